"""Language-model scores: the marginal probability of a text over all its segmentations.

The vocabulary of an existing subword tokenizer gives the pieces. Their weights
are the frequencies of the tokenizer's own segmentation of the training words.
Each training word is a further piece, for that word as a whole, weighted by its count; so
what is learnt grows with the corpus. Beside it an escape leads into the vocabulary's pieces, with
the weight that Witten and Bell give to unseen events: of n tokens, v of them distinct,
the word c / (n + v), the escape v / (n + v).
A text is a sequence of words, each opened by a word mark and made of pieces,
and an end piece. No piece crosses words, so the lattice of a text falls apart
into the lattices of its words: a word's marginal is made once by a forward recursion
in log space, however often the word occurs.

Texts are taken in blocks of a task's rows, up to BLOCK bytes. Each block numbers its
own words; texts become counts of numbers. Only (block, word) rows meet the
corpus-wide counts, by a join, so neither vocabulary nor counts need fit in one place.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrow import map_rows, schema_of
from corpusloom.runtime import materialise

#: Bytes of text whose words are numbered together.
BLOCK = 16 << 20
#: Texts that are Python objects at once.
ROWS = 200
#: What is added to each piece's count.
SMOOTHING = 0.1
#: The tokenizer's mark of a word's beginning.
MARK = "▁"


class Numbers(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def planes(values: np.ndarray) -> bytes:
    """Integers as 32-bit, all lowest bytes first, then the next ones: small numbers then compress well."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def in_training(doc_id) -> bool:
    """crc32 of the id as text, modulo 7, is not 2; a null id counts as ''."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 != 2


def number_words(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows of two kinds, from one pass.

    Documents: block, doc_id, held_out, n_tokens, words (numbers and counts, packed).
    Words: block, number, word, train (occurrences in the block's training texts).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 33
        numbers, size, train = Numbers(), 0, np.zeros(1024, np.int64)
        # few rows at once as Python objects, whatever a batch holds
        for batch in (b.slice(low, ROWS) for b in batches for low in range(0, b.num_rows, ROWS)):
            held: list[tuple] = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = (t or "").encode().lower()
                words = data.split()
                own = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
                found, counts = np.unique(own, return_counts=True)
                training = in_training(k)
                if len(numbers) > len(train):
                    train = np.concatenate([train, np.zeros(max(len(train), len(numbers) - len(train)), np.int64)])
                if training:
                    train[found] += counts
                gaps = np.diff(found, prepend=0)
                held.append((at, k, not training, len(words) + 1, planes(gaps) + planes(counts), None, None, None))
                size += len(data)
                if size >= block:
                    yield out(held)
                    held = []
                    yield from vocabulary(at, numbers, train)
                    at, numbers, size, train = at + 1, Numbers(), 0, np.zeros(1024, np.int64)
            if held:
                yield out(held)
        if numbers:
            yield from vocabulary(at, numbers, train)

    def vocabulary(at: int, numbers: Numbers, train: np.ndarray) -> Iterator[pa.RecordBatch]:
        words = [w.decode() for w in numbers]
        for low in range(0, len(words), 50_000):
            part = words[low : low + 50_000]
            n = len(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, at, np.int64)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(np.arange(low, low + n, dtype=np.int32)), pa.array(part), pa.array(train[low : low + n])],
                names,
            )

    def out(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)

    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.int32(), pa.string(), pa.int64()]
    names = ["block", "doc_id", "held_out", "n_tokens", "words", "number", "word", "train"]
    ddl = "block long, doc_id long, held_out boolean, n_tokens long, words binary, number int, word string, train long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema_of(ddl))


class Lattice:
    """Natural-log weights of pieces, and the marginals of words under them."""

    def __init__(self, pieces: dict[str, float], byte_pieces: list[float]):
        self.bytes = byte_pieces
        #: For each piece its weight, for each beginning of one (that is none itself) minus infinity.
        self.tree: dict[str, float] = {}
        for piece, weight in pieces.items():
            for k in range(1, len(piece)):
                self.tree.setdefault(piece[:k], -math.inf)
            self.tree[piece] = weight

    def marginal(self, word: str) -> float:
        """log of the sum over all segmentations of the product of the pieces' weights."""
        text = MARK + word
        n, get, exp, log, none = len(text), self.tree.get, math.exp, math.log, -math.inf
        reach: list[list[float]] = [[] for _ in range(n + 1)]
        now = 0.0
        for i in range(n):
            if i:
                found = reach[i]
                if len(found) == 1:
                    now = found[0]
                else:
                    top = max(found)
                    now = top + log(sum([exp(x - top) for x in found])) if top > none else none
                reach[i] = found = []
            # a character spelt in bytes is always a way on
            reach[i + 1].append(now + sum([self.bytes[b] for b in text[i].encode()]))
            for j in range(i + 1, n + 1):
                weight = get(text[i:j])
                if weight is None:
                    break
                if weight > none:
                    reach[j].append(now + weight)
        found = reach[n]
        top = max(found)
        return top + log(sum([exp(x - top) for x in found]))


def with_whole(pieces: float, c: int, n: int, v: int) -> float:
    """log of the sum of two ways: the token itself, seen c times of n, or by an escape to its pieces (a log); v distinct tokens."""
    if not n:
        return pieces
    escaped = math.log(v / (n + v)) + pieces
    if not c:
        return escaped
    whole = math.log(c / (n + v))
    top = max(whole, escaped)
    return top + math.log(math.exp(whole - top) + math.exp(escaped - top))


def load_pieces(path: str) -> tuple[list[str], list[int]]:
    """The pieces of a sentencepiece model by id, and the ids of the 256 byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(k) for k in range(model.get_piece_size())]
    return names, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]


def piece_counts(counts: DataFrame, path: str) -> DataFrame:
    """piece (id), n: how often the tokenizer's own segmentation of the training words (word, c) uses each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        sums = np.zeros(model.get_piece_size(), np.int64)
        for batch in batches:
            words, often = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for low in range(0, len(words), 5000):
                found = model.encode(words[low : low + 5000], num_threads=1)
                ids = np.fromiter((k for f in found for k in f), np.int64)
                np.add.at(sums, ids, np.repeat(often[low : low + 5000], [len(f) for f in found]))
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(sums[used])], ["piece", "n"])

    return counts.filter("c > 0").select("word", "c").mapInArrow(run, schema_of("piece int, n long")).groupBy("piece").agg(F.sum("n").alias("n"))


def score_documents(docs: DataFrame, path: str, block: int = BLOCK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs (doc_id, text).

    Tokens: words (runs of other than the six ASCII white-space characters, A-Z
    lower-cased), then one end. base_score: log10 of the add-one word model from
    the training texts. score: log10 of the text's marginal probability under the
    lattice of pieces and whole training words; without training texts, of pieces
    alone. `path` is the sentencepiece model. Training texts are those of in_training().
    Null and empty texts are the end alone; repeated rows are scored, and learnt from, each.
    """
    numbered = materialise(number_words(docs, block), "numbered")
    texts = numbered.filter("words is not null").select("block", "doc_id", "held_out", "n_tokens", "words")
    vocabulary = numbered.filter("word is not null").select("block", "number", "word", "train")
    counts = materialise(vocabulary.groupBy("word").agg(F.sum("train").alias("c")), "counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    ends = texts.filter("not held_out").count()
    n, v = n + ends, v + (ends > 0)
    # one row for each piece of a fixed vocabulary at most
    seen = {r.piece: r.n for r in piece_counts(counts, path).collect()}
    names, byte_ids = load_pieces(path)
    total = sum(seen.values()) + ends + SMOOTHING * (len(names) + 1)
    weights = [math.log((seen.get(k, 0) + SMOOTHING) / total) for k in range(len(names))]
    end_weight = with_whole(math.log((ends + SMOOTHING) / total), ends, n, v)
    special = {0, 1, 2, *byte_ids}
    pieces = {p: w for k, (p, w) in enumerate(zip(names, weights, strict=True)) if k not in special}
    shared = docs.sparkSession.sparkContext.broadcast((pieces, [weights[k] for k in byte_ids]))

    def marginals(rows: Iterator[tuple]) -> Iterator[tuple]:
        lattice = Lattice(*shared.value)
        for word, c in rows:
            yield word, c, with_whole(lattice.marginal(word), c, n, v)

    known = map_rows(counts.select("word", "c"), marginals, "word string, c long, weight double")
    found = vocabulary.select("block", "number", "word").join(known, "word").select(F.col("block").alias("of"), "number", "c", "weight")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        numbers = right.column("number").to_numpy()
        often, weight = np.zeros(len(numbers), np.int64), np.zeros(len(numbers))
        often[numbers] = right.column("c").to_numpy()
        weight[numbers] = right.column("weight").to_numpy()
        base = np.log10((often + 1) / (n + v + 1))
        end = math.log10((ends + 1) / (n + v + 1))
        known, bases, scores = [], [], []
        for raw in left.column("words").to_pylist():
            half = len(raw) // 2
            words, times = np.cumsum(unplanes(raw[:half])), unplanes(raw[half:]).astype(np.int64)
            known.append(int(times[often[words] > 0].sum()) + (ends > 0))
            bases.append(float(base[words] @ times) + end)
            scores.append((float(weight[words] @ times) + end_weight) / math.log(10))
        columns = [left.column(c) for c in ("doc_id", "held_out", "n_tokens")]
        columns += [pa.array(known, pa.int64()), pa.array([n] * len(known), pa.int64()), pa.array(bases, pa.float64()), pa.array(scores, pa.float64())]
        return pa.table(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    ddl = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return texts.groupBy("block").cogroup(found.groupBy("of")).applyInArrow(score, schema_of(ddl))
