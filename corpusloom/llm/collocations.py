"""Phrases whose words go together: position bitmaps per word, shifted and intersected, in shards of the corpus.

1. shards(): each task turns its texts into shards of one language. A shard is a dictionary
   of its words and the words' numbers in order, the first of each piece marked.
2. In a shard every word is a bitmap over positions. Only its non-zero blocks of 16
   positions are kept, as (block, bits). A phrase's bitmap marks where it ends; shifted
   by one, cut at the pieces' beginnings and intersected with a word's bitmap it becomes
   the bitmap of the phrase with that word, and its population count the local count.
   A stack of bitmaps goes depth first; what a step makes is bounded by BATCH entries.
3. Local counts are summed over shards. Two filters of fixed size keep shards from extending phrases that
   can't be frequent: one of frequent words, one of pairs. Pairs are first counted by slot, a hash whose range grows
   with the corpus, which takes two or three bytes for each pair of a shard; a pair whose slot doesn't reach
   the limit can't. A false hit of a filter costs time only: every count is the exact sum over all
   shards, and the limit is applied to the sums.
4. Scores, the rule about longer phrases and the ranking are joins and aggregates over frequent phrases.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.arrow import schema_of
from corpusloom.llm.words import hash_words, mix, text_chunks
from corpusloom.runtime import Scratch, configured, materialise

#: Words of a shard; a task holds four times as many at most, and one more text.
SHARD = 1 << 20
#: Entries of bitmaps that are extended at once.
BATCH = 1 << 17
#: Bits of a filter, whatever the number of phrases.
BITS = 1 << 25
_WIDTH = 16
_CUT = bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)
_PAIR = np.uint64(0xD6E8FEB86659FD93)


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of each piece of a UTF-8 text, A-Z lower-cased; pieces without words are left out."""
    for piece in text.lower().translate(_CUT).split(b"\n"):
        if words := piece.split():
            yield words


class _Open:
    """A shard that still grows: dictionary, and numbers of words with the first of a piece as its complement."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.tokens = array("i")

    def add(self, words: list[bytes]) -> None:
        known = self.known
        at = len(self.tokens)
        self.tokens.extend([known.setdefault(w, len(known)) for w in words])
        self.tokens[at] = ~self.tokens[at]


def shards(docs: DataFrame, size: int = SHARD) -> DataFrame:
    """shard, lang, vocabulary (words joined by spaces), tokens (binary, 32-bit numbers), n_tokens, for docs (lang, text).

    A null language is 'und', a null text empty. Numbers of shards are the task's times 2^33 plus a
    counter. The result should be written, since later steps read it several times.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, filled = TaskContext.get().partitionId() << 33, {}, 0

        def row(lang: str) -> pa.RecordBatch:
            nonlocal number
            done = held.pop(lang)
            number += 1
            values = [number - 1], [lang], [b" ".join(done.known)], [done.tokens.tobytes()], [len(done.tokens)]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.int64()), strict=True)], ["shard", "lang", "vocabulary", "tokens", "n_tokens"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for words in pieces(text or b""):
                    if (own := held.get(lang)) is None:
                        own = held[lang] = _Open()
                    own.add(words)
                    filled += len(words)
                    if len(own.tokens) >= size:
                        filled -= len(own.tokens)
                        yield row(lang)
                    elif filled >= 4 * size:
                        most = max(held, key=lambda x: len(held[x].tokens))
                        filled -= len(held[most].tokens)
                        yield row(most)
        for lang in list(held):
            yield row(lang)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, schema_of("shard long, lang string, vocabulary binary, tokens binary, n_tokens long"))


def _counts(lang: str, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    names = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(counts), np.int32)), pa.array([lang])).cast(pa.string())
    return pa.RecordBatch.from_arrays([names, phrases.cast(pa.string()), pa.array(counts, pa.int64())], ["lang", "phrase", "c"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes, np.ndarray]]:
    """lang, vocabulary and tokens of each shard."""
    for batch in batches:
        for k in range(batch.num_rows):
            tokens = np.frombuffer(batch.column("tokens")[k].as_buffer(), np.int32)
            yield batch.column("lang")[k].as_py(), batch.column("vocabulary")[k].as_buffer().to_pybytes(), tokens


def word_counts(shards: DataFrame) -> DataFrame:
    """lang, phrase, c: occurrences of each word in each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, vocabulary, tokens in _rows(batches):
            words = pa.array(vocabulary.split(b" "), pa.binary())
            yield _counts(lang, words, np.bincount(np.where(tokens < 0, ~tokens, tokens), minlength=len(words)))

    return shards.select("lang", "vocabulary", "tokens").mapInArrow(run, schema_of("lang string, phrase string, c long"))


def _language(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def _slots(hashes: np.ndarray, count: int) -> np.ndarray:
    return (mix(hashes) % np.uint64(count)).astype(np.int64)


def bit_filter(slots: DataFrame) -> np.ndarray:
    """BITS bits as bytes; each number in the column `slot` sets one. The driver gets at most BITS / 64 rows."""
    place = F.pmod(F.col("slot"), F.lit(BITS))
    words = slots.select(F.shiftright(place, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(slot, {BITS}) & 63 as int))").alias("b"))
    rows = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(BITS // 64, np.int64)
    bits[rows.column("w").to_numpy()] = rows.column("b").to_numpy()
    return bits.view(np.uint8)


def word_slots(words: DataFrame) -> DataFrame:
    """slot of each word (lang, phrase)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = {x: _language(x) for x in pc.unique(batch.column("lang")).to_pylist()}
            salt = np.array([langs[x] for x in batch.column("lang").to_pylist()], np.uint64)
            for at, data, bounds in text_chunks(batch.column("phrase")):
                found = hash_words(data, bounds, lower=False)[0]
                yield pa.RecordBatch.from_arrays([pa.array(_slots(found ^ salt[at : at + len(found)], BITS))], ["slot"])

    return words.select("lang", "phrase").mapInArrow(run, schema_of("slot long"))


def _set(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    slots = slots % BITS
    return (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 != 0


class Bitmaps:
    """The position bitmaps of a shard's words, by block: (word, bits) of each block, and where pieces go on."""

    def __init__(self, tokens: np.ndarray, allowed: np.ndarray):
        ids = np.where(tokens < 0, ~tokens, tokens)
        self.blocks = len(ids) // _WIDTH + 1
        inner = np.zeros(self.blocks * _WIDTH, bool)
        inner[: len(ids)] = tokens >= 0
        self.inner = np.packbits(inner, bitorder="little").view("<u2")  # the bits of positions that aren't a piece's first
        at = np.flatnonzero(allowed[ids])
        key = (at // _WIDTH) * np.int64(len(allowed)) + ids[at]
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.bits = np.bitwise_or.reduceat((1 << (at % _WIDTH)).astype(np.uint16), first) if len(first) else np.zeros(0, np.uint16)
        self.block, self.word = (key[first] // len(allowed)).astype(np.int32), (key[first] % len(allowed)).astype(np.int32)
        self.begin = np.searchsorted(self.block, np.arange(self.blocks + 1))

    def extend(self, phrase: np.ndarray, block: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """phrase, word, block, bits of the bitmaps of all phrases with all words behind them, without those that are empty."""
        shifted = bits.astype(np.uint32) << np.uint32(1)
        carry = np.flatnonzero((shifted >> np.uint32(_WIDTH)) & (block + 1 < self.blocks))
        phrase = np.concatenate([phrase, phrase[carry]])
        bits = np.concatenate([(shifted & np.uint32(0xFFFF)).astype(np.uint16), np.ones(len(carry), np.uint16)])
        block = np.concatenate([block, block[carry] + 1])
        bits = bits & self.inner[block]
        some = np.flatnonzero(bits)
        phrase, block, bits = phrase[some], block[some], bits[some]
        begin = self.begin[block]
        counts = self.begin[block + 1] - begin
        row = np.repeat(np.arange(len(block), dtype=np.int32), counts)
        entry = np.arange(len(row)) + np.repeat(begin - np.cumsum(counts) + counts, counts)
        both = bits[row] & self.bits[entry]
        hit = np.flatnonzero(both)
        row, entry = row[hit], entry[hit]
        return phrase[row], self.word[entry], block[row], both[hit]


class Shard:
    """A shard as bitmaps of its allowed words; walks phrases depth first."""

    def __init__(self, lang: str, vocabulary: bytes, tokens: np.ndarray, words: np.ndarray):
        self.lang, self.known = lang, pa.array(vocabulary.split(b" "), pa.binary())
        self.hashes = hash_words(np.frombuffer(vocabulary, np.uint8), np.array([0, len(vocabulary)]), lower=False)[0]
        self.salt = _language(lang)
        self.maps = Bitmaps(tokens, _set(words, _slots(self.hashes ^ self.salt, BITS)))

    def pair_slots(self, left: np.ndarray, right: np.ndarray, count: int) -> np.ndarray:
        return _slots((self.hashes[left] * _PAIR + self.hashes[right]) ^ self.salt, count)

    def walk(self, longest: int, allow=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(words of each phrase as a row, occurrences) of phrases of two words to `longest`; allow(left, right): which pairs to go on with."""
        maps = self.maps
        order = np.argsort(maps.word, kind="stable")
        one, number = np.unique(maps.word[order], return_inverse=True)
        # names: the words of each phrase of a batch; phrase, block, bits: their bitmaps
        stack = [(one[:, None], number.astype(np.int32), maps.block[order], maps.bits[order])]
        while stack:
            names, phrase, block, bits = stack.pop()
            if len(block) > BATCH:
                stack += [(names, phrase[k : k + BATCH], block[k : k + BATCH], bits[k : k + BATCH]) for k in range(0, len(block), BATCH)]
                continue
            phrase, word, block, bits = maps.extend(phrase, block, bits)
            if allow is not None:
                some = np.flatnonzero(allow(names[phrase, -1], word))
                phrase, word, block, bits = phrase[some], word[some], block[some], bits[some]
            if not len(word):
                continue
            key = phrase * np.int64(len(self.known)) + word
            order = np.argsort(key, kind="stable")
            key = key[order]
            new = np.concatenate([[True], key[1:] != key[:-1]])
            first = np.flatnonzero(new)
            bits, child = bits[order], (np.cumsum(new) - 1).astype(np.int32)
            names = np.concatenate([names[phrase[order[first]]], word[order[first], None]], 1)
            yield names, np.add.reduceat(np.bitwise_count(bits).astype(np.int64), first)
            if names.shape[1] < longest:
                stack.append((names, child, block[order], bits))


def frequent_slots(shards: DataFrame, words: np.ndarray, least: int, slots: int) -> DataFrame:
    """slot: those of the numbers below `slots` whose pairs occur `least` times or more in all.

    A shard sends its counts by blocks of 65536 slots, as sorted 16-bit numbers and the counts up to `least`. A
    block's sums are made in one task; it gets as many rows as there are shards, of a few bytes for each pair.
    """
    sent = shards.sparkSession.sparkContext.broadcast(words)
    kind = np.uint8 if least < 256 else np.uint32

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            shard = Shard(*row, sent.value)
            walked = list(shard.walk(2))
            if not walked:
                continue
            slot = np.concatenate([shard.pair_slots(names[:, 0], names[:, 1], slots) for names, _ in walked])
            found, inverse = np.unique(slot, return_inverse=True)
            n = np.minimum(np.bincount(inverse, np.concatenate([c for _, c in walked])), least).astype(kind)
            low, block = (found & 65535).astype(np.uint16), found >> 16
            cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            ends = np.append(cuts[1:], len(block)).tolist()
            columns = [block[cuts].tolist(), [low[a:b].tobytes() for a, b in zip(cuts.tolist(), ends, strict=True)], [n[a:b].tobytes() for a, b in zip(cuts.tolist(), ends, strict=True)]]
            for at in range(0, len(cuts), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 2000], t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["block", "low", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, np.zeros(65536, np.int64)

        def passed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array((now << 16) + np.flatnonzero(sums >= least))], ["slot"])

        for batch in batches:
            for block, low, n in zip(batch.column("block").to_pylist(), batch.column("low"), batch.column("n"), strict=True):
                if block != now:
                    if now is not None:
                        yield passed()
                    now = block
                    sums[:] = 0
                sums[np.frombuffer(low.as_buffer(), np.uint16)] += np.frombuffer(n.as_buffer(), kind)
        if now is not None:
            yield passed()

    counts = shards.select("lang", "vocabulary", "tokens").mapInArrow(count, schema_of("block long, low binary, n binary"))
    return counts.repartition("block").sortWithinPartitions("block").mapInArrow(add, schema_of("slot long"))


def phrase_counts(shards: DataFrame, words: np.ndarray, pairs: np.ndarray, slots: int, longest: int) -> DataFrame:
    """lang, phrase, c: occurrences in each shard of phrases of two words to `longest`, found depth first.

    Phrases with a word that isn't in the filter `words`, or two words in a row whose slot isn't in the
    filter `pairs`, are left out. A phrase may come several times for a shard: its counts add up.
    """
    sent = shards.sparkSession.sparkContext.broadcast((words, pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = sent.value
        for row in _rows(batches):
            shard = Shard(*row, words)
            for names, counts in shard.walk(longest, lambda a, b, shard=shard: _set(pairs, shard.pair_slots(a, b, slots))):
                yield _counts(shard.lang, pc.binary_join_element_wise(*(shard.known.take(pa.array(names[:, k])) for k in range(names.shape[1])), b" "), counts)

    return shards.select("lang", "vocabulary", "tokens").mapInArrow(run, schema_of("lang string, phrase string, c long"))


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of phrases of up to `longest` words that occur `least` times or more, and (lang, n) of words in all."""
    with Scratch(docs.sparkSession) as scratch:
        # few shards in a file, so that a reader's batch, which never crosses files, stays small
        with configured(docs.sparkSession, {"spark.sql.files.maxRecordsPerFile": "4"}):
            dealt = scratch.keep(shards(docs), "shards")

        def summed(counts: DataFrame, path: str) -> DataFrame:
            return materialise(counts.groupBy("lang", "phrase").agg(F.sum("c").alias("f")).filter(F.col("f") >= least), path)

        every = summed(word_counts(dealt), "words")
        sizes = materialise(dealt.groupBy("lang").agg(F.sum("n_tokens").alias("n")), "sizes")
        if longest >= 2:
            words = bit_filter(word_slots(every))
            # about four words of the corpus for each slot, so that few slots reach the limit by chance
            n = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
            slots = max(1 << 16, n // 4)
            pairs = bit_filter(frequent_slots(dealt, words, least, slots))
            every = every.unionAll(summed(phrase_counts(dealt, words, pairs, slots, longest), "phrases"))
    return every.select("lang", "phrase", (F.length("phrase") - F.length(F.replace("phrase", F.lit(" "))) + 1).cast("int").alias("k"), "f"), sizes


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of each language, for docs (lang, text).

    Texts are lower-cased (A-Z) and split at . , ; : ! ? and line ends into pieces, those at spaces and tabs
    into words. A candidate has 2 to `longest` words and occurs a >= `least` times within pieces. Its score is
    the least over its cuts of floor(1000 a n / (l r)), l and r being the occurrences of the two parts and n
    those of all words of the language; of equal cuts the first counts. A candidate goes if one longer candidate that
    holds it is as frequent: then a phrase of one more word is, too. Order: score, a, both falling, then phrase.

    A null language is 'und', a null or empty text has no words; repeated rows count again; other
    columns are ignored. Products are decimals of 38 digits.
    """
    every, sizes = frequent_phrases(docs, least, longest)
    some = every.filter("k >= 2").withColumnRenamed("f", "a")
    word = F.split("phrase", " ")
    cut = some.select("lang", "phrase", "k", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("at"))
    cut = cut.withColumn("left", F.array_join(F.slice(word, F.lit(1), F.col("at")), " ")).withColumn("right", F.array_join(F.slice(word, F.col("at") + 1, F.col("k") - F.col("at")), " "))
    cut = cut.join(every.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cut = cut.join(every.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    cut = cut.join(sizes, "lang")
    score = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = cut.withColumn("score", score).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "at", "l", "r")).alias("x"))
    inside = some.filter("k >= 3").select("lang", "a", F.explode(F.array(F.array_join(F.slice(word, F.lit(1), F.col("k") - 1), " "), F.array_join(F.slice(word, F.lit(2), F.col("k") - 1), " "))).alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(inside, ["lang", "phrase"], "left").filter("longer is null or longer < a")
    kept = kept.select("lang", "phrase", "a", F.col("x.l").alias("l"), F.col("x.r").alias("r"), "n", F.col("x.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
