"""One-permutation MinHash with optimal densification, kept as packed low-order bits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrow import map_rows
from corpusloom.llm.words import hash_words, mix, shingles, text_chunks

BINS, BITS = 256, 4
_BOUNDS = (np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)).astype(np.uint64)
#: For each bin, the order in which it asks the others when it is empty (each a random permutation).
_RANKS = np.random.default_rng(11).permuted(np.tile(np.arange(BINS, dtype=np.uint16), (BINS, 1)), axis=1)

_OWN = np.random.default_rng(12).integers(0, 2**63, BINS, dtype=np.uint64)


def bins_of(sets: np.ndarray) -> np.ndarray | None:
    """The low-order bits of each bin's least hash; sets: sorted distinct hashes of shingles.

    The high bits of a hash name its bin, so one pass over the set fills all bins.
    An empty bin takes the value of the first full one in its own random order,
    independent of the other bins'; equal sets fill alike. None for no shingle.
    """
    if not len(sets):
        return None
    at = np.searchsorted(sets, _BOUNDS)
    full = np.append(at[1:], len(sets)) > at
    out = np.zeros(BINS, np.uint64)
    out[full] = sets[at[full]]
    if not full.all():
        donors = np.flatnonzero(full)
        empty = np.flatnonzero(~full)
        out[empty] = out[donors[_RANKS[np.ix_(empty, donors)].argmin(1)]]
    # each bin keeps bits of its own hash of the value, so that chance agreements of two values are independent over bins
    return (mix(out ^ _OWN) & np.uint64((1 << BITS) - 1)).astype(np.uint8)


def pack(bins: np.ndarray | None) -> str:
    """Hexadecimal digits, one for each bin's 4 bits; '' for no shingle."""
    return "" if bins is None else ((bins[0::2] << 4) | bins[1::2]).astype(np.uint8).tobytes().hex()


def unpack(fingerprint: str) -> np.ndarray | None:
    if not fingerprint:
        return None
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8)
    return np.stack([raw >> 4, raw & 15], 1).ravel()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Estimated Jaccard similarity: the share of equal bins, less what chance makes equal, from 0 to 1.

    Unequal values agree in their low bits with probability 2^-BITS. Two texts without shingles are alike, one is unlike any other.
    """
    if a is None or b is None:
        return float(a is None and b is None)
    chance = 2.0**-BITS
    return float(min(1.0, max(0.0, ((a == b).mean() - chance) / (1 - chance))))


def fingerprints(texts: list[str], size: int = 5) -> list[np.ndarray | None]:
    out = []
    for _, data, bounds in text_chunks(pa.array(texts, pa.large_string())):
        hashes, _, _, words = hash_words(data, bounds, lower=True)
        out += [bins_of(shingles(hashes[words[k] : words[k + 1]], size)) for k in range(len(bounds) - 1)]
    return out


def fingerprint_documents(docs: DataFrame, size: int = 5) -> DataFrame:
    """doc_id and fingerprint for every row of docs (doc_id, text); no shuffle.

    Shingles are `size` lower-cased (A-Z) words; a text with fewer words is one
    shingle; null, empty and white-space texts have the fingerprint ''. Equal texts have
    equal fingerprints; repeated rows and null ids give rows of their own.
    """

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for part in chunks(rows, 256):
            for (k, _), bins in zip(part, fingerprints([t or "" for _, t in part], size), strict=True):
                yield k, pack(bins)

    return map_rows(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def chunks(rows: Iterator[tuple], n: int) -> Iterator[list[tuple]]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= n:
            yield held
            held = []
    if held:
        yield held


def _place(column: Column, cuts: list[int], low: int, high: int) -> Column:
    """The number of cuts below a value, by binary search in nested conditions."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(column <= cuts[middle], _place(column, cuts, low, middle)).otherwise(_place(column, cuts, middle + 1, high))


def followed(docs: DataFrame) -> DataFrame:
    """bucket, tail, doc_id, text: buckets of falling doc_id whose last row (tail) is the next bucket's first.

    Ranges of doc_id are cut at quantiles; the largest id of each range, which
    the range before it needs, is copied there. So every text goes through one shuffle, and no
    task needs more than one row of another. After the smallest id comes the largest again.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("_key", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = rows.select("_key")
    cuts = sorted({int(x) for x in ids.filter(F.col("_key") > -(1 << 63)).approxQuantile("_key", [k / n for k in range(1, n)], 0.1 / n)})
    place = _place(F.col("_key"), cuts, 0, len(cuts)).cast("int")
    # one row for each range at most, as many as there are buckets
    heads = sorted((r.bucket, r.head) for r in ids.groupBy(place.alias("bucket")).agg(F.max("_key").alias("head")).collect())
    if not heads:
        return rows.select(F.lit(0).alias("bucket"), F.lit(0).alias("tail"), "doc_id", "_key", "text")
    above = [b for b, _ in heads[1:]] + [heads[0][0]]
    table = spark.createDataFrame([(head, to) for (_, head), to in zip(heads, above, strict=True)], "_head long, _to int")
    copied = rows.join(F.broadcast(table), rows["_key"] == table["_head"], "left").withColumn("_at", place)
    both = F.array_compact(F.array(F.struct(F.col("_at").alias("bucket"), F.lit(0).alias("tail")), F.when(F.col("_to").isNotNull(), F.struct(F.col("_to").alias("bucket"), F.lit(1).alias("tail")))))
    dealt = copied.withColumn("_x", F.explode(both)).select("_x.bucket", "_x.tail", "doc_id", "_key", "text")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "tail", F.desc("_key"), F.xxhash64("text"))


def edit(text: str, following: str) -> str:
    """The last floor(n/2) code points of a text replaced by the first as many (or all) of another."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def fingerprint_edits(docs: DataFrame, size: int = 5) -> DataFrame:
    """Fingerprints of each text and of the text edited with its follower in falling doc_id.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. Null texts count as empty, null ids come last; rows with equal doc_id
    follow each other in the order of a hash of their texts; a single row follows itself.
    """

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        before: tuple | None = None
        for part in chunks(rows, 128):
            pairs = []
            held = [*([before] if before else []), *part]
            for row, after in zip(held, held[1:], strict=False):
                if row[0] == after[0] and not row[1]:
                    pairs.append((row, after))
            before = held[-1]
            if not pairs:
                continue
            plain = {id(r): r for p in pairs for r in p}
            own = dict(zip(plain, fingerprints([r[3] for r in plain.values()], size), strict=True))
            edited = [edit(r[3], a[3]) for r, a in pairs]
            for (row, after), text, bins in zip(pairs, edited, fingerprints(edited, size), strict=True):
                mine = own[id(row)]
                yield row[2], len(row[3]), hashlib.sha256(text.encode()).hexdigest(), pack(mine), pack(bins), likeness(mine, bins), likeness(mine, own[id(after)])

    rows = followed(docs).select("bucket", "tail", "doc_id", "text")
    return map_rows(rows, run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
