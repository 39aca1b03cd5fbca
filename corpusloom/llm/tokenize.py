"""BPE encoding and decoding, token counts of sections, packing into power-of-two sequences.

All three stream Arrow batches through one encoder per task; no shuffle, no
state between texts but bounded caches. Encoders are made in the task from a
vocabulary file whose path is a parameter and must exist on every executor.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrow import map_rows
from corpusloom.llm.bpe import ByteBpe, WordBpe


def encode_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's ids under the word tokenizer at `path`, and the text that the ids decode to.

    Returns key, ids (binary, little-endian unsigned 32-bit), decoded (string).
    Null and empty texts have no ids and decode to ''. Repeated rows give repeated
    rows; other columns are ignored. A run of any length is encoded with constant
    memory besides the text and its ids (see WordBpe.stream_word).
    """

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        bpe = WordBpe(path)
        for k, t in rows:
            ids = bpe.encode(t)
            yield k, ids, bpe.decoder().feed(np.frombuffer(ids, "<u4"), final=True)

    return map_rows(docs.select(key, text), run, f"{key} {docs.schema[key].dataType.simpleString()}, ids binary, decoded string")


def encode_digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As encode_decode, but ids and decoded text stay in the task: key, n_tokens, ids_sha256, decoded_sha256."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        bpe = WordBpe(path)
        for k, t in rows:
            ids = bpe.encode(t)
            digest, decoder = hashlib.sha256(), bpe.decoder()
            for at in range(0, len(ids), 1 << 18):
                digest.update(decoder.feed(np.frombuffer(ids[at : at + (1 << 18)], "<u4")).encode())
            yield k, len(ids) // 4, hashlib.sha256(ids).hexdigest(), digest.hexdigest()

    return map_rows(docs.select(key, text), run, f"{key} {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def binary_pieces(n: int, longest: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full pieces first, then the powers of two of what is left, falling."""
    start = 0
    while n - start >= longest:
        yield start, longest
        start += longest
    rest = n - start
    while rest:
        size = 1 << (rest.bit_length() - 1)
        yield start, size
        start += size
        rest -= size


def pack(docs: DataFrame, path: str, special: dict[str, int] | None = None, end: int = 0, longest: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Sequences of power-of-two length, each from one document only.

    A document's ids (byte tokenizer at `path`, then the id `end`) are cut into
    pieces whose lengths are powers of two up to `longest` (itself a power of
    two); every piece is a sequence of its own, so there is no padding and no sequence
    crosses documents. `bucket` is the log2 of the length: a reader batches
    within a bucket. A null or empty text is the one id `end`.

    Returns key, start, length, bucket, ids (binary), doc_tokens, sequence_id,
    offset. sequence_id is the task's number times 2^33 plus a counter, as
    Spark's own monotonically increasing ids: unique, and the same again when a
    lost task is repeated on the same partition; no shuffle is needed.
    """

    def keep(pieces: Iterator[tuple]) -> Iterator[tuple]:
        return ((k, start, size, size.bit_length() - 1, ids, n, at, 0) for k, start, size, ids, n, at in pieces)

    return _packed(docs, path, special, end, longest, key, text, keep, "bucket int, ids binary, doc_tokens long, sequence_id long, offset long")


def bucketed(packed: DataFrame, tasks: int = 64) -> DataFrame:
    """Rows of pack() gathered by bucket: each partition holds stretches of sequences of one length.

    A bucket is dealt to `tasks` pieces by the sequences' ids, so the fullest one isn't sorted in one
    task. A reader takes a stretch as batches of equal length, without padding. write_buckets() puts them in folders.
    """
    piece = F.pmod(F.xxhash64("sequence_id", "start"), F.lit(tasks))
    return packed.repartition("bucket", piece).sortWithinPartitions("bucket", "sequence_id", "offset")


def write_buckets(packed: DataFrame, path: str) -> None:
    """bucketed() rows as Parquet, a folder for each bucket."""
    bucketed(packed).write.mode("overwrite").partitionBy("bucket").parquet(path)


def pack_digests(docs: DataFrame, path: str, special: dict[str, int] | None = None, end: int = 0, longest: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """pack() in the same pass, with ids_crc32 in the place of ids."""

    def digest(pieces: Iterator[tuple]) -> Iterator[tuple]:
        return ((k, start, size, zlib.crc32(ids), n, at, 0, size.bit_length() - 1) for k, start, size, ids, n, at in pieces)

    return _packed(docs, path, special, end, longest, key, text, digest, "ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int")


def _packed(docs: DataFrame, path: str, special: dict[str, int] | None, end: int, longest: int, key: str, text: str, then: Callable, columns: str) -> DataFrame:
    if longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    last = int(end).to_bytes(4, "little")

    def pieces(rows: Iterator[tuple]) -> Iterator[tuple]:
        from pyspark import TaskContext

        bpe, at = ByteBpe(path, special), TaskContext.get().partitionId() << 33
        for k, t in rows:
            ids = bpe.encode(t) + last
            n = len(ids) // 4
            for start, size in binary_pieces(n, longest):
                yield k, start, size, ids[4 * start : 4 * (start + size)], n, at
                at += 1

    return map_rows(docs.select(key, text), lambda rows: then(pieces(rows)), f"{key} {docs.schema[key].dataType.simpleString()}, start long, length long, {columns}")


def line_sections(text: str) -> list[tuple[str, int, int]]:
    """Sections of a text: each line with its line feed, as (name, first and end byte in UTF-8)."""
    out, at = [], 0
    for k, line in enumerate(text.encode().split(b"\n")):
        out.append((f"line {k}", at, at + len(line) + 1))
        at += len(line) + 1
    if out:
        name, a, b = out[-1]
        out[-1] = (name, a, b - 1)
    return [x for x in out if x[1] < x[2]]


#: To which section a token that crosses a boundary goes.
RULES = ("first", "last", "most")


def attribute(widths: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and those among them that reach beyond it.

    widths: bytes of each token, in order; starts, ends: the sections' byte
    spans, in order and without overlap. A token that touches no section is not
    counted. `rule` for a token over several sections: "first" or "last" of
    them, or "most": the one with most of its bytes, the first of equals.
    """
    n = len(starts)
    if not n or not len(widths):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    stop = np.cumsum(widths)
    begin = stop - widths
    low = np.searchsorted(ends, begin, "right")  # the first section that ends after the token begins
    high = np.searchsorted(starts, stop, "left") - 1  # the last section that begins before the token ends
    touched = (low <= high) & (widths > 0)
    low, high, begin, stop = low[touched], high[touched], begin[touched], stop[touched]
    if rule == "first":
        to = low
    elif rule == "last":
        to = high
    else:
        to = low.copy()
        for k in np.flatnonzero(high > low):
            shares = np.minimum(ends[low[k] : high[k] + 1], stop[k]) - np.maximum(starts[low[k] : high[k] + 1], begin[k])
            to[k] = low[k] + int(shares.argmax())
    crossing = (begin < starts[to]) | (stop > ends[to])
    return np.bincount(to, minlength=n), np.bincount(to[crossing], minlength=n)


def count_tokens(docs: DataFrame, path: str, special: dict[str, int] | None = None, rule: str = "first", sections=line_sections, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokens of every section of every text; the whole text is encoded once.

    sections(text) gives (name, first byte, end byte) in order without overlap,
    by default the lines. Byte-level tokens join to the text's own bytes, so
    their spans are running sums of token widths, and sections meet tokens by
    binary search. A token over a boundary goes to one section by `rule` (see
    attribute), so the counts of sections that cover the text add up to its tokens.

    Returns key, section, first_byte, end_byte, n_tokens, n_crossing, doc_tokens.
    A text without a section (null, empty) gives one row: section null, zeros.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        bpe = ByteBpe(path, special)
        for k, t in rows:
            spans = sections(t or "")
            ids = np.frombuffer(bpe.encode(t), "<u4")
            if not spans:
                yield k, None, 0, 0, 0, 0, len(ids)
                continue
            starts, ends = np.array([s[1] for s in spans]), np.array([s[2] for s in spans])
            counts, crossing = attribute(bpe.sizes[ids], starts, ends, rule)
            for (name, a, b), n, c in zip(spans, counts.tolist(), crossing.tolist(), strict=True):
                yield k, name, a, b, n, c, len(ids)

    return map_rows(docs.select(key, text), run, f"{key} {docs.schema[key].dataType.simpleString()}, section string, first_byte long, end_byte long, n_tokens long, n_crossing long, doc_tokens long")
