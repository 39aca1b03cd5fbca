"""Packing into few sequences: patterns of a few lengths, fitted to the histogram of lengths.

1. One pass over the texts gives each document's pieces. Their lengths make a histogram of at most
   `longest` rows, which is all that the driver sees of the corpus, whatever its size.
2. plan(): every set of up to three lengths that fill a sequence exactly is a pattern. Non-negative
   least squares fit how often each is used to the histogram; rounded counts, as far as there are pieces, are taken.
   What is left of the histogram goes through best-fit decreasing, many equal sequences at a time.
3. The plan says, for each length, which stretch of its pieces belongs to which sequences. Pieces are
   numbered within their length (two-level, no sort of a whole length) and look their place up.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.arrow import map_rows, schema_of
from corpusloom.llm.bpe import ByteBpe
from corpusloom.runtime import materialise

#: Classes of equal width into which lengths are put for the fit.
CLASSES = 256
#: Pieces that are numbered in one group, about.
GROUP = 1 << 18


def whole_pieces(n: int, longest: int) -> Iterator[tuple[int, int, int]]:
    """(piece, start, length) of n tokens: the first piece takes what isn't a multiple of `longest`."""
    start = 0
    size = n % longest or min(n, longest)
    piece = 0
    while start < n:
        yield piece, start, size
        start, piece, size = start + size, piece + 1, longest


def patterns(classes: np.ndarray) -> np.ndarray:
    """Rows of three falling classes of length out of 1 to CLASSES that add up to CLASSES; 0 stands for none.

    classes: those that have pieces. A class's pieces are no longer than its number times the width of a class,
    so the pieces of a pattern always fit a sequence.
    """
    there = np.zeros(CLASSES + 1, bool)
    there[classes] = there[0] = True
    a, b = (x.ravel() for x in np.meshgrid(classes, np.arange(CLASSES + 1), indexing="ij"))
    c = CLASSES - a - b
    ok = (b <= a) & (c <= b) & (c >= 0)
    a, b, c = a[ok], b[ok], c[ok]
    ok = there[b] & there[c]
    return np.stack([a[ok], b[ok], c[ok]], 1)


def fit(rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How often to use each pattern: x >= 0 with the least sum of squares of (counts - pieces used) x class.

    The active-set method of Lawson and Hanson: admit the pattern of steepest descent, solve the least squares over
    the admitted ones, and step back to where the first would turn negative, which then leaves. No more
    patterns than classes stay in use, so the repeats are large enough to round.
    """
    weight = np.arange(len(counts)) / len(counts)
    matrix = np.zeros((len(counts), len(rows)))
    for k in range(3):
        np.add.at(matrix, (rows[:, k], np.arange(len(rows))), 1.0)
    matrix *= weight[:, None]
    goal = counts * weight
    x, used = np.zeros(len(rows)), np.zeros(0, np.int64)
    for _ in range(3 * len(counts) if len(rows) else 0):
        slope = matrix.T @ (goal - matrix[:, used] @ x[used])
        slope[used] = 0
        best = int(slope.argmax())
        if slope[best] <= 1e-9 * max(1.0, float(goal.max())):
            break
        used = np.append(used, best)
        while True:
            own = matrix[:, used]
            square = own.T @ own
            square[np.diag_indices(len(used))] += 1e-10  # patterns that depend on each other stay solvable
            v = np.linalg.solve(square, own.T @ goal)
            if (v > 0).all():
                x[used] = v
                break
            now, low = x[used], v <= 0
            step = float((now[low] / np.maximum(now[low] - v[low], 1e-300)).min())
            x[used] = np.where(low & (now <= step * (now - v) * (1 + 1e-9)), 0, now + step * (v - now))
            used = used[x[used] > 0]
            if not len(used):
                break
    return x


def best_fit(left: np.ndarray, longest: int) -> list[tuple[int, dict[int, int]]]:
    """(repeats, {length: times}) of sequences for a histogram, by best-fit decreasing on groups of equal sequences."""
    spaces: dict[int, list[list]] = {}  # space left -> [repeats, contents]
    open_spaces = np.zeros(longest + 1, bool)

    def put(space: int, repeats: int, held: dict[int, int]) -> None:
        spaces.setdefault(space, []).append([repeats, held])
        open_spaces[space] = True

    for size in np.flatnonzero(left)[::-1].tolist():
        n = int(left[size])
        while n:
            fitting = np.flatnonzero(open_spaces[size:])
            if not len(fitting):
                times = min(n, longest // size)
                put(longest - times * size, n // times, {size: times})
                n -= n // times * times
                continue
            space = size + int(fitting[0])
            group = spaces[space][-1]
            taken = min(n, group[0])
            group[0] -= taken
            put(space - size, taken, group[1] | {size: group[1].get(size, 0) + 1})
            n -= taken
            if not group[0]:
                # the emptied group may not be the last any more when space - size is space's own list
                spaces[space].remove(group)
                open_spaces[space] = bool(spaces[space])
    return [(repeats, held) for groups in spaces.values() for repeats, held in groups if repeats]


@dataclass
class Plan:
    """For each length, stretches of its pieces by number: the first number, and where they go.

    Piece number k of a stretch that begins at `first` goes to sequence `sequence` + (k - first) // `times`, at
    `offset` + length * ((k - first) % `times`). key is length * 2^40 + first, sorted.
    """

    key: np.ndarray
    sequence: np.ndarray
    times: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (length.astype(np.int64) << 40) + number
        at = np.searchsorted(self.key, key, "right") - 1
        k = key - self.key[at]
        return self.sequence[at] + k // self.times[at], self.offset[at] + length * (k % self.times[at])


def plan(histogram: np.ndarray, longest: int) -> Plan:
    """Sequences for histogram[length] pieces of each length up to `longest`. Time and size depend on `longest`, not on the counts."""
    left = histogram.astype(np.int64).copy()
    groups: list[tuple[int, dict[int, int]]] = []
    if left[longest]:
        groups.append((int(left[longest]), {longest: 1}))
        left[longest] = 0
    width = -(-longest // CLASSES)
    of = -(-np.arange(longest + 1) // width)
    counts = np.bincount(of, left, CLASSES + 1)
    rows = patterns(np.flatnonzero(counts))
    times = fit(rows, counts)

    def largest(low: int, high: int) -> int:
        """The largest length in (low, high] that has pieces, or 0."""
        there = np.flatnonzero(left[low + 1 : high + 1])
        return low + 1 + int(there[-1]) if len(there) else 0

    for j in np.lexsort((-times, *-rows.T[::-1])).tolist():
        want = int(times[j] + 0.5)
        classes = [c for c in rows[j].tolist() if c]
        while want:
            # the largest pieces of each class, but the last as large as still fits
            held: dict[int, int] = {}
            room = longest
            for c in classes:
                size = largest((c - 1) * width, room if c is classes[-1] else min(room, c * width))
                if not size or left[size] <= held.get(size, 0):
                    break
                held[size] = held.get(size, 0) + 1
                room -= size
            else:
                repeats = min([want, *(int(left[size]) // n for size, n in held.items())])
                want -= repeats
                groups.append((repeats, held))
                for size, n in held.items():
                    left[size] -= repeats * n
                continue
            break
    groups += best_fit(left, longest)
    used: dict[int, int] = {}
    out, sequence = [], 0
    for repeats, held in groups:
        offset = 0
        for size, n in sorted(held.items(), reverse=True):
            first = used.get(size, 0)
            used[size] = first + repeats * n
            out.append(((size << 40) + first, sequence, n, offset))
            offset += size * n
        sequence += repeats
    out.sort()
    columns = np.array(out, np.int64).reshape(-1, 4).T
    return Plan(*columns, sequence)


def pieces(docs: DataFrame, path: str, special: dict[str, int] | None, end: int, longest: int, key: str, text: str, digest: bool) -> DataFrame:
    """key, piece, start, length and ids (or ids_crc32) of every piece of every text."""
    last = int(end).to_bytes(4, "little")

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        bpe = ByteBpe(path, special)
        for k, t in rows:
            ids = bpe.encode(t) + last
            for piece, start, size in whole_pieces(len(ids) // 4, longest):
                own = ids[4 * start : 4 * (start + size)]
                yield k, piece, start, size, zlib.crc32(own) if digest else own

    return map_rows(docs.select(key, text), run, f"{key} {docs.schema[key].dataType.simpleString()}, piece int, start long, length long, {'ids_crc32 long' if digest else 'ids binary'}")


def pack_few(docs: DataFrame, path: str, special: dict[str, int] | None = None, end: int = 0, longest: int = 2048, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """Pieces of all documents in few sequences of at most `longest` tokens.

    A document is its ids under the byte tokenizer at `path`, then the id `end`; a null or empty text is that
    id alone. Only a document of over `longest` ids is cut, into pieces of `longest`, the first of which may be shorter.

    Returns key, piece, start, length, ids (binary, little-endian unsigned 32-bit; with `digest` ids_crc32 in
    their place), sequence_id (from 0, gapless), offset. Repeated rows and null keys are documents like others; other
    columns are ignored. An empty table gives no row.

    The pieces are written once; the histogram, the numbering and the plan read only their lengths. Numbers
    within a length come from counts of (length, group), groups being dealt by the row's hash so that each has about
    GROUP pieces; so a length that holds most pieces isn't sorted in one task. Equal rows may change places: nothing shows.
    """
    value = "ids_crc32" if digest else "ids"
    made = materialise(pieces(docs, path, special, end, longest, key, text, digest), "pieces")
    counts = made.groupBy("length").agg(F.count("*").alias("n")).toArrow()  # at most `longest` rows
    histogram = np.zeros(longest + 1, np.int64)
    histogram[counts.column("length").to_numpy()] = counts.column("n").to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(plan(histogram, longest))
    groups = int(histogram.sum()) // GROUP + 1
    dealt = made.withColumn("_group", F.pmod(F.xxhash64(key, "piece", value), F.lit(groups)))
    by = Window.partitionBy("length", "_group")
    before = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("length", "_group").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    numbered = dealt.withColumn("_at", F.row_number().over(by.orderBy(F.col(key), "piece", value)) - 1).join(offsets.drop("_n"), ["length", "_group"])
    numbered = numbered.select(key, "piece", "start", "length", value, (F.col("_at") + F.col("_before")).alias("_at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = sent.value.place(batch.column("length").to_numpy(), batch.column("_at").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:-1], "sequence_id", "offset"])

    return numbered.mapInArrow(run, schema_of(f"{key} {docs.schema[key].dataType.simpleString()}, piece int, start long, length long, {value} {'long' if digest else 'binary'}, sequence_id long, offset long"))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, ids (binary) and bounds (the first token of each piece) of pack_few() rows: what a trainer reads."""
    held = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return held.select("sequence_id", "n_tokens", F.expr("aggregate(p, cast('' as binary), (a, x) -> a || x.ids)").alias("ids"), F.transform("p", lambda x: x["offset"]).alias("bounds"))
