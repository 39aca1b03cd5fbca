"""Near-duplicates: MinHash signatures in an LSH forest, links confirmed on full shingle sets.

1. One pass over the texts: distinct shingles, a digest of the set, a signature
   of TREES x DEPTH minima. Equal sets form a class, represented by the smallest id.
2. Each tree orders the classes by its own DEPTH minima. A region is a stretch
   of that order with a common prefix of `depth` minima; a class's neighbours by longest common
   prefix are in its region. Where a region holds over CROWD classes, they go to a
   deeper forest: regions of DEPTH common minima, in sixteen times as many orders.
3. In a region, pairs whose signatures agree well enough (4.5 standard errors
   below the limit) are joined into a spanning forest: no pairs are written.
4. The components of the forest are candidate groups. Their texts are read again
   and all pairs in a group are compared on full sets, in blocks of BLOCK
   classes against each other; each block again gives a spanning forest.
5. The components of those confirmed links are the answer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrow import map_rows, schema_of
from corpusloom.llm.components import connected_components
from corpusloom.llm.prefilter import only_possible
from corpusloom.llm.words import hash_words, shingles, text_chunks
from corpusloom.runtime import Scratch, materialise

TREES, DEPTH = 16, 8
#: Classes in one task, classes above which a region goes to the deep forest, texts of a group in one task.
REGION, CROWD, BLOCK = 1024, 16384, 256
_FACTORS = np.random.default_rng(7).integers(1, 2**63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = np.random.default_rng(8).integers(0, 2**63, TREES * DEPTH, dtype=np.uint64)
#: Orders of the signature, each by DEPTH of its minima: those of the first forest, then the minima dealt anew 15 times.
ORDERS = [
    order
    for dealt in [np.arange(TREES * DEPTH), *(np.random.default_rng(9 + k).permutation(TREES * DEPTH) for k in range(15))]
    for order in dealt.reshape(TREES, DEPTH).tolist()
]


def missed(similarity: float, depth: int, orders: int) -> float:
    """The chance that a pair agrees in the first `depth` minima of none of some orders; orders may share minima."""
    pairs = TREES * DEPTH
    return sum(comb(pairs, a) * similarity**a * (1 - similarity) ** (pairs - a) * (1 - comb(a, depth) / comb(pairs, depth)) ** orders for a in range(pairs + 1))


def signature(sets: np.ndarray) -> np.ndarray:
    """The minima of a set of 64-bit hashes under TREES x DEPTH hash functions, 32 bits each."""
    out = np.full(TREES * DEPTH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(sets), 4096):
        np.minimum(out, (_FACTORS[:, None] * sets[None, at : at + 4096] + _TERMS[:, None]).min(1), out=out)
    return (out >> np.uint64(32)).astype(">u4")


def shingle_sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """(batch, row, distinct shingle hashes) for the texts in the column `text` of each batch."""
    for batch in batches:
        for at, data, bounds in text_chunks(batch.column("text")):
            hashes, _, _, words = hash_words(data, bounds, lower=True)
            for k in range(len(bounds) - 1):
                yield batch, at + k, shingles(hashes[words[k] : words[k + 1]], size)


def sketch(docs: DataFrame, size: int = 5) -> DataFrame:
    """doc_id, t (a hash of the text), n_shingles, digest of the shingle set, signature (both binary; null where the set is empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, bytes] = {}  # signatures of recent sets, for copies
        held: list[tuple] = []
        for batch, row, found in shingle_sets(batches, size):
            digest = made = None
            if len(found):
                digest = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                if (made := seen.get(digest)) is None:
                    made = signature(found).tobytes()
                    if len(seen) >= 4096:
                        seen.clear()
                    seen[digest] = made
            held.append((batch.column("doc_id")[row].as_py(), batch.column("t")[row].as_py(), len(found), digest, made))
            if len(held) >= 4096:
                yield rows(held)
                held = []
        if held:
            yield rows(held)

    def rows(held: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*held, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.binary()), pa.array(columns[4], pa.binary())], ["doc_id", "t", "n_shingles", "digest", "sig"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("t")).mapInArrow(run, schema_of("doc_id long, t long, n_shingles long, digest binary, sig binary"))


def regions(classes: DataFrame, depth: int, similarity: float) -> DataFrame:
    """(region, cls) for all regions of two classes or more; classes: cls (a long of the class's own), sig.

    A region that two orders share comes once: its key is a digest of the classes in it. One of over REGION
    classes is dealt to blocks of REGION / 2, and each pair of blocks is a region, so all its pairs meet and no task
    holds more than about REGION classes. That is quadratic in the region but spread over tasks; each class goes to as
    many of them as there are other blocks. Classes of a region of over CROWD go to the deep forest instead, whose
    ORDERS orders of DEPTH minima miss no more pairs of that similarity than the first; where they would (low
    similarities), and in the deep forest itself, blocks are used at every size. So the size of a region never lowers the chance of a pair.
    """
    forests = [(depth, ORDERS[:TREES])]
    if missed(similarity, DEPTH, len(ORDERS)) <= (1 - similarity**depth) ** TREES:
        forests.append((DEPTH, ORDERS))
    found, left = None, classes
    for d, orders in forests:
        last = d == forests[-1][0]
        each = F.explode(F.array(*[F.array(*[F.lit(at) for at in order[:d]]) for order in orders]))
        prefix = F.transform("order", lambda at: F.substring(F.col("sig"), 4 * at + 1, F.lit(4)))
        keyed = left.select("cls", "sig", each.alias("order")).select("cls", F.xxhash64("order", prefix).alias("h"))
        groups = materialise(keyed.groupBy("h").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("cls")).alias("x")).filter("n > 1"), "regions")
        dealt = keyed.join(groups if last else groups.filter(F.col("n") <= CROWD), "h")
        dealt = dealt.withColumn("k", F.when(F.col("n") > REGION, F.ceil(2 * F.col("n") / REGION)).otherwise(1).cast("int"))
        dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("k")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).filter("k = 1 or other != mine")
        part = dealt.select(F.xxhash64("x", "n", F.least("mine", "other"), F.greatest("mine", "other")).alias("region"), "cls")
        found = part if found is None else found.unionAll(part)
        crowded = groups.filter(F.col("n") > CROWD).select("h")
        if last or crowded.isEmpty():
            break
        left = materialise(classes.join(keyed.join(crowded, "h").select("cls").distinct(), "cls"), "crowded")
    return found.distinct()


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that are equal in the first `keys` columns, from sorted batches; only one run is held."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        new = np.ones(batch.num_rows, bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        cuts = [*np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a] for c in columns)
            if key != held_key and held:
                yield pa.Table.from_batches(held)
                held = []
            held_key = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def spanning(near: np.ndarray) -> list[tuple[int, int]]:
    """Links (member, first member) of each component of a symmetric matrix of truth values."""
    out, left = [], np.ones(len(near), bool)
    for k in range(len(near)):
        if not left[k]:
            continue
        left[k] = False
        front = [k]
        while front:
            reached = near[front].any(0) & left
            left &= ~reached
            front = np.flatnonzero(reached).tolist()
            out += [(x, k) for x in front]
    return out


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def candidate_edges(members: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """A spanning forest (a, b) of the pairs in each region whose signatures and sizes allow the similarity.

    members: region, cls, read twice; classes: cls, rep, n_shingles, sig.
    """
    least = similarity - 4.5 * (similarity * (1 - similarity) / (TREES * DEPTH)) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int]] = []
        for table in _runs(batches, 1):
            reps = table.column("rep").to_numpy()
            sizes = table.column("n_shingles").to_numpy()
            sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(len(reps), -1)
            if len(reps) == 2:
                if sizes.min() >= similarity * sizes.max() and (sigs[0] == sigs[1]).mean() >= least:
                    held.append((int(reps[1]), int(reps[0])))
            else:
                near = np.zeros((len(reps), len(reps)), bool)
                for k in range(len(reps)):
                    near[k] = ((sigs == sigs[k]).mean(1) >= least) & (np.minimum(sizes, sizes[k]) >= similarity * np.maximum(sizes, sizes[k]))
                held += [(int(reps[x]), int(reps[y])) for x, y in spanning(near)]
            if len(held) >= 4096:
                yield _edges(held)
                held = []
        if held:
            yield _edges(held)

    rows = members.join(only_possible(classes, "cls", members, "cls"), "cls").select("region", "rep", "n_shingles", "sig")
    return rows.repartition("region").sortWithinPartitions("region", "rep").mapInArrow(run, schema_of("a long, b long"))


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections of some sets."""
    n = len(sets)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    first = np.ones(len(values), bool)
    first[1:] = values[1:] != values[:-1]
    number = np.cumsum(first) - 1
    shared = np.bincount(number)[number] > 1  # a shingle of one set is in no intersection
    number, owner = number[shared], owner[shared]
    out = np.zeros((n, n), np.int64)
    if not len(number):
        return out
    number = np.cumsum(np.concatenate([[0], number[1:] != number[:-1]]))
    for low in range(0, int(number[-1]) + 1, 4096):
        a, b = np.searchsorted(number, [low, low + 4096])
        there = np.zeros((n, 4096), np.float32)
        there[owner[a:b], number[a:b] - low] = 1
        out += (there @ there.T).astype(np.int64)
    return out


def confirmed_edges(docs: DataFrame, groups: DataFrame, percent: int, size: int) -> DataFrame:
    """A spanning forest (a, b) of the confirmed links inside each group; groups: node, component.

    A group of over BLOCK classes is dealt to pairs of blocks: its work is
    quadratic in the group but spread over tasks, and each class goes to as many tasks as there are blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, 3):
            reps = table.column("doc_id").to_numpy()
            mine = table.column("mine").to_numpy()
            i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
            held = [found for _, _, found in shingle_sets(table.to_batches(), size)]
            lengths = np.array([len(s) for s in held])
            both = overlaps(held)
            near = 100 * both >= percent * (lengths[:, None] + lengths[None, :] - both)
            if i != j:
                near &= mine[:, None] != mine[None, :]
            if pairs := spanning(near):
                yield _edges([(int(reps[x]), int(reps[y])) for x, y in pairs])

    counts = groups.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k"))
    placed = groups.join(counts, "component").select("node", F.col("component").alias("g"), "k", F.pmod(F.xxhash64("node"), F.col("k")).cast("int").alias("mine"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.select("node", "g", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    texts = only_possible(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id", groups, "node")
    rows = texts.join(dealt, F.col("doc_id") == F.col("node")).select("g", "i", "j", "mine", "doc_id", "text")
    return rows.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "doc_id").mapInArrow(run, schema_of("a long, b long"))


def near_duplicates(docs: DataFrame, percent: int = 80, size: int = 5, depth: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text).

    Texts are linked when 100 * |A and B| >= percent * |A or B| over their
    distinct shingles of `size` lower-cased words; a text with fewer words is one
    shingle, one without words (null, empty) has none and is linked with
    nothing. component_id is the smallest doc_id reachable over links, kept says
    whether that is the row's own. Rows with the same doc_id share a component.
    A null doc_id can't stand for a group: such a row is kept only
    if no row with an id has the same shingles.

    Every step's work follows the rows and the sizes of candidate groups. A pair
    with the least similarity s meets in no tree with probability (1 - s^3)^16:
    2.4e-7 at 85 % and 1.0e-5 at 80 %, and in no order of the deep forest, where both texts'
    regions are crowded, with 1.1e-10 and 1.6e-7 (missed()). The
    signature test drops 1.8e-5 and 2.0e-5 of such pairs. A missed pair still
    shares a component when other links join it.
    """
    return verdicts(docs, percent, size, depth).select("doc_id", "n_shingles", "component_id", "kept")


def verdicts(docs: DataFrame, percent: int, size: int = 5, depth: int = 3) -> DataFrame:
    """near_duplicates() with t, xxhash64 of the row's text, and digest, that of its shingle set."""
    sketches = materialise(sketch(docs, size), "sketches")
    some = sketches.filter("n_shingles > 0 and doc_id is not null")
    least = some.groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "sig")).alias("x"))
    classes = materialise(least.select("digest", F.xxhash64("digest").alias("cls"), F.col("x.doc_id").alias("rep"), F.col("x.n_shingles").alias("n_shingles"), F.col("x.sig").alias("sig")), "classes")
    # one id may have several sets: their classes share the representative, so they are one node of the links
    with Scratch(docs.sparkSession) as scratch:
        members = scratch.keep(regions(classes.select("cls", "sig"), depth, percent / 100), "members")
        groups = connected_components(candidate_edges(members, classes, percent / 100))
    links = connected_components(confirmed_edges(docs, groups, percent, size))
    heads = classes.join(links, classes.rep == links.node, "left").select("digest", F.coalesce("component", "rep").alias("head"))
    out = sketches.select("doc_id", "t", "n_shingles", "digest").join(heads, "digest", "left")
    out = out.withColumn("component_id", F.coalesce("head", "doc_id"))
    return out.select("doc_id", "t", "digest", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))
