"""Substring deduplication with a log-structured index of window fingerprints.

A window is `size` consecutive words of one document. Each window names one
anchor, the least hash among its runs of GRAM words; equal windows name equal
anchors, and a text of n words has about 2n / (size - GRAM + 2) of them. So
anchors find where windows can be equal at all, and only there the windows'
own hashes are made and compared.

The index holds immutable runs in the shared folder, each dealt to a fixed number of
buckets by its key and sorted in each bucket:
  anchors    each anchor, the one text that has it or that several have it
  stretches  for anchors of several texts, the hashes of consecutive windows
  texts      the digest of each whole text, with its least document
A new batch is merge-joined with the runs, bucket by bucket, without shuffling or sorting
them again. An anchor that one earlier text had alone makes that text's windows
due, which are then made from the text. What a batch adds becomes a run of level 0;
`fan` runs of a level are merged into one of the next. A manifest names the runs, so that an index can be
opened again by a later job.

Verification: a stretch of windows that is found again is removed only after
the words themselves (their SHA-256) are equal to those of the place that it was found at.

A doc_id may repeat, also with other texts. So what is found in a text is kept by
(doc_id, t), t being a 64-bit hash of the whole text, and goes to that text's rows only.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.arrow import map_rows, schema_of
from corpusloom.llm.prefilter import apart, only_possible
from corpusloom.llm.words import grams, hash_words, text_chunks
from corpusloom.runtime import Scratch, configured, delete, materialise, table_path

GRAM = 10
#: Runs of a level that are merged into one of the next.
FAN = 4
#: Stretches that one anchor may have for its windows to be compared in one task; beyond, they are compared row by row.
CROWD = 512
#: Windows of a stretch at most, and windows that are compared at once.
STRETCH, AT_ONCE = 64, 1 << 17
KEYS = {"anchors": "a", "stretches": "a", "texts": "digest"}
STRETCHES = "a long, doc_id long, t long, start int, hs array<long>"
RUNS = {"anchors": "a long, doc_id long, t long, shared boolean", "stretches": STRETCHES, "texts": "digest binary, doc_id long"}
#: Windows start .. start + n - 1 of the text (doc_id, t) begin at places place .. of the text (of, of_t).
FOUND = "doc_id long, t long, start int, n int, of long, of_t long, place int"
SPAN = "struct<start:int,n:int,of:bigint,of_t:bigint,place:int>"


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` consecutive values, in linear time by blocks."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    shaped = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(shaped, 1).ravel()
    back = np.minimum.accumulate(shaped[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(hashes: np.ndarray, size: int) -> np.ndarray:
    """The anchor of each window of `size` words."""
    gram = min(GRAM, size)
    return sliding_min(grams(hashes, gram), size - gram + 1)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, bytes, np.ndarray]]:
    """(batch, row, text's bytes, word hashes) for every row with a column `text`."""
    for batch in batches:
        for at, data, bounds in text_chunks(batch.column("text")):
            hashes, _, _, words = hash_words(data, bounds, lower=False)
            for k in range(len(bounds) - 1):
                yield batch, at + k, data[bounds[k] : bounds[k + 1]].tobytes(), hashes[words[k] : words[k + 1]]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, t."""
    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("t"))


def sketch(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, t, n_words, digest (SHA-256 of the words joined by spaces), anchors (distinct)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch, row, data, hashes in _texts(batches):
            found = np.unique(anchors(hashes, size)).view(np.int64)
            held.append((batch.column("doc_id")[row].as_py(), batch.column("t")[row].as_py(), len(hashes), hashlib.sha256(b" ".join(data.split())).digest(), found))
            if len(held) >= 2000:
                yield rows(held)
                held = []
        if held:
            yield rows(held)

    def rows(held: list[tuple]) -> pa.RecordBatch:
        ids, t, n, digests, found = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(t, pa.int64()), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), _lists([len(x) for x in found], np.concatenate(found))], ["doc_id", "t", "n_words", "digest", "anchors"])

    return keyed(docs).mapInArrow(run, schema_of("doc_id long, t long, n_words long, digest binary, anchors array<long>"))


def _names(columns: str) -> list[str]:
    return [c.split()[0] for c in columns.split(", ")]


def _lists(lengths, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(values))


def cut_stretches(texts: DataFrame, size: int) -> DataFrame:
    """The stretches (STRETCHES and fresh) of windows whose anchor is in the row's `hits`; texts: doc_id, text, t, fresh, hits.

    A stretch is of consecutive windows with one anchor, STRETCH at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch, row, _, hashes in _texts(batches):
            hits = np.sort(np.array(batch.column("hits")[row].as_py(), np.int64))
            found = anchors(hashes, size).view(np.int64)
            due = np.flatnonzero(hits[np.minimum(np.searchsorted(hits, found), len(hits) - 1)] == found)
            if not len(due):
                continue
            first = np.ones(len(due), bool)
            first[1:] = (np.diff(due) != 1) | (found[due[1:]] != found[due[:-1]])
            begun = np.maximum.accumulate(np.where(first, np.arange(len(due)), 0))
            first |= (np.arange(len(due)) - begun) % STRETCH == 0
            at = np.flatnonzero(first)
            same = [np.full(len(at), batch.column(c)[row].as_py()) for c in ("doc_id", "t", "fresh")]
            held.append((found[due[at]], *same, due[at].astype(np.int32), np.diff(np.append(at, len(due))), grams(hashes, size)[due].view(np.int64)))
            count += len(due)
            if count >= AT_ONCE:
                yield rows(held)
                held, count = [], 0
        if held:
            yield rows(held)

    def rows(held: list[tuple]) -> pa.RecordBatch:
        a, ids, t, fresh, start, lengths, hs = (np.concatenate(c) for c in zip(*held, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(ids, pa.int64()), pa.array(t, pa.int64()), pa.array(start), _lists(lengths, hs), pa.array(fresh, pa.bool_())], ["a", "doc_id", "t", "start", "hs", "fresh"])

    return texts.select("doc_id", "text", "t", "fresh", "hits").mapInArrow(run, schema_of(f"{STRETCHES}, fresh boolean"))


def compare(stretches: DataFrame) -> DataFrame:
    """What the stretches of each anchor find in each other; stretches: STRETCHES, fresh (null: of an earlier batch's run).

    Two kinds of rows. FOUND: fresh windows that a smaller document has, with
    the place of the first one. STRETCHES (a not null): stretches of this
    batch that hold the first occurrence of some window.
    A task holds AT_ONCE windows and what one anchor has beyond; that is CROWD stretches at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            a = batch.column("a").to_numpy()
            if held and count >= AT_ONCE and (a != last).any():
                # what comes before the next anchor is complete
                cut = int(np.argmax(a != last))
                yield judge([*held, batch.slice(0, cut)])
                held, count, batch = [], 0, batch.slice(cut)
            held.append(batch)
            count += len(batch.column("hs").flatten())
            last = a[-1]
        if held:
            yield judge(held)

    def judge(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        doc, t, start = (rows.column(c).to_numpy() for c in ("doc_id", "t", "start"))
        past = rows.column("fresh").is_null().to_numpy(zero_copy_only=False)
        fresh = rows.column("fresh").fill_null(False).to_numpy(zero_copy_only=False)
        lists = rows.column("hs")
        lengths, hs = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
        row = np.repeat(np.arange(len(doc)), lengths)
        place = start[row] + np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        # rows are in order of anchor, document, text and place, so the first of equal hashes is the least
        order = np.argsort(hs, kind="stable")
        first = np.ones(len(order), bool)
        first[1:] = hs[order[1:]] != hs[order[:-1]]
        least = np.empty(len(order), np.int64)
        least[order] = order[first][np.cumsum(first) - 1]
        hit = np.flatnonzero(fresh[row] & (doc[row[least]] < doc[row]))
        begins = np.ones(len(hit), bool)
        source, shift = row[least[hit]], place[least[hit]] - place[hit]
        begins[1:] = (np.diff(hit) != 1) | (np.diff(row[hit]) != 0) | (np.diff(source) != 0) | (np.diff(shift) != 0)
        at = np.flatnonzero(begins)
        who, of = row[hit[at]], source[at]
        kept = np.unique(row[order[first]])
        kept = kept[~past[kept]]
        n, m = len(at), len(kept)

        def column(values, kind, before: bool) -> pa.Array:
            none = pa.nulls(m if before else n, kind)
            return pa.concat_arrays([pa.array(values, kind), none] if before else [none, values])

        index = rows.take(pa.array(kept))
        return pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([pa.array(doc[who]), index.column("doc_id")]),
                pa.concat_arrays([pa.array(t[who]), index.column("t")]),
                pa.concat_arrays([pa.array(place[hit[at]].astype(np.int32)), index.column("start")]),
                column(np.diff(np.append(at, len(hit))).astype(np.int32), pa.int32(), True),
                column(doc[of], pa.int64(), True),
                column(t[of], pa.int64(), True),
                column(place[least[hit[at]]].astype(np.int32), pa.int32(), True),
                column(index.column("a"), pa.int64(), False),
                column(index.column("hs"), lists.type, False),
            ],
            ["doc_id", "t", "start", "n", "of", "of_t", "place", "a", "hs"],
        )

    dealt = stretches.select("a", "doc_id", "t", "start", "hs", "fresh").repartition("a").sortWithinPartitions("a", "doc_id", "t", "start")
    return dealt.mapInArrow(run, schema_of(f"{FOUND}, a long, hs array<long>"))


def compare_rows(stretches: DataFrame, scratch: Scratch) -> DataFrame:
    """compare() for anchors of any number of stretches; no group is gathered.

    Equal stretches are one class, made by partial aggregates, and stand behind its first one; only classes
    are taken apart into windows. Where each window begins first is found by partial aggregates too. What a class
    finds is put together into spans (a stretch has STRETCH windows at most), which then join the class's stretches,
    one row a span. Classes and spans are written first, so the joins against them are split where a class is frequent.
    """
    key = ["doc_id", "t", "start"]
    classes = stretches.groupBy("a", "hs").agg(F.min(F.struct(*key, F.col("fresh").isNull().alias("past"))).alias("x"), F.max("doc_id").alias("high"))
    classes = scratch.keep(classes.select("a", "hs", "x.*", "high"), "classes")
    windows = classes.select("a", *key, "past", "high", F.posexplode("hs").alias("k", "h"))
    first = windows.groupBy("h").agg(F.min(F.struct("doc_id", "t", (F.col("start") + F.col("k")).alias("at"), "start", "a", "past")).alias("x"), F.max("high").alias("high"))
    first = scratch.keep(first.select("h", "x.*", "high"), "first")
    several = first.filter("doc_id < high").select("h", F.col("doc_id").alias("of"), F.col("t").alias("of_t"), F.col("at").alias("place"))
    # runs of windows with one source and shift; a partition is one class's at most
    alike = Window.partitionBy(*key, "of", "of_t", F.col("place") - F.col("k")).orderBy("k")
    places = windows.join(several, "h").withColumn("run", F.col("k") - F.row_number().over(alike))
    spans = places.groupBy(*key, "of", "of_t", F.col("place") - F.col("k"), "run").agg(F.min("k").alias("k"), F.count("*").cast("int").alias("n"), F.min("place").alias("place"))
    spans = classes.select("a", "hs", *key).join(spans.select(*key, "of", "of_t", "k", "n", "place"), key)
    spans = scratch.keep(spans.select("a", "hs", "of", "of_t", "k", "n", "place"), "class-spans")
    found = stretches.filter("fresh").join(spans, ["a", "hs"]).filter("of < doc_id")
    found = found.select("doc_id", "t", (F.col("start") + F.col("k")).alias("start"), "n", "of", "of_t", "place", F.lit(None).cast("long").alias("a"), F.lit(None).cast("array<long>").alias("hs"))
    holds = first.filter("not past").select(*key).distinct()
    none = [F.lit(None).cast(k).alias(c) for c, k in (("n", "int"), ("of", "long"), ("of_t", "long"), ("place", "int"))]
    index = classes.filter("not past").join(holds, key, "left_semi")
    return found.unionByName(index.select("doc_id", "t", "start", *none, "a", "hs"))


def join_spans(found: DataFrame) -> DataFrame:
    """doc_id, t, spans (array of SPAN): rows of FOUND by text, touching ones with one source and shift joined."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc, t, spans in rows:
            out: list[list] = []
            for x in sorted((s["start"], s["n"], s["of"], s["of_t"], s["place"]) for s in spans):
                last = out[-1] if out else None
                if last and last[2:4] == list(x[2:4]) and last[0] + last[1] >= x[0] and last[4] - last[0] == x[4] - x[0]:
                    last[1] = max(last[1], x[0] + x[1] - last[0])
                else:
                    out.append(list(x))
            yield doc, t, [dict(zip(("start", "n", "of", "of_t", "place"), x, strict=True)) for x in out]

    grouped = found.groupBy("doc_id", "t").agg(F.collect_list(F.struct("start", "n", "of", "of_t", "place")).alias("spans"))
    return map_rows(grouped, run, f"doc_id long, t long, spans array<{SPAN}>")


def proof(words: list[bytes], place: int, n: int, size: int) -> bytes:
    """SHA-256 of the words of n windows."""
    return hashlib.sha256(b" ".join(words[place : place + n + size - 1])).digest()


def prove(texts: DataFrame, spans: DataFrame, size: int, scratch: Scratch) -> DataFrame:
    """doc_id, t, proved (array of start, n, proof): each span with the SHA-256 of the words at its source."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc, t, text, places in rows:
            words = text.encode().split()
            for x in places:
                yield doc, t, x["place"], x["n"], proof(words, x["place"], x["n"], size)

    each = spans.select("doc_id", "t", F.explode("spans").alias("s")).select("doc_id", "t", "s.*")
    asked = each.select("of", "of_t", "place", "n").distinct().groupBy("of", "of_t").agg(F.collect_list(F.struct("place", "n")).alias("places"))
    asked = scratch.keep(asked, "asked")
    sources = only_possible(texts, "t", asked, "of_t").join(asked, (F.col("doc_id") == F.col("of")) & (F.col("t") == F.col("of_t")))
    made = map_rows(sources.select("of", "of_t", "text", "places"), run, "of long, of_t long, place int, n int, proof binary")
    made = scratch.keep(made.groupBy("of", "of_t", "place", "n").agg(F.first("proof").alias("proof")), "proofs")
    return each.join(made, ["of", "of_t", "place", "n"]).groupBy("doc_id", "t").agg(F.collect_list(F.struct("start", "n", "proof")).alias("proved"))


def cover(words: list[bytes], proved: list, size: int) -> np.ndarray:
    """Which of the words lie in a span whose words are those of its source."""
    marks = np.zeros(len(words) + 1, np.int64)
    for s in proved:
        if proof(words, s["start"], s["n"], size) == bytes(s["proof"]):
            marks[s["start"]] += 1
            marks[s["start"] + s["n"] + size - 1] -= 1
    return np.cumsum(marks)[: len(words)] > 0


def cut_text(data: bytes, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> bytes:
    """The text without the words that are gone, and without the white space after each of them."""
    if not gone.any():
        return data
    following = np.append(starts[1:], len(data))
    out, at = [], 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    for a, b in edges.reshape(-1, 2):
        out.append(data[at : starts[a]])
        at = following[b - 1]
    out.append(data[at:])
    return b"".join(out)


class FingerprintIndex:
    """Runs of what earlier batches held, in one folder of a file system that all executors share.

    levels: for each kind of KEYS a list of (level, path), the newest last. Every run is written in
    `buckets` files, by the hash of its key, each sorted by it.
    """

    def __init__(self, spark: SparkSession, size: int = 50, fan: int = FAN, folder: str | None = None, buckets: int | None = None):
        self.spark, self.size, self.fan = spark, size, fan
        self.folder = folder or table_path(spark, "index")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: dict[str, list[tuple[int, str]]] = {k: [] for k in KEYS}
        self.tables: dict[str, str] = {}
        self.batches = 0

    # the manifest

    def save(self) -> None:
        """Writes a new version of the manifest; the last complete one counts."""
        kept = {"size": self.size, "fan": self.fan, "buckets": self.buckets, "batches": self.batches, "levels": self.levels}
        self.spark.createDataFrame([(self.batches, json.dumps(kept))], "version int, value string").coalesce(1).write.mode("append").json(f"{self.folder}/manifest")

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> FingerprintIndex:
        """The index that another job left in a folder."""
        kept = json.loads(spark.read.schema("version int, value string").json(f"{folder}/manifest").orderBy(F.desc("version")).first().value)
        index = cls(spark, kept["size"], kept["fan"], folder, kept["buckets"])
        index.batches = kept["batches"]
        index.levels = {k: [(level, path) for level, path in runs] for k, runs in kept["levels"].items()}
        return index

    def drop(self) -> None:
        """Deletes the index."""
        for runs in self.levels.values():
            for _, path in runs:
                self._forget(path)
        delete(self.spark, self.folder)

    # runs

    def _forget(self, path: str) -> None:
        if path in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(path)}")
        delete(self.spark, path)

    def run(self, kind: str, path: str) -> DataFrame:
        """A run, known to Spark as dealt and sorted by its key."""
        if path not in self.tables:
            name = f"run_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {name} ({RUNS[kind]}) USING parquet CLUSTERED BY ({KEYS[kind]}) SORTED BY ({KEYS[kind]}) INTO {self.buckets} BUCKETS LOCATION '{path}'")
            self.tables[path] = name
        return self.spark.table(self.tables[path]).select(*_names(RUNS[kind]))

    def runs(self, kind: str) -> list[DataFrame]:
        return [self.run(kind, path) for _, path in self.levels[kind]]

    def merging(self):
        """Inside, plans take the runs' buckets and order as they are, and deal other rows likewise."""
        return configured(self.spark, {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.unionOutputPartitioning": "false", "spark.sql.shuffle.partitions": str(self.buckets)})

    def write(self, kind: str, rows: DataFrame) -> str:
        """rows as a run: one sorted file for each bucket."""
        path, key, name = f"{self.folder}/{kind}-{uuid.uuid4().hex}", KEYS[kind], f"run_{uuid.uuid4().hex}"
        rows.write.format("parquet").bucketBy(self.buckets, key).sortBy(key).option("path", path).saveAsTable(name)
        self.tables[path] = name
        return path

    def append(self, kind: str, path: str) -> None:
        """Takes a run in at level 0; where `fan` runs of a level are, they become one of the next."""
        self.levels[kind].append((0, path))
        level = 0
        while len(same := [p for at, p in self.levels[kind] if at == level]) >= self.fan:
            with self.merging():
                merged = self.write(kind, self.merge(kind, [self.run(kind, p) for p in same]).select(*_names(RUNS[kind])))
            self.levels[kind] = [x for x in self.levels[kind] if x[0] != level] + [(level + 1, merged)]
            for p in same:
                self._forget(p)
            level += 1
        self.levels[kind].sort(key=lambda x: -x[0])

    def merge(self, kind: str, runs: list[DataFrame]) -> DataFrame:
        """Sorted runs as one, by merge joins on their key: what the older and the newer one say of a key is combined."""
        if kind == "stretches":
            return reduce(DataFrame.unionByName, runs).repartition(self.buckets, "a")

        def two(old: DataFrame, new: DataFrame) -> DataFrame:
            key = KEYS[kind]
            new = new.withColumnsRenamed({c: f"{c}2" for c in new.columns if c != key})
            both = old.join(new, key, "full_outer")
            if kind == "texts":
                return both.select(key, F.least("doc_id", "doc_id2").alias("doc_id"))
            takes = F.coalesce(F.col("doc_id2") < F.col("doc_id"), F.col("doc_id").isNull())
            return both.select(
                key,
                F.when(takes, F.col("doc_id2")).otherwise(F.col("doc_id")).alias("doc_id"),
                F.when(takes, F.col("t2")).otherwise(F.col("t")).alias("t"),
                (F.coalesce("shared", F.lit(False)) | F.coalesce("shared2", F.lit(False)) | (F.col("doc_id").isNotNull() & F.col("doc_id2").isNotNull())).alias("shared"),
            )

        return reduce(two, runs)

    # batches

    def add(self, batch: DataFrame, texts: DataFrame, scratch: Scratch, last: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Finds what the batch (doc_id, text) repeats, and takes it into the index.

        texts: the batch and all earlier batches, from where the words of earlier texts are read when
        they are needed. Returns, as tables of scratch: the batch's rows as doc_id, t, n_words, digest,
        anchors; its whole copies of earlier texts as doc_id, t; doc_id, t, proved (see prove) of the other
        texts that repeat something. With last=True the index stays as it is.
        """
        with self.merging():
            out = self._add(batch, texts, scratch, last)
        if not last:
            self.batches += 1
            self.save()
        return out

    def _add(self, batch: DataFrame, texts: DataFrame, scratch: Scratch, last: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
        size, keep = self.size, scratch.keep
        sketches = keep(sketch(batch, size), "sketch")
        ids = sketches.filter("doc_id is not null")
        # whole copies: all windows of every copy but the first begin there too
        firsts = ids.filter(F.col("n_words") >= size).groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
        for k, old in enumerate(self.runs("texts")):
            firsts = firsts.join(old.withColumnRenamed("doc_id", f"old{k}"), "digest", "left")
            firsts = firsts.select("digest", F.least("doc_id", f"old{k}").alias("doc_id"))
        if last:
            firsts = keep(firsts, "texts")
        else:
            path = self.write("texts", firsts)
            firsts, new_texts = self.run("texts", path), path
        whole = ids.select("doc_id", "t", "digest").join(firsts.withColumnRenamed("doc_id", "least"), "digest").filter("doc_id > least")
        whole = keep(whole.select("doc_id", "t").distinct(), "copies")
        maybe, never = apart(ids.select("doc_id", "t", "anchors"), "t", whole, "t")
        posts = never.unionByName(maybe.join(whole, ["doc_id", "t"], "left_anti")).select("doc_id", "t", F.explode("anchors").alias("a"))
        # anchors: who has them in the batch, who had them before
        met = posts.groupBy("a").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("high"), F.min("t").alias("t"), F.max("t").alias("high_t"))
        met = met.select("a", "doc_id", "t", ((F.col("doc_id") < F.col("high")) | (F.col("t") < F.col("high_t"))).alias("shared"), F.lit(None).cast("long").alias("old"), F.lit(None).cast("long").alias("old_t"), F.lit(False).alias("old_shared"))
        for run in self.runs("anchors"):
            met = met.join(run.withColumnsRenamed({"doc_id": "doc_id2", "t": "t2", "shared": "shared2"}), "a", "left")
            both = F.col("old").isNotNull() & F.col("doc_id2").isNotNull()
            takes = F.coalesce(F.col("doc_id2") < F.col("old"), F.col("old").isNull())
            met = met.select(
                "a", "doc_id", "t", (F.col("shared") | F.col("doc_id2").isNotNull()).alias("shared"),
                F.when(takes, F.col("doc_id2")).otherwise(F.col("old")).alias("old"), F.when(takes, F.col("t2")).otherwise(F.col("old_t")).alias("old_t"),
                # an anchor in two runs is shared by now, and so are the stretches of its earlier text
                (F.col("old_shared") | F.coalesce("shared2", F.lit(False)) | both).alias("old_shared"),
            )
        if last:
            met = keep(met.filter("shared"), "anchors")
        else:
            earlier = F.coalesce(F.col("old") < F.col("doc_id"), F.lit(False))
            now = {"doc_id": F.when(earlier, F.col("old")).otherwise(F.col("doc_id")), "t": F.when(earlier, F.col("old_t")).otherwise(F.col("t"))}
            # the run itself also tells the rest of this batch what was met
            new_anchors = self.write("anchors", met.withColumns(now))
            met = self.spark.table(self.tables[new_anchors]).filter("shared")
        # texts with such anchors, new ones and those that had one alone
        hits = only_possible(posts, "a", met, "a").join(met.select("a"), "a").groupBy("doc_id", "t").agg(F.collect_set("a").alias("hits")).withColumn("fresh", F.lit(True))
        if self.levels["anchors"]:
            alone = met.filter("old is not null and not old_shared").groupBy(F.col("old").alias("doc_id"), F.col("old_t").alias("t")).agg(F.collect_set("a").alias("hits"))
            hits = hits.unionByName(alone.withColumn("fresh", F.lit(False)))
        hits = keep(hits, "hits")
        stretches = keep(cut_stretches(only_possible(keyed(texts), "t", hits, "t").join(hits, ["doc_id", "t"]), size), "stretches")
        every = stretches
        for run in self.runs("stretches"):
            every = every.unionByName(run.join(met.filter("old_shared").select("a"), "a", "left_semi").withColumn("fresh", F.lit(None).cast("boolean")))
        crowds = every.groupBy("a").count().filter(F.col("count") > CROWD).select("a")
        if crowds.isEmpty():
            judged = keep(compare(every), "judged")
        else:
            crowds = keep(crowds, "crowds")
            crowded, others = apart(every, "a", crowds, "a")
            crowded = keep(crowded, "crowded")
            judged = keep(compare(others).unionByName(compare_rows(crowded, scratch)), "judged")
        spans = keep(join_spans(judged.filter("n is not null")), "spans")
        proved = keep(prove(keyed(texts), spans, size, scratch), "proved")
        if not last:
            new_stretches = self.write("stretches", judged.filter("n is null").select(*_names(STRETCHES)).repartition(self.buckets, "a"))
            self.append("texts", new_texts)
            self.append("anchors", new_anchors)
            self.append("stretches", new_stretches)
        return sketches, whole, proved


def in_batches(docs: DataFrame, batches: int) -> Iterator[tuple[DataFrame, DataFrame, bool]]:
    """(batch, it and all before, whether it is the last) over ranges of doc_id; null ids are in the first one."""
    cuts = docs.filter("doc_id is not null").approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    cuts = sorted({int(c) for c in cuts})
    k = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    for at in range(len(cuts) + 1):
        upto = docs.filter(k <= cuts[at]) if at < len(cuts) else docs
        yield upto.filter(k > cuts[at - 1]) if at else upto, upto, at == len(cuts)


def remove_repeats(docs: DataFrame, size: int = 50, batches: int = 3, fan: int = FAN) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of docs (doc_id, text).

    Words are runs of other than the six ASCII white-space characters. A word is
    removed when it lies in a window of `size` words that also begins in a
    document with a smaller doc_id; windows are judged on the input. kept_sha256 is of the kept words
    joined by one space. Texts with fewer words, empty and null texts lose
    nothing; rows with a null doc_id neither lose words nor make others lose
    them; rows with equal doc_id don't affect each other.
    """
    nothing = hashlib.sha256(b"").hexdigest()

    def kept(rows: Iterator[tuple]) -> Iterator[tuple]:
        for k, text, proved in rows:
            words = text.encode().split()
            gone = cover(words, proved, size)
            yield k, len(words), int(gone.sum()), hashlib.sha256(b" ".join([w for w, x in zip(words, gone.tolist(), strict=True) if not x])).hexdigest()

    index, out = FingerprintIndex(docs.sparkSession, size, fan), []
    for batch, upto, last in in_batches(docs.select("doc_id", "text"), batches):
        with Scratch(docs.sparkSession) as scratch:
            sketches, whole, proved = index.add(batch, upto, scratch, last)
            rest = sketches.select("doc_id", "t", "n_words", "digest").join(proved.select("doc_id", "t"), ["doc_id", "t"], "left_anti")
            rest = rest.join(whole.withColumn("gone", F.lit(True)), ["doc_id", "t"], "left")
            rest = rest.select("doc_id", "n_words", F.when(F.col("gone"), F.col("n_words")).otherwise(F.lit(0)).cast("long").alias("n_removed"), F.when(F.col("gone"), F.lit(nothing)).otherwise(F.lower(F.hex("digest"))).alias("kept_sha256"))
            # a row of the batch is in one of the two, and each joins one row, so rows with equal ids don't multiply
            partly = only_possible(keyed(batch), "t", proved, "t").join(proved, ["doc_id", "t"]).select("doc_id", "text", "proved")
            out.append(materialise(rest.unionAll(map_rows(partly, kept, "doc_id long, n_words long, n_removed long, kept_sha256 string")), "kept"))
    index.drop()
    return reduce(DataFrame.unionAll, out)


def deduplicate(docs: DataFrame, size: int = 50, batches: int = 3, fan: int = FAN) -> DataFrame:
    """docs without the words that remove_repeats() removes, other white space kept.

    Same columns as docs, whatever their names; n_chars, if there, is set anew in changed texts. Documents that lose all
    their words go; documents without words stay. Rows with a null doc_id and null texts stay as they are; of rows
    that share a doc_id each is changed by its own text.
    """
    columns, name = docs.columns, uuid.uuid4().hex[:12]
    new, gone, i, t = (f"_{c}_{name}" for c in ("text", "gone", "id", "t"))

    def cut(rows: Iterator[tuple]) -> Iterator[tuple]:
        for k, t, text, proved in rows:
            _, data, bounds = next(text_chunks(pa.array([text], pa.string())))
            _, first, end, _ = hash_words(data, bounds, lower=False)
            lost = cover(text.encode().split(), proved, size)
            yield k, t, bool(lost.all()), cut_text(text.encode(), first, end, lost).decode()

    index, changes = FingerprintIndex(docs.sparkSession, size, fan), []
    for batch, upto, last in in_batches(docs.select("doc_id", "text"), batches):
        with Scratch(docs.sparkSession) as scratch:
            _, whole, proved = index.add(batch, upto, scratch, last)
            partly = only_possible(keyed(batch), "t", proved, "t").dropDuplicates(["doc_id", "t"]).join(proved, ["doc_id", "t"])
            partly = map_rows(partly.select("doc_id", "t", "text", "proved"), cut, "doc_id long, t long, gone boolean, text string")
            changes.append(materialise(whole.select("doc_id", "t", F.lit(True).alias("gone"), F.lit("").alias("text")).unionAll(partly), "changes"))
    index.drop()
    changed = reduce(DataFrame.unionAll, changes).toDF(i, t, gone, new)
    maybe, never = apart(docs, "doc_id", changed, i)
    # of rows that repeat a doc_id with other texts, each meets the change of its own text
    joined = maybe.join(changed, (F.col("doc_id").cast("long") == F.col(i)) & (F.xxhash64("text") == F.col(t)), "left").filter(F.coalesce(~F.col(gone), F.lit(True)))
    # in one step, so that the text that is asked for is the one that was there
    same = {"text": F.coalesce(F.col(new), F.col("text"))}
    if "n_chars" in columns:
        same["n_chars"] = F.when(F.col(i).isNotNull(), F.length(F.coalesce(F.col(new), F.col("text")))).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return joined.withColumns(same).select(*columns).unionByName(never.select(*columns))
