"""Helpers that every operator may use: shared storage and gapless numbering."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Shuffle files go as soon as the query that made them has ended, not when the driver collects its garbage.
_CLEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from spark.checkpoint.dir.

    Only where that setting is absent and Spark runs in this one process (tests) a folder under the
    local temporary directory is used and set as the checkpoint folder; a cluster without it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), "checkpoints")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


@contextmanager
def configured(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Session settings that hold inside the block only."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def table_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "table", path: str | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back.

    Cuts the lineage, survives lost executors, and lets several consumers read
    one computation. The plan of the result is a plain scan.
    """
    path = path or table_path(df.sparkSession, name)
    with configured(df.sparkSession, _CLEAN):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Removes a file or folder of any file system that Spark writes to."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)  # noqa: SLF001


class Scratch:
    """Intermediate tables of one computation; they go together once its result is written.

    with Scratch(spark) as scratch: ... scratch.keep(df, "name") ... result = materialise(...)
    What leaves the block mustn't read its tables any more. After an error they stay.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame, name: str = "table") -> DataFrame:
        path = table_path(self.spark, name)
        self.paths.append(path)
        return materialise(df, name, path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            for path in self.paths:
                delete(self.spark, path)


def gapless(rows: DataFrame, group: str, bucket_key: Column, order: list[Column], count: str, out: str, buckets: int = 1024) -> DataFrame:
    """Adds `out`: for each row the sum of `count` over the rows before it in `group`.

    The order inside a group is (bucket of bucket_key, order); a bucket is the first 12 bits of the key's MD5, modulo `buckets`. A group is never
    sorted in one task: its rows are dealt to `buckets` buckets, each bucket is
    numbered on its own, and the offsets of the buckets come from a table of
    (groups x buckets) sums. `rows` is read twice, so it should be cheap or
    materialised. The number of groups must be small and fixed (shards, classes).
    """
    # names of its own, so that columns of rows may have any
    bucket, total, offset, inner, whose = (f"_{n}_{uuid.uuid4().hex[:12]}" for n in ("bucket", "sum", "offset", "inside", "group"))
    dealt = rows.withColumn(bucket, F.conv(F.substring(F.md5(bucket_key.cast("binary")), 1, 3), 16, 10).cast("int") % buckets)
    sums = dealt.groupBy(F.col(group).alias(whose), F.col(bucket).alias(total)).agg(F.sum(count).alias(inner))
    before = Window.partitionBy(whose).orderBy(total).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(whose, total, F.coalesce(F.sum(inner).over(before), F.lit(0)).alias(offset))
    inside = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    numbered = dealt.withColumn(inner, F.coalesce(F.sum(count).over(inside), F.lit(0)))
    # groups x buckets rows at most, whatever the number of records: a proven bound for the broadcast
    joined = numbered.join(F.broadcast(offsets), (F.col(group) == F.col(whose)) & (F.col(bucket) == F.col(total)))
    return joined.withColumn(out, (F.col(offset) + F.col(inner)).cast("long")).drop(bucket, total, offset, inner, whose)


def written(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written to the end at path."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")  # noqa: SLF001
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)  # noqa: SLF001


def once(df: DataFrame, path: str) -> DataFrame:
    """materialise() at a place of its own; what an earlier run has written to the end there is read, not made again."""
    spark = df.sparkSession
    if not written(spark, path):
        delete(spark, path)
        materialise(df, path=path)
    return spark.read.schema(df.schema).parquet(path)


def ordinals(rows: DataFrame, key: str, order: list[Column], out: str, width: int = 4096) -> DataFrame:
    """Adds `out`: each row's number, from 0 without gaps, in the order of (key, order).

    key: a column of longs from 0, of which only a bounded number of rows are equal (the links of one page). Rows are
    numbered inside stretches of `width` keys, stretches inside groups of `width` of them; the driver sees
    one row for each group, that is for width x width keys. No window is without a partition. `rows` is read twice.
    """
    stretch, group, inside, before = (f"_{n}_{uuid.uuid4().hex[:12]}" for n in ("stretch", "group", "inside", "before"))
    dealt = rows.withColumn(stretch, F.expr(f"{key} div {width}"))
    counts = dealt.groupBy(F.col(stretch).alias(group)).agg(F.count("*").alias(inside)).withColumnRenamed(group, before)
    counts = counts.withColumn(group, F.expr(f"{before} div {width}"))
    total, sums = 0, []
    for g, n in sorted(tuple(r) for r in counts.groupBy(group).agg(F.sum(inside)).collect()):
        sums.append((g, total))
        total += n
    if not sums:
        return rows.withColumn(out, F.lit(0).cast("long"))
    starts = rows.sparkSession.createDataFrame(sums, f"{group} long, _start long")
    up_to = Window.partitionBy(group).orderBy(before).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn(inside, F.coalesce(F.sum(inside).over(up_to), F.lit(0))).join(F.broadcast(starts), group)
    offsets = offsets.select(F.col(before).alias(group), (F.col(inside) + F.col("_start")).alias(before))
    numbered = dealt.withColumn(inside, F.row_number().over(Window.partitionBy(stretch).orderBy(key, *order)) - 1)
    joined = numbered.join(offsets, F.col(stretch) == F.col(group))
    return joined.withColumn(out, (F.col(inside) + F.col(before)).cast("long")).drop(stretch, group, inside, before)


#: Bits of the filter in front of an anti join, however many keys there are.
SEEN_BITS = 1 << 24


def unseen(rows: DataFrame, key: str, seen: DataFrame, seen_key: str) -> DataFrame:
    """Rows whose key isn't in seen: an anti join behind a filter of fixed size.

    Each seen key sets one of SEEN_BITS bits, broadcast as at most SEEN_BITS / 64 rows; a row whose bit isn't set is new
    without a shuffle, only the others go through the join. Both tables are read twice; where rows end in a shuffle, Spark
    makes it once for both readings. Null keys are never seen.
    """
    word, bits, slot = (f"_{n}_{uuid.uuid4().hex[:12]}" for n in ("word", "bits", "slot"))
    place = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(SEEN_BITS))
    words = seen.select(place(seen_key).alias(slot)).groupBy(F.expr(f"{slot} div 64").alias(word)).agg(F.expr(f"bit_or(shiftleft(1L, cast({slot} % 64 as int)))").alias(bits))
    looked = rows.withColumn(slot, place(key)).join(F.broadcast(words), F.expr(f"{slot} div 64 = {word}"), "left")
    looked = looked.withColumn(slot, F.coalesce(F.expr(f"bit_get({bits}, cast({slot} % 64 as int))"), F.lit(0))).drop(word, bits)
    maybe = looked.filter(F.col(slot) == 1).drop(slot).join(seen.select(F.col(seen_key).alias(word)), F.col(key) == F.col(word), "left_anti")
    return looked.filter(F.col(slot) == 0).drop(slot).unionByName(maybe)
