"""First-wins deduplication over batches that come one after the other, possibly in different jobs."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.runtime import configured, delete, table_path, written

#: The column of keys in the store's files.
KEY = "_store_key"
#: So many runs of a level become one of the next.
FAN = 4


class KeyStore:
    """Keys that earlier batches held, in a folder that all executors share.

    A batch's new rows are one run: `buckets` files, by the hash of the key, each sorted by it. The next
    batch is dealt once, likewise, and anti joined with the runs, which are neither shuffled nor sorted again. Runs
    are merged by merge joins on their keys, so a batch meets a number of runs that grows with the logarithm of
    the number of batches. A job that opens the folder again goes on behind the last whole batch.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int | None = None, fan: int = FAN):
        self.spark, self.fan = spark, fan
        self.folder = folder or table_path(spark, "keys")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.batches: list[str] = []
        self.runs: list[tuple[int, str]] = []
        self.made = 0
        self.tables: dict[str, str] = {}
        if written(spark, f"{self.folder}/manifest"):
            kept = json.loads(spark.read.schema("version int, value string").json(f"{self.folder}/manifest").orderBy(F.desc("version")).first().value)
            self.buckets, self.batches, self.made = kept["buckets"], kept["batches"], kept["made"]
            self.runs = [(level, name) for level, name in kept["runs"]]

    def _save(self) -> None:
        kept = {"buckets": self.buckets, "batches": self.batches, "made": self.made, "runs": self.runs}
        row = self.spark.createDataFrame([(len(self.batches), json.dumps(kept))], "version int, value string")
        row.coalesce(1).write.mode("append").json(f"{self.folder}/manifest")

    def _dealt(self):
        """Inside, plans take the runs' buckets and order as they are, and deal other rows likewise."""
        return configured(self.spark, {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.shuffle.partitions": str(self.buckets)})

    def _write(self, rows: DataFrame, name: str) -> None:
        path, table = f"{self.folder}/{name}", f"written_{uuid.uuid4().hex}"
        self._forget(name)
        delete(self.spark, path)
        rows.write.format("parquet").bucketBy(self.buckets, KEY).sortBy(KEY).option("path", path).mode("overwrite").saveAsTable(table)
        self.spark.sql(f"DROP TABLE {table}")

    def _forget(self, name: str) -> None:
        if name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(name)}")

    def keys(self, name: str) -> DataFrame:
        """The keys of a run, known to Spark as dealt and sorted."""
        if name not in self.tables:
            table = f"keys_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {table} ({KEY} STRING) USING parquet CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{name}'")
            self.tables[name] = table
        return self.spark.table(self.tables[name])

    def new(self, rows: DataFrame, key: Column, *order: Column) -> DataFrame:
        """The first row of each key that no batch held, with the key as KEY; null and empty keys go."""
        first = Window.partitionBy(KEY).orderBy(*order)
        kept = rows.withColumn(KEY, key.cast("string")).filter(F.col(KEY) != "")
        kept = kept.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank")
        for _, name in self.runs:
            kept = kept.join(self.keys(name), KEY, "left_anti")
        return kept

    def admit(self, batch: str, rows: DataFrame, key: Column, *order: Column) -> DataFrame:
        """new() of a batch, which is taken in; a batch that was taken in before gives what it gave then."""
        name = f"batch-{batch}"
        if batch not in self.batches:
            with self._dealt():
                self._write(self.new(rows, key, *order), name)
                self.batches.append(batch)
                gone = self._append(name)
            self._save()
            for old in gone:
                self._forget(old)
                if not old.startswith("batch-"):
                    delete(self.spark, f"{self.folder}/{old}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{name}")

    def _append(self, name: str) -> list[str]:
        """Takes a run in at level 0 and merges full levels; what the merged runs replace."""
        self.runs.append((0, name))
        level, gone = 0, []
        while len(same := [n for at, n in self.runs if at == level]) >= self.fan:
            merged = self.keys(same[0])
            for n in same[1:]:
                # no key is in two runs
                other = self.keys(n).withColumnRenamed(KEY, "_other")
                merged = merged.join(other, F.col(KEY) == F.col("_other"), "full_outer").select(F.coalesce(KEY, "_other").alias(KEY))
            self.made += 1
            self._write(merged, f"merged-{self.made}")
            self.runs = [x for x in self.runs if x[0] != level] + [(level + 1, f"merged-{self.made}")]
            gone += same
            level += 1
        return gone
