"""Deduplication in which the first row of a key, by an explicit order, wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusloom.runtime import materialise


def first_wins(rows: DataFrame, key: Column, *order: Column) -> DataFrame:
    """The first row of each key; rows with a null or empty key go.

    The rank filter becomes a limit per key before and after the shuffle, so a
    frequent key sends one row from each task.
    """
    w = Window.partitionBy("_key").orderBy(*order)
    keyed = rows.withColumn("_key", key).filter(F.col("_key").isNotNull())
    if isinstance(keyed.schema["_key"].dataType, StringType):
        keyed = keyed.filter("_key <> ''")
    return keyed.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_key", "_rank")


def not_seen(rows: DataFrame, key: Column, seen: DataFrame, seen_key: str) -> DataFrame:
    """Rows whose key isn't in another table; Spark picks the join by size."""
    return rows.withColumn("_key", key).join(seen.select(F.col(seen_key).alias("_key")).distinct(), "_key", "left_anti").drop("_key")


def flag_repeats(rows: DataFrame, key: Column, order: list[Column], out: str = "duplicate") -> DataFrame:
    """Keeps all rows and marks the second and later ones of a key."""
    keyed = rows.withColumn("_key", key)
    # the first place of each key by a partial aggregate, so a frequent key isn't sorted in one task
    # and is written, so that the join back against one row a key can be split where a key is frequent
    first = materialise(keyed.groupBy(F.col("_key").alias("_of")).agg(F.min(F.struct(*order)).alias("_first")), "first")
    return keyed.join(first, F.col("_key").eqNullSafe(F.col("_of"))).select(*rows.columns, (F.struct(*order) != F.col("_first")).alias(out))
