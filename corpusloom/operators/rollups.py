"""Sums over all grouping sets of some columns, and sketches that are kept per day and merged later."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Binary logarithm of the registers of a distinct-count sketch: standard error 1.04 / sqrt(2 ** 14), that is 0.8 %.
REGISTERS = 14
#: Size of a quantile sketch: its ranks are within about 1.7 % with 99 % certainty.
QUANTILES = 200


def cube(rows: DataFrame, dims: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """dims, level, rows and the sum of each column of `sums`, for every grouping set of dims.

    level: the grouping id; bit k from the right is set where the k-th last column is summed over, which tells such
    rows from those with a null of their own. Rows are summed at the finest grouping before they are multiplied by
    the number of grouping sets, so the shuffles move sums, not rows.
    """
    fine = rows.groupBy(*dims).agg(F.count("*").alias("_rows"), *(F.sum(c).alias(c) for c in sums))
    return fine.cube(*dims).agg(F.grouping_id().alias("level"), F.sum("_rows").alias("rows"), *(F.sum(c).alias(c) for c in sums))


def day_sketches(rows: DataFrame, time: str, counted: str, measured: str) -> DataFrame:
    """day, n, distinct and quantiles (both binary) of rows: what is kept of a day. Null values count in n only."""
    sketches = F.hll_sketch_agg(counted, REGISTERS).alias("distinct"), F.kll_sketch_agg_double(F.col(measured).cast("double"), QUANTILES).alias("quantiles")
    return rows.groupBy(F.to_date(time).alias("day")).agg(F.count("*").alias("n"), *sketches)


def merged(sketches: DataFrame, by: Column, name: str, quantile: float = 0.5) -> DataFrame:
    """by (as `name`), n, the estimated number of distinct values and the estimated quantile, from sketches alone."""
    both = sketches.groupBy(by.alias(name)).agg(F.sum("n").alias("n"), F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("quantiles").alias("quantiles"))
    return both.select(name, "n", F.hll_sketch_estimate("distinct").alias("distinct"), F.kll_sketch_get_quantile_double("quantiles", F.lit(quantile)).alias("quantile"))
