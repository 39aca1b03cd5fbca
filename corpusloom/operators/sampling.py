"""Exact-size samples, shuffles and splits, reproducible from a seed and a key.

mode "hash" orders rows by the MD5 of seed and key; it needs no state and any
engine can repeat it. mode "compat" repeats the index permutations of Python's
random module for given (seed, n, k), made on the driver: for tables of a size that fits there.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 42
WEBSITE_WEIGHT, CHAT_WEIGHT = 0.85, 0.15
TRAIN_SPLIT = 0.9


def order_hash(key: Column, seed: int = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def first_by_hash(rows: DataFrame, key: str, k: int, seed: int = SEED) -> DataFrame:
    """The k rows with the smallest (hash, key), exactly; rows of equal keys stay or go together."""
    within = up_to(rows, key, k, seed)
    return rows.filter(within) if within is not None else rows


def up_to(rows: DataFrame, key: str, k: int, seed: int = SEED) -> Column | None:
    """Whether a row is among the k with the smallest (hash, key), as a column of rows; None where all are.

    The k-th smallest pair is found from a histogram of the hash's first digits and
    then within one of its cells, so no task sorts the whole table; rows
    are filtered against it.
    """
    if k <= 0:
        return F.lit(False)
    hashed = rows.withColumn("_h", order_hash(F.col(key), seed))
    prefix, inside = "", k
    cells = hashed.select("_h", key)
    while True:
        width = len(prefix) + 3
        # 4096 rows at most
        counts = sorted((r.c, r.n) for r in cells.groupBy(F.substring("_h", 1, width).alias("c")).agg(F.count("*").alias("n")).collect())
        cell = None
        for c, n in counts:
            if inside <= n:
                cell = (c, n)
                break
            inside -= n
        if cell is None:
            return None
        prefix = cell[0]
        cells = cells.filter(F.startswith("_h", F.lit(prefix)))
        if cell[1] <= 100_000 or width >= 30:
            break
    last = cells.orderBy("_h", key).limit(inside).orderBy(F.desc("_h"), F.desc(key)).first()
    h = order_hash(F.col(key), seed)
    return (h < last["_h"]) | ((h == last["_h"]) & (F.col(key) <= F.lit(last[key])))


def mix_target(website: int, chat: int) -> int:
    """Chat rows for a number of website rows: at least one, halves to even, no more than there are."""
    return min(max(1, round(website * CHAT_WEIGHT / WEBSITE_WEIGHT)), chat)


def sample_exact(rows: DataFrame, key: str, k: int, seed: int = SEED, mode: str = "hash") -> DataFrame:
    if mode == "hash":
        return first_by_hash(rows, key, k, seed)
    return _compat(rows, key, lambda n: random.Random(seed).sample(range(n), min(k, n))).drop("_at")


def split_exact(rows: DataFrame, key: str, fraction: float = TRAIN_SPLIT, seed: int = SEED, mode: str = "hash") -> DataFrame:
    """Adds split: 'train' for floor(n * fraction) rows in shuffled order, 'valid' for the rest.

    Rows of equal keys get the same split, so with repeated keys 'train' may have a few more. A null key counts as valid.
    """
    n = rows.count()
    k = int(n * fraction)
    if mode == "hash":
        within = up_to(rows, key, k, seed)
        return rows.withColumn("split", F.when(F.lit(True) if within is None else within, F.lit("train")).otherwise(F.lit("valid")))
    else:

        def prefix(total: int) -> list[int]:
            order = list(range(total))
            random.Random(seed).shuffle(order)
            return order[:k]

        train = _compat(rows.select(key), key, prefix).select(F.col(key).alias("_train"))
    return rows.join(train, F.col(key) == F.col("_train"), "left").withColumn("split", F.when(F.col("_train").isNotNull(), F.lit("train")).otherwise(F.lit("valid"))).drop("_train")


def mix_compat(website: DataFrame, chat: DataFrame, key: str, seed: int = SEED) -> DataFrame:
    """website and a sample of chat with place (long), as Python's random module draws and then shuffles them from one seed."""
    random_state = random.Random(seed)
    target = mix_target(website.count(), chat.count())
    chosen = _compat(chat, key, lambda n: random_state.sample(range(n), min(target, n)))
    listed = _compat(website, key, lambda n: list(range(n)))
    n = listed.count()
    order = list(range(n + chosen.count()))
    random_state.shuffle(order)
    places = website.sparkSession.createDataFrame([(at, place) for place, at in enumerate(order)], "_listed long, place long")
    both = listed.withColumnRenamed("_at", "_listed").unionByName(chosen.withColumn("_listed", F.col("_at") + n).drop("_at"))
    return both.join(places, "_listed").drop("_listed")


def _compat(rows: DataFrame, key: str, choose) -> DataFrame:
    """Rows at chosen ordinals of the key's order, with _at; the ordinals come from the driver. Keys must differ."""
    ids = [r[0] for r in rows.select(key).orderBy(key).collect()]
    if len(set(ids)) < len(ids):
        raise ValueError("keys must differ in compat mode")
    chosen = [(ids[i], at) for at, i in enumerate(choose(len(ids)))]
    table = rows.sparkSession.createDataFrame(chosen, f"_key {rows.schema[key].dataType.simpleString()}, _at long")
    return rows.join(table, F.col(key) == F.col("_key")).drop("_key")
