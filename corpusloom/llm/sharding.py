"""Sharding by weighted rendezvous hashing, on built-in functions only."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import gapless

#: Bits of the digest that make a score's uniform number; a double holds them exactly.
BITS = 52


def score(key: Column, shard: int, weight: float) -> Column:
    """The rendezvous score of a key (string) for a shard: weight / -ln(u), u from the digest of both."""
    digest = F.md5(F.concat(key, F.lit(f"|{shard}")).cast("binary"))
    number = F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("double")
    return F.lit(float(weight)) / -F.ln((number + 0.5) / float(1 << BITS))


def assign(records: DataFrame, key: Column, weights: list[float], grown_by: float | None = None) -> DataFrame:
    """Adds `shard` (int): the shard with the highest score, the lowest number of equals.

    A shard gets a share in proportion to its weight. Scores of other shards
    don't depend on a shard's being there, so a new shard takes records only
    into itself and a removed one gives up only its own. With grown_by, the
    weight of one more shard, `grown_shard` is the place with that shard added.
    A null key is one key of its own. No shuffle; columns named shard (with
    grown_by also grown_shard) are replaced, whatever else the rows hold stays.
    """
    own = F.coalesce(key.cast("string"), F.lit("\\N"))
    ranked = [F.struct(score(own, k, w).alias("score"), F.lit(-k).alias("shard")) for k, w in enumerate(weights)]
    best = f"_best_{uuid.uuid4().hex[:12]}"
    out = records.withColumn(best, F.array_max(F.array(*ranked)))
    out = out.withColumn("shard", (-F.col(f"{best}.shard")).cast("int"))
    if grown_by is not None:
        more = F.struct(score(own, len(weights), grown_by).alias("score"), F.lit(-len(weights)).alias("shard"))
        out = out.withColumn("grown_shard", (-F.greatest(F.col(best), more)["shard"]).cast("int"))
    return out.drop(best)


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """The shard and the place in it of every document, with equal weights.

    Returns doc_id, size (UTF-8 bytes and 8), text_crc32, law ("key"), shard,
    slot, grown_shard. Null texts have no bytes and checksum 0. Rows that are
    equal in doc_id, size and checksum are counted before the shuffle and
    spread out again after it, so a repeated row costs one row in the sort.
    """
    weights = [1.0] * shards
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    placed = assign(rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("_n")), F.col("doc_id"), weights, 1.0)
    first = gapless(placed, "shard", F.coalesce(F.col("doc_id").cast("string"), F.lit("\\N")), [F.col("doc_id"), F.col("size"), F.col("text_crc32")], "_n", "_first")
    spread = first.withColumn("slot", F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_n") - 1)))
    return spread.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long"), "grown_shard")
