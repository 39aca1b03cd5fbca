"""A corpus pipeline of four stages over documents; see STAGES."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import neardup, quality, substrings, tokenize
from corpusloom.llm.prefilter import apart
from corpusloom.llm.queries import BYTE_SPECIAL, vocabulary
from corpusloom.runtime import materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that the rules reject go."""
    return quality.keep_good(docs.select(*COLUMNS))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: of each group of near copies (similarity 0.8 or more) the smallest doc_id stays.

    Each row goes by the verdict on its own id and text; of rows that share an id, or have none,
    and have the same shingles one stays. Rows without an id are compared by equal shingles only.
    """
    judged = materialise(neardup.verdicts(docs, percent=80), "judged")
    # texts without shingles are linked with nothing, so all their rows stay
    texts = judged.filter("n_shingles > 0").groupBy("doc_id", "t").agg(F.first("digest").alias("digest"), F.first("kept").alias("kept"), F.count("*").alias("n"))
    sets = texts.groupBy("doc_id", "digest").agg(F.min("t").alias("least"), F.count("*").alias("texts"))
    repeated = texts.join(sets.filter("texts > 1").withColumnsRenamed({"doc_id": "i", "digest": "d"}), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d")), "left")
    changes = repeated.select(F.col("doc_id").alias("_id"), F.col("t").alias("_t"), (~F.col("kept") | F.coalesce(F.col("t") != F.col("least"), F.lit(False))).alias("_gone"), "n").filter("_gone or n > 1")
    changes = materialise(changes.select("_id", "_t", "_gone"), "gone")
    maybe, never = apart(docs.select(*COLUMNS), "doc_id", changes, "_id")
    joined = maybe.join(changes, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_t")), "left").filter("_gone is null or not _gone")
    once = joined.filter("_gone is not null").dropDuplicates(["doc_id", "_t"])
    return joined.filter("_gone is null").select(*COLUMNS).unionByName(once.select(*COLUMNS)).unionByName(never)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup: words in 50-word windows that begin in an earlier document go; so do texts without words left."""
    return substrings.deduplicate(docs.select(*COLUMNS), size=50, batches=3, fan=2)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: the pieces of every document, with their ids."""
    return tokenize.pack(docs, vocabulary("byte_bpe_50k.tiktoken"), BYTE_SPECIAL, end=0, longest=1024)


STAGES = [("quality_rules", keep_quality), ("near_dedup", drop_near_duplicates), ("substring_dedup", remove_repeats), ("packing", pack_sequences)]

#: Tokens are outside of SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
