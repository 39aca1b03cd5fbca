"""The queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import chat, collocations, fingerprints, lattice, neardup, patterns, periods, quality, sharding, substrings, tokenize

#: The one special token of the byte-level vocabulary.
BYTE_SPECIAL = {"<|endoftext|>": 50256}


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file on this machine and, by the same installation, on the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.encode_digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=24)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.format_conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.pack_digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), BYTE_SPECIAL, end=0, longest=1024)


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), BYTE_SPECIAL, rule="first")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), size=50, batches=3, fan=2)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score_documents(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op11_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periods.planted(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periods.find_runs(docs)
    best = F.array_max(F.transform("runs", lambda x: F.struct(x["length"].alias("length"), (-x["start"]).alias("start"), (-x["period"]).alias("period"))))
    said = F.array_join(F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string")), F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-best["start"]).alias("start"),
        best["length"].alias("length"),
        (-best["period"]).alias("period"),
        F.floor(1000 * best["length"] / -best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(said, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"), least=100, longest=5, top=2000)


def op13_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.pack_few(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), BYTE_SPECIAL, end=0, longest=2048, digest=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_bpe": op2_bpe,
    "op3_sharding": op3_sharding,
    "op4_chat_format": op4_chat_format,
    "op5_packing": op5_packing,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_token_counts": op7_token_counts,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_fingerprints": op9_fingerprints,
    "op10_lm_scores": op10_lm_scores,
    "op11_periods": op11_periods,
    "op12_collocations": op12_collocations,
    "op13_pattern_packing": op13_pattern_packing,
}
