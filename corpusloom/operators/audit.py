"""Rules over answers, and their summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import payloads
from corpusloom.functions.text import words
from corpusloom.operators.dedupe import flag_repeats

#: Phrases that an answer shouldn't have; add names of the site's own (fixed values).
PHRASES = ("according to", "the provided content", "in conclusion", "this article")
MAX_CHARS, MIN_CHARS, MIN_DISTINCT = 180, 2, 0.6


def issues(answer: Column, phrases: Sequence[str] = PHRASES) -> Column:
    """array<struct<issue, fix>> in the order of the rules; no rule stops another."""

    # names and remedies of the rules (fixed values)
    def one(issue: str, fix: str) -> Column:
        return F.struct(F.lit(issue).alias("issue"), F.lit(fix).alias("fix"))

    def when(condition: Column, issue: str, fix: str) -> Column:
        return F.when(condition, F.array(one(issue, fix))).otherwise(F.array().cast("array<struct<issue:string,fix:string>>"))

    said = words(F.lower(answer))
    phrase = F.transform(
        F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(F.lower(answer), p)),
        lambda p: F.struct(F.lit("bad phrase").alias("issue"), F.concat(F.lit("Remove '"), p, F.lit("'")).alias("fix")),
    )
    return F.concat(
        when(F.length(answer) > MAX_CHARS, "too long", "Shorten answer to 1-2 sentences"),
        when(F.length(answer) < MIN_CHARS, "too short", "Answer is likely useless"),
        phrase,
        when(F.endswith(answer, F.lit(":")), "bad ending", "Answer should be complete sentence"),
        when(F.contains(answer, F.lit("?")), "question in answer", "Answer should not ask questions"),
        when((F.size(said) > 0) & (F.size(F.array_distinct(said)) < F.size(said) * F.lit(MIN_DISTINCT)), "repetition", "Answer may be repetitive"),
    )


def audit(rows: DataFrame, order: list[str], phrases: Sequence[str] = PHRASES) -> DataFrame:
    """Adds invalid, duplicate and issues to rows (question, answer, and columns that order them).

    A row without a question or an answer is invalid, and neither duplicate nor with issues.
    """
    invalid = F.col("question").isNull() | F.col("answer").isNull()
    good = flag_repeats(rows.filter(~invalid), F.col("question"), [F.col(c) for c in order]).withColumn("invalid", F.lit(False)).withColumn("issues", issues(F.col("answer"), phrases))
    bad = rows.filter(invalid).withColumns({"duplicate": F.lit(False), "invalid": F.lit(True), "issues": F.array().cast("array<struct<issue:string,fix:string>>")})
    return good.unionByName(bad)


def positional(lines: DataFrame) -> DataFrame:
    """lines (value: a variant, and columns that order them) with question and answer: the contents of the first two messages.

    Both are null where either isn't there as a string, whatever else the row holds; audit() takes such a row as invalid.
    """
    both = [F.try_variant_get("value", f"$.messages[{k}].content", "variant") for k in (0, 1)]
    texts = [F.when(payloads.is_string(v), F.try_variant_get("value", f"$.messages[{k}].content", "string")) for k, v in enumerate(both)]
    whole = texts[0].isNotNull() & texts[1].isNotNull()
    return lines.withColumns({"question": F.when(whole, texts[0]), "answer": F.when(whole, texts[1])})


def summary(audited: DataFrame) -> DataFrame:
    """total, issues and score: invalid and duplicate rows count one, and rows with issues one more; null score for no row."""
    count = F.coalesce(F.sum(F.col("invalid").cast("long") + F.col("duplicate").cast("long") + (F.size("issues") > 0).cast("long")), F.lit(0))
    totals = audited.agg(F.count("*").alias("total"), count.cast("long").alias("issues"))
    return totals.withColumn("score", F.round(F.try_divide(F.col("total") - F.col("issues"), F.col("total")) * 100.0, 2))
