"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words, as the contract has it.
SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Frequent words of the corpus' languages (fixed values): English, German, French, Spanish.
STOP_WORDS = (
    "the of and to in a is that it for on was be with as by this are at from "
    "der die und den von zu das mit sich des auf ist im dem nicht ein eine "
    "de la le et les des en un une que est pour dans du qui pas sur au par "
    "el los las se con por para y lo como del una"
)

#: (name, measure, comparison that rejects, threshold). A measure is a column of measures().
RULES: tuple[tuple[str, str, str, float], ...] = (
    ("words are too short", "mean_word_chars", "<", 2.0),
    ("words are too long", "mean_word_chars", ">", 12.0),
    ("too many symbols", "symbols_per_word", ">", 0.1),
    ("no stop words in a long text", "long_stop_ratio", "<", 0.02),
    ("words echo the word before", "echo_ratio", ">", 0.3),
    ("too many repeated lines", "dup_line_ratio", ">", 0.5),
)


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once, inside an expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(words: Column) -> Column:
    """Words that lie in a 5-word window that occurs twice or more.

    Hashes of all windows tell whether any can repeat; only then the windows
    themselves are sorted with their places, so equal hashes alone decide nothing.
    n log n in the words of a text.
    """

    def covered(places: Column) -> Column:
        following = F.transform(places, lambda p, i: F.least(F.lit(5), F.coalesce(F.get(places, i + 1) - p, F.lit(5))))
        return F.aggregate(following, F.lit(0), lambda a, x: a + x)

    def exact(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(w) - 4), lambda i: F.struct(F.array_join(F.slice(w, i, 5), " ").alias("t"), i.alias("p")))
        return _let(
            F.array_sort(windows),
            lambda s: _let(
                F.array_sort(F.transform(F.filter(s, lambda x, i: (x["t"] == F.coalesce(F.get(s, i - 1)["t"], F.lit(""))) | (x["t"] == F.coalesce(F.get(s, i + 1)["t"], F.lit("")))), lambda x: x["p"])),
                covered,
            ),
        )

    def hashed(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)]))

    some = _let(words, lambda w: F.when(_let(hashed(w), lambda h: F.size(F.array_distinct(h)) < F.size(h)), exact(w)).otherwise(F.lit(0)))
    return F.when(F.size(words) < 5, F.lit(0)).otherwise(some)


def measures(docs: DataFrame, text: str = "text", stop_words: str = STOP_WORDS) -> DataFrame:
    """Adds what the rules look at; no shuffle. Columns of docs with one of these names are replaced, every other one stays.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long; see the
    names in the README), n_lines, n_echo_words (equal to the word
    before), n_stop_words, and the ratios mean_word_chars, symbols_per_word,
    stop_ratio, long_stop_ratio (null under 50 words), echo_ratio, dup_line_ratio. A null text counts as empty; ratios of nothing are null.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, SPACE), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    own_words, own_lines = (f"_{n}_{uuid.uuid4().hex[:12]}" for n in ("words", "lines"))
    out = docs.withColumn(own_words, words).withColumn(own_lines, lines)
    out = out.withColumns(
        {
            "n_words": F.size(own_words).cast("long"),
            "word_chars": F.aggregate(own_words, F.lit(0).cast("long"), lambda a, w: a + F.length(w)),
            "n_symbols": F.length(F.regexp_replace(t, f"[^{SYMBOLS}]+", "")).cast("long"),
            "n_dup_lines": (F.size(own_lines) - F.size(F.array_distinct(own_lines))).cast("long"),
            "n_repeat_words": _repeated(F.col(own_words)).cast("long"),
            "n_lines": F.size(own_lines).cast("long"),
            "n_echo_words": _let(F.col(own_words), lambda words: F.size(F.filter(words, lambda w, i: w == F.get(words, i - 1)))).cast("long"),
            "n_stop_words": F.size(F.filter(own_words, lambda w: w.isin(stop_words.split()))).cast("long"),
        }
    ).drop(own_words, own_lines)
    some = F.nullif(F.col("n_words"), F.lit(0))
    return out.withColumns(
        {
            "mean_word_chars": F.col("word_chars") / some,
            "symbols_per_word": F.col("n_symbols") / some,
            "stop_ratio": F.col("n_stop_words") / some,
            "long_stop_ratio": F.when(F.col("n_words") >= 50, F.col("n_stop_words") / some),
            "echo_ratio": F.col("n_echo_words") / some,
            "dup_line_ratio": F.col("n_dup_lines") / F.nullif(F.col("n_lines"), F.lit(0)),
        }
    )


def verdict(rules: tuple[tuple[str, str, str, float], ...] = RULES) -> tuple[Column, Column]:
    """The table as two columns: true where no rule rejects, and the names of the rules that reject.

    A measure that is null rejects nothing.
    """
    compare = {"<": lambda c, x: c < x, ">": lambda c, x: c > x, "<=": lambda c, x: c <= x, ">=": lambda c, x: c >= x}
    hits = [(name, F.coalesce(compare[how](F.col(measure), F.lit(limit)), F.lit(False))) for name, measure, how, limit in rules]
    passed = F.lit(True)
    for _, hit in hits:
        passed = passed & ~hit
    return passed, F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in hits]))


def score_quality(docs: DataFrame, text: str = "text", rules: tuple[tuple[str, str, str, float], ...] = RULES) -> DataFrame:
    """measures() and, from them, base_failed, kept (boolean) and rejected_by (names of rules).

    Columns of docs that have one of these names are replaced. Filter with keep_good(), which says why.

    base_failed: fewer than 10 words, or over 20 % of the words in repeated 5-word windows.
    """
    passed, names = verdict(rules)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measures(docs, text).withColumn("base_failed", base).withColumns({"kept": ~F.col("base_failed") & passed, "rejected_by": names})


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[tuple[str, str, str, float], ...] = RULES) -> DataFrame:
    """The rows of docs that score_quality() keeps, with their own columns, also those that are named as a measure.

    A plain filter on `kept` would be pushed below the projections, and all that
    the verdict is made of computed again in it; the partition's number, which may not be
    moved, holds the filter above them.
    """
    own = f"_own_{uuid.uuid4().hex[:12]}"
    rows = docs.select(F.struct("*").alias(own), F.col(text))
    scored = score_quality(rows, text, rules).withColumn("_at", F.spark_partition_id())
    return scored.filter("kept and _at >= 0").select(f"{own}.*")
