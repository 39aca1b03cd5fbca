"""Text functions as columns, with the Unicode white-space and line-break classes spelt out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.isspace has it, in Java's regular expressions (fixed values).
WS = "[\\s\\x1c-\\x1f\\x85\\p{Z}]"
NOT_WS = "[^\\s\\x1c-\\x1f\\x85\\p{Z}]"
#: The characters of WS, for functions that take them as a string (fixed values).
SPACES = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Line ends as Python's str.splitlines has them (fixed values).
LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\x{2028}\\x{2029}]"
#: Words that don't count as evidence (fixed values).
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from",
    "has", "have", "in", "is", "it", "its", "of", "on", "or", "that", "the",
    "their", "this", "to", "was", "with", "your", "you", "they", "we", "our",
)
MAX_CHARS = 3500


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(text, F.lit(SPACES))


def collapse(text: Column) -> Column:
    """Every run of white space as one space."""
    return F.regexp_replace(text, f"{WS}+", " ")


def simplify(text: Column, limit: int = MAX_CHARS) -> Column:
    """Collapsed, cut to `limit` code points, then stripped: in this order.

    A long text's beginning is enough where it has `limit` code points once collapsed; else the whole text is collapsed.
    """
    head = F.array(collapse(F.substring(text, 1, 2 * limit)))
    whole = lambda h: F.when((F.length(h) >= limit) | (F.length(text) <= 2 * limit), h).otherwise(collapse(text))
    return strip(F.substring(F.get(F.transform(head, whole), 0), 1, limit))


def words(text: Column) -> Column:
    """Runs without white space."""
    return F.regexp_extract_all(text, F.lit(f"{NOT_WS}+"), F.lit(0))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def tokens(text: Column, stop_words: Sequence[str] = STOP_WORDS, longer_than: int = 2) -> Column:
    """Lower-case runs of ASCII letters and digits, without stop words and short ones."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) > longer_than) & ~t.isin(*stop_words))


def overlap(a: Column, b: Column) -> Column:
    """Distinct tokens that two token arrays share."""
    return F.size(F.array_intersect(a, b))


def clean_lines(text: Column) -> Column:
    """The lines of a text: collapsed, stripped, none empty, each once (case apart) at its first place.

    Sorts the lines by lower-cased key and place: n log n in the lines of a page, no shuffle.
    """
    lines = F.filter(F.transform(F.split(text, LINE_BREAK), lambda x: strip(collapse(x))), lambda x: x != "")
    keyed = F.transform(lines, lambda x, i: F.struct(F.lower(x).alias("key"), i.alias("at"), x.alias("line")))
    # sorted by key then place: a line stays where its key differs from the one before
    firsts = F.element_at(
        F.transform(
            F.array(F.array_sort(keyed)),
            lambda s: F.filter(s, lambda x, i: (i == 0) | (x["key"] != F.get(s, i - 1)["key"])),
        ),
        1,
    )
    ordered = F.array_sort(F.transform(firsts, lambda x: F.struct(x["at"].alias("at"), x["line"].alias("line"))))
    return F.transform(ordered, lambda x: x["line"])


def page_name(file: Column) -> Column:
    """A text file's name without its extension, hyphens as spaces."""
    return F.replace(F.regexp_replace(file, "\\.[^./]*$", ""), F.lit("-"), F.lit(" "))
