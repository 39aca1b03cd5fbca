"""Predicates and normal forms of conversations, array<struct<role, content>>."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import overlap, strip, tokens, word_count

#: An answer with one of these, case apart, isn't grounded in its page (fixed values).
BAD_PATTERNS = (
    "according to the content",
    "according to the provided content",
    "based on the content",
    "from the content",
    "the text says",
    "the article says",
    "i don't know",
    "not sure",
)
ROLES = ("user", "assistant")


def _sure(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def all_valid(messages: Column) -> Column:
    """Every message has a known role and a content that isn't blank."""
    return _sure(F.forall(messages, lambda m: _sure(m["role"].isin(*ROLES) & (strip(m["content"]) != ""))))


def alternates(messages: Column) -> Column:
    """Roles are user, assistant, user, assistant and so on."""
    expected = F.transform(messages, lambda m, i: _sure(m["role"] == F.when(i % 2 == 0, F.lit("user")).otherwise(F.lit("assistant"))))
    return _sure(F.forall(expected, lambda ok: ok))


def answers(messages: Column) -> Column:
    """The stripped contents of the assistant's messages."""
    return F.transform(F.filter(messages, lambda m: m["role"] == "assistant"), lambda m: strip(m["content"]))


def has_phrase(text: Column, phrases: Sequence[str]) -> Column:
    return F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(F.lower(text), p))


def reject_reason(messages: Column, source_tokens: Column, patterns: Sequence[str] = BAD_PATTERNS, least: int = 4, most: int = 45, shared: int = 2) -> Column:
    """Why the strict validator rejects a conversation, the first reason in its order; null where it doesn't."""
    said = answers(messages)
    return (
        F.when(messages.isNull(), F.lit("not a list"))
        .when((F.size(messages) < 2) | (F.size(messages) % 2 != 0), F.lit("turn count"))
        .when(~_sure(F.get(messages, 0)["role"] == "user"), F.lit("first role"))
        .when(~all_valid(messages), F.lit("invalid message"))
        .when(~alternates(messages), F.lit("alternation"))
        .when(F.exists(said, lambda a: has_phrase(a, patterns)), F.lit("bad phrase"))
        .when(F.exists(said, lambda a: ~word_count(a).between(least, most)), F.lit("answer length"))
        .when(F.exists(said, lambda a: overlap(tokens(a), source_tokens) < shared), F.lit("not grounded"))
    )


def structural(messages: Column) -> Column:
    """The messages with stripped contents where turns are even and alternate and no content is blank; else null."""
    stripped = F.transform(messages, lambda m: F.struct(m["role"].alias("role"), strip(m["content"]).alias("content")))
    good = _sure((F.size(messages) >= 2) & (F.size(messages) % 2 == 0)) & all_valid(messages) & alternates(messages)
    return F.when(good, stripped)


def loose(messages: Column) -> Column:
    """As structural(), but any order and number of turns from two on, as long as the user begins."""
    stripped = F.transform(messages, lambda m: F.struct(m["role"].alias("role"), strip(m["content"]).alias("content")))
    good = _sure(F.size(messages) >= 2) & all_valid(messages) & _sure(F.get(messages, 0)["role"] == "user")
    return F.when(good, stripped)


def conversation_key(messages: Column) -> Column:
    """What makes two conversations the same: roles and lower-cased contents."""
    return F.transform(messages, lambda m: F.struct(m["role"].alias("role"), F.lower(m["content"]).alias("content")))


def question_key(messages: Column, collapsed: bool) -> Column:
    """The first message, stripped and lower-cased, with white space collapsed or not."""
    key = F.lower(strip(F.get(messages, 0)["content"]))
    return F.regexp_replace(key, "[\\s\\x1c-\\x1f\\x85\\p{Z}]+", " ") if collapsed else key
