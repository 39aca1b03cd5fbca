"""JSON that a model returned, possibly among prose."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusloom.functions.text import strip

#: In this order: a fenced block, the widest {...}, the widest [...] (fixed values).
FENCED = "(?s)```(?:json)?\\s*(\\{.*\\}|\\[.*\\])\\s*```"
OBJECT = "(?s)\\{.*\\}"
LIST = "(?s)\\[.*\\]"


def salvage(text: Column) -> Column:
    """The JSON part of a response, null where there is none."""
    plain = strip(text)
    return F.coalesce(
        F.nullif(F.regexp_extract(plain, FENCED, 1), F.lit("")),
        F.nullif(F.regexp_extract(plain, OBJECT, 0), F.lit("")),
        F.nullif(F.regexp_extract(plain, LIST, 0), F.lit("")),
    )


@F.pandas_udf(StringType())
def _python_json(texts: pd.Series) -> pd.Series:
    """A text as plain JSON, read by Python's rules; null where it isn't one JSON value."""

    def plain(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            return json.dumps(json.loads(text, parse_constant=lambda _: None))
        except (ValueError, RecursionError):
            return None

    return pd.Series([plain(t) for t in texts], dtype=object)


def strict_json(text: Column) -> Column:
    """The variant that a whole text is; null where it isn't exactly one JSON value.

    Spark's parser refuses repeated keys and NaN or Infinity. Texts that it refuses, and only those, are read
    as Python's json module does: of a repeated key the last value stays, and those numbers become JSON's null.
    """
    # try_parse_json alone would take the first value and ignore what follows, so the text is the first of two elements of a list
    both = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"~~end~~"]'))), "$", "array<variant>")
    closed = F.coalesce((F.size(both) == 2) & (F.try_variant_get(F.get(both, 1), "$", "string") == "~~end~~"), F.lit(False))
    return F.when(closed, F.get(both, 0)).otherwise(F.try_parse_json(_python_json(F.when(~closed, text))))


def unwrap(value: Column) -> Column:
    """The items of a payload: the list itself, or an object's list `items`, else none."""
    return F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.try_variant_get(value, "$.items", "array<variant>"), F.array().cast("array<variant>"))


def is_string(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def messages(item: Column) -> Column:
    """An item's messages as array<struct<role, content>>; null unless it is an object whose `messages` is a list of objects.

    A role or content that isn't a string becomes null, which every validator rejects.
    """
    found = F.try_variant_get(item, "$.messages", "array<variant>")

    def text(m: Column, name: str) -> Column:
        value = F.try_variant_get(m, f"$.{name}", "variant")
        return F.when(is_string(value), F.try_variant_get(m, f"$.{name}", "string"))

    objects = F.forall(found, lambda m: F.coalesce(F.startswith(F.schema_of_variant(m), F.lit("OBJECT")), F.lit(False)))
    return F.when(objects, F.transform(found, lambda m: F.struct(text(m, "role").alias("role"), text(m, "content").alias("content"))))
