"""A filter of fixed size in front of a join with few matches."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter, however many ids there are.
BITS = 1 << 24


def apart(rows: DataFrame, key: str, ids: DataFrame, id_column: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be in ids, rows whose key isn't): together all rows.

    Each id sets one of BITS bits; they are broadcast as a table of (word, 64
    bits), of at most BITS / 64 = 262144 rows whatever the ids, and every row looks up
    its own bit before any shuffle. By chance some keys that aren't in ids may seem to
    be, more with very many ids, but none is missed: the join that follows
    decides. A null key may be in ids only if a null is. The other columns of rows may have any
    names. ids is read for each of the two results, so it should be materialised.
    """

    def place(column: str) -> Column:
        return F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(BITS))

    p, w, b = (f"_{n}_{uuid.uuid4().hex[:12]}" for n in "pwb")
    words = ids.select(place(id_column).alias(p)).groupBy(F.expr(f"{p} div 64").alias(w)).agg(F.expr(f"bit_or(shiftleft(1L, cast({p} % 64 as int)))").alias(b))
    looked = rows.withColumn(p, place(key)).join(F.broadcast(words), F.expr(f"{p} div 64 = {w}"), "left")
    bit = F.coalesce(F.expr(f"bit_get({b}, cast({p} % 64 as int))"), F.lit(0))
    return looked.filter(bit == 1).drop(p, w, b), looked.filter(bit == 0).drop(p, w, b)


def only_possible(rows: DataFrame, key: str, ids: DataFrame, id_column: str) -> DataFrame:
    """The rows whose key may be in ids (see apart)."""
    return apart(rows, key, ids, id_column)[0]
