"""Sessions, as-of joins and interval joins over rows with a time.

A busy key is split: work is done inside (key, slice of time) first, and only one row of each such part, whose
number depends on the span of time and not on the number of events, is put in the order of its key.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import times


def _own(*names: str) -> list[str]:
    """Column names that no table has."""
    tail = uuid.uuid4().hex[:12]
    return [f"_{n}_{tail}" for n in names]


def sessions(events: DataFrame, key: str, time: str, gap: str, sums: Sequence[str] = (), hours: int = 24) -> DataFrame:
    """key, start, last, events and the sum of each column of `sums`, for every session of a key.

    A session goes on while the next event comes at most `gap` (an interval such as "30 minutes") after the one before, as in session_window. Rows with a null key or time
    are in no session; repeated rows count each time.
    """
    piece, part, first, last, n, fresh, begins, count = _own("piece", "slice", "first", "last", "n", "fresh", "begins", "count")
    rows = events.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).select(key, time, *sums, times.slices(F.col(time), hours).alias(part))
    by_time = Window.partitionBy(key, part).orderBy(time)
    before = F.lag(time).over(by_time)
    far = F.coalesce(F.col(time) > before + F.expr(f"INTERVAL {gap}"), F.lit(True))
    pieces = rows.withColumn(fresh, far.cast("long")).withColumn(piece, F.sum(fresh).over(by_time.rangeBetween(Window.unboundedPreceding, 0)))
    pieces = pieces.groupBy(key, part, piece).agg(F.min(time).alias(first), F.max(time).alias(last), F.count("*").alias(n), *(F.sum(c).alias(c) for c in sums))
    # one row a slice: does its first piece go on from the slice before, and where did the last piece so far begin?
    edges = pieces.groupBy(key, part).agg(F.min(first).alias(first), F.max(last).alias(last), F.max(first).alias(begins), F.max(piece).alias(count))
    in_key = Window.partitionBy(key).orderBy(part)
    edges = edges.withColumn(fresh, F.coalesce(F.col(first) > F.lag(last).over(in_key) + F.expr(f"INTERVAL {gap}"), F.lit(True)))
    opened = F.when(F.col(fresh) | (F.col(count) > 1), F.col(begins))
    edges = edges.withColumn(begins, F.last(opened, ignorenulls=True).over(in_key.rowsBetween(Window.unboundedPreceding, -1)))
    edges = edges.filter(~F.col(fresh)).select(key, part, F.lit(1).cast("long").alias(piece), begins)
    whole = pieces.join(edges, [key, part, piece], "left").withColumn("start", F.coalesce(begins, first))
    return whole.groupBy(key, "start").agg(F.max(last).alias("last"), F.sum(n).alias("events"), *(F.sum(c).alias(c) for c in sums))


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, out: str = "match", ties: Sequence[str] = (), hours: int = 24) -> DataFrame:
    """left's rows with `out`, a struct of the last row of right with their key at or before their time; null where there is none.

    Of right's rows with equal times the greatest by `ties` counts; `ties` should tell such rows apart. Rows of left with a null key or time stay, without
    a match; such rows of right match nothing. Repeated rows of left stay repeated.
    """
    row, match, part, k, t, carry = _own("row", "match", "slice", "key", "time", "carry")
    known = F.col(key).isNotNull() & F.col(time).isNotNull()
    dealt = [F.col(key).alias(k), F.col(time).alias(t), times.slices(F.col(time), hours).alias(part)]
    found = right.filter(known).select(*dealt, F.struct(*right.columns).alias(match))
    asked = left.filter(known).select(*dealt, F.struct(*left.columns).alias(row))
    both = found.unionByName(asked, allowMissingColumns=True)
    order = [F.col(t), F.col(row).isNotNull(), *(F.col(match)[c] for c in ties)]
    inside = Window.partitionBy(k, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn(match, F.last(match, ignorenulls=True).over(inside)).filter(F.col(row).isNotNull())
    # what each slice hands on: one row a slice, also for slices in which right has none
    place = F.when(F.col(match).isNotNull(), F.struct(F.col(t), *(F.col(match)[c].alias(f"tie{i}") for i, c in enumerate(ties))))
    handed = both.groupBy(k, part).agg(F.max_by(match, place).alias(carry))
    in_key = Window.partitionBy(k).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    handed = handed.withColumn(carry, F.last(carry, ignorenulls=True).over(in_key)).filter(F.col(carry).isNotNull())
    matched = carried.join(handed, [k, part], "left").select(*(F.col(row)[c].alias(c) for c in left.columns), F.coalesce(match, carry).alias(out))
    none = left.filter(~known).select(*left.columns, F.lit(None).cast(matched.schema[out].dataType).alias(out))
    return matched.unionByName(none)


def within(left: DataFrame, right: DataFrame, time: str, before: int, after: int, on: Sequence[str] = (), out: str = "other") -> DataFrame:
    """Each pair of a row of left and one of right (struct `out`) that lies at most `before` seconds earlier or `after` later.

    Times are dealt to bins of a quarter of the interval, so a row of left lies in about five of them and meets each row of right in one;
    the join is on equal bins and equal `on`, and the exact times decide: about five rows are compared for four pairs. The bounds
    are made once a row of left, not once a pair. Nulls in time or `on` give no pair. The result itself grows with the product of the rows in an interval.
    """
    width = max(1, (before + after) // 4)
    bin_, t, other, low, high = _own("bin", "time", "other", "low", "high")
    at = times.seconds(F.col(time))
    bins = F.sequence(F.floor((at - before) / width), F.floor((at + after) / width))
    own = {c: n for c, n in zip(on, _own(*(f"on{i}" for i in range(len(on)))), strict=True)}
    asked = left.filter(F.col(time).isNotNull()).select(*left.columns, (F.col(time) - F.expr(f"INTERVAL '{before}' SECOND")).alias(low), (F.col(time) + F.expr(f"INTERVAL '{after}' SECOND")).alias(high), F.explode(bins).alias(bin_))
    found = right.filter(F.col(time).isNotNull()).select(F.struct(*right.columns).alias(other), F.col(time).alias(t), *(F.col(c).alias(n) for c, n in own.items()), F.floor(at / width).alias(f"{bin_}r"))
    condition = F.col(bin_) == F.col(f"{bin_}r")
    for c, n in own.items():
        condition &= F.col(c) == F.col(n)
    return asked.join(found, condition & F.col(t).between(F.col(low), F.col(high))).select(*left.columns, F.col(other).alias(out))
