"""Sessions in batch and stream, as-of and interval joins, cubes, sketches and the store of keys."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import times
from corpusloom.operators import events, keystore, rollups
from corpusloom.runtime import configured
from corpusloom.streaming.sessions import stream_sessions

START = dt.datetime(2024, 3, 30, 20, 0, 0)
SCHEMA = "event_id long, user_id long, ts timestamp_ntz, v long"


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def drawn(n, users, span, seed, step=1):
    """Events of which user 0 has a third, with ties, nulls and repeated rows."""
    r = random.Random(seed)
    rows = [(k, 0 if r.random() < 0.33 else r.randrange(users), at(step * r.randrange(span)), r.randrange(9)) for k in range(n)]
    return [*rows, *rows[:5], (n, None, at(3), 1), (n + 1, 1, None, 1)]


def plain_sessions(rows, gap):
    out = {}
    for user in {r[1] for r in rows} - {None}:
        mine = sorted((r[2], r[3]) for r in rows if r[1] == user and r[2] is not None)
        last = None
        for t, v in mine:
            if last is None or t > last + gap:
                start = t
                out[user, start] = [t, 0, 0]
            last = t
            x = out[user, start]
            x[0], x[1], x[2] = t, x[1] + 1, x[2] + v
    return sorted((*k, *x) for k, x in out.items())


@pytest.mark.parametrize("gap,hours", [(30, 24), (30, 1), (180, 1), (7, 3)])
def test_sessions(spark, gap, hours):
    rows = drawn(300, 6, 6000, gap)
    frame = spark.createDataFrame(rows, SCHEMA)
    got = events.sessions(frame, "user_id", "ts", f"{gap} minutes", ["v"], hours).select("user_id", "start", "last", "events", "v")
    assert sorted(tuple(r) for r in got.collect()) == plain_sessions(rows, dt.timedelta(minutes=gap))


def test_sessions_over_many_slices_and_at_the_gap(spark):
    rows = [(k, 1, at(45 * k), 1) for k in range(200)] + [(k, 2, at(60 * k), 1) for k in range(5)] + [(k, 3, at(61 * k), 1) for k in range(5)]
    got = events.sessions(spark.createDataFrame(rows, SCHEMA), "user_id", "ts", "60 minutes", hours=1)
    assert sorted((r.user_id, r.start, r.events) for r in got.collect()) == [(1, START, 200), (2, START, 5), *((3, at(61 * k), 1) for k in range(5))]
    assert events.sessions(spark.createDataFrame([], SCHEMA), "user_id", "ts", "1 hour").collect() == []


def test_stream_gives_the_sessions_of_the_batch(spark, tmp_path):
    gap = dt.timedelta(minutes=30)
    rows = [r for r in drawn(120, 5, 4000, 5) if r[1] is not None and r[2] is not None]
    rows.append((500, 9, rows[0][2], 1))
    rows += [(501, 9, rows[-1][2] + gap, 1)]
    # within a day's lateness in any order; a later event lets the watermark pass all sessions
    ordered = sorted(rows, key=lambda r: r[2])
    batches = [ordered[k : k + 45][::-1] for k in range(0, len(rows), 45)]
    batches.append([(900, 99, at(100000), 1)])
    batches.append([(901, 1, at(10), 1), (902, 99, at(100001), 1)])
    for k, b in enumerate(batches):
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{k:02}"))
        query = stream_sessions(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in/*")), "user_id", "ts", "30 minutes", "1 day", "event_id").writeStream
        query = query.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
    got = sorted((r.user_id, r.last, r.events) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    once = {r[0]: r for r in rows}.values()
    # event 901 came late and is in none; user 99's session isn't over
    assert got == [(u, last, n) for u, _, last, n, _ in sorted(plain_sessions(list(once), gap), key=lambda x: (x[0], x[2]))]


@pytest.mark.parametrize("hours", [1, 24])
def test_as_of(spark, hours):
    left, right = drawn(200, 6, 900, 1, 5), drawn(90, 6, 900, 2, 5)
    got = events.as_of(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), "user_id", "ts", "m", ["event_id"], hours)
    assert got.columns == ["event_id", "user_id", "ts", "v", "m"]
    key = lambda r: repr(tuple(r))

    def match(x):
        found = [y for y in right if None not in (x[1], x[2], y[2]) and y[1] == x[1] and y[2] <= x[2]]
        return max(found, key=lambda y: (y[2], y[0]))[0] if found else None

    expected = sorted(((*x, match(x)) for x in left), key=key)
    assert sorted(((*r[:4], r.m and r.m.event_id) for r in got.collect()), key=key) == expected
    none = events.as_of(spark.createDataFrame(left, SCHEMA), spark.createDataFrame([], SCHEMA), "user_id", "ts", "m", ["event_id"])
    assert none.filter("m is null").count() == len(left)


def test_interval_join(spark):
    left, right = drawn(150, 6, 9000, 3), drawn(150, 6, 9000, 4)
    frames = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
    for before, after, on in ((600, 1800, ["user_id"]), (0, 0, ["user_id"]), (60, 0, [])):
        found = events.within(*frames, "ts", before, after, on)
        low, high = dt.timedelta(seconds=before), dt.timedelta(seconds=after)
        expected = [(x[0], y[0]) for x in left for y in right if x[2] and y[2] and x[2] - low <= y[2] <= x[2] + high and (not on or (x[1] is not None and x[1] == y[1]))]
        assert sorted((r.event_id, r.other.event_id) for r in found.collect()) == sorted(expected)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_times_are_of_the_clock(spark):
    rows = spark.createDataFrame([(dt.datetime(2024, 3, 31, 2, 30, 1, 123456),), (dt.datetime(1969, 12, 31, 23, 59, 59, 999999),), (None,)], "t timestamp_ntz")
    for zone in ("UTC", "Europe/Berlin"):
        with configured(spark, {"spark.sql.session.timeZone": zone}):
            got = [tuple(r) for r in rows.select(times.micros(F.col("t")), times.slices(F.col("t"), 24)).collect()]
        assert got == [(1711852201123456, 19813), (-1, -1), (None, None)]


def test_cube(spark):
    rows = [("a", "x", 1), ("a", None, 2), ("b", "x", 4), ("b", "x", 8), (None, None, None)]
    got = rollups.cube(spark.createDataFrame(rows, "p string, q string, v long"), ["p", "q"], ["v"])
    expected = set()
    for level in range(4):
        cut = lambda r: (None if level & 2 else r[0], None if level & 1 else r[1])  # noqa: B023, E731
        for k in {cut(r) for r in rows}:
            mine = [r[2] for r in rows if cut(r) == k]
            known = [v for v in mine if v is not None]
            expected.add((*k, level, len(mine), sum(known) if known else None))
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(expected) and set(found) == expected


def test_merged_sketches(spark):
    rows = spark.range(40000).select(F.col("id").alias("k"), (F.col("id") % 9000).alias("part"), F.col("id").cast("double").alias("price"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(id % 600 as int))").alias("t"))
    days = rollups.day_sketches(rows, "t", "part", "price")
    assert days.count() == 600
    for r in rollups.merged(days, F.year("day"), "year").collect():
        exact = rows.filter(F.year("t") == r.year)
        assert r.n == exact.count()
        parts = exact.select("part").distinct().count()
        assert abs(r.distinct - parts) <= 0.04 * parts
        assert abs(exact.filter(F.col("price") <= r.quantile).count() / r.n - 0.5) <= 0.03


def test_key_store_gives_the_answer_of_one_pass(spark, tmp_path):
    r = random.Random(7)
    rows = [(k, None if r.random() < 0.05 else "" if r.random() < 0.05 else "hot" if r.random() < 0.3 else f"k{r.randrange(120)}") for k in range(500)]
    firsts = {}
    for k, key in rows:
        if key:
            firsts.setdefault(key, k)
    got, folder = {}, str(tmp_path / "store")
    for b in range(7):
        part = spark.createDataFrame([x for x in rows if x[0] * 7 // 500 == b], "id long, name string")
        # another job each time
        store = keystore.KeyStore(spark, folder, buckets=4, fan=2)
        with configured(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
            if b == 6:
                with store._dealt():
                    new = store.new(part, F.col("name"), F.col("id"))
                    plan = new._jdf.queryExecution().executedPlan().toString()
                assert plan.count("Exchange") == 1 and plan.count("LeftAnti") == len(store.runs) == 2
            found = {x.name: x.id for x in store.admit(str(b), part, F.col("name"), F.col("id")).collect()}
        assert not set(found) & set(got)
        got |= found
        again = keystore.KeyStore(spark, folder, fan=2).admit(str(b), part, F.col("name"), F.col("id"))
        assert {x.name: x.id for x in again.collect()} == found
    assert got == firsts
    none = spark.createDataFrame([], "id long, name string")
    assert keystore.KeyStore(spark, folder, fan=2).admit("none", none, F.col("name"), F.col("id")).count() == 0


def test_interval_join_makes_bounds_once_a_row(spark):
    rows = spark.sql("SELECT id, TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, id, 0) AS ts FROM range(300)")
    found = events.within(rows, rows, "ts", 1200, 2400)
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert joins and all("INTERVAL" not in x for x in joins)
    assert sorted((r.id, r.other.id) for r in found.collect()) == [(a, b) for a in range(300) for b in range(300) if a - 20 <= b <= a + 40]
