"""Streams that stop and go on from their checkpoint against the same rows as one batch."""

from __future__ import annotations

import datetime
import hashlib

import pytest
from pyspark.sql import functions as F

from contaflux.streaming import joins, state

T0 = datetime.datetime(2024, 5, 1, 12)
HOURS = lambda h: T0 + datetime.timedelta(hours=h)
EVENTS = "key string, id long, ts timestamp, use boolean"


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def events(spark, rows):
    return spark.createDataFrame([(k, i, HOURS(h) if h is not None else None, use) for k, i, h, use in rows], EVENTS)


def test_counter_and_chain_go_on_after_a_restart(spark):
    data = events(spark, [(k, i, i, False) for i in range(14) for k in ("a", "b" if i % 4 == 0 else "a", None if i % 5 == 0 else "c")])
    data = data.withColumn("id", F.xxhash64("key", "id", F.rand(3)))
    data.write.mode("overwrite").parquet(path := f"{state.shared_folder(spark, 'test')}/rows")
    data = spark.read.parquet(path)
    for threshold in (1, 3):
        stream = state.advanced(data, 3, "ts", lambda r, t=threshold: state.flagged(r, "key", t, ["ts", "id"]))
        assert rows_of(stream, "key", "ts", "id") == rows_of(state.flagged(data, "key", threshold, ["ts", "id"]), "key", "ts", "id")
    log = data.where("key IS NOT NULL").withColumn("payload", F.when(F.col("id") % 3 != 0, F.concat("key", F.col("id").cast("string"))))
    columns = ("key", "id", "n", "previous", "hash")
    got = rows_of(state.advanced(log, 2, "ts", lambda r: state.chained(r, "key", ["ts", "id"])), *columns)
    assert got == rows_of(state.chained(log, "key", ["ts", "id"]), *columns)
    last = {}
    for r in sorted(log.collect(), key=lambda r: (r["key"], r["ts"], r["id"])):
        last[r["key"]] = hashlib.sha256((last.get(r["key"], "") + (r["payload"] or "")).encode()).hexdigest()
    assert {k: max((c for c in got if c[0] == k), key=lambda c: c[2])[4] for k in last} == last


TOKENS = [
    ("once", 1, 0, False), ("once", 2, 1, True),
    ("twice", 3, 0, False), ("twice", 4, 1, True), ("twice", 5, 1.5, True),
    ("late", 6, 0, False), ("late", 7, 5, True),
    ("never", 8, 0, False),
    ("edge", 9, 0, False), ("edge", 10, 3, True),
    ("again", 11, 0, False), ("again", 12, 2, False), ("again", 13, 4, True),
    ("stale", 14, 0, False), ("stale", 15, 9, False),
    ("unknown", 16, 4, True), ("open", 17, 29.9, False), (None, 18, 0, False), ("timeless", 19, None, False),
    ("clock", 20, 30, True),
]


def test_keys_are_good_for_one_use_and_a_time(spark):
    data = events(spark, TOKENS)
    want = {("once", 1, 2, "used"), ("twice", 3, 4, "used"), ("twice", None, 5, "refused"), ("late", 6, None, "unused"), ("late", None, 7, "refused"), ("never", 8, None, "unused"), ("edge", 9, 10, "used"),
            ("again", 11, None, "replaced"), ("again", 12, 13, "used"), ("stale", 14, None, "unused"), ("stale", 15, None, "unused"), ("unknown", None, 16, "refused"), (None, 18, None, "unused"), ("clock", None, 20, "refused")}
    columns = ("key", "grant_id", "use_id", "outcome")
    use = lambda r: state.once_used(r, datetime.timedelta(hours=3))
    assert set(rows_of(use(data), *columns)) == want
    assert set(rows_of(state.advanced(data.where("ts IS NOT NULL"), 3, "ts", use), *columns)) == want


def test_a_replayed_batch_writes_nothing_new(spark):
    path = state.shared_folder(spark, "sink")
    write = state.into_once(path, ["k"])
    batch = lambda *rows: spark.createDataFrame(rows, "k string, v int")
    write(batch(("a", 1), ("b", 1), (None, 1)), 0)
    write(batch(("b", 2), ("c", 2), (None, 2), ("c", 2)), 1)
    want = [("a", 1), ("b", 1), ("c", 2), (None, 1)]
    read = lambda: rows_of(spark.read.schema("k string, v int").parquet(path), "k", "v")
    assert read() == sorted(want, key=repr)
    write(batch(("b", 2), ("c", 2), (None, 2), ("c", 2)), 1)  # the same batch after a failure
    write(batch(("a", 1), ("b", 1), (None, 1)), 0)
    assert read() == sorted(want, key=repr)
    write(batch(("a", 9)), 2)
    assert read() == sorted(want, key=repr)


def test_ingest_ends_and_goes_on(spark):
    data = events(spark, [("a", i % 4, i, False) for i in range(12)])
    assert rows_of(state.ingested(data, 3, "ts", ["id"]), "id") == [(0,), (1,), (2,), (3,)]


@pytest.mark.parametrize("outer", [False, True])
def test_streams_joined_in_an_interval(spark, outer):
    left = spark.createDataFrame([(i, i % 3 if i % 7 else None, HOURS(i * 0.5)) for i in range(24)], "id long, k long, ts timestamp")
    right = spark.createDataFrame([(100 + i, i % 3, HOURS(i * 0.5 + 0.25)) for i in range(30)] + [(200, 1, HOURS(60)), (201, 1, HOURS(61))], "id long, k long, ts timestamp")
    both = left.withColumn("side", F.lit("l")).unionByName(right.withColumn("side", F.lit("r")))
    side = lambda r, s: r.where(F.col("side") == s).drop("side")
    join = lambda r: joins.interval_join(side(r, "l"), side(r, "r"), "k", "2 hours", outer=outer)
    tick = spark.createDataFrame([(300, 9, HOURS(62), "l"), (301, 9, HOURS(62), "r")], "id long, k long, ts timestamp, side string")  # moves both watermarks on
    stream = rows_of(state.advanced(both.unionByName(tick), 3, "ts", join).where("k IS NULL OR k <> 9"), "k", "left_id", "right_id", "left_ts", "right_ts")
    assert stream == rows_of(join(both), "k", "left_id", "right_id", "left_ts", "right_ts") and len(stream) > 20


def test_late_rows_go_aside_and_replays_change_nothing(spark):
    part = lambda *hours: events(spark, [("k", int(h * 10) if h is not None else -1, h, False) for h in hours])
    main, late = joins.late_of([part(0, 5, None), part(3, 4.5, 9), part(4, 8.5, 12)], "1 hour")
    assert rows_of(main, "id", "batch") == sorted([(0, 0), (50, 0), (45, 1), (90, 1), (85, 2), (120, 2)], key=repr)
    assert rows_of(late, "id", "batch") == sorted([(-1, 0), (30, 1), (40, 2)], key=repr)
    path = state.shared_folder(spark, "apart")
    write = joins.apart(path, "1 hour")
    for number, hours in ((0, (0, 5)), (1, (3, 9)), (0, (0, 5)), (1, (3, 9))):
        write(part(*hours), number)
    assert rows_of(spark.read.parquet(f"{path}/late"), "id") == [(30,)] and spark.read.parquet(f"{path}/main").count() == 3
