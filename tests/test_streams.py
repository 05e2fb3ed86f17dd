"""Streams over several arrivals with restarts in between: lives, eviction, late rows, bridged and last bursts."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from resultloom.operators import state
from resultloom.sources import testviews as T
from resultloom.streaming import processors, state_streams as S

SCHEMA = "sid long, seq long, saved_at timestamp, payload string, build_key string"
START = dt.datetime(2024, 1, 1)
HOUR = 3_600_000_000


def events(spark, rows):
    """rows: (sid, seq, hours after the start, key)"""
    return spark.createDataFrame([(s, q, START + dt.timedelta(hours=h), f"p{q}", k) for s, q, h, k in rows], SCHEMA)


def test_builds_by_life_and_by_the_last_keys(spark):
    # 8 is late but within the hour, 12 is not; a and c push b out; session 1 has rested for more than a day before 10
    parts = [[(1, 1, 0, "a"), (1, 2, 0.5, "b"), (1, 3, 1, "a"), (2, 4, 0, "a")],
             [(1, 5, 2, "c"), (1, 6, 3, "b"), (2, 7, 20, "x"), (1, 8, 0.9, "late"), (2, 9, 0.2, "a")],
             [(1, 10, 29, "b"), (2, 11, 30, "x"), (1, 12, 5, "gone"), (None, 13, 31, "z")]]
    got = {r["seq"]: r["status"] for r in S.replay(spark, [events(spark, p) for p in parts], lambda s: S.reuse_build(s, 24 * HOUR, kept=2)).collect()}
    assert got == {1: "build", 2: "build", 3: "hit", 4: "build", 8: "build", 5: "build", 6: "build", 9: "hit", 7: "build", 10: "build", 11: "hit"}


def test_a_session_is_forgotten(spark):
    parts = [[(1, 1, 0, "a"), (2, 2, 1, "b")], [(2, 3, 30, "c")], [(2, 4, 40, "d"), (1, 5, 39.5, "e")], [(2, 6, 39.6, "old")]]
    out = S.replay(spark, [events(spark, p) for p in parts], lambda s: S.latest_state(s, 24 * HOUR), "update")
    got = sorted((r["sid"], r["seq"], r["expired"]) for r in out.collect())
    assert got == [(1, 1, False), (1, 1, True), (1, 5, False), (2, 2, False), (2, 2, True), (2, 3, False), (2, 4, False)]


def test_bursts_are_bridged_and_the_last_one_closes(spark):
    parts = [[(1, 1, 0, "a"), (1, 2, 0.8, "b"), (2, 3, 0, "x")],
             [(1, 4, 0.4, "c"), (2, 5, 1, "x")],                    # 4 joins 1 and 2; 5 begins a burst that starts no build
             [(1, 6, 90, "b"), (1, 7, 90.3, "b")]]                  # the key is the same, but the life of what was built is over
    parts = [events(spark, p) for p in parts]
    marker = S.end_marker(parts[-1])
    out = S.replay(spark, [*parts, marker], lambda s: S.bursts(s, int(0.5 * HOUR), 48 * HOUR))
    got = sorted((r["sid"], r["changes"], r["payload"], r["build_key"], r["starts_build"]) for r in out.collect())
    assert got == [(1, 2, "p7", "b", True), (1, 3, "p2", "b", True), (2, 1, "p3", "x", True), (2, 1, "p5", "x", False)]


def test_bursts_in_order_equal_the_batch(spark, folder):
    """One session holds a third of all rows."""
    rows = T.state_events(spark, folder).withColumn("sid", F.when(F.col("seq") % 3 == 0, F.lit(0).cast("long")).otherwise(F.col("sid")))
    middle = F.lit("2024-01-15").cast("timestamp")
    parts = [rows.filter(F.col("saved_at") < middle), rows.filter(F.col("saved_at") >= middle), S.end_marker(rows)]
    stream = S.replay(spark, parts, lambda s: S.bursts(s, 6 * HOUR))
    want = state.debounce(rows, 6 * 3600 * 1000, slice_unit="day")
    cols = ["sid", "changes", "payload", "build_key", "starts_build"]
    assert sorted(map(tuple, stream.select("started_us", *cols).collect())) == sorted(map(tuple, want.select(F.unix_micros("started"), *cols).collect()))


class _State:
    """A list or value state, and the handle that gives it, in memory."""

    def __init__(self):
        self.held, self.timers, self.states = None, [], {}

    def getListState(self, name, schema):
        return self.states.setdefault(name, _State())

    getValueState = getListState

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def put(self, value):
        self.held = value

    update = put

    def clear(self):
        self.held = None

    def registerTimer(self, ms):
        self.timers.append(ms)


class _Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_a_session_sets_one_timer_however_many_bursts_are_open():
    handle, bursts = _State(), processors.Bursts(10 ** 12, 1_000_000)
    bursts.init(handle)
    times = [(k * 37 % 101) * 3_000_000 + k % 2 * 400_000 for k in range(100)]      # 100 bursts, in no order
    for part in (times[:50], times[50:], [t + 700_000 for t in times[::10]]):         # the last rows join bursts that are open
        before = len(handle.timers)
        list(bursts.handleInputRows((1,), iter([pd.DataFrame([(t, n, f"p{t}", f"k{t}") for n, t in enumerate(part)], columns=["us", "seq", "payload", "build_key"])]), None))
        assert len(handle.timers) == before + 1
    got, due = [], 0
    while handle.states["open"].exists():     # a timer that closes bursts sets the next; one that was set too early closes nothing
        due = min(t for t in handle.timers if t > due)
        for out in bursts.handleExpiredTimer((1,), _Watermark(due), None):
            got += [tuple(r) for r in out.itertuples(index=False)]
    joined = set(times[::10])
    assert [(r[1], r[2], r[3]) for r in got] == [(t, t + 700_000, 2) if t in joined else (t, t, 1) for t in sorted(times)]
