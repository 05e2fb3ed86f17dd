"""Queries of the state tables and of their streams."""

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import state
from ..sources import testviews as T
from ..streaming import state_streams
from .core import query, view

NOW = "2024-01-31 00:00:00"
SIX_HOURS = 6 * 3600 * 1000


@query("l1_build_key", """
SELECT event_id, substr(sha1('2.2|{"event_type":"' || event_type || '","props":"' || replace(props, '"', '\\"') || '","user_id":' || user_id || ',"value":"' || CAST(value AS VARCHAR) || '"}'), 1, 12) AS build_key FROM events""")
def _(spark, folder):
    df = T.table(spark, folder, "events").withColumn("make_pdf", F.col("event_id") % 2 == 0)
    df = df.withColumn("value", F.col("value").cast("string"))
    return state.build_key(df, ["user_id", "make_pdf", "event_type", "props", "value"]).select("event_id", "build_key")


STATES = """CASE event_id % 3 WHEN 0 THEN concat('{"user": ', user_id, ', "page": {"kind": "', event_type, '", "at": "', ts, '", "props": ', props, '}, "list": [', value, ', null, "x"], "make_pdf": true}')
  WHEN 1 THEN concat('{ "list":[', value, ',null , "x"],"make_pdf":false, "page":{"props":', props, ',"kind":"', event_type, '","at":"', ts, '"},"user":', user_id, '.0}')
  ELSE concat('{"page": {"at": "', ts, '", "kind": "', event_type, '", "props": ', props, '}, "user": ', user_id, ', "list": [', value, ', null, "x"]}') END"""


@query("l1_state_key", """
SELECT event_id, substr(sha1('2.2|{"list":[' || regexp_replace(regexp_replace(CAST(value AS VARCHAR), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') || ',null,"x"],"page":{"at":"' || ts || '","kind":"' || event_type || '","props":' || replace(props, ' ', '') || '},"user":' || user_id || '}'), 1, 12) AS build_key FROM events""")
def _(spark, folder):
    """Whole nested states, each spelled in one of three orders of its keys."""
    df = T.table(spark, folder, "events").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).withColumn("ts", F.regexp_replace("ts", r"\.?0+$", ""))
    return state.state_key(df.withColumn("state", F.expr(STATES)), "state").select("event_id", "build_key")


@query("l2_reuse_build", """
SELECT sid, seq, build_key, CASE WHEN row_number() OVER (PARTITION BY sid, build_key ORDER BY saved_at, seq) = 1 THEN 'build' ELSE 'hit' END AS status FROM state_events""")
def _(spark, folder):
    return state.reuse_build(T.state_events(spark, folder)).select("sid", "seq", "build_key", "status")


@query("l3_keep_last_builds", """
SELECT sid, build_key, seq, rank FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY last_used DESC, seq DESC) AS rank FROM (
SELECT sid, build_key, max(saved_at) AS last_used, arg_max(seq, (saved_at, seq)) AS seq FROM state_events GROUP BY ALL) a) b WHERE rank <= 6""")
def _(spark, folder):
    return state.keep_last_builds(T.state_events(spark, folder)).select("sid", "build_key", "seq", "rank")


@query("l4_expire_sessions", f"""
SELECT sid, epoch_us(max(saved_at)) AS last_us FROM state_events GROUP BY sid HAVING epoch_us(TIMESTAMP '{NOW}') - epoch_us(max(saved_at)) > 86400000000""")
def _(spark, folder):
    return state.expire_sessions(T.state_events(spark, folder), NOW, days=1).select("sid", F.unix_micros("last_saved").alias("last_us"))


@query("l5_latest_state", """
SELECT sid, seq, payload, row_number() OVER (ORDER BY saved_at DESC, seq DESC, sid DESC) = 1 AS newest FROM (
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY saved_at DESC, seq DESC) AS rn FROM state_events) a WHERE rn = 1) b""")
def _(spark, folder):
    return state.latest_state(T.state_events(spark, folder)).select("sid", "seq", "payload", "newest")


view("burst_rows", """
SELECT *, sum(CASE WHEN us - before <= 21600000000 THEN 0 ELSE 1 END) OVER (PARTITION BY sid ORDER BY saved_at, seq) AS burst FROM (
SELECT *, epoch_us(saved_at) AS us, lag(epoch_us(saved_at)) OVER (PARTITION BY sid ORDER BY saved_at, seq) AS before FROM state_events) a""")


@query("l6_debounce", """
SELECT sid, CAST(burst AS BIGINT) AS burst, started_us, ended_us, changes, payload, build_key, build_key IS DISTINCT FROM lag(build_key) OVER (PARTITION BY sid ORDER BY burst) AS starts_build FROM (
SELECT sid, burst, min(us) AS started_us, max(us) AS ended_us, count(*) AS changes, arg_max(payload, (us, seq)) AS payload, arg_max(build_key, (us, seq)) AS build_key FROM burst_rows GROUP BY sid, burst) a""")
def _(spark, folder):
    df = state.debounce(T.state_events(spark, folder), SIX_HOURS, slice_unit="day")
    return df.select("sid", "burst", F.unix_micros("started").alias("started_us"), F.unix_micros("ended").alias("ended_us"), "changes", "payload", "build_key", "starts_build")


@query("l7_mru_history", """
SELECT hist_key, entry, last_seq, rank FROM (SELECT *, row_number() OVER (PARTITION BY hist_key ORDER BY last_seq DESC, entry) AS rank FROM (
SELECT hist_key, trim(entry) AS entry, max(seq) AS last_seq FROM history WHERE trim(entry) <> '' AND NOT regexp_matches(entry, '\\[.*\\]') GROUP BY ALL) a) b WHERE rank <= 40""")
def _(spark, folder):
    return state.mru_history(T.history(spark, folder))


# The streams get the events in three arrivals by time; one row in 97 comes an arrival late and is dropped if it is behind the watermark by then.
ARRIVALS = 3
HOUR_US = 3_600_000_000
LIFE_US, GAP_US = 24 * HOUR_US, 6 * HOUR_US


def arrivals(spark, folder):
    events = T.state_events(spark, folder)
    low, high = events.agg(F.min(F.unix_micros("saved_at")), F.max(F.unix_micros("saved_at"))).first()
    third = F.expr(f"(unix_micros(saved_at) - {low}) * {ARRIVALS} div {high - low + 1}")
    nth = F.least(F.lit(ARRIVALS - 1), third + F.when(F.col("seq") % 97 == 0, 1).otherwise(0))
    return [events.filter(nth == k) for k in range(ARRIVALS)]


view("arriving", f"""
SELECT *, epoch_us(saved_at) AS us, least({ARRIVALS - 1}, (epoch_us(saved_at) - lo) * {ARRIVALS} // (hi - lo + 1) + CASE WHEN seq % 97 = 0 THEN 1 ELSE 0 END) AS arrival
FROM state_events, (SELECT min(epoch_us(saved_at)) AS lo, max(epoch_us(saved_at)) AS hi FROM state_events) x""")
view("watermarks", f"""
SELECT k AS arrival, (SELECT max(us) // 1000 * 1000 FROM arriving WHERE arrival < k) - {HOUR_US} AS mark FROM range(0, {ARRIVALS + 1}) g(k)""")
view("in_time", """
SELECT a.*, row_number() OVER (PARTITION BY sid ORDER BY a.arrival, us, seq) AS nth FROM arriving a JOIN watermarks w ON w.arrival = a.arrival WHERE w.mark IS NULL OR a.us > w.mark""")
view("lives", f"""
SELECT *, sum(CASE WHEN us - newest <= {LIFE_US} THEN 0 ELSE 1 END) OVER (PARTITION BY sid ORDER BY nth) AS life FROM (
SELECT *, max(us) OVER (PARTITION BY sid ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM in_time) a""")


@query("l2_reuse_build_stream", f"""
SELECT u.sid, u.seq, u.build_key, CASE WHEN used IS NOT NULL AND (SELECT count(DISTINCT o.build_key) FROM lives o WHERE o.sid = u.sid AND o.nth > u.used AND o.nth < u.nth) < {fixed.BUILDS_KEPT} THEN 'hit' ELSE 'build' END AS status
FROM (SELECT *, lag(nth) OVER (PARTITION BY sid, life, build_key ORDER BY nth) AS used FROM lives) u""")
def _(spark, folder):
    """A session knows its last builds for as long as it lives: by arrival, not by hindsight."""
    return state_streams.replay(spark, arrivals(spark, folder), lambda s: state_streams.reuse_build(s, LIFE_US)).drop("batch")


@query("l5_latest_state_stream", f"""
SELECT sid, us, seq, payload, us + {LIFE_US} <= (SELECT mark FROM watermarks WHERE arrival = {ARRIVALS}) AS expired FROM (
SELECT *, row_number() OVER (PARTITION BY sid ORDER BY us DESC, seq DESC) AS rn FROM in_time) a WHERE rn = 1""")
def _(spark, folder):
    updates = state_streams.replay(spark, arrivals(spark, folder), lambda s: state_streams.latest_state(s, LIFE_US), "update")
    last = F.max(F.struct("us", "seq", "expired", "payload")).alias("s")
    return updates.groupBy("sid").agg(last).select("sid", "s.us", "s.seq", "s.payload", "s.expired")


@query("l6_debounce_stream", f"""
SELECT sid, started_us, ended_us, changes, payload, build_key, (lag(build_key) OVER w IS DISTINCT FROM build_key OR started_us - lag(ended_us) OVER w > {LIFE_US}) AS starts_build FROM (
SELECT sid, min(us) AS started_us, max(us) AS ended_us, count(*) AS changes, arg_max(payload, (us, seq)) AS payload, arg_max(build_key, (us, seq)) AS build_key FROM (
SELECT *, sum(CASE WHEN us - earlier <= {GAP_US} THEN 0 ELSE 1 END) OVER (PARTITION BY sid ORDER BY us, seq) AS burst FROM (
SELECT *, lag(us) OVER (PARTITION BY sid ORDER BY us, seq) AS earlier FROM in_time) a) b GROUP BY sid, burst) c WINDOW w AS (PARTITION BY sid ORDER BY started_us)""")
def _(spark, folder):
    """All bursts: an end marker behind the last arrival closes those that are open."""
    parts = arrivals(spark, folder)
    parts.append(state_streams.end_marker(T.state_events(spark, folder)))
    return state_streams.replay(spark, parts, lambda s: state_streams.bursts(s, GAP_US, LIFE_US)).drop("batch")
