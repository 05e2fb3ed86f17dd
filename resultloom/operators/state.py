"""State of the page as batch tables: build keys, reuse, retention, latest state, bursts, suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import exprs as X, fixed
from ..plans import skew


def build_key(states: DataFrame, fields: list[str], version: str = fixed.VERSION, leave_out=("make_pdf",)) -> DataFrame:
    """Key of a page state: first 12 hex digits over version and the JSON of its fields in sorted order."""
    body = F.to_json(F.struct(*[F.col(f) for f in sorted(fields) if f not in leave_out]))
    return states.withColumn("build_key", F.left(F.sha1(F.concat(F.lit(version + "|"), body)), F.lit(12)))


def canonical_json(text, leave_out=()):
    """One text for all spellings of a JSON document: keys sorted at every level, no blanks, numbers without trailing zeros, list order kept; null if it is
    no document. ``leave_out`` names top-level keys that don't count. Of a key that is given twice nothing is kept: such a document is none."""
    document = F.try_parse_json(X.col(text))
    fields = F.try_variant_get(document, "$", "map<string, variant>")
    names = F.array_sort(F.filter(F.map_keys(fields), lambda k: ~k.isin(*leave_out) if leave_out else F.lit(True)))
    body = F.transform(names, lambda k: F.concat(F.regexp_extract(F.to_json(F.array(k)), r"^\[(.*)\]$", 1), F.lit(":"), F.to_json(fields[k])))
    return F.when(fields.isNotNull(), F.concat(F.lit("{"), F.array_join(body, ","), F.lit("}"))).otherwise(F.to_json(document))


def state_key(states: DataFrame, column: str, version: str = fixed.VERSION, leave_out=("make_pdf",)) -> DataFrame:
    """Key of a whole page state, a nested JSON document: equal for any order of its keys, another one for any changed value."""
    return states.withColumn("build_key", F.left(F.sha1(F.concat(F.lit(version + "|"), canonical_json(column, leave_out))), F.lit(12)))


def reuse_build(events: DataFrame, hot_rows: int | None = skew.HOT_ROWS) -> DataFrame:
    """First time a session shows a key is a build, later times are hits. Keys removed by ``keep_last_builds`` count as known."""
    df = skew.attach(events, ["sid", "build_key"], hot_rows, __first=F.min(F.struct("saved_at", "seq")))
    fresh = (F.col("saved_at") == F.col("__first.saved_at")) & (F.col("seq") == F.col("__first.seq"))
    return df.withColumn("status", F.when(fresh, F.lit("build")).otherwise(F.lit("hit"))).drop("__first")


def keep_last_builds(events: DataFrame, n: int = fixed.BUILDS_KEPT) -> DataFrame:
    """The current key of a session and the most recently used others, n in all."""
    used = events.groupBy("sid", "build_key").agg(F.max(F.struct("saved_at", "seq")).alias("u"))
    used = used.select("sid", "build_key", F.col("u.saved_at").alias("last_used"), F.col("u.seq").alias("seq"))
    return skew.top_k(used, ["sid"], [F.desc("last_used"), F.desc("seq")], n).withColumn("rank", F.col("rank").cast("long"))


def expire_sessions(events: DataFrame, now, days: int = fixed.SESSION_DAYS) -> DataFrame:
    """Sessions whose last change is more than ``days`` before ``now``."""
    now = F.lit(now).cast("timestamp") if isinstance(now, str) else now
    last = events.groupBy("sid").agg(F.max("saved_at").alias("last_saved"))
    return last.filter(F.unix_micros(now) - F.unix_micros("last_saved") > F.lit(days * 86_400_000_000))


def latest_state(events: DataFrame) -> DataFrame:
    """Last snapshot of every session; the newest session of all is marked."""
    latest = events.groupBy("sid").agg(F.max(F.struct("saved_at", "seq", "payload")).alias("s")).select("sid", "s.*")
    newest = latest.agg(F.max(F.struct("saved_at", "seq", "sid")).alias("m")).select(F.col("m.sid").alias("sid"), F.lit(True).alias("newest"))
    return latest.join(F.broadcast(newest), "sid", "left").withColumn("newest", F.coalesce("newest", F.lit(False)))


def debounce(events: DataFrame, gap_ms: int = 1400, slice_unit: str = "hour", hot_rows: int | None = skew.HOT_ROWS) -> DataFrame:
    """One row per burst of a session: a pause longer than the gap ends it, its last state counts.

    ``starts_build`` is false when that state equals the one the burst before ended with. Works in time slices, so one busy
    session is spread over many tasks.
    """
    slices = [F.date_trunc(slice_unit, "saved_at")]
    df = events.withColumn("__us", F.unix_micros("saved_at"))
    df = skew.settle(skew.previous(df, ["sid"], ["saved_at", "seq"], "__us", slices, "__before", hot_rows))
    opens = F.col("__before").isNull() | (F.col("__us") - F.col("__before") > gap_ms * 1000)
    df = skew.prefix_sum(df, ["sid"], ["saved_at", "seq"], opens.cast("long"), slices, "burst", hot_rows=hot_rows)
    df = df.groupBy("sid", "burst").agg(F.min("saved_at").alias("started"), F.max("saved_at").alias("ended"), F.count(F.lit(1)).alias("changes"),
                                        F.max(F.struct("saved_at", "seq", "payload", "build_key")).alias("s"))
    df = skew.settle(df.select("sid", "burst", "started", "ended", "changes", F.col("s.payload").alias("payload"), F.col("s.build_key").alias("build_key")))
    df = skew.previous(df, ["sid"], ["burst"], "build_key", [skew.slice_of("burst")], "__key", hot_rows)
    return df.withColumn("starts_build", ~F.col("build_key").eqNullSafe(F.col("__key"))).drop("__key")


def mru_history(entries: DataFrame, n: int = fixed.HISTORY_KEPT) -> DataFrame:
    """Distinct typed values of a key, newest first, without bracketed placeholders."""
    text = F.trim(F.coalesce("entry", F.lit("")))
    df = entries.select("hist_key", "seq", text.alias("entry")).filter((F.col("entry") != "") & ~F.col("entry").rlike(r"\[.*\]"))
    df = df.groupBy("hist_key", "entry").agg(F.max("seq").alias("last_seq"))
    return skew.top_k(df, ["hist_key"], [F.desc("last_seq"), "entry"], n).withColumn("rank", F.col("rank").cast("long"))
