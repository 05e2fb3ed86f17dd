"""Page state as streams. Rows that come later than ``delay`` behind the newest one are dropped."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import fixed
from ..plans.skew import scratch_folder
from . import processors

DAY = 86_400_000_000
LIFE = fixed.SESSION_DAYS * DAY
DELAY = "1 hour"
_STORE = "spark.sql.streaming.stateStore.providerClass"


def _per_session(events: DataFrame, processor, mode: str, delay: str, columns: list[str]) -> DataFrame:
    rows = events.withWatermark("saved_at", delay).select("sid", "saved_at", F.unix_micros("saved_at").alias("us"), "seq", *columns)
    return rows.groupBy("sid").transformWithStateInPandas(processor, processor.schema, mode, "EventTime")


def reuse_build(events: DataFrame, life_us: int = LIFE, kept: int = fixed.BUILDS_KEPT, delay: str = DELAY) -> DataFrame:
    """Every row as a build or a hit, in the order of arrival; a key that fell out of the last ``kept`` ones, or whose session was at rest for its life, is built again."""
    return _per_session(events, processors.Builds(life_us, kept), "append", delay, ["build_key"])


def latest_state(events: DataFrame, life_us: int = LIFE, delay: str = DELAY) -> DataFrame:
    """Last snapshot of every session as it changes, and its end (update mode)."""
    return _per_session(events, processors.Latest(life_us), "update", delay, ["payload"])


def bursts(events: DataFrame, gap_us: int = 1_400_000, life_us: int = LIFE, delay: str = DELAY) -> DataFrame:
    """One row per burst of a session, once it is over."""
    return _per_session(events, processors.Bursts(life_us, gap_us), "append", delay, ["payload", "build_key"])


def end_marker(events: DataFrame, after_us: int = LIFE + DAY) -> DataFrame:
    """A row without a session, ``after_us`` behind the newest row: the last file of a stream that ends. It moves the watermark, so all that is open is closed."""
    newest = events.agg(F.max("saved_at").alias("saved_at"))
    at = F.timestamp_micros(F.unix_micros("saved_at") + after_us)
    return newest.select(*[at.alias(c) if c == "saved_at" else F.lit(None).cast(t).alias(c) for c, t in events.dtypes])


def replay(spark: SparkSession, arrivals: list[DataFrame], build: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """The output of ``build`` over a stream of files that come one arrival after the other, with a restart from the checkpoint before each, and its ``batch``."""
    base = f"{scratch_folder(spark)}/resultloom-stream-{uuid.uuid4().hex}"
    before = spark.conf.get(_STORE, None)
    schema = None
    for part in arrivals:
        part.write.mode("append").parquet(f"{base}/in")
        stream = build(spark.readStream.schema(part.schema).parquet(f"{base}/in"))
        schema = stream.schema
        writer = stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).outputMode(mode)
        # a batch that is run again replaces its own rows
        writer = writer.foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{base}/out/batch={batch}"))
        spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")   # timers need it
        try:
            query = writer.start()
        finally:
            spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)
        query.awaitTermination()
    return spark.read.schema(schema.add("batch", "long")).parquet(f"{base}/out")
