"""Sources: picture folders, settings, sessions, report configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions import exprs as X, fixed
from ..plans import skew


def read_pictures(spark: SparkSession, path: str, hot_rows: int | None = skew.HOT_ROWS) -> DataFrame:
    """Files below a folder of job folders: job, order of arrival ``seq`` (from 1), name, first bytes, hash, length, ``readable``.

    Files arrive in the order of their time of change, then of their path. Contents are read once and leave their task as a hash and a few bytes; a file that
    is listed but can't be read (or went away in between) keeps its row without them. Nothing is decoded.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    parts = F.split("path", "/")
    listed = files.load(path).select("path", "modificationTime", "length", F.element_at(parts, -1).alias("name"), F.element_at(parts, -2).alias("job_id"))
    read = files.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(path)
    read = read.select("path", F.substring("content", 1, 12).alias("head"), F.md5("content").alias("hash"))
    df = listed.join(read, "path", "left").withColumn("readable", F.col("hash").isNotNull())
    df = skew.number_rows(df, ["job_id"], ["modificationTime", "path"], [F.date_trunc("hour", "modificationTime")], "seq", hot_rows=hot_rows)
    return df.select("job_id", "seq", "name", "path", "head", "hash", "length", "readable")


def _is_picture(name="name", head="head"):
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    head = F.hex(head)
    known = (head.startswith("89504E470D0A1A0A") | head.startswith("FFD8FF") | head.startswith("424D") | head.startswith("49492A00") | head.startswith("4D4D002A")
             | (head.startswith("52494646") & head.endswith("57454250")))
    return suffix.isin(*fixed.PICTURE_SUFFIXES) & known


def scan_pictures(files: DataFrame, hot_rows: int | None = skew.HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Files (job_id, seq, name and content, or its ``head`` and ``hash``) -> (pictures with dense ids from 0 per job, skipped files).

    A picture has a picture suffix and begins like one. ``seq`` is the order of arrival within the job.
    """
    if "content" in files.columns:
        files = files.withColumns({"head": F.substring("content", 1, 12), "hash": F.md5("content")})
    df = files.withColumn("__ok", F.coalesce(_is_picture(), F.lit(False)))
    good = df.filter("__ok").select("job_id", "seq", "name", "hash")
    good = skew.number_rows(good, ["job_id"], ["seq"], [skew.slice_of("seq")], "id", hot_rows=hot_rows).withColumn("id", F.col("id") - 1)
    return good, df.filter(~F.col("__ok")).select("job_id", "seq", "name")


def default_settings() -> list[tuple]:
    """Defaults as rows (key, subkey, value); subkey is empty for plain values."""
    rows = []
    for key, value in fixed.SETTINGS.items():
        rows += [(key, k, str(v)) for k, v in value.items()] if isinstance(value, dict) else [(key, "", str(value))]
    return rows


def overlay_config(sets: DataFrame, overrides: DataFrame, defaults: list[tuple] | None = None) -> DataFrame:
    """Defaults with the overrides of each settings set (set_id, key, subkey, value) put over them.

    Keys that begin with an underscore are ignored. A key with sub-keys on both sides is merged sub-key by sub-key; any
    other override replaces the whole key. The defaults are a short fixed list, so they ride along as an array.
    """
    rows = defaults or default_settings()
    over = skew.settle(overrides.filter(~F.col("key").startswith("_")).withColumn("subkey", F.coalesce("subkey", F.lit(""))))
    kinds = over.groupBy("set_id", "key").agg(F.min(F.col("subkey") != "").alias("__dict"))
    base = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("key", "subkey", "value"), r)]) for r in rows])
    df = sets.select("set_id").distinct().select("set_id", F.explode(base).alias("d")).select("set_id", "d.*")
    df = df.join(kinds, ["set_id", "key"], "left").join(over.select("set_id", "key", "subkey", F.lit(True).alias("__hit")), ["set_id", "key", "subkey"], "left")
    merged = F.col("__dict") & (F.col("subkey") != "")
    kept = df.filter(F.col("__dict").isNull() | (merged & F.col("__hit").isNull()))
    return kept.select("set_id", "key", "subkey", "value").unionByName(over.select("set_id", "key", "subkey", "value"))


def _kind(value) -> str:
    if isinstance(value, dict):
        return "STRUCT<" + ", ".join(f"{k}: {_kind(v)}" for k, v in value.items()) + ">"
    return "ARRAY<STRING>" if isinstance(value, (list, tuple)) else {bool: "BOOLEAN", float: "DOUBLE", int: "DOUBLE"}.get(type(value), "STRING")


def _overlaid(given, default):
    """The given value where there is one, else the default; sub-keys one by one, lists as a whole."""
    if isinstance(default, dict):
        return F.struct(*[_overlaid(given[k], v).alias(k) for k, v in default.items()])
    if isinstance(default, (list, tuple)):
        return F.coalesce(given, F.array(*map(F.lit, default)))
    return F.coalesce(given, F.lit(float(default) if isinstance(default, (int, float)) and not isinstance(default, bool) else default))


def job_settings(jobs: DataFrame, text: str = "settings_json", defaults: dict | None = None) -> DataFrame:
    """Adds ``settings``, all settings of a job as one typed struct: the defaults with the job's own JSON document put over them, and ``settings_ok``.

    A document that can't be read, or holds a value of another kind, leaves the defaults (``settings_ok`` is false); no document is fine. Keys that are no settings, like notes
    that begin with an underscore, are ignored.
    """
    defaults = defaults or fixed.SETTINGS | {"assumption_library": fixed.ASSUMPTIONS}
    schema = ", ".join(f"{k} {_kind(v)}" for k, v in defaults.items()) + ", _damaged STRING"
    df = jobs.withColumn("__s", F.from_json(text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_damaged"}))
    good = F.col("__s._damaged").isNull()
    own = F.when(good, F.col("__s"))
    return df.withColumn("settings", F.struct(*[_overlaid(own[k], v).alias(k) for k, v in defaults.items()])).withColumn("settings_ok", good).drop("__s")


PRIVATE = ("path", "_done", "hash")


def public_projection(pictures: DataFrame, sid="job_id") -> DataFrame:
    """Picture records without their private fields, with the address of the picture."""
    url = F.concat(F.lit("/api/img/"), X.col(sid).cast("string"), F.lit("/"), F.col("id").cast("string"))
    return pictures.drop(*PRIVATE).withColumn("url", url)


def to_records(pictures: DataFrame, keys=("job_id", "id")) -> DataFrame:
    """One JSON record per picture."""
    return pictures.select(*keys, F.to_json(F.struct(*pictures.columns), {"ignoreNullFields": "false"}).alias("record"))


def from_records(records: DataFrame, schema: str = schemas.PICTURES) -> DataFrame:
    return records.select(F.from_json("record", schema).alias("r")).select("r.*")


def read_sessions(spark: SparkSession, path: str, schema: str = schemas.PICTURES, keys=("job_id", "id")) -> tuple[DataFrame, DataFrame]:
    """Session files of several generations -> (the newest whole record of each picture, with its ``generation``; lines that can't be read).

    A record that was cut off while it was written is set aside, so the picture falls back to its record of the generation before.
    """
    lines = spark.read.schema(schema + ", generation BIGINT, _damaged STRING").option("columnNameOfCorruptRecord", "_damaged").json(path)
    lines = skew.settle(lines, dear=True)
    whole = lines.filter("_damaged IS NULL").drop("_damaged")
    rest = [c for c in whole.columns if c not in (*keys, "generation")]
    newest = whole.groupBy(*keys).agg(F.max_by(F.struct("generation", *rest), "generation").alias("r"))
    return newest.select(*keys, "r.*"), lines.filter("_damaged IS NOT NULL").select(F.col("_damaged").alias("line"))


def read_session(spark: SparkSession, path: str, schema: str = schemas.PICTURES) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_report_config(spark: SparkSession, path: str) -> DataFrame:
    """Report configurations, one JSON document per file."""
    return spark.read.schema(schemas.REPORT_CONFIG).option("multiLine", "true").json(path)


def parse_report_config(configs: DataFrame, column: str = "config") -> DataFrame:
    """The same from a column of JSON text."""
    keep = [c for c in configs.columns if c != column]
    return configs.select(*keep, F.from_json(column, schemas.REPORT_CONFIG).alias("c")).select(*keep, "c.*")
