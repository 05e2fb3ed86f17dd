"""Sinks: session records, published reports, report model."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.skew import settle

BUCKETS = 256


def write_session(pictures: DataFrame, path: str) -> None:
    pictures.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def publish_once(reports: DataFrame, published: DataFrame) -> DataFrame:
    """Reports (name, content, made_at) still to be published: same name and content is skipped, same name with other content
    gets the time of day in its name. ``published`` has name and content; both have one row per name."""
    known = published.select("name", F.sha1("content").alias("__sha"))
    df = reports.join(known, "name", "left").filter(F.col("__sha").isNull() | (F.col("__sha") != F.sha1("content")))
    stamped = F.concat(F.regexp_replace("name", r"\.[^.]*$", ""), F.lit("_"), F.date_format("made_at", "HHmmss"), F.regexp_extract("name", r"(\.[^.]*)$", 1))
    return df.select(F.when(F.col("__sha").isNull(), F.col("name")).otherwise(stamped).alias("published_name"), "name", "content")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _commits(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Committed runs of a published table, the oldest first: one small file each."""
    if not _exists(spark, f"{path}/manifest"):
        return []
    rows = spark.read.schema("version INT, run STRING").json(f"{path}/manifest").collect()
    return sorted((r["version"], r["run"]) for r in rows)


def published(spark: SparkSession, path: str) -> DataFrame:
    """What is published: name, content, version. Of a name that was published again the newest version counts; runs that were not committed don't exist."""
    runs = [f"{path}/runs/{run}" for _, run in _commits(spark, path)]
    schema = "name STRING, content STRING, version INT"
    df = spark.read.schema(schema).parquet(*runs) if runs else spark.createDataFrame([], schema)
    return df.groupBy("name").agg(F.max_by("content", "version").alias("content"), F.max("version").alias("version"))


def publish(path: str, reports: DataFrame) -> int:
    """Publishes reports (name, content, made_at; one row per name) by the rule of ``publish_once`` and returns the version that stands then.

    Rows are written to a folder of the run first and become visible by one manifest file, which only one run can create for a
    version. So a run that fails on the way changes nothing, a repeated run finds nothing to publish, and of two runs at once one must start again.
    """
    spark = reports.sparkSession
    version = len(_commits(spark, path)) + 1
    known = settle(published(spark, path).select("name", "content"))
    new = publish_once(reports, known).select(F.col("published_name").alias("name"), "content")
    there = known.select("name", F.sha1("content").alias("__there"))
    new = new.join(there, "name", "left").filter(F.col("__there").isNull() | (F.col("__there") != F.sha1("content"))).drop("__there")
    run = uuid.uuid4().hex
    new.withColumn("version", F.lit(version)).write.parquet(f"{path}/runs/{run}")
    if not spark.read.parquet(f"{path}/runs/{run}").take(1):
        return version - 1
    commit(spark, path, version, run)
    return version


def commit(spark: SparkSession, path: str, version: int, run: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/{version:09d}.json")
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, False)   # fails if the version is there
    out.writeBytes(json.dumps({"version": version, "run": run}) + "\n")
    out.close()


def write_report_model(path: str, buckets: int = BUCKETS, **tables: DataFrame) -> None:
    """The tables of the report model, each in its folder, split by a hash of the job.

    A fixed number of buckets stands for one folder per job: readers still skip most files for one job, and a million jobs
    do not make a million folders. A job that is written again replaces its rows: the buckets it touches are written anew, with
    the rows of their other jobs, and swapped in when all tasks are done. Rows are dealt to tasks by bucket, and Spark
    splits buckets that are too large for one task.
    """
    for name, df in tables.items():
        spark, target = df.sparkSession, f"{path}/{name}"
        out = df.withColumn("job_bucket", F.pmod(F.xxhash64("job_id"), F.lit(buckets)).cast("int"))
        if _exists(spark, target):
            out = settle(out)
            old, jobs = spark.read.parquet(target), out.select(F.col("job_id").alias("__job")).distinct()
            touched = F.broadcast(out.select("job_bucket").distinct())      # at most ``buckets`` rows
            others = old.join(touched, "job_bucket", "left_semi").join(jobs, F.col("job_id").eqNullSafe(F.col("__job")), "left_anti")
            out = out.unionByName(others, allowMissingColumns=True)
        out.hint("rebalance", "job_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_bucket").parquet(target)


def read_report_model(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}").drop("job_bucket")
