"""Input views of the operators, derived from the star-schema test tables.

Ids that count rows within a group are numbered slice by slice (see ``plans.skew``), so no group is ever held by one task.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans import skew


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pictures(spark, folder):
    """Pictures of jobs. AQE splits a hot part in the join to ``part``; numbering runs per slice of the order key."""
    lines = table(spark, folder, "lineitem").withColumn("job_id", F.col("l_orderkey") % 1000)
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_tax", "l_discount"]
    lines = skew.number_rows(lines, ["job_id"], order, [skew.slice_of("l_orderkey", 1 << 22)], "id")
    lines = lines.withColumn("id", F.col("id") - 1)
    part = table(spark, folder, "part").select("p_partkey", "p_brand", "p_name")
    df = lines.join(part, F.col("p_partkey") == F.col("l_partkey"))
    return df.selectExpr(
        "job_id", "id",
        "concat('img_', id, CASE WHEN l_partkey % 9 = 0 THEN '_section' WHEN l_partkey % 9 = 1 THEN '_zoom' ELSE '' END, '.png') AS name",
        "CASE l_linenumber WHEN 1 THEN 'bc' WHEN 2 THEN 'deformation' WHEN 3 THEN 'stress' WHEN 4 THEN 'x_stress' "
        "WHEN 5 THEN 'geometry' WHEN 6 THEN 'mesh' ELSE 'x_other' END AS role",
        "CASE WHEN l_suppkey % 5 = 0 OR job_id % 4 = 1 THEN NULL WHEN job_id % 4 = 0 THEN 'A' ELSE l_returnflag END AS letter",
        "concat(l_partkey, '_', p_brand, '_', replace(p_name, ' ', '_')) AS model",
        "CASE WHEN l_linenumber IN (2, 3, 4, 7) AND l_suppkey % 11 <> 0 THEN l_extendedprice / 100 END AS max_value",
        "CASE WHEN l_linenumber IN (5, 6) THEN CASE l_suppkey % 3 WHEN 0 THEN 'up' WHEN 1 THEN 'down' END END AS z_dir",
        "CASE WHEN l_linenumber = 3 THEN l_suppkey % 12 END AS red_px",
        "600 + l_suppkey * 20 AS width", "CAST(400 + l_linenumber * 90 AS BIGINT) AS height",
        "l_linestatus = 'O' AND l_quantity > 45 AS user_set",
        "md5(CAST(concat(l_partkey % 400, '|', l_linenumber) AS BINARY)) AS hash")


PICTURE_HEADS = {0: "89504E470D0A1A0A", 1: "FFD8FFE0", 2: "424D3604", 3: "49492A0008000000"}
PICTURE_SUFFIXES = ("png", "JPG", "bmp", "tiff", "html", "png", "webp", "")


def page_files(spark, folder):
    """Pages as files of ten jobs: job_id, seq, name, content; half of them begin like the picture that their name tells."""
    name = "concat('page', page_id, CASE page_id % 8 " + " ".join(f"WHEN {i} THEN '.{n}'" for i, n in enumerate(PICTURE_SUFFIXES) if n) + " ELSE '' END) AS name"
    head = "concat(CASE page_id % 8 " + " ".join(f"WHEN {i} THEN unhex('{h}')" for i, h in PICTURE_HEADS.items()) + " ELSE unhex('') END, CAST(html AS BINARY)) AS content"
    return table(spark, folder, "pages").selectExpr("page_id % 10 AS job_id", "page_id AS seq", name, head)


def page_folder(spark, folder) -> str:
    """The same, written as files into job folders; ``seq`` is their time of change in seconds, so it is their order of arrival."""
    target = f"{skew.scratch_folder(spark)}/resultloom-files-{uuid.uuid4().hex}"
    local = target.removeprefix("file://").removeprefix("file:")

    def write(batches):
        for batch in batches:
            for job, seq, name, content in zip(*(batch.column(c).to_pylist() for c in range(4))):
                os.makedirs(f"{local}/{job}", exist_ok=True)
                with open(f"{local}/{job}/{name}", "wb") as f:
                    f.write(content)
                os.utime(f"{local}/{job}/{name}", (1_700_000_000 + seq, 1_700_000_000 + seq))
            yield batch.select([1])

    page_files(spark, folder).mapInArrow(write, "seq long").write.format("noop").mode("overwrite").save()
    return target


def picture_names(spark, folder):
    """Only job, name and size of the pictures; the id of a picture is its order, line and part key."""
    return table(spark, folder, "lineitem").selectExpr(
        "l_orderkey % 1000 AS job_id", "l_orderkey", "CAST(l_linenumber AS BIGINT) AS l_linenumber", "l_partkey", "l_suppkey")


def legend_lines(spark, folder):
    events = table(spark, folder, "events").withColumn("pass", F.col("event_id") % 2).withColumn("image_id", F.col("user_id"))
    events = skew.number_rows(events, ["image_id", "pass"], ["ts", "event_id"], [F.date_trunc("hour", "ts")], "line_no")
    text = (F.when(F.col("event_type") == "signup", F.concat(F.lit("me "), F.col("value").cast("string"), F.lit(" Max")))
            .when(F.col("event_type") == "error", F.concat(F.col("value").cast("string"), F.lit(" Min")))
            .when(F.col("event_type") == "click", F.concat(F.lit("| "), F.col("value").cast("string")))
            .when(F.col("event_type") == "view", F.concat(F.lit("junk text "), F.col("value").cast("string")))
            .otherwise(F.lit("A: Static Structural")))
    return events.select("image_id", "pass", "line_no", text.alias("text"))


def header_lines(spark, folder):
    """Four lines of a title block, then all lines of the document's text."""
    docs = table(spark, folder, "documents")
    below = docs.select(F.col("doc_id").alias("image_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line_no", "text"))
    below = below.select("image_id", (F.col("line_no") + 5).cast("long").alias("line_no"), "text")
    docs = docs.select("doc_id", "source", "lang")
    docs = docs.withColumn("line_no", F.explode(F.array(*[F.lit(i).cast("long") for i in (1, 2, 3, 4)])))
    top = docs.selectExpr(
        "doc_id AS image_id", "line_no",
        "CASE line_no WHEN 1 THEN concat(CASE doc_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE '' END, ': ', "
        "doc_id, '_', source, '_', lang, ' x') "
        "WHEN 2 THEN CASE doc_id % 5 WHEN 0 THEN 'Total Deformation' WHEN 1 THEN 'Equivalent Stress' "
        "WHEN 2 THEN 'Maximum Principal Stress' WHEN 3 THEN 'Static Structural' ELSE 'Holiday photo' END "
        "WHEN 3 THEN CASE doc_id % 5 WHEN 0 THEN 'Type: Total Deformation' WHEN 1 THEN 'Type: Equivalent (von-Mises) Stress' "
        "WHEN 2 THEN 'Type: Maximum Principal Stress' ELSE 'Time: 1. s' END "
        "ELSE CASE doc_id % 5 WHEN 0 THEN 'Unit: mm' WHEN 1 THEN 'Unit: MPa' ELSE 'no unit' END END AS text")
    return top.unionByName(below)


def _numbered_orders(spark, folder, out):
    orders = table(spark, folder, "orders")
    return skew.number_rows(orders, ["o_custkey"], ["o_orderkey"], [skew.slice_of("o_orderkey", 1 << 20)], out)


def bc_lines(spark, folder):
    return _numbered_orders(spark, folder, "line_no").selectExpr(
        "o_custkey AS case_id", "line_no",
        "CASE o_orderpriority WHEN '1-URGENT' THEN concat('[B] Pressure: ', CAST(o_totalprice AS STRING), "
        "CASE o_orderstatus WHEN 'P' THEN ' Pa' WHEN 'F' THEN ' kPa' ELSE ' bar' END) "
        "WHEN '2-HIGH' THEN concat('(C) Force: ', CAST(o_totalprice AS STRING), ' N') "
        "WHEN '3-MEDIUM' THEN concat('Moment: ', CAST(o_totalprice AS STRING), ' N-mm') "
        "WHEN '4-NOT SPECIFIED' THEN 'Standard Earth Gravity: 9806.6 mm/s2' ELSE '(Ay Fixed Support' END AS text")


def cases(spark, folder):
    return _numbered_orders(spark, folder, "n").selectExpr(
        "o_custkey AS job_id", "n", "o_orderkey AS case_key",
        "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice / 500 END AS stress_max",
        "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice / 100000 END AS def_max",
        "CASE WHEN o_orderkey % 19 = 0 THEN 'Pa' ELSE 'MPa' END AS stress_unit",
        "CASE WHEN o_orderkey % 23 = 0 THEN 'm' ELSE 'mm' END AS def_unit",
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'singularity' WHEN '2-HIGH' THEN 'refine' WHEN '3-MEDIUM' THEN 'asis' ELSE '' END AS basis",
        "CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice / 2000 END AS stress_away",
        "CASE WHEN o_orderkey % 7 = 0 THEN 'the left shaft' ELSE '' END AS loc_stress",
        "CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice END AS react_applied",
        "CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice * (1 + (o_orderkey % 9 - 4) / 100.0D) END AS react_sum",
        "9806.65D * (1 + (o_orderkey % 5 - 2) / 125.0D) AS gravity",
        "concat('Case ', CAST(o_orderkey % 6 AS STRING)) AS name")


def materials(spark, folder):
    return table(spark, folder, "part").selectExpr(
        "p_partkey AS job_id", "p_brand AS material",
        "CASE p_partkey % 4 WHEN 0 THEN '191400' WHEN 1 THEN '200' WHEN 2 THEN '1e9' ELSE 'n/a' END AS e_text",
        "CASE p_partkey % 3 WHEN 0 THEN '0,3' WHEN 1 THEN ' 0.5 ' ELSE '' END AS nu_text",
        "CASE p_partkey % 5 WHEN 0 THEN '7.8E-9' WHEN 1 THEN '7850' WHEN 2 THEN '7.85E-6' WHEN 3 THEN '1.5d' ELSE '1E-3' END AS rho_text",
        "CAST(p_retailprice / 4 AS DOUBLE) AS yield_mpa", "CASE WHEN p_size < 5 THEN 0.9D ELSE 1.3D END AS fos")


def mesh_stats(spark, folder):
    return table(spark, folder, "supplier").selectExpr(
        "s_suppkey AS job_id", "(s_suppkey % 100) / 100.0D AS skew_max", "(s_suppkey % 60) / 100.0D AS skew_avg",
        "(s_suppkey % 40) / 200.0D AS oq_min", "s_suppkey * 1000 AS elements")


def words(spark, folder):
    return table(spark, folder, "events").selectExpr(
        "user_id AS image_id", "event_id AS word_id",
        "CASE event_type WHEN 'signup' THEN CAST(value AS STRING) WHEN 'error' THEN 'Max' WHEN 'click' THEN CAST(value AS STRING) "
        "WHEN 'view' THEN 'Support' ELSE 'xx' END AS t",
        "value AS x0", "value + 30 AS x1", "(event_id % 400) * 1.0D AS y0", "(event_id % 400) + 8 + (event_id % 7) * 0.5D AS y1",
        "event_id % 100 AS conf", "event_id % 12 AS line")


def ocr_calls(spark, folder):
    return table(spark, folder, "events").selectExpr("user_id AS image_id", "event_id AS call_no", "value / 20 AS seconds")


def assignments(spark, folder):
    """User corrections, some for ids that do not exist."""
    return (table(spark, folder, "orders").selectExpr("o_orderkey % 1000 AS job_id", "o_custkey % 90 AS id", "o_orderstatus", "o_orderkey", "o_custkey")
            .groupBy("job_id", "id")
            .agg(F.expr("min(CASE o_orderstatus WHEN 'P' THEN 'stress' WHEN 'F' THEN 'x_other' ELSE 'unused' END)").alias("role"),
                 F.expr("min(CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 4 + 1 END)").alias("case_no")))


def state_events(spark, folder):
    return table(spark, folder, "events").selectExpr(
        "user_id AS sid", "event_id AS seq", "CAST(ts AS TIMESTAMP) AS saved_at", "concat(event_type, '|', props) AS payload",
        "substr(sha1(CAST(concat('2.2|', event_type, '|', props) AS BINARY)), 1, 12) AS build_key")


def history(spark, folder):
    return table(spark, folder, "conversations").selectExpr(
        "role AS hist_key", "conv_id * 100 + turn AS seq",
        "CASE WHEN turn = 1 THEN '[value - please confirm]' ELSE concat('  Client ', CAST(conv_id % 60 AS STRING), ' ') END AS entry")


def legend_arrays(spark, folder):
    """One legend per row; it is cut out of the row's own array, so nothing is shuffled."""
    vec = table(spark, folder, "embeddings").select("vec_id", "embedding")
    first = F.expr("transform(embedding, (e, p) -> struct(-CAST(e AS DOUBLE) AS k, p AS p, CAST(e AS DOUBLE) AS e))")
    vals = F.expr("transform(array_sort(a), (s, i) -> floor((s.e + 1) * 1000) / 10 * CASE WHEN vec_id % 4 = 0 AND i = 3 THEN 100 ELSE 1 END)")
    return vec.withColumn("a", first).select(F.col("vec_id").alias("image_id"), vals.alias("vals"))


def pixels(spark, folder):
    vec = table(spark, folder, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "e"))
    return vec.selectExpr(
        "vec_id AS image_id", "CAST(p DIV 8 AS BIGINT) AS y", "CAST(p % 8 AS BIGINT) AS x", "floor(abs(CAST(e AS DOUBLE)) * 100000) % 256 AS r",
        "floor(abs(CAST(e AS DOUBLE)) * 733331) % 256 AS g", "floor(abs(CAST(e AS DOUBLE)) * 5299709) % 256 AS b")
