"""Queries of the sources and sinks."""

import uuid

from pyspark.sql import functions as F

from ..functions import fixed
from ..plans import skew
from ..sources import readers, sinks, testviews as T
from . import sqltext as Q
from .core import query, view

view("page_files", f"""
SELECT *, CASE WHEN ok THEN row_number() OVER (PARTITION BY job_id, ok ORDER BY seq) - 1 END AS id, CASE WHEN ok THEN md5(content) END AS hash FROM (
SELECT *, regexp_matches(name, '(?i)\\.(png|jpg|jpeg|bmp|tif|tiff|webp)$') AND regexp_matches(hex(content), '^(89504E470D0A1A0A|FFD8FF|424D|49492A00|4D4D002A|52494646.{{8}}57454250)') AS ok FROM (
SELECT page_id % 10 AS job_id, page_id AS seq, 'page' || page_id || CASE page_id % 8 {' '.join(f"WHEN {i} THEN '.{n}'" for i, n in enumerate(T.PICTURE_SUFFIXES) if n)} ELSE '' END AS name,
  CASE page_id % 8 {' '.join(f"WHEN {i} THEN unhex('{h}')" for i, h in T.PICTURE_HEADS.items())} ELSE unhex('') END || encode(html) AS content FROM pages) a) b""")


def accepted(good, skipped):
    return good.withColumn("accepted", F.lit(True)).unionByName(skipped.withColumn("accepted", F.lit(False)), allowMissingColumns=True)


@query("a1_scan_pictures", "SELECT job_id, seq, name, ok AS accepted, id, hash FROM page_files")
def _(spark, folder):
    return accepted(*readers.scan_pictures(T.page_files(spark, folder)))


@query("a1_picture_files", """
SELECT CAST(job_id AS VARCHAR) AS job_id, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS seq, name, ok AS accepted, id, hash FROM page_files""")
def _(spark, folder):
    """From a folder of job folders: files in the order of their arrival."""
    files = skew.settle(readers.read_pictures(spark, T.page_folder(spark, folder)))
    return accepted(*readers.scan_pictures(files))


DEFAULTS = ", ".join(f"({Q.quote(k)}, {Q.quote(s)}, {Q.quote(v)})" for k, s, v in readers.default_settings())
KEYS = ("fos", "mesh_limits", "material", "_help", "mm_format", "new_key")
OVERRIDES = ("SELECT c_custkey AS set_id, CASE c_nationkey % 6 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KEYS)) + " END AS key, "
             "CASE c_nationkey % 6 WHEN 1 THEN CASE WHEN c_custkey % 2 = 0 THEN 'skew_max_warn' ELSE 'extra' END WHEN 2 THEN CASE WHEN c_custkey % 3 = 0 THEN 'E' ELSE '' END ELSE '' END AS subkey, "
             "CAST(c_custkey % 97 AS STRING) AS value FROM customer")


@query("a2_overlay_config", f"""
WITH d AS (SELECT * FROM (VALUES {DEFAULTS}) t(key, subkey, value)), o AS (SELECT * FROM ({OVERRIDES}) x WHERE key NOT LIKE '\\_%' ESCAPE '\\'),
s AS (SELECT c_custkey AS set_id FROM customer)
SELECT set_id, key, subkey, value FROM o UNION ALL
SELECT s.set_id, d.key, d.subkey, d.value FROM s CROSS JOIN d LEFT JOIN o ON o.set_id = s.set_id AND o.key = d.key
WHERE o.key IS NULL OR (o.subkey <> '' AND d.subkey <> '' AND o.subkey <> d.subkey)""")
def _(spark, folder):
    customer = T.table(spark, folder, "customer")
    cases = " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KEYS))
    over = customer.selectExpr(
        "c_custkey AS set_id", f"CASE c_nationkey % 6 {cases} END AS key",
        "CASE c_nationkey % 6 WHEN 1 THEN CASE WHEN c_custkey % 2 = 0 THEN 'skew_max_warn' ELSE 'extra' END WHEN 2 THEN CASE WHEN c_custkey % 3 = 0 THEN 'E' ELSE '' END ELSE '' END AS subkey",
        "CAST(c_custkey % 97 AS STRING) AS value")
    return readers.overlay_config(customer.select(F.col("c_custkey").alias("set_id")), over)


SETTINGS_JSON = """CASE s_suppkey % 5 WHEN 1 THEN '{"mesh_limits": {"skew_max_warn": 0.7}, "_note": 1}' WHEN 2 THEN '{"mesh_limits": {"oq_min_warn": 0.15, "skew_avg_info": 0.3}, "fos": 1.5, "assumption_library": ["Only one."]}'
  WHEN 3 THEN '{"mesh_limits": {"skew_max' WHEN 4 THEN '{"fos": 2, "show_utilisation": false, "material": {"E": "2e5"}}' END"""
LIMITS = fixed.SETTINGS["mesh_limits"]
view("job_settings", f"""
SELECT job_id, t IS NULL OR json_valid(t) AS settings_ok, coalesce(CAST(json_extract_string(ok, '$.fos') AS DOUBLE), {fixed.SETTINGS['fos']}e0) AS fos,
  coalesce(CAST(json_extract_string(ok, '$.show_utilisation') AS BOOLEAN), true) AS show_utilisation, coalesce(json_extract_string(ok, '$.material.E'), '{fixed.SETTINGS['material']['E']}') AS e,
  {", ".join(f"coalesce(CAST(json_extract_string(ok, '$.mesh_limits.{k}') AS DOUBLE), {v}e0) AS {k}" for k, v in LIMITS.items())},
  CAST(coalesce(json_array_length(ok, '$.assumption_library'), {len(fixed.ASSUMPTIONS)}) AS BIGINT) AS assumptions
FROM (SELECT *, CASE WHEN json_valid(t) THEN t END AS ok FROM (SELECT s_suppkey AS job_id, {SETTINGS_JSON} AS t FROM supplier) a) b""")


def settings(spark, folder):
    jobs = T.table(spark, folder, "supplier").select(F.col("s_suppkey").alias("job_id"), F.expr(SETTINGS_JSON).alias("settings_json"))
    return readers.job_settings(jobs)


@query("a2_job_settings", "SELECT * FROM job_settings")
def _(spark, folder):
    """Defaults with each job's own document put over them: values, sub-keys, lists; a damaged document leaves the defaults."""
    s = settings(spark, folder)
    return s.select("job_id", "settings_ok", "settings.fos", "settings.show_utilisation", F.col("settings.material.E").alias("e"), *[f"settings.mesh_limits.{k}" for k in LIMITS],
                    F.size("settings.assumption_library").cast("long").alias("assumptions"))


def session_lines(pictures, records):
    """One line per picture and record; the pictures are made once for all of them."""
    return pictures.select(F.explode(F.array(*records)).alias("value"))


@query("a3_session_files", """
SELECT 'record' AS kind, job_id, id, CASE WHEN id % 50 = 7 THEN 1 ELSE 2 END AS generation, CASE WHEN id % 50 = 7 THEN 'old ' || name ELSE name END AS name, max_value FROM pictures
UNION ALL SELECT 'damaged', NULL, count(*), NULL, NULL, NULL FROM pictures WHERE id % 50 = 7""")
def _(spark, folder):
    """Two generations of session files; some lines of the newer ones were cut off while they were written."""
    records = []
    for generation, name in ((1, F.concat(F.lit("old "), F.col("name"))), (2, F.col("name"))):
        record = F.to_json(F.struct("job_id", "id", name.alias("name"), "max_value", F.lit(generation).alias("generation")))
        records.append(F.when((F.col("id") % 50 == 7) & F.lit(generation == 2), F.left(record, F.lit(20))).otherwise(record))
    lines = session_lines(T.pictures(spark, folder), records)
    path = f"{skew.scratch_folder(spark)}/resultloom-sessions-{uuid.uuid4().hex}"
    lines.write.option("compression", "gzip").text(path)
    newest, damaged = readers.read_sessions(spark, path)
    count = damaged.agg(F.lit("damaged").alias("kind"), F.count(F.lit(1)).alias("id"))
    return newest.select(F.lit("record").alias("kind"), "job_id", "id", F.col("generation").cast("int").alias("generation"), "name", "max_value").unionByName(count, allowMissingColumns=True)


@query("a3_session_records", """
SELECT job_id, id, name, role, letter, model, max_value, z_dir, CAST(red_px AS BIGINT) AS red_px, width, height, user_set, '/api/img/' || job_id || '/' || id AS url FROM pictures""")
def _(spark, folder):
    back = readers.from_records(readers.to_records(T.pictures(spark, folder)))
    names = ("job_id", "id", "name", "role", "letter", "model", "max_value", "z_dir", "red_px", "width", "height", "user_set", "url")
    return readers.public_projection(back).select(*names)


@query("a4_publish_once", """
WITH e AS (SELECT *, 'FEA_Report_' || sid || '.pptx' AS name FROM state_events),
p AS (SELECT name, arg_max(payload, (saved_at, seq)) AS content FROM e WHERE seq % 3 = 0 GROUP BY name),
r AS (SELECT name, arg_max(payload, (saved_at, seq)) AS content, max(saved_at) AS made_at FROM e GROUP BY name)
SELECT CASE WHEN p.name IS NULL THEN r.name ELSE regexp_replace(r.name, '\\.pptx$', '') || '_' || strftime(made_at, '%H%M%S') || '.pptx' END AS published_name, r.name, r.content
FROM r LEFT JOIN p ON p.name = r.name WHERE p.name IS NULL OR p.content <> r.content""")
def _(spark, folder):
    events = T.state_events(spark, folder).withColumn("name", F.concat(F.lit("FEA_Report_"), F.col("sid").cast("string"), F.lit(".pptx")))

    def last(df):
        s = df.groupBy("name").agg(F.max(F.struct("saved_at", "seq", "payload")).alias("s"))
        return s.select("name", F.col("s.payload").alias("content"), F.col("s.saved_at").alias("made_at"))

    return sinks.publish_once(last(events), last(events.filter("seq % 3 = 0")).drop("made_at"))


@query("a4_publish_runs", """
WITH third AS (SELECT *, least(2, (epoch_us(saved_at) - lo) * 3 // (hi - lo + 1)) AS k FROM state_events, (SELECT min(epoch_us(saved_at)) AS lo, max(epoch_us(saved_at)) AS hi FROM state_events) x),
runs AS (SELECT r.k, sid, 'FEA_Report_' || sid AS stem, arg_max(payload, (saved_at, seq)) AS content, max(saved_at) AS made_at FROM (SELECT unnest([0, 1, 2]) AS k) r JOIN third t ON t.k <= r.k GROUP BY ALL),
firsts AS (SELECT stem, min(k) AS k0, arg_min(content, k) AS c0 FROM runs GROUP BY stem)
SELECT name, arg_max(content, k) AS content FROM (
SELECT stem || CASE WHEN r.k = k0 THEN '' ELSE '_' || strftime(made_at, '%H%M%S') END || '.pptx' AS name, content, r.k FROM runs r JOIN firsts USING (stem) WHERE r.k = k0 OR content <> c0) a GROUP BY name""")
def _(spark, folder):
    """Three runs over growing states; the second is repeated, and one was killed before its commit."""
    events = T.state_events(spark, folder).withColumn("name", F.concat(F.lit("FEA_Report_"), F.col("sid").cast("string"), F.lit(".pptx")))
    low, high = events.agg(F.min(F.unix_micros("saved_at")), F.max(F.unix_micros("saved_at"))).first()
    third = F.least(F.lit(2), F.expr(f"(unix_micros(saved_at) - {low}) * 3 div {high - low + 1}"))
    path = f"{skew.scratch_folder(spark)}/resultloom-published-{uuid.uuid4().hex}"
    for k in (0, 1, 1, 2):
        last = events.filter(third <= k).groupBy("name").agg(F.max(F.struct("saved_at", "seq", "payload")).alias("s"))
        last = last.select("name", F.col("s.payload").alias("content"), F.col("s.saved_at").alias("made_at"))
        if k == 1:
            last.select("name", F.lit("killed").alias("content"), F.lit(2).alias("version")).write.mode("overwrite").parquet(f"{path}/runs/killed")
        sinks.publish(path, last)
    return sinks.published(spark, path).select("name", "content")


@query("a5_read_report_config", """
SELECT c_custkey AS job_id, 'QA desk' AS author, CASE WHEN c_custkey % 2 = 0 THEN 'sig3' END AS mm_format, c_acctbal AS allowable_mpa, c_name AS title, 'stack' AS results, CAST(c_custkey % 3 AS BIGINT) AS cases FROM customer""")
def _(spark, folder):
    text = ("concat('{\"author\": \"QA desk\", ', CASE WHEN c_custkey % 2 = 0 THEN '\"mm_format\": \"sig3\", ' ELSE '' END, '\"allowable_mpa\": ', c_acctbal, ', \"cover\": {\"title\": \"', c_name, '\"}, "
            "\"layouts\": {\"results\": \"stack\"}, \"cases\": [', CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN '{\"name\": \"a\"}' ELSE '{\"name\": \"a\"}, {\"name\": \"b\"}' END, ']}') AS config")
    df = readers.parse_report_config(T.table(spark, folder, "customer").selectExpr("c_custkey AS job_id", text))
    return df.select("job_id", "author", "mm_format", "allowable_mpa", F.col("cover.title").alias("title"), F.col("layouts.results").alias("results"), F.size("cases").cast("long").alias("cases"))
