"""Queries of the intake operators."""

from pyspark.sql import functions as F

from ..functions import exprs as X, fixed
from ..operators import intake, pixels
from ..sources import testviews as T
from . import sqltext as Q
from .core import query, view

view("deduped", """
SELECT job_id, id, name, CASE WHEN id > first_id THEN 'unused' ELSE role END AS role, letter, model, max_value, z_dir, red_px, width, height, user_set, hash,
  CASE WHEN id > first_id THEN first_id END AS dup_of
FROM (SELECT *, min(id) OVER (PARTITION BY job_id, hash) AS first_id FROM pictures) d""")


@query("b1_dedup_first", "SELECT job_id, id, role, dup_of, hash FROM deduped")
def _(spark, folder):
    return intake.dedup_first(T.pictures(spark, folder)).select("job_id", "id", "role", "dup_of", "hash")


def name_table(spark, folder):
    """Picture names with case numbers and hints, told from the keys of a line."""
    return T.picture_names(spark, folder).selectExpr(
        "job_id", "l_orderkey", "l_linenumber", "l_partkey",
        "concat(CASE l_partkey % 7 WHEN 0 THEN 'LC' WHEN 1 THEN 'case_' WHEN 2 THEN 'load case ' WHEN 3 THEN 'c' ELSE 'img' END, l_suppkey % 120, "
        "CASE l_linenumber WHEN 1 THEN '_bc' WHEN 2 THEN '_usum' WHEN 3 THEN '_stress' WHEN 4 THEN '_Mesh' WHEN 5 THEN '_topview' WHEN 6 THEN '_set-up' ELSE '_misc' END, "
        "CASE l_partkey % 9 WHEN 0 THEN '_section' WHEN 1 THEN '_zoom' ELSE '' END, '.png') AS name")


view("name_table", """
SELECT l_orderkey % 1000 AS job_id, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey,
  concat(CASE l_partkey % 7 WHEN 0 THEN 'LC' WHEN 1 THEN 'case_' WHEN 2 THEN 'load case ' WHEN 3 THEN 'c' ELSE 'img' END, l_suppkey % 120,
  CASE l_linenumber WHEN 1 THEN '_bc' WHEN 2 THEN '_usum' WHEN 3 THEN '_stress' WHEN 4 THEN '_Mesh' WHEN 5 THEN '_topview' WHEN 6 THEN '_set-up' ELSE '_misc' END,
  CASE l_partkey % 9 WHEN 0 THEN '_section' WHEN 1 THEN '_zoom' ELSE '' END, '.png') AS name
FROM lineitem""")

BY_NAME = f"""
SELECT *, CASE WHEN r IN ('bc', 'deformation', 'stress') AND {Q.hint('name')} IS NOT NULL THEN 'x_' || r ELSE r END AS r2 FROM (
SELECT *, CASE WHEN regexp_matches(s, '(^|[^a-z])(bc|bcs|boundary|support|supports|setup|set[-_ ]?up|constraints?|loads?|loading)([^a-z]|$)') THEN 'bc'
  WHEN regexp_matches(s, 'deform|displac|(^|[^a-z])(td|def|usum|disp)([^a-z]|$)') THEN 'deformation'
  WHEN regexp_matches(s, 'stress|von|mises|equiv|(^|[^a-z])(vm|eqv|sigma)([^a-z]|$)') THEN 'stress'
  WHEN regexp_matches(s, 'mesh|element|grid') THEN 'mesh'
  WHEN regexp_matches(s, 'geom|model|cad|(^|[^a-z])(top|bottom|iso|isometric|front|rear|plan)([^a-z]|$)') THEN 'geometry' END AS r,
  TRY_CAST(regexp_extract(s, '(^|[^a-z])(load[-_ ]?case|case|lc|c)[-_ ]?([0-9]{{1,2}})([^0-9]|$)', 3) AS BIGINT) AS case_no
FROM (SELECT *, lower({Q.stem('name')}) AS s FROM %s) a) b"""


@query("b2_classify_by_name", f"""
SELECT l_orderkey, l_linenumber, l_partkey, name, coalesce(r2, 'unknown') AS role, case_no,
  CASE WHEN case_no > 0 AND r2 IN {Q.in_list(fixed.CASE_ROLES)} THEN chr(CAST(64 + case_no AS INT)) END AS letter,
  CASE WHEN r IS NULL THEN 'low' ELSE 'medium' END AS confidence
FROM ({BY_NAME % 'name_table'}) c""")
def _(spark, folder):
    return intake.classify_by_name(name_table(spark, folder)).drop("job_id")


@query("b3_view_hint", f"SELECT l_orderkey, l_linenumber, l_partkey, name, {Q.hint('name')} AS hint FROM name_table")
def _(spark, folder):
    return name_table(spark, folder).select("l_orderkey", "l_linenumber", "l_partkey", "name", X.view_hint("name").alias("hint"))


def headers(spark, folder):
    return intake.classify_by_header(T.header_lines(spark, folder))


view("headers", """
SELECT image_id, letter, model, unit, role, has_header, is_result,
  CASE WHEN role = 'x_other' THEN coalesce(nullif(left(trim(regexp_replace(regexp_replace(CASE WHEN t <> '' THEN t ELSE n END, '[^A-Za-z0-9 ()/.+\\-]', '', 'g'), '\\s+', ' ', 'g'), ' -.'), 60), ''), 'Other result') ELSE '' END AS result_kind
FROM (
SELECT *, CASE WHEN src LIKE '%total deformation%' THEN 'deformation' WHEN regexp_matches(src, 'von[- ]?mises|equivalent\\s*(\\(.*?\\))?\\s*stress') THEN 'stress'
  WHEN is_result OR (regexp_matches(src, 'deformation|stress|strain|safety factor|displacement|reaction|energy|fatigue|damage|shear|principal|intensity') AND NOT static) THEN 'x_other'
  WHEN static THEN 'bc' END AS role
FROM (
SELECT image_id, letter, model, unit, letter IS NOT NULL AS has_header, t, n, (t <> '' OR unit IS NOT NULL) AS is_result, lower(t || ' | ' || n) AS src,
  regexp_matches(lower(top3), 'static structural|transient structural|steady-state|modal|harmonic|buckling') AS static
FROM (
SELECT image_id, arg_min(nullif(regexp_extract(text, '^\\W*([A-Z])\\s*[:;]\\s*(\\S.*)$', 1), ''), line_no) FILTER (line_no <= 3 AND regexp_matches(text, '^\\W*([A-Z])\\s*[:;]\\s*(\\S.*)$')) AS letter,
  regexp_replace(arg_min(trim(regexp_extract(text, '^\\W*([A-Z])\\s*[:;]\\s*(\\S.*)$', 2)), line_no) FILTER (line_no <= 3 AND regexp_matches(text, '^\\W*([A-Z])\\s*[:;]\\s*(\\S.*)$')), '(\\s+[a-z]{1,2})+$', '') AS model,
  coalesce(arg_min(trim(regexp_extract(text, '(?i)^\\W*Type\\s*[:;]\\s*(.+)$', 1)), line_no) FILTER (line_no <= 7 AND regexp_matches(text, '(?i)^\\W*Type\\s*[:;]\\s*(.+)$')), '') AS t,
  coalesce(max(text) FILTER (line_no = 2), '') AS n, string_agg(text, ' ' ORDER BY line_no) FILTER (line_no <= 3) AS top3,
  nullif(regexp_extract(string_agg(text, ' ' ORDER BY line_no), 'Unit\\s*[:;]\\s*([A-Za-z/²^0-9]+)', 1), '') AS unit
FROM header_lines GROUP BY image_id) a) b) c""")


@query("b4_classify_by_header", "SELECT image_id, letter, model, unit, role, result_kind, has_header, is_result FROM headers")
def _(spark, folder):
    return headers(spark, folder)


view("edges", """
SELECT image_id, avg(CASE WHEN abs(gr - g) + abs(gd - g) > 60 THEN 1.0e0 ELSE 0.0e0 END) AS edge_density FROM (
  SELECT image_id, g, lead(g) OVER (PARTITION BY image_id, y ORDER BY x) AS gr, lead(g) OVER (PARTITION BY image_id, x ORDER BY y) AS gd
  FROM (SELECT image_id, x, y, floor((CAST(r AS BIGINT) * 19595 + CAST(g AS BIGINT) * 38470 + CAST(b AS BIGINT) * 7471 + 32768) / 65536) AS g FROM pixels) p) q
WHERE gr IS NOT NULL AND gd IS NOT NULL GROUP BY image_id""")


@query("b5_fallback_role", """
SELECT image_id, letter, model, CASE WHEN role IS NULL AND NOT has_header THEN CASE WHEN edge_density > 0.075 THEN 'mesh' ELSE 'geometry' END ELSE coalesce(role, 'unknown') END AS role,
  CASE WHEN role = 'x_other' OR (role IS NULL AND NOT has_header) THEN 'medium' ELSE 'high' END AS confidence,
  CASE WHEN role = 'x_other' THEN 'Result type ''' || result_kind || ''' is not Total Deformation or Equivalent (von-Mises) Stress, so it is used as an additional view. Change it in the table if that is wrong.'
    WHEN role IS NULL AND has_header THEN 'Title not recognised - please choose what this picture is.' END AS note
FROM headers LEFT JOIN edges USING (image_id)""")
def _(spark, folder):
    read = headers(spark, folder)
    return intake.fallback_role(read, pixels.edge_density(T.pixels(spark, folder))).select("image_id", "letter", "model", "role", "confidence", "note")


view("budget", """
SELECT image_id, call_no, seconds, used, 60 - used > 1 AS admitted, CASE WHEN 60 - used > 1 THEN least(10.0e0, 60 - used) END AS cap_seconds
FROM (SELECT *, CAST(coalesce(sum(CAST(seconds AS DECIMAL(18,6))) OVER (PARTITION BY image_id ORDER BY call_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS used FROM ocr_calls) a""")


def budget(spark, folder):
    return intake.ocr_budget(T.ocr_calls(spark, folder), 60.0, 10.0)


@query("b6_route_read_or_manual", f"""
WITH slow AS (SELECT image_id, bool_or(NOT admitted OR coalesce(seconds > cap_seconds, false)) AS slow FROM budget GROUP BY image_id),
rd AS (SELECT h.image_id, role, letter, CASE WHEN slow THEN 'it took too long' WHEN role IS NULL THEN 'ValueError' END AS failure FROM headers h JOIN pages ON page_id = h.image_id LEFT JOIN slow USING (image_id)),
nm AS ({BY_NAME % '(SELECT page_id AS image_id, url AS name FROM pages)'})
SELECT image_id, name, rd.role, 'high' AS confidence, letter, false AS manual, CAST(NULL AS VARCHAR) AS note FROM rd JOIN nm USING (image_id) WHERE failure IS NULL
UNION ALL
SELECT image_id, name, coalesce(r2, 'unknown'), CASE WHEN r2 IS NULL THEN 'low' ELSE 'medium' END, CASE WHEN case_no > 0 AND r2 IN {Q.in_list(fixed.CASE_ROLES)} THEN chr(CAST(64 + case_no AS INT)) END, true,
  CASE WHEN r2 IS NULL AND failure IS NULL THEN 'I could not tell what this picture is - please choose it in the list.'
  WHEN r2 IS NULL THEN 'This picture could not be read automatically (' || failure || ') - please choose what it is.'
  WHEN failure IS NOT NULL THEN 'This picture could not be read automatically (' || failure || ') - its type was guessed from the file name; please check it and type the numbers.' END
FROM nm LEFT JOIN rd USING (image_id) WHERE rd.image_id IS NULL OR failure IS NOT NULL""")
def _(spark, folder):
    pictures = T.table(spark, folder, "pages").select(F.col("page_id").alias("image_id"), F.col("url").alias("name"))
    slow = budget(spark, folder).groupBy("image_id").agg(F.first("picture_timed_out").alias("slow"))
    read = headers(spark, folder).join(pictures, "image_id", "left_semi").join(slow, "image_id", "left")
    read = read.withColumn("confidence", F.lit("high")).withColumn(
        "failure", F.when(F.col("slow"), F.lit("it took too long")).when(F.col("role").isNull(), F.lit("ValueError")))
    return intake.route_read_or_manual(read, pictures)


@query("b7_ocr_budget", """
SELECT image_id, call_no, round(used, 6) AS used, admitted, round(cap_seconds, 6) AS cap_seconds,
  bool_or(NOT admitted OR coalesce(seconds > cap_seconds, false)) OVER (PARTITION BY image_id) AS picture_timed_out FROM budget""")
def _(spark, folder):
    return budget(spark, folder).select("image_id", "call_no", F.round("used", 6).alias("used"), "admitted", F.round("cap_seconds", 6).alias("cap_seconds"), "picture_timed_out")


@query("b8_first_accepting_region", """
SELECT image_id // 4 AS picture_id, coalesce(min(image_id % 4) FILTER (has_header OR role IS NOT NULL), max(image_id % 4)) AS region FROM headers GROUP BY image_id // 4""")
def _(spark, folder):
    reads = headers(spark, folder).withColumn("picture_id", F.floor(F.col("image_id") / 4)).withColumn("ordinal", F.col("image_id") % 4)
    return intake.first_accepting_region(reads, "picture_id")


def _box(u):
    return [f"least(1.0e0, {float(p)}e0 * {u}e0 / {'width' if i % 2 == 0 else 'height'})" for i, p in enumerate(fixed.REGIONS["header"][1])]


def _gap(a, b):
    return " + ".join(f"abs({a}[{i}] - {b}[{i}])" for i in (1, 2, 3, 4))


@query("b9_candidate_regions", f"""
WITH b AS (SELECT job_id, id, width > 1300 OR height > 800 AS large, [0.0e0, 0.0e0, 0.46e0, 0.215e0] AS f, {', '.join(f"[{', '.join(_box(u))}] AS b{k}" for k, u in ((1, 1.0), (2, 1.5), (3, 2.0)))} FROM pictures),
w AS (SELECT *, {', '.join(f"(large AND b{k}[3] - b{k}[1] > 0.02 AND b{k}[4] - b{k}[2] > 0.02 AND {_gap(f'b{k}', 'f')} > 0.03) AS w{k}" for k in (1, 2, 3))} FROM b),
a2 AS (SELECT *, w2 AND (NOT w1 OR {_gap('b2', 'b1')} > 0.03) AS k2 FROM w),
a3 AS (SELECT *, w3 AND (NOT w1 OR {_gap('b3', 'b1')} > 0.03) AND (NOT k2 OR {_gap('b3', 'b2')} > 0.03) AS k3 FROM a2),
r AS (SELECT job_id, id, 0 AS o, f AS box FROM a3 UNION ALL SELECT job_id, id, 1, b1 FROM a3 WHERE w1 UNION ALL SELECT job_id, id, 2, b2 FROM a3 WHERE k2 UNION ALL SELECT job_id, id, 3, b3 FROM a3 WHERE k3)
SELECT job_id, id, row_number() OVER (PARTITION BY job_id, id ORDER BY o) - 1 AS ordinal, box[1] AS x0, box[2] AS y0, box[3] AS x1, box[4] AS y1 FROM r""")
def _(spark, folder):
    return intake.candidate_regions(T.pictures(spark, folder))
