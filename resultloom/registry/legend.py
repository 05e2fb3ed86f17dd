"""Queries of the colour-legend operators."""

from pyspark.sql import functions as F

from ..operators import legend
from ..plans import skew
from ..sources import testviews as T
from . import sqltext as Q
from .core import query, view

NUM = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"

view("legend_flags", f"""
SELECT image_id, pass, line_no, t, regexp_matches(t, '(?i)({NUM})\\s*M[aeo]\\s*x\\b') AS is_max, regexp_matches(t, '(?i)({NUM})\\s*M[il1I]\\s*n\\b') AS is_min,
  TRY_CAST(regexp_extract(t, '(?i)({NUM})\\s*M[aeo]\\s*x\\b', 1) AS DOUBLE) AS vmax, TRY_CAST(regexp_extract(t, '(?i)({NUM})\\s*M[il1I]\\s*n\\b', 1) AS DOUBLE) AS vmin,
  TRY_CAST(regexp_extract(t, '(^|[^0-9.])({NUM})\\s*$', 2) AS DOUBLE) AS vend, len(trim(regexp_extract(t, '^(.*?(^|[^0-9.]))({NUM})\\s*$', 1))) AS lead
FROM (SELECT image_id, pass, line_no, regexp_replace(text, '([0-9]),([0-9])', '\\1.\\2', 'g') AS t FROM legend_lines) a""")
view("legend_reads", """
SELECT f.image_id, f.pass, max_line, any_value(mx) AS "max", min(line_no) FILTER (is_min AND line_no > max_line) AS end_line,
  coalesce(arg_min(vmin, line_no) FILTER (is_min AND line_no > max_line), arg_max(vmin, line_no) FILTER (is_min AND (max_line IS NULL OR line_no < max_line))) AS "min"
FROM legend_flags f JOIN (SELECT image_id, pass, min(line_no) FILTER (is_max) AS max_line, arg_min(vmax, line_no) FILTER (is_max) AS mx FROM legend_flags GROUP BY ALL) m ON f.image_id = m.image_id AND f.pass = m.pass
GROUP BY f.image_id, f.pass, max_line""")
view("legend_values", """
SELECT image_id, pass, max_line AS line_no, "max" AS value FROM legend_reads WHERE max_line IS NOT NULL
UNION ALL SELECT f.image_id, f.pass, f.line_no, vend FROM legend_flags f JOIN legend_reads r ON f.image_id = r.image_id AND f.pass = r.pass
WHERE f.line_no > max_line AND (end_line IS NULL OR f.line_no < end_line) AND NOT is_min AND vend IS NOT NULL AND lead <= 5""")


@query("c1_parse_legend", """
SELECT r.image_id, r.pass, r."max", r."min", v.line_no, v.value FROM legend_reads r LEFT JOIN legend_values v ON v.image_id = r.image_id AND v.pass = r.pass""")
def _(spark, folder):
    reads, values = legend.parse_legend(T.legend_lines(spark, folder))
    return reads.select("image_id", "pass", "max", "min").join(values, ["image_id", "pass"], "left")


view("reconciled", f"""
SELECT image_id, mx AS "max", coalesce(na, nb) AS "min", CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN CASE WHEN differ THEN 'low' ELSE 'high' END WHEN a IS NULL AND b IS NULL THEN 'low' ELSE 'medium' END AS confidence,
  CASE WHEN differ THEN {Q.say('two readings of the Max value disagree ({a} and {b}) - check it against the legend picture', a="printf('%g', a)", b="printf('%g', b)")}
    WHEN (a IS NULL) <> (b IS NULL) THEN 'the Max value could only be read once - please check it' END AS note,
  CASE WHEN ca >= cb THEN 0::BIGINT ELSE 1 END AS kept_pass, greatest(ca, cb) AS n_values, CASE WHEN ca >= cb THEN sa ELSE sb END AS second
FROM (SELECT *, CASE WHEN differ THEN CASE WHEN sec IS NULL OR a > sec THEN a WHEN b > sec THEN b ELSE a END ELSE coalesce(a, b) END AS mx FROM (
SELECT *, coalesce(abs(a - b) > 1e-6 * greatest(abs(a), abs(b), 1e-12), false) AS differ, coalesce(sa, sb) AS sec FROM (
SELECT image_id, max("max") FILTER (pass = 0) AS a, max("max") FILTER (pass = 1) AS b, max("min") FILTER (pass = 0) AS na, max("min") FILTER (pass = 1) AS nb,
  coalesce(max(c) FILTER (pass = 0), 0) AS ca, coalesce(max(c) FILTER (pass = 1), 0) AS cb, max(s) FILTER (pass = 0) AS sa, max(s) FILTER (pass = 1) AS sb
FROM legend_reads r LEFT JOIN (SELECT image_id, pass, count(*) AS c, arg_min(value, line_no) FILTER (rn > 1) AS s FROM (SELECT *, row_number() OVER (PARTITION BY image_id, pass ORDER BY line_no) AS rn FROM legend_values) q GROUP BY ALL) v USING (image_id, pass)
GROUP BY image_id) p) x) y""")


def chosen(spark, folder):
    return legend.reconcile_passes(legend.read_passes(T.legend_lines(spark, folder)))


@query("c2_reconcile_passes", """
SELECT c.*, v.line_no, CASE WHEN v.line_no = r.max_line THEN coalesce(c."max", v.value) ELSE v.value END AS value FROM reconciled c
LEFT JOIN legend_values v ON v.image_id = c.image_id AND v.pass = c.kept_pass LEFT JOIN legend_reads r ON r.image_id = c.image_id AND r.pass = c.kept_pass""")
def _(spark, folder):
    lines = skew.settle(T.legend_lines(spark, folder))
    reads = skew.settle(legend.read_passes(lines))
    best = skew.settle(legend.reconcile_passes(reads))
    return best.join(legend.kept_values(lines, reads, best), "image_id", "left")


@query("c3_first_region_with_max", """
SELECT image_id // 3 AS picture_id, coalesce(min(image_id % 3) FILTER ("max" IS NOT NULL), min(image_id % 3)) AS ordinal,
  coalesce(arg_min("max", image_id % 3) FILTER ("max" IS NOT NULL), arg_min("max", image_id % 3)) AS "max",
  CASE WHEN count("max") > 0 THEN arg_min_null("min", image_id % 3) FILTER ("max" IS NOT NULL) ELSE arg_min_null("min", image_id % 3) END AS "min",
  CASE WHEN count("max") > 0 THEN arg_min(confidence, image_id % 3) FILTER ("max" IS NOT NULL) ELSE arg_min(confidence, image_id % 3) END AS confidence
FROM reconciled GROUP BY image_id // 3""")
def _(spark, folder):
    reads = chosen(spark, folder).withColumn("picture_id", F.floor(F.col("image_id") / 3)).withColumn("ordinal", F.col("image_id") % 3)
    return legend.first_region_with_max(reads, "picture_id")


@query("c4_repair_monotonic", """
WITH RECURSIVE steps(image_id, pos, kept, notes) AS (
SELECT DISTINCT image_id, CAST(-1 AS BIGINT), CAST([] AS DOUBLE[]), CAST([] AS VARCHAR[]) FROM legend_arrays
UNION ALL
SELECT image_id, pos, CASE WHEN fits THEN list_append(kept, x) WHEN mine IS NOT NULL THEN list_append(kept, mine) WHEN other IS NOT NULL THEN list_concat(kept[:-2], [other, x]) ELSE kept END,
  CASE WHEN fits THEN notes WHEN mine IS NOT NULL THEN list_append(notes, printf('legend value %g repaired to %g', x, mine))
    WHEN other IS NOT NULL THEN list_append(notes, printf('legend value %g repaired to %g', kept[-1], other)) ELSE list_append(notes, printf('legend value %g ignored', x)) END
FROM (SELECT s.image_id, v.pos, s.kept, s.notes, v.v AS x, len(kept) = 0 OR v.v < kept[-1] AS fits,
  list_filter(list_transform([0.1, 0.01, 10.0, 100.0, 0.001, 1000.0], lambda f: CAST(printf('%g', v.v * CAST(f AS DOUBLE)) AS DOUBLE)), lambda c: c > 0 AND c < kept[-1] AND (v.following IS NULL OR c > v.following))[1] AS mine,
  CASE WHEN len(kept) > 1 THEN list_filter(list_transform([0.1, 0.01, 10.0, 100.0, 0.001, 1000.0], lambda f: CAST(printf('%g', kept[-1] * CAST(f AS DOUBLE)) AS DOUBLE)), lambda c: c > 0 AND c < kept[-2] AND c > v.v)[1] END AS other
  FROM steps s JOIN (SELECT *, lead(v) OVER (PARTITION BY image_id ORDER BY pos) AS following FROM legend_arrays) v ON v.image_id = s.image_id AND v.pos = s.pos + 1) t),
ends AS (SELECT image_id, arg_max(kept, pos) AS kept, arg_max(notes, pos) AS notes FROM steps GROUP BY image_id)
SELECT image_id, CAST(i - 1 AS INTEGER) AS pos, kept[i] AS v, array_to_string(notes, '; ') AS repairs FROM ends, unnest(generate_series(1, len(kept))) g(i)""")
def _(spark, folder):
    df = legend.repair_monotonic(T.legend_arrays(spark, folder))
    return df.select("image_id", F.posexplode("vals").alias("pos", "v"), F.array_join("repairs", "; ").alias("repairs"))


@query("c5_sanity_max", f"""
SELECT image_id, "max", second, CASE WHEN "max" < second THEN 'low' ELSE confidence END AS confidence,
  CASE WHEN "max" < second THEN {Q.say('the Max ({m}) is smaller than the next legend value ({s}) - the reading is probably wrong', m="printf('%g', \"max\")", s="printf('%g', second)")} ELSE note END AS note FROM reconciled""")
def _(spark, folder):
    return legend.sanity_max(chosen(spark, folder)).select("image_id", "max", "second", "confidence", "note")


view("caps", """
SELECT image_id, CASE WHEN count(*) >= 5 AND max(v) FILTER (pos = 2) - max(v) FILTER (pos = 3) > 0 AND max(v) FILTER (pos = 0) - max(v) FILTER (pos = 1) > 2 * (max(v) FILTER (pos = 2) - max(v) FILTER (pos = 3))
  THEN max(v) FILTER (pos = 1) END AS cap FROM legend_arrays GROUP BY image_id""")


@query("c6_legend_cap", "SELECT image_id, cap FROM caps")
def _(spark, folder):
    return legend.legend_cap(T.legend_arrays(spark, folder)).select("image_id", "cap")


view("cap_jobs", "SELECT (c_custkey + n_id) % 40 AS job_id, floor(100 + abs(c_acctbal) % 2) + (c_custkey % 4) * 0.25e0 + CASE WHEN (c_custkey + n_id) % 4 = 0 THEN c_custkey % 50 ELSE 0 END AS cap FROM (SELECT c_custkey, c_acctbal, c_nationkey % 3 AS n_id FROM customer) c")


@query("c7_suggest_yield", """
WITH j AS (SELECT image_id % 25 AS job_id, cap FROM caps WHERE cap IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY cap) - 1 AS rn, count(*) OVER (PARTITION BY job_id) AS n, max(cap) OVER (PARTITION BY job_id) AS hi, min(cap) OVER (PARTITION BY job_id) AS lo FROM (SELECT job_id, cap FROM j UNION ALL SELECT job_id + 100, cap FROM cap_jobs) u)
SELECT job_id, cap AS allowable, CAST(ceil(cap * 1.3e0 - 1e-9) AS DOUBLE) AS yield, abs(101.0e0 - cap) <= 0.5 AS matches_typed FROM r WHERE rn = n // 2 AND hi - lo <= 0.02e0 * hi""")
def _(spark, folder):
    seen = legend.legend_cap(T.legend_arrays(spark, folder)).filter("cap IS NOT NULL").select((F.col("image_id") % 25).alias("job_id"), "cap")
    typed = T.table(spark, folder, "customer").selectExpr(
        "(c_custkey + c_nationkey % 3) % 40 + 100 AS job_id",
        "floor(100 + abs(c_acctbal) % 2) + (c_custkey % 4) * 0.25D + CASE WHEN (c_custkey + c_nationkey % 3) % 4 = 0 THEN c_custkey % 50 ELSE 0 END AS cap")
    caps = seen.unionByName(typed)
    ctx = caps.select("job_id").distinct().withColumns({"fos": F.lit(1.3), "allow": F.lit(101.0)})
    return legend.suggest_yield(caps, ctx)


@query("c8_legend_text_height", """
SELECT image_id, CASE WHEN count(h) >= 3 THEN CAST(printf('%.2f', median(h)) AS DOUBLE) END AS legend_px
FROM (SELECT image_id, CASE WHEN regexp_full_match(t, '[-+]?[0-9]+\\.[0-9]+|[0-9]{2,}') AND conf > 40 THEN y1 - y0 END AS h FROM words) a GROUP BY image_id""")
def _(spark, folder):
    return legend.legend_text_height(T.words(spark, folder))


def _crop_sql(source, pad, need):
    r = "CAST(printf('%.4f', {}) AS DOUBLE)"
    return f"""SELECT image_id, '{source}' AS kind, CASE WHEN n >= {need} THEN {r.format(f'greatest(0, a - {pad[0]}) / 640.0e0')} END AS x0, CASE WHEN n >= {need} THEN {r.format(f'greatest(0, b - {pad[1]}) / 480.0e0')} END AS y0,
  CASE WHEN n >= {need} THEN {r.format(f'least(640, c + {pad[2]}) / 640.0e0')} END AS x1, CASE WHEN n >= {need} THEN {r.format(f'least(480, d + {pad[3]}) / 480.0e0')} END AS y1
FROM (SELECT image_id, count(*) FILTER (use_{source}) AS n, min(x0) FILTER (use_{source}) AS a, min(y0) FILTER (use_{source}) AS b, max(x1) FILTER (use_{source}) AS c, max(y1) FILTER (use_{source}) AS d FROM w GROUP BY image_id) q"""


@query("c9_evidence_crop", f"""
WITH w AS (SELECT *, conf > 30 AND (regexp_full_match(t, '{NUM}') OR regexp_full_match(t, '(?i)(ma?x|mi?n)')) AS use_legend, bool_or(regexp_matches(t, '(?i)support|pressure|gravity|force|moment')) OVER (PARTITION BY image_id, line) AS use_setup FROM words)
{_crop_sql('legend', (26, 10, 8, 8), 4)} UNION ALL {_crop_sql('setup', (34, 8, 10, 8), 2)}""")
def _(spark, folder):
    words = T.words(spark, folder)
    both = [legend.evidence_crop(words, k, 640, 480).withColumn("kind", F.lit(k)) for k in ("legend", "setup")]
    return both[0].unionByName(both[1])


@query("c10_value_defaults", """
SELECT image_id, role, "max", CASE WHEN role = 'bc' THEN NULL WHEN role = 'deformation' THEN 'mm' ELSE 'MPa' END AS unit, CASE WHEN role <> 'bc' AND "max" IS NULL THEN 'low' ELSE confidence END AS confidence,
  CASE WHEN role = 'bc' THEN NULL WHEN "max" IS NULL THEN 'Could not read the Max value from the legend - please type it in.' ELSE upper(left(note, 1)) || substr(note, 2) || '.' END AS note
FROM (SELECT *, CASE image_id % 4 WHEN 0 THEN 'deformation' WHEN 1 THEN 'stress' WHEN 2 THEN 'x_other' ELSE 'bc' END AS role FROM reconciled) a""")
def _(spark, folder):
    df = chosen(spark, folder).withColumn("role", F.expr("CASE image_id % 4 WHEN 0 THEN 'deformation' WHEN 1 THEN 'stress' WHEN 2 THEN 'x_other' ELSE 'bc' END"))
    return legend.value_defaults(df.withColumn("unit", F.lit(None).cast("string"))).select("image_id", "role", "max", "unit", "confidence", "note")
