"""Queries of the layout and report-model operators."""

from pyspark.sql import functions as F

from ..functions import exprs as X, fixed
from ..operators import cases, intake, report, verdict
from ..plans import skew
from ..sources import sinks, testviews as T
from . import sqltext as Q
from .cases import mains, once, originals, rollup_sql
from .core import query, view
from .verdict import case_table

MAIN = Q.in_list(fixed.MAIN_ROLES)


def sized_cases(spark, folder):
    """Cases of the draft, with the legend height of their main pictures."""
    px = F.when(F.col("id") % 2 == 0, 6.0 + F.col("id") % 7)
    return once(spark, folder, "sized_cases", lambda: cases.case_rollup(originals(spark, folder).withColumn("legend_px", px)))


view("sized_mains", "SELECT *, CASE WHEN id % 2 = 0 THEN 6.0e0 + id % 7 END AS px FROM mains")
view("sized_cases", rollup_sql("sized_mains", f"median(px) FILTER (role IN {MAIN})"))
view("shown", """
SELECT s.*, coalesce(case_px, job_px, 9.6e0) AS px, k, greatest(1.0e0, round_even(width * k, 0)) AS pw, greatest(1.0e0, round_even(height * k, 0)) AS ph FROM (
SELECT job_id, n, legend_px AS case_px, 'results' AS family, 'case' AS part, def_id AS id, 1 AS pos FROM sized_cases WHERE def_id IS NOT NULL AND stress_id IS NOT NULL
UNION ALL SELECT job_id, n, legend_px, 'results', 'case', stress_id, 2 FROM sized_cases WHERE def_id IS NOT NULL AND stress_id IS NOT NULL
UNION ALL SELECT job_id, n, legend_px, 'bc', 'case', bc_id, 1 FROM sized_cases WHERE bc_id IS NOT NULL
UNION ALL SELECT job_id, 0, NULL, 'geometry', 'geometry', id, position FROM geo_views UNION ALL SELECT job_id, 0, NULL, 'geometry', 'meshes', id, position FROM mesh_views
UNION ALL SELECT job_id, n, NULL, 'extras', kind, id, id FROM extras) s
JOIN (SELECT job_id, id, width, height, least(1.0e0, 2600.0e0 / greatest(width, height)) AS k FROM pictures) p USING (job_id, id)
LEFT JOIN (SELECT job_id, median(legend_px) AS job_px FROM sized_cases GROUP BY job_id) j USING (job_id)""")


def _fit(mode, family="pair"):
    w, h = fixed.BOXES[(family, mode)]
    return f"least({w}e0 / pw, {h}e0 / ph)"


def _mode(mode):
    alone = f"CASE WHEN c % 2 = 1 AND pos = last THEN {_fit('separate')} ELSE {_fit(mode)} END"
    scale = f"CASE WHEN family = 'bc' THEN {_fit(mode, 'bc')} ELSE {alone} END" if mode != "separate" else alone
    where = "" if mode != "separate" else " AND family <> 'bc'"
    slides = "c" if mode == "separate" else "(c + 1) // 2"
    return (f"SELECT job_id, family, '{mode}' AS mode, min(CAST(printf('%.1f', {scale} * k * px / 0.72e0) AS DOUBLE)) AS pt, CASE family WHEN 'bc' THEN 1 WHEN 'results' THEN {2 if mode == 'separate' else 1} "
            f"ELSE CAST(sum({slides}) FILTER (pos = last) AS BIGINT) END AS slides FROM g WHERE (family <> 'geometry' OR c >= 2){where} GROUP BY job_id, family")


view("options", f"""
SELECT * FROM (WITH g AS (SELECT *, count(*) OVER (PARTITION BY job_id, family, n, part) AS c, max(pos) OVER (PARTITION BY job_id, family, n, part) AS last FROM shown)
{' UNION ALL '.join(_mode(m) for m in fixed.LAYOUTS)}) o""")


def options(spark, folder):
    draft = originals(spark, folder)
    geo = cases.geometry_headings(draft).select("job_id", "id", "position", F.lit("geometry").alias("part"))
    mesh = cases.mesh_headings(draft).select("job_id", "id", "position", F.lit("meshes").alias("part"))
    shown = report.shown_pictures(sized_cases(spark, folder), geo.unionByName(mesh), cases.case_extras(draft), draft)
    return report.legibility(shown)


def layout_options(spark, folder):
    return once(spark, folder, "options", lambda: options(spark, folder))


@query("k1_legibility", "SELECT * FROM options")
def _(spark, folder):
    return options(spark, folder)


view("wishes", """
SELECT c_custkey AS job_id, CASE c_custkey % 4 WHEN 0 THEN 'results' WHEN 1 THEN 'geometry' WHEN 2 THEN 'bc' ELSE 'extras' END AS family, CASE c_custkey % 5 WHEN 0 THEN 'stack' WHEN 1 THEN 'separate' WHEN 2 THEN 'side' ELSE 'auto' END AS choice FROM customer""")
view("layout_plan", """
SELECT job_id, family, auto, choice, effective, CASE effective WHEN 'side' THEN a WHEN 'stack' THEN b ELSE c END AS pt, CASE auto WHEN 'side' THEN a WHEN 'stack' THEN b ELSE c END AS auto_pt, best AS best_pt, a AS side_pt, thr FROM (
SELECT *, CASE WHEN choice IN ('side', 'stack') OR (choice = 'separate' AND c IS NOT NULL) THEN choice ELSE auto END AS effective FROM (
SELECT *, CASE WHEN a >= thr - 1e-9 THEN 'side' WHEN b >= thr - 1e-9 THEN 'stack' WHEN c >= thr - 1e-9 THEN 'separate' WHEN a = best THEN 'side' WHEN b = best THEN 'stack' ELSE 'separate' END AS auto FROM (
SELECT o.job_id, o.family, coalesce(w.choice, 'auto') AS choice, a, b, c, best, CASE WHEN o.family IN ('results', 'bc') OR (o.family = 'extras' AND o.job_id IN (SELECT job_id FROM extras WHERE kind IN ('deformation', 'stress', 'other'))) THEN 5.0e0 ELSE 3.5e0 END AS thr
FROM (SELECT job_id, family, max(pt) FILTER (mode = 'side') AS a, max(pt) FILTER (mode = 'stack') AS b, max(pt) FILTER (mode = 'separate') AS c, max(pt) AS best FROM options GROUP BY ALL) o
LEFT JOIN wishes w ON w.job_id = o.job_id AND w.family = o.family) x) y) z""")


def layout_plan(spark, folder):
    wishes = T.table(spark, folder, "customer").selectExpr(
        "c_custkey AS job_id", "CASE c_custkey % 4 WHEN 0 THEN 'results' WHEN 1 THEN 'geometry' WHEN 2 THEN 'bc' ELSE 'extras' END AS family",
        "CASE c_custkey % 5 WHEN 0 THEN 'stack' WHEN 1 THEN 'separate' WHEN 2 THEN 'side' ELSE 'auto' END AS choice")
    legend_jobs = cases.case_extras(originals(spark, folder)).filter("kind IN ('deformation', 'stress', 'other')").select("job_id").distinct()
    return report.choose_mode(layout_options(spark, folder), wishes, legend_jobs)


@query("k2_choose_mode", "SELECT * FROM layout_plan")
def _(spark, folder):
    return layout_plan(spark, folder)


@query("k3_effective_layout", """
WITH j AS (SELECT job_id, max(effective) FILTER (family = 'results') AS r, max(effective) FILTER (family = 'bc') AS b FROM layout_plan GROUP BY job_id)
SELECT c.job_id, n, coalesce(CASE n % 5 WHEN 0 THEN 'stack' WHEN 2 THEN 'separate' END, r, 'side') AS effective_results, coalesce(CASE n % 4 WHEN 0 THEN 'stack' END, b, 'side') AS effective_bc
FROM sized_cases c LEFT JOIN j ON j.job_id = c.job_id""")
def _(spark, folder):
    df = sized_cases(spark, folder).withColumns({"layout": F.expr("CASE n % 5 WHEN 0 THEN 'stack' WHEN 1 THEN 'bogus' WHEN 2 THEN 'separate' END"),
                                                 "bc_layout": F.expr("CASE n % 4 WHEN 0 THEN 'stack' WHEN 1 THEN 'separate' END")})
    return report.effective_layout(df, layout_plan(spark, folder))


S = fixed.CHECK_SAY
WHAT = "CASE family " + " ".join(f"WHEN '{k}' THEN {Q.quote(v)}" for k, v in fixed.FAMILY_LABEL.items()) + " END"


@query("k4_layout_checks", f"""
SELECT job_id, family, 'warn' AS level, 'too_small' AS code, {Q.say(S['too_small'], what=WHAT, pt=Q.general('pt'), best=Q.general('best_pt'))} AS text FROM layout_plan WHERE pt < thr AND best_pt < thr
UNION ALL SELECT job_id, family, 'warn', 'better', {Q.say(S['better'], what=WHAT, pt=Q.general('pt'), mode='auto', best=Q.general('auto_pt'))} FROM layout_plan WHERE pt < thr AND best_pt >= thr
UNION ALL SELECT job_id, family, 'info', 'moved', {Q.say(S['moved'], what=WHAT, mode='effective', pt=Q.general('pt'), side=Q.general('side_pt'))} FROM layout_plan WHERE pt >= thr AND family <> 'extras' AND auto <> 'side' AND choice = 'auto'
UNION ALL SELECT job_id, family, 'warn', 'overflow', {Q.quote(S['overflow'])} FROM layout_plan WHERE family = 'bc' AND job_id % 10 = 0""")
def _(spark, folder):
    return report.layout_checks(layout_plan(spark, folder).withColumn("overflow", F.col("job_id") % 10 == 0))


@query("k5_paginate", """
SELECT job_id, n, (k - 1) // 8 + 1 AS slide, (k - 1) % 8 + 1 AS row, CASE WHEN k > 8 THEN 'Final Summary (cont.)' ELSE 'Final Summary' END AS title
FROM (SELECT job_id, n, row_number() OVER (PARTITION BY job_id ORDER BY n) AS k FROM cases) a""")
def _(spark, folder):
    return report.paginate(T.cases(spark, folder).select("job_id", "n"))


@query("k6_chunk_views", """
WITH v AS (SELECT job_id, 'geometry' AS part, id, heading, position, CASE job_id % 3 WHEN 0 THEN 'side' WHEN 1 THEN 'stack' ELSE 'separate' END AS mode FROM geo_views UNION ALL SELECT job_id, 'meshes', id, heading, position, CASE job_id % 3 WHEN 0 THEN 'side' WHEN 1 THEN 'stack' ELSE 'separate' END FROM mesh_views),
c AS (SELECT *, CASE part WHEN 'geometry' THEN '2. Duct Geometry' ELSE '3. Duct Mesh' END AS title, count(*) OVER (PARTITION BY job_id, part) AS c FROM v),
s AS (SELECT *, CASE WHEN mode = 'separate' THEN position - 1 ELSE (position - 1) // 2 END AS slide, mode = 'separate' OR (c % 2 = 1 AND position = c) AS lonely FROM c)
SELECT job_id, part, id, slide + 1 AS slide, CASE WHEN mode = 'separate' THEN 0 ELSE (position - 1) % 2 END AS place,
  CASE WHEN lonely THEN CASE WHEN c = 1 THEN title ELSE title || ' – ' || heading END WHEN slide = 0 THEN title ELSE title || ' (cont.)' END AS slide_title FROM s""")
def _(spark, folder):
    df = intake.dedup_first(T.pictures(spark, folder)).filter("role IN ('geometry', 'mesh')")
    df = skew.settle(df.select("job_id", "id", "name", "role", "z_dir"))
    geo = cases.geometry_headings(df).select("job_id", "id", "heading", "position", F.lit("geometry").alias("part"))
    mesh = cases.mesh_headings(df).select("job_id", "id", "heading", "position", F.lit("meshes").alias("part"))
    views = geo.unionByName(mesh).withColumn("mode", F.expr("CASE job_id % 3 WHEN 0 THEN 'side' WHEN 1 THEN 'stack' ELSE 'separate' END"))
    return report.chunk_views(views, F.when(F.col("part") == "geometry", F.lit("2. Duct Geometry")).otherwise(F.lit("3. Duct Mesh")))


view("job_parts", """
SELECT job_id, bool_or(role = 'geometry') AND job_id % 7 <> 0 AS has_geometry, bool_or(role = 'mesh') AND job_id % 5 <> 0 AS has_mesh, CASE WHEN job_id % 3 = 0 THEN 'Elements: 1,000' END AS mesh_line, job_id % 4 AS assumptions,
  CASE WHEN job_id % 11 = 0 THEN 0 ELSE count(DISTINCT case_no) FILTER (role IN ('bc', 'deformation', 'stress', 'x_bc', 'x_deformation', 'x_stress', 'x_other')) END AS cases, CASE WHEN job_id % 6 = 0 THEN 'frame' ELSE 'skip' END AS policy, CASE job_id % 2 WHEN 0 THEN 'duct' ELSE 'GG' END AS short
FROM mains GROUP BY job_id""")


def job_parts(spark, folder):
    """What a job has to show; some parts are taken away so that every rule is met."""
    df = mains(spark, folder).withColumn("c", F.when(cases.is_case_role(), F.col("case_no")))
    df = df.groupBy("job_id", "c").agg(F.bool_or(F.col("role") == "geometry").alias("g"), F.bool_or(F.col("role") == "mesh").alias("m"))
    df = df.groupBy("job_id").agg(F.bool_or("g").alias("g"), F.bool_or("m").alias("m"), F.count("c").alias("k"))
    return df.selectExpr("job_id", "g AND job_id % 7 <> 0 AS has_geometry", "m AND job_id % 5 <> 0 AS has_mesh", "CASE WHEN job_id % 3 = 0 THEN 'Elements: 1,000' END AS mesh_line",
                         "job_id % 4 AS assumptions", "CASE WHEN job_id % 11 = 0 THEN 0 ELSE k END AS cases", "CASE WHEN job_id % 6 = 0 THEN 'frame' ELSE 'skip' END AS policy",
                         "CASE job_id % 2 WHEN 0 THEN 'duct' ELSE 'GG' END AS short")


@query("k7_section_plan", """
WITH p AS (SELECT *, has_geometry OR policy = 'frame' AS g, has_mesh OR policy = 'frame' OR mesh_line IS NOT NULL AS m, CASE short WHEN 'duct' THEN 'Duct' ELSE short END AS label FROM job_parts),
q AS (SELECT *, 2 + g::INT AS nm, 2 + g::INT + m::INT AS na FROM p)
SELECT job_id, 1::BIGINT AS position, 'cover' AS section, CAST(NULL AS BIGINT) AS number, CAST(NULL AS VARCHAR) AS title FROM q UNION ALL SELECT job_id, 2, 'material', NULL, NULL FROM q
UNION ALL SELECT job_id, 3, 'geometry', 2, '2. ' || label || ' Geometry' FROM q WHERE g UNION ALL SELECT job_id, 4, 'mesh', nm, nm || '. ' || label || ' Mesh' FROM q WHERE m
UNION ALL SELECT job_id, 5, 'assumptions', na, na || '. Assumptions & Scope' FROM q WHERE assumptions > 0 UNION ALL SELECT job_id, 6, 'cases', NULL, NULL FROM q WHERE cases > 0
UNION ALL SELECT job_id, 7, 'summary', NULL, 'Final Summary' FROM q WHERE cases > 0""")
def _(spark, folder):
    return report.section_plan(job_parts(spark, folder))


N = fixed.NOTE_SAY
view("noted_cases", "SELECT c.job_id, n, bc_id, def_id, stress_id, CAST(n % 2 AS BIGINT) AS list_items, CASE WHEN def_max IS NULL AND stress_max IS NULL THEN 0 ELSE 3 END AS observations, policy = 'frame' AS frame FROM sized_cases c JOIN job_parts p ON p.job_id = c.job_id")


@query("k7_section_notes", f"""
SELECT job_id, NULL::BIGINT AS n, 'geometry_frame' AS code, {Q.quote(N['geometry_frame'])} AS text FROM job_parts WHERE policy = 'frame' AND NOT has_geometry
UNION ALL SELECT job_id, NULL, 'geometry_out', {Q.quote(N['geometry_out'])} FROM job_parts WHERE policy <> 'frame' AND NOT has_geometry
UNION ALL SELECT job_id, NULL, 'mesh_frame_stats', {Q.quote(N['mesh_frame_stats'])} FROM job_parts WHERE NOT has_mesh AND mesh_line IS NOT NULL
UNION ALL SELECT job_id, NULL, 'mesh_frame', {Q.quote(N['mesh_frame'])} FROM job_parts WHERE NOT has_mesh AND policy = 'frame' AND mesh_line IS NULL
UNION ALL SELECT job_id, NULL, 'mesh_out', {Q.quote(N['mesh_out'])} FROM job_parts WHERE NOT has_mesh AND policy <> 'frame' AND mesh_line IS NULL
UNION ALL SELECT job_id, NULL, 'no_cases', {Q.quote(N['no_cases'])} FROM job_parts WHERE cases = 0
UNION ALL SELECT job_id, n, 'frame', {Q.say(N['frame'], n='n', what="'Setup'")} FROM noted_cases WHERE frame AND bc_id IS NULL
UNION ALL SELECT job_id, n, 'frame', {Q.say(N['frame'], n='n', what="'Total deformation'")} FROM noted_cases WHERE frame AND def_id IS NULL
UNION ALL SELECT job_id, n, 'frame', {Q.say(N['frame'], n='n', what="'Von-Mises stress'")} FROM noted_cases WHERE frame AND stress_id IS NULL
UNION ALL SELECT job_id, n, 'setup_list_only', {Q.say(N['setup_list_only'], n='n')} FROM noted_cases WHERE NOT frame AND bc_id IS NULL AND list_items > 0
UNION ALL SELECT job_id, n, 'setup_out', {Q.say(N['setup_out'], n='n')} FROM noted_cases WHERE NOT frame AND bc_id IS NULL AND list_items = 0
UNION ALL SELECT job_id, n, 'results_out', {Q.say(N['results_out'], n='n')} FROM noted_cases WHERE NOT frame AND def_id IS NULL AND stress_id IS NULL
UNION ALL SELECT job_id, n, 'results_one', {Q.say(N['results_one'], n='n')} FROM noted_cases WHERE NOT frame AND (def_id IS NULL) <> (stress_id IS NULL)
UNION ALL SELECT job_id, n, 'no_observation', {Q.say(N['no_observation'], n='n')} FROM noted_cases WHERE observations = 0""")
def _(spark, folder):
    rows = sized_cases(spark, folder).withColumns({"list_items": F.col("n") % 2, "observations": F.when(F.col("def_max").isNull() & F.col("stress_max").isNull(), 0).otherwise(3)})
    return report.section_notes(skew.settle(job_parts(spark, folder)), rows)


@query("k8_result_slides", """
WITH c AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY job_id) > 1 THEN 'Case ' || n || ': ' ELSE '' END AS pre, n % 3 = 0 AS sep FROM sized_cases)
SELECT job_id, n, 0::BIGINT AS slide, 'both' AS kind, pre || 'Results' AS title FROM c WHERE def_id IS NOT NULL AND stress_id IS NOT NULL AND NOT sep
UNION ALL SELECT job_id, n, 0, 'deformation', pre || 'Total Deformation' FROM c WHERE def_id IS NOT NULL AND (sep OR stress_id IS NULL)
UNION ALL SELECT job_id, n, CASE WHEN def_id IS NULL THEN 0 ELSE 1 END, 'stress', pre || 'Von-Mises Stress' FROM c WHERE stress_id IS NOT NULL AND (sep OR def_id IS NULL)""")
def _(spark, folder):
    return report.result_slides(sized_cases(spark, folder).withColumn("effective_results", F.when(F.col("n") % 3 == 0, F.lit("separate")).otherwise(F.lit("side"))))


@query("k9_missing_picture_policy", " UNION ALL ".join(f"""
SELECT job_id, n, '{s}' AS slot, {c} AS picture_id, CASE WHEN {c} IS NULL THEN '{fixed.SLOT_LABEL[s]} picture not provided' END AS placeholder, CASE WHEN {c} IS NULL THEN {Q.say(N['frame'], n='n', what=Q.quote(fixed.SLOT_LABEL[s]))} END AS note
FROM sized_cases WHERE {c} IS NOT NULL OR job_id % 2 = 0""" for s, c in (("bc", "bc_id"), ("deformation", "def_id"), ("stress", "stress_id"))))
def _(spark, folder):
    df = sized_cases(spark, folder).withColumn("policy", F.when(F.col("job_id") % 2 == 0, F.lit("frame")).otherwise(F.lit("skip")))
    return report.missing_picture_policy(df)


@query("k10_material_rows", """
WITH m AS (SELECT job_id // 3 AS job_id, job_id % 3 AS row_no, material, e_text, trim(nu_text) AS nu, rho_text, job_id % 2 = 0 AS long FROM materials)
SELECT job_id, row_no, material AS c1, '[value - please confirm]' AS c2, e_text AS c3, coalesce(nullif(nu, ''), '[value - please confirm]') AS c4, rho_text AS c5, '[value - please confirm]' AS c6, CASE WHEN long THEN 'g' ELSE '[value - please confirm]' END AS c7 FROM m
UNION ALL SELECT -s_suppkey, 0, 'IS 2062', 'Duct', '191400', '0.3', '7.8E-9', '[value - please confirm]', '[value - please confirm]' FROM supplier WHERE s_suppkey > 0""")
def _(spark, folder):
    df = T.materials(spark, folder).withColumn("j", F.floor(F.col("job_id") / 3))
    bare = T.table(spark, folder, "supplier").filter("s_suppkey > 0").selectExpr("-s_suppkey AS job_id")     # jobs without a row
    rows = df.selectExpr("j AS job_id", "job_id % 3 AS row_no", "CASE WHEN job_id % 2 = 0 THEN array(material, ' ', e_text, nu_text, rho_text, '', 'g', 'h') ELSE array(material, CAST(NULL AS STRING), e_text, nu_text, rho_text) END AS cells")
    return report.material_rows(df.select(F.col("j").alias("job_id")).unionByName(bare), rows)


LIB = "[" + ", ".join(Q.quote(a) for a in fixed.ASSUMPTIONS) + "]"


@query("k11_assumption_lines", f"""
SELECT DISTINCT o_custkey AS job_id, 0::BIGINT AS part, o_orderkey % 12 AS pos, {LIB}[CAST(o_orderkey % 12 + 1 AS INT)] AS text FROM orders WHERE o_orderkey % 12 < 10
UNION ALL SELECT doc_id, 1, pos, text FROM (SELECT doc_id, generate_subscripts(t, 1) - 1 AS pos, trim(unnest(t)) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents) a) b WHERE text <> ''""")
def _(spark, folder):
    ticks = T.table(spark, folder, "orders").selectExpr("o_custkey AS job_id", "o_orderkey % 12 AS line")
    return report.assumption_lines(ticks, T.table(spark, folder, "documents").selectExpr("doc_id AS job_id", "text"))


@query("a6_write_report_model", f"""
SELECT job_id, n, 'Case – ' || name AS load_case, coalesce(nullif(cell_def, ''), '–') AS max_deformation, coalesce(nullif(cell_stress, ''), '–') AS max_stress,
  coalesce({Q.general('allow')} || ' MPa', '[value - please confirm]') AS allowable_stress, {Q.general('lim')} || ' mm' AS allowable_deformation FROM judged""")
def _(spark, folder):
    import uuid
    path = f"{skew.scratch_folder(spark)}/resultloom-model-{uuid.uuid4().hex}"
    sinks.write_report_model(path, buckets=16, summary_rows=verdict.summary_rows(case_table(spark, folder)))
    return sinks.read_report_model(spark, path, "summary_rows")
