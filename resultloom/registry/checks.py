"""Queries of the checks."""

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import cases, checks, legend, verdict
from ..plans import skew
from ..sources import testviews as T
from . import sqltext as Q
from .cases import originals
from .sources import settings
from .core import query, view
from .verdict import case_table, job_limits

S = fixed.CHECK_SAY
view("checked", """
SELECT j.*, CAST(case_key % 12 AS BIGINT) AS red_px, CASE case_key % 10 WHEN 0 THEN 192.3e0 ELSE cap END AS cap, CASE WHEN case_key % 3 = 0 THEN 'm/s2' ELSE 'mm/s2' END AS gravity_unit FROM (SELECT * REPLACE (CASE WHEN case_key % 3 = 0 THEN gravity / 1000 ELSE gravity END AS gravity) FROM judged) j LEFT JOIN caps ON image_id = case_key % 500""")


def checked(spark, folder):
    """Cases with limits, verdict, red pixels and the cap of their legend."""
    caps = legend.legend_cap(T.legend_arrays(spark, folder)).select(F.col("image_id").alias("cap_id"), "cap")
    # the caps first: the lookup writes its input, and the texts of a verdict are made only where a check reads them
    df = skew.lookup(case_table(spark, folder).withColumn("cap_id", F.col("case_key") % 500), caps, ["cap_id"])
    df = verdict.verdict(df).withColumn("cap", F.when(F.col("case_key") % 10 == 0, F.lit(192.3)).otherwise(F.col("cap")))
    metres = F.col("case_key") % 3 == 0
    return df.withColumns({"red_px": F.col("case_key") % 12, "gravity_unit": F.when(metres, F.lit("m/s2")).otherwise(F.lit("mm/s2")), "gravity": F.when(metres, F.col("gravity") / 1000).otherwise(F.col("gravity"))})


def row(seq, level, code, cond, text):
    return f"SELECT job_id, n, {seq}::BIGINT AS seq, '{level}' AS level, '{code}' AS code, {text} AS text FROM checked WHERE {cond}"


G = Q.general
OVER = "stress_max IS NOT NULL AND allow IS NOT NULL AND tier <> 'pass'"
BASIS = "CASE basis " + " ".join(f"WHEN '{k}' THEN {Q.quote(v)}" for k, v in fixed.BASIS_TEXT.items()) + " END"
H1 = [row(1, "warn", "stress_unit", "lower(stress_unit) <> 'mpa'", Q.say(S["stress_unit"], n="n", u="stress_unit")),
      row(2, "warn", "def_unit", "lower(def_unit) <> 'mm'", Q.say(S["def_unit"], n="n", u="def_unit"))]
H2 = [row(3, "warn", "gravity_mm", "gravity_unit = 'mm/s2' AND abs(gravity - 9806.65e0) > 98.0665e0", Q.say(S["gravity_mm"], n="n", v=G("gravity"), u="gravity_unit")),
      row(3, "warn", "gravity_m", "gravity_unit = 'm/s2' AND abs(gravity - 9.80665e0) > 0.0980665e0", Q.say(S["gravity_m"], n="n", v=G("gravity"), u="gravity_unit"))]
H3 = [row(4, "ok", "pass", "tier = 'pass'", Q.say(S["pass"], n="n", s=G("stress_max"), allow=G("allow"), util=Q.dec("stress_max / allow * 100", 0))),
      row(4, "bad", "exceeds", "tier = 'exceeds'", Q.say(S["exceeds"], n="n", s=G("stress_max"), allow=G("allow"), times=Q.dec("stress_max / allow", 1))),
      row(4, "bad", "beyond_yield", "tier = 'beyond_yield'", Q.say(S["beyond_yield"], n="n", s=G("stress_max"), sy=G("sy"), times=Q.dec("stress_max / sy", 1))),
      row(4, "info", "suspect_set", "tier = 'suspect' AND basis <> ''", Q.say(S["suspect_set"], n="n", s=G("stress_max"), times=Q.dec("stress_max / sy", 0), basis=BASIS)),
      row(4, "bad", "suspect", "tier = 'suspect' AND basis = ''", Q.say(S["suspect"], n="n", s=G("stress_max"), times=Q.dec("stress_max / sy", 0))),
      row(5, "warn", "away_above_yield", "tier = 'suspect' AND basis = 'singularity' AND stress_away > sy", Q.say(S["away_above_yield"], n="n", away="stress_away"))]
H5 = [row(6, "warn", "no_red", OVER + " AND red_px < 5 AND basis = ''", Q.say(S["no_red"], n="n"))]
H4 = [row(7, "warn", "no_cap", OVER + " AND cap IS NULL", Q.say(S["no_cap"], n="n", allow=G("allow"))),
      row(7, "warn", "cap_off", OVER + " AND abs(cap - allow) > greatest(0.02e0 * allow, 0.5e0)", Q.say(S["cap_off"], n="n", cap=G("cap"), allow=G("allow"))),
      row(7, "ok", "cap_ok", OVER + " AND abs(cap - allow) <= greatest(0.02e0 * allow, 0.5e0)", Q.say(S["cap_ok"], n="n", cap=G("cap")))]
H6 = [row(8, "bad", "def_limit", "stress_max IS NOT NULL AND allow IS NOT NULL AND def_fail", Q.say(S["def_limit"], n="n", d=G("def_max"), lim=G("lim")))]
DIFF = "(abs(react_sum - react_applied) / abs(react_applied) * 100)"
RP = dict(n="n", rs=Q.grouped("react_sum"), ra=Q.grouped("react_applied"), diff=Q.dec(DIFF, 1))
H8 = [row(10, "warn", "reaction_bad", f"stress_max IS NOT NULL AND allow IS NOT NULL AND react_applied <> 0 AND {DIFF} > 2", Q.say(S["reaction_bad"], **RP)),
      row(10, "ok", "reaction_ok", f"stress_max IS NOT NULL AND allow IS NOT NULL AND react_applied <> 0 AND {DIFF} <= 2", Q.say(S["reaction_ok"], **RP))]
for key, name, rows, rules in (("h1", "unit_check", H1, checks.unit_rules), ("h2", "gravity_check", H2, checks.gravity_rules), ("h3", "tier_check", H3, checks.tier_rules),
                               ("h4", "legend_vs_allowable", H4, checks.legend_rules), ("h5", "red_zone_check", H5, checks.red_zone_rules),
                               ("h6", "deformation_limit_check", H6, checks.deformation_rules), ("h8", "reaction_balance", H8, checks.reaction_rules)):
    query(f"{key}_{name}", "\nUNION ALL ".join(rows))(lambda spark, folder, rules=rules: checks.emit(checks.with_check_texts(checked(spark, folder)), rules()))
view("all_checks", "\nUNION ALL ".join(H1 + H2 + H3 + H5 + H4 + H6 + H8))


@query("h7_extras_exceed_main", f"""
SELECT job_id, n, id, 9::BIGINT AS seq, 'warn' AS level, 'extra' AS code, {Q.say(S['extra'], n='n', kind='kind', heading='heading', m=G('max_value'), main=G('main'))} AS text FROM (
SELECT e.*, CASE kind WHEN 'stress' THEN stress_max ELSE def_max END AS main, stress_max, allow FROM extras e JOIN judged j USING (job_id, n) WHERE kind IN ('stress', 'deformation')) a
WHERE stress_max IS NOT NULL AND allow IS NOT NULL AND max_value > main * 1.001e0""")
def _(spark, folder):
    return checks.extras_exceed_main(case_table(spark, folder), cases.case_extras(originals(spark, folder)))


@query("h9_material_check", f"""
WITH m AS (SELECT job_id, fos, TRY_CAST(CASE WHEN e_text <> 'n/a' THEN e_text END AS DOUBLE) AS e, TRY_CAST(nullif(trim(replace(nu_text, ',', '.')), '') AS DOUBLE) AS nu, CASE WHEN rho_text NOT LIKE '%d' THEN TRY_CAST(rho_text AS DOUBLE) END AS rho FROM materials)
SELECT job_id, 1::BIGINT AS seq, 'warn' AS level, 'fos' AS code, {Q.say(S['fos'], v=G('fos'))} AS text FROM m WHERE fos < 1
UNION ALL SELECT job_id, 2, 'warn', 'rho_kg_m3', {Q.say(S['rho_kg_m3'], v=G('rho'))} FROM m WHERE rho >= 100
UNION ALL SELECT job_id, 2, 'warn', 'rho_kg_mm3', {Q.say(S['rho_kg_mm3'], v=G('rho'))} FROM m WHERE rho >= 1e-7 AND rho <= 1e-4
UNION ALL SELECT job_id, 2, 'warn', 'rho_range', {Q.say(S['rho_range'], v=G('rho'))} FROM m WHERE rho < 100 AND NOT (rho >= 1e-7 AND rho <= 1e-4) AND NOT (rho >= 5e-10 AND rho <= 5e-8)
UNION ALL SELECT job_id, 3, 'warn', 'e_low', {Q.say(S['e_low'], v=G('e'))} FROM m WHERE e < 1000
UNION ALL SELECT job_id, 3, 'warn', 'e_high', {Q.say(S['e_high'], v=G('e'))} FROM m WHERE e > 2e6
UNION ALL SELECT job_id, 4, 'warn', 'nu', {Q.say(S['nu'], v=G('nu'))} FROM m WHERE NOT (nu >= 0 AND nu < 0.5e0)""")
def _(spark, folder):
    return checks.material_checks(T.materials(spark, folder))


@query("h10_mesh_check", f"""
SELECT job_id, 1::BIGINT AS seq, 'warn' AS level, 'skew_bad' AS code, {Q.say(S['skew_bad'], v=G('skew_max'), lim="'0.9'")} AS text FROM mesh_stats WHERE skew_max >= 0.9e0
UNION ALL SELECT job_id, 1, 'info', 'skew_poor', {Q.say(S['skew_poor'], v=G('skew_max'), lo="'0.75'", lim="'0.9'")} FROM mesh_stats WHERE skew_max >= 0.75e0 AND skew_max < 0.9e0
UNION ALL SELECT job_id, 2, 'info', 'skew_avg', {Q.say(S['skew_avg'], v=G('skew_avg'), lim="'0.5'")} FROM mesh_stats WHERE skew_avg > 0.5e0
UNION ALL SELECT job_id, 3, 'warn', 'oq', {Q.say(S['oq'], v=G('oq_min'), lim="'0.1'")} FROM mesh_stats WHERE oq_min < 0.1e0""")
def _(spark, folder):
    return checks.mesh_checks(T.mesh_stats(spark, folder))


@query("h10_mesh_check_by_job", f"""
WITH m AS (SELECT * FROM mesh_stats JOIN job_settings USING (job_id))
SELECT job_id, 1::BIGINT AS seq, 'warn' AS level, 'skew_bad' AS code, {Q.say(S['skew_bad'], v=G('skew_max'), lim=G('skew_max_warn'))} AS text FROM m WHERE skew_max >= skew_max_warn
UNION ALL SELECT job_id, 1, 'info', 'skew_poor', {Q.say(S['skew_poor'], v=G('skew_max'), lo=G('skew_max_info'), lim=G('skew_max_warn'))} FROM m WHERE skew_max >= skew_max_info AND skew_max < skew_max_warn
UNION ALL SELECT job_id, 2, 'info', 'skew_avg', {Q.say(S['skew_avg'], v=G('skew_avg'), lim=G('skew_avg_info'))} FROM m WHERE skew_avg > skew_avg_info
UNION ALL SELECT job_id, 3, 'warn', 'oq', {Q.say(S['oq'], v=G('oq_min'), lim=G('oq_min_warn'))} FROM m WHERE oq_min < oq_min_warn""")
def _(spark, folder):
    """The limits are those of each job's own settings."""
    return checks.mesh_checks(T.mesh_stats(spark, folder).join(settings(spark, folder).select("job_id", "settings"), "job_id"))


@query("h11_duplicate_case_names", f"""
SELECT DISTINCT job_id, 'warn' AS level, 'same_name' AS code, {Q.quote(S['same_name'])} AS text FROM (SELECT job_id FROM cases GROUP BY job_id, lower(trim(name)) HAVING count(*) > 1) a""")
def _(spark, folder):
    return checks.duplicate_case_names(T.cases(spark, folder))


@query("h12_missing_inputs", f"""
SELECT job_id, 0::BIGINT AS seq, 'info' AS level, 'no_yield' AS code, {Q.quote(S['no_yield'])} AS text FROM job_ctx WHERE allow IS NULL
UNION ALL SELECT job_id, 99, 'info', 'no_evidence', {Q.quote(S['no_evidence'])} FROM cases WHERE job_id NOT IN (SELECT job_id FROM mesh_stats)
  AND job_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment < 'C') GROUP BY job_id HAVING NOT bool_or(loc_stress <> '' OR case_key % 11 = 0)""")
def _(spark, folder):
    ctx = job_limits(spark, folder)
    assumed = T.table(spark, folder, "customer").selectExpr("c_custkey AS job_id", "CASE WHEN c_mktsegment < 'C' THEN c_mktsegment ELSE ' ' END AS text")
    typed = T.cases(spark, folder).withColumn("loc_def", F.expr("CASE WHEN case_key % 11 = 0 THEN 'the right bearing' ELSE ' ' END"))
    return checks.missing_inputs(ctx, typed, verdict.mesh_line(T.mesh_stats(spark, folder)), assumed)


@query("h13_rank_checks", f"""
SELECT job_id, n, level, code, text, row_number() OVER (PARTITION BY job_id ORDER BY CASE level WHEN 'bad' THEN 0 WHEN 'warn' THEN 1 WHEN 'info' THEN 2 ELSE 3 END, n, seq, code) AS rank FROM all_checks
UNION ALL SELECT job_id, NULL, 'ok', 'nothing', 'Nothing unusual found.', 1 FROM job_ctx WHERE job_id NOT IN (SELECT job_id FROM all_checks)""")
def _(spark, folder):
    jobs = T.table(spark, folder, "customer").select(F.col("c_custkey").alias("job_id"))
    return checks.rank_checks(checks.case_checks(checked(spark, folder)), jobs)


def fields(spark, folder):
    """Fields of the page in long form: one row per field of a case."""
    items = ["struct('casename' AS need, CASE WHEN case_key % 31 = 0 THEN ' ' ELSE name END AS value)", "struct('num' AS need, CASE WHEN case_key % 8 = 0 THEN 'n/a' ELSE CAST(stress_max AS STRING) END AS value)",
             "struct('optnum' AS need, CASE WHEN case_key % 9 = 0 THEN '1,5x' ELSE CAST(stress_away AS STRING) END AS value)", "struct('bracketOpt' AS need, CASE WHEN case_key % 5 = 0 THEN '[location - please confirm]' ELSE loc_stress END AS value)",
             "struct('bracket' AS need, loc_stress AS value)", "struct('req' AS need, basis AS value)", "struct('title' AS need, CASE WHEN case_key % 6 = 0 THEN 'Analysis Of' ELSE name END AS value)",
             "struct('role' AS need, CASE WHEN case_key % 10 = 0 THEN 'unknown' ELSE 'stress' END AS value)", "struct('basis' AS need, CASE WHEN case_key % 11 = 0 THEN '1' ELSE '0' END AS value)"]
    df = T.cases(spark, folder).selectExpr("job_id", f"explode(array({', '.join(items)})) AS f")
    return df.select("job_id", "f.need", "f.value")


@query("h14_completeness_audit", """
WITH c AS (SELECT *, CASE WHEN case_key % 31 = 0 THEN '' ELSE name END AS nm FROM cases), u AS (SELECT *, count(*) OVER (PARTITION BY job_id, lower(nm)) AS same FROM c),
f AS (SELECT job_id, 'casename' AS need, nm = '' OR same > 1 AS bad FROM u UNION ALL SELECT job_id, 'num', case_key % 8 = 0 OR stress_max IS NULL FROM c UNION ALL SELECT job_id, 'optnum', case_key % 9 = 0 FROM c
UNION ALL SELECT job_id, 'bracketOpt', case_key % 5 = 0 FROM c UNION ALL SELECT job_id, 'bracket', loc_stress = '' FROM c UNION ALL SELECT job_id, 'req', basis = '' FROM c UNION ALL SELECT job_id, 'title', case_key % 6 = 0 FROM c
UNION ALL SELECT job_id, 'role', case_key % 10 = 0 FROM c UNION ALL SELECT job_id, 'basis', case_key % 11 = 0 FROM c)
SELECT job_id, need, count(*) AS items, count(*) FILTER (bad) AS open_items FROM f GROUP BY job_id, need""")
def _(spark, folder):
    return checks.completeness_audit(fields(spark, folder))


@query("h15_placeholder_scan", """
WITH f AS (SELECT job_id, n, pos, regexp_extract_all(text, '(?i)\\[[^\\[\\]]*(?:please confirm|not entered)[^\\[\\]]*\\]') AS f FROM observed)
SELECT job_id, n, pos, len(f) AS tokens, generate_subscripts(f, 1) - 1 AS k, unnest(f) AS token FROM f WHERE len(f) > 0""")
def _(spark, folder):
    return checks.placeholder_scan(verdict.observations(case_table(spark, folder)).drop("code"))
