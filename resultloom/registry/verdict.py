"""Queries of the verdict operators."""

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import cases, verdict
from ..sources import testviews as T
from . import sqltext as Q
from .cases import once
from .core import query, view


@query("g1_allowable", """
SELECT job_id, coalesce(g, f) AS allow, coalesce(gs, fs) AS sy FROM (
SELECT job_id, max(a) FILTER (row_no = gov) AS g, max(sy) FILTER (row_no = gov) AS gs, max(a) FILTER (row_no = 0) AS f, max(sy) FILTER (row_no = 0) AS fs FROM (
SELECT job_id // 4 AS job_id, job_id % 4 AS row_no, (job_id // 4) % 6 AS gov, yield_mpa AS sy, floor(yield_mpa / fos + 1e-9) AS a FROM materials) a GROUP BY job_id) b""")
def _(spark, folder):
    rows = T.materials(spark, folder).selectExpr("floor(job_id / 4) AS job_id", "job_id % 4 AS row_no", "yield_mpa AS yield_value", "fos")
    return verdict.allowable(rows.withColumn("gov", F.col("job_id") % 6), None)


def job_inputs(spark, folder):
    """Typed limits of a job, with decimal commas, blanks and junk."""
    return T.table(spark, folder, "customer").selectExpr(
        "c_custkey AS job_id", "CASE c_custkey % 20 WHEN 3 THEN 'n/a' WHEN 4 THEN '-5' WHEN 5 THEN '192,5' ELSE ' 192 ' END AS allowable",
        "CASE c_custkey % 30 WHEN 7 THEN '' ELSE '250' END AS yield", "CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN '0' ELSE '1.3' END AS fos",
        "CASE c_custkey % 3 WHEN 0 THEN '  ' WHEN 1 THEN ' duct ' ELSE 'GG' END AS short", "CASE c_custkey % 2 WHEN 0 THEN true END AS show_utilisation",
        "CASE c_custkey % 3 WHEN 1 THEN '3,5' ELSE '' END AS def_limit")


view("job_ctx", """
SELECT c_custkey AS job_id, CASE c_custkey % 20 WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN 192.5e0 ELSE 192.0e0 END AS allow, CASE c_custkey % 30 WHEN 7 THEN NULL ELSE 250.0e0 END AS sy, 1.3e0 AS fos,
  CASE c_custkey % 3 WHEN 0 THEN 'structure' WHEN 1 THEN 'duct' ELSE 'GG' END AS short, true AS show_util, CASE c_custkey % 3 WHEN 1 THEN 3.5e0 END AS lim, 2.0e0 AS k FROM customer""")


@query("g2_job_context", "SELECT * FROM job_ctx")
def _(spark, folder):
    return verdict.job_context(job_inputs(spark, folder))


def job_limits(spark, folder):
    """Written, so that Spark does not derive a filter on the key of other tables from what a limit is computed from: it would parse the limits again for each of their rows."""
    return once(spark, folder, "job_limits", lambda: verdict.with_limit_texts(verdict.job_context(job_inputs(spark, folder))), dear=True)


def case_table(spark, folder):
    """Cases with the limits of their job; the numbered cases are written once for all queries."""
    return verdict.with_context(once(spark, folder, "cases", lambda: T.cases(spark, folder)), job_limits(spark, folder))


view("tiered", """
SELECT c.* EXCLUDE (basis), x.* EXCLUDE (job_id), tier, CASE WHEN tier IN ('exceeds', 'beyond_yield', 'suspect') THEN basis ELSE '' END AS basis FROM (
SELECT *, CASE WHEN s IS NULL OR a IS NULL THEN NULL WHEN s <= a THEN 'pass' WHEN y IS NULL OR s <= y THEN 'exceeds' WHEN s < 2 * y THEN 'beyond_yield' ELSE 'suspect' END AS tier
FROM (SELECT c.*, stress_max AS s, x.allow AS a, x.sy AS y FROM cases c LEFT JOIN job_ctx x ON x.job_id = c.job_id) t) c LEFT JOIN job_ctx x ON x.job_id = c.job_id""")


@query("g3_tier", "SELECT job_id, n, tier FROM tiered")
def _(spark, folder):
    return verdict.tier(case_table(spark, folder)).select("job_id", "n", "tier")


@query("g4_resolve_basis", "SELECT job_id, n, tier, basis, coalesce(tier = 'suspect' AND basis = '', false) AS needs_basis FROM tiered")
def _(spark, folder):
    return verdict.resolve_basis(case_table(spark, folder)).select("job_id", "n", "tier", "basis", "needs_basis")


C, ALLOW = fixed.CAPTION, Q.general("allow")
view("judged", f"""
SELECT *, tier <> 'pass' AS exceeds, CASE WHEN tier = 'pass' THEN stress_max / allow * 100 END AS util,
  CASE WHEN def_max IS NULL THEN '' WHEN def_fail THEN 'Exceeding Limit' ELSE {Q.mm('def_max')} || ' mm' END AS cell_def,
  CASE how WHEN 'none' THEN '' WHEN 'neutral' THEN {Q.mpa('stress_max')} || ' MPa' WHEN 'pass' THEN {Q.mpa('stress_max')} || ' MPa' WHEN 'sing?' THEN '[value - please confirm]' WHEN 'sing+' THEN {Q.mpa('stress_away')} || ' MPa (away from local peak)'
    WHEN 'refine' THEN 'Under review' ELSE 'Exceeding Limit' END AS cell_stress,
  CASE WHEN how IN ('none', 'neutral', 'sing?', 'sing+') OR (how = 'pass' AND NOT def_fail) THEN '' WHEN how = 'refine' THEN 'Model refinement required.' ELSE 'Need to take corrective actions.' END AS conclusion,
  CASE WHEN how IN ('none', 'neutral', 'refine') THEN NULL WHEN how IN ('pass', 'sing+') THEN NOT def_fail ELSE false END AS adequate,
  CASE WHEN def_max IS NULL THEN '' ELSE {Q.say(C['def'], d=Q.mm('def_max'))} END AS deformation_caption,
  CASE how WHEN 'none' THEN '' WHEN 'neutral' THEN {Q.say(C['neutral'], s=Q.mpa('stress_max'))} WHEN 'pass' THEN {Q.say(C['within'], allow=ALLOW)} WHEN 'sing?' THEN {Q.quote(C['away_none'])} WHEN 'sing+' THEN {Q.say(C['away_ok'], allow=ALLOW)}
    WHEN 'sing-' THEN {Q.say(C['away_bad'], allow=ALLOW)} WHEN 'refine' THEN {Q.quote(C['refine'])} ELSE {Q.say(C['over'], allow=ALLOW)} END AS stress_caption
FROM (SELECT *, coalesce(tier = 'suspect' AND basis = '', false) AS needs_basis, coalesce(def_max > lim, false) AS def_fail,
  CASE WHEN stress_max IS NULL THEN 'none' WHEN allow IS NULL THEN 'neutral' WHEN tier = 'pass' THEN 'pass' WHEN basis = 'singularity' THEN CASE WHEN stress_away IS NULL THEN 'sing?' WHEN stress_away <= allow THEN 'sing+' ELSE 'sing-' END
    WHEN basis = 'refine' THEN 'refine' ELSE 'over' END AS how FROM tiered) a""")
JUDGED = ("job_id", "n", "tier", "basis", "needs_basis", "exceeds", "util", "def_fail", "cell_def", "cell_stress", "conclusion", "adequate", "deformation_caption", "stress_caption")


@query("g5_verdict", f"SELECT {', '.join(JUDGED)} FROM judged")
def _(spark, folder):
    return verdict.verdict(case_table(spark, folder)).select(*JUDGED)


Y = fixed.SAY
TEXTS = {
    "deformation": f"CASE WHEN lim IS NULL THEN {Q.say(Y['def'], obj='short', d=Q.mm('def_max'))} WHEN def_max > lim THEN {Q.say(Y['def_exceeds'], obj='short', d=Q.mm('def_max'), lim=Q.general('lim'))} ELSE {Q.say(Y['def_within'], obj='short', d=Q.mm('def_max'), lim=Q.general('lim'))} END",
    "stress": f"""CASE how WHEN 'neutral' THEN {Q.say(Y['neutral'], obj='short', s=Q.mpa('stress_max'))} WHEN 'pass' THEN {Q.say(Y['within_util'], obj='short', s=Q.mpa('stress_max'), allow=ALLOW, util="CASE WHEN util < 10 THEN printf('%.1f', util) ELSE printf('%.0f', util) END")}
      WHEN 'sing?' THEN {Q.say(Y['sing'], s=Q.mpa('stress_max'), loc=Q.quote(fixed.WHERE))} WHEN 'sing+' THEN {Q.say(Y['sing'], s=Q.mpa('stress_max'), loc=Q.quote(fixed.WHERE))} WHEN 'sing-' THEN {Q.say(Y['sing'], s=Q.mpa('stress_max'), loc=Q.quote(fixed.WHERE))}
      WHEN 'refine' THEN {Q.say(Y['refine'], s=Q.mpa('stress_max'), times=Q.dec('stress_max / allow', 1), allow=ALLOW, loc=Q.quote(fixed.WHERE))} WHEN 'over' THEN {Q.say(Y['over'], obj='short', allow=ALLOW)} END""",
    "stress_location": f"CASE WHEN how IN ('neutral', 'pass', 'over') AND loc_stress <> '' THEN {Q.say(Y['stress_loc'], loc='loc_stress')} END",
    "middle": f"""CASE WHEN how = 'sing?' THEN {Q.quote(Y['away_none'])} WHEN how = 'sing+' THEN {Q.say(Y['away_ok'], away=Q.mpa('stress_away'), allow=ALLOW)} WHEN how = 'sing-' THEN {Q.say(Y['away_bad'], away=Q.mpa('stress_away'), allow=ALLOW)}
      WHEN how = 'over' AND tier <> 'exceeds' THEN {Q.say(Y['above_yield'], s=Q.mpa('stress_max'), sy=Q.general('sy'))} END""",
    "reaction": f"CASE WHEN how NOT IN ('none', 'neutral') AND react_applied <> 0 THEN {Q.say(Y['reaction'], rs=Q.grouped('react_sum'), ra=Q.grouped('react_applied'), diff=Q.dec('abs(react_sum - react_applied) / abs(react_applied) * 100', 1))} END",
    "closing": f"""CASE how WHEN 'neutral' THEN {Q.quote(Y['neutral_close'])} WHEN 'pass' THEN CASE WHEN def_fail THEN {Q.say(Y['close_def'], obj='short')} ELSE {Q.say(Y['close_ok'], obj='short')} END WHEN 'sing?' THEN {Q.quote(Y['away_none_close'])}
      WHEN 'sing+' THEN {Q.say(Y['away_ok_close'], obj='short')} WHEN 'refine' THEN {Q.quote(Y['refine_close'])} WHEN 'none' THEN NULL ELSE {Q.say(Y['close_bad'], obj='short')} END""",
}
view("observed", "SELECT job_id, n, row_number() OVER (PARTITION BY job_id, n ORDER BY o) - 1 AS pos, code, text FROM (\n" + "\nUNION ALL ".join(
    f"SELECT job_id, n, {i} AS o, '{code}' AS code, {text} AS text FROM judged" for i, (code, text) in enumerate(TEXTS.items())) + ") a WHERE text IS NOT NULL")


@query("g6_observations", "SELECT * FROM observed")
def _(spark, folder):
    return verdict.observations(case_table(spark, folder))


@query("g7_summary_rows", f"""
SELECT job_id, n, 'Case – ' || name AS load_case, coalesce(nullif(cell_def, ''), '–') AS max_deformation, coalesce(nullif(cell_stress, ''), '–') AS max_stress,
  coalesce({ALLOW} || ' MPa', '[value - please confirm]') AS allowable_stress, {Q.general('lim')} || ' mm' AS allowable_deformation FROM judged""")
def _(spark, folder):
    return verdict.summary_rows(case_table(spark, folder))


@query("g8_override_texts", """
WITH o AS (SELECT job_id, n, string_agg(text, ' ' ORDER BY pos) AS observations FROM observed GROUP BY ALL)
SELECT j.job_id, j.n, CASE WHEN case_key % 5 = 0 THEN 'Typed caption' ELSE stress_caption END AS stress_caption, CASE WHEN case_key % 7 = 0 THEN '' ELSE conclusion END AS conclusion, deformation_caption,
  CASE WHEN case_key % 6 = 1 THEN 'first second' ELSE coalesce(observations, '') END AS observations FROM judged j LEFT JOIN o ON o.job_id = j.job_id AND o.n = j.n""")
def _(spark, folder):
    df = verdict.verdict(case_table(spark, folder))
    df = df.withColumn("observations", F.transform(verdict.observation_list(df), lambda o: o["text"]))
    edits = T.cases(spark, folder).selectExpr(
        "job_id", "n", "CAST(NULL AS STRING) AS deformation_caption", "CASE WHEN case_key % 5 = 0 THEN ' Typed caption ' END AS stress_caption",
        "CASE case_key % 6 WHEN 1 THEN array(' first', '', 'second ') WHEN 2 THEN array(' ') WHEN 3 THEN CAST(array() AS ARRAY<STRING>) END AS observations",
        "CASE WHEN case_key % 7 = 0 THEN '' END AS conclusion")
    df = verdict.override_texts(df.select("job_id", "n", "deformation_caption", "stress_caption", "observations", "conclusion"), edits)
    return df.withColumn("observations", F.array_join("observations", " "))


@query("g9_mesh_stats_line", f"""
SELECT job_id, concat_ws('  |  ', 'Elements: ' || format('{{:,}}', CAST(elements AS BIGINT)), 'Avg. skewness ' || printf('%.2f', skew_avg), 'Max. skewness ' || printf('%.2f', skew_max), 'Min. orthogonal quality ' || printf('%.2f', oq_min)) AS mesh_line FROM mesh_stats""")
def _(spark, folder):
    return verdict.mesh_line(T.mesh_stats(spark, folder))
