"""Whole chains, from pictures and what was read from them to wording and messages."""

import re

from pyspark.sql import functions as F

from ..operators import cases, checks, loads, verdict
from ..plans import chains, skew
from ..sources import testviews as T
from . import checks as case_checks, loads as setup  # noqa: F401  (their SQL)
from .cases import mains, once, originals
from .core import SQL, VIEWS, query, view
from .verdict import JUDGED, job_inputs

_OWN = r"\b(FROM|JOIN) (cases|tiered|judged|checked|all_checks|observed|bc_lines|setup_lines)\b"


def drafted(sql: str) -> str:
    """The same SQL over the tables of the chain."""
    return re.sub(_OWN, r"\1 draft_\2", sql)


# Inputs: every order is a line of a setup picture; a stress picture has one of the legends; what was typed are the values of ``cases``.
LINE = """CASE o_orderpriority WHEN '1-URGENT' THEN concat('[B] Pressure: ', CAST(o_totalprice AS {text}), CASE o_orderstatus WHEN 'P' THEN ' Pa' WHEN 'F' THEN ' kPa' ELSE ' bar' END)
    WHEN '2-HIGH' THEN concat('(C) Force: ', CAST(o_totalprice AS {text}), ' N') WHEN '3-MEDIUM' THEN concat('Moment: ', CAST(o_totalprice AS {text}), ' N-mm')
    WHEN '4-NOT SPECIFIED' THEN CASE o_orderkey % 3 WHEN 0 THEN 'Standard Earth Gravity: 9806.6 mm/s2' WHEN 1 THEN 'Standard Earth Gravity: 9.5 m/s2' ELSE 'Standard Earth Gravity: 9500.5 mm/s2' END
    ELSE '(Ay Fixed Support' END AS text"""
UNIT = "CASE WHEN role = 'stress' AND id % 19 = 0 THEN 'Pa' WHEN role = 'deformation' AND id % 23 = 0 THEN 'm' END"


def picture_lines(spark, folder):
    rows = T.table(spark, folder, "orders").selectExpr("o_orderkey % 1000 AS job_id", "o_custkey % 90 AS id", "o_orderkey AS line_no", LINE.format(text="STRING"))
    return loads.clean_lines(rows)


def picture_legends(spark, folder):
    shown = originals(spark, folder).filter("role = 'stress'").selectExpr("job_id", "id", "(job_id * 31 + id) % 500 AS image_id")
    return skew.lookup(shown, T.legend_arrays(spark, folder), ["image_id"]).filter("vals IS NOT NULL").select("job_id", "id", "vals")


def judged(spark, folder):
    def build():
        pictures = originals(spark, folder).withColumn("unit", F.expr(UNIT))
        return chains.complete_cases(pictures, picture_lines(spark, folder), picture_legends(spark, folder), T.cases(spark, folder), verdict.job_context(job_inputs(spark, folder)))
    return once(spark, folder, "judged", build)


view("draft_bc_lines", f"SELECT o_orderkey % 1000 * 1000000 + o_custkey % 90 AS case_id, o_orderkey AS line_no, {LINE.format(text='STRING')} FROM orders")
view("draft_setup_lines", drafted(VIEWS["setup_lines"]))
view("draft_heads", f"SELECT * FROM ({drafted(SQL['d4_case_headline'])}) a")
view("draft_gravity", """
SELECT case_id, arg_min(CAST(regexp_extract(text, ': ([0-9.]+)', 1) AS DOUBLE), line_no) AS gravity, arg_min(regexp_extract(text, ' ([a-z]+/s2)$', 1), line_no) AS gravity_unit
FROM draft_setup_lines WHERE text ILIKE '%gravity%' GROUP BY case_id""")
view("draft_legends", "SELECT job_id, id, pos, v FROM mains JOIN legend_arrays ON image_id = (job_id * 31 + id) % 500 WHERE role = 'stress'")
view("draft_cases", """
SELECT c.* REPLACE (coalesce(nullif(h.name, ''), c.name) AS name, coalesce(nullif(h.subtitle, ''), c.subtitle) AS subtitle, CASE WHEN c.stress_id % 19 = 0 THEN 'Pa' ELSE 'MPa' END AS stress_unit,
    CASE WHEN c.def_id % 23 = 0 THEN 'm' ELSE 'mm' END AS def_unit),
  coalesce(nullif(h.name, ''), c.name) AS short_name, g.gravity, g.gravity_unit, k.cap, coalesce(t.basis, '') AS basis, t.stress_away, coalesce(t.loc_stress, '') AS loc_stress, t.react_applied, t.react_sum
FROM rollup_cases c LEFT JOIN draft_heads h ON h.case_id = c.job_id * 1000000 + c.bc_id LEFT JOIN draft_gravity g ON g.case_id = c.job_id * 1000000 + c.bc_id
LEFT JOIN caps k ON k.image_id = (c.job_id * 31 + c.stress_id) % 500 LEFT JOIN cases t ON t.job_id = c.job_id AND t.n = c.n""")
view("draft_tiered", drafted(VIEWS["tiered"]))
view("draft_judged", drafted(VIEWS["judged"]))
view("draft_checked", "SELECT * FROM draft_judged")
view("draft_observed", drafted(VIEWS["observed"]))
view("draft_all_checks", drafted(VIEWS["all_checks"]))

READ = ("job_id", "n", "bc_id", "def_id", "stress_id", "name", "subtitle", "short_name", "gravity", "gravity_unit", "cap", "def_unit", "stress_unit", "def_max", "stress_max", "red_px")


@query("f6_case_readings", f"SELECT {', '.join(READ)} FROM draft_cases")
def _(spark, folder):
    return judged(spark, folder).select(*READ)


@query("f6_setup_items", f"""
SELECT c.job_id, c.n, c.bc_id AS id, d.line_no, d.text AS legend, d.draft AS text, d.needs_input FROM rollup_cases c JOIN ({drafted(SQL['d3_normalise_loads'])}) d ON d.case_id = c.job_id * 1000000 + c.bc_id""")
def _(spark, folder):
    items = loads.normalise_loads(cases.rows_of_main(judged(spark, folder), picture_lines(spark, folder), "bc_id"))
    return items.select("job_id", "n", "id", "line_no", F.col("text").alias("legend"), F.col("draft").alias("text"), "needs_input")


@query("f6_legend_values", "SELECT c.job_id, c.n, c.stress_id AS id, pos, v AS value FROM rollup_cases c JOIN draft_legends l ON l.job_id = c.job_id AND l.id = c.stress_id")
def _(spark, folder):
    """Whole legends go to their case and become rows there: a join moves one row per legend."""
    shown = cases.rows_of_main(judged(spark, folder), picture_legends(spark, folder), "stress_id")
    return shown.select("job_id", "n", "id", F.posexplode("vals").alias("pos", "value")).withColumn("pos", F.col("pos").cast("long"))


@query("entry_values_to_wording", f"""
WITH o AS (SELECT job_id, n, string_agg(text, ' ' ORDER BY pos) AS observations FROM draft_observed GROUP BY ALL)
SELECT {', '.join('j.' + c for c in JUDGED)}, coalesce(o.observations, '') AS observations FROM draft_judged j LEFT JOIN o ON o.job_id = j.job_id AND o.n = j.n""")
def _(spark, folder):
    df = judged(spark, folder)
    return df.select(*JUDGED, F.array_join(F.transform(verdict.observation_list(df), lambda o: o["text"]), " ").alias("observations"))


ASSUMED = "SELECT c_custkey FROM customer WHERE c_mktsegment < 'C'"
KINDS = checks.MESSAGES.index
view("draft_messages", f"""
SELECT job_id, {KINDS('hint')} AS part, 'hint' AS kind, 0 AS n, 0::BIGINT AS seq, 'info' AS level, 'no_yield' AS code, {case_checks.Q.quote(case_checks.S['no_yield'])} AS text, -1 AS id FROM job_ctx WHERE allow IS NULL
UNION ALL SELECT job_id, {KINDS('case')}, 'case', n, seq, level, code, text, -1 FROM draft_all_checks
UNION ALL SELECT job_id, {KINDS('case')}, 'case', n, seq, level, code, text, id FROM ({drafted(SQL['h7_extras_exceed_main'])}) a
UNION ALL SELECT job_id, {KINDS('material')}, 'material', 0, seq, level, code, text, -1 FROM ({SQL['h9_material_check']}) a
UNION ALL SELECT job_id, {KINDS('mesh')}, 'mesh', 0, seq, level, code, text, -1 FROM ({SQL['h10_mesh_check']}) a
UNION ALL SELECT job_id, {KINDS('evidence')}, 'evidence', 0, 99, 'info', 'no_evidence', {case_checks.Q.quote(case_checks.S['no_evidence'])}, -1 FROM draft_cases
  WHERE job_id IN (SELECT job_id FROM job_ctx) AND job_id NOT IN (SELECT job_id FROM mesh_stats) AND job_id NOT IN ({ASSUMED}) GROUP BY job_id HAVING NOT bool_or(loc_stress <> '')""")


@query("entry_values_to_checks", """
SELECT job_id, kind, nullif(n, 0) AS n, level, code, text,
  row_number() OVER (PARTITION BY job_id ORDER BY CASE level WHEN 'bad' THEN 0 WHEN 'warn' THEN 1 WHEN 'info' THEN 2 ELSE 3 END, part, n, seq, code, id) AS rank FROM draft_messages
UNION ALL SELECT c_custkey, NULL, NULL, 'ok', 'nothing', 'Nothing unusual found.', 1 FROM customer WHERE c_custkey NOT IN (SELECT job_id FROM draft_messages)""")
def _(spark, folder):
    jobs = T.table(spark, folder, "customer").selectExpr("c_custkey AS job_id", "CASE WHEN c_mktsegment < 'C' THEN c_mktsegment ELSE ' ' END AS text")
    return chains.job_messages(judged(spark, folder), cases.case_extras(mains(spark, folder)), T.materials(spark, folder), T.mesh_stats(spark, folder),
                               verdict.job_context(job_inputs(spark, folder)), jobs, jobs)
