"""All messages of all jobs in one ranking."""

from pyspark.sql import functions as F

from ..operators import checks
from ..sources import testviews as T
from . import report  # noqa: F401  (the layout checks)
from .checks import checked
from .core import QUERIES, SQL, query, view

#: kind of message: queries that give them
SOURCES = {"material": ["h9_material_check"], "mesh": ["h10_mesh_check_by_job"], "layout": ["k4_layout_checks"]}

PARTS = [f"SELECT job_id, {checks.MESSAGES.index('case')} AS part, 'case' AS kind, n, seq, level, code, text, -1 AS id, '' AS family FROM all_checks",
         f"SELECT job_id, {checks.MESSAGES.index('case')}, 'case', n, seq, level, code, text, id, '' FROM ({SQL['h7_extras_exceed_main']}) a",
         f"SELECT job_id, {checks.MESSAGES.index('material')}, 'material', 0, seq, level, code, text, -1, '' FROM ({SQL['h9_material_check']}) a",
         f"SELECT job_id, {checks.MESSAGES.index('mesh')}, 'mesh', 0, seq, level, code, text, -1, '' FROM ({SQL['h10_mesh_check_by_job']}) a",
         f"SELECT job_id, {checks.MESSAGES.index('layout')}, 'layout', 0, 0, level, code, text, -1, family FROM ({SQL['k4_layout_checks']}) a",
         f"SELECT job_id, CASE code WHEN 'no_yield' THEN {checks.MESSAGES.index('hint')} ELSE {checks.MESSAGES.index('evidence')} END, CASE code WHEN 'no_yield' THEN 'hint' ELSE 'evidence' END, 0, seq, level, code, text, -1, '' FROM ({SQL['h12_missing_inputs']}) a"]
view("messages", "\nUNION ALL ".join(PARTS))


@query("h13_rank_messages", """
SELECT job_id, kind, nullif(n, 0) AS n, level, code, text,
  row_number() OVER (PARTITION BY job_id ORDER BY CASE level WHEN 'bad' THEN 0 WHEN 'warn' THEN 1 WHEN 'info' THEN 2 ELSE 3 END, part, n, seq, code, id, family) AS rank FROM messages
UNION ALL SELECT c_custkey, NULL, NULL, 'ok', 'nothing', 'Nothing unusual found.', 1 FROM customer WHERE c_custkey NOT IN (SELECT job_id FROM messages)""")
def _(spark, folder):
    found = {kind: [QUERIES[q](spark, folder) for q in names] for kind, names in SOURCES.items()}
    found["case"] = [checks.case_checks(checked(spark, folder)), QUERIES["h7_extras_exceed_main"](spark, folder)]
    missing = QUERIES["h12_missing_inputs"](spark, folder)
    found |= {"hint": [missing.filter("code = 'no_yield'")], "evidence": [missing.filter("code <> 'no_yield'")]}
    jobs = T.table(spark, folder, "customer").select(F.col("c_custkey").alias("job_id"))
    return checks.rank_messages(found, jobs)
