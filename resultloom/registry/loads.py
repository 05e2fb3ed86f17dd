"""Queries of the setup-list operators."""

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import loads
from ..sources import testviews as T
from . import sqltext as Q
from .core import query, view

view("setup_lines", r"""
SELECT case_id, line_no, text FROM (
SELECT case_id, line_no, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')),
  '^[\(\[\{]\s*[A-Za-z]{1,2}\s*[\)\]\}]?\s+', ''), '^\s*[A-Za-z]{0,2}[\]\)\}\|]\s*', ''), '\s+[A-Za-z]?[\]\}]$', ''), '^[^A-Za-z]+', ''), '\s+[''`"|,.;:]+$', '') AS text FROM bc_lines) a
WHERE regexp_matches(text, '(?i)support|pressure|gravity|force|moment|displacement|load|temperature|fixed') AND NOT regexp_matches(text, '(?i)^(static|transient|time)\b')""")


def lines(spark, folder):
    return loads.clean_lines(T.bc_lines(spark, folder))


@query("d1_clean_bc_lines", "SELECT * FROM setup_lines")
def _(spark, folder):
    return lines(spark, folder)


@query("d2_best_bc_region", """
WITH c AS (SELECT case_id // 3 AS image_id, case_id % 3 AS ordinal, line_no, text FROM setup_lines),
b AS (SELECT image_id, ordinal, row_number() OVER (PARTITION BY image_id ORDER BY k DESC, ordinal) AS rn FROM (SELECT image_id, ordinal, count(*) AS k FROM c GROUP BY image_id, ordinal) q)
SELECT c.image_id, c.ordinal, c.line_no, c.text FROM c JOIN b ON b.image_id = c.image_id AND b.ordinal = c.ordinal AND rn = 1""")
def _(spark, folder):
    df = lines(spark, folder).selectExpr("floor(case_id / 3) AS image_id", "case_id % 3 AS ordinal", "line_no", "text")
    return loads.best_region(df)


S = fixed.SETUP_SAY
MPA = "(value * CASE unit WHEN 'Pa' THEN 1e-6 WHEN 'kPa' THEN 1e-3 WHEN 'bar' THEN 0.1e0 ELSE 1.0e0 END)"


@query("d3_normalise_loads", f"""
WITH v AS (SELECT case_id, line_no, text, TRY_CAST(nullif(regexp_extract(text, '^[^:]*:\\s*([-+]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][-+]?[0-9]+)?)\\s*(.*)$', 1), '') AS DOUBLE) AS value,
  trim(regexp_extract(text, '^[^:]*:\\s*([-+]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][-+]?[0-9]+)?)\\s*(.*)$', 2)) AS unit FROM setup_lines),
k AS (SELECT *, CASE WHEN text ILIKE '%gravity%' THEN 'gravity' WHEN text ILIKE '%pressure%' AND value IS NOT NULL THEN 'pressure' WHEN text ILIKE '%moment%' THEN 'moment' WHEN text ILIKE '%force%' AND value IS NOT NULL THEN 'force'
  WHEN text ILIKE '%fixed%' THEN 'fixed' ELSE 'other' END AS load_type FROM v),
s AS (SELECT *, CASE load_type WHEN 'pressure' THEN {MPA} WHEN 'moment' THEN value * 1.0e0 WHEN 'force' THEN value * 1.0e0 END AS value_si FROM k),
m AS (SELECT *, value_si * 1e6 / 9.80665e0 AS mm FROM s)
SELECT case_id, line_no, text, value, unit, load_type, value_si, load_type NOT IN ('gravity', 'pressure') AS needs_input,
  CASE load_type WHEN 'gravity' THEN {Q.quote(S['gravity'])} WHEN 'pressure' THEN {Q.say(S['pressure'], mm="CASE WHEN abs(mm - round_even(mm, 0)) < 0.002e0 * mm THEN printf('%.0f', mm) ELSE printf('%.2f', mm) END",
    mpa="CASE WHEN value_si >= 999.5 THEN printf('%.0f', CAST(printf('%.3g', value_si) AS DOUBLE)) ELSE printf('%.3g', value_si) END")}
  WHEN 'moment' THEN {Q.say(S['moment'], v=Q.grouped('value_si'), nm=Q.general('value_si / 1000'))} WHEN 'force' THEN {Q.say(S['force'], v=Q.grouped('value_si'))}
  WHEN 'fixed' THEN {Q.quote(S['fixed'])} ELSE {Q.say(S['other'], line='text')} END AS draft FROM m""")
def _(spark, folder):
    return loads.normalise_loads(lines(spark, folder))


@query("d4_case_headline", """
WITH l AS (SELECT case_id, CASE WHEN text ILIKE '%pressure%' THEN 'Pressure' WHEN text ILIKE '%moment%' THEN 'Moment' WHEN text ILIKE '%force%' THEN 'Force' END AS k, text ILIKE '%gravity%' AS own, line_no FROM setup_lines),
f AS (SELECT case_id, k, min(line_no) AS first_at FROM l WHERE k IS NOT NULL GROUP BY ALL),
g AS (SELECT case_id, string_agg(k, ' + ' ORDER BY first_at) AS loads, count(*) AS c FROM f GROUP BY case_id),
o AS (SELECT case_id, bool_or(own) AS own FROM l GROUP BY case_id)
SELECT case_id, CASE WHEN loads IS NULL THEN '' WHEN c = 1 THEN loads || ' Only' ELSE loads END AS name,
  CASE WHEN loads IS NULL THEN '' ELSE '(' || CASE WHEN own THEN 'Self Weight + ' ELSE '' END || loads || ')' END AS subtitle FROM o LEFT JOIN g USING (case_id)""")
def _(spark, folder):
    return loads.case_headline(lines(spark, folder))


@query("d5_gravity_of", """
SELECT case_id, max(9806.6e0) FILTER (text ILIKE '%gravity%') AS gravity, max('mm/s2') FILTER (text ILIKE '%gravity%') AS gravity_unit FROM setup_lines GROUP BY case_id""")
def _(spark, folder):
    return loads.gravity_of(lines(spark, folder))
