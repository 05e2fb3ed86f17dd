"""Queries of the column expressions."""

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..sources import testviews as T
from . import sqltext as Q
from .core import query

STRICT = "^[-+]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][-+]?[0-9]+)?$"


def _num(c):
    t = f"trim(replace({c}, ',', '.'))"
    return f"CASE WHEN regexp_matches({t}, '{STRICT}') THEN CAST({t} AS DOUBLE) END"


@query("j1_to_float", f"""
SELECT job_id, {_num('e_text')} AS e, {_num('nu_text')} AS nu, {_num('rho_text')} AS rho, {_num('nu_text')} AS page_nu, {_num('rho_text')} AS page_rho FROM materials""")
def _(spark, folder):
    return T.materials(spark, folder).select("job_id", X.to_float("e_text").alias("e"), X.to_float("nu_text").alias("nu"), X.to_float("rho_text").alias("rho"),
                                             X.page_num("nu_text").alias("page_nu"), X.page_num("rho_text").alias("page_rho"))


@query("j2_cleaning", """
SELECT doc_id, md5(c) AS collapsed, md5(rtrim(c, '.')) AS cleaned, left(trim(regexp_replace(regexp_replace(text, '[^A-Za-z0-9 ()/.+\\-]', '', 'g'), '\\s+', ' ', 'g'), ' -.'), 60) AS kind
FROM (SELECT doc_id, text, trim(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) AS c FROM documents) a""")
def _(spark, folder):
    df = T.table(spark, folder, "documents")
    return df.select("doc_id", F.md5(X.collapse_ws("text").cast("binary")).alias("collapsed"), F.md5(X.clean("text").cast("binary")).alias("cleaned"), X.clean_kind("text").alias("kind"))


@query("j3_number_text", f"""
SELECT case_key, {Q.mm('def_max')} AS mm, CASE WHEN def_max >= 1 THEN printf('%.0f', def_max) ELSE printf('%.2f', def_max) END AS mm_plain, {Q.mpa('stress_max')} AS mpa FROM cases""")
def _(spark, folder):
    return T.cases(spark, folder).select("case_key", X.mm_text("def_max").alias("mm"), X.mm_text("def_max", "sample").alias("mm_plain"), X.mpa_text("stress_max").alias("mpa"))


@query("j4_sig", """
SELECT case_key, CASE WHEN react_applied >= 999.5 THEN printf('%.0f', CAST(printf('%.3g', react_applied) AS DOUBLE)) ELSE printf('%.3g', react_applied) END AS applied, printf('%.3g', def_max) AS deformation,
  CASE WHEN stress_max >= 999.5 THEN printf('%.0f', CAST(printf('%.3g', stress_max) AS DOUBLE)) ELSE printf('%.3g', stress_max) END AS stress FROM cases""")
def _(spark, folder):
    return T.cases(spark, folder).select("case_key", X.sig_text("react_applied").alias("applied"), X.sig_text("def_max").alias("deformation"), X.sig_text("stress_max").alias("stress"))


@query("j5_slug", "SELECT page_id, 'FEA_Report_' || coalesce(nullif(trim(regexp_replace(url, '[^A-Za-z0-9._-]+', '-', 'g'), '-'), ''), 'report') AS slug FROM pages")
def _(spark, folder):
    return T.table(spark, folder, "pages").select("page_id", X.slug("url").alias("slug"))


@query("j6_model_prefix", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, trim(regexp_replace(lower(a), '[_\\s]+', ' ', 'g')) AS model, len(list_filter(range(1, least(len(a), len(b)) + 1), lambda k: left(a, k) = left(b, k))) AS shared
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey || '__Model ' || l_suppkey AS a, l_orderkey || '__Model ' || l_suppkey AS b FROM lineitem) x""")
def _(spark, folder):
    df = T.table(spark, folder, "lineitem").selectExpr("l_orderkey", "CAST(l_linenumber AS BIGINT) AS l_linenumber", "l_partkey", "l_suppkey",
                                                       "concat(l_partkey, '__Model ', l_suppkey) AS a", "concat(l_orderkey, '__Model ', l_suppkey) AS b")
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", X.norm_model("a").alias("model"), X.common_prefix("a", "b").alias("shared"))


@query("j7_ordinal_date", """
SELECT o_orderkey, d || CASE WHEN d BETWEEN 10 AND 20 THEN 'th' WHEN d % 10 = 1 THEN 'st' WHEN d % 10 = 2 THEN 'nd' WHEN d % 10 = 3 THEN 'rd' ELSE 'th' END || ' ' ||
  ['Jan', 'Feb', 'Mar', 'Apr', 'May', 'June', 'July', 'Aug', 'Sept', 'Oct', 'Nov', 'Dec'][month(o_orderdate)] || ' ' || year(o_orderdate) AS text FROM (SELECT o_orderkey, o_orderdate, day(o_orderdate) AS d FROM orders) a""")
def _(spark, folder):
    return T.table(spark, folder, "orders").select("o_orderkey", X.ordinal_date("o_orderdate").alias("text"))


@query("j8_safe_text", """
SELECT doc_id, md5(t) AS safe, CASE WHEN len(t) <= 400 THEN t ELSE regexp_replace(left(t, 400), '\\s+$', '') || '...' END AS short
FROM (SELECT doc_id, regexp_replace(text || chr(7) || 'x' || chr(27) || chr(9) || 'y', '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x{FFFE}\\x{FFFF}]', '', 'g') AS t FROM documents) a""")
def _(spark, folder):
    df = T.table(spark, folder, "documents").select("doc_id", F.concat("text", F.char(F.lit(7)), F.lit("x"), F.char(F.lit(27)), F.char(F.lit(9)), F.lit("y")).alias("t"))
    df = X.xml_safe_all(df)
    return df.select("doc_id", F.md5(F.col("t").cast("binary")).alias("safe"), X.shorten("t").alias("short"))


@query("j9_glue_units", """
SELECT job_id, n, pos, regexp_replace(text, '([0-9]) ((?:mm|cm|m|MPa|GPa|kPa|Pa|N|kN|kg|t|mmWC|Hz|s|rpm|°C|%)(?:[^A-Za-z]|$))', '\\1' || chr(160) || '\\2', 'g') AS text FROM observed""")
def _(spark, folder):
    from ..operators import verdict
    from .verdict import case_table
    return verdict.observations(case_table(spark, folder)).select("job_id", "n", "pos", X.glue_units("text").alias("text"))


@query("j10_object_label", """
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE upper(left(p_name, 1)) || substr(p_name, 2) END AS label FROM part""")
def _(spark, folder):
    name = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    return T.table(spark, folder, "part").select("p_partkey", X.object_label(name).alias("label"))


@query("j11_ago", """
SELECT event_id, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || ' min ago' WHEN m < 1440 THEN CAST(floor(m / 60.0e0 + 0.5) AS BIGINT) || ' h ago' ELSE CAST(floor(m / 1440.0e0 + 0.5) AS BIGINT) || ' days ago' END AS age
FROM (SELECT event_id, greatest(0, CAST(floor((epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts)) / 60e6 + 0.5) AS BIGINT)) AS m FROM events) a""")
def _(spark, folder):
    events = T.table(spark, folder, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return events.select("event_id", X.ago(F.lit("2024-01-31 00:00:00").cast("timestamp"), "ts").alias("age"))


def _letters(k: str) -> str:
    """The name of a list item, place by place from the highest."""
    firsts = [(26 ** (place + 1) - 1) // 25 for place in range(13, -1, -1)]
    return " || ".join(f"CASE WHEN {k} >= {a} THEN chr(CAST(65 + (({k} - {a}) // {26 ** (13 - i)}) % 26 AS INT)) ELSE '' END" for i, a in enumerate(firsts))


@query("j12_list_letter", f"SELECT o_orderkey, {_letters('k')} AS letter FROM (SELECT o_orderkey, (o_orderkey - 3) * o_orderkey * o_custkey AS k FROM orders) a")
def _(spark, folder):
    key = F.col("o_orderkey").cast("decimal(20,0)")    # the product of three keys goes beyond a long
    return T.table(spark, folder, "orders").select("o_orderkey", X.list_letter((key - 3) * key * F.col("o_custkey")).alias("letter"))
