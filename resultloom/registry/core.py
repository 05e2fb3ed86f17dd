"""Register of the queries and of the SQL that checks them."""

from __future__ import annotations

import re

QUERIES: dict = {}
SQL: dict = {}

# the same input views in SQL, for the check
VIEWS = {
    "pictures": """
SELECT job_id, id, concat('img_', CAST(id AS STRING), CASE WHEN l_partkey % 9 = 0 THEN '_section' WHEN l_partkey % 9 = 1 THEN '_zoom' ELSE '' END, '.png') AS name,
  CASE l_linenumber WHEN 1 THEN 'bc' WHEN 2 THEN 'deformation' WHEN 3 THEN 'stress' WHEN 4 THEN 'x_stress' WHEN 5 THEN 'geometry' WHEN 6 THEN 'mesh' ELSE 'x_other' END AS role,
  CASE WHEN l_suppkey % 5 = 0 OR job_id % 4 = 1 THEN NULL WHEN job_id % 4 = 0 THEN 'A' ELSE l_returnflag END AS letter,
  concat(CAST(l_partkey AS STRING), '_', p_brand, '_', replace(p_name, ' ', '_')) AS model,
  CASE WHEN l_linenumber IN (2, 3, 4, 7) AND l_suppkey % 11 <> 0 THEN l_extendedprice / 100 END AS max_value,
  CASE WHEN l_linenumber IN (5, 6) THEN CASE l_suppkey % 3 WHEN 0 THEN 'up' WHEN 1 THEN 'down' END END AS z_dir,
  CASE WHEN l_linenumber = 3 THEN l_suppkey % 12 END AS red_px,
  600 + l_suppkey * 20 AS width, CAST(400 + l_linenumber * 90 AS BIGINT) AS height,
  l_linestatus = 'O' AND l_quantity > 45 AS user_set,
  md5(concat(CAST(l_partkey % 400 AS STRING), '|', CAST(l_linenumber AS STRING))) AS hash
FROM (SELECT l_orderkey % 1000 AS job_id, row_number() OVER (PARTITION BY l_orderkey % 1000 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_tax, l_discount) - 1 AS id, l.* FROM lineitem l) x
JOIN part ON p_partkey = l_partkey""",
    "legend_lines": """
SELECT user_id AS image_id, event_id % 2 AS pass, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY ts, event_id) AS line_no,
  CASE event_type WHEN 'signup' THEN concat('me ', CAST(value AS STRING), ' Max') WHEN 'error' THEN concat(CAST(value AS STRING), ' Min')
    WHEN 'click' THEN concat('| ', CAST(value AS STRING)) WHEN 'view' THEN concat('junk text ', CAST(value AS STRING)) ELSE 'A: Static Structural' END AS text
FROM events""",
    "header_lines": """
SELECT doc_id AS image_id, line_no, CASE line_no WHEN 1 THEN concat(CASE doc_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE '' END, ': ', CAST(doc_id AS STRING), '_', source, '_', lang, ' x')
  WHEN 2 THEN CASE doc_id % 5 WHEN 0 THEN 'Total Deformation' WHEN 1 THEN 'Equivalent Stress' WHEN 2 THEN 'Maximum Principal Stress' WHEN 3 THEN 'Static Structural' ELSE 'Holiday photo' END
  WHEN 3 THEN CASE doc_id % 5 WHEN 0 THEN 'Type: Total Deformation' WHEN 1 THEN 'Type: Equivalent (von-Mises) Stress' WHEN 2 THEN 'Type: Maximum Principal Stress' ELSE 'Time: 1. s' END
  ELSE CASE doc_id % 5 WHEN 0 THEN 'Unit: mm' WHEN 1 THEN 'Unit: MPa' ELSE 'no unit' END END AS text
FROM documents CROSS JOIN (SELECT CAST(i AS BIGINT) AS line_no FROM range(1, 5) t(i)) n
UNION ALL SELECT doc_id, 4 + generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1), unnest(string_split(coalesce(text, ''), chr(10))) FROM documents""",
    "bc_lines": """
SELECT o_custkey AS case_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS line_no,
  CASE o_orderpriority WHEN '1-URGENT' THEN concat('[B] Pressure: ', CAST(o_totalprice AS STRING), CASE o_orderstatus WHEN 'P' THEN ' Pa' WHEN 'F' THEN ' kPa' ELSE ' bar' END)
    WHEN '2-HIGH' THEN concat('(C) Force: ', CAST(o_totalprice AS STRING), ' N') WHEN '3-MEDIUM' THEN concat('Moment: ', CAST(o_totalprice AS STRING), ' N-mm')
    WHEN '4-NOT SPECIFIED' THEN 'Standard Earth Gravity: 9806.6 mm/s2' ELSE '(Ay Fixed Support' END AS text
FROM orders""",
    "cases": """
SELECT o_custkey AS job_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_orderkey AS case_key,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice / 500 END AS stress_max, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice / 100000 END AS def_max,
  CASE WHEN o_orderkey % 19 = 0 THEN 'Pa' ELSE 'MPa' END AS stress_unit, CASE WHEN o_orderkey % 23 = 0 THEN 'm' ELSE 'mm' END AS def_unit,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'singularity' WHEN '2-HIGH' THEN 'refine' WHEN '3-MEDIUM' THEN 'asis' ELSE '' END AS basis,
  CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice / 2000 END AS stress_away, CASE WHEN o_orderkey % 7 = 0 THEN 'the left shaft' ELSE '' END AS loc_stress,
  CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice END AS react_applied, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice * (1 + (o_orderkey % 9 - 4) / 100.0e0) END AS react_sum,
  9806.65e0 * (1 + (o_orderkey % 5 - 2) / 125.0e0) AS gravity, concat('Case ', CAST(o_orderkey % 6 AS STRING)) AS name
FROM orders""",
    "materials": """
SELECT p_partkey AS job_id, p_brand AS material, CASE p_partkey % 4 WHEN 0 THEN '191400' WHEN 1 THEN '200' WHEN 2 THEN '1e9' ELSE 'n/a' END AS e_text,
  CASE p_partkey % 3 WHEN 0 THEN '0,3' WHEN 1 THEN ' 0.5 ' ELSE '' END AS nu_text, CASE p_partkey % 5 WHEN 0 THEN '7.8E-9' WHEN 1 THEN '7850' WHEN 2 THEN '7.85E-6' WHEN 3 THEN '1.5d' ELSE '1E-3' END AS rho_text,
  CAST(p_retailprice / 4 AS DOUBLE) AS yield_mpa, CASE WHEN p_size < 5 THEN 0.9e0 ELSE 1.3e0 END AS fos
FROM part""",
    "mesh_stats": """
SELECT s_suppkey AS job_id, (s_suppkey % 100) / 100.0e0 AS skew_max, (s_suppkey % 60) / 100.0e0 AS skew_avg, (s_suppkey % 40) / 200.0e0 AS oq_min, s_suppkey * 1000 AS elements FROM supplier""",
    "words": """
SELECT user_id AS image_id, event_id AS word_id, CASE event_type WHEN 'signup' THEN CAST(value AS STRING) WHEN 'error' THEN 'Max' WHEN 'click' THEN CAST(value AS STRING) WHEN 'view' THEN 'Support' ELSE 'xx' END AS t,
  value AS x0, value + 30 AS x1, (event_id % 400) * 1.0e0 AS y0, (event_id % 400) + 8 + (event_id % 7) * 0.5e0 AS y1, event_id % 100 AS conf, event_id % 12 AS line FROM events""",
    "ocr_calls": """
SELECT user_id AS image_id, event_id AS call_no, value / 20 AS seconds FROM events""",
    "assignments": """
SELECT o_orderkey % 1000 AS job_id, o_custkey % 90 AS id, min(CASE o_orderstatus WHEN 'P' THEN 'stress' WHEN 'F' THEN 'x_other' ELSE 'unused' END) AS role, min(CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 4 + 1 END) AS case_no
FROM orders GROUP BY o_orderkey % 1000, o_custkey % 90""",
    "state_events": """
SELECT user_id AS sid, event_id AS seq, ts AS saved_at, concat(event_type, '|', props) AS payload, substr(sha1(concat('2.2|', event_type, '|', props)), 1, 12) AS build_key FROM events""",
    "history": """
SELECT role AS hist_key, conv_id * 100 + turn AS seq, CASE WHEN turn = 1 THEN '[value - please confirm]' ELSE concat('  Client ', CAST(conv_id % 60 AS STRING), ' ') END AS entry FROM conversations""",
    "legend_arrays": """
SELECT vec_id AS image_id, pos, CASE WHEN vec_id % 4 = 0 AND pos = 3 THEN v * 100 ELSE v END AS v FROM (SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY e DESC, p) - 1 AS pos, floor((CAST(e AS DOUBLE) + 1) * 1000) / 10 AS v
FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS p, unnest(embedding) AS e FROM embeddings) a) b""",
    "pixels": """
SELECT vec_id AS image_id, p // 8 AS y, p % 8 AS x, floor(abs(CAST(e AS DOUBLE)) * 100000) % 256 AS r, floor(abs(CAST(e AS DOUBLE)) * 733331) % 256 AS g, floor(abs(CAST(e AS DOUBLE)) * 5299709) % 256 AS b
FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS p, unnest(embedding) AS e FROM embeddings) a""",
}


def view(name: str, body: str) -> None:
    """A further SQL view that later checks build on."""
    VIEWS[name] = body


def _needed(body: str, seen: list) -> list:
    for name in VIEWS:
        if name not in seen and re.search(rf"\b{name}\b", body):
            _needed(VIEWS[name], seen)
            if name not in seen:
                seen.append(name)
    return seen


def query(name: str, sql: str | None = None):
    """Registers a query and the SQL that checks it."""
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql.strip()
        return fn
    return register


def full_sql(body: str) -> str:
    """The check with the input views it names put in front."""
    views = _needed(body, [])
    if not views:
        return body
    front = "WITH " + ",\n".join(f"{v} AS ({VIEWS[v]})" for v in views)
    if body.startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + front[5:] + ",\n" + body[15:]
    return front + ",\n" + body[5:] if body.startswith("WITH ") else front + "\n" + body
