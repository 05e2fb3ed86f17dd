"""Queries of the load-case operators, and the flagship."""

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import cases, intake
from ..plans import skew
from ..sources import testviews as T
from . import sqltext as Q
from .core import query, view

CASE = Q.in_list(fixed.CASE_ROLES)
MAIN = Q.in_list(fixed.MAIN_ROLES)
EXTRA = Q.in_list(fixed.EXTRA_ROLES)


SHOWN = ("name", "max_value", "z_dir", "red_px", "width", "height", "user_set")   # further columns of a picture that queries of the draft read


def deduped(spark, folder, *more):
    """Only with the columns that are asked for: every step behind writes and shuffles whole rows."""
    pictures = T.pictures(spark, folder).select("job_id", "id", "hash", "role", "letter", *more)
    return intake.dedup_first(pictures).drop("hash")


_tables: dict = {}


def once(spark, folder, name, build, dear=False):
    """A table that several queries start from, written once per application."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _tables:
        _tables[key] = skew.settle(build(), dear)
    return _tables[key]


def sorted_out(spark, folder):
    """The pictures of the draft and their groups of same content, written once; the copies are looked up where they are read."""
    key = (spark.sparkContext.applicationId, folder, "sorted out")
    if key not in _tables:
        kept, groups = intake.same_content(T.pictures(spark, folder).select("job_id", "id", "hash", "role", "letter", "model", *SHOWN))
        _tables[key] = kept, skew.settle(groups)
    return _tables[key]


def originals(spark, folder):
    """The draft of all jobs without the copies of other pictures: a report shows none of them."""
    return once(spark, folder, "originals", lambda: cases.draft_steps(skew.settle(intake.without_copies(*sorted_out(spark, folder)).drop("hash"), dear=True), *cases.DRAFT), dear=True)


def mains(spark, folder):
    """The draft of all jobs."""
    copies = once(spark, folder, "copies", lambda: intake.mark_copies(*sorted_out(spark, folder)).drop("hash").filter("dup_of IS NOT NULL"))
    return cases.beside(originals(spark, folder), copies, *cases.DRAFT)


view("lettered", f"""
SELECT *, CASE WHEN NOT cr THEN NULL WHEN letter IS NOT NULL THEN letter WHEN lo IS NULL THEN '' WHEN lo = hi THEN lo END AS group_letter
FROM (SELECT *, role IN {CASE} AS cr, min(letter) FILTER (role IN {CASE}) OVER (PARTITION BY job_id) AS lo, max(letter) FILTER (role IN {CASE}) OVER (PARTITION BY job_id) AS hi FROM deduped) a""")


@query("f1_group_by_letter", "SELECT job_id, id, role, letter, group_letter FROM lettered")
def _(spark, folder):
    return cases.draft_steps(deduped(spark, folder), *cases.DRAFT[:1]).select("job_id", "id", "role", "letter", "group_letter")


view("projected", """
SELECT l.*, CASE WHEN l.role = 'bc' AND s.c > 1 THEN l.nm ELSE b.m END AS sub_model, CASE WHEN l.role = 'bc' AND s.c > 1 THEN l.id ELSE b.i END AS sub_id
FROM (SELECT *, trim(regexp_replace(lower(coalesce(model, '')), '[_\\s]+', ' ', 'g')) AS nm FROM lettered) l
LEFT JOIN (SELECT job_id, group_letter, count(*) AS c FROM lettered WHERE role = 'bc' AND group_letter IS NOT NULL GROUP BY ALL) s ON s.job_id = l.job_id AND s.group_letter = l.group_letter
LEFT JOIN (
  SELECT job_id, id, m, i FROM (
    SELECT x.job_id, x.id, y.nm AS m, y.id AS i, row_number() OVER (PARTITION BY x.job_id, x.id ORDER BY
      len(list_filter(range(1, least(len(x.nm), len(y.nm)) + 1), lambda k: left(x.nm, k) = left(y.nm, k))) DESC, y.nm, y.id) AS rn
    FROM (SELECT job_id, id, group_letter, trim(regexp_replace(lower(coalesce(model, '')), '[_\\s]+', ' ', 'g')) AS nm FROM lettered WHERE role <> 'bc' AND group_letter IS NOT NULL) x
    JOIN (SELECT *, count(*) OVER (PARTITION BY job_id, group_letter) AS c FROM (SELECT job_id, id, group_letter, trim(regexp_replace(lower(coalesce(model, '')), '[_\\s]+', ' ', 'g')) AS nm FROM lettered WHERE role = 'bc' AND group_letter IS NOT NULL) q) y
      ON x.job_id = y.job_id AND x.group_letter = y.group_letter AND y.c > 1) z WHERE rn = 1) b ON b.job_id = l.job_id AND b.id = l.id""")


@query("f2_split_projects", "SELECT job_id, id, role, group_letter, sub_model, sub_id FROM projected")
def _(spark, folder):
    return cases.draft_steps(deduped(spark, folder, "model"), *cases.DRAFT[:2]).select("job_id", "id", "role", "group_letter", "sub_model", "sub_id")


view("numbered", """
SELECT *, CASE WHEN group_letter IS NOT NULL THEN dense_rank() OVER (PARTITION BY job_id, group_letter IS NULL ORDER BY group_letter, coalesce(sub_model, ''), coalesce(sub_id, -1)) END AS case_no FROM projected""")


@query("f3_number_cases", "SELECT job_id, id, group_letter, sub_id, case_no FROM numbered")
def _(spark, folder):
    return cases.draft_steps(deduped(spark, folder, "model"), *cases.DRAFT[:3]).select("job_id", "id", "group_letter", "sub_id", "case_no")


view("mains", f"""
SELECT * REPLACE (CASE WHEN cand AND id <> win THEN 'x_' || role ELSE role END AS role), cand AND id <> win AS auto_extra, CASE WHEN cand THEN win END AS main_id FROM (
SELECT *, role IN {MAIN} AND case_no IS NOT NULL AS cand,
  first_value(id) OVER (PARTITION BY job_id, case_no, role ORDER BY NOT user_set, CASE WHEN role = 'bc' THEN 0 ELSE -coalesce(max_value, 0) END, id) AS win FROM numbered) a""")


@query("f4_pick_main", "SELECT job_id, id, case_no, role, auto_extra, main_id FROM mains")
def _(spark, folder):
    df = cases.draft_steps(deduped(spark, folder, "model", "max_value", "user_set"), *cases.DRAFT)
    return df.select("job_id", "id", "case_no", "role", "auto_extra", "main_id")


view("extras", f"""
SELECT job_id, case_no AS n, id, substr(role, 3) AS kind, CASE {Q.hint('name')} WHEN 'section' THEN 'Section view {fixed.WHERE}' WHEN 'detail' THEN 'Detail view {fixed.WHERE}'
  ELSE 'Additional view [describe - please confirm]' END AS heading, max_value, CASE WHEN id % 7 <> 0 THEN CASE role WHEN 'x_deformation' THEN 'mm' WHEN 'x_stress' THEN 'MPa' END END AS unit, auto_extra AS auto FROM mains WHERE role IN {EXTRA} AND case_no IS NOT NULL""")


@query("f5_case_extras", "SELECT * FROM extras")
def _(spark, folder):
    unit = F.expr("CASE WHEN id % 7 <> 0 THEN CASE role WHEN 'x_deformation' THEN 'mm' WHEN 'x_stress' THEN 'MPa' END END")
    return cases.case_extras(originals(spark, folder).withColumn("unit", unit))


def rollup_sql(source, px="CAST(NULL AS DOUBLE)"):
    def slot(col, role):
        return f"max({col}) FILTER (role = '{role}')"
    first = "CASE WHEN {bc} IS NOT NULL THEN {b} WHEN {df} IS NOT NULL THEN {d} ELSE {s} END"
    parts = dict(bc=slot("id", "bc"), df=slot("id", "deformation"))
    letter = first.format(b=slot("letter", "bc"), d=slot("letter", "deformation"), s=slot("letter", "stress"), **parts)
    model = first.format(b=slot("model", "bc"), d=slot("model", "deformation"), s=slot("model", "stress"), **parts)
    return f"""
SELECT job_id, case_no AS n, {slot('id', 'bc')} AS bc_id, {slot('id', 'deformation')} AS def_id, {slot('id', 'stress')} AS stress_id, 'Load Case ' || case_no AS name,
  '(Self Weight + Pressure)' AS subtitle, 'mm' AS def_unit, 'MPa' AS stress_unit, {slot('max_value', 'deformation')} AS def_max, {slot('max_value', 'stress')} AS stress_max,
  {slot('red_px', 'stress')} AS red_px, {px} AS legend_px, {letter} AS letter, {model} AS model
FROM {source} WHERE role IN {CASE} AND case_no IS NOT NULL GROUP BY job_id, case_no"""


view("rollup_cases", rollup_sql("mains"))


@query("f6_case_rollup", "SELECT * FROM rollup_cases")
def _(spark, folder):
    return cases.case_rollup(originals(spark, folder))


view("corrected", f"""
SELECT m.* REPLACE (coalesce(user_set OR CASE WHEN a.role IS NOT NULL THEN a.role <> m.role OR nc IS DISTINCT FROM m.case_no ELSE false END, false) AS user_set,
  coalesce(a.role, m.role) AS role, CASE WHEN a.role IS NOT NULL THEN nc ELSE m.case_no END AS case_no)
FROM mains m LEFT JOIN LATERAL (SELECT role, CASE WHEN role IN {CASE} THEN coalesce(x.case_no, nullif(m.case_no, 0), 1) END AS nc FROM assignments x WHERE x.job_id = m.job_id AND x.id = m.id) a ON true""")


def corrected(spark, folder):
    return cases.apply_corrections(mains(spark, folder), T.assignments(spark, folder))


@query("f7_apply_corrections", "SELECT job_id, id, role, case_no, user_set FROM corrected")
def _(spark, folder):
    return corrected(spark, folder).select("job_id", "id", "role", "case_no", "user_set")


ROLLED = ("job_id", "id", "role", "case_no", "letter", "model", "max_value", "red_px", "user_set")   # what a change of the cases reads


view("corrected_mains", f"""
SELECT * REPLACE (CASE WHEN cand2 AND id <> win2 THEN 'x_' || role ELSE role END AS role) FROM (
SELECT *, role IN {MAIN} AND case_no IS NOT NULL AS cand2,
  first_value(id) OVER (PARTITION BY job_id, case_no, role ORDER BY NOT user_set, CASE WHEN role = 'bc' THEN 0 ELSE -coalesce(max_value, 0) END, id) AS win2 FROM corrected) a""")
view("corrected_cases", rollup_sql("corrected_mains"))


@query("f8_merge_user_edits", """
SELECT c.job_id, c.n, c.bc_id, c.def_id, c.stress_id, CASE WHEN o.n IS NOT NULL AND o.bc_id IS NOT DISTINCT FROM c.bc_id THEN 'Typed ' || o.n ELSE c.name END AS name, c.subtitle, c.def_unit, c.stress_unit,
  CASE WHEN o.n IS NOT NULL AND o.def_id IS NOT DISTINCT FROM c.def_id THEN o.def_max + 1 ELSE c.def_max END AS def_max,
  CASE WHEN o.n IS NOT NULL AND o.stress_id IS NOT DISTINCT FROM c.stress_id THEN o.stress_max ELSE c.stress_max END AS stress_max, c.red_px, c.legend_px, c.letter, c.model
FROM corrected_cases c LEFT JOIN rollup_cases o ON o.job_id = c.job_id AND o.n = c.n""")
def _(spark, folder):
    before = mains(spark, folder).select(*ROLLED)
    old = cases.case_rollup(before).withColumn("name", F.concat(F.lit("Typed "), F.col("n").cast("string"))).withColumn("def_max", F.col("def_max") + 1)
    new = cases.case_rollup(cases.pick_main(cases.apply_corrections(before, T.assignments(spark, folder))))
    return cases.merge_case_edits(old, new)


view("corrected_extras", f"""
SELECT job_id, case_no AS n, id, substr(role, 3) AS kind, CASE {Q.hint('name')} WHEN 'section' THEN 'Section view {fixed.WHERE}' WHEN 'detail' THEN 'Detail view {fixed.WHERE}'
  ELSE 'Additional view [describe - please confirm]' END AS heading FROM corrected_mains WHERE role IN {EXTRA} AND case_no IS NOT NULL""")


@query("f8_merge_extra_edits", """
SELECT c.job_id, c.n, c.id, c.kind, CASE WHEN o.id IS NOT NULL THEN 'Typed ' || o.id ELSE c.heading END AS heading, CASE WHEN o.id IS NOT NULL THEN 'caption' ELSE '' END AS caption
FROM corrected_extras c LEFT JOIN (SELECT * FROM extras WHERE id % 3 <> 0) o ON o.job_id = c.job_id AND o.n = c.n AND o.id = c.id""")
def _(spark, folder):
    """Extras of a case: headings and captions typed before the change stay with the pictures that are still extras of the same case."""
    before = mains(spark, folder).select("job_id", "id", "name", "role", "case_no", "max_value", "user_set")
    typed = cases.case_extras(before).filter("id % 3 <> 0").withColumn("heading", F.concat(F.lit("Typed "), F.col("id").cast("string"))).withColumn("caption", F.lit("caption"))
    after = cases.case_extras(cases.pick_main(cases.apply_corrections(before, T.assignments(spark, folder))))
    return cases.merge_view_edits(typed, after.select("job_id", "n", "id", "kind", "heading"), ("job_id", "n", "id"))


# Setup lines: two to four are read from a setup picture; the user's list moves them to the end, lacks the second one in every third case, and has a line more in every second one.
READ_LINES = "SELECT job_id, n, k AS line_no, 'load ' || k || ' of picture ' || bc_id AS text FROM {0}, range(1, 5) g(k) WHERE bc_id IS NOT NULL AND k <= 2 + bc_id % 3"
view("typed_lines", f"""
SELECT job_id, n, 10 - line_no AS line_no, 'typed ' || text AS text FROM ({READ_LINES.format('rollup_cases')}) a WHERE line_no <> 2 OR n % 3 <> 0
UNION ALL SELECT job_id, n, 20, 'one more' FROM rollup_cases WHERE n % 2 = 0""")


def read_lines(table):
    lines = table.filter("bc_id IS NOT NULL").selectExpr("job_id", "n", "bc_id", "explode(sequence(1L, 2 + bc_id % 3)) AS line_no")
    return lines.selectExpr("job_id", "n", "line_no", "concat('load ', line_no, ' of picture ', bc_id) AS text")


@query("f8_merge_setup_lines", f"""
WITH same AS (SELECT c.job_id, c.n FROM corrected_cases c JOIN rollup_cases o ON o.job_id = c.job_id AND o.n = c.n AND o.bc_id IS NOT DISTINCT FROM c.bc_id)
SELECT * FROM typed_lines WHERE (job_id, n) IN (SELECT (job_id, n) FROM same)
UNION ALL SELECT * FROM ({READ_LINES.format('corrected_cases')}) a WHERE (job_id, n) NOT IN (SELECT (job_id, n) FROM same)""")
def _(spark, folder):
    before = mains(spark, folder).select(*ROLLED)
    old = cases.case_rollup(before)
    typed = read_lines(old).filter("line_no <> 2 OR n % 3 <> 0").selectExpr("job_id", "n", "10 - line_no AS line_no", "concat('typed ', text) AS text")
    typed = typed.unionByName(old.filter("n % 2 = 0").selectExpr("job_id", "n", "20L AS line_no", "'one more' AS text"))
    new = skew.settle(cases.case_rollup(cases.pick_main(cases.apply_corrections(before, T.assignments(spark, folder)))))
    return cases.merge_setup_lines(old, typed, new, read_lines(new))


@query("f8_merge_view_edits", f"""
SELECT g.job_id, g.id, CASE WHEN g.id % 3 = 0 THEN 'Typed ' || g.id ELSE g.heading END AS heading, g.position, g.k, CASE WHEN g.id % 3 = 0 THEN 'caption' ELSE '' END AS caption FROM geo_views g""")
def _(spark, folder):
    kept = intake.dedup_first(T.pictures(spark, folder))
    typed = T.pictures(spark, folder).filter("id % 3 = 0").select("job_id", "id", F.concat(F.lit("Typed "), F.col("id").cast("string")).alias("heading"), F.lit("caption").alias("caption"))
    return cases.merge_view_edits(typed, cases.geometry_headings(kept))


@query("f9_swap_and_drop", f"""
WITH asked AS (SELECT m.job_id, m.id, m.case_no, substr(m.role, 3) AS base FROM mains m JOIN assignments a ON a.job_id = m.job_id AND a.id = m.id WHERE m.role IN ('x_bc', 'x_deformation', 'x_stress') AND m.case_no IS NOT NULL AND a.role = 'stress'),
mn AS (SELECT job_id, case_no, role AS base, min(id) AS main_id FROM mains WHERE role IN {MAIN} AND case_no IS NOT NULL GROUP BY ALL)
SELECT job_id, id, base AS role, case_no FROM asked
UNION SELECT job_id, main_id, 'x_' || base, case_no FROM asked JOIN mn USING (job_id, case_no, base)
UNION ALL SELECT job_id, id, 'unused', NULL FROM assignments WHERE role = 'unused'""")
def _(spark, folder):
    asked = T.assignments(spark, folder)
    swapped = cases.swap_main(mains(spark, folder), asked.filter("role = 'stress'"))
    return swapped.unionByName(cases.drop_picture(asked.filter("role = 'unused'")))


view("geo_views", f"""
SELECT job_id, id, heading, row_number() OVER (PARTITION BY job_id ORDER BY CASE heading WHEN 'Top view' THEN 0 WHEN 'Bottom view' THEN 1 ELSE 2 END, id) AS position, k FROM (
SELECT job_id, id, k, CASE WHEN h = '' OR back > 1 THEN 'View ' || k ELSE h END AS heading FROM (
SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY id) AS k, row_number() OVER (PARTITION BY job_id, h ORDER BY id DESC) AS back FROM (
SELECT job_id, id, CASE {Q.hint('name')} WHEN 'section' THEN 'Section view {fixed.WHERE}' WHEN 'detail' THEN 'Detail view {fixed.WHERE}'
  ELSE CASE z_dir WHEN 'up' THEN 'Top view' WHEN 'down' THEN 'Bottom view' ELSE '' END END AS h FROM deduped WHERE role = 'geometry') a) b) c""")


@query("f10_geometry_headings", "SELECT job_id, id, heading, position, k FROM geo_views")
def _(spark, folder):
    return cases.geometry_headings(intake.dedup_first(T.pictures(spark, folder)))


view("mesh_views", f"""
SELECT job_id, id, CASE {Q.hint('name')} WHEN 'section' THEN 'Mesh section {fixed.WHERE}' WHEN 'detail' THEN 'Mesh detail {fixed.WHERE}'
  ELSE CASE WHEN id = min(id) OVER (PARTITION BY job_id) THEN 'Overall mesh' ELSE 'Mesh detail [describe - please confirm]' END END AS heading,
  row_number() OVER (PARTITION BY job_id ORDER BY id) AS position FROM deduped WHERE role = 'mesh'""")


@query("f11_mesh_headings", "SELECT * FROM mesh_views")
def _(spark, folder):
    return cases.mesh_headings(intake.dedup_first(T.pictures(spark, folder)))


S = fixed.CHECK_SAY
view("draft_checks", f"""
SELECT m.job_id, 'info' AS level, 'same_picture' AS code, CAST(NULL AS BIGINT) AS case_no, m.id, {Q.say(S['same_picture'], name='m.name', first='f.name')} AS text FROM mains m JOIN mains f ON f.job_id = m.job_id AND f.id = m.dup_of
UNION ALL SELECT job_id, 'warn', 'note', NULL, id, {Q.say(S['note'], name='name', note="'Could not read the Max value from the legend - please type it in.'")} FROM mains WHERE role IN ('deformation', 'stress') AND max_value IS NULL
UNION ALL SELECT job_id, 'warn', 'no_case', NULL, id, {Q.say(S['no_case'], name='name')} FROM mains WHERE role IN {CASE} AND case_no IS NULL
UNION ALL SELECT job_id, 'info', 'slot_bc', n, NULL, {Q.say(S['slot_bc'], n='n')} FROM rollup_cases WHERE bc_id IS NULL
UNION ALL SELECT job_id, 'info', 'slot_deformation', n, NULL, {Q.say(S['slot_deformation'], n='n')} FROM rollup_cases WHERE def_id IS NULL
UNION ALL SELECT job_id, 'info', 'slot_stress', n, NULL, {Q.say(S['slot_stress'], n='n')} FROM rollup_cases WHERE stress_id IS NULL
UNION ALL SELECT x.job_id, 'info', 'demoted', x.case_no, x.id, {Q.say(S['demoted'], n='x.case_no', main='w.name', extra='x.name', kind="CASE x.role WHEN 'x_bc' THEN 'setup' WHEN 'x_deformation' THEN 'total-deformation' ELSE 'von-Mises stress' END",
    max="CASE WHEN x.role <> 'x_bc' AND w.max_value IS NOT NULL THEN ' (Max ' || printf('%g', w.max_value) || ')' ELSE '' END")} FROM mains x JOIN mains w ON w.job_id = x.job_id AND w.id = x.main_id WHERE x.auto_extra
UNION ALL SELECT job_id, 'info', 'no_geometry', NULL, NULL, {Q.quote(S['no_geometry'])} FROM mains GROUP BY job_id HAVING NOT bool_or(role = 'geometry')
UNION ALL SELECT job_id, 'info', 'no_mesh', NULL, NULL, {Q.quote(S['no_mesh'])} FROM mains GROUP BY job_id HAVING NOT bool_or(role = 'mesh')
UNION ALL SELECT job_id, 'info', 'no_cases', NULL, NULL, {Q.quote(S['no_cases'])} FROM mains GROUP BY job_id HAVING NOT bool_or(role IN {CASE} AND case_no IS NOT NULL)""")


def noted_mains(spark, folder):
    """Main pictures whose maximum could not be read carry a note."""
    unread = F.col("role").isin("deformation", "stress") & F.col("max_value").isNull()
    return mains(spark, folder).withColumn("notes", F.when(unread, F.array(F.lit("Could not read the Max value from the legend - please type it in.")))
                                           .otherwise(F.array().cast("array<string>")))


@query("f12_draft_warnings", "SELECT * FROM draft_checks")
def _(spark, folder):
    return cases.draft_warnings(noted_mains(spark, folder))


@query("f13_guess_cover", f"""
SELECT job_id, model, job, client, object, short, 'Static Structural Analysis Of ' || object AS title, CASE WHEN job = '' THEN '' ELSE 'FEA/ACK-' || job || '/01' END AS report_no FROM (
SELECT job_id, model, CASE WHEN ok THEN t[1] ELSE '' END AS job, CASE WHEN ok THEN t[2] ELSE '' END AS client, CASE WHEN ok THEN array_to_string(t[3:], ' ') ELSE '' END AS object, CASE WHEN ok THEN t[-1] ELSE '' END AS short FROM (
SELECT *, len(t) >= 3 AND regexp_full_match(t[1], '[0-9]+') AS ok FROM (
SELECT job_id, model, list_filter(regexp_split_to_array(model, '[_\\s]+'), lambda x: x <> '' AND x NOT LIKE '%+%' AND lower(x) NOT IN {Q.in_list(fixed.LOAD_WORDS)}) AS t FROM (
SELECT job_id, model FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY len(model) - len(replace(model, '_', '')) DESC, len(model) DESC, id) AS rn FROM pictures) a WHERE rn = 1) b) c) d) e""")
def _(spark, folder):
    return cases.guess_cover(T.pictures(spark, folder))


@query("f14_read_summary", """
SELECT job_id, id, concat_ws('  ·  ', CASE WHEN role IN ('deformation', 'stress', 'x_deformation', 'x_stress', 'x_other') THEN coalesce('Max ' || regexp_replace(CAST(max_value AS VARCHAR), '\\.0$', '') || ' ', 'Max not read') END,
  CASE WHEN role IN ('bc', 'x_bc') THEN '0 load / support entries' END, CASE WHEN role = 'geometry' THEN CASE z_dir WHEN 'up' THEN 'Z axis points up: top view' WHEN 'down' THEN 'Z axis points down: bottom view' ELSE 'view direction unknown' END END,
  CASE WHEN role = 'mesh' THEN 'mesh pattern' END, 'ANSYS case ' || letter, CASE WHEN role IN ('geometry', 'mesh') THEN 'no ANSYS title: told apart by how the picture looks' END,
  CASE WHEN dup_of IS NOT NULL THEN 'same picture as another one: used once' END) AS summary, coalesce(role IN ('deformation', 'stress', 'x_stress', 'x_other') AND max_value IS NULL, false) AS needs_attention FROM deduped""")
def _(spark, folder):
    df = intake.dedup_first(T.pictures(spark, folder))
    unread = F.col("role").isin("deformation", "stress", "x_stress", "x_other") & F.col("max_value").isNull()
    df = df.withColumn("confidence", F.when(F.col("role").isin("geometry", "mesh"), F.lit("medium")).when(unread, F.lit("low")).otherwise(F.lit("high")))
    return cases.read_summary(df)


@query("flagship", f"""
SELECT job_id, n, letter, bc_id, def_id, stress_id, tier, 'Case – ' || name AS load_case, coalesce({Q.mm('def_max')} || ' mm', '–') AS max_deformation,
  CASE WHEN stress_max IS NULL THEN '–' WHEN tier = 'pass' THEN {Q.mpa('stress_max')} || ' MPa' ELSE 'Exceeding Limit' END AS max_stress, '192 MPa' AS allowable_stress
FROM (SELECT *, CASE WHEN stress_max IS NULL THEN NULL WHEN stress_max <= 192 THEN 'pass' WHEN stress_max <= 250 THEN 'exceeds' WHEN stress_max < 500 THEN 'beyond_yield' ELSE 'suspect' END AS tier FROM rollup_cases) a""")
def _(spark, folder):
    from ..plans.chains import job_summary
    return job_summary(T.pictures(spark, folder))
