"""Load cases: grouping by letter, separate projects, main pictures, corrections, headings, warnings, cover."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import exprs as X, fixed
from ..plans import skew
from .intake import opt


def is_case_role(c="role"):
    return F.col(c).isin(*fixed.CASE_ROLES)


def group_by_letter(pictures: DataFrame, hot_rows: int | None = skew.HOT_ROWS) -> DataFrame:
    """Letter group of every case picture; without a letter it follows the only letter of its job, if there is just one."""
    own = F.when(is_case_role(), F.nullif(F.col("letter"), F.lit("")))
    df = skew.attach(pictures.withColumn("__own", own), ["job_id"], hot_rows, few_groups=True, __lo=F.min("__own"), __hi=F.max("__own"))
    group = (F.when(F.col("__own").isNotNull(), F.col("__own")).when(F.col("__lo").isNull(), F.lit(""))
             .when(F.col("__lo") == F.col("__hi"), F.col("__lo")))
    return df.withColumn("group_letter", F.when(is_case_role(), group)).drop("__own", "__lo", "__hi")


def split_projects(pictures: DataFrame, hot_rows: int | None = skew.HOT_ROWS) -> DataFrame:
    """Letters with several setup pictures: every setup starts a sub-group, the others follow the most alike model.

    No pairs are formed. In the order of the models, the setup that shares the longest prefix with a model is one of the
    two closest to it; among all setups with that prefix the first in order is the closest one above the prefix. So two
    sorted passes over the distinct models are enough. A sub-group is named by its setup (model, id).
    """
    on = ["job_id", "group_letter"]
    kind = F.when(F.col("role") == "bc", F.lit("bc")).otherwise(F.lit("other"))
    df = skew.settle(pictures).withColumns({"__model": X.norm_model("model"), "__kind": kind})
    groups = skew.settle(df.filter(F.col("group_letter").isNotNull()).groupBy(*on, "__model", "__kind")
                         .agg(F.min("id").alias("__id"), F.count(F.lit(1)).alias("__size")))
    setups = groups.filter("__kind = 'bc'").withColumn("__s", F.struct(F.col("__model").alias("m"), F.col("__id").alias("i")))
    several = skew.settle(setups.groupBy(*on).agg(F.sum("__size").alias("__c")).filter(F.col("__c") > 1).select(*on, F.lit(True).alias("__many")))
    marks = setups.select(*on, F.col("__model").alias("__at"))

    def closest(points):
        return skew.nearest(points, marks, on, "__at", [F.left("__at", F.lit(2))], hot_rows)

    near = closest(groups.filter("__kind = 'other'").withColumn("__at", F.col("__model"))).filter("below IS NOT NULL OR above IS NOT NULL")
    near = X.with_common_prefix(X.with_common_prefix(near, "__model", "below", "__p"), "__model", "above", "__q")
    near = skew.settle(near.withColumn("__at", F.left("__model", F.greatest("__p", "__q"))).drop("below", "above", "__p", "__q"))
    found = closest(near).drop("below").withColumnRenamed("above", "m")
    found = skew.lookup(found, setups.select(*on, F.col("__model").alias("m"), F.col("__id").alias("i")), [*on, "m"], hot_rows=hot_rows)
    others = skew.lookup(found, several, on, hot_rows=hot_rows).filter("__many").withColumn("__sub", F.struct("m", "i"))
    own = skew.lookup(setups, several, on, hot_rows=hot_rows).filter("__many").withColumn("__sub", F.col("__s"))
    keep = [*on, "__model", "__kind", "__size", "__sub"]
    names = others.select(*keep).unionByName(own.select(*keep)).withColumn("__known", F.lit(True))
    df = skew.lookup(df, names, [*on, "__model", "__kind"], size="__size", hot_rows=hot_rows)
    mine = F.col("__known") & (F.col("role") == "bc")   # several setups of one model: each names its own sub-group
    return (df.withColumn("sub_model", F.when(mine, F.col("__model")).otherwise(F.col("__sub.m")))
            .withColumn("sub_id", F.when(mine, F.col("id")).otherwise(F.col("__sub.i"))).drop("__model", "__kind", "__sub", "__known"))


def number_cases(pictures: DataFrame, hot_rows: int | None = skew.HOT_ROWS) -> DataFrame:
    """Case numbers 1..n of a job in the order of letter, then setup. Numbers the distinct groups, not the pictures."""
    on = ["job_id", "group_letter", "__m", "__i"]
    df = skew.settle(pictures).withColumns({"__m": F.coalesce("sub_model", F.lit("")), "__i": F.coalesce("sub_id", F.lit(-1))})
    groups = df.filter(F.col("group_letter").isNotNull()).groupBy(*on).agg(F.count(F.lit(1)).alias("__size"))
    groups = skew.number_rows(groups, ["job_id"], ["group_letter", "__m", "__i"], [F.col("group_letter"), F.left("__m", F.lit(2))], "case_no",
                              hot_rows=hot_rows)
    return skew.lookup(df.drop("case_no"), groups, on, size="__size", hot_rows=hot_rows).drop("__m", "__i")


def pick_main(pictures: DataFrame, hot_rows: int | None = skew.HOT_ROWS) -> DataFrame:
    """One main picture per job, case and kind: chosen by the user first, then the highest maximum, then the lowest id.

    The others become additional views (``auto_extra``) and carry the id of the winner (``main_id``).
    """
    candidate = F.col("role").isin(*fixed.MAIN_ROLES) & F.col("case_no").isNotNull()
    user_set = F.coalesce(F.col("user_set"), F.lit(False))
    height = F.when(F.col("role") == "bc", F.lit(0.0)).otherwise(-F.coalesce("max_value", F.lit(0.0)))
    rank = F.struct((~user_set).alias("a"), height.alias("b"), F.col("id").alias("c"))
    df = skew.attach(pictures.drop("main_id"), ["job_id", "case_no", "role"], hot_rows, few_groups=True, main_id=F.min_by("id", F.when(candidate, rank)))
    loser = candidate & (F.col("id") != F.col("main_id"))
    return (df.withColumn("auto_extra", F.coalesce(loser, F.lit(False)))
            .withColumn("main_id", F.when(candidate, F.col("main_id")))
            .withColumn("role", F.when(loser, F.concat(F.lit("x_"), F.col("role"))).otherwise(F.col("role"))))


#: columns that the steps of a draft make; null (``auto_extra``: false) on pictures that take no part in them
MADE = {group_by_letter: ("group_letter",), split_projects: ("sub_model", "sub_id"), number_cases: ("case_no",), pick_main: ("main_id", "auto_extra")}


def beside(taking: DataFrame, rest: DataFrame, *steps) -> DataFrame:
    """Pictures after the steps of a draft, with those that took no part in them."""
    made = [c for step in steps for c in MADE[step]]
    blank = [F.lit(False if c == "auto_extra" else None).cast(taking.schema[c].dataType).alias(c) for c in made]
    return taking.unionByName(rest.select(*[c for c in rest.columns if c not in made], *blank))


def draft_steps(pictures: DataFrame, *steps) -> DataFrame:
    """The given steps, from ``group_by_letter`` on, on the pictures with a role in a case only. Copies and pictures of other roles leave every step as they
    came, so they are put beside at the end: no step reads, moves or writes them. The others are written first, as every step reads its input several times."""
    takes = F.coalesce(is_case_role(), F.lit(False))
    taking = skew.settle(pictures.filter(takes), dear=True)
    for step in steps:
        taking = step(taking)
    return beside(taking, pictures.filter(~takes), *steps)


DRAFT = (group_by_letter, split_projects, number_cases, pick_main)


def case_extras(pictures: DataFrame) -> DataFrame:
    """Additional views of the cases (after ``pick_main``) with their heading; ordered by id within a case."""
    df = pictures.filter(F.col("role").isin(*fixed.EXTRA_ROLES) & F.col("case_no").isNotNull())
    hint, kind = X.view_hint("name"), opt(df, "result_kind", "", "string")
    heading = (F.when((F.col("role") == "x_other") & (kind != ""), kind)
               .when(hint == "section", F.lit(f"Section view {fixed.WHERE}")).when(hint == "detail", F.lit(f"Detail view {fixed.WHERE}"))
               .otherwise(F.lit("Additional view [describe - please confirm]")))
    return df.select("job_id", F.col("case_no").alias("n"), "id", X.base_role().alias("kind"), heading.alias("heading"), "max_value",
                     opt(df, "unit", None, "string").alias("unit"), opt(df, "auto_extra", False, "boolean").alias("auto"))


def case_rollup(pictures: DataFrame) -> DataFrame:
    """One row per case from its main pictures (after ``pick_main``). A present record wins even where its value is null."""
    df = pictures.filter(is_case_role() & F.col("case_no").isNotNull())
    unit, px = opt(df, "unit", None, "string"), opt(df, "legend_px", None, "double")
    rec = F.struct("id", "max_value", unit.alias("unit"), F.nullif(px, F.lit(0.0)).alias("px"), "red_px", "letter", "model",
                   opt(df, "headline_name", "", "string").alias("name"), opt(df, "headline_sub", "", "string").alias("sub"))
    main = [F.max(F.when(F.col("role") == r, rec)).alias(r) for r in fixed.MAIN_ROLES]
    df = df.groupBy("job_id", F.col("case_no").alias("n")).agg(*main)
    first = F.coalesce("bc", "deformation", "stress")
    sizes = F.array_sort(F.array_compact(F.array("bc.px", "deformation.px", "stress.px")))
    middle = (F.when(F.size(sizes) == 1, F.get(sizes, F.lit(0))).when(F.size(sizes) == 2, (F.get(sizes, F.lit(0)) + F.get(sizes, F.lit(1))) / 2)
              .when(F.size(sizes) == 3, F.get(sizes, F.lit(1))))
    default = X.fill("Load Case {n}", n="n")
    return df.select(
        "job_id", "n", F.col("bc.id").alias("bc_id"), F.col("deformation.id").alias("def_id"), F.col("stress.id").alias("stress_id"),
        F.coalesce(F.nullif(F.col("bc.name"), F.lit("")), default).alias("name"),
        F.coalesce(F.nullif(F.col("bc.sub"), F.lit("")), F.lit("(Self Weight + Pressure)")).alias("subtitle"),
        F.coalesce(F.col("deformation.unit"), F.lit("mm")).alias("def_unit"), F.coalesce(F.col("stress.unit"), F.lit("MPa")).alias("stress_unit"),
        F.col("deformation.max_value").alias("def_max"), F.col("stress.max_value").alias("stress_max"), F.col("stress.red_px").alias("red_px"),
        middle.alias("legend_px"), first["letter"].alias("letter"), first["model"].alias("model"))


def with_readings(cases: DataFrame, setup: DataFrame, caps: DataFrame, hot_rows: int | None = skew.HOT_ROWS) -> DataFrame:
    """Cases (after ``case_rollup``) with what was read from their main pictures: ``setup`` (job_id, id, name, subtitle, gravity, gravity_unit) of the
    setup picture, ``caps`` (job_id, id, cap) of the legend of the stress picture. Without a headline the default name and subtitle stay."""
    setup = setup.select("job_id", F.col("id").alias("bc_id"), F.col("name").alias("__name"), F.col("subtitle").alias("__sub"), "gravity", "gravity_unit")
    df = skew.lookup(cases, setup, ["job_id", "bc_id"], hot_rows=hot_rows)
    df = skew.lookup(df, caps.select("job_id", F.col("id").alias("stress_id"), "cap"), ["job_id", "stress_id"], hot_rows=hot_rows)
    df = df.withColumns({"name": F.coalesce(F.nullif("__name", F.lit("")), F.col("name")), "subtitle": F.coalesce(F.nullif("__sub", F.lit("")), F.col("subtitle"))})
    return df.withColumn("short_name", F.col("name")).drop("__name", "__sub")


def rows_of_main(cases: DataFrame, rows: DataFrame, slot: str, hot_rows: int | None = skew.HOT_ROWS) -> DataFrame:
    """Rows that were read from pictures (job_id, id, ...), setup lines or legend values, as rows of the case (``n``) whose main picture in ``slot``
    they were read from. They stay rows: a picture may hold any number of them."""
    own = cases.filter(F.col(slot).isNotNull()).select("job_id", F.col(slot).alias("id"), "n")
    return skew.lookup(rows, own, ["job_id", "id"], hot_rows=hot_rows).filter(F.col("n").isNotNull())


def with_typed(cases: DataFrame, typed: DataFrame, hot_rows: int | None = skew.HOT_ROWS) -> DataFrame:
    """Cases with the values typed for them (job_id, n, basis, stress_away, loc_stress, loc_def, react_applied, react_sum); empty words where nothing was typed."""
    words, numbers = ("basis", "loc_stress", "loc_def"), ("stress_away", "react_applied", "react_sum")
    typed = typed.select("job_id", "n", *[opt(typed, c, "", "string").alias(c) for c in words], *[opt(typed, c, None, "double").alias(c) for c in numbers])
    df = skew.lookup(cases, typed, ["job_id", "n"], hot_rows=hot_rows)
    return df.withColumns({c: F.coalesce(c, F.lit("")) for c in words})


def apply_corrections(pictures: DataFrame, assignments: DataFrame) -> DataFrame:
    """User corrections (job, id, role, case) put over the pictures; unknown ids are ignored."""
    fix = assignments.select("job_id", "id", F.col("role").alias("__role"), F.col("case_no").alias("__case"), F.lit(True).alias("__hit"))
    df = pictures.join(fix, ["job_id", "id"], "left")
    hit = F.coalesce("__hit", F.lit(False))
    new_case = F.when(F.col("__role").isin(*fixed.CASE_ROLES), F.coalesce("__case", F.nullif(F.col("case_no"), F.lit(0)), F.lit(1)))
    changed_role = hit & (F.col("__role") != F.col("role"))
    changed = changed_role | (hit & ~new_case.eqNullSafe(F.col("case_no")))
    out = {"user_set": F.coalesce(F.col("user_set"), F.lit(False)) | F.coalesce(changed, F.lit(False)),
           "case_no": F.when(hit, new_case).otherwise(F.col("case_no")),
           "role": F.when(hit, F.col("__role")).otherwise(F.col("role"))}
    if "confidence" in pictures.columns:
        out["confidence"] = F.when(changed_role & (F.col("confidence") != "low"), F.lit("high")).otherwise(F.col("confidence"))
    if "notes" in pictures.columns:
        fresh = F.filter("notes", lambda t: ~t.contains("recognised") & ~t.contains("additional view"))
        out["notes"] = F.when(changed_role, fresh).otherwise(F.col("notes"))
    return df.withColumns(out).drop("__role", "__case", "__hit")


CASE_DERIVED = ("bc_id", "def_id", "stress_id", "red_px", "stress_unit", "def_unit", "legend_px")


def merge_case_edits(old: DataFrame, new: DataFrame) -> DataFrame:
    """Cases after a change: typed words stay while their picture is the same, derived values always come new."""
    o = old.select("job_id", "n", F.struct(*[c for c in old.columns if c not in ("job_id", "n")]).alias("o"))
    df = new.join(o, ["job_id", "n"], "left")
    known = F.col("o").isNotNull()

    def same(slot):
        return known & F.col(f"o.{slot}").eqNullSafe(F.col(slot))

    out = {c: F.when(same("bc_id"), F.col(f"o.{c}")).otherwise(F.col(c)) for c in ("name", "subtitle") if c in new.columns}
    out["def_max"] = F.when(same("def_id"), F.col("o.def_max")).otherwise(F.col("def_max"))
    out["stress_max"] = F.when(same("stress_id"), F.col("o.stress_max")).otherwise(F.col("stress_max"))
    return df.withColumns(out).drop("o")


def merge_setup_lines(old: DataFrame, old_lines: DataFrame, new: DataFrame, new_lines: DataFrame, hot_rows: int | None = skew.HOT_ROWS) -> DataFrame:
    """Setup lines (job_id, n, line_no, ...) after a change of the cases (job_id, n, bc_id): the user's lines, as moved, added, removed or
    rewritten, stay while the case has the same setup picture; a case with another one, or a new case, has the lines that were read from it.

    Lines stay rows: a case may have any number of them.
    """
    before = old.select("job_id", "n", F.col("bc_id").alias("__bc"), F.lit(True).alias("__known"))
    same = F.coalesce(F.col("__known") & F.col("__bc").eqNullSafe(F.col("bc_id")), F.lit(False))
    now = skew.settle(new.select("job_id", "n", "bc_id").join(before, ["job_id", "n"], "left").select("job_id", "n", same.alias("__same")))
    kept = skew.lookup(old_lines, now, ["job_id", "n"], hot_rows=hot_rows).filter("__same")
    fresh = skew.lookup(new_lines, now, ["job_id", "n"], hot_rows=hot_rows).filter("NOT __same")
    return kept.unionByName(fresh).drop("__same")


def merge_view_edits(old: DataFrame, new: DataFrame, on=("job_id", "id")) -> DataFrame:
    """Views after a change: the heading and caption typed for a picture stay with it. Extras of a case are views by (job_id, n, id)."""
    o = old.select(*on, F.col("heading").alias("__h"), F.col("caption").alias("__c"), F.lit(True).alias("__hit"))
    df = new.drop("caption").join(o, [*on], "left")
    return (df.withColumn("caption", F.coalesce("__c", F.lit("")))
            .withColumn("heading", F.when(F.col("__hit"), F.col("__h")).otherwise(F.col("heading"))).drop("__h", "__c", "__hit"))


def swap_main(pictures: DataFrame, requests: DataFrame, hot_rows: int | None = skew.HOT_ROWS) -> DataFrame:
    """Swap an additional view with the main picture of its case: two correction rows per request (one without a main)."""
    pictures = skew.settle(pictures)
    mains = pictures.filter(F.col("role").isin(*fixed.MAIN_ROLES) & F.col("case_no").isNotNull())
    mains = mains.groupBy("job_id", "case_no", F.col("role").alias("base")).agg(F.min("id").alias("main_id"))
    asked = pictures.join(requests.select("job_id", "id"), ["job_id", "id"], "left_semi").filter(F.col("role").isin("x_bc", "x_deformation", "x_stress"))
    asked = asked.select("job_id", "id", "case_no", X.base_role().alias("base")).filter(F.col("case_no").isNotNull())
    asked = skew.lookup(asked, mains, ["job_id", "case_no", "base"], hot_rows=hot_rows)
    rows = F.array(F.struct(F.col("id"), F.col("base").alias("role")), F.struct(F.col("main_id").alias("id"), F.concat(F.lit("x_"), F.col("base")).alias("role")))
    out = asked.select("job_id", "case_no", F.explode(rows).alias("r")).filter(F.col("r.id").isNotNull())
    return out.select("job_id", F.col("r.id").alias("id"), F.col("r.role").alias("role"), "case_no").distinct()


def drop_picture(requests: DataFrame) -> DataFrame:
    return requests.select("job_id", "id", F.lit("unused").alias("role"), F.lit(None).cast("long").alias("case_no"))


def geometry_headings(pictures: DataFrame, hot_rows: int | None = skew.HOT_ROWS) -> DataFrame:
    """Headings of the geometry views and their order: top view, bottom view, others.

    Of several equal headings the last one keeps it; blank ones and the earlier ones become 'View k'.
    """
    df = pictures.filter(F.col("role") == "geometry")
    hint = X.view_hint("name")
    first = (F.when(hint == "section", F.lit(f"Section view {fixed.WHERE}")).when(hint == "detail", F.lit(f"Detail view {fixed.WHERE}"))
             .when(F.col("z_dir") == "up", F.lit("Top view")).when(F.col("z_dir") == "down", F.lit("Bottom view")).otherwise(F.lit("")))
    df = df.select("job_id", "id", first.alias("__h"))
    df = skew.number_rows(df, ["job_id"], ["id"], [skew.slice_of("id")], "k", hot_rows=hot_rows)
    df = skew.attach(df, ["job_id", "__h"], hot_rows, __last=F.max("id"))
    heading = F.when((F.col("__h") == "") | (F.col("id") != F.col("__last")), X.fill("View {k}", k="k")).otherwise(F.col("__h"))
    df = df.select("job_id", "id", heading.alias("heading"), "k")
    df = df.withColumn("__c", F.when(F.col("heading") == "Top view", 0).when(F.col("heading") == "Bottom view", 1).otherwise(2))
    df = skew.number_rows(df, ["job_id"], ["__c", "id"], [F.col("__c"), skew.slice_of("id")], "position", hot_rows=hot_rows)
    return df.drop("__c")


def mesh_headings(pictures: DataFrame, hot_rows: int | None = skew.HOT_ROWS) -> DataFrame:
    """Headings of the mesh views in picture order; a first one without a hint is the overall mesh."""
    df = pictures.filter(F.col("role") == "mesh").select("job_id", "id", X.view_hint("name").alias("__hint"))
    df = skew.number_rows(df, ["job_id"], ["id"], [skew.slice_of("id")], "position", hot_rows=hot_rows)
    heading = (F.when(F.col("__hint") == "section", F.lit(f"Mesh section {fixed.WHERE}")).when(F.col("__hint") == "detail", F.lit(f"Mesh detail {fixed.WHERE}"))
               .when(F.col("position") == 1, F.lit("Overall mesh")).otherwise(F.lit("Mesh detail [describe - please confirm]")))
    return df.select("job_id", "id", heading.alias("heading"), "position")


def demotions(pictures: DataFrame, hot_rows: int | None = skew.HOT_ROWS) -> DataFrame:
    """Pictures that lost the main slot (after ``pick_main``), with the name and maximum of the winner."""
    pictures = skew.settle(pictures)
    lost = pictures.filter("auto_extra").select("job_id", "case_no", "id", "name", "main_id", X.base_role().alias("base"))
    main = pictures.select("job_id", F.col("id").alias("main_id"), F.col("name").alias("main_name"), F.col("max_value").alias("main_max"))
    main = main.join(lost.select("job_id", "main_id").distinct(), ["job_id", "main_id"], "left_semi")
    return skew.lookup(lost, main, ["job_id", "main_id"], hot_rows=hot_rows)


def _say(df, level, code, case, rank, text):
    return df.select("job_id", F.lit(level).alias("level"), F.lit(code).alias("code"), case.cast("long").alias("case_no"),
                     rank.cast("long").alias("id"), text.alias("text"))


def draft_warnings(pictures: DataFrame, hot_rows: int | None = skew.HOT_ROWS) -> DataFrame:
    """All warnings of a draft, from the pictures after ``pick_main``."""
    S, none = fixed.CHECK_SAY, F.lit(None)
    pictures = skew.settle(pictures)
    out = []
    if "notes" in pictures.columns:
        noted = pictures.select("job_id", "id", "name", F.explode("notes").alias("note"))
        out.append(_say(noted, "warn", "note", none, F.col("id"), X.fill(S["note"], name="name", note="note")))
    twins = pictures.filter(F.col("dup_of").isNotNull()).select("job_id", "id", "name", "dup_of")
    firsts = pictures.select("job_id", F.col("id").alias("dup_of"), F.col("name").alias("first"))
    firsts = firsts.join(twins.select("job_id", "dup_of").distinct(), ["job_id", "dup_of"], "left_semi")
    twins = skew.lookup(twins, firsts, ["job_id", "dup_of"], hot_rows=hot_rows)
    out.append(_say(twins, "info", "same_picture", none, F.col("id"), X.fill(S["same_picture"], name="name", first=F.coalesce("first", F.lit("another picture")))))
    lost = pictures.filter(is_case_role() & F.col("case_no").isNull())
    out.append(_say(lost, "warn", "no_case", none, F.col("id"), X.fill(S["no_case"], name="name")))
    cases = case_rollup(pictures)
    slots = cases.select("job_id", "n", F.explode(F.array(*[
        F.struct(F.lit(r).alias("slot"), F.col(c).alias("pid"), X.fill(S[f"slot_{r}"], n="n").alias("text"))
        for r, c in (("bc", "bc_id"), ("deformation", "def_id"), ("stress", "stress_id"))])).alias("s")).filter("s.pid IS NULL")
    out.append(slots.select("job_id", F.lit("info").alias("level"), F.concat(F.lit("slot_"), F.col("s.slot")).alias("code"),
                            F.col("n").cast("long").alias("case_no"), none.cast("long").alias("id"), F.col("s.text").alias("text")))
    lost = demotions(pictures, hot_rows)
    shown = F.when((F.col("base") != "bc") & F.col("main_max").isNotNull(), X.fill(" (Max {m})", m=X.general_text("main_max"))).otherwise(F.lit(""))
    label = F.coalesce(*[F.when(F.col("base") == k, F.lit(v)) for k, v in fixed.KIND_LABEL.items()])
    out.append(_say(lost, "info", "demoted", F.col("case_no"), F.col("id"),
                    X.fill(S["demoted"], n="case_no", kind=label, main="main_name", max=shown, extra="name")))
    has = pictures.groupBy("job_id").agg(F.bool_or(F.col("role") == "geometry").alias("geo"), F.bool_or(F.col("role") == "mesh").alias("mesh"),
                                         F.bool_or(is_case_role() & F.col("case_no").isNotNull()).alias("cases"))
    gaps = F.array(*[F.when(~F.col(c), F.struct(F.lit(code).alias("code"), F.lit(S[code]).alias("text")))
                     for c, code in (("geo", "no_geometry"), ("mesh", "no_mesh"), ("cases", "no_cases"))])
    gaps = has.select("job_id", F.explode(F.array_compact(gaps)).alias("g"))
    out.append(gaps.select("job_id", F.lit("info").alias("level"), F.col("g.code").alias("code"), none.cast("long").alias("case_no"),
                           none.cast("long").alias("id"), F.col("g.text").alias("text")))
    return reduce(DataFrame.unionByName, out)


def guess_cover(pictures: DataFrame, pattern: str = fixed.SETTINGS["report_no_pattern"]) -> DataFrame:
    """Cover words of a job from its richest model name."""
    model = F.nullif(F.col("model"), F.lit(""))
    rich = F.struct(F.char_length(F.regexp_replace(model, "[^_]", "")).alias("u"), F.char_length(model).alias("l"), (-F.col("id")).alias("i"))
    df = pictures.groupBy("job_id").agg(F.max_by("model", F.when(model.isNotNull(), rich)).alias("model"))
    df = df.withColumn("model", F.coalesce("model", F.lit("")))
    parts = F.filter(F.split("model", r"[_\s]+"), lambda t: (t != "") & ~t.contains("+") & ~F.lower(t).isin(*fixed.LOAD_WORDS))
    df = df.withColumn("t", parts)
    good = (F.size("t") >= 3) & F.get("t", F.lit(0)).rlike(r"^\d+$")
    obj = F.when(good, F.array_join(F.slice("t", 3, F.size("t")), " ")).otherwise(F.lit(""))
    df = df.select("job_id", "model", F.when(good, F.get("t", F.lit(0))).otherwise(F.lit("")).alias("job"),
                   F.when(good, F.get("t", F.lit(1))).otherwise(F.lit("")).alias("client"), obj.alias("object"),
                   F.when(good, F.element_at("t", -1)).otherwise(F.lit("")).alias("short"))
    return df.withColumn("title", F.concat(F.lit("Static Structural Analysis Of "), F.col("object"))).withColumn(
        "report_no", F.when(F.col("job") == "", F.lit("")).otherwise(X.fill(pattern, job="job")))


def read_summary(pictures: DataFrame) -> DataFrame:
    """What was read from a picture, in one line, and whether it needs a look."""
    df = pictures
    role, conf = F.col("role"), opt(df, "confidence", "high", "string")
    number = F.call_function("format_number", F.col("max_value"), F.lit("0.################"))
    unit, kind = F.coalesce(opt(df, "unit", "", "string"), F.lit("")), opt(df, "result_kind", "", "string")
    entries = F.size("bc_legend") if "bc_legend" in df.columns else F.lit(0)
    letter = F.nullif(F.col("letter"), F.lit(""))
    text = F.concat_ws(
        "  ·  ",
        F.when(role.isin("deformation", "stress", "x_deformation", "x_stress", "x_other"),
               F.coalesce(F.concat(F.lit("Max "), number, F.lit(" "), unit), F.lit("Max not read"))),
        F.when((role == "x_other") & (kind != ""), kind),
        F.when(role.isin("bc", "x_bc"), F.concat(entries.cast("string"), F.lit(" load / support entries"))),
        F.when(role == "geometry", F.when(F.col("z_dir") == "up", F.lit("Z axis points up: top view"))
               .when(F.col("z_dir") == "down", F.lit("Z axis points down: bottom view")).otherwise(F.lit("view direction unknown"))),
        F.when(role == "mesh", F.lit("mesh pattern")),
        F.concat(F.lit("ANSYS case "), letter),
        F.when((conf == "medium") & role.isin("geometry", "mesh"), F.lit("no ANSYS title: told apart by how the picture looks")),
        F.when(opt(df, "dup_of", None, "long").isNotNull(), F.lit("same picture as another one: used once")))
    noted = (F.size("notes") > 0) if "notes" in df.columns else F.lit(False)
    return df.select("job_id", "id", text.alias("summary"), (noted | (conf == "low") | (role == "unknown")).alias("needs_attention"))
