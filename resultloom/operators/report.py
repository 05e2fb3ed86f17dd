"""Layout choice and the report model: which slides a job gets, in which order, with which titles and notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import exprs as X, fixed
from ..plans import skew
from .intake import opt


def _sizes(df):
    """Size of a picture as it is placed, and the scale applied to it."""
    k = F.least(F.lit(1.0), F.lit(fixed.PLACE_SIDE) / F.greatest("width", "height"))
    return df.withColumn("k", k).withColumns({"pw": F.greatest(F.lit(1.0), F.rint(F.col("width") * F.col("k"))),
                                             "ph": F.greatest(F.lit(1.0), F.rint(F.col("height") * F.col("k")))})


def _fit(box):
    return F.least(F.lit(box[0]) / F.col("pw"), F.lit(box[1]) / F.col("ph"))


def _points(scale):
    return X.fixed_text(scale * F.col("k") * F.col("px") / 0.72, 1).cast("double")


def shown_pictures(cases: DataFrame, views: DataFrame, extras: DataFrame, pictures: DataFrame, hot_rows: int | None = skew.HOT_ROWS) -> DataFrame:
    """Every picture a report shows: family, group of pictures laid out together, position, size, legend height in pixels.

    A result pair counts when both plots exist. The legend height is the one of the case, else the median of the job.
    """
    cases = skew.settle(cases)
    px = F.nullif(F.col("legend_px"), F.lit(0.0))
    job = skew.exact_median(cases.withColumn("__px", px), ["job_id"], "__px", hot_rows).select("job_id", F.col("median").alias("job_px"))
    pair = F.col("def_id").isNotNull() & F.col("stress_id").isNotNull()

    def slot(family, c, pos, when):
        return F.when(when, F.struct(F.lit(family).alias("family"), F.lit("case").alias("part"), F.col(c).alias("id"), F.lit(pos).cast("long").alias("pos")))

    slots = F.array_compact(F.array(slot("results", "def_id", 1, pair), slot("results", "stress_id", 2, pair), slot("bc", "bc_id", 1, F.col("bc_id").isNotNull())))
    own = cases.select("job_id", "n", px.alias("case_px"), F.explode(slots).alias("s")).select("job_id", "n", "case_px", "s.*")
    none = F.lit(None).cast("double").alias("case_px")
    seen = views.select("job_id", F.lit(0).cast("long").alias("n"), none, F.lit("geometry").alias("family"), "part", "id", F.col("position").alias("pos"))
    more = extras.select("job_id", "n", none, F.lit("extras").alias("family"), F.col("kind").alias("part"), "id", F.col("id").alias("pos"))
    df = own.unionByName(seen).unionByName(more).join(pictures.select("job_id", "id", "width", "height"), ["job_id", "id"])
    df = skew.lookup(df, job, ["job_id"], hot_rows=hot_rows)
    return _sizes(df.withColumn("px", F.coalesce("case_px", "job_px", F.lit(fixed.DEFAULT_LEGEND_PX))))


def legibility(shown: DataFrame, hot_rows: int | None = skew.HOT_ROWS) -> DataFrame:
    """Smallest legend text (points) and number of slides of every family and layout of a job.

    Views count only in groups of two or more; the odd last picture of a group stands alone. The few layouts are put on
    every picture by an array, and minima are combined before the shuffle.
    """
    df = skew.attach(shown, ["job_id", "family", "n", "part"], hot_rows, __c=F.count(F.lit(1)), __last=F.max("pos"))
    df = df.filter((F.col("family") != "geometry") | (F.col("__c") >= 2))
    alone = (F.col("__c") % 2 == 1) & (F.col("pos") == F.col("__last"))
    single, bc = fixed.BOXES[("pair", "separate")], F.col("family") == "bc"

    def option(mode):
        pair = F.when(alone, _fit(single)).otherwise(_fit(fixed.BOXES[("pair", mode)]))
        scale = F.when(bc, _fit(fixed.BOXES[("bc", mode)])).otherwise(pair) if mode != "separate" else F.when(~bc, pair)
        return F.when(scale.isNotNull(), F.struct(F.lit(mode).alias("mode"), _points(scale).alias("pt")))

    df = df.select("job_id", "family", "n", "part", "pos", "__c", "__last", F.explode(F.array_compact(F.array(*[option(m) for m in fixed.LAYOUTS]))).alias("o"))
    first = F.col("pos") == F.col("__last")   # one row of the group carries its slides
    per_group = F.when(F.col("o.mode") == "separate", F.col("__c")).otherwise(F.floor((F.col("__c") + 1) / 2))
    df = df.groupBy("job_id", "family", F.col("o.mode").alias("mode")).agg(F.min("o.pt").alias("pt"), F.sum(F.when(first, per_group)).alias("__s"))
    slides = F.when(F.col("family") == "bc", F.lit(1)).when(F.col("family") == "results", F.when(F.col("mode") == "separate", 2).otherwise(1)).otherwise(F.col("__s"))
    return df.select("job_id", "family", "mode", "pt", slides.cast("long").alias("slides"))


def choose_mode(options: DataFrame, choices: DataFrame | None = None, legend_jobs: DataFrame | None = None,
                min_pt: float = fixed.SETTINGS["min_legend_pt"]) -> DataFrame:
    """Layout per job and family: the first one that is readable, else the one with the largest text; a valid choice wins.

    ``choices`` (job_id, family, choice) are the wishes of the user; ``legend_jobs`` names jobs whose extras show a legend.
    """
    soft = round(fixed.SOFT_SHARE * min_pt, 2)
    wide = options.groupBy("job_id", "family").agg(*[F.max(F.when(F.col("mode") == m, F.col("pt"))).alias(f"pt_{m}") for m in fixed.LAYOUTS])
    if legend_jobs is not None:
        wide = wide.join(legend_jobs.select("job_id", F.lit(True).alias("__legend")), "job_id", "left")
    else:
        wide = wide.withColumn("__legend", F.lit(True))
    hard = F.col("family").isin("results", "bc") | ((F.col("family") == "extras") & F.coalesce("__legend", F.lit(False)))
    wide = wide.withColumn("thr", F.when(hard, F.lit(float(min_pt))).otherwise(F.lit(soft))).drop("__legend")
    if choices is not None:
        wide = wide.join(choices, ["job_id", "family"], "left")
    else:
        wide = wide.withColumn("choice", F.lit(None).cast("string"))
    points = {m: F.col(f"pt_{m}") for m in fixed.LAYOUTS}
    best = F.greatest(*points.values())
    readable = F.coalesce(*[F.when(p >= F.col("thr") - 1e-9, F.lit(m)) for m, p in points.items()])
    largest = F.coalesce(*[F.when(p == best, F.lit(m)) for m, p in points.items()])
    valid = F.coalesce(*[F.when((F.col("choice") == m) & p.isNotNull(), F.lit(m)) for m, p in points.items()])
    df = wide.withColumns({"auto": F.coalesce(readable, largest), "choice": F.coalesce("choice", F.lit("auto")), "best_pt": best})
    df = df.withColumn("effective", F.coalesce(valid, F.col("auto")))
    pt = F.coalesce(*[F.when(F.col("effective") == m, p) for m, p in points.items()])
    auto_pt = F.coalesce(*[F.when(F.col("auto") == m, p) for m, p in points.items()])
    return df.withColumns({"pt": pt, "auto_pt": auto_pt}).select("job_id", "family", "auto", "choice", "effective", "pt", "auto_pt", "best_pt", F.col("pt_side").alias("side_pt"), "thr")


def effective_layout(cases: DataFrame, plan: DataFrame, hot_rows: int | None = skew.HOT_ROWS) -> DataFrame:
    """Layout of every case: its own override, then the layout of the job, then side by side."""
    job = plan.groupBy("job_id").agg(*[F.max(F.when(F.col("family") == f, F.col("effective"))).alias(f"__{f}") for f in ("results", "bc")])
    df = skew.lookup(cases, job, ["job_id"], hot_rows=hot_rows)
    side = F.lit("side")
    return df.select("job_id", "n", F.coalesce(F.when(F.col("layout").isin(*fixed.LAYOUTS), F.col("layout")), F.col("__results"), side).alias("effective_results"),
                     F.coalesce(F.when(F.col("bc_layout").isin("side", "stack"), F.col("bc_layout")), F.col("__bc"), side).alias("effective_bc"))


def layout_checks(plan: DataFrame) -> DataFrame:
    """Text too small, a better layout, layouts moved away from side by side, an over-long setup list."""
    S, g = fixed.CHECK_SAY, X.general_text
    what = F.coalesce(*[F.when(F.col("family") == k, F.lit(v)) for k, v in fixed.FAMILY_LABEL.items()])
    small = F.col("pt") < F.col("thr")
    hopeless = F.col("best_pt") < F.col("thr")
    moved = ~small & (F.col("family") != "extras") & (F.col("auto") != "side") & (F.col("choice") == "auto")
    over = opt(plan, "overflow", False, "boolean") & (F.col("family") == "bc")

    def row(fires, level, code, text):
        return F.when(fires, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), text.alias("text")))

    rows = F.array_compact(F.array(
        row(small & hopeless, "warn", "too_small", X.fill(S["too_small"], what=what, pt=g("pt"), best=g("best_pt"))),
        row(small & ~hopeless, "warn", "better", X.fill(S["better"], what=what, pt=g("pt"), mode="auto", best=g("auto_pt"))),
        row(moved, "info", "moved", X.fill(S["moved"], what=what, mode="effective", pt=g("pt"), side=g("side_pt"))),
        row(over, "warn", "overflow", F.lit(S["overflow"]))))
    return plan.select("job_id", "family", F.explode(rows).alias("c")).select("job_id", "family", "c.*")


def paginate(rows: DataFrame, per_slide: int = fixed.SUMMARY_ROWS, title: str = "Final Summary", hot_rows: int | None = skew.HOT_ROWS) -> DataFrame:
    """Summary rows (ordered by n) on slides of fixed length; later slides are continuations."""
    df = skew.number_rows(rows, ["job_id"], ["n"], [skew.slice_of("n")], "__k", hot_rows=hot_rows)
    df = df.withColumn("slide", F.floor((F.col("__k") - 1) / per_slide).cast("long") + 1).withColumn("row", F.pmod(F.col("__k") - 1, F.lit(per_slide)) + 1)
    return df.withColumn("title", F.when(F.col("slide") > 1, F.lit(f"{title} (cont.)")).otherwise(F.lit(title))).drop("__k")


def chunk_views(views: DataFrame, title, single=None, hot_rows: int | None = skew.HOT_ROWS) -> DataFrame:
    """Views (job_id, part, position, heading, mode) on slides: pairs, or one by one if the layout is separate.

    ``single`` is the title of a slide with one picture only, where it is not the usual one.
    """
    df = skew.attach(views, ["job_id", "part"], hot_rows, few_groups=True, __c=F.count(F.lit(1)))
    at = F.col("position") - 1
    pairs = F.col("mode") != "separate"
    lonely = ~pairs | ((F.col("__c") % 2 == 1) & (at == F.col("__c") - 1))
    slide = F.when(pairs, F.floor(at / 2)).otherwise(at).cast("long")
    named = single if single is not None else F.when(F.col("__c") == 1, title).otherwise(F.concat(title, F.lit(" – "), F.col("heading")))
    text = F.when(lonely, named).when(slide == 0, title).otherwise(F.concat(title, F.lit(" (cont.)")))
    return df.select("job_id", "part", "id", (slide + 1).alias("slide"), F.when(pairs, at % 2).otherwise(F.lit(0)).cast("long").alias("place"), text.alias("slide_title"))


def section_plan(jobs: DataFrame) -> DataFrame:
    """Ordered sections of a job; numbers start at 2 and count only what is there.

    ``jobs`` has has_geometry, has_mesh, mesh_line, assumptions (count), cases (count), policy, short.
    """
    frame, stats = F.col("policy") == "frame", F.col("mesh_line").isNotNull()
    geo, mesh = F.col("has_geometry") | frame, F.col("has_mesh") | frame | stats
    label = X.object_label("short")
    no_mesh = F.lit(2) + geo.cast("int")
    no_assume = no_mesh + mesh.cast("int")

    def section(order, name, there, number, title):
        return F.when(there, F.struct(F.lit(order).cast("long").alias("position"), F.lit(name).alias("section"), number.cast("long").alias("number"), title.alias("title")))

    none = F.lit(None)
    rows = F.array_compact(F.array(
        section(1, "cover", F.lit(True), none, none.cast("string")), section(2, "material", F.lit(True), none, none.cast("string")),
        section(3, "geometry", geo, F.lit(2), X.fill("2. {l} Geometry", l=label)), section(4, "mesh", mesh, no_mesh, X.fill("{n}. {l} Mesh", n=no_mesh, l=label)),
        section(5, "assumptions", F.col("assumptions") > 0, no_assume, X.fill("{n}. Assumptions & Scope", n=no_assume)),
        section(6, "cases", F.col("cases") > 0, none, none.cast("string")), section(7, "summary", F.col("cases") > 0, none, F.lit("Final Summary"))))
    return jobs.select("job_id", F.explode(rows).alias("s")).select("job_id", "s.*")


def _notes(df, keys, rules):
    rows = F.array_compact(F.array(*[F.when(F.coalesce(hit, F.lit(False)), F.struct(F.lit(code).alias("code"), text.alias("text"))) for code, hit, text in rules]))
    return df.select(*keys, F.explode(rows).alias("c")).select(*keys, "c.*")


def section_notes(jobs: DataFrame, cases: DataFrame, hot_rows: int | None = skew.HOT_ROWS) -> DataFrame:
    """What was left out or framed, for the job and for every case (bc_id, def_id, stress_id, list_items, observations)."""
    N, frame = fixed.NOTE_SAY, F.col("policy") == "frame"
    stats = F.col("mesh_line").isNotNull()
    lit = {k: F.lit(v) for k, v in N.items()}
    job = _notes(jobs, ["job_id"], [
        ("geometry_frame", frame & ~F.col("has_geometry"), lit["geometry_frame"]), ("geometry_out", ~frame & ~F.col("has_geometry"), lit["geometry_out"]),
        ("mesh_frame_stats", (frame | stats) & ~F.col("has_mesh") & stats, lit["mesh_frame_stats"]), ("mesh_frame", frame & ~F.col("has_mesh") & ~stats, lit["mesh_frame"]),
        ("mesh_out", ~frame & ~stats & ~F.col("has_mesh"), lit["mesh_out"]), ("no_cases", F.col("cases") == 0, lit["no_cases"])])
    df = skew.lookup(cases, jobs.select("job_id", "policy"), ["job_id"], hot_rows=hot_rows)
    slots = {"bc": "bc_id", "deformation": "def_id", "stress": "stress_id"}
    framed = [("frame", frame & F.col(c).isNull(), X.fill(N["frame"], n="n", what=F.lit(fixed.SLOT_LABEL[s]))) for s, c in slots.items()]
    bare = ~frame & F.col("bc_id").isNull()
    d, s = F.col("def_id").isNotNull() | frame, F.col("stress_id").isNotNull() | frame
    case = _notes(df, ["job_id", "n"], framed + [
        ("setup_list_only", bare & (F.col("list_items") > 0), X.fill(N["setup_list_only"], n="n")), ("setup_out", bare & (F.col("list_items") == 0), X.fill(N["setup_out"], n="n")),
        ("results_out", ~d & ~s, X.fill(N["results_out"], n="n")), ("results_one", d != s, X.fill(N["results_one"], n="n")),
        ("no_observation", F.col("observations") == 0, X.fill(N["no_observation"], n="n"))])
    return case.unionByName(job, allowMissingColumns=True)


def result_slides(cases: DataFrame, hot_rows: int | None = skew.HOT_ROWS) -> DataFrame:
    """Result slides of every case: none, one plot alone, two separate, or one that holds both."""
    df = skew.attach(cases, ["job_id"], hot_rows, few_groups=True, __c=F.count(F.lit(1)))
    pre = F.when(F.col("__c") > 1, X.fill("Case {n}: ", n="n")).otherwise(F.lit(""))
    d, s = F.col("def_id").isNotNull(), F.col("stress_id").isNotNull()

    def slide(kind, word):
        return F.struct(F.lit(kind).alias("kind"), F.concat(pre, F.lit(word)).alias("title"))

    one, two, both = slide("deformation", "Total Deformation"), slide("stress", "Von-Mises Stress"), slide("both", "Results")
    rows = (F.when(d & s & (F.col("effective_results") == "separate"), F.array(one, two)).when(d & s, F.array(both)).when(d, F.array(one)).when(s, F.array(two)))
    df = df.select("job_id", "n", F.posexplode(rows).alias("slide", "r"))
    return df.select("job_id", "n", F.col("slide").cast("long").alias("slide"), "r.kind", "r.title")


def missing_picture_policy(cases: DataFrame, policy: str | None = None) -> DataFrame:
    """Picture slots of every case: 'frame' fills a gap with a labelled placeholder and a note, 'skip' leaves it out."""
    keep = F.lit(policy) == "frame" if policy else F.col("policy") == "frame"
    slots = F.array(*[F.struct(F.lit(s).alias("slot"), F.col(c).alias("picture_id"), F.lit(fixed.SLOT_LABEL[s]).alias("label"))
                      for s, c in (("bc", "bc_id"), ("deformation", "def_id"), ("stress", "stress_id"))])
    df = cases.withColumn("__keep", keep).select("job_id", "n", "__keep", F.explode(slots).alias("s")).filter("__keep OR s.picture_id IS NOT NULL")
    gap = F.col("s.picture_id").isNull()
    return df.select("job_id", "n", F.col("s.slot").alias("slot"), F.col("s.picture_id").alias("picture_id"),
                     F.when(gap, X.fill("{l} picture not provided", l=F.col("s.label"))).alias("placeholder"),
                     F.when(gap, X.fill(fixed.NOTE_SAY["frame"], n="n", what=F.col("s.label"))).alias("note"))


def material_rows(jobs: DataFrame, rows: DataFrame, columns: int = 7, default: dict = fixed.SETTINGS["material"], hot_rows: int | None = skew.HOT_ROWS) -> DataFrame:
    """Material rows (job_id, row_no, cells) with a fixed number of cells; blanks are visible, a job without rows gets the default."""
    base = F.array(*[F.lit(str(default[k])) for k in ("material", "item", "E", "nu", "rho")], F.lit(""), F.lit(""))
    known = jobs.select("job_id").distinct()
    own = skew.lookup(rows.select("job_id", "row_no", "cells"), known.withColumn("__in", F.lit(True)), ["job_id"], hot_rows=hot_rows).filter("__in").drop("__in")
    bare = known.join(rows.select("job_id").distinct(), "job_id", "left_anti").select("job_id", F.lit(0).cast("long").alias("row_no"), base.alias("cells"))
    df = own.unionByName(bare).withColumns({"row_no": F.coalesce("row_no", F.lit(0).cast("long")), "cells": F.coalesce("cells", base)})
    cells = F.slice(F.concat("cells", F.array_repeat(F.lit(""), columns)), 1, columns)
    cells = F.transform(cells, lambda t: F.coalesce(F.nullif(F.trim(t), F.lit("")), F.lit(fixed.VALUE)))
    df = df.withColumn("__c", cells)
    return df.select("job_id", "row_no", *[F.col("__c")[i].alias(f"c{i + 1}") for i in range(columns)])


def assumption_lines(ticks: DataFrame, custom: DataFrame, library=fixed.ASSUMPTIONS) -> DataFrame:
    """Ticked lines of the library in its order, then the own lines of the job that are not blank."""
    lines = F.array(*[F.lit(t) for t in library])
    own = custom.select("job_id", F.posexplode(F.split("text", "\n")).alias("pos", "t")).withColumn("t", F.trim("t")).filter("t <> ''")
    ticked = ticks.select("job_id", F.col("line").alias("pos")).distinct().filter(F.col("pos").between(0, len(library) - 1))
    ticked = ticked.select("job_id", F.lit(0).cast("long").alias("part"), F.col("pos").cast("long").alias("pos"), F.get(lines, F.col("pos").cast("int")).alias("text"))
    return ticked.unionByName(own.select("job_id", F.lit(1).cast("long").alias("part"), F.col("pos").cast("long").alias("pos"), F.col("t").alias("text")))
