"""Verdict and wording of load cases against the limits of their job.

Most steps read a table of cases that carries the limits of its job (``with_context``): allow, sy, fos, short, show_util,
lim, k. They are projections: no shuffle, all inside generated code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import exprs as X, fixed
from ..plans import skew
from .intake import opt

OVER = ("exceeds", "beyond_yield", "suspect")


def row_allowable(yield_value, fos):
    """Allowable stress of a material row: yield / factor, rounded down; null without a yield or a positive factor."""
    return F.when((X.col(yield_value) != 0) & (X.col(fos) > 0), F.floor(X.col(yield_value) / X.col(fos) + F.lit(1e-9)).cast("double"))


def allowable(rows: DataFrame, governing: DataFrame) -> DataFrame:
    """Allowable of the governing material row of a job (the first row when the index does not exist)."""
    df = rows.join(governing, "job_id", "left") if governing is not None else rows
    rec = F.struct(row_allowable("yield_value", "fos").alias("allow"), F.col("yield_value").alias("sy"))
    df = df.groupBy("job_id").agg(F.max(F.when(F.col("row_no") == F.col("gov"), rec)).alias("g"), F.max(F.when(F.col("row_no") == 0, rec)).alias("f"))
    pick = F.coalesce("g", "f")
    return df.select("job_id", pick["allow"].alias("allow"), pick["sy"].alias("sy"))


def job_context(inputs: DataFrame, settings: dict = fixed.SETTINGS) -> DataFrame:
    """Typed limits of a job as numbers: non-positive limits are null, an empty or zero factor takes the default."""
    fos = X.to_float("fos")
    return inputs.select(
        "job_id", X.positive(X.to_float("allowable")).alias("allow"), X.positive(X.to_float("yield")).alias("sy"),
        F.when(fos != 0, fos).otherwise(F.lit(settings["fos"])).alias("fos"),
        F.coalesce(F.nullif(F.trim("short"), F.lit("")), F.lit("structure")).alias("short"),
        F.coalesce(F.col("show_utilisation"), F.lit(settings["show_utilisation"])).alias("show_util"),
        X.to_float("def_limit").alias("lim"), F.lit(float(settings["singularity_factor"])).alias("k"))


def with_limit_texts(ctx: DataFrame) -> DataFrame:
    """The limits of a job with the texts of these numbers: made here once per job, not once per case (see ``with_texts``)."""
    return ctx.withColumns({f"t_{c}": X.general_text(c) for c in ("allow", "lim", "sy")})


def with_context(cases: DataFrame, ctx: DataFrame, hot_rows: int | None = skew.HOT_ROWS) -> DataFrame:
    return skew.lookup(cases, ctx, ["job_id"], hot_rows=hot_rows)


def fixed_context(cases: DataFrame, allow: float, sy: float, fos: float = 1.3, lim=None, short: str = "structure") -> DataFrame:
    """The same limits for every job, as constants."""
    return cases.withColumns({"allow": F.lit(allow).cast("double"), "sy": F.lit(sy).cast("double"), "fos": F.lit(fos), "lim": F.lit(lim).cast("double"),
                              "short": F.lit(short), "show_util": F.lit(True), "k": F.lit(fixed.SETTINGS["singularity_factor"])})


def tier_of():
    s, allow, sy = F.col("stress_max"), F.col("allow"), F.col("sy")
    return (F.when(s.isNull() | allow.isNull(), F.lit(None).cast("string")).when(s <= allow, F.lit("pass"))
            .when(sy.isNull() | (s <= sy), F.lit("exceeds")).when(s < F.col("k") * sy, F.lit("beyond_yield")).otherwise(F.lit("suspect")))


def tier(cases: DataFrame) -> DataFrame:
    return cases.withColumn("tier", tier_of())


def resolve_basis(cases: DataFrame) -> DataFrame:
    """How an over-limit peak is reported; a suspect peak without a choice needs one."""
    df = cases if "tier" in cases.columns else tier(cases)
    typed = F.trim(F.coalesce("basis", F.lit("")))
    basis = F.when(F.col("tier").isin(*OVER) & typed.isin(*fixed.BASES), typed).otherwise(F.lit(""))
    df = df.withColumn("basis", basis)
    return df.withColumn("needs_basis", F.coalesce((F.col("tier") == "suspect") & (F.col("basis") == ""), F.lit(False)))


def with_texts(df: DataFrame) -> DataFrame:
    """The number texts that sentences share, each made once per case."""
    if "t_mm" in df.columns:
        return df
    texts = {"t_mm": X.mm_text("def_max"), "t_mpa": X.mpa_text("stress_max"), "t_allow": X.general_text("allow"), "t_away": X.mpa_text("stress_away"),
             "t_lim": X.general_text("lim"), "t_sy": X.general_text("sy")}
    return df.withColumns({c: text for c, text in texts.items() if c not in df.columns})   # those of the limits may come with the job


TEXTS = ("t_mm", "t_mpa", "t_allow", "t_away", "t_lim", "t_sy")


def verdict(cases: DataFrame) -> DataFrame:
    """Adequate or not, table cells, captions and closing line of every case, from tier, basis, away stress and limit."""
    df = with_texts(resolve_basis(cases))
    d, s, allow, away = F.col("def_max"), F.col("stress_max"), F.col("allow"), F.col("stress_away")
    passed, over = F.col("tier") == "pass", F.col("tier").isin(*OVER)
    sing, refine = over & (F.col("basis") == "singularity"), over & (F.col("basis") == "refine")
    df = df.withColumn("def_fail", F.coalesce(d > F.col("lim"), F.lit(False)))
    fail = F.col("def_fail")
    mm, mpa, limit = F.col("t_mm"), F.col("t_mpa"), F.col("t_allow")
    neutral = s.isNotNull() & allow.isNull()
    none, empty = F.lit(None), F.lit("")
    cell_def = F.when(d.isNull(), empty).when(fail, F.lit(fixed.EXCEEDS)).otherwise(F.concat(mm, F.lit(" mm")))
    value = F.concat(mpa, F.lit(" MPa"))
    cell = (F.when(s.isNull(), empty).when(neutral | passed, value)
            .when(sing & away.isNull(), F.lit(fixed.VALUE)).when(sing & (away <= allow), F.concat(F.col("t_away"), F.lit(" MPa (away from local peak)")))
            .when(refine, F.lit("Under review")).otherwise(F.lit(fixed.EXCEEDS)))
    conclusion = (F.when(s.isNull() | neutral, empty).when(passed, F.when(fail, F.lit(fixed.ACTIONS)).otherwise(empty))
                  .when(sing & (away.isNull() | (away <= allow)), empty).when(refine, F.lit(fixed.REFINE_FIRST)).otherwise(F.lit(fixed.ACTIONS)))
    adequate = (F.when(s.isNull() | neutral | refine, none.cast("boolean")).when(passed, ~fail)
                .when(sing & (away <= allow), ~fail).otherwise(F.lit(False)))
    caption = (F.when(s.isNull(), empty).when(neutral, X.fill(fixed.CAPTION["neutral"], s=mpa)).when(passed, X.fill(fixed.CAPTION["within"], allow=limit))
               .when(sing & away.isNull(), F.lit(fixed.CAPTION["away_none"])).when(sing & (away <= allow), X.fill(fixed.CAPTION["away_ok"], allow=limit))
               .when(sing, X.fill(fixed.CAPTION["away_bad"], allow=limit)).when(refine, F.lit(fixed.CAPTION["refine"]))
               .otherwise(X.fill(fixed.CAPTION["over"], allow=limit)))
    return df.withColumns({
        "exceeds": ~passed, "util": F.when(passed, s / allow * 100), "cell_def": cell_def, "cell_stress": cell, "conclusion": conclusion,
        "adequate": adequate, "stress_caption": caption,
        "deformation_caption": F.when(d.isNull(), empty).otherwise(X.fill(fixed.CAPTION["def"], d=mm))})


def observation_list(df: DataFrame):
    """The sentences of a case in order, as one array; a sentence whose number is missing is left out."""
    say, obj = fixed.SAY, F.col("short")
    d, s, allow, away, lim = (F.col(c) for c in ("def_max", "stress_max", "allow", "stress_away", "lim"))
    passed, over = F.col("tier") == "pass", F.col("tier").isin(*OVER)
    sing, refine = over & (F.col("basis") == "singularity"), over & (F.col("basis") == "refine")
    mm, mpa, limit = F.col("t_mm"), F.col("t_mpa"), F.col("t_allow")
    has = s.isNotNull() & allow.isNotNull()
    where_def, where = X.clean(opt(df, "loc_def", "", "string")), X.clean(opt(df, "loc_stress", "", "string"))
    peak = F.coalesce(F.nullif(X.clean(opt(df, "sing_loc", "", "string")), F.lit("")), F.lit(fixed.WHERE))
    util = F.when(F.col("util") < 10, X.fixed_text("util", 1)).otherwise(X.fixed_text("util", 0))
    ra, rs = F.col("react_applied"), F.col("react_sum")

    def line(code, text):
        return F.when(text.isNotNull(), F.struct(F.lit(code).alias("code"), text.alias("text")))

    first = F.when(lim.isNull(), X.fill(say["def"], obj=obj, d=mm)).when(d > lim, X.fill(say["def_exceeds"], obj=obj, d=mm, lim=F.col("t_lim"))) \
        .otherwise(X.fill(say["def_within"], obj=obj, d=mm, lim=F.col("t_lim")))
    main = (F.when(s.isNull(), F.lit(None)).when(allow.isNull(), X.fill(say["neutral"], obj=obj, s=mpa))
            .when(passed & F.col("show_util"), X.fill(say["within_util"], obj=obj, s=mpa, allow=limit, util=util))
            .when(passed, X.fill(say["within"], obj=obj, s=mpa, allow=limit))
            .when(sing, X.fill(say["sing"], s=mpa, loc=peak))
            .when(refine, X.fill(say["refine"], s=mpa, times=X.fixed_text(s / allow, 1), allow=limit, loc=peak))
            .otherwise(X.fill(say["over"], obj=obj, allow=limit)))
    plain_over = over & ~F.col("basis").isin("singularity", "refine")
    middle = (F.when(sing & away.isNull(), F.lit(say["away_none"])).when(sing & (away <= allow), X.fill(say["away_ok"], away=F.col("t_away"), allow=limit))
              .when(sing, X.fill(say["away_bad"], away=F.col("t_away"), allow=limit))
              .when(plain_over & F.col("tier").isin("beyond_yield", "suspect"), X.fill(say["above_yield"], s=mpa, sy="t_sy")))
    close = (F.when(s.isNull(), F.lit(None)).when(allow.isNull(), F.lit(say["neutral_close"]))
             .when(passed & F.col("def_fail"), X.fill(say["close_def"], obj=obj)).when(passed, X.fill(say["close_ok"], obj=obj))
             .when(sing & away.isNull(), F.lit(say["away_none_close"])).when(sing & (away <= allow), X.fill(say["away_ok_close"], obj=obj))
             .when(refine, F.lit(say["refine_close"])).otherwise(X.fill(say["close_bad"], obj=obj)))
    balance = F.when(has & (ra != 0) & rs.isNotNull(), X.fill(say["reaction"], rs=X.grouped_text("react_sum"), ra=X.grouped_text("react_applied"),
                                                             diff=X.fixed_text(F.abs(rs - ra) / F.abs(ra) * 100, 1)))
    return F.array_compact(F.array(
        line("deformation", first),
        line("deformation_location", F.when(d.isNotNull() & (where_def != ""), X.fill(say["def_loc"], loc=where_def))),
        line("stress", main),
        line("stress_location", F.when(s.isNotNull() & ~F.coalesce(sing | refine, F.lit(False)) & (where != ""), X.fill(say["stress_loc"], loc=where))),
        line("middle", middle), line("reaction", balance), line("closing", close)))


def observations(cases: DataFrame) -> DataFrame:
    """Sentences of every case with their position."""
    df = verdict(cases)
    df = df.select("job_id", "n", F.posexplode(observation_list(df)).alias("pos", "o"))
    return df.select("job_id", "n", F.col("pos").cast("long").alias("pos"), F.col("o.code").alias("code"), F.col("o.text").alias("text"))


def summary_rows(cases: DataFrame) -> DataFrame:
    """Row of the summary table for every case; the deformation limit is null where the job has none."""
    df = with_texts(cases if "cell_stress" in cases.columns else verdict(cases))
    short = F.trim(F.coalesce(F.nullif(opt(df, "short_name", "", "string"), F.lit("")), F.col("name"), F.lit("")))
    title = F.coalesce(F.nullif(short, F.lit("")), X.fill("Load Case {n}", n="n"))

    def cell(c):
        return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("–"))

    return df.select("job_id", "n", F.concat(F.lit("Case – "), title).alias("load_case"), cell("cell_def").alias("max_deformation"),
                     cell("cell_stress").alias("max_stress"),
                     F.coalesce(F.concat(F.col("t_allow"), F.lit(" MPa")), F.lit(fixed.VALUE)).alias("allowable_stress"),
                     F.concat(F.col("t_lim"), F.lit(" mm")).alias("allowable_deformation"))


def override_texts(cases: DataFrame, edits: DataFrame) -> DataFrame:
    """Hand-edited wording wins. A null edit is no edit; an empty list of observations does not override, an empty closing line does."""
    e = edits.select("job_id", "n", *[F.col(c).alias(f"__{c}") for c in ("deformation_caption", "stress_caption", "observations", "conclusion")])
    df = cases.join(e, ["job_id", "n"], "left")
    kept = F.filter(F.transform("__observations", lambda t: F.trim(t)), lambda t: t != "")
    plain = {c: F.coalesce(F.trim(f"__{c}"), F.col(c)) for c in ("deformation_caption", "stress_caption", "conclusion")}
    plain["observations"] = F.when(F.size(kept) > 0, kept).otherwise(F.col("observations"))
    return df.withColumns(plain).drop(*[c for c in e.columns if c.startswith("__")])


def mesh_line(stats: DataFrame) -> DataFrame:
    """Mesh statistics in one line: filled parts only, numbers formatted, text kept as typed."""
    def part(name, before, shape, after=""):
        if name not in stats.columns:
            return F.lit(None).cast("string")
        text = F.trim(F.col(name).cast("string"))
        value = X.to_float(name)
        return F.when(text != "", F.concat(F.lit(before), F.coalesce(shape(value), text), F.lit(after)))

    def two(v):
        return X.fixed_text(v, 2)

    parts = [part("type", "", lambda v: F.lit(None).cast("string")), part("elements", "Elements: ", X.grouped_text), part("nodes", "Nodes: ", X.grouped_text),
             part("size", "Element size: ", X.general_text, " mm"), part("skew_avg", "Avg. skewness ", two), part("skew_max", "Max. skewness ", two),
             part("oq_min", "Min. orthogonal quality ", two)]
    return stats.select("job_id", F.nullif(F.concat_ws("  |  ", *parts), F.lit("")).alias("mesh_line"))
