"""Checks on cases, materials, mesh and completeness.

Each check is a list of rules; a rule is a struct that is null when it does not fire, and says nothing without a text. ``emit``
turns any number of rules into rows in one pass over the cases, so all checks of a case cost one projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import exprs as X, fixed
from ..plans import skew
from . import verdict
from .intake import opt

S = fixed.CHECK_SAY


def rule(seq: int, level, code: str, fires, text):
    level = F.lit(level) if isinstance(level, str) else level
    return F.when(fires, F.struct(F.lit(seq).cast("long").alias("seq"), level.alias("level"), F.lit(code).alias("code"), text.alias("text")))


def with_check_texts(df: DataFrame) -> DataFrame:
    """Verdict and the number texts that the rules of a case share."""
    df = verdict.with_texts(df if "def_fail" in df.columns else verdict.verdict(df))
    return df.withColumns({"t_stress": X.general_text("stress_max"), "t_cap": X.general_text("cap")})


def emit(df: DataFrame, rules: list, keys=("job_id", "n")) -> DataFrame:
    """The sentences are made once: for a plain explode, Spark would make them a second time in a filter on the size of its array."""
    said = df.select(*keys, F.array(*rules).alias("__rules")).select(*keys, F.explode_outer("__rules").alias("c"))
    return said.filter("c.text IS NOT NULL").select(*keys, "c.seq", "c.level", "c.code", "c.text")


def _g(c):
    return X.general_text(c)


def unit_rules():
    su, du = F.coalesce(F.nullif(F.col("stress_unit"), F.lit("")), F.lit("MPa")), F.coalesce(F.nullif(F.col("def_unit"), F.lit("")), F.lit("mm"))
    return [rule(1, "warn", "stress_unit", F.lower(su) != "mpa", X.fill(S["stress_unit"], n="n", u=su)),
            rule(2, "warn", "def_unit", F.lower(du) != "mm", X.fill(S["def_unit"], n="n", u=du))]


def gravity_rules():
    v, u = F.col("gravity"), F.coalesce("gravity_unit", F.lit(""))
    mm = u.contains("mm")
    return [rule(3, "warn", "gravity_mm", mm & (F.abs(v - 9806.65) > F.lit(0.01 * 9806.65)), X.fill(S["gravity_mm"], n="n", v=_g("gravity"), u=u)),
            rule(3, "warn", "gravity_m", ~mm & u.contains("m/s") & (F.abs(v - 9.80665) > F.lit(0.01 * 9.80665)), X.fill(S["gravity_m"], n="n", v=_g("gravity"), u=u))]


def _gate():
    return F.col("stress_max").isNotNull() & F.col("allow").isNotNull()


def tier_rules():
    s, allow, sy, t = F.col("t_stress"), F.col("t_allow"), F.col("t_sy"), F.col("tier")
    basis = F.coalesce(*[F.when(F.col("basis") == k, F.lit(v)) for k, v in fixed.BASIS_TEXT.items()])
    per_allow, per_yield = F.col("stress_max") / F.col("allow"), F.col("stress_max") / F.col("sy")
    sus = t == "suspect"
    return [rule(4, "ok", "pass", t == "pass", X.fill(S["pass"], n="n", s=s, allow=allow, util=X.fixed_text(per_allow * 100, 0))),
            rule(4, "bad", "exceeds", t == "exceeds", X.fill(S["exceeds"], n="n", s=s, allow=allow, times=X.fixed_text(per_allow, 1))),
            rule(4, "bad", "beyond_yield", t == "beyond_yield", X.fill(S["beyond_yield"], n="n", s=s, sy=sy, times=X.fixed_text(per_yield, 1))),
            rule(4, "info", "suspect_set", sus & (F.col("basis") != ""), X.fill(S["suspect_set"], n="n", s=s, times=X.fixed_text(per_yield, 0), basis=basis)),
            rule(4, "bad", "suspect", sus & (F.col("basis") == ""), X.fill(S["suspect"], n="n", s=s, times=X.fixed_text(per_yield, 0))),
            rule(5, "warn", "away_above_yield", sus & (F.col("basis") == "singularity") & (F.col("stress_away") > F.col("sy")),
                 X.fill(S["away_above_yield"], n="n", away="stress_away"))]


def red_zone_rules():
    fires = _gate() & (F.col("tier") != "pass") & (F.col("red_px") < 5) & (F.col("basis") == "")
    return [rule(6, "warn", "no_red", fires, X.fill(S["no_red"], n="n"))]


def legend_rules():
    over, cap, allow = _gate() & (F.col("tier") != "pass"), F.col("cap"), F.col("allow")
    off = F.abs(cap - allow) > F.greatest(F.lit(0.02) * allow, F.lit(0.5))
    return [rule(7, "warn", "no_cap", over & cap.isNull(), X.fill(S["no_cap"], n="n", allow="t_allow")),
            rule(7, "warn", "cap_off", over & off, X.fill(S["cap_off"], n="n", cap="t_cap", allow="t_allow")),
            rule(7, "ok", "cap_ok", over & ~off, X.fill(S["cap_ok"], n="n", cap="t_cap"))]


def deformation_rules():
    return [rule(8, "bad", "def_limit", _gate() & F.col("def_fail"), X.fill(S["def_limit"], n="n", d=_g("def_max"), lim="t_lim"))]


def reaction_rules():
    ra, rs = F.col("react_applied"), F.col("react_sum")
    diff = F.abs(rs - ra) / F.abs(F.nullif(ra, F.lit(0.0))) * 100
    parts = dict(n="n", rs=X.grouped_text("react_sum"), ra=X.grouped_text("react_applied"), diff=X.fixed_text(diff, 1))
    return [rule(10, "warn", "reaction_bad", _gate() & (diff > 2.0), X.fill(S["reaction_bad"], **parts)),
            rule(10, "ok", "reaction_ok", _gate() & (diff <= 2.0), X.fill(S["reaction_ok"], **parts))]


def case_checks(cases: DataFrame) -> DataFrame:
    """All checks that need one case only; the case carries its limits, ``red_px``, ``cap`` and ``gravity_unit``."""
    return emit(with_check_texts(cases), unit_rules() + gravity_rules() + tier_rules() + red_zone_rules() + legend_rules() + deformation_rules() + reaction_rules())


def extras_exceed_main(cases: DataFrame, extras: DataFrame, hot_rows: int | None = skew.HOT_ROWS) -> DataFrame:
    """Additional views whose maximum is above the one of the main picture by more than 0.1 %."""
    base = cases.filter(_gate()).select("job_id", "n", "stress_max", "def_max")
    df = skew.lookup(extras.filter(F.col("kind").isin("stress", "deformation")), base, ["job_id", "n"], hot_rows=hot_rows)
    main = F.when(F.col("kind") == "stress", F.col("stress_max")).otherwise(F.col("def_max"))
    text = X.fill(S["extra"], n="n", kind="kind", heading=F.coalesce("heading", F.lit("")), m=_g("max_value"), main=X.general_text(main))
    return emit(df, [rule(9, "warn", "extra", F.col("stress_max").isNotNull() & (F.col("max_value") > main * 1.001), text)], ("job_id", "n", "id"))


def material_checks(materials: DataFrame) -> DataFrame:
    """Factor of safety, density, modulus and Poisson's ratio against the bands of their units."""
    df = materials.withColumns({"__e": X.to_float("e_text"), "__nu": X.to_float("nu_text"), "__rho": X.to_float("rho_text")})
    e, nu, rho = F.col("__e"), F.col("__nu"), F.col("__rho")
    kg_m3, kg_mm3 = rho >= 100, rho.between(1e-7, 1e-4)
    return emit(df, [
        rule(1, "warn", "fos", F.col("fos") < 1, X.fill(S["fos"], v=_g("fos"))),
        rule(2, "warn", "rho_kg_m3", kg_m3, X.fill(S["rho_kg_m3"], v=_g("__rho"))), rule(2, "warn", "rho_kg_mm3", kg_mm3, X.fill(S["rho_kg_mm3"], v=_g("__rho"))),
        rule(2, "warn", "rho_range", ~kg_m3 & ~kg_mm3 & ~rho.between(5e-10, 5e-8), X.fill(S["rho_range"], v=_g("__rho"))),
        rule(3, "warn", "e_low", e < 1000, X.fill(S["e_low"], v=_g("__e"))), rule(3, "warn", "e_high", e > 2e6, X.fill(S["e_high"], v=_g("__e"))),
        rule(4, "warn", "nu", ~((nu >= 0) & (nu < 0.5)), X.fill(S["nu"], v=_g("__nu")))], ("job_id",))


def mesh_checks(stats: DataFrame, limits: dict = fixed.SETTINGS["mesh_limits"]) -> DataFrame:
    """Skewness and orthogonal quality against the limits of the settings: those of the job (a column ``settings``, see ``readers.job_settings``) or the given ones."""
    df = stats.withColumns({c: X.to_float(c) for c in ("skew_max", "skew_avg", "oq_min")})
    names = ("skew_max_warn", "skew_max_info", "skew_avg_info", "oq_min_warn")
    own = "settings" in stats.columns
    bad, poor, avg, oq = (F.col(f"settings.mesh_limits.{k}") if own else F.lit(float(limits[k])) for k in names)
    m, shown = F.col("skew_max"), {k: _g(f"settings.mesh_limits.{k}") if own else F.lit(f"{limits[k]:g}") for k in names}
    return emit(df, [
        rule(1, "warn", "skew_bad", m >= bad, X.fill(S["skew_bad"], v=_g("skew_max"), lim=shown["skew_max_warn"])),
        rule(1, "info", "skew_poor", (m >= poor) & (m < bad), X.fill(S["skew_poor"], v=_g("skew_max"), lo=shown["skew_max_info"], lim=shown["skew_max_warn"])),
        rule(2, "info", "skew_avg", F.col("skew_avg") > avg, X.fill(S["skew_avg"], v=_g("skew_avg"), lim=shown["skew_avg_info"])),
        rule(3, "warn", "oq", F.col("oq_min") < oq, X.fill(S["oq"], v=_g("oq_min"), lim=shown["oq_min_warn"]))], ("job_id",))


def duplicate_case_names(cases: DataFrame) -> DataFrame:
    """One warning for every job with two cases of the same name."""
    same = cases.groupBy("job_id", F.lower(F.trim(F.coalesce("name", F.lit("")))).alias("k")).agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    return same.select("job_id").distinct().select("job_id", F.lit("warn").alias("level"), F.lit("same_name").alias("code"), F.lit(S["same_name"]).alias("text"))


def missing_inputs(ctx: DataFrame, cases: DataFrame, mesh_lines: DataFrame, assumptions: DataFrame) -> DataFrame:
    """Hints for jobs without a yield stress, and for jobs with cases but no evidence at all: no mesh statistics, no assumption
    (``job_id, text``), and no case with a typed place of its stress or deformation."""
    typed = [F.coalesce(F.trim(c) != "", F.lit(False)) for c in ("loc_stress", "loc_def")]
    has = cases.groupBy("job_id").agg(F.bool_or(typed[0] | typed[1]).alias("located"))
    assumed = assumptions.filter(F.trim("text") != "").select("job_id", F.lit(True).alias("assumed")).distinct()
    df = ctx.select("job_id", "allow").join(has, "job_id", "left").join(mesh_lines.select("job_id", "mesh_line"), "job_id", "left").join(assumed, "job_id", "left")
    bare = F.col("located").isNotNull() & ~F.col("located") & F.col("mesh_line").isNull() & F.col("assumed").isNull()
    return emit(df, [rule(0, "info", "no_yield", F.col("allow").isNull(), F.lit(S["no_yield"])), rule(99, "info", "no_evidence", bare, F.lit(S["no_evidence"]))], ("job_id",))


def _ranked(checks: DataFrame, jobs: DataFrame, order: list[str], hot_rows: int | None) -> DataFrame:
    """Numbered by severity and then in the given order; a job without any gets one calm line."""
    checks = skew.settle(checks, dear=True)   # sentences are made once
    level = F.coalesce(*[F.when(F.col("level") == k, F.lit(v)) for k, v in fixed.LEVELS.items()])
    df = checks.withColumn("__l", level)
    first = F.col(order[0]) if order[0] != "n" else skew.slice_of("n")
    df = skew.number_rows(df, ["job_id"], ["__l", *order], [F.col("__l"), first], "rank", hot_rows=hot_rows).drop("__l")
    calm = jobs.select("job_id").distinct().join(checks.select("job_id").distinct(), "job_id", "left_anti")
    calm = calm.select("job_id", F.lit("ok").alias("level"), F.lit("nothing").alias("code"), F.lit(S["nothing"]).alias("text"), F.lit(1).cast("long").alias("rank"))
    return df.unionByName(calm, allowMissingColumns=True)


def rank_checks(checks: DataFrame, jobs: DataFrame, hot_rows: int | None = skew.HOT_ROWS) -> DataFrame:
    """Checks of a job by severity, in their own order (n, seq) within a level; a calm job gets one line."""
    return _ranked(checks, jobs, ["n", "seq", "code"], hot_rows).select("job_id", "n", "level", "code", "text", "rank")


#: kinds of messages in the order in which a job lists them within a level
MESSAGES = ("hint", "case", "material", "mesh", "layout", "evidence")


def rank_messages(messages: dict[str, list[DataFrame]], jobs: DataFrame, hot_rows: int | None = skew.HOT_ROWS) -> DataFrame:
    """All messages of a job in one ranking: by severity, then by kind, case, place in the kind. ``messages`` are tables by kind with job_id, level, code, text and, where
    the kind has them, n, seq, id and family."""
    rows = None
    for kind, tables in messages.items():
        for df in tables:
            part = df.select("job_id", F.lit(MESSAGES.index(kind)).alias("part"), F.lit(kind).alias("kind"), opt(df, "n", 0, "long").alias("n"), opt(df, "seq", 0, "long").alias("seq"),
                             "level", "code", "text", opt(df, "id", -1, "long").alias("id"), opt(df, "family", "", "string").alias("family"))
            rows = part if rows is None else rows.unionByName(part)
    out = _ranked(rows, jobs, ["part", "n", "seq", "code", "id", "family"], hot_rows)
    return out.select("job_id", "kind", F.nullif(F.col("n"), F.lit(0)).alias("n"), "level", "code", "text", "rank")


def completeness_audit(fields: DataFrame, hot_rows: int | None = skew.HOT_ROWS) -> DataFrame:
    """Open items of a job by kind of need, from a long table (job_id, need, value)."""
    v = F.trim(F.coalesce("value", F.lit("")))
    df = fields.withColumns({"__v": v, "__k": F.lower(v)})
    df = skew.attach(df, ["job_id", "need", "__k"], hot_rows, __same=F.count(F.lit(1)))
    v, empty = F.col("__v"), F.col("__v") == ""
    bracket, number = v.rlike(r"\[[^\]]*\]"), X.page_num("__v").isNotNull()
    bad = (F.when(F.col("need") == "req", empty).when(F.col("need") == "bracket", empty | bracket).when(F.col("need") == "bracketOpt", bracket)
           .when(F.col("need") == "num", ~number).when(F.col("need") == "optnum", ~empty & ~number).when(F.col("need") == "title", empty | v.rlike(r"(?i)\bof$"))
           .when(F.col("need") == "role", v == "unknown").when(F.col("need") == "casename", empty | (F.col("__same") > 1)).when(F.col("need") == "basis", v == "1"))
    return df.groupBy("job_id", "need").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.coalesce(bad, F.lit(False))).alias("open_items"))


def placeholder_scan(texts: DataFrame, column: str = "text") -> DataFrame:
    """Every placeholder left in a text, with how many the text holds."""
    keys = [c for c in texts.columns if c != column]
    found = F.regexp_extract_all(column, F.lit(fixed.PLACEHOLDER), F.lit(0))
    df = texts.select(*keys, found.alias("f")).filter(F.size("f") > 0)
    return df.select(*keys, F.size("f").cast("long").alias("tokens"), F.posexplode("f").alias("k", "token")).withColumn("k", F.col("k").cast("long"))
