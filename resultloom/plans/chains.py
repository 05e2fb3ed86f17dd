"""Whole questions as chains of operators; a chain that reads a step more than once writes it first."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import cases, checks, intake, legend, loads, verdict
from . import skew


def draft(pictures: DataFrame) -> DataFrame:
    """Pictures with their case number and role, each case having one main picture per slot."""
    return cases.draft_steps(intake.dedup_first(pictures).drop("hash"), *cases.DRAFT)


def job_summary(pictures: DataFrame, allow: float = 192.0, sy: float = 250.0, fos: float = 1.3) -> DataFrame:
    """Per job: the load cases, the main picture of each slot, and the row of the summary table."""
    needed = pictures.select("job_id", "id", "hash", "role", "letter", "model", "max_value", "red_px", "user_set")
    df = skew.settle(cases.case_rollup(draft(needed)))
    df = verdict.fixed_context(df, allow, sy, fos).withColumns({"basis": F.lit(""), "stress_away": F.lit(None).cast("double")})
    df = verdict.verdict(df)
    rows = verdict.summary_rows(df).select("job_id", "n", "load_case", "max_deformation", "max_stress", "allowable_stress")
    return df.select("job_id", "n", "letter", "bc_id", "def_id", "stress_id", "tier").join(rows, ["job_id", "n"])


def setup_readings(lines: DataFrame) -> DataFrame:
    """Headline and gravity of setup pictures, from their lines (job_id, id, line_no, text)."""
    rows = skew.settle(lines.select(F.struct("job_id", "id").alias("picture"), "line_no", "text"))
    df = loads.case_headline(rows, "picture").join(loads.gravity_of(rows, "picture"), "picture")
    return df.select("picture.job_id", "picture.id", "name", "subtitle", "gravity", "gravity_unit")


def complete_cases(drafted: DataFrame, lines: DataFrame, legends: DataFrame, typed: DataFrame, ctx: DataFrame) -> DataFrame:
    """From the draft and the readings of its pictures (setup lines; legends with ``vals``) to judged cases, with the values typed for them and the limits of
    their job. Written once: wording and checks start from it."""
    caps = legend.legend_cap(legends).select("job_id", "id", "cap")
    df = cases.with_readings(skew.settle(cases.case_rollup(drafted)), setup_readings(lines), caps)
    df = verdict.with_context(cases.with_typed(df, typed), ctx)
    return skew.settle(verdict.verdict(df), dear=True)


def job_messages(judged: DataFrame, extras: DataFrame, materials: DataFrame, mesh: DataFrame, ctx: DataFrame, assumptions: DataFrame, jobs: DataFrame) -> DataFrame:
    """From judged cases to all messages of their jobs in one ranking."""
    hints = skew.settle(checks.missing_inputs(ctx, judged, verdict.mesh_line(mesh), assumptions))
    return checks.rank_messages({"hint": [hints.filter("code = 'no_yield'")], "case": [checks.case_checks(judged), checks.extras_exceed_main(judged, extras)],
                                 "material": [checks.material_checks(materials)], "mesh": [checks.mesh_checks(mesh)], "evidence": [hints.filter("code <> 'no_yield'")]}, jobs)
