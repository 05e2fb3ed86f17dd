"""Operators give the same rows when almost every group is treated as hot."""

import pytest
from pyspark.sql import functions as F

from resultloom.operators import cases, checks, intake, legend, loads, pixels, report, state
from resultloom.plans import skew
from resultloom.sources import testviews as T

HOT = 5


def same(a, b):
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, a.select(sorted(a.columns)).collect()), key=key) == sorted(map(tuple, b.select(sorted(b.columns)).collect()), key=key)


@pytest.fixture(scope="module")
def pictures(spark, folder):
    return skew.settle(T.pictures(spark, folder).filter("job_id < 60"))


@pytest.fixture(scope="module")
def draft(pictures):
    step = skew.settle(intake.dedup_first(pictures))
    step = cases.group_by_letter(step)
    return skew.settle(cases.pick_main(cases.number_cases(cases.split_projects(step))))


def test_draft_chain(pictures, draft):
    step = intake.dedup_first(pictures, HOT)
    step = cases.number_cases(cases.split_projects(cases.group_by_letter(step, HOT), HOT), HOT)
    same(cases.pick_main(step, HOT), draft)


def test_draft_has_one_live_picture_per_content_and_one_main_per_slot(draft):
    live = draft.filter("dup_of IS NULL").groupBy("job_id", "hash").count().filter("count > 1")
    assert live.count() == 0
    mains = draft.filter("role IN ('bc', 'deformation', 'stress') AND case_no IS NOT NULL").groupBy("job_id", "case_no", "role").count()
    assert mains.filter("count > 1").count() == 0
    numbers = draft.filter("case_no IS NOT NULL").groupBy("job_id").agg(F.max("case_no").alias("m"), F.countDistinct("case_no").alias("c"))
    assert numbers.filter("m <> c").count() == 0


def test_headings_and_warnings(draft):
    same(cases.geometry_headings(draft, HOT), cases.geometry_headings(draft))
    same(cases.mesh_headings(draft, HOT), cases.mesh_headings(draft))
    same(cases.draft_warnings(draft, HOT), cases.draft_warnings(draft))


def test_legends(spark, folder):
    lines = T.legend_lines(spark, folder)
    a, b = legend.parse_legend(lines, hot_rows=HOT), legend.parse_legend(lines)
    same(a[0], b[0])
    same(a[1], b[1])
    words = T.words(spark, folder)
    same(legend.legend_text_height(words, hot_rows=HOT), legend.legend_text_height(words))
    same(legend.evidence_crop(words, "setup", 640, 480, hot_rows=HOT), legend.evidence_crop(words, "setup", 640, 480))


def test_budget_regions_pixels(spark, folder):
    calls = T.ocr_calls(spark, folder)
    same(intake.ocr_budget(calls, 20, 10, hot_rows=2), intake.ocr_budget(calls, 20, 10))
    lines = loads.clean_lines(T.bc_lines(spark, folder)).selectExpr("floor(case_id / 3) AS image_id", "case_id % 3 AS ordinal", "line_no", "text")
    same(loads.best_region(lines, hot_rows=2), loads.best_region(lines))
    px = T.pixels(spark, folder)
    same(pixels.pixel_stats(pixels.with_frame(px, 10)), pixels.pixel_stats(pixels.with_frame(px)))


def test_state(spark, folder):
    events = T.state_events(spark, folder)
    same(state.reuse_build(events, 1), state.reuse_build(events))
    same(state.debounce(events, 6 * 3600 * 1000, hot_rows=2), state.debounce(events, 6 * 3600 * 1000, slice_unit="day"))


def test_layouts(draft):
    rolled = skew.settle(cases.case_rollup(draft.withColumn("legend_px", F.when(F.col("id") % 2 == 0, 6.0 + F.col("id") % 7))))
    geo = cases.geometry_headings(draft).select("job_id", "id", "position", F.lit("geometry").alias("part"))
    views = skew.settle(geo)
    extras = cases.case_extras(draft)
    a = report.legibility(report.shown_pictures(rolled, views, extras, draft, HOT), HOT)
    same(a, report.legibility(report.shown_pictures(rolled, views, extras, draft)))
