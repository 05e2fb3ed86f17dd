"""Fixed schemas of the input tables (null allowed unless a key)."""

PICTURES = """job_id BIGINT, id BIGINT, name STRING, path STRING, role STRING, confidence STRING, letter STRING, model STRING, unit STRING,
 width BIGINT, height BIGINT, max_value DOUBLE, min_value DOUBLE, notes ARRAY<STRING>, legend_values ARRAY<DOUBLE>, bc_legend ARRAY<STRING>,
 bc_draft ARRAY<STRUCT<legend: STRING, text: STRING, needs_input: BOOLEAN>>, headline_name STRING, headline_sub STRING,
 gravity STRUCT<value: DOUBLE, unit: STRING>, z_dir STRING, red_px BIGINT, legend_px DOUBLE, edge_density DOUBLE, result_kind STRING, hash STRING,
 dup_of BIGINT, user_set BOOLEAN, case_no BIGINT"""

OCR_LINES = "job_id BIGINT, image_id BIGINT, region STRING, pass BIGINT, line_no BIGINT, text STRING"
OCR_WORDS = "image_id BIGINT, word_id BIGINT, t STRING, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, conf DOUBLE, line STRUCT<block: INT, par: INT, line: INT>"
PIXELS = "image_id BIGINT, y BIGINT, x BIGINT, r BIGINT, g BIGINT, b BIGINT"
STATE_EVENTS = "sid BIGINT, seq BIGINT, saved_at TIMESTAMP, payload STRING, build_key STRING"

REPORT_CONFIG = """author STRING, mm_format STRING, missing STRING, object_short STRING, allowable_mpa DOUBLE,
 cover STRUCT<title: STRING, report_no: STRING, client: STRING>, layouts STRUCT<geometry: STRING, results: STRING>,
 cases ARRAY<STRUCT<name: STRING, max_deformation_mm: DOUBLE, max_stress_mpa: DOUBLE>>"""
