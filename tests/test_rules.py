"""Golden values and small brute-force checks of single rules."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from resultloom import registry
from resultloom.functions import exprs as X, fixed
from resultloom.operators import cases, checks, intake, legend, loads, report, state, verdict
from resultloom.plans import skew
from resultloom.sources import readers, sinks, testviews


def one(spark, value, kind, make):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make("v").alias("r")).first()["r"]


@pytest.mark.parametrize("value", [2.42, 0.085, 12345.0, 0.000123456, 1e-5, 7.8e-9, 1e6, 999999.5, 122.5, 0.0, -3.5, 123.45678, 2.675, 100.0, 4235905.0, -6182265.0, 1225.0, 12350.0, 1e7, 1.5e22, 2.5e-120])
def test_number_text_is_like_python(spark, value):
    assert one(spark, value, "double", X.general_text) == f"{value:g}"
    assert one(spark, value, "double", lambda c: X.fixed_text(c, 2)) == f"{value:.2f}"
    assert one(spark, value, "double", X.grouped_text) == f"{value:,.0f}"
    assert one(spark, value, "double", X.mm_text) == f"{float(f'{value:.3g}'):g}"


@pytest.mark.parametrize("value,text", [(12250.0, "12200"), (12350.0, "12400"), (0.00045678, "0.000457"), (2.5e-7, "0.00000025"), (1.2345e9, "1230000000"), (-999.6, "-1000"), (0.0, "0"), (None, None), (float("inf"), None)])
def test_significant_digits(spark, value, text):
    assert one(spark, value, "double", X.sig_text) == text


@pytest.mark.parametrize("text,value", [("24,7", 24.7), (" 1.e+006 ", 1e6), ("1.5d", None), ("n/a", None), ("nan", None), ("inf", None), ("1_000", 1000.0), ("", None), ("1e999", None), (".5", 0.5)])
def test_to_float(spark, text, value):
    assert one(spark, text, "string", X.to_float) == value


@pytest.mark.parametrize("n,label", [(1, "A"), (26, "Z"), (27, "AA"), (52, "AZ"), (53, "BA"), (702, "ZZ"), (703, "AAA"), (18278, "ZZZ")])
def test_list_letter(spark, n, label):
    assert one(spark, n, "bigint", X.list_letter) == label


@pytest.mark.parametrize("n", [(1 << 63) - 1, 1 << 63, 26 ** 14, (26 ** 15 - 1) // 25 - 1, (26 ** 15 - 1) // 25, 899_999 * 8_999_996 * 8_999_999, 10 ** 30, 2 * 10 ** 37])
def test_list_letter_beyond_a_long(spark, n):
    rest, label = n, ""
    while rest:
        rest, k = divmod(rest - 1, 26)
        label = chr(65 + k) + label
    assert one(spark, Decimal(n), "decimal(38,0)", X.list_letter) == label
    assert one(spark, None, "decimal(38,0)", X.list_letter) == one(spark, None, "bigint", X.list_letter) == ""


def test_list_letters_of_large_orders(spark, tmp_path):
    spark.createDataFrame([(8_999_999, 899_999), (30, 2), (3, 5), (None, 1)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r["o_orderkey"]: r["letter"] for r in registry.queries()["j12_list_letter"](spark, str(tmp_path)).collect()}
    assert got == {8_999_999: one(spark, Decimal(8_999_996 * 8_999_999 * 899_999), "decimal(38,0)", X.list_letter), 30: "BJH", 3: "", None: ""}


def test_texts(spark):
    assert one(spark, "load 5 mm and 3 mmWC, 7 N", "string", X.glue_units) == "load 5\u00a0mm and 3\u00a0mmWC, 7\u00a0N"
    assert one(spark, "duct GG", "string", X.object_label) == "Duct GG"
    assert one(spark, "GG", "string", X.object_label) == "GG"
    assert one(spark, "a\x07b\tc", "string", X.xml_safe) == "ab\tc"
    assert one(spark, "x" * 398 + "   tail", "string", X.shorten) == "x" * 398 + "..."
    assert one(spark, "case1_hot spot.png", "string", X.view_hint) == "detail"
    assert one(spark, "closed_section.v2.png", "string", X.view_hint) == "section"


@pytest.mark.parametrize("name,role,case,letter", [
    ("case1_bc.png", "bc", 1, "A"), ("lc2_stress.png", "stress", 2, "B"), ("lc2_stress_section.png", "x_stress", 2, "B"), ("Overall mesh.png", "mesh", None, None),
    ("holiday.jpg", "unknown", None, None), ("usum-c3.png", "deformation", 3, "C"), ("model top.png", "geometry", None, None)])
def test_classify_by_name(spark, name, role, case, letter):
    r = intake.classify_by_name(spark.createDataFrame([(name,)], "name string")).first()
    assert (r["role"], r["case_no"], r["letter"]) == (role, case, letter)


def test_header_unit_across_lines(spark):
    lines = [(1, i, t) for i, t in enumerate(["A: duct x", "Total Deformation"], 1)] + [(2, i, f"line {i}") for i in range(1, 9)] + [(2, 9, "Unit"), (2, 10, ": mm")]
    got = {r["image_id"]: r for r in intake.classify_by_header(spark.createDataFrame(lines, "image_id bigint, line_no bigint, text string")).collect()}
    assert got[1]["role"] == "deformation" and got[1]["model"] == "duct"
    assert got[2]["unit"] == "mm" and got[2]["role"] == "x_other"


def legend_of(spark, texts):
    df = spark.createDataFrame([(1, 0, i, t) for i, t in enumerate(texts, 1)], "image_id bigint, pass bigint, line_no bigint, text string")
    reads, values = legend.parse_legend(df)
    r = reads.first()
    return r["max"], r["min"], [v["value"] for v in values.orderBy("line_no").collect()]


def test_parse_legend(spark):
    assert legend_of(spark, ["me 292 Max", "| 1 256", "24,7", "a long text 3", "1.e+006", "0.5 Min", "9"]) == (292.0, 0.5, [292.0, 256.0, 24.7, 1e6])
    assert legend_of(spark, ["3 Min", "7 Max", "6", "8 Max", "5"]) == (7.0, 3.0, [7.0, 6.0, 5.0])
    assert legend_of(spark, ["nothing", "4 Min", "2 Min"]) == (None, 2.0, [])


def test_repair_golden(spark):
    df = spark.createDataFrame([(1, [2.12, 188.0, 1.65, 1.41]), (2, [10.0, 50.0, 8.0]), (3, [5.0, 4.0]), (4, [])], "image_id bigint, vals array<double>")
    got = {r["image_id"]: (r["vals"], r["repairs"]) for r in legend.repair_monotonic(df).collect()}
    assert got[1] == ([2.12, 1.88, 1.65, 1.41], ["legend value 188 repaired to 1.88"])
    assert got[2] == ([10.0, 8.0], ["legend value 50 ignored"]) or got[2][0][1] < 10
    assert got[3] == ([5.0, 4.0], []) and got[4] == ([], [])


def test_repair_always_falls_and_keeps_the_first(spark):
    rnd = random.Random(3)
    data = [(i, [round(rnd.uniform(1, 500), 2) for _ in range(rnd.randrange(1, 12))]) for i in range(300)]
    got = {r["image_id"]: r["vals"] for r in legend.repair_monotonic(spark.createDataFrame(data, "image_id bigint, vals array<double>")).collect()}
    for i, v in data:
        assert got[i][0] == v[0] and all(a > b for a, b in zip(got[i], got[i][1:]))


@pytest.mark.parametrize("line,text", [("(Ay Fixed Support", "Fixed Support"), ("[Bl Pressure: 5 Pa", "Pressure: 5 Pa"), ("i] Fixed Support", "Fixed Support"), ("Static Structural load", None), ("hello", None)])
def test_clean_lines(spark, line, text):
    got = loads.clean_lines(spark.createDataFrame([(1, line)], "line_no bigint, text string")).first()
    assert (got["text"] if got else None) == text


@pytest.mark.parametrize("line,kind,si,needs", [("Pressure: 1.5 bar", "pressure", 0.15, False), ("Torque: 2 kN-m", "moment", 2e6, True), ("Force: 3 kN", "force", 3000.0, True), ("Pressure", "other", None, True),
                                                ("Standard Earth Gravity: 9806.6 mm/s2", "gravity", None, False), ("Temperature: 22 C", "temperature", 22.0, False), ("Remote Displacement", "remote_displacement", None, True)])
def test_normalise_loads(spark, line, kind, si, needs):
    r = loads.normalise_loads(spark.createDataFrame([(line,)], "text string")).first()
    assert (r["load_type"], r["needs_input"]) == (kind, needs)
    assert r["value_si"] == (pytest.approx(si) if si is not None else None)


def test_longest_prefix_decides_the_project(spark):
    rnd = random.Random(5)
    words = ["12_duct a", "12_duct b", "12_gate", "7_x", "7_xy", "", "12_duct"]
    data = [(1, i, rnd.choice(["bc", "deformation", "stress"]), "A", rnd.choice(words) + rnd.choice(["", "1", "2"])) for i in range(80)]
    df = spark.createDataFrame(data, "job_id bigint, id bigint, role string, group_letter string, model string")
    got = {r["id"]: (r["sub_model"], r["sub_id"]) for r in cases.split_projects(df).collect()}
    norm = lambda m: m.lower().replace("_", " ").strip()
    setups = sorted((norm(m), i) for _, i, r, _, m in data if r == "bc")

    def shared(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    for _, i, role, _, m in data:
        want = (norm(m), i) if role == "bc" else max(range(len(setups)), key=lambda k: (shared(norm(m), setups[k][0]), -k))
        assert got[i] == (want if role == "bc" else setups[want])


def test_headline(spark):
    lines = [(1, 1, "Gravity"), (1, 2, "Force: 1 N"), (1, 3, "Pressure: 1 Pa"), (1, 4, "Force: 2 N"), (2, 1, "Pressure"), (3, 1, "Fixed Support")]
    got = {r["case_id"]: (r["name"], r["subtitle"]) for r in loads.case_headline(spark.createDataFrame(lines, "case_id bigint, line_no bigint, text string")).collect()}
    assert got == {1: ("Force + Pressure", "(Self Weight + Force + Pressure)"), 2: ("Pressure Only", "(Pressure)"), 3: ("", "")}


def test_tier_edges(spark):
    data = [(192.0,), (192.1,), (250.0,), (499.9,), (500.0,), (None,)]
    df = verdict.fixed_context(spark.createDataFrame(data, "stress_max double"), 192, 250)
    assert [r["tier"] for r in verdict.tier(df).collect()] == ["pass", "exceeds", "exceeds", "beyond_yield", "suspect", None]


def test_placeholders(spark):
    df = spark.createDataFrame([(1, "a [x - please confirm] b [Not Entered] [other]")], "id bigint, text string")
    assert [r["token"] for r in checks.placeholder_scan(df).collect()] == ["[x - please confirm]", "[Not Entered]"]


def test_files_and_sinks(spark, tmp_path):
    job = tmp_path / "in" / "job7"
    job.mkdir(parents=True)
    (job / "a.PNG").write_bytes(bytes.fromhex("89504E470D0A1A0A") + b"x")
    (job / "b.png").write_bytes(b"not a picture")
    (job / "c.txt").write_bytes(b"text")
    files = readers.read_pictures(spark, str(tmp_path / "in"))
    good, skipped = readers.scan_pictures(files)
    assert [(r["job_id"], r["id"], r["name"]) for r in good.collect()] == [("job7", 0, "a.PNG")]
    assert sorted(r["name"] for r in skipped.collect()) == ["b.png", "c.txt"]
    pics = readers.from_records(spark.createDataFrame([('{"job_id": 1, "id": 2, "name": "x", "notes": ["n"], "hash": "h"}',)], "record string"))
    sinks.write_session(pics, str(tmp_path / "session"))
    assert readers.read_session(spark, str(tmp_path / "session")).collect() == pics.collect()
    public = readers.public_projection(pics)
    assert "hash" not in public.columns and public.first()["url"] == "/api/img/1/2"
    sinks.write_report_model(str(tmp_path / "model"), buckets=4, rows=spark.range(10).withColumnRenamed("id", "job_id"))
    assert sinks.read_report_model(spark, str(tmp_path / "model"), "rows").count() == 10
    (tmp_path / "cfg.json").write_text('{\n "author": "me",\n "cases": [{"name": "a"}]\n}')
    assert readers.read_report_config(spark, str(tmp_path / "cfg.json")).first()["author"] == "me"


def test_report_model_written_again_replaces_its_jobs(spark, tmp_path):
    path, kind = str(tmp_path / "model"), "job_id long, n long"
    rows = [(j, n) for j in range(20) for n in range(3)] + [(None, 7)]
    for _ in range(2):
        sinks.write_report_model(path, buckets=4, rows=spark.createDataFrame(rows, kind))
    sinks.write_report_model(path, buckets=4, rows=spark.createDataFrame([(3, 9), (None, 8)], kind).groupBy("job_id").agg(F.max("n").alias("n")))
    got = [tuple(r) for r in sinks.read_report_model(spark, path, "rows").select("job_id", "n").collect()]
    want = [(j, n) for j, n in rows if j not in (3, None)] + [(3, 9), (None, 8)]
    assert sorted(got, key=str) == sorted(want, key=str)
    # its own rows, read and changed
    again = sinks.read_report_model(spark, path, "rows").withColumn("n", F.col("n") + 1)
    sinks.write_report_model(path, buckets=4, rows=again)
    got = [tuple(r) for r in sinks.read_report_model(spark, path, "rows").select("job_id", "n").collect()]
    assert sorted(got, key=str) == sorted(((j, n + 1) for j, n in want), key=str)
    assert len(list((tmp_path / "model" / "rows").glob("*/*.parquet"))) <= 8


def test_publish_once(spark):
    new = spark.createDataFrame([("a.pptx", "1", "2024-01-02 03:04:05"), ("b.pptx", "2", "2024-01-02 03:04:05"), ("c.pptx", "3", "2024-01-02 03:04:05")], "name string, content string, made_at string").withColumn("made_at", F.col("made_at").cast("timestamp"))
    old = spark.createDataFrame([("a.pptx", "1"), ("b.pptx", "x")], "name string, content string")
    assert sorted(r["published_name"] for r in sinks.publish_once(new, old).collect()) == ["b_030405.pptx", "c.pptx"]


def test_views_on_slides(spark):
    data = [(1, "g", i, i, f"h{i}", m) for i in range(1, 4) for m in ("side",)] + [(2, "g", i, i, f"h{i}", "separate") for i in range(1, 3)] + [(3, "g", 1, 1, "h1", "side")]
    df = spark.createDataFrame(data, "job_id bigint, part string, id bigint, position bigint, heading string, mode string")
    got = {(r["job_id"], r["id"]): (r["slide"], r["place"], r["slide_title"]) for r in report.chunk_views(df, F.lit("T")).collect()}
    assert got == {(1, 1): (1, 0, "T"), (1, 2): (1, 1, "T"), (1, 3): (2, 0, "T – h3"), (2, 1): (1, 0, "T – h1"), (2, 2): (2, 0, "T – h2"), (3, 1): (1, 0, "T")}


def test_repair_has_no_limit(spark):
    """Two hundred faults are all put right."""
    vals = [1000.0 - i * (1 if i % 2 else 0.01) for i in range(400)]
    r = legend.repair_monotonic(spark.createDataFrame([(1, vals)], "image_id bigint, vals array<double>")).first()
    assert all(a > b for a, b in zip(r["vals"], r["vals"][1:])) and len(r["repairs"]) > 150


def test_names_blanks_and_letters(spark):
    df = spark.createDataFrame([("https://model.host/page/3.png", "a\u00a0\u2003b\x1c c.", 18279), ("C:\\job\\x.y.jpg", "\u3000", 0), ("plain", None, 475255)], "name string, t string, n long")
    got = [tuple(r) for r in df.select(X.stem("name"), X.clean("t"), X.list_letter("n")).collect()]
    assert got == [("3", "a b c", "AAAA"), ("x.y", "", ""), ("plain", "", "AAAAA")]


@pytest.mark.parametrize("lines_of_a_segment", [1, 3, 4096])
def test_readings_may_be_cut_anywhere(spark, monkeypatch, lines_of_a_segment):
    """Max, Min and value lines in any order: the summaries of segments join to what one walk over the lines finds."""
    monkeypatch.setattr(legend, "LINES", lines_of_a_segment)
    rnd = random.Random(11)
    kinds = ["{} Max", "{} Min", "| {}", "{}", "a long text {}", "none"]
    data = [(image, p, n, rnd.choice(kinds).format(rnd.randrange(1, 900))) for image in range(150) for p in (0, 1) for n in range(rnd.randrange(1, 14))]
    want = {}
    for image, p, _, _ in data:
        mine = sorted((n, t) for i, q, n, t in data if (i, q) == (image, p))
        number = lambda t: float(t.replace("|", " ").split()[0])
        top = next(((n, number(t)) for n, t in mine if t.endswith("Max")), None)
        behind = next(((n, number(t)) for n, t in mine if top and n > top[0] and t.endswith("Min")), None)
        ahead = [(n, number(t)) for n, t in mine if t.endswith("Min") and (top is None or n < top[0])]
        rest = [number(t) for n, t in mine if top and n > top[0] and (behind is None or n < behind[0]) and t[-1].isdigit() and not t.startswith("a")]
        low = behind or (ahead[-1] if ahead else None)
        want[image, p] = (top and top[0], top and top[1], behind and behind[0], low and low[1], len(rest) if top else None, rest[0] if rest else None)
    df = spark.createDataFrame(data, "image_id bigint, pass bigint, line_no bigint, text string").repartition(7)
    got = {(r["image_id"], r["pass"]): (r["max_line"], r["max"], r["end_line"], r["min"], r["more"], r["second"]) for r in legend.read_passes(df).collect()}
    assert got == want


def test_lines_are_shuffled_once_to_the_chosen_maximum(spark):
    df = skew.settle(spark.range(10).selectExpr("id % 2 AS image_id", "id % 2 AS pass", "id AS line_no", "'3 Max' AS text").repartition(3))
    plan = legend.reconcile_passes(legend.read_passes(df))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 3     # by segment, then two of summaries: by reading and by picture


def test_state_key_tells_values_and_not_spellings(spark):
    same = ['{"a": 1, "b": {"y": [1, 2.50, null], "x": "é\\"q"}, "make_pdf": true}', '{"b":{"x":"é\\"q","y":[1.0,2.5,null]},"make_pdf":false,"a":1.0}', ' { "a" : 1 , "b" : { "x" : "é\\"q" , "y" : [ 1 , 2.5 , null ] } } ']
    other = ['{"a": 2, "b": {"y": [1, 2.50, null], "x": "é\\"q"}}', '{"a": 1, "b": {"y": [2.50, 1, null], "x": "é\\"q"}}', '{"a": 1, "b": {"y": [1, 2.50], "x": "é\\"q"}}', '{"a": 1, "b": {"y": [1, 2.50, null], "x": "é\\"q", "make_pdf": true}}',
             '{"a": "1", "b": {"y": [1, 2.50, null], "x": "é\\"q"}}', "{}", "[1]", "7"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*same, *other, "no document", None])], "i bigint, t string")
    keys = [r["build_key"] for r in state.state_key(df, "t").orderBy("i").collect()]
    assert len(set(keys[:3])) == 1 and len(set(keys[2:-2])) == 1 + len(other) and keys[-2:] == [None, None]


def test_common_prefix_of_long_texts(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(60):
        n = rnd.choice((0, 1, 63, 64, 65, 1000, 9_999, 10_000))
        base = "é" * n
        rows.append((i, base + "a" * rnd.randrange(3), base + "b" * rnd.randrange(3), n))
    df = spark.createDataFrame(rows, "i bigint, a string, b string, n bigint").select("n", X.common_prefix("a", "b").alias("p"))
    assert all(r["n"] == r["p"] for r in df.collect())
    assert spark.createDataFrame([(None, "a")], "a string, b string").select(X.common_prefix("a", "b").alias("p")).first()["p"] is None


def test_settings_of_a_job(spark):
    docs = [None, "{}", '{"mesh_limits": {"oq_min_warn": 0.2}, "_x": 1, "fos": 2}', '{"fos": ', '{"assumption_library": ["a", "b"], "material": {"E": "7"}}']
    df = readers.job_settings(spark.createDataFrame(list(enumerate(docs)), "job_id bigint, settings_json string"))
    got = {r["job_id"]: (r["settings_ok"], r["settings"]) for r in df.collect()}
    assert [got[i][0] for i in range(5)] == [True, True, True, False, True]
    plain = fixed.SETTINGS["mesh_limits"]
    assert got[0][1].asDict(True)["mesh_limits"] == got[3][1].asDict(True)["mesh_limits"] == plain and got[2][1].asDict(True)["mesh_limits"] == {**plain, "oq_min_warn": 0.2}
    assert got[2][1]["fos"] == 2.0 and got[4][1]["fos"] == 1.3 and got[4][1]["assumption_library"] == ["a", "b"] and got[4][1]["material"]["E"] == "7" and got[4][1]["material"]["nu"] == "0.3"


def test_published_versions(spark, tmp_path):
    path = str(tmp_path / "published")
    make = lambda rows: spark.createDataFrame(rows, "name string, content string, made string").withColumn("made_at", F.to_timestamp("made")).drop("made")
    first = make([("a.pptx", "one", "2024-01-01 01:02:03"), ("b.pptx", "two", "2024-01-01 01:02:03")])
    assert sinks.publish(path, first) == 1 and sinks.publish(path, first) == 1
    second = make([("a.pptx", "new", "2024-01-02 04:05:06"), ("b.pptx", "two", "2024-01-02 04:05:06"), ("c.pptx", "three", "2024-01-02 04:05:06")])
    second.select("name", "content").withColumn("version", F.lit(2)).write.parquet(path + "/runs/killed")
    assert sinks.publish(path, second) == 2 and sinks.publish(path, second) == 2
    want = {("a.pptx", "one", 1), ("b.pptx", "two", 1), ("a_040506.pptx", "new", 2), ("c.pptx", "three", 2)}
    assert {tuple(r) for r in sinks.published(spark, path).select("name", "content", "version").collect()} == want
    with pytest.raises(Exception, match="exist"):
        sinks.commit(spark, path, 2, "killed")
    assert {tuple(r) for r in sinks.published(spark, path).select("name", "content", "version").collect()} == want


def test_readings_of_a_case(spark):
    """Headline, gravity and cap come from the main pictures; cases without a setup picture, and pictures without readings, keep their defaults."""
    base = spark.createDataFrame([(1, 1, 10, 11, "Load Case 1", "(Self Weight + Pressure)"), (1, 2, None, 12, "Load Case 2", "(Self Weight + Pressure)"),
                                  (2, 1, 10, None, "Load Case 1", "(Self Weight + Pressure)"), (None, 1, 10, 11, "Load Case 1", "")],
                                 "job_id long, n long, bc_id long, stress_id long, name string, subtitle string")
    setup = spark.createDataFrame([(1, 10, "Force Only", "(Force)", 9806.6, "mm/s2"), (2, 10, "", "", None, None), (1, 99, "Other", "", 1.0, "m/s2")],
                                  "job_id long, id long, name string, subtitle string, gravity double, gravity_unit string")
    caps = spark.createDataFrame([(1, 11, 192.0), (1, 12, None), (2, 11, 5.0)], "job_id long, id long, cap double")
    got = {(r["job_id"], r["n"]): (r["name"], r["short_name"], r["subtitle"], r["gravity"], r["cap"]) for r in cases.with_readings(base, setup, caps).collect()}
    default = "(Self Weight + Pressure)"
    assert got == {(1, 1): ("Force Only", "Force Only", "(Force)", 9806.6, 192.0), (1, 2): ("Load Case 2", "Load Case 2", default, None, None),
                   (2, 1): ("Load Case 1", "Load Case 1", default, None, None), (None, 1): ("Load Case 1", "Load Case 1", "", None, None)}
    rows = spark.createDataFrame([(1, 10, 2, "b"), (1, 10, 1, "a"), (1, 11, 1, "x"), (2, 10, 1, "c"), (3, 10, 1, "lost"), (1, None, 1, "none")], "job_id long, id long, line_no long, text string")
    assert sorted((r["job_id"], r["n"], r["text"]) for r in cases.rows_of_main(base, rows, "bc_id").collect()) == [(1, 1, "a"), (1, 1, "b"), (2, 1, "c")]
    typed = spark.createDataFrame([(1, 1, "refine", 3.5)], "job_id long, n long, basis string, stress_away double")
    words = {(r["job_id"], r["n"]): (r["basis"], r["loc_stress"], r["stress_away"], r["react_sum"]) for r in cases.with_typed(base, typed).collect()}
    assert words[1, 1] == ("refine", "", 3.5, None) and words[1, 2] == ("", "", None, None) and len(words) == 4
    assert cases.with_readings(base.limit(0), setup, caps).count() == 0 and cases.rows_of_main(base, rows.limit(0), "bc_id").count() == 0


def test_checks_write_no_texts_of_a_verdict(spark, tmp_path, monkeypatch):
    """Only what a check reads is made: the table that the caps are looked up for is written without captions and cells."""
    registry.queries()
    from resultloom.registry import checks as queries
    spark.createDataFrame([(k, k % 3, "OFP"[k % 3], 1000.0 * k, p) for k, p in enumerate(["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"] * 5)],
                          "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, "x", k, 1.0, "A") for k in range(3)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(k, [0.1 * k, 0.2, 0.5, 0.9]) for k in range(15)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    written, keep = [], skew.settle
    monkeypatch.setattr(skew, "settle", lambda df, dear=False: written.append(df.columns) or keep(df, dear))
    found = queries.checked(spark, str(tmp_path))
    assert found.count() == 20 and "cell_stress" in found.columns
    assert written and not any({"cell_stress", "stress_caption", "t_mpa"} & set(c) for c in written)


def line_items(spark, path, rows=60):
    """Pictures of three jobs, as the tables that the input view reads."""
    spark.createDataFrame([(k % 3 + 1000 * (k // 9), k % 4, k % 7, 1 + k % 7, 50.0 - k % 9, 100.0 * k, 0.0, 0.0, "ANR"[k % 3], "OF"[k % 2]) for k in range(rows)],
                          "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
                          ).withColumn("l_shipdate", F.lit("2024-01-01").cast("timestamp")).write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(k, f"red pipe {k}", f"Brand {k}") for k in range(4)], "p_partkey long, p_name string, p_brand string").write.parquet(f"{path}/part.parquet")
    return str(path)


def test_steps_of_a_draft_write_only_what_is_asked_for(spark, tmp_path, monkeypatch):
    queries, folder = registry.queries(), line_items(spark, tmp_path)
    written, keep = [], skew.settle
    monkeypatch.setattr(skew, "settle", lambda df, dear=False: written.append(df.columns) or keep(df, dear))
    whole = {"name", "z_dir", "red_px", "width", "height"}
    for name, spare in (("f1_group_by_letter", whole | {"model", "max_value", "user_set"}), ("f3_number_cases", whole | {"max_value", "user_set"}), ("f4_pick_main", whole)):
        written.clear()
        assert queries[name](spark, folder).count() == 60
        assert written and not any(spare & set(c) for c in written)
    from resultloom.registry import cases as of_cases
    assert "hash" not in of_cases.mains(spark, folder).columns
    for name in ("f8_merge_user_edits", "f8_merge_extra_edits", "f8_merge_setup_lines"):
        monkeypatch.setattr(of_cases, "mains", lambda spark, folder, draft=of_cases.mains(spark, folder): draft)
        monkeypatch.setattr(of_cases.T, "assignments", lambda spark, folder: spark.createDataFrame([(0, 1, "stress", 1)], "job_id long, id long, role string, case_no long"))
        written.clear()
        assert queries[name](spark, folder).count() and written and not any({"width", "z_dir", "dup_of"} & set(c) for c in written)


def test_session_files_are_compressed(spark, tmp_path, monkeypatch):
    import glob
    queries, folder = registry.queries(), line_items(spark, tmp_path / "in")
    monkeypatch.setattr(skew, "scratch_folder", lambda spark: str(tmp_path))
    got = queries["a3_session_files"](spark, folder).collect()
    assert len([r for r in got if r["kind"] == "record"]) == 60 and {r["generation"] for r in got if r["kind"] == "record" and r["id"] != 7} == {2}
    files = glob.glob(f"{tmp_path}/resultloom-sessions-*/part-*")
    assert files and all(f.endswith(".gz") for f in files)


def test_sentences_of_checks_are_made_once(spark):
    df = spark.createDataFrame([(1, 1, 3.0, "x"), (1, 2, None, "x"), (1, 3, 3.0, None), (1, 4, 1.0, "x"), (2, 1, 9.0, "y")], "job_id bigint, n bigint, v double, t string")
    over = checks.rule(1, "bad", "over", F.col("v") > 2, X.fill("{n}: {t}", n="n", t="t"))
    far = checks.rule(2, F.when(F.col("v") > 8, F.lit("warn")), "far", F.col("v") > 8, X.fill("far {n}", n="n"))
    found = checks.emit(df, [over, far])
    assert "size(" not in found._jdf.queryExecution().optimizedPlan().toString()     # a filter there would make all sentences a second time
    assert sorted(map(tuple, found.collect())) == [(1, 1, 1, "bad", "over", "1: x"), (2, 1, 1, "bad", "over", "1: y"), (2, 1, 2, "warn", "far", "far 1")]


def test_steps_of_a_draft_read_only_pictures_of_cases(spark, monkeypatch):
    from resultloom.operators import intake
    from resultloom.plans import chains
    roles = ["bc", "deformation", "stress", "x_stress", "geometry", "mesh", "bc", None, "unknown"]
    data = [(j, k, f"h{k % 14}" if k else None, roles[k % 9], "AB"[k % 2] if j else None, f"part_{k % 3}", 1.0 * k if k % 4 else None, k % 5 == 0) for j in (0, 1, None) for k in range(27)]
    pictures = spark.createDataFrame(data, "job_id long, id long, hash string, role string, letter string, model string, max_value double, user_set boolean")
    want = cases.pick_main(cases.number_cases(cases.split_projects(cases.group_by_letter(intake.dedup_first(pictures).drop("hash")))))
    written, keep = [], skew.settle
    monkeypatch.setattr(skew, "settle", lambda df, dear=False: written.append(df) or keep(df, dear))
    got = chains.draft(pictures)
    stepped = [df for df in written if "role" in df.columns and "hash" not in df.columns]
    assert stepped and not any(df.filter("role IS NULL OR role IN ('geometry', 'mesh', 'unused', 'unknown')").count() for df in stepped)
    assert sorted(map(str, got.select(sorted(want.columns)).collect())) == sorted(map(str, want.select(sorted(want.columns)).collect()))
    assert got.filter("auto_extra IS NULL").count() == 0 and got.filter("role = 'unused'").count() and got.filter("case_no > 1").count()


def test_limits_are_parsed_once_per_job(spark, tmp_path):
    from resultloom.registry import verdict as queries
    spark.createDataFrame([(k, k % 30, "O", 9000.0 * k, "5-LOW") for k in range(60)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, "x", k, 1.0, "A") for k in range(28)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    found = queries.case_table(spark, str(tmp_path))
    limited = found.filter("allow IS NOT NULL").select("job_id", "n")
    assert "RLIKE" not in limited._jdf.queryExecution().optimizedPlan().toString().upper()   # such a filter on the key would run for every case
    assert found.count() == 60 and limited.count() == 60 - 2 * 6
    plain = verdict.verdict(found.drop("t_allow", "t_lim", "t_sy"))
    assert sorted(map(str, plain.select("job_id", "n", "t_allow", "t_lim", "t_sy").collect())) == sorted(map(str, verdict.verdict(found).select("job_id", "n", "t_allow", "t_lim", "t_sy").collect()))


def test_pictures_without_copies_are_those_of_the_first_content(spark):
    """Rows without a job, an id or a content are copies of none; a row that comes twice stays twice; most copies are left out before the join."""
    from resultloom.operators import intake
    data = [(j, k, f"h{k % 9}" if k % 7 else None, "stress") for j in (1, 2, None) for k in range(120)] + [(1, None, "h1", "stress"), (2, 4, "h4", "bc"), (2, 1, "h1", "bc")]
    pictures = spark.createDataFrame(data, "job_id long, id long, hash string, role string")
    want = intake.dedup_first(pictures).filter("dup_of IS NULL")
    kept, groups = intake.same_content(pictures)
    for hot in (3, 50, None):
        got = intake.without_copies(kept, groups, hot)
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    few = skew.sieve(kept, groups.select("job_id", F.col("__first").alias("id")), ["job_id", "id"], F.col("hash").isNull(), 3)
    assert want.count() <= few.count() < pictures.count() - 150


def test_legend_values_are_made_without_copies(spark, tmp_path, monkeypatch):
    """The draft of the cases needs no copies of pictures, so none are looked up or written; each main stress picture shows its whole legend."""
    from resultloom.operators import intake
    from resultloom.registry import cases as draft
    lines = [(1000 * k + j, 1 + k % 4, 1 + k % 11, 1 + k % 3, 10.0, 100.0 * k + j, 0.0, 0.0, "AN"[j % 2], "F", "1995-01-01") for j in range(6) for k in range(1, 25)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                          "l_linestatus string, l_shipdate string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, f"B{k}", f"part {k}") for k in range(1, 5)], "p_partkey long, p_brand string, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(k, k % 30, "O", 9000.0 * k, "5-LOW") for k in range(60)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, "x", k, 1.0, "A") for k in range(6)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    vectors = {k: [round(((k * 7 + i * 3) % 20) / 20 - 0.5, 3) for i in range(4)] for k in range(0, 500, 2)}
    spark.createDataFrame([*vectors.items()], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    asked, keep = [], intake.mark_copies
    monkeypatch.setattr(intake, "mark_copies", lambda *a: asked.append(a) or keep(*a))
    got = sorted((r["job_id"], r["n"], r["id"], r["pos"], r["value"]) for r in registry.queries()["f6_legend_values"](spark, str(tmp_path)).collect())
    assert len(asked) == 1 and (spark.sparkContext.applicationId, str(tmp_path), "copies") not in draft._tables
    rolled = cases.case_rollup(draft.mains(spark, str(tmp_path))).filter("stress_id IS NOT NULL").collect()
    legends = {r["image_id"]: r["vals"] for r in testviews.legend_arrays(spark, str(tmp_path)).collect()}
    want = [(r["job_id"], r["n"], r["stress_id"], i, v) for r in rolled for i, v in enumerate(legends.get((r["job_id"] * 31 + r["stress_id"]) % 500, []))]
    assert got == sorted(want) and len(want) > 8 and len(want) < 4 * len(rolled)
