import datetime as dt

from helpers import empty_docs, odd_docs

from resultloom.llm import cotraining, url_lists
from resultloom.llm.common import table


def test_temporal_lists(spark):
    day = dt.date
    entries = [("Example.com.", day(2024, 1, 5), "block"), ("example.com", day(2024, 2, 1), "remove"), ("ok.example.com", day(2024, 1, 10), "allow"), ("b.org", day(2024, 1, 1), "allow"),
               ("b.org", day(2024, 1, 1), "block"), (None, day(2024, 1, 1), "block"), ("c.org", None, "block"), ("c.org", day(2024, 1, 1), "maybe")]
    cases = [("http://example.com/x", 4, None), ("http://a.example.com:80/x", 5, ("example.com", "block")), ("https://u:p@OK.example.com./", 9, ("example.com", "block")), ("http://ok.example.com", 10, ("ok.example.com", "allow")),
             ("http://ok.example.com", 40, ("ok.example.com", "allow")), ("http://example.com?q", 31, None), ("ftp://b.org#f", 0, ("b.org", "block")), ("http://c.org/", 3, None), ("http://notexample.com", 6, None),
             (None, 6, None), ("no scheme", 6, None), ("http://" + "a." * 200 + "example.com", 6, ("example.com", "block")), ("http://" + "a" * 300 + ".ok.example.com", 40, ("ok.example.com", "allow")), ("http://example.com/x", None, None), ("http://a.example.com:80/x", 5, ("example.com", "block"))]
    start = day(2024, 1, 1)
    rows = [(i, u, None if d is None else start + dt.timedelta(days=d if d != 4 else 3), "x") for i, (u, d, _) in enumerate(cases)]
    rows = [(i, u, d if d is None or cases[i][1] in (4, 0, 31) else d - dt.timedelta(days=1), x) for i, u, d, x in rows]
    df = spark.createDataFrame(rows, "id long, url string, fetched date, action string")
    got = {r["id"]: r for r in url_lists.judge(df, spark.createDataFrame(entries, "domain string, day date, action string")).collect()}
    for i, (_, _, want) in enumerate(cases):
        assert ((got[i]["listed_domain"], got[i]["action"]) if got[i]["action"] else None) == want, (i, got[i])
        assert got[i]["blocked"] == bool(want and want[1] == "block")
    assert url_lists.judge(df, spark.createDataFrame([], "domain string, day date, action string")).filter("blocked").count() == 0
    assert url_lists.judge(df.limit(0), spark.createDataFrame(entries, "domain string, day date, action string")).count() == 0


def test_held_out_accuracy(spark):
    """Labels of every fifth document are kept from the training; good ones stay, most bad ones go."""
    folder = "/root/testdata/sf0.1"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    out = cotraining.score(docs, labels.filter("doc_id % 5 <> 0"), rounds=1).join(labels.filter("doc_id % 5 = 0"), "doc_id")
    n = {(r["quality_label"], r["kept"]): r["count"] for r in out.select("kept", labels["quality"].alias("quality_label")).groupBy("quality_label", "kept").count().collect()}
    assert n[1, True] > 0.97 * (n[1, True] + n.get((1, False), 0)) and n.get((0, False), 0) > 0.5 * (n.get((0, False), 0) + n.get((0, True), 0))


def test_odd_rows(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(0, 1, 0), (3, None, 0), (None, 1, 1), (18, 0, 0), (18, 0, 0), (21, 1, 0), (27, 0, 1)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.filter("quality = 1"), labels.limit(0)):
        rows = cotraining.score(docs, some).collect()
        assert len(rows) == docs.count() and all(0 <= r["quality"] <= 1 for r in rows)
    assert cotraining.score(empty_docs(spark), labels).count() == 0
