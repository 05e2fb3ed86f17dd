"""Grouped steps give the same rows whether a group counts as hot or not; checked against plain Python."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from resultloom.plans import skew


@pytest.fixture(scope="module")
def table(spark):
    """One group holds a third of all rows, and its order keys cluster in one slice."""
    rnd = random.Random(7)
    data = []
    for i in range(900):
        k = "hot" if i % 3 == 0 else f"k{rnd.randrange(40)}"
        data.append((k, rnd.choice([5, 5, 5, 120, 300]) * 10 + rnd.randrange(8), i, rnd.randrange(-20, 50)))
    return spark.createDataFrame(data, "k string, o bigint, id bigint, v bigint"), data


def grouped(data):
    out = defaultdict(list)
    for r in data:
        out[r[0]].append(r)
    return {k: sorted(v, key=lambda r: (r[1], r[2])) for k, v in out.items()}


@pytest.mark.parametrize("hot", [4, 50, 10**6])
def test_attach(table, hot):
    df, data = table
    got = {r["id"]: (r["lo"], r["c"]) for r in skew.attach(df, ["k"], hot, lo=F.min("v"), c=F.count(F.lit(1))).collect()}
    g = grouped(data)
    assert got == {r[2]: (min(x[3] for x in g[r[0]]), len(g[r[0]])) for r in data}


@pytest.mark.parametrize("hot", [4, 10**6])
@pytest.mark.parametrize("size", [True, False])
def test_lookup_keeps_rows_without_a_match(spark, table, hot, size):
    df, data = table
    g = grouped(data)
    dim = spark.createDataFrame([(k, len(v), k.upper()) for k, v in g.items() if k != "k3"], "k string, n bigint, name string")
    got = skew.lookup(df, dim if size else dim.drop("n"), ["k"], size="n" if size else None, hot_rows=hot).collect()
    assert {r["id"]: r["name"] for r in got} == {r[2]: (None if r[0] == "k3" else r[0].upper()) for r in data}
    assert len(got) == len(data)


@pytest.mark.parametrize("hot", [4, 10**6])
@pytest.mark.parametrize("before", [True, False])
def test_prefix_sum(table, hot, before):
    df, data = table
    out = skew.prefix_sum(df, ["k"], ["o", "id"], "v", [skew.slice_of("o", 1000)], "run", before=before, hot_rows=hot)
    got = {r["id"]: r["run"] for r in out.collect()}
    for rows in grouped(data).values():
        total = 0
        for r in rows:
            total += r[3]
            assert got[r[2]] == (total - r[3] if before else total)


def test_number_rows_and_previous(table):
    df, data = table
    num = {r["id"]: r["n"] for r in skew.number_rows(df, ["k"], ["o", "id"], [skew.slice_of("o", 100)], "n", hot_rows=6).collect()}
    prev = {r["id"]: r["p"] for r in skew.previous(df, ["k"], ["o", "id"], "id", [skew.slice_of("o", 100)], "p", hot_rows=6).collect()}
    for rows in grouped(data).values():
        assert [num[r[2]] for r in rows] == list(range(1, len(rows) + 1))
        assert [prev[r[2]] for r in rows] == [None] + [r[2] for r in rows[:-1]]


def test_exact_median(table):
    from statistics import median
    df, data = table
    got = {r["k"]: (r["count"], r["median"]) for r in skew.exact_median(df, ["k"], "v", hot_rows=5).collect()}
    assert got == {k: (len(v), median(r[3] for r in v)) for k, v in grouped(data).items()}


def test_top_k(table):
    df, data = table
    got = {(r["k"], r["rank"]): r["id"] for r in skew.top_k(df, ["k"], [F.desc("o"), "id"], 3).collect()}
    for k, rows in grouped(data).items():
        best = sorted(rows, key=lambda r: (-r[1], r[2]))[:3]
        assert [got.get((k, i + 1)) for i in range(len(best))] == [r[2] for r in best]


def test_settle_writes_what_moves_rows(spark, table):
    df, _ = table
    few = skew.settle(df.groupBy("k").agg(F.sum("v").alias("s")))
    for plan, written in ((df.filter("v > 0").withColumn("w", F.col("v") + 1), False), (df.join(F.broadcast(few), "k"), False), (df.join(few.hint("merge"), "k"), True),
                          (df.groupBy("k").count(), True), (df.repartition(3), True), (df.distinct(), True)):
        assert bool(skew.settle(plan).inputFiles() and "resultloom-" in skew.settle(plan).inputFiles()[0] and len(skew.settle(plan)._jdf.queryExecution().sparkPlan().toString().splitlines()) < 3) == written
    assert skew.settle(df, dear=True).inputFiles()


def test_settle_uses_the_folder_of_the_session(spark, table):
    df, _ = table
    assert skew.settle(df.filter("v > 0")) is not None
    written = skew.settle(df.groupBy("k").count())
    assert spark.conf.get("spark.checkpoint.dir") in written.inputFiles()[0]
    assert written.count() == df.select("k").distinct().count()


def test_top_k_is_cut_before_the_shuffle(table):
    df, _ = table
    plan = skew.top_k(df, ["k"], ["id"], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_rows_of_hot_keys_and_null_keys_stay_spread(spark, monkeypatch):
    """Two keys with all the rows, and rows without a key: no task gets many more than its share, once the table counts as more than small."""
    monkeypatch.setattr(skew, "SMALL", 1000)
    df = skew.settle(spark.range(24_000).repartition(16).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'a' WHEN id % 3 = 1 THEN 'b' END AS k", "id % 7 AS v"))
    dim = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, w long")
    for out in (skew.attach(df, ["k"], total=F.sum("v")), skew.lookup(df, dim, ["k"])):
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 24_000 and max(sizes) <= 2_500, sizes


def test_a_sieve_lets_few_other_rows_through(spark, table, tmp_path):
    """All wanted rows and those without a whole key stay, few others do, and no row of the table moves before; small tables stay whole."""
    spark.range(20_000).selectExpr("id % 5 AS k", "CASE WHEN id % 1000 <> 7 THEN id END AS id", "CASE WHEN id % 900 = 1 THEN true END AS also").write.parquet(f"{tmp_path}/rows")
    spark.range(300).selectExpr("(id * 11) % 5 AS k", "CAST(id * 11 AS INT) AS id").unionByName(spark.sql("SELECT 9L AS k, CAST(NULL AS INT) AS id")).write.parquet(f"{tmp_path}/keys")
    df, keys = spark.read.parquet(f"{tmp_path}/rows"), spark.read.parquet(f"{tmp_path}/keys")
    few = skew.sieve(df, keys, ["k", "id"], F.col("also"), hot_rows=10)
    wanted = df.filter("id IS NULL OR also OR (id % 11 = 0 AND id < 3300)")
    assert few.columns == df.columns and wanted.exceptAll(few).count() == 0 and few.exceptAll(df).count() == 0
    assert wanted.count() <= few.count() <= wanted.count() + 40
    assert skew.sieve(df, keys, ["k", "id"], F.col("also")) is df


def test_a_huge_slice_is_cut_along_the_whole_order(spark):
    """All rows are one group and one slice, and their order keys share forty characters: pieces stay small, sums and neighbours right."""
    n = 20_000
    df = skew.settle(spark.range(n).repartition(8).selectExpr("'job' AS k", "concat(repeat('x', 40), lpad(CAST(id AS STRING), 8, '0')) AS o", "id", "id % 7 AS v").repartition(8))
    cut, names = skew._sliced(df, ["k"], [F.left("o", F.lit(2))], ["o"], 1000)
    sizes = [r["count"] for r in cut.groupBy("k", *names).count().collect()]
    assert sum(sizes) == n and max(sizes) <= 1500, sizes
    run = skew.prefix_sum(df, ["k"], ["o"], "v", [F.left("o", F.lit(2))], "run", hot_rows=1000)
    whole = 7 * 6 // 2
    assert run.filter(F.col("run") != F.expr(f"(id div 7) * {whole} + (id % 7) * (id % 7 + 1) div 2")).count() == 0 and run.count() == n
    before = skew.previous(df, ["k"], ["o"], "id", [F.left("o", F.lit(2))], "p", hot_rows=1000)
    assert before.filter("NOT (p <=> CASE WHEN id > 0 THEN id - 1 END)").count() == 0
    marks = df.filter("id % 501 = 0").select("k", "o")
    near = skew.nearest(df.select("k", "o", "id"), marks, ["k"], "o", [F.left("o", F.lit(2))], 1000)
    at = F.substring("below", 41, 8).cast("long"), F.substring("above", 41, 8).cast("long")
    assert near.filter(~at[0].eqNullSafe(F.expr("id div 501 * 501"))).count() == 0
    assert near.filter(~at[1].eqNullSafe(F.expr(f"nullif(least((id + 500) div 501 * 501, {n // 501 * 501 + 501}), {n // 501 * 501 + 501})"))).count() == 0


@pytest.mark.parametrize("bound", [3, 40, 65_536])
def test_ranks_by_radix_selection(spark, bound):
    """Ties, signs, zero, very near and very far values, one group of nearly all rows, one of a single value."""
    from statistics import median
    rnd = random.Random(4)
    kinds = [lambda: rnd.gauss(0, 1), lambda: 1 + rnd.randrange(50) * 2.0 ** -52, lambda: rnd.choice([0.0, -5.0, 7.5]), lambda: rnd.choice([-1, 1]) * 10.0 ** rnd.randrange(-300, 300), lambda: float("inf")]
    data = [("big", rnd.choice(kinds)()) for _ in range(3001)] + [("near", 1 + i * 2.0 ** -52) for i in range(300)] + [("one", 3.5)] * 50 + [(f"g{i % 20}", rnd.random()) for i in range(100)] + [("g1", None), ("none", None)]
    df = spark.createDataFrame(data, "k string, v double").repartition(8)
    groups = defaultdict(list)
    for k, v in data:
        if v is not None:
            groups[k].append(v)
    got = {r["k"]: (r["count"], r["median"]) for r in skew.exact_median(df, ["k"], "v", bound=bound).collect()}
    assert got == {k: (len(v), median(v)) for k, v in groups.items()}
    picks = {"first": lambda n: n * 0, "tenth": lambda n: F.floor(n / 10), "last": lambda n: n - 1}
    got = {r["k"]: (r["low"], r["high"], r["first"], r["tenth"], r["last"]) for r in skew.rank_value(df, ["k"], "v", picks, bound=bound).collect()}
    assert got == {k: (min(v), max(v), min(v), sorted(v)[len(v) // 10], max(v)) for k, v in groups.items()}


def test_lookup_in_a_small_written_table_has_one_branch(spark, monkeypatch):
    """A third of the rows has one key, a tenth none; the table holds one key twice and a null one."""
    monkeypatch.setattr(skew, "SMALL", 10)
    df = spark.range(90).selectExpr("id", "CASE WHEN id % 10 = 0 THEN NULL WHEN id % 3 = 0 THEN 1 ELSE id END AS k", "'old' AS w")
    dim = skew.settle(spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d"), (500, "e")], "k bigint, w string"), dear=True)
    found = skew.lookup(df, dim, ["k"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("Join") == 1
    want = []
    for i in range(90):
        k = None if i % 10 == 0 else 1 if i % 3 == 0 else i
        want += [(i, k, w) for w in {1: ["a"], 2: ["b", "c"]}.get(k, [None])]
    assert sorted(map(tuple, found.select("id", "k", "w").collect()), key=str) == sorted(want, key=str)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(tuple, skew.lookup(df, dim, ["k"]).select("id", "k", "w").collect()), key=str) == sorted(want, key=str)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
