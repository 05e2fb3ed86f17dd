"""Shards against a plain search over capacities and plain cuts; hot groups; the bounds that the driver reckons with."""

import random
import zlib

import pytest
from helpers import empty_docs, odd_docs
from pyspark.sql import functions as F

from resultloom.llm import sharding as S
from resultloom.llm.common import table


def plain_plan(sizes, shards):
    """Smallest capacity by trying all that a shard can have, and the cuts by their rule, over prefix sums in a list."""
    ends = [0]
    for s in sizes:
        ends.append(ends[-1] + s)
    total = ends[-1]

    def fits(c, parts):
        used, room = 1, c
        for s in sizes:
            if s > c:
                return False
            if s > room:
                used, room = used + 1, c
            room -= s
        return used <= parts

    sums = sorted({b - a for i, a in enumerate(ends) for b in ends[i + 1:]}) if len(ends) < 120 else range(max(sizes), total + 1)
    c = next(c for c in sums if fits(c, shards))
    latest = [total]
    for _ in range(shards - 1):
        latest.append(min(e for e in ends if e >= latest[-1] - c))
    begin = [0]
    for i in range(1, shards):
        at = begin[-1]
        share = max(e for e in ends if e <= at + (total - at) // (shards - i + 1))
        following = min((e for e in ends if e > at), default=total)
        begin.append(max(share, following, latest[shards - i]))
    return c, begin


def plain_assign(docs, shards):
    """docs: (id, text) -> sorted list of (id, size, crc, shard, slot)."""
    import hashlib
    groups = {}
    for i, x in docs:
        groups.setdefault((x or "").encode(), []).append(i)
    low = lambda ids: min((i for i in ids if i is not None), default=None)
    key = lambda i: (i is not None, i or 0)
    order = sorted(groups, key=lambda x: (key(low(groups[x])), hashlib.sha256(x).digest()))
    sizes = [(len(x) + 1) * len(groups[x]) for x in order]
    c, begin = plain_plan(sizes, shards)
    out, place, slots = [], 0, [0] * shards
    for x, size in zip(order, sizes):
        shard = max(s for s in range(shards) if begin[s] <= place)
        for i in sorted(groups[x], key=key):
            out.append((str(i), len(x) + 1, zlib.crc32(x), shard, slots[shard]))
            slots[shard] += 1
        place += size
    return sorted(out), c


def check(docs, shards):
    got = sorted((str(r["doc_id"]), r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in S.assign(docs, shards).collect())
    want, c = plain_assign([(r["doc_id"], r["text"]) for r in docs.collect()], shards)
    assert got == want
    loads = {}
    for _, size, _, shard, _ in got:
        loads[shard] = loads.get(shard, 0) + size
    assert max(loads.values()) <= c
    return loads


def test_whole_table(spark, folder):
    loads = check(table(spark, folder, "documents"), 16)
    assert len(loads) == 16


def test_odd_rows(spark):
    for shards in (1, 3, 16, 40):
        check(odd_docs(spark), shards)
    assert S.assign(empty_docs(spark)).collect() == []
    check(spark.createDataFrame([(None, None), (None, "")], "doc_id long, text string"), 4)


def test_a_third_is_one_group(spark):
    """The crowd keeps together; the rest is spread evenly over the other shards, none of which is empty."""
    rng = random.Random(1)
    rows = [(i, "crowd " * 4 if i % 3 == 0 else f"text {i} " + "w" * rng.randrange(40)) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = S.assign(docs, 16)
    assert got.filter((F.col("doc_id") % 3 == 0)).select("shard").distinct().count() == 1
    loads = sorted(r["b"] for r in got.groupBy("shard").agg(F.sum("size").alias("b")).collect())
    crowd = 2000 * (len("crowd " * 4) + 1)
    assert len(loads) == 16 and loads[-1] == crowd and loads[0] > 0.8 * (sum(loads) - crowd) / 15
    # slots are gapless
    assert got.groupBy("shard").agg((F.max("slot") + 1).alias("n"), F.count_distinct("slot").alias("d"), F.count("*").alias("c"), F.min("slot").alias("z")).filter("n <> d OR d <> c OR z <> 0").count() == 0


@pytest.mark.parametrize("knots", [1, 3, 64])
def test_bounds_find_the_exact_plan(knots):
    """Whatever little the driver may look at in one go, the plan is that of the plain search."""
    rng = random.Random(knots)
    for trial in range(60):
        sizes = [rng.choice((1, 2, 5, 900, rng.randrange(1, 4000))) for _ in range(rng.randrange(1, 90))]
        if trial % 3 == 0:
            sizes[rng.randrange(len(sizes))] = sum(sizes) // 2 + 1
        shards = rng.choice((1, 2, 7, 16))
        places = [sum(sizes[:i]) for i in range(1, len(sizes))]
        order, unsure, looks = S.Order(sum(sizes)), [(0, sum(sizes))], 0
        while unsure:
            found = []
            for a, b in unsure:
                width = max(1, -(-(b - a) // max(1, knots)))
                if knots == 1:
                    width = max(1, (b - a + 1) // 2)
                buckets = {}
                for p in places:
                    if a < p < b:
                        buckets.setdefault((p - a) // width, []).append(p)
                found += [(a, v[0], v[-1], len(v)) for v in buckets.values()]
            order.learn(unsure, found)
            c, begin, unsure = S.cuts(order, shards, max(sizes))
            looks += 1
            assert looks < 200
        assert (c, begin) == plain_plan(sizes, shards)


def test_written_shards(spark, folder, tmp_path):
    docs = table(spark, folder, "documents")
    S.write_shards(docs, str(tmp_path / "shards"), 4)
    back = spark.read.parquet(str(tmp_path / "shards"))
    want = S.assign(docs, 4)
    assert sorted((r["doc_id"], r["shard"]) for r in back.select("doc_id", "shard").collect()) == sorted((r["doc_id"], r["shard"]) for r in want.collect())
    assert sorted(map(str, back.select(*docs.columns).collect())) == sorted(map(str, docs.collect()))
