"""The audit against filters that really run in every order; its rational solver against the average over orders."""

import random
import re
from fractions import Fraction
from itertools import permutations

from helpers import empty_docs, odd_docs

from resultloom.llm import filter_audit as A
from resultloom.llm.common import table


def plain_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, x, _ in docs:
        if i is not None:
            least[x or ""] = min(i, least.get(x or "", i))
    rows = {}
    for i, x, part in docs:
        x = x or ""
        words = [w for w in re.split("[\x20\x09-\x0d]+", x) if w]
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", x)) > 10 * len(x),
                 "D": bool(re.search(r"[#$%&*|]", x)), "E": i is not None and least[x] < i}
        rows.setdefault(part or "", []).append((i, fails))
    out, shares = {}, {}
    for part, members in rows.items():
        for order in permutations("ABCDE"):
            left = members
            for step, f in enumerate(order, 1):
                gone = [m for m in left if m[1][f]]
                left = [m for m in left if not m[1][f]]
                failing = [m for m in members if m[1][f]]
                out[part, "".join(order), step] = [f, len(left), len(gone), len(failing) - len(gone), sum(sum(m[1].values()) == 1 for m in failing),
                                                   sum(m[0] in good for m in gone), sum(m[0] in toxic for m in gone)]
                shares[part, f] = shares.get((part, f), 0) + len(gone)
    return {k: (*v, shares[k[0], v[0]]) for k, v in out.items()}


def as_dict(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in df.collect()}


def check(spark, docs, labels):
    got = as_dict(A.filter_audit(docs, labels))
    want = plain_audit([(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()], [(r["doc_id"], r["quality"], r["toxic"]) for r in labels.collect()])
    assert got == want and len(got) == 600 * len({k[0] for k in got})


def test_all_orders(spark, folder):
    check(spark, table(spark, folder, "documents"), table(spark, folder, "labels"))


def test_odd_rows(spark):
    labels = spark.createDataFrame([(3, 1, 0), (18, 1, 1), (18, 0, 0), (21, None, 1), (None, 1, 1), (6, 0, None)], "doc_id long, quality int, toxic int")
    check(spark, odd_docs(spark), labels)
    check(spark, odd_docs(spark), labels.limit(0))
    assert A.filter_audit(empty_docs(spark), labels).count() == 0
    # copies of one text in many parts; ids that repeat with like and unlike texts
    rows = [(i % 7, "same " * (i % 3), f"l{i % 5}") for i in range(60)] + [(None, "same ", "l1"), (None, "same ", None)]
    check(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels)


def test_solver_is_exact():
    rng = random.Random(3)
    for players in (2, 3, 5, 6):
        worth = [0] + [rng.randrange(10 ** 18) for _ in range((1 << players) - 1)]
        orders = list(permutations(range(players)))
        want = [Fraction(0)] * players
        for order in orders:
            before = 0
            for p in order:
                want[p] += Fraction(worth[before | 1 << p] - worth[before], len(orders))
                before |= 1 << p
        assert A.shapley(worth) == want
