import re
from math import comb

from helpers import empty_docs, odd_docs

from resultloom.llm import quality_rules as q, queries
from resultloom.llm.common import table


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    many = {}
    for g in grams:
        many[g] = many.get(g, 0) + 1
    covered = {i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered))


def test_query_base(spark, folder):
    texts = {r["doc_id"]: r["text"] for r in table(spark, folder, "documents").collect()}
    got = queries.QUERIES["op6_risk_controlled_rules"](spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        want = plain_counts(texts[r["doc_id"]])
        assert tuple(r)[1:6] == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r["kept"] and r["base_failed"])


def test_odd_rows(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(0, 1, 0), (3, None, 0), (None, 1, 1), (18, 1, 0), (18, 1, 0)], "doc_id long, quality int, toxic int")
    out = q.judge(docs, labels)
    rows = out.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert tuple(r["counts"])[:2] == plain_counts(r["text"])[:2] and tuple(r["counts"])[2:5] == plain_counts(r["text"])[2:5]
        assert r["kept"] == (not r["base_failed"])       # too few labels to guarantee anything
    assert q.judge(empty_docs(spark), labels).count() == 0
    assert q.judge(docs, labels.limit(0)).count() == docs.count()


def test_tail_is_exact():
    for n, k, p in ((10, 0, 0.1), (50, 3, 0.02), (400, 9, 0.05), (7, 7, 0.5)):
        assert abs(q.tail(n, k, p) - sum(comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1))) < 1e-12


def test_cutoffs_hold_their_limit(spark):
    """A plain search over the grid finds the same cutoffs; lost good documents stay below the limit."""
    rows = []
    for i in range(15000):
        good, lang = i % 4 != 0, ("en", "de", None)[i % 3]
        symbols = (i * 7 % 100) // 12 if good else 20 + i % 30
        rows.append((lang, good, (100, 500, symbols, 0, 0, 10, 5, 8, 80)))
    kind = "stratum string, good boolean, counts struct<" + ",".join(f"{c}:long" for c in q.COUNTS) + ">"
    got = {(r["stratum"], r["rule"]): r["cutoff"] for r in q.cutoffs(spark.createDataFrame(rows, kind), "stratum", "good").collect()}
    tests = 3 * len(q.RULES) * len(q.GRID)
    for lang in ("en", "de", None):
        mine = [(g, c[2] / c[1]) for s, g, c in rows if s == lang]
        n = sum(g for g, _ in mine)
        ok = []
        for at, c in enumerate(q.GRID):
            lost, caught = sum(g and x > c for g, x in mine), sum(not g and x > c for g, x in mine)
            if q.tail(n, lost, q.ALPHA / len(q.RULES)) <= q.DELTA / tests and caught > lost:
                ok.append((caught - lost, at))
        assert ok and got[lang, "symbols"] == q.GRID[max(ok)[1]]
        assert sum(g and x > got[lang, "symbols"] for g, x in mine) <= q.ALPHA * n
    assert {r for _, r in got} == {"symbols"}


def test_few_hundred_good_labels_give_a_cutoff(spark):
    """About 300 good documents per stratum certify a rule that rejects none of them; a stratum of 100 gets nothing, and what good ones share is kept."""
    rows = [(lang, good, (100, 500, 30 + i % 20 if not good else i % 9, 0, 0, 10, 5, 8, 60 + i % 40))
            for lang, n in (("en", 320), ("de", 320), (None, 320), ("few", 100)) for good in (True, False) for i in range(n)]
    kind = "stratum string, good boolean, counts struct<" + ",".join(f"{c}:long" for c in q.COUNTS) + ">"
    got = {(r["stratum"], r["rule"]): r["cutoff"] for r in q.cutoffs(spark.createDataFrame(rows, kind), "stratum", "good").collect()}
    assert {s for s, _ in got} == {"en", "de", None} and all(r == "symbols" and 0.02 <= c < 0.06 for (_, r), c in got.items())


def test_limit_holds_for_all_rules_together():
    """Steps are nested, and where two rules each lose good documents the joint loss is what is tested."""
    import numpy as np
    levels = np.array([[0] * 6, [5, 0, 0, 0, 0, 0], [0, 9, 0, 0, 0, 0], [5, 9, 0, 0, 0, 0]])
    steps = q.nested_order(levels, np.array([100, 1, 2, 0]), np.array([0, 50, 10, 5]))
    assert steps == [(1, 8), (0, 4)] or steps == [(0, 4), (1, 8)]
    assert all(b[1] < a[1] for r in range(6) for a, b in zip([s for s in steps if s[0] == r], [s for s in steps if s[0] == r][1:]))


def plain_levels(text):
    """How many cutoffs of the grid lie below each rule's value."""
    words, dup, rep = re.findall(r"[^\x20\x09-\x0D]+", text), plain_counts(text)[3], plain_counts(text)[4]
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    chars = sum(map(len, words))
    values = {"symbols": (plain_counts(text)[2], chars), "dup_lines": (dup, len(lines)), "repeat_words": (rep, len(words)), "capitals": (sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in text), chars),
              "stops": (sum(c in "!?.,;:" for c in text), len(words)), "same_words": (len(words) - len(set(words)), len(words))}
    return tuple(sum(values[r][0] / max(values[r][1], 1) > c for c in q.GRID) for r in q.RULES)


def plain_cutoffs(good, bad, tests, strata):
    """Number of cutoffs that stay below, by rule: every step looks at all cutoffs and all documents again."""
    at, steps = [len(q.GRID)] * len(q.RULES), []
    while True:
        options = []
        passes = lambda x: all(v <= a for v, a in zip(x, at))
        for r in range(len(at)):
            for c in range(at[r]):
                gain, lost = sum(passes(x) and x[r] > c for x in bad), sum(passes(x) and x[r] > c for x in good)
                if gain > lost:
                    options.append((r, c, gain, lost))
        loosest = [max((o for o in options if o[0] == r), key=lambda o: o[1]) for r in {o[0] for o in options}]
        if not loosest:
            break
        r, c, _, _ = min(loosest, key=lambda o: (o[3] / o[2], -o[1], o[0]))
        at[r] = c
        steps.append((r, c))
    held = [len(q.GRID)] * len(q.RULES)
    for r, c in steps:
        trial = [*held[:r], c, *held[r + 1:]]
        lost = sum(any(v > a for v, a in zip(x, trial)) for x in tests)
        if sum(comb(len(tests), i) * q.ALPHA ** i * (1 - q.ALPHA) ** (len(tests) - i) for i in range(lost + 1)) > q.DELTA / strata:
            break
        held = trial
    return held


def test_kept_equals_plain_search(spark):
    """Every verdict against a plain search over all steps; repeated labels and repeated rows count one trial each."""
    import random
    from pyspark.sql import functions as F
    rng, docs, labels = random.Random(4), [], []
    for i in range(1500):
        good, lang = i % 3 != 0, ("en", None)[i % 2]
        words = [f"w{rng.randint(0, 300 if good else 90)}" for _ in range(rng.randint(45, 90))]
        words += ["#$"] * rng.choice([0, 0, 1, 2] if good else [0, 9, 20]) + ["Stop!!"] * (rng.randint(0, 30) if not good else 0)
        rng.shuffle(words)
        docs.append((i, " ".join(words), lang))
        if i % 10:
            labels += [(i, int(good))] * (3 if i % 4 == 0 else 1)
    docs += docs[:300] + [(2000, None, None), (2001, "", "xx"), (None, "a b", "en")]
    labels += [(1, 0), (4, 1), (9999, 1), (None, 1), (5, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = q.judge(df, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    design = {r["doc_id"] for r in df.filter(F.pmod(F.xxhash64(F.lit("design"), "doc_id"), F.lit(q.DESIGN)) == 0).collect()}
    is_good = {}
    for i, quality in labels:
        if i is not None and quality is not None:
            is_good[i] = is_good.get(i, False) or quality > 0
    texts = {i: (t or "", lang) for i, t, lang in docs if i is not None}
    failed = {i: (c := plain_counts(t))[0] < 50 or 100 * c[4] > 50 * c[0] for i, (t, _) in texts.items()}
    levels = {i: plain_levels(t) for i, (t, _) in texts.items()}
    hold = [i for i in is_good if i in texts and not failed[i]]
    held = {}
    for lang in ("en", None):
        mine = [i for i in hold if texts[i][1] == lang]
        held[lang] = plain_cutoffs([levels[i] for i in mine if is_good[i] and i in design], [levels[i] for i in mine if not is_good[i]],
                                   [levels[i] for i in mine if is_good[i] and i not in design], 2)
    assert any(a < len(q.GRID) for at in held.values() for a in at)
    assert len(got) == len(docs) and any(not r["kept"] and not r["base_failed"] for r in got)
    for r in got:
        if r["doc_id"] is not None:
            at = held.get(r["lang"], [len(q.GRID)] * len(q.RULES))
            assert r["kept"] == (not failed[r["doc_id"]] and all(v <= a for v, a in zip(levels[r["doc_id"]], at))), r["doc_id"]
