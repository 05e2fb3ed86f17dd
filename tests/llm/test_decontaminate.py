import random
import re
import time

import numpy as np
from helpers import empty_docs, odd_docs, sentence

from resultloom.llm import decontaminate as d, queries
from resultloom.llm.common import table

MASKS = d.MASKS


def words(text):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, least=13, penalty=4, few=5):
    """All diagonals of all pairs: those that some mask hits are searched for their best stretch."""
    first = {}
    for i, t in sorted(((i, t) for i, t in items if words(t)), key=lambda x: (x[0] is None, x[0])):
        first.setdefault(tuple(words(t)), i)
    out = {}
    for doc, text in docs:
        w = words(text)
        for item, i in first.items():
            best = None
            if len(set(w) & set(item)) < min(few, len(set(item))):
                continue       # a mask hit needs at least that many different words, or a tiny item
            for s in range(1 - len(item), len(w)):
                same = [(0 <= s + k < len(w)) and w[s + k] == item[k] for k in range(len(item))]
                if not all(same) if len(item) < 12 else not any(all(same[p + k] for k, m in enumerate(mask) if m == "1") for mask in MASKS for p in range(len(same) - 11)):
                    continue
                lo, hi = max(0, -s), min(len(item), len(w) - s)
                x, y = d.best_stretch(np.array(same[lo:hi]), penalty)
                if y - x >= min(least, len(item)):
                    row = (sum(same[lo + x:lo + y]), y - x, -(s + lo + x), -(lo + x))
                    best = max(best or row, row)
            if best:
                out[doc, i] = (len(item), best[1], best[0], -best[2], -best[3])
    return out


def found(df):
    return {(r["doc_id"], r["item_id"]): tuple(r)[2:] for r in df.collect()}


def test_query(spark, folder):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, folder, "documents").collect()]
    items = [(r["item_id"], r["text"]) for r in table(spark, folder, "benchmark").collect()]
    got = found(queries.QUERIES["op3_spaced_seed_decontamination"](spark, folder))
    held = {(doc, i) for doc, t in docs for i, x in items if " ".join(words(x)) in " ".join(words(t))}
    assert held and held <= set(got)
    small = [(doc, t) for doc, t in docs if len(t or "") < 1500 and doc in {k[0] for k in got}][:12]
    assert plain(small, items) == {k: v for k, v in got.items() if k[0] in dict(small)}


def test_changed_words_are_found(spark):
    rng = random.Random(8)
    vocabulary = [sentence(rng, 1) for _ in range(3000)]
    items = [(i, sentence(rng, rng.randint(13, 60), vocabulary)) for i in range(30)] + [(90, "two words"), (None, "no id but these seven other words here"), (91, None), (92, "")]
    items.append((99, items[0][1].upper()))
    docs = []
    for k in range(40):
        w = words(items[k % 30][1])
        for at in range(rng.randint(0, 4), len(w), rng.randint(6, 12)):
            w[at] = "changed"
        docs.append((k, " ".join([sentence(rng, rng.randint(0, 40), vocabulary), *w, sentence(rng, rng.randint(0, 40), vocabulary)])))
    docs += [(100, "start Two, WORDS end"), (101, sentence(rng, 50, vocabulary)), (102, None), (103, "two words"), (100, "start Two, WORDS end")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = plain(docs, items)
    assert found(d.overlaps(df, bench)) == want and len({k[0] for k in want}) > 20 and (100, 90) in want
    assert found(d.overlaps(df, bench, slice_words=64)) == want                  # many slices, the same rows
    assert d.overlaps(df, bench.limit(0)).count() == 0
    assert d.overlaps(empty_docs(spark), bench).count() == 0


def test_odd_rows_and_long_items(spark):
    docs = odd_docs(spark)
    rng = random.Random(6)
    long = sentence(rng, 5000, [sentence(rng, 1) for _ in range(3000)])
    more = spark.createDataFrame([(77, "before " + " ".join(long.split()[1000:1400]) + " after")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, long), (2, docs.filter("doc_id = 18").first()["text"])], "item_id long, text string")
    assert {r["doc_id"] for r in d.overlaps(docs, bench).collect()} >= {18, 21, 24, None}
    r = d.overlaps(more, bench).collect()
    assert [(x["doc_id"], x["item_id"], x["item_words"], x["overlap_words"] >= 300) for x in r] == [(77, 1, 5000, True)]


def plain_stretch(same, penalty):
    """The longest of all stretches, tried one by one."""
    ok = [(y - x, sum(same[x:y]), -x) for x in range(len(same)) for y in range(x + 1, len(same) + 1)
          if sum(same[x:y]) >= penalty * (y - x - sum(same[x:y])) and ((x, y) == (0, len(same)) or same[x] and same[y - 1])]
    n, _, x = max(ok, default=(0, 0, 0))
    return -x, n - x


def test_stretch_is_the_longest_of_enough_equal_words():
    rng = random.Random(3)
    for _ in range(1500):
        same = [rng.random() < rng.choice((0.5, 0.8, 0.9)) for _ in range(rng.randint(1, 40))]
        assert d.best_stretch(np.array(same), 4) == plain_stretch(same, 4)


def test_passages_of_80_percent_are_found(spark):
    word = iter([f"w{i}" for i in range(10_000)])
    cases = [(50, range(4, 50, 5)), (15, (3,)), (16, (3,)), (20, (3, 16)), (27, (12, 13, 14)), (13, (0,)), (13, (12,))]
    items, docs = [], []
    for k, (n, changed) in enumerate(cases):
        w = [next(word) for _ in range(n)]
        items.append((k, " ".join(w)))
        docs.append((k, " ".join(["x", "y", *("other" if i in changed else x for i, x in enumerate(w)), "z"])))
    w = [next(word) for _ in range(40)]
    items.append((50, " ".join(w)))
    docs.append((50, " ".join(["x"] * 5 + w[10:22] + ["x"] * 5)))      # 12 equal words: changed ones around them don't count
    got = found(d.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    hit = {k for k, (n, changed) in enumerate(cases)
           if any(all(p + i not in changed for i, m in enumerate(mask) if m == "1") for mask in MASKS for p in range(n - 11))}
    assert hit >= {0, 1, 2, 3, 4} and set(got) == {(k, k) for k in hit}
    assert all(got[k, k][:3] == (cases[k][0], cases[k][0], cases[k][0] - len(cases[k][1])) for k in hit)


def test_repeated_words(spark, monkeypatch):
    """Words said over and over: only diagonals are kept of their seeds, and the best overlap is that of all pairs."""
    rng = random.Random(12)
    items = [(0, "la " * 40), (1, "tick tock " * 25), (2, "la " * 20 + "and then some more words here to end it " + "la " * 20), (3, "one two three " * 9 + "four")]
    docs = [(0, "la " * 90), (1, "la " * 15), (2, "tick tock " * 60), (3, "x " * 5 + "la " * 30 + "tick tock " * 12 + "la " * 31), (4, "one two three " * 30), (5, "tock " * 50),
            (6, " ".join(rng.choice(("la", "la", "la", "la", "tick")) for _ in range(120)))]
    tables = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = plain(docs, items, few=1)
    assert len(want) > 6
    for many in (1, 50, 1 << 12):
        monkeypatch.setattr(d, "MANY", many)
        rows = d.Slice([(i, len(words(t)), 0, d.words_of([t.encode()], d.NO_WORD)[0].tobytes()) for i, t in items])
        block = d.words_of([t.encode() for _, t in docs], d.NO_WORD)[0]
        got = {tuple(map(int, p)) for p in zip(*rows.hits(block))}
        expected = set()
        for k, item in enumerate(rows.words):
            for places in d._PLACES:
                mine, theirs = d.seeds(block, places, d._WIDE), d.seeds(item, places, d._WIDE)
                expected |= {(k, int(p - a)) for a in range(len(theirs)) for p in np.flatnonzero(mine == theirs[a])}
        assert got == expected
    assert found(d.overlaps(*tables)) == want


def test_repeated_words_cost_their_diagonals(spark):
    docs = spark.createDataFrame([(1, "la " * 20_000), (2, "la " * 40)], "doc_id long, text string")
    items = spark.createDataFrame([(5, "la " * 1000)], "item_id long, text string")
    d.overlaps(docs, items).collect()
    began = time.time()
    assert found(d.overlaps(docs, items)) == {(1, 5): (1000, 1000, 1000, 0, 0), (2, 5): (1000, 40, 40, 0, 0)}
    assert time.time() - began < 8
