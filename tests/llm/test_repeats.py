import hashlib
import random

import numpy as np
import pytest
from helpers import empty_docs, odd_docs, sentence

from resultloom.llm import repeats


def plain(docs, depth):
    """docs: (id, text) without repeats, in order; n_bytes, spans and digest of each."""
    seen, out = set(), []
    for _, text in docs:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, np.int64)
        for i in range(len(data) - depth + 1):
            w = data[i:i + depth]
            if w in seen:
                gone[i:i + depth] = 1
            seen.add(w)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], gone))))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((len(data), list(zip(edge[::2].tolist(), edge[1::2].tolist())), hashlib.sha256(kept).hexdigest(), kept))
    return out


def tricky(seed):
    rng = random.Random(seed)
    common = sentence(rng, 30)
    docs = ["a" * 700, "ab" * 300, "aaab" * 200 + common, common * 4, "x" * 99, "x" * 100, "x" * 101]
    for _ in range(40):
        docs.append(" ".join(rng.choice([common, sentence(rng, rng.randint(1, 25)), common[7:160], "é" * 70, "z" * rng.randint(1, 150)]) for _ in range(rng.randint(1, 5))))
    return [*docs, docs[9], docs[12] + "!", "", None]


@pytest.mark.parametrize("hot", [1, 1000])
def test_equals_plain_search(spark, hot):
    docs = [(i, t) for i, t in enumerate(tricky(3))]
    want = {i: w for (i, _), w in zip(docs, plain(docs, 100))}
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for r in repeats.repeats(df, sample=1, hot_runs=hot, keep_text=True).collect():
        n, spans, digest, kept = want[r["doc_id"]]
        assert (r["n_bytes"], [tuple(s) for s in r["spans"]], r["kept_sha256"]) == (n, spans, digest), r["doc_id"]
        assert r["kept"] is None or bytes(r["kept"]) == kept


def test_radix_groups_are_the_equal_windows():
    rng = np.random.default_rng(1)
    buf = rng.integers(97, 99, 3000).astype(np.uint8)
    start = np.arange(2900)
    for depth in (8, 13, 20, 100):
        active, cls = repeats.equal_windows(buf, start, start % 3, depth)
        groups = {}
        for s in start.tolist():
            groups.setdefault((s % 3, buf[s:s + depth].tobytes()), []).append(s)
        got = {}
        for a, c in zip(active.tolist(), cls.tolist()):
            got.setdefault(c, []).append(a)
        assert sorted(map(sorted, got.values())) == sorted(g for g in groups.values() if len(g) > 1)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = sorted({(r["doc_id"], r["text"]) for r in docs.collect()}, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    want = dict(zip(rows, plain(rows, 100)))
    got = repeats.repeats(docs).collect()
    assert len(got) == docs.count()
    assert sorted((str(r["doc_id"]), r["n_bytes"], str([tuple(s) for s in r["spans"]]), r["kept_sha256"]) for r in got) == sorted(
        (str(r["doc_id"]), w[0], str(w[1]), w[2]) for r in docs.collect() for w in [want[r["doc_id"], r["text"]]])
    assert repeats.repeats(empty_docs(spark)).count() == 0
