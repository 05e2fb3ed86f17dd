"""The pipeline against plain versions of its stages, and its stages on odd rows."""

import hashlib

import corpus_pipeline
from helpers import empty_docs, odd_docs
from test_bpe import PLAIN
from test_quality_rules import plain_counts
from test_simhash import similar

from resultloom.llm import decontaminate, secrets, simhash
from resultloom.llm.common import stored, table


def test_whole_run(spark, folder):
    rows = {r["doc_id"]: r["text"] or "" for r in table(spark, folder, "documents").collect()}
    counts = {d: plain_counts(t) for d, t in rows.items()}
    rows = {d: t for d, t in rows.items() if counts[d][0] >= 50 and 100 * counts[d][4] <= 50 * counts[d][0]}   # too few labels for any cutoff
    ids = sorted(rows)
    first, _ = similar([rows[d] for d in ids])      # all pairs, five-word shingles, similarity 0.8
    rows = {d: rows[d] for k, d in enumerate(ids) if first[k] == k}
    bad = {r["doc_id"] for r in decontaminate.overlaps(table(spark, folder, "documents"), table(spark, folder, "benchmark")).collect()}
    want = set()
    for d, t in rows.items():
        if d in bad:
            continue
        hidden = set()
        for a, b, _ in secrets.spans_of(t):
            hidden |= set(range(a, b))
        clean = "".join("[secret]" if i in hidden and (i - 1 not in hidden or any(a == i and all(y <= i for x, y, _ in secrets.spans_of(t) if x < i) for a, _, _ in secrets.spans_of(t))) else
                        "" if i in hidden else c for i, c in enumerate(t))
        ids = PLAIN.encode_ordinary(clean)
        want.add((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(clean.encode()).hexdigest()))
    got = {tuple(r) for r in corpus_pipeline.run(spark, folder).collect()}
    assert {g[0] for g in got} == {w[0] for w in want} and len(want) > 50
    assert len(got - want) <= len(want) // 50      # adjoining spans may share one mark; all other digests are equal


def test_stages_on_odd_rows(spark, folder):
    for docs in (odd_docs(spark), empty_docs(spark)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stored(stage(spark, docs, folder), name)
            assert out.columns == docs.columns and out.count() <= docs.count()
            if name == "simhash_near_dedup" and docs.count():
                ids = [r["doc_id"] for r in out.collect() if r["doc_id"] is not None]
                assert len(ids) == len(set(ids))
        assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == docs.count()


def test_near_copies_go(spark, folder):
    """A copy with two of 120 words changed is beyond op5's three bits, but no document of its own."""
    words = [f"w{i * 7 % 1000}" for i in range(120)]
    copy = [*words[:30], "x", *words[31:80], "y", *words[81:]]
    docs = spark.createDataFrame([(5, " ".join(words)), (7, " ".join(copy)), (9, " ".join(words[60:] + ["other"] * 40)), (None, " ".join(copy)), (None, "no copy of anything")], "doc_id long, text string")
    assert (simhash.fingerprint(" ".join(words).encode()) ^ simhash.fingerprint(" ".join(copy).encode())).bit_count() > simhash.RADIUS
    assert sorted((str(r["doc_id"]) for r in corpus_pipeline.near_duplicates(spark, docs, folder).collect())) == ["5", "9", "None"]


def test_each_group_keeps_a_row_where_ids_repeat(spark, folder):
    """Of two rows of one id and unlike texts none is lost, and the row that goes is the near copy."""
    x, y, z = (" ".join(f"{c}{i}" for i in range(100)) for c in "xyz")
    docs = spark.createDataFrame([(1, x), (3, x + " more"), (3, y), (5, z), (5, y + " more"), (5, z)], "doc_id long, text string")
    assert sorted(tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, folder).collect()) == [(1, x), (3, y), (5, z)]
