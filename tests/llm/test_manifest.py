"""The manifest against a plain tree; proofs that fail for what was changed; any arity; one hot source."""

import hashlib
import zlib

import pytest
from helpers import empty_docs, odd_docs
from pyspark.sql import functions as F

from resultloom.llm import manifest as M
from resultloom.llm.queries import QUERIES


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(*values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes, arity):
    """Root, and the siblings (before, behind) of each leaf from the bottom up."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, i in enumerate(at):
            run = i // arity * arity
            paths[k].append(("".join(level[run:i]), "".join(level[i + 1:run + arity])))
        level = [h(*level[i:i + arity]) for i in range(0, len(level), arity)]
        at = [i // arity for i in at]
    return level[0], paths


def plain_manifest(rows, arity=3):
    """Sorted (leaf, subroot, root, proof, ...) of rows (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(((r[0] is not None, r[0] or 0), plain_leaf(*r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[1] for x in sorted(groups[s], key=lambda x: x[:2])], arity) for s in names}
    root, upper = plain_tree([trees[s][0] for s in names], arity)
    out = []
    for k, s in enumerate(names):
        for (_, leaf, r), path in zip(sorted(groups[s], key=lambda x: x[:2]), trees[s][1]):
            path = path + upper[k]
            node = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                node = plain_leaf(*r[:4], r[4].replace("\n", ""))
            for a, b in path:
                node = h(a, node, b)
            out.append((str(r[0]), leaf, trees[s][0], root, h(*(a + b for a, b in path)), node, node == root))
    return sorted(out)


def fields(df):
    return [tuple(r) for r in df.select(*M.FIELDS).collect()]


def written(spark, docs, tmp_path):
    docs.select(*M.FIELDS).write.parquet(str(tmp_path / "documents.parquet"))
    return sorted((str(r["doc_id"]), *tuple(r)[1:]) for r in QUERIES["op13_merkle_manifest"](spark, str(tmp_path)).collect())


def test_odd_rows(spark, tmp_path):
    docs = odd_docs(spark)
    assert written(spark, docs, tmp_path) == plain_manifest(fields(docs))


def test_empty_table(spark, tmp_path):
    assert written(spark, empty_docs(spark), tmp_path) == []


def test_one_document(spark, tmp_path):
    docs = spark.createDataFrame([(2, None, "en", 3, "a\nb")], "doc_id long, source string, lang string, n_chars long, text string")
    got = written(spark, docs, tmp_path)
    assert got == plain_manifest(fields(docs)) and got[0][1] == got[0][2] == got[0][3]


@pytest.mark.parametrize("arity", [2, 3, 4])
def test_sources_of_all_sizes(spark, arity):
    """A hot source, sources of one to thirty rows, one without a name, names that sort bytewise."""
    names = [None, "", "Z", "a", "é", "漢", "\U0001f600", "￮"]
    rows = [(i, "hot", "en", i, f"text {i}") for i in range(700)] + [(1000 + i, names[i % 8] if i < 120 else f"s{i}", None, None, f"x\n{i}") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    found = M.manifest(docs, arity=arity)
    hexed = found.select("doc_id", *[M.as_text(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")], M.as_text(M.proof_of(F.col("path"))).alias("p"))
    got = sorted((str(r["doc_id"]), *tuple(r)[1:]) for r in hexed.collect())
    assert got == [r[:5] for r in plain_manifest(rows, arity)]


def test_any_change_is_found(spark):
    rows = [(i, f"s{i % 3}", "en", 5, f"text {i}") for i in range(50)]
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    docs = spark.createDataFrame(rows, schema)
    proofs = M.manifest(docs)
    root = F.lit(proofs.first()["root"])
    changed = [list(r) for r in rows]
    changed[7][4], changed[11][2], changed[13][3] = "text 8", None, 6
    changed.append([99, "s1", "en", 5, "new"])
    got = {r["doc_id"]: r["verified"] for r in M.verify(spark.createDataFrame([tuple(r) for r in changed], schema), proofs, root).collect()}
    assert {i for i, ok in got.items() if not ok} == {7, 11, 13, 99}


def test_hot_source_is_spread(spark):
    """One source has all rows: its leaves come in many runs, none with more than its share."""
    leaves = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("s").alias("grp"), M.digest(F.col("id").cast("string")).alias("digest"))
    got = M.numbered(leaves, ["doc_id", "digest"])
    assert got.filter("idx <> doc_id OR n <> 40000").count() == 0
    assert got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= 12_000
