"""The corpus pipeline: documents in, token digests of clean and different documents out.

``STAGES`` are (name, function) in their order; each function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of the documents they got. A stage works on all that the one before kept: its result is written and read again.
"""

from __future__ import annotations

import os
import sys
from functools import partial

from pyspark.sql import DataFrame, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from resultloom.llm import decontaminate, quality_rules, queries, secrets, simhash  # noqa: E402
from resultloom.llm.common import few_or_not, finished, stored, table  # noqa: E402

#: calibrated cutoffs, fingerprints and token ids are no SQL; tests/llm compares the stages with plain versions
ORACLE_SQL = None


def quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the guaranteed cutoffs keep."""
    return quality_rules.judge(docs, table(spark, sf_dir, "labels")).filter("kept").select(*docs.columns)


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id.

    Near duplicates share 0.8 or more of their five-word shingles (Jaccard), checked by the shingles themselves. The query of the operator
    links by its own contract, three bits of a fingerprint of three-word shingles, which hardly any near copy is within.

    Where ids repeat, each group still keeps one row: that of the smallest id and then of the smallest hash of its shingles. Rows without an id stay only if no document of their group has one, and then as one row.
    """
    groups = finished(spark, "groups", lambda: simhash.similar_groups(docs))
    if groups.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").take(1):
        # an id may name rows of several groups: each group is represented by its own row
        first = groups.filter("doc_id IS NOT NULL").groupBy("group_node").agg(F.min(F.struct("doc_id", F.col("node").alias("__node"))).alias("first"))
        first = few_or_not(stored(first.select("first.*"), "firsts"))
        out = simhash.with_node(docs, "__node").join(first, ["doc_id", "__node"], "left_semi").dropDuplicates(["doc_id", "__node"]).select(*docs.columns)
    else:
        first = few_or_not(stored(groups.filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct(), "firsts"))
        out = docs.join(first, "doc_id", "left_semi").select(*docs.columns)
    if groups.filter("component_id IS NULL").take(1):
        nameless = docs.filter("doc_id IS NULL")
        lone = groups.filter("component_id IS NULL").select(F.col("node").alias("__node"), F.col("group_node").alias("__group")).distinct()
        nameless = simhash.with_node(nameless, "__node").join(lone, "__node").dropDuplicates(["__group"])
        out = out.unionByName(nameless.select(*docs.columns))
    return out


def decontamination(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any verified overlap with a benchmark item. Rows without an id can't be named by an overlap: they are checked by their text's hash."""
    key = F.xxhash64("text", F.col("doc_id").cast("string"))
    bad = decontaminate.overlaps(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    bad = few_or_not(stored(bad.withColumnRenamed("doc_id", "__key"), "overlapping"))
    return docs.withColumn("__key", key).join(bad, "__key", "left_anti").select(*docs.columns)


def secret_scan(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; ``n_chars`` follows where a text has changed."""
    out = secrets.redact(docs.withColumn("__before", F.col("text")))
    if "n_chars" in docs.columns:
        changed = ~F.col("text").eqNullSafe(F.col("__before"))
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def tokens(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids of each document that is left."""
    return queries.token_digests(docs.select("doc_id", "text"))


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_duplicates), ("benchmark_decontamination", decontamination),
          ("secret_scan", secret_scan), ("byte_bpe", tokens)]


def run(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = finished(spark, name, partial(stage, spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
