"""Merkle manifest of a dataset: a tree per source, a tree over the sources, and for every document the proof that it belongs.

A node is (group, index, digest). At each level every node meets the others of its run by self-joins on computed sibling indices: the index with its last bit
turned for binary trees, the slots shifted by 1, 2, ... inside the run otherwise. Rows of slot zero then hold the whole run and emit the parent. Indices spread the
rows of one source over all tasks, and each level has a fraction of the rows of the one below. Proofs come down the same tables: each node's path is its own
siblings and the path of its parent, so a level is joined once with the next smaller one.

Defined results: null fields are hashed as ``-``. Leaves are ordered by id, null first, and equal ids by their digests, so the root does not depend on the order of rows; repeated rows
are leaves of their own. A null source is a group before all others. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import few_or_not, in_order, stored

ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "struct<ahead:binary,behind:binary>"   # digests of the siblings on either side, one behind the other


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def as_text(digests: Column) -> Column:
    """Lower-case hex digits of one digest or of several in a row."""
    return F.lower(F.hex(digests))


def leaf_of(*fields: Column) -> Column:
    """Digest of the fields, each with its length in bytes, so that no two rows of fields look alike."""
    values = [f.cast("string") for f in fields]
    return digest(F.concat(*[F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in values]))


def numbered(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Adds the index of each leaf in its group ``grp`` and the number ``n`` of the group's leaves; groups may be of any size."""
    runs = in_order(leaves, ["grp", *order], "leaves")
    pieces = runs.groupBy("run", "grp").agg(F.min("at").alias("__from"), F.count(F.lit(1)).alias("__c"))
    # a group has at most one row per run here
    group = Window.partitionBy("grp")
    before = F.coalesce(F.sum("__c").over(group.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select("run", "grp", (before - F.col("__from")).alias("__off"), F.sum("__c").over(group).alias("n"))
    return runs.join(few_or_not(stored(pieces, "pieces")), ["run", "grp"]).withColumn("idx", F.col("at") + F.col("__off")).drop("run", "at", "__off")


def _met(nodes: DataFrame, arity: int) -> DataFrame:
    """Nodes with the digests of their siblings before (``ahead``) and after them (``behind``)."""
    slot, run = F.col("idx") % arity, F.expr(f"idx div {arity}")
    found = []
    for k in range(1, arity):
        sibling = F.col("idx").bitwiseXOR(F.lit(1).cast("long")) if arity == 2 else run * arity + (slot + k) % arity
        other = nodes.select("grp", F.col("idx").alias(f"__at{k}"), F.col("digest").alias(f"__d{k}"))
        found.append((f"__at{k}", sibling, other))
    out = nodes.withColumns({name: sibling for name, sibling, _ in found})
    for name, _, other in found:
        out = out.join(other, ["grp", name], "left")
    nothing = F.unhex(F.lit(""))
    # in the order of slots: a shift by k that wraps around is ahead of the node
    beside = lambda wrapped: F.concat(*[F.when(((slot + k >= arity) == F.lit(wrapped)), F.coalesce(F.col(f"__d{k}"), nothing)).otherwise(nothing) for k in range(1, arity)])
    return out.select(*nodes.columns, beside(True).alias("ahead"), beside(False).alias("behind"))


def levels(leaves: DataFrame, arity: int, name: str) -> list[DataFrame]:
    """All levels of the trees of all groups, each written: ``grp, idx, n, digest, ahead, behind``, the leaves with their other columns. A node with n = 1 is the root of its group."""
    leaves = stored(leaves, name)
    n = leaves.agg(F.max("n")).first()[0]
    out, nodes = [], leaves
    while n is not None:
        many = _met(nodes.filter("n > 1"), arity)
        nothing = F.unhex(F.lit(""))
        level = stored(many.unionByName(nodes.filter("n = 1").withColumns({"ahead": nothing, "behind": nothing})), name)
        out.append(level)
        if n == 1:
            return out
        n = -(-n // arity)
        heads = level.filter((F.col("n") > 1) & (F.col("idx") % arity == 0))
        nodes = heads.select("grp", F.expr(f"idx div {arity}").alias("idx"), F.expr(f"(n + {arity - 1}) div {arity}").alias("n"),
                             digest(F.concat(as_text(F.col("digest")), as_text(F.col("behind")))).alias("digest"))
    return out


def paths(tree: list[DataFrame], starts: DataFrame, arity: int, name: str) -> DataFrame:
    """The leaves with ``path``, the steps from the leaf up, and ``top``. ``starts`` gives both for the roots of the groups (``grp, path, top``)."""
    above = None
    for level, nodes in reversed(list(enumerate(tree))):
        roots = nodes.filter("n = 1").join(starts, "grp")
        if above is None:
            found = roots
        else:
            mine = F.array(F.struct("ahead", "behind").cast(STEP))
            up = above.select("grp", F.col("idx").alias("__up"), F.col("path").alias("__path"), "top")
            inner = nodes.filter("n > 1").withColumn("__up", F.expr(f"idx div {arity}")).join(up, ["grp", "__up"])
            found = inner.withColumn("path", F.concat(mine, F.col("__path"))).drop("__up", "__path").unionByName(roots)
        if level == 0:
            return found
        above = stored(found.select("grp", "idx", "path", "top"), name)


def proof_of(path: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(as_text(s["ahead"]), as_text(s["behind"]))), ""))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    def step(node, s):
        return digest(F.concat(as_text(s["ahead"]), as_text(node), as_text(s["behind"])))
    return F.aggregate(path, leaf, step)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", order: str = "doc_id", arity: int = ARITY, **more: Column) -> DataFrame:
    """``doc_id, leaf, subroot, root`` (digests), ``path`` and the columns ``more`` of each row: what anyone needs to check a document against the root alone."""
    grp = F.coalesce(F.concat(F.lit("s"), F.col(group).cast("string")), F.lit(""))   # sorts like the source, null first, and is never null
    leaves = stored(docs.select(F.col(order).alias("doc_id"), grp.alias("grp"), leaf_of(*map(F.col, fields)).alias("digest"), *[c.alias(n) for n, c in more.items()]), "leaves")
    tree = levels(numbered(leaves, ["doc_id", "digest"]), arity, "level")
    if not tree:
        return leaves.select("doc_id", F.col("digest").alias("leaf"), F.col("digest").alias("subroot"), F.col("digest").alias("root"), F.array().cast(f"array<{STEP}>").alias("path"), *more)
    tops = None
    for nodes in tree:
        some = nodes.filter("n = 1").select("grp", "digest")
        tops = some if tops is None else tops.unionByName(some)
    tops = stored(tops.select(F.lit("").alias("grp"), F.col("grp").alias("source"), "digest"), "subroots")
    upper = levels(numbered(tops, ["source"]), arity, "upper")
    root = upper[-1].first()["digest"]
    start = upper[-1].select("grp", F.array().cast(f"array<{STEP}>").alias("path"), F.lit(None).cast("binary").alias("top"))
    starts = stored(paths(upper, start, arity, "upper").select(F.col("source").alias("grp"), "path", F.col("digest").alias("top")), "starts")
    found = paths(tree, starts, arity, "paths")
    return found.select("doc_id", F.col("digest").alias("leaf"), F.col("top").alias("subroot"), F.lit(root).alias("root"), "path", *more)


def verify(docs: DataFrame, proofs: DataFrame, root: Column, fields: tuple[str, ...] = FIELDS, order: str = "doc_id") -> DataFrame:
    """Documents (ids unique) beside their proofs: does each, as it is now, lead to the root?"""
    now = docs.select(F.col(order).alias("doc_id"), leaf_of(*map(F.col, fields)).alias("now"))
    return now.join(proofs.select("doc_id", "path"), "doc_id", "left").select("doc_id", F.coalesce(folded(F.col("now"), F.col("path")) == root, F.lit(False)).alias("verified"))
