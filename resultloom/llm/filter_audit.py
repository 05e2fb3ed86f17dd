"""How filters overlap: what each removes at each place of each order, and its exact Shapley share.

Every document has a mask of the filters it fails. From the histogram of masks, each part's table of *coalitions* is made: how many documents
any filter of a set removes, for all sets. Differences of two coalitions are the counts of a step: a filter behind the set ``P`` removes
``v(P + f) - v(P)``. The Shapley values are the solution of a least squares problem: the additive game closest to ``v``
under the Shapley kernel's weights, held to add up to ``v`` of all filters. Its normal equations with that condition are solved in
rationals, so the values are exact.

Defined results: null text counts as empty. A document without an id fails no comparison with smaller ids and is nobody's smaller id. Repeated rows count
as often as they occur; rows of one id and one text aren't earlier than one another. A null part is the empty string's part. An id has a label if any
of its label rows says so. Other columns are ignored. An empty table has no parts and gives an empty result.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import extended, few_or_not, stored

FILTERS = "ABCDE"
# fixed values of the audited filters
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 100, 80, 10
CAPITALS, SYMBOLS, INNER = bytes(range(65, 91)), b"#$%&*|", bytes(range(0x80, 0xC0))


def failures(text: bytes) -> int:
    """Bits 0 to 3 for the filters that look at one text: few words, few different words, many capitals, symbols."""
    words = text.split()   # bytes: exactly the blanks \\x20 \\x09-\\x0D
    capitals = len(text) - len(text.translate(None, CAPITALS))
    points = len(text.translate(None, INNER))
    return ((len(words) < MIN_WORDS) | (100 * len(set(words)) < MIN_DISTINCT * len(words)) << 1 | (100 * capitals > MAX_CAPITALS * points) << 2
            | (len(text.translate(None, SYMBOLS)) < len(text)) << 3)


def with_failures(docs: DataFrame, text: str = "text", out: str = "mask", digest: str = "digest") -> DataFrame:
    """Adds the failures of each whole text, and the digest by which equal texts are found."""
    def of(texts: list[bytes]):
        return [failures(t) for t in texts], [hashlib.sha256(t).digest() for t in texts]

    return extended(docs, text, lambda: of, [(out, "int", pa.int32()), (digest, "binary", pa.binary())])


def histogram(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """``part, mask, n, good, toxic``: documents by their failures; bit 4 is set if a smaller id has the same text.

    Equal texts fail the same filters, so a text is one row per part before it is shuffled, however many copies it has.
    """
    rows = docs.select(F.col(id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).alias("text"))
    rows = with_failures(rows).select("doc_id", "part", "mask", "digest")
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    marks = labels.filter(F.col(id).isNotNull()).groupBy(F.col(id).alias("doc_id")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    marks = few_or_not(stored(marks.filter("good OR toxic").withColumn("salt", F.lit(0)), "marks"))
    # rows without an id meet no label; the salt deals them out where the join shuffles
    rows = rows.withColumn("salt", F.when(F.col("doc_id").isNull(), F.pmod(F.hash("digest"), F.lit(4096)) + 1).otherwise(0)).join(marks, ["doc_id", "salt"], "left")
    one = lambda c: F.sum(F.coalesce(F.col(c), F.lit(False)).cast("long")).alias(c)
    each = rows.groupBy("digest", "part", "mask", "doc_id").agg(F.count(F.lit(1)).alias("n"), one("good"), one("toxic"))
    named = F.col("doc_id").isNotNull()
    counts = ("n", "good", "toxic")
    texts = each.groupBy("digest", "part", "mask").agg(F.min(F.when(named, F.struct("doc_id", *counts))).alias("first"),
                                                       F.struct(*[F.sum(F.when(named, F.col(c)).otherwise(0)).alias(c) for c in counts]).alias("named"),
                                                       F.struct(*[F.sum(F.when(named, 0).otherwise(F.col(c))).alias(c) for c in counts]).alias("nameless"))
    # a text has as many rows here as it has parts
    least = texts.groupBy("digest").agg(F.min("first.doc_id").alias("least"))
    texts = texts.join(least, "digest")
    own = F.coalesce(F.col("first.doc_id") == F.col("least"), F.lit(False))
    first = {c: F.when(own, F.col(f"first.{c}")).otherwise(0) for c in counts}
    passing = F.struct(F.col("mask").alias("mask"), *[(F.col(f"nameless.{c}") + first[c]).alias(c) for c in counts])
    failing = F.struct((F.col("mask") + 16).alias("mask"), *[(F.col(f"named.{c}") - first[c]).alias(c) for c in counts])
    split = texts.select("part", F.explode(F.array(passing, failing)).alias("x")).select("part", "x.*").filter("n > 0")
    return split.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in counts])


def coalitions(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """``part, coalition, total, removed, good, toxic`` for all sets of filters; a histogram has at most as many rows a part as there are sets."""
    sets = masks.withColumn("coalition", F.explode(F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))))
    hit = F.col("mask").bitwiseAND(F.col("coalition")) != 0
    return sets.groupBy("part", "coalition").agg(F.sum("n").alias("total"), *[F.sum(F.when(hit, F.col(c)).otherwise(0)).alias(o) for c, o in (("n", "removed"), ("good", "good"), ("toxic", "toxic"))])


def solve(rows: list[list[Fraction]]) -> list[Fraction]:
    """Unknowns of a regular linear system, each row with its right side at the end, by elimination in rationals."""
    rows, n = [list(r) for r in rows], len(rows)
    for i in range(n):
        pivot = next(k for k in range(i, n) if rows[k][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for k in range(n):
            if k != i and rows[k][i]:
                rows[k] = [a - rows[k][i] * b for a, b in zip(rows[k], rows[i])]
    return [r[n] for r in rows]


def shapley(values: list[int]) -> list[Fraction]:
    """Shapley values of the game ``values`` (worth of each set of players, by its bits; the empty one is worth nothing).

    Least squares over the proper sets under the kernel weights, with the values held to add up to the worth of all: one
    equation per player, one more for the multiplier of the condition.
    """
    m = len(values).bit_length() - 1
    weight = {s: Fraction(m - 1, comb(m, k) * k * (m - k)) for s in range(1, len(values) - 1) for k in [s.bit_count()]}
    among = lambda *players: [s for s in weight if all(s >> p & 1 for p in players)]
    rows = [[*(sum((weight[s] for s in among(i, j)), Fraction(0)) for j in range(m)), Fraction(1), sum((weight[s] * values[s] for s in among(i)), Fraction(0))] for i in range(m)]
    rows.append([*[Fraction(1)] * m, Fraction(0), Fraction(values[-1])])
    return solve(rows)[:m]


def audit(sets: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order and step from the tables of coalitions; each part is a group of as many rows as there are sets."""
    m, orders = len(filters), factorial(len(filters))
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def of(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        at = dict(zip(table.column("coalition").to_pylist(), table.select(["total", "removed", "good", "toxic"]).to_pylist()))
        removed, good, toxic = ([at[s][c] for s in range(1 << m)] for c in ("removed", "good", "toxic"))
        total, every = at[0]["total"], (1 << m) - 1
        shares = [share * orders for share in shapley(removed)]
        assert all(s.denominator == 1 for s in shares)
        rows = []
        for order in permutations(range(m)):
            before = 0
            for step, f in enumerate(order, 1):
                behind = before | 1 << f
                gone = removed[behind] - removed[before]
                rows.append((part, "".join(filters[i] for i in order), step, filters[f], total - removed[behind], gone, removed[1 << f] - gone, removed[every] - removed[every ^ 1 << f],
                             good[behind] - good[before], toxic[behind] - toxic[before], int(shares[f])))
                before = behind
        kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), *[pa.int64()] * len(names)]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["part", "filter_order", "step", "letter", *names])

    schema = "part string, filter_order string, step int, letter string, " + ", ".join(f"{n} long" for n in names)
    return sets.groupBy("part").applyInArrow(of, schema)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over whole documents."""
    return audit(coalitions(histogram(docs, labels)))
