"""Shards of near equal size: the minimax contiguous partition of ordered groups.

Documents of equal texts are one group and stay together. Groups are ordered by their smallest id; shards are stretches of that order. The smallest capacity that
the given number of shards can keep to is found by binary search: a capacity is feasible if filling shards greedily uses up all groups. Then the
order is cut so that no shard exceeds this capacity: each shard takes its fair share of what is left, at least one group, and as much as the shards behind it can't
take.

The order is never held in one place. It is sorted over the cluster, with running sums per sorted run. The driver knows the size before a bounded number of groups
(``KNOTS`` at a time); between them it reckons with bounds. Where the bounds leave a capacity or a cut open, the stretches in question are looked at more closely.

Defined results: null text counts as empty, so null and empty texts are one group; its documents have size 1. Rows without an id come first in their group,
and a group without any id comes before the others. Repeated rows each have a slot. Other columns are ignored. An empty table gives an empty result; with
fewer groups than shards some shards are empty.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from resultloom.plans.skew import HOT_KEYS, lookup

from .common import few_or_not, in_order, stored

SHARDS = 16
KNOTS = 1 << 16   # buckets that one look at the order may return: five numbers each


class Order:
    """What the driver knows of the order: some places where a group begins (``at``, bytes before it), the end, and between which of
    them no other group begins (``solid``). ``floor`` and ``above`` give bounds of the last beginning up to x and of the first behind x."""

    def __init__(self, total: int):
        self.total, self.at, self.solid = total, [0, total], [False]

    def _gap(self, x: int) -> int:
        return min(bisect_right(self.at, x) - 1, len(self.at) - 1)

    def floor(self, x: int, high: bool) -> int:
        if x >= self.total:
            return self.total
        k = self._gap(x)
        return self.at[k] if self.solid[k] or not high else min(x, self.at[k + 1] - 1)

    def above(self, x: int, high: bool) -> int:
        if x >= self.total:
            return self.total
        k = self._gap(x)
        return self.at[k + 1] if self.solid[k] or high else x + 1

    def open_gaps(self, low: int, high: int) -> list[tuple[int, int]]:
        first, last = self._gap(low), self._gap(min(high, self.total - 1))
        return [(self.at[k], self.at[k + 1]) for k in range(first, last + 1) if not self.solid[k]]

    def learn(self, looked: list[tuple[int, int]], found: list[tuple[int, int, int, int]]) -> None:
        """``looked``: the gaps; ``found``: for each of their buckets that is not empty the gap's begin, its first and last beginning, and their number."""
        gaps: dict[int, list] = {begin: [] for begin, _ in looked}
        for begin, first, last, n in sorted(found):
            gaps[begin].append((first, last, n))
        at, solid = [], []
        for k, place in enumerate(self.at):
            at.append(place)
            if k == len(self.solid):
                break
            solid.append(self.solid[k] or place in gaps)
            for first, last, n in gaps.get(place, ()):
                at.append(first)
                solid.append(True)
                if last > first:
                    solid[-1] = n == 2
                    at.append(last)
                    solid.append(True)
        self.at, self.solid = at, solid


def smallest(feasible, low: int, high: int) -> int:
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if feasible(middle) else (middle + 1, high)
    return low


def cuts(order: Order, shards: int, largest: int) -> tuple[int, list[int], list[tuple[int, int]]]:
    """Smallest capacity and where the shards begin, as far as known, and the gaps that must be looked at before both are sure (none: done).

    Every place is held as a lower and an upper bound; all steps rise (or fall) with what they start from.
    """
    total = order.total

    def filled(capacity: int, high: bool) -> list[int]:
        places = [0]
        for _ in range(shards):
            places.append(order.floor(places[-1] + capacity, high))
        return places

    least = max(largest, -(-total // shards))
    low = smallest(lambda c: filled(c, True)[-1] == total, least, total)
    high = smallest(lambda c: filled(c, False)[-1] == total, low, total)
    places = [*zip(filled(low, False), filled(high, True))] if low < high else []
    # from the end: where the last j shards may begin at the earliest
    latest = [(total, total)]
    for _ in range(shards - 1):
        a, b = latest[-1]
        latest.append((order.above(max(a - high, 0) - 1, False) if a > high else 0, order.above(b - low - 1, True) if b > low else 0))
    begin = [(0, 0)]
    for i in range(1, shards):
        p = []
        for high_side, c in enumerate(begin[-1]):
            share = c + (total - c) // (shards - i + 1)
            p.append(max(order.floor(share, bool(high_side)), order.above(c, bool(high_side)), latest[shards - i][high_side]))
        begin.append(tuple(p))
    unsure = sorted({g for a, b in [*places, *latest, *begin] if a < b for g in order.open_gaps(a, b)})
    return high, [b for _, b in begin], unsure


def _look(heads: DataFrame, windows: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """Beginnings of groups strictly inside the windows, in at most ``KNOTS`` buckets."""
    begin, end = (np.array(x, np.int64) for x in zip(*windows))
    width = np.maximum(1, -(-(end - begin) // max(1, KNOTS // len(windows))))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.sort(batch.column(0).to_numpy(zero_copy_only=False))
            k = np.searchsorted(begin, at, "right") - 1
            inside = (k >= 0) & (at > begin[k]) & (at < end[k])
            at, k = at[inside], k[inside]
            if len(at):
                bucket = (at - begin[k]) // width[k]
                first = np.flatnonzero(np.concatenate(([True], (np.diff(k) != 0) | (np.diff(bucket) != 0))))
                stop = np.append(first[1:], len(at))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (begin[k[first]], bucket[first], at[first], at[stop - 1], stop - first)], ["gap", "bucket", "first", "last", "n"])

    some = heads.mapInArrow(of, "gap long, bucket long, first long, last long, n long")
    some = some.groupBy("gap", "bucket").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    return [(r["gap"], r["first"], r["last"], r["n"]) for r in some.collect()]


def with_size(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, digest``: what an assignment needs of each document."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(id).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), digest_of(text).alias("digest"))


def digest_of(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def assign(docs: DataFrame, shards: int = SHARDS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, digest, shard, slot`` per row; slots of a shard follow the order of groups and, inside a group, of ids."""
    spark = docs.sparkSession
    rows = stored(with_size(docs, id, text), "sizes")
    groups = stored(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.sum("size").alias("bytes")), "groups")
    largest = groups.agg(F.max("bytes")).first()[0]
    if largest is None:
        return rows.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    shared = groups.filter("copies > 1").select("digest", "first", "copies")
    rows = stored(lookup(rows, shared, ["digest"], size="copies", hot_rows=max(1, rows.count() // HOT_KEYS)).withColumn("first", F.coalesce("first", "doc_id")), "grouped")
    ordered = in_order(rows, ["first", "digest", "doc_id"], "ordered", sums={"bytes_before": "size"}, changes={"head": "digest"})
    # one row per run: as many as there are shuffle partitions
    runs = ordered.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.min_by("digest", "at").alias("a"), F.max_by("digest", "at").alias("z")).orderBy("run").collect()
    listed, count, total, last = [], 0, 0, None
    for r in runs:
        listed.append((r["run"], count, total, last == r["a"]))
        count, total, last = count + r["n"], total + r["bytes"], r["z"]
    offsets = F.broadcast(spark.createDataFrame(listed, "run int, __rows long, __bytes long, goes_on boolean"))
    ordered = ordered.join(offsets, "run").withColumns({"place": F.col("bytes_before") + F.col("__bytes"), "nth": F.col("at") + F.col("__rows")})
    heads = ordered.filter(F.col("head") & ~(F.col("goes_on") & (F.col("at") == 0))).select("place")
    order = Order(total)
    unsure = [(0, total)]
    while unsure:
        order.learn(unsure, _look(heads, unsure))
        # a gap that was looked at is either resolved or cut into smaller ones
        _, begin, unsure = cuts(order, shards, largest)
    shard = sum(((F.col("place") >= b).cast("int") for b in begin[1:]), F.lit(0))
    placed = ordered.withColumn("shard", shard)
    before = {r["shard"]: r["nth"] for r in placed.groupBy("shard").agg(F.min("nth").alias("nth")).collect()}
    ahead = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in before.items() for x in kv]), F.col("shard").cast("long"))
    return placed.select("doc_id", "size", "text_crc32", "digest", "shard", (F.col("nth") - ahead).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id: str = "doc_id", text: str = "text") -> None:
    """Writes the documents into a folder per shard, in the order of their slots. Rows of one id and one text are told apart by nothing: they come one behind the other."""
    where = assign(docs, shards, id, text).groupBy("doc_id", "digest").agg(F.min("shard").alias("shard"), F.min("slot").alias("__slot"))
    keyed = docs.withColumn("__digest", digest_of(text))
    placed = keyed.join(few_or_not(stored(where.withColumnsRenamed({"doc_id": "__id", "digest": "__digest_"}), "placed")),
                        F.col(id).eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__digest_")))
    placed = placed.repartitionByRange("shard", "__slot").sortWithinPartitions("shard", "__slot")
    placed.select(*[c for c in docs.columns if c != "shard"], "shard").write.partitionBy("shard").parquet(path)
