"""Grouped steps that stay balanced when one group holds a large share of all rows.

A window over a whole group puts that group into one task. The steps below give the same results from
partial aggregation, joins whose hot keys are broadcast, and windows over bounded slices of a group:

* ``attach``      aggregate per group, put back on every row of the group
* ``lookup``      many-to-one join: a table below Spark's own threshold travels by broadcast; else in three branches: rows of hot keys
                  meet them by broadcast and are not moved, rows without a key pass through, the rest is an ordinary shuffled join
* ``sieve``       rows that may have one of many keys, told by a broadcast bit table, so that a join behind it moves few of the others
* ``prefix_sum``  running sum, ``number_rows`` running number: local per slice, plus an offset per slice
* ``previous``    value of the row before, across slices
* ``rank_value`` order statistics by a radix selection over histograms
* ``top_k``       first k rows of each group; Spark cuts every map task to k rows before its shuffle

A *slice* is a coarse, order-preserving function of the leading order column (for example
``floor(line_no / 65536)``), so slices follow one another in the order of the rows.

Every step reads its input more than once. An input that is itself the result of shuffles is therefore written once
to the shared checkpoint folder (``settle``): that cuts the lineage, survives lost executors, and keeps plans small.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

HOT_KEYS = 1000        # keys that may be hot at once: a key is hot if it has more than this share of all rows
HOT_ROWS = None        # rows above which a key is hot; None: rows / HOT_KEYS, so hot keys are few at any size and may be broadcast
SMALL = 1 << 20        # rows of a table that one task can bear: none of its keys is hot
SLICE = 65_536         # rows of one slice when the order column is a dense counter
SIEVE = 1 << 26        # bits of a sieve, 8 MB: some millions of keys let a few percent of the other rows through
SLICE_ROWS, MANY_SLICES = 1 << 20, 100_000   # a slice of more rows, and of more than this share of all rows, is cut again

#: physical steps that move rows; joins with a broadcast table and what reads, filters or computes row by row do not
_MOVES = {"SortMergeJoin", "ShuffledHashJoin", "CartesianProduct", "BroadcastNestedLoopJoin", "HashAggregate", "ObjectHashAggregate", "SortAggregate", "Window", "Sort", "Exchange", "TakeOrderedAndProject"}
_own_folder: list = []


def scratch_folder(spark) -> str:
    """The cluster's checkpoint folder; a folder of our own only on one machine and where the session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="resultloom-"))
    return _own_folder[0]


def settle(df: DataFrame, dear: bool = False) -> DataFrame:
    """The same rows read back from a written table. A plan that moves no rows (scans, projections, joins with small written tables) is left as it is:
    computing it again is cheaper than a copy, unless its rows are ``dear`` to make."""
    if not dear and not _moves(df._jdf.queryExecution().sparkPlan()):
        return df
    path = f"{scratch_folder(df.sparkSession)}/resultloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _moves(node) -> bool:
    children = node.children()
    return node.nodeName() in _MOVES or any(_moves(children.apply(i)) for i in range(children.size()))


def _limit(df: DataFrame, hot_rows: int | None) -> int | None:
    """Rows above which a key is hot; None if the table is so small that one task could hold it."""
    if hot_rows is not None:
        return hot_rows
    rows = df.count()
    return None if rows <= SMALL else max(1, rows // HOT_KEYS)


def _travels(dim: DataFrame) -> bool:
    """Whether Spark would broadcast the table by its size; that of a written table is known, that of an aggregate is only guessed from the files below it."""
    plan = dim._jdf.queryExecution().optimizedPlan()
    text = plan.toString()
    if "Relation [" not in text and "Relation[" not in text or "Aggregate [" in text:   # only tables that are read from files
        return False
    size = plan.stats().sizeInBytes()
    most = dim.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(size)) <= most


def lookup(df: DataFrame, dim: DataFrame, on: list[str], size: str | None = None, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Left join to a table with one row per key; rows with a null in their key match nothing.

    ``size`` names a column of ``dim`` with the number of rows of ``df`` per key, if it is known. Keys above ``hot_rows``
    are broadcast: at most rows(df) / hot_rows of them exist, whatever the data.
    """
    return _lookup(settle(df), settle(dim), on, size, hot_rows)


def _lookup(df, dim, on, size, hot_rows):
    values = [c for c in dim.columns if c not in on and c != size]
    if hot_rows is None and _travels(dim.select(*on, *values)):   # no row of df moves, so no key is hot, and the plan has one branch
        return df.select(*[c for c in df.columns if c not in values]).join(F.broadcast(dim.select(*on, *values)), on, "left")
    limit = _limit(df, hot_rows)
    if limit is None:
        return df.select(*[c for c in df.columns if c not in values]).join(dim.select(*on, *values), on, "left")
    packed = dim.select(*on, F.struct(*values).alias("__found"), *([F.col(size).alias("__size")] if size else []))
    if size is None:
        often = df.groupBy(*on).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > limit).select(*on)
        hot, cold = F.broadcast(often).join(packed, on, "left"), packed     # also hot keys that the table lacks
    else:
        hot, cold = packed.filter(F.col("__size") > limit).drop("__size"), packed.filter(F.col("__size") <= limit).drop("__size")
        often = hot.select(*on)
    base = df.select(*[c for c in df.columns if c not in values])
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on])
    keyed = base.filter(complete)
    parts = [keyed.join(F.broadcast(hot), on), keyed.join(F.broadcast(often), on, "left_anti").join(cold, on, "left"),
             base.filter(~complete).withColumn("__found", F.lit(None).cast(packed.schema["__found"].dataType))]
    out = reduce(DataFrame.unionByName, parts)
    return out.select(*base.columns, *[F.col("__found")[v].alias(v) for v in values])


def attach(df: DataFrame, on: list[str], hot_rows: int | None = HOT_ROWS, few_groups: bool = False, **aggs: Column) -> DataFrame:
    """Every row with the aggregates of its group: what a window without an order gives, minus the hot task.

    ``few_groups`` writes the aggregates first: Spark then knows their real size and broadcasts them only if they are below
    its own threshold, which saves the shuffle of all rows.
    """
    df = settle(df)
    groups = df.groupBy(*on).agg(F.count(F.lit(1)).alias("__rows"), *[c.alias(n) for n, c in aggs.items()])
    return _lookup(df, settle(groups) if few_groups else groups, on, "__rows", hot_rows)


def sieve(df: DataFrame, keys: DataFrame, on: list[str], also: Column, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Rows whose key is among ``keys``, those with a null in it, those that are ``also`` wanted, and some others: the key's hash tells a bit, and the bits of
    all keys are a table of fixed size that travels by broadcast. No row of ``df`` moves; what is left is written. Tables that a lookup joins plainly stay whole."""
    df, keys = settle(df), settle(keys)
    if (hot_rows is None and _travels(keys)) or _limit(df, hot_rows) is None:
        return df
    of = lambda: F.pmod(F.xxhash64(*[F.col(c).cast(df.schema[c].dataType) for c in on]), F.lit(SIEVE))
    bits = keys.dropna(subset=on).select(of().alias("__bit")).selectExpr("__bit DIV 64 AS __word", "shiftleft(1L, CAST(__bit % 64 AS INT)) AS __set").groupBy("__word").agg(F.bit_or("__set").alias("__set"))
    parts = bits.groupBy(F.expr("__word DIV 64").alias("__part")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("__word") % 64, "__set"))).alias("__sets"))
    parts = parts.selectExpr("__part", "transform(sequence(0L, 63L), i -> coalesce(__sets[i], 0L)) AS __words")
    found = df.withColumn("__bit", of()).withColumn("__part", F.expr("__bit DIV 4096")).join(F.broadcast(parts), "__part", "left")
    hit = F.expr("getbit(get(__words, CAST(__bit DIV 64 % 64 AS INT)), CAST(__bit % 64 AS INT)) = 1")
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    return settle(found.filter(F.coalesce(hit, F.lit(False)) | missing | also).select(*df.columns), dear=True)


def _sliced(df, on, slices, order, hot_rows):
    """Adds the slice columns. A slice of too many rows is cut again at sampled bounds of its rows' full order, so the pieces are of like size whatever
    the order columns hold; pieces follow one another in the order of the rows, like slices."""
    names = [f"__s{i}" for i in range(len(slices))]
    df = df.withColumns(dict(zip(names, slices)))
    rows = df.count()
    limit = hot_rows or max(SLICE_ROWS, rows // MANY_SLICES)
    if rows <= limit:
        return df, names
    big = settle(df.groupBy(*on, *names).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > limit))
    held = big.agg(F.sum("__n")).first()[0]
    if held is None:
        return df, names
    keys = F.broadcast(big.drop("__n"))    # at most rows / limit of them
    pieces = min(-(-2 * held // limit), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 8)
    cut = df.join(keys, [*on, *names], "left_semi").repartitionByRange(max(2, pieces), *on, *names, *order).withColumn("__cut", F.spark_partition_id())
    rest = df.join(keys, [*on, *names], "left_anti").withColumn("__cut", F.lit(0))
    return rest.unionByName(settle(cut)), [*names, "__cut"]


def _with_slice_values(df, per_slice, cols):
    """Joined on the very columns the windows are partitioned by, so the rows are not shuffled again."""
    return df.join(per_slice, cols, "left")


def prefix_sum(df: DataFrame, on: list[str], order: list, value, slices: list, out: str, before: bool = False,
               hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Running sum of ``value`` in each group, with the row itself or (``before``) without it."""
    value = F.col(value) if isinstance(value, str) else value
    df = settle(df)
    source = df.columns
    df, names = _sliced(df, on, slices, order, hot_rows)
    cols = [*on, *names]
    totals = df.groupBy(*cols).agg(F.sum(value).alias("__t"))
    ahead = Window.partitionBy(*on).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*cols, F.sum("__t").over(ahead).alias("__off"))
    local = Window.partitionBy(*cols).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)
    df = df.withColumn("__run", F.sum(value).over(local))
    df = _with_slice_values(df, offsets, cols)
    zero = F.lit(0)
    return df.select(*[c for c in source if c != out], (F.coalesce("__off", zero) + F.coalesce("__run", zero)).alias(out))


def number_rows(df: DataFrame, on: list[str], order: list, slices: list, out: str,
                hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Dense running number from 1 in each group."""
    return prefix_sum(df, on, order, F.lit(1).cast("long"), slices, out, hot_rows=hot_rows)


def previous(df: DataFrame, on: list[str], order: list, value: str, slices: list, out: str,
             hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """``value`` of the row before in each group, null on the first row. ``value`` must not be null."""
    df = settle(df)
    source = df.columns
    df, names = _sliced(df, on, slices, order, hot_rows)
    cols = [*on, *names]
    last = df.groupBy(*cols).agg(F.max_by(value, F.struct(*order)).alias("__last"))
    carried = last.select(*cols, F.lag("__last").over(Window.partitionBy(*on).orderBy(*names)).alias("__carry"))
    df = df.withColumn("__lag", F.lag(value).over(Window.partitionBy(*cols).orderBy(*order)))
    df = _with_slice_values(df, carried, cols)
    return df.select(*[c for c in source if c != out], F.coalesce("__lag", "__carry").alias(out))


def nearest(points: DataFrame, marks: DataFrame, on: list[str], at: str, slices: list,
            hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Points with the closest mark of their group on either side: largest ``below`` <= at <= smallest ``above``.

    One sorted pass over points and marks together, slice by slice, instead of pairs.
    """
    both = points.withColumn("__mark", F.lit(False)).unionByName(marks.select(*on, at, F.lit(True).alias("__mark")), allowMissingColumns=True)
    both, names = _sliced(settle(both), on, slices, [at], hot_rows)
    cols, mark = [*on, *names], F.when(F.col("__mark"), F.col(at))
    span = Window.partitionBy(*on).orderBy(*names)
    ends = both.groupBy(*cols).agg(F.max(mark).alias("__hi"), F.min(mark).alias("__lo"))
    ends = ends.select(*cols, F.max("__hi").over(span.rowsBetween(Window.unboundedPreceding, -1)).alias("__prev"),
                       F.min("__lo").over(span.rowsBetween(1, Window.unboundedFollowing)).alias("__next"))
    up = Window.partitionBy(*cols).orderBy(at, F.desc("__mark")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy(*cols).orderBy(F.desc(at), F.desc("__mark")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("__b", F.last(mark, True).over(up)).withColumn("__a", F.last(mark, True).over(down)).filter(~F.col("__mark"))
    both = _with_slice_values(both, ends, cols)
    return both.select(*points.columns, F.coalesce("__b", "__prev").alias("below"), F.coalesce("__a", "__next").alias("above"))


def top_k(df: DataFrame, on: list[str], order: list, k: int, out: str = "rank") -> DataFrame:
    """First k rows of each group with their rank."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*on).orderBy(*order))).filter(F.col(out) <= k)


def slice_of(c, width: int = SLICE) -> Column:
    """Order-preserving slice of a counter."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c / F.lit(width)).cast("long")


def _picked(rows, ranks, on):
    """The rows (group, part, digit ``__d``, count ``__c``) on which the ranks of their part fall, with the rank inside them. A part has at most ``SLICE`` rows."""
    ahead = Window.partitionBy(*on, "__p").orderBy("__d").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__b", F.coalesce(F.sum("__c").over(ahead), F.lit(0)))
    rows = rows.join(ranks.select(*on, "__p", "__picks"), [*on, "__p"]).withColumn("__k", F.explode("__picks")).drop("__picks")
    return rows.filter((F.col("__k.at") >= F.col("__b")) & (F.col("__k.at") < F.col("__b") + F.col("__c"))).withColumn("__k", F.struct(F.col("__k.name").alias("name"), (F.col("__k.at") - F.col("__b")).alias("at")))


def _digit(first: bool) -> Column:
    """Grows with the value: its binary exponent first, then 65 536 steps of equal width between the lowest and the highest value that are left."""
    v, low, high = (F.col(c).cast("double") for c in ("__v", "__lo", "__hi"))
    if first:
        size = F.least(F.floor(F.log2(F.abs(v))), F.lit(1500)) + 1100
        return F.when(F.isnan(v), F.lit(4000)).when(v == 0, F.lit(0)).otherwise(F.signum(v).cast("long") * size).cast("long")
    return F.when(high > low, F.least(F.floor((v - low) / (high - low) * 65536), F.lit(65535))).otherwise(F.lit(0)).cast("long")


def rank_value(df: DataFrame, on: list[str], value: str, picks: dict, hot_rows: int | None = HOT_ROWS, bound: int = SLICE) -> DataFrame:
    """Exact order statistics of each group: count, lowest, highest and the values at given ranks; keys must not be null.

    ``picks`` maps a result name to a function of the count that gives a rank from 0. Works on the histogram, which Spark combines before
    the shuffle, so equal values cost nothing. Groups of more than ``bound`` different values are narrowed by a radix selection first: counts by digit tell in which
    digit each rank falls, and only its values go on. The exponent takes one pass and the 52 bits behind it at most four, so no window holds more rows than digits.
    """
    hist = settle(df.filter(F.col(value).isNotNull()).groupBy(*on, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__c")))
    total = settle(hist.groupBy(*on).agg(F.sum("__c").alias("count"), F.min("__v").alias("low"), F.max("__v").alias("high"), F.count(F.lit(1)).alias("__n")))
    asked = F.array(*[F.struct(F.lit(n).alias("name"), at(F.col("count")).cast("long").alias("at")) for n, at in picks.items()])
    ranks = total.select(*on, F.lit("").alias("__p"), asked.alias("__picks"), F.col("low").alias("__lo"), F.col("high").alias("__hi"), "__n")
    left, first = hist.withColumn("__p", F.lit("")), True

    def narrowed():
        found = _lookup(left, ranks.select(*on, "__p", F.lit(True).alias("__in"), "__lo", "__hi", "__n"), [*on, "__p"], "__n", hot_rows)
        return found.filter("__in").drop("__in")

    while ranks.filter(F.col("__n") > bound).take(1):
        left = settle(narrowed().withColumn("__d", _digit(first)))
        digits = left.groupBy(*on, "__p", "__d").agg(F.sum("__c").alias("__c"), F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
        part = F.concat_ws("/", "__p", F.col("__d").cast("string"))
        ranks = _picked(digits, ranks, on).withColumn("__p", part).groupBy(*on, "__p").agg(
            F.collect_list("__k").alias("__picks"), F.first("__lo").alias("__lo"), F.first("__hi").alias("__hi"), F.first("__n").alias("__n"))
        ranks, left, first = settle(ranks), left.select(*on, "__v", "__c", part.alias("__p")), False
    rows = left if first else narrowed()
    found = _picked(rows.select(*on, "__p", F.col("__v").alias("__d"), "__c"), ranks, on)
    found = found.groupBy(*on).agg(*[F.max(F.when(F.col("__k.name") == n, F.col("__d"))).alias(n) for n in picks])
    return total.drop("__n").join(found, on)


def exact_median(df: DataFrame, on: list[str], value: str, hot_rows: int | None = HOT_ROWS, bound: int = SLICE) -> DataFrame:
    """Count and exact median of each group."""
    ranked = rank_value(df, on, value, {"__low": lambda n: F.floor((n - 1) / 2), "__high": lambda n: F.floor(n / 2)}, hot_rows, bound)
    return ranked.select(*on, "count", ((F.col("__low") + F.col("__high")) / 2).alias("median"))
