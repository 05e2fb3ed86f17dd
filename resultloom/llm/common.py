"""What all operators of this package share: written intermediate tables, and Arrow batches cut to a bounded size."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from resultloom.plans.skew import scratch_folder

FEW = 1_000_000           # rows of one or two numbers that may be broadcast: 16 MB
BLOCK_BYTES = 1 << 20   # text that numpy handles at a time; its arrays take some 50 times as much


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{scratch_folder(spark)}/resultloom-llm/{name}-{uuid.uuid4().hex}"


_written: list[list[str]] = []   # tables written inside each call of ``finished`` that is under way


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    if _written:
        _written[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def finished(spark, name: str, build) -> DataFrame:
    """Stores what ``build()`` gives and removes the tables that were stored on the way to it; nothing is removed before the result is written."""
    _written.append([])
    try:
        out = stored(build(), name)
    finally:
        made = _written.pop()
    for path in made[:-1]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if _written:
        _written[-1].append(made[-1])
    return out


def few_or_not(ids: DataFrame) -> DataFrame:
    """A table of ids, to be broadcast if it has at most ``FEW`` rows; beyond that the join shuffles both sides."""
    return F.broadcast(ids) if ids.count() <= FEW else ids


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """UTF-8 bytes of all texts in order, in lists of at most ``limit`` bytes or one text; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    part, size = [], 0
    for n, value in zip(pc.binary_length(texts).to_pylist(), texts):
        if part and size + n > limit:
            yield part
            part, size = [], 0
        part.append(value.as_py())
        size += n
    if part:
        yield part


def extended(df: DataFrame, text: str, fn, added: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    """Adds columns (name, Spark type, Arrow type) that ``fn()`` makes, block by block, from lists of UTF-8 texts; columns of the same names are replaced.

    ``fn`` is called once per task and returns the function of a block. Results leave a task block by block, so its memory is that of a block,
    however many rows Spark puts into a batch.
    """
    names = [a[0] for a in added]
    kept = [c for c in df.columns if c not in names]
    source = df.select(*kept, *([] if text in kept else [F.col(text).alias("__text")]))
    at_text = kept.index(text) if text in kept else len(kept)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = fn()
        for batch in batches:
            at = 0
            for part in blocks(batch.column(at_text)):
                rows = batch.slice(at, len(part))
                at += len(part)
                yield pa.RecordBatch.from_arrays([*rows.columns[:len(kept)], *(pa.array(v, k) if not isinstance(v, pa.Array) else v for v, (_, _, k) in zip(make(part), added))], [*kept, *names])

    schema = T.StructType([*(f for f in source.schema.fields if f.name in kept), *(T.StructField(n, T._parse_datatype_string(k)) for n, k, _ in added)])
    return source.mapInArrow(of, schema)


def in_order(df: DataFrame, keys: list[str], name: str, sums: dict[str, str] | None = None, changes: dict[str, str] | None = None) -> DataFrame:
    """The rows in the order of ``keys``, written as runs that follow one another; nulls come first.

    Added: ``run`` and ``at`` (place in the run, from 0); for each of ``sums`` the sum of a long column over the rows before it in its run; for each of
    ``changes`` whether a column differs from the row before (true on the first row of a run). Runs are ranges of the keys, so no key is too
    frequent as long as all keys together tell rows apart. ``df`` is read twice: it should be a written table.
    """
    sums, changes = sums or {}, changes or {}
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = df.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, at, before, last = TaskContext.get().partitionId(), 0, dict.fromkeys(sums, 0), {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            added = [pa.array(np.full(n, run, np.int32)), pa.array(np.arange(at, at + n))]
            at += n
            for out, column in sums.items():
                ends = before[out] + np.cumsum(batch.column(column).to_numpy(zero_copy_only=False).astype(np.int64))
                added.append(pa.array(np.concatenate(([before[out]], ends[:-1]))))
                before[out] = int(ends[-1])
            for out, column in changes.items():
                values = batch.column(column).to_pylist()
                added.append(pa.array([a != b for a, b in zip(values, [last.get(out, ()), *values])]))
                last[out] = values[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*names, "run", "at", *sums, *changes])

    added = [("run", T.IntegerType()), ("at", T.LongType()), *((c, T.LongType()) for c in sums), *((c, T.BooleanType()) for c in changes)]
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, t) for c, t in added)])
    return stored(df.repartitionByRange(count, *keys).sortWithinPartitions(*keys).mapInArrow(number, schema), name)
