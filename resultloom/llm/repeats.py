"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Every suffix of every text is ordered by its first ``depth`` bytes only, most significant digit first; suffixes that are alone with their
digits so far drop out, and the groups that are left in the end are exactly the repeated windows of ``depth`` bytes.

* First digit, over the cluster: a window's anchor, the ``anchor`` bytes of least hash in it (the leftmost of equals). It depends on the window's
  content alone, so equal windows meet under one key, and neighbouring windows mostly share it: windows travel as one row per run of common anchor, about
  2.5 % of all suffixes. Whole texts that are equal are told apart before that.
* Runs of equal bytes are repeated as a whole: all but the first are removed without a look at their windows. A run whose anchor no other run has drops out.
* Further digits, in tasks: the few runs that share an anchor but differ in other bytes are split into their windows, which are sorted by eight bytes at
  a time up to ``depth``.

No key holds more than a task can bear: a block of text sends each different run once, and anchors with many different runs (found on a sample of
texts, which decides on the way and not on the result) are sent as single windows under a key of the window itself, each once per block.
Anchors and runs are compared by 64-bit hashes each, together 128 bits; windows in the last step byte by byte.

Defined results: a null text is empty. Documents are ordered by id, null first, and rows of equal id by their text's SHA-256; repeated rows
(same id and text) are one document and get the same result. Texts shorter than ``depth`` lose nothing. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import few_or_not, stored
from .text import Spans

DEPTH, ANCHOR = 100, 24
PIECE, BLOCK = 1 << 20, 1 << 23
SAMPLE, HOT_RUNS, HOT_KEYS = 16, 64, 20_000
NULL_ID = -(1 << 63)
ANCHORED, REMOVED, HOT = range(3)


def runs_of(text: np.ndarray, depth: int, anchor: int) -> tuple[np.ndarray, ...]:
    """First window, last window, hash of the anchor and hash of all bytes of each run of windows with a common anchor."""
    out = []
    for at in range(0, max(1, len(text) - depth + 1), PIECE):
        piece = text[at:at + PIECE + depth - 1]
        n, width = len(piece) - depth + 1, depth - anchor + 1
        if n <= 0:
            break
        spans = Spans(piece)
        place = np.arange(len(piece) - anchor + 1)
        h = spans.hashes(place, place + anchor)
        pad = np.concatenate((h, np.full(-len(h) % width, ~np.uint64(0)))).reshape(-1, width)
        ahead, behind = np.minimum.accumulate(pad, 1).ravel(), np.minimum.accumulate(pad[:, ::-1], 1)[:, ::-1].ravel()
        least = np.minimum(behind[:n], ahead[width - 1:width - 1 + n])
        first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        last = np.append(first[1:], n) - 1
        where = first + np.lib.stride_tricks.sliding_window_view(h, width)[first].argmin(1)
        again = np.flatnonzero(last > where)     # the same hash once more in the run: its windows have different anchors
        if len(again):
            more, keep = [], np.ones(len(first), bool)
            keep[again] = False
            for a, b in zip(first[again].tolist(), last[again].tolist()):
                value = least[a]
                hits = np.flatnonzero(h[a:b + width] == value) + a
                start = np.concatenate(([a], hits[:-1] + 1))
                ok = start <= b
                more.append(np.stack((start[ok], np.minimum(hits[ok], b))))
            first, last = np.concatenate((np.stack((first[keep], last[keep])), *more), axis=1)
        out.append((first + at, last + at, least[first], spans.hashes(first, last + depth)))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(c) for c in zip(*out))


def firsts(order: tuple[np.ndarray, ...], same: tuple[np.ndarray, ...]) -> np.ndarray:
    """Which rows come first, in ``order``, among those that agree in ``same``."""
    ranked = np.lexsort((*order[::-1], *same[::-1]))
    new = np.zeros(len(ranked), bool)
    new[:1] = True
    for s in same:
        s = s[ranked]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(ranked), bool)
    out[ranked] = new
    return out


def _gathered(batches: Iterator[pa.RecordBatch], size_of, limit: int = BLOCK) -> Iterator[list[tuple]]:
    """Rows in lists of bounded size; the last column of a batch is taken as bytes."""
    rows, held = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns[:-1]), batch.column(batch.num_columns - 1)):
            rows.append((*row[:-1], row[-1].as_py()))
            held += size_of(rows[-1])
            if held >= limit:
                yield rows
                rows, held = [], 0
    if rows:
        yield rows


_RUN = "pk long, key long, region long, did long, tie int, pos long"
_RANGE = "did long, tie int, first long, last long"


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64)) if x.dtype != np.int64 else pa.array(x)


def _scan(docs: DataFrame, hot: list[int], depth: int, anchor: int) -> DataFrame:
    """Runs of all texts (did, tie, bytes); pos holds the first window, the number of further ones and the kind."""
    shared = docs.sparkSession.sparkContext.broadcast(np.array(sorted(hot), np.int64).view(np.uint64))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.sort(shared.value)
        for rows in _gathered(batches, lambda r: len(r[2])):
            found = [(i, *runs_of(np.frombuffer(r[2], np.uint8), depth, anchor)) for i, r in enumerate(rows)]
            owner = np.concatenate([np.full(len(f[1]), f[0]) for f in found])
            first, last, key, region = (np.concatenate([f[c] for f in found]) for c in range(1, 5))
            did, tie = np.array([r[0] for r in rows], np.int64)[owner], np.array([r[1] for r in rows], np.int64)[owner]
            kind = np.where(np.isin(key, often), HOT, ANCHORED)
            kind[~firsts((did, tie, first), (key, region))] = REMOVED
            pk = np.where(kind == ANCHORED, key, np.where(kind == HOT, region ^ (key >> np.uint64(1)), did.view(np.uint64) + np.uint64(1)))
            pos = first << 9 | (last - first) << 2 | kind
            yield pa.RecordBatch.from_arrays([_signed(pk), _signed(key), _signed(region), pa.array(did), pa.array(tie, pa.int32()), pa.array(pos)], [c.split()[0] for c in _RUN.split(", ")])

    return docs.select("did", "tie", "data").mapInArrow(of, _RUN)


def equal_windows(buf: np.ndarray, start: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows that are not alone in their group, and their classes of equal bytes: a radix sort by eight bytes at a time, from the first."""
    words = np.lib.stride_tricks.sliding_window_view(np.concatenate((buf, np.zeros(8, np.uint8))), 8)
    active, cls = np.arange(len(start)), group
    digits = [*range(0, depth - 7, 8)] + ([depth - 8] if depth % 8 else []) if depth >= 8 else range(0)
    for d in digits:
        value = np.ascontiguousarray(words[start[active] + d]).view(">u8").ravel().astype(np.uint64)
        order = np.lexsort((value, cls))
        c, v = cls[order], value[order]
        new = np.concatenate(([True], (c[1:] != c[:-1]) | (v[1:] != v[:-1]))) if len(c) else np.zeros(0, bool)
        label = np.cumsum(new) - 1
        several = np.bincount(label, minlength=1)[label] > 1
        active, cls = active[order][several], label[several]
    return active, cls


def _contents(docs: DataFrame, wanted: DataFrame, depth: int) -> DataFrame:
    """``key, did, tie, first, content``: the bytes of the wanted runs, those of hot anchors as single windows under a key of their own; content is null
    for a window that the same block has before."""
    rows = wanted.groupBy("did", "tie").agg(F.collect_list(F.struct("pos", "key")).alias("asked"))
    rows = docs.join(rows.hint("shuffle_hash"), ["did", "tie"]).select("did", "tie", F.transform("asked", lambda a: a["pos"]).alias("pos"), F.transform("asked", lambda a: a["key"]).alias("key"), "data")
    kinds = [("key", pa.int64()), ("did", pa.int64()), ("tie", pa.int32()), ("first", pa.int64()), ("content", pa.binary())]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _gathered(batches, lambda r: len(r[4])):
            out, single = [], []
            for did, tie, poss, keys, data in rows:
                spans = None
                for pos, key in zip(poss, keys):
                    first, n = pos >> 9, (pos >> 2 & 127) + 1
                    if pos & 3 == ANCHORED:
                        out.append((key, did, tie, first, data[first:first + n + depth - 1]))
                    else:
                        spans = spans or Spans(np.frombuffer(data, np.uint8))
                        at = np.arange(first, first + n)
                        single.append((np.full(n, did), np.full(n, tie), at, spans.hashes(at, at + depth), [data[a:a + depth] for a in at.tolist()]))
            if single:
                did, tie, at, h = (np.concatenate([s[c] for s in single]) for c in range(4))
                bytes_of = [b for s in single for b in s[4]]
                lead = firsts((did, tie, at), (h,))
                ties = dict(zip(h[lead].tolist(), (bytes_of[i] for i in np.flatnonzero(lead))))
                for i, (d, t, a, k, is_first) in enumerate(zip(did.tolist(), tie.tolist(), at.tolist(), h.tolist(), lead.tolist())):
                    known = not is_first and ties[k] == bytes_of[i]
                    out.append((d if known else k - (1 << 63), d, t, a, None if known else bytes_of[i]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(list(zip(*out)) or [[]] * 5, kinds)], [n for n, _ in kinds])

    return rows.mapInArrow(of, "key long, did long, tie int, first long, content binary")


def _resolve(contents: DataFrame, depth: int) -> DataFrame:
    """Windows with an equal one before them among those of equal key, as ranges of window starts."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for rows in _gathered(batches, lambda r: 100 + len(r[4] or b""), 1 << 20):
            rows = held + rows
            cut = next((i for i in range(len(rows) - 1, 0, -1) if rows[i][0] != rows[i - 1][0]), 0)
            held = rows[cut:]
            if cut:
                yield _removed(rows[:cut], depth)
        if held:
            yield _removed(held, depth)

    sorted_rows = contents.repartition("key").sortWithinPartitions("key")
    return sorted_rows.select("key", "did", "tie", "first", "content").mapInArrow(of, _RANGE)


def _removed(rows: list[tuple], depth: int) -> pa.RecordBatch:
    parts = [[(d, t, a, a) for _, d, t, a, c in rows if c is None]]
    rows = [r for r in rows if r[4] is not None]
    if rows:
        buf = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
        size = np.array([len(r[4]) for r in rows])
        n = size - depth + 1
        owner = np.repeat(np.arange(len(rows)), n)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        key = np.unique(np.array([r[0] for r in rows], np.int64), return_inverse=True)[1]
        did, tie, first = (np.array([r[c] for r in rows], np.int64) for c in (1, 2, 3))
        active, cls = equal_windows(buf, (np.cumsum(size) - size)[owner] + inner, key[owner], depth)
        o, at = owner[active], first[owner[active]] + inner[active]
        late = ~firsts((did[o], tie[o], at), (cls,))
        o, at = o[late], at[late]
        order = np.lexsort((at, o))
        o, at = o[order], at[order]
        new = np.concatenate(([True], (o[1:] != o[:-1]) | (at[1:] != at[:-1] + 1))) if len(o) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(o)) - 1
        if len(begin):
            parts.append(list(zip(did[o[begin]].tolist(), tie[o[begin]].tolist(), at[begin].tolist(), at[end].tolist())))
    cols = list(zip(*(x for p in parts for x in p))) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["did", "tie", "first", "last"])


def _cut(docs: DataFrame, ranges: DataFrame, depth: int, keep_text: bool) -> DataFrame:
    rows = ranges.groupBy("did", "tie").agg(F.collect_list(F.struct("first", "last")).alias("asked"))
    rows = docs.join(rows.hint("shuffle_hash"), ["did", "tie"]).select("did", "tie", F.transform("asked", lambda a: a["first"]).alias("f"), F.transform("asked", lambda a: a["last"]).alias("l"), "data")
    span = pa.list_(pa.struct([("start", pa.int64()), ("finish", pa.int64())]))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _gathered(batches, lambda r: len(r[4])):
            out = []
            for did, tie, f, l, data in rows:
                order = np.argsort(f)
                start, stop = np.array(f, np.int64)[order], np.maximum.accumulate(np.array(l, np.int64)[order] + depth)
                new = np.concatenate(([True], start[1:] > stop[:-1]))
                start, stop = start[new], stop[np.append(np.flatnonzero(new)[1:] - 1, len(stop) - 1)]
                kept = b"".join(data[a:b] for a, b in zip([0, *stop.tolist()], [*start.tolist(), len(data)]))
                out.append((did, tie, [{"start": a, "finish": b} for a, b in zip(start.tolist(), stop.tolist())], hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
            kinds = (pa.int64(), pa.int32(), span, pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["did", "tie", "spans", "kept_sha256", "kept"])

    return rows.mapInArrow(of, "did long, tie int, spans array<struct<start:long,finish:long>>, kept_sha256 string, kept binary")


def repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", depth: int = DEPTH, anchor: int = ANCHOR, sample: int = SAMPLE, hot_runs: int = HOT_RUNS,
            keep_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, spans, kept_sha256`` and, if asked for, ``kept`` (the bytes that stay, null where all do or none) per row. Spans are the
    maximal removed byte ranges."""
    data = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = docs.select(F.coalesce(F.col(id).cast("long"), F.lit(NULL_ID)).alias("did"), F.col(id).cast("long").alias("doc_id"), data.alias("data"))
    meta = stored(rows.select("did", "doc_id", F.octet_length("data").cast("long").alias("n_bytes"), F.sha2("data", 256).alias("sha")), "meta")
    unique = not meta.groupBy("did").count().filter("count > 1").take(1)
    if unique:
        meta = meta.withColumn("tie", F.lit(0))
        rows = rows.select("did", F.lit(0).alias("tie"), "data")
    else:
        order = Window.partitionBy("did").orderBy("sha")
        ties = stored(meta.select("did", "sha").distinct().withColumn("tie", F.row_number().over(order) - 1), "ties")
        meta = meta.join(ties, ["did", "sha"])
        rows = rows.withColumn("sha", F.sha2("data", 256)).join(ties, ["did", "sha"]).dropDuplicates(["did", "tie"]).select("did", "tie", "data")
    # texts that equal an earlier one: all of theirs stands before, and nothing needs them as a first occurrence
    leads = meta.groupBy("sha").agg(F.min(F.struct("did", "tie")).alias("lead")).select("sha", "lead.*")
    copies = stored(meta.join(leads, ["sha", "did", "tie"], "left_anti").select("did", "tie").distinct(), "copies")
    long = rows.filter(F.octet_length("data") >= depth).join(few_or_not(copies), ["did", "tie"], "left_anti")

    tried = _scan(long.filter(F.pmod(F.xxhash64("did", "tie"), F.lit(sample)) == 0), [], depth, anchor).filter(F.col("pos").bitwiseAND(F.lit(3)) == ANCHORED)
    tried = tried.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= hot_runs).orderBy(F.desc("n"), "key").limit(HOT_KEYS)
    hot = [r["key"] for r in tried.select("key").collect()]

    kind = F.col("pos").bitwiseAND(F.lit(3))
    found = _scan(long, hot, depth, anchor).repartition("pk")
    nth = F.row_number().over(Window.partitionBy("pk", "key", "region").orderBy("did", "tie", "pos"))
    alike = Window.partitionBy("pk")
    found = found.withColumn("nth", nth).withColumn("differ", F.min("region").over(alike) != F.max("region").over(alike))
    gone = (kind == REMOVED) | (F.col("nth") > 1)
    found = stored(found.withColumn("gone", gone).filter(F.col("gone") | (kind == HOT) | F.col("differ")).select("did", "tie", "pos", "key", "gone"), "runs")
    first = F.shiftright("pos", 9)
    ranges = found.filter("gone").select("did", "tie", first.alias("first"), (first + F.shiftright("pos", 2).bitwiseAND(F.lit(127))).alias("last"))
    more = stored(_resolve(_contents(long, found.filter("NOT gone"), depth), depth), "windows")
    cut = stored(_cut(long, ranges.unionByName(more), depth, keep_text), "cut")

    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("finish")))
    none = F.array().cast("array<struct<start:long,finish:long>>")
    gone_whole = F.col("copy") & (F.col("n_bytes") >= depth)
    out = meta.join(copies.withColumn("copy", F.lit(True)), ["did", "tie"], "left").withColumn("copy", F.coalesce("copy", F.lit(False))).join(cut, ["did", "tie"], "left")
    out = out.select("doc_id", "n_bytes", F.when(gone_whole, whole).otherwise(F.coalesce("spans", none)).alias("spans"),
                     F.when(gone_whole, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"), "kept")
    return out if keep_text else out.drop("kept")
