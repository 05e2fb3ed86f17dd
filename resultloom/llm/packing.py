"""Token ids packed into rows of equal length, by best-fit-decreasing.

Documents are cut into parts of at most ``length`` ids, losslessly: each part knows its document and where it begins there. Parts are
packed group by group: a task packs whenever it has gathered ``group_ids`` ids, so its memory is bounded and nothing is shuffled. In a
group, parts go from the longest to the shortest into the row with the least room that still holds them. Rows are found by a segment tree
over capacities: a leaf tells whether some row has just that room, so the least sufficient one is found in logarithmic time.

A packed row is a row of an id matrix (``length`` ids, little-endian, filled up with ``pad``), the cumulative lengths of its segments from 0 on, and a
row of positions that restart at each segment. ``write_matrices`` stores groups as plain binary files and ``read_matrices`` reads them back.

Defined results: null and empty texts have no ids and no segment. Null ids of documents stay null. Repeated rows are packed each. Ties in
length go by arrival. Other columns are ignored. Padding positions are 0, and belong to no segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .bpe import Coder, read_ranks
from .common import blocks, stored

LENGTH, GROUP_IDS, PAD = 2048, 1 << 22, 50256
READ_ROWS = 1024     # packed rows that a task holds while it reads them back
ROW = "grp string, row int, length int, ids binary, positions binary, cu_seqlens array<int>, doc_ids array<long>, doc_starts array<long>"

INDEX = ("grp", "row", "length", "cu_seqlens", "doc_ids", "doc_starts")   # columns of a packed row beside its matrices


class PieceCoder(Coder):
    """The same ids, with the merges inside a rare piece left to the tiktoken library: what is packed matters here, not how it is merged.

    The library's pattern takes a piece as a whole, so that texts are split in one place only, and long runs of blanks need no backtracking.
    """

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__(ranks)
        self.library = tiktoken.Encoding("pieces", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={})

    def tree(self, data: bytes) -> list[int]:
        return self.library.encode_ordinary(data.decode())


class Rooms:
    """Open rows by their room: which is the least room of at least n, in a segment tree over 0..length."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.some = bytearray(2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def _set(self, room: int, value: int) -> None:
        at = room + self.leaves
        while at and self.some[at] != value:
            self.some[at] = value
            at //= 2
            if at:
                value = self.some[2 * at] | self.some[2 * at + 1]

    def add(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        self._set(room, 1)

    def take(self, n: int) -> tuple[int, int] | None:
        """The row of least room that holds n, and that room; it is no longer listed."""
        at = n + self.leaves
        if not self.some[at]:
            while at > 1 and (at & 1 or not self.some[at + 1]):
                at //= 2
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.some[2 * at] else 2 * at + 1
        room = at - self.leaves
        row = self.rows[room].pop()
        if not self.rows[room]:
            self._set(room, 0)
        return row, room


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Parts of each row, by best-fit-decreasing; sizes are 1..length."""
    rooms, rows = Rooms(length), []
    for part in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        n = sizes[part]
        found = rooms.take(n)
        if found is None:
            row, room = len(rows), length
            rows.append([])
        else:
            row, room = found
        rows[row].append(part)
        if room > n:
            rooms.add(row, room - n)
    return rows


def _lines(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values; nothing is copied."""
    ends = pa.array(np.arange(len(matrix) + 1) * (matrix.shape[1] * matrix.itemsize)).cast(pa.int32())   # fails beyond 2 GB
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, ends.buffers()[1], pa.py_buffer(matrix)])


def _packed(group: str, parts: list[tuple[int | None, int, np.ndarray]], length: int, pad: int, kind: str) -> pa.RecordBatch:
    rows = best_fit([len(ids) for _, _, ids in parts], length)
    ids, positions = np.full((len(rows), length), pad, kind), np.zeros((len(rows), length), kind)
    steps = np.arange(length).astype(kind)
    ends, docs, starts = [], [], []
    for r, members in enumerate(rows):
        cu = [0]
        for m in members:
            at, n = cu[-1], len(parts[m][2])
            ids[r, at:at + n] = parts[m][2]
            positions[r, at:at + n] = steps[:n]
            cu.append(at + n)
        ends.append(cu)
        docs.append([parts[m][0] for m in members])
        starts.append([parts[m][1] for m in members])
    return pa.RecordBatch.from_arrays(
        [pa.array([group] * len(rows)), pa.array(range(len(rows)), pa.int32()), pa.array([length] * len(rows), pa.int32()), _lines(ids), _lines(positions),
         pa.array(ends, pa.list_(pa.int32())), pa.array(docs, pa.list_(pa.int64())), pa.array(starts, pa.list_(pa.int64()))],
        [x.split()[0] for x in ROW.split(", ")])


def packed(docs: DataFrame, ranks_path: str, id: str = "doc_id", text: str = "text", length: int = LENGTH, group_ids: int = GROUP_IDS, pad: int = PAD) -> DataFrame:
    """One row per packed row: its group and number, ids and positions (2 bytes each if ids and length fit, else 4), ``cu_seqlens``, and
    for each segment its document and the token of the document it begins with."""
    ranks = read_ranks(ranks_path)
    kind = "<u2" if max(len(ranks), pad, length) < 1 << 16 else "<i4"
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task, done, parts, held = PieceCoder(shared.value), TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            names = iter(batch.column(0).to_pylist())
            for block in blocks(batch.column(1)):
                ids, bound = coder.encode(block)
                ids = ids.astype(kind)
                for a, b in zip(bound.tolist(), bound[1:].tolist()):
                    name = next(names)
                    for at in range(a, b, length):
                        parts.append((name, at - a, ids[at:min(at + length, b)]))
                        held += len(parts[-1][2])
                        if held >= group_ids:
                            yield _packed(f"{task:06d}-{done:06d}", parts, length, pad, kind)
                            done, parts, held = done + 1, [], 0
        if parts:
            yield _packed(f"{task:06d}-{done:06d}", parts, length, pad, kind)

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(pack, ROW)


def write_matrices(rows: DataFrame, folder: str) -> DataFrame:
    """Stores packed rows as ``.ids``, ``.positions`` (matrices, row after row) and ``.cu`` (per row the number of its cumulative
    lengths, then those; 4 bytes each) files of each task. Returns a written row for each row of the files of successful tasks: ``path``, ``at`` (its
    number in the file), ``width`` (bytes of an id), ``grp, row, length, cu_seqlens, doc_ids, doc_starts``."""
    names = [x.split()[0] for x in ROW.split(", ")]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = fs.FileSystem.from_uri(folder)
        system.create_dir(top, recursive=True)
        task, out, n = TaskContext.get(), {}, 0
        path = f"{top}/{task.partitionId():06d}-{task.taskAttemptId()}"
        prefix = folder[:len(folder) - len(top)] if folder.endswith(top) else ""
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or {e: system.open_output_stream(f"{path}.{e}", compression=None) for e in ("ids", "positions", "cu")}
            for length, ids, positions, cu in zip(*(batch.column(c) for c in ("length", "ids", "positions", "cu_seqlens"))):
                out["ids"].write(ids.as_buffer())
                out["positions"].write(positions.as_buffer())
                cu = cu.as_py()
                out["cu"].write(np.array([len(cu), *cu], "<i4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([prefix + path] * batch.num_rows), pa.array(range(n, n + batch.num_rows), pa.int64()),
                                              pa.array([len(ids.as_buffer()) // length.as_py()] * batch.num_rows, pa.int32()), *(batch.column(c) for c in INDEX)], ["path", "at", "width", *INDEX])
            n += batch.num_rows
        for f in out.values():
            f.close()      # a task whose files are not whole fails here, and none of its rows are kept

    kinds = [x for x in ROW.split(", ") if x.split()[0] in INDEX]
    return stored(rows.select(*names).mapInArrow(put, ", ".join(["path string", "at long", "width int", *kinds])), "matrices")


def read_matrices(index: DataFrame) -> DataFrame:
    """The packed rows again, read from the files that ``write_matrices`` names; any part of the index may be read by any task."""
    names = [x.split()[0] for x in ROW.split(", ")]

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, files = None, {}
        for batch in (b.slice(at, READ_ROWS) for b in batches for at in range(0, b.num_rows, READ_ROWS)):
            found: dict[str, list[bytes]] = {"ids": [], "positions": []}
            for path, at, size in zip(batch.column("path").to_pylist(), batch.column("at").to_pylist(), pc.multiply(batch.column("length"), batch.column("width")).to_pylist()):
                if path != now:
                    for f in files.values():
                        f.close()
                    system, top = fs.FileSystem.from_uri(path)
                    files = {e: system.open_input_file(f"{top}.{e}") for e in found}
                    now = path
                for e, f in files.items():
                    f.seek(at * size)
                    found[e].append(f.read(size))
            columns = {**{c: batch.column(c) for c in INDEX}, **{e: pa.array(v, pa.binary()) for e, v in found.items()}}
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)
        for f in files.values():
            f.close()

    return index.mapInArrow(get, ROW)
