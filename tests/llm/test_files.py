"""Packed matrices and WARC archives: exact round trips."""

import io
import random

import numpy as np
import public_tokenizers
from helpers import empty_docs, odd_docs

from resultloom.llm import bpe, packing, queries, warc
from resultloom.llm.common import shared_path

PATH = public_tokenizers.path(queries.RANKS)


def test_best_fit_decreasing_equals_plain_search():
    rng = random.Random(1)
    for length in (1, 7, 64, 100):
        sizes = [rng.randint(1, length) for _ in range(300)]
        room, rows = [], []
        for part in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            fits = [r for r in room if r >= sizes[part]]
            if fits:
                room[room.index(min(fits))] -= sizes[part]
            else:
                room.append(length - sizes[part])
        rows = packing.best_fit(sizes, length)
        assert sorted(p for r in rows for p in r) == list(range(len(sizes)))
        assert all(sum(sizes[p] for p in r) <= length for r in rows) and sorted(length - sum(sizes[p] for p in r) for r in rows) == sorted(room)


def test_packing_is_lossless(spark):
    docs = odd_docs(spark)
    rows = packing.packed(docs, PATH, length=64, group_ids=500).collect()
    coder = bpe.Coder(bpe.read_ranks(PATH))
    parts = {}
    for r in rows:
        ids, positions, cu = np.frombuffer(r["ids"], "<u2"), np.frombuffer(r["positions"], "<u2"), r["cu_seqlens"]
        assert len(ids) == len(positions) == 64 and cu[0] == 0 and (ids[cu[-1]:] == packing.PAD).all() and not positions[cu[-1]:].any()
        for a, b, doc, at in zip(cu, cu[1:], r["doc_ids"], r["doc_starts"]):
            assert positions[a:b].tolist() == list(range(b - a))
            parts.setdefault(doc, []).append((at, ids[a:b].tolist()))
    want = {}
    for r in docs.collect():
        ids, _ = coder.encode([(r["text"] or "").encode()])
        want.setdefault(r["doc_id"], []).extend((at, ids[at:at + 64].tolist()) for at in range(0, len(ids), 64))
    assert {k: sorted(v) for k, v in parts.items()} == {k: sorted(v) for k, v in want.items() if v}
    assert packing.packed(empty_docs(spark), PATH).count() == 0


def test_matrices_are_written_and_read(spark):
    rows = packing.packed(odd_docs(spark), PATH, length=64, group_ids=500)
    index = packing.write_matrices(rows, shared_path(spark, "matrices"))
    files = sorted({r["path"] for r in index.collect()})
    ids = np.concatenate([np.fromfile(f + ".ids", "<u2").reshape(-1, 64) for f in files])
    assert sorted(r.tobytes() for r in ids) == sorted(bytes(r["ids"]) for r in rows.collect())
    assert index.count() == len(ids)
    as_text = lambda df: sorted(map(str, df.collect()))
    assert as_text(packing.read_matrices(index)) == as_text(rows)
    assert as_text(packing.read_matrices(index.repartition(5))) == as_text(rows)     # any task reads any row
    flat = np.concatenate([np.fromfile(f + ".cu", "<i4") for f in files]).tolist()
    lengths = []
    while flat:
        n, flat = flat[0], flat[1:]
        lengths.append(flat[:n])
        flat = flat[n:]
    assert sorted(lengths) == sorted(r["cu_seqlens"] for r in rows.collect())
    none = packing.write_matrices(packing.packed(empty_docs(spark), PATH), shared_path(spark, "matrices"))
    assert none.count() == 0 and packing.read_matrices(none).count() == 0


def test_query_reads_what_it_wrote(spark, folder):
    got = queries.QUERIES["op7_bfd_packing"](spark, folder)
    want = packing.packed(queries.table(spark, folder, "documents"), PATH)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def odd_pages(spark):
    big = "<p>é</p>" * 400
    rows = [(1, "http://a/ü b\r\nX: y", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u", "small"), (6, "u", "small"), (None, "u", big), (7, "u", "z" * 999), (8, "u", "z" * 999),
            (9, "u", "y" * 1000), (9, "u", "y" * 1000), (None, "u", "only nameless " * 100), (None, "u", "only nameless " * 100)]
    return spark.createDataFrame([r + ("x", "x") for r in rows], "page_id long, url string, html string, digest string, key string")


def test_archive_round_trip(spark):
    for ranges in (64, 1 << 24):
        got = warc.archived(odd_pages(spark), file_bytes=300, range_bytes=ranges).collect()
        seen = sorted((str(r["page_id"]), r["payload_bytes"], r["record_type"], str(r["refers_to"]), r["payload"] is None) for r in got)
        n = len("<p>é</p>".encode()) * 400
        assert seen == sorted([("1", n, "revisit", "2", True), ("2", n, "response", "None", False), ("None", n, "revisit", "2", True), ("3", 0, "response", "None", False), ("4", 0, "response", "None", False),
                               ("5", 5, "response", "None", False), ("6", 5, "response", "None", False), ("7", 999, "response", "None", False), ("8", 999, "response", "None", False),
                               *[("9", 1000, "response", "None", False)] * 2, *[("None", 1400, "response", "None", False)] * 2])
    assert warc.archived(odd_pages(spark).limit(0)).count() == 0


def test_every_split_owns_its_records():
    rng = random.Random(2)
    payloads = [rng.randbytes(rng.randint(0, 3000)) for _ in range(20)] + [b"\x1f\x8b\x08" * 500]
    payloads.append(warc.member(1, "u", b"inner", "00" * 20, None, level=0))     # an archive inside a record
    members = [warc.member(i, "u", p, "00" * 20, None) for i, p in enumerate(payloads)]
    data = b"".join(members)
    starts = np.cumsum([0] + [len(m) for m in members[:-1]]).tolist()
    for width in (50, 333, 4096, len(data)):
        found = [o for a in range(0, len(data), width) for o, _ in warc.starting_in(io.BytesIO(data), a, min(a + width, len(data)), len(data))]
        assert found == starts


def test_rows_of_a_matrix_are_not_copied():
    matrix = np.arange(12, dtype="<u2").reshape(3, 4)
    rows = packing._lines(matrix)
    assert rows.to_pylist() == [r.tobytes() for r in matrix]
    assert rows.buffers()[2].address == matrix.ctypes.data
