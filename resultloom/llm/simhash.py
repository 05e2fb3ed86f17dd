"""Near duplicates by SimHash, compared exactly in tiles.

A fingerprint is made of the hashes of a text's word shingles. Different fingerprints are put into tiles of equal population
counts: the counts of set bits in each of ``segments`` equal parts of the fingerprint. Two fingerprints that differ in at most
``radius`` bits have counts that differ by no more than ``radius`` in sum, so only tiles with such counts are compared, each
pair of tiles by exclusive-or and bit counts in numpy. A comparison puts out a spanning forest, never all its pairs. Tiles hold a bounded
number of fingerprints; equal fingerprints are one. The share of tile pairs that is skipped grows with ``segments``: about
50 % with 1, 95 % with 4, 99.8 % with 8 for evenly spread bits.

``similar_groups`` asks for more: a link holds only if the two sets of shingles are as similar as asked. There the fingerprints, two of
them, only choose what is compared; see it for what they may miss.

Defined results: null, empty and blank texts have fingerprint 0, linked like any other. A component's id is the smallest document
id in it, null if there is none. Repeated rows each get a row. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import extended, few_or_not, stored
from .components import components
from .text import mixed

SHINGLE, RADIUS, SEED = 3, 3, 42
SEGMENTS, TILE = 4, 4096
SIMILARITY, WIDE_SHINGLE, WIDE_RADII = 0.8, 5, (18, 32)
WIDE_TILE, CROWD_BYTES = 1 << 17, 8 << 20   # members of a tile; bytes of the sets in a tile of a crowd


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64 bits: each is set if it is set in over half of the shingles' hashes."""
    words = text.lower().split()   # bytes: A-Z only, and exactly the blanks \\x20 \\x09-\\x0D
    if not words:
        return 0
    parts = zip(*(words[i:] for i in range(shingle))) if len(words) > shingle else [words]
    hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(p), SEED) for p in parts), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at:at + (1 << 16)].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def with_fingerprint(docs: DataFrame, out: str, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Adds the fingerprint of each text as a signed 64-bit integer."""
    def of(texts: list[bytes]):
        return (np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts)).view(np.int64),)

    return extended(docs, text, lambda: of, [(out, "long", pa.int64())])


def _forest(u: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """As few links as connect what the given ones connect."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    node = np.flatnonzero(label != np.arange(n))
    return node, label[node]


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int, same: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the fingerprints of two tiles that differ in at most ``radius`` bits."""
    found_u, found_v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    found = 0
    n = len(a) + (0 if same else len(b))
    for at in range(0, len(a), 256):
        near = np.bitwise_count(a[at:at + 256, None] ^ b[None, :]) <= radius
        i, j = np.nonzero(near)
        u, v = i + at, j + (0 if same else len(a))
        keep = u < v
        found_u.append(u[keep])
        found_v.append(v[keep])
        found += int(keep.sum())
        if found > 4 * n:
            u, v = _forest(np.concatenate(found_u), np.concatenate(found_v), n)
            found_u, found_v, found = [u], [v], len(u)
    u, v = _forest(np.concatenate(found_u), np.concatenate(found_v), n)
    every = a if same else np.concatenate((a, b))
    return every[u], every[v]


def links(distinct: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS, tile: int = TILE) -> DataFrame:
    """Links ``u, v`` that connect all different fingerprints (column ``fp``) at ``radius`` or fewer differing bits."""
    width = 64 // segments
    base = width + 2 * radius + 2     # a count beyond its range then never looks like another one
    cell = sum((((F.bit_count(F.shiftrightunsigned("fp", i * width).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))) + radius).cast("long") * F.lit(base ** i).cast("long"))
                for i in range(segments)), F.lit(0)).cast("long")
    fps = distinct.select("fp", cell.alias("cell"))
    # at most (width + 1) ** segments rows, whatever the data; only cells of more than one tile are listed
    wide = fps.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).alias("tiles")).filter("tiles > 1")
    fps = fps.join(wide, "cell", "left").withColumn("slot", F.pmod(F.xxhash64("fp"), F.coalesce("tiles", F.lit(1))))
    tiles = stored(fps.groupBy("cell", "slot").agg(F.collect_list("fp").alias("fps")), "tiles")
    steps = [d for d in product(range(-radius, radius + 1), repeat=segments) if sum(map(abs, d)) <= radius]
    steps = [s for s in (sum(x * base ** i for i, x in enumerate(d)) for d in steps) if s >= 0]
    mine = tiles.select(F.col("cell").alias("own"), F.col("slot").alias("own_slot"), F.col("fps").alias("a"),
                        F.explode(F.transform(F.array(*map(F.lit, steps)).cast("array<long>"), lambda s: s + F.col("cell"))).alias("cell"))
    pairs = mine.join(tiles.withColumnRenamed("fps", "b"), "cell").filter((F.col("own") < F.col("cell")) | (F.col("own_slot") <= F.col("slot")))
    pairs = pairs.select("a", "b", ((F.col("own") == F.col("cell")) & (F.col("own_slot") == F.col("slot"))).alias("same"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            sides = []
            for c in (0, 1):
                values, offsets = batch.column(c).flatten().to_numpy(zero_copy_only=False).view(np.uint64), batch.column(c).offsets.to_numpy()
                sides.append((values, offsets - offsets[0]))
            (a, oa), (b, ob) = sides
            for k, same in enumerate(batch.column(2).to_pylist()):
                u, v = close_pairs(a[oa[k]:oa[k + 1]], b[ob[k]:ob[k + 1]], radius, same)
                if len(u):
                    us.append(u)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (us, vs)], ["u", "v"])

    return pairs.mapInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS,
                    segments: int = SEGMENTS, tile: int = TILE) -> DataFrame:
    """``doc_id, fp, component_id, group_fp`` per row; ``group_fp`` is a fingerprint that names the component even if it has no ids."""
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    rows = stored(with_fingerprint(rows, "fp", "text", shingle).select("doc_id", "fp"), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    groups = components(links(distinct, radius, segments, tile))
    named = distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("group_fp", F.coalesce("component", "fp"))
    named = stored(named.select("fp", "first", "group_fp"), "groups")
    ids = named.groupBy("group_fp").agg(F.min("first").alias("component_id"))
    named = named.join(ids, "group_fp").select("fp", "group_fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id", "group_fp")


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The different hashes of the shingles, sorted; a text of fewer words is one shingle."""
    words = text.lower().split()
    parts = zip(*(words[i:] for i in range(shingle))) if len(words) > shingle else [words] if words else []
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(p), SEED) for p in parts), np.uint64))


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at:at + (1 << 16)].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def with_prints(docs: DataFrame, text: str = "text", shingle: int = WIDE_SHINGLE, sets: bool = False) -> DataFrame:
    """Adds the hash ``node`` that names a text's set of shingles, its size ``n`` and its two fingerprints ``fp, fp2``; or ``node`` and the set itself (``hashes``)."""
    def of(texts: list[bytes]):
        found = [shingle_set(t, shingle) for t in texts]
        longs = lambda values: np.fromiter(values, np.uint64, len(found)).view(np.int64)
        nodes = longs(xxhash.xxh3_64_intdigest(x.tobytes()) for x in found)
        if sets:
            return nodes, [x.tobytes() for x in found]
        return nodes, longs(map(_majority, found)), longs(_majority(mixed(x)) for x in found), np.fromiter(map(len, found), np.int64, len(found))

    return extended(docs, text, lambda: of, [("node", "long", pa.int64()), *([("hashes", "binary", pa.binary())] if sets else [(c, "long", pa.int64()) for c in ("fp", "fp2", "n")])])


def with_node(docs: DataFrame, out: str, text: str = "text", shingle: int = WIDE_SHINGLE) -> DataFrame:
    """Adds the name of the set of shingles alone."""
    def of(texts: list[bytes]):
        return (np.fromiter((xxhash.xxh3_64_intdigest(shingle_set(t, shingle).tobytes()) for t in texts), np.uint64, len(texts)).view(np.int64),)

    return extended(docs, text, lambda: of, [(out, "long", pa.int64())])


def _chains(u: np.ndarray, v: np.ndarray, orders: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """What the given links connect, connected by a chain in each of the orders: no member has more than two links in a chain."""
    n = len(orders[0])
    node, top = _forest(u, v, n)
    label = np.arange(n)
    label[node] = top
    us, vs = [], []
    for order in orders:
        chain = np.lexsort((order, label))
        chain = chain[np.isin(label[chain], top)]
        joined = label[chain[1:]] == label[chain[:-1]]
        us.append(chain[:-1][joined])
        vs.append(chain[1:][joined])
    return np.concatenate(us), np.concatenate(vs)


def _within(a: np.ndarray, b: np.ndarray, same: bool, radii: tuple[int, int], similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of two tiles, block by block, whose sizes allow the similarity and whose fingerprints differ in at most ``radii[0]`` bits, both
    fingerprints together in at most ``radii[1]``. Tiles are rows node, fp, fp2, n in the order of n. Blocks come row of ``a`` by row."""
    unsigned = lambda x: np.ascontiguousarray(x).view(np.uint64)
    fa, ga, fb, gb = unsigned(a[1]), unsigned(a[2]), unsigned(b[1]), unsigned(b[2])
    for at in range(0, a.shape[1], 64):
        some = slice(at, at + 64)
        low = at if same else int(np.searchsorted(b[3], similarity * a[3, at] - 1e-6))
        high = int(np.searchsorted(b[3], a[3, some][-1] / similarity + 1e-6, "right"))
        for begin in range(low, high, 8192):
            part = slice(begin, min(begin + 8192, high))
            i, j = np.nonzero(np.bitwise_count(fa[some, None] ^ fb[None, part]) <= radii[0])
            i, j = i + at, j + begin
            small, large = np.minimum(a[3, i], b[3, j]), np.maximum(a[3, i], b[3, j])
            near = np.bitwise_count(fa[i] ^ fb[j]).astype(np.int64) + np.bitwise_count(ga[i] ^ gb[j]) <= radii[1]
            keep = near & (small >= similarity * large - 1e-6) & ((i < j) if same else True)
            if keep.any():
                yield i[keep], j[keep]


def candidates(a: np.ndarray, b: np.ndarray, same: bool, radii: tuple[int, int], similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs of two tiles as two arrays of nodes. If there are many of them, a *crowd*: only chains of what they connect, and all nodes that are in a pair."""
    a, b = (x[:, np.argsort(x[3], kind="stable")] for x in (a, b))
    both = a if same else np.concatenate((a, b), axis=1)
    n, shift, found, chained = both.shape[1], 0 if same else a.shape[1], 0, False
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    paired = np.zeros(n, bool)
    for i, j in _within(a, b, same, radii, similarity):
        us.append(i)
        vs.append(j + shift)
        paired[i] = paired[j + shift] = True
        found += len(i)
        if found > 8 * n + 1000:
            u, v = _forest(np.concatenate(us), np.concatenate(vs), n)
            us, vs, found, chained = [u], [v], len(u), True
    u, v = np.concatenate(us), np.concatenate(vs)
    if chained:
        u, v = _chains(u, v, [both[1], both[2], both[0]])
    return both[0, u], both[0, v], both[0, paired] if chained else both[0, :0]


_PAIR = ["own", "own_slot", "cell", "slot"]


def _tiled(nodes: DataFrame, fields: list[str], per_tile, name: str) -> tuple[DataFrame, DataFrame]:
    """Tiles of the nodes of each cell, and which tiles are compared: those of one cell and of two neighbouring ones. ``per_tile`` is the number of tiles of a cell."""
    wide = stored(nodes.groupBy("cell").agg(F.ceil(per_tile).cast("long").alias("tiles")), name)   # one row per cell: the logarithm of a size
    slots = nodes.join(F.broadcast(wide), "cell").withColumn("slot", F.pmod(F.xxhash64("node"), F.greatest("tiles", F.lit(1))))
    tiles = stored(slots.groupBy("cell", "slot").agg(F.collect_list(F.struct(*fields)).alias("members")), name)
    ids = tiles.select(F.col("cell").alias("own"), F.col("slot").alias("own_slot"), F.explode(F.array(F.col("cell"), F.col("cell") + 1)).alias("cell"))
    pairs = ids.join(tiles.select("cell", "slot"), "cell").filter((F.col("own") < F.col("cell")) | (F.col("own_slot") <= F.col("slot")))
    return tiles, stored(pairs.select(*_PAIR), name)


def _compared(tiles: DataFrame, pairs: DataFrame, compare, out: list[str]) -> DataFrame:
    """``compare(a, b, same)`` on each pair of tiles; columns of its arrays are ``out``. Tiles travel to the tasks of their pairs."""
    spread = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = tiles.select(F.col("cell").alias("own"), F.col("slot").alias("own_slot"), F.col("members").alias("a"))
    rows = pairs.repartition(spread, *_PAIR).join(a, ["own", "own_slot"]).join(tiles.withColumnRenamed("members", "b"), ["cell", "slot"]).select(*_PAIR, "a", "b")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (own, own_slot, cell, slot) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)))):
                found = compare(batch.column(4)[k].values, batch.column(5)[k].values, (own, own_slot) == (cell, slot))
                for at in range(0, len(found[0]), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(x[at:at + (1 << 16)]) for x in found], out)

    return rows.mapInArrow(of, ", ".join(f"{c} long" for c in out))


def _numbers(members: pa.StructArray) -> np.ndarray:
    return np.stack([members.field(c).to_numpy(zero_copy_only=False) for c in range(4)])


def _connected(a: pa.StructArray, b: pa.StructArray, same: bool, radii: tuple[int, int], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of two tiles (node, fp, fp2, n, label, hashes) that connect all candidate pairs of different labels whose sets are similar enough.

    Every such pair is checked by its sets unless links found before connect it.
    """
    sides = []
    for x in (a, b):
        x = x.take(pa.array(np.argsort(x.field(3).to_numpy(zero_copy_only=False), kind="stable")))
        sets = [np.frombuffer(v.as_py(), np.uint64) for v in x.field(5)]
        sides.append((_numbers(x), x.field(4).to_numpy(zero_copy_only=False), sets))
    (a, label_a, sets_a), (b, label_b, sets_b) = sides
    _, root = np.unique(label_a if same else np.concatenate((label_a, label_b)), return_inverse=True)
    flat, begin = np.concatenate([*sets_b, np.zeros(1, np.uint64)]), np.concatenate(([0], np.cumsum([len(x) for x in sets_b]))).astype(np.int64)
    shift = 0 if same else len(sets_a)
    us, vs = [], []
    for rows, columns in _within(a, b, same, radii, similarity):
        for i in np.unique(rows):
            js = columns[rows == i]
            js = js[np.argsort(np.bitwise_count(a[1, i:i + 1].view(np.uint64) ^ b[1, js].view(np.uint64)), kind="stable")]
            mine, size = sets_a[i], 1
            while len(js := js[root[js + shift] != root[i]]):
                # the nearest first, then more at a time: whatever a link connects needs no check any more
                part, js, size = js[:size], js[size:], min(8 * size, 1024)
                n = begin[part + 1] - begin[part]
                ends = np.cumsum(n)
                values = flat[np.arange(ends[-1]) - np.repeat(ends - n - begin[part], n)]
                at = np.minimum(np.searchsorted(mine, values), max(len(mine) - 1, 0))
                hits = np.concatenate(([0], np.cumsum(mine[at] == values if len(mine) else np.zeros(len(values), bool))))
                shared = hits[ends] - hits[ends - n]
                for j in part[shared >= similarity * (len(mine) + n - shared) - 1e-9]:
                    if root[j + shift] != root[i]:
                        us.append(a[0, i])
                        vs.append(b[0, j])
                        root[root == root[j + shift]] = root[i]
    return np.array(us, np.int64), np.array(vs, np.int64)


def _sets_of(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """``node, hashes`` of the wanted nodes (``node, first``), made anew from the texts of the documents that stand for them."""
    some = docs.join(few_or_not(stored(nodes.filter("first IS NOT NULL").select(F.col("first").alias("doc_id")).distinct(), "wanted")), "doc_id", "left_semi")
    if nodes.filter("first IS NULL").take(1):
        some = some.unionByName(docs.filter("doc_id IS NULL"))
    wanted = few_or_not(nodes.select("node"))
    return stored(with_prints(some, "text", shingle, sets=True).select("node", "hashes").join(wanted, "node", "left_semi").dropDuplicates(["node"]), "sets")


def _verified(links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The links whose sets of shingles are similar enough."""
    both = links.join(sets.select(F.col("node").alias("u"), F.col("hashes").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("hashes").alias("b")), "v")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for a, b in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                shared = len(a) + len(b) - len(np.unique(np.concatenate((a, b))))
                ok.append(shared >= similarity * (len(a) + len(b) - shared) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return both.select("u", "v", "a", "b").mapInArrow(of, "u long, v long")


def similar_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = WIDE_SHINGLE, similarity: float = SIMILARITY,
                   radii: tuple[int, int] = WIDE_RADII, tile: int = WIDE_TILE, crowd_bytes: int = CROWD_BYTES) -> DataFrame:
    """``doc_id, node, component_id, group_node`` per row: groups connected by texts whose sets of shingles have at least this Jaccard similarity.

    Tiles hold sets of like size: sizes that differ by more than ``similarity`` are never compared. Pairs whose two fingerprints are within
    ``radii`` are checked by their sets. Where a pair of tiles has more candidates than members (a crowd of near copies), chains of what they
    connect are checked first; then the members of crowds are put into tiles with their sets, and pairs that are not connected yet are checked where the tiles meet, so no
    pair leaves a task but the links. Sets are made anew for members of candidates and held for them alone. Only pairs beyond ``radii`` are missed: at a
    similarity of exactly 0.8 the bits of a fingerprint differ independently with a probability of about 0.15, so about 3 of 1000 such pairs, fewer of more similar ones.
    """
    source = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    rows = stored(with_prints(source, "text", shingle).select("doc_id", "node", "fp", "fp2", "n"), "prints")
    distinct = rows.groupBy("node").agg(F.min("doc_id").alias("first"), *[F.min(c).alias(c) for c in ("fp", "fp2", "n")])
    # a little wider than the similarity asks, so that rounded logarithms never put allowed sizes two cells apart
    distinct = stored(distinct.withColumn("cell", F.floor(F.log(F.greatest("n", F.lit(1)).cast("double")) / F.lit(1e-6 - log(similarity))).cast("long")), "distinct")

    def first_look(a, b, same):
        u, v, crowd = candidates(_numbers(a), _numbers(b), same, radii, similarity)
        return np.concatenate((u, crowd)), np.concatenate((v, crowd))

    tiles, pairs = _tiled(distinct, ["node", "fp", "fp2", "n"], F.count(F.lit(1)) / tile, "tiles")
    found = stored(_compared(tiles, pairs, first_look, ["u", "v"]), "links")
    links = stored(found.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "candidates")
    crowd = stored(found.filter("u = v").select(F.col("u").alias("node")).distinct(), "crowd")
    nodes = links.select(F.col("u").alias("node")).unionByName(links.select(F.col("v").alias("node"))).unionByName(crowd).distinct()
    nodes = stored(distinct.select("node", "first").join(few_or_not(stored(nodes, "nodes")), "node", "left_semi"), "nodes")
    sets = _sets_of(source, nodes, shingle)
    good = stored(_verified(links, sets, similarity), "good")
    groups = components(good)
    if crowd.take(1):
        members = distinct.join(crowd, "node", "left_semi").join(groups, "node", "left").withColumn("label", F.coalesce("component", "node")).join(sets, "node")
        members = stored(members.select("node", "fp", "fp2", "n", "cell", "label", "hashes"), "crowd")
        tiles, pairs = _tiled(members, ["node", "fp", "fp2", "n", "label", "hashes"], F.sum("n") * 8 / crowd_bytes, "crowd")
        rest = stored(_compared(tiles, pairs, lambda a, b, same: _connected(a, b, same, radii, similarity), ["u", "v"]), "good")
        groups = components(good.unionByName(rest))
    named = distinct.join(groups, "node", "left").select("node", "first", F.coalesce("component", "node").alias("group_node"))
    named = stored(named, "groups")
    least = named.groupBy("group_node").agg(F.min("first").alias("component_id"))
    return rows.select("doc_id", "node").join(named.join(least, "group_node").select("node", "group_node", "component_id"), "node").select("doc_id", "node", "component_id", "group_node")


def hex_of(fp):
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
