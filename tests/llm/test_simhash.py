import random
import re

import numpy as np
import xxhash
from helpers import empty_docs, odd_docs

from resultloom.llm import queries, simhash
from resultloom.llm.common import table
from resultloom.llm.components import components


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows, radius=3):
    """rows: (id, fingerprint); the smallest id that each fingerprint reaches."""
    prints = sorted({f for _, f in rows})
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    smallest = {}
    for d, f in rows:
        k = find(prints.index(f))
        if d is not None:
            smallest[k] = min(d, smallest.get(k, d))
    return {f: smallest.get(find(i)) for i, f in enumerate(prints)}


def test_query(spark, folder):
    rows = [(r["doc_id"], plain_print(r["text"])) for r in table(spark, folder, "documents").collect()]
    group = plain_groups(rows)
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in queries.QUERIES["op5_tiled_simhash"](spark, folder).collect()}
    assert got == {(d, f"{f:016x}", group[f]) for d, f in rows}


def test_tiles_find_what_all_pairs_find(spark):
    rng = random.Random(2)
    seeds = [rng.getrandbits(64) for _ in range(60)] + [0, (1 << 64) - 1]
    prints = {s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for s in seeds for _ in range(12)}
    chain = 0xF0F0
    for b in range(0, 60, 3):
        chain ^= 7 << b
        prints.add(chain)
    rows = [(i, f) for i, f in enumerate(sorted(prints))]
    want = plain_groups(rows)
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for _, f in rows], "fp long")
    for segments, tile in ((1, 16), (2, 1000), (4, 4), (8, 4096)):
        found = {r["node"]: r["component"] for r in components(simhash.links(df, 3, segments, tile)).collect()}
        mates = {}
        for i, f in rows:
            signed = int(np.uint64(f).astype(np.int64))
            mates.setdefault(found.get(signed, signed), set()).add(want[f])
        assert all(len(m) == 1 for m in mates.values()) and len(mates) == len(set(want.values()))


def test_forest_stays_small():
    base = np.arange(2000, dtype=np.uint64) % 8      # all within three bits of each other
    u, v = simhash.close_pairs(np.unique(base), np.unique(base) ^ np.uint64(1 << 60), 4)
    assert len(u) < 16
    crowd = np.unique(np.random.default_rng(1).integers(0, 1 << 11, 2000, dtype=np.uint64))
    u, v = simhash.close_pairs(crowd, crowd, 3, same=True)
    assert len(u) < len(crowd)


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1300)] + [(rng.randint(2000, 2300), rng.randint(2000, 2300)) for _ in range(200)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = [(r["doc_id"], plain_print(r["text"])) for r in docs.collect()]
    group = plain_groups(rows)
    got = sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted(((d, f, group[f]) for d, f in rows), key=str)
    assert simhash.near_duplicates(empty_docs(spark)).count() == 0


def near_copies(rng, crowd):
    """Texts of 60 to 250 words with copies that differ in some words, and one crowd of copies of a single text."""
    words = [f"w{i}" for i in range(5000)]
    texts = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(60, 250))]
        for _ in range(4):
            w = list(base)
            for at in rng.sample(range(len(w)), rng.randint(0, 1 + len(w) // 40)):
                w[at] = rng.choice(words)
            texts.append(" ".join(w))
    base = [rng.choice(words) for _ in range(200)]
    texts += [" ".join([*base[:at], "Other", *base[at + 1:]]) for at in range(crowd // 2)] + [" ".join([*base, *("tail",) * (k % 7), str(k)]) for k in range(crowd // 2)]
    return texts


def similar(texts, least=0.8):
    """The smallest number that each text reaches over pairs of this similarity, tried one by one."""
    sets = [frozenset(" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))) for w in (t.lower().split() for t in texts)]
    root, pairs = list(range(len(texts))), 0

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both >= least * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
                pairs += a != sets[j]
    return [find(i) for i in range(len(texts))], pairs


def test_similar_groups_are_those_of_all_pairs(spark):
    texts = near_copies(random.Random(9), 300)
    want, pairs = similar(texts)
    assert pairs > 8 * len(texts) + 1000 and len(set(want)) > 50       # the crowd is first joined by chains
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for tile, crowd_bytes in ((40, 30_000), (1 << 14, 8 << 20)):
        got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(df, tile=tile, crowd_bytes=crowd_bytes).collect()}
        assert [got[i] for i in range(len(texts))] == want
    assert simhash.similar_groups(df.limit(0)).count() == 0


def test_a_crowd_that_hardly_links(spark):
    """Copies of one text that are near by their fingerprints and mostly less similar than asked: each pair is checked, only real links count."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for k in range(240):
        w = list(base)
        for at in rng.sample(range(150), rng.choice((1, 3, 4, 5))):
            w[at] = f"x{rng.randrange(10 ** 6)}"
        texts.append(" ".join(w))
    want, pairs = similar(texts)
    assert 0 < pairs < 240 * 239 // 4 and 1 < len(set(want)) < 240
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(df, crowd_bytes=40_000).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_crowds_are_chained_and_all_their_members_named():
    fp = np.arange(200, dtype=np.int64) % 8
    tile = np.stack((np.arange(200), fp, fp, np.full(200, 100)))
    u, v, crowd = simhash.candidates(tile, tile, True, (18, 32), 0.8)
    assert len(u) == 3 * 199 and sorted(crowd) == list(range(200))
    u, v, crowd = simhash.candidates(tile[:, :40], tile[:, :40], True, (18, 32), 0.8)
    assert len(u) == 40 * 39 // 2 and not len(crowd)
