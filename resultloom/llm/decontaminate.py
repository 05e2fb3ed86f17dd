"""Benchmark decontamination by spaced-seed hashing.

Texts become words (runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased). A spaced seed is a fixed mask over a
window of words: the words at its marked places are hashed, the others are ignored, so a changed word spoils only those windows that
have it at a marked place. Windows of documents whose hash is also one of a benchmark item are hits. Around each hit the words of document and
item are compared place by place along the hit's diagonal; the longest stretch whose score (+1 for an equal word, -``penalty`` for a
changed one) is not below zero is an overlap if it has ``min_words`` words or all words of a shorter item. A penalty of 4 asks for 80 % equal
words. A stretch begins and ends with an equal word unless it is the whole item (or all of it that the document has room for).

Documents are read once, without a shuffle. Benchmark hashes travel by broadcast in slices of at most ``slice_words`` words; long
items are cut into overlapping segments first, so the bound holds for any benchmark. More slices mean more scans, never a larger broadcast.

Defined results: null and empty texts and items without words match nothing; items shorter than the masks must occur as a whole. Equal items count as one, named by their smallest id
(null if none has one).
A document row that is repeated gives the same rows once. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import blocks, stored
from .text import NO_WORD, mixed, words_of

# fixed values: places that count (1) or are ignored (0), weight 7 of 11 or 12
MASKS = ("110100110101", "111010010111", "11111101000")
MIN_WORDS, PENALTY = 13, 4
SLICE_WORDS, SEGMENT_WORDS, OVERLAP_WORDS = 1 << 20, 1024, 128
MANY = 1 << 12   # pairs of places that one seed may make before only its diagonals are kept
_PLACES = [np.flatnonzero(np.frombuffer(m.encode(), np.uint8) == ord("1")) for m in MASKS]
_WIDE = max(map(len, MASKS))
_SIEVE = 1 << 22
_FACTORS = np.random.default_rng(7).integers(1, 1 << 62, _WIDE, dtype=np.uint64) | np.uint64(1)
#: words between two texts of a block, equal to no other word
_GAP = mixed(np.arange(_WIDE, dtype=np.uint64) + np.uint64(1 << 40))


def seeds(words: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    """One hash for each window of ``width`` words, of the words at ``places`` in it."""
    n = len(words) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for p in places if n > 0 else ():
        out += words[p:p + n] * _FACTORS[p]
    return mixed(out)


class Slice:
    """Benchmark words of a slice with all their seeds, sorted: (item, words of the whole item, first word, words) per segment."""

    def __init__(self, segments: list[tuple[int | None, int, int, bytes]]):
        self.item = [i for i, *_ in segments]
        self.whole = [n for _, n, *_ in segments]
        self.first = [at for _, _, at, _ in segments]
        self.words = [np.frombuffer(w, np.uint64) for *_, w in segments]
        size = np.array([len(w) for w in self.words], np.int64)
        long = np.flatnonzero(size >= _WIDE)
        self.tables = [self._table(places, _WIDE, long) for places in _PLACES]
        # what is shorter than the masks is looked for as a whole
        self.tables += [self._table(np.arange(n), n, np.flatnonzero(size == n)) for n in sorted({*size.tolist()}) if n < _WIDE]

    def _table(self, places, width, members):
        made = [seeds(self.words[k], places, width) for k in members]
        key = np.concatenate([np.zeros(0, np.uint64), *made])
        which = np.repeat(members, [len(x) for x in made])
        at = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(x)) for x in made)])
        order = np.argsort(key, kind="stable")
        sieve = np.zeros(_SIEVE, bool)
        sieve[(key & np.uint64(_SIEVE - 1)).astype(np.int64)] = True
        return places, width, key[order], which[order], at[order], sieve

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Different (segment, word of the document at which the segment would start), the latter possibly negative."""
        found = [np.zeros((2, 0), np.int64)]
        for places, width, key, which, at, sieve in self.tables:
            made = seeds(words, places, width)
            place = np.flatnonzero(sieve[(made & np.uint64(_SIEVE - 1)).astype(np.int64)])
            low, high = np.searchsorted(key, made[place], "left"), np.searchsorted(key, made[place], "right")
            n = high - low
            found += self._often(made, place, low, high, which, at, len(words))
            n[_repeated(made[place], n)] = 0
            k = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            found.append(np.stack((which[k], np.repeat(place, n) - at[k])))
        pairs = np.unique(np.concatenate(found, axis=1), axis=1)
        return pairs[0], pairs[1]

    @staticmethod
    def _often(made, place, low, high, which, at, n_words) -> Iterator[np.ndarray]:
        """Hits of seeds that are frequent on both sides (a word said over and over): diagonals are marked in one array per segment, so their number
        counts and not that of the pairs."""
        some = _repeated(made[place], high - low)
        keys, first, back, count = np.unique(made[place][some], return_index=True, return_inverse=True, return_counts=True)
        order = np.argsort(back, kind="stable")
        groups = np.split(place[some][order], np.cumsum(count)[:-1]) if len(keys) else []
        entries: dict[int, list] = {}
        for k, begin in enumerate(first.tolist()):
            a, b = int(low[some][begin]), int(high[some][begin])
            for w in np.unique(which[a:b]).tolist():
                entries.setdefault(w, []).append((groups[k], at[a:b][which[a:b] == w]))
        for w, pairs in entries.items():
            far = max(int(places.max()) for _, places in pairs)
            marks = np.zeros(n_words + far + 1, bool)
            for mine, places in pairs:
                few, many, sign = (places, mine, -1) if len(places) <= len(mine) else (mine, -places, 1)
                for x in few.tolist():
                    marks[many + sign * x + far] = True
            s = np.flatnonzero(marks) - far
            yield np.stack((np.full(len(s), w), s))


def _repeated(made: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which of a text block's seeds, with ``n`` places on the other side each, make more than ``MANY`` pairs."""
    if int(n.sum()) <= MANY:
        return np.zeros(len(made), bool)
    _, back, count = np.unique(made, return_inverse=True, return_counts=True)
    return count[back] * n > MANY


def best_stretch(same: np.ndarray, penalty: int) -> tuple[int, int]:
    """Start and end of the longest stretch whose score is not below zero, of equals that of highest score and then the first.

    It is the whole, or begins and ends with an equal word, so changed words around a passage never make it longer.
    """
    run = np.concatenate(([0], np.cumsum(np.where(same, 1, -penalty))))
    if run[-1] >= 0:
        return 0, len(same)
    ends = np.flatnonzero(same) + 1
    if not len(ends):
        return 0, 0
    # the lowest sum before any allowed start up to each place falls, so the first start that an end can have is found by bisection
    low = np.minimum.accumulate(np.where(same, run[:-1], len(same) + 1))
    starts = np.searchsorted(-low, -run[ends])
    best = np.lexsort((starts, run[starts] - run[ends], starts - ends))[0]
    return int(starts[best]), int(ends[best])


def benchmark_words(benchmark: DataFrame, id: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id, n_words, at, words``: segments of the different items, as hashed words."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            ids = iter(batch.column(0).to_pylist())
            for part in blocks(batch.column(1)):
                words, bound = words_of(part, NO_WORD)
                rows += [(next(ids), words[a:b].tobytes()) for a, b in zip(bound, bound[1:])]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["item_id", "words"])

    items = benchmark.select(F.col(id).cast("long").alias("item_id"), F.col(text).alias("text")).mapInArrow(of, "item_id long, words binary")
    items = items.filter(F.length("words") > 0).groupBy("words").agg(F.min("item_id").alias("item_id"))
    n = (F.length("words") / 8).cast("long")
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(n - OVERLAP_WORDS - 1, F.lit(0)), F.lit(SEGMENT_WORDS - OVERLAP_WORDS).cast("long"))).alias("at")
    cut = items.select("item_id", n.alias("n_words"), "words", at)
    return cut.select("item_id", "n_words", "at", F.substring("words", (8 * F.col("at") + 1).cast("int"), F.lit(8 * SEGMENT_WORDS)).alias("words"))


def overlaps(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
             min_words: int = MIN_WORDS, penalty: int = PENALTY, slice_words: int = SLICE_WORDS) -> DataFrame:
    """``doc_id, item_id, item_words, overlap_words, equal_words, doc_word, item_word``: the longest verified overlap of each pair."""
    segments = stored(benchmark_words(benchmark, item_id, item_text), "benchmark")
    total = segments.agg(F.sum(F.length("words") / 8)).first()[0] or 0
    slices = max(1, -(-int(2 * total) // slice_words))   # about half full, as segments fall into slices by hash
    out = None
    for k in range(slices):
        mine = segments.filter(F.pmod(F.xxhash64("item_id", "at"), F.lit(slices)) == k).orderBy("item_id", "at").collect()
        part = _scan(docs, id, text, mine, min_words, penalty)
        out = part if out is None else out.unionByName(part)
    best = F.max_by(F.struct("item_words", "overlap_words", "equal_words", "doc_word", "item_word"),
                    F.struct("equal_words", "overlap_words", -F.col("doc_word"), -F.col("item_word"))).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")


def _scan(docs, id, text, rows, min_words, penalty):
    shared = docs.sparkSession.sparkContext.broadcast([(r.item_id, r.n_words, r.at, bytes(r.words)) for r in rows])
    names = ["doc_id", "item_id", "item_words", "overlap_words", "equal_words", "doc_word", "item_word"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Slice(shared.value)
        for batch in batches:
            ids = iter(batch.column(0).to_pylist())
            rows = []
            for part in blocks(batch.column(1)):
                words, bound = words_of(part, NO_WORD)
                docs_in = [next(ids) for _ in part]
                # texts stand apart by a gap, so one pass serves the whole block
                spread = np.concatenate([x for a, b in zip(bound, bound[1:]) for x in (_GAP, words[a:b])])
                shift = np.arange(1, len(part) + 1) * _WIDE
                start, end = bound[:-1] + shift, bound[1:] + shift
                which, begin = table.hits(spread)
                # the segment's place may touch several texts: each is compared with its part of the segment
                met: dict[tuple[int, int], list] = {}
                for w, s in zip(which.tolist(), begin.tolist()):
                    first = int(np.searchsorted(end, s, "right"))
                    while first < len(start) and start[first] < s + len(table.words[w]):
                        a, b = max(s, int(start[first])), min(s + len(table.words[w]), int(end[first]))
                        met.setdefault((first, w), []).append((a - b, a, s))
                        first += 1
                for (doc, w), diagonals in met.items():
                    # the longest diagonals first: those that cannot beat what was found are not compared
                    item, origin, best = table.words[w], int(start[doc]), None
                    for less, a, s in sorted(diagonals):
                        if best and (-less, -less, origin - a) < best[0][:3]:
                            if -less < best[0][0]:
                                break
                            continue
                        same = spread[a:a - less] == item[a - s:a - less - s]
                        x, y = best_stretch(same, penalty)
                        if y - x >= min(min_words, table.whole[w]):
                            key = (int(same[x:y].sum()), y - x, origin - a - x, s - a - x)
                            if best is None or key > best[0]:
                                best = key, (docs_in[doc], table.item[w], table.whole[w], y - x, key[0], a + x - origin, table.first[w] + a + x - s)
                    if best:
                        rows.append(best[1])
            cols = list(zip(*rows)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(of, ", ".join(f"{n} long" for n in names))
