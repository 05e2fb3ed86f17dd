"""Byte-level BPE by monoid tree reduction.

The encodings of byte strings form a monoid: ``join(encode(a), encode(b)) == encode(a + b)``. A piece is halved until it is short,
the halves are encoded, and neighbours are joined on the way up. A sequence of tokens is the encoding of its bytes exactly if each
pair of neighbours is (a merge across a border would show in the two tokens at that border alone). So a join looks at the border:
if the two tokens there may stand side by side, the halves are put together as they are; else a window around the border is
encoded anew. It grows to the left until its first token and the one before it may stand side by side, and to the right by a token at a time: what is settled
on the left leaves the window. When both sides may stand, no token outside the window can change. So a join costs what it changes, and a run whose tokens all shift
meets the same few windows again and again. Decoding concatenates the tokens' bytes up the same kind of tree.

Texts are first split into pieces by the pattern of the rank files; the split is done for a block of texts at once from
the classes of their characters. Equal pieces of a block are encoded once.

Defined results: null and empty texts have no tokens; ids that are null or empty decode to no bytes; other columns are kept,
and a column with the name of the result is replaced. Each row is handled by itself, so repeated rows repeat their results.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import extended
from .text import Spans

LEAF = 6                 # bytes that are merged directly
KNOWN_PIECES, KNOWN_PARTS = 300_000, 100_000   # encodings of pieces, and of leaves, windows and borders, that a worker remembers

# fixed values: what the pattern of the rank files takes as one piece behind an apostrophe
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

OTHER, LETTER, NUMBER, SPACE, BORDER = range(5)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[[ord(c) for c in m[0]]] = kind
    return out


def piece_starts(text: str, borders: np.ndarray) -> np.ndarray:
    """Where pieces start in the characters of ``text``; ``borders`` are characters that separate texts and belong to none."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kind = _classes()[points]
    kind[borders] = BORDER
    n = len(points)
    start = np.ones(n + 1, bool)
    start[1:n] = kind[1:] != kind[:-1]
    start[borders] = True
    start[borders + 1] = True
    # the last blank of a run stands alone before what is no blank, and a plain space there belongs to what follows
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] < SPACE))
    start[last] = True
    joined = last[points[last] == 0x20]
    start[joined + 1] = False
    # an apostrophe that begins a piece takes one or two of the letters behind it
    quote = np.flatnonzero((points[:-1] == 0x27) & start[:n - 1] & (kind[1:] == LETTER))
    for q in quote.tolist():
        for tail in CONTRACTIONS:
            if text.startswith(tail, q + 1):
                start[q + 1] = False
                start[q + 1 + len(tail)] = True
                break
    return np.flatnonzero(start[:n])


class Coder:
    """Encodes and decodes with one set of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.table = {i: token for token, i in ranks.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[bytes, list[int]] = {}
        self.short: dict[bytes, list[int]] = {}   # leaves and windows: few different ones, each often

    def merged(self, data: bytes) -> list[int]:
        """The encoding from its definition: again and again the pair of lowest rank, the leftmost of equals, becomes one token."""
        if len(data) > 256:
            return self._merged_long(data)
        ranks, cut = self.ranks, list(range(len(data) + 1))
        far = len(ranks) + (1 << 62)
        cost = [ranks.get(data[i:i + 2], far) for i in range(len(data) - 1)]
        while cost and (low := min(cost)) < far:
            at = cost.index(low)
            del cut[at + 1], cost[at]
            if at < len(cost):
                cost[at] = ranks.get(data[cut[at]:cut[at + 2]], far)
            if at:
                cost[at - 1] = ranks.get(data[cut[at - 1]:cut[at + 1]], far)
        return [ranks[data[a:b]] for a, b in zip(cut, cut[1:])]

    def _merged_long(self, data: bytes) -> list[int]:
        """The same by a heap of pairs over linked neighbours; a pair that has changed since is passed over."""
        ranks, n = self.ranks, len(data)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))   # of the token that begins here; end 0: none does any more
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(data[i:end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if i and (r := ranks.get(data[before[i]:stop])) is not None:
                heapq.heappush(heap, (r, before[i], stop))
        return [ranks[data[a:b]] for a, b in enumerate(end) if b]

    def remembered(self, data: bytes) -> list[int]:
        ids = self.short.get(data)
        if ids is None:
            if len(self.short) >= KNOWN_PARTS:
                self.short.clear()
            ids = self.short[data] = self.merged(data)
        return ids

    def stable(self, a: int, b: int) -> bool:
        """Whether the two tokens may stand side by side."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= KNOWN_PARTS:
                self.pairs.clear()
            found = self.pairs[a, b] = self.merged(self.table[a] + self.table[b]) == [a, b]
        return found

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of both, from their encodings."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        out, r, table = list(left), 0, self.table
        while r < len(right) and not self.stable(out[-1], right[r]):
            l, step = len(out) - 1, 1
            while True:
                window = self.remembered(b"".join(map(table.__getitem__, out[l:])) + table[right[r]])
                if l == 0 or self.stable(out[l - 1], window[0]):
                    break
                l, step = max(0, l - step), 2 * step
            out[l:] = window
            r += 1
        return out + right[r:]

    def tree(self, data: bytes) -> list[int]:
        if len(data) <= LEAF:
            return self.remembered(data)
        # long pieces are cut at powers of two, so that the parts of a run or a period are equal
        half = len(data) // 2 if len(data) <= 64 else 1 << (len(data) - 1).bit_length() - 1
        left, right = data[:half], data[half:]
        same = left == right
        left = self.short.get(left) or self.tree(left)
        right = left if same else self.short.get(right) or self.tree(right)
        return left + right if self.pairs.get((left[-1], right[0])) else self.join(left, right)

    def piece(self, data: bytes) -> list[int]:
        """A piece that is a token as a whole is that token."""
        ids = self.known.get(data)
        if ids is None:
            if len(self.known) >= KNOWN_PIECES:
                self.known.clear()
            whole = self.ranks.get(data)
            ids = self.known[data] = self.tree(data) if whole is None else [whole]
        return ids

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text's ids begin (one entry more than texts)."""
        data = b"\n".join(texts) + b"\n"
        text = data.decode()
        buf = np.frombuffer(data, np.uint8)
        first = np.flatnonzero((buf & 0xC0) != 0x80)   # byte at which each character begins
        ends = np.cumsum([len(t) + 1 for t in texts])
        borders = np.searchsorted(first, ends - 1)
        start = first[piece_starts(text, borders)]
        end = np.append(start[1:], len(data))
        real = ~np.isin(start, ends - 1, assume_unique=True)
        start, end = start[real], end[real]
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        one, which = self._distinct(buf, start, end)
        codes = [self.piece(data[a:b]) for a, b in zip(start[one].tolist(), end[one].tolist())]
        sizes = np.fromiter(map(len, codes), np.int64, len(codes))
        flat = np.fromiter(chain.from_iterable(codes), np.int32, int(sizes.sum()))
        begin, n = (np.cumsum(sizes) - sizes)[which], sizes[which]
        stop = np.cumsum(n)
        ids = flat[np.arange(stop[-1]) - np.repeat(stop - n - begin, n)]
        return ids, np.concatenate(([0], stop))[np.concatenate(([0], np.searchsorted(start, ends)))]

    @staticmethod
    def _distinct(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One of each set of equal pieces, and which of them each piece equals. Pieces are put together by a hash and then compared byte by byte;
        should unequal ones ever share a hash, each piece of the block stands for itself."""
        keys, one, which = np.unique(Spans(buf).hashes(start, end), return_index=True, return_inverse=True)
        alone = np.arange(len(start)), np.arange(len(start))
        size = end - start
        if not np.array_equal(size, size[one][which]):
            return alone
        padded = np.concatenate((buf, np.zeros(16, np.uint8)))
        words = np.lib.stride_tricks.sliding_window_view(padded, 8)
        for off in (0, 8):
            eight = np.ascontiguousarray(words[start + off]).view("<u8").ravel()
            left = np.clip(size - off, 0, 8).astype(np.uint64)
            kept = np.where(left == 8, eight, eight & ((np.uint64(1) << (np.uint64(8) * np.minimum(left, np.uint64(7)))) - np.uint64(1)))
            if not np.array_equal(kept, kept[one][which]):
                return alone
        for k in np.flatnonzero(size > 16).tolist():
            a, b = int(start[k]), int(start[one[which[k]]])
            if a != b and not np.array_equal(buf[a:a + size[k]], buf[b:b + size[k]]):
                return alone
        return one, which

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 1024:
            return b"".join(map(self.table.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


IDS = ("array<int>", pa.list_(pa.int32()))


def _lists(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))


def encode(df: DataFrame, ranks_path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds the token ids of each whole text. The ranks travel by broadcast: their size is that of one vocabulary file."""
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def start():
        coder = Coder(shared.value)
        return lambda texts: (_lists(*coder.encode(texts)),)

    return extended(df, text, start, [(out, *IDS)])


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the bytes that the token ids of each row stand for."""
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def bytes_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = Coder(shared.value)
        for batch in batches:
            # row by row: all ids of a batch as Python numbers would take ten times its memory
            yield pa.array((coder.decode(row.values.to_numpy().tolist() if row.is_valid else []) for row in batch), pa.binary())

    return df.withColumn(out, F.arrow_udf(bytes_of, "binary")(F.col(ids)))


def round_trip(df: DataFrame, ranks_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the ids and the bytes decoded from them, in one pass."""
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def start():
        coder = Coder(shared.value)

        def both(texts):
            codes, bounds = coder.encode(texts)
            return _lists(codes, bounds), [coder.decode(codes[a:b].tolist()) for a, b in zip(bounds, bounds[1:])]
        return both

    return extended(df, text, start, [(ids, *IDS), (decoded, "binary", pa.binary())])
