"""Quality classifier by co-training of two views.

One classifier sees the content of a text (its words and their shapes), the other only its metadata (source, language, size and layout). Both are naive
Bayes over hashed features, so a model is a table of fixed size and training is a sum of counts. They start from a bounded
sample of labelled documents (``max_labelled``, those of smallest hash; a quarter is held out). In each round every other document of the corpus is scored
by both views; where one view is confident, its label is a training example of the other view. A view is confident beyond the score
at which its labels surely reach ``precision`` on the held-out documents. In the end each view's score is calibrated on the held-out
documents (logistic), and the calibrated log-odds are added, the prior counted once, to score all documents.

Every round is one scan: tasks put out sums of counts, at most one row per feature. Only tables of fixed size (models, held-out scores of the bounded
sample) pass the driver.

Defined results: null and empty texts have no content features, their content score is neutral; null metadata is a value of its own. Labels without id or
quality are ignored; of contradictory labels of one document the larger share counts, a tie as good. Without labels of both classes all scores are the
prior (0.5 without any). Repeated rows each get a row; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import blocks, stored
from .text import BLANKS, LOWER, Spans, lookup_table, mixed, runs

MAX_LABELLED, ROUNDS, PRECISION, HELD_OUT = 20_000, 2, 0.95, 4
Z = 1.645      # one-sided 95 % for the precision
CONTENT, META = 1 << 16, 1 << 12      # features of each view
SMOOTH = 1.0
_CAPITAL = lookup_table(bytes(range(65, 91)))


def content_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Different features of each text: (text, feature) in two arrays, by text."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    start, end = runs(~BLANKS[buf])
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, "right")
    words = Spans(LOWER[buf]).hashes(start, end) % np.uint64(CONTENT // 2)
    capitals = np.concatenate(([0], np.cumsum(_CAPITAL[buf])))
    size = end - start
    shape = buf[end - 1].astype(np.uint64) | buf[np.maximum(end - 2, start)].astype(np.uint64) << np.uint64(8)
    shape |= (2 * (capitals[end] - capitals[start]) > size).astype(np.uint64) << np.uint64(16) | np.minimum(size, 12).astype(np.uint64) << np.uint64(17)
    shape = mixed(shape) % np.uint64(CONTENT // 2) + np.uint64(CONTENT // 2)
    pairs = np.unique(np.concatenate([owner.astype(np.uint64) * np.uint64(CONTENT) + f for f in (words, shape)]))
    return (pairs // np.uint64(CONTENT)).astype(np.int64), (pairs % np.uint64(CONTENT)).astype(np.int64)


def meta_features(source, lang, n_chars, text: bytes) -> list[int]:
    n = len(text) if n_chars is None else max(0, n_chars)
    lines = text.count(b"\n") + 1
    values = {"source": source, "lang": lang, "size": int(2 * np.log2(n + 1)), "lines": int(2 * np.log2(lines)), "line": int(2 * np.log2(n / lines + 1))}
    return sorted({zlib.crc32(f"{k}={v!r}".encode()) % META for k, v in values.items()})


class Model:
    """Naive Bayes weights of both views, from counts of features and documents per class."""

    def __init__(self, counts: dict[str, np.ndarray], docs: dict[str, np.ndarray]):
        self.weights = {}
        for view, n in counts.items():
            rate = (n + SMOOTH) / (docs[view][:, None] + 2 * SMOOTH)
            self.weights[view] = np.log(rate[1]) - np.log(rate[0])
        #: per view: scores at or below which, and at or above which, a document counts as surely bad or good
        self.sure = {view: (-np.inf, np.inf) for view in counts}

    def content(self, texts: list[bytes]) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        owner, feature = content_features(texts)
        n = np.bincount(owner, minlength=len(texts))
        return np.bincount(owner, self.weights["content"][feature], len(texts)) / np.maximum(n, 1), (owner, feature)

    def meta(self, features: list[list[int]]) -> np.ndarray:
        return np.array([self.weights["meta"][f].mean() for f in features])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """(other columns' values by row, texts) in bounded parts; the text is the last column."""
    for batch in batches:
        others = list(zip(*(c.to_pylist() for c in batch.columns[:-1])))
        at = 0
        for part in blocks(batch.column(batch.num_columns - 1)):
            yield others[at:at + len(part)], part
            at += len(part)


def _counts(found: DataFrame) -> tuple[dict, dict]:
    """Sums of ``view, feature, good, n`` (feature -1: documents) as arrays."""
    sums = found.groupBy("view", "feature", "good").agg(F.sum("n").alias("n")).collect()   # at most 2 rows per feature
    counts, docs = {"content": np.zeros((2, CONTENT)), "meta": np.zeros((2, META))}, {"content": np.zeros(2), "meta": np.zeros(2)}
    for view, feature, good, n in sums:
        if feature < 0:
            docs[view][int(good)] += n
        else:
            counts[view][int(good), feature] += n
    return counts, docs


class _Sums:
    def __init__(self):
        self.counts, self.docs = {"content": np.zeros((2, CONTENT), np.int64), "meta": np.zeros((2, META), np.int64)}, {"content": [0, 0], "meta": [0, 0]}

    def add(self, view: str, good: int, features) -> None:
        self.counts[view][good, features] += 1
        self.docs[view][good] += 1

    def batch(self) -> pa.RecordBatch:
        cols: list[list] = [[], [], [], []]
        for view in self.counts:
            for good in (0, 1):
                at = np.flatnonzero(self.counts[view][good])
                for c, v in zip(cols, ([view] * (len(at) + 1), [*at.tolist(), -1], [bool(good)] * (len(at) + 1), [*self.counts[view][good, at].tolist(), self.docs[view][good]])):
                    c += v
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.bool_()), pa.array(cols[3], pa.int64())], ["view", "feature", "good", "n"])


_SUMS = "view string, feature int, good boolean, n long"


def _pseudo(docs: DataFrame, model: Model) -> DataFrame:
    """Counts from the documents that a view is sure of, for the other view."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, sums = shared.value, _Sums()
        for rows, texts in _rows(batches):
            scores, (owner, feature) = model.content(texts)
            metas = [meta_features(*r[1:4], t) for r, t in zip(rows, texts)]
            others = model.meta(metas)
            bound = np.searchsorted(owner, np.arange(len(texts) + 1))
            for i, row in enumerate(rows):
                if row[0]:          # a labelled document speaks for itself
                    continue
                low, high = model.sure["content"]
                if bound[i] < bound[i + 1] and (scores[i] <= low or scores[i] >= high):
                    sums.add("meta", int(scores[i] >= high), metas[i])
                low, high = model.sure["meta"]
                if others[i] <= low or others[i] >= high:
                    sums.add("content", int(others[i] >= high), feature[bound[i]:bound[i + 1]])
        yield sums.batch()

    return docs.mapInArrow(of, _SUMS)


def _train_counts(known: DataFrame) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for rows, texts in _rows(batches):
            owner, feature = content_features(texts)
            bound = np.searchsorted(owner, np.arange(len(texts) + 1))
            for i, (row, text) in enumerate(zip(rows, texts)):
                good = int(row[0])
                sums.add("content", good, feature[bound[i]:bound[i + 1]])
                sums.add("meta", good, meta_features(*row[1:4], text))
        yield sums.batch()

    return known.mapInArrow(of, _SUMS)


def _scored(docs: DataFrame, model: Model, first: str) -> DataFrame:
    """First column, content score, metadata score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = {"long": pa.int64(), "boolean": pa.bool_()}[first]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _rows(batches):
            scores, _ = shared.value.content(texts)
            others = shared.value.meta([meta_features(*r[1:4], t) for r, t in zip(rows, texts)])
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array(scores), pa.array(others)], ["first", "content", "meta"])

    return docs.mapInArrow(of, f"first {first}, content double, meta double")


def sure_beyond(scores: np.ndarray, good: np.ndarray, precision: float) -> tuple[float, float]:
    """The widest score ranges at the ends in which at least ``precision`` of the documents are bad, or good, by the lower bound of a Wilson interval,
    so a few documents are never enough; ties in a score go together."""
    out = []
    for s, hit in ((scores, ~good), (-scores, good)):
        order = np.argsort(s, kind="stable")
        s, right = s[order], np.cumsum(hit[order])
        last = np.append(s[1:] != s[:-1], True)
        n = np.arange(1, len(s) + 1)
        p = right / n
        low = (p + Z * Z / (2 * n) - Z * np.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)
        ok = np.flatnonzero(last & (low >= precision))
        out.append(s[ok[-1]] if len(ok) else -np.inf)
    return float(out[0]), float(-out[1])


def logistic(scores: np.ndarray, good: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and intercept of the log-odds, with targets drawn in by one document per class, and a slight ridge."""
    n1, n0 = good.sum(), (~good).sum()
    y = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack((scores, np.ones(len(scores))), 1)
    w = np.array([0.0, np.log((n1 + 1) / (n0 + 1))])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + 1e-6 * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), grad)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def score(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", n_chars: str = "n_chars",
          quality: str = "quality", max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS, precision: float = PRECISION) -> DataFrame:
    """``doc_id, content_quality, meta_quality, quality, kept`` for every document; kept if good is at least as likely as bad."""
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"),
                       F.col(n_chars).cast("long").alias("n_chars"), F.col(text).alias("text"))
    votes = labels.filter(F.col(id).isNotNull() & F.col(quality).isNotNull()).groupBy(F.col(id).cast("long").alias("doc_id")).agg((F.avg((F.col(quality) > 0).cast("int")) >= 0.5).alias("good"))
    sample = stored(votes.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(max_labelled).drop("h"), "labels")
    few = F.broadcast(sample)                        # at most max_labelled rows
    known = stored(rows.join(few, "doc_id").select(F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(HELD_OUT)).alias("fold"), "good", "source", "lang", "n_chars", "text"), "labelled")
    fit, held = known.filter("fold > 0").drop("fold"), known.filter("fold = 0").drop("fold")
    base, base_docs = _counts(_train_counts(fit))
    rest = rows.join(few.select("doc_id", F.lit(True).alias("known")), "doc_id", "left").select(F.coalesce("known", F.lit(False)).alias("known"), "source", "lang", "n_chars", "text")

    def tried(model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        got = _scored(held, model, "boolean").toPandas()   # a quarter of max_labelled rows
        return got["content"].to_numpy(float), got["meta"].to_numpy(float), got["first"].to_numpy(bool)

    model = Model(base, base_docs)
    for _ in range(rounds):
        content, meta, good = tried(model)
        if good.all() or not good.any():
            break
        model.sure = {"content": sure_beyond(content, good, precision), "meta": sure_beyond(meta, good, precision)}
        more, more_docs = _counts(_pseudo(rest, model))
        model = Model({v: base[v] + more[v] for v in base}, {v: base_docs[v] + more_docs[v] for v in base})
    content, meta, good = tried(model)
    prior = float(np.log((good.sum() + 1) / ((~good).sum() + 1)))
    lines = [logistic(s, good) if 0 < good.sum() < len(good) else (0.0, prior) for s in (content, meta)]
    odds = [F.lit(a) * F.col(c) + F.lit(b) for (a, b), c in zip(lines, ("content", "meta"))]
    chance = lambda x: F.round(1 / (1 + F.exp(-x)), 9)
    out = _scored(rows, model, "long")
    return out.select(F.col("first").alias("doc_id"), chance(odds[0]).alias("content_quality"), chance(odds[1]).alias("meta_quality"),
                      chance(odds[0] + odds[1] - F.lit(prior)).alias("quality"), (odds[0] + odds[1] - F.lit(prior) >= 0).alias("kept"))
