"""Quality rules whose cutoffs carry a guarantee against rejecting good documents.

Every rule is a number per document that is large for bad ones. For each stratum one nested order of cutoffs is fixed first, from the bad
labelled documents and a share of the good ones (``DESIGN``): it begins with no cutoff, and each step lowers one rule's cutoff on a fixed grid to the next one that
rejects more bad documents, that of the fewest good ones for each bad one first. The other good documents test the steps in this order: a step is allowed
if the steps before are, and if an exact binomial test shows that all rules together reject less than ``alpha`` of the good documents. With ``n`` good documents of which ``k`` are rejected, the
probability of ``k`` or fewer at a rate of ``alpha`` must be at most ``delta`` divided by the number of strata. The first step that loses too many good
documents is the only one whose test counts (fixed sequence), so with probability 1 - ``delta`` no stratum loses more than ``alpha`` of its good
documents to the rules together. The last allowed step holds; a rule that adds nothing rejects nothing. Strata without labels thus keep everything.

Defined results: null texts count as empty; a null stratum is a stratum of its own; labels without a quality are ignored. Each id is one trial of
the tests: its labels are one label, good if any of them says so, and of its rows that with the least stratum, then counts, is tested. Documents that
are repeated rows get the same verdict. Columns of the input are kept, and one with
the name of a result is replaced. Empty tables give an empty result, or no cutoff at all.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import extended, few_or_not, stored

ALPHA, DELTA = 0.02, 0.05
DESIGN = 5   # one good labelled document of so many helps to choose the order of cutoffs, and tests nothing
MIN_WORDS, REPEAT_PERCENT, WINDOW = 50, 50, 3

# fixed values: the character classes of the counts
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#*$%&|<>"
CAPITALS = bytes(range(65, 91))
STOPS = b"!?.,;:"

_NOT_COUNTED = BLANKS + bytes(range(0x80, 0xC0))   # blanks, and all but the first byte of each character
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_stops", "n_different")

#: rule: numerator and denominator
RULES = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeat_words": ("n_repeat_words", "n_words"),
         "capitals": ("n_capitals", "word_chars"), "stops": ("n_stops", "n_words"), "same_words": ("n_same", "n_words")}
GRID = [round(0.02 * 1.2 ** i, 5) for i in range(22)]


def counts_of(text: bytes) -> tuple[int, ...]:
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip(BLANKS)]
    windows = list(zip(*(words[i:] for i in range(WINDOW))))
    repeated = 0
    if len(seen := Counter(windows)) < len(windows):
        covered = np.zeros(len(words) + 1, np.int64)
        hit = np.fromiter((i for i, w in enumerate(windows) if seen[w] > 1), np.int64)
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + WINDOW, -1)
        repeated = int((np.cumsum(covered) > 0).sum())
    size = len(text)
    return (len(words), len(text.translate(None, _NOT_COUNTED)), size - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated,
            len(lines), size - len(text.translate(None, CAPITALS)), size - len(text.translate(None, STOPS)), len(set(words)))


def with_counts(docs: DataFrame, text: str = "text", out: str = "counts") -> DataFrame:
    """Adds one struct of counts."""
    kind = pa.struct([(c, pa.int64()) for c in COUNTS])

    def of(texts: list[bytes]):
        rows = np.array([counts_of(t) for t in texts], np.int64).reshape(-1, len(COUNTS))
        return (pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(COUNTS))], fields=list(kind)),)

    return extended(docs, text, lambda: of, [(out, "struct<" + ",".join(f"{c}:long" for c in COUNTS) + ">", kind)])


def base_failed(counts: str = "counts"):
    n, r = F.col(f"{counts}.n_words"), F.col(f"{counts}.n_repeat_words")
    return (n < MIN_WORDS) | (100 * r > REPEAT_PERCENT * n)


def _signal(rule: str, counts: str):
    top, below = RULES[rule]
    value = F.col(f"{counts}.n_words") - F.col(f"{counts}.n_different") if top == "n_same" else F.col(f"{counts}.{top}")
    return value / F.greatest(F.col(f"{counts}.{below}"), F.lit(1))


def tail(n: int, k: int, rate: float) -> float:
    """Probability of at most ``k`` of ``n`` at this rate, exactly summed."""
    if k >= n:
        return 1.0
    odds, logs = math.log(rate) - math.log1p(-rate), n * math.log1p(-rate)
    total, high = 0.0, -math.inf
    terms = []
    for i in range(k + 1):
        if i:
            logs += math.log(n - i + 1) - math.log(i) + odds
        terms.append(logs)
        high = max(high, logs)
    total = sum(math.exp(t - high) for t in terms)
    return min(1.0, math.exp(high) * total)


def nested_order(levels: np.ndarray, good: np.ndarray, bad: np.ndarray) -> list[tuple[int, int]]:
    """(rule, cutoff of the grid) step by step; ``levels`` are numbers of cutoffs below each value, with the good and bad documents that have them."""
    at, alive, steps = [len(GRID)] * levels.shape[1], np.ones(len(levels), bool), []
    while True:
        best = None
        for r in range(levels.shape[1]):
            # what a cutoff would reject beyond the steps before
            gain, lost = (np.cumsum(np.bincount(levels[alive, r], x[alive], len(GRID) + 1)[::-1])[::-1][1:] for x in (bad, good))
            lower = np.flatnonzero(gain[:at[r]] > lost[:at[r]])
            if len(lower):
                c = int(lower[-1])
                best = min(best or (math.inf,), (lost[c] / gain[c], -c, r))
        if best is None:
            return steps
        c, r = -best[1], best[2]     # of equals the loosest
        at[r] = c
        alive &= levels[:, r] <= c
        steps.append((r, c))


def cutoffs(labelled: DataFrame, stratum: str, good: str, alpha: float = ALPHA, delta: float = DELTA, counts: str = "counts", key: str | None = None) -> DataFrame:
    """``stratum, rule, cutoff``: the guaranteed cutoffs, from labelled documents (``good`` boolean) with their counts. Rows of one ``key`` are one document's."""
    def level_of(x):
        return F.aggregate(F.array(*map(F.lit, GRID)), F.lit(0), lambda n, c: n + (x > c).cast("int"))

    level = F.array(*[level_of(_signal(r, counts)) for r in RULES])
    chosen = F.pmod(F.xxhash64(F.lit("design"), F.col(key) if key else F.monotonically_increasing_id()), F.lit(DESIGN)) == 0
    rows = labelled.select(F.col(stratum).alias("stratum"), F.col(good).alias("good"), chosen.alias("chosen"), level.alias("levels"))
    hist = stored(rows.groupBy("stratum", "good", "chosen", "levels").agg(F.count(F.lit(1)).alias("n")), "levels")
    kind = hist.schema["stratum"].dataType.simpleString()

    def order(group: pa.Table) -> pa.Table:
        n, is_good = group["n"].to_numpy(), np.array(group["good"].to_pylist(), bool)
        steps = nested_order(np.array(group["levels"].to_pylist(), np.int64), n * is_good, n * ~is_good)
        return pa.table({"stratum": pa.array([group["stratum"][0].as_py()] * len(steps), group.schema.field("stratum").type), "step": pa.array(range(len(steps)), pa.int32()),
                         "rule": pa.array([r for r, _ in steps], pa.int32()), "at": pa.array([c for _, c in steps], pa.int32())})

    # documents of equal levels are one row: thousands at most for a stratum
    seen = hist.filter("NOT good OR chosen").groupBy("stratum", "good", "levels").agg(F.sum("n").alias("n"))
    path = stored(seen.groupBy("stratum").applyInArrow(order, f"stratum {kind}, step int, rule int, at int"), "order")
    strata = max(1, path.select("stratum").distinct().count())
    whole = path.groupBy(F.col("stratum").alias("__stratum")).agg(F.collect_list(F.struct("step", "rule", "at")).alias("path"))
    first = F.array_min(F.transform(F.filter("path", lambda p: F.get(F.col("levels"), p["rule"]) > p["at"]), lambda p: p["step"]))
    tested = hist.filter("good AND NOT chosen").join(F.broadcast(whole), F.col("stratum").eqNullSafe(F.col("__stratum"))).select("__stratum", first.alias("first"), "n")
    tested = tested.groupBy("__stratum", "first").agg(F.sum("n").alias("n"))     # a row per step at most
    lost = path.join(tested, F.col("stratum").eqNullSafe(F.col("__stratum"))).groupBy("stratum", "step", "rule", "at").agg(
        F.sum("n").alias("n_good"), F.sum(F.when(F.col("first") <= F.col("step"), F.col("n")).otherwise(0)).alias("lost"))

    def test(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for n, k in batches:
            yield pa.array([tail(a, b, alpha) <= delta / strata for a, b in zip(n.to_pylist(), k.to_pylist())], pa.bool_())

    judged = stored(lost.withColumn("safe", F.arrow_udf(test, "boolean")(F.col("n_good"), F.col("lost"))), "steps")
    end = judged.filter("NOT safe").groupBy(F.col("stratum").alias("__stratum")).agg(F.min("step").alias("end"))
    held = judged.join(F.broadcast(end), F.col("stratum").eqNullSafe(F.col("__stratum")), "left").filter("end IS NULL OR step < end")
    held = held.groupBy("stratum", "rule").agg(F.min("at").alias("at"))
    return held.select("stratum", F.element_at(F.array(*map(F.lit, RULES)), F.col("rule") + 1).alias("rule"), F.element_at(F.array(*map(F.lit, GRID)), F.col("at") + 1).alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", stratum: str = "lang", quality: str = "quality",
          alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Adds ``counts``, ``base_failed`` and ``kept`` to the documents. Labels have the same id and a quality of 0 or 1."""
    hold = labels.filter(F.col(quality).isNotNull() & F.col(id).isNotNull()).groupBy(F.col(id).alias("doc_id")).agg((F.max(quality) > 0).alias("good"))
    known = with_counts(docs.select(F.col(id).alias("doc_id"), F.col(stratum).alias("stratum"), F.col(text).alias("text")).join(few_or_not(stored(hold, "labels")), "doc_id"))
    # a document that fails the base rules is rejected anyway and says nothing about the cutoffs
    known = known.groupBy("doc_id").agg(F.min(F.struct("stratum", "counts", "good")).alias("one")).select("doc_id", "one.*")
    chosen = cutoffs(stored(known, "labelled").filter(~base_failed()), "stratum", "good", alpha, delta, key="doc_id")
    per_stratum = chosen.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(r) for r in RULES])
    per_stratum = stored(per_stratum.select(F.col("stratum").alias("__stratum"), F.struct(*RULES).alias("__cut")), "cutoffs")
    out = with_counts(docs, text).join(per_stratum, F.col(stratum).eqNullSafe(F.col("__stratum")), "left")
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | F.coalesce(_signal(r, "counts") > F.col(f"__cut.{r}"), F.lit(False))
    out = out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected)
    return out.drop("__stratum", "__cut")
