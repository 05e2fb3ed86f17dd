"""What a session remembers between rows, as stateful processors with event-time timers.

All three keep a bounded state per session (the builds kept, one snapshot, the open bursts) and forget a session once the watermark has passed its last
change by its life. Rows of one session and micro-batch are put in order first, so the batch is what must fit: bound it by the source's ``maxBytesPerTrigger``. Rows behind
the watermark are dropped by Spark. Rows without a session (a marker that only moves the watermark) leave nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor


class _Session(StatefulProcessor):
    def __init__(self, life_us: int):
        self.life_us = life_us

    def _ordered(self, rows: Iterator[pd.DataFrame]) -> list:
        return list(pd.concat(list(rows)).sort_values(["us", "seq"]).itertuples(index=False))

    def _timer(self, us: int) -> None:
        self.handle.registerTimer(-(-us // 1000))

    @staticmethod
    def _passed(timerValues) -> int:
        return timerValues.getCurrentWatermarkInMs() * 1000

    def close(self) -> None:
        pass


class Builds(_Session):
    """Each row is a build or a hit: a hit if its key is one of the ``kept`` keys that the session used last. A session that rests longer than its life starts afresh."""

    schema = "sid long, seq long, build_key string, status string"

    def __init__(self, life_us: int, kept: int):
        super().__init__(life_us)
        self.kept = kept

    def init(self, handle) -> None:
        self.handle = handle
        self.keys = handle.getListState("keys", "build_key string")
        self.last = handle.getValueState("last", "us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if pd.isna(key[0]):
            return
        last = self.last.get()[0] if self.last.exists() else None
        keys = [k[0] for k in self.keys.get()] if last is not None else []
        out = []
        for r in self._ordered(rows):
            if last is not None and r.us - last > self.life_us:
                keys = []
            out.append((key[0], r.seq, r.build_key, "hit" if r.build_key in keys else "build"))
            keys = [r.build_key, *(k for k in keys if k != r.build_key)][:self.kept]
            last = r.us if last is None else max(last, r.us)
        self.keys.put([(k,) for k in keys])
        self.last.update((last,))
        self._timer(last + self.life_us + 1)
        yield pd.DataFrame(out, columns=["sid", "seq", "build_key", "status"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists() and self.last.get()[0] + self.life_us < self._passed(timerValues):
            self.last.clear()
            self.keys.clear()
        yield from ()


class Latest(_Session):
    """The last snapshot of a session whenever it changes, and once more, as ``expired``, when it is forgotten."""

    schema = "sid long, us long, seq long, payload string, expired boolean"

    def init(self, handle) -> None:
        self.handle = handle
        self.snapshot = handle.getValueState("snapshot", "us long, seq long, payload string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if pd.isna(key[0]):
            return
        before = best = tuple(self.snapshot.get()) if self.snapshot.exists() else None
        out = []
        for r in self._ordered(rows):
            if best is None or (r.us, r.seq) > best[:2]:
                if best is not None and r.us - best[0] >= self.life_us:
                    out.append((key[0], *best, True))
                best = (int(r.us), int(r.seq), r.payload)
        if best != before:
            self.snapshot.update(best)
            self._timer(best[0] + self.life_us)
            yield pd.DataFrame([*out, (key[0], *best, False)], columns=["sid", "us", "seq", "payload", "expired"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.snapshot.exists():
            last = tuple(self.snapshot.get())
            if last[0] + self.life_us <= self._passed(timerValues):
                self.snapshot.clear()
                yield pd.DataFrame([(key[0], *last, True)], columns=["sid", "us", "seq", "payload", "expired"])


class Bursts(_Session):
    """A row per burst, put out by a timer when no row can belong to it any more. ``starts_build`` is false if it ends with the key that the burst before ended with,
    unless that one is longer ago than the session's life."""

    schema = "sid long, started_us long, ended_us long, changes long, payload string, build_key string, starts_build boolean"
    _fields = "started long, ended long, changes long, seq long, payload string, build_key string"

    def __init__(self, life_us: int, gap_us: int):
        super().__init__(life_us)
        self.gap_us = gap_us

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", self._fields)
        self.before = handle.getValueState("before", "ended long, build_key string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if pd.isna(key[0]):
            return
        bursts = [tuple(b) for b in self.open.get()] if self.open.exists() else []
        pieces = [*bursts, *((r.us, r.us, 1, r.seq, r.payload, r.build_key) for r in self._ordered(rows))]
        bursts = []
        for p in sorted(pieces, key=lambda b: b[:2]):     # in the order of their starts, a piece can only join the last burst
            if bursts and p[0] - self.gap_us <= bursts[-1][1]:
                last = max((bursts[-1], p), key=lambda b: (b[1], b[3]))
                bursts[-1] = (bursts[-1][0], last[1], bursts[-1][2] + p[2], *last[3:])
            else:
                bursts.append(p)
        self.open.put(bursts)
        self._timer(min(b[1] for b in bursts) + self.gap_us)    # one timer at a time: the one that closes a burst sets the next
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = self._passed(timerValues)
        bursts = sorted(tuple(b) for b in self.open.get()) if self.open.exists() else []
        done = [b for b in bursts if b[1] + self.gap_us <= passed]
        before = self.before.get() if self.before.exists() else None
        if done:
            out = []
            for started, ended, changes, _, payload, build_key in done:
                fresh = before is None or build_key != before[1] or started - before[0] > self.life_us
                out.append((key[0], started, ended, changes, payload, build_key, fresh))
                before = (ended, build_key)
            self.before.update(before)
            self._timer(before[0] + self.life_us + 1)
            rest = bursts[len(done):]
            if rest:
                self.open.put(rest)
                self._timer(min(b[1] for b in rest) + self.gap_us)
            else:
                self.open.clear()
            yield pd.DataFrame(out, columns=[c.split()[0] for c in self.schema.split(", ")])
        elif before is not None and not bursts and before[0] + self.life_us < passed:
            self.before.clear()
