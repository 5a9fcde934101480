"""The memory controller of generation calls as keyed streaming state: one limit and the next call's number for each key.

Calls of a key are numbered densely from 0. They may come in any order and in any batch: a call waits in the key's state until all
before it have come, so the limits are those of the calls in order, whatever the batches were. A key that has waited longer than a
patience is given up: a timer lets its waiting calls go on without the missing ones.

Every call to the state store, and every group of rows, costs far more than a waiting call's own work. So keys are dealt to a fixed
number of parts, each a group with a map of its keys, and waiting calls are kept by spans of numbers, a record for each: those of the
next call's span beside the limit, later ones in a map. A key whose calls fit into a span costs a read and a write for each batch,
however many of them wait.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.sequence import next_limit

#: Parts that keys are dealt to; a stream's checkpoint holds for this number alone.
PARTS = 1 << 10
#: Numbers of a span.
SPAN = 1 << 10
#: Rows of a part that are held at a time, and that are made at a time.
HELD, MADE = 1 << 18, 10_000

NONE = np.empty((0, 3), "int64")


def packed(numbers: np.ndarray) -> bytes:
    return numbers.astype("<i8").tobytes()


def unpacked(numbers: bytes) -> np.ndarray:
    return np.frombuffer(numbers, "<i8")


def in_order(*calls: np.ndarray) -> np.ndarray:
    """All calls (number, blocks, peak) by number; of those with the same number the first."""
    every = np.concatenate(calls)
    return every[np.unique(every[:, 0], return_index=True)[1]]


class LimitProcessor(StatefulProcessor):
    def __init__(self, key: str, kind: str, order: str, target: int, first: int, patience_ms: int):
        self.key, self.kind, self.order, self.target, self.first, self.patience = key, kind, order, target, first, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # near: calls that wait in the span of next; far: later spans with waiting calls; until: when the key is given up, or 0
        self.now = handle.getMapState("now", f"key {self.kind}", "limit long, next long, near binary, far binary, until long")
        self.waiting = handle.getMapState("waiting", f"key {self.kind}, span long", "calls binary")
        self.due = handle.getMapState("due", "at long, piece long", f"keys array<{self.kind}>")

    def _now(self, key) -> tuple[int, int, np.ndarray, np.ndarray, int]:
        limit, expected, near, far, until = self.now.getValue((key,)) or (self.first, 0, b"", b"", 0)
        return limit, expected, unpacked(near).reshape(-1, 3), unpacked(far), until

    def _keep(self, key, limit: int, expected: int, near: np.ndarray, far: np.ndarray, until: int) -> None:
        self.now.updateValue((key,), (limit, expected, packed(near), packed(far), until))

    def _stored(self, key, span: int) -> np.ndarray:
        return unpacked(self.waiting.getValue((key, span))[0]).reshape(-1, 3)

    def _go(self, key, limit: int, calls: np.ndarray, out: list[tuple]) -> int:
        """Lets calls go on; the limit after them."""
        for number, blocks, peak in calls.tolist():
            before, limit = limit, next_limit(limit, blocks or 1, peak, self.target)
            out.append((key, number, before, limit))
        return limit

    def _settle(self, key, calls: np.ndarray, until: int, out: list[tuple]) -> Generator[pd.DataFrame, None, bool]:
        """Adds rows of the calls that can go on now that these have come; the others wait. Whether any does."""
        limit, expected, near, far, _ = self._now(key)
        calls = in_order(calls[calls[:, 0] >= expected])  # others are given up, or seen before
        while True:
            span = expected // SPAN
            here = np.searchsorted(calls[:, 0], (span + 1) * SPAN)
            near, calls = in_order(near, calls[:here]), calls[here:]
            ready = np.count_nonzero(near[:, 0] == np.arange(expected, expected + len(near)))
            limit = self._go(key, limit, near[:ready], out)
            near, expected = near[ready:], expected + int(ready)
            if len(out) >= MADE:
                yield self._rows(out)
                out.clear()
            if expected // SPAN == span:
                break
            if len(far) and far[0] == span + 1:
                near, far = self._stored(key, span + 1), far[1:]
                self.waiting.removeKey((key, span + 1))
        if len(calls):
            held = set(far.tolist())
            spans = calls[:, 0] // SPAN
            for later in np.split(calls, np.flatnonzero(np.diff(spans)) + 1):
                span = int(later[0, 0]) // SPAN
                self.waiting.updateValue((key, span), (packed(in_order(self._stored(key, span), later) if span in held else later),))
            far = np.union1d(far, spans)
        waits = len(near) > 0 or len(far) > 0
        self._keep(key, limit, expected, near, far, until if waits else 0)
        return waits

    def _take(self, frames: list[pd.DataFrame], until: int) -> Iterator[pd.DataFrame]:
        rows = pd.concat(frames) if len(frames) > 1 else frames[0]
        codes, keys = pd.factorize(rows["key"], use_na_sentinel=False)
        by = np.argsort(codes, kind="stable")
        calls = np.stack([rows[c].to_numpy("int64") for c in ("number", "blocks", "peak")], 1)[by]
        out, waiting = [], []
        for key, mine in zip(keys.tolist(), np.split(calls, np.flatnonzero(np.diff(codes[by])) + 1)):
            key = None if key != key else key  # pandas has NaN for null
            if (yield from self._settle(key, mine, until, out)):
                waiting.append(key)
        if out:
            yield self._rows(out)
        if until and waiting:
            piece = next(i for i in count() if not self.due.containsKey((until, i)))
            self.due.updateValue((until, piece), (waiting,))
            if piece == 0:
                self.handle.registerTimer(until)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentProcessingTimeInMs() + self.patience if self.patience else 0
        frames, n = [], 0
        for frame in rows:
            frames.append(frame)
            n += len(frame)
            if n >= HELD:
                yield from self._take(frames, until)
                frames, n = [], 0
        if frames:
            yield from self._take(frames, until)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, out = expiredTimerInfo.getExpiryTimeInMs(), []
        for piece in count():
            stored = self.due.getValue((at, piece))
            if stored is None:
                break
            self.due.removeKey((at, piece))
            for name in stored[0]:
                limit, expected, near, far, until = self._now(name)
                if until != at:  # calls came since, or none waits
                    continue
                for span in (None, *far.tolist()):
                    calls = near if span is None else self._stored(name, span)
                    limit = self._go(name, limit, calls, out)
                    if len(calls):
                        expected = int(calls[-1, 0]) + 1
                    if span is not None:
                        self.waiting.removeKey((name, span))
                    if len(out) >= MADE:
                        yield self._rows(out)
                        out.clear()
                self._keep(name, limit, expected, NONE, far[:0], 0)
        if out:
            yield self._rows(out)

    def _rows(self, out: list[tuple]) -> pd.DataFrame:
        keys, *numbers = zip(*out)
        return pd.DataFrame({self.key: pd.Series(keys, dtype=object)} | {c: np.array(x, "int64") for c, x in zip((self.order, "limit_before", "limit_after"), numbers)})

    def close(self) -> None:
        pass


def limit_stream(calls: DataFrame, key: str, order: str, blocks: str, peak: str, target: int, first: int, patience_ms: int = 0) -> DataFrame:
    """key, order, limit_before, limit_after of each call; the streaming twin of sequence.adaptive_limits over dense orders from 0.

    patience_ms: how long calls wait for a missing one; 0: for ever. A null number of blocks is 1, a null peak 0; null keys are a key; a call that comes twice,
    or after its key gave up on it, drops out. Needs the RocksDB state store. With patience, a stream runs batches without rows, too, as timers
    need them; one that is to end when all is read must turn these off (spark.sql.streaming.noDataMicroBatches.enabled).
    """
    kind = dict(calls.dtypes)[key]
    carried = "string" if kind in ("tinyint", "smallint", "int", "bigint") else kind  # pandas makes whole numbers beside nulls floats
    rows = calls.selectExpr(f"pmod(xxhash64(`{key}`), {PARTS}) as part", f"cast(`{key}` as {carried}) as key", f"cast(`{order}` as long) as number", f"cast(coalesce(`{blocks}`, 1) as long) as blocks", f"cast(coalesce(`{peak}`, 0) as long) as peak")
    calls.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = rows.groupBy("part").transformWithStateInPandas(LimitProcessor(key, carried, order, target, first, patience_ms), f"`{key}` {carried}, `{order}` long, limit_before long, limit_after long", "Append", "ProcessingTime" if patience_ms else "None")
    return out.withColumn(key, F.col(f"`{key}`").cast(kind))
