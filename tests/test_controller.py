"""The controller's waiting calls: kept by spans, with few calls to the state store, whatever the order of arrival."""

import random
from collections import Counter

import pandas as pd
import pytest

from loomline.operators.sequence import next_limit
from loomline.streaming import controller
from loomline.streaming.stateful import drain


class Map:
    """A map state of one part that counts what is asked of it."""

    def __init__(self, asked):
        self.asked, self.pairs = asked, {}

    def _ask(self, x):
        self.asked["state"] += 1
        return x

    def containsKey(self, key):
        return self._ask(key in self.pairs)

    def getValue(self, key):
        return self._ask(self.pairs.get(key))

    def updateValue(self, key, value):
        self.pairs[key] = self._ask(value)

    def removeKey(self, key):
        del self.pairs[self._ask(key)]


class Part:
    """A part's handle, clock and expired timer."""

    def __init__(self, patience=0):
        self.asked, self.maps, self.timers, self.clock = Counter(), {}, [], 100
        self.processor = controller.LimitProcessor("u", "string", "i", 100, 4, patience)
        self.processor.init(self)

    def getMapState(self, name, key, value):
        return self.maps.setdefault(name, Map(self.asked))

    def registerTimer(self, at):
        self.timers.append(at)

    def getCurrentProcessingTimeInMs(self):
        return self.clock

    def getExpiryTimeInMs(self):
        return self.clock

    def take(self, batch, rows=7):
        frames = (pd.DataFrame(batch[lo : lo + rows], columns=["key", "number", "blocks", "peak"]) for lo in range(0, len(batch), rows))
        return [tuple(r) for f in self.processor.handleInputRows((0,), frames, self) for r in f.values.tolist()]

    def expire(self, at):
        self.clock = self.timers.pop(self.timers.index(at))
        return [tuple(r) for f in self.processor.handleExpiredTimer(key=(0,), timerValues=self, expiredTimerInfo=self) for r in f.values.tolist()]


def told(calls):
    limits, out = {}, []
    for key, number, blocks, peak in sorted(calls, key=lambda c: (str(c[0]), c[1])):
        before = limits.get(key, 4)
        limits[key] = next_limit(before, blocks, peak, 100)
        out.append((key, number, before, limits[key]))
    return out


def in_order(rows):
    return sorted(rows, key=lambda c: (str(c[0]), c[1]))


def made(n, seed, keys=("a",)):
    r = random.Random(seed)
    return [(k, i, r.choice([1, 3, 8]), r.choice([0, 20, 60, 90, 130, 400])) for k in keys for i in range(n)]


def test_waiting_calls_cost_few_calls_to_the_store():
    calls = made(600, 1)
    part = Part()
    assert part.take(calls[:0:-1], 100) == []
    assert part.take(calls[:1]) == told(calls)
    assert part.asked["state"] <= 4


@pytest.mark.parametrize("span, held, rows", [(1, 1, 1), (4, 5, 3), (4, 1 << 18, 10_000), (16, 9, 10_000), (1 << 10, 30, 10)])
def test_calls_in_any_order_and_batch(monkeypatch, span, held, rows):
    for name, x in (("SPAN", span), ("HELD", held), ("MADE", rows)):
        monkeypatch.setattr(controller, name, x)
    for seed in range(12):
        r, calls = random.Random(seed), made(30 + seed, seed, ("a", None, "b"))
        dealt = [*calls, *r.sample(calls, 9)]
        r.shuffle(dealt)
        part = Part()
        cuts = sorted(r.sample(range(len(dealt)), 4))
        got = [x for lo, hi in zip([0, *cuts], [*cuts, len(dealt)]) for x in part.take(dealt[lo:hi])]
        assert in_order(got) == told(calls)
        assert not part.maps["waiting"].pairs and all(not near and not far for _, _, near, far, _ in part.maps["now"].pairs.values())


def test_first_of_calls_with_the_same_number_stays(monkeypatch):
    monkeypatch.setattr(controller, "SPAN", 2)
    part = Part()
    for batch in ([("a", 1, 1, 400), ("a", 5, 1, 400)], [("a", 1, 1, 0), ("a", 5, 1, 0), ("a", 5, 8, 0)]):
        assert part.take(batch) == []
    rest = [("a", 0, 1, 0), ("a", 2, 1, 0), ("a", 3, 1, 0), ("a", 4, 8, 130)]
    assert part.take(rest) == told([*rest, ("a", 1, 1, 400), ("a", 5, 1, 400)])


@pytest.mark.parametrize("span, held", [(1, 1 << 18), (4, 3), (1 << 10, 1 << 18)])
def test_keys_that_give_up(monkeypatch, span, held):
    monkeypatch.setattr(controller, "SPAN", span)
    monkeypatch.setattr(controller, "HELD", held)
    calls = made(30, 5, ("a", None))
    late = [c for c in calls if c[1] in (3, 4, 17)]
    come = [c for c in calls if c not in late]
    part = Part(patience=5)
    assert part.take(come[:0:-1], 3) == [x for x in told(come) if x[0] is None and x[1] < 3]
    part.clock = 103
    got = part.take([("b", 1, 1, 0), come[0]])  # a waits on, from now; the null key doesn't
    assert got == [x for x in told(come) if x[0] == "a" and x[1] < 3] and part.timers == [105, 108]
    assert part.expire(105) == [x for x in told(come) if x[0] is None and x[1] > 4]
    assert in_order(part.expire(108)) == [x for x in told(come) if x[0] == "a" and x[1] > 4] + told([("b", 1, 1, 0)])
    assert not part.maps["waiting"].pairs and not part.maps["due"].pairs
    assert part.take(late) == [] and part.timers == []
    assert part.take([("a", 30, 1, 400)]) == [x for x in told([*come, ("a", 30, 1, 400)]) if x[:2] == ("a", 30)]


def test_spans_in_the_state_store(spark, tmp_path):
    calls = made(3 * controller.SPAN - 50, 3, (1 << 60, (1 << 60) + 1, None))
    dealt = [*calls]
    random.Random(4).shuffle(dealt)
    third = len(dealt) // 3 + 1
    for lo in range(0, len(dealt), third):
        spark.createDataFrame(dealt[lo : lo + third], "u long, i long, b long, p long").coalesce(1).write.mode("append").parquet(str(tmp_path / "calls"))
    stream = spark.readStream.schema("u long, i long, b long, p long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "calls"))
    got = drain(controller.limit_stream(stream, "u", "i", "b", "p", 100, 4))
    assert got.dtypes == [("u", "bigint"), ("i", "bigint"), ("limit_before", "bigint"), ("limit_after", "bigint")]
    assert in_order(map(tuple, got.collect())) == told(calls)
