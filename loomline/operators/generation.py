"""Speech generation as a stage of the plan: an adapter on the executors, measured windows, assets made only where they are stale."""

from __future__ import annotations

import json
import subprocess
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import slices
from .registry import stale

#: Bytes of text whose sound is held at a time: samples are many times as large.
HEARD = 1 << 14


class Adapter(Protocol):
    """What a speech generator must do. It is sent to the executors, so it must be picklable, and loads its model when first used."""

    rate: int

    def generate(self, texts: list[str], voices: list[str | None]) -> list[list[float]]: ...


class CountingAdapter:
    """A stand-in for a generator: per_char samples of silence for each character."""

    def __init__(self, per_char: int, rate: int):
        self.per_char, self.rate = per_char, rate

    def generate(self, texts: list[str], voices: list[str | None]) -> list[list[float]]:
        return [[0.0] * (self.per_char * len(t)) for t in texts]


class Worker:
    """A process that answers JSON lines: one request a line, its answer the first line that is JSON with the request's id."""

    def __init__(self, command: list[str]):
        self.command, self.process, self.last = command, None, 0

    def __getstate__(self):
        return {"command": self.command, "process": None, "last": 0}

    def ask(self, kind: str, payload: dict) -> dict:
        if self.process is None:
            self.process = subprocess.Popen(self.command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True)
        self.last += 1
        self.process.stdin.write(json.dumps({"id": self.last, "command": kind, "payload": payload}) + "\n")
        self.process.stdin.flush()
        for line in self.process.stdout:
            try:
                answer = json.loads(line)
            except ValueError:
                continue  # a log line
            if isinstance(answer, dict) and answer.get("id") == self.last:
                if answer.get("error"):
                    raise RuntimeError(answer["error"])
                return answer.get("result") or {}
        raise RuntimeError("the worker ended without an answer")

    def close(self) -> None:
        if self.process is not None:
            self.process.stdin.close()
            self.process.wait(timeout=10)
            self.process.stdout.close()
            self.process = None


def generated(df: DataFrame, text: str, voice: str, adapter: Adapter, keep_samples: bool = False) -> DataFrame:
    """df with n_samples, sample_rate and, if asked for, the samples of each row, generated for so much text at a time as its sound can be held for."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in slices(batches, text, HEARD):
            names = b.schema.names
            made = adapter.generate([t or "" for t in b.column(names.index(text)).to_pylist()], b.column(names.index(voice)).to_pylist())
            more = [pa.array([len(x) for x in made], pa.int64()), pa.array([adapter.rate] * len(made), pa.int64())]
            yield pa.record_batch([*b.columns, *more, *([pa.array(made, pa.list_(pa.float32()))] if keep_samples else [])], names=[*names, "n_samples", "sample_rate", *(["samples"] if keep_samples else [])])

    return df.mapInArrow(run, f"{fields}, n_samples long, sample_rate long" + ", samples array<float>" * keep_samples)


def measured(df: DataFrame, key: str, order: str, text: str, adapter: Adapter, speed: float = 1.0, warm_up: bool = True, clock: Callable[[], float] = time.perf_counter) -> DataFrame:
    """One row per window (key) of units: n_units, n_chars, seconds, playback, success, error. The first one of a Python worker may be
    run once unmeasured before; a failure there or later is a row, not an end."""
    kind = df.schema[key].dataType.simpleString()
    warm: list[str] = []

    def run(group: pa.Table) -> pa.Table:
        texts = [t or "" for t in group.sort_by(order)[text].to_pylist()]
        seconds = playback = 0.0
        error = None
        try:
            if warm_up and not warm:
                adapter.generate(texts[:1], [None])
                warm.append("done")
            began = clock()
            made = adapter.generate(texts, [None] * len(texts))
            seconds = clock() - began
            playback = sum(map(len, made)) / adapter.rate / max(0.1, speed)
        except Exception as e:  # a failing generator is a result  # noqa: BLE001
            error = f"{type(e).__name__}: {e}"
        row = {"n_units": len(texts), "n_chars": sum(map(len, texts)), "seconds": seconds, "playback": playback, "success": error is None, "error": error}
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.string())
        return pa.table([group[key].slice(0, 1), *(pa.array([v], k) for v, k in zip(row.values(), kinds))], names=[key, *row])

    return df.select(key, order, text).groupBy(key).applyInArrow(run, f"`{key}` {kind}, n_units long, n_chars long, seconds double, playback double, success boolean, error string")


def assets(current: DataFrame, stored: DataFrame, key: str, digest: str, text: str, voice: str, adapter: Adapter) -> DataFrame:
    """key, status, n_samples: cached where the stored digest still holds, else complete, made anew."""
    due = stale(current.select(key, digest), stored, key, digest).select(key)
    made = generated(current.join(due, key), text, voice, adapter).select(key, F.lit("complete").alias("status"), "n_samples")
    kept = current.join(due, key, "left_anti").select(key, F.lit("cached").alias("status"), F.lit(None).cast("long").alias("n_samples"))
    return made.unionByName(kept)
