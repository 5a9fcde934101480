"""Exact corpus-wide totals of 64-bit keys, handed back to the documents that hold them.

Documents are dealt to chunks by a hash of their row. Each chunk sorts and pre-aggregates its own keys, so that a key
that fills a third of the corpus leaves each chunk once, and sends one packed block to every key range ("bucket"). A bucket
adds up its blocks and sends the totals back in the blocks' own order; the chunk lines them up with its keys again, which
it recomputes. Texts cross the network once: both uses of the chunks share one exchange.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import lean, partitions

#: The keys of a chunk's rows, repeats included, and whatever the later steps need of them.
Keys = Callable[[pa.Table], tuple[np.ndarray, Any]]
#: More keys of a chunk, chosen by the totals of its first ones.
MoreKeys = Callable[[Any, np.ndarray], np.ndarray]
Finish = Callable[..., pa.Table]


def pack(x: np.ndarray) -> bytes:
    """Numbers as compressed byte planes; good for small numbers and for differences of sorted ones."""
    planes = np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each occurs."""
    s = np.sort(keys)
    if not len(s):
        return s, np.empty(0, np.uint64)
    at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    return s[at], np.diff(np.append(at, len(s))).astype(np.uint64)


def _bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's part of sorted keys begins; bucket b holds an equal share of the 64-bit range."""
    edges = np.array([(b << 64) // buckets for b in range(buckets)], np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


def chunked(df: DataFrame, columns: list[str], chunks: int) -> DataFrame:
    """The named columns and a chunk number, a hash of the row: equal rows share a chunk, all others spread evenly."""
    return df.select(F.pmod(F.xxhash64(*columns), F.lit(chunks)).cast("int").alias("chunk"), *columns)


def chunk_count(spark: SparkSession) -> int:
    """Half as many again as partitions, so that the hashes of chunk numbers load them evenly enough."""
    return (3 * partitions(spark) + 1) // 2


def with_totals(df: DataFrame, columns: list[str], keys: Keys, finish: Finish, schema: str, more: MoreKeys | None = None, buckets: int | None = None, chunks: int | None = None) -> DataFrame:
    """chunk_totals() for rows that are not yet dealt to chunks."""
    return chunk_totals(chunked(df, columns, chunks or chunk_count(df.sparkSession)), keys, finish, schema, more, buckets)


def chunk_totals(rows: DataFrame, keys: Keys, finish: Finish, schema: str, more: MoreKeys | None = None, buckets: int | None = None) -> DataFrame:
    """Applies ``finish(rows, state, totals)`` to each chunk of rows; with more keys ``finish(rows, state, totals, totals of those)``.

    totals: how often each key occurs in the whole table, in the order in which the keys were given.
    buckets and chunks follow the number of shuffle partitions, so that they grow with the cluster's setting for the data;
    every chunk sends every bucket one row.
    """
    buckets = buckets or partitions(rows.sparkSession)
    fewer = max(1, buckets // 4)  # for the second keys, which are far fewer

    def blocks(chunk: int, found: np.ndarray, buckets: int) -> pa.Table:
        own, n = distinct(found)
        at = _bounds(own, buckets)
        out = [(b, chunk, pack(np.diff(own[s:e], prepend=np.uint64(0))), pack(n[s:e])) for b, (s, e) in enumerate(zip(at[:-1], at[1:])) if e > s]
        kinds = (("bucket", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("n", pa.binary()))
        return pa.table({name: pa.array([x[i] for x in out], kind) for i, (name, kind) in enumerate(kinds)})

    def aligned(found: np.ndarray, got: pa.Table, turn: int) -> np.ndarray:
        """The totals of a chunk's keys from the buckets' answers."""
        order = np.argsort(found)
        s = found[order]
        at = np.cumsum(np.concatenate([[False], s[1:] != s[:-1]])) if len(s) else order
        answers = [(b, x) for t, b, x in zip(got["turn"].to_pylist(), got["bucket"].to_pylist(), got["total"].to_pylist()) if t == turn]
        totals = np.concatenate([unpack(x) for _, x in sorted(answers)]) if answers else np.empty(0, np.uint64)
        out = np.empty(len(found), np.uint64)
        out[order] = totals[at]
        return out

    def send(group: pa.Table) -> pa.Table:
        return blocks(group["chunk"][0].as_py(), keys(group)[0], buckets)

    def send_more(group: pa.Table, got: pa.Table) -> pa.Table:
        found, state = keys(group)
        return blocks(group["chunk"][0].as_py(), more(state, aligned(found, got, 1)), fewer)

    def adder(turn: int):
        def add(group: pa.Table) -> pa.Table:
            own = [np.cumsum(unpack(x), dtype=np.uint64) for x in group["keys"].to_pylist()]
            ends = np.cumsum([len(x) for x in own])
            own = np.concatenate(own)
            n = np.concatenate([unpack(x) for x in group["n"].to_pylist()])
            order = np.argsort(own)
            s = own[order]
            run = np.cumsum(np.concatenate([[False], s[1:] != s[:-1]]))
            sums = np.bincount(run, weights=n[order]).astype(np.uint64)  # exact below 2 ** 53
            total = np.empty(len(own), np.uint64)
            total[order] = sums[run]
            answer = [pack(total[s:e]) for s, e in zip(np.concatenate([[0], ends[:-1]]), ends)]
            return pa.table({"chunk": group["chunk"].combine_chunks(), "bucket": group["bucket"].combine_chunks(), "turn": pa.array([turn] * len(answer), pa.int32()), "total": pa.array(answer, pa.binary())})

        return add

    def back(group: pa.Table, got: pa.Table) -> pa.Table:
        found, state = keys(group)
        first = aligned(found, got, 1)
        return finish(group, state, first) if more is None else finish(group, state, first, aligned(more(state, first), got, 2))

    block, answer = "bucket int, chunk int, keys binary, n binary", "chunk int, bucket int, turn int, total binary"
    totals = rows.groupBy("chunk").applyInArrow(lean(send), block).groupBy("bucket").applyInArrow(lean(adder(1)), answer)
    if more is not None:
        second = rows.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(lean(send_more), block)
        totals = totals.union(second.groupBy("bucket").applyInArrow(lean(adder(2)), answer))
    return rows.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(lean(back), schema)
