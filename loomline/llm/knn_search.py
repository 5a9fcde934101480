"""Exact top-k inner-product search as a Voronoi kNN join.

Vectors become whole numbers, floor(scale * component). A bounded set of pivots splits them into cells, each vector going
to its nearest pivot. A cell's summary holds its largest distance from the pivot and its nearest distances. From the
summaries alone a query knows a score that its k-th best candidate reaches at least, and the highest score that each cell
can hold: q.x lies within |q| * |x - p| of q.p. The query is copied only to cells that can still matter, and each cell is
solved locally by one matrix product per block. Cells are split into blocks of bounded size by a hash of the id, and the queries
into parts, so one cell may hold most of the data and a task holds a block and a part at most. Where vectors have no clusters, as
in high dimensions at random, the bounds leave out no cell and every query meets every block; the query set is a stated one.

Vectors that are null, or hold null or non-finite components, and rows with a null id take no part. Shorter vectors count
as zero beyond their end. Rows count, not ids: each row is a candidate, and where several rows share an id that is asked for, each
of them is a query with ranks of its own, and the others are candidates of it. Only a query's own row is no candidate of
it; queries without candidates return nothing. Ids that are texts count as their whole numbers, others take no part. Scores that
doubles cannot hold exactly are worked out in whole numbers; one that needs more than 64 bits is an error. Vectors of any
length are used whole; equal scores rank by smaller id. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import lean, materialise, table

K, SCALE, QUERY_STEP = 5, 256, 50
#: The most pivots, and about how many vectors and how many queries meet in one place.
PIVOTS, BLOCK, QUERIES = 64, 1 << 16, 1 << 15
#: Queries that are routed at once, and rows of a batch of routed ones.
ROUTED, COPIES = 256, 1 << 13


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of number lists as rows of doubles, zero beyond each list's end."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    out = np.zeros((len(size), width))
    at = np.repeat(np.arange(len(size)), size)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-numbered rows."""
    if not len(q) or not len(x) or np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1]) < 2.0**53:
        return (q @ x.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    exact = whole(q) @ whole(x).T
    if max(abs(s) for s in exact.ravel().tolist()) >= 2**63:
        raise OverflowError("an inner product needs more than 64 bits")
    return exact.astype(np.int64)


def quantised(df: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (the whole-numbered vector) and row (a number of its own) of the rows that take part."""
    x = F.transform(vector_col, lambda c: c.cast("double"))
    ok = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    # doubles from 2 ** 52 on are whole numbers already
    whole = F.transform(x, lambda c: F.when(F.abs(c * F.lit(float(scale))) < 2.0**52, F.floor(c * F.lit(float(scale))).cast("double")).otherwise(c * F.lit(float(scale))))
    if df.schema[id_col].dataType.simpleString() == "string":
        df = df.withColumn(id_col, F.col(id_col).try_cast("long"))
        ok = F.col(id_col).isNotNull() & ok
    return df.filter(ok).select(F.col(id_col).alias("vec_id"), whole.alias("v"), F.monotonically_increasing_id().alias("row"))


def top_k(df: DataFrame, k: int = K, query_step: int = QUERY_STEP, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows for each row whose id is divisible by query_step; ties to smaller ids."""
    spark = df.sparkSession
    data, _ = materialise(quantised(df, scale, id_col, vector_col), "vectors")
    facts = data.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    n, width = facts["n"], max(1, facts["width"] or 1)
    some = data.select("v").distinct().orderBy(F.xxhash64("v")).limit(int(min(pivots, max(1, n**0.5)))).collect()
    p = np.zeros((max(1, len(some)), width))
    for i, r in enumerate(some):
        p[i, : len(r["v"])] = r["v"]
    kinds = dict(data.dtypes)
    ids = kinds["vec_id"]

    def assign(batches):
        for b in batches:
            x = matrix(b.column(1), width)
            far = np.maximum((x * x).sum(1)[:, None] - 2 * (x @ p.T) + (p * p).sum(1)[None, :], 0)
            cell = far.argmin(1)
            d = np.sqrt(((x - p[cell]) ** 2).sum(1))
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(cell, pa.int32()), pa.array(d * (1 + 1e-9) + 1e-6)], names=["vec_id", "v", "row", "cell", "d"])

    celled, _ = materialise(data.select("vec_id", "v", "row").mapInArrow(lean(assign), f"vec_id {ids}, v array<double>, row long, cell int, d double"), "cells")

    def summarise(batches):
        found: dict[int, list] = {}
        for b in batches:
            cell, d = b.column(0).to_numpy(), b.column(1).to_numpy()
            for c in np.unique(cell).tolist():
                own = d[cell == c]
                old = found.get(c, [0, 0.0, np.empty(0)])
                found[c] = [old[0] + len(own), max(old[1], float(own.max())), np.sort(np.concatenate([old[2], own]))[: k + 1]]
        out = [(c, x[0], x[1], x[2]) for c, x in found.items()]
        yield pa.record_batch([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.float64()), pa.array([x[3] for x in out], pa.list_(pa.float64()))], names=["cell", "n", "far", "near"])

    near = F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k + 1)  # k + 1 numbers from each task
    cells = celled.select("cell", "d").mapInArrow(lean(summarise), "cell int, n long, far double, near array<double>").groupBy("cell").agg(F.sum("n").alias("n"), F.max("far").alias("far"), near.alias("near")).collect()
    number = np.array([c["cell"] for c in cells], np.int64)
    far = np.array([c["far"] for c in cells])
    blocks = {c["cell"]: 1 + c["n"] // block for c in cells}
    low_cell = np.repeat(np.arange(len(cells)), [len(c["near"]) for c in cells])
    low_d = np.array([d for c in cells for d in c["near"]])

    def near_blocks(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The blocks of every cell that may hold one of a query's best: query, cell, block."""
        norm = np.sqrt((q * q).sum(1)) * (1 + 1e-9)
        at_pivot = q @ p[number].T
        least = np.sort(at_pivot[:, low_cell] - norm[:, None] * low_d[None, :], axis=1)
        # the k + 1 best of known rows reach this; one of them may be the query itself
        sure = least[:, -(k + 1)] if least.shape[1] > k else np.full(len(q), -np.inf)
        reach = at_pivot + norm[:, None] * far[None, :]
        row, at = np.nonzero(reach >= (sure - 1e-6 * (1 + np.abs(sure)))[:, None])
        times = several[at]
        return np.repeat(row, times), np.repeat(number[at], times), np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)

    def route(batches):
        """Each query once for each block; a batch that leaves holds a bounded number of rows."""
        for b in batches:
            for lo in range(0, b.num_rows, ROUTED):
                own = b.slice(lo, ROUTED)
                row, cell, at = near_blocks(matrix(own.column(1), width))
                for s in range(0, len(row), COPIES):
                    some = pa.array(row[s : s + COPIES])
                    yield pa.record_batch([*(own.column(c).take(some) for c in range(4)), pa.array(cell[s : s + COPIES], pa.int32()), pa.array(at[s : s + COPIES], pa.int32())], names=["query_id", "q", "asker", "part", "cell", "block"])

    def wanted(batches):
        """Which blocks the queries of a part go to, without the queries."""
        seen: set[tuple[int, int, int]] = set()
        for b in batches:
            for lo in range(0, b.num_rows, ROUTED):
                own = b.slice(lo, ROUTED)
                row, cell, at = near_blocks(matrix(own.column(1), width))
                seen.update(zip(cell.tolist(), at.tolist(), own.column(3).to_numpy()[row].tolist()))
            yield pa.record_batch([pa.array([x[i] for x in seen], pa.int32()) for i in range(3)], names=["cell", "block", "part"])
            seen = set()

    several = np.array([blocks[c["cell"]] for c in cells], np.int64)
    split = F.create_map(*[F.lit(x) for c in blocks.items() for x in c]) if blocks else F.create_map(F.lit(0), F.lit(1))
    asks = data.filter(F.col("vec_id") % query_step == 0)
    parts = 1 + asks.count() // queries  # queries are split too: every block meets each part of them by itself
    asks = asks.select("vec_id", "v", "row", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(parts)).cast("int").alias("part"))
    met = asks.mapInArrow(lean(wanted), "cell int, block int, part int").distinct()
    rows = celled.select("vec_id", "v", "row", "cell", F.pmod(F.xxhash64("row"), split[F.col("cell")]).cast("int").alias("block"))
    held = rows.join(met, ["cell", "block"])  # a block goes only to the parts that ask for it
    asked = asks.mapInArrow(lean(route), f"query_id {ids}, q array<double>, asker long, part int, cell int, block int")

    def solve(queries: pa.Table, rows: pa.Table) -> pa.Table:
        asker, vid, row = queries["asker"].to_numpy(), rows["vec_id"].to_numpy(), rows["row"].to_numpy()
        q = matrix(queries["q"].combine_chunks(), width) if len(asker) else np.zeros((0, width))
        order = np.argsort(vid, kind="stable")
        vid, row = vid[order], row[order]
        x = (matrix(rows["v"].combine_chunks(), width) if len(vid) else np.zeros((0, width)))[order]
        of, found, scores = [], [], []
        for lo in range(0, len(asker), 256):
            score = products(q[lo : lo + 256], x)
            for i, own in enumerate(score):
                others = np.flatnonzero(row != asker[lo + i])
                s = own[others]
                if len(s) > k:
                    cut = np.partition(s, -k)[-k]
                    others, s = others[s >= cut], s[s >= cut]
                best = np.lexsort((vid[others], -s))[:k]
                of += [lo + i] * len(best)
                found += vid[others[best]].tolist()
                scores += s[best].tolist()
        of = pa.array(of, pa.int64())
        return pa.table({"query_id": queries["query_id"].take(of), "asker": queries["asker"].take(of), "vec_id": pa.array(found, rows.schema.field("vec_id").type), "score": pa.array(scores, pa.int64())})

    local = asked.groupBy("cell", "block", "part").cogroup(held.groupBy("cell", "block", "part")).applyInArrow(lean(solve), f"query_id {ids}, asker long, vec_id {ids}, score long")
    best = Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_knn_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns query_id, rank, vec_id, score."""
    return top_k(table(spark, "embeddings")(sf_dir))


SQL = """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.row AS asker, q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e) AS score FROM v AS q JOIN v ON q.row <> v.row WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY asker ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score::BIGINT AS score FROM r WHERE rank <= 5
"""
