"""Centroid clustering of whole-numbered vectors by ball-tree filtering, exact to the last tie.

Vectors become whole numbers, floor(scale * component). Each task packs its rows, ``TREE_ROWS`` at a time, into metric trees:
a node stores the radius of its ball, the count of its vectors and their integer sum, and the vectors lie in the order of the
leaves. Trees are built once and written to the shared folder; a round walks them all. A ball whose vectors are, by the triangle
inequality, nearer to one centroid than to any other goes there as a whole, with its count and sum; centroids that can't be
nearest anywhere in a ball are dropped on the way down, and what reaches a leaf undecided is compared exactly in integers.
Only k counts and sums of each task are shuffled, and k rows reach the driver. A tree is a bounded batch of rows in
the order they are read, so a vector that a third of all rows repeat is spread over as many trees as it fills, each a single ball there.

Vectors that are null, of another length, or hold null or non-finite components take no part. Rows count, not ids: repeated rows
are clustered each on its own. Rows with a null id are clustered but can't start a centroid. Starting rows of equal ids have equal hashes and
stand in the order of their vectors. Equal distances go to the smaller number. With fewer rows than centroids all rows start one;
an empty table gives an empty one. A component of 2 ** 27 or more after scaling is an error, as
distances would not fit into 64 bits. Only the two named columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import lean, materialise, table

K, ROUNDS, WIDTH, SCALE = 16, 3, 64, 64
#: Vectors of a tree, and of a leaf.
TREE_ROWS, LEAF = 1 << 14, 32
LIMIT = 1 << 27
#: What distances in doubles may be off by, at most, relative to the largest terms.
SLACK = 1e-9


class Tree:
    """Nodes in preorder: low and high (its vectors are x[low:high]), skip (the node after its subtree), radius, and total, the integer sum; count is high - low."""

    KINDS = {"x": "<i4", "low": "<i4", "high": "<i4", "skip": "<i4", "radius": "<f8", "total": "<i8"}

    def __init__(self, x, low, high, skip, radius, total):
        self.x, self.low, self.high, self.skip, self.radius, self.total = x, low, high, skip, radius, total

    @classmethod
    def build(cls, x: np.ndarray, leaf: int = LEAF) -> tuple[Tree, np.ndarray]:
        """A tree of whole-numbered vectors, and the order in which it holds them.

        A ball is split between two far vectors, each vector going to the nearer one; where this tells none apart, the ball stays a leaf.
        """
        order = np.arange(len(x))
        nodes: list[list] = []
        todo = [(0, len(x), -1)]
        parents = []
        while todo:
            low, high, parent = todo.pop()
            own = x[order[low:high]].astype(np.float64)
            total = own.sum(0)
            centre = total / (high - low)
            far = ((own - centre) ** 2).sum(1)
            radius = float(np.sqrt(far.max())) * (1 + SLACK)
            nodes.append([low, high, radius, total])
            parents.append(parent)
            if high - low <= leaf or radius == 0:
                continue
            one = own[far.argmax()]
            to_one = ((own - one) ** 2).sum(1)
            other = own[to_one.argmax()]
            right = ((own - other) ** 2).sum(1) < to_one
            n = int(right.sum())
            if not n or n == high - low:
                continue
            order[low:high] = np.concatenate([order[low:high][~right], order[low:high][right]])
            here = len(nodes) - 1
            todo += [(high - n, high, here), (low, high - n, here)]
        skip = np.arange(1, len(nodes) + 1)
        for i in range(len(nodes) - 1, 0, -1):
            skip[parents[i]] = max(skip[parents[i]], skip[i])
        return cls(x[order].astype("<i4"), *(np.array([n[k] for n in nodes]) for k in (0, 1)), skip, np.array([n[2] for n in nodes]), np.array([n[3] for n in nodes]).astype(np.int64)), order

    def pack(self) -> list[bytes]:
        return [np.ascontiguousarray(getattr(self, name)).astype(kind).tobytes() for name, kind in self.KINDS.items()]

    @classmethod
    def unpack(cls, parts: list[bytes], width: int) -> Tree:
        return cls(*(np.frombuffer(p, kind).reshape(-1, width) if name in ("x", "total") else np.frombuffer(p, kind) for (name, kind), p in zip(cls.KINDS.items(), parts)))

    def assign(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The nearest centroid of each vector; counts and integer sums of the clusters; how many vectors were settled in whole balls."""
        k = len(centroids)
        cluster, count, total = np.zeros(len(self.x), np.int32), np.zeros(k, np.int64), np.zeros((k, self.x.shape[1]), np.int64)
        size = (self.high - self.low).astype(np.int64)
        if not k or not len(self.x):
            return cluster, count, total, 0
        centre = self.total / np.maximum(size, 1)[:, None]
        c = centroids.astype(np.float64)
        away = np.sqrt(np.maximum((centre**2).sum(1)[:, None] - 2 * (centre @ c.T) + (c**2).sum(1), 0))
        # root of a difference of squares: its error is bounded by the root of the terms' error
        slack = np.sqrt(SLACK * ((centre**2).sum(1) + (c**2).sum(1).max())) + 1e-6
        possible: list[np.ndarray] = []
        settled, node = 0, 0
        stack: list[tuple[int, np.ndarray]] = [(len(self.low), np.arange(k))]
        while node < len(self.low):
            while node >= stack[-1][0]:
                stack.pop()
            possible = stack[-1][1]
            d = away[node, possible]
            best = d.argmin()
            keep = d - self.radius[node] - slack[node] <= d[best] + self.radius[node] + slack[node]
            possible = possible[keep]
            low, high = int(self.low[node]), int(self.high[node])
            if len(possible) == 1:
                own = int(possible[0])
                cluster[low:high] = own
                count[own] += high - low
                total[own] += self.total[node]
                settled += high - low
                node = int(self.skip[node])
                continue
            if self.skip[node] == node + 1:  # a leaf; equal vectors of any number are one comparison
                near = nearest(self.x[low : low + 1] if self.radius[node] == 0 else self.x[low:high], centroids[possible])[0]
                near = np.broadcast_to(possible[near], high - low)
                cluster[low:high] = near
                for own in np.unique(near).tolist():
                    count[own] += int((near == own).sum())
                    total[own] += self.x[low:high][near == own].sum(0, dtype=np.int64)
            else:
                stack.append((int(self.skip[node]), possible))
            node += 1
        return cluster, count, total, settled


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, ties to the smaller number, and the squared distance, in whole numbers."""
    x, c = x.astype(np.int64), centroids.astype(np.int64)
    d = np.stack([((x - one) ** 2).sum(1) for one in c], 1)
    at = d.argmin(1)
    return at, d[np.arange(len(x)), at]


def whole_numbers(df: DataFrame, scale: int, width: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and v, the whole-numbered vector, of the rows that take part."""
    x = F.transform(vector_col, lambda c: c.cast("double"))
    ok = F.col(vector_col).isNotNull() & (F.size(vector_col) == width) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    wide = F.raise_error(F.lit(f"a component of {LIMIT} or more after scaling: distances would not fit into 64 bits")).cast("int")
    return df.filter(ok).select(F.col(id_col).alias("vec_id"), F.transform(x, lambda c: F.when(F.abs(c * float(scale)) < LIMIT, F.floor(c * float(scale)).cast("int")).otherwise(wide)).alias("v"))


def plant(vectors: DataFrame, width: int, tree_rows: int = TREE_ROWS, leaf: int = LEAF) -> DataFrame:
    """Metric trees over the rows of each partition: ids in the trees' order, and their arrays."""

    def run(batches):
        def grow(ids, xs):
            x = np.concatenate(xs)
            tree, order = Tree.build(x, leaf)
            return pa.record_batch([pa.array([pa.concat_arrays(ids).take(pa.array(order)).to_pylist()], pa.list_(ids[0].type)), *(pa.array([p], pa.binary()) for p in tree.pack())], names=["ids", *Tree.KINDS])

        ids, xs, n = [], [], 0
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            lo = 0
            while lo < len(x):
                hi = min(len(x), lo + tree_rows - n)
                ids.append(b.column(0).slice(lo, hi - lo))
                xs.append(x[lo:hi])
                n, lo = n + hi - lo, hi
                if n == tree_rows:
                    yield grow(ids, xs)
                    ids, xs, n = [], [], 0
        if n:
            yield grow(ids, xs)

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(lean(run), f"ids array<{kind}>, " + ", ".join(f"{name} binary" for name in Tree.KINDS))


def _trees(batch, width: int):
    for i in range(batch.num_rows):
        yield i, Tree.unpack([batch.column(k)[i].as_buffer() for k in range(batch.num_columns - len(Tree.KINDS), batch.num_columns)], width)


def step(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """cluster, n, total and settled (vectors that went in whole balls) of one round, one row for each cluster that has vectors."""
    width = centroids.shape[1]

    def run(batches):
        count, total, whole = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64), 0
        for b in batches:
            for _, tree in _trees(b, width):
                _, n, s, settled = tree.assign(centroids)
                count, total, whole = count + n, total + s, whole + settled
        own = np.flatnonzero(count)
        yield pa.record_batch([pa.array(own, pa.int32()), pa.array(count[own]), pa.array(list(total[own]), pa.list_(pa.int64())), pa.array(np.where(own == own[:1], whole, 0) if len(own) else [], pa.int64())], names=["cluster", "n", "total", "settled"])

    parts = trees.select(*Tree.KINDS).mapInArrow(lean(run), "cluster int, n long, total array<long>, settled long")
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(width)]).alias("total"), F.sum("settled").alias("settled"))


def start(vectors: DataFrame, k: int) -> np.ndarray:
    """The vectors of the k smallest hashes of ids."""
    text = F.concat(F.lit("1:"), F.col("vec_id").cast("string"))
    rows = vectors.filter(F.col("vec_id").isNotNull()).orderBy(F.sha2(text, 256), "v").limit(k).select("v").collect()
    return np.array([r["v"] for r in rows], np.int64)


def fit(trees: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids after so many rounds; a mean is floor(sum / count), exactly."""
    centroids = centroids.copy()
    for _ in range(rounds if len(centroids) else 0):
        for r in step(trees, centroids).collect():
            centroids[r["cluster"]] = [s // r["n"] for s in r["total"]]
    return centroids


def assign(trees: DataFrame, centroids: np.ndarray, kind: str) -> DataFrame:
    """vec_id, cluster, distance of every vector."""
    width = centroids.shape[1] if len(centroids) else WIDTH

    def run(batches):
        for b in batches:
            for i, tree in _trees(b, width):
                cluster = tree.assign(centroids)[0]
                distance = ((tree.x.astype(np.int64) - centroids[cluster]) ** 2).sum(1)
                yield pa.record_batch([b.column(0).slice(i, 1).flatten(), pa.array(cluster), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return trees.mapInArrow(lean(run), f"vec_id {kind}, cluster int, distance long")


def cluster(df: DataFrame, k: int = K, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", tree_rows: int = TREE_ROWS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster, distance of every vector that takes part, and the final centroids."""
    vectors = whole_numbers(df, scale, width, id_col, vector_col)
    trees, _ = materialise(plant(vectors, width, tree_rows), "trees")
    centroids = fit(trees, start(vectors, k), rounds)
    if not len(centroids):  # no ids to start from
        return vectors.select("vec_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")), centroids
    return assign(trees, centroids, vectors.schema["vec_id"].dataType.simpleString()), centroids


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    found, centroids = cluster(table(spark, "embeddings")(sf_dir))
    found, _ = materialise(found, "clusters")
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()  # k rows at most
    whole = sum(r["inertia"] for r in sums if r["inertia"] is not None) if len(centroids) else None
    text = [",".join(map(str, c.tolist())) for c in centroids]
    facts = spark.createDataFrame([(r["cluster"], r["inertia"], whole, hashlib.sha256(text[r["cluster"]].encode()).hexdigest()) for r in sums if r["cluster"] is not None], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster", "left").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    ctes = [
        f"v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings"
        f" WHERE embedding IS NOT NULL AND len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), e) - 1 AS cluster, e AS c FROM v WHERE vec_id IS NOT NULL ORDER BY 1 LIMIT {K})",
    ]
    for i in range(ROUNDS + 1):
        away = "list_sum(list_transform(range(1, len(v.e) + 1), lambda i: (v.e[i] - c.c[i]) * (v.e[i] - c.c[i])))::BIGINT"
        ctes.append(f"a{i} AS (SELECT row, any_value(vec_id) AS vec_id, any_value(e) AS e, min({{'d': d, 'cluster': cluster}}) AS best FROM (SELECT v.row, v.vec_id, v.e, c.cluster, {away} AS d FROM v, c{i} AS c) GROUP BY row)")
        if i < ROUNDS:
            ctes.append(f"s{i} AS (SELECT cluster, i, sum(e[i])::BIGINT AS s, count(*) AS n FROM (SELECT best.cluster AS cluster, e, unnest(range(1, {WIDTH} + 1)) AS i FROM a{i}) GROUP BY cluster, i)")
            ctes.append(f"m{i} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{i} GROUP BY cluster)")
            ctes.append(f"c{i + 1} AS (SELECT c{i}.cluster, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (cluster))")
    last = f"a{ROUNDS}"
    return (
        f"WITH {', '.join(ctes)} SELECT vec_id, best.cluster::INTEGER AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY best.cluster)::BIGINT AS cluster_inertia, sum(best.d) OVER ()::BIGINT AS inertia, "
        f"sha256(array_to_string(c.c, ',')) AS centroid_sha256 FROM {last} JOIN c{ROUNDS} AS c ON c.cluster = best.cluster"
    )


SQL = _sql()
