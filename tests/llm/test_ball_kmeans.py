"""Ball-tree filtering against plain k-means in Python integers."""

import hashlib
import random

import numpy as np
import pytest

from loomline.llm import ball_kmeans


def brute(rows, k, rounds, scale, width):
    """(id, cluster, distance) of all rows that take part, in Python integers."""
    kept = [(i, tuple(int(np.floor(scale * float(x))) for x in v)) for i, v in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    c = [v for _, v in sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), n) for n, m in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for n in range(len(c)):
            mine = [v for (_, v), o in zip(kept, own) if o == n]
            if mine:
                c[n] = tuple(sum(x) // len(mine) for x in zip(*mine))
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in kept), key=repr), c


def clustered(n, width, seed=1):
    r = random.Random(seed)
    middles = [[r.uniform(-9, 9) for _ in range(width)] for _ in range(6)]
    return [[x + r.gauss(0, 0.3) for x in r.choice(middles)] for _ in range(n)]


@pytest.mark.parametrize("leaf", [1, 8, 1000])
def test_tree_equals_plain_search(leaf):
    x = np.floor(np.array(clustered(500, 5)) * 4).astype(np.int32)
    x[100:250] = x[100]
    tree, order = ball_kmeans.Tree.build(x, leaf)
    tree = ball_kmeans.Tree.unpack(tree.pack(), 5)
    assert (tree.x == x[order]).all() and sorted(order) == list(range(500))
    for node in range(len(tree.low)):
        own = tree.x[tree.low[node] : tree.high[node]]
        assert (own.sum(0) == tree.total[node]).all() and np.sqrt(((own - own.mean(0)) ** 2).sum(1)).max() <= tree.radius[node] + 1e-9
    c = x[[3, 100, 100, 7, 400]].astype(np.int64)  # two equal centroids: ties
    cluster, count, total, settled = tree.assign(c)
    want = ball_kmeans.nearest(tree.x, c)[0]
    assert (cluster == want).all() and 2 not in cluster
    assert (count == np.bincount(want, minlength=5)).all() and all((total[i] == tree.x[want == i].sum(0)).all() for i in range(5))
    if leaf < 1000:
        assert settled > 250  # whole balls were assigned


def test_cluster_equals_brute_force(spark):
    r = random.Random(2)
    rows = list(enumerate(clustered(300, 4))) + [(5, [1.0, 2.0, 3.0, 4.0])] * 150 + [(None, [0.1, 0.2, -0.3, 0.4]), (900, None), (901, [1.0]), (902, [1.0, None, 2.0, 3.0]), (903, [1.0, float("nan"), 2.0, 3.0]), (904, [float("inf")] * 4), (7, [-0.0001] * 4)]
    r.shuffle(rows)
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, v string, cluster int").repartition(3)
    got, c = ball_kmeans.cluster(df, k=5, rounds=3, width=4, scale=64, tree_rows=64)
    want, centroids = brute(rows, 5, 3, 64, 4)
    assert [tuple(x) for x in c.tolist()] == centroids
    assert sorted((tuple(x) for x in got.collect()), key=repr) == want


def test_few_rows_empty_tables_and_no_ids(spark):
    kinds = "vec_id long, embedding array<float>"
    two = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], kinds)
    assert sorted(r["distance"] for r in ball_kmeans.cluster(two, width=2)[0].collect()) == [0, 0]
    assert ball_kmeans.cluster(spark.createDataFrame([], kinds), width=2)[0].count() == 0
    assert [tuple(r) for r in ball_kmeans.cluster(spark.createDataFrame([(None, [1.0, 0.0])], kinds), width=2)[0].collect()] == [(None, None, None)]


def test_too_large_components_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        ball_kmeans.cluster(df, width=2)[0].collect()
