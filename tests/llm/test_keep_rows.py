"""simhash.keep_first on repeated rows and ids that several texts share."""

import numpy as np
import pyarrow as pa
import pytest

from loomline.llm import near_dedup, simhash


def test_rows_are_decided_on_their_own(spark):
    unique = " ".join(f"w{i * i}" for i in range(300))
    rows = [(4, "Ana bo"), (4, "Ana bo"), (9, unique), (9, "Ana bo"), (10, "Ana bo"), (10, "Ana bo"), (None, "Ana bo"), (None, "river stone wall deep")]
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int").repartition(3)
    kept = simhash.keep_first(frame)
    assert kept.columns == frame.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(4, "Ana bo"), (9, unique), (None, "river stone wall deep")], key=repr)


def test_columns_may_be_called_anything(spark):
    """Of the names that the operator uses itself, too; and empty tables stay empty."""
    names = ["__id", "__row", "__stays", "__no", "whole", "fp", "root", "least", "stays", "row", "unnamed", "n"]
    rows = [(4, "Ana bo"), (4, "Ana bo"), (10, "Ana bo"), (11, None), (None, "river stone wall deep")]
    frame = spark.createDataFrame([(i, t, *range(len(names))) for i, t in rows], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names)).repartition(2)
    for keep in (simhash.keep_first, near_dedup.keep_first):
        kept = keep(frame)
        assert kept.columns == frame.columns
        assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(4, "Ana bo"), (11, None), (None, "river stone wall deep")], key=repr)
        assert keep(frame.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_runs_over_many_batches(size):
    rng = np.random.default_rng(size)
    key = np.sort(rng.integers(0, 9, 400))
    key[100:300] = key[100]
    key.sort()
    other = np.arange(400)
    batches = [pa.record_batch([pa.array(key[i : i + size]), pa.array(other[i : i + size])], names=["key", "x"]) for i in range(0, 400, size)]
    runs = list(near_dedup._runs(iter([*batches, batches[0].slice(0, 0)]), ["key", "x"]))
    assert np.concatenate([r["key"] for r in runs]).tolist() == key.tolist() and np.concatenate([r["x"] for r in runs]).tolist() == other.tolist()
    assert all(a["key"][-1] != b["key"][0] for a, b in zip(runs, runs[1:])) and list(near_dedup._runs(iter([]), ["key"])) == []
