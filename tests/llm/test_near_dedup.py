"""The pipeline's near-dedup stage against brute-force Jaccard similarity of five-word shingles."""

import random

import pytest

import corpus_pipeline
from loomline.llm import near_dedup


def shingles(text):
    ws = (text or "").lower().split()
    n = min(5, len(ws))
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if ws else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def corpus():
    rng = random.Random(7)
    words = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    shared = words(40)
    out = []
    for _ in range(60):  # single partners, on both sides of 0.8
        base = words(rng.randint(60, 400))
        near = list(base)
        for _ in range(max(1, int(len(base) * rng.choice([0.005, 0.015, 0.02, 0.023, 0.026, 0.03, 0.04])))):
            near[rng.randrange(len(near))] = f"n{rng.randrange(3000)}"
        out += [" ".join(base), " ".join(near)]
    base = words(150)
    for _ in range(30):  # one large group
        near = list(base)
        near[rng.randrange(150)] = "other"
        out.append(" ".join(near))
    out += [" ".join(words(30) + shared + words(30)) for _ in range(20)]  # a common passage
    out += [None, "", "  ", "one two", "One two", "one two three", "a b c d e", "a b c d e f"]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("small", [2, 32])
def test_stage_equals_brute_force(spark, small):
    texts = corpus()
    sets = [shingles(t) for t in texts]
    near = {(i, j) for j in range(len(texts)) for i in range(j) if jaccard(sets[i], sets[j]) >= 0.8}
    assert sum(jaccard(sets[i], sets[j]) < 0.9 for i, j in near) >= 5
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in near:
        root[max(find(i), find(j))] = min(find(i), find(j))
    frame = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(5)
    prints, roots = near_dedup.groups(frame, small=small)
    of = {r.fp: r.root for r in roots.collect()}
    group = {r.doc_id: of.get(r.fp, r.fp) for r in prints.collect()}
    linked = {(i, j) for j in range(len(texts)) for i in range(j) if group[i] == group[j]}
    chained = {(i, j) for j in range(len(texts)) for i in range(j) if find(i) == find(j)}
    recall, precision = len(linked & chained) / len(chained), len(linked & chained) / len(linked)
    assert (recall, precision) == (1.0, 1.0) and near <= linked
    kept = near_dedup.keep_first(frame, small=small)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == [i for i in range(len(texts)) if find(i) == i]


def test_stage_on_pairs_near_the_threshold(spark):
    words = [f"w{i}" for i in range(104)]  # 100 shingles
    far = [*words[:50], "x", *words[51:]]  # 95 of 105
    below = [*words[:20], "x", *words[21:60], "y", *words[61:80], "z", *words[81:]]  # 85 of 115
    pairs = [(1, words), (2, far), (3, [w + "b" for w in words]), (4, [w + "b" for w in below])]
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in pairs], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame, "").collect()) == [1, 3, 4]


def test_stage_on_nulls_and_repeated_rows(spark):
    a, b = " ".join(f"w{i}" for i in range(50)), " ".join(f"v{i}" for i in range(50))
    rows = [(1, a), (1, a), (2, b), (3, a), (3, b + " more"), (3, "alone"), (None, a), (None, "left"), (None, "left"), (None, "right")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, frame, "").collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([(1, a), (2, b), (3, "alone"), (None, "left"), (None, "right")], key=repr)
    assert corpus_pipeline.near_duplicates(spark, frame.limit(0), "").count() == 0


def test_stage_links_by_simhash_too(spark):
    """Two texts of one fingerprint whose shingle sets aren't similar, a chain over both ways of linking, and a text that neither links."""
    from loomline.llm import simhash

    long = " ".join(f"w{i}" for i in range(40))
    texts = [" ".join(["x y z"] * 60 + ["a b c"]), " ".join(["x y z"] * 60 + ["d e f"]), " ".join(["x y z"] * 60 + ["d e f g"]), long, long + " more", "some other words stand here alone"]
    assert simhash.fingerprint(texts[0].encode()) == simhash.fingerprint(texts[1].encode()) and jaccard(shingles(texts[0]), shingles(texts[1])) < 0.8
    frame = spark.createDataFrame([(9 - i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame, "").collect()) == [4, 5, 7]
