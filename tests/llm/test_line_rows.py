"""Line dedup on tables with repeated rows and rows that share an id."""

from loomline.llm import line_dedup


def kept(spark, rows):
    frame = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, lang string").repartition(3)
    out = line_dedup.keep_lines(frame)
    assert out.columns == frame.columns
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)


def test_one_of_equal_rows_keeps_its_lines(spark):
    rows = [(1, "red green blue"), (2, "one two three\nfour five six"), (2, "one two three\nfour five six"), (3, "red green blue\nlast line here"), (3, "red green blue\nlast line here"), (3, "red green blue\nlast line here"), (None, "no id at all"), (None, "no id at all"), (4, None), (4, None), (4, "")]
    want = [(1, "red green blue"), (2, "one two three\nfour five six"), (2, ""), (3, "last line here"), (3, ""), (3, ""), (None, "no id at all"), (None, ""), (4, None), (4, None), (4, "")]
    assert kept(spark, rows) == sorted(want, key=repr)


def test_rows_that_share_an_id_have_their_own_decisions(spark):
    rows = [(1, "red green blue\nsun moon stars"), (5, "first of its own\nred green blue"), (5, "quite another row\nstays as it is")]
    rows += [(None, "alpha beta gamma\nsun moon stars"), (None, "delta epsilon zeta\nalso stays right here"), (None, "eta theta iota\nkappa lambda mu")]
    want = [rows[0], (5, "first of its own"), rows[2], (None, "alpha beta gamma"), rows[4], rows[5]]
    assert kept(spark, rows) == sorted(want, key=repr)


def test_open_lines_of_rows_without_id(spark):
    import random

    rng = random.Random(3)
    base = [f"w{i}" for i in range(10)]
    line = lambda: " ".join(sorted({rng.choice(base) for _ in range(9)} | {f"u{rng.randrange(4)}"}))
    rows = [(rng.choice([None, None, 7, k]), "\n".join(line() for _ in range(rng.randint(1, 4)))) for k in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    from pyspark.sql import functions as F

    ties = {r.text: r.t for r in frame.select("text", F.xxhash64("text").alias("t")).collect()}
    seen, want = [], []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, ties[r[1]])):
        gone = []
        for no, words in enumerate(set(x.split()) for x in text.split("\n")):
            if any(len(words & o) >= 0.8 * len(words | o) for o in seen):
                gone.append(no)
            seen.append(words)
        want.append((i, gone))
    for nearest in (1, 2):
        got = line_dedup.line_decisions(frame, nearest=nearest).collect()
        assert sorted(((r.doc_id, r.removed) for r in got), key=repr) == sorted(want, key=repr)
