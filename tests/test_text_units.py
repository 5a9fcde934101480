"""Role units of whole texts: without a shuffle, and the same as those of sentences as rows."""

import random

from pyspark.sql import functions as F

from loomline.operators import spans


def test_units_of_texts_need_no_shuffle_and_equal_those_of_rows(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice(['A b. ', 'He "said. ', '“Oh. ', 'No” she. ', 'x" y. ', '"Z" u “v” w. ', '" . ']) for _ in range(n)) for n in (*range(30), 499, 500, 501, 1700)]
    df = spark.createDataFrame([*enumerate(texts), (-1, None), (-2, " ")], "k long, t string").repartition(3)
    want = spans.role_unit_rows(spans.sentence_rows(df, "k", "t"), "k", "idx", "sentence")
    got = spans.text_role_units(df, "k", "t")
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    read = spans.text_role_units(df.coalesce(1), "k", "t", lambda s: F.translate(s, "b", '"'))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hash" not in read and "Window" not in read
    units = df.select("k", F.posexplode(spans.text_units(F.col("t"))).alias("n", "unit"))
    told = {}
    for r in want.orderBy("k", "idx", "part").collect():
        told.setdefault(r.k, []).append(r.unit)
    assert sorted(map(tuple, units.collect())) == sorted((k, i, u) for k, us in told.items() for i, u in enumerate(us))
