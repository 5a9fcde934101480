"""Names that very many rows share: joins hand on a row for each of them, not one for each pair."""

from pyspark.sql import functions as F

from loomline.operators import annotation, asking, cast, lookup


def join_rows(frame) -> int:
    """The most rows that a join of the frame's plan gave."""
    frame.collect()
    most, open_ = 0, [frame._jdf.queryExecution().executedPlan()]
    while open_:
        node = open_.pop()
        kind = node.getClass().getSimpleName()
        if kind.endswith("JoinExec") and node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        if kind == "AdaptiveSparkPlanExec":
            open_.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            open_.append(node.plan())
        else:
            children = node.children()
            open_ += [children.apply(i) for i in range(children.size())]
    return most


def test_a_name_of_all_is_matched_once_a_stage(spark):
    n, none = 300, F.lit(None).cast("string")
    no = F.array().cast("array<string>")
    stage = F.element_at(F.array(*map(F.lit, ("", "teen", "Adult"))), (F.col("id") % 3 + 1).cast("int"))
    new = spark.range(n).select("id", F.lit("Ann Lee").alias("name"), none.alias("profile_id"), none.alias("person_id"), no.alias("aliases"), F.when(F.col("id") % 2 == 0, "adult").alias("age_stage"))
    held = spark.range(1, n).select(F.col("id").alias("ord"), F.concat(F.lit("r"), F.col("id").cast("string")).alias("role_id"), none.alias("profile_id"), none.alias("person_id"), F.lit("ann lee").alias("display_name"), no.alias("aliases"), stage.alias("age_stage"))
    got = cast.merge_matches(new, held, "id")
    assert join_rows(got) <= 3 * n
    assert {r.id: r.role_id for r in got.collect()} == {i: "r2" if i % 2 == 0 else "r1" for i in range(n)}


def test_first_of_many_equal_rows_joins_once(spark):
    n = 300
    rows = spark.range(n).select(F.lit("x").alias("path"), F.col("id").alias("role"), (F.lit(n) - F.col("id")).alias("o"), F.concat(F.lit("l"), F.col("id").cast("string")).alias("label"))
    left = spark.range(n).select(F.col("id").alias("u"), F.lit("x").alias("path"), F.col("id").alias("role"))
    got = cast.first_of(rows, left, "u", "o", [("role", "role"), ("path", "path")], "label")
    assert join_rows(got) <= 2 * n
    assert {r.label for r in got.collect()} == {f"l{n - 1}"}


def crowd(spark, n):
    """n roles of one name, as candidates with that name and their own, some with names of nobody; and the bridge."""
    own = F.concat(F.lit("r"), F.col("id").cast("string"))
    said = spark.range(n + 2).select("id", F.when(F.col("id") == n, F.array(F.lit("nobody"))).when(F.col("id") == n + 1, F.array(own, F.lit("Ann"), F.lit("Two"))).otherwise(F.array(F.lit("ann"), own)).alias("names")).repartition(3)
    bridge = spark.range(n).select(F.explode(F.array(own, F.when(F.col("id") % 7 != 0, "ann"), F.when(F.col("id") % 2 == 0, "two"))).alias("alias"), own.alias("role_id")).filter("alias is not null")
    ann, two = {f"r{i}" for i in range(n) if i % 7}, {f"r{i}" for i in range(0, n, 2)}
    want = {i: sorted(ann | {f"r{i}"}) for i in range(n)} | {n: [], n + 1: sorted(ann | two)}
    return said, bridge, {k: ",".join(v) for k, v in want.items()}


def shuffled(frame) -> int:
    """The bytes of the largest shuffle of a frame."""
    frame.collect()
    most, open_ = 0, [frame._jdf.queryExecution().executedPlan()]
    while open_:
        node = open_.pop()
        if node.metrics().contains("dataSize") and node.getClass().getSimpleName() == "ShuffleExchangeExec":
            most = max(most, node.metrics().apply("dataSize").value())
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            open_.append(node.executedPlan())
        elif node.getClass().getSimpleName().endswith("QueryStageExec"):
            open_.append(node.plan())
        else:
            children = node.children()
            open_ += [children.apply(i) for i in range(children.size())]
    return most


def test_a_list_that_many_share_moves_once(spark):
    said, bridge, want = crowd(spark, 2000)
    got = lookup.match_candidates(said, bridge, "id", "names")
    assert shuffled(got) < 2_000_000  # all lists are 22 MB
    assert {r.id: r.roles for r in got.collect()} == want
    assert {r.id: (r.n_roles, r.role_id) for r in got.collect()} == {k: (len(v.split(",")) if v else 0, None) for k, v in want.items()}
    taken = annotation.collisions(said, bridge, "names")
    assert shuffled(taken) < 2_000_000
    assert {r.id: r.taken_by for r in taken.collect()} == {k: v for k, v in want.items() if v}


def test_long_prompts_are_made_where_they_are_asked(spark, tmp_path):
    """What moves is what prompts are made of: the rows that ask, the answers, and no prompt."""
    n = 300
    df = spark.range(n).select("id", (F.col("id") % 150).alias("word")).repartition(3)
    made = lambda rows: rows.withColumn("prompt", F.concat(F.repeat(F.lit("x"), 100_000), F.col("word").cast("string")))
    got = asking.answered(df, "id", "prompt", lambda p: '{"n": %d}' % len(p), lambda a: [], str(tmp_path / "answers"), made=made)
    assert shuffled(got) < 100_000
    rows = got.collect()
    assert {r.id: r.answer for r in rows} == {i: '{"n": %d}' % (100_000 + len(str(i % 150))) for i in range(n)}
    assert asking.kept_answers(spark, str(tmp_path / "answers")).count() == 150
