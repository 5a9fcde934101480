"""Tables that grow with the input: none is sent to the driver, none is held whole by a reading task, no batch of texts is held as objects."""

import hashlib
import json
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F

from loomline.functions.arrow import slices
from loomline.operators import annotation, asking, generation, lookup, merging
from loomline.plans import annotations, merges

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't import tests


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_batch_is_not_sent_to_the_driver(spark, sf_dir):
    stored = merges.stored(spark, sf_dir)
    new = merges.people(spark, sf_dir).filter("k >= 2")
    assert "BroadcastExchange" not in plan(merging.inserted(stored, merging.profiled(new)))
    assert "BroadcastExchange" not in plan(merging.merged(stored, new))


def test_repair_hints_of_a_name_that_many_have(spark):
    rows = spark.createDataFrame([("c", 2, "Jo Far"), ("c", 1, "Jo Far"), ("c", 3, "Al"), ("c", 4, "Bo_x")], "chapter string, idx int, role string")
    bridge = spark.createDataFrame([("jo", f"r{i:02d}") for i in (*range(30), 3)] + [("bo", "b")], "alias string, role_id string")
    got = annotation.repair_hints(rows, rows.filter("role = 'Al'").select("chapter", "role"), bridge)
    assert sorted(map(tuple, got.collect())) == [("c", "Bo_x", "4", "b"), ("c", "Jo Far", "1,2", "r00,r01,r02,r03,r04,r05,r06,r07")]
    assert "BroadcastExchange" not in plan(got) and "collect_set(role_id" not in plan(got)


def test_names_meet_after_they_are_dealt(spark):
    reg = spark.createDataFrame([("a_b", "A B", ["x", "X", "-"], "teen"), ("a_b", "A B", ["y"], ""), ("c", "A B", None, None)], "role_id string, display_name string, aliases array<string>, age_stage string")
    got = lookup.alias_bridge(reg)
    planned = plan(got)
    assert sorted(map(tuple, got.collect())) == sorted([(x, "a_b") for x in ("ab", "x", "abteen", "xteen", "teen", "y")] + [("ab", "c"), ("c", "c")])
    assert "HashAggregate" not in planned.split("Exchange")[-1] and planned.count("Exchange hashpartitioning") == 1


def test_slices_are_bounded():
    b = pa.record_batch([pa.array(range(7)), pa.array(["a" * 3, None, "b" * 50, "", "c" * 4, "é" * 3, "d" * 4])], names=["k", "t"])
    got = list(slices([b, b.slice(0, 0)], "t", 10))
    assert [x.column(0).to_pylist() for x in got] == [[0, 1], [2], [3, 4, 5], [6]] and pa.Table.from_batches(got).to_pylist() == b.to_pylist()


def test_sound_is_made_for_a_little_text_at_a_time(spark):
    class Adapter:
        rate = 10

        def generate(self, texts, voices):
            assert sum(map(len, texts)) <= max(generation.HEARD, max(map(len, texts)))
            return [[0.0] * len(t) for t in texts]

    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    rows = spark.range(300).select("id", F.repeat(F.lit("x"), F.lit(1000)).alias("t"), F.lit("v").alias("v")).coalesce(1)
    assert generation.generated(rows, "t", "v", Adapter()).agg(F.sum("n_samples")).first()[0] == 300_000


def parts(spark):
    """Roles, of which very many share a name, as parts of tables and candidates; the planner takes both for small."""
    own = F.concat(F.lit("r"), F.col("id").cast("string"))
    said = spark.range(400).select("id", F.array(F.when(F.col("id") % 2 == 0, "Ann"), own).alias("names"))
    bridge = spark.range(300).select(F.explode(F.array(own, F.when(F.col("id") % 3 == 0, "ann"))).alias("alias"), own.alias("role_id")).filter("alias is not null")
    ann = {f"r{i}" for i in range(0, 300, 3)}
    return said, bridge, {i: sorted((ann if i % 2 == 0 else set()) | ({f"r{i}"} if i < 300 else set())) for i in range(400)}


def test_lists_of_roles_are_not_sent_to_the_driver(spark):
    said, bridge, want = parts(spark)
    got = lookup.match_candidates(said, bridge, "id", "names")
    assert "BroadcastExchange" not in plan(got)
    assert {r.id: (r.roles, r.n_roles, r.role_id) for r in got.collect()} == {k: (",".join(v), len(v), v[0] if len(v) == 1 else None) for k, v in want.items()}


def test_rows_without_a_list_are_dealt_out(spark):
    """Rows that share no list don't meet in one task."""
    said = spark.range(4000).select("id", F.array(F.concat(F.lit("r"), F.col("id").cast("string"))).alias("names"))
    bridge = spark.range(4000).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("alias"), F.col("id").cast("string").alias("role_id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = lookup.match_candidates(said, bridge, "id", "names").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["count"] for r in got) == 4000 and max(r["count"] for r in got) < 2000


def test_names_that_are_taken_are_not_sent_to_the_driver(spark):
    said, bridge, want = parts(spark)
    got = annotation.collisions(said.withColumn("n", F.col("id") + 1), bridge, "names")
    assert "BroadcastExchange" not in plan(got)
    assert {(r.id, r.n): r.taken_by for r in got.collect()} == {(k, k + 1): ",".join(v) for k, v in want.items() if v}


def test_no_question_or_answer_is_sent_to_the_driver(spark, tmp_path):
    said, bridge, want = parts(spark)
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()

    def client(prompt):
        asked = json.loads(prompt)
        assert prompt == json.dumps(asked, separators=(",", ":")) and list(asked) == ["names", "roles"] and asked["roles"] == sorted(asked["roles"])
        return json.dumps({"role_id": asked["roles"][-1]})

    for _ in range(2):  # the second call finds answers
        got = asking.consolidated(said, bridge, "id", "names", client, str(tmp_path))
        assert {r.id: (r.role_id, r.how) for r in got.collect()} == {k: (v[-1], "asked" if len(v) > 1 else "match") if v else (None, "none") for k, v in want.items()}
    ran = store.executionsList()
    plans = [ran.apply(i).physicalPlanDescription() for i in range(ran.size()) if ran.apply(i).executionId() >= before]
    assert len(plans) > 8 and not any("BroadcastExchange" in p for p in plans)


def test_repair_hints_name_all_candidates(spark):
    rows = spark.createDataFrame([("c", 1, "Jo Far"), ("c", 2, "Jo Near"), ("d", 3, "Jo Far"), ("d", 4, "Al_x"), ("d", 5, "Bo x"), ("d", 6, None)], "chapter string, idx int, role string")
    bridge = spark.createDataFrame([("jo", f"r{i:03d}") for i in (*range(99, -1, -1), 3)] + [("al", f"a{i}") for i in range(9)] + [("xx", "x")], "alias string, role_id string")
    got = annotation.repair_hints(rows, rows.limit(0).select("chapter", "role"), bridge, most=None)
    jo, al = ",".join(f"r{i:03d}" for i in range(100)), ",".join(f"a{i}" for i in range(9))
    want = [("c", "Jo Far", "1", jo), ("c", "Jo Near", "2", jo), ("d", "Jo Far", "3", jo), ("d", "Al_x", "4", al), ("d", "Bo x", "5", None), ("d", None, "6", None)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and "BroadcastExchange" not in plan(got)


def test_the_query_of_repair_hints_has_no_cap(spark, tmp_path):
    """A part's name as a lost role's first word: all roles of that name are its candidates."""
    spark.range(30).selectExpr("id + 100 as p_partkey", "'ghost' as p_name", "'Brand#1' as p_brand", "'x' as p_type", "1 as p_size", "1.0D as p_retailprice").write.parquet(str(tmp_path / "part.parquet"))
    spark.range(3).selectExpr("1L as conv_id", "id as turn", "'user' as role", "'t' as text").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.role: r.candidates for r in annotations.repair_hints(spark, str(tmp_path)).collect()}
    assert {k: len(v.split(",")) for k, v in got.items()} == {"ghost 0": 30 - 4, "ghost 1": 30 - 4}  # the name of every seventh begins with a title


def test_a_known_registry_is_stored_once_and_hashed_once(spark, tmp_path):
    """No rows are joined with the registry, prompts begin with it, and digests are those of whole prompts."""
    kinds = "ord long, role_id string, profile_id string, person_id string, display_name string, age_stage string, gender string, race_or_ethnicity string, accent string, occupation string, personality array<string>, aliases array<string>"
    registry = spark.createDataFrame([(i, f"r{i}", f"r{i}", f"r{i}", f"Röle {i}", "unknown", None, None, None, None, [], []) for i in range(200)], kinds)
    chapters = spark.createDataFrame([(i, f"T{i % 4}", "ж" * 20) for i in range(12)] + [(12, None, None)], "order long, title string, text string")
    (tmp_path / "calls").mkdir()

    def client(prompt):
        (tmp_path / "calls" / hashlib.sha256(prompt.encode()).hexdigest()).write_text(prompt)
        return json.dumps({"characters": [{"name": "New"}]})

    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    for _ in range(2):
        got = asking.discovered(chapters, registry, client, str(tmp_path / "kept"), most=25).collect()
        assert len(got) == 201 and sum(r.n_rows for r in got) == 212
    asked = {p.name: p.read_text() for p in (tmp_path / "calls").iterdir()}
    begin = "Known characters: " + json.dumps(json.loads(next(iter(asked.values())).split("\n")[0][18:]), separators=(",", ":"), ensure_ascii=False) + "\n\n"
    assert begin.count("Röle") == 200 and {p.removeprefix(begin)[:5] for p in asked.values()} == {f"## T{i}" for i in range(4)}
    assert {r.digest for r in asking.kept_answers(spark, str(tmp_path / "kept")).collect()} == set(asked)
    ran = store.executionsList()
    plans = [ran.apply(i).physicalPlanDescription() for i in range(ran.size()) if ran.apply(i).executionId() >= before]
    assert len(plans) > 4 and not any("BroadcastNestedLoopJoin" in p or "CartesianProduct" in p for p in plans)
