"""Outside calls: asked once, kept, matched first; discovery; the controller's stream; cascades of stages."""

import json
import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from loomline.operators import asking, library, sequence
from loomline.streaming.controller import limit_stream
from loomline.streaming.stateful import drain

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't import tests


def counted(folder, reply):
    """A client that leaves a file for each call."""

    def client(prompt):
        import uuid

        open(f"{folder}/{uuid.uuid4().hex}", "w").close()
        return reply(prompt)

    return client


def fine(answer):
    return [] if "n" in answer else ["no n"]


def test_each_question_is_asked_once(spark, tmp_path):
    calls, kept = tmp_path / "calls", str(tmp_path / "kept")
    calls.mkdir()
    rows = spark.createDataFrame([(i, ["a", "bb", None, ""][i % 4], "x") for i in range(40)], "id int, prompt string, answer string").repartition(5)
    client = counted(calls, lambda p: json.dumps({"n": len(p)}))
    got = asking.answered(rows, "id", "prompt", client, fine, kept)
    assert {r["id"]: json.loads(r["answer"])["n"] for r in got.collect()} == {i: [1, 2, 0, 0][i % 4] for i in range(40)}
    assert len(os.listdir(calls)) == 3  # a, bb and the empty one
    assert got.count() == 40 and len(os.listdir(calls)) == 3  # run again: nothing is asked
    assert asking.kept_answers(spark, kept).count() == 3
    assert asking.answered(rows.limit(0), "id", "prompt", client, fine, kept).count() == 0


def test_a_lost_worker_costs_only_open_questions(spark, tmp_path):
    calls, kept, flag = tmp_path / "calls", str(tmp_path / "kept"), tmp_path / "died"
    calls.mkdir()
    rows = spark.createDataFrame([(i, f"question {i}") for i in range(60)], "id int, prompt string").repartition(2)

    def reply(prompt):
        if prompt == "question 33" and not os.path.exists(flag):
            open(flag, "w").close()
            os._exit(3)
        return json.dumps({"n": 1})

    ask = lambda: asking.answered(rows, "id", "prompt", counted(calls, reply), fine, kept, at_once=2).count()
    with pytest.raises(Exception):
        asking.answered(rows, "id", "prompt", counted(calls, reply), fine, kept, at_once=2).collect()
    asked, answers = len(os.listdir(calls)), asking.kept_answers(spark, kept).count()
    assert ask() == 60 and asking.answered(rows, "id", "prompt", counted(calls, reply), fine, kept).filter("answer is null").count() == 0
    assert len(os.listdir(calls)) == asked + 60 - answers  # what was kept isn't asked again


def test_wrong_answers_are_asked_again(spark, tmp_path):
    rows = spark.createDataFrame([(1, "good"), (2, "late"), (3, "never"), (4, "raises")], "id int, prompt string")

    def client(prompt):
        if prompt.startswith("raises"):
            raise OSError("down")
        return '{"n": 1}' if prompt == "good" or prompt.startswith("late") and "wrong" in prompt else "[]" if prompt.startswith("never") else "{}"

    got = {r["id"]: (r["answer"], r["tries"], r["errors"]) for r in asking.answered(rows, "id", "prompt", client, fine, str(tmp_path), retries=2).collect()}
    assert got == {1: ('{"n": 1}', 1, ""), 2: ('{"n": 1}', 2, ""), 3: (None, 3, "not an object"), 4: (None, 3, "OSError: down")}


def test_consolidated(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    bridge = spark.createDataFrame([("ana", "ana_1"), ("ana", "ana_2"), ("bo", "bo_1"), ("cy", "cy_1"), ("cy", "cy_2")], "alias string, role_id string")
    rows = spark.createDataFrame([(1, ["Bo"]), (2, ["Ana"]), (3, ["Nobody"]), (4, ["Cy"]), (5, None), (6, ["Ana", None])], "id int, names array<string>")
    client = counted(calls, lambda p: json.dumps({"role_id": json.loads(p.split("\n")[0])["roles"][-1] if "Ana" in p else "made_up"}))
    got = {r["id"]: (r["role_id"], r["how"]) for r in asking.consolidated(rows, bridge, "id", "names", client, str(tmp_path / "kept")).collect()}
    assert got == {1: ("bo_1", "match"), 2: ("ana_2", "asked"), 3: (None, "none"), 4: (None, "none"), 5: (None, "none"), 6: ("ana_2", "asked")}
    assert len(os.listdir(calls)) == 2  # 2 and 6 are one question


def test_discovered(spark, tmp_path):
    kinds = "ord long, role_id string, profile_id string, person_id string, display_name string, age_stage string, gender string, race_or_ethnicity string, accent string, occupation string, personality array<string>, aliases array<string>"
    registry = spark.createDataFrame([(0, "ana", "ana", "ana", "Ana", "unknown", None, None, None, None, [], [])], kinds)
    chapters = spark.createDataFrame([(0, "One", "Ana speaks."), (1, "Two", "Bo speaks." * 3), (2, "Three", "Ana again."), (3, None, None)], "order long, title string, text string")

    def client(prompt):
        assert '"name":"Ana"' in prompt
        found = [{"name": n, "gender": "female" if n == "Ana" else None, "race_or_accent": "Japanese; Tokyo accent" if n == "Bo" else "unknown", "personality_type": "calm, wry"} for n in ("Ana", "Bo") if f"{n} " in prompt.split("\n\n", 1)[1]]
        return json.dumps({"characters": [*found, {"name": " "}]})

    got = asking.discovered(chapters, registry, client, str(tmp_path), most=25).orderBy("ord").collect()
    assert [(r["role_id"], r["gender"], r["race_or_ethnicity"], r["accent"], r["personality"], r["n_rows"]) for r in got] == [("ana", "female", None, None, ["calm", "wry"], 3), ("bo", "unknown", "Japanese", "Tokyo", ["calm", "wry"], 1)]


def test_limit_stream_in_any_order_and_batch(spark, tmp_path):
    import random

    r = random.Random(2)
    calls = [(k, i, r.choice([None, 1, 3, 8]), r.choice([None, 0, 20, 60, 90, 130, 400])) for k in ("a", "b", None) for i in range(40)]
    want = {(x.u, x.i): (x.limit_before, x.limit_after) for x in sequence.adaptive_limits(spark.createDataFrame(calls, "u string, i long, b int, p int"), "u", ["i"], "b", "p", 100, 4).collect()}
    shuffled = [*calls, *calls[:5]]
    r.shuffle(shuffled)
    folder = tmp_path / "calls"
    got = {}
    for lo in range(0, len(shuffled), 50):
        spark.createDataFrame(shuffled[lo : lo + 50], "u string, i long, b int, p int").coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema("u string, i long, b int, p int").parquet(str(folder))
        for x in drain(limit_stream(stream, "u", "i", "b", "p", 100, 4), checkpoint=str(tmp_path / "check")).collect():
            assert (x.u, x.i) not in got
            got[x.u, x.i] = (x.limit_before, x.limit_after)
    assert got == want


def test_limit_stream_gives_up_on_missing_calls(spark, tmp_path):
    import time

    folder, got = tmp_path / "calls", []
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    for rows in ([("a", 0, 1, 0), ("a", 2, 1, 400), ("a", 3, 1, 0)], [("b", 0, 1, 0)], [("a", 1, 1, 0), ("a", 4, 1, 0)]):
        spark.createDataFrame(rows, "u string, i long, b int, p int").coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema("u string, i long, b int, p int").parquet(str(folder))
        got += [tuple(x) for x in drain(limit_stream(stream, "u", "i", "b", "p", 100, 4, patience_ms=1000), checkpoint=str(tmp_path / "check")).orderBy("u", "i").collect()]
        time.sleep(1.2)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert sorted(got) == [("a", 0, 4, 4), ("a", 2, 4, 1), ("a", 3, 1, 1), ("a", 4, 1, 1), ("b", 0, 4, 4)]


def test_cascade_over_three_levels(spark):
    steps = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("x", "y"), ("y", "x"), (None, "a")], "kind string, source string")
    assert {tuple(r) for r in library.depends_on(spark, steps).collect()} == {("b", "a"), ("c", "a"), ("d", "a"), ("c", "b"), ("d", "b"), ("d", "c"), ("x", "y"), ("y", "x")}
    artifacts = spark.createDataFrame([(k, t) for k in ("one", "two", None) for t in ("a", "b", "c", "d", "x", None)], "book string, kind string")
    changed = spark.createDataFrame([("one", "b"), ("one", "b"), ("two", "y"), (None, "a")], "book string, kind string")
    left = sorted((tuple(r) for r in library.cascaded(artifacts, changed, "book", "kind", steps).collect()), key=str)
    assert left == sorted([(k, t) for k in ("one", "two", None) for t in ("a", "b", "c", "d", "x", None) if (k, t) not in {("one", "c"), ("one", "d"), ("two", "x")}], key=str)
    assert library.cascaded(artifacts.limit(0), changed, "book", "kind").count() == 0
    ready = library.open_stages(spark.createDataFrame([("one", "a"), ("two", "a"), ("two", "b"), ("two", "c")], "book string, kind string"), "book", "kind", steps)
    assert {tuple(r) for r in ready.collect()} == {("one", "b"), ("two", "d")}
