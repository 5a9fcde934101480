"""Confirmed appearances of persons, and places in a whole table."""

import pytest
from pyspark.sql import functions as F

from loomline.operators import cast, sequence

REGISTRY = [(0, "ana_child", "ana", "Ana", "child", "Ana child"), (1, "ana_adult", "ana", "Ana", "adult", "Ana adult"), (2, "bo", None, "Bo", None, "Bo")]


def confirmed(spark, selections):
    registry = spark.createDataFrame([(o, r, None, p, n, [], s, m) for o, r, p, n, s, m in REGISTRY], "ord long, role_id string, profile_id string, person_id string, display_name string, aliases array<string>, age_stage string, role_name string")
    roles = spark.createDataFrame([(1, i, r) for i, r in enumerate(["Narrator", "ana child", "Bo", "ANA_ADULT", "nobody", "nobody"])] + [(2, 0, "Bo")], "chapter int, role_idx long, role string")
    rows = spark.createDataFrame([(1, q, q % 6) for q in range(12)] + [(2, 0, 0)], "chapter int, idx int, role_idx long")
    return cast.confirmed(roles, rows, registry, spark.createDataFrame(selections, "chapter int, person_id string, age_stage string"))


@pytest.mark.parametrize("selections,ana", [([], "Ana child"), ([(1, "ana", " Adult ")], "Ana adult"), ([(2, "ana", "adult")], "Ana child")])
def test_roles_of_a_person_become_one(spark, selections, ana):
    roles, rows, approvals = confirmed(spark, selections)
    assert [r["role"] for r in roles.filter("chapter = 1").orderBy("role_idx").collect()] == ["Narrator", ana, "Bo", "nobody"]
    assert [r["role_idx"] for r in rows.filter("chapter = 1").orderBy("idx").collect()] == [0, 1, 2, 1, 3, 3] * 2
    assert sorted(tuple(r) for r in approvals.collect()) == [(1, "ana", "Ana", ana[4:], ana), (1, "bo", "Bo", "unknown", "Bo"), (2, "bo", "Bo", "unknown", "Bo")]


def test_a_stage_that_nobody_has_is_an_error(spark):
    with pytest.raises(Exception, match="no record of ana is elder"):
        confirmed(spark, [(1, "ana", "elder")])[2].collect()


def test_numbered_over_ranges(spark):
    df = spark.range(3000).select((F.col("id") * 7919 % 3001).alias("x"), F.lit(1).alias("__n")).repartition(7)
    got = sequence.numbered(df, [F.desc("x")], "place", 5).collect()
    assert {r["__n"] for r in got} == {1}
    assert {r["x"]: r["place"] for r in got} == {x: i + 5 for i, x in enumerate(sorted((i * 7919 % 3001 for i in range(3000)), reverse=True))}
    assert sequence.numbered(df.limit(0), [F.col("x")], "place").count() == 0


def test_reports(spark, tmp_path):
    from loomline.sources.files import write_report

    rows = spark.createDataFrame([(i, "a|b" if i % 2 else None, [i]) for i in range(30)], "k int, `na me` string, l array<int>").repartition(4)
    write_report(rows, str(tmp_path), ["k"])
    lines = "".join(f.read_text() for f in sorted((tmp_path / "markdown").glob("part-*"))).splitlines()
    assert lines == ["| k | na me | l |", "| --- | --- | --- |", *(f"| {i} | {'a' + chr(92) + '|b' if i % 2 else ''} | [{i}] |" for i in range(30))]
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 30 and spark.read.json(str(tmp_path / "json")).count() == 30


def test_unknown_units_are_an_error(spark):
    from loomline.operators import script

    units = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "c string, u int, text string")
    assert [r["text"] for r in script.script_units(units.limit(1).select("c", "u"), units, "c", "u").collect()] == ["x"]
    with pytest.raises(Exception, match="unknown unit 9"):
        script.script_units(spark.createDataFrame([("a", 9)], "c string, u int"), units, "c", "u").collect()
