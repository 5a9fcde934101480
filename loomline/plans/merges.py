"""Queries on batches that enter a registry: parts as characters, twelve consecutive ones as the people of one place."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merging as M
from ..operators.sequence import running_sum
from .base import Plan, name_key, reader, slug

PLAN = Plan()
query, QUERIES, SQL = PLAN.query, PLAN.QUERIES, PLAN.SQL
part = reader("part")

#: Parts of one place; the first few of each place are in the registry already.
PLACE, STORED = 12, 2


def people(spark, sf_dir):
    """ord, place, k, and the columns of an incoming record. Names, aliases and persons of one place overlap, so that rows match over several steps."""
    p = part(spark, sf_dir)
    place = F.concat(F.lit("at"), F.floor(F.col("p_partkey") / PLACE).cast("string"))
    words, size = F.split("p_name", " "), F.col("p_size") % 5
    return p.select(
        F.col("p_partkey").alias("ord"), (F.col("p_partkey") % PLACE).alias("k"), F.concat_ws(" ", F.element_at(words, -1), place).alias("name"), F.lit("").alias("profile_id"), F.concat_ws(" ", "p_brand", place).alias("person_id"),
        F.when(size == 0, "Child").when(size == 1, " adult ").when(size == 2, "").otherwise("unknown").alias("age_stage"), F.when(F.col("p_size") % 3 == 0, "Female").alias("gender"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("race_or_ethnicity"),
        F.when(F.col("p_size") % 7 == 0, "Welsh").alias("accent"), F.lit("unknown").alias("occupation"), F.array("p_type").alias("personality"), F.array(F.concat_ws(" ", F.element_at(words, 1), place)).alias("aliases"),
    )


def stored(spark, sf_dir):
    """The registry: the first parts of each place."""
    return M.profiled(people(spark, sf_dir).filter(f"k < {STORED}")).withColumnRenamed("name", "display_name").withColumn("role_id", F.col("profile_id"))


PEOPLE_SQL = f"""p AS (SELECT p_partkey AS o, p_partkey // {PLACE} AS g, p_partkey % {PLACE} AS k, string_split(p_name, ' ')[-1] || ' at' || (p_partkey // {PLACE}) AS name, string_split(p_name, ' ')[1] || ' at' || (p_partkey // {PLACE}) AS alias, {slug(f"p_brand || ' at' || (p_partkey // {PLACE})")} AS person,
CASE p_size % 5 WHEN 0 THEN 'child' WHEN 1 THEN 'adult' ELSE 'unknown' END AS st, CASE WHEN p_size % 3 = 0 THEN 'female' ELSE 'unknown' END AS gender, CASE WHEN p_size % 2 = 0 THEN p_type END AS race, CASE WHEN p_size % 7 = 0 THEN 'Welsh' END AS accent, p_type FROM part),
q AS (SELECT *, CASE WHEN st = 'unknown' THEN person ELSE person || '_' || st END AS role_id, CASE WHEN st = 'unknown' THEN [alias] ELSE [alias, name || ' ' || st] END AS aliases FROM p)"""


def _list(c):
    return F.array_join(c, "|")


@query("merged_registry", f"""WITH RECURSIVE {PEOPLE_SQL},
w AS (SELECT o, g, k, st, list_transform(aliases || [role_id, name, person], lambda x: {name_key('x')}) AS has, list_transform(aliases || [role_id, name] || CASE WHEN st = 'unknown' THEN [person] ELSE [] END, lambda x: {name_key('x')}) AS asks, list_transform(aliases || [name], lambda x: {name_key('x')}) AS leaves FROM q),
s AS (SELECT g, -1 AS k, 0::BIGINT AS o, 0::BIGINT AS record, []::STRUCT(o BIGINT, st VARCHAR, names VARCHAR[])[] AS recs FROM w GROUP BY g
  UNION ALL SELECT g, k, o, coalesce(hit, o), CASE WHEN hit IS NULL THEN list_append(recs, {{'o': o, 'st': st, 'names': has}}) ELSE list_transform(recs, lambda x: CASE WHEN x.o = hit THEN {{'o': x.o, 'st': CASE WHEN x.st = 'unknown' THEN st ELSE x.st END, 'names': x.names || leaves}} ELSE x END) END
  FROM (SELECT w.g, w.k, w.o, w.st, w.has, w.leaves, recs, CASE WHEN w.k >= {STORED} THEN list_filter(recs, lambda x: list_has_any(x.names, w.asks) AND (x.st = 'unknown' OR w.st = 'unknown' OR x.st = w.st))[1].o END AS hit FROM s JOIN w ON w.g = s.g AND w.k = s.k + 1)),
m AS (SELECT q.*, s.record, n.name AS shown FROM s JOIN q ON q.o = s.o JOIN q AS n ON n.o = s.record WHERE s.k >= 0),
a0 AS (SELECT record, o, unnest(aliases || CASE WHEN o <> record AND {name_key('name')} <> {name_key('shown')} THEN [name] ELSE [] END) AS a, generate_subscripts(aliases || CASE WHEN o <> record AND {name_key('name')} <> {name_key('shown')} THEN [name] ELSE [] END, 1) AS i FROM m),
a1 AS (SELECT record, arg_min(a, o * 10 + i) AS a, min(o * 10 + i) AS z FROM a0 GROUP BY record, {name_key('a')}),
a AS (SELECT record, string_agg(a, '|' ORDER BY z) AS aliases FROM a1 GROUP BY record),
t1 AS (SELECT record, arg_min(p_type, o) AS t, min(o) AS z FROM m GROUP BY record, {name_key('p_type')}),
t AS (SELECT record, string_agg(t, '|' ORDER BY z) AS personality FROM t1 GROUP BY record),
f AS (SELECT record, count(*) AS n_rows, coalesce(arg_min(st, o) FILTER (st <> 'unknown'), 'unknown') AS age_stage, coalesce(arg_min(gender, o) FILTER (gender <> 'unknown'), 'unknown') AS gender, arg_min(race, o) AS race, arg_min(accent, o) AS accent FROM m GROUP BY record)
SELECT rank() OVER (ORDER BY record >= 0 AND q.k >= {STORED}, record) AS ord, role_id, name AS display_name, person AS person_id, f.age_stage, f.gender, f.race AS race_or_ethnicity, f.accent, personality, a.aliases, n_rows FROM f JOIN q ON q.o = record JOIN a USING (record) JOIN t USING (record)""")
def merged_registry(spark, sf_dir):
    """Part of the places' people are stored, the rest come as a batch; a row may match only by an alias that another left a record."""
    out = M.merged(stored(spark, sf_dir), people(spark, sf_dir).filter(f"k >= {STORED}"))
    place = out.select(F.col("ord").alias("__ord"), "role_id", "display_name", "person_id", "age_stage", "gender", "race_or_ethnicity", "accent", _list("personality").alias("personality"), _list("aliases").alias("aliases"), "n_rows")
    numbered = running_sum(place.withColumn("__one", F.lit(1)).withColumn("__all", F.lit(0)), "__all", "__ord", "__one", "__before")
    return numbered.withColumn("ord", F.col("__before") + 1).drop("__one", "__all", "__ord", "__before")


@query("inserted_batch", f"""WITH RECURSIVE {PEOPLE_SQL},
w AS (SELECT o, g, k, role_id, list_transform(aliases || [role_id], lambda x: {name_key('x')}) AS claims, {name_key('name')} AS n FROM q),
s AS (SELECT g, -1 AS k, 0::BIGINT AS o, '' AS role_id, NULL::VARCHAR AS taken_by, []::STRUCT(role_id VARCHAR, names VARCHAR[])[] AS held FROM w GROUP BY g
  UNION ALL SELECT g, k, o, role_id, hit, CASE WHEN hit IS NULL THEN list_append(held, {{'role_id': role_id, 'names': claims}}) ELSE held END
  FROM (SELECT w.*, held, CASE WHEN w.k >= {STORED} THEN list_filter(held, lambda x: list_has_any(x.names, w.claims || [w.n]))[1].role_id END AS hit FROM s JOIN w ON w.g = s.g AND w.k = s.k + 1))
SELECT o AS ord, role_id, taken_by IS NULL AS accepted, taken_by FROM s WHERE k >= {STORED}""")
def inserted_batch(spark, sf_dir):
    """The same batch, where a name that is taken, by a stored role or by an accepted row before, keeps a row out."""
    return M.inserted(stored(spark, sf_dir), M.profiled(people(spark, sf_dir).filter(f"k >= {STORED}")))
