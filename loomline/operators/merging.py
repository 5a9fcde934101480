"""Batches that enter a registry in order, where a row's outcome depends on what the rows before it became.

``merged`` takes every record in: it joins the first record that shares a name with it and has no other known age stage, fills
what that record lacks and leaves it its aliases, by which later rows may match; or it becomes a record. Only rows that are linked
by names, over any number of steps, can meet: these components are found by labels that names hand on, without pairs
of rows. Inside a component the order decides, so its rows are streamed in order through a state of names, as narrow rows of
keys; the records themselves are then filled by aggregates, which combine before they shuffle, so a record that a third of
all rows join is no heavy task. One component is one task, as its result is sequential by definition.

``inserted`` takes in only rows none of whose names is claimed by the registry or by an accepted row before them. Rows are
decided in rounds, by the least claim on each name, until none is open; a rejected row claims nothing.
"""

from __future__ import annotations

import bisect
import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import voice as V
from ..functions.text import name_key, slug
from ..session import scratch
from .sequence import ordered_fold

UNKNOWN = "unknown"
IDENTITY = ("gender", "race_or_ethnicity", "accent", "occupation")
LONG = ("long", pa.int64())


def _text(c: str | Column, default: str = "") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.nullif(F.btrim(c), F.lit("")), F.lit(default))


def _spaced(c: str) -> Column:
    return F.replace(F.col(c), F.lit("_"), F.lit(" "))


def _array(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def _met(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join of two tables that grow with the batch, by sorting: stored tables are compressed, so their sizes on disk, which the planner would go by, let it send whole ones to the driver."""
    return left.join(right.hint("merge"), on, how)


def _keys(*names: Column, more: Column | None = None) -> Column:
    """The distinct normalised names, without blanks and nulls."""
    every = F.array(*names) if more is None else F.concat(F.array(*names), more)
    return F.array_distinct(F.filter(F.transform(F.array_compact(every), name_key), lambda k: k != ""))


def profiled(incoming: DataFrame) -> DataFrame:
    """Incoming records with the ids, stage, accent and aliases that they get: profile_id is the slug of the one given, else of the
    person and the known stage; a name with the stage is an alias too. Rows without a name drop out.

    incoming: ord, name, profile_id, person_id, age_stage, gender, race_or_ethnicity, accent, occupation, personality, aliases.
    A name, person or profile id without a Latin letter or digit is an error, as it yields no id.
    """
    named = incoming.withColumn("name", _text("name")).filter("name <> ''")
    stage = F.replace(F.lower(_text("age_stage", UNKNOWN)), F.lit(" "), F.lit("_"))
    person = slug(F.coalesce(F.nullif(_text("person_id"), F.lit("")), F.col("name")), strict=True)
    own = F.when(_text("profile_id") != "", slug(F.col("profile_id"), strict=True))
    out = named.withColumns({"age_stage": stage, "person_id": person, "gender": F.lower(_text("gender", UNKNOWN)), "accent": F.coalesce(F.nullif(_text("accent"), F.lit("")), V.accent(F.col("race_or_ethnicity"))), "__own": own})
    known = F.col("age_stage") != UNKNOWN
    aged = F.when(known, F.array(F.concat_ws(" ", "name", _spaced("age_stage")))).otherwise(F.array().cast("array<string>"))
    out = out.withColumn("profile_id", F.coalesce("__own", F.when(known, F.concat_ws("_", "person_id", slug(F.col("age_stage")))).otherwise(F.col("person_id"))))
    return out.withColumn("aliases", F.concat(_array("aliases"), aged)).drop("__own")


def components(pairs: DataFrame, row: str, name: str) -> DataFrame:
    """row, component: the least row that is reachable over shared names. pairs: row (a whole number) and name, one row for each.

    Names hand the least label of their rows on, and labels are replaced by their own labels, so that chains shrink by half a
    round. Each name is aggregated, never paired, so one that a third of all rows share is one label.
    """
    scratch(pairs.sparkSession)
    pairs = pairs.select(F.col(row).alias("r"), F.col(name).alias("n")).distinct().checkpoint()
    labels = pairs.select("r").distinct().withColumn("c", F.col("r"))
    while True:
        least = _met(pairs, labels, "r").groupBy("n").agg(F.min("c").alias("m"))
        seen = _met(pairs, least, "n").groupBy("r").agg(F.min("m").alias("m"))
        over = labels.select(F.col("r").alias("m"), F.col("c").alias("cc"))
        new = _met(_met(labels, seen, "r"), over, "m", "left").select("r", F.least("c", "m", F.coalesce("cc", "m")).alias("new"), "c").checkpoint()
        if new.filter("new <> c").isEmpty():
            return new.select(F.col("r").alias(row), F.col("new").alias("component"))
        labels = new.select("r", F.col("new").alias("c"))


def _matcher():
    """A component's records so far: by name, the records that have it, the oldest first; and each record's stage."""
    having: dict[str, list[int]] = {}
    stages: dict[int, str] = {}

    def give(record: int, names: list[str]) -> None:
        for n in names:
            held = having.setdefault(n, [])
            i = bisect.bisect_left(held, record)
            if i == len(held) or held[i] != record:
                held.insert(i, record)

    def step(at: int, stage: str, record_names: list[str], asked: list[str] | None, left: list[str] | None):
        match = at
        for r in heapq.merge(*(having.get(n, ()) for n in asked or ())):
            if UNKNOWN in (stage, stages[r]) or stages[r] == stage:
                match = r
                break
        if match == at:
            stages[at] = stage
            give(at, record_names)
        else:
            if stages[match] == UNKNOWN:
                stages[match] = stage
            give(match, left)
        return (match,)

    return step


def matched(registry: DataFrame, incoming: DataFrame) -> DataFrame:
    """Both tables' rows as one: at (their place), record (the place of the row whose record they belong to), and their columns.

    registry: ord, role_id, profile_id, person_id, display_name, age_stage, gender, race_or_ethnicity, accent, occupation, personality, aliases,
    in the order ord; incoming: as profiled() gives it. Orders are whole numbers without repeats. No cell but ord need be filled.
    """
    stage = F.replace(F.lower(_text("age_stage", UNKNOWN)), F.lit(" "), F.lit("_"))
    common = ["person_id", "age_stage", *IDENTITY, "personality", "aliases"]
    last = registry.agg(F.coalesce(F.max("ord") + 1, F.lit(0))).first()[0]
    lowest = incoming.agg(F.min("ord")).first()[0] or 0
    base = last - lowest if lowest < last else 0
    names = ("role_id", "profile_id", "display_name")
    old = registry.select(F.col("ord").cast("long").alias("at"), *names, *common, stage.alias("__stage"), F.lit(False).alias("__asks"))
    new = incoming.select((F.col("ord") + base).cast("long").alias("at"), F.col("profile_id").alias("role_id"), "profile_id", F.col("name").alias("display_name"), *common, stage.alias("__stage"), F.lit(True).alias("__asks"))
    rows = old.unionByName(new)
    has = _keys(F.col("role_id"), _spaced("role_id"), F.col("profile_id"), _spaced("profile_id"), F.col("display_name"), F.col("person_id"), more=_array("aliases"))
    asks = _keys(F.col("display_name"), F.col("profile_id"), _spaced("profile_id"), F.when(F.col("__stage") == UNKNOWN, F.col("person_id")), more=_array("aliases"))
    scratch(rows.sparkSession)
    rows = rows.withColumns({"__has": has, "__asked": F.when(F.col("__asks"), asks), "__left": F.when(F.col("__asks"), _keys(F.col("display_name"), more=_array("aliases")))}).checkpoint()
    found = components(rows.select("at", F.explode("__has").alias("name")), "at", "name")
    narrow = _met(rows.select("at", "__stage", "__has", "__asked", "__left"), found, "at", "left").withColumn("component", F.coalesce("component", "at"))
    told = ordered_fold(narrow, "component", ["at"], _matcher, ["at", "__stage", "__has", "__asked", "__left"], {"record": LONG}).select("at", "record")
    return _met(rows, told, "at").select("at", "record", *names, *common)


def _gathered(rows: DataFrame, values: Column, name: str) -> DataFrame:
    """record and the values' first spellings by normalised name, in the order of rows and places."""
    each = rows.select("record", "at", F.posexplode(values).alias("__p", "__v")).select("record", F.struct("at", "__p").alias("__o"), "__v", name_key(F.col("__v")).alias("__k")).filter("__k <> ''")
    first = each.groupBy("record", "__k").agg(F.min("__o").alias("__o"), F.min_by("__v", "__o").alias("__v"))
    return first.groupBy("record").agg(F.transform(F.array_sort(F.collect_list(F.struct("__o", "__v"))), lambda x: x["__v"]).alias(name))


def merged(registry: DataFrame, incoming: DataFrame) -> DataFrame:
    """The registry after a batch: ord, role_id, profile_id, person_id, display_name, age_stage, gender, race_or_ethnicity, accent, occupation, personality, aliases, n_rows.

    Old records keep their place, new ones follow in the order of the rows that made them. A record keeps its own values; the first known one of the rows that
    join it fills an unknown one. Aliases and personality are distinct by normalised name, the first spelling stays; a joining row's name becomes
    an alias if it isn't the record's. Rows whose id a record of another known stage has make a record beside it. An empty batch changes nothing but repeated aliases.
    """
    rows = matched(registry, profiled(incoming)).checkpoint()
    own = rows.filter("at = record")
    known = lambda c: F.when(~F.coalesce(F.col(c), F.lit("")).isin("", UNKNOWN), F.col(c))
    filled = rows.groupBy("record").agg(F.count("*").alias("n_rows"), *[F.min_by(known(c), F.when(known(c).isNotNull(), F.col("at"))).alias(f"__{c}") for c in ("age_stage", *IDENTITY)])
    shown = own.select("record", name_key(F.coalesce("display_name", F.lit(""))).alias("__shown"))
    named = _met(rows, shown, "record")
    its = F.when((F.col("at") != F.col("record")) & (name_key(F.coalesce("display_name", F.lit(""))) != F.col("__shown")), F.array("display_name")).otherwise(F.array().cast("array<string>"))
    out = _met(own.drop("personality", "aliases", "at"), filled, "record")
    for name, values, source in (("personality", _array("personality"), rows), ("aliases", F.concat(_array("aliases"), its), named)):
        out = _met(out, _gathered(source, values, name), "record", "left").withColumn(name, _array(name))
    values = [F.coalesce(f"__{c}", c).alias(c) for c in ("age_stage", *IDENTITY)]
    return out.select(F.col("record").alias("ord"), "role_id", "profile_id", "person_id", "display_name", *values, "personality", "aliases", "n_rows")


def inserted(registry: DataFrame, incoming: DataFrame) -> DataFrame:
    """ord, role_id, accepted, taken_by: which rows of a batch may be inserted, and the role that holds a name of a rejected one (the first by place, then by id).

    A row claims its role id, the id in words and its aliases; its name, too, must be free, but isn't claimed. Ids and aliases of stored roles and
    "narrator" are taken. registry: ord, role_id, profile_id, aliases; incoming: as profiled() gives it. Equal rows: the first one stays.
    """
    spark = registry.sparkSession
    scratch(spark)
    rows = incoming.select(F.col("ord").cast("long").alias("at"), F.col("profile_id").alias("role_id"), _keys(F.col("profile_id"), _spaced("profile_id"), more=_array("aliases")).alias("claims"), F.col("name"))
    rows = rows.withColumn("needs", F.array_union("claims", _keys(F.col("name")))).checkpoint()
    stored = registry.select("ord", "role_id", F.explode(_keys(F.col("role_id"), _spaced("role_id"), F.col("profile_id"), _spaced("profile_id"), more=_array("aliases"))).alias("key"))
    stored = stored.unionByName(spark.range(1).select(F.lit(-1).alias("ord"), F.lit("narrator").alias("role_id"), F.lit("narrator").alias("key")))
    holder = lambda at, role: F.min(F.struct(at.cast("long").alias("at"), role.alias("role_id")))
    taken = stored.groupBy("key").agg(holder(F.col("ord"), F.col("role_id")).alias("held"))
    needs, claims = (rows.select("at", "role_id", F.explode(c).alias("key")).checkpoint() for c in ("needs", "claims"))
    met = _met(needs, taken, "key").groupBy("at").agg(F.min("held")["role_id"].alias("taken_by"))
    state = _met(rows.select("at"), met, "at", "left").select("at", F.when(F.col("taken_by").isNotNull(), False).alias("accepted"), "taken_by").checkpoint()
    while not state.filter("accepted is null").isEmpty():
        live = _met(claims, state.filter("accepted is null or accepted").select("at", "accepted"), "at")
        sure = F.when(F.col("accepted"), F.struct("at", "role_id"))
        least = live.groupBy("key").agg(F.min(sure).alias("sure"), F.min(F.when(F.col("accepted").isNull(), F.col("at"))).alias("open"))
        asked = _met(_met(needs, state.filter("accepted is null").select("at"), "at"), least, "key", "left")
        told = asked.groupBy("at").agg(F.min(F.when(F.col("sure.at") < F.col("at"), F.col("sure"))).alias("__by"), F.max(F.coalesce(F.col("open") < F.col("at"), F.lit(False))).alias("__waits"))
        decided = F.when(F.col("accepted").isNotNull(), F.col("accepted")).when(F.col("__by").isNotNull(), False).when(~F.coalesce("__waits", F.lit(False)), True)
        state = _met(state, told, "at", "left").select("at", decided.alias("accepted"), "taken_by").checkpoint()
    # only now is the first of the accepted rows known that holds a name
    first = _met(claims, state.filter("accepted").select("at"), "at").groupBy("key").agg(F.min(F.struct("at", "role_id")).alias("held"))
    lost = _met(_met(needs, state.filter("not accepted and taken_by is null").select("at"), "at"), first, "key").filter("held.at < at").groupBy("at").agg(F.min("held")["role_id"].alias("__by"))
    return _met(_met(rows.select("at", "role_id"), state, "at"), lost, "at", "left").select(F.col("at").alias("ord"), "role_id", "accepted", F.coalesce("taken_by", "__by").alias("taken_by"))
