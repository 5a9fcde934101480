"""Checks that return their findings as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import name_key


def coverage(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """key, error: missing (expected only), extra (actual only) or duplicate (more than once in actual)."""
    want = expected.select(key).distinct().withColumn("__e", F.lit(True))
    have = actual.groupBy(key).agg(F.count("*").alias("__n"))
    both = want.join(have, key, "full")
    errors = F.array_compact(F.array(F.when(F.col("__n").isNull(), "missing"), F.when(F.col("__e").isNull(), "extra"), F.when(F.col("__n") > 1, "duplicate")))
    return both.select(key, F.explode(errors).alias("error"))


# Kinds of quotes, and types of script rows in their order.
QUOTE_KINDS = ("dialogue", "narrator_quote")
ROW_TYPES = ("narration", "dialogue", "thought")


def _listed(errors: DataFrame, group: str) -> DataFrame:
    """group, errors: all errors of a group, by place and text, joined by "; ". errors: group, idx, error."""
    text = F.concat_ws(" ", "error", F.col("idx").cast("string"))
    each = F.array_sort(F.collect_list(F.struct(F.col("idx").isNull(), "idx", text.alias("t"))))
    return errors.groupBy(group).agg(F.array_join(F.transform(each, lambda x: x["t"]), "; ").alias("errors"))


def attribution_errors(quotes: DataFrame, rows: DataFrame, roles: DataFrame, known: DataFrame, locals_: DataFrame | None = None) -> DataFrame:
    """chapter, errors (joined by "; "): quotes without a row, rows without a quote, repeated rows; role numbers out of range; unknown
    kinds; dialogue by the narrator; roles that are neither known nor local; local speakers without dialogue.

    A row gives one error at most of those that look at its role and kind, in that order; narrator quotes have any role. quotes:
    chapter, idx; rows: chapter, idx, role_idx, kind; roles: chapter, role_idx, role; known: role; locals_: chapter, local_id.
    """
    found = coverage(quotes.select(F.struct("chapter", "idx").alias("q")), rows.select(F.struct("chapter", "idx").alias("q")), "q")
    found = found.select(F.col("q.chapter").alias("chapter"), F.col("q.idx").alias("idx"), F.concat(F.col("error"), F.lit(" quote")).alias("error"))
    if locals_ is None:
        locals_ = roles.select("chapter", F.col("role").alias("local_id")).limit(0)
    mine = locals_.select("chapter", name_key(F.col("local_id")).alias("k"), "local_id").filter("k <> ''").dropDuplicates(["chapter", "k"])
    names = known.select(name_key(F.col("role")).alias("k")).distinct().withColumn("known", F.lit(True))
    said = rows.join(roles.select("chapter", "role_idx", "role", F.lit(True).alias("there")), ["chapter", "role_idx"], "left").withColumn("k", name_key(F.col("role")))
    said = said.join(names, "k", "left").join(mine.select("chapter", "k", F.lit(True).alias("local")), ["chapter", "k"], "left")
    error = (
        F.when(F.col("there").isNull(), "role out of range")
        .when(~F.col("kind").isin(*QUOTE_KINDS) | F.col("kind").isNull(), "unknown kind")
        .when(F.col("kind") == "narrator_quote", None)
        .when(F.col("k") == "narrator", "Narrator cannot speak dialogue")
        .when(F.col("known").isNull() & F.col("local").isNull(), F.concat(F.lit("unknown role "), F.col("role"), F.lit(" of")))
    )
    wrong = said.select("chapter", "idx", error.alias("error")).filter("error IS NOT NULL")
    used = said.filter(F.col("kind").isin("dialogue") & F.col("local")).select("chapter", "k").distinct()
    idle = mine.join(used, ["chapter", "k"], "left_anti").select("chapter", F.lit(None).cast("long").alias("idx"), F.concat(F.lit("unused local speaker "), F.col("local_id")).alias("error"))
    return _listed(found.unionByName(wrong).unionByName(idle), "chapter")


def consolidation_errors(quotes: DataFrame, resolved: DataFrame, known: DataFrame) -> DataFrame:
    """chapter, errors: what is wrong with quotes to which a service or a match gave roles, as attribution_errors tells it.

    quotes: chapter, idx; resolved: chapter, idx, role (null: read by the narrator); known: role, the registry's. Each chapter's roles are numbered as
    they appear, so a row's role can't be out of range, and roles that the registry lacks are errors, as there are no local speakers.
    """
    said = resolved.withColumn("kind", F.when(F.col("role").isNull(), "narrator_quote").otherwise("dialogue")).withColumn("role", F.coalesce("role", F.lit("Narrator")))
    first = said.groupBy("chapter", "role").agg(F.min("idx").alias("__first"))
    roles = first.select("chapter", F.row_number().over(Window.partitionBy("chapter").orderBy("__first", "role")).cast("long").alias("role_idx"), "role")
    rows = said.join(roles, ["chapter", "role"]).select("chapter", "idx", "role_idx", "kind")
    return attribution_errors(quotes, rows, roles, known)


def script_errors(units: DataFrame, rows: DataFrame, roles: DataFrame, known: DataFrame, characters: DataFrame, speakers: DataFrame, types: tuple[str, ...] = ROW_TYPES, most_instruction: int = 240) -> DataFrame:
    """chapter, errors of an annotation script, a rule each:

    unit numbers missing, unknown or repeated; role and type numbers out of range; narration without the role Narrator; roles that
    are neither known nor declared; new characters without a name, with a taken name or id, an incomplete profile, an empty or
    too long voice instruction; local speakers without a label or id, or with an incomplete profile.

    units: chapter, idx; rows: chapter, idx, role_idx, type_idx; roles: chapter, role_idx, role; known: name; characters: chapter, pos,
    name, profile (struct profile_id, person_id, age_stage, gender, personality, aliases), voice (struct description, instruction, or null);
    speakers: chapter, pos, local_id, label, profile.
    """
    found = coverage(units.select(F.struct("chapter", "idx").alias("q")), rows.select(F.struct("chapter", "idx").alias("q")), "q")
    found = found.select(F.col("q.chapter").alias("chapter"), F.col("q.idx").alias("idx"), F.concat(F.col("error"), F.lit(" sentence")).alias("error"))
    sizes = roles.groupBy("chapter").agg(F.count("*").alias("n"), F.bool_or(F.col("role") == "Narrator").alias("narrator"))
    met = rows.join(sizes, "chapter", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ranges = met.select("chapter", "idx", F.explode(F.array_compact(F.array(F.when((F.col("role_idx") < 0) | (F.col("role_idx") >= F.col("n")), "role out of range at"), F.when((F.col("type_idx") < 0) | (F.col("type_idx") >= len(types)), "type out of range at")))).alias("error"))
    none = F.lit(None).cast("long").alias("idx")
    silent = met.filter((F.col("type_idx") == types.index("narration")) & ~F.coalesce("narrator", F.lit(False))).select("chapter").distinct().select("chapter", none, F.lit("narration without Narrator").alias("error"))
    taken = known.select(name_key(F.col("name")).alias("k")).filter("k <> ''").distinct()
    given = lambda c: F.coalesce(F.btrim(c), F.lit(""))
    person = F.when(given("profile.person_id") != "", given("profile.person_id")).otherwise(given("name"))
    own_id = F.when(given("profile.profile_id") != "", given("profile.profile_id")).otherwise(F.concat_ws("_", person, F.nullif(given("profile.age_stage"), F.lit(""))))
    shown = characters.withColumns({"__id": F.when(F.col("profile").isNotNull(), own_id), "__name": given("name")})
    declared = shown.select("chapter", F.explode(F.concat(F.array("__name", "__id"), F.coalesce("profile.aliases", F.array().cast("array<string>")))).alias("x")).union(speakers.select("chapter", F.explode(F.array("local_id", "label"))))
    declared = declared.select("chapter", name_key(F.col("x")).alias("k")).filter("k <> ''").distinct()
    lost = roles.withColumn("k", name_key(F.col("role"))).filter("k <> 'narrator'").join(taken, "k", "left_anti").join(declared, ["chapter", "k"], "left_anti")
    lost = lost.select("chapter", none, F.concat(F.lit("unknown role "), F.col("role")).alias("error"))

    def profile_rules(who: Column) -> list[Column]:
        whole = F.col("profile").isNotNull()
        trait_ok = F.coalesce((F.size("profile.personality") > 0) & F.forall("profile.personality", lambda x: F.coalesce(F.btrim(x), F.lit("")) != ""), F.lit(False))
        out = [F.when(~whole, F.concat(F.lit("no profile of "), who))]
        out += [F.when(whole & (given(f"profile.{f}") == ""), F.concat(F.lit(f"no {f} of "), who)) for f in ("age_stage", "gender")]
        return [*out, F.when(whole & ~trait_ok, F.concat(F.lit("no personality of "), who))]

    keyed = shown.withColumns({"__k1": name_key(F.col("__name")), "__k2": name_key(F.col("__id"))})
    keyed = keyed.join(taken.select(F.col("k").alias("__k1"), F.lit(True).alias("__t1")), "__k1", "left").join(taken.select(F.col("k").alias("__k2"), F.lit(True).alias("__t2")), "__k2", "left")
    spoken = F.col("voice").isNotNull()
    rules = [F.when(F.col("__t1"), F.concat(F.lit("taken name "), F.col("__name"))), F.when(F.col("__t2"), F.concat(F.lit("taken name "), F.col("__id"))), *profile_rules(F.col("__name"))]
    rules += [F.when(spoken & (given(f"voice.{f}") == ""), F.concat(F.lit(f"no voice {f} of "), F.col("__name"))) for f in ("description", "instruction")]
    rules.append(F.when(spoken & (F.length("voice.instruction") > most_instruction), F.concat(F.lit("long voice instruction of "), F.col("__name"))))
    people = keyed.select("chapter", none, F.explode(F.array_compact(F.when(F.col("__name") == "", F.array(F.lit("character without name"))).otherwise(F.array(*rules)))).alias("error"))
    label = F.coalesce(F.nullif(given("label"), F.lit("")), given("local_id"))
    local_rules = [F.when(given("local_id") == "", F.concat(F.lit("no local_id of "), label)), *profile_rules(label)]
    local = speakers.select("chapter", none, F.explode(F.array_compact(F.when(label == "", F.array(F.lit("speaker without label"))).otherwise(F.array(*local_rules)))).alias("error"))
    every = found
    for more in (ranges, silent, lost, people, local):
        every = every.unionByName(more)
    return _listed(every, "chapter")


def positions(saved: DataFrame, units: DataFrame, key: str, unit: str) -> DataFrame:
    """saved with valid: whether the chapter has the unit that the reader stopped at."""
    there = units.select(key, unit).distinct().withColumn("__there", F.lit(True))
    return saved.join(there, [key, unit], "left").withColumn("valid", F.col("__there").isNotNull()).drop("__there")


def package_errors(members: DataFrame, key: str, path: str, required: tuple[str, ...], patterns: dict[str, str]) -> DataFrame:
    """key, errors: required members that an archive lacks, sorted, then the kinds of members of which it has none."""
    have = members.groupBy(key).agg(F.collect_set(F.when(F.col(path).isin(*required), F.col(path))).alias("__have"), *[F.bool_or(F.regexp_like(F.col(path), F.lit(p))).alias(f"__{i}") for i, p in enumerate(patterns.values())])
    missing = F.array_sort(F.array_except(F.array(*[F.lit(r) for r in required]), "__have"))
    kinds = F.array_compact(F.array(*[F.when(~F.col(f"__{i}"), F.lit(n)) for i, n in enumerate(patterns)]))
    return have.select(key, F.array_join(F.concat(missing, kinds), ",").alias("errors")).filter("errors <> ''")


def unused(declared: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """Declared keys that nothing uses."""
    return declared.select(key).distinct().join(used.select(key).distinct(), key, "left_anti")


def same_bags(left: DataFrame, right: DataFrame, group: str, value: str) -> DataFrame:
    """group, same: whether both sides hold the same values equally often in the group."""
    n = lambda df, name: df.groupBy(group, value).agg(F.count("*").alias(name))
    both = n(left, "a").join(n(right, "b"), [group, value], "full")
    return both.groupBy(group).agg(F.bool_and(F.col("a").eqNullSafe(F.col("b"))).alias("same"))


def one_rate(df: DataFrame, group: str, rate: str) -> DataFrame:
    """group, rate, and an error where rows differ in it."""
    return df.groupBy(group).agg(F.min(rate).alias(rate), F.when(F.count_distinct(rate) > 1, "mixed sample rates").alias("error"))
