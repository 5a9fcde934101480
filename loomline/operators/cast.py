"""Speakers of chapters and characters of books: lookups with fallbacks, matches for merging, conversions, derived voices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import voice as V
from ..functions.text import name_key, slug
from .lookup import resolve
from .sequence import numbered

# Character columns that are no longer kept.
DEPRECATED = ("age", "timeline", "same_person_as", "character_profile", "narrative_notes", "first_seen", "global_evidence", "voice_variants")


def spaced(c: str | Column) -> Column:
    return F.replace(F.col(c) if isinstance(c, str) else c, F.lit("_"), F.lit(" "))


def _names(df: DataFrame, keep: list[str], *names: Column | str, more: str | None = None) -> DataFrame:
    """keep and key: one row for each normalised name."""
    every = F.array(*names)
    if more:
        every = F.concat(every, F.coalesce(more, F.array().cast("array<string>")))
    rows = df.select(*keep, F.explode(F.array_distinct(F.transform(F.array_compact(every), name_key))).alias("key"))
    return rows.filter("key <> ''")


def temp_voices(lines: DataFrame, speakers: DataFrame, chapter: str = "chapter", role: str = "role") -> DataFrame:
    """lines with temp_role_id and temp_path of their chapter's first temporary speaker of that name.

    speakers: chapter, ord, local_id, label, role_id, legacy_names, voice_config_path.
    """
    names = _names(speakers, [chapter, "ord", "role_id", "voice_config_path"], "local_id", "label", "role_id", spaced("role_id"), more="legacy_names")
    first = names.groupBy(chapter, "key").agg(F.min_by("role_id", "ord").alias("temp_role_id"), F.min_by("voice_config_path", "ord").alias("temp_path"))
    return lines.withColumn("key", name_key(F.col(role))).join(first, [chapter, "key"], "left").drop("key")


def effective_roles(lines: DataFrame, registry: DataFrame, speakers: DataFrame, role: str = "role") -> DataFrame:
    """lines with role_id and how: as lookup.resolve finds it (narrator, direct, short), else temp, else none."""
    known = resolve(lines.select(F.col(role).alias("__name")).distinct(), registry, "__name").select("__name", F.col("role_id").alias("__id"), "how")
    met = temp_voices(lines, speakers, role=role).join(known, F.col(role) == F.col("__name"), "left")
    how = F.when(F.col("__id").isNotNull(), F.col("how")).when(F.col("temp_role_id").isNotNull(), "temp").otherwise("none")
    return met.select(*lines.columns, F.coalesce("__id", "temp_role_id").alias("role_id"), how.alias("how"))


def canonical_names(names: DataFrame, registry: DataFrame, name: str = "name") -> DataFrame:
    """names with canonical: the display name of the first role that has the name; where several roles share that display name,
    the alias as the role spells it, or the display name with the age stage, or the role's id in words. Unknown names stay."""
    shown = registry.withColumn("__shared", F.count("*").over(Window.partitionBy(name_key(F.col("display_name")))) > 1)
    stage = F.btrim(spaced(F.coalesce("age_stage", F.lit(""))))
    staged = F.when((F.btrim("display_name") != "") & ~F.lower(stage).isin("", "unknown"), F.concat_ws(" ", F.btrim("display_name"), stage))
    plain = F.when(F.col("display_name") != "", F.col("display_name"))
    other = F.coalesce(staged, spaced("role_id"))
    each = shown.select("ord", "__shared", plain.alias("__plain"), other.alias("__other"), F.explode(F.concat(F.transform(F.array_compact(F.array("display_name", "role_id", spaced("role_id"))), lambda n: F.struct(n.alias("n"), F.lit(False).alias("alias"))), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda n: F.struct(n.alias("n"), F.lit(True).alias("alias"))))).alias("__x"))
    keyed = each.select("ord", "__shared", "__plain", "__other", name_key(F.col("__x.n")).alias("__k"), F.when(F.col("__x.alias") & (F.btrim("__x.n") != ""), F.col("__x.n")).alias("__alias")).filter("__k <> ''")
    perrole = keyed.groupBy("__k", "ord").agg(F.first("__shared").alias("__shared"), F.first("__plain").alias("__plain"), F.first("__other").alias("__other"), F.min("__alias").alias("__alias"))
    said = F.when(F.col("__shared"), F.coalesce("__alias", "__other")).otherwise(F.col("__plain"))
    first = perrole.groupBy("__k").agg(F.min_by(said, "ord").alias("__said"))
    met = names.withColumn("__k", name_key(F.col(name))).join(first, "__k", "left")
    return met.select(*names.columns, F.when(F.col("__k") == "narrator", "Narrator").otherwise(F.coalesce("__said", F.col(name))).alias("canonical"))


def merge_matches(incoming: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """key, role_id: the first role that shares a name with a record and whose known age stage doesn't differ from its known one.

    incoming: key, name, profile_id, person_id, aliases, age_stage; registry: ord, role_id, profile_id, person_id, display_name, aliases, age_stage.
    """
    stage = lambda c: F.replace(F.lower(F.btrim(F.coalesce(c, F.lit("unknown")))), F.lit(" "), F.lit("_"))
    unknown = stage("age_stage").isin("", "unknown")
    mine = _names(incoming.withColumn("__stage", stage("age_stage")), [key, "__stage"], "name", "profile_id", spaced("profile_id"), F.when(unknown, F.col("person_id")), more="aliases")
    theirs = _names(registry.withColumn("__other", stage("age_stage")), ["ord", "role_id", "__other"], "role_id", spaced("role_id"), "profile_id", spaced("profile_id"), "display_name", "person_id", more="aliases")
    clash = ~F.col("__stage").isin("", "unknown") & ~F.col("__other").isin("", "unknown") & (F.col("__stage") != F.col("__other"))
    # a name that many roles have joins as one row for each age stage, that of its first role
    first = theirs.groupBy("key", "__other").agg(F.min_by("role_id", "ord").alias("role_id"), F.min("ord").alias("ord"))
    met = mine.join(first, "key").filter(~clash)
    return met.groupBy(key).agg(F.min_by("role_id", "ord").alias("role_id"))


def first_of(rows: DataFrame, left: DataFrame, key: str, order: str, either: list[tuple[str, str]], value: str) -> DataFrame:
    """left with value of the first of rows (by order) that agrees in any of the pairs (column of left, column of rows): one
    equi-join for each pair instead of a nested loop, with the first row of each column's value alone."""
    firsts = lambda c: rows.groupBy(F.col(c).alias("__k")).agg(F.min_by(value, order).alias(value), F.min(order).alias(order))
    parts = [left.select(key, F.col(mine).alias("__k")).join(firsts(theirs), "__k").select(key, order, value) for mine, theirs in either]
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    first = every.groupBy(key).agg(F.min_by(value, order).alias(value))
    return left.join(first, key, "left")


def by_display_name(compact: DataFrame, roles: DataFrame, name: str, order: str) -> DataFrame:
    """roles (role_id, display_name) with the columns of the last compact row of the same normalised name."""
    columns = [c for c in compact.columns if c not in (name, order)]
    last = compact.groupBy(name_key(F.col(name)).alias("__k")).agg(F.max_by(F.struct(*columns), order).alias("__x"))
    met = roles.withColumn("__k", name_key(F.coalesce(F.nullif("display_name", F.lit("")), F.col("role_id")))).join(last, "__k", "left")
    return met.select(*roles.columns, *[F.col(f"__x.{c}").alias(c) for c in columns])


def requested(existing: DataFrame, wanted: DataFrame, key: str, order: str) -> DataFrame:
    """key, position: the requested keys that exist, in the order of the request; all of them, sorted, if nothing is requested."""
    none = wanted.agg(F.count("*").alias("__n"))  # one row
    asked = wanted.groupBy(key).agg(F.min(order).alias("__o"))
    met = existing.select(key).distinct().join(asked, key, "left").crossJoin(F.broadcast(none)).filter(F.col("__o").isNotNull() | (F.col("__n") == 0))
    return numbered(met.select(key, "__o"), [F.col("__o").asc_nulls_last(), F.col(key)], "position", 0).drop("__o")


def legacy_speakers(existing: DataFrame, legacy: DataFrame, chapter: str = "chapter") -> DataFrame:
    """chapter, pos, local_id, label: a chapter's local speakers, then older records as local speakers, tmp_00n by their place after
    the existing ones; those whose id is taken drop out. existing, legacy: chapter, pos, and local_id and label or name."""
    counts = existing.groupBy(chapter).agg(F.count("*").alias("__n"))
    place = F.row_number().over(Window.partitionBy(chapter).orderBy("pos"))
    index = F.coalesce("__n", F.lit(0)) + place
    label = F.coalesce(F.nullif(F.btrim("name"), F.lit("")), F.concat(F.lit("Temporary speaker "), index.cast("string")))
    new = legacy.join(counts, chapter, "left").select(chapter, index.cast("long").alias("pos"), F.format_string("tmp_%03d", index.cast("int")).alias("local_id"), label.alias("label"))
    taken = existing.select(chapter, name_key(F.coalesce(F.nullif("local_id", F.lit("")), F.nullif("label", F.lit("")))).alias("__k"))
    new = new.withColumn("__k", name_key(F.col("local_id"))).join(taken.distinct(), [chapter, "__k"], "left_anti").drop("__k")
    old = existing.select(chapter, F.row_number().over(Window.partitionBy(chapter).orderBy("pos")).cast("long").alias("pos"), "local_id", "label")
    return old.unionByName(new)


def chapter_speakers(speakers: DataFrame, book: str, chapter: str = "chapter") -> DataFrame:
    """A chapter's local speakers as voice records: local_id (slug; later ones of the same get _2, _3 ...), label, role_id, seed,
    labels, description, instruction, voice_config_path. speakers: chapter, pos, local_id, label, age_stage, gender, personality, race, accent."""
    index = F.row_number().over(Window.partitionBy(chapter).orderBy("pos"))
    raw = slug(F.coalesce("local_id", F.lit("")))
    base = speakers.withColumns({"__i": index}).withColumn("__base", F.when(raw != "", raw).otherwise(F.format_string("tmp_%03d", "__i")))
    again = F.row_number().over(Window.partitionBy(chapter, "__base").orderBy("pos"))
    ids = base.withColumn("__again", again).withColumn("local_id", F.when(F.col("__again") == 1, F.col("__base")).otherwise(F.concat_ws("_", "__base", F.col("__again").cast("string"))))
    label = F.coalesce(F.nullif(F.btrim(F.coalesce("label", F.lit(""))), F.lit("")), F.concat(F.lit("Temporary speaker "), F.col("__i").cast("string")))
    rows = ids.withColumns({"label": label, "role_id": F.concat_ws("_", slug(F.col(chapter)), "local_id")}).withColumn("seed", V.seed(F.lit(book), F.col("role_id")))
    description, instruction = V.profile(F.col("label"), F.col("age_stage"), F.col("gender"), F.col("personality"), F.col("race"), F.col("accent"))
    path = F.concat(F.lit("voices/_temp/"), F.col(chapter), F.lit("/"), F.col("local_id"), F.lit(".qvp"))
    return rows.select(chapter, "local_id", "label", "role_id", "seed", V.labels(F.col("seed")).alias("labels"), description.alias("description"), V.with_labels(instruction, V.labels(F.col("seed"))).alias("instruction"), path.alias("voice_config_path"))


def canonical_quotes(roles: DataFrame, quotes: DataFrame, locals_: DataFrame, aliases: DataFrame, chapter: str = "chapter") -> DataFrame:
    """quotes with the role that stands for them: narrator quotes speak as Narrator, local speakers keep their ids, names that one
    role alone has become its id, others stay. roles: chapter, role_idx, role; quotes: chapter, idx, role_idx, kind; locals_: chapter,
    local_id; aliases: alias, role_id, unique. Numbering what is left is script.pruned's work."""
    mine = locals_.select(chapter, name_key(F.col("local_id")).alias("__k")).filter("__k <> ''").distinct().withColumn("__local", F.lit(True))
    named = roles.withColumn("__k", name_key(F.col("role"))).join(mine, [chapter, "__k"], "left").join(aliases.select(F.col("alias").alias("__k"), F.col("role_id").alias("__id")), "__k", "left")
    said = F.when(F.col("__k") == "narratorquote", "Narrator").when(F.col("__local"), F.col("role")).otherwise(F.coalesce("__id", "role"))
    met = quotes.join(named.select(chapter, "role_idx", said.alias("role")), [chapter, "role_idx"], "left")
    return met.withColumn("role", F.when(F.col("kind") == "narrator_quote", "Narrator").otherwise(F.col("role")))


def spoken_locals(locals_: DataFrame, quotes: DataFrame, chapter: str = "chapter") -> DataFrame:
    """locals_ without those that only narrator quotes name. quotes: chapter, role, kind, before they are made canonical."""
    use = quotes.groupBy(chapter, name_key(F.col("role")).alias("__k")).agg(F.bool_and(F.col("kind") == "narrator_quote").alias("__only"))
    keyed = locals_.withColumn("__k", name_key(F.col("local_id")))
    return keyed.join(use.filter("__only"), [chapter, "__k"], "left_anti").drop("__k")


def replaced(rows: DataFrame, approvals: DataFrame, chapter: str, role: str) -> DataFrame:
    """rows with roles put in place of others by approvals (chapter, old, new); names compare without case and marks."""
    swap = approvals.groupBy(chapter, name_key(F.col("old")).alias("__k")).agg(F.min("new").alias("__new"))
    met = rows.withColumn("__k", name_key(F.col(role))).join(swap, [chapter, "__k"], "left")
    return met.withColumn(role, F.coalesce("__new", role)).drop("__k", "__new")


def confirmed(roles: DataFrame, rows: DataFrame, registry: DataFrame, selections: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A chapter's annotation after each person in it was confirmed at one age stage: its roles, its rows, and the approvals.

    roles: chapter, role_idx, role; rows: with chapter and role_idx; registry: ord, role_id, profile_id, person_id, display_name, aliases, age_stage,
    role_name (as annotations name the role); selections: chapter, person_id, age_stage. A person without a selection keeps the stage of its
    first role; a stage that no record of the person has is an error. Roles of one person become that stage's role; the narrator and unknown roles
    stay. New roles are numbered densely in the order of the old ones, each once, and rows follow. Approvals: chapter, person_id, name, age_stage, role_name.
    Chapters whose roles changed are what library.cascaded takes as changed.
    """
    stage = lambda c: F.replace(F.lower(F.btrim(F.coalesce(c, F.lit("unknown")))), F.lit(" "), F.lit("_"))
    records = registry.withColumns({"__stage": stage("age_stage"), "__person": F.coalesce(F.nullif(F.btrim("person_id"), F.lit("")), F.col("role_id"))})
    found = resolve(roles.select(F.col("role").alias("__name")).distinct(), registry, "__name").filter("how in ('direct', 'short')").select("__name", "role_id")
    own = records.groupBy("role_id").agg(F.min_by(F.struct("__person", "__stage", "display_name"), "ord").alias("__r"))
    met = roles.join(found.join(own, "role_id"), F.col("role") == F.col("__name"), "left").select("chapter", "role_idx", "role", "__r")
    first = met.filter("__r is not null").groupBy("chapter", F.col("__r.__person").alias("__person")).agg(F.min_by("__r", "role_idx").alias("__first"))
    chosen = selections.groupBy("chapter", F.col("person_id").alias("__person")).agg(F.min(stage("age_stage")).alias("__asked"))
    options = records.groupBy("__person", "__stage").agg(F.min_by("role_name", "ord").alias("role_name"))
    people = first.join(chosen, ["chapter", "__person"], "left").withColumn("__stage", F.coalesce("__asked", "__first.__stage")).join(options, ["__person", "__stage"], "left")
    wrong = F.raise_error(F.concat(F.lit("no record of "), F.col("__person"), F.lit(" is "), F.col("__stage"))).cast("string")
    approvals = people.select("chapter", F.col("__person").alias("person_id"), F.col("__first.display_name").alias("name"), F.col("__stage").alias("age_stage"), F.coalesce("role_name", wrong).alias("role_name"))
    swap = approvals.select("chapter", F.col("person_id").alias("__person"), F.col("role_name").alias("__new"))
    said = met.withColumn("__person", F.col("__r.__person")).join(swap, ["chapter", "__person"], "left").select("chapter", "role_idx", F.coalesce("__new", "role").alias("role"))
    fresh = said.groupBy("chapter", "role").agg(F.min("role_idx").alias("__first"))
    fresh = fresh.select("chapter", "role", (F.row_number().over(Window.partitionBy("chapter").orderBy("__first")).cast("long") - 1).alias("__new"))
    moves = said.join(fresh, ["chapter", "role"]).select("chapter", "role_idx", "__new")
    moved = rows.join(moves, ["chapter", "role_idx"]).withColumn("role_idx", F.col("__new")).select(*rows.columns)
    return fresh.select("chapter", F.col("__new").alias("role_idx"), "role"), moved, approvals


def detected(registry: DataFrame, speakers: DataFrame, column: str, base: tuple[str, ...] = ()) -> DataFrame:
    """value, position: a base list, then the attribute's values in the registry, then those of chapters' speakers, each once by its
    normalised form, first spelling and place kept. registry: ord; speakers: chapter, pos."""
    spark = registry.sparkSession
    first = spark.createDataFrame([(0, str(i).zfill(6), 0, v) for i, v in enumerate(base)], "part int, a string, b long, value string")
    rows = first.union(registry.select(F.lit(1), F.lit(""), F.col("ord").cast("long"), column)).union(speakers.select(F.lit(2), F.col("chapter").cast("string"), F.col("pos").cast("long"), column))
    rows = rows.filter(F.btrim("value") != "")
    each = rows.groupBy(name_key(F.col("value")).alias("__k")).agg(F.min_by("value", F.struct("part", "a", "b")).alias("value"), F.min(F.struct("part", "a", "b")).alias("__at"))
    return numbered(each, [F.col("__at")], "position", 1).select("value", "position")


def known_names(registry: DataFrame, speakers: DataFrame | None = None) -> DataFrame:
    """name: every normalised name that a role, or a chapter's speaker, answers to."""
    out = _names(registry, ["role_id"], "role_id", spaced("role_id"), "display_name", more="aliases").select(F.col("key").alias("name"))
    if speakers is not None:
        out = out.union(_names(speakers, ["chapter"], "local_id", "label").select("key"))
    return out.distinct()


def migrated(characters: DataFrame, book: str) -> DataFrame:
    """Characters with every field that later steps need: ids and names from each other, seeds and labels from the id, the voice of
    an older default variant where there is no own one, its names as aliases; deprecated columns go.

    characters: profile_id, role_id, display_name, aliases, voice_config_path, voice_config_hash, seed, legacy (struct role_id, display_name, voice_config_path, voice_config_hash)."""
    given = lambda c: F.nullif(F.btrim(F.coalesce(c, F.lit(""))), F.lit(""))
    role = F.coalesce(given("role_id"), given("profile_id"), slug(F.coalesce("display_name", F.lit("character"))))
    old = F.array_compact(F.array(given("legacy.role_id"), given("legacy.display_name")))
    names = F.concat(F.coalesce("aliases", F.array().cast("array<string>")), old)
    rows = characters.withColumn("role_id", role).withColumn("seed", F.coalesce("seed", V.seed(F.lit(book), F.col("role_id"))))
    out = rows.withColumns({"display_name": F.coalesce(given("display_name"), F.col("role_id")), "aliases": F.array_distinct(names), "labels": V.labels(F.col("seed")), "voice_config_path": F.coalesce("voice_config_path", "legacy.voice_config_path"), "voice_config_hash": F.coalesce("voice_config_hash", given("legacy.voice_config_hash"))})
    return out.drop("legacy", *DEPRECATED)


def edited(stored: DataFrame, form: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The form's rows that change any of the fields; those of a changed row need a new voice: voice_config_hash is null in them."""
    old = stored.select(key, F.struct(*fields).alias("__old"))
    met = form.join(old, key).filter(~F.struct(*fields).eqNullSafe(F.col("__old"))).drop("__old")
    return met.withColumn("voice_config_hash", F.lit(None).cast("string"))


def forms(registry: DataFrame) -> DataFrame:
    """Characters as an editor shows them, by role_id: lists as text, an accent guessed from the race where there is none."""
    text = lambda c: F.coalesce(F.array_join(F.filter(F.transform(c, lambda x: F.btrim(x)), lambda x: x != ""), ", "), F.lit(""))
    given = lambda c: F.coalesce(F.btrim(c), F.lit(""))
    accent = F.when(given("accent") != "", given("accent")).otherwise(F.coalesce(V.accent(F.coalesce("race", F.lit(""))), F.lit("")))
    return registry.select("role_id", "voice_config_path", F.coalesce("display_name", F.lit("")).alias("display_name"), given("age_stage").alias("age_stage"), given("gender").alias("gender"), text("personality").alias("personality"), given("race").alias("race"), accent.alias("accent"), given("occupation").alias("occupation"), text("aliases").alias("aliases")).orderBy("role_id")


def patched(df: DataFrame, which: Column, values: dict[str, Column]) -> DataFrame:
    """df with the values in place of its columns where the condition holds."""
    return df.withColumns({c: F.when(which, v).otherwise(F.col(c)) for c, v in values.items()})
