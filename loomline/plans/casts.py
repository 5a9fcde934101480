"""Queries on speakers, characters, voices and the library of books."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import voice as V
from ..operators import cast as C
from ..operators import library as B
from .base import Plan, name_key, reader, slug
from .tables import LABELS_SQL, REG_SQL, registry

PLAN = Plan()
query, QUERIES, SQL = PLAN.query, PLAN.QUERIES, PLAN.SQL
conversations, part, customer, nation, supplier, documents, labels, orders = map(reader, ("conversations", "part", "customer", "nation", "supplier", "documents", "labels", "orders"))


def none():
    return F.lit(None).cast("string")


def speakers(spark, sf_dir):
    """Every role of a conversation but the user as a temporary speaker of that chapter."""
    c = conversations(spark, sf_dir).filter("role <> 'user'")
    return c.groupBy(F.col("conv_id").alias("chapter"), F.col("role").alias("label")).agg(F.min("turn").alias("ord")).select("chapter", "ord", F.format_string("tmp_%03d", F.col("ord") + 1).alias("local_id"), "label", F.concat_ws("_", F.lit("c"), F.col("chapter").cast("string"), "label").alias("role_id"), F.array(F.concat(F.lit("old "), "label")).alias("legacy_names"), F.concat(F.lit("voices/_temp/"), "label").alias("voice_config_path"))


SPEAKERS_SQL = "sp AS (SELECT conv_id AS chapter, role AS label, min(turn) AS ord, 'c_' || conv_id || '_' || role AS role_id FROM conversations WHERE role <> 'user' GROUP BY conv_id, role)"
LINES_SQL = "ln AS (SELECT conv_id AS chapter, turn, CASE turn % 3 WHEN 0 THEN role WHEN 1 THEN 'Old ' || upper(role) ELSE 'narrator' END AS said, role FROM conversations)"


def said(spark, sf_dir):
    t = F.col("turn") % 3
    return conversations(spark, sf_dir).select(F.col("conv_id").alias("chapter"), "turn", F.when(t == 0, F.col("role")).when(t == 1, F.concat(F.lit("Old "), F.upper("role"))).otherwise("narrator").alias("role"))


@query("temp_voices", f"WITH {SPEAKERS_SQL}, {LINES_SQL} SELECT ln.chapter, turn, sp.role_id AS temp_role_id, 'voices/_temp/' || sp.label AS temp_path FROM ln LEFT JOIN sp ON sp.chapter = ln.chapter AND ({name_key('said')} = {name_key('label')} OR {name_key('said')} = {name_key(chr(39) + 'old ' + chr(39) + ' || label')})")
def temp_voices(spark, sf_dir):
    return C.temp_voices(said(spark, sf_dir), speakers(spark, sf_dir)).select("chapter", "turn", "temp_role_id", "temp_path")


@query("effective_roles", f"WITH {SPEAKERS_SQL}, {LINES_SQL} SELECT ln.chapter, turn, CASE WHEN said = 'narrator' THEN 'narrator' ELSE sp.role_id END AS role_id, CASE WHEN said = 'narrator' THEN 'narrator' WHEN sp.role_id IS NULL THEN 'none' ELSE 'temp' END AS how FROM ln LEFT JOIN sp ON sp.chapter = ln.chapter AND ({name_key('said')} = {name_key('label')} OR {name_key('said')} = {name_key(chr(39) + 'old ' + chr(39) + ' || label')})")
def effective_roles(spark, sf_dir):
    return C.effective_roles(said(spark, sf_dir), registry(spark, sf_dir), speakers(spark, sf_dir)).select("chapter", "turn", "role_id", "how")


@query("canonical_names", f"""WITH {REG_SQL}, s AS (SELECT *, count(*) OVER (PARTITION BY {name_key('display_name')}) > 1 AS shared FROM reg),
n AS (SELECT ord, unnest([display_name, role_id, replace(role_id, '_', ' ')]) AS n, shared, display_name, age_stage, role_id, NULL AS al FROM s UNION ALL SELECT ord, alias1, shared, display_name, age_stage, role_id, alias1 FROM s),
k AS (SELECT {name_key('n')} AS k, ord, any_value(shared) AS shared, any_value(display_name) AS d, any_value(CASE WHEN age_stage <> '' THEN display_name || ' ' || age_stage ELSE replace(role_id, '_', ' ') END) AS o, min(al) AS al FROM n GROUP BY 1, 2),
f AS (SELECT k, arg_min(CASE WHEN shared THEN coalesce(al, o) ELSE d END, ord) AS canonical FROM k GROUP BY k),
q AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'NARRATOR.' WHEN 1 THEN upper(p_brand) || ' ' || p_partkey WHEN 2 THEN string_split(p_name, ' ')[1] || '  ' || coalesce(string_split(p_name, ' ')[2], '') ELSE 'nobody ' || p_partkey END AS name FROM part)
SELECT p_partkey, CASE WHEN {name_key('name')} = 'narrator' THEN 'Narrator' ELSE coalesce(canonical, name) END AS canonical FROM q LEFT JOIN f ON f.k = {name_key('name')}""")
def canonical_names(spark, sf_dir):
    words, k, n = F.split("p_name", " "), F.col("p_partkey") % 4, F.col("p_partkey").cast("string")
    name = F.when(k == 0, "NARRATOR.").when(k == 1, F.concat_ws(" ", F.upper("p_brand"), n)).when(k == 2, F.concat(F.element_at(words, 1), F.lit("  "), F.coalesce(F.try_element_at(words, F.lit(2)), F.lit("")))).otherwise(F.concat_ws(" ", F.lit("nobody"), n))
    return C.canonical_names(part(spark, sf_dir).select("p_partkey", name.alias("name")), registry(spark, sf_dir)).select("p_partkey", "canonical")


@query("merge_matches", f"""WITH {REG_SQL}, i AS (SELECT p_partkey AS id, string_split(p_name, ' ')[1] || ' ' || coalesce(string_split(p_name, ' ')[2], '') AS name, CASE WHEN p_partkey % 2 = 0 THEN 'Adult' ELSE 'unknown' END AS st FROM part),
n AS (SELECT ord, role_id, CASE WHEN age_stage = '' THEN 'unknown' ELSE age_stage END AS st, unnest([role_id, replace(role_id, '_', ' '), profile_id, replace(profile_id, '_', ' '), display_name, alias1]) AS n FROM reg),
m AS (SELECT id, ord, role_id FROM i JOIN n ON {name_key('i.name')} = {name_key('n')} WHERE i.st = 'unknown' OR n.st = 'unknown' OR n.st = 'adult')
SELECT id, arg_min(role_id, ord) AS role_id FROM m GROUP BY id""")
def merge_matches(spark, sf_dir):
    words = F.split("p_name", " ")
    name = F.concat(F.element_at(words, 1), F.lit(" "), F.coalesce(F.try_element_at(words, F.lit(2)), F.lit("")))
    new = part(spark, sf_dir).select(F.col("p_partkey").alias("id"), name.alias("name"), none().alias("profile_id"), none().alias("person_id"), F.array().cast("array<string>").alias("aliases"), F.when(F.col("p_partkey") % 2 == 0, "Adult").otherwise("unknown").alias("age_stage"))
    return C.merge_matches(new, registry(spark, sf_dir).withColumn("person_id", none()), "id")


ACCENTS = [*V.ACCENT_INSTRUCTIONS, "Upper-Class British", " tokyo ", "New York", "Maltese", ""]


@query("accent_instructions", f"""WITH a AS (SELECT p_partkey, {ACCENTS!r}[p_partkey % {len(ACCENTS)} + 1] AS accent FROM part),
t AS (SELECT unnest({list(V.ACCENT_INSTRUCTIONS)!r}) AS k, unnest([{", ".join("'" + x.replace("'", "''") + "'" for x in V.ACCENT_INSTRUCTIONS.values())}]) AS said)
SELECT p_partkey, CASE WHEN trim(accent) = '' THEN '' ELSE coalesce(said, trim(accent) || '{V.OTHER_ACCENT}') END AS instruction FROM a LEFT JOIN t ON k = {name_key('accent')}""")
def accent_instructions(spark, sf_dir):
    accent = F.element_at(F.array(*map(F.lit, ACCENTS)), (F.col("p_partkey") % len(ACCENTS) + 1).cast("int"))
    return part(spark, sf_dir).select("p_partkey", V.accent_instruction(accent).alias("instruction"))


PERSONS_SQL = "reg0 AS (SELECT c_custkey AS ord, c_custkey // 3 AS person, ['child', 'adult', 'elder'][c_custkey % 3 + 1] AS stage FROM customer)"


def persons(spark, sf_dir):
    """Customers as characters: three in a row are one person at three ages."""
    k = F.col("c_custkey")
    stage = F.element_at(F.array(*map(F.lit, ("child", "adult", "elder"))), (k % 3 + 1).cast("int"))
    person = F.concat(F.lit("p"), F.floor(k / 3).cast("string"))
    return customer(spark, sf_dir).select(k.alias("ord"), F.concat_ws("_", person, stage).alias("role_id"), F.lit(None).cast("string").alias("profile_id"), person.alias("person_id"), F.concat_ws(" ", person, stage).alias("display_name"), F.array().cast("array<string>").alias("aliases"), stage.alias("age_stage"), F.concat_ws(" ", person, stage).alias("role_name"))


@query("confirmed_roles", f"""WITH {PERSONS_SQL}, r AS (SELECT o_custkey // 30 AS chapter, o_orderkey AS o, CASE WHEN o_orderkey % 9 = 0 THEN 'Narrator' WHEN o_orderkey % 9 = 1 THEN 'stranger' ELSE 'P' || (o_custkey // 3) || ' ' || upper(['child', 'adult', 'elder'][o_custkey % 3 + 1]) END AS role, CASE WHEN o_orderkey % 9 > 1 THEN o_custkey END AS c FROM orders),
d AS (SELECT chapter, role, min(o) AS o, any_value(c) AS c FROM r GROUP BY 1, 2),
f AS (SELECT d.*, person, stage, first_value(stage) OVER (PARTITION BY chapter, person ORDER BY d.o) AS now FROM d LEFT JOIN reg0 ON ord = c),
s AS (SELECT *, CASE WHEN person IS NULL THEN role ELSE 'p' || person || ' ' || CASE WHEN chapter % 2 = 0 AND person % 2 = 0 AND EXISTS (SELECT 1 FROM reg0 AS x WHERE x.person = f.person AND x.stage = 'elder') THEN 'elder' ELSE now END END AS said FROM f),
n AS (SELECT chapter, said, row_number() OVER (PARTITION BY chapter ORDER BY min(o)) - 1 AS idx FROM s GROUP BY chapter, said)
SELECT r.chapter, r.o, n.idx AS role_idx, n.said AS role FROM r JOIN s ON s.chapter = r.chapter AND s.role = r.role JOIN n ON n.chapter = s.chapter AND n.said = s.said""")
def confirmed_roles(spark, sf_dir):
    """Orders as quotes of chapters, customers as persons at three ages: a person's roles in a chapter become the role of one age, that of
    the first by default; even chapters ask for the elder of even persons, where there is one."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    stage = F.upper(F.element_at(F.array(*map(F.lit, ("child", "adult", "elder"))), (c % 3 + 1).cast("int")))
    role = F.when(k % 9 == 0, "Narrator").when(k % 9 == 1, "stranger").otherwise(F.concat(F.lit("P"), F.floor(c / 3).cast("string"), F.lit(" "), stage))
    said = orders(spark, sf_dir).select(F.floor(c / 30).alias("chapter"), k.alias("o"), role.alias("role"))
    first = said.groupBy("chapter", "role").agg(F.min("o").alias("role_idx"))
    rows = said.join(first, ["chapter", "role"]).select("chapter", "o", "role_idx")
    registry_ = persons(spark, sf_dir)
    people = said.filter("o % 9 > 1").select("chapter", F.concat(F.lit("p"), F.regexp_extract("role", "P([0-9]+)", 1)).alias("person_id")).distinct()
    elders = registry_.filter("age_stage = 'elder'").select("person_id", "age_stage")
    even = (F.col("chapter") % 2 == 0) & (F.substring("person_id", 2, 20).cast("long") % 2 == 0)
    asked = people.filter(even).join(elders, "person_id").select("chapter", "person_id", "age_stage")
    roles, moved, _ = C.confirmed(first, rows, registry_, asked)
    return moved.join(roles, ["chapter", "role_idx"]).select("chapter", "o", "role_idx", "role")


@query("first_speaker", f"WITH {SPEAKERS_SQL}, u AS (SELECT conv_id * 1000 + turn AS u, 'c_' || conv_id || '_' || role AS role_id, 'voices/_temp/' || CASE WHEN turn % 2 = 0 THEN role ELSE 'x' END AS path FROM conversations), m AS (SELECT u, chapter * 1000 + ord AS o, label FROM u JOIN sp ON sp.role_id = u.role_id UNION ALL SELECT u, chapter * 1000 + ord, label FROM u JOIN sp ON 'voices/_temp/' || label = path) SELECT u.u, arg_min(label, o) AS label FROM u LEFT JOIN m USING (u) GROUP BY u.u")
def first_speaker(spark, sf_dir):
    units = conversations(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("u"), F.concat_ws("_", F.lit("c"), F.col("conv_id").cast("string"), "role").alias("role_id"), F.concat(F.lit("voices/_temp/"), F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise("x")).alias("path"))
    rows = speakers(spark, sf_dir).select("role_id", "voice_config_path", "label", (F.col("chapter") * 1000 + F.col("ord")).alias("o"))
    return C.first_of(rows, units, "u", "o", [("role_id", "role_id"), ("path", "voice_config_path")], "label").select("u", "label")


@query("by_display_name", f"WITH {REG_SQL}, l AS (SELECT {name_key('p_name')} AS k, arg_max(p_brand, p_partkey) AS brand FROM part GROUP BY 1) SELECT role_id, brand FROM reg LEFT JOIN l ON l.k = {name_key('display_name')}")
def by_display_name(spark, sf_dir):
    compact = part(spark, sf_dir).select(F.col("p_name").alias("name"), F.col("p_partkey").alias("o"), F.col("p_brand").alias("brand"))
    return C.by_display_name(compact, registry(spark, sf_dir).select("role_id", "display_name"), "name", "o").select("role_id", "brand")


@query("requested_chapters", "SELECT n_nationkey, row_number() OVER (ORDER BY n_name DESC) - 1 AS position FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)")
def requested_chapters(spark, sf_dir):
    wanted = nation(spark, sf_dir)
    from pyspark.sql import Window

    asked = wanted.select("n_nationkey", F.row_number().over(Window.orderBy(F.desc("n_name"))).alias("o"))
    return C.requested(customer(spark, sf_dir).select(F.col("c_nationkey").alias("n_nationkey")), asked, "n_nationkey", "o")


@query("legacy_speakers", "WITH o AS (SELECT conv_id AS chapter, turn AS pos, 'tmp_' || lpad((turn + 2)::VARCHAR, 3, '0') AS local_id, role AS label FROM conversations WHERE turn < 2), n AS (SELECT conv_id AS chapter, row_number() OVER (PARTITION BY conv_id ORDER BY turn) + (SELECT count(*) FROM o WHERE o.chapter = conv_id) AS pos, role FROM conversations WHERE turn >= 2) SELECT chapter, row_number() OVER (PARTITION BY chapter ORDER BY pos) AS pos, local_id, label FROM o UNION ALL SELECT chapter, pos, 'tmp_' || lpad(pos::VARCHAR, 3, '0'), role FROM n WHERE 'tmp_' || lpad(pos::VARCHAR, 3, '0') NOT IN (SELECT local_id FROM o WHERE o.chapter = n.chapter)")
def legacy_speakers(spark, sf_dir):
    c = conversations(spark, sf_dir).select(F.col("conv_id").alias("chapter"), F.col("turn").alias("pos"), F.col("role").alias("label"))
    old = c.filter("pos < 2").withColumn("local_id", F.format_string("tmp_%03d", F.col("pos") + 2))
    return C.legacy_speakers(old, c.filter("pos >= 2").withColumnRenamed("label", "name"))


@query("chapter_speakers", f"""WITH s AS (SELECT conv_id AS chapter, turn AS pos, role AS label, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, CASE WHEN turn % 2 = 0 THEN role END AS raw FROM conversations),
b AS (SELECT *, coalesce({slug('raw')}, 'tmp_' || lpad(i::VARCHAR, 3, '0')) AS base FROM s),
n AS (SELECT *, row_number() OVER (PARTITION BY chapter, base ORDER BY pos) AS again FROM b),
r AS (SELECT *, CASE WHEN again = 1 THEN base ELSE base || '_' || again END AS local_id FROM n),
d AS (SELECT *, chapter || '_' || local_id AS role_id, ('0x' || substr(sha256('tpch:' || chapter || '_' || local_id), 1, 8))::BIGINT AS seed FROM r)
SELECT chapter, local_id, role_id, seed, 'adult; calm, dry; Irish; Irish accent' AS description, 'A adult voice; calm, dry personality; {V.ACCENT_INSTRUCTIONS['irish']}; clear natural audiobook delivery, with ' || array_to_string(list_transform(range(3), lambda i: {LABELS_SQL}[(seed + i) % 8 + 1]), ', ') || '.' AS instruction FROM d""")
def chapter_speakers(spark, sf_dir):
    rows = conversations(spark, sf_dir).select(F.col("conv_id").cast("string").alias("chapter"), F.col("turn").alias("pos"), F.when(F.col("turn") % 2 == 0, F.col("role")).alias("local_id"), F.col("role").alias("label"), F.lit("adult").alias("age_stage"), F.lit("unknown").alias("gender"), F.array(F.lit("calm"), F.lit(" dry ")).alias("personality"), F.lit("Irish").alias("race"), none().alias("accent"))
    out = C.chapter_speakers(rows, "tpch").select(F.col("chapter").cast("long").alias("chapter"), "local_id", "role_id", "seed", "description", "instruction")
    return out


QUOTES_SQL = "q AS (SELECT conv_id AS chapter, turn AS idx, CASE WHEN turn % 4 = 3 THEN 'narrator_quote' ELSE 'dialogue' END AS kind, role FROM conversations)"


@query("canonical_quotes", f"WITH {QUOTES_SQL} SELECT chapter, idx, CASE WHEN kind = 'narrator_quote' THEN 'Narrator' WHEN role = 'user' THEN 'customer_id' ELSE role END AS role FROM q")
def canonical_quotes(spark, sf_dir):
    c = conversations(spark, sf_dir).select(F.col("conv_id").alias("chapter"), F.col("turn").alias("idx"), F.col("turn").alias("role_idx"), "role", F.when(F.col("turn") % 4 == 3, "narrator_quote").otherwise("dialogue").alias("kind"))
    local = c.filter("role <> 'user'").select("chapter", F.upper("role").alias("local_id")).distinct()
    aliases = spark.createDataFrame([("user", "customer_id"), ("assistant", "never")], "alias string, role_id string")
    return C.canonical_quotes(c.select("chapter", "role_idx", "role"), c.drop("role"), local, aliases).select("chapter", "idx", "role")


@query("spoken_locals", f"WITH {QUOTES_SQL}, u AS (SELECT chapter, role, bool_and(kind = 'narrator_quote') AS quoted FROM q GROUP BY 1, 2) SELECT chapter, role AS local_id FROM u WHERE NOT quoted")
def spoken_locals(spark, sf_dir):
    c = conversations(spark, sf_dir).select(F.col("conv_id").alias("chapter"), "role", F.when(F.col("turn") % 4 == 3, "narrator_quote").otherwise("dialogue").alias("kind"))
    return C.spoken_locals(c.select("chapter", F.col("role").alias("local_id")).distinct(), c)


@query("replaced_roles", "SELECT conv_id AS chapter, turn, CASE WHEN role = 'user' AND conv_id % 2 = 0 THEN 'Guest' ELSE role END AS role FROM conversations")
def replaced_roles(spark, sf_dir):
    c = conversations(spark, sf_dir).select(F.col("conv_id").alias("chapter"), "turn", "role")
    swaps = c.filter("chapter % 2 = 0").select("chapter", F.lit("U.S.E.R").alias("old"), F.lit("Guest").alias("new")).distinct()
    return C.replaced(c, swaps, "chapter", "role")


@query("detected_values", f"WITH v AS (SELECT 0 AS p, 0 AS o, 'brand#3' AS v UNION ALL SELECT 1, p_partkey, p_brand FROM part UNION ALL SELECT 2, conv_id * 1000 + turn, role FROM conversations), f AS (SELECT {name_key('v')} AS k, arg_min(v, (p, o)) AS value, min((p, o)) AS at0 FROM v GROUP BY 1) SELECT value, row_number() OVER (ORDER BY at0) AS position FROM f")
def detected_values(spark, sf_dir):
    reg = part(spark, sf_dir).select(F.col("p_partkey").alias("ord"), F.col("p_brand").alias("v"))
    local = conversations(spark, sf_dir).select(F.lpad(F.col("conv_id").cast("string"), 12, "0").alias("chapter"), F.col("turn").alias("pos"), F.col("role").alias("v"))
    return C.detected(reg, local, "v", ("brand#3",))


@query("known_names", f"WITH {REG_SQL}, n AS (SELECT unnest([role_id, replace(role_id, '_', ' '), display_name, alias1]) AS n FROM reg UNION ALL SELECT role FROM conversations) SELECT DISTINCT {name_key('n')} AS name FROM n WHERE {name_key('n')} <> ''")
def known_names(spark, sf_dir):
    local = conversations(spark, sf_dir).select(F.col("conv_id").alias("chapter"), F.col("role").alias("local_id"), F.col("role").alias("label"))
    return C.known_names(registry(spark, sf_dir), local)


@query("migrated_characters", f"SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'r' || p_partkey ELSE 'p' || p_partkey END AS role_id, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 2 = 0 THEN 'r' || p_partkey ELSE 'p' || p_partkey END AS display_name, 'a,old ' || p_brand AS aliases, coalesce(CASE WHEN p_partkey % 5 = 0 THEN 'own.qvp' END, 'old.qvp') AS voice_config_path FROM part")
def migrated_characters(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_partkey").cast("string")
    rows = part(spark, sf_dir).select(k, F.concat(F.lit("p"), n).alias("profile_id"), F.when(k % 2 == 0, F.concat(F.lit("r"), n)).alias("role_id"), F.when(k % 3 == 0, F.col("p_name")).otherwise(" ").alias("display_name"), F.array(F.lit("a")).alias("aliases"), F.when(k % 5 == 0, "own.qvp").alias("voice_config_path"), none().alias("voice_config_hash"), F.lit(None).cast("long").alias("seed"), F.struct(F.concat(F.lit("old "), "p_brand").alias("role_id"), F.lit("a").alias("display_name"), F.lit("old.qvp").alias("voice_config_path"), none().alias("voice_config_hash")).alias("legacy"), F.lit(44).alias("age"))
    out = C.migrated(rows, "tpch")
    return out.select("p_partkey", "role_id", "display_name", F.array_join("aliases", ",").alias("aliases"), "voice_config_path")


@query("edited_characters", "SELECT p_partkey, p_brand || '!' AS p_brand, p_type, NULL::VARCHAR AS voice_config_hash FROM part WHERE p_partkey % 4 = 0")
def edited_characters(spark, sf_dir):
    old = part(spark, sf_dir).select("p_partkey", "p_brand", "p_type")
    form = old.withColumn("p_brand", F.when(F.col("p_partkey") % 4 == 0, F.concat("p_brand", F.lit("!"))).otherwise(F.col("p_brand")))
    return C.edited(old, form, "p_partkey", ["p_brand", "p_type"])


@query("character_forms", f"WITH {REG_SQL} SELECT role_id, display_name, age_stage, alias1 AS aliases, 'Irish' AS accent, 'x, y' AS personality FROM reg")
def character_forms(spark, sf_dir):
    reg = registry(spark, sf_dir).select("*", none().alias("voice_config_path"), none().alias("gender"), F.array(F.lit(" x"), F.lit(""), F.lit("y")).alias("personality"), F.lit("irish").alias("race"), none().alias("accent"), none().alias("occupation"))
    return C.forms(reg).select("role_id", "display_name", "age_stage", "aliases", "accent", "personality")


@query("narrator_voices", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'adult female audiobook narrator, warm alto timbre, clear pacing' ELSE 'adult male audiobook narrator, calm baritone timbre, clear pacing' END AS description, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE n_name || ' pronunciation: keep the accent consistent, audible, and do not drift into General American unless requested' END AS accent, CASE WHEN n_nationkey % 3 = 0 THEN 'Narrator: custom narrator' ELSE 'Narrator: young adult ' || replace(n_name, '_', ' ') END AS summary, CASE n_nationkey % 3 WHEN 0 THEN 'Not started' WHEN 1 THEN 'c1' ELSE 'c1, segment ' || (n_nationkey + 1) END AS last_read FROM nation")
def narrator_voices(spark, sf_dir):
    k = F.col("n_nationkey")
    some = k % 3 != 0
    description, _ = V.narrator_voice(F.when(k % 2 == 0, " Female").otherwise("other"))
    summary = V.narrator_summary(F.lit(" "), F.when(some, "young_adult").otherwise("unknown"), F.lit("unknown"), F.when(some, F.col("n_name")))
    return nation(spark, sf_dir).select(k, description.alias("description"), V.accent_instruction(F.when(some, F.col("n_name"))).alias("accent"), summary.alias("summary"), V.last_read_label(F.when(some, "c1"), F.when(k % 3 == 2, k)).alias("last_read"))


@query("unit_predicates", "SELECT conv_id, turn, role = 'user' OR turn % 5 = 0 AS narrator, turn % 2 = 1 AS temp, CASE WHEN role = 'user' OR turn % 5 = 0 THEN 'n.qvp' WHEN turn % 2 = 1 THEN 'voices\\_temp\\x' ELSE 'v' END AS path FROM conversations")
def unit_predicates(spark, sf_dir):
    rows = conversations(spark, sf_dir).select("conv_id", "turn", F.when(F.col("role") == "user", "Narrator").otherwise(F.col("role")).alias("role"), F.when(F.col("turn") % 5 == 0, "functional_narrator").otherwise("x").alias("role_id"), none().alias("voice_variant"), F.when(F.col("turn") % 2 == 1, "voices\\_temp\\x").otherwise("v").alias("voice_config_path"))
    rows = rows.withColumns({"narrator": V.is_narrator(), "temp": V.is_temp(F.col("voice_config_path"))})
    return C.patched(rows, F.col("narrator"), {"voice_config_path": F.lit("n.qvp")}).select("conv_id", "turn", "narrator", "temp", F.col("voice_config_path").alias("path"))


@query("book_actions", "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'annotate' WHEN 1 THEN 'review_registry' WHEN 2 THEN 'initialize' ELSE 'prepare_voices' END AS action, n_nationkey % 4 = 1 AS opens, CASE WHEN n_nationkey % 4 = 2 OR n_nationkey % 3 = 2 THEN '' WHEN n_nationkey % 3 = 0 THEN 'Retry Annotation' ELSE 'Resume Annotation' END AS resume FROM nation")
def book_actions(spark, sf_dir):
    k = F.col("n_nationkey") % 4
    status = F.when(k == 0, "registry_ready").when(k == 1, "voices_ready").when(k == 2, "fresh_added").otherwise("annotated")
    progress = F.when(F.col("n_nationkey") % 3 == 0, "failed").when(F.col("n_nationkey") % 3 == 1, "running").otherwise("done")
    action, _, opens = B.action(status)
    return nation(spark, sf_dir).select("n_nationkey", action.alias("action"), opens.alias("opens"), B.resume_action(status, F.lit(True), progress).alias("resume"))


@query("catalogue_upsert", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'New' ELSE s_name END AS title FROM supplier UNION ALL SELECT 1000000 + s_suppkey, 'New' FROM supplier WHERE s_suppkey % 2 = 1")
def catalogue_upsert(spark, sf_dir):
    s = supplier(spark, sf_dir)
    fresh = s.select(F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey")).otherwise(F.col("s_suppkey") + 1000000).alias("s_suppkey"), F.lit("New").alias("title"))
    return B.upserted(s.select("s_suppkey", F.col("s_name").alias("title")), fresh, "s_suppkey")


@query("removed_books", "SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 <> 0")
def removed_books(spark, sf_dir):
    s = supplier(spark, sf_dir).select("s_suppkey")
    return B.removed(s, s.filter("s_suppkey % 3 = 0"), "s_suppkey")


@query("invalidated_artifacts", "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'audio' WHEN 1 THEN 'text' ELSE 'timeline' END AS kind FROM conversations WHERE conv_id % 2 = 1 OR turn % 3 = 1")
def invalidated_artifacts(spark, sf_dir):
    t = F.col("turn") % 3
    c = conversations(spark, sf_dir).select("conv_id", "turn", F.when(t == 0, "audio").when(t == 1, "text").otherwise("timeline").alias("kind"))
    return B.invalidated(c, c.filter("conv_id % 2 = 0"), "conv_id", "kind")


@query("initialised_books", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'stored' ELSE 'default' END AS state FROM supplier")
def initialised_books(spark, sf_dir):
    s = supplier(spark, sf_dir).select("s_suppkey")
    return B.initialised(s.filter("s_suppkey % 2 = 0").withColumn("state", F.lit("stored")), s, "s_suppkey", s.withColumn("state", F.lit("default")))


@query("resolved_titles", "SELECT '/b/' || s_suppkey AS book_root, CASE s_suppkey % 3 WHEN 0 THEN s_name WHEN 1 THEN 'Lib ' || s_suppkey ELSE s_suppkey::VARCHAR END AS title, CASE s_suppkey % 3 WHEN 0 THEN 'reg' WHEN 1 THEN 'lib' ELSE s_suppkey::VARCHAR END AS slug FROM supplier")
def resolved_titles(spark, sf_dir):
    k = F.col("s_suppkey")
    s = supplier(spark, sf_dir).select(k, "s_name", F.concat(F.lit("/b/"), k.cast("string")).alias("book_root"))
    reg = s.filter("s_suppkey % 3 <> 2").select("book_root", F.col("s_name").alias("title"), F.when(k % 3 == 0, "reg").alias("slug"))
    lib = s.filter("s_suppkey % 3 = 1").select(k.alias("ord"), "book_root", F.concat(F.lit("Lib "), k.cast("string")).alias("title"), F.lit("lib").alias("slug"))
    return B.resolved_titles(s.select("book_root", none().alias("slug")), reg, lib)


@query("audio_counts", "SELECT conv_id, count(DISTINCT turn // 2) AS n FROM conversations WHERE turn % 3 <> 2 GROUP BY conv_id")
def audio_counts(spark, sf_dir):
    t = F.col("turn") % 3
    files = conversations(spark, sf_dir).select("conv_id", F.when(t == 0, "audio").when(t == 1, "audiobook").otherwise("logs").alias("folder"), F.floor(F.col("turn") / 2).alias("chapter"))
    return B.audio_counts(files, "conv_id", "folder", "chapter")


@query("harness_totals", "SELECT conv_id, sum(turn % 3)::BIGINT AS settled, sum(turn % 2)::BIGINT AS asked, 0::BIGINT AS failed, sum(length(text))::BIGINT AS asked_chars, sum(100)::BIGINT AS full_chars, greatest(0, sum(100) - sum(length(text)))::BIGINT AS saved_chars FROM conversations GROUP BY conv_id")
def harness_totals(spark, sf_dir):
    t = F.col("turn")
    return B.harness_totals(conversations(spark, sf_dir).select("conv_id", (t % 3).alias("settled"), (t % 2).alias("asked"), F.lit(0).cast("long").alias("failed"), F.length("text").cast("long").alias("asked_chars"), F.lit(100).cast("long").alias("full_chars")), "conv_id")


@query("next_stages", "WITH s AS (SELECT source, doc_id, CASE WHEN quality IS NULL THEN 'extract' WHEN quality = 0 THEN 'annotate' WHEN toxic = 1 THEN 'speak' END AS stage FROM documents LEFT JOIN labels USING (doc_id)) SELECT source, min(doc_id) AS doc_id, arg_min(stage, doc_id) AS stage FROM s WHERE stage IS NOT NULL GROUP BY source")
def next_stages(spark, sf_dir):
    d = documents(spark, sf_dir).select("source", "doc_id").join(labels(spark, sf_dir), "doc_id", "left")
    rows = d.select("source", "doc_id", F.col("quality").isNotNull().alias("extract"), (F.col("quality") == 1).alias("annotate"), (F.col("toxic") != 1).alias("speak"))
    return B.next_stages(rows, "source", "doc_id", ("extract", "annotate", "speak"))


@query("packages", "SELECT conv_id, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM conversations WHERE turn % 2 = 0 GROUP BY conv_id")
def packages(spark, sf_dir):
    c = conversations(spark, sf_dir).select("conv_id", F.concat(F.when(F.col("turn") % 2 == 0, "chapters/").otherwise("logs/"), F.col("turn").cast("string")).alias("path"), F.col("text").cast("binary").alias("data"))
    keep = lambda name: name.startswith("chapters/")
    out = B.unpacked(B.packages(c, "conv_id", "path", "data", keep), "conv_id", "package", keep)
    return out.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length(F.col("data").cast("string"))).alias("n_chars"))


@query("failure_rows", """SELECT '{"event_type":"call","details":{"c_custkey":' || c_custkey || '},"exception":"[REDACTED] ' || c_mktsegment || '"}' AS failure FROM customer WHERE c_custkey % 2 = 0""")
def failure_rows(spark, sf_dir):
    from ..functions.text import redact

    rows = customer(spark, sf_dir).select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Bearer abc.def "), "c_mktsegment")).alias("e"))
    return B.failure_rows(rows, "call", "e", ["c_custkey"], redact)
