"""Queries on scripts: decoding, segments, windows by profile, pruning, halving, voices, validation, generation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import generation as G
from ..operators import library as B
from ..operators import quality as Q
from ..operators import script as P
from .base import SPACES_SQL, Plan, name_key, reader, squeezed
from .conversations import speech_sql

PLAN = Plan()
query, QUERIES, SQL = PLAN.query, PLAN.QUERIES, PLAN.SQL
conversations, part, documents, orders, customer, events, benchmark = map(reader, ("conversations", "part", "documents", "orders", "customer", "events", "benchmark"))


def chapters(spark, sf_dir):
    """Turns as quotes of chapters: chapter, idx, role_idx (by first appearance of the role in the alphabet), kind, text."""
    c = conversations(spark, sf_dir).select(F.col("conv_id").alias("chapter"), F.col("turn").alias("idx"), "role", "text")
    codes = c.groupBy("chapter").agg(F.array_sort(F.collect_set("role")).alias("rs"))
    roles = codes.select("chapter", F.posexplode("rs").alias("role_idx", "role")).withColumn("role_idx", F.col("role_idx").cast("long"))
    return c, roles


CODES_SQL = "codes AS (SELECT conv_id AS chapter, role, row_number() OVER (PARTITION BY conv_id ORDER BY role) - 1 AS role_idx FROM (SELECT DISTINCT conv_id, role FROM conversations WHERE role IS NOT NULL))"


@query("decoded_roles", "SELECT conv_id AS chapter, turn AS idx, role FROM conversations")
def decoded_roles(spark, sf_dir):
    c, roles = chapters(spark, sf_dir)
    rows = c.join(roles, ["chapter", "role"]).select("chapter", "idx", "role_idx")
    return P.decoded(rows, roles, "chapter", "role_idx", "role").select("chapter", "idx", "role")


@query("attributed_quotes", f"WITH {CODES_SQL} SELECT conv_id AS chapter, turn AS idx, role_idx, length(text) AS n_chars FROM conversations c JOIN codes ON codes.chapter = conv_id AND codes.role = c.role")
def attributed_quotes(spark, sf_dir):
    c, roles = chapters(spark, sf_dir)
    attribution = c.join(roles, ["chapter", "role"]).select("chapter", "idx", "role_idx")
    return P.attributed(c.select("chapter", "idx", F.length("text").cast("long").alias("n_chars")), attribution, "chapter", "idx")


@query("script_units", "SELECT conv_id AS chapter, turn AS idx, upper(role) AS said, length(text) AS n_chars FROM conversations WHERE turn % 4 <> 3")
def script_units(spark, sf_dir):
    c = conversations(spark, sf_dir).select(F.col("conv_id").alias("chapter"), F.col("turn").alias("idx"), "role", "text")
    rows = c.filter("idx % 4 <> 3").select("chapter", "idx", F.upper("role").alias("said"))
    return P.script_units(rows, c.select("chapter", "idx", F.length("text").cast("long").alias("n_chars")), "chapter", "idx").select("chapter", "idx", "said", "n_chars")


@query("report_lines", "SELECT (n_nationkey + 2)::BIGINT AS n, '| ' || n_nationkey || ' | ' || n_name || ' \\| x | ' || CASE WHEN n_regionkey = 1 THEN '' ELSE '[' || n_regionkey || ',0]' END || ' |' AS line FROM nation UNION ALL SELECT 0::BIGINT, '| key | name | regions |' UNION ALL SELECT 1::BIGINT, '| --- | --- | --- |'")
def report_lines(spark, sf_dir):
    """Nations as a Markdown table, with a bar and a line break in each name and lists that may be null."""
    from ..sources.files import markdown_lines

    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    regions = F.when(F.col("n_regionkey") != 1, F.array(F.col("n_regionkey"), F.lit(0).cast("long")))
    return markdown_lines(n.select(F.col("n_nationkey").alias("key"), F.concat("n_name", F.lit("\n| x")).alias("name"), regions.alias("regions")), ["key"])


@query("quote_segments", r"""WITH t AS (SELECT doc_id, text, (doc_id % 2 = 0) AND NOT regexp_matches(text, '["“]') AND contains(text, '”') AS inside FROM documents),
x AS (SELECT doc_id, inside, CASE WHEN inside THEN regexp_extract_all(text, '[^”]*”|[^”]+') ELSE regexp_extract_all(text, '["“][^"”]*(?:["”]|$)|[^"“]+') END AS xs FROM t),
p AS (SELECT doc_id, inside, unnest(xs) AS s, unnest(range(len(xs))) AS i FROM x),
f AS (SELECT doc_id, i, CASE WHEN inside THEN i = 0 ELSE regexp_matches(s, '^["“]') END AS is_quote, regexp_replace(s, '^\s+|\s+$', '', 'g') AS segment FROM p)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS part, is_quote, sha256(segment) AS segment_sha256 FROM f WHERE segment <> ''""")
def quote_segments(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", "text", (F.col("doc_id") % 2 == 0).alias("spoken"))
    return P.quote_segments(rows, ["doc_id"], "text", "spoken").select("doc_id", "part", "is_quote", F.sha2("segment", 256).alias("segment_sha256"))


@query("narration_sentences", f"""WITH w AS (SELECT doc_id, string_split(regexp_replace({squeezed('text')}, '([.!?])\\s+(["''“‘A-Z0-9])', '\\1' || chr(31) || '\\2', 'g'), chr(31)) AS ss FROM documents),
s AS (SELECT doc_id, unnest(ss) AS sentence, unnest(range(len(ss))) AS part FROM w)
SELECT doc_id, part, 100 + coalesce(sum(length(sentence) + 1) OVER (PARTITION BY doc_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "begin", length(sentence) AS n_chars FROM s WHERE sentence <> ''""")
def narration_sentences(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", X.squeeze(F.col("text")).alias("t"), F.lit(100).alias("s"))
    return P.narration_sentences(rows, ["doc_id"], "t", "s").select("doc_id", "part", "begin", (F.col("end") - F.col("begin")).alias("n_chars"))


@query("narration_places", f"""WITH RECURSIVE w AS (SELECT doc_id, text, string_split(regexp_replace({squeezed(r"regexp_replace(text, '^\\s+|\\s+$', '', 'g')")}, '([.!?])\\s+(["''“‘A-Z0-9])', '\\1' || chr(31) || '\\2', 'g'), chr(31)) AS ss FROM documents),
s AS (SELECT doc_id, text, list_filter(ss, lambda x: trim(x) <> '') AS ss, (length(text) - length(regexp_replace(text, '^' || {SPACES_SQL}, '')))::BIGINT AS led FROM w),
f AS (SELECT doc_id, 1 AS i, text, ss, CASE WHEN strpos(substr(text, led + 1), ss[1]) = 0 THEN led ELSE led + strpos(substr(text, led + 1), ss[1]) - 1 END AS pos FROM s WHERE len(ss) > 0
UNION ALL SELECT doc_id, i + 1, text, ss, CASE WHEN strpos(substr(text, pos + length(ss[i]) + 1), ss[i + 1]) = 0 THEN pos + length(ss[i]) ELSE pos + length(ss[i]) + strpos(substr(text, pos + length(ss[i]) + 1), ss[i + 1]) - 1 END FROM f WHERE i < len(ss))
SELECT doc_id, (i - 1)::BIGINT AS part, doc_id % 7 + pos AS "begin", length(ss[i]) AS n_chars FROM f""")
def narration_places(spark, sf_dir):
    """Texts as they are: sentences whose white space was squeezed aren't found in them, and stand where the one before ended."""
    rows = documents(spark, sf_dir).select("doc_id", "text", (F.col("doc_id") % 7).alias("s"))
    return P.narration_sentences(rows, ["doc_id"], "text", "s").select("doc_id", "part", "begin", (F.col("end") - F.col("begin")).alias("n_chars"))


@query("span_sentences", f"SELECT doc_id, len(list_filter(string_split(regexp_replace({squeezed('text')}, '([.!?])\\s+([\"''“‘A-Z0-9])', '\\1' || chr(31) || '\\2', 'g'), chr(31)), lambda x: x <> ''))::BIGINT AS n FROM documents")
def span_sentences(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.size(P.span_sentences(F.col("text"))).cast("long").alias("n"))


@query("segment_jobs", "SELECT conv_id AS chapter, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS sentence_idx, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS unit_idx, role, role AS role_id, CASE WHEN turn % 2 = 0 THEN 'dialogue' ELSE 'narration' END AS type, text, NULL::VARCHAR AS voice_config_path, 10 * turn AS source_start, 10 * turn + 5 AS source_end FROM conversations")
def segment_jobs(spark, sf_dir):
    c = conversations(spark, sf_dir).select(F.col("conv_id").alias("chapter"), F.col("turn").alias("seq"), "role", F.col("role").alias("role_id"), "text", F.lit(None).cast("string").alias("voice_config_path"), (F.col("turn") * 10).alias("start"), (F.col("turn") * 10 + 5).alias("end"))
    even = F.col("seq") % 2 == 0
    units = P.segments(c.filter(even).withColumn("type", F.lit("dialogue")), c.filter(~even).withColumn("type", F.lit("narration")), "chapter", ["start", "end"])
    return P.jobs(units)


@query("script_order", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text), turn) - 1 AS place FROM conversations")
def script_order(spark, sf_dir):
    rows = conversations(spark, sf_dir).withColumn("n", F.length("text"))
    return B.numbered(rows, "conv_id", ["n", "turn"], "place").select("conv_id", "turn", "place")


@query("nested_windows", "SELECT conv_id, turn // 4 AS win, (turn % 4) // 2 AS section, turn % 2 AS job, turn, role FROM conversations")
def nested_windows(spark, sf_dir):
    c = conversations(spark, sf_dir).select("conv_id", F.floor(F.col("turn") / 4).alias("win"), F.floor(F.col("turn") % 4 / 2).alias("section"), "turn", "role")
    flat = P.nested(c, "conv_id", "win", "section", "turn", ["role"]).select("conv_id", F.explode("windows").alias("w")).select("conv_id", "w.window", "w.sections")
    return P.unnested(flat, "conv_id", "window", "sections", "jobs").select("conv_id", F.col("window").alias("win"), "section", "job", F.col("order").alias("turn"), "role")


@query("pruned_roles", f"WITH {CODES_SQL}, u AS (SELECT DISTINCT conv_id, role FROM conversations WHERE turn % 3 <> 0 AND role IS NOT NULL), n AS (SELECT codes.chapter, codes.role, row_number() OVER (PARTITION BY codes.chapter ORDER BY role_idx) - 1 AS role_idx FROM codes JOIN u ON u.conv_id = codes.chapter AND u.role = codes.role) SELECT conv_id AS chapter, turn AS idx, role_idx FROM conversations c JOIN n ON n.chapter = conv_id AND n.role = c.role WHERE turn % 3 <> 0")
def pruned_roles(spark, sf_dir):
    c, roles = chapters(spark, sf_dir)
    rows = c.filter("idx % 3 <> 0").join(roles, ["chapter", "role"]).select("chapter", "idx", "role_idx")
    return P.pruned(roles, rows, "chapter", "role_idx")[1].select("chapter", "idx", "role_idx")


@query("halved_windows", """WITH RECURSIVE n AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS m FROM conversations),
r AS (SELECT conv_id, 0::BIGINT AS lo, max(m)::BIGINT AS hi FROM n GROUP BY conv_id
UNION ALL SELECT conv_id, CASE h WHEN 0 THEN lo ELSE lo + (hi - lo) // 2 END, CASE h WHEN 0 THEN lo + (hi - lo) // 2 ELSE hi END FROM r, (SELECT unnest([0, 1]) AS h)
WHERE hi - lo > 1 AND (SELECT sum(n.n) FROM n WHERE n.conv_id = r.conv_id AND n.i >= r.lo AND n.i < r.hi) > 400),
s AS (SELECT r.conv_id, lo, hi, sum(n.n) AS total, min(turn) AS first, max(turn) AS last FROM r JOIN n ON n.conv_id = r.conv_id AND n.i >= lo AND n.i < hi GROUP BY 1, 2, 3)
SELECT conv_id, first, last, total <= 400 AS ok FROM s WHERE total <= 400 OR hi - lo <= 1""")
def halved_windows(spark, sf_dir):
    rows = conversations(spark, sf_dir).select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    return P.halved(rows, ["conv_id"], "turn", "text", lambda texts: sum(map(len, texts)) <= 400)


@query("profile_windows", speech_sql(*P.PROFILES["precise"]))
def profile_windows(spark, sf_dir):
    return P.profile_windows(conversations(spark, sf_dir), "conv_id", ["turn"], "role", "text", " Precise").select("conv_id", "turn", "window_id")


@query("default_windows", speech_sql(*P.PROFILES["balanced"]))
def default_windows(spark, sf_dir):
    """A profile that doesn't exist is the balanced one."""
    return P.profile_windows(conversations(spark, sf_dir), "conv_id", ["turn"], "role", "text", "no such profile").select("conv_id", "turn", "window_id")


@query("voice_paths", "WITH j AS (SELECT conv_id, turn, role, CASE WHEN turn % 3 = 1 THEN NULL ELSE role || '_id' END AS role_id, 'v/' || conv_id || '_' || turn AS p, conv_id * 100000 + turn AS o FROM conversations), a AS (SELECT role_id, arg_max(p, o) AS p FROM j WHERE role_id IS NOT NULL GROUP BY 1), b AS (SELECT role, arg_max(p, o) AS p FROM j GROUP BY 1) SELECT conv_id, turn, coalesce(a.p, b.p) AS voice_path FROM j LEFT JOIN a USING (role_id) LEFT JOIN b USING (role)")
def voice_paths(spark, sf_dir):
    c = conversations(spark, sf_dir)
    rows = c.select("conv_id", "turn", "role", F.when(F.col("turn") % 3 != 1, F.concat("role", F.lit("_id"))).alias("role_id"), F.format_string("v/%d_%d", "conv_id", "turn").alias("voice_config_path"), (F.col("conv_id") * 100000 + F.col("turn")).alias("o"))
    return P.voice_paths(rows, "o").select("conv_id", "turn", "voice_path")


@query("tokenised", "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''))::BIGINT AS n FROM documents")
def tokenised(spark, sf_dir):
    rows = documents(spark, sf_dir)
    n = P.tokenised(rows, "doc_id", "text", lambda t: t.split("\n")).groupBy("doc_id").agg(F.count("*").alias("n"))
    return rows.select("doc_id").join(n, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("playback_session", """WITH RECURSIVE c AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, CASE event_id % 5 WHEN 1 THEN 'consume' WHEN 3 THEN 'consume' ELSE 'generate' END AS k FROM events),
f AS (SELECT user_id, event_id, rn, CASE k WHEN 'generate' THEN 1 ELSE 0 END AS ready, CASE k WHEN 'generate' THEN 1 ELSE 0 END AS made FROM c WHERE rn = 1
UNION ALL SELECT c.user_id, c.event_id, c.rn, CASE c.k WHEN 'generate' THEN ready + 1 ELSE greatest(0, ready - 1) END, CASE c.k WHEN 'generate' THEN made + 1 ELSE made END FROM f JOIN c ON c.user_id = f.user_id AND c.rn = f.rn + 1)
SELECT event_id, ready::BIGINT AS n_ready, 0.5 * ready AS ready_seconds, made::BIGINT AS next_unit FROM f""")
def playback_session(spark, sf_dir):
    kind = F.when((F.col("event_id") % 5).isin(1, 3), "consume").otherwise("generate")
    rows = events(spark, sf_dir).select("user_id", "event_id", kind.alias("k"), F.lit(0.5).alias("s"))
    return P.session(rows, "user_id", "event_id", "k", "s").select("event_id", "n_ready", "ready_seconds", "next_unit")


@query("ready_totals", "SELECT conv_id, count(*) AS n, sum(CASE WHEN turn <> 1 THEN 0.25 * turn ELSE 0 END)::DOUBLE AS seconds, avg(0.25 * turn)::DOUBLE AS mean_seconds FROM conversations GROUP BY conv_id")
def ready_totals(spark, sf_dir):
    rows = conversations(spark, sf_dir).select("conv_id", "turn", (F.col("turn") * F.lit(0.25)).alias("s"), F.lit(1).cast("long").alias("now"))
    return B.ready_totals(rows, "conv_id", "turn", "s", "now")


@query("playback_seconds", "SELECT conv_id, turn, round(1200 * length(coalesce(text, '')) / 24000 / greatest(0.1, 0.05 * (turn % 40)), 6) AS seconds FROM conversations")
def playback_seconds(spark, sf_dir):
    speed = F.lit(0.05) * (F.col("turn") % 40)
    return conversations(spark, sf_dir).select("conv_id", "turn", F.round(B.playback(1200 * F.length(F.coalesce("text", F.lit(""))), F.lit(24000), speed), 6).alias("seconds"))


@query("generated_units", "SELECT conv_id, turn, 12 * length(coalesce(text, '')) AS n_samples, 24000::BIGINT AS sample_rate FROM conversations")
def generated_units(spark, sf_dir):
    rows = conversations(spark, sf_dir).select("conv_id", "turn", "text", F.col("role").alias("voice"))
    return G.generated(rows, "text", "voice", G.CountingAdapter(12, 24000)).select("conv_id", "turn", "n_samples", "sample_rate")


@query("measured_windows", "SELECT conv_id, count(*) AS n_units, sum(length(coalesce(text, '')))::BIGINT AS n_chars, sum(12 * length(coalesce(text, ''))) / 24000 / 1.25 AS playback, true AS success FROM conversations GROUP BY conv_id")
def measured_windows(spark, sf_dir):
    return G.measured(conversations(spark, sf_dir), "conv_id", "turn", "text", G.CountingAdapter(12, 24000), speed=1.25).select("conv_id", "n_units", "n_chars", "playback", "success")


@query("voice_assets", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'cached' ELSE 'complete' END AS status, CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE 12 * length(p_name) END AS n_samples FROM part")
def voice_assets(spark, sf_dir):
    now = part(spark, sf_dir).select("p_partkey", F.sha2("p_name", 256).alias("digest"), "p_name", F.col("p_brand").alias("voice"))
    stored = part(spark, sf_dir).select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.sha2("p_name", 256)).otherwise("old").alias("digest")).filter("p_partkey % 3 <> 1 OR p_partkey % 2 = 0")
    return G.assets(now, stored, "p_partkey", "digest", "p_name", "voice", G.CountingAdapter(12, 24000))


@query("quote_keys", f"SELECT doc_id, sha256({name_key('text')}) AS key_sha256 FROM documents")
def quote_keys(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.sha2(X.quote_key(F.concat(F.lit(" “"), "text", F.lit("” "))), 256).alias("key_sha256"))


@query("small_texts", """SELECT p_partkey, trim(p_name) || ' ' || p_brand AS joined, printf('%.3f', p_retailprice) AS price, '[run] sized part=' || p_partkey || CASE WHEN p_size > 25 THEN ' size=' || p_size ELSE '' END AS line, sha256(p_name) AS digest,
CASE WHEN p_partkey % 2 = 0 THEN 's' || p_size END AS session, CASE WHEN p_partkey % 2 = 0 THEN p_partkey END AS unit, 'Part ' || p_name || ' (' || p_brand || ')' AS prompt, CASE WHEN length(p_name) > 10 THEN left(p_name, 5) || chr(10) || chr(10) || '[...truncated failed model response...]' || chr(10) || chr(10) || right(p_name, 5) ELSE p_name END AS bounded FROM part""")
def small_texts(spark, sf_dir):
    p = F.col("p_partkey")
    url = F.when(p % 2 == 0, F.format_string("/api/session/s%d/audio/%d.wav", F.col("p_size").cast("long"), p)).otherwise(F.format_string("/api/session/%d.wav", p))
    session, unit = X.path_parts(url, "/api/session/", "audio", ".wav")
    return part(spark, sf_dir).select("p_partkey", X.join_filled(F.array(F.concat(F.lit(" "), "p_name"), F.lit("  "), "p_brand")).alias("joined"), X.fixed(F.col("p_retailprice")).alias("price"), X.log_line("[run]", F.lit("sized"), part=p, size=F.when(F.col("p_size") > 25, F.col("p_size"))).alias("line"), X.text_hash(F.col("p_name")).alias("digest"), session.alias("session"), unit.alias("unit"), X.prompt("Part {name} ({brand})", name=F.col("p_name"), brand=F.col("p_brand")).alias("prompt"), X.bounded(F.col("p_name"), 10).alias("bounded"))


@query("script_validation", f"""WITH {CODES_SQL}, w AS (SELECT conv_id AS chapter, turn AS idx, CASE WHEN turn % 9 = 8 THEN 99 ELSE role_idx END AS role_idx, CASE WHEN turn % 7 = 6 THEN 5 ELSE 1 END AS type_idx FROM conversations c JOIN codes ON codes.chapter = conv_id AND codes.role = c.role WHERE turn % 4 <> 3),
e AS (SELECT conv_id AS chapter, turn AS idx, 'missing sentence' AS error FROM conversations WHERE turn % 4 = 3 UNION ALL SELECT chapter, idx, 'role out of range at' FROM w WHERE role_idx = 99 UNION ALL SELECT chapter, idx, 'type out of range at' FROM w WHERE type_idx = 5
UNION ALL SELECT DISTINCT conv_id, NULL::BIGINT, 'unknown role ' || role FROM conversations WHERE role NOT IN ('user', 'assistant')
UNION ALL SELECT DISTINCT conv_id, NULL, 'taken name user' FROM conversations UNION ALL SELECT DISTINCT conv_id, NULL, 'no gender of user' FROM conversations UNION ALL SELECT DISTINCT conv_id, NULL, 'long voice instruction of user' FROM conversations UNION ALL SELECT DISTINCT conv_id, NULL, 'no personality of guard' FROM conversations)
SELECT chapter, string_agg(error || coalesce(' ' || idx, ''), '; ' ORDER BY idx IS NULL, idx, error) AS errors FROM e GROUP BY chapter""")
def script_validation(spark, sf_dir):
    c, roles = chapters(spark, sf_dir)
    i = F.col("idx")
    rows = c.filter(i % 4 != 3).join(roles, ["chapter", "role"]).select("chapter", "idx", F.when(i % 9 == 8, 99).otherwise(F.col("role_idx")).alias("role_idx"), F.when(i % 7 == 6, 5).otherwise(1).alias("type_idx"))
    none = F.lit(None).cast("string")

    def profile(gender, traits):
        return F.struct(none.alias("profile_id"), none.alias("person_id"), F.lit("adult").alias("age_stage"), gender.alias("gender"), traits.alias("personality"), F.array(none).alias("aliases"))

    each = c.select("chapter").distinct()
    people = each.select("chapter", F.lit(0).alias("pos"), F.lit("user").alias("name"), profile(none, F.array(F.lit("calm"))).alias("profile"), F.struct(F.lit("d").alias("description"), F.repeat(F.lit("x"), F.lit(241)).alias("instruction")).alias("voice"))
    speakers = each.select("chapter", F.lit(0).alias("pos"), F.lit("tmp_001").alias("local_id"), F.lit("guard").alias("label"), profile(F.lit("male"), F.array(none)).alias("profile"))
    known = c.filter(F.col("role").isin("user", "assistant")).select(F.col("role").alias("name")).distinct()
    return Q.script_errors(c, rows, roles, known, people, speakers)


@query("reading_positions", "SELECT c_custkey, c_custkey % 4 < 2 AS valid FROM customer WHERE c_custkey IN (SELECT conv_id FROM conversations WHERE turn <= 1 GROUP BY 1 HAVING count(*) = 2)")
def reading_positions(spark, sf_dir):
    c = conversations(spark, sf_dir)
    both = c.filter("turn <= 1").groupBy("conv_id").count().filter("count = 2").select("conv_id")
    saved = customer(spark, sf_dir).join(both, F.col("c_custkey") == F.col("conv_id")).select("c_custkey", "conv_id", F.when(F.col("c_custkey") % 4 < 2, F.col("c_custkey") % 2).otherwise(-1).alias("turn"))
    return Q.positions(saved, c, "conv_id", "turn").select("c_custkey", "valid")


@query("package_check", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'toc.json,units' ELSE 'registry.json,chapters' END AS errors FROM part WHERE p_partkey % 3 <> 2")
def package_check(spark, sf_dir):
    k = F.col("p_partkey") % 3
    files = F.when(k == 0, F.array(F.lit("readalong_book.json"), F.lit("registry.json"), F.lit("chapters/1.txt"))).when(k == 1, F.array(F.lit("readalong_book.json"), F.lit("toc.json"), F.lit("read_along/a.units.json"))).otherwise(F.array(*map(F.lit, B.REQUIRED), F.lit("chapters/1.txt"), F.lit("read_along/a.units.json")))
    return Q.package_errors(part(spark, sf_dir).select("p_partkey", F.explode(files).alias("f")), "p_partkey", "f", B.REQUIRED, B.REQUIRED_KINDS)


@query("unit_slice", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS unit_id FROM conversations WHERE trim(coalesce(text, '')) <> '' QUALIFY unit_id >= 2 AND unit_id < 5")
def unit_slice(spark, sf_dir):
    units = B.numbered(conversations(spark, sf_dir).filter(F.trim(F.coalesce("text", F.lit(""))) != ""), "conv_id", ["turn"], "unit_id")
    return units.filter((F.col("unit_id") >= 2) & (F.col("unit_id") < 5)).select("conv_id", "turn", "unit_id")


