"""Queries on registries, coverage, measurements and samples, over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import voice as V
from ..operators import lookup as L
from ..operators import metrics as M
from ..operators import quality as Q
from ..operators import registry as R
from ..operators import sequence as S
from .base import Plan, name_key, reader, slug

PLAN = Plan()
query, QUERIES, SQL = PLAN.query, PLAN.QUERIES, PLAN.SQL
part, customer, nation, documents, labels, events, embeddings, conversations, benchmark, pages, supplier = map(reader, ("part", "customer", "nation", "documents", "labels", "events", "embeddings", "conversations", "benchmark", "pages", "supplier"))
LABELS_SQL = "[" + ", ".join(f"'{x}'" for x in V.DIFFERENTIATORS) + "]"
SEED_SQL = "('0x' || substr(sha256('tpch:' || {}), 1, 8))::BIGINT"


@query("voice_seed", f"WITH s AS (SELECT p_partkey, {SEED_SQL.format(slug('p_name'))} AS seed FROM part) SELECT p_partkey, seed, array_to_string(list_transform(range(3), lambda i: {LABELS_SQL}[(seed + i) % 8 + 1]), ', ') AS labels, 'Calm voice, with ' || array_to_string(list_transform(range(3), lambda i: {LABELS_SQL}[(seed + i) % 8 + 1]), ', ') || '.' AS instruction FROM s")
def voice_seed(spark, sf_dir):
    rows = part(spark, sf_dir).select("p_partkey", V.seed(F.lit("tpch"), X.slug(F.col("p_name"))).alias("seed"))
    labels_of = V.labels(F.col("seed"))
    return rows.select("p_partkey", "seed", F.array_join(labels_of, ", ").alias("labels"), V.with_labels(F.lit("Calm voice. "), labels_of).alias("instruction"))


@query("profile_hash", "SELECT c_custkey, sha256(coalesce(c_name, '') || chr(10) || coalesce(c_mktsegment, '')) AS digest FROM customer")
def profile_hash(spark, sf_dir):
    return customer(spark, sf_dir).select("c_custkey", V.profile_hash(F.col("c_name"), F.col("c_mktsegment")).alias("digest"))


def _accent_sql(x: str) -> str:
    return "CASE " + " ".join("WHEN " + " AND ".join(f"contains({x}, '{p}')" for p in parts) + f" THEN '{name}'" for parts, name in V.ACCENTS) + " END"


@query("accent_rules", f"WITH k AS (SELECT n_nationkey, {name_key('''n_name || ' ' || CASE n_nationkey % 5 WHEN 0 THEN 'upper-class English' WHEN 1 THEN 'German and Scottish' WHEN 2 THEN 'german' WHEN 3 THEN 'Yorkshire' ELSE 'none' END''')} AS k FROM nation) SELECT n_nationkey, {_accent_sql('k')} AS accent FROM k")
def accent_rules(spark, sf_dir):
    kind = F.pmod("n_nationkey", F.lit(5))
    said = F.when(kind == 0, "upper-class English").when(kind == 1, "German and Scottish").when(kind == 2, "german").when(kind == 3, "Yorkshire").otherwise("none")
    return nation(spark, sf_dir).select("n_nationkey", V.accent(F.concat_ws(" ", "n_name", said)).alias("accent"))


def registry(spark, sf_dir):
    """Parts as characters: two words of a name, its brand as an alias, its size as an age stage."""
    words = F.split("p_name", " ")
    shown = F.concat_ws(" ", F.when(F.col("p_partkey") % 7 == 0, "Mr."), F.element_at(words, 1), F.try_element_at(words, F.lit(2)))
    stage = F.when(F.col("p_size") > 40, "adult").when(F.col("p_size") > 20, "teen").otherwise("")
    return part(spark, sf_dir).select(
        F.col("p_partkey").alias("ord"), F.concat(X.slug(shown), F.lit("_"), F.col("p_partkey").cast("string")).alias("role_id"), X.slug(shown).alias("profile_id"), shown.alias("display_name"), F.array(F.concat_ws(" ", "p_brand", F.col("p_partkey").cast("string"))).alias("aliases"), stage.alias("age_stage")
    )


REG_SQL = f"""reg0 AS (SELECT p_partkey AS ord, concat_ws(' ', CASE WHEN p_partkey % 7 = 0 THEN 'Mr.' END, string_split(p_name, ' ')[1], string_split(p_name, ' ')[2]) AS display_name, p_brand || ' ' || p_partkey AS alias1, CASE WHEN p_size > 40 THEN 'adult' WHEN p_size > 20 THEN 'teen' ELSE '' END AS age_stage FROM part),
reg AS (SELECT *, {slug('display_name')} || '_' || ord AS role_id, {slug('display_name')} AS profile_id, regexp_split_to_array(trim(display_name), '\\s+') AS parts FROM reg0)"""
BRIDGE_SQL = f"""{REG_SQL}, nm0 AS (SELECT role_id, age_stage, unnest([role_id, replace(role_id, '_', ' '), display_name, alias1, CASE WHEN len(parts) >= 3 AND lower(rtrim(parts[1], '.')) IN ('mr', 'mrs', 'ms', 'miss', 'dr', 'sir', 'lady', 'lord') THEN parts[1] || ' ' || parts[-1] END]) AS name FROM reg),
nm AS (SELECT role_id, name FROM nm0 WHERE name IS NOT NULL UNION ALL SELECT role_id, name || ' ' || age_stage FROM nm0 WHERE name IS NOT NULL AND age_stage <> ''),
bridge AS (SELECT DISTINCT {name_key('name')} AS alias, role_id FROM nm WHERE {name_key('name')} <> '')"""


@query("alias_bridge", f"WITH {BRIDGE_SQL} SELECT alias, role_id FROM bridge")
def alias_bridge(spark, sf_dir):
    return L.alias_bridge(registry(spark, sf_dir))


@query("unique_aliases", f"WITH {BRIDGE_SQL} SELECT alias, min(role_id) AS role_id FROM bridge GROUP BY alias HAVING count(*) = 1")
def unique_aliases(spark, sf_dir):
    return L.unique_aliases(L.alias_bridge(registry(spark, sf_dir)))


@query("match_candidates", f"""WITH {BRIDGE_SQL}, c AS (SELECT p_partkey, unnest([string_split(p_name, ' ')[1] || ' ' || coalesce(string_split(p_name, ' ')[2], ''), p_brand || ' ' || p_partkey]) AS a FROM part),
m AS (SELECT p_partkey, list_sort(list(DISTINCT role_id) FILTER (role_id IS NOT NULL)) AS r FROM c LEFT JOIN bridge ON alias = {name_key('a')} GROUP BY p_partkey)
SELECT p_partkey, CASE WHEN len(r) = 1 THEN r[1] END AS role_id, coalesce(len(r), 0)::BIGINT AS n_roles, coalesce(array_to_string(r, ','), '') AS roles FROM m""")
def match_candidates(spark, sf_dir):
    words = F.split("p_name", " ")
    said = part(spark, sf_dir).select("p_partkey", F.array(F.concat(F.element_at(words, 1), F.lit(" "), F.coalesce(F.try_element_at(words, F.lit(2)), F.lit(""))), F.concat_ws(" ", "p_brand", F.col("p_partkey").cast("string"))).alias("aliases"))
    return L.match_candidates(said, L.alias_bridge(registry(spark, sf_dir)), "p_partkey", "aliases")


@query("resolve_names", f"""WITH {REG_SQL}, d0 AS (SELECT *, count(*) OVER (PARTITION BY {name_key('display_name')}) AS same FROM reg),
d1 AS (SELECT ord, role_id, unnest([role_id, replace(role_id, '_', ' '), profile_id, replace(profile_id, '_', ' '), CASE WHEN same = 1 THEN display_name END, alias1]) AS n FROM d0),
direct AS (SELECT {name_key('n')} AS k, arg_min(role_id, ord) AS role_id FROM d1 WHERE n IS NOT NULL AND {name_key('n')} <> '' GROUP BY 1),
short AS (SELECT {name_key("trim(parts[1], '.,;:!?')")} AS k, min(role_id) AS role_id FROM reg WHERE length({name_key("trim(parts[1], '.,;:!?')")}) > 2 GROUP BY 1 HAVING count(*) = 1),
n AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Narrator' WHEN 1 THEN string_split(p_name, ' ')[1] WHEN 2 THEN string_split(p_name, ' ')[1] || ' ' || coalesce(string_split(p_name, ' ')[2], '') ELSE p_brand || ' ' || p_partkey END AS name FROM customer JOIN part ON p_partkey = c_custkey)
SELECT c_custkey, name, CASE WHEN {name_key('name')} = 'narrator' THEN 'narrator' ELSE coalesce(direct.role_id, short.role_id) END AS role_id, CASE WHEN {name_key('name')} = 'narrator' THEN 'narrator' WHEN direct.role_id IS NOT NULL THEN 'direct' WHEN short.role_id IS NOT NULL THEN 'short' ELSE 'none' END AS how
FROM n LEFT JOIN direct ON direct.k = {name_key('name')} LEFT JOIN short ON short.k = {name_key('name')}""")
def resolve_names(spark, sf_dir):
    words, kind = F.split("p_name", " "), F.pmod("c_custkey", F.lit(4))
    name = F.when(kind == 0, "Narrator").when(kind == 1, F.element_at(words, 1)).when(kind == 2, F.concat(F.element_at(words, 1), F.lit(" "), F.coalesce(F.try_element_at(words, F.lit(2)), F.lit("")))).otherwise(F.concat_ws(" ", "p_brand", F.col("p_partkey").cast("string")))
    names = customer(spark, sf_dir).join(part(spark, sf_dir), F.col("p_partkey") == F.col("c_custkey")).select("c_custkey", name.alias("name"))
    return L.resolve(names, registry(spark, sf_dir))


@query("kth_match", "WITH a AS (SELECT conv_id, turn, role || ':' || length(text) % 9 AS k, conv_id * 100000 + turn AS o FROM conversations), l AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o) AS rn FROM a WHERE conv_id % 2 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o) AS rn FROM a WHERE conv_id % 2 = 1) SELECT l.k AS match_key, l.o AS left_o, r.o AS right_o FROM l JOIN r ON l.k = r.k AND l.rn = r.rn")
def kth_match(spark, sf_dir):
    key = F.concat_ws(":", "role", (F.length("text") % 9).cast("string"))
    rows = conversations(spark, sf_dir).filter("role IS NOT NULL AND text IS NOT NULL").select(key.alias("match_key"), "conv_id", (F.col("conv_id") * 100000 + F.col("turn")).alias("o"))
    side = lambda k, name: rows.filter(F.col("conv_id") % 2 == k).select("match_key", F.col("o").alias(f"{name}_o"))
    return L.kth_match(side(0, "left"), side(1, "right"), "match_key", "left_o", "right_o")


@query("coverage_check", "SELECT doc_id, 'missing' AS error FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'extra' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT doc_id, 'duplicate' FROM labels GROUP BY doc_id HAVING count(*) > 1")
def coverage_check(spark, sf_dir):
    return Q.coverage(documents(spark, sf_dir), labels(spark, sf_dir), "doc_id")


@query("missing_assets", "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def missing_assets(spark, sf_dir):
    return Q.unused(documents(spark, sf_dir), labels(spark, sf_dir), "doc_id")


@query("stale_rows", "WITH c AS (SELECT p_partkey, sha256(p_name || chr(10) || p_brand) AS digest FROM part), o AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'old' ELSE digest END AS digest FROM c WHERE p_partkey % 11 <> 0) SELECT p_partkey, CASE WHEN o.digest IS NULL THEN 'missing' ELSE 'changed' END AS reason FROM c LEFT JOIN o USING (p_partkey) WHERE o.digest IS DISTINCT FROM c.digest")
def stale_rows(spark, sf_dir):
    now = part(spark, sf_dir).select("p_partkey", V.profile_hash(F.col("p_name"), F.col("p_brand")).alias("digest"))
    old = now.filter(F.col("p_partkey") % 11 != 0).withColumn("digest", F.when(F.col("p_partkey") % 5 == 0, "old").otherwise(F.col("digest")))
    return R.stale(now, old, "p_partkey", "digest")


@query("registry_merge", f"""WITH p AS (SELECT p_partkey, p_brand, nullif(CASE WHEN p_partkey % 3 = 0 THEN 'unknown' WHEN p_partkey % 3 = 1 THEN '' ELSE p_type END, '') AS kind, string_split(p_name, ' ')[1] AS word FROM part),
k AS (SELECT p_brand, arg_min(word, p_partkey) AS w, min(p_partkey) AS o FROM p GROUP BY p_brand, {name_key('word')}),
a AS (SELECT p_brand, string_agg(w, ',' ORDER BY o) AS word FROM k GROUP BY p_brand)
SELECT p.p_brand, count(*) AS n_rows, arg_min(kind, p_partkey) FILTER (kind <> 'unknown') AS kind, any_value(a.word) AS word FROM p JOIN a USING (p_brand) GROUP BY p.p_brand""")
def registry_merge(spark, sf_dir):
    kind = F.when(F.col("p_partkey") % 3 == 0, "unknown").when(F.col("p_partkey") % 3 == 1, "").otherwise(F.col("p_type"))
    rows = part(spark, sf_dir).select("p_brand", "p_partkey", kind.alias("kind"), F.element_at(F.split("p_name", " "), 1).alias("word"))
    return R.merge(rows, "p_brand", "p_partkey", ["kind"], ["word"])


@query("person_variants", "SELECT p.p_name AS person, p.p_partkey AS role, string_agg(DISTINCT v.p_type, ',' ORDER BY v.p_type) AS variants, count(v.p_partkey) AS n_records, min(v.p_partkey) AS first_role FROM part p JOIN part v ON v.p_name = p.p_name GROUP BY p.p_name, p.p_partkey")
def person_variants(spark, sf_dir):
    rows = part(spark, sf_dir).select(F.col("p_name").alias("person"), F.col("p_partkey").alias("role"), "p_type")
    return R.variants(rows, "person", "role", "p_type")


@query("unique_slugs", f"WITH s AS (SELECT p_partkey, {slug('p_name')} AS slug FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) AS k FROM s) SELECT p_partkey, slug, CASE WHEN k = 1 THEN slug ELSE slug || '_' || k END AS unique_slug FROM n")
def unique_slugs(spark, sf_dir):
    return R.unique_slugs(part(spark, sf_dir).select("p_partkey", X.slug(F.col("p_name")).alias("slug")), "slug", "p_partkey")


STATUS_SQL = "CASE WHEN n_ready = 0 THEN 'new' WHEN n_ready < n THEN 'in_progress' WHEN n_bad > 0 THEN 'needs_review' ELSE 'ready' END"


@query("book_summary", f"WITH b AS (SELECT source, count(*) AS n, count(l.doc_id) AS n_ready, count(*) FILTER (toxic = 1) AS n_bad, sum(n_chars)::BIGINT AS chars FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source) SELECT source, n AS n_docs, n_ready, n_bad, chars, {STATUS_SQL} AS status FROM b")
def book_summary(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", "source", "n_chars").join(labels(spark, sf_dir).withColumn("seen", F.lit(1)), "doc_id", "left")
    out = rows.groupBy("source").agg(F.count("*").alias("n_docs"), F.count("seen").alias("n_ready"), F.count_if(F.col("toxic") == 1).alias("n_bad"), F.sum("n_chars").alias("chars"))
    ready, every = F.col("n_ready"), F.col("n_docs")
    return out.withColumn("status", F.when(ready == 0, "new").when(ready < every, "in_progress").when(F.col("n_bad") > 0, "needs_review").otherwise("ready"))


@query("tiered_selection", "WITH t AS (SELECT doc_id, source, CASE WHEN text LIKE '%icen%' THEN 1 WHEN length(text) >= 3000 THEN 2 WHEN length(text) >= 300 THEN 3 END AS tier FROM documents), b AS (SELECT *, min(tier) OVER (PARTITION BY source) AS best FROM t) SELECT doc_id, source, tier::BIGINT AS tier, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS number FROM b WHERE tier = best")
def tiered_selection(spark, sf_dir):
    n = F.length("text")
    tier = F.when(F.contains("text", F.lit("icen")), 1).when(n >= 3000, 2).when(n >= 300, 3).cast("long")
    rows = documents(spark, sf_dir).select("doc_id", "source", tier.alias("tier"))
    best = rows.groupBy("source").agg(F.min("tier").alias("tier"))  # partial sums first: a hot source costs one row per task
    kept = rows.join(best, ["source", "tier"])
    return S.running_sum(kept.withColumn("one", F.lit(1)), "source", "doc_id", "one", "k").select("doc_id", "source", "tier", (F.col("k") + 1).cast("long").alias("number"))


@query("settings_clamp", "SELECT event_id, greatest(10, least(60, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 20)))::BIGINT AS k, CASE WHEN lower(trim(event_type)) IN ('click', 'view', 'purchase') THEN lower(trim(event_type)) ELSE 'other' END AS kind FROM events")
def settings_clamp(spark, sf_dir):
    k = F.get_json_object("props", "$.k").try_cast("long")
    return events(spark, sf_dir).select("event_id", V.clamp(k, 10, 60, 20).cast("long").alias("k"), V.choice(F.col("event_type"), ("click", "view", "purchase"), "other").alias("kind"))


@query("perf_rollup", "WITH e AS (SELECT user_id, event_type, json_extract_string(props, '$.k')::BIGINT AS k, value FROM events), s AS (SELECT user_id, event_type, max(k) AS k, count(*) AS n, sum(value) AS v FROM e GROUP BY 1, 2) SELECT user_id, sum(k)::BIGINT AS jobs, sum(n)::BIGINT AS n_events, count(*) AS n_kinds, round(sum(v), 4) AS total FROM s GROUP BY user_id")
def perf_rollup(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"), "value")
    s = e.groupBy("user_id", "event_type").agg(F.max("k").alias("k"), F.count("*").alias("n"), F.sum("value").alias("v"))
    return s.groupBy("user_id").agg(F.sum("k").alias("jobs"), F.sum("n").alias("n_events"), F.count("*").alias("n_kinds"), F.round(F.sum("v"), 4).alias("total"))


SWEEP_SQL = "r AS (SELECT user_id AS target, event_id, 1 + value AS s, 2 + value * 3 AS p, value AS peak, event_type <> 'error' AS ok, CASE WHEN event_type = 'error' THEN 'failed' END AS err FROM events)"


def sweep(spark, sf_dir):
    v = F.col("value")
    return events(spark, sf_dir).select(F.col("user_id").alias("target"), "event_id", (1 + v).alias("s"), (2 + v * 3).alias("p"), v.alias("peak"), (F.col("event_type") != "error").alias("ok"), F.when(F.col("event_type") == "error", "failed").alias("err"))


@query("sweep_average", f"WITH {SWEEP_SQL}, a AS (SELECT target, count(*) AS repeats, bool_and(ok) AS success, coalesce(avg(s), 0) AS s, coalesce(avg(p) FILTER (ok), 0) AS p, max(peak) AS peak, string_agg(err, '; ') AS e FROM r GROUP BY target) SELECT target, repeats, success, round(s, 6) AS seconds, round(p, 6) AS playback, peak, round(CASE WHEN success AND p > 0 THEN s / p END, 6) AS rtf, round(CASE WHEN success AND s > 0 THEN p / s END, 6) AS speed, CASE WHEN NOT success THEN coalesce(e, 'repeat failed') END AS error FROM a")
def sweep_average(spark, sf_dir):
    out = M.average_repeats(sweep(spark, sf_dir), "target", "s", "p", "peak", "ok", "err")
    return out.select("target", "repeats", "success", *[F.round(c, 6).alias(c) for c in ("seconds", "playback")], "peak", *[F.round(c, 6).alias(c) for c in ("rtf", "speed")], "error")


@query("first_under_threshold", f"WITH {SWEEP_SQL}, t AS (SELECT unnest([0.5, 0.4, 0.35]) AS threshold) SELECT target, threshold::DOUBLE AS threshold, min(event_id) FILTER (p > 0 AND s / p <= threshold) AS at FROM r, t GROUP BY 1, 2")
def first_under_threshold(spark, sf_dir):
    rows = sweep(spark, sf_dir).withColumn("rtf", M.ratio(F.col("s"), F.col("p")))
    return M.first_under(rows, "target", "event_id", "rtf", [0.5, 0.4, 0.35])


@query("sweep_until_limit", f"WITH {SWEEP_SQL}, q AS (SELECT target, min(event_id) FILTER (peak >= 150) AS stop FROM r GROUP BY target) SELECT r.target, r.event_id FROM r JOIN q USING (target) WHERE stop IS NULL OR event_id <= stop")
def sweep_until_limit(spark, sf_dir):
    return M.until_limit(sweep(spark, sf_dir), "target", "event_id", "peak", 150.0).select("target", "event_id")


@query("readiness_margin", "SELECT event_id, user_id, round(sum(2 + value * 3) OVER w - (1 + value), 4) AS margin FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def readiness_margin(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "user_id", (2 + F.col("value") * 3).alias("p"), "value")
    out = S.running_sum(rows, "user_id", "event_id", "p", "before")
    return out.select("event_id", "user_id", F.round(F.col("before") + F.col("p") - (1 + F.col("value")), 4).alias("margin"))


@query("memory_peaks", "SELECT user_id, round_even(greatest(max(value * 1e8), max(coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0) * 1e7)) / 1073741824.0, 3) AS peak_gb FROM events GROUP BY user_id")
def memory_peaks(spark, sf_dir):
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast("long"), F.lit(0)) * 1e7
    return events(spark, sf_dir).groupBy("user_id").agg(M.gigabytes(F.greatest(F.max(F.col("value") * 1e8), F.max(k))).alias("peak_gb"))


@query("adaptive_limit", """WITH RECURSIVE e AS (SELECT user_id, event_id, 1 + event_id % 9 AS b, trunc(value * 1000)::BIGINT AS p, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
s AS (SELECT user_id, 0::BIGINT AS rn, 0::BIGINT AS event_id, 4::BIGINT AS was, 4::BIGINT AS now FROM e WHERE rn = 1
UNION ALL SELECT e.user_id, e.rn, e.event_id, s.now, CASE WHEN p <= 0 THEN s.now WHEN p > 120000 THEN greatest(1, floor(b * 120000 / p * 0.85))::BIGINT WHEN s.now > 0 AND p < 78000 THEN CASE WHEN s.now + greatest(1, s.now // 2) >= 24 THEN 0 ELSE s.now + greatest(1, s.now // 2) END ELSE s.now END FROM s JOIN e ON e.user_id = s.user_id AND e.rn = s.rn + 1)
SELECT user_id, event_id, was AS limit_before, now AS limit_after FROM s WHERE rn > 0""")
def adaptive_limit(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "event_id", (1 + F.pmod("event_id", F.lit(9))).alias("blocks"), (F.col("value") * 1000).cast("long").alias("peak"))
    return S.adaptive_limits(rows, "user_id", ["event_id"], "blocks", "peak", 120_000, 4).select("user_id", "event_id", "limit_before", "limit_after")


@query("job_progress", "WITH e AS (SELECT user_id, event_id, CASE event_id % 3 WHEN 0 THEN 'started' WHEN 1 THEN 'completed' ELSE 'failed' END AS kind, event_id % 40 AS idx FROM events) SELECT user_id, coalesce(greatest(max(CASE kind WHEN 'completed' THEN idx WHEN 'started' THEN idx - 1 END), 0), 0)::BIGINT AS completed, arg_max(kind, event_id) AS status, max(idx) FILTER (kind = 'failed')::BIGINT AS failed_at FROM e GROUP BY user_id")
def job_progress(spark, sf_dir):
    m = F.pmod("event_id", F.lit(3))
    e = events(spark, sf_dir).select("user_id", "event_id", F.when(m == 0, "started").when(m == 1, "completed").otherwise("failed").alias("kind"), F.pmod("event_id", F.lit(40)).alias("idx"))
    return R.progress(e, "user_id", "event_id", "kind", "idx")


@query("resume_point", "WITH s AS (SELECT d.source, d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN toxic = 1 AND quality = 0 THEN 'failed' WHEN toxic = 1 THEN 'stale' ELSE 'done' END AS stage FROM documents d LEFT JOIN labels l USING (doc_id)) SELECT source, coalesce(min(doc_id) FILTER (stage = 'failed'), min(doc_id) FILTER (stage IN ('stale', 'missing')), 0)::BIGINT AS resume_at FROM s GROUP BY source")
def resume_point(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", "source").join(labels(spark, sf_dir).withColumn("seen", F.lit(1)), "doc_id", "left")
    stage = F.when(F.col("seen").isNull(), "missing").when((F.col("toxic") == 1) & (F.col("quality") == 0), "failed").when(F.col("toxic") == 1, "stale").otherwise("done")
    return R.resume_points(rows.withColumn("stage", stage), "source", "doc_id", "stage")


@query("resume_after_run", """WITH d AS (SELECT d.source, d.doc_id, substr(d.source, 4)::INTEGER AS k, l.doc_id IS NULL AS new, toxic = 1 AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)),
s AS (SELECT source, doc_id, (k % 4 * 5 - 3)::BIGINT AS completed, CASE WHEN k % 5 = 0 AND toxic THEN 'failed' WHEN k % 5 = 1 AND toxic THEN 'running' WHEN k % 5 = 2 AND new THEN 'missing' WHEN k % 5 = 3 AND toxic THEN 'stale' ELSE 'done' END AS stage FROM d)
SELECT source, coalesce(min(doc_id) FILTER (stage = 'failed'), min(doc_id) FILTER (stage = 'running'), CASE WHEN max(completed) > 0 AND max(completed) <= count(*) THEN max(completed) - 1 END, min(doc_id) FILTER (stage IN ('stale', 'missing')), 0)::BIGINT AS resume_at FROM s GROUP BY source""")
def resume_after_run(spark, sf_dir):
    """Sources with a failed or a running document, a last completed one that exists or doesn't, stale and missing ones, or none."""
    k = F.substring("source", 4, 9).cast("int")
    rows = documents(spark, sf_dir).select("doc_id", "source").join(labels(spark, sf_dir).withColumn("seen", F.lit(1)), "doc_id", "left")
    toxic = F.coalesce(F.col("toxic") == 1, F.lit(False))
    stage = F.when((k % 5 == 0) & toxic, "failed").when((k % 5 == 1) & toxic, "running").when((k % 5 == 2) & F.col("seen").isNull(), "missing").when((k % 5 == 3) & toxic, "stale").otherwise("done")
    return R.resume_points(rows.withColumns({"stage": stage, "completed": (k % 4 * 5 - 3).cast("long")}), "source", "doc_id", "stage", "completed")


@query("same_bags", "WITH a AS (SELECT lang AS g, quality AS v, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2), b AS (SELECT lang AS g, toxic AS v, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2) SELECT g, bool_and(a.n IS NOT DISTINCT FROM b.n) AS same FROM a FULL JOIN b USING (g, v) GROUP BY g")
def same_bags(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.col("lang").alias("g")).join(labels(spark, sf_dir), "doc_id")
    return Q.same_bags(rows.select("g", F.col("quality").alias("v")), rows.select("g", F.col("toxic").alias("v")), "g", "v")


@query("pcm_encode", "WITH s AS (SELECT vec_id, label, list_transform(embedding, lambda x: trunc(least(1, greatest(-1, x::DOUBLE)) * 32767)::BIGINT) AS v FROM embeddings) SELECT vec_id, array_to_string(v, ',') AS pcm, list_sum(v)::BIGINT AS total FROM s")
def pcm_encode(spark, sf_dir):
    v = F.transform("embedding", lambda x: (F.least(F.lit(1.0), F.greatest(F.lit(-1.0), x.cast("double"))) * 32767).cast("long"))
    rows = embeddings(spark, sf_dir).select("vec_id", v.alias("v"))
    return rows.select("vec_id", F.array_join(F.transform("v", lambda x: x.cast("string")), ",").alias("pcm"), F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("element_means", "WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS pos FROM embeddings) SELECT label, pos, round(avg(x), 6) AS mean FROM e GROUP BY label, pos")
def element_means(spark, sf_dir):
    rows = embeddings(spark, sf_dir).select("label", F.posexplode("embedding").alias("p", "x"))
    return rows.groupBy("label", F.col("p").cast("long").alias("pos")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query("attribution_errors", """WITH q AS (SELECT conv_id AS chapter, turn AS idx FROM conversations WHERE turn % 5 <> 4),
w AS (SELECT conv_id AS chapter, turn AS idx, CASE WHEN turn % 11 = 10 THEN 'out' WHEN turn % 6 = 5 THEN 'ghost' WHEN turn % 6 = 2 THEN 'Narrator' ELSE role END AS role, CASE WHEN turn % 7 = 6 THEN 'song' WHEN turn % 8 = 5 THEN 'narrator_quote' ELSE 'dialogue' END AS kind FROM conversations WHERE turn % 4 <> 3),
e AS (SELECT chapter, idx, 'missing quote' AS error FROM q WHERE (chapter, idx) NOT IN (SELECT (chapter, idx) FROM w) UNION ALL SELECT chapter, idx, 'extra quote' FROM w WHERE (chapter, idx) NOT IN (SELECT (chapter, idx) FROM q)
UNION ALL SELECT chapter, idx, CASE WHEN role = 'out' THEN 'role out of range' WHEN kind = 'song' THEN 'unknown kind' WHEN kind = 'narrator_quote' THEN NULL WHEN role = 'Narrator' THEN 'Narrator cannot speak dialogue' WHEN role = 'ghost' THEN 'unknown role ghost of' END FROM w
UNION ALL SELECT DISTINCT chapter, NULL::BIGINT, 'unused local speaker tmp_009' FROM q)
SELECT chapter, string_agg(error || coalesce(' ' || idx, ''), '; ' ORDER BY idx IS NULL, idx, error) AS errors FROM e WHERE error IS NOT NULL GROUP BY chapter""")
def attribution_errors(spark, sf_dir):
    c = conversations(spark, sf_dir).select(F.col("conv_id").alias("chapter"), F.col("turn").alias("idx"), "role")
    i = F.col("idx")
    role = F.when(i % 11 == 10, "out").when(i % 6 == 5, "ghost").when(i % 6 == 2, "Narrator").otherwise(F.col("role"))
    rows = c.filter(i % 4 != 3).select("chapter", "idx", role.alias("role"), F.when(i % 7 == 6, "song").when(i % 8 == 5, "narrator_quote").otherwise("dialogue").alias("kind"))
    every = c.select("chapter").distinct()
    roles = every.crossJoin(F.broadcast(spark.createDataFrame([(0, "ghost"), (1, "Narrator"), (2, "user"), (3, "assistant"), (4, "system"), (5, "tool")], "role_idx long, role string")))
    coded = rows.join(roles, ["chapter", "role"], "left").select("chapter", "idx", F.coalesce("role_idx", F.lit(99)).alias("role_idx"), "kind")
    known = spark.createDataFrame([("user",), ("ASSISTANT",), ("system",), ("tool",)], "role string")
    return Q.attribution_errors(c.filter(i % 5 != 4), coded, roles, known, every.withColumn("local_id", F.lit("tmp_009")))


@query("event_stream", "SELECT event_type, date_trunc('hour', ts) AS begin, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def event_stream(spark, sf_dir):
    """Streaming: events per kind and hour, from the table read as a stream; its results go to files in the shared folder."""
    from ..streaming.stateful import drain, event_counts, table_stream

    stream = event_counts(table_stream(spark, f"{sf_dir}/events.parquet"), "ts", "event_type", "value")
    return drain(stream, "complete").withColumn("total", F.round("total", 2))
