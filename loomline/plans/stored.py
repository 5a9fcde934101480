"""Queries on what is stored and asked for: tailed files, imported books, keyed tables, outside calls, keyed streams, cascades."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from ..operators import asking as K
from ..operators import library as B
from ..operators import lookup as L
from ..operators import orchestration as O
from ..operators import quality as Q
from ..session import scratch
from ..sources import books, keyed, tail
from .base import Plan, name_key, reader
from .tables import BRIDGE_SQL, registry
from .texts import QUOTED, QUOTED_SQL, units_sql

PLAN = Plan()
query, QUERIES, SQL = PLAN.query, PLAN.QUERIES, PLAN.SQL
conversations, part, events, documents, supplier = map(reader, ("conversations", "part", "events", "documents", "supplier"))


def place(spark, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


@query("tailed_events", "SELECT event_id, user_id, event_type, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 2 END AS run FROM events")
def tailed_events(spark, sf_dir):
    """Events written as JSON lines and tailed in two runs of one stream: the second gets only the lines that came after the first."""
    from ..streaming.stateful import drain

    path, check = place(spark, "events"), place(spark, "tail")
    runs = []
    for run in (1, 2):
        e = events(spark, sf_dir).select("event_id", "user_id", "event_type").filter(F.col("event_id") % 2 == run - 1)
        e.write.mode("append").json(path)
        told = drain(tail.tail_events(spark, path, "event_id long, user_id long, event_type string", suffix=".json", part=1 << 16), checkpoint=check)
        runs.append(told.select("event_id", "user_id", "event_type", F.lit(run).alias("run")))
    return runs[0].unionByName(runs[1])


@query("imported_books", """WITH b AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id % 5 ORDER BY printf('%09d', conv_id)) AS nth, count(*) AS n, sum(strlen(coalesce(text, '')))::BIGINT AS size FROM conversations GROUP BY conv_id)
SELECT 'shelf-' || conv_id % 5 || CASE WHEN nth > 1 THEN '-' || nth ELSE '' END AS slug, n AS n_chapters, size AS n_bytes, 'Book ' || conv_id AS title FROM b""")
def imported_books(spark, sf_dir):
    """Conversations as books, a chapter for each turn, imported under few slugs, and read back from the library folder."""
    c = conversations(spark, sf_dir)
    book = F.format_string("%09d", "conv_id")
    slug = F.concat(F.lit("Shelf "), (F.col("conv_id") % 5).cast("string"))
    chapters = c.select(book.alias("book"), slug.alias("slug"), F.format_string("chapters/%05d.txt", "turn").alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    manifest = F.to_json(F.struct(F.concat(F.lit("Book "), F.col("conv_id").cast("string")).alias("title")))
    rest = F.explode(F.array(*[F.struct(F.lit(p).alias("path"), t.alias("data")) for p, t in ((books.MANIFEST, manifest), ("registry.json", F.lit("{}")), ("toc.json", F.lit("[]")), ("read_along/all.units.json", F.lit("{}")))])).alias("m")
    other = c.select("conv_id").distinct().select(book.alias("book"), slug.alias("slug"), rest).select("book", "slug", "m.path", F.col("m.data").cast("binary").alias("data"))
    root = place(spark, "library")
    books.import_books(chapters.unionByName(other), root, slug="slug")
    return books.library_books(spark, root).select("slug", "n_chapters", "n_bytes", F.get_json_object("manifest", "$.title").alias("title"))


@query("upserted_table", "SELECT CASE WHEN p_partkey % 3 = 0 THEN p_partkey ELSE p_partkey + 0 END AS p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'new ' || p_name ELSE p_name END AS p_name, CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS version FROM part UNION ALL SELECT -1 - p_partkey, p_name, 2 FROM part WHERE p_partkey % 3 = 1")
def upserted_table(spark, sf_dir):
    """A table of parts after two upserts: the second changes some keys, twice each, and adds others."""
    p = part(spark, sf_dir).select("p_partkey", "p_name")
    table = keyed.KeyedTable(spark, place(spark, "parts"), "p_partkey", "p_partkey long, p_name string, version int", 8)
    table.upsert(p.withColumn("version", F.lit(1)))
    k = F.col("p_partkey")
    changed = p.filter(k % 3 == 0).select(k, F.explode(F.array(F.struct(F.lit("old").alias("n"), F.lit(1).alias("o")), F.struct(F.concat(F.lit("new "), "p_name").alias("n"), F.lit(2).alias("o")))).alias("x")).select(k, F.col("x.n").alias("p_name"), F.col("x.o").alias("o"))
    added = p.filter(k % 3 == 1).select((-1 - k).alias("p_partkey"), "p_name", F.lit(1).alias("o"))
    table.upsert(changed.unionByName(added).withColumn("version", F.lit(2)), "o")
    return table.read()


@query("consolidated_candidates", f"""WITH {BRIDGE_SQL}, c AS (SELECT p_partkey, unnest([string_split(p_name, ' ')[1] || ' ' || coalesce(string_split(p_name, ' ')[2], ''), p_brand || ' ' || p_partkey]) AS a FROM part),
m AS (SELECT p_partkey, list_sort(list(DISTINCT role_id) FILTER (role_id IS NOT NULL)) AS r FROM c LEFT JOIN bridge ON alias = {name_key('a')} GROUP BY p_partkey)
SELECT p_partkey, CASE WHEN len(r) = 1 THEN r[1] WHEN len(r) > 1 AND p_partkey % 2 = 0 THEN r[len(r)] END AS role_id, CASE WHEN len(r) = 1 THEN 'match' WHEN len(r) > 1 AND p_partkey % 2 = 0 THEN 'asked' ELSE 'none' END AS how FROM m""")
def consolidated_candidates(spark, sf_dir):
    """Parts as candidates: a name that several roles have is asked for; the stand-in for a model picks the last role, or one that doesn't exist for odd parts."""
    words = F.split("p_name", " ")
    said = part(spark, sf_dir).select("p_partkey", F.array(F.concat(F.element_at(words, 1), F.lit(" "), F.coalesce(F.try_element_at(words, F.lit(2)), F.lit(""))), F.concat_ws(" ", "p_brand", F.col("p_partkey").cast("string"))).alias("aliases"))

    def client(prompt: str) -> str:
        asked = json.loads(prompt.split("\n\nThe last")[0])
        number = min(int(n.rsplit(" ", 1)[1]) for n in asked["names"] if "#" in n)
        return json.dumps({"role_id": asked["roles"][-1] if number % 2 == 0 else "nobody"})

    return K.consolidated(said, L.alias_bridge(registry(spark, sf_dir)), "p_partkey", "aliases", client, place(spark, "answers"))


@query("discovered_characters", """WITH RECURSIVE n AS (SELECT doc_id, source, length(text) AS n, row_number() OVER (ORDER BY doc_id) AS rn FROM documents),
f AS (SELECT doc_id, source, rn, 0::BIGINT AS chunk, n::BIGINT AS total FROM n WHERE rn = 1
UNION ALL SELECT n.doc_id, n.source, n.rn, CASE WHEN f.total + n.n > 50000 THEN chunk + 1 ELSE chunk END, CASE WHEN f.total + n.n > 50000 THEN n.n ELSE f.total + n.n END FROM f JOIN n ON n.rn = f.rn + 1),
s AS (SELECT source, count(DISTINCT chunk) AS n, min(chunk) AS c FROM f GROUP BY source), k AS (SELECT DISTINCT 'src' || s_suppkey AS source FROM supplier)
SELECT coalesce(s.source, k.source) AS role_id, coalesce(s.n, 0)::BIGINT + CASE WHEN k.source IS NULL THEN 0 ELSE 1 END AS n_rows, CASE WHEN s.source IS NULL THEN 'unknown' ELSE 'female' END AS gender, CASE WHEN s.source IS NOT NULL THEN 'Tokyo' END AS accent FROM s FULL JOIN k ON s.source = k.source""")
def discovered_characters(spark, sf_dir):
    """Documents as chapters of one book; the stand-in for a model finds each chunk's sources as characters."""
    c = documents(spark, sf_dir).select(F.col("doc_id").alias("order"), F.col("source").alias("title"), "text")
    none = lambda kind="string": F.lit(None).cast(kind)
    known = supplier(spark, sf_dir).select(F.col("s_suppkey").alias("ord"), F.concat(F.lit("src"), F.col("s_suppkey").cast("string")).alias("role_id"))
    known = known.select("ord", "role_id", F.col("role_id").alias("profile_id"), F.col("role_id").alias("person_id"), F.col("role_id").alias("display_name"), F.lit("unknown").alias("age_stage"), F.lit("unknown").alias("gender"), *[none().alias(x) for x in ("race_or_ethnicity", "accent", "occupation")], *[none("array<string>").alias(x) for x in ("personality", "aliases")])

    def client(prompt: str) -> str:
        found = sorted({line[3:] for line in prompt[max(prompt.find("\n## "), 0) :].split("\n") if line.startswith("## ")})
        return json.dumps({"characters": [{"name": f, "gender": "Female", "race_or_accent": "Japanese; Tokyo accent"} for f in found]})

    return K.discovered(c, known, client, place(spark, "answers"), most=50_000, block=10_000).select("role_id", "n_rows", "gender", "accent")


@query("annotated_chapters", f"""WITH u AS (SELECT doc_id AS chapter, row_number() OVER (PARTITION BY doc_id ORDER BY idx, part) - 1 AS unit, unit AS text FROM ({units_sql("sentence").replace("FROM documents", f"FROM (SELECT doc_id, source, {QUOTED_SQL.replace('sentence', 'text')} AS text FROM documents)")})),
s AS (SELECT *, CASE WHEN regexp_matches(text, '["“”]') THEN 'Speaker ' || length(text) % 3 ELSE 'Narrator' END AS role FROM u WHERE length(text) % 41 <> 40),
f AS (SELECT chapter, role, row_number() OVER (PARTITION BY chapter ORDER BY min(unit)) - 1 AS role_idx FROM s GROUP BY chapter, role)
SELECT chapter, unit, role_idx, role, CASE WHEN role = 'Narrator' THEN 'narration' ELSE 'dialogue' END AS type, sha256(text) AS text_sha256 FROM s JOIN f USING (chapter, role)""")
def annotated_chapters(spark, sf_dir):
    """Documents as chapters, rare letters taken for quotation marks; the stand-in for a model leaves some units out, so that their windows are halved until only these fail."""
    d = documents(spark, sf_dir).select(F.col("doc_id").alias("chapter"), F.translate("text", *QUOTED).alias("text"))

    def client(prompt: str) -> str:
        units = json.loads(prompt.split("\n\nThe last")[0])["units"]
        rows = []
        for u in units:
            quoted = any(c in u["text"] for c in '"“”')
            if len(u["text"]) % 41 != 40:
                rows.append({"unit": u["unit"], "role": f"Speaker {len(u['text']) % 3}" if quoted else "Narrator", "type": "dialogue" if quoted else "narration"})
        return json.dumps({"rows": rows})

    known = spark.range(1).select(F.lit("Narrator").alias("name"))
    told, _ = O.annotated(d, known, client, place(spark, "answers"), retries=0)
    return told.select("chapter", "unit", "role_idx", "role", "type", F.sha2("text", 256).alias("text_sha256"))


@query("limit_calls", """WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, 1 + event_id % 9 AS b, trunc(value * 1000)::BIGINT AS p FROM events),
s AS (SELECT user_id, 0::BIGINT AS rn, 4::BIGINT AS was, 4::BIGINT AS now FROM e WHERE rn = 1
UNION ALL SELECT e.user_id, e.rn, s.now, CASE WHEN p <= 0 THEN s.now WHEN p > 120000 THEN greatest(1, floor(b * 120000 / p * 0.85))::BIGINT WHEN s.now > 0 AND p < 78000 THEN CASE WHEN s.now + greatest(1, s.now // 2) >= 24 THEN 0 ELSE s.now + greatest(1, s.now // 2) END ELSE s.now END FROM s JOIN e ON e.user_id = s.user_id AND e.rn = s.rn + 1)
SELECT user_id, rn - 1 AS call, was AS limit_before, now AS limit_after FROM s WHERE rn > 0""")
def limit_calls(spark, sf_dir):
    """The controller as a keyed stream over calls that arrive in files dealt by chance, so that most wait for earlier ones."""
    from pyspark.sql import Window

    from ..streaming.controller import limit_stream
    from ..streaming.stateful import drain

    number = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long") - 1
    calls = events(spark, sf_dir).select("user_id", number.alias("call"), (1 + F.pmod("event_id", F.lit(9))).alias("blocks"), (F.col("value") * 1000).cast("long").alias("peak"))
    path = place(spark, "calls")
    calls.repartition(3 * spark.sparkContext.defaultParallelism, F.xxhash64("user_id", "call")).write.parquet(path)
    dealt = spark.read.parquet(path)
    stream = spark.readStream.schema(dealt.schema).option("maxFilesPerTrigger", -(-len(dealt.inputFiles()) // 3)).parquet(path)  # three batches
    return drain(limit_stream(stream, "user_id", "call", "blocks", "peak", 120_000, 4))


@query("cascaded_artifacts", """WITH a AS (SELECT conv_id, unnest(['text', 'units', 'registry', 'annotation', 'voices', 'tts_script', 'audio', 'timeline', 'audiobook']) AS kind FROM conversations GROUP BY conv_id)
SELECT conv_id, kind FROM a WHERE CASE conv_id % 4 WHEN 0 THEN kind NOT IN ('annotation', 'tts_script', 'audio', 'timeline', 'audiobook') WHEN 1 THEN kind NOT IN ('timeline', 'audiobook') WHEN 2 THEN kind = 'text' ELSE true END""")
def cascaded_artifacts(spark, sf_dir):
    """Every artifact of each conversation, after its units, its sound, its text or nothing changed."""
    kinds = ("text", "units", "registry", "annotation", "voices", "tts_script", "audio", "timeline", "audiobook")
    ids = conversations(spark, sf_dir).select("conv_id").distinct()
    artifacts = ids.select("conv_id", F.explode(F.array(*map(F.lit, kinds))).alias("kind"))
    k = F.col("conv_id") % 4
    changed = ids.select("conv_id", F.when(k == 0, "units").when(k == 1, "audio").when(k == 2, "text").alias("kind"))
    return B.cascaded(artifacts, changed, "conv_id", "kind")


@query("open_stages", """SELECT conv_id, unnest(CASE conv_id % 3 WHEN 0 THEN ['registry', 'units'] WHEN 1 THEN ['annotation', 'voices'] ELSE ['tts_script'] END) AS kind FROM conversations GROUP BY conv_id""")
def open_stages(spark, sf_dir):
    have = F.when(F.col("conv_id") % 3 == 0, F.array(F.lit("text"))).when(F.col("conv_id") % 3 == 1, F.array(*map(F.lit, ("text", "units", "registry")))).otherwise(F.array(*map(F.lit, ("text", "units", "registry", "annotation", "voices"))))
    return B.open_stages(conversations(spark, sf_dir).select("conv_id", F.explode(have).alias("kind")), "conv_id", "kind")


@query("cluster_aliases", "WITH k AS (SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_name)), '|') AS aliases FROM part WHERE p_partkey % 2 = 0 AND p_brand < 'Brand#2' GROUP BY p_brand) SELECT p_partkey, coalesce(aliases, '') AS aliases FROM part LEFT JOIN k USING (p_brand)")
def cluster_aliases(spark, sf_dir):
    p = part(spark, sf_dir)
    clusters = p.filter("p_partkey % 2 = 0 and p_brand < 'Brand#2'").select("p_brand", F.array("p_name").alias("aliases"))
    return L.with_aliases(p.select("p_partkey", "p_brand"), clusters, "p_brand").select("p_partkey", F.array_join("aliases", "|").alias("aliases"))


@query("unit_sounds", "SELECT conv_id, turn, 1200 * length(coalesce(text, '')) + CASE WHEN turn % 4 = 0 THEN 7 ELSE 0 END AS n_samples, round((1200 * length(coalesce(text, '')) + CASE WHEN turn % 4 = 0 THEN 7 ELSE 0 END) / 24000.0 / greatest(0.1, 0.05 * (turn % 40)), 6)::DOUBLE AS playback_seconds FROM conversations")
def unit_sounds(spark, sf_dir):
    """Sounds by unit number, or by sentence number where that is null; some units were made twice."""
    c = conversations(spark, sf_dir).select("conv_id", "turn", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    t = F.col("turn")
    times = F.when(t % 4 == 0, F.array(F.lit(0), F.lit(7))).otherwise(F.array(F.lit(0)))
    made = c.select("conv_id", F.when(t % 3 != 0, t).alias("unit_idx"), F.when(t % 3 == 0, t).otherwise(-1).alias("sentence_idx"), "n", F.posexplode(times).alias("ord", "more")).select("conv_id", "unit_idx", "sentence_idx", (1200 * F.col("n") + F.col("more")).cast("long").alias("n_samples"), F.lit(24000).alias("sample_rate"), "ord")
    out = L.generated_by_unit(c.select("conv_id", "turn"), made, "conv_id", "turn", F.lit(0.05) * (t % 40))
    return out.select("conv_id", "turn", "n_samples", F.round("playback_seconds", 6).alias("playback_seconds"))


@query("consolidation_errors", """WITH r AS (SELECT conv_id AS chapter, turn AS idx, CASE WHEN turn % 5 = 4 THEN NULL WHEN turn % 7 = 6 THEN 'stranger' ELSE role END AS role FROM conversations WHERE turn % 6 <> 5),
e AS (SELECT conv_id AS chapter, turn AS idx, 'missing quote' AS error FROM conversations WHERE turn % 6 = 5 UNION ALL SELECT chapter, idx, 'unknown role stranger of' FROM r WHERE role = 'stranger')
SELECT chapter, string_agg(error || ' ' || idx, '; ' ORDER BY idx) AS errors FROM e GROUP BY chapter""")
def consolidation_errors(spark, sf_dir):
    c = conversations(spark, sf_dir)
    t = F.col("turn")
    quotes = c.select(F.col("conv_id").alias("chapter"), t.alias("idx"))
    resolved = c.filter("turn % 6 <> 5").select(F.col("conv_id").alias("chapter"), t.alias("idx"), F.when(t % 5 == 4, None).when(t % 7 == 6, "stranger").otherwise(F.col("role")).alias("role"))
    return Q.consolidation_errors(quotes, resolved, c.select("role").distinct())
