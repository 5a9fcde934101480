"""Queries on sources and sinks: tables written as the files that a source reads, and read back through it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import library as B
from ..sources import files as S
from .base import Plan, reader
from .stored import place

PLAN = Plan()
query, QUERIES, SQL = PLAN.query, PLAN.QUERIES, PLAN.SQL
conversations, part, documents, supplier = map(reader, ("conversations", "part", "documents", "supplier"))

TIER_SQL = r"(?im)^\s*(?:chapter\s+\S+|prologue|epilogue|part\s+\S+)\s*$"


@query("selected_chapters", f"""WITH d AS (SELECT source, doc_id, 'item' || doc_id || CASE WHEN substr(source, 4)::INTEGER % 3 = 0 AND doc_id % 4 = 1 THEN '_Chapter.html' ELSE '.html' END AS member, CASE WHEN substr(source, 4)::INTEGER % 3 = 1 AND doc_id % 3 = 0 THEN 'Part one' || chr(10) || text ELSE text END AS text FROM documents),
t AS (SELECT *, CASE WHEN regexp_matches(member, '(?i)chapter|prologue|epilogue|part') THEN 1 WHEN regexp_matches(substr(text, 1, 500), '{TIER_SQL}') THEN 2 WHEN length(text) >= 300 THEN 3 END AS tier FROM d),
b AS (SELECT *, min(tier) OVER (PARTITION BY source) AS best FROM t),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth FROM b WHERE tier = best)
SELECT source, doc_id, printf('chapter_%03d', nth) AS chapter FROM n WHERE length(text) >= CASE WHEN tier < 3 THEN 1 ELSE 300 END""")
def selected_chapters(spark, sf_dir):
    """Sources as books: some have members named like chapters, some documents that begin with a heading, some neither."""
    k = F.substring("source", 4, 9).cast("int") % 3
    member = F.concat(F.lit("item"), F.col("doc_id").cast("string"), F.when((k == 0) & (F.col("doc_id") % 4 == 1), "_Chapter.html").otherwise(".html"))
    text = F.when((k == 1) & (F.col("doc_id") % 3 == 0), F.concat(F.lit("Part one\n"), "text")).otherwise(F.col("text"))
    d = documents(spark, sf_dir).select("source", "doc_id", member.alias("member"), text.alias("text"))
    return S.select_chapters(d, "source", "doc_id", "member", "text").select("source", "doc_id", "chapter")


@query("tab_entities", "SELECT p_partkey::INTEGER AS id, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_name END AS name, CASE WHEN p_partkey % 4 = 0 THEN -1 ELSE p_size END AS size FROM part")
def tab_entities(spark, sf_dir):
    """Parts as a tab-separated table, read by the second or third spelling of its columns; blank cells are null, or -1."""
    k = F.col("p_partkey")
    rows = part(spark, sf_dir).select(k.alias("COREF"), F.when(k % 3 != 0, F.col("p_name")).alias("mention"), F.lit(None).cast("string").alias("text"), F.when(k % 4 != 0, F.col("p_size")).alias("span"))
    path = place(spark, "entities")
    rows.write.csv(path, sep="\t", header=True, quote="", emptyValue="", nullValue="")
    return S.tab_entities(spark, path, {"id": ("id", "coref"), "name": ("text", "phrase", "mention"), "size": ("size", "span")}, whole=("id", "size"))


@query("stitched_chunks", "SELECT conv_id, 44 + 2 * sum(1 + length(coalesce(text, '')) % 50)::BIGINT AS n_bytes FROM conversations GROUP BY conv_id")
def stitched_chunks(spark, sf_dir):
    """A tone for each turn as a WAV file, and a conversation's files end to end."""
    n = 1 + F.coalesce(F.length("text"), F.lit(0)) % 50
    tones = conversations(spark, sf_dir).select("conv_id", "turn", F.transform(F.sequence(F.lit(1), n), lambda i: (F.sin(i / 5.0) * 2).cast("float")).alias("samples"))
    return S.stitched_wavs(S.wav_column(tones, "samples", 24000), "conv_id", "turn", "wav", 24000).select("conv_id", F.length("wav").cast("long").alias("n_bytes"))


@query("sound_round_trip", "SELECT conv_id, turn, length(coalesce(text, '')) % 40 AS n, 4 * ceil(length(coalesce(text, '')) % 40 * 4 / 3.0)::BIGINT AS n_letters, coalesce(list_sum(list_transform(range(1, length(coalesce(text, '')) % 40 + 1), lambda i: i * 0.25)), 0)::DOUBLE AS total FROM conversations")
def sound_round_trip(spark, sf_dir):
    """Samples as base64 of 32-bit floats, and back."""
    n = F.coalesce(F.length("text"), F.lit(0)) % 40
    rows = conversations(spark, sf_dir).select("conv_id", "turn", F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i * 0.25).cast("float"))).otherwise(F.array().cast("array<float>")).alias("x"))
    back = S.decoded_audio(S.encoded_audio(rows, "x"), "samples_b64")
    return back.select("conv_id", "turn", F.size("samples").cast("long").alias("n"), F.length("samples_b64").cast("long").alias("n_letters"), F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double")).alias("total"))


@query("catalogue_rows", "SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'Untitled Book' ELSE s_name END AS title, CASE s_suppkey % 4 WHEN 0 THEN 's' || s_suppkey WHEN 3 THEN 'book' ELSE 'folder' || s_suppkey END AS slug FROM supplier")
def catalogue_rows(spark, sf_dir):
    """A library's catalogue with titles and slugs that are absent, blank, or to be taken from folders of either kind of path."""
    k = F.col("s_suppkey")
    folder = F.concat(F.lit("folder"), k.cast("string"))
    root = F.when(k % 4 == 1, F.concat(F.lit("C:\\lib\\"), folder)).when(k % 4 == 2, F.concat(F.lit("/lib/"), folder, F.lit("/"))).otherwise("")
    book = F.struct(F.when(k % 3 != 0, F.col("s_name")).otherwise(" ").alias("title"), F.when(k % 4 == 0, F.concat(F.lit("s"), k.cast("string"))).alias("slug"), root.alias("book_root"))
    path = place(spark, "catalogue")
    supplier(spark, sf_dir).groupBy((k % 7).alias("shelf")).agg(F.collect_list(book).alias("books")).select("books").write.option("maxRecordsPerFile", 1).json(path)
    return B.catalogue(spark, path).select("title", "slug")


@query("unit_file", "SELECT conv_id * 1000 + turn AS unit_id, text FROM conversations WHERE trim(coalesce(text, '')) <> '' AND conv_id * 1000 + turn >= 1002")
def unit_file(spark, sf_dir):
    """Turns as unit files, one for each conversation, from a number on."""
    c = conversations(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("unit_id"), "conv_id", "text")
    path = place(spark, "units")
    c.groupBy("conv_id").agg(F.collect_list(F.struct("unit_id", "text")).alias("units")).select("units").write.option("maxRecordsPerFile", 1).json(path)
    return S.unit_texts(spark, path, 1002)
