"""Queries on role-tagged, ordered turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import speech, squeeze, word_count
from ..operators import sequence as S
from .base import Plan
from .base import squeezed as SQ

RATE, PER_CHAR, PAUSE, INNER = 24000, 1200, 250, 60
PLAN = Plan()
query, QUERIES, SQL = PLAN.query, PLAN.QUERIES, PLAN.SQL


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")


def blocks(spark: SparkSession, sf_dir: str) -> int | None:
    """How to window over turns: at two levels if any conversation is longer than a block."""
    return S.depth(turns(spark, sf_dir), "turn")


RUNS_SQL = f"""n AS (SELECT conv_id, turn, role, {SQ("replace(text, '#', ' hashtag ')")} AS t, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
i AS (SELECT *, sum(CASE WHEN rn = 1 OR role IS NOT DISTINCT FROM prev THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM n)"""


@query("dialogue_script", f"""WITH {RUNS_SQL},
l AS (SELECT conv_id, island, role || ': ' || coalesce(string_agg(nullif(t, ''), ' ' ORDER BY turn), '') AS line FROM i GROUP BY conv_id, island, role)
SELECT conv_id, count(*) AS n_runs, string_agg(line, chr(10) ORDER BY island) AS script FROM l GROUP BY conv_id""")
def dialogue_script(spark, sf_dir):
    return S.dialogue(turns(spark, sf_dir), "conv_id", "turn", "role", "text", blocks(spark, sf_dir))


@query("role_switches", f"WITH {RUNS_SQL} SELECT conv_id, max(island)::BIGINT AS switches, count(DISTINCT role) AS n_roles FROM i GROUP BY conv_id")
def role_switches(spark, sf_dir):
    rows = S.islands(turns(spark, sf_dir), "conv_id", "turn", "role", block=blocks(spark, sf_dir))
    return rows.groupBy("conv_id").agg(F.max("island").alias("switches"), F.count_distinct("role").alias("n_roles"))


TIMELINE_SQL = f"""s AS (SELECT conv_id, turn, role, {PER_CHAR} * length(coalesce(text, '')) AS n, lead(turn) OVER w AS nxt, lead(role) OVER w AS nrole FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT *, n + CASE WHEN nxt IS NULL THEN 0 WHEN nrole = role THEN {RATE * INNER // 1000} ELSE {RATE * PAUSE // 1000} END AS step FROM s),
c AS (SELECT *, coalesce(sum(step) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM p),
tl AS (SELECT conv_id, turn, round_even(st * 1000 / {RATE}, 0)::BIGINT AS start_ms, round_even((st + n) * 1000 / {RATE}, 0)::BIGINT AS end_ms FROM c)"""


def laid_out(spark, sf_dir):
    rows = turns(spark, sf_dir).withColumn("n", PER_CHAR * F.length(F.coalesce("text", F.lit(""))).cast("long"))
    return S.timeline(rows, "conv_id", "turn", "n", RATE, PAUSE, INNER, "role", blocks(spark, sf_dir))


@query("timeline", f"WITH {TIMELINE_SQL} SELECT conv_id, turn, start_ms, end_ms FROM tl")
def timeline(spark, sf_dir):
    return laid_out(spark, sf_dir).select("conv_id", "turn", "start_ms", "end_ms")


@query("chapter_duration", f"WITH {TIMELINE_SQL} SELECT conv_id, round_even(max(end_ms) / 1000, 3) AS seconds FROM tl GROUP BY conv_id")
def chapter_duration(spark, sf_dir):
    return laid_out(spark, sf_dir).groupBy("conv_id").agg(F.bround(F.max("end_ms") / 1000, 3).alias("seconds"))


@query("conversation_timeline_summary", f"""WITH {TIMELINE_SQL}, {RUNS_SQL}, r AS (SELECT conv_id, max(island) + 1 AS n_runs, count(DISTINCT role) AS n_roles FROM i GROUP BY conv_id)
SELECT conv_id, count(*) AS n_turns, max(end_ms) AS end_ms, any_value(n_runs)::BIGINT AS n_runs, any_value(n_roles) AS n_roles FROM tl JOIN r USING (conv_id) GROUP BY conv_id""")
def conversation_timeline_summary(spark, sf_dir):
    rows = S.islands(laid_out(spark, sf_dir), "conv_id", "turn", "role", block=blocks(spark, sf_dir))
    return rows.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.max("end_ms").alias("end_ms"), (F.max("island") + 1).alias("n_runs"), F.count_distinct("role").alias("n_roles"))


MOST, ROLES = 1500, 2


def speech_sql(most: int, roles: int) -> str:
    """Greedy windows of rendered dialogue by a recursion over the turns of each conversation."""
    return f"""WITH RECURSIVE n AS (SELECT conv_id, turn, role, length({SQ("coalesce(text, '')")}) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
f AS (SELECT conv_id, rn, turn, 0::BIGINT AS win, [role] AS roles, role AS last, 0::BIGINT AS closed, CASE WHEN n = 0 THEN 0 ELSE length(role) + 2 + n END::BIGINT AS line FROM n WHERE rn = 1
UNION ALL SELECT conv_id, rn, turn, CASE WHEN brk THEN win + 1 ELSE win END, CASE WHEN brk THEN [role] ELSE list_distinct(list_append(roles, role)) END, role,
  CASE WHEN brk THEN 0 ELSE c END, CASE WHEN brk THEN CASE WHEN n = 0 THEN 0 ELSE length(role) + 2 + n END ELSE o END
FROM (SELECT *, (CASE WHEN o > 0 THEN c + o ELSE greatest(0, c - 1) END) > {most} OR len(list_distinct(list_append(roles, role))) > {roles} AS brk
  FROM (SELECT n.conv_id, n.rn, n.turn, n.role, n.n, f.win, f.roles,
    CASE WHEN f.line > 0 AND n.role <> f.last THEN f.closed + f.line + 1 ELSE f.closed END AS c,
    CASE WHEN f.line > 0 AND n.role <> f.last THEN CASE WHEN n.n = 0 THEN 0 ELSE length(n.role) + 2 + n.n END
         WHEN n.n = 0 THEN f.line WHEN f.line > 0 THEN f.line + 1 + n.n ELSE length(n.role) + 2 + n.n END AS o
    FROM f JOIN n ON n.conv_id = f.conv_id AND n.rn = f.rn + 1)))
SELECT conv_id, turn, win AS window_id FROM f"""


@query("speech_windows", speech_sql(MOST, ROLES))
def speech_windows(spark, sf_dir):
    return S.speech_windows(turns(spark, sf_dir), "conv_id", ["turn"], "role", "text", MOST, ROLES, alone=True).select("conv_id", "turn", "window_id")


BLOCKS_SQL = f"""WITH {RUNS_SQL}, w AS (SELECT conv_id, turn, role, island, greatest(1, length({SQ("coalesce(text, '')")})) AS weight FROM i JOIN (SELECT conv_id AS c, turn AS u, text FROM conversations) ON c = conv_id AND u = turn)"""


def weighted(spark, sf_dir):
    rows = S.islands(turns(spark, sf_dir), "conv_id", "turn", "role", block=blocks(spark, sf_dir))
    return rows.withColumn("weight", F.greatest(F.lit(1), F.length(squeeze(F.coalesce("text", F.lit(""))))))


@query("generation_blocks", BLOCKS_SQL + " SELECT conv_id, island::BIGINT AS block, any_value(role) AS role, count(*) AS n_jobs, (sum(weight) + count(*) - 1)::BIGINT AS n_chars, floor(island / 4)::BIGINT AS batch FROM w GROUP BY conv_id, island")
def generation_blocks(spark, sf_dir):
    blocks = weighted(spark, sf_dir).groupBy("conv_id", F.col("island").alias("block")).agg(F.first("role").alias("role"), F.count("*").alias("n_jobs"), (F.sum("weight") + F.count("*") - 1).cast("long").alias("n_chars"))
    return blocks.withColumn("batch", F.floor(F.col("block") / 4))


@query("apportion_audio", BLOCKS_SQL + """, c AS (SELECT *, sum(weight) OVER (PARTITION BY conv_id, island ORDER BY turn) AS cum, sum(weight) OVER (PARTITION BY conv_id, island) AS tot, lead(turn) OVER (PARTITION BY conv_id, island ORDER BY turn) AS nxt FROM w),
e AS (SELECT *, tot * 977 AS n FROM c),
b AS (SELECT *, CASE WHEN nxt IS NULL THEN n ELSE round_even(n * cum / tot, 0) END::BIGINT AS last FROM e)
SELECT conv_id, turn, coalesce(lag(last) OVER (PARTITION BY conv_id, island ORDER BY turn), 0)::BIGINT AS first, last FROM b""")
def apportion_audio(spark, sf_dir):
    return S.apportion(weighted(spark, sf_dir), ["conv_id", "island"], "turn", "weight", lambda n: n * 977, blocks(spark, sf_dir)).select("conv_id", "turn", "first", "last")


@query("prefix_take", "SELECT conv_id, turn, cum::BIGINT AS chars FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS cum, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) WHERE cum <= 600 OR rn = 1")
def prefix_take(spark, sf_dir):
    rows = turns(spark, sf_dir).select("conv_id", "turn", F.length("text").alias("n"))
    return S.prefix_take(rows, "conv_id", "turn", "n", 600, blocks(spark, sf_dir)).drop("n")


@query("target_sweep", """WITH c AS (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS cum, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, sum(length(text)) OVER (PARTITION BY conv_id) AS tot FROM conversations),
t AS (SELECT DISTINCT conv_id, unnest(generate_series(100, 100 + (ceil(tot / 100) * 100)::BIGINT, 100)) AS target FROM c),
p AS (SELECT t.conv_id, target, count(*) AS n_rows, max(cum)::BIGINT AS n_chars FROM t JOIN c ON c.conv_id = t.conv_id AND (cum <= target OR rn = 1) GROUP BY t.conv_id, target),
m AS (SELECT conv_id, min(target) AS target, n_rows, n_chars FROM p GROUP BY conv_id, n_rows, n_chars)
SELECT conv_id, target, n_rows, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY target) AS k FROM m) WHERE k <= 8""")
def target_sweep(spark, sf_dir):
    rows = turns(spark, sf_dir).select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    return S.target_sweep(rows, "conv_id", "turn", "n", 100, 100, 8, blocks(spark, sf_dir))


@query("buffer_simulation", """WITH RECURSIVE n AS (SELECT conv_id, turn, length(text) * 1.0::DOUBLE / 16 AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
f AS (SELECT conv_id, turn, rn, 0::BIGINT AS call, s AS ready, 2::BIGINT AS lft FROM n WHERE rn = 1
UNION ALL SELECT n.conv_id, n.turn, n.rn, CASE WHEN f.call IS NULL OR f.lft = 1 AND f.ready >= 60 THEN NULL WHEN f.lft = 1 THEN f.call + 1 ELSE f.call END, f.ready + n.s,
  CASE WHEN f.lft > 1 THEN f.lft - 1 ELSE greatest(1, least(2, ceil(greatest(0.1, 60 - f.ready) / (f.ready / f.rn))))::BIGINT END
FROM f JOIN n ON n.conv_id = f.conv_id AND n.rn = f.rn + 1)
SELECT conv_id, turn, coalesce(call, -1) AS call FROM f""")
def buffer_simulation(spark, sf_dir):
    rows = turns(spark, sf_dir).select("conv_id", "turn", (F.length("text") / 16.0).cast("double").alias("s"))
    return S.buffer(rows, "conv_id", "turn", "s", 60.0, 90.0, 2).select("conv_id", "turn", F.coalesce("call", F.lit(-1).cast("long")).alias("call"))


@query("dictionary_encode", "WITH f AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY min(turn)) - 1 AS code FROM conversations GROUP BY conv_id, role) SELECT conv_id, turn, role, code FROM conversations JOIN f USING (conv_id, role)")
def dictionary_encode(spark, sf_dir):
    return S.first_appearance(turns(spark, sf_dir), "conv_id", "turn", "role").select("conv_id", "turn", "role", "code")


@query("window_attributes", f"SELECT conv_id, count(DISTINCT role) AS n_roles, sum(length({SQ('text')}))::BIGINT AS n_chars, sum(len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')))::BIGINT AS n_words, string_agg(turn::VARCHAR, ',' ORDER BY turn) AS turns FROM conversations GROUP BY conv_id")
def window_attributes(spark, sf_dir):
    rows = turns(spark, sf_dir)
    return rows.groupBy("conv_id").agg(F.count_distinct("role").alias("n_roles"), F.sum(F.length(squeeze(F.col("text")))).cast("long").alias("n_chars"), F.sum(word_count(F.col("text"))).cast("long").alias("n_words"), S.ordered_text("turn", F.col("turn").cast("string"), ",").alias("turns"))


@query("speech_normalize", f"SELECT conv_id, turn, {SQ("replace(text, '#', ' hashtag ')")} AS spoken FROM conversations")
def speech_normalize(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", speech(F.col("text")).alias("spoken"))
