"""Stupid-backoff language-model scores of documents under the counts of the whole corpus.

Words are separated by ASCII white space, with A-Z lower-cased. The corpus's 1- to ``order``-grams are counted in tables
that are dealt out by hash and joined back to each document's own n-grams (see keycount); a document's score is the sum
over its words. A word's score is count(gram) / count(context) for the longest gram that ends in it and occurs at least
``min_count`` times in the corpus, times ``alpha`` for each order given up; a single word's score is its share of all
words. Grams stay within one document. Longer grams are counted only where all their word pairs occur ``min_count`` times,
as no other can.

A null or empty text has no words: its log_score is 0 and its mean_log_score null. Every row counts, repeated ones too.
Columns other than the two named ones are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Words, raw, table
from .keycount import with_totals

ORDER, ALPHA, MIN_COUNT = 3, 0.4, 2
#: The key whose total is the number of words of the corpus.
ALL = np.uint64(0x5851F42D4C957F2D)


def lm_scores(df: DataFrame, order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, log_score (natural logarithm), mean_log_score."""
    ids = df.schema[id_col].dataType.simpleString()

    def keys(group: pa.Table):
        w = Words(raw(group["text"]), lower=True)
        grams = [w.grams(n) for n in range(1, order + 1)]
        low = [k for _, k in grams[:2]]
        return np.concatenate([np.full(len(w.start), ALL), *low]), (w, grams)

    def often(state, totals: np.ndarray) -> list[np.ndarray]:
        """For 3 words and more: which grams may occur min_count times, as all their word pairs do."""
        w, grams = state
        pair = np.zeros(len(w.start) + 1, bool)
        if order > 1:
            pair[grams[1][0]] = totals[2 * len(w.start) :] >= min_count
        out = []
        for n in range(3, order + 1):
            ok = np.ones(len(grams[n - 1][0]), bool)
            for i in range(n - 1):
                ok &= pair[grams[n - 1][0] + i]
            out.append(ok)
        return out

    def more(state, totals: np.ndarray) -> np.ndarray:
        return np.concatenate([np.empty(0, np.uint64), *(k[ok] for (_, k), ok in zip(state[1][2:], often(state, totals)))])

    def finish(group: pa.Table, state, totals: np.ndarray, long: np.ndarray) -> pa.Table:
        w, grams = state
        n = len(w.start)
        score = np.zeros(n)
        if n:
            counts = [totals[n : 2 * n], *([totals[2 * n :]] if order > 1 else [])]
            lo = 0
            for ok in often(state, totals):
                count = np.ones(len(ok), np.uint64)
                count[ok] = long[lo : lo + ok.sum()]
                lo += int(ok.sum())
                counts.append(count)
            score = np.log(counts[0] / float(totals[0]))
            below = counts[0].astype(float)  # by first word, of grams with one word less
            for m in range(2, order + 1):
                at, count = grams[m - 1][0], counts[m - 1].astype(float)
                seen, end = count >= min_count, at + m - 1
                score[end] = np.where(seen, np.log(count / below[at]), score[end] + np.log(alpha))
                below = np.ones(n)
                below[at] = count
        size = np.diff(w.first)
        log_score = np.array([score[s:e].sum() for s, e in zip(w.first[:-1], w.first[1:])])
        mean = [float(x) / int(k) if k else None for x, k in zip(log_score, size)]
        return pa.table([group["doc_id"], pa.array(size, pa.int64()), pa.array(log_score, pa.float64()), pa.array(mean, pa.float64())], names=["doc_id", "n_words", "log_score", "mean_log_score"])

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return with_totals(rows, ["doc_id", "text"], keys, finish, f"doc_id {ids}, n_words long, log_score double, mean_log_score double", more)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns doc_id, n_words, log_score and mean_log_score, rounded to 4 places."""
    got = lm_scores(table(spark, "documents")(sf_dir))
    return got.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 4).alias("mean_log_score"))


SQL = """
WITH w AS (SELECT r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
           FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)),
p AS (SELECT r, unnest(ws) AS c, unnest(generate_series(1, len(ws))) AS i FROM w),
t AS (SELECT r, i, c, lag(c, 1) OVER (PARTITION BY r ORDER BY i) AS b, lag(c, 2) OVER (PARTITION BY r ORDER BY i) AS a FROM p),
k AS (SELECT r, i, a, b, c, count(*) OVER () AS n, count(*) OVER (PARTITION BY c) AS c1, count(*) OVER (PARTITION BY b, c) AS c2, count(*) OVER (PARTITION BY a, b, c) AS c3 FROM t),
u AS (SELECT c AS x, count(*) AS n1 FROM p GROUP BY 1),
v AS (SELECT b AS x, c AS y, count(*) AS n2 FROM t WHERE b IS NOT NULL GROUP BY 1, 2),
s AS (SELECT k.r, CASE WHEN a IS NOT NULL AND c3 >= 2 THEN ln(c3 / n2)
                       WHEN b IS NOT NULL AND c2 >= 2 THEN ln(c2 / n1) + CASE WHEN a IS NULL THEN 0 ELSE ln(0.4) END
                       ELSE ln(c1 / n) + CASE WHEN b IS NULL THEN 0 ELSE ln(0.4) END + CASE WHEN a IS NULL THEN 0 ELSE ln(0.4) END END AS score
      FROM k LEFT JOIN u ON u.x = k.b LEFT JOIN v ON v.x = k.a AND v.y = k.b),
d AS (SELECT r, sum(score) AS score FROM s GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, round(coalesce(score, 0), 4) AS log_score, round(score / len(ws), 4) AS mean_log_score FROM w LEFT JOIN d USING (r)
"""
