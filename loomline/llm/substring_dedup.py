"""Removal of word passages that repeat anywhere in the corpus.

Every run of ``window`` consecutive words of a document gets a 64-bit Rabin-Karp hash. Windows are counted over the whole
corpus (see keycount); those whose hash repeats are counted again by a second hash of other word hashes and another base, as
64 bits alone would repeat by chance among 10 ** 13 windows. Every word that some repeated window covers goes, so overlapping repeated windows merge into
maximal intervals. Windows are judged on the input, not on what is left of it.

Words are separated by ASCII white space and otherwise unchanged. A null text has no words. Documents with fewer words than
a window keep all of them; texts and words of any length are read whole. Equal rows count separately, so they remove each other's windows. Columns other than the two
named ones are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Words, mix, raw, rolled, rolling, table
from .keycount import with_totals

WINDOW = 35
#: What makes the second hash of a window.
OTHER, OTHER_BASE = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def covered(words: int, at: np.ndarray, window: int) -> np.ndarray:
    """Which of so many words the windows that begin at these places cover."""
    step = np.zeros(words + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + window, -1)
    return np.cumsum(step[:-1]) > 0


def substring_dedup(df: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (kept words, one space between), removed (word intervals, end exclusive)."""
    ids = df.schema[id_col].dataType.simpleString()

    def keys(group: pa.Table):
        w = Words(raw(group["text"]))
        at, key = w.grams(window)
        return key, (w, at, key)

    def again(state, totals: np.ndarray) -> np.ndarray:
        """A second hash, made of other hashes of the words, of the windows whose first one repeats."""
        w, at, key = state
        some = at[totals > 1]
        prefix = rolling(mix(w.hash ^ OTHER), OTHER_BASE)
        return mix(key[totals > 1] ^ mix(rolled(prefix, some, some + window, OTHER_BASE)))

    def finish(group: pa.Table, state, totals: np.ndarray, second: np.ndarray) -> pa.Table:
        w, at, _ = state
        gone = covered(len(w.start), at[totals > 1][second > 1], window)
        out = []
        for s, e in zip(w.first[:-1], w.first[1:]):
            edges = np.flatnonzero(np.diff(np.concatenate([[False], gone[s:e], [False]]).view(np.int8))).tolist()
            out.append((int(e - s), int(gone[s:e].sum()), b" ".join([w.word(i) for i in (s + np.flatnonzero(~gone[s:e])).tolist()]).decode(), [{"first": a, "end": b} for a, b in zip(edges[::2], edges[1::2])]))
        span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
        cols = zip(*out) if out else ([], [], [], [])
        return pa.table([group["doc_id"], *(pa.array(list(c), k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string(), span)))], names=["doc_id", "n_words", "n_removed", "kept", "removed"])

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return with_totals(rows, ["doc_id", "text"], keys, finish, f"doc_id {ids}, n_words long, n_removed long, kept string, removed array<struct<first:long,end:long>>", again)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns doc_id, n_words, n_removed, kept_sha256."""
    return substring_dedup(table(spark, "documents")(sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH w AS (SELECT rowid AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
           FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)),
g AS (SELECT r, i, md5(array_to_string(list_slice(ws, i, i + 34), ' ')) AS k
      FROM (SELECT r, ws, unnest(generate_series(1, len(ws) - 34)) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS n FROM g) WHERE n > 1),
gone AS (SELECT DISTINCT r, unnest(generate_series(i, i + 34)) AS p FROM rep),
p AS (SELECT r, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS p FROM w),
kept AS (SELECT p.r, string_agg(word, ' ' ORDER BY p.p) AS t, count(*) AS n FROM p LEFT JOIN gone g ON g.r = p.r AND g.p = p.p WHERE g.p IS NULL GROUP BY p.r)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (r)
"""
