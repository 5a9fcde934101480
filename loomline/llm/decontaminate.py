"""Benchmark decontamination with suffix arrays over shards of the training documents.

Each Arrow batch of documents is a shard. Its words become numbers: the rank in the benchmark's vocabulary, or 0. Only
stretches of vocabulary words at least as long as the shortest window can hold a match, so the shard's suffix array is built
over those, by prefix doubling. Every suffix of every benchmark item is then binary-searched in it; the interval of a
window's suffixes gives all its occurrences, and windows that continue each other on one diagonal join into longest verbatim
matches. A document lies in one shard, so no shuffle is needed.

The benchmark is dealt into blocks of bounded size. Each block is broadcast by itself, and the documents pass through the
blocks one after the other in one scan; each block then has a Python worker of its own, so memory grows with the benchmark,
by about three times its text for each task, but not with the documents.

Words: A-Z lower-cased, then runs of ASCII letters, digits and everything beyond ASCII. A window is ``window`` consecutive
words of an item; an item of fewer words is one window, an item of none has none. A null text has no words; items with a
null id take no part; items of the same id count as one. Texts of any length are read whole, many to a shard. Equal rows each get their
own result, and ties don't occur: an item's id is listed once.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import ALNUM, WORD_BASE, Words, lean, mix, raw, rolled, rolling, table

WINDOW = 10
#: Bytes of benchmark text in one broadcast block.
BLOCK_BYTES = 16 << 20
MATCH = "array<struct<item_id:string,item_first:long,first:long,length:long>>"


class Index:
    """A block of the benchmark: vocabulary, items as numbers, and the windows of each item."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        items = sorted(items)
        w = Words([t.encode() for _, t in items], ALNUM, lower=True)
        self.ids = [i for i, _ in items]
        self.vocabulary = np.unique(w.hash)
        codes = (np.searchsorted(self.vocabulary, w.hash) + 1).astype(">u4")
        self.items = [codes[s:e] for s, e in zip(w.first[:-1], w.first[1:])]
        #: By width of window: the sorted hashes of all windows of that width, and each one's item and place.
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        by_width: dict[int, list] = {}
        for no, item in enumerate(self.items):
            if width := min(window, len(item)):
                key = windows(item.astype(np.uint64), width)
                by_width.setdefault(width, []).append((key, np.full(len(key), no), np.arange(len(key))))
        for width, parts in by_width.items():
            key, no, at = (np.concatenate(c) for c in zip(*parts))
            order = np.argsort(key, kind="stable")
            self.windows[width] = key[order], no[order], at[order]
        sizes = [len(x) for x in self.items if len(x)]
        self.shortest = min([window, *sizes])
        self.longest = max(sizes, default=0)
        self.window = window
        self.empty = not sizes


def windows(codes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of width codes."""
    if len(codes) < width:
        return np.empty(0, np.uint64)
    at = np.arange(len(codes) - width + 1)
    return mix(rolled(rolling(mix(codes), WORD_BASE), at, at + width, WORD_BASE))


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions of codes in the order of their suffixes, compared over depth codes at least."""
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    k, n = 1, len(codes)
    while k < depth and n and rank.max() < n - 1:
        after = np.zeros(n, np.int64)
        after[:-k or n] = rank[k:] + 1
        rank = np.unique(rank * (n + 2) + after, return_inverse=True)[1]
        k *= 2
    return np.argsort(rank, kind="stable")


def matches(index: Index, texts: list[bytes]) -> tuple[np.ndarray, list[list[dict]]]:
    """The number of words of each text, and its longest verbatim matches of a window or more."""
    w = Words(texts, ALNUM, lower=True)
    sizes, found = np.diff(w.first), [[] for _ in texts]
    if index.empty or not len(w.start):
        return sizes, found
    at = np.searchsorted(index.vocabulary, w.hash)
    at[at == len(index.vocabulary)] = 0
    code = np.where(index.vocabulary[at] == w.hash, at + 1, 0)
    doc = np.repeat(np.arange(len(texts)), sizes)
    live = np.concatenate([[False], code > 0, [False]])
    cut = np.concatenate([[True], doc[1:] != doc[:-1], [True]])
    starts = np.flatnonzero(live[1:-1] & (cut[:-1] | ~live[:-2]))
    ends = np.flatnonzero(live[1:-1] & (cut[1:] | ~live[2:])) + 1
    long = ends - starts >= index.shortest
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return sizes, found
    size = ends - starts + 1  # a zero after each stretch
    where = np.repeat(starts - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    last = np.cumsum(size) - 1
    where[last] = ends - 1
    text = code[where]
    text[last] = 0
    array = suffix_array(text, index.longest)
    array = array[text[array] > 0].tolist()
    whole = text.astype(">u4").tobytes()
    item_no, item_at, place = [], [], []
    for width, (known, no_of, at_of) in index.windows.items():
        # only windows whose hash the shard holds are searched, so a shard costs its own size and not the benchmark's
        own = np.unique(windows(text.astype(np.uint64), width))
        lo = np.searchsorted(known, own)
        count = np.searchsorted(known, own, "right") - lo
        some = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        key = lambda i: whole[4 * i : 4 * (i + width)]  # noqa: B023, E731
        for no, first in zip(no_of[some].tolist(), at_of[some].tolist()):
            p = index.items[no][first : first + width].tobytes()
            lo = bisect.bisect_left(array, p, key=key)
            if lo == len(array) or key(array[lo]) != p:
                continue
            hi = bisect.bisect_right(array, p, lo=lo, key=key)
            place.append(np.array(array[lo:hi]))
            item_no.append(np.full(hi - lo, no))
            item_at.append(np.full(hi - lo, first))
    if not place:
        return sizes, found
    no, first, place = np.concatenate(item_no), np.concatenate(item_at), where[np.concatenate(place)]
    order = np.lexsort((first, place - first, no))
    no, first, place = no[order], first[order], place[order]
    new = np.concatenate([[True], (no[1:] != no[:-1]) | (place[1:] - first[1:] != place[:-1] - first[:-1]) | (first[1:] != first[:-1] + 1)])
    begin = np.flatnonzero(new)
    run = np.diff(np.append(begin, len(new)))
    for n, f, p, k in zip(no[begin].tolist(), first[begin].tolist(), place[begin].tolist(), run.tolist()):
        d = int(doc[p])
        found[d].append({"item_id": index.ids[n], "item_first": f, "first": int(p - w.first[d]), "length": k - 1 + min(index.window, len(index.items[n]))})
    return sizes, found


def hit_words(matches: list[dict]) -> int:
    """How many words the matches cover."""
    total, reach = 0, 0
    for s, e in sorted((m["first"], m["first"] + m["length"]) for m in matches):
        total += max(0, e - max(s, reach))
        reach = max(reach, e)
    return total


def find_matches(df: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", keep: list[str] | None = None, item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The kept columns of df (all by default) and n_words, n_hit, matches (see MATCH; word positions from 0).

    Columns of df with those three names are replaced.
    """
    spark = df.sparkSession
    items = benchmark.filter(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull()).select(F.col(item_col).cast("string").alias("id"), F.col(item_text_col).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + total // block_bytes
    keep = [c for c in (keep if keep is not None else df.columns) if c not in ("n_words", "n_hit", "matches", "__text")]
    out = df.select(*keep, F.col(text_col).alias("__text"), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast(MATCH).alias("matches"))
    for k in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k)
        index = spark.sparkContext.broadcast(Index([(r["id"], r["text"]) for r in own.collect()], window))

        def run(batches, index=index):
            for b in batches:
                for lo in range(0, b.num_rows, 1000):
                    part = b.slice(lo, 1000)
                    names = part.schema.names
                    sizes, found = matches(index.value, raw(part.column(names.index("__text"))))
                    every = [old + new for old, new in zip(part.column(names.index("matches")).to_pylist(), found)]
                    new = {"n_words": pa.array(sizes, pa.int64()), "n_hit": pa.array([hit_words(m) for m in every], pa.int64()), "matches": pa.array(every, part.schema.field("matches").type)}
                    yield pa.record_batch([new.get(n, part.column(i)) for i, n in enumerate(names)], names=names)

        out = out.mapInArrow(lean(run), out.schema)
    return out.drop("__text")


def remove_contaminated(df: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """The rows of df without any word inside a benchmark window; all columns."""
    found = find_matches(df.select(F.struct(*df.columns).alias("row"), F.col(text_col).alias("__t")), benchmark, window, "__t", ["row"])
    return found.filter("n_hit = 0").select("row.*")


def items_of(matches: str) -> Column:
    """The distinct item ids of a matches column, sorted as strings."""
    return F.array_sort(F.array_distinct(F.col(f"{matches}.item_id")))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_matches(table(spark, "documents")(sf_dir), table(spark, "benchmark")(sf_dir), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size(items_of("matches")).cast("long").alias("n_items"), F.sha2(F.array_join(items_of("matches"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS ws FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT item_id, least(10, len(ws)) AS n, array_to_string(list_slice(ws, i, i + least(10, len(ws)) - 1), ' ') AS k
        FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 9))) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
g AS (SELECT r, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS k
      FROM (SELECT r, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM d, sizes)),
m AS (SELECT r, g.n, i, item_id FROM g JOIN win ON g.n = win.n AND g.k = win.k),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM m) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT r, item_id FROM m) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""
