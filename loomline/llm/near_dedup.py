"""Near-duplicate documents: an exact similarity join of their sets of word shingles.

A document is the set of its runs of ``shingle`` words (A-Z lower-cased, separated by ASCII white space); a shorter text is one
run. Documents are linked if the Jaccard similarity of their sets is ``threshold`` or more, and linked documents form groups,
by chains if need be. No pair at the threshold is missed, and none below it is linked; shingles and sets are compared by 64-bit hashes.

1. Shingles are counted over all documents (see keycount). Of sets that are equal within a chunk, one is counted and sent.
2. A set sends a posting for each shingle of its prefix, the |x| - ceil(t |x|) + 1 rarest, but for shingles that occur once;
   similar sets share one of them. Sets with postings are sent along, for step 4.
3. Postings of a shingle are paired under the length filter and the positional filter. Where more than ``small`` sets share a
   shingle, only neighbours by size are paired at first.
4. Pairs are compared exactly.
5. The shingles put aside in 3 are paired in full, but for sets that links connect already. So a large group of near
   copies costs its size, not the square, and no link between groups is lost.

Null and empty texts are equal sets. Columns other than the two named ones are not read, and keep_first keeps them, whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import GRAPHIC, Words, lean, materialise, mix, partitions, raw, release
from .keycount import chunk_count, chunk_totals
from .line_dedup import _sets, prefix, rarity, similar
from .simhash import components, keep_rows, row_hash

SHINGLE, THRESHOLD = 5, 0.8
#: Sets that share a shingle and are all paired at once.
SMALL = 32


class Shingles:
    """Sorted hashes of the shingles of text i, without repeats: keys[first[i] : first[i + 1]]; ids: a hash of each set."""

    def __init__(self, texts: list[bytes], size: int):
        w = Words(texts, GRAPHIC, lower=True)
        n = np.diff(w.first)
        of = np.repeat(np.arange(len(texts)), n)
        keys, text = [], []
        for k in range(1, size + 1):
            if k < size and not (n == k).any():
                continue
            at, key = w.grams(k)
            ok = slice(None) if k == size else n[of[at]] == k
            keys.append(key[ok])
            text.append(of[at[ok]])
        self.keys, self.first = _sets(np.concatenate(keys), np.concatenate(text), len(texts))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.keys), dtype=np.uint64)])
        self.ids = (sums[self.first[1:]] - sums[self.first[:-1]]).view(np.int64)


def _fits(size: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of postings of a shingle may be similar, by sizes and by the shingle's places; size[i] <= size[j]."""
    need = np.ceil(threshold / (1 + threshold) * (size[i] + size[j]) - 1e-9)
    most = np.minimum(size[i] - at[i], size[j] - at[j]) + np.minimum(at[i], at[j])
    return (size[i] >= threshold * size[j] - 1e-9) & (most >= need)


def _pairs(sig: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of sets, the smaller hash first."""
    both = np.unique(np.stack([np.minimum(sig[i], sig[j]), np.maximum(sig[i], sig[j])], axis=1), axis=0)
    return both[:, 0], both[:, 1]


def _runs(batches, names: list[str]):
    """Columns of sorted batches, cut where the first one changes."""
    held: list[list[np.ndarray]] = []  # pieces of one key's run, put together once

    def joined(last: list[np.ndarray]):
        return dict(zip(names, (np.concatenate(c) for c in zip(*held, last))))

    for b in batches:
        new = [b.column(k).to_numpy() for k in range(len(names))]
        if not len(new[0]):
            continue
        cut = int(np.searchsorted(new[0], new[0][-1]))
        if cut or held and held[0][0][0] != new[0][0]:
            yield joined([x[:cut] for x in new])
            held = [[x[cut:] for x in new]]
        else:
            held.append(new)
    if held:
        yield joined([x[:0] for x in held[0]])


def _across(root: np.ndarray, size: np.ndarray, at: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one shingle's postings, sorted by size, of different roots: those outside the largest root against all."""
    kinds, of, count = np.unique(root, return_inverse=True, return_counts=True)
    if len(kinds) == 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    outside = np.flatnonzero(of != count.argmax())
    found = []
    block = max(1, (1 << 21) // len(root))
    for lo in range(0, len(outside), block):
        x, y = np.nonzero(of[outside[lo : lo + block], None] != of[None, :])
        x = outside[lo : lo + block][x]
        i, j = np.minimum(x, y), np.maximum(x, y)
        ok = _fits(size, at, i, j, threshold)
        found.append((i[ok], j[ok]))
    return tuple(np.concatenate(c) for c in zip(*found))


def groups(df: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL) -> tuple[DataFrame, DataFrame]:
    """doc_id, row (see simhash.row_hash) and fp, a hash of its set, of every row; and fp and root of the sets that have links."""
    spark = df.sparkSession
    n_parts, chunks = partitions(spark), chunk_count(spark)
    ids = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.pmod(F.xxhash64(id_col, text_col), F.lit(chunks)).cast("int").alias("chunk"), F.col(id_col).alias("doc_id"), row_hash(text_col).alias("row"), F.col(text_col).alias("text"))

    def keys(group: pa.Table):
        s = Shingles(raw(group["text"]), shingle)
        first = np.unique(s.ids, return_index=True)[1]
        new = np.zeros(len(s.ids), bool)
        new[first] = True
        size = np.diff(s.first)
        return s.keys[np.repeat(new, size)], (s, new, size)

    def send(group: pa.Table, state, totals: np.ndarray) -> pa.Table:
        s, new, size = state
        own = np.flatnonzero(new)
        n = size[own]
        begin = np.cumsum(n) - n
        key, text = s.keys[np.repeat(new, size)], np.repeat(np.arange(len(own)), n)
        rare = rarity(totals).astype(np.uint8)
        order = np.argsort(rare, kind="stable")  # keys are sorted within their sets already
        order = order[np.argsort(text[order].astype(np.uint16) if len(own) < 1 << 16 else text[order], kind="stable")]
        place = np.arange(len(order)) - begin[text]
        sent = np.flatnonzero((rare[order] > 0) & (place < np.array([prefix(int(k), threshold) for k in n], np.int64)[text]))
        of = text[sent]
        bodies = np.unique(of)
        some = pa.table({"kind": pa.array(np.zeros(len(s.ids), np.int8)), "doc_id": group["doc_id"].combine_chunks(), "row": group["row"].combine_chunks(), "fp": pa.array(s.ids)})
        posted = pa.table({"kind": pa.array(np.ones(len(sent), np.int8)), "fp": pa.array(s.ids[own[of]]), "key": pa.array(key[order[sent]].view(np.int64)), "size": pa.array(n[of].astype(np.int32)), "at": pa.array(place[sent].astype(np.int32))})
        whole = pa.table({"kind": pa.array(np.full(len(bodies), 2, np.int8)), "fp": pa.array(s.ids[own[bodies]]), "body": pa.array([s.keys[s.first[i] : s.first[i + 1]].tobytes() for i in own[bodies].tolist()], pa.binary())})
        out = pa.concat_tables([some, posted, whole], promote_options="default")
        return out.select(["kind", "doc_id", "row", "fp", "key", "size", "at", "body"])

    found, _ = materialise(chunk_totals(rows, keys, send, f"kind byte, doc_id {ids}, row long, fp long, key long, size int, at int, body binary"), "shingles")
    release(spark)
    postings, sets = found.filter("kind = 1").select("key", "size", "fp", "at"), found.filter("kind = 2").select("fp", "body")

    def meet(batches):
        for p in _runs(batches, ["key", "size", "fp", "at"]):
            again = np.concatenate([[False], (p["key"][1:] == p["key"][:-1]) & (p["fp"][1:] == p["fp"][:-1])])
            key, size, fp, at = (p[k][~again] for k in ("key", "size", "fp", "at"))
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            count = np.diff(np.append(starts, len(key)))
            big = np.repeat(count > small, count)
            a, b = [], []
            for step in range(1, int(min(small, count.max()))):
                i = np.flatnonzero((key[:-step] == key[step:]) & (~big[:-step] | (step == 1)))
                ok = _fits(size, at, i, i + step, threshold)
                a.append(i[ok])
                b.append(i[ok] + step)
            if a:
                x, y = _pairs(fp, np.concatenate(a), np.concatenate(b))
                none = pa.nulls(len(x), pa.int32())
                yield pa.record_batch([pa.nulls(len(x), pa.int64()), none, pa.array(x), none, pa.array(y)], names=["key", "size", "fp", "at", "other"])
            if big.any():
                yield pa.record_batch([pa.array(key[big]), pa.array(size[big]), pa.array(fp[big]), pa.array(at[big]), pa.nulls(int(big.sum()), pa.int64())], names=["key", "size", "fp", "at", "other"])

    def meet_again(batches):
        for p in _runs(batches, ["key", "size", "fp", "at", "root"]):
            edges = np.flatnonzero(np.concatenate([[True], p["key"][1:] != p["key"][:-1], [True]]))
            for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
                i, j = _across(p["root"][s:e], p["size"][s:e].astype(np.int64), p["at"][s:e].astype(np.int64), threshold)
                if len(i):
                    x, y = _pairs(p["fp"][s:e], i, j)
                    yield pa.record_batch([pa.array(x), pa.array(y)], names=["a", "b"])

    def compare(batches):
        for b in batches:
            ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), threshold) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def verified(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()
        have, _ = materialise(sets.join(wanted, "fp", "left_semi").groupBy("fp").agg(F.first("body").alias("body")), "sets")
        both = pairs.join(have.select(F.col("fp").alias("a"), F.col("body").alias("x")), "a").join(have.select(F.col("fp").alias("b"), F.col("body").alias("y")), "b")
        return materialise(both.select("a", "b", "x", "y").mapInArrow(lean(compare), "a long, b long"), "verified")[0]

    met, _ = materialise(postings.repartition(n_parts, "key").sortWithinPartitions("key", "size", "fp").mapInArrow(lean(meet), "key long, size int, fp long, at int, other long"), "met")
    pairs, _ = materialise(met.filter("other IS NOT NULL").select(F.col("fp").alias("a"), F.col("other").alias("b")).distinct(), "pairs")
    links = verified(pairs)
    roots = components(links)
    big = met.filter("other IS NULL").drop("other")
    if not big.isEmpty():
        rooted = big.join(roots, "fp", "left").select("key", "size", "fp", "at", F.coalesce("root", "fp").alias("root"))
        more = rooted.repartition(n_parts, "key").sortWithinPartitions("key", "size", "fp").mapInArrow(lean(meet_again), "a long, b long").distinct().join(pairs, ["a", "b"], "left_anti")
        roots = components(links.union(verified(materialise(more, "pairs")[0])))
    return found.filter("kind = 0").select("doc_id", "row", "fp"), roots


def keep_first(df: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL) -> DataFrame:
    """One row of each group of df, with all its columns: that of the smallest id (null last)."""
    return keep_rows(df, *groups(df, shingle, threshold, id_col, text_col, small), id_col, text_col)
