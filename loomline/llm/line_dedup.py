"""Removal of lines that match an earlier line: an exact set-similarity join with prefix, length and positional filters.

A line is the set of its words (A-Z lower-cased, separated by ASCII white space). Of two lines with Jaccard similarity of
``threshold`` or more, the later one goes, whether or not the earlier one stays; earlier means a smaller doc_id (null last), of
rows that share an id (or have none) a smaller hash of the text, then an earlier line. Blank lines always stay.

1. Words are counted over all documents in ``SLOTS`` hashed counters. A word's code is its rarity class by its counter and its hash,
   so sorted codes run from rare to frequent, in the same order everywhere.
2. A line sends one posting for each word of its prefix, the |x| - ceil(t |x|) + 1 rarest words, but for words that certainly
   occur once. Lines that are equal sets meet within a task first and send one line's postings.
3. A bucket of words drops equal sets but the first, then compares postings of a word under the length filter, the
   positional filter, and a bitmap filter: the parity of a line's words in 128 bits bounds from below how many words two lines
   differ in. For each line it names the ``nearest`` earlier candidates and notes whether there were more. Words with more than
   ``hot`` postings are put aside and compared in squares of that side, each a task's group of its own.
4. Candidates' words are fetched from their documents and compared exactly.
5. A line that had more candidates, none of the named ones matching, is compared with all its candidates by a join on the words
   of its prefix, under the same filters. So the bound of step 3 never costs a match.

Each step's tables are written to the shared folder and its shuffle files released before the next one begins.

A row is known by its id and the hash of its text. Ids that are no whole numbers count as null. Texts that are null have no
lines. Equal rows are told apart: the second one's lines match the first one's. Columns other than the two named ones pass
through keep_lines() unread, whatever their names.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import GRAPHIC, Words, lean, materialise, mix, partitions, raw, release, sorted_within, table

THRESHOLD, NEAREST = 0.8, 4
#: Candidates named for a line whose nearest one may well fail, as its bitmap differs by over half of what is allowed.
WIDE = 256
#: Hashed counters of words, and how many parts they are added up in.
SLOTS, RANGES = 1 << 22, 16
#: Postings of a word that are compared in one place.
HOT = 20_000
#: Bytes of text that are taken apart at once (little enough for a core's cache), and postings that a task gathers before it sends them.
SLICE, HELD = 1 << 18, 400_000
LAST = (1 << 63) - 1
ROW_LINE = ("doc", "tie", "line")
POSTING = ("code", "set", "doc", "tie", "line", "size", "at", "low", "high")
KINDS = ", ".join(f"{c} long" for c in POSTING)


class Lines:
    """The non-blank lines of many texts as sets of words: text and number within the text of each line; the words' hashes of
    line i, without repeats, are words[first[i] : first[i + 1]], in the order of classes (if given, a class for each word slot), then hashes."""

    def __init__(self, texts: list[bytes], classes: np.ndarray | None = None):
        w = Words(texts, GRAPHIC, lower=True)
        cuts = np.flatnonzero(np.frombuffer(w.data, np.uint8) == 10)
        of = np.searchsorted(cuts, w.start)
        begin = np.searchsorted(cuts, w.begins[:-1])  # the first line of each text
        some = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else of
        dense = np.cumsum(np.concatenate([[0], of[1:] != of[:-1]])) if len(of) else of
        number = of[some]
        self.text = np.searchsorted(begin, number, "right") - 1
        self.number = number - begin[self.text] if len(number) else number
        self.rank = None if classes is None else classes[slot(w.hash, len(classes))]
        self.words, self.first, self.rank = _ranked_sets(w.hash, dense, len(number), self.rank)

    @functools.cached_property
    def ids(self) -> np.ndarray:
        """A hash of each line's set."""
        return np.add.reduceat(mix(self.words), self.first[:-1]) if len(self.words) else np.empty(0, np.uint64)


def _ranked_sets(key: np.ndarray, line: np.ndarray, lines: int, rank: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    order = sorted_within(line, key, rank)
    key, line = key[order], line[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (line[1:] != line[:-1])]) if len(key) else np.empty(0, bool)
    return key[new], np.searchsorted(line[new], np.arange(lines + 1)), None if rank is None else rank[order][new]


def _sets(key: np.ndarray, line: np.ndarray, lines: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys sorted within their lines, without repeats, and where each line's begin."""
    return _ranked_sets(key, line, lines, None)[:2]


def rarity(totals: np.ndarray) -> np.ndarray:
    """Classes from 0, for a word that occurs once, to 255."""
    return np.minimum(255, np.where(totals > 1, 1 + np.log2(np.maximum(totals, 1)) * 5, 0)).astype(np.uint64)


def slot(key: np.ndarray, slots: int) -> np.ndarray:
    """The counter of a key, by the key's first bits."""
    return (key >> np.uint64(64 - (slots.bit_length() - 1))).astype(np.int64)


def squeeze(columns: dict[str, np.ndarray]) -> bytes:
    """Columns of 64-bit numbers as one compressed blob of byte planes; the first is sent as differences."""
    first, *rest = columns.values()
    planes = [np.diff(first, prepend=first.dtype.type(0)).view(np.uint64), *(c.view(np.uint64) for c in rest)]
    data = b"".join(np.ascontiguousarray(p).view(np.uint8).reshape(-1, 8).T.tobytes() for p in planes)
    return zstandard.ZstdCompressor(level=1).compress(data)


def expand(blobs: list[bytes], names: tuple[str, ...]) -> dict[str, np.ndarray]:
    got: dict[str, list] = {n: [] for n in names}
    for blob in blobs:
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(len(names), 8, -1)
        for i, n in enumerate(names):
            x = np.ascontiguousarray(planes[i].T).view("<u8").ravel()
            got[n].append((np.cumsum(x, dtype=np.uint64) if i == 0 else x).view(np.int64))
    return {n: np.concatenate(x) if x else np.empty(0, np.int64) for n, x in got.items()}


def similar(a: list[int] | np.ndarray, b: np.ndarray, threshold: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= threshold * (len(a) + len(b) - both) - 1e-9


def prefix(size: int, threshold: float) -> int:
    return size - math.ceil(threshold * size - 1e-9) + 1


def prefixes(size: np.ndarray, threshold: float) -> np.ndarray:
    return (size - np.ceil(threshold * size - 1e-9) + 1).astype(np.int64)


def _slices(batch: pa.RecordBatch, column: int, most: int = SLICE):
    """Parts of a batch with about so many bytes of text, a row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    lo, total = 0, np.concatenate([[0], np.cumsum(size)])
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + most, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def counted(df: DataFrame, keys, slots: int) -> np.ndarray:
    """How many of the keys that keys(batch) yields fall to each of the slots, over all of df. Its size is fixed by slots."""
    spark = df.sparkSession
    width = slots // RANGES

    def count(batches):
        total, held = np.zeros(slots, np.uint32), [np.empty(0, np.uint64)]

        def tally():
            total[:] += np.bincount(slot(np.concatenate(held), slots), minlength=slots).astype(np.uint32)
            held.clear()

        for b in batches:
            for key in keys(b):
                held.append(key)
                if sum(map(len, held)) > 1 << 21:
                    tally()
        if held:
            tally()
        parts = [(r, squeeze({"n": total[r * width : (r + 1) * width].astype(np.uint64)})) for r in range(RANGES) if total[r * width : (r + 1) * width].any()]
        yield pa.record_batch([pa.array([r for r, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], names=["range", "n"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for r, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = expand([blob], ("n",))["n"]
                sums[r] = sums[r] + x if r in sums else x
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([np.minimum(x, (1 << 32) - 1).astype("<u4").tobytes() for x in sums.values()], pa.binary())], names=["range", "n"])

    out = np.zeros(slots, np.uint32)
    for r in df.mapInArrow(lean(count), "range int, n binary").repartition(min(RANGES, partitions(spark)), "range").mapInArrow(lean(add), "range int, n binary").collect():  # slots numbers in all
        out[r["range"] * width : (r["range"] + 1) * width] = np.frombuffer(r["n"], "<u4")
    return out


def earlier(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether line x of the postings comes before line y."""
    d, t = p["doc"], p["tie"]
    return (d[x] < d[y]) | (d[x] == d[y]) & ((t[x] < t[y]) | (t[x] == t[y]) & (p["line"][x] < p["line"][y]))


def _nearest(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, d: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most pairs of each x (a set's first posting stands for it): by distance, then in document order of y; each y once."""
    sx, sy = p["set"][x], p["set"][y]
    order = np.lexsort((sy, p["line"][y], p["tie"][y], p["doc"][y], d, sx))
    x, y, d, sx, sy = (c[order] for c in (x, y, d, sx, sy))
    new = np.concatenate([[True], (sx[1:] != sx[:-1]) | (sy[1:] != sy[:-1])]) if len(x) else np.empty(0, bool)
    x, y, d = x[new], y[new], d[new]
    keep = _places(p["set"][x]) < most
    return x[keep], y[keep], d[keep]


def _places(x: np.ndarray) -> np.ndarray:
    """How many equal numbers precede each in a sorted array."""
    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)
    return np.arange(len(x)) - np.repeat(starts, np.diff(np.append(starts, len(x))))


PAIR = ("xdoc", "xtie", "xline", "ydoc", "ytie", "yline", "more")


def once(p: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Postings sorted by word and size with one line, the first, of each set and word; and the lines that repeat an earlier set."""
    order = np.lexsort((p["set"], p["size"], p["code"]))
    p = {k: v[order] for k, v in p.items()}
    same = (p["code"][1:] == p["code"][:-1]) & (p["set"][1:] == p["set"][:-1]) if len(order) else np.empty(0, bool)
    if same.any():
        run = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))
        own = run[np.lexsort((p["line"][run], p["tie"][run], p["doc"][run], p["set"][run], p["size"][run], p["code"][run]))]
        p = {k: v.copy() for k, v in p.items()}
        for v in p.values():
            v[run] = v[own]
    again = np.concatenate([[False], same]) if len(order) else np.empty(0, bool)
    return {k: v[~again] for k, v in p.items()}, {k: p[k][elsewhere(again, *(p[c] for c in ROW_LINE)) & (p["at"] == 0)] for k in ROW_LINE}


def elsewhere(again: np.ndarray, *place: np.ndarray) -> np.ndarray:
    """Which of the repeats stand in another place than the first of their run: equal rows share their places."""
    first = np.maximum.accumulate(np.where(again, 0, np.arange(len(again))))
    differs = np.zeros(len(again), bool)
    for c in place:
        differs |= c != c[first]
    return again & differs


def candidates(p: dict[str, np.ndarray], threshold: float, nearest: int, hot: int = HOT) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray], dict[str, np.ndarray]]:
    """From postings of whole words: pairs (x later, y earlier) to verify, lines that repeat an earlier set, and postings of hot words."""
    p, repeats = once(p)
    n, code = len(p["code"]), p["code"]
    starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if n else np.empty(0, np.int64)
    count = np.diff(np.append(starts, n))
    big = np.repeat(count > hot, count)
    aside = {k: v[big] for k, v in p.items()}
    some = np.repeat(count > 1, count) & ~big
    p = {k: v[some] for k, v in p.items()}
    n, code, size = len(p["code"]), p["code"], p["size"]
    starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if n else np.empty(0, np.int64)
    # sizes rise within a word, so the partners of a posting that pass the length filter follow it without a gap
    composite = np.cumsum(np.concatenate([[0], code[1:] != code[:-1]])) * (1 << 31) + size if n else size
    limit = np.minimum(np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n))), np.searchsorted(composite, (composite >> 31 << 31) + np.minimum(np.floor(size / threshold + 1e-9).astype(np.int64), (1 << 31) - 1), "right")) if n else size
    xs, ys, ds = [], [], []
    for a, b in _following(limit - np.arange(n) - 1):
        a, b, far = compared(p, a, b, threshold)
        later = earlier(p, b, a)
        xs.append(np.where(later, a, b))
        ys.append(np.where(later, b, a))
        ds.append(far)
        if sum(map(len, xs)) > 1 << 22:
            xs, ys, ds = ([c] for c in _nearest(p, np.concatenate(xs), np.concatenate(ys), np.concatenate(ds), WIDE + 1))
    return _named(p, xs, ys, ds, nearest), repeats, aside


def _following(span: np.ndarray):
    """Blocks of pairs of each row with the span rows after it."""
    lo, n = 0, len(span)
    total = np.concatenate([[0], np.cumsum(span)])
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + (1 << 21), "right")) - 1)
        a = np.repeat(np.arange(lo, hi), span[lo:hi])
        yield a, a + 1 + np.arange(len(a)) - np.repeat(total[lo:hi] - total[lo], span[lo:hi])
        lo = hi


def compared(p: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of postings of a word that pass the length, positional and bitmap filters, and twice the bits that their bitmaps
    differ in, plus one where that is over half of what is allowed."""
    size, at = p["size"], p["at"]
    need = np.ceil(threshold / (1 + threshold) * (size[a] + size[b]) - 1e-9)
    # similar lines share a word of both prefixes that are as long as this pair needs them
    ok = (np.maximum(at[a] - size[a], at[b] - size[b]) <= -need) & (np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]) - 1e-9)
    a, b, need = a[ok], b[ok], need[ok]
    far = sum(np.bitwise_count(p[m][a].view(np.uint64) ^ p[m][b].view(np.uint64)).astype(np.int64) for m in ("low", "high"))
    most = (size[a] + size[b] - 2 * need).astype(np.int64)
    ok = far <= most
    return a[ok], b[ok], 2 * far[ok] + (2 * far[ok] > most[ok])  # an odd number: not sure


def _named(p: dict[str, np.ndarray], xs: list, ys: list, ds: list, nearest: int) -> dict[str, np.ndarray]:
    x, y, d = (np.concatenate(c) if c else np.empty(0, np.int64) for c in (xs, ys, ds))
    x, y, d = _nearest(p, x, y, d, WIDE + 1)
    place = _places(p["set"][x])
    most = np.where(d[np.maximum.accumulate(np.where(place == 0, np.arange(len(x)), 0))] % 2 > 0, max(nearest, WIDE), nearest) if len(x) else x
    more = np.isin(p["set"][x], p["set"][x[place >= most]])
    keep = place < most
    x, y, more = x[keep], y[keep], more[keep]
    return {"xdoc": p["doc"][x], "xtie": p["tie"][x], "xline": p["line"][x], "ydoc": p["doc"][y], "ytie": p["tie"][y], "yline": p["line"][y], "more": more.astype(np.int64)}


def square(p: dict[str, np.ndarray], threshold: float, nearest: int) -> dict[str, np.ndarray]:
    """Pairs between two sides (column side, 0 and 1) of one hot word's postings, or among one side alone."""
    p, side = p, p["side"]
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    xs, ys, ds = [], [], []
    other = right if len(right) else left
    block = max(1, (1 << 21) // max(1, len(other)))
    for lo in range(0, len(left), block):
        a, b = np.repeat(left[lo : lo + block], len(other)), np.tile(other, len(left[lo : lo + block]))
        if not len(right):
            a, b = a[a < b], b[a < b]
        a, b, far = compared(p, a, b, threshold)
        later = earlier(p, b, a)
        xs.append(np.where(later, a, b))
        ys.append(np.where(later, b, a))
        ds.append(far)
        if sum(map(len, xs)) > 1 << 22:
            xs, ys, ds = ([c] for c in _nearest(p, np.concatenate(xs), np.concatenate(ys), np.concatenate(ds), WIDE + 1))
    return _named(p, xs, ys, ds, nearest)


def _keyed(df: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    return _keyed_rows(df, id_col, text_col, *more)[0]


def _keyed_rows(df: DataFrame, id_col: str, text_col: str, *more) -> tuple[DataFrame, DataFrame]:
    """The rows, and those of them that may have equal rows: with a null id, and others only where ids repeat. Columns: doc, the id that sorts null last, tie, a hash of the text where the id has several rows or is null, else 0, text and more."""
    kind = df.schema[id_col].dataType.simpleString()
    number = F.col(id_col).cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.col(id_col).cast("string").try_cast("long")
    named = lambda d: d.select(F.coalesce(number, F.lit(LAST)).alias("doc"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"), *more)
    rows = named(df)
    # a row whose id is its own needs no hash to be told apart; most postings are smaller for it
    several = materialise(rows.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) & (F.col("doc") < LAST)).select("doc"), "lines-ids")[0]
    if several.isEmpty():
        return rows.withColumn("tie", F.when(F.col("doc") == LAST, F.col("tie")).otherwise(0)), named(df.filter(number.isNull()))
    hit = df.sparkSession.sparkContext.broadcast(counted(several, lambda b: [mix(b.column(0).to_numpy().view(np.uint64))], SLOTS) > 0)

    @F.pandas_udf(T.LongType())
    def told(doc: pd.Series, tie: pd.Series) -> pd.Series:
        own = doc.to_numpy()
        return pd.Series(np.where(hit.value[slot(mix(own.view(np.uint64)), SLOTS)] | (own == LAST), tie.to_numpy(), 0))

    rows = rows.withColumn("tie", told("doc", "tie"))
    return rows, rows


def posted(lines: Lines, doc: np.ndarray, tie: np.ndarray, threshold: float) -> dict[str, np.ndarray]:
    """The postings of the lines, but for words that occur once; of: their lines. doc and tie: of each text."""
    count = len(lines.number)
    size = np.diff(lines.first)
    place = lines.words & np.uint64(127)
    bit, low = np.uint64(1) << (place & np.uint64(63)), place < 64
    maps = [np.bitwise_xor.reduceat(np.where(low == side, bit, np.uint64(0)), lines.first[:-1]) if count else np.empty(0, np.uint64) for side in (True, False)]
    long = prefixes(size, threshold)
    line = np.repeat(np.arange(count), long)
    at = np.arange(len(line)) - np.repeat(np.cumsum(long) - long, long)
    word = lines.first[line] + at
    some = lines.rank[word] > 0
    line, at, word = line[some], at[some], word[some]
    code = lines.rank[word].astype(np.uint64) << np.uint64(40) | lines.words[word] >> np.uint64(24)
    text = lines.text[line]
    return {"of": line, "code": code.view(np.int64), "set": lines.ids[line].view(np.int64), "doc": doc[text], "tie": tie[text], "line": lines.number[line], "size": size[line], "at": at, **{n: m[line].view(np.int64) for n, m in zip(("low", "high"), maps)}}


def _postings(rows: DataFrame, classes, threshold: float, buckets: int) -> DataFrame:
    """bucket, kind (0: postings, 1: lines known as repeats) and blob."""

    def flush(held: list[dict[str, np.ndarray]], places: list[dict[str, np.ndarray]], turn: int):
        at = {k: np.concatenate([h[k] for h in places]) for k in (*ROW_LINE, "set")}
        order = np.lexsort((at["line"], at["tie"], at["doc"], at["set"]))
        same = at["set"][order]
        again = np.zeros(len(order), bool)
        again[order[1:][same[1:] == same[:-1]]] = True
        away = order[elsewhere(again[order], *(at[c][order] for c in ROW_LINE))]
        out = [(turn % buckets, 1, squeeze({c: at[c][away] for c in ROW_LINE}))] if len(away) else []
        starts = np.cumsum([0, *(len(h["set"]) for h in places)])
        of = np.concatenate([h["of"] + s for h, s in zip(held, starts)])
        p = {k: np.concatenate([h[k] for h in held])[~again[of]] for k in POSTING}
        to = (mix(p["code"].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = sorted_within(to, p["code"].view(np.uint64) << np.uint64(16))
        p, to = {k: v[order] for k, v in p.items()}, to[order]
        edges = np.searchsorted(to, np.arange(buckets + 1))
        out += [(b, 0, squeeze({k: v[s:e] for k, v in p.items()})) for b, (s, e) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())) if e > s]
        return pa.record_batch([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["bucket", "kind", "blob"])

    def send(batches):
        held, places, count, turn = [], [], 0, 0
        for b in batches:
            for part in _slices(b, 2):
                lines = Lines(raw(part.column(2)), classes.value)
                if not len(lines.number):
                    continue
                doc, tie = part.column(0).to_numpy(), part.column(1).to_numpy()
                held.append(posted(lines, doc, tie, threshold))
                places.append({"doc": doc[lines.text], "tie": tie[lines.text], "line": lines.number, "set": lines.ids.view(np.int64)})
                count += len(held[-1]["code"])
                if count > HELD:
                    yield flush(held, places, turn)
                    held, places, count, turn = [], [], 0, turn + 1
        if held:
            yield flush(held, places, turn)

    return rows.mapInArrow(lean(send), "bucket int, kind int, blob binary")


FOUND = "kind int, " + ", ".join(f"{c} long" for c in (*PAIR, *POSTING))


def _found(kind: int, columns: dict[str, np.ndarray]) -> pa.Table:
    n = len(next(iter(columns.values())))
    none = pa.nulls(n, pa.int64())
    return pa.table({"kind": pa.array(np.full(n, kind, np.int32)), **{c: pa.array(columns[c].astype(np.int64)) if c in columns else none for c in (*PAIR, *POSTING)}})


def _meet(rows: DataFrame, classes, threshold: float, nearest: int, hot: int) -> DataFrame:
    """kind 0: pairs to verify; 1: lines that repeat an earlier set; 2: postings of hot words."""

    def meet(group: pa.Table) -> pa.Table:
        kinds, blobs = group["kind"].to_pylist(), group["blob"].to_pylist()
        known = expand([x for k, x in zip(kinds, blobs) if k == 1], ROW_LINE)
        pairs, repeats, aside = candidates(expand([x for k, x in zip(kinds, blobs) if k == 0], POSTING), threshold, nearest, hot)
        return pa.concat_tables([_found(0, pairs), _found(1, known), _found(1, repeats), _found(2, aside)])

    buckets = partitions(rows.sparkSession)
    return materialise(_postings(rows, classes, threshold, buckets).groupBy("bucket").applyInArrow(lean(meet), FOUND), "lines-met")[0]


def _squares(aside: DataFrame, threshold: float, nearest: int, hot: int) -> DataFrame:
    """The pairs of hot words: a word's postings fall into groups of about ``hot``, and each pair of groups is one task's work."""
    sizes = aside.groupBy("code").agg(F.ceil(F.count(F.lit(1)) / hot).cast("int").alias("groups"))
    own = aside.join(sizes, "code").withColumn("g", F.pmod(F.xxhash64("set"), F.col("groups")).cast("int"))
    each = own.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    each = each.select("code", F.least("g", "o").alias("i"), F.greatest("g", "o").alias("j"), (F.col("g") > F.col("o")).cast("long").alias("side"), *[c for c in POSTING if c != "code"])

    def meet(group: pa.Table) -> pa.Table:
        got = square({c: group[c].to_numpy() for c in (*POSTING, "side")}, threshold, nearest)
        return pa.table({c: pa.array(got[c].astype(np.int64)) for c in PAIR})

    return each.groupBy("code", "i", "j").applyInArrow(lean(meet), ", ".join(f"{c} long" for c in PAIR))


WORDS = "doc long, tie long, line long, words binary"


def _text_key(doc: np.ndarray, tie: np.ndarray) -> np.ndarray:
    return mix(mix(doc.view(np.uint64)) ^ tie.view(np.uint64))


def _line_key(text: np.ndarray, line: np.ndarray) -> np.ndarray:
    return mix(text + (line.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))


def _marked(df: DataFrame, lines: bool):
    """A broadcast bitmap of fixed size that holds the texts (doc, tie) of df, and their lines if asked for; it may hold others too."""

    def keys(b):
        text = _text_key(b.column(0).to_numpy(), b.column(1).to_numpy())
        yield text
        if lines:
            yield _line_key(text, b.column(2).to_numpy())

    return df.sparkSession.sparkContext.broadcast(counted(df.select(*ROW_LINE[: 3 if lines else 2]), keys, SLOTS) > 0)


def _words_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The words' hashes, sorted, of the lines wanted (doc, tie, line), each once: a scan that keeps what the bitmap holds, then a join."""
    hit = _marked(wanted, True)

    def take(batches):
        for b in batches:
            b = b.filter(pa.array(hit.value[slot(_text_key(b.column(0).to_numpy(), b.column(1).to_numpy()), SLOTS)]))
            for part in _slices(b, 2):
                lines = Lines(raw(part.column(2)))
                text = _text_key(part.column(0).to_numpy(), part.column(1).to_numpy())
                at = np.flatnonzero(hit.value[slot(_line_key(text[lines.text], lines.number), SLOTS)])
                of = pa.array(lines.text[at])
                yield pa.record_batch([part.column(0).take(of), part.column(1).take(of), pa.array(lines.number[at]), pa.array([lines.words[lines.first[i] : lines.first[i + 1]].tobytes() for i in at.tolist()], pa.binary())], names=["doc", "tie", "line", "words"])

    found = rows.select("doc", "tie", "text").mapInArrow(lean(take), WORDS)
    return materialise(found.join(wanted, list(ROW_LINE), "left_semi").dropDuplicates(list(ROW_LINE)), "lines-words")[0]


def _verified(pairs: DataFrame, words: DataFrame, threshold: float) -> DataFrame:
    """xdoc, xtie, xline, more and ok, whether the lines are similar, of each pair."""
    side = lambda s: words.select(*[F.col(c).alias(s + c) for c in ROW_LINE], F.col("words").alias(s + "words"))

    def compare(batches):
        for b in batches:
            ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), threshold) for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist())]
            yield pa.record_batch([*(b.column(i) for i in range(4)), pa.array(ok, pa.bool_())], names=["xdoc", "xtie", "xline", "more", "ok"])

    both = pairs.join(side("x"), ["xdoc", "xtie", "xline"]).join(side("y"), ["ydoc", "ytie", "yline"])
    return materialise(both.select("xdoc", "xtie", "xline", "more", "xwords", "ywords").mapInArrow(lean(compare), "xdoc long, xtie long, xline long, more long, ok boolean"), "lines-verified")[0]


def _places_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(*[F.col("x" + c).alias(c) for c in ROW_LINE]).union(pairs.select(*["y" + c for c in ROW_LINE])).distinct()


def _bodies(p: dict[str, np.ndarray], words: np.ndarray, first: np.ndarray, line: np.ndarray, to: np.ndarray, kind: int) -> pa.RecordBatch:
    """Postings with the words of their lines, one row for each bucket (column to); line: the place of each posting's line in first."""
    out = []
    order = np.argsort(to, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], np.diff(to[order]) != 0, [True]])) if len(order) else np.zeros(1, np.int64)
    for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
        own = order[s:e]
        each, body = np.unique(line[own], return_inverse=True)
        flat = np.concatenate([words[first[i] : first[i + 1]] for i in each.tolist()])
        out.append((int(to[own[0]]), squeeze({**{k: v[own] for k, v in p.items()}, "body": body.astype(np.int64)}), zstandard.ZstdCompressor(level=1).compress(flat.tobytes())))
    return pa.record_batch([pa.array([x[0] for x in out], pa.int32()), pa.array([kind] * len(out), pa.int32()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], names=["bucket", "kind", "blob", "words"])


def _unpacked(blobs: list[bytes], words: list[bytes]) -> tuple[dict[str, np.ndarray], list[np.ndarray]]:
    """What _bodies packed: postings, and the sorted words of each body; body is then a place in that list."""
    parts, bodies = [], []
    for blob, flat in zip(blobs, words):
        p = expand([blob], (*POSTING, "body"))
        flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(flat), np.uint64)
        size = np.zeros(int(p["body"].max()) + 1, np.int64)
        size[p["body"]] = p["size"]
        ends = np.cumsum(size)
        p["body"] = p["body"] + len(bodies)
        bodies += [flat[e - n : e] for e, n in zip(ends.tolist(), size.tolist())]
        parts.append(p)
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.int64) for k in (*POSTING, "body")}, bodies


def matched(x: dict[str, np.ndarray], xbody: list[np.ndarray], y: dict[str, np.ndarray], ybody: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which postings of x belong to lines that have an earlier similar line among the postings y of the same word."""
    order = np.argsort(y["code"], kind="stable")
    y = {k: v[order] for k, v in y.items()}
    both = {k: np.concatenate([x[k], y[k]]) for k in POSTING}
    n, found = len(x["code"]), set()
    for i, (lo, hi) in enumerate(zip(np.searchsorted(y["code"], x["code"]).tolist(), np.searchsorted(y["code"], x["code"], "right").tolist())):
        if int(x["set"][i]) in found:
            continue
        a, b, far = compared(both, np.full(hi - lo, i), n + np.arange(lo, hi), threshold)
        before = earlier(both, b, a)
        b, far = b[before], far[before]
        for j in b[np.argsort(far, kind="stable")].tolist():
            if similar(xbody[x["body"][i]], ybody[y["body"][j - n]], threshold):
                found.add(int(x["set"][i]))
                break
    return np.isin(x["set"], np.array(sorted(found), np.int64))


def _settle(rows: DataFrame, waiting: DataFrame, words: DataFrame, classes, threshold: float) -> DataFrame:
    """The waiting lines (doc, tie, line) that have an earlier similar line among all their candidates.

    Lines with a word of a waiting line's prefix are sent to that word's bucket with their words, and compared there; words that
    are frequent have several buckets, and waiting lines go to all of them. Only lines found similar leave a bucket.
    """
    spark = rows.sparkSession
    buckets = partitions(spark)
    share = lambda code: 1 + (np.exp2((np.maximum(code >> 40, 1) - 1) / 5) // HOT).astype(np.int64)  # noqa: E731  buckets of a word

    def place(code: np.ndarray, salt: np.ndarray) -> np.ndarray:
        return (mix(code.view(np.uint64) ^ mix(salt.astype(np.uint64))) % np.uint64(buckets)).astype(np.int64)

    def ask(batches):
        for b in batches:
            some = [np.frombuffer(w, np.uint64) for w in b.column(3).to_pylist()]
            one = Lines.__new__(Lines)
            flat = np.concatenate([*some, np.empty(0, np.uint64)])
            one.text = one.number = np.arange(len(some))
            one.words, one.first, one.rank = _ranked_sets(flat, np.repeat(one.text, [len(w) for w in some]), len(some), classes.value[slot(flat, SLOTS)])
            p = posted(one, b.column(0).to_numpy(), b.column(1).to_numpy(), threshold)
            line, n = p.pop("of"), share(p["code"])
            p["line"] = b.column(2).to_numpy()[line]
            again = np.repeat(np.arange(len(n)), n)
            salt = np.arange(len(again)) - np.repeat(np.cumsum(n) - n, n)
            p, line = {k: v[again] for k, v in p.items()}, line[again]
            yield _bodies(p, flat, np.concatenate([[0], np.cumsum([len(w) for w in some])]), line, place(p["code"], salt), 0)

    own = materialise(words.join(waiting, list(ROW_LINE), "left_semi").select("doc", "tie", "line", "words"), "lines-own")[0]

    def prefix_words(b):
        for w in b.column(3).to_pylist():
            w = np.frombuffer(w, np.uint64)
            w = w[sorted_within(np.zeros(len(w), np.int64), w, classes.value[slot(w, SLOTS)])][: prefix(len(w), threshold)]
            yield w
            yield mix(w >> np.uint64(24))

    hit = spark.sparkContext.broadcast(counted(own, prefix_words, SLOTS) > 0)

    def asked(word: np.ndarray) -> np.ndarray:
        """Whether a word may be in a waiting line's prefix: by two bits of the bitmap."""
        out = hit.value[slot(word, SLOTS)]
        out[out] = hit.value[slot(mix(word[out] >> np.uint64(24)), SLOTS)]
        return out

    def send(batches):
        for b in batches:
            met = []
            for part in _slices(b, 2):
                w = Words(raw(part.column(2)), GRAPHIC, lower=True)
                met.append(np.diff(np.concatenate([[0], np.cumsum(asked(w.hash))])[w.first]) > 0)
            for part in _slices(b.filter(pa.array(np.concatenate([*met, np.empty(0, bool)]))), 2, 8 * SLICE):
                lines = Lines(raw(part.column(2)), classes.value)
                p = posted(lines, part.column(0).to_numpy(), part.column(1).to_numpy(), threshold)
                ok = asked(p["code"].view(np.uint64) << np.uint64(24))
                line = np.repeat(np.arange(len(lines.number)), np.diff(lines.first))
                sort = sorted_within(line, lines.words)  # bodies are sorted by hash
                p = {k: v[ok] for k, v in p.items()}
                of = p.pop("of")
                yield _bodies(p, lines.words[sort], lines.first, of, place(p["code"], mix(p["set"].view(np.uint64)) % share(p["code"]).astype(np.uint64)), 1)

    def check(group: pa.Table) -> pa.Table:
        kinds, blobs, flats = (group[c].to_pylist() for c in ("kind", "blob", "words"))
        side = lambda k: _unpacked([x for n, x in zip(kinds, blobs) if n == k], [x for n, x in zip(kinds, flats) if n == k])
        (x, xbody), (y, ybody) = side(0), side(1)
        ok = matched(x, xbody, y, ybody, threshold)
        return pa.table({c: pa.array(x[c][ok]) for c in ROW_LINE})

    packed = "bucket int, kind int, blob binary, words binary"
    every = own.mapInArrow(lean(ask), packed).unionByName(rows.select("doc", "tie", "text").mapInArrow(lean(send), packed))
    return materialise(every.groupBy("bucket").applyInArrow(lean(check), "doc long, tie long, line long").distinct(), "lines-late")[0]


def removed_lines(rows: DataFrame, threshold: float = THRESHOLD, nearest: int = NEAREST, hot: int = HOT) -> DataFrame:
    """doc, tie and removed (line numbers from 0, sorted) of the texts that lose lines to other rows' or their own earlier lines.

    rows: doc, tie and text, as _keyed makes them. Equal rows have the same lines and so one row here.
    """
    spark = rows.sparkSession

    def keys(batch):
        for part in _slices(batch, 2):
            yield Words(raw(part.column(2)), GRAPHIC, lower=True).hash

    classes = spark.sparkContext.broadcast(rarity(counted(rows, keys, SLOTS)).astype(np.uint8))
    met = _meet(rows, classes, threshold, nearest, hot)
    release(spark)
    pairs, aside = met.filter("kind = 0").select(*PAIR), met.filter("kind = 2")
    if not aside.isEmpty():
        pairs = pairs.union(_squares(aside.select(*POSTING), threshold, nearest, hot))
    pairs = materialise(pairs.groupBy(*PAIR[:-1]).agg(F.max("more").alias("more")), "lines-pairs")[0]
    words = _words_of(rows, _places_of(pairs))
    release(spark)
    seen = _verified(pairs, words, threshold)
    each = seen.groupBy(*[F.col("x" + c).alias(c) for c in ROW_LINE]).agg(F.bool_or("ok").alias("ok"), F.max("more").alias("more"))
    gone = met.filter("kind = 1").select(*ROW_LINE).union(each.filter("ok").select(*ROW_LINE))
    waiting = materialise(each.filter("NOT ok AND more > 0").select(*ROW_LINE), "lines-waiting")[0]
    if not waiting.isEmpty():
        gone = gone.union(_settle(rows, waiting, words, classes, threshold))
    out = materialise(gone.groupBy("doc", "tie").agg(F.array_sort(F.collect_set(F.col("line").cast("int"))).alias("removed")), "lines-removed")[0]
    release(spark)
    return out


@F.pandas_udf(T.StringType())
def without(text: pd.Series, removed: pd.Series) -> pd.Series:
    """A text without the lines of these numbers."""
    out = []
    for t, gone in zip(text, removed):
        if t is None or gone is None:
            out.append(t)
            continue
        lines = t.split("\n")
        stays = np.ones(len(lines), bool)
        stays[np.asarray(gone, np.int64)] = False
        out.append("\n".join([x for x, s in zip(lines, stays.tolist()) if s]))
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def filled(text: pd.Series) -> pd.Series:
    """The numbers of a text's lines that aren't blank."""
    out = []
    for t in text:
        lines = Lines([t.encode()]) if t is not None else None
        out.append(None if lines is None else lines.number.astype(np.int32))
    return pd.Series(out, dtype=object)


def _decided(df: DataFrame, threshold: float, nearest: int, id_col: str, text_col: str, *more) -> DataFrame:
    """The rows of df as doc, tie, text and more, with removed, null if no line goes, and kept, the text that stays."""
    rows, doubtful = _keyed_rows(df, id_col, text_col, *more)
    gone = removed_lines(rows, threshold, nearest)
    copies = materialise(doubtful.filter("text <> ''").groupBy("doc", "tie").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc", "tie"), "lines-copies")[0]
    several = not copies.isEmpty()
    marks = gone.join(copies.withColumn("several", F.lit(True)), ["doc", "tie"], "full") if several else gone
    hit = _marked(marks, False)

    @F.pandas_udf(T.BooleanType())
    def concerned(doc: pd.Series, tie: pd.Series) -> pd.Series:
        return pd.Series(hit.value[slot(_text_key(doc.to_numpy(), tie.to_numpy()), SLOTS)])

    # only texts that the bitmap holds are shuffled; the others pass by
    rest = rows.filter(~concerned("doc", "tie")).withColumns({"removed": F.lit(None).cast("array<int>"), "kept": F.col("text")})
    marked = rows.filter(concerned("doc", "tie")).join(marks.hint("shuffle_hash"), ["doc", "tie"], "left")
    if several:  # of equal rows all but one lose every line that isn't blank
        alone = marked.filter("several IS NULL").drop("several")
        equal = marked.filter("several").withColumn("no", F.row_number().over(Window.partitionBy("doc", "tie").orderBy(F.lit(1))))
        every = filled(F.when(F.col("no") > 1, F.col("text")))
        marked = alone.unionByName(equal.withColumn("removed", F.coalesce(every, "removed")).drop("several", "no"))
    kept = F.coalesce(without(F.when(F.col("removed").isNotNull(), F.col("text")), "removed"), "text")
    return rest.unionByName(marked.withColumn("kept", kept))


def line_decisions(df: DataFrame, threshold: float = THRESHOLD, nearest: int = NEAREST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: doc_id, n_lines, removed (line numbers from 0), kept_sha256."""
    found = _decided(df, threshold, nearest, id_col, text_col, F.col(id_col).alias("doc_id"))
    text = F.coalesce("text", F.lit(""))
    n_lines = F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    kept = F.sha2(F.coalesce("kept", F.lit("")), 256)
    return found.select("doc_id", n_lines.alias("n_lines"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"), kept.alias("kept_sha256"))


def keep_lines(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with the removed lines gone from its text; all columns and rows stay.

    Of rows equal in id and text, any one gets the first one's decision; the others lose all their lines.
    """
    quoted = [F.col(f"`{c}`") for c in df.columns]
    found = _decided(df, threshold, NEAREST, id_col, text_col, F.struct(*quoted).alias("row"))
    return found.select("row", "kept").select(*[F.col("kept").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in df.columns])


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns doc_id, n_lines, n_removed, removed_lines (numbers from 0, comma-joined), kept_sha256 of the kept lines."""
    found = line_decisions(table(spark, "documents")(sf_dir))
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.transform("removed", lambda x: x.cast("string")), ",").alias("removed_lines"), "kept_sha256")


SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS no FROM documents WHERE text <> ''),
s AS (SELECT doc_id, no, line, list_distinct(list_filter(regexp_split_to_array(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS ws FROM l),
t AS (SELECT doc_id, no, len(ws) AS n, unnest(ws) AS w FROM s),
f AS (SELECT w, count(*) AS df FROM t GROUP BY w),
o AS (SELECT doc_id, no, n, t.w, row_number() OVER (PARTITION BY doc_id, no ORDER BY df, t.w) AS p FROM t JOIN f ON t.w = f.w),
x AS (SELECT * FROM o WHERE p <= n - ceil(0.8 * n - 1e-9) + 1),
c AS (SELECT DISTINCT a.doc_id AS d1, a.no AS l1, b.doc_id AS d2, b.no AS l2 FROM x a JOIN x b ON a.w = b.w AND (a.doc_id > b.doc_id OR a.doc_id = b.doc_id AND a.no > b.no) AND a.n >= 0.8 * b.n - 1e-9 AND b.n >= 0.8 * a.n - 1e-9),
gone AS (SELECT DISTINCT d1 AS doc_id, l1 AS no FROM c JOIN s a ON a.doc_id = d1 AND a.no = l1 JOIN s b ON b.doc_id = d2 AND b.no = l2
         WHERE len(list_intersect(a.ws, b.ws)) >= 0.8 * (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws))) - 1e-9),
r AS (SELECT l.doc_id, count(*) AS n_lines, count(g.no) AS n_removed, coalesce(string_agg(g.no::VARCHAR, ',' ORDER BY g.no), '') AS removed_lines,
             coalesce(string_agg(CASE WHEN g.no IS NULL THEN line END, chr(10) ORDER BY l.no), '') AS kept
      FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.no = l.no GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(removed_lines, '') AS removed_lines, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id
"""
