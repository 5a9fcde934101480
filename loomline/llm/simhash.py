"""SimHash near-duplicates by the generalised pigeonhole principle.

A document's fingerprint has a bit set where over half of its word shingles' XXH64 values (seed 42) have it set. Equal
fingerprints collapse first, so that groups of copies cost one node. Fingerprints at ``radius`` or fewer differing bits are
found as follows. The 64 bits are split into m disjoint parts, correlated bits together; the thresholds t of a probe's
parts may be unequal, and its matches agree in at least one part within t if the thresholds sum to radius - m + 1 (-1 skips
a part). Each fingerprint chooses its thresholds by dynamic programming over estimated candidate counts, enumerates the
part values within them, and meets the fingerprints that hold those values. All candidates are verified. A part value that
many fingerprints share is divided further by exact sub-parts of its remaining bits, again by the pigeonhole principle.

What is held on the driver or sent to all executors has a fixed size: 64 x 64 bit co-occurrences and m histograms of 2 ** 16
counters. They steer the cost alone; every link is found whatever they say.

Matching groups emit a spanning forest, never all pairs. Components are then found by repeated minimum labels and pointer
jumps over tables in the shared folder.

A null or empty text has fingerprint 0 and is linked like any other. Rows with a null id keep their place in a component
but do not name it; a component that has no other rows has a null name. Equal rows are separate rows of one node. Columns
other than the two named ones are not read.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import LOWER, drop_path, lean, materialise, mix, partitions, raw, table

SHINGLE, RADIUS, SEED, BITS = 3, 2, 42, 64
HISTOGRAM = 1 << 16
#: Part values that more fingerprints share by the histogram, and many more than the mean, are divided further.
HEAVY, TIMES_MEAN = 4096, 16
#: What sending a probe costs, in comparisons.
PROBE = 50
ONE = np.uint64(1)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.translate(LOWER.tobytes()).split()
    if not words:
        return 0
    s = b" ".join(words)
    size = min(shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words])[: len(words) - size + 1].tolist()
    stops = (ends - 1)[size - 1 :].tolist()
    hashed = xxhash.xxh64_intdigest
    votes = np.zeros(BITS, np.int64)
    for lo in range(0, len(starts), 1 << 16):
        h = np.array([hashed(s[a:b], SEED) for a, b in zip(starts[lo : lo + (1 << 16)], stops[lo : lo + (1 << 16)])], "<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every row."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in raw(b.column(1))], np.uint64)
            yield pa.record_batch([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), f"doc_id {kind}, fp long")


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def gather(fps: np.ndarray, bits: tuple[int, ...]) -> np.ndarray:
    """The named bits of each fingerprint as one number."""
    out = np.zeros(len(fps), np.uint64)
    for i, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & ONE) << np.uint64(i)
    return out


def layout(both: np.ndarray, n: int, m: int) -> list[tuple[int, ...]]:
    """m parts of near-equal width; each part grows by the free bit that correlates most with it.

    both: how many fingerprints have bits i and j set.
    """
    n = max(1, n)
    p = np.diag(both) / n
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    r = np.abs(both / n - np.outer(p, p)) / np.outer(sd, sd)
    free, parts = list(range(BITS)), []
    for k in range(m):
        width = len(free) // (m - k)
        part = [free.pop(0)]
        while len(part) < width:
            best = max(free, key=lambda b: (r[b, part].sum(), -b))
            free.remove(best)
            part.append(best)
        parts.append(tuple(sorted(part)))
    return parts


def choose_parts(n: int, radius: int) -> int:
    """The number of parts, from 2 to radius + 2, with the least expected probes and candidates of evenly spread fingerprints."""

    def cost(m: int) -> float:
        width = BITS // m
        each = {t: _ball(width, t) * (PROBE + n / 2.0**width) if t >= 0 else 0.0 for t in range(-1, min(radius, width) + 1)}
        best = {0: 0.0}
        for _ in range(m):
            new: dict[int, float] = {}
            for s, c in best.items():
                for t, x in each.items():
                    new[s + t] = min(new.get(s + t, float("inf")), c + x)
            best = new
        return best[radius - m + 1]

    return min(range(2, radius + 3), key=cost)


def _ball(width: int, t: int) -> int:
    return int(sum(np.prod(np.arange(width - k + 1, width + 1)) / np.prod(np.arange(1, k + 1)) for k in range(t + 1)))


def _slot(values: np.ndarray) -> np.ndarray:
    return (mix(values + ONE) & np.uint64(HISTOGRAM - 1)).astype(np.int64)


def _flips(width: int, t: int) -> np.ndarray:
    """What to xor into a part's value to reach all values within distance t."""
    return np.array([sum(1 << b for b in c) for k in range(t + 1) for c in itertools.combinations(range(width), k)], np.uint64)


def allocate(fps: np.ndarray, parts: list[tuple[int, ...]], counts: np.ndarray, radius: int) -> np.ndarray:
    """Thresholds of each fingerprint in each part: the least estimated sum of probes and candidates, by dynamic programming.

    counts[i]: histogram of part i's values. Distance 2 and beyond is estimated from the mean over distance 1.
    """
    n, m = len(fps), len(parts)
    cost = np.zeros((m, radius + 2, n))
    for i, part in enumerate(parts):
        v, width = gather(fps, part), len(part)
        near = np.zeros(n)
        for flip in _flips(width, 1).tolist():
            near += counts[i][_slot(v ^ np.uint64(flip))]
        cost[i, 1] = PROBE + counts[i][_slot(v)]
        for t in range(1, radius + 1):
            cost[i, t + 1] = _ball(width, t) * (PROBE + near / (width + 1))
    low, high = -m, radius
    goal = radius - m + 1
    best = {0: np.zeros(n)}
    picks: list[dict[int, np.ndarray]] = []
    for i in range(m):
        new: dict[int, np.ndarray] = {}
        pick: dict[int, np.ndarray] = {}
        for s, c in best.items():
            for t in range(-1, radius + 1):
                if not low <= s + t <= high:
                    continue
                x = c + cost[i, t + 1]
                if s + t not in new:
                    new[s + t], pick[s + t] = x, np.full(n, t)
                else:
                    less = x < new[s + t]
                    new[s + t] = np.where(less, x, new[s + t])
                    pick[s + t] = np.where(less, t, pick[s + t])
        best = new
        picks.append(pick)
    out = np.empty((n, m), np.int64)
    left = np.full(n, goal)
    for i in range(m - 1, -1, -1):
        for s in np.unique(left):
            rows = left == s
            out[rows, i] = picks[i][int(s)][rows]
        left = left - out[:, i]
    return out


def forest(a: np.ndarray, b: np.ndarray, nodes: int) -> np.ndarray:
    """The smallest node that each node reaches over the links a-b."""
    label = np.arange(nodes)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    while (label[label] != label).any():
        label = label[label]
    return label


def _pairs_of_run(fp: np.ndarray, data: np.ndarray, probe: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links within one run, as a forest of it: probes against data in blocks, so that memory stays bounded."""
    q, d = np.flatnonzero(probe), np.flatnonzero(data)
    label, own = np.arange(len(fp)), np.arange(len(fp))
    block = max(1, (1 << 21) // max(1, len(d)))
    for lo in range(0, len(q), block):
        part = q[lo : lo + block]
        x, y = np.nonzero(np.bitwise_count(fp[part, None] ^ fp[None, d]) <= radius)
        x, y = part[x], d[y]
        if (x != y).any():
            label = forest(np.concatenate([x, own]), np.concatenate([y, label]), len(fp))
    other = np.flatnonzero(label != own)
    return other, label[other]


def _links(key: np.ndarray, fp: np.ndarray, data: np.ndarray, probe: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between rows of equal keys; the keys are sorted."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(starts, len(key)))
    a, b = [], []
    for s, k in zip(starts[size > 32].tolist(), size[size > 32].tolist()):
        x, y = _pairs_of_run(fp[s : s + k], data[s : s + k], probe[s : s + k], radius)
        a.append(x + s)
        b.append(y + s)
    small = np.repeat(size <= 32, size)
    for step in range(1, int(size[size <= 32].max(initial=1))):
        i = np.flatnonzero(small[:-step] & (key[:-step] == key[step:]))
        j = i + step
        ok = (np.bitwise_count(fp[i] ^ fp[j]) <= radius) & ((data[i] & probe[j]) | (probe[i] & data[j]))
        a.append(i[ok])
        b.append(j[ok])
    if not a:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    a, b = np.concatenate(a), np.concatenate(b)
    nodes, at = np.unique(np.concatenate([fp[a], fp[b]]), return_inverse=True)
    label = forest(at[: len(a)], at[len(a) :], len(nodes))
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[other], nodes[label[other]]


def near_links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links a-b that connect exactly the distinct fingerprints (column fp) that chains of distances up to radius connect."""
    spark = nodes.sparkSession
    n_parts = partitions(spark)

    def together(batches):
        total, n = np.zeros((BITS, BITS), np.int64), 0
        for b in batches:
            x = _bits(b.column(0).to_numpy().view(np.uint64))
            for lo in range(0, len(x), 1 << 15):
                y = x[lo : lo + (1 << 15)].astype(np.float32)  # sums below 2 ** 24 are exact
                total += (y.T @ y).astype(np.int64)
            n += len(x)
        at = np.append(np.arange(BITS * BITS), -1)
        yield pa.record_batch([pa.array(at), pa.array(np.append(total.ravel(), n))], names=["at", "n"])

    sums = {r["at"]: r["n"] for r in nodes.select("fp").mapInArrow(lean(together), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()}
    n = sums.get(-1, 0)
    both = np.array([sums.get(i, 0) for i in range(BITS * BITS)], float).reshape(BITS, BITS)
    parts = layout(both, n, choose_parts(n, radius))
    m = len(parts)

    def count(batches):
        h = np.zeros((m, HISTOGRAM), np.int64)
        for b in batches:
            fps = b.column(0).to_numpy().view(np.uint64)
            for i, part in enumerate(parts):
                h[i] += np.bincount(_slot(gather(fps, part)), minlength=HISTOGRAM)
        at = np.flatnonzero(h.ravel())
        yield pa.record_batch([pa.array(at), pa.array(h.ravel()[at])], names=["at", "n"])

    counts = np.zeros(m * HISTOGRAM)
    for r in nodes.select("fp").mapInArrow(lean(count), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["at"]] = r["n"]
    counts = spark.sparkContext.broadcast(counts.reshape(m, HISTOGRAM).astype(np.float32))
    rest = [[tuple(b for b in range(BITS) if b not in part)[k :: radius + 1] for k in range(radius + 1)] for part in parts]

    def emit(batches):
        for b in batches:
            whole = b.column(0).to_numpy().view(np.uint64)
            for lo in range(0, len(whole), 1 << 14):
                fps = whole[lo : lo + (1 << 14)]
                t = allocate(fps, parts, counts.value, radius)
                for i, part in enumerate(parts):
                    v = gather(fps, part)
                    for k, flips in enumerate([_flips(len(part), 0), *([_flips(len(part), int(t[:, i].max()))] if (t[:, i] > 0).any() else [])]):
                        # the value itself, for data and for probes of threshold 0 or more; then the others within a probe's threshold
                        for flip in flips[k:].tolist():
                            rows = np.arange(len(fps)) if not k else np.flatnonzero(t[:, i] >= bin(flip).count("1"))
                            if not len(rows):
                                continue
                            value = v[rows] ^ np.uint64(flip)
                            role = np.full(len(rows), 2) if k else 1 + 2 * (t[rows, i] >= 0)
                            key = mix(value * np.uint64(m) + np.uint64(i + 1))
                            heavy = counts.value[i][_slot(value)] > max(HEAVY, TIMES_MEAN * n / 2.0 ** len(part))
                            yield from _rows(key[~heavy], fps[rows][~heavy], role[~heavy])
                            if heavy.any():
                                for j, sub in enumerate(rest[i]):
                                    f = fps[rows][heavy]
                                    yield from _rows(mix(key[heavy] ^ mix(gather(f, sub) * np.uint64(radius + 2) + np.uint64(j + 1))), f, role[heavy])

    def _rows(key, fps, role):
        if len(key):
            yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(fps.view(np.int64)), pa.array(role.astype(np.int8))], names=["key", "fp", "role"])

    def match(batches):
        held: list[tuple] = []  # joined when a key ends, so a long run is copied once
        for b in itertools.chain(batches, [None]):
            if b is not None and b.num_rows:
                held.append((b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy()))
                if held[0][0][0] == held[-1][0][-1]:
                    continue
            elif b is not None:
                continue
            key, fp, role = (np.concatenate(c) for c in zip(*held)) if held else (np.empty(0, k) for k in (np.int64, np.uint64, np.int8))
            cut = len(key) if b is None else int(np.searchsorted(key, key[-1])) if len(key) else 0
            if cut:
                x, y = _links(key[:cut], fp[:cut], (role[:cut] & 1) > 0, (role[:cut] & 2) > 0, radius)
                yield pa.record_batch([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])
                held = [(key[cut:], fp[cut:], role[cut:])] if cut < len(key) else []

    probes = nodes.select("fp").mapInArrow(lean(emit), "key long, fp long, role byte")
    return probes.repartition(n_parts, "key").sortWithinPartitions("key").mapInArrow(lean(match), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """fp and root (the least fp, as a signed long, that it reaches) of every fp in links a-b."""
    spark = links.sparkSession
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).filter("u <> v").distinct()
    both, both_path = materialise(both, "links")
    label, path = materialise(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("l")), "labels")
    while True:
        near = both.join(label.select(F.col("u").alias("v"), F.col("l").alias("m")), "v").groupBy("u").agg(F.min("m").alias("m"))
        hooked = label.join(near, "u").select("u", F.col("l").alias("old"), F.least("l", "m").alias("l"))
        jump = label.select(F.col("u").alias("l"), F.col("l").alias("far"))
        new, new_path = materialise(hooked.join(jump, "l").select("u", F.least("l", "far").alias("l"), "old"), "labels")
        moved = new.filter("l <> old").limit(1).count()
        drop_path(spark, path)
        label, path = new.select("u", "l"), new_path
        if not moved:
            drop_path(spark, both_path)
            return label.select(F.col("u").alias("fp"), F.col("l").alias("root"))


def simhash_components(df: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (signed long) and component_id, the least id in the component, of every row."""
    prints, _ = materialise(fingerprints(df, shingle, id_col, text_col), "fingerprints")
    nodes, _ = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(near_links(nodes, radius))
    rooted = nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named, _ = materialise(rooted.join(names, "root").select("fp", "component_id"), "components")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def row_hash(text_col: str | Column):
    """What tells rows of one id apart: a hash of the text."""
    return F.xxhash64(text_col)


def keep_rows(df: DataFrame, prints: DataFrame, roots: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of df for each group: the smallest id (null last), of its rows the one with the smallest hash, of equal rows any.

    Other columns of df are kept, whatever they are called. An empty df gives an empty one.

    prints: doc_id, row (see row_hash) and fp of every row of df; roots: fp and root of the fps that have links.
    """
    nodes, _ = materialise(prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("least")), "nodes")
    rooted = nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("stays")), "root").select("fp", "stays")
    each = prints.groupBy("doc_id", "row", "fp").agg(F.count(F.lit(1)).alias("n")).join(named, "fp")
    stays = F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("row") == F.col("stays.row"))
    marks, _ = materialise(each.withColumn("__stays", stays).filter("NOT __stays OR n > 1").select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), "__stays"), "marks")
    whole = df.select(F.struct("*").alias("whole"))  # so that df's columns may be called anything
    here = F.col("whole")[id_col].eqNullSafe(F.col("__id")) & (row_hash(F.col("whole")[text_col]) == F.col("__row"))
    alone = whole.join(marks, here, "left_anti")
    several = whole.join(marks.filter("__stays"), here)
    one = several.withColumn("__no", F.row_number().over(Window.partitionBy("__id", "__row").orderBy(F.lit(1)))).filter("__no = 1")
    return alone.union(one.select("whole")).select("whole.*")


def groups(df: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """doc_id, row (see row_hash) and fp of every row; and fp and root of the fingerprints that have links."""
    rows = df.select(F.struct(F.col(id_col).alias("doc_id"), row_hash(text_col).alias("row")).alias("own"), F.col(text_col).alias("text"))
    prints, _ = materialise(fingerprints(rows, shingle, "own", "text").select("doc_id.*", "fp"), "fingerprints")
    nodes, _ = materialise(prints.select("fp").distinct(), "nodes")
    return prints, components(near_links(nodes, radius))


def united(first: tuple[DataFrame, DataFrame], second: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The groups of two ways of linking the same rows, joined where they share a row: prints and roots as groups() gives them."""
    rooted = [prints.join(roots, "fp", "left").select("doc_id", "row", F.coalesce("root", "fp").alias(name)) for (prints, roots), name in ((first, "a"), (second, "b"))]
    other = rooted[1].distinct().select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), "b")
    both, _ = materialise(rooted[0].join(other, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("row") == F.col("__row"))).select("doc_id", "row", "a", "b"), "both")
    least = both.groupBy("b").agg(F.min("a").alias("least"))
    links = both.select("a", "b").distinct().join(least, "b").filter("a <> least").select("a", F.col("least").alias("b"))
    return both.select("doc_id", "row", F.col("a").alias("fp")), components(links)


def keep_first(df: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of df, with all its columns (see keep_rows)."""
    return keep_rows(df, *groups(df, shingle, radius, id_col, text_col), id_col, text_col)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns doc_id, fingerprint (16 hexadecimal digits), component_id."""
    found = simhash_components(table(spark, "documents")(sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
