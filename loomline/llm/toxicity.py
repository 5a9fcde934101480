"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is its own bucket and the buckets of its character n-grams, so an unseen spelling shares most of a known one's
vectors. A word's vector is the mean of its buckets' vectors, a document's the mean of its words', and a softmax over two
classes sits on top; all are trained jointly in numpy on the driver. The training rows are a bounded sample: the
``TRAIN_ROWS`` labelled rows of either class with the smallest hashes of their ids, with texts of at most ``TRAIN_BYTES``
bytes. Scoring reads whole texts. As the model is linear above its vectors, a bucket's share in the score is one number, and
scoring looks up one number for each word.

Words: lower-cased runs of letters and digits. A null or empty text has no words and gets the score of the bias alone. If
the labelled rows lack one of the classes, the score is the share of the other (0.5 without any rows). Rows of labels with
a null id or class take no part; repeated ones count as often as they occur; of several texts of one id the least is learnt. Texts
of any length are scored whole. Other columns are not read.

Buckets whose shares in the two classes' texts don't differ surely (``SURE`` standard errors) keep a zero vector: on held-out
rows that gives fewer wrong answers of both kinds than training all of them (the README has the figures).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import forget, lean, raw, table

BUCKETS, DIM, SHORTEST, LONGEST = 1 << 18, 4, 3, 6
TRAIN_ROWS, TRAIN_BYTES = 2000, 1 << 16
#: Gradient steps, whatever the number of rows.
STEPS, BATCH, RATE, SEED = 4000, 32, 0.5, 7
LEAST, SURE = 2, 4.0
#: Words whose numbers a Python worker remembers at most.
REMEMBER = 200_000

_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    if not text.isascii():
        text = text.decode().lower().encode()
    return text.translate(_PLAIN).split()


def buckets(word: bytes) -> list[int]:
    """The word's bucket and those of its character n-grams, with its ends marked."""
    s = f"<{word.decode(errors='replace')}>"
    grams = [s[i : i + n] for n in range(SHORTEST, LONGEST + 1) for i in range(len(s) - n + 1)]
    return [zlib.crc32(g.encode()) % BUCKETS for g in (s, *grams)]


class Model:
    """share: what each bucket adds to the log odds of the second class; bias: what is there without words."""

    def __init__(self, share: np.ndarray, bias: float):
        self.share, self.bias = share.astype(np.float32), bias
        self.known: dict[bytes, float] = {}

    def __getstate__(self):
        return {"share": self.share, "bias": self.bias, "known": {}}

    def odds(self, text: bytes) -> float:
        ws = words(text)
        if not ws:
            return self.bias
        forget(self.known, REMEMBER)
        known, share = self.known, self.share
        for w in set(ws):
            if w not in known:
                known[w] = float(share[buckets(w)].mean())
        return self.bias + sum([known[w] for w in ws]) / len(ws)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip([self.odds(t) for t in texts], -30, 30))) if texts else np.empty(0)


def _spread(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Lists end to end, and their sizes."""
    return (np.concatenate(lists) if lists else np.empty(0, np.int64)), np.array([len(x) for x in lists], np.int64)


def _share(text: bytes, known: dict[bytes, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's words and each bucket's share in the text's mean of means. known: buckets of words met before."""
    ws, n = np.unique(np.array(words(text) or [b""], object), return_counts=True)
    for w in ws:
        if w not in known:
            known[w] = np.array(buckets(w), np.int32)
    flat, size = _spread([known[w] for w in ws])
    own, at = np.unique(flat, return_inverse=True)
    return own, np.bincount(at, weights=np.repeat(n / n.sum() / size, size))


def fit(texts: list[bytes], labels: list[int], share1: float | None = None) -> Model:
    """Adagrad over minibatches. share1: the second class's share in the population, if the sample's differs.

    Buckets in fewer than LEAST texts, or in shares of the classes' texts that differ by less than SURE standard errors,
    stay zero: they could only be learnt by heart.
    """
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        rate = float(y.mean()) if len(y) else 0.5
        return Model(np.zeros(BUCKETS), float(np.log((rate + 1e-3) / (1 - rate + 1e-3))))
    rng = np.random.default_rng(SEED)
    n1, n0 = int(y.sum()), int((1 - y).sum())
    known: dict[bytes, np.ndarray] = {}
    inside = np.zeros((2, BUCKETS))
    for t, c in zip(texts, labels):
        inside[c, _share(t, known)[0]] += 1
    in0, in1 = inside
    rate = (in1 + in0) / len(y)
    z = (in1 / n1 - in0 / n0) / np.sqrt(np.maximum(rate * (1 - rate), 1e-9) * (1 / n1 + 1 / n0))
    kept = np.flatnonzero((in1 + in0 >= LEAST) & (np.abs(z) >= SURE))
    place = np.full(BUCKETS, -1)
    place[kept] = np.arange(len(kept))
    ids, shares = [], []
    for t in texts:
        own, share = _share(t, known)
        ok = place[own] >= 0
        ids.append(place[own[ok]])
        shares.append(share[ok])
    known.clear()
    e = rng.uniform(-1 / DIM, 1 / DIM, (len(kept), DIM))
    w = rng.uniform(-1, 1, (DIM, 2))
    bias = np.zeros(2)
    ge, gw, gb = np.full(e.shape, 1e-12), np.full(w.shape, 1e-8), np.full(2, 1e-8)
    share1 = n1 / len(y) if share1 is None else share1
    weight = np.array([(1 - share1) * len(y) / n0, share1 * len(y) / n1])
    bias[1] = np.log(share1 / (1 - share1))
    rows = np.arange(len(y))
    epochs = -(-STEPS * BATCH // len(y))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        rng.shuffle(rows)
        for lo in range(0, len(rows), BATCH):
            batch = rows[lo : lo + BATCH]
            at, size = _spread([ids[i] for i in batch])
            share = np.concatenate([shares[i] for i in batch])
            hidden = np.zeros((len(batch), DIM))
            if len(at):  # a text without any kept bucket has the bias alone
                hidden[size > 0] = np.add.reduceat(e[at] * share[:, None], (np.cumsum(size) - size)[size > 0], axis=0)
            logit = hidden @ w + bias
            d = np.exp(logit - logit.max(1, keepdims=True))
            d /= d.sum(1, keepdims=True)
            d[np.arange(len(batch)), y[batch]] -= 1
            d *= weight[y[batch], None] / len(batch)
            dh = np.repeat(d @ w.T, size, axis=0) * share[:, None]
            own, of = np.unique(at, return_inverse=True)
            de = np.stack([np.bincount(of, weights=dh[:, j], minlength=len(own)) for j in range(DIM)], axis=1)
            dw, db = hidden.T @ d, d.sum(0)
            ge[own] += de * de
            gw += dw * dw
            gb += db * db
            e[own] -= rate * de / np.sqrt(ge[own])
            w -= 0.1 * rate * dw / np.sqrt(gw)
            bias -= 0.1 * rate * db / np.sqrt(gb)
    share = np.zeros(BUCKETS)
    share[kept] = e @ (w[:, 1] - w[:, 0])
    return Model(share, float(bias[1] - bias[0]))


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES, label: str = "toxic") -> Model:
    """Learns from the sample described above; rows that held_out() marks are never read."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out()).select("doc_id", F.col(label).cast("int").alias("y"))
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = {}
    for y in (0, 1):
        for r in known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect():
            picked.setdefault(r["doc_id"], []).append(y)
    spark = docs.sparkSession
    ids = spark.createDataFrame([(i,) for i in picked], docs.select("doc_id").schema)
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", text.alias("text")).filter(F.octet_length("text") <= most_bytes).join(F.broadcast(ids), "doc_id")
    sample = found.groupBy("doc_id").agg(F.min("text").alias("text")).collect()  # one text of an id, so rows and bytes have bounds
    sample = sorted((r["doc_id"], r["text"]) for r in sample)
    pairs = [(t.encode(), y) for i, t in sample for y in picked[i]]
    return fit([t for t, _ in pairs], [y for _, y in pairs], totals.get(1, 0) / max(1, sum(totals.values())))


def score(df: DataFrame, model: Model, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The kept columns of df (all by default) and score, the probability of the second class. A column score is replaced."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in (keep if keep is not None else df.columns) if c not in ("score", "__text")]
    rows = df.select(*keep, F.col(text_col).alias("__text"))

    def run(batches):
        for b in batches:
            at = b.schema.names.index("__text")
            kept = [c for i, c in enumerate(b.columns) if i != at]
            yield pa.record_batch([*kept, pa.array(shared.value.scores(raw(b.column(at))), pa.float64())], names=[*(n for n in b.schema.names if n != "__text"), "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    return rows.mapInArrow(lean(run), f"{fields}, score double" if fields else "score double")


def remove_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose score is below the threshold; all columns."""
    scored = score(docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("__t")), model, ["row"], "__t")
    return scored.filter(F.col("score") < threshold).select("row.*")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns doc_id, held_out, score, predicted."""
    docs = table(spark, "documents")(sf_dir)
    model = train(docs, table(spark, "labels")(sf_dir))
    return score(docs, model, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
