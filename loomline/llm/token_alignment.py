"""Alignment of the tokens that two tokenizers make of the same bytes.

Tokenizer A is a byte-level BPE, B a sentence-piece BPE with byte fallback that puts a space before a text, so A gets the text with
a space before it. Both sequences tile the same bytes. The ends and starts of B's tokens are a static interval index: bisecting it with A's
tokens' byte ranges (stabbing queries) lists the B tokens that each A token overlaps. A gap between tokens that no token of the
other side spans bounds a group. All texts of a slice are one long interval index, as texts end in gaps of both sides.

How many documents hold an overlapping pair of ids linked is counted over the whole corpus. Documents are dealt to chunks of about ``CHUNK``
bytes of text as they are read. A chunk lists its distinct pairs once, each with its number of documents, so a pair that every document holds is
one row for each chunk; a window adds them up per pair, and the sums go back to the chunks, where the documents' pairs wait as packed
numbers of places in the chunk's list. The highest count of an A id is one number for each id of the vocabulary, which bounds what is broadcast.

Texts that are null or empty, or whose joined bytes on either side differ from space and text (normalisation, pieces for white space
letters), have no tokens: zeros and an empty string. Special tokens' strings are plain text. Ties: every pair with the
highest count of its A id is best. Repeated rows and ids count as documents of their own. Texts of any length are aligned whole; a text
is never split, so a chunk may be as large as one text. An empty table gives an empty one. Only the two named columns are read.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe_codec
from ._shared import lean, materialise, raw, table
from .bpe_codec import spread

#: Bytes of text in a chunk and in a slice, where it holds more than one text.
CHUNK, SLICE = 1 << 25, 1 << 20
FACTS = ("n_a", "n_b", "n_groups", "n_links")


class PieceModel:
    """A sentence-piece model: ids of texts, and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self._model
        of = [bytes([int(m.id_to_piece(i)[3:-1], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode() for i in range(m.get_piece_size())]
        self.size = np.array([len(b) for b in of], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(of), np.uint8)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many texts in a row, and where each text's begin, one more entry than texts."""
        got = self._model.encode(texts, num_threads=1)
        first = np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int64)
        return np.fromiter((i for x in got for i in x), np.int32, int(first[-1])), first


@functools.lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


@functools.lru_cache(maxsize=4)
def decimals(size: int) -> list[str]:
    """Decimal numbers with each of the marks that may follow: comma, bar, semicolon."""
    return [f"{i}{mark}" for mark in (",", "|", ";") for i in range(size)]


class Alignment:
    """Tokens of A and B over the same texts: ids, first (where each text's begin), groups of both sides, and links as pairs of places."""

    def __init__(self, ids_a, first_a, size_a, ids_b, first_b, size_b):
        self.ids_a, self.first_a, self.ids_b, self.first_b = ids_a, first_a, ids_b, first_b
        end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
        start_a, start_b = end_a - size_a, end_b - size_b
        low, high = np.searchsorted(end_b, start_a, "right"), np.searchsorted(start_b, end_a, "left")
        self.link_a, self.link_b = np.repeat(np.arange(len(ids_a)), high - low), spread(low, high - low)
        closes = np.zeros(len(ids_a), bool)
        if len(ids_a):
            closes = end_b[high - 1] == end_a
        closes_b = np.zeros(len(ids_b), bool)
        closes_b[high[closes] - 1] = True
        #: The group of each token, counted through all texts, and the first group of each text.
        self.group_a, self.group_b = np.cumsum(closes) - closes, np.cumsum(closes_b) - closes_b
        self.first_group = np.concatenate([[0], np.cumsum(closes)])[first_a]
        self.first_link = np.searchsorted(self.link_a, first_a)
        self._closes_a, self._closes_b = closes, closes_b

    def group_texts(self, vocabulary_size: int) -> list[str]:
        """a1,a2|b1;a3|b2,b3 for each text."""
        per_a, per_b = np.bincount(self.group_a, minlength=1), np.bincount(self.group_b, minlength=1)
        at_a = np.arange(len(self.ids_a)) + (np.cumsum(per_b) - per_b)[self.group_a] if len(self.ids_a) else np.empty(0, np.int64)
        at_b = np.arange(len(self.ids_b)) + np.cumsum(per_a)[self.group_b] if len(self.ids_b) else np.empty(0, np.int64)
        key = np.empty(len(at_a) + len(at_b), np.int64)
        key[at_a] = self.ids_a + vocabulary_size * self._closes_a
        key[at_b] = self.ids_b + 2 * vocabulary_size * self._closes_b
        text = list(map(decimals(vocabulary_size).__getitem__, key.tolist()))
        first = (self.first_a + self.first_b).tolist()
        return ["".join(text[s:e])[:-1] for s, e in zip(first, first[1:])]


def align_texts(vocab: bpe_codec.Vocabulary, model: PieceModel, texts: list[bytes]) -> tuple[Alignment, np.ndarray]:
    """The alignment of many texts, and which of them have tokens; the others have none in it."""
    spaced = [b" " + t if t else b"" for t in texts]
    sides = []
    for coder, (ids, first) in ((vocab, bpe_codec.encode_texts(vocab, spaced, specials=False)), (model, model.encode([t.decode() for t in texts]))):
        size = coder.size[ids]
        data = coder.flat[spread(coder.start[ids], size)].tobytes()
        cuts = np.concatenate([[0], np.cumsum(size)])[first].tolist()
        sides.append((ids, first, size, [data[s:e] == t for s, e, t in zip(cuts, cuts[1:], spaced)]))
    good = np.array([bool(t) for t in texts], bool) & np.array(sides[0][3], bool) & np.array(sides[1][3], bool)
    out = []
    for ids, first, size, _ in sides:
        count = np.diff(first)
        keep = np.repeat(good, count)
        out += [ids[keep], np.concatenate([[0], np.cumsum(np.where(good, count, 0))]), size[keep]]
    return Alignment(*out), good


def pack(numbers: np.ndarray, step: bool) -> bytes:
    """Numbers below 2 ** 32 in few bytes; step: they rise, so their steps are kept."""
    if step:
        numbers = np.diff(numbers, prepend=0)
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T  # low bytes first, then higher ones, mostly zero
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, step: bool) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    numbers = np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)
    return np.cumsum(numbers) if step else numbers


def aligned(df: DataFrame, tokenizer: str, pieces: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, with_groups: bool = False) -> DataFrame:
    """A row for each document, and one for each chunk of them.

    chunk; doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and groups if asked for; place and times: packed places of the document's pairs in
    its chunk's list, and how often it links each. The chunk's own row (n_a is null) has pairs, A id * 2 ** 32 + B id, rising, and docs, each one's number of documents.
    """
    names = ["chunk", "doc_id", *FACTS, "groups_sha256", "place", "times", "pairs", "docs", *(["groups"] if with_groups else [])]
    kind = df.schema[id_col].dataType.simpleString()
    kinds = ["long", kind, *["long"] * 4, "string", "binary", "binary", "array<long>", "array<int>", *(["string"] if with_groups else [])]

    def run(batches):
        vocab, model = bpe_codec.vocabulary(tokenizer), piece_model(pieces)
        base, width = TaskContext.get().partitionId() << 32, max(len(vocab.size), len(model.size))
        number, held, size = 0, [], 0

        def close():
            """The chunk's rows: its slices hold doc ids, facts, and for each document's distinct pairs its row, key and times."""
            key = np.concatenate([k for _, _, _, k, _ in held])
            pairs, docs = np.unique(key, return_counts=True)
            for ids, facts, rows, own, times in held:
                place = np.searchsorted(pairs, own)
                cuts = np.searchsorted(rows, np.arange(len(ids) + 1)).tolist()
                packed = [[pack(place[s:e], True) for s, e in zip(cuts, cuts[1:])], [pack(times[s:e], False) for s, e in zip(cuts, cuts[1:])]]
                n, null = len(ids), lambda t: pa.nulls(len(ids), t)
                columns = [pa.array(np.full(n, base + number)), ids, *(pa.array(f) for f in facts[:5]), *(pa.array(x, pa.binary()) for x in packed), null(pa.list_(pa.int64())), null(pa.list_(pa.int32()))]
                yield pa.record_batch([*columns, *([pa.array(facts[5])] if with_groups else [])], names=names)
            none = [pa.nulls(1, t) for t in (held[0][0].type, *[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary())]
            own = [pa.array([pairs], pa.list_(pa.int64())), pa.array([docs], pa.list_(pa.int32()))]
            yield pa.record_batch([pa.array([base + number], pa.int64()), *none, *own, *([pa.nulls(1, pa.string())] if with_groups else [])], names=names)

        for b in batches:
            texts, lo = raw(b.column(1)), 0
            while lo < len(texts):
                hi, n = lo, 0
                while hi < len(texts) and (hi == lo or n + len(texts[hi]) <= SLICE):
                    n, hi = n + len(texts[hi]), hi + 1
                a, _ = align_texts(vocab, model, texts[lo:hi])
                told = a.group_texts(width)
                sha = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in told]
                facts = [*(np.diff(x) for x in (a.first_a, a.first_b, a.first_group, a.first_link)), sha, told if with_groups else None]
                row = np.repeat(np.arange(hi - lo), np.diff(a.first_link))
                key = a.ids_a[a.link_a].astype(np.int64) * len(model.size) + a.ids_b[a.link_b]
                both, times = np.unique(row * (len(vocab.size) * len(model.size)) + key, return_counts=True)
                row, key = np.divmod(both, len(vocab.size) * len(model.size))
                one, other = np.divmod(key, len(model.size))
                held.append((b.column(0).slice(lo, hi - lo), facts, row, one << 32 | other, times))
                size, lo = size + n, hi
                if size >= chunk:
                    yield from close()
                    number, held, size = number + 1, [], 0
        if held:
            yield from close()

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


def pair_counts(found: DataFrame) -> DataFrame:
    """chunk, pair, total: in how many documents of the corpus each of a chunk's pairs is linked."""
    listed = found.filter("n_a is null").select("chunk", F.explode(F.arrays_zip("pairs", "docs")).alias("x")).select("chunk", F.col("x.pairs").alias("pair"), F.col("x.docs").alias("docs"))
    return listed.select("chunk", "pair", F.sum("docs").over(Window.partitionBy("pair")).alias("total"))


def scores(found: DataFrame, totals: DataFrame) -> DataFrame:
    """The documents of aligned() with n_best and count_sum. totals: what pair_counts() gave, materialised."""
    a_id = F.shiftright("pair", 32)
    highest = totals.groupBy(a_id.alias("a")).agg(F.max("total").alias("most")).collect()  # a row for each id of A's vocabulary at most
    most = np.zeros(1 + max((r["a"] for r in highest), default=0), np.int64)
    most[[r["a"] for r in highest]] = [r["most"] for r in highest]
    shared = found.sparkSession.sparkContext.broadcast(most)
    kind = found.schema["doc_id"].dataType.simpleString()

    def score(docs: pa.Table, counts: pa.Table) -> pa.Table:
        pair, total = counts["pair"].to_numpy(), counts["total"].to_numpy()
        order = np.argsort(pair)
        pair, total = pair[order], total[order]
        best = total == shared.value[pair >> 32]
        n_best, count_sum = [], []
        for place, times in zip(docs["place"], docs["times"]):
            at, n = unpack(place.as_py(), True), unpack(times.as_py(), False)
            n_best.append(int(n[best[at]].sum()))
            count_sum.append(int((n * total[at]).sum()))
        return pa.table([*(docs[n] for n in ("doc_id", *FACTS, "groups_sha256")), pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())], names=["doc_id", *FACTS, "groups_sha256", "n_best", "count_sum"])

    docs = found.filter("n_a is not null").select("chunk", "doc_id", *FACTS, "groups_sha256", "place", "times")
    return docs.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(lean(score), f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")


def align(df: DataFrame, tokenizer: str, pieces: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum of every row."""
    found, _ = materialise(aligned(df, tokenizer, pieces, id_col, text_col, chunk), "aligned")
    totals, _ = materialise(pair_counts(found), "pairs")
    return scores(found, totals)


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    found = align(table(spark, "documents")(sf_dir), bpe_codec.default_tokenizer(), default_pieces())
    return found.select("doc_id", *FACTS, "n_best", "count_sum", "groups_sha256")
