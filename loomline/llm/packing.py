"""Bulk-synchronous best-fit packing of tokenised documents into sequences of bounded length.

Documents are tokenised, ended with one id, and cut into pieces only if they are longer than a sequence. Lengths are whole
numbers up to the capacity, so range-sorting pieces and gaps leaves at most ``capacity`` distinct lengths and gaps, however
many pieces there are. A superstep takes all pieces of one length, longest first: a sweep finds each gap's successor
matches (the smallest gaps that hold the length, in order), pieces that want the same gap are told apart by their rank, the
gaps shrink, and what found no gap opens new sequences. Pieces of one length and gaps of one size move as runs of ranks, so
the state of the sweeps is a few runs for each length - a bound that does not depend on the data - while ranking the pieces
and placing them in their sequences are distributed. The result equals best-fit decreasing done piece by piece.

Ranks within a length come from counts of (length, hash bucket) pairs and row numbers inside those, so a length that a third
of all pieces share is spread over all buckets.

A null text is empty, and an empty text has the ending id alone. Equal rows are packed separately. Columns other than
the two named ones are not read.
"""

from __future__ import annotations

import bisect
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import Words, forget, lean, materialise, partitions, raw, table

CAPACITY, END_ID = 4096, 1
#: Word encodings that a Python worker remembers at most.
REMEMBER = 300_000


class WordEncoder:
    """Token ids of texts, for tokenizers that lower-case, and whose pre-tokens hold neither white space nor letters beside marks.

    The model must mark the last id of a pre-token with </w>. Each word is encoded once and remembered. New words that are all
    letters are encoded many in one call; a word that ends in marks is its letters' ids, then its marks'. Texts that may name a special token are left to the tokenizer as a whole.
    """

    MARKS = b".,!?;:%$#&*|"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        #: Whether an id ends a pre-token.
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _one_by_one(self, words: list[bytes]) -> None:
        for lo in range(0, len(words), 4096):
            part = words[lo : lo + 4096]
            for word, got in zip(part, self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)):
                self.known[word] = np.array(got.ids, "<u4").tobytes()

    def _together(self, words: list[bytes]) -> None:
        """Words of letters only: each is one pre-token, so the ids that end pre-tokens tell words apart."""
        for lo in range(0, len(words), 1 << 14):
            parts = [words[i : i + 256] for i in range(lo, min(len(words), lo + (1 << 14)), 256)]
            for part, got in zip(parts, self.tokenizer.encode_batch_fast([b" ".join(p).decode() for p in parts], add_special_tokens=False)):
                ids = np.array(got.ids, "<u4")
                ends = (4 * np.flatnonzero(self.last[ids]) + 4).tolist()
                if len(ends) != len(part):
                    self._one_by_one(part)
                    continue
                data = ids.tobytes()
                self.known.update(zip(part, map(data.__getitem__, map(slice, [0, *ends], ends))))

    def _learn(self, new: list[bytes]) -> None:
        known, letters, other, joined = self.known, set(), set(), []
        for w in new:
            base = w.rstrip(self.MARKS)
            if base.isalpha() or base and not base.isascii() and (t := base.decode()).isalpha() and t.lower().isalpha():
                letters.add(base)
                if base != w:
                    other.add(w[len(base) :])
                    joined.append((w, base, w[len(base) :]))
            else:
                other.add(w)
        self._together([w for w in letters if w not in known])
        self._one_by_one([w for w in other if w not in known])
        for w, base, marks in joined:
            known[w] = known[base] + known[marks]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers. Words are told apart by 64-bit hashes, many texts at once."""
        forget(self.known, REMEMBER)
        known, special = self.known, {i for i, t in enumerate(texts) if b"<|" in t}
        w = Words([b"" if i in special else t for i, t in enumerate(texts)], lower=True)
        _, at, of = np.unique(w.hash, return_index=True, return_inverse=True)
        own = [w.word(i) for i in at.tolist()]
        self._learn([x for x in own if x not in known])
        ids = [known[x] for x in own]
        size = np.array([len(x) // 4 for x in ids], np.int64)
        start = np.cumsum(size) - size
        each = size[of]
        ends = np.cumsum(each)
        flat = np.frombuffer(b"".join(ids), "<u4")[np.repeat(start[of] - (ends - each), each) + np.arange(int(each.sum()))]
        cuts = np.concatenate([[0], ends])[w.first].tolist()
        whole = lambda t: np.array(self.tokenizer.encode(t.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        return [whole(t) if i in special else flat[s:e].tobytes() for i, (t, s, e) in enumerate(zip(texts, cuts, cuts[1:]))]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def tokenise(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces: doc_id, piece, start, length, ids_crc32, and the ids themselves if asked for. tokenizer: a file that all executors have."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode = encoder(tokenizer)
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, got in enumerate(encode.encode(raw(part.column(1)))):
                    got += end
                    n = len(got) // 4
                    for k, s in enumerate(range(0, n, capacity)):
                        own = got[4 * s : 4 * (s + capacity)]
                        row.append(i)
                        piece.append(k)
                        start.append(s)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                        if with_ids:
                            ids.append(np.frombuffer(own, "<u4").astype(np.int32))
                out = [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.record_batch([*out, *([pa.array(ids, pa.list_(pa.int32()))] if with_ids else [])], names=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


class Gaps:
    """Runs of sequences by their free space, the smallest first."""

    def __init__(self):
        self.runs: dict[int, list[tuple[int, int]]] = {}
        self.sizes: list[int] = []

    def add(self, gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in self.runs:
                bisect.insort(self.sizes, gap)
                self.runs[gap] = []
            self.runs[gap].append((first, count))

    def successor(self, length: int) -> tuple[int, int, int] | None:
        """Takes out a run with the smallest gap that holds the length: gap, first sequence, sequences."""
        at = bisect.bisect_left(self.sizes, length)
        if at == len(self.sizes):
            return None
        gap = self.sizes[at]
        first, count = self.runs[gap].pop()
        if not self.runs[gap]:
            del self.runs[gap], self.sizes[at]
        return gap, first, count


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Supersteps over piece counts by length, as runs: length, first rank, pieces in a sequence, first sequence, place in the sequence."""
    gaps, runs, sequences = Gaps(), [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            got = gaps.successor(length)
            if got is None:
                each = capacity // length
                got = capacity, sequences, -(-left // each)
                sequences += got[2]
            gap, first, count = got
            each = gap // length
            full, rest = min(count, left // each), 0
            if full < count:
                rest = left - full * each
            if full:
                runs.append((length, rank, each, first, capacity - gap))
                gaps.add(gap - each * length, first, full)
            if rest:
                runs.append((length, rank + full * each, each, first + full, capacity - gap))
                gaps.add(gap - rest * length, first + full, 1)
            used = full + (1 if rest else 0)
            gaps.add(gap, first + used, count - used)
            left -= full * each + rest
            rank += full * each + rest
    return runs


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The columns of pieces with sequence_id and offset. pieces: as tokenise returns them."""
    spark = pieces.sparkSession
    pieces, _ = materialise(pieces, "pieces")
    spread = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(partitions(spark))))
    counts = spread.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    runs = plan(histogram, capacity)
    key = np.array([(r[0] << 44) + r[1] for r in runs], np.int64)
    order = np.argsort(key)
    steps = spark.sparkContext.broadcast((key[order], np.array(runs, np.int64).reshape(-1, 5)[order]))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = spread.withColumn("rn", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")))
    ranked = ranked.join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("rn") - 1).select(*pieces.columns, "rank")

    def place(batches):
        keys, table = steps.value
        for b in batches:
            names = b.schema.names
            length, rank = b.column(names.index("length")).to_numpy(), b.column(names.index("rank")).to_numpy()
            got = table[np.searchsorted(keys, (length << 44) + rank, "right") - 1] if b.num_rows else table[:0]
            step = rank - got[:, 1]
            kept = [b.column(i) for i, n in enumerate(names) if n != "rank"]
            yield pa.record_batch([*kept, pa.array(got[:, 3] + step // got[:, 2]), pa.array(got[:, 4] + step % got[:, 2] * length)], names=[*(n for n in names if n != "rank"), "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(lean(place), f"{fields}, sequence_id long, offset long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(tokenise(table(spark, "documents")(sf_dir), default_tokenizer()))
