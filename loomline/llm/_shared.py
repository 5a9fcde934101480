"""Helpers shared by the operators: shared-folder tables, Arrow columns, vectorised word hashing."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import inspect
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Odd 64-bit constants: the start of a word's hash, and the base of Rabin-Karp over words' hashes.
WORD_SEED = np.uint64(0x9E3779B97F4A7C15)
WORD_BASE = np.uint64(0xD1342543DE82EF95)
#: Words of more bytes are hashed one by one.
LONG_WORD = 512

try:
    _TRIM = ctypes.CDLL(None).malloc_trim  # glibc has it
except (OSError, AttributeError):
    _TRIM = None

SPACE = b" \t\n\x0b\x0c\r"
#: True for bytes of words that white space separates.
GRAPHIC = np.array([b not in SPACE for b in range(256)])
#: True for bytes of words made of ASCII letters and digits and everything beyond ASCII.
ALNUM = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def table(spark: SparkSession, name: str):
    """A function from a folder of tables to the table of this name."""
    return lambda sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's checkpoint folder. A temporary one in local mode only."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="loomline-"))
        found = sc.getCheckpointDir()
    return found


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _drop_quietly(spark: SparkSession, path: str) -> None:
    try:
        drop_path(spark, path)
    except Exception:  # the session is gone, and its folder with it  # noqa: BLE001
        pass


def drop_late(spark: SparkSession, path: str) -> None:
    """Frees a path when the process ends."""
    atexit.register(_drop_quietly, spark, path)


def materialise(df: DataFrame, name: str = "t") -> tuple[DataFrame, str]:
    """Writes a table in the shared folder and reads it again: lineage ends there, and lost executors cost no recomputation.

    Returns the table and its path; ``drop_path`` frees it once nothing refers to it, and the end of the process does so in any case.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    drop_late(spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished queries that nothing refers to any more, before the next large one."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tidy() -> None:
    """Gives memory that a Python worker no longer uses back to the system: workers live on, idle, while others work."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def lean(f):
    """A function for mapInArrow or applyInArrow that tidies up when it is done."""
    if inspect.isgeneratorfunction(f):

        def run(batches):
            try:
                yield from f(batches)
            finally:
                tidy()

    elif f.__code__.co_argcount == 1:

        def run(group):
            try:
                return f(group)
            finally:
                tidy()

    else:

        def run(group, other):
            try:
                return f(group, other)
            finally:
                tidy()

    return run


def forget(known: dict, most: int) -> None:
    """Drops the newer half of a memory that has grown too large; the frequent words came first."""
    if len(known) > most:
        for k in list(known)[most // 2 :]:
            del known[k]


def raw(column) -> list[bytes]:
    """The UTF-8 bytes of a string column; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sorted_within(group: np.ndarray, key: np.ndarray, rank: np.ndarray | None = None) -> np.ndarray:
    """The order of rows by group, then rank (below 256), then key. Groups are whole numbers from 0.

    Numbers that hold group, rank, the key's first bits and the row are sorted by value, which is far faster than sorting places;
    rows that those bits don't tell apart are put in order afterwards.
    """
    n = len(key)
    at = max(1, n.bit_length())
    most = max(1, int(group.max(initial=0)).bit_length())
    bits = min(56, 64 - at - most - (8 if rank is not None else 0))
    if n == 0 or bits < 1:
        return np.lexsort((key, group) if rank is None else (key, rank, group))
    whole = group.astype(np.uint64)
    if rank is not None:
        whole = whole << np.uint64(8) | rank.astype(np.uint64)
    whole = (whole << np.uint64(bits) | key >> np.uint64(64 - bits)) << np.uint64(at) | np.arange(n, dtype=np.uint64)
    whole.sort()
    order = (whole & np.uint64((1 << at) - 1)).astype(np.int64)
    head = whole >> np.uint64(at)
    same = head[1:] == head[:-1]
    if same.any():
        tied = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))
        own = order[tied]
        order[tied] = own[np.lexsort((key[own], head[tied]))]
    return order


@functools.lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, np.uint64(base))
    p[0] = 1
    return np.multiply.accumulate(p)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1), modulo 2 ** 64."""
    return _powers(int(base), 1 << max(10, int(n - 1).bit_length()))[:n]


def inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def rolling(codes: np.ndarray, base: np.uint64) -> np.ndarray:
    """Prefix sums P for Rabin-Karp: (P[e] - P[s]) * base ** -s is the hash of codes[s:e], modulo 2 ** 64."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(base, len(codes)) if len(codes) else codes, out=out[1:])
    return out


def rolled(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.uint64) -> np.ndarray:
    back = powers(inverse(base), max(1, len(prefix)))
    return (prefix[end] - prefix[start]) * back[start]


class Words:
    """The words of many texts at once.

    start, end: byte offsets into data; hash: a 64-bit hash of each word's bytes; first: where each text's words begin, one more entry than texts.
    """

    def __init__(self, texts: list[bytes], member: np.ndarray = GRAPHIC, lower: bool = False):
        self.data = data = b"\n".join(texts)
        if lower:
            self.data = data = LOWER[np.frombuffer(data, np.uint8)].tobytes()
        b = np.frombuffer(data, np.uint8)
        inside = np.zeros(len(b) + 2, np.int8)
        inside[1:-1] = member[b]
        edge = np.diff(inside)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        begins = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=begins[1:])
        self.begins = begins
        self.first = np.searchsorted(self.start, begins)
        self._bytes = b

    @functools.cached_property
    def hash(self) -> np.ndarray:
        """Each word's bytes, eight at a time, pass through a bijection that mixes all bits, so no structure of a word survives;
        words of up to eight bytes and equal length never share a hash. All words advance together; the longest are hashed apart."""
        size = self.end - self.start
        padded = np.concatenate([self._bytes, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        mask = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
        h = mix((size.astype(np.uint64) * WORD_SEED) ^ (eight[self.start] & mask[np.minimum(size, 8)]))
        live, k = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
        while len(live):
            left = size[live] - k
            h[live] = mix((h[live] + WORD_BASE) ^ (eight[self.start[live] + k] & mask[np.minimum(left, 8)]))
            live, k = live[left > 8], k + 8
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            h[i] = xxhash.xxh64_intdigest(self.word(i))
        return h

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]]

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First-word indices and hashes of all runs of n words that lie in one text."""
        count = len(self.start)
        if count < n:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        at = np.arange(count - n + 1)
        last = np.repeat(self.first[1:], np.diff(self.first))[: count - n + 1]
        at = at[at + n <= last]
        return at, mix(rolled(self._prefix, at, at + n, WORD_BASE) + np.uint64(n))

    @functools.cached_property
    def _prefix(self) -> np.ndarray:
        return rolling(self.hash, WORD_BASE)
