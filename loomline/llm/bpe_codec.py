"""Byte-level BPE encoding and decoding with a lexicon of frequent words, compiled into a minimal acyclic transducer.

Words here are the pieces that the tokenizer's own splitting yields, leading space included. They are counted over all
documents; the most frequent ones, at most ``lexicon_words``, are encoded once, compiled into a shared-suffix automaton whose
arcs add up to a word's number, and written as one file to the shared folder. Spark hands the file to every executor, whose
workers map it into memory. All words of a slice of text walk through it together, one byte at a time. Words that it does not
hold are merged exactly: in every word the leftmost pair of least rank is joined, again and again, for all words at once, and
by a heap in words of more than ``WIDE`` bytes. So the lexicon decides about speed only, never about results.

A null text is empty and has no ids; an empty text has none either. Texts of any length are encoded whole, in slices that are
cut before white space, where no word can cross. Equal rows are encoded each on its own, rows keep their order within a
partition, and no two words tie, as the transducer numbers them by their bytes; words of equal counts enter the lexicon all
or none. An empty table gives an empty one. Only the two named columns are read, whatever others are called.
"""

from __future__ import annotations

import functools
import heapq
import json
import os
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import drop_late, lean, materialise, mix, raw, shared_dir, table

#: The most words of a lexicon, the longest of them in bytes, and how many words a counting task holds before it hands them on.
LEXICON, LONGEST, HELD = 1 << 17, 32, 1 << 18
#: Bytes of text that are worked on at once, and the longest words that are merged side by side.
SLICE, WIDE = 1 << 20, 64
NONE = np.iinfo(np.int32).max
#: Classes of characters: letters, numbers, white space, other; then places between texts, and special tokens.
OTHER, LETTER, NUMBER, SPACE, BETWEEN, SPECIAL, UNKNOWN = range(7)
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


def same_words(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One word of each set of equal words of up to 15 bytes, and every longer word; and which of these each word is.

    Words are gathered by a hash of two numbers that hold all their bytes and their size, then compared by the numbers themselves.
    """
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    mask = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    low = eight[start] & mask[np.minimum(size, 8)]
    high = (eight[np.minimum(start + 8, len(eight) - 1)] & mask[np.clip(size - 8, 0, 7)]) | (np.minimum(size, 255).astype(np.uint64) << np.uint64(56))
    _, first, of = np.unique(mix(low) ^ (high * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_inverse=True)
    alone = np.flatnonzero((size > 15) | (low[first[of]] != low) | (high[first[of]] != high))
    of[alone] = len(first) + np.arange(len(alone))
    return np.concatenate([first, alone]), of


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies, and back."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE file: the bytes of each id, the merges, the special tokens, and how the library classes characters."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._split = Tokenizer.from_file(path).pre_tokenizer
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        if file["model"]["type"] != "BPE" or (file["pre_tokenizer"] or {}).get("type") != "ByteLevel" or file["normalizer"] or file["pre_tokenizer"].get("add_prefix_space") or not file["pre_tokenizer"].get("use_regex", True):
            raise ValueError(f"{path} is no byte-level BPE without a prefix space")
        letters = byte_letters()
        ids = file["model"]["vocab"]
        self.specials = {t["content"]: t["id"] for t in file["added_tokens"]}
        size = 1 + max([*ids.values(), *self.specials.values()])
        of = [b""] * size
        for token, i in ids.items():
            of[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        for token, i in self.specials.items():
            of[i] = token.encode()
        self.bytes_of = of
        self.size = np.array([len(b) for b in of], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(of), np.uint8)
        self.byte_id = np.array([ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]]
        left, right = (np.array([ids[m[k]] for m in merges], np.int64) for k in (0, 1))
        #: By rank of a merge: the id that it makes.
        self.made = np.array([ids[a + b] for a, b in merges] or [0], np.int32)
        self._table(left * size + right)
        self.kind = np.full(0x110000, UNKNOWN, np.uint8)
        self.special = re.compile("|".join(re.escape(t) for t in sorted(self.specials, key=len, reverse=True)).encode()) if self.specials else None

    def _table(self, keys: np.ndarray) -> None:
        """Ranks by pair, in an open table that many pairs are looked up in at once."""
        self._bits = max(10, int(4 * len(keys) + 1).bit_length())
        self._key, self._rank = np.full(1 << self._bits, -1, np.int64), np.full(1 << self._bits, NONE, np.int32)
        at, rank = self._place(keys), np.arange(len(keys), dtype=np.int32)
        while len(rank):  # of the keys that want one place, the first by rank gets it, the others move on
            free = np.flatnonzero(self._key[at] < 0)
            place, first = np.unique(at[free], return_index=True)
            self._key[place], self._rank[place] = keys[rank[free[first]]], rank[free[first]]
            left = np.ones(len(rank), bool)
            left[free[first]] = False
            at, rank = (at[left] + 1) & ((1 << self._bits) - 1), rank[left]

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; NONE where no merge joins them or an id is negative."""
        out = np.full(left.shape, NONE, np.int32)
        live = np.flatnonzero(((left >= 0) & (right >= 0)).ravel())
        keys = left.ravel()[live].astype(np.int64) * len(self.size) + right.ravel()[live]
        at, flat = self._place(keys), out.reshape(-1)
        while len(live):
            found = self._key[at]
            hit = found == keys
            flat[live[hit]] = self._rank[at[hit]]
            on = ~hit & (found >= 0)
            live, keys, at = live[on], keys[on], (at[on] + 1) & ((1 << self._bits) - 1)
        return out

    def classes(self, points: np.ndarray) -> np.ndarray:
        """Classes of characters, as the library's own splitting tells them: its Unicode tables, not Python's."""
        kind = self.kind[points]
        if (kind == UNKNOWN).any():
            for c in np.unique(points[kind == UNKNOWN]).tolist():
                alone = lambda before: len(self._split.pre_tokenize_str(before + chr(c))) == 1
                self.kind[c] = LETTER if alone("x") else NUMBER if alone("1") else OTHER if alone("!") else SPACE
            kind = self.kind[points]
        return kind

    def merge_wide(self, word: bytes) -> np.ndarray:
        """The ids of one long word: a heap of pairs by rank and place over a chain of ids."""
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        after, before = [*range(1, len(ids)), -1], list(range(-1, len(ids) - 1))
        first = self.ranks(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        n = len(self.size)
        known: dict[int, int] = {}

        def offer(i: int, j: int) -> None:
            key = ids[i] * n + ids[j]
            if key not in known:
                known[key] = int(self.ranks(np.array([ids[i]]), np.array([ids[j]]))[0])
            if known[key] != NONE:
                heapq.heappush(heap, (known[key], i, ids[i], ids[j]))

        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = int(self.made[rank]), -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
                offer(i, after[j])
            if before[i] >= 0:
                offer(before[i], i)
        return np.array([x for x in ids if x >= 0], np.int32)

    def merge(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many words: how many each has, and all of them in a row. Equal words are merged once."""
        if len(start) < 256:
            return self._merge(data, start, size)
        first, of = same_words(data, start, size)
        count, ids = self._merge(data, start[first], size[first])
        at = np.cumsum(count) - count
        return count[of], ids[spread(at[of], count[of])]

    def _merge(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count, parts = np.zeros(len(start), np.int64), []
        low = 0
        for width in (1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 24, 32, WIDE):
            own = np.flatnonzero((size > low) & (size <= width))
            low = width
            for lo in range(0, len(own), 1 << 14):
                some = own[lo : lo + (1 << 14)]
                count[some], ids = self._side_by_side(data, start[some], size[some], width)
                parts.append((some, ids))
        memory: dict[bytes, np.ndarray] = {}
        for i in np.flatnonzero(size > WIDE).tolist():
            word = data[start[i] : start[i] + size[i]].tobytes()
            if word not in memory:
                memory[word] = self.merge_wide(word)
            count[i] = len(memory[word])
            parts.append((np.array([i]), memory[word]))
        out, at = np.empty(int(count.sum()), np.int32), np.cumsum(count) - count
        for some, ids in parts:
            out[spread(at[some], count[some])] = ids
        return count, out

    def _side_by_side(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Words of at most width bytes as columns of a matrix. A round joins each column's uppermost pair of least rank."""
        line = np.arange(width, dtype=np.int8)[:, None]
        ids = np.full((width + 1, len(start)), -1, np.int32)
        ids[:-1] = np.where(line < size.astype(np.int8), self.byte_id[data[np.minimum(start + np.arange(width)[:, None], len(data) - 1)]], -1)
        rank = self.ranks(ids[:-1], ids[1:])
        done, column = np.full((len(start), width), -1, np.int32), np.arange(len(start))
        while len(column):
            j = rank.argmin(0)
            best = rank[j, np.arange(len(column))]
            on = best != NONE
            if on.sum() < 0.8 * len(on):  # columns without a pair go once they are many
                done[column[~on]] = ids[:-1, ~on].T
                column, ids, rank, j, best = column[on], ids[:, on], rank[:, on], j[on], best[on]
                on = np.ones(len(column), bool)
            if not len(column):
                break
            after = line >= np.where(on, j, width).astype(np.int8)
            rank[:-1] = np.where(after[:-1], rank[1:], rank[:-1])
            after[np.where(on, j, 0), np.arange(len(column))] = False
            ids[:-1] = np.where(after, ids[1:], ids[:-1])
            at = np.flatnonzero(on)
            j = j[at]
            ids[j, at] = self.made[best[at]]
            rank[-1, at] = NONE
            rank[j, at] = self.ranks(ids[j, at], ids[j + 1, at])
            at, j = at[j > 0], j[j > 0]
            rank[j - 1, at] = self.ranks(ids[j - 1, at], ids[j, at])
        return (done >= 0).sum(1), done[done >= 0]

    def unite(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for."""
        return self.flat[spread(self.start[ids], self.size[ids])].tobytes()


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Pieces:
    """Words of many texts: byte offsets into data, the special id of a word or -1, and first, where each text's words begin."""

    def __init__(self, vocab: Vocabulary, texts: list[bytes], specials: bool = True):
        segments, owner, special = [], [], []
        for i, t in enumerate(texts):
            at = 0
            for m in vocab.special.finditer(t) if specials and vocab.special else ():
                segments += [t[at : m.start()], m.group()]
                special += [-1, vocab.specials[m.group().decode()]]
                owner += [i, i]
                at = m.end()
            segments.append(t[at:])
            special.append(-1)
            owner.append(i)
        joined = b"\n".join(segments) + b"\n"
        self.data = np.frombuffer(joined, np.uint8)
        ends = np.cumsum([len(s) + 1 for s in segments]) - 1
        if joined.isascii():
            points, place, gaps = self.data, None, ends
        else:
            points = np.frombuffer(joined.decode().encode("utf-32-le"), np.uint32)
            place = np.zeros(len(points) + 1, np.int64)
            np.cumsum(1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000), out=place[1:])
            gaps = np.searchsorted(place, ends)
        kind = vocab.classes(points).copy()
        kind[gaps] = BETWEEN
        marked = [k for k, x in enumerate(special) if x >= 0]
        for k in marked:
            kind[gaps[k - 1] + 1 : gaps[k]] = SPECIAL
        n = len(kind)
        begins = np.ones(n, bool)
        begins[1:] = kind[1:] != kind[:-1]
        # white space before a word gives its last character away: a plain space goes with the word, another stands alone
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & (kind[1:] != BETWEEN)) if n else np.empty(0, np.int64)
        begins[last] = True
        begins[last[points[last] == 32] + 1] = False
        # contractions, where no space goes with the apostrophe
        quote = np.flatnonzero((points == 39) & begins)
        for c in CONTRACTIONS:
            q = quote[quote + len(c) < n]
            for k, letter in enumerate(c, 1):
                q = q[points[q + k] == ord(letter)]
            begins[q + 1] = False
            begins[q + len(c) + 1] = True
            quote = np.setdiff1d(quote, q, assume_unique=True)
        at = np.flatnonzero(begins)
        end = np.append(at[1:], n)
        is_word = kind[at] != BETWEEN
        at, end = at[is_word], end[is_word]
        segment = np.searchsorted(gaps, at)
        self.special = np.array(special, np.int32)[segment]
        self.start, self.end = (at, end) if place is None else (place[at], place[end])
        self.first = np.searchsorted(np.array(owner)[segment], np.arange(len(texts) + 1))


class Lexicon:
    """A minimal acyclic transducer from words to their ids, as arrays in one buffer or mapped file.

    A state's arcs stand in cells base + byte, which check names as its own; target is the next state, add what the arc adds to a word's number, final whether
    a word ends there. The ids of word number r are ids[first[r]:first[r + 1]].
    """

    KINDS = {"base": np.int32, "final": np.uint8, "check": np.int32, "target": np.int32, "add": np.int32, "first": np.int64, "ids": np.int32}

    def __init__(self, buffer):
        head = np.frombuffer(buffer, np.int64, len(self.KINDS))
        at = head.nbytes
        for (name, kind), n in zip(self.KINDS.items(), head.tolist()):
            setattr(self, name, np.frombuffer(buffer, kind, n, at))
            at += -(-n * np.dtype(kind).itemsize // 8) * 8

    @classmethod
    def compile(cls, words: dict[bytes, list[int]]) -> bytes:
        """Words in the order of their bytes join one at a time; what the next word can't reach any more is merged with an equal state."""
        names = sorted(words)
        register: dict[tuple, int] = {}
        states: list[tuple] = []  # (final, ((byte, state), ...)), targets before sources
        path: list[list] = [[False, []]]  # states of the last word that may still grow

        def freeze(depth: int) -> None:
            while len(path) > depth:
                final, arcs = path.pop()
                key = (final, tuple(arcs))
                if key not in register:
                    register[key] = len(states)
                    states.append(key)
                path[-1][1].append((last[len(path) - 1], register[key]))

        last = b""
        for w in names:
            shared = len(os.path.commonprefix([last, w]))
            freeze(shared + 1)
            path += [[False, []] for _ in w[shared:]]
            path[-1][0] = True
            last = w
        freeze(1)
        states.append((path[0][0], tuple(path[0][1])))
        below = np.zeros(len(states), np.int64)  # words that end at or below a state
        for s, (final, arcs) in enumerate(states):
            below[s] = final + sum(below[t] for _, t in arcs)
        # cells: states of many arcs look for the first base where all fit, those of one arc fill the rest
        busy = np.zeros(256 + sum(len(a) for _, a in states) * 2 + 65536, bool)
        base, low = np.zeros(len(states), np.int64), 256
        for s in sorted(range(len(states)), key=lambda s: -len(states[s][1])):
            labels = np.array([b for b, _ in states[s][1]], np.int64)
            if not len(labels):
                continue
            found, at = -1, low - 256
            while found < 0:
                if at + 5000 > len(busy):
                    busy = np.concatenate([busy, np.zeros(len(busy), bool)])
                ok = ~busy[at + labels[0] : at + labels[0] + 4096]
                for b in labels[1:].tolist():
                    ok &= ~busy[at + b : at + b + 4096]
                found = at + int(ok.argmax()) if ok.any() else -1
                at += 4096
            base[s] = found
            busy[found + labels] = True
            while busy[low]:
                low += 1
        size = int(base.max(initial=0)) + 256
        check, target, add = np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(size, np.int32)
        for s, (final, arcs) in enumerate(states):
            before = int(final)
            for b, t in arcs:
                check[base[s] + b], target[base[s] + b], add[base[s] + b] = s, t, before
                before += int(below[t])
        first = np.cumsum([0, *(len(words[w]) for w in names)])
        arrays = [base, [f for f, _ in states], check, target, add, first, [i for w in names for i in words[w]]]
        out = [np.array([len(a) for a in arrays], np.int64).tobytes()]
        for a, kind in zip(arrays, cls.KINDS.values()):
            data = np.asarray(a).astype(kind).tobytes()
            out.append(data + b"\0" * (-len(data) % 8))
        return b"".join(out)

    def numbers(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Each word's number, -1 where the lexicon lacks it. All words take a byte at a time together."""
        out = np.full(len(start), -1, np.int64)
        live = np.flatnonzero((size > 0) & (size <= LONGEST))
        state, number = np.full(len(live), len(self.base) - 1, np.int32), np.zeros(len(live), np.int32)
        for k in range(LONGEST + 1):
            ends = size[live] == k
            good = ends & (self.final[state] == 1)
            out[live[good]] = number[good]
            live, state, number = live[~ends], state[~ends], number[~ends]
            if not len(live):
                break
            cell = self.base[state] + data[start[live] + k]
            known = self.check[cell] == state
            live, cell, number = live[known], cell[known], number[known]
            state, number = self.target[cell], number + self.add[cell]
        return out


@functools.lru_cache(maxsize=4)
def mapped(name: str) -> Lexicon:
    """The lexicon file that Spark brought here, mapped into memory: all workers of a machine share its pages."""
    return Lexicon(np.memmap(SparkFiles.get(name), np.uint8, "r"))


def encode_texts(vocab: Vocabulary, texts: list[bytes], lexicon: Lexicon | None = None, specials: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The ids of many texts in a row, and where each text's begin, one more entry than texts."""
    p = Pieces(vocab, texts, specials)
    size = p.end - p.start
    count, found = np.zeros(len(size), np.int64), p.special >= 0
    count[found] = 1
    number = np.where(found, -1, lexicon.numbers(p.data, p.start, size)) if lexicon is not None else np.full(len(size), -1)
    known = np.flatnonzero(number >= 0)
    if len(known):
        count[known] = np.diff(lexicon.first)[number[known]]
    rest = np.flatnonzero(~found & (number < 0))
    count[rest], merged = vocab.merge(p.data, p.start[rest], size[rest])
    ends = np.cumsum(count)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
    at = ends - count
    out[at[found]] = p.special[found]
    out[spread(at[rest], count[rest])] = merged
    if len(known):
        out[spread(at[known], count[known])] = lexicon.ids[spread(lexicon.first[number[known]], count[known])]
    return out, np.concatenate([[0], ends])[p.first]


#: A word's last ASCII letter or digit, and white space: what comes before it can be split apart from what follows.
CUT = re.compile(rb"[0-9A-Za-z](?=[ \n])")


def slices(texts: list[bytes], most: int = SLICE):
    """Lists of (row, part of its text) of about most bytes; longer texts are cut where no word can cross."""
    held, size = [], 0
    for i, t in enumerate(texts):
        lo = 0
        while len(t) - lo > most and (m := CUT.search(t, lo + most)):
            held.append((i, t[lo : m.end()]))
            yield held
            held, size, lo = [], 0, m.end()
        held.append((i, t[lo:]))
        size += len(t) - lo
        if size > most:
            yield held
            held, size = [], 0
    if held:
        yield held


def count_words(df: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """word (its bytes) and n: how often it occurs in all texts. Words of more than LONGEST bytes are left out."""

    def run(batches):
        vocab, held = vocabulary(tokenizer), {}

        def out():
            return pa.record_batch([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for part in slices(raw(b.column(0))):
                p = Pieces(vocab, [t for _, t in part])
                data, size = p.data.tobytes(), p.end - p.start
                some = (size <= LONGEST) & (p.special < 0)
                for w in map(data.__getitem__, map(slice, p.start[some].tolist(), p.end[some].tolist())):
                    held[w] = held.get(w, 0) + 1
                if len(held) > HELD:
                    yield out()
                    held.clear()
        yield out()

    return df.select(text_col).filter(F.length(text_col) > 0).mapInArrow(lean(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> list[bytes]:
    """The most frequent words, at most ``most``: all that occur as often as a bound which a histogram of fixed size tells."""
    bin_of = F.floor(F.log2("n") * 64)
    seen = sorted(((r["bin"], r["words"]) for r in counts.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("words")).collect()), reverse=True)
    total, least = 0, None
    for b, words in seen:
        total += words
        if total > most:
            break
        least = b
    return [] if least is None else [bytes(r["word"]) for r in counts.filter(bin_of >= F.lit(least)).select("word").collect()]


def build_lexicon(df: DataFrame, tokenizer: str, lexicon_words: int = LEXICON, text_col: str = "text") -> str:
    """Compiles the frequent words of a table; returns the name of the file that every executor is handed.

    The driver sees at most lexicon_words words of at most LONGEST bytes.
    """
    spark = df.sparkSession
    counts, _ = materialise(count_words(df, tokenizer, text_col).filter("n > 1"), "words")
    words = frequent(counts, lexicon_words)
    vocab = vocabulary(tokenizer)
    data = np.frombuffer(b"".join(words) + b"\0", np.uint8)
    size = np.array([len(w) for w in words], np.int64)
    count, ids = vocab.merge(data, np.cumsum(size) - size, size)
    cuts = np.cumsum(count)[:-1] if len(count) else []
    blob = Lexicon.compile(dict(zip(words, (x.tolist() for x in np.split(ids, cuts))))) if words else Lexicon.compile({})
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = f"{shared_dir(spark)}/{name}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    file = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    file.write(blob)
    file.close()
    spark.sparkContext.addFile(path)
    drop_late(spark, path)
    return name


def encode(df: DataFrame, tokenizer: str, lexicon: str | None = None, id_col: str = "doc_id", text_col: str = "text", specials: bool = True) -> DataFrame:
    """doc_id and ids, little-endian unsigned 32-bit numbers, of every row. lexicon: a name that build_lexicon gave, or none.

    specials: whether the strings of special tokens inside texts become their ids, as the library does by default.
    """

    def run(batches):
        vocab, lex = vocabulary(tokenizer), mapped(lexicon) if lexicon else None
        for b in batches:
            texts, base, open_row = raw(b.column(1)), 0, []
            for part in slices(texts):
                ids, first = encode_texts(vocab, [t for _, t in part], lex, specials)
                got = [ids[s:e].astype("<u4").tobytes() for s, e in zip(first, first[1:])]
                rows: dict[int, list[bytes]] = {}
                for (i, _), x in zip(part, got):
                    rows.setdefault(i, []).append(x)
                open_row += rows.pop(base, [])
                whole = part[-1][0]
                done = []
                if whole > base:  # a text may go on in the next slice: only what lies before the last one is whole
                    done = [b"".join(open_row), *(b"".join(rows[i]) for i in range(base + 1, whole))]
                    open_row = rows[whole]
                    yield pa.record_batch([b.column(0).slice(base, len(done)), pa.array(done, pa.binary())], names=["doc_id", "ids"])
                    base = whole
            if texts:
                yield pa.record_batch([b.column(0).slice(base, 1), pa.array([b"".join(open_row)], pa.binary())], names=["doc_id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), f"doc_id {kind}, ids binary")


def decode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, ids and text: what the ids stand for, special tokens included; bytes that are no UTF-8 become U+FFFD. Null ids stand for nothing."""

    def run(batches):
        vocab = vocabulary(tokenizer)
        for b in batches:
            held, lo, size = [], 0, 0
            for i, x in enumerate(raw(b.column(1))):
                held.append(vocab.unite(np.frombuffer(x, "<u4")).decode("utf-8", "replace"))
                size += len(x)
                if size > 2 * SLICE or i + 1 == b.num_rows:
                    own = b.slice(lo, len(held))
                    yield pa.record_batch([own.column(0), own.column(1), pa.array(held, pa.string())], names=["doc_id", "ids", "text"])
                    held, lo, size = [], i + 1, 0

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("binary").alias("ids")).mapInArrow(lean(run), f"doc_id {kind}, ids binary, text string")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op11_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns doc_id, n_tokens, ids_sha256, decoded_sha256."""
    docs, tokenizer = table(spark, "documents")(sf_dir), default_tokenizer()
    both = decode(encode(docs, tokenizer, build_lexicon(docs, tokenizer)), tokenizer)
    return both.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
