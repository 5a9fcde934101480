"""Line dedup where words are hot, columns clash, ids are texts, and words are built to fool polynomial hashes."""

import random

from loomline.llm import line_dedup
from loomline.llm._shared import Words


def brute(rows, threshold=0.8):
    seen, want = [], []
    for i, text in rows:
        gone = []
        for no, words in enumerate(set(x.split()) for x in text.split("\n")):
            if words and any(len(words & o) >= threshold * len(words | o) for o in seen):
                gone.append(no)
            if words:
                seen.append(words)
        want.append((i, gone))
    return want


def corpus(n):
    rng = random.Random(8)
    line = lambda: " ".join(f"w{rng.randrange(14)}" for _ in range(rng.randint(4, 14)))
    return [(k, "\n".join(line() for _ in range(rng.randint(1, 3)))) for k in range(n)]


def test_hot_words_are_compared_in_squares(spark, monkeypatch):
    rows = corpus(50)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    keyed = line_dedup._keyed(frame, "doc_id", "text")
    for hot, nearest, wide in ((3, 1, 1), (7, 4, 256)):
        monkeypatch.setattr(line_dedup, "WIDE", wide)
        got = {r.doc: r.removed for r in line_dedup.removed_lines(keyed, hot=hot, nearest=nearest).collect()}
        assert got == {i: g for i, g in brute(rows) if g}


def test_clashing_columns_and_text_ids(spark):
    rows = [("b", "one two three\nfour five six"), ("a", "one two three"), ("7", "four five six"), ("12", "seven eight nine")]
    frame = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in rows], "doc_id string, text string, doc int, tie int, removed int, `line.no` int")
    out = line_dedup.keep_lines(frame)
    assert out.columns == frame.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got["7"] == "four five six" and got["12"] == "seven eight nine"  # ids that are no numbers count as null, and sort last
    assert sorted(x for i in ("a", "b") for x in got[i].split("\n") if x) == ["one two three"]


def test_structured_words_have_their_own_hashes():
    one = bytes(97 + bin(i).count("1") % 2 for i in range(2048))
    other = bytes(98 - bin(i).count("1") % 2 for i in range(2048))
    assert len(set(Words([one + b" " + other, b"a " + b"b" * 600 + b" " + b"b" * 601, b"abcdefgh abcdefghi abcdefghj"]).hash.tolist())) == 8
