"""Token alignment against plain loops over the libraries' tokens."""

import hashlib
import random
from collections import Counter

import sentencepiece
from tokenizers import Tokenizer

from loomline.llm import bpe_codec, token_alignment

A, B = bpe_codec.default_tokenizer(), token_alignment.default_pieces()
PARTS = ["a", "the", " the", " ", "  ", "\n", "é", "ß", "日本", "12", "!", "...", "<|endoftext|>", "<s>", "🙂", "ing", "▁", "ﬁ", "\x00", "thing", " of", ",", "　"]


def brute(texts):
    """The rows' facts, and the groups of each."""
    t, m = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    t.encode_special_tokens = True
    letters = bpe_codec.byte_letters()
    out, links = [], []
    for text in texts:
        own = []
        whole = (" " + (text or "")).encode()
        if text:
            a = [(i, bytes(letters[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode()) for i in m.encode(text)]
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            out.append([0, 0, 0, 0, ""])
            links.append([])
            continue
        spans = []
        for side in (a, b):
            at, ranges = 0, []
            for i, x in side:
                ranges.append((at, at + len(x), i))
                at += len(x)
            spans.append(ranges)
        own = [(i, j) for s, e, i in spans[0] for u, v, j in spans[1] if s < v and u < e]
        both = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups = ";".join("|".join(",".join(str(i) for s, _, i in side if lo <= s < hi) for side in spans) for lo, hi in zip([0, *both], both))
        out.append([len(a), len(b), len(both), len(own), groups])
        links.append(own)
    docs = Counter(p for own in links for p in set(own))
    most = {}
    for (i, _), n in docs.items():
        most[i] = max(n, most.get(i, 0))
    return [[*x, sum(docs[p] == most[p[0]] for p in own), sum(docs[p] for p in own)] for x, own in zip(out, links)]


def test_every_odd_row(spark):
    r = random.Random(5)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 25))) for _ in range(250)] + [None, "", "x", "the thing", "the thing", "the thing" * 40, "a  b", "long ü" * 400]
    docs = spark.createDataFrame([(i if i != 3 else None, t, "x", 7) for i, t in enumerate(texts)], "doc_id long, text string, chunk string, n_a int").repartition(3)
    want = {(i if i != 3 else None): x for i, x in enumerate(brute(texts))}
    for chunk in (1 << 25, 300):
        got = token_alignment.align(docs, A, B, chunk=chunk).collect()
        assert len(got) == len(texts)
        for row in got:
            w = want[row["doc_id"]]
            sha = hashlib.sha256(w[4].encode()).hexdigest() if w[4] else ""
            assert [*row[1:5], row["groups_sha256"], row["n_best"], row["count_sum"]] == [*w[:4], sha, *w[5:]]
    told = token_alignment.aligned(docs, A, B, with_groups=True).filter("n_a is not null").collect()
    assert {row["doc_id"]: row["groups"] for row in told} == {i: w[4] for i, w in want.items()}


def test_packed_numbers():
    import numpy as np

    for x in ([], [0], [3, 3, 9, 70_000, 2**31]):
        assert token_alignment.unpack(token_alignment.pack(np.array(x, np.int64), True), True).tolist() == x
        assert token_alignment.unpack(token_alignment.pack(np.array(x, np.int64), False), False).tolist() == x


def test_empty_and_tokenless_tables(spark):
    kinds = "doc_id long, text string"
    assert token_alignment.align(spark.createDataFrame([], kinds), A, B).count() == 0
    got = token_alignment.align(spark.createDataFrame([(1, None), (2, "")], kinds), A, B).collect()
    assert sorted(tuple(r) for r in got) == [(i, 0, 0, 0, 0, "", 0, 0) for i in (1, 2)]


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    short = [(r["doc_id"], r["text"]) for r in docs if len(r["text"] or "") < 3000]
    df = spark.createDataFrame(short, "doc_id long, text string")
    want = {i: x for (i, _), x in zip(short, brute([t for _, t in short]))}
    for row in token_alignment.align(df, A, B, chunk=1 << 16).collect():
        w = want[row["doc_id"]]
        assert [*row[1:5], row["n_best"], row["count_sum"]] == [*w[:4], *w[5:]]
    assert token_alignment.op13_token_alignment(spark, sf_dir).count() == len(docs)
