"""BPE encoding and decoding against the tokenizers library, and the lexicon against a plain dictionary."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from loomline.llm import bpe_codec

PATH = bpe_codec.default_tokenizer()
PARTS = ["a", "th", "'", "'s", "'ll", " ", "  ", "\n", "\t", "　", "é", "ß", "日本", "12", "²", "!", "...", "<|endoftext|>", "<|", "🙂", "՘", "ing", " the", "\r\n", "\x00", "́", "z" * 70, "!" * 100, "aé" * 50]


def library(texts, specials=True):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = not specials
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)], t


def odd_texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 30))) for _ in range(n)] + ["".join(chr(r.choice([r.randrange(0x20, 0x250), r.randrange(0x2000, 0x3100), r.randrange(0xE000, 0x1FFFF)])) for _ in range(30)) for _ in range(n // 10)]


@pytest.mark.parametrize("specials", [True, False])
@pytest.mark.parametrize("words", [[], ["a", "th", " the", "é", "the", " a", "ing", "thing", "日本"]])
def test_equals_the_library(specials, words):
    texts, vocab = odd_texts(2000), bpe_codec.vocabulary(PATH)
    lexicon = bpe_codec.Lexicon(bpe_codec.Lexicon.compile(dict(zip([w.encode() for w in words], library(words)[0] if words else []))))
    ids, first = bpe_codec.encode_texts(vocab, [t.encode() for t in texts], lexicon, specials)
    assert [ids[s:e].tolist() for s, e in zip(first, first[1:])] == library(texts, specials)[0]


def test_lexicon_is_a_minimal_automaton_of_the_words():
    r = random.Random(3)
    words = {bytes(r.choices(b"abc\xff\x00", k=r.randint(1, 6))): [r.randrange(9) for _ in range(r.randint(1, 3))] for _ in range(400)}
    lex = bpe_codec.Lexicon(bpe_codec.Lexicon.compile(words))
    asked = [*words, *(w + b"a" for w in words), b"", b"zz"]
    size = np.array([len(w) for w in asked])
    found = lex.numbers(np.frombuffer(b"".join(asked), np.uint8), np.cumsum(size) - size, size)
    names = sorted(words)
    assert found.tolist() == [names.index(w) if w in words else -1 for w in asked]
    assert all(lex.ids[lex.first[i] : lex.first[i + 1]].tolist() == words[w] for i, w in enumerate(names))
    # as many states as the words have different sets of endings
    endings = {}
    for w in words:
        for k in range(len(w) + 1):
            endings.setdefault(w[:k], set()).add(w[k:])
    assert len(lex.base) == len({frozenset(x) for x in endings.values()})


def test_whole_table_with_every_odd_row(spark):
    long = "ab' c\n" * 400_000 + "<|endoftext|>" + "x" * 3_000 + " ü" * 9
    texts = [*odd_texts(300), None, "", "same", "same", long]
    docs = spark.createDataFrame([(i if i != 7 else None, t, "x", 0) for i, t in enumerate(texts)], "doc_id long, text string, ids string, n int").repartition(3)
    coded = bpe_codec.encode(docs, PATH, bpe_codec.build_lexicon(docs, PATH, 500))
    got = {(r["doc_id"], r["text"]): bytes(r["ids"]) for r in bpe_codec.decode(coded, PATH).collect()}
    want, lib = library([t or "" for t in texts])
    assert got == {(i if i != 7 else None, lib.decode(w, skip_special_tokens=False)): np.array(w, "<u4").tobytes() for i, w in enumerate(want)}


def test_bytes_that_are_no_text(spark):
    ids = [np.array(x, "<u4").tobytes() for x in ([188], [230, 188], [])] + [None]
    got = bpe_codec.decode(spark.createDataFrame(list(enumerate(ids)), "doc_id int, ids binary"), PATH).orderBy("doc_id").collect()
    lib = library([""])[1]
    assert [r["text"] for r in got] == [lib.decode([188]), lib.decode([230, 188]), "", ""]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe_codec.decode(bpe_codec.encode(docs, PATH, bpe_codec.build_lexicon(docs, PATH)), PATH).count() == 0


def test_query(spark, sf_dir):
    got = {r["doc_id"]: r for r in bpe_codec.op11_bpe_codec(spark, sf_dir).collect()}
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want, _ = library([t for _, t in docs])
    for (i, t), ids in zip(docs, want):
        r = got[i]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
