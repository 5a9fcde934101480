"""Each operator against a brute-force version on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import bisect
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm import decontaminate, keycount, knn_search, license_scan, line_dedup, lm_scoring, packing, pii, simhash, substring_dedup, toxicity
from loomline.llm._shared import Words

RNG = random.Random(11)
VOCAB = ["the", "of", "Ana", "bo", "çé", "x1", "deep", "river,", "stone", "wall."]
WORDS = lambda n: " ".join(RNG.choice(VOCAB) for _ in range(n))
SHARED = WORDS(45)
TEXTS = [
    (0, None), (1, ""), (2, "  \n\t "), (3, "Ana"), (4, "Ana bo"), (5, WORDS(12)), (6, f"{WORDS(20)} {SHARED} {WORDS(3)}"), (7, f"{SHARED}\n{WORDS(9)}"), (8, WORDS(300)), (9, WORDS(300)), (9, "Ana bo"), (10, "Ana bo"), (10, "Ana bo"),
    (11, f"{WORDS(40)}\n{WORDS(8)}\n\n{WORDS(8)}"), (None, "Ana bo\nriver, stone wall. deep the of"), (12, "the of river, stone wall. deep\nANA bo\nthe of river, stone wall."), (13, SHARED + " " + SHARED), (14, "word " * 5000),
]
SCHEMA = "doc_id long, text string, chunk string, bucket int, fp string, doc long, row int, score string, matches int, n_words string, id int, key int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "c", 1, "f", 5, 2, "s", 3, "n", 4, 6) for i, t in TEXTS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.select(*columns).collect()), key=repr)


def test_words():
    texts = [(t or "").encode() for _, t in TEXTS]
    w = Words(texts)
    assert [[w.word(i) for i in range(s, e)] for s, e in zip(w.first[:-1], w.first[1:])] == [t.split() for t in texts]
    assert len(set(w.hash.tolist())) == len({x for t in texts for x in t.split()})


def test_packing_of_numbers():
    for x in (np.array([], np.uint64), np.array([0, 5, 2**64 - 1], np.uint64)):
        assert keycount.unpack(keycount.pack(x)).tolist() == x.tolist()


# 1
def lines_left(rows):
    seen, out = [], []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, (r[1] or "").encode())):
        gone = []
        lines = text.split("\n") if text else []
        for no, line in enumerate(lines):
            s = {w.lower() if w.isascii() else w for w in re.split("[ \t-\r]+", line.translate({c: c + 32 for c in range(65, 91)})) if w}
            if s and any(len(s & o) >= 0.8 * len(s | o) for o in seen):
                gone.append(no)
            if s:
                seen.append(s)
        out.append((i, len(lines), gone, hashlib.sha256("\n".join(x for no, x in enumerate(lines) if no not in gone).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_line_dedup(spark, docs, none):
    assert bag(line_dedup.line_decisions(docs), "doc_id", "n_lines", "removed", "kept_sha256") == lines_left(TEXTS)
    assert line_dedup.line_decisions(none).count() == 0
    assert line_dedup.keep_lines(none).columns == none.columns


def test_line_dedup_random_and_few_candidates(spark):
    rng = random.Random(2)
    base = [[rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("0123456789") for _ in range(rng.randint(1, 14))] for _ in range(25)]

    def line():
        words = list(rng.choice(base))
        if rng.random() < 0.6:
            words[rng.randrange(len(words))] = rng.choice("qrst") + rng.choice("0123")
        return " ".join(words)

    rows = [(i, "\n".join(line() for _ in range(rng.randint(1, 12)))) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert bag(line_dedup.line_decisions(frame, nearest=1), "doc_id", "n_lines", "removed", "kept_sha256") == lines_left(rows)
    kept = {r.doc_id: r.text for r in line_dedup.keep_lines(frame).collect()}
    assert all(hashlib.sha256(kept[i].encode()).hexdigest() == h for i, _, _, h in lines_left(rows))


# 2
def components(fps, ids, radius):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    name = collections.defaultdict(list)
    for i in range(len(fps)):
        name[find(i)].append(ids[i])
    return [min((x for x in name[find(i)] if x is not None), default=None) for i in range(len(fps))]


def test_simhash(docs, none):
    ids, fps = [i for i, _ in TEXTS], [simhash.fingerprint((t or "").encode()) for _, t in TEXTS]
    want = sorted(((i, f, c) for i, f, c in zip(ids, fps, components(fps, ids, 2))), key=repr)
    got = sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.simhash_components(docs).collect()), key=repr)
    assert got == want and fps[0] == fps[1] == fps[2] == 0
    assert simhash.simhash_components(none).count() == 0


@pytest.mark.parametrize("radius", [1, 2, 5, 8])
def test_links_of_any_radius(spark, radius, monkeypatch):
    rng = np.random.default_rng(radius)
    seeds = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = {int(s) for s in seeds}
    for s in seeds:
        for _ in range(25):
            fps.add(int(s) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False)))
    fps = sorted(fps)
    monkeypatch.setattr(simhash, "HEAVY", 4)
    nodes = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")
    roots = {r.fp % 2**64: r.root for r in simhash.components(simhash.near_links(nodes, radius)).collect()}
    want = components(fps, fps, radius)
    groups = collections.defaultdict(set)
    for f, c in zip(fps, want):
        groups[c].add(f)
    for g in groups.values():
        assert len({roots.get(f, f) for f in g}) == 1
    assert len({roots[f] for f in roots}) == sum(len(g) > 1 for g in groups.values())


def test_keep_first(spark, docs):
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect() if r.text == "Ana bo"} == {4}


# 3
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def decontaminated(text, items, window=10):
    ws = ALNUM.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for i, t in items:
        own = ALNUM.findall((t or "").translate(LOWER))
        n = min(window, len(own))
        if i is None or not n:
            continue
        for a in range(len(own) - n + 1):
            for b in range(len(ws) - n + 1):
                if ws[b : b + n] == own[a : a + n]:
                    hit |= set(range(b, b + n))
                    found.add(str(i))
    return len(ws), len(hit), ",".join(sorted(found))


@pytest.mark.parametrize("block_bytes", [1 << 24, 200])
def test_decontaminate(spark, docs, none, block_bytes):
    items = [(1, SHARED), (10, WORDS(15)), (2, "x1 deep"), (3, None), (4, "?!"), (None, "Ana"), (5, SHARED[:100]), (5, "STONE wall"), (6, WORDS(60))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_matches(docs, bench, keep=["doc_id", "text"], block_bytes=block_bytes)
    got = got.select("text", "doc_id", "n_words", "n_hit", F.array_join(decontaminate.items_of("matches"), ",").alias("s"))
    assert bag(got, "doc_id", "n_words", "n_hit", "s") == sorted(((i, *decontaminated(t, items)) for i, t in TEXTS), key=repr)
    clean = decontaminate.remove_contaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not decontaminated(t, items)[1] for _, t in TEXTS)
    assert decontaminate.find_matches(none, bench).count() == 0
    assert decontaminate.find_matches(docs, bench.limit(0), keep=["doc_id"]).filter("n_hit > 0").count() == 0


def test_matches_are_the_longest():
    index = decontaminate.Index([("a", "k l m n o p")], 3)
    (n,), (found,) = decontaminate.matches(index, [b"x k l m n y l m n o p"])
    assert n == 11 and sorted((m["first"], m["item_first"], m["length"]) for m in found) == [(1, 0, 4), (6, 1, 5)]


# 4
def test_word_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    plain = Tokenizer.from_file(path)
    letters = "aAéÉİßǅ'.,!|<> ́Å 12st\n\t#한"
    texts = [t or "" for _, t in TEXTS] + ["".join(RNG.choice(letters) for _ in range(RNG.randint(0, 50))) for _ in range(500)] + ["a <|endoftext|> B", "it's don't", "<|ENDOFTEXT|>"]
    got = packing.WordEncoder(path).encode([t.encode() for t in texts])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("seed", range(5))
def test_plan_equals_best_fit_decreasing(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([rng.randint(1, 50), rng.randint(1, 12), 50, 17]) for _ in range(400)]
    counts = collections.Counter(lengths)
    fill = collections.Counter()
    for length, rank, each, first, at in packing.plan(dict(counts), 50):
        after = [r for r in packing.plan(dict(counts), 50) if r[0] == length and r[1] > rank]
        stop = min([r[1] for r in after], default=counts[length])
        for k in range(rank, stop):
            fill[first + (k - rank) // each] += length
    gaps, want = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(gaps, x)
        g = gaps.pop(i) if i < len(gaps) else None
        if g is None:
            want, g = want + 1, 50
        if g > x:
            bisect.insort(gaps, g - x)
    assert len(fill) == want and max(fill.values()) <= 50 and sum(fill.values()) == sum(lengths)


def test_pack(spark, docs, none):
    pieces = packing.tokenise(docs, packing.default_tokenizer(), 64, with_ids=True)
    got = packing.pack(pieces, 64).collect()
    encode = packing.encoder(packing.default_tokenizer()).encode
    want = collections.Counter()
    for i, t in TEXTS:
        ids = np.frombuffer(encode([(t or "").encode()])[0], "<u4").tolist() + [1]
        for k, s in enumerate(range(0, len(ids), 64)):
            want[i, k, s, len(ids[s : s + 64]), zlib.crc32(np.array(ids[s : s + 64], "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = collections.defaultdict(list)
    for r in got:
        assert len(r.ids) == r.length
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 64
    assert packing.pack(packing.tokenise(none, packing.default_tokenizer())).count() == 0


# 5
def test_toxicity_on_unseen_spellings(spark, docs, none):
    rng = random.Random(4)
    noise = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    text = lambda bad: " ".join([*(rng.choice(noise) for _ in range(40)), *([bad] if bad else []), *(rng.choice(noise) for _ in range(20))])
    bad = [f"grumbo{rng.choice('aeiou')}{rng.choice('lnrst')}" for _ in range(20)]
    rows = [(i, text(rng.choice(bad[:15]) if i % 3 == 0 else None), int(i % 3 == 0)) for i in range(400)]
    frame = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(frame, labels)
    unseen = [text(f"grumbo{c}zz").encode() for c in "aeiou"] + [text(None).encode() for _ in range(5)]
    assert (model.scores(unseen) >= 0.5).tolist() == [True] * 5 + [False] * 5
    out = toxicity.score(docs, model)
    assert set(out.columns) == set(docs.columns) and all(0 <= r.score <= 1 for r in out.collect())
    assert toxicity.score(none, model).count() == 0
    left = toxicity.remove_toxic(frame, model)
    assert left.columns == frame.columns and 260 <= left.count() <= 275
    assert toxicity.train(frame, labels.limit(0)).scores([b"x"])[0] == pytest.approx(0.5)


def test_held_out_rows_are_the_contracts(spark):
    got = spark.range(50).select(F.col("id").alias("doc_id"), toxicity.held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


# 6
def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=4), 1)]) for i in range(120)]
    rows += [(120 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(40)] + [(500, None), (501, [1.0, None, 0.0, 0.0]), (502, [float("nan")] * 4), (503, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (504, []), (505, [2.0]), (5, rows[5][1]), (5, [1.0, -1.0, 2.0, 0.0]), (60, rows[60][1]), (60, rows[61][1])]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, cell int, block int").repartition(4)
    good = [(i, np.floor(256 * np.array(v, np.float32).astype(float))) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    pad = lambda v: np.concatenate([v, np.zeros(4 - len(v))])
    want = []
    for own, (q, x) in enumerate(good):
        if q % 10 == 0:
            best = sorted((-int(pad(x) @ pad(v)), i) for row, (i, v) in enumerate(good) if row != own)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    got = knn_search.top_k(frame, query_step=10, pivots=8, block=16)
    assert bag(got, "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)
    assert knn_search.top_k(frame.limit(0)).count() == 0
    assert knn_search.products(np.array([[2.0**52, 1]]), np.array([[2.0**8, 3]])).tolist() == [[2**60 + 3]]
    with pytest.raises(OverflowError):
        knn_search.products(np.array([[2.0**60]]), np.array([[2.0**8]]))
    assert bag(knn_search.top_k(frame, query_step=10, pivots=8, block=16, queries=3), "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)


def test_top_k_of_repeated_ids_equals_sql(spark):
    import duckdb

    rng = np.random.default_rng(9)
    rows = [(i % 70, [float(x) for x in rng.normal(size=6)]) for i in range(300)] + [(1, [9.0] * 6), (1, [-9.0] * 6), (50, [1.0] * 6), (50, [1.0] * 6)]
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, embedding double[])")
    con.executemany("insert into embeddings values (?, ?)", rows)
    got = knn_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=20, queries=4)
    assert bag(got, "query_id", "rank", "vec_id", "score") == sorted(con.execute(knn_search.SQL).fetchall(), key=repr)


def test_batches_of_routed_queries_are_bounded(spark, monkeypatch):
    """Queries that go to every block leave in batches of few rows."""
    monkeypatch.setattr(knn_search, "COPIES", 7)
    monkeypatch.setattr(knn_search, "ROUTED", 3)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(150)]
    good = [(i, np.floor(256 * np.array(v))) for i, v in rows]
    want = [(q, k + 1, i, -s) for q, x in good if q % 50 == 0 for k, (s, i) in enumerate(sorted((-int(x @ v), i) for i, v in good if i != q)[:5])]
    got = knn_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=10)
    assert bag(got, "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)


def test_top_k_of_text_ids_and_clusters(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(str(i), [float(x) for x in 8 * np.eye(8)[i % 8] + rng.normal(scale=0.1, size=8)]) for i in range(400)] + [("no number", [1.0] * 8)]
    frame = spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    good = {int(i): np.floor(256 * np.array(v)) for i, v in rows if i.isdigit()}
    want = [(q, k + 1, i, -s) for q in good if q % 50 == 0 for k, (s, i) in enumerate(sorted((-int(good[q] @ v), i) for i, v in good.items() if i != q)[:5])]
    assert bag(knn_search.top_k(frame), "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)


# 7
def test_license_scan(spark, docs, none):
    frame = spark.createDataFrame([(1, "Some words.\nReleased under the MIT License.\nMore"), (2, "Licensed under the Example Foo License, version 9."), (3, None), (4, "no cue here"), (5, "THIS WORK IS LICENSED under the GNU General Public License, version 3.")], "doc_id long, text string")
    model = license_scan.train(docs)
    got = {r.doc_id: [(p.line, p.family) for p in r.paragraphs] for r in license_scan.scan(frame, model).collect()}
    assert got == {1: [(1, "mit")], 2: [(0, "unknown")], 3: [], 4: [], 5: [(0, "gpl-3.0")]}
    assert license_scan.scan(docs, model).count() == len(TEXTS) and license_scan.scan(none, model).count() == 0


def test_every_notice_is_known(docs):
    model = license_scan.train(docs)
    for family, notices in license_scan.NOTICES.items():
        for n in notices:
            if any(c in n.lower() for c in license_scan.CUES):
                assert [f for _, f, _ in model.scan([n.encode()])[0]] == [family], n


# 8
def test_substring_dedup(docs, none):
    window = 35
    split = lambda t: [w for w in re.split("[\t-\r ]+", t or "") if w]
    count = collections.Counter(tuple(ws[i : i + window]) for ws in (split(t) for _, t in TEXTS) for i in range(len(ws) - window + 1))
    want = []
    for i, t in TEXTS:
        ws = split(t)
        gone = {k for a in range(len(ws) - window + 1) if count[tuple(ws[a : a + window])] > 1 for k in range(a, a + window)}
        want.append((i, len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone)))
    assert bag(substring_dedup.substring_dedup(docs), "doc_id", "n_words", "n_removed", "kept") == sorted(want, key=repr)
    assert substring_dedup.substring_dedup(none).count() == 0


# 9
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(t):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, t):
            d = pii.digits_of(m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (16 <= len(d) <= 19 and pii.luhn(d)) or kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_patterns_equal_the_plain_ones():
    rng = random.Random(1)
    for _ in range(4000):
        t = "".join(rng.choice(["a", "B", "@", ".", "+", "-", "_", " ", "1", "25", "(", ")", "4111 1111 1111 1111", "é", "x@y.z", "10.0.0.1"]) for _ in range(rng.randint(0, 25)))
        assert pii.pattern_spans(t) == plain_spans(t), t
    assert pii.pattern_spans("1" * 100_000) == []


def test_pii(spark, none):
    long = "word " * 20000
    rows = [(1, "é call (555) 010-9876 now, +1 (555) 010-1234!"), (2, None), (3, ""), (4, long + "a.b@c.example.org"), (5, "version 1.2.3 in 2004"), (5, "version 1.2.3 in 2004"), (6, "tel 020-7946-0123")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.base, r.spans) for r in pii.find_pii(frame).collect()}
    assert got[1] == ("phone:27:44", "phone:7:21,phone:27:44") and got[2] == got[3] == got[5] == ("", "")
    assert got[4][1] == f"email:{len(long)}:{len(long) + 17}" and got[6] == ("", "phone:4:17")
    assert pii.find_pii(none).count() == 0


def test_field_learns_its_table():
    model = pii.field()
    for words, labels in pii.labelled():
        for s, e in pii.runs(words):
            assert model.decode([model.scores(words, s, e)])[0].tolist() == labels[s:e]


def test_viterbi_equals_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    k = len(pii.LABELS)
    model = pii.Field({}, np.zeros((0, k)), rng.normal(size=(k, k)), rng.normal(size=k), rng.normal(size=k))
    batch = [rng.normal(size=(n, k)) for n in (1, 3, 2, 3)]
    for x, got in zip(batch, model.decode(batch)):
        best = max(itertools.product(range(k), repeat=len(x)), key=lambda p: model.begin[p[0]] + model.end[p[-1]] + sum(x[i, c] for i, c in enumerate(p)) + sum(model.move[a, b] for a, b in zip(p, p[1:])))
        assert got.tolist() == list(best)


# 10
def test_lm_scores(docs, none):
    split = [[w for w in re.split("[\t-\r ]+", (t or "").translate(LOWER)) if w] for _, t in TEXTS]
    count = collections.Counter(tuple(ws[i : i + n]) for ws in split for n in (1, 2, 3) for i in range(len(ws) - n + 1))
    total = sum(map(len, split))
    want = []
    for (i, _), ws in zip(TEXTS, split):
        s = 0.0
        for k in range(len(ws)):
            for give, n in enumerate(range(min(3, k + 1), 0, -1)):
                g = tuple(ws[k - n + 1 : k + 1])
                if n == 1 or count[g] >= 2:
                    s += math.log(count[g] / (count[g[:-1]] if n > 1 else total)) + give * math.log(0.4)
                    break
        want.append((i, len(ws), round(s, 6)))
    got = lm_scoring.lm_scores(docs).withColumn("log_score", F.round("log_score", 6))
    assert [(a, b, pytest.approx(c, abs=1e-5)) for a, b, c in sorted(want, key=repr)] == bag(got, "doc_id", "n_words", "log_score")
    assert lm_scoring.lm_scores(none).count() == 0
