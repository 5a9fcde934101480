"""Small cases with known answers, and random texts against plain statements of the rules."""

import io
import json
import random
import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.functions import text as X
from loomline.functions import voice as V
from loomline.operators import lookup, metrics, quality, registry, sequence, spans
from loomline.sources import files


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("x")).first()["x"]


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "id long, t string")


def test_chapters(spark):
    book = "Chapter 1\nRain fell on the harbour all night.\n\nChapter 2\nBy noon the ferries ran again.\n"
    got = spans.chapter_rows(texts(spark, book, "Pages without any heading at all.", None), "id", "t").orderBy("chapter").collect()
    assert [(r.chapter, r.body) for r in got] == [("chapter_001", "Rain fell on the harbour all night.\n"), ("chapter_002", "By noon the ferries ran again.\n")]


def test_sentences(spark):
    got = spans.sentence_rows(texts(spark, "Lanterns swung.  Tides turned!\nWho rows?", ""), "id", "t").orderBy("idx").collect()
    assert [(r.idx, r.sentence) for r in got] == [(0, "Lanterns swung."), (1, "Tides turned!"), (2, "Who rows?")]


QUOTED = "Ines knelt. “These shells came up with the nets.” “Put them by the lamp.” Ines emptied the bucket."


def test_spans(spark):
    got = spans.spans(texts(spark, QUOTED), "id", "t").orderBy("start").collect()
    assert [(r.kind, r.idx) for r in got] == [("narration", 0), ("quote", 1), ("quote", 2), ("narration", 1)]
    assert all(QUOTED[r.start : r.end] == r.text for r in got)


def test_single_quotes(spark):
    t = "Fog again. ‘That boat’s Marek’s, look,’ calls the pilot. ‘It’s ’alf sunk.’"
    got = spans.spans(texts(spark, t), "id", "t").filter("kind = 'quote'").orderBy("idx").collect()
    assert [r.text for r in got] == ["‘That boat’s Marek’s, look,’", "‘It’s ’alf sunk.’"]


def test_marked(spark):
    assert spans.marked(texts(spark, 'Up. "Down." Off.'), "id", "t").first()["marked"] == 'Up. |q001| "Down." ||q001|| Off.'


def scan(text):
    """Quote spans by a state machine."""
    pairs, out, start, close = {"“": "”", "‘": "’", '"': '"'}, [], None, ""
    for i, c in enumerate(text):
        if start is None:
            if c in pairs:
                start, close = i, pairs[c]
        elif c == close and not (c == "’" and i + 1 < len(text) and text[i + 1].isalnum()):
            out.append(text[start : i + 1])
            start = None
    return out + ([text[start:]] if start is not None else [])


def test_quotes_match_a_state_machine(spark):
    rng = random.Random(5)
    cases = ["".join(rng.choice("ab .\n“”‘’\"") for _ in range(rng.randint(0, 30))) for _ in range(400)]
    got = {}
    for r in spans.spans(texts(spark, *cases), "id", "t").filter("kind = 'quote'").orderBy("id", "idx").collect():
        got.setdefault(r.id, []).append(r.text)
    assert [got.get(i, []) for i in range(len(cases))] == [scan(t) for t in cases]


PAIRS = {'"': '"', "“": "”"}


def quote_fragments(text: str, inside: bool) -> tuple[list[tuple[str, bool]], bool]:
    """Letter by letter: fragments of a sentence and whether each is a quote; inside: the sentence begins in an open quote, which any closing mark ends."""
    out, held, quoted, close = [], "", inside, ""
    for c in text:
        if not quoted and c in PAIRS:
            out.append((held.strip(), False))
            held, quoted, close = c, True, PAIRS[c]
            continue
        held += c
        if quoted and (c == close or inside and c in '"”'):
            out.append((held.strip(), True))
            held, quoted, close = "", False, ""
    out.append((held.strip(), quoted))
    return [f for f in out if f[0]], quoted


def plain_units(fragments: list[tuple[str, bool]]) -> list[str]:
    """One unit per quote: narration before the first quote joins it, later narration joins the unit before."""
    if not any(q for _, q in fragments):
        whole = " ".join(t for t, _ in fragments)
        return [whole] if whole else []
    units: list[str] = []
    ahead = ""
    for t, q in fragments:
        if q:
            units.append(f"{ahead} {t}".strip())
            ahead = ""
        elif units:
            units[-1] += f" {t}"
        else:
            ahead = f"{ahead} {t}".strip()
    return units


@pytest.mark.parametrize(
    "text, units",
    [
        ('"Salt in the flour." "Sieve it, then." Odo shrugged at the oven.', ['"Salt in the flour."', '"Sieve it, then." Odo shrugged at the oven.']),
        ('"Row," Ines called across the water. "Harder."', ['"Row," Ines called across the water.', '"Harder."']),
        ('Marek asked, "Is that rope new?" "Spliced last week." Odo tied it off.', ['Marek asked, "Is that rope new?"', '"Spliced last week." Odo tied it off.']),
    ],
)
def test_role_units(spark, text, units):
    rows = spark.createDataFrame([("a", 0, text)], "k string, i long, s string")
    assert [r.unit for r in spans.role_unit_rows(rows, "k", "i", "s").orderBy("part").collect()] == units


@pytest.mark.parametrize("block", [3, 50, 10_000])
def test_role_units_equal_a_scan_letter_by_letter(spark, block):
    r = random.Random(block)
    texts = [None, "", " ", '"', "”", *("".join(r.choices(["“", "”", '"', "a", "b ", " ", "\u00a0", "c."], [1, 1, 1, 4, 4, 2, 1, 2], k=r.randint(0, 9))) for _ in range(600))]
    r.shuffle(texts)
    data = [("ab"[i % 5 == 0], i, t) for i, t in enumerate(texts)] + [(None, i, t) for i, t in enumerate(texts[:80])]
    want, state = [], {}
    for k, i, t in data:
        fragments, state[k] = quote_fragments(t or "", state.get(k, False))
        want += [(k, i, part, u) for part, u in enumerate(plain_units(fragments))]
    got = spans.role_unit_rows(spark.createDataFrame(data, "k string, i long, s string").repartition(3), "k", "i", "s", block)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_open_quotes_go_on(spark):
    rows = spark.createDataFrame([("a", 0, "“The bell rang twice."), ("a", 1, "Nobody came down."), ("a", 2, "Then the tower fell silent.” Gulls wheeled over it.")], "k string, i long, s string")
    got = spans.role_unit_rows(rows, "k", "i", "s").orderBy("i", "part").collect()
    assert [(r.i, r.unit) for r in got] == [(0, "“The bell rang twice."), (1, "Nobody came down."), (2, "Then the tower fell silent.” Gulls wheeled over it.")]


def jobs(spark, *pairs):
    return spark.createDataFrame([("c", i, r, t) for i, (r, t) in enumerate(pairs)], "k string, i long, role string, t string")


def test_dialogue(spark):
    rows = jobs(spark, ("Narrator", "Dusk came."), ("Narrator", "Boats went out."), ("Ines", "Ready."), ("Narrator", "They chose #Nine."))
    assert sequence.dialogue(rows, "k", "i", "role", "t").first()["script"] == "Narrator: Dusk came. Boats went out.\nInes: Ready.\nNarrator: They chose hashtag Nine."


def test_capacity_windows(spark):
    rows = jobs(spark, ("a", "aaaa"), ("a", "bbbb"), ("a", "cccc")).withColumn("n", F.length("t"))
    got = sequence.capacity_windows(rows, "k", ["i"], "n", 9).orderBy("i").collect()
    assert [r.window_id for r in got] == [0, 0, 1]
    with pytest.raises(Exception, match="exceeds"):
        sequence.capacity_windows(rows, "k", ["i"], "n", 3).collect()


@pytest.mark.parametrize("most,most_rows", [(9, 0), (30, 4), (0, 3), (200, 0), (5, 1)])
def test_capacity_windows_by_blocks(spark, most, most_rows):
    """Blocks of any length give the windows of the fold: windows longer than a block, rows larger than a window, gaps, empty sizes and null keys."""
    r = random.Random(most)
    data = [(k, i * g, r.choice([0, None, 1, 2, 5, 8, 12])) for k, g in (("a", 1), ("b", 3), (None, 1)) for i in range(200)] + [("c", 999, 7)]
    rows = spark.createDataFrame(data, "k string, i long, n int").repartition(5)
    told = lambda df: sorted(map(str, df.select("k", "i", "n", "window_id").collect()))
    want = told(sequence.capacity_windows(rows, "k", ["i"], "n", most, most_rows, alone=True))
    for block in (1, 7, 64, 5000):
        assert told(sequence.capacity_windows(rows, "k", ["i"], "n", most, most_rows, alone=True, block=block)) == want


def test_blocks_of_one_key_are_tasks_of_their_own(spark):
    rows = spark.range(40_000).select(F.lit("one").alias("k"), F.col("id").alias("i"), (F.col("id") % 7).alias("n"))
    got = sequence.capacity_windows(rows, "k", ["i"], "n", 50, block=1000)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = got.groupBy(F.spark_partition_id().alias("p")).count().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert parts > 1
    with pytest.raises(Exception, match="exceeds"):
        sequence.capacity_windows(rows, "k", ["i"], "n", 3, block=1000).collect()


def rendered(rows):
    lines, last, held = [], None, []
    for r, t in rows:
        t = " ".join(t.split())
        if held and r != last:
            lines.append(f"{last}: {' '.join(held)}")
            held = []
        last = r
        held += [t] if t else []
    return len("\n".join([*lines, *([f"{last}: {' '.join(held)}"] if held else [])]))


def greedy(rows, most, roles):
    out, held, window = [], [], 0
    for row in rows:
        if held and (rendered([*held, row]) > most or len({r for r, _ in [*held, row]}) > roles):
            window, held = window + 1, []
        held.append(row)
        out.append(window)
    return out


def test_speech_windows_match_rendering(spark):
    rng = random.Random(3)
    groups = [[(rng.choice(["A", "Bob", "Narrator"]), rng.choice(["", "hi", "x y  z", "w" * rng.randint(1, 20)])) for _ in range(rng.randint(1, 25))] for _ in range(60)]
    rows = spark.createDataFrame([(g, i, r, t) for g, x in enumerate(groups) for i, (r, t) in enumerate(x)], "k long, i long, role string, t string")
    got = {}
    for r in sequence.speech_windows(rows, "k", ["i"], "role", "t", 60, 2).orderBy("k", "i").collect():
        got.setdefault(r.k, []).append(r.window_id)
    assert [got[g] for g in range(len(groups))] == [greedy(x, 60, 2) for x in groups]


def test_role_cap(spark):
    got = sequence.speech_windows(jobs(spark, *[(f"r{i}", "Hi.") for i in range(9)]), "k", ["i"], "role", "t", 1000, 8).orderBy("i").collect()
    assert [r.window_id for r in got] == [0] * 8 + [1]


def test_timeline(spark):
    rows = jobs(spark, ("a", "Hello."), ("a", "Hi.")).withColumn("n", 10 * F.length("t"))
    got = sequence.timeline(rows, "k", "i", "n", 1000, 100).orderBy("i").collect()
    assert [(r.start_ms, r.end_ms) for r in got] == [(0, 60), (160, 190)]
    grouped = spark.createDataFrame([("c", 0, 0, 10), ("c", 1, 0, 10), ("c", 2, 1, 10)], "k string, i long, s long, n long")
    got = sequence.timeline(grouped, "k", "i", "n", 1000, 100, 20, "s").orderBy("i").collect()
    assert [(r.start_ms, r.end_ms) for r in got] == [(0, 10), (30, 40), (140, 150)]


def test_target_sweep(spark):
    rows = spark.createDataFrame([("c", i, n) for i, n in enumerate((70, 40, 55, 80, 25))], "k string, i long, n long")
    got = sequence.target_sweep(rows, "k", "i", "n", 100, 100, 3).orderBy("target").collect()
    assert [(r.target, r.n_rows) for r in got] == [(100, 1), (200, 3), (300, 5)]
    rows = spark.createDataFrame([("c", i, n) for i, n in enumerate((70, 400, 20))], "k string, i long, n long")
    got = sequence.target_sweep(rows, "k", "i", "n", 100, 100, 9).orderBy("target").collect()
    assert [(r.target, r.n_chars) for r in got] == [(100, 70), (500, 490)]


def test_buffer(spark):
    def calls(seconds, **k):
        rows = spark.createDataFrame([("c", i, s) for i, s in enumerate(seconds)], "k string, i long, s double")
        return [r.call for r in sequence.buffer(rows, "k", "i", "s", limit=2, **k).orderBy("i").collect()]

    assert calls([1.0] * 4, target=3.0, most=4.0) == [0, 0, 1, None]
    assert calls([0.1] * 10, target=0.6, most=9.0) == [0, 0, 1, 1, 2, 2, None, None, None, None]


def test_next_limit():
    assert sequence.next_limit(4, 4, 200, 100) == 1
    assert sequence.next_limit(4, 4, 10, 100) == 6
    assert sequence.next_limit(16, 4, 10, 100) == 0
    assert sequence.next_limit(4, 4, 80, 100) == 4


def test_running_sum_over_blocks(spark):
    rows = spark.range(1000).selectExpr("id % 2 as k", "id as i", "id * 3 as v")
    got = {r.i: r.s for r in sequence.running_sum(rows, "k", "i", "v", "s", block=64).collect()}
    assert got == {i: sum(3 * j for j in range(i % 2, i, 2)) for i in range(1000)}


def test_half_even(spark):
    got = spark.createDataFrame([(1, 2), (3, 2), (5, 2), (7, 3), (0, 4)], "n long, d long").select(sequence.half_even(F.col("n"), F.col("d")).alias("x")).collect()
    assert [r.x for r in got] == [0, 2, 2, 2, 0]


REGISTRY = "ord long, role_id string, profile_id string, display_name string, aliases array<string>, age_stage string"


def test_aliases(spark):
    reg = spark.createDataFrame([(0, "mr_odo_marsh_adult", "mr_odo_marsh_adult", "Mr Odo Marsh", [], "adult")], REGISTRY)
    said = spark.createDataFrame([(1, ["Mr. Marsh"]), (2, ["he", "Odo Marsh"]), (3, ["he"])], "q long, aliases array<string>")
    got = {r.q: r.role_id for r in lookup.match_candidates(said, lookup.alias_bridge(reg), "q", "aliases").collect()}
    assert got == {1: "mr_odo_marsh_adult", 2: None, 3: None}
    two = reg.union(spark.createDataFrame([(1, "mr_lev_marsh_adult", "x", "Mr Lev Marsh", None, "adult")], REGISTRY))
    got = lookup.match_candidates(said.filter("q = 1"), lookup.alias_bridge(two), "q", "aliases").first()
    assert (got.role_id, got.roles) == (None, "mr_lev_marsh_adult,mr_odo_marsh_adult")


def test_resolve(spark):
    reg = spark.createDataFrame([(0, "brina_holt_adult", "p", "Brina Holt", None, ""), (1, "ann_a", "q", "Ann Lee", ["Annie"], ""), (2, "ann_b", "r", "Ann Lee", None, "")], REGISTRY)
    names = spark.createDataFrame([("Brina",), ("narrator",), ("Annie",), ("Ann Lee",), ("Ann",), ("brina holt adult",)], "name string")
    got = {r.name: (r.role_id, r.how) for r in lookup.resolve(names, reg).collect()}
    assert got == {"Brina": ("brina_holt_adult", "short"), "narrator": ("narrator", "narrator"), "Annie": ("ann_a", "direct"), "Ann Lee": (None, "none"), "Ann": (None, "none"), "brina holt adult": ("brina_holt_adult", "direct")}


def test_kth_match(spark):
    side = lambda name, *keys: spark.createDataFrame(list(zip(keys, range(len(keys)))), f"k string, {name} long")
    got = lookup.kth_match(side("a", "x", "y", "x", "x"), side("b", "x", "x", "z"), "k", "a", "b").orderBy("a").collect()
    assert [(r.a, r.b) for r in got] == [(0, 0), (2, 1)]


def test_first_appearance(spark):
    got = sequence.first_appearance(jobs(spark, ("Narrator", ""), ("Ines", ""), ("Narrator", "")), "k", "i", "role").orderBy("i").collect()
    assert [r.code for r in got] == [0, 1, 0]


def test_merge(spark):
    rows = spark.createDataFrame([("ines_adult", 0, "patient", "unknown"), ("ines_adult", 1, "blunt", "pilot"), ("ines_adult", 2, "Blunt", "baker"), ("ines_teen", 3, "shy", "")], "k string, o long, trait string, job string")
    got = {r.k: (r.n_rows, r.job, r.trait) for r in registry.merge(rows, "k", "o", ["job"], ["trait"]).collect()}
    assert got == {"ines_adult": (3, "pilot", "patient,blunt"), "ines_teen": (1, None, "shy")}


def test_attribution(spark):
    quotes = spark.createDataFrame([("c", 1), ("c", 2)], "chapter string, idx long")
    rows = spark.createDataFrame([("c", 1, 1, "dialogue"), ("c", 3, 0, "song"), ("c", 4, 7, "dialogue"), ("c", 5, 2, "narrator_quote"), ("c", 6, 2, "dialogue")], "chapter string, idx long, role_idx long, kind string")
    roles = spark.createDataFrame([("c", 0, "Ines"), ("c", 1, "Narrator"), ("c", 2, "stranger")], "chapter string, role_idx long, role string")
    known = spark.createDataFrame([("INES",)], "role string")
    local = spark.createDataFrame([("c", "tmp_001")], "chapter string, local_id string")
    got = quality.attribution_errors(quotes, rows, roles, known, local).first()["errors"].split("; ")
    assert got == ["Narrator cannot speak dialogue 1", "missing quote 2", "extra quote 3", "unknown kind 3", "extra quote 4", "role out of range 4", "extra quote 5", "extra quote 6", "unknown role stranger of 6", "unused local speaker tmp_001"]


def test_ratio(spark):
    got = spark.createDataFrame([(2.0, 4.0), (2.0, 0.0)], "a double, b double").select(metrics.ratio(F.col("a"), F.col("b")).alias("x")).collect()
    assert [r.x for r in got] == [0.5, None]


def test_scalars(spark):
    assert one(spark, "One, two three.", X.word_count) == 3
    assert one(spark, " Élan vital  #1 ", X.speech) == "Élan vital hashtag 1"
    assert one(spark, "Mr. O'Neil-Jones", X.slug) == "mr_o_neil_jones"
    assert one(spark, "unknown", lambda c: X.absent_to_null(c, "unknown")) is None
    assert one(spark, "a; b, A ,, c", X.split_list) == ["a", "b", "c"]
    assert one(spark, "Scottish and German", V.accent) == "German-Scottish"
    assert one(spark, "Bearer abc.def", X.redact) == "[REDACTED]"


def test_html(spark):
    page = "<html><head><style>p{}</style><script>if (a<b) {}</script></head><body><h1>T&amp;C</h1><!-- no --><p>One <b>two</b><br/>three&nbsp;four</p><ul><li>x</li></ul></body></html>"
    assert one(spark, page, X.html_text) == "T&C\nOne two\nthree four\nx"
    assert one(spark, "<p>it&#8217;s caf&eacute; &#x41; &notanentity; &lt;b&gt;</p>", X.html_text) == "it’s café A ¬anentity; <b>"


OPF = """<package><manifest><item id="a" href="contents.xhtml" media-type="application/xhtml+xml"/><item id="b" href="chapter001.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>"""


def test_epub(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "b.epub", "w") as z:
        z.writestr("content.opf", OPF)
        z.writestr("contents.xhtml", "<p>Contents</p>")
        z.writestr("chapter001.xhtml", "<h1>Chapter 1</h1><p>Oars dipped.</p>")
    docs = files.epub_documents(spark, str(tmp_path / "b.epub"))
    got = files.select_chapters(docs, "path", "pos", "member", "text").collect()
    assert [(r.chapter, r.text) for r in got] == [("chapter_001", "Chapter 1\nOars dipped.")]


def test_zip_rejects_paths_that_leave(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("../evil", "x")
    with pytest.raises(Exception, match="unsafe"):
        files.zip_members(spark, str(tmp_path / "x.zip")).collect()


def test_tab_tables(spark, tmp_path):
    (tmp_path / "e.tsv").write_text("COREF\tstart_token\ttext\n7\t1\tOdo Marsh\n8\t\tMary\n")
    got = files.tab_entities(spark, str(tmp_path / "e.tsv"), {"id": ("char_id", "COREF"), "start": ("start_token",), "mention": ("text", "mention")}, ("start",)).orderBy("id").collect()
    assert [(r.id, r.start, r.mention) for r in got] == [("7", 1, "Odo Marsh"), ("8", -1, "Mary")]
    (tmp_path / "q.tsv").write_text("a\tb\nx\t1\n")
    with pytest.raises(Exception):
        files.tab_table(spark, str(tmp_path / "q.tsv"), "a int, b int").collect()


def test_events_and_stream(spark, tmp_path):
    files.write_events(spark.createDataFrame([("a", 1), ("b", 2)], "k string, n long"), str(tmp_path / "log"))
    assert files.events(spark, str(tmp_path / "log"), "k string, n long").count() == 2
    from loomline.streaming.stateful import drain

    stream = files.stream_events(spark, str(tmp_path / "log"), "k string, n long").groupBy("k").agg(F.sum("n").alias("n"))
    assert {r.k: r.n for r in drain(stream, "complete", str(tmp_path / "ck")).collect()} == {"a": 1, "b": 2}


def test_streaming_limits_equal_the_batch_twin(spark, tmp_path):
    rows = [("u", i, 1 + i % 5, (i * 37) % 200) for i in range(30)]
    frame = spark.createDataFrame(rows, "u string, i long, b long, p long")
    frame.coalesce(1).write.json(str(tmp_path / "in"))
    from loomline.streaming.stateful import drain, limits

    stream = files.stream_events(spark, str(tmp_path / "in"), "u string, i long, b long, p long")
    got = {r.i: r.limit_after for r in drain(limits(stream, "u", "i", "b", "p", 100, 4), "append", str(tmp_path / "ck")).collect()}
    want = {r.i: r.limit_after for r in sequence.adaptive_limits(frame, "u", ["i"], "b", "p", 100, 4).collect()}
    assert got == want


def test_wav_and_resampling(spark):
    data = files.wav_bytes(np.array([0.0, 1.0, -2.0]), 8000)
    import wave

    with wave.open(io.BytesIO(data)) as w:
        assert (w.getframerate(), w.getnchannels(), np.frombuffer(w.readframes(3), "<i2").tolist()) == (8000, 1, [0, 32767, -32767])
    assert len(files.resampled(np.arange(10, dtype=np.float32), 2.0)) == 5
    assert files.wav_column(spark.createDataFrame([([0.0, 0.5],)], "s array<double>"), "s", 8000).first()["wav"][:4] == b"RIFF"


def test_report(spark, tmp_path):
    files.write_report(spark.createDataFrame([("a", [1, 2])], "k string, v array<int>"), str(tmp_path / "r"))
    line = "".join(p.read_text() for p in (tmp_path / "r" / "json").glob("part*"))
    assert json.loads(line) == {"k": "a", "v": [1, 2]}
    assert re.search(r"\[1,2\]", "".join(p.read_text() for p in (tmp_path / "r" / "csv").glob("part*")))


def test_two_levels_equal_plain_windows(spark):

    r = random.Random(3)
    rows = [(k, i, r.randrange(1, 9), r.choice(["a", "b", None])) for k, n in (("x", 40), ("y", 3), ("z", 1), (None, 25)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i long, v long, g string")

    def got(frame, *columns):
        return sorted(((x.k or "", x.i, *[x[c] for c in columns]) for x in frame.collect()))

    for wide, args in ((sequence.islands, ("k", "i", "g")), (sequence.timeline, ("k", "i", "v", 1000, 7, 3, "g"))):
        columns = ["island"] if wide is sequence.islands else ["start_ms", "end_ms"]
        assert got(wide(df, *args, block=4), *columns) == got(wide(df, *args, block=None), *columns)
    plain, before = {}, {}
    for k, i, v, g in rows:
        last, n = plain.get(k, {}).get(i - 1, (None, -1))
        plain.setdefault(k, {})[i] = (g, n + 1 if i == 0 or g != last else n)
        before[k, i] = sum(x[2] for x in rows if x[0] == k and x[1] < i)
    assert got(sequence.islands(df, "k", "i", "g", block=4), "island") == sorted((k or "", i, plain[k][i][1]) for k, i, *_ in rows)
    assert got(sequence.running_sum(df, "k", "i", "v", "s", block=4), "s") == sorted((k or "", i, before[k, i]) for k, i, *_ in rows)
    for block in (4, None):
        shares = sequence.apportion(df, ["k"], "i", "v", lambda n: n * 3, block)
        assert got(shares, "first", "last") == sorted((k or "", i, 3 * before[k, i], 3 * (before[k, i] + v)) for k, i, v, _ in rows)
        taken = sequence.prefix_take(df, "k", "i", "v", 20, block)
        assert got(taken, "chars") == sorted((k or "", i, before[k, i] + v) for k, i, v, _ in rows if before[k, i] + v <= 20 or i == 0)
    assert sequence.depth(df, "i") is None and sequence.depth(df, "i", 30) == 30
    swept = [sequence.target_sweep(df, "k", "i", "v", 10, 10, 5, block=b).collect() for b in (4, None)]
    assert sorted(map(repr, swept[0])) == sorted(map(repr, swept[1]))


def test_html_without_every_reference(spark):
    assert one(spark, "<p>a &copy; b &amp;\n&amp</p>", lambda c: X.html_text(c, every=False)) == "a © b &\n&amp"
