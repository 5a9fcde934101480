"""Scripts, casts, libraries, sound files and generation on small cases with known answers."""

import io
import json
import sys
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.operators import cast, generation, library, quality, script
from loomline.sources import files


def test_decoding_is_strict_or_lenient(spark):
    codes = spark.createDataFrame([("c", 0, "Ines"), ("c", 1, "Odo")], "k string, code long, role string")
    rows = spark.createDataFrame([("c", 1), ("c", 2)], "k string, code long")
    assert sorted((r.code, r.role) for r in script.decoded(rows, codes, "k", "code", "role", strict=False).collect()) == [(1, "Odo"), (2, None)]
    with pytest.raises(Exception, match="no role"):
        script.decoded(rows, codes, "k", "code", "role").collect()
    with pytest.raises(Exception, match="no attribution"):
        script.attributed(rows, codes.select("k", "code").filter("code = 0"), "k", "code").collect()


def test_segments_of_a_unit(spark):
    units = [(0, "Go,” said Odo. Off they went.", True), (1, "He said “wait” and “st", True), (2, "No quote ” here", False), (3, None, True)]
    rows = spark.createDataFrame(units, "i long, t string, d boolean")
    got = {}
    for r in script.quote_segments(rows, ["i"], "t", "d").orderBy("i", "part").collect():
        got.setdefault(r.i, []).append((r.is_quote, r.segment))
    assert got == {0: [(True, "Go,”"), (False, "said Odo. Off they went.")], 1: [(False, "He said"), (True, "“wait”"), (False, "and"), (True, "“st")], 2: [(False, "No quote ” here")]}


def test_narration_places(spark):
    text = "  Rain.  Then   sun. "
    got = script.narration_sentences(spark.createDataFrame([("c", text, 7)], "k string, t string, s long"), ["k"], "t", "s").orderBy("part").collect()
    assert [(r.sentence, r.begin - 7, r.end - r.begin) for r in got] == [("Rain.", 2, 5), ("Then sun.", 7, 9)]  # squeezed text is taken to follow on


def test_halving_ends_at_single_rows(spark):
    rows = spark.createDataFrame([("w", i, n) for i, n in enumerate((1, 1, 1, 9, 1))], "k string, i long, n long")
    got = script.halved(rows, ["k"], "i", "n", lambda xs: sum(xs) <= 3).orderBy("first").collect()
    assert [(r.first, r.last, r.ok) for r in got] == [(0, 1, True), (2, 2, True), (3, 3, False), (4, 4, True)]


def test_voice_without_registration(spark):
    jobs = spark.createDataFrame([("a", "Ines", None)], "role_id string, role string, voice_config_path string").withColumn("o", F.lit(1))
    with pytest.raises(Exception, match="no voice"):
        script.voice_paths(jobs, "o").collect()


def test_punkt_or_rule():
    assert script.punkt("Rain fell. Sun rose.") == ["Rain fell.", "Sun rose."]


def test_merge_needs_compatible_ages(spark):
    reg = spark.createDataFrame([(0, "ines_teen", "ines_teen", "ines", "Ines", [], "teen"), (1, "ines_adult", "ines_adult", "ines", "Ines", ["the pilot"], "adult")], "ord long, role_id string, profile_id string, person_id string, display_name string, aliases array<string>, age_stage string")
    new = spark.createDataFrame([(1, "Ines", None, None, [], "adult"), (2, "Ines", None, None, [], "unknown"), (3, "The Pilot!", None, None, [], "teen"), (4, "x", None, "ines", [], "")], "id long, name string, profile_id string, person_id string, aliases array<string>, age_stage string")
    assert {r.id: r.role_id for r in cast.merge_matches(new, reg, "id").collect()} == {1: "ines_adult", 2: "ines_teen", 4: "ines_teen"}


def test_requests(spark):
    have = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    ask = spark.createDataFrame([("c", 0), ("x", 1), ("a", 2)], "k string, o long")
    assert [r.k for r in cast.requested(have, ask, "k", "o").orderBy("position").collect()] == ["c", "a"]
    assert [r.k for r in cast.requested(have, ask.limit(0), "k", "o").orderBy("position").collect()] == ["a", "b", "c"]


def wav(rate, *values):
    return files.wav_bytes(np.array(values), rate)


def test_stitching(spark):
    rows = spark.createDataFrame([("c", 1, bytearray(wav(8000, 0.5))), ("c", 0, bytearray(wav(8000, 0.0, 1.0))), ("d", 0, bytearray(wav(16000, 0.0)))], "k string, o long, w binary")
    whole = files.stitched_wavs(rows.filter("k = 'c'"), "k", "o", "w", 8000).first()["wav"]
    with wave.open(io.BytesIO(whole)) as w:
        assert np.frombuffer(w.readframes(9), "<i2").tolist() == [0, 32767, 16383]
    with pytest.raises(Exception, match="16000 Hz"):
        files.stitched_wavs(rows.filter("k = 'd'"), "k", "o", "w", 8000).collect()


def test_audio_round_trip(spark):
    rows = spark.createDataFrame([(1, [0.5, -1.0]), (2, [])], "i long, s array<float>")
    assert {r.i: r.samples for r in files.decoded_audio(files.encoded_audio(rows, "s"), "samples_b64").collect()} == {1: [0.5, -1.0], 2: []}


def test_settings():
    got = files.environment({"rate": 24000, "fast": False, "speed": 1.0, "name": "x"}, "APP_", {"APP_RATE": "8000", "APP_FAST": "Yes", "APP_NAME": " "})
    assert got == {"rate": 8000, "fast": True, "speed": 1.0, "name": "x"}
    with pytest.raises(ValueError):
        files.environment({"rate": 1}, "", {"RATE": "many"})


def test_units_catalogue_and_discovery(spark, tmp_path):
    (tmp_path / "u.json").write_text(json.dumps({"units": [{"unit_id": 0, "text": "a"}, {"unit_id": 1, "text": " "}, {"unit_id": 2, "text": "b"}, {"unit_id": 3, "text": "c"}]}))
    assert [r.unit_id for r in files.unit_texts(spark, str(tmp_path / "u.json"), 1, 1).collect()] == [2]
    (tmp_path / "library.json").write_text(json.dumps({"books": [{"title": "", "slug": "", "book_root": "/b/one"}, {"title": "T", "slug": "s", "book_root": "/b/two"}]}))
    assert sorted((r.title, r.slug) for r in library.catalogue(spark, str(tmp_path / "library.json")).collect()) == [("T", "s"), ("Untitled Book", "one")]
    for name, title in (("b1", "Zebra"), ("b2", "apple")):
        (tmp_path / "books" / name / "chapters").mkdir(parents=True)
        (tmp_path / "books" / name / "readalong_book.json").write_text(json.dumps({"title": title, "slug": name}))
        (tmp_path / "books" / name / "chapters" / "c1.txt").write_text("x")
    got = library.discovered(spark, str(tmp_path / "books")).collect()
    assert [(r.title, r.n_chapters) for r in got] == [("apple", 1), ("Zebra", 1)]


def test_portable_manifest_and_unsafe_packages(spark):
    got = library.portable({"title": "x", "last_read": {"chapter": "c"}, "stages": {"extra": 1}}, "s", "t", "a")
    assert "last_read" not in got and got["stages"]["extra"] == 1 and got["stages"]["annotated"] and not got["source_included"]
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("../x", "y")
    rows = spark.createDataFrame([("b", bytearray(out.getvalue()))], "k string, p binary")
    with pytest.raises(Exception, match="unsafe"):
        library.unpacked(rows, "k", "p", lambda n: True).collect()


ECHO = """
import json, sys
print("loading a model", flush=True)
for line in sys.stdin:
    r = json.loads(line)
    print(json.dumps({"id": r["id"], **({"error": "no"} if r["command"] == "fail" else {"result": {"n": len(r["payload"]["t"])}})}), flush=True)
"""


def test_worker():
    w = generation.Worker([sys.executable, "-c", ECHO])
    assert w.ask("size", {"t": "abc"}) == {"n": 3} and w.ask("size", {"t": ""}) == {"n": 0}
    with pytest.raises(RuntimeError, match="no"):
        w.ask("fail", {"t": ""})
    w.close()


class Broken(generation.CountingAdapter):
    def generate(self, texts, voices):
        raise OSError("out of memory")


def test_measured_failures_are_rows(spark):
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    rows = spark.createDataFrame([("w", 0, "ab"), ("w", 1, "c")], "k string, o long, t string")
    got = generation.measured(rows, "k", "o", "t", Broken(1, 10)).first()
    assert (got.success, got.error, got.n_chars) == (False, "OSError: out of memory", 3)
    got = generation.measured(rows, "k", "o", "t", generation.CountingAdapter(10, 10), speed=0.0).first()
    assert got.success and got.playback == pytest.approx(30.0)


def test_reading_positions(spark):
    saved = spark.createDataFrame([("c", 1), ("c", 9), ("d", 1)], "k string, u long")
    units = spark.createDataFrame([("c", 1)], "k string, u long")
    assert {(r.k, r.u): r.valid for r in quality.positions(saved, units, "k", "u").collect()} == {("c", 1): True, ("c", 9): False, ("d", 1): False}
