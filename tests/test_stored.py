"""Streams that tail files, imports of books, and tables of keys."""

import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from loomline.sources import books, keyed, tail
from loomline.streaming.stateful import drain


def lines(spark, path, checkpoint, **options):
    return sorted((r["at"], r["line"]) for r in drain(tail.tail_lines(spark, path, **options), checkpoint=checkpoint).collect())


def test_tail_resumes_mid_file_and_holds_half_lines_back(spark, tmp_path):
    file, check = tmp_path / "log" / "events.jsonl", str(tmp_path / "check")
    file.parent.mkdir()
    file.write_text("one\ntwö\nhal")
    assert lines(spark, str(file.parent), check) == [(0, "one"), (4, "twö")]
    with file.open("a") as f:
        f.write("f\n\nlast\nopen")
    (file.parent / "other.jsonl").write_text("x\n")
    (file.parent / "skipped.txt").write_text("no\n")
    assert lines(spark, f"file:{file.parent}", check, suffix=".jsonl") == [(0, "x"), (9, "half"), (14, ""), (15, "last")]
    assert lines(spark, str(file.parent), check, suffix=".jsonl") == []
    file.write_text("")
    with pytest.raises(Exception, match="gone|shrunk"):
        lines(spark, str(file.parent), check, suffix=".jsonl")


@pytest.mark.parametrize("part", [1, 7, 64, 1 << 20])
def test_tail_parts_give_each_line_once(spark, tmp_path, part):
    text = [f"{'é' * (i % 9)}{i}" for i in range(60)]
    (tmp_path / "a.log").write_text("\n".join(text) + "\nrest")
    assert [x for _, x in lines(spark, str(tmp_path / "a.log"), str(tmp_path / "c"), part=part)] == text


def test_tail_of_nothing(spark, tmp_path):
    assert lines(spark, str(tmp_path / "absent"), str(tmp_path / "c")) == []


def test_tail_events(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"kind": "start", "n": 1}\n\n{"kind": "end"}\n')
    got = drain(tail.tail_events(spark, str(tmp_path / "a.jsonl"), "kind string, n int"), checkpoint=str(tmp_path / "c"))
    assert [(r["kind"], r["n"]) for r in got.orderBy("at").collect()] == [("start", 1), ("end", None)]
    (tmp_path / "b.jsonl").write_text("no json\n")
    with pytest.raises(Exception):
        drain(tail.tail_events(spark, str(tmp_path / "b.jsonl"), "kind string"), checkpoint=str(tmp_path / "d")).collect()


def members(spark, *books_, extra=()):
    whole = lambda b, title: [(b, p, json.dumps({"title": title, "slug": title, "last_read": 3}).encode() if p == books.MANIFEST else p.encode()) for p in (books.MANIFEST, "registry.json", "toc.json", "chapters/one.txt", "read_along/one.units.json")]
    return spark.createDataFrame([r for b, t in books_ for r in whole(b, t)] + list(extra), "book string, path string, data binary").repartition(4)


def tree(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names if not f.endswith(".crc"))


def test_import_gives_free_slugs(spark, tmp_path):
    root = str(tmp_path / "library")
    books.import_books(members(spark, ("a", "The Harbour!"), ("b", "the harbour"), ("c", "日本")), root)
    assert sorted(os.listdir(root)) == ["imported-book", "the-harbour", "the-harbour-2"]
    books.import_books(members(spark, ("a", "The Harbour"), extra=[("a", books.PACKAGE, b'{"schema": "readalong_package_v1"}')]).withColumn("slug", F.lit("Mine")), f"file:{root}", slug="slug")
    assert tree(f"{root}/mine") == ["chapters/one.txt", "read_along/one.units.json", "readalong_book.json", "registry.json", "toc.json"]
    manifest = json.load(open(f"{root}/the-harbour-2/{books.MANIFEST}"))
    assert (manifest["title"], manifest["slug"], "last_read" in manifest) == ("the harbour", "the-harbour-2", False)


@pytest.mark.parametrize("row,error", [(("b", "../evil", b""), "unsafe"), (("b", "notes.doc", b""), "unsupported"), (("c", "registry.json", b""), "lacks"), (("a", books.PACKAGE, b'{"schema": "v9"}'), "schema")])
def test_a_failing_member_leaves_nothing_behind(spark, tmp_path, row, error):
    root = str(tmp_path / "library")
    books.import_books(members(spark, ("a", "old")), root)
    before = tree(root)
    with pytest.raises(Exception, match=error):
        books.import_books(members(spark, ("a", "new"), ("b", "other"), extra=[row]), root)
    assert tree(root) == before and os.listdir(root) == ["old"]


def test_upserts_are_seen_whole(spark, tmp_path):
    t = keyed.KeyedTable(spark, str(tmp_path / "t"), "k", "k string, v int", buckets=4)
    frame = lambda rows: spark.createDataFrame(rows, "k string, v int, o int")
    got = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert t.version() == (0, {}) and got(t.read()) == []
    assert t.upsert(frame([("a", 1, 1), ("b", 2, 1), (None, 0, 1)])) == 1
    old = t.read()
    assert t.upsert(frame([("b", 5, 2), ("b", 4, 3), ("c", 6, 1), (None, 9, 1)]), "o") == 2
    assert got(old) == [("a", 1), ("b", 2), (None, 0)]  # a reader of the version before
    assert got(t.read()) == [("a", 1), ("b", 4), ("c", 6), (None, 9)]
    assert t.upsert(frame([])) == 2
    t.vacuum()
    assert got(t.read()) == [("a", 1), ("b", 4), ("c", 6), (None, 9)] and t.version()[0] == 2


def test_upserts_at_the_same_time_lose_nothing(spark, tmp_path):
    t = keyed.KeyedTable(spark, str(tmp_path / "t"), "k", "k int, v int", buckets=2)
    run = [threading.Thread(target=lambda i=i: t.upsert(spark.createDataFrame([(i, i), (100, i)], "k int, v int"), tries=20)) for i in range(3)]
    [x.start() for x in run]
    [x.join() for x in run]
    rows = {r["k"]: r["v"] for r in t.read().collect()}
    assert {k: v for k, v in rows.items() if k < 100} == {0: 0, 1: 1, 2: 2} and t.version()[0] == 3


def test_a_batch_tries_each_slug_once(spark, tmp_path):
    tried, asked = {}, []
    free = {"a", *(f"a-{n}" for n in range(2, 300))}
    for _ in range(200):
        slug = books.free_slug("a", lambda s: asked.append(s) or s not in free, tried)
        free.remove(slug)
    assert slug == "a-200" and len(asked) < 500
    root = str(tmp_path / "library")
    books.import_books(members(spark, ("a", "One"), ("b", "One"), ("c", "Two"), extra=[("c", "chapters/more/2.txt", b"12")]), root)
    assert sorted((r.slug, json.loads(r.manifest)["title"], r.n_chapters, r.n_bytes) for r in books.library_books(spark, root).collect()) == [("one", "One", 1, 16), ("one-2", "One", 1, 16), ("two", "Two", 2, 18)]
    assert books.library_books(spark, str(tmp_path / "none")).count() == 0
