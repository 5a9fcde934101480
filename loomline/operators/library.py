"""Books as rows of a library: discovery, catalogue upserts, status actions, portable manifests, packages, cascades of stages."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.keyed import last_rows

# What can be done with a book in a state: action, label, and whether it opens.
ACTIONS = {
    "fresh_added": ("initialize", "Initialize Book", False),
    "initialized": ("build_registry", "Build Registry", False),
    "annotating": ("annotate", "Annotating", False),
    "registry_ready": ("annotate", "Annotate Book", False),
    "partially_annotated": ("annotate", "Annotate Book", False),
    "registry_review": ("prepare_voices", "Generate Voices", False),
    "registry_reviewed": ("prepare_voices", "Generate Voices", False),
    "annotated": ("prepare_voices", "Generate Voices", False),
    "voices_ready": ("review_registry", "Review Voices", True),
    "audio_ready": ("review_registry", "Review Voices", True),
}
# Stages of a portable book, and what a package must hold.
PORTABLE_STAGES = {"source_added": False, "initialized": True, "global_registry": True, "annotating": False, "annotated": True, "registry_reviewed": True, "voices_ready": True}
REQUIRED = ("readalong_book.json", "registry.json", "toc.json")
REQUIRED_KINDS = {"chapters": r"\Achapters/.*\.txt\z", "units": r"\Aread_along/.*\.units\.json\z"}


def action(status: Column) -> tuple[Column, Column, Column]:
    """action, label and opens of a book's status; an unknown one begins anew."""
    every = []
    for i in range(3):
        out = None
        for name, said in ACTIONS.items():
            out = F.when(status == name, said[i]) if out is None else out.when(status == name, said[i])
        every.append(out.otherwise(ACTIONS["fresh_added"][i]))
    return tuple(every)


def resume_action(status: Column, has_registry: Column, progress: Column) -> Column:
    """The label of a book's resume button, or blank."""
    early = ~has_registry | status.isin("fresh_added", "initialized", "annotating")
    return F.when(early, "").when(progress == "failed", "Retry Annotation").when(progress == "running", "Resume Annotation").otherwise("")


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """title, slug, book_root, epub_path, author of a library's catalogue file; a book without a title or slug gets one."""
    book = "array<struct<title:string,slug:string,book_root:string,epub_path:string,author:string>>"
    rows = spark.read.schema(f"books {book}").json(path, multiLine=True).select(F.explode("books").alias("b")).select("b.*")
    given = lambda c: F.nullif(F.btrim(F.coalesce(c, F.lit(""))), F.lit(""))
    folder = F.element_at(F.split(F.rtrim(F.replace("book_root", F.lit("\\"), F.lit("/")), F.lit("/")), "/"), -1)
    return rows.withColumns({"title": F.coalesce(given("title"), F.lit("Untitled Book")), "slug": F.coalesce(given("slug"), given(folder), F.lit("book"))})


def discovered(spark: SparkSession, root: str) -> DataFrame:
    """book, title, slug, n_chapters of every folder below root that holds a book's manifest, by title and slug without case."""
    manifest = spark.read.schema("title string, slug string").option("pathGlobFilter", "readalong_book.json").json(f"{root}/*", multiLine=True).select(F.col("_metadata.file_path").alias("path"), "title", "slug")
    book = F.element_at(F.split("path", "/"), -2)
    chapters = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(root).select("path").filter(F.contains("path", F.lit("/chapters/")))
    counts = chapters.groupBy(F.element_at(F.split("path", "/"), -3).alias("book")).agg(F.count("*").alias("n_chapters"))
    rows = manifest.select(book.alias("book"), F.coalesce("title", book).alias("title"), F.coalesce("slug", book).alias("slug"))
    return sorted_books(rows.join(counts, "book", "left").fillna({"n_chapters": 0}))


def sorted_books(books: DataFrame) -> DataFrame:
    return books.orderBy(F.lower("title"), F.lower("slug"))


def upserted(stored: DataFrame, fresh: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """stored with the rows of fresh in place of those of the same key. Repeated keys of fresh leave their last row by order, else the greatest."""
    new = last_rows(fresh, key, order)
    return stored.join(new.select(key), key, "left_anti").select(*fresh.columns).unionByName(new)


def removed(stored: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """stored without the keys that are gone."""
    return stored.join(gone.select(key).distinct(), key, "left_anti")


def invalidated(artifacts: DataFrame, changed: DataFrame, key: str, kind: str, dependants: tuple[str, ...] = ("tts_script", "qwen_script", "audio", "timeline")) -> DataFrame:
    """artifacts without those that depend on a changed chapter."""
    hit = changed.select(key).distinct().withColumn("__hit", F.lit(True))
    met = artifacts.join(hit, key, "left")
    return met.filter(F.col("__hit").isNull() | ~F.col(kind).isin(*dependants)).drop("__hit")


# The artifact of each stage, and what it is made from.
MADE_FROM = (("units", "text"), ("registry", "text"), ("annotation", "units"), ("annotation", "registry"), ("voices", "registry"), ("tts_script", "annotation"), ("tts_script", "voices"), ("audio", "tts_script"), ("timeline", "audio"), ("audiobook", "timeline"))


def depends_on(spark: SparkSession, made_from: DataFrame) -> DataFrame:
    """kind, source: what each kind of artifact depends on over any number of steps. made_from: kind, source, one step each; cycles end.

    A recursive query over a table of kinds, which the stages bound, not the artifacts.
    """
    steps = made_from.select("kind", "source").filter("kind is not null and source is not null").distinct()
    return spark.sql("WITH RECURSIVE d(kind, source, way) AS (SELECT kind, source, array(kind, source) FROM {s} UNION ALL SELECT d.kind, s.source, array_append(way, s.source) FROM d JOIN {s} AS s ON s.kind = d.source WHERE NOT array_contains(way, s.source)) SELECT DISTINCT kind, source FROM d WHERE kind <> source", s=steps)


def cascaded(artifacts: DataFrame, changed: DataFrame, key: str, kind: str, made_from: DataFrame | None = None) -> DataFrame:
    """artifacts without those that depend, over any number of steps, on one that changed. changed: key, kind. made_from: kind, source; MADE_FROM by default.

    What changed itself stays. Null keys and kinds depend on nothing.
    """
    spark = artifacts.sparkSession
    steps = spark.createDataFrame(MADE_FROM, "kind string, source string") if made_from is None else made_from
    closure = depends_on(spark, steps).select(F.col("kind").alias("__kind"), F.col("source").alias("__source"))
    gone = changed.select(key, F.col(kind).alias("__source")).distinct().join(F.broadcast(closure), "__source").select(key, F.col("__kind").alias(kind)).distinct()
    return artifacts.join(gone, [key, kind], "left_anti").select(*artifacts.columns)


def open_stages(artifacts: DataFrame, key: str, kind: str, made_from: DataFrame | None = None) -> DataFrame:
    """key, kind: the stages that a book lacks and could run now, as it has all that these are made from."""
    spark = artifacts.sparkSession
    steps = spark.createDataFrame(MADE_FROM, "kind string, source string") if made_from is None else made_from
    needs = steps.groupBy("kind").agg(F.count_distinct("source").alias("__needs"))
    have = artifacts.select(key, F.col(kind).alias("source")).distinct()
    ready = have.join(F.broadcast(steps.distinct()), "source").groupBy(key, "kind").agg(F.count("*").alias("__has")).join(F.broadcast(needs), "kind").filter("__has = __needs")
    return ready.select(key, F.col("kind").alias(kind)).join(have.withColumnRenamed("source", kind), [key, kind], "left_anti")


def initialised(stored: DataFrame, books: DataFrame, key: str, default: DataFrame) -> DataFrame:
    """stored with default's row for every book that has none; of several, the greatest."""
    return stored.unionByName(last_rows(default, key).join(books.select(key), key, "left_semi").join(stored.select(key), key, "left_anti"))


def resolved_titles(books: DataFrame, registry: DataFrame, library: DataFrame, root: str = "book_root", slug: str = "slug") -> DataFrame:
    """books (root, slug) with title and slug: the registry's, if it has both; else the library's by path, else by slug; else the folder's name."""
    given = lambda c: F.nullif(F.btrim(F.coalesce(c, F.lit(""))), F.lit(""))
    reg = registry.select(root, given("title").alias("__t0"), given("slug").alias("__s0")).filter("__t0 IS NOT NULL AND __s0 IS NOT NULL").dropDuplicates([root])
    by_root = library.groupBy(root).agg(F.min(F.struct("ord", "title", "slug")).alias("__r"))
    by_slug = library.groupBy(F.col("slug").alias("__slug")).agg(F.min(F.struct("ord", "title", "slug")).alias("__g"))
    met = books.join(reg, root, "left").join(by_root, root, "left").join(by_slug, books[slug] == F.col("__slug"), "left")
    folder = F.element_at(F.split(F.rtrim(root, F.lit("/")), "/"), -1)
    first = F.least("__r", "__g")
    found = F.coalesce(first, F.col("__r"), F.col("__g"))
    title = F.coalesce("__t0", F.when(found.isNotNull(), F.coalesce(given(found["title"]), F.lit("Untitled Book"))), given(folder), F.lit("Untitled Book"))
    name = F.coalesce("__s0", F.when(found.isNotNull(), F.coalesce(given(found["slug"]), given(folder), F.lit("book"))), given(F.col(slug)), given(folder), F.lit("book"))
    return met.select(root, title.alias("title"), name.alias("slug"))


def portable(manifest: dict, slug: str, title: str, author: str) -> dict:
    """A book's manifest as it leaves the machine: fixed stages, no source, no reading position."""
    stages = {**(manifest.get("stages") or {}), **PORTABLE_STAGES}
    return {**{k: v for k, v in manifest.items() if k != "last_read"}, "schema": "readalong_book_v1", "title": title, "author": author, "slug": slug, "source_epub_path": "", "source_included": False, "stages": stages}


def packages(members: DataFrame, key: str, path: str, data: str, allowed: Callable[[str], bool]) -> DataFrame:
    """key, package: a zip of each book's allowed members, sorted by name. One book's files are one group."""
    kind = members.schema[key].dataType.simpleString()

    def run(group: pa.Table) -> pa.Table:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, content in sorted(zip(group[path].to_pylist(), group[data].to_pylist())):
                if allowed(name):
                    z.writestr(zipfile.ZipInfo(name), content or b"")
        return pa.table({key: group[key].slice(0, 1), "package": pa.array([out.getvalue()], pa.binary())})

    return members.select(key, path, data).groupBy(key).applyInArrow(run, f"`{key}` {kind}, package binary")


def unpacked(packages_: DataFrame, key: str, package: str, allowed: Callable[[str], bool]) -> DataFrame:
    """key, path, data of packages' allowed members; names that leave the archive are errors. The inverse of packages."""
    kind = packages_.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for i, content in enumerate(b.column(1).to_pylist()):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in z.infolist():
                        if info.filename.startswith("/") or ".." in info.filename.split("/"):
                            raise ValueError(f"unsafe member {info.filename!r}")
                        if allowed(info.filename):
                            yield pa.record_batch([b.column(0).slice(i, 1), pa.array([info.filename]), pa.array([z.read(info)], pa.binary())], names=[key, "path", "data"])

    return packages_.select(key, package).mapInArrow(run, f"`{key}` {kind}, path string, data binary")


def audio_counts(files: DataFrame, key: str, folder: str, chapter: str, folders: tuple[str, ...] = ("audio", "audiobook")) -> DataFrame:
    """key, n: chapters with a sound file in any of the folders."""
    return files.filter(F.col(folder).isin(*folders)).groupBy(key).agg(F.count_distinct(chapter).alias("n"))


def harness_totals(rows: DataFrame, key: str) -> DataFrame:
    """Sums of a book's chapters and the prompt characters saved, not below zero. rows: settled, asked, failed, asked_chars, full_chars."""
    sums = rows.groupBy(key).agg(*[F.sum(c).alias(c) for c in ("settled", "asked", "failed", "asked_chars", "full_chars")])
    return sums.withColumn("saved_chars", F.greatest(F.lit(0), F.col("full_chars") - F.col("asked_chars")))


def next_stages(chapters: DataFrame, key: str, order: str, stages: tuple[str, ...]) -> DataFrame:
    """key, chapter, stage: the first stage that a book's first unfinished chapter lacks; done chapters are passed by.

    chapters: key, order and a boolean column for each stage.
    """
    first = None
    for s in stages:
        first = F.when(~F.coalesce(s, F.lit(False)), s) if first is None else first.when(~F.coalesce(s, F.lit(False)), s)
    rows = chapters.withColumn("stage", first).filter("stage IS NOT NULL")
    return rows.groupBy(key).agg(F.min(order).alias(order), F.min_by("stage", order).alias("stage"))


def ready_totals(units: DataFrame, key: str, unit: str, seconds: str, without: str | None = None) -> DataFrame:
    """key, n, seconds and mean of a buffer's ready units; a row's own `without` unit counts in n and mean alone."""
    counted = F.sum(seconds) if without is None else F.sum(F.when(~F.col(unit).eqNullSafe(F.col(without)), F.col(seconds)).otherwise(0.0))
    return units.groupBy(key).agg(F.count("*").alias("n"), counted.alias("seconds"), F.avg(seconds).alias("mean_seconds"))


def playback(samples: Column, rate: Column, speed: Column) -> Column:
    """Seconds that samples last at a speed, which is 0.1 at least."""
    return samples / rate / F.greatest(F.lit(0.1), speed)


def numbered(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """name: places from 0 by the order columns, the last of which tells all rows apart, so equal ones keep their input order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long") - 1)


def manifest_json(columns: dict[str, Column]) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in columns.items()]))


def write_json(df: DataFrame, path: str) -> None:
    """Replaces a folder of JSON lines; readers see the old files or, once the job has committed, the new ones."""
    df.write.mode("overwrite").json(path)


def failure_rows(df: DataFrame, event: str, error: str, details: list[str], hide: Callable[[Column], Column]) -> DataFrame:
    """One JSON text per failed row, secrets hidden in every part of it."""
    return df.filter(F.col(error).isNotNull()).select(hide(F.to_json(F.struct(F.lit(event).alias("event_type"), F.struct(*details).alias("details"), F.col(error).alias("exception")))).alias("failure"))


def json_bytes(value: dict) -> bytes:
    return json.dumps(value, ensure_ascii=False, indent=2).encode()
