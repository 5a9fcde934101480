"""Files: books, pages, tables with synonyms, JSON lines, zip packages, EPUB, WAV. Readers are distributed; archives are unpacked in
Arrow batches on the executors."""

from __future__ import annotations

import base64
import io
import os
import posixpath
import re
import struct
import wave
import xml.etree.ElementTree as ET
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import html_text


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text: one row per file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one or more lines each, under a declared schema; absent keys are null."""
    return spark.read.schema(schema).json(path, multiLine=True)


def events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a declared schema."""
    return spark.read.schema(schema).json(path)


def tab_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A tab-separated table with a header; a value that doesn't fit its type is an error."""
    return spark.read.csv(path, sep="\t", header=True, schema=schema, mode="FAILFAST", quote="")


def tab_entities(spark: SparkSession, path: str, synonyms: dict[str, tuple[str, ...]], whole: tuple[str, ...] = ()) -> DataFrame:
    """A tab-separated table whose columns have several spellings: the first one that isn't empty; -1 for absent whole numbers."""
    raw = spark.read.csv(path, sep="\t", header=True, quote="")
    have = {c.lower(): c for c in raw.columns}

    def pick(name: str, spellings: tuple[str, ...]):
        found = [F.nullif(F.trim(F.col(f"`{have[s.lower()]}`")), F.lit("")) for s in spellings if s.lower() in have]
        value = F.coalesce(*found, F.lit(None).cast("string"))
        return (F.coalesce(value.cast("int"), F.lit(-1)) if name in whole else value).alias(name)

    return raw.select(*[pick(n, s) for n, s in synonyms.items()])


def stream_events(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """JSON lines as a stream; the checkpoint remembers what was read."""
    return spark.readStream.schema(schema).json(folder)


MEMBER = T.StructType([T.StructField("path", T.StringType()), T.StructField("member", T.StringType()), T.StructField("pos", T.IntegerType()), T.StructField("data", T.BinaryType())])


def zip_members(spark: SparkSession, path: str, allowed: str = r".*", most_bytes: int = 1 << 30) -> DataFrame:
    """path, member, pos, data of zip files' members whose clean relative name matches; names that leave the archive are errors."""
    accept = re.compile(allowed)

    def run(batches):
        for b in batches:
            for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for pos, info in enumerate(z.infolist()):
                        name = info.filename.replace("\\", "/")
                        if name.startswith("/") or ".." in name.split("/") or re.match(r"[A-Za-z]:", name):
                            raise ValueError(f"{p}: unsafe member {info.filename!r}")
                        if not info.is_dir() and accept.fullmatch(name):
                            if info.file_size > most_bytes:
                                raise ValueError(f"{p}: member {name!r} has {info.file_size} bytes")
                            yield pa.record_batch([pa.array([p]), pa.array([name]), pa.array([pos], pa.int32()), pa.array([z.read(info)], pa.binary())], names=["path", "member", "pos", "data"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, MEMBER)


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def spine(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Member names and texts of an EPUB's HTML documents in reading order."""
    names = set(z.namelist())
    opf = None
    if "META-INF/container.xml" in names:
        root = ET.fromstring(z.read("META-INF/container.xml"))
        opf = next((e.get("full-path") for e in root.iter() if _local(e.tag) == "rootfile"), None)
    opf = opf or ("content.opf" if "content.opf" in names else None)
    if not opf:
        raise ValueError("the EPUB names no package document")
    package = ET.fromstring(z.read(opf))
    items = {e.get("id"): e.get("href") for e in package.iter() if _local(e.tag) == "item" and "html" in (e.get("media-type") or "")}
    folder = posixpath.dirname(opf)
    out = []
    for e in package.iter():
        href = items.get(e.get("idref")) if _local(e.tag) == "itemref" else None
        name = posixpath.normpath(posixpath.join(folder, href)) if href else None
        if name in names:
            out.append((name, z.read(name).decode("utf-8", "replace")))
    return out


# What a chapter's member name holds.
CHAPTER_NAME = r"(?i)chapter|prologue|epilogue|part"


def epub_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, pos, member, text of EPUB files' documents in reading order."""

    def run(batches):
        for b in batches:
            for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    docs = spine(z)
                yield pa.record_batch([pa.array([p] * len(docs), pa.string()), pa.array(range(len(docs)), pa.int32()), pa.array([m for m, _ in docs], pa.string()), pa.array([h for _, h in docs], pa.string())], names=["path", "pos", "member", "html"])

    raw = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, pos int, member string, html string")
    return raw.select("path", "pos", "member", html_text(F.col("html")).alias("text"))


def select_chapters(docs: DataFrame, book: str, pos: str, member: str, text: str, shortest: int = 300) -> DataFrame:
    """The best tier of a book's documents: those named like chapters, else those that begin with a heading, else the long ones.
    Chapters are numbered before short ones go, so numbers may have gaps."""
    heading = F.regexp_like(F.substring(text, 1, 500), F.lit(r"(?im)^\s*(?:chapter\s+\S+|prologue|epilogue|part\s+\S+)\s*$"))
    tier = F.when(F.regexp_like(F.col(member), F.lit(CHAPTER_NAME)), 1).when(heading, 2).when(F.length(text) >= shortest, 3)
    tiered = docs.withColumn("__tier", tier).withColumn("__best", F.min("__tier").over(Window.partitionBy(book))).filter("__tier = __best")
    number = F.row_number().over(Window.partitionBy(book).orderBy(pos))
    return tiered.withColumn("chapter", F.format_string("chapter_%03d", number)).filter(F.length(text) >= F.when(F.col("__tier") < 3, 1).otherwise(shortest)).drop("__tier", "__best")


def wav_bytes(samples: np.ndarray, rate: int) -> bytes:
    """Mono 16-bit WAV of samples in [-1, 1]."""
    data = (np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + b"data" + struct.pack("<I", len(data)) + data


def wav_column(df: DataFrame, samples: str, rate: int, name: str = "wav") -> DataFrame:
    """df with a WAV file of a column of samples."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{name}` binary"])

    def run(batches):
        for b in batches:
            files = [None if x is None else wav_bytes(np.array(x, np.float32), rate) for x in b.column(b.schema.names.index(samples)).to_pylist()]
            yield pa.record_batch([*b.columns, pa.array(files, pa.binary())], names=[*b.schema.names, name])

    return df.mapInArrow(run, schema)


def resampled(samples: np.ndarray, speed: float) -> np.ndarray:
    """Samples played at another speed, by linear interpolation."""
    n = max(1, round(len(samples) / speed)) if speed != 1 and len(samples) > 1 else len(samples)
    if n == len(samples):
        return samples
    return np.interp(np.linspace(0, len(samples) - 1, n, dtype=np.float32), np.arange(len(samples), dtype=np.float32), samples).astype(np.float32)


def write_events(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def _flat(df: DataFrame) -> list:
    """The columns of a table, nested ones as JSON text."""
    return [F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(c) for c in df.columns]


def markdown_lines(df: DataFrame, order: list[str]) -> DataFrame:
    """n, line: a table as Markdown, its rows in the order of columns that tell them apart; nested cells as JSON, nulls blank, bars escaped, line breaks as spaces."""
    from ..operators.sequence import numbered

    cell = lambda c: F.regexp_replace(F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"\s*[\r\n]+\s*", " ")
    row = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    rows = numbered(df, [F.col(c) for c in order], "__n", 2).select("__n", *_flat(df))
    head = df.sparkSession.createDataFrame([(0, f"| {' | '.join(df.columns)} |"), (1, "| " + " | ".join("---" for _ in df.columns) + " |")], "n long, line string")
    return head.unionByName(rows.select(F.col("__n").alias("n"), row([cell(c) for c in df.columns]).alias("line")))


def write_report(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """A table as CSV, nested columns as JSON text, as JSON lines, and, where an order is given, as Markdown, whose files in the order of their names are one table."""
    df.select(*_flat(df)).write.mode("overwrite").csv(f"{path}/csv", header=True)
    df.write.mode("overwrite").json(f"{path}/json")
    if order:
        markdown_lines(df, order).orderBy("n").select("line").write.mode("overwrite").text(f"{path}/markdown")


def write_chapters(df: DataFrame, path: str, chapter: str = "chapter", text: str = "text") -> None:
    """One folder per chapter with its text, a line break at its end."""
    df.select(chapter, F.rtrim(text).alias("value")).write.mode("overwrite").partitionBy(chapter).text(path)


def stitched_wavs(df: DataFrame, key: str, order: str, wav: str, rate: int) -> DataFrame:
    """key, wav: a chapter's mono 16-bit chunks end to end, in order; another rate, width or channel count is an error. One chapter is one group."""
    kind = df.schema[key].dataType.simpleString()

    def run(group: pa.Table) -> pa.Table:
        out = io.BytesIO()
        with wave.open(out, "wb") as whole:
            whole.setnchannels(1)
            whole.setsampwidth(2)
            whole.setframerate(rate)
            for chunk in group.sort_by(order)[wav].to_pylist():
                with wave.open(io.BytesIO(chunk)) as part:
                    if (part.getframerate(), part.getnchannels(), part.getsampwidth()) != (rate, 1, 2):
                        raise ValueError(f"chunk of {part.getframerate()} Hz, {part.getnchannels()} channels, {8 * part.getsampwidth()} bits in a chapter of {rate} Hz mono 16 bits")
                    whole.writeframes(part.readframes(part.getnframes()))
        return pa.table({key: group[key].slice(0, 1), "wav": pa.array([out.getvalue()], pa.binary())})

    return df.select(key, order, wav).groupBy(key).applyInArrow(run, f"`{key}` {kind}, wav binary")


def _floats(df: DataFrame, column: str, name: str, kind: str, of: pa.DataType, change) -> DataFrame:
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{name}` {kind}"])

    def run(batches):
        for b in batches:
            made = [None if x is None else change(x) for x in b.column(b.schema.names.index(column)).to_pylist()]
            yield pa.record_batch([*b.columns, pa.array(made, of)], names=[*b.schema.names, name])

    return df.mapInArrow(run, schema)


def encoded_audio(df: DataFrame, samples: str, name: str = "samples_b64") -> DataFrame:
    """df with samples as base64 of little-endian 32-bit floats."""
    return _floats(df, samples, name, "string", pa.string(), lambda x: base64.b64encode(np.array(x, "<f4").tobytes()).decode())


def decoded_audio(df: DataFrame, encoded: str, name: str = "samples") -> DataFrame:
    """df with samples from base64 of little-endian 32-bit floats."""
    return _floats(df, encoded, name, "array<float>", pa.list_(pa.float32()), lambda x: np.frombuffer(base64.b64decode(x), "<f4"))


def unit_texts(spark: SparkSession, path: str, first: int = 0, most: int | None = None) -> DataFrame:
    """unit_id, text of a unit file's units (JSON with a list units) from a number on, without blank ones; the first few if asked for."""
    rows = spark.read.schema("units array<struct<unit_id:long,text:string>>").json(path, multiLine=True).select(F.explode("units").alias("u")).select("u.*")
    rows = rows.filter((F.btrim(F.coalesce("text", F.lit(""))) != "") & (F.col("unit_id") >= first)).orderBy("unit_id")
    return rows if most is None else rows.limit(most)


def environment(defaults: dict, prefix: str = "", env: dict | None = None) -> dict:
    """Settings from the environment: a default's type decides how a value is read; absent and blank ones are the default."""
    env = os.environ if env is None else env
    out = {}
    for name, default in defaults.items():
        value = env.get(prefix + name.upper(), "").strip()
        if not value:
            out[name] = default
        elif isinstance(default, bool):
            out[name] = value.lower() in ("1", "true", "yes", "on")
        else:
            out[name] = type(default)(value) if default is not None else value
    return out
