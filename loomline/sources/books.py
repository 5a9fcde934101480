"""Import of book packages into a library folder, all or nothing.

Members are written by all tasks below a staging folder that no reader looks at. Once every task is done, the commit checks
that each book is whole, gives it a free slug and moves its folder into the library; if a book fails or a move does, nothing is
left behind.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..operators.library import REQUIRED, REQUIRED_KINDS, json_bytes, portable
from .tail import store

# What a package's own manifest is called and says, the book's manifest, and the members that may be in it.
PACKAGE, PACKAGE_SCHEMA, MANIFEST = "readalong_package.json", "readalong_package_v1", "readalong_book.json"
ALLOWED = (
    r"readalong_package\.json|readalong_book\.json|registry\.json|toc\.json",
    r"(?:chapters|sentence_segments|annotations|temp_registries)/.+",
    r"read_along/(?:settings|narrator_profile)\.json|audiobook/(?:settings|narrator_profile)\.json|read_along/.*\.units\.json",
    r"voices/[^/]+\.qvp|voices/_samples/[^/]+\.wav",
)


def member_path(name: str) -> str:
    """A member's clean relative path; names that leave the book or aren't part of one are errors."""
    clean = name.replace("\\", "/").strip("/")
    if not clean or re.match(r"[A-Za-z]:", clean) or any(p in ("", ".", "..") for p in clean.split("/")):
        raise ValueError(f"unsafe member {name!r}")
    if not any(re.fullmatch(a, clean) for a in ALLOWED):
        raise ValueError(f"unsupported member {clean!r}")
    return clean


def folder_slug(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", text.strip().lower()).strip("-") or "imported-book"


def free_slug(base: str, taken: Callable[[str], bool], tried: dict[str, int]) -> str:
    """base, or the first of base-2, base-3 ... that isn't taken. tried: by base, the numbers below which none is free; so a batch tries each once."""
    n = tried.get(base, 1)
    slug = lambda: base if n == 1 else f"{base}-{n}"
    while taken(slug()):
        n += 1
    tried[base] = n
    return slug()


def required(path: str) -> set[str]:
    """Which of the things that a book must hold a member is."""
    return {r for r in REQUIRED if r == path} | {k for k, pattern in REQUIRED_KINDS.items() if re.match(pattern.replace(r"\z", r"\Z"), path)}


@dataclass
class Written(WriterCommitMessage):
    """By book: the slug asked for, and what it must hold that this task wrote."""

    books: dict[str, tuple[str, set[str]]] = field(default_factory=dict)


class BookWriter(DataSourceWriter):
    def __init__(self, root: str, overwrite: bool):
        if overwrite:
            raise ValueError("books are added: use append")
        self.root, self.staging = root.rstrip("/"), f"_staging-{uuid.uuid4().hex}"

    def _places(self) -> tuple[fs.FileSystem, str, str]:
        system, root = store(self.root)
        return system, root, f"{root}/{self.staging}"

    @staticmethod
    def _folder(book: str) -> str:
        return hashlib.sha256(book.encode()).hexdigest()[:32]

    def write(self, iterator: Iterator) -> Written:
        """A task that runs again writes the same files."""
        system, _, staging = self._places()
        done, there = Written(), set()
        for book, slug, path, data in iterator:
            path = member_path(path or "")
            file = f"{staging}/{self._folder(book)}/{path}"
            folder = file.rsplit("/", 1)[0]
            if folder not in there:
                system.create_dir(folder, recursive=True)
                there.add(folder)
            with system.open_output_stream(file) as out:
                out.write(bytes(data or b""))
            old = done.books.get(book, ("", set()))
            done.books[book] = (old[0] or slug or "", old[1] | required(path))
        return done

    def commit(self, messages: list) -> None:
        system, root, staging = self._places()
        books: dict[str, tuple[str, set[str]]] = {}
        for m in messages:
            for book, (slug, has) in (m.books if m else {}).items():
                old = books.get(book, ("", set()))
                books[book] = (old[0] or slug, old[1] | has)
        moved: list[str] = []
        tried: dict[str, int] = {}
        try:
            for book, (asked, has) in sorted(books.items()):
                lacks = sorted({*REQUIRED, *REQUIRED_KINDS} - has)
                if lacks:
                    raise ValueError(f"book {book!r} lacks {', '.join(lacks)}")
            for book, (asked, _) in sorted(books.items()):
                folder = f"{staging}/{self._folder(book)}"
                own, package = self._json(system, f"{folder}/{MANIFEST}"), self._json(system, f"{folder}/{PACKAGE}")
                if package and package.get("schema") != PACKAGE_SCHEMA:
                    raise ValueError(f"book {book!r} is of a package schema that isn't supported")
                if not own:
                    raise ValueError(f"book {book!r} has an empty manifest")
                title = str(own.get("title") or package.get("title") or "Imported Book")
                slug = free_slug(folder_slug(asked or str(own.get("slug") or package.get("source_slug") or title)), lambda s: system.get_file_info(f"{root}/{s}").type != fs.FileType.NotFound, tried)
                with system.open_output_stream(f"{folder}/{MANIFEST}") as out:
                    out.write(json_bytes(portable(own, slug, title, str(own.get("author") or package.get("author") or ""))))
                if package:
                    system.delete_file(f"{folder}/{PACKAGE}")
                system.move(folder, f"{root}/{slug}")
                moved.append(slug)
        except Exception:
            for slug in moved:
                system.delete_dir(f"{root}/{slug}")
            self.abort(messages)
            raise
        self.abort(messages)

    def abort(self, messages: list) -> None:
        """Nothing of the staging folder stays."""
        system, _, staging = self._places()
        system.delete_dir_contents(staging, missing_dir_ok=True)
        if system.get_file_info(staging).type != fs.FileType.NotFound:
            system.delete_dir(staging)

    @staticmethod
    def _json(system: fs.FileSystem, path: str) -> dict:
        if system.get_file_info(path).type == fs.FileType.NotFound:
            return {}
        with system.open_input_stream(path) as f:
            return json.loads(f.read())


class BookSource(DataSource):
    """Format book_library: rows book, slug, path, data go to folders of the library at path."""

    @classmethod
    def name(cls) -> str:
        return "book_library"

    def schema(self) -> str:
        return "book string, slug string, path string, data binary"

    def writer(self, schema, overwrite: bool) -> BookWriter:
        return BookWriter(self.options["path"], overwrite)


def library_books(spark: SparkSession, root: str, tasks: int | None = None) -> DataFrame:
    """slug, manifest (JSON text), n_chapters, n_bytes of the chapters of each book of a library. One listing names the books; their folders are listed and read by
    the tasks that they are dealt to, so the driver holds no file."""

    def names(batches):
        for _ in batches:
            system, path = store(root)
            found = [f.base_name for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.type == fs.FileType.Directory and not f.base_name.startswith("_")]
            for lo in range(0, len(found), 10_000):
                yield pa.record_batch([pa.array(found[lo : lo + 10_000], pa.string())], names=["slug"])

    def read(batches):
        system, path = store(root)
        for b in batches:
            rows = []
            for slug in b.column(0).to_pylist():
                with system.open_input_stream(f"{path}/{slug}/{MANIFEST}") as f:
                    manifest = f.read().decode()
                sizes = [f.size for f in system.get_file_info(fs.FileSelector(f"{path}/{slug}/chapters", allow_not_found=True, recursive=True)) if f.type == fs.FileType.File]
                rows.append((slug, manifest, len(sizes), sum(sizes)))
            columns = list(zip(*rows)) if rows else [()] * 4
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["slug", "manifest", "n_chapters", "n_bytes"])

    dealt = spark.range(1, numPartitions=1).mapInArrow(names, "slug string").repartition(tasks or int(spark.conf.get("spark.sql.shuffle.partitions")))
    return dealt.mapInArrow(read, "slug string, manifest string, n_chapters long, n_bytes long")


def import_books(members: DataFrame, root: str, book: str = "book", slug: str | None = None, path: str = "path", data: str = "data") -> None:
    """Adds the books of a table of package members (as files.zip_members or library.unpacked give them) to a library folder.

    slug: a column with the folder name asked for; else the manifest's slug, else its title. A taken name gets -2, -3 ..., books of one batch in the order of their keys. An unsafe, unsupported
    or missing member of any book is an error that leaves the library as it was. No rows add nothing.
    """
    members.sparkSession.dataSource.register(BookSource)
    asked = F.coalesce(F.col(slug).cast("string"), F.lit("")) if slug else F.lit("")
    members.select(F.col(book).cast("string").alias("book"), asked.alias("slug"), F.col(path).alias("path"), F.col(data).alias("data")).write.format("book_library").mode("append").save(root)
