"""EPUB archives to book rows, spine pages, cover items and errors.

An archive is opened once per pass, and its package document is read in the same
pass.  What leaves the pass is one row per book and one per spine page: no row
holds an archive, nothing is joined, and entries that nobody asked for are not
inflated.  ``register`` makes the same pass a data source,
``spark.read.format("epub").load(folder)``, with one file as the unit of work.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator, Sequence
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from narrate_spark import constants as K
from narrate_spark.sources.files import decode_markup

_CONTAINER = "META-INF/container.xml"
_DC = "{http://purl.org/dc/elements/1.1/}"
_OPF = "{http://www.idpf.org/2007/opf}"
# An entry is one cell, and a cell holds less than 2 GB.
_LARGEST = (1 << 31) - 64
_NAMES = ("book_id", "stem", "part", "pos", "name", "content", "title", "author", "language", "error")
ARCHIVE_ROWS = (
    "book_id string, stem string, part string, pos bigint, name string, content binary, "
    "title string, author string, language string, error string"
)
_ARROW = pa.schema(
    [(n, pa.int64() if n == "pos" else pa.binary() if n == "content" else pa.string()) for n in _NAMES]
)
PARTS = ("book", "page")


class _Archive:
    """An open archive with its package document."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.infos = {i.filename: i for i in self.zip.infolist() if not i.is_dir()}
        self.folder, self.root = "", None
        box = self.read(_CONTAINER) or b""
        place = re.search(r'full-path="([^"]+)"', box.decode("utf-8", "replace"))
        if place and (xml := self.read(place[1])) is not None:
            self.folder = place[1].rpartition("/")[0]
            try:
                self.root = ElementTree.fromstring(xml.decode("utf-8", "replace").encode("utf-8"))
            except ElementTree.ParseError:
                self.root = None

    def read(self, name: str) -> bytes | None:
        """An entry, or None when there is none."""
        info = self.infos.get(name)
        if info is None:
            return None
        if info.file_size > _LARGEST:
            raise ValueError(f"{name}: larger than a cell")
        return self.zip.read(info)

    def path(self, href: str) -> str:
        """Entry name of a manifest reference."""
        return posixpath.normpath(posixpath.join(self.folder, unquote(href)))

    def all(self, tag: str) -> list[ElementTree.Element]:
        """Package elements of a kind, in document order."""
        return [] if self.root is None else list(self.root.iter(f"{_OPF}{tag}"))

    def first(self, tag: str) -> str | None:
        """Text of the first metadata element of a kind."""
        found = None if self.root is None else self.root.find(f".//{_DC}{tag}")
        return found.text.strip() if found is not None and found.text else None

    def pages(self) -> Iterator[tuple[int, str, str]]:
        """(spine position, reference, entry) of the documents of the spine that exist."""
        items = {}
        for item in self.all("item"):
            href, media = item.get("href", ""), item.get("media-type", "")
            if media in ("application/xhtml+xml", "text/html") or _suffix(href) in K.HTML_SUFFIXES:
                items[item.get("id")] = href  # of items with one id the last one counts
        refs = [e.get("idref") for e in self.all("itemref")]
        for pos, ref in enumerate(r for r in refs if r is not None and r not in K.SPINE_SKIP_IDS):
            if ref in items and self.path(items[ref]) in self.infos:
                yield pos, items[ref], self.path(items[ref])


def _suffix(path: str) -> str:
    found = re.search(r"(?<=[^/])(\.[^./]+)\Z", path)
    return found[1].lower() if found else ""


def archive_rows(book_id: str | None, stem: str | None, content: bytes | None, parts: Sequence[str]) -> Iterator[dict]:
    """Rows of one archive: its book row, and a row per spine page.

    Whatever an archive holds, it must not end the job: an unreadable archive is a
    book row with its ``error``, an unreadable page a page row with one.
    """
    book = {"book_id": book_id, "stem": stem, "part": "book"}
    try:
        archive = _Archive(content or b"")
        book |= {"title": archive.first("title"), "author": archive.first("creator"), "language": archive.first("language")}
        pages = list(archive.pages()) if "page" in parts else []
    except Exception as exc:  # noqa: BLE001
        book["error"], pages = f"Corrupt or invalid ZIP: {exc}", []
    if "book" in parts:
        yield book
    for pos, name, entry in pages:
        row = {"book_id": book_id, "stem": stem, "part": "page", "pos": pos, "name": name}
        try:
            row["content"] = archive.read(entry)
        except Exception as exc:  # noqa: BLE001
            row["error"] = f"Unreadable page: {exc}"
        yield row


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in _ARROW], schema=_ARROW)


# Page bytes that are sent on together at most, or one page.
_SEND_BYTES = 8 << 20


def read_archives(books: DataFrame, parts: Sequence[str] = PARTS) -> DataFrame:
    """Rows of all archives (book_id, content, and stem if there is one); see ``archive_rows``.

    Only the ``parts`` asked for are made: without ``page`` no page is inflated.
    """
    wanted = tuple(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0
        for batch in batches:
            columns = (batch.column(c) for c in ("book_id", "stem", "content"))
            for book_id, stem, content in zip(*columns, strict=True):
                for row in archive_rows(book_id.as_py(), stem.as_py(), content.as_py(), wanted):
                    held.append(row)
                    size += len(row.get("content") or b"") + 200
                    if size > _SEND_BYTES:
                        yield _batch(held)
                        held, size = [], 0
        yield _batch(held)

    stem = F.col("stem") if "stem" in books.columns else F.lit(None).cast("string")
    rows = books.select(F.col("book_id").cast("string").alias("book_id"), stem.alias("stem"), "content")
    return rows.mapInArrow(run, ARCHIVE_ROWS)


def spine_pages(rows: DataFrame) -> DataFrame:
    """Spine pages of archive rows: book_id, chapter_idx, source_file, markup."""
    pages = rows.where((F.col("part") == "page") & F.col("content").isNotNull())
    return pages.select(
        "book_id",
        F.col("pos").alias("chapter_idx"),
        F.col("name").alias("source_file"),
        decode_markup(F.col("content")).alias("markup"),
    )


def metadata(rows: DataFrame, use_stem: bool = False) -> DataFrame:
    """Title, author and language of every book with the usual defaults.

    With ``use_stem`` an empty title becomes the file stem, as for books that
    were unpacked from a Kindle file.
    """
    title = F.coalesce("title", F.lit(""))
    if use_stem:
        title = F.when(title == "", F.col("stem")).otherwise(title)
    return rows.where(F.col("part") == "book").select(
        "book_id",
        title.alias("title"),
        F.coalesce("author", F.lit("")).alias("author"),
        F.coalesce("language", F.lit("en")).alias("language"),
    )


def archive_errors(rows: DataFrame) -> DataFrame:
    """(book_id, name, error) of archives and pages that cannot be read; the name is null for archives."""
    return rows.where(F.col("error").isNotNull()).select("book_id", "name", "error")


_COVER_ITEM = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("pos", "size")]
    + [T.StructField("is_cover", T.BooleanType())]
    + [T.StructField(n, T.StringType()) for n in ("item_id", "name", "entry", "media_type", "head", "shows")]
)
_IMAGE_SOURCE = re.compile(r"""<img[^>]+src=["']([^"']+)["']""", re.IGNORECASE)
COVER_ITEMS = T.StructType(
    [T.StructField("items", T.ArrayType(_COVER_ITEM)), T.StructField("metas", T.ArrayType(T.StringType()))]
)


def _cover_items(content: bytes | None) -> dict | None:
    archive = _Archive(content or b"")
    items = []
    for pos, item in enumerate(archive.all("item")):
        name, media = item.get("href", ""), item.get("media-type") or ""
        entry = archive.path(name)
        info = archive.infos.get(entry)
        head = shows = None
        if info is not None and not (media.startswith("image/") or _suffix(name) in K.IMAGE_SUFFIXES):
            try:
                text = archive.read(entry).decode("utf-8", "replace")
                found = _IMAGE_SOURCE.search(text)
                head, shows = text[:100], found[1] if found else ""
            except Exception:  # noqa: BLE001  an unreadable page shows nothing
                pass
        items.append(
            {
                "pos": pos, "item_id": item.get("id"), "name": name, "entry": entry, "media_type": media,
                "is_cover": "cover-image" in (item.get("properties") or ""),
                "size": info.file_size if info is not None else 0, "head": head, "shows": shows,
            }
        )
    metas = [e.get("content") for e in archive.all("meta") if e.get("name") == "cover"]
    return {"items": items, "metas": metas}


@F.pandas_udf(COVER_ITEMS)
def cover_items(content: pd.Series) -> pd.DataFrame:
    """Manifest of an archive for ``covers.best_cover``; empty for an unreadable one."""

    def read(value: bytes | None) -> dict:
        try:
            return _cover_items(value)
        except Exception:  # noqa: BLE001
            return {"items": [], "metas": []}

    return pd.DataFrame([read(c) for c in content], columns=["items", "metas"])


def with_entry(rows: DataFrame) -> DataFrame:
    """Replace the archive in ``content`` by its entry that ``entry`` names, null without one."""
    at = rows.columns.index("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(whole.num_rows):  # a batch holds no more than one archive's image
                batch = whole.slice(i, 1)
                content, name = batch.column("content")[0].as_py(), batch.column("entry")[0].as_py()
                try:
                    found = _Archive(content or b"").read(name) if name else None
                except Exception:  # noqa: BLE001
                    found = None
                columns = list(batch.columns)
                columns[at] = pa.array([found], pa.binary())
                yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


class _File(InputPartition):
    def __init__(self, uri: str, place: str):
        self.uri, self.place = uri, place


class _Reader(DataSourceReader):
    def __init__(self, path: str, parts: tuple[str, ...]):
        self.path, self.parts = path, parts

    def _system(self) -> tuple[pyarrow.fs.FileSystem, str]:
        uri = self.path.removeprefix("file:") if self.path.startswith("file:") else self.path
        return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else f"file://{'/' + uri.lstrip('/')}")

    def partitions(self) -> list[InputPartition]:
        system, root = self._system()
        found = system.get_file_info(pyarrow.fs.FileSelector(root, recursive=True))
        return [_File(self.path, f.path) for f in found if f.is_file and f.extension.lower() == "epub"]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with self._system()[0].open_input_stream(partition.place) as stream:
            content = stream.read()
        stem = partition.place.rpartition("/")[2].rpartition(".")[0]
        for row in archive_rows(partition.place, stem, content, self.parts):
            yield tuple(row.get(n) for n in _NAMES)


class EpubSource(DataSource):
    """``spark.read.format("epub").option("parts", "book,page").load(folder)``, one task per file."""

    @classmethod
    def name(cls) -> str:
        """Name of the format."""
        return "epub"

    def schema(self) -> str:
        """Columns of ``read_archives``."""
        return ARCHIVE_ROWS

    def reader(self, schema) -> DataSourceReader:
        """Reader of the folder that ``load`` names."""
        return _Reader(self.options["path"], tuple(self.options.get("parts", ",".join(PARTS)).split(",")))


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(EpubSource)
