"""The tree of book files as tables, and back.

Files are planned by name: `tree_files` lists paths and sizes without opening any, and what is asked of a tree (which books, which
pages of which stage, what is missing) is answered from that table. Texts are read only for pages that a query has chosen, by
the tasks that hold them. Paths are those of any store that Spark lists; `open_store` reaches it through Arrow.

A tree below its root: output/BOOK/pages/p.0001.SLUG.md, output/BOOK/manifest.json, output/BOOK/BIBLIO.json and
tmp/BOOK/STAGE/p.0001.SLUG..., where BOOK has 64 hexadecimal digits.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from quire.functions.text import truncate

#: Areas, stages and the form of names.
STAGES = ("stage1OCR", "stage2Vision", "stage3Editor", "pages")
PLACE = r"/(output|tmp)/([0-9a-f]{64})/(?:(pages|stage1OCR|stage2Vision|stage3Editor)/)?([^/]+)$"
PAGE_NAME = r"^p\.(\d{4})\."
BIBLIOGRAPHY = (
    "struct<schema_version: string, source_sha256: string, slug: string, node_id: string, corpus_node: struct<authors: string, title: string, year: int, in_corpus: boolean, incomplete: boolean>, "
    "entries: array<struct<id: string, authors: string, title: string, year: int, line: int, raw: string, extras: map<string, string>, all_unknown: boolean, incomplete: boolean, aligned_page: int, original_page: int>>>"
)
GRAPH = (
    "struct<schema_version: string, nodes: map<string, struct<authors: string, title: string, year: int, in_corpus: boolean, source_sha256: string>>, "
    "edges: array<struct<from: string, to: string, source_sha256: string, aligned_pages: array<int>>>>"
)
ARTICLES = "struct<articles: map<string, struct<poh_id: string, title: string, snippet: string, url: string, no_material: boolean, generated_at: string>>>"


def tree_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, area, book, stage, page, size) of the files of the books in a tree; stage and page are null for other files than pages.

    Only names and sizes are read. Files elsewhere, or under a folder that is no book's id, are not there, nor are files of no bytes
    (Spark plans none) and folders without others.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size"))
    part = lambda k: F.nullif(F.regexp_extract("path", PLACE, k), F.lit(""))
    rows = listed.select("path", part(1).alias("area"), part(2).alias("book"), part(3).alias("stage"), part(4).alias("name"), "size").where("book is not null")
    page = F.when(F.col("stage").isNotNull(), F.nullif(F.regexp_extract("name", PAGE_NAME, 1), F.lit("")).cast("int"))
    return rows.select("path", "area", "book", F.when(page.isNotNull(), F.col("stage")).alias("stage"), page.alias("page"), "name", "size")


def books_in(files: DataFrame) -> DataFrame:
    """The distinct books (book) of a tree."""
    return files.select("book").distinct()


def pages_in(files: DataFrame) -> DataFrame:
    """Distinct (book, stage, page) of page files."""
    return files.where("page is not null").select("book", "stage", "page").distinct()


def last_pages(files: DataFrame) -> DataFrame:
    """(book, last): the highest page number of any stage."""
    return files.where("page is not null").groupBy("book").agg(F.max("page").alias("last"))


def expected_pages(files: DataFrame, listed: DataFrame, counts: DataFrame, excluded: DataFrame) -> DataFrame:
    """(book, page): the pages that a manifest lists (book, page) or that any stage has; of books with neither 1 to n (counts: book, n). Excluded ones (book, page) are left out."""
    seen = listed.select("book", "page").union(pages_in(files).select("book", "page")).where("page is not null").distinct()
    blind = counts.where("n > 0").groupBy("book").agg(F.max("n").alias("n")).join(seen, "book", "left_anti").select("book", F.explode(F.sequence(F.lit(1), "n")).alias("page"))
    return seen.unionByName(blind).join(excluded.select("book", "page"), ["book", "page"], "left_anti")


def missing_pages(files: DataFrame, expected: DataFrame) -> DataFrame:
    """(book, stage, page): expected pages (book, page) that a stage has no file of."""
    wanted = expected.select("book", "page", F.explode(F.lit(list(STAGES))).alias("stage"))
    return wanted.join(files.where("page is not null").select("book", "page", "stage").distinct(), ["book", "page", "stage"], "left_anti")


def open_store(path: str):
    """(file system, path in it) of a path or URI as Spark writes it."""
    from pyarrow import fs

    local = path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")
    return (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(path)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row at a time, as the texts of a batch may be many times its size."""
    for batch in batches:
        for k, path in enumerate(batch.column("path").to_pylist()):
            text = None
            if path is not None:
                store, at = open_store(path)
                try:
                    with store.open_input_stream(at) as f:
                        text = f.read().decode("utf-8", "replace").removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
                except OSError:
                    text = None
            row = batch.slice(k, 1)
            yield pa.RecordBatch.from_arrays([*row.columns, pa.array([text], pa.string())], names=[*row.schema.names, "text"])


def loaded_texts(candidates: DataFrame, manifest: DataFrame, root: str, budget: int | None = None) -> DataFrame:
    """(book, page, text, truncated): the Markdown of candidate pages (book, page), null where the manifest (book, page, file) has none or it can't be read.

    file is a path below the book's output folder. Texts are cut to a budget of characters, if there is one. Only chosen files are opened.
    """
    place = F.concat(F.lit(f"{root.rstrip('/')}/output/"), "book", F.lit("/"), "file")
    first = manifest.where("trim(file) <> ''").groupBy("book", "page").agg(F.min("file").alias("file"))
    rows = candidates.select("book", "page").distinct().join(first, ["book", "page"], "left").select("book", "page", place.alias("path"))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("book", "page"))
    read = rows.mapInArrow(_texts, f"{kinds}, path string, text string")
    cut = truncate(F.col("text"), budget) if budget else F.col("text")
    return read.select("book", "page", cut.alias("text"), (F.length("text") > (budget or 2**31 - 1)).alias("truncated"))


def load_counts(loaded: DataFrame) -> DataFrame:
    """(book, n_loaded, n_missing, n_truncated, chars) of `loaded_texts`."""
    return loaded.groupBy("book").agg(F.count("text").alias("n_loaded"), F.count_if(F.col("text").isNull()).alias("n_missing"), F.count_if("truncated").alias("n_truncated"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))


def _documents(spark: SparkSession, path: str, shape: str) -> DataFrame:
    """(path, d): JSON objects, one a file; a file that holds none is not there."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return raw.where(F.try_parse_json("value").isNotNull() & F.ltrim("value").startswith("{")).select("path", F.from_json("value", shape).alias("d"))


def _filled(*columns: Column) -> Column:
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def read_bibliographies(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(books, entries) of per-book bibliography files: (book, slug, node, authors, title, year) and (book, place, id, authors, title, year, line, raw, page, unknown, incomplete).

    A book's id is that in the file or else its folder's name. place counts entries from 0.
    """
    d = _documents(spark, path, BIBLIOGRAPHY).withColumn("book", _filled(F.col("d.source_sha256"), F.element_at(F.split("path", "/"), -2)))
    books = d.select("book", "d.slug", F.col("d.node_id").alias("node"), "d.corpus_node.authors", "d.corpus_node.title", "d.corpus_node.year")
    entries = d.select("book", F.posexplode("d.entries").alias("place", "e"))
    flag = lambda c: F.coalesce(c, F.lit(False))
    return books, entries.select("book", "place", "e.id", "e.authors", "e.title", "e.year", "e.line", "e.raw", F.col("e.aligned_page").alias("page"), flag("e.all_unknown").alias("unknown"), flag("e.incomplete").alias("incomplete"))


def read_citation_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of citation documents: (id, authors, title, year, in_corpus, book) and (source, target, book, pages)."""
    d = _documents(spark, path, GRAPH)
    nodes = d.select(F.explode("d.nodes").alias("id", "n")).select("id", "n.authors", "n.title", "n.year", F.coalesce("n.in_corpus", F.lit(False)).alias("in_corpus"), F.col("n.source_sha256").alias("book"))
    edges = d.select(F.explode("d.edges").alias("e")).select(F.col("e.from").alias("source"), F.col("e.to").alias("target"), F.col("e.source_sha256").alias("book"), F.coalesce("e.aligned_pages", F.array().cast("array<int>")).alias("pages"))
    return nodes, edges


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, snippet, url, no_material, generated_at) of article catalogues."""
    rows = _documents(spark, path, ARTICLES).select(F.explode("d.articles").alias("id", "a"))
    return rows.select("id", "a.title", "a.snippet", "a.url", F.coalesce("a.no_material", F.lit(False)).alias("no_material"), "a.generated_at")


@dataclass
class Staged(WriterCommitMessage):
    """Files that a task has staged, as pairs (staged path, path), and how many were as they are already."""

    moves: list[tuple[str, str]] = field(default_factory=list)
    same: int = 0


class TreeWriter(DataSourceWriter):
    """Writes rows (path, content) as files below a root.

    A task compares each file's bytes with those there and stages it only if they differ; the commit moves what is staged into
    place, file by file, so readers see the old bytes or the new ones. A job that fails leaves all files as they were. The
    commit's work follows how much has changed. Of several rows of one path one wins.
    """

    def __init__(self, root: str, job: str):
        self.root, self.staging = root.rstrip("/"), f"{root.rstrip('/')}/_staging/{job}"

    def write(self, iterator: Iterator) -> Staged:
        store, root = open_store(self.root)
        _, staging = open_store(self.staging)
        out, folder = Staged(), f"{staging}/{uuid.uuid4().hex}"
        for row in iterator:
            if row.path.startswith("/") or ".." in row.path.split("/"):
                raise ValueError(f"not below the root: {row.path}")
            to, data = f"{root}/{row.path}", (row.content or "").encode()
            if _digest(store, to) == hashlib.sha256(data).digest():
                out.same += 1
                continue
            at = f"{folder}/{len(out.moves)}"
            store.create_dir(folder, recursive=True)
            with store.open_output_stream(at) as f:
                f.write(data)
            out.moves.append((at, to))
        return out

    def commit(self, messages: list) -> None:
        store, _ = open_store(self.root)
        for at, to in (move for m in messages if m is not None for move in m.moves):
            store.create_dir(to.rsplit("/", 1)[0], recursive=True)
            store.move(at, to)
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        store, staging = open_store(self.staging)
        if store.get_file_info(staging).type == fs.FileType.Directory:
            store.delete_dir(staging)


def _digest(store, path: str) -> bytes | None:
    """The digest of a file's bytes, read in pieces; None without a file."""
    try:
        with store.open_input_stream(path) as f:
            have = hashlib.sha256()
            while piece := f.read(1 << 20):
                have.update(piece)
            return have.digest()
    except OSError:
        return None


class BookTree(DataSource):
    """The sink "booktree": df.write.format("booktree").mode("append").save(root) for rows (path, content)."""

    @classmethod
    def name(cls) -> str:
        return "booktree"

    def schema(self) -> str:
        return "path string, content string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if not {"path", "content"} <= set(schema.fieldNames()):
            raise ValueError("rows need path and content")
        return TreeWriter(self.options["path"], uuid.uuid4().hex)


def write_tree(rows: DataFrame, root: str) -> None:
    """Write rows (path below the root, content) as files, those that differ from what is there; null contents are empty files."""
    rows.sparkSession.dataSource.register(BookTree)
    rows.select("path", "content").write.format("booktree").mode("append").save(root)


def page_rows(pages: DataFrame) -> DataFrame:
    """(path, content) of pages (book, page, slug, text) in the form of a tree."""
    return pages.select(F.format_string("output/%s/pages/p.%04d.%s.md", "book", "page", "slug").alias("path"), F.col("text").alias("content"))
