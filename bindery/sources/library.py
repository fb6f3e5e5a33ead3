"""Catalog libraries: SQLite catalogs and the files they declare, many at a time.

A catalog is one binary row (path, content) of spark.read.format("binaryFile") and is
opened from memory, so any store that Spark reads will do and nothing can be written.
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

VERSION = 27
#: Tables and columns that a catalog must have (fixed values), with the types they are read as.
TABLES = {
    "library_id": "uuid string",
    "books": "id long, title string, author_sort string, path string, pubdate string, series_index string, has_cover string",
    "authors": "id long, name string, sort string",
    "books_authors_link": "id long, book long, author long",
    "identifiers": "book long, type string, val string",
    "data": "book long, format string, name string",
    "publishers": "id long, name string",
    "books_publishers_link": "id long, book long, publisher long",
    "series": "id long, name string",
    "books_series_link": "id long, book long, series long",
    "languages": "id long, lang_code string",
    "books_languages_link": "id long, book long, lang_code long, item_order long",
}
_KINDS = {"string": pa.string(), "long": pa.int64()}


def _columns(table: str) -> list[tuple[str, str]]:
    return [tuple(f.split()) for f in TABLES[table].split(", ")]


def location_error(path: str | None) -> str | None:
    """The first thing wrong with a library folder on this machine, or None."""
    if not path or not path.strip():
        return "EmptyPath"
    if not os.path.isdir(path):
        return "FolderNotFound"
    if not os.access(path, os.R_OK | os.X_OK):
        return "FolderNotReadable"
    catalog = os.path.join(path, "metadata.db")
    if not os.path.exists(catalog):
        return "MetadataDatabaseNotFound"
    if not os.path.isfile(catalog):
        return "MetadataDatabaseNotAFile"
    return None if os.access(catalog, os.R_OK) else "MetadataDatabaseNotReadable"


def _open(content: bytes) -> sqlite3.Connection:
    connection = sqlite3.connect(":memory:")
    connection.deserialize(content)
    connection.execute("PRAGMA query_only = ON")
    return connection


def problems(content: bytes | None) -> list[tuple[str, str]]:
    """(code, detail) for each reason why a file is no catalog of the expected version."""
    if not content or content[:16] != b"SQLite format 3\0":
        return [("NotSqliteDatabase", "")]
    try:
        with _open(content) as c:
            version = c.execute("PRAGMA user_version").fetchone()[0]
            if version != VERSION:
                return [("UnsupportedSchema", f"version {version}")]
            out = []
            for table in TABLES:
                have = {r[1] for r in c.execute(f"PRAGMA table_info({table})")}
                out += [("UnsupportedSchema", table)] if not have else [("UnsupportedSchema", f"{table}.{n}") for n, _ in _columns(table) if n not in have]
            return out
    except sqlite3.DatabaseError as e:
        return [("NotSqliteDatabase", str(e))]


def validate(files: DataFrame) -> DataFrame:
    """(path, code, detail) of catalogs (path, content) that cannot be read."""
    schema = pa.schema([("path", pa.string()), ("code", pa.string()), ("detail", pa.string())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = [{"path": p, "code": c, "detail": d} for p, b in zip(part["path"].to_pylist(), part["content"], strict=True) for c, d in problems(b.as_py())]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("path", "content").mapInArrow(run, "path string, code string, detail string")


def read_table(files: DataFrame, table: str, at_once: int = 10_000) -> DataFrame:
    """(library, columns of TABLES[table]) of all valid catalogs (path, content); text that is not UTF-8 and values of another type are nulls."""
    columns = _columns(table)
    schema = pa.schema([("library", pa.string())] + [(n, _KINDS[k]) for n, k in columns])

    def value(x, kind: str):
        if kind == "long":
            return x if isinstance(x, int) else None
        return None if x is None or isinstance(x, bytes) else str(x)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for path, content in zip(part["path"].to_pylist(), part["content"], strict=True):
                content = content.as_py()
                if problems(content):
                    continue
                with _open(content) as c:
                    c.text_factory = lambda b: b.decode("utf-8", "replace")
                    found = c.execute(f"SELECT {', '.join(n for n, _ in columns)} FROM {table}")
                    while rows := found.fetchmany(at_once):
                        yield pa.RecordBatch.from_pylist([{"library": path} | {n: value(x, k) for (n, k), x in zip(columns, r, strict=True)} for r in rows], schema)

    return files.select("path", "content").mapInArrow(run, f"library string, {TABLES[table]}")


def books(files: DataFrame) -> DataFrame:
    """(library, book_id, title, author_sort, publisher, series, authors, languages) of all catalogs; authors and languages keep their order."""
    t = {n: read_table(files, n) for n in TABLES}
    keys = ["library", "book_id"]

    def linked(link: str, target: str, key: str, value: str, order: list[str]) -> DataFrame:
        names = t[target].select("library", F.col("id").alias(key), F.col(value).alias("_v"))
        rows = t[link].withColumnRenamed("book", "book_id").withColumnRenamed("id", "link_id").join(names, ["library", key], "left")
        listed = F.array_sort(F.collect_list(F.struct(*order, F.col("_v"))))
        return rows.groupBy(*keys).agg(F.transform(listed, lambda r: r["_v"]).alias("_list"))

    out = t["books"].select("library", F.col("id").alias("book_id"), "title", "author_sort")
    for link, target, key, value, order, name in [("books_authors_link", "authors", "author", "name", ["link_id"], "authors"), ("books_languages_link", "languages", "lang_code", "lang_code", ["item_order", "link_id"], "languages"), ("books_publishers_link", "publishers", "publisher", "name", ["link_id"], "publisher"), ("books_series_link", "series", "series", "name", ["link_id"], "series")]:
        if target == "languages":
            t["languages"] = t["languages"].withColumnRenamed("lang_code", "_code")
            value = "_code"
        out = out.join(linked(link, target, key, value, order).withColumnRenamed("_list", name), keys, "left")
    return out.withColumn("publisher", F.get("publisher", F.lit(0))).withColumn("series", F.get("series", F.lit(0)))


def hash_files(spark: SparkSession, declared: DataFrame, root: str) -> DataFrame:
    """Declared files (with a relative `path`) and what lies under `root`: size, SHA-256, modification time; Missing when nothing does."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    place = F.substring_index(F.col("path"), root.rstrip("/") + "/", -1)
    found = found.select(place.alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("modified"))
    return declared.join(found, "path", "left").withColumn("status", F.when(F.col("sha256").isNull(), "Missing").otherwise("Present"))
