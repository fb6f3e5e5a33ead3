"""Exact duplicates: files with equal bytes, records with equal normalised title and author set."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.digests import binary_group_id, metadata_group_id
from ..functions.text import canonical
from .skew import HOT_ROWS, dealt_join


def binary_groups(files: DataFrame) -> DataFrame:
    """Groups of two or more distinct files with one size and SHA-256; a file without a fingerprint never groups.

    One row per group: its id, how many members and records it has, and whether it
    spans several records.  Counts alone are kept, in two partial aggregations, so a
    fingerprint that a third of all files share is never gathered.
    """
    known = files.where(F.col("sha256").isNotNull() & F.col("size").isNotNull())
    each = known.select("size", "sha256", "book_id", "format", "path").distinct()
    books = each.groupBy("size", "sha256", "book_id").agg(F.count(F.lit(1)).alias("n"))
    groups = books.groupBy("size", "sha256").agg(F.sum("n").alias("member_count"), F.count(F.lit(1)).alias("book_count")).where("member_count >= 2")
    return groups.select(binary_group_id(F.col("size"), F.col("sha256")).alias("group_id"), "size", "sha256", "member_count", "book_count", (F.col("book_count") > 1).alias("spans_records"))


def binary_members(files: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_id, size, sha256, book_id, format, path): the distinct members of binary groups."""
    each, keys = files.select("size", "sha256", "book_id", "format", "path").distinct(), ["size", "sha256"]
    return dealt_join(each, groups.select(*keys, "group_id"), keys, F.struct("book_id", "path"), groups.select(*keys, F.col("member_count").alias("_n")), HOT_ROWS).select("group_id", "size", "sha256", "book_id", "format", "path")


def identities(books: DataFrame, authors: DataFrame, incomplete: DataFrame | None = None) -> DataFrame:
    """(book_id, title_key, author_keys) of records whose title and every author normalise.

    `authors` has a row per author of a book with `name` (null when its reference is
    broken); records in `incomplete` are left out.
    """
    keyed = authors.withColumn("key", canonical(F.col("name")))
    sets = keyed.groupBy("book_id").agg(F.array_sort(F.collect_set("key")).alias("author_keys"), F.bool_and(F.col("key").isNotNull()).alias("complete")).where("complete")
    found = books.select("book_id", canonical(F.col("title")).alias("title_key")).where(F.col("title_key").isNotNull()).join(sets, "book_id").drop("complete")
    return found if incomplete is None else found.join(incomplete.select("book_id").distinct(), "book_id", "left_anti")


def metadata_groups(identity: DataFrame) -> DataFrame:
    """(group_id, title_key, author_keys, member_count): identities that two or more records share."""
    groups = identity.select("title_key", "author_keys", "book_id").distinct().groupBy("title_key", "author_keys").agg(F.count(F.lit(1)).alias("member_count")).where("member_count >= 2")
    return groups.select(metadata_group_id(F.col("title_key"), F.col("author_keys")).alias("group_id"), "title_key", "author_keys", "member_count")


def metadata_members(identity: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_id, book_id): the records of metadata groups."""
    each, keys = identity.select("title_key", "author_keys", "book_id").distinct(), ["title_key", "author_keys"]
    return dealt_join(each, groups.select(*keys, "group_id"), keys, F.col("book_id"), groups.select(*keys, F.col("member_count").alias("_n")), HOT_ROWS).select("group_id", "book_id")


def all_in_one_group(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: whether every candidate has one and the same fingerprint (it then lies in a single binary group)."""
    return candidates.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.coalesce(F.min("sha256") == F.max("sha256"), F.lit(False)) & F.bool_and(F.col("sha256").isNotNull())).alias("all_equal"))


def evidence_consistent(members: DataFrame, files: DataFrame) -> DataFrame:
    """Per group of members (group_id, size, sha256, book_id, format, path): each matches one present file of equal fingerprint."""
    wanted = members.withColumnsRenamed({"size": "want_size", "sha256": "want_sha"})
    now = files.groupBy("book_id", "format", "path").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("size"), F.min("sha256").alias("sha256"), F.min("status").alias("status"))
    fits = (F.col("n") == 1) & (F.col("status") == "Present") & (F.col("size") == F.col("want_size")) & (F.col("sha256") == F.col("want_sha"))
    return wanted.join(now, ["book_id", "format", "path"], "left").groupBy("group_id").agg(F.bool_and(F.coalesce(fits, F.lit(False))).alias("consistent"))
