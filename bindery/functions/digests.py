"""Canonical encodings and digests; every length prefix says in which unit it counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def field16(text: Column) -> Column:
    """`{UTF-16 length}:{text};`, null as empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.concat(utf16_length(text).cast("string"), F.lit(":"), text, F.lit(";"))


def field8(text: Column) -> Column:
    """`V{UTF-8 length}:{text};`, null as `N;`."""
    text = text.cast("string")
    return F.when(text.isNull(), "N;").otherwise(F.concat(F.lit("V"), F.octet_length(text).cast("string"), F.lit(":"), text, F.lit(";")))


def framed(columns: list[Column], field=field16) -> Column:
    return reduce(lambda a, b: F.concat(a, b), [field(c) for c in columns])


def fold(order: list[str], text: Column) -> Column:
    """Aggregate: SHA-256 of `text` of all rows of a group in the order of `order` (a total order)."""
    rows = F.array_sort(F.collect_list(F.struct(*order, text.alias("_text"))))
    return F.sha2(F.array_join(F.transform(rows, lambda r: r["_text"]), ""), 256)


def binary_group_id(size: Column, sha256: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.lower(sha256), F.lit(":"), size.cast("string"))


def metadata_group_id(title: Column, authors: Column) -> Column:
    part = lambda t: F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)
    return F.concat_ws("|", F.lit("exact-metadata:v1"), F.lit("title"), part(title), F.lit("authors"), F.size(authors).cast("string"), F.array_join(F.transform(authors, part), "|"))
