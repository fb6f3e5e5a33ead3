"""Web pages read as the chapters of a document: readable text, references and inspection facts per host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_HIDDEN = r"(?is)<(script|style|nav)\b.*?</\1\s*>"
_REFERENCE = r"""(?i)\b(?:src|href|poster)\s*=\s*["']([^"'<>]*)["']"""


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def readable(html: Column) -> Column:
    """Letters and decimal digits outside of scripts, styles, navigation and tags."""
    plain = F.regexp_replace(F.regexp_replace(html, _HIDDEN, " "), r"(?s)<[^>]*>", " ")
    return F.length(F.regexp_replace(plain, r"[^\p{L}\p{Nd}]", ""))


def chapters(pages: DataFrame) -> DataFrame:
    """(page_id, host, readable): a null page has no characters."""
    return pages.select("page_id", host(F.col("url")).alias("host"), F.coalesce(readable(F.col("html")), F.lit(0)).alias("readable"))


def sanitised(reference: Column) -> Column:
    """`scheme:x;host:y` of a remote reference."""
    return F.concat(F.lit("scheme:"), F.lower(F.regexp_extract(reference, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)), F.lit(";host:"), host(reference))


def references(pages: DataFrame) -> DataFrame:
    """(page_id, host, position, kind, target): src, href and poster values in page order; fragments and queries are cut.

    Remote targets are sanitised.  A local one is broken when its length is odd: the
    pages of the test tables link to nothing that exists, so a rule stands for the lookup.
    """
    found = pages.select("page_id", host(F.col("url")).alias("host"), F.posexplode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_REFERENCE), 1)).alias("position", "raw"))
    raw = F.col("raw")
    remote = raw.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | raw.startswith("//")
    local = F.regexp_replace(raw, r"[?#].*$", "")
    return found.select("page_id", "host", "position", F.when(remote, "remote").when(F.length(local) % 2 == 1, "broken").otherwise("local").alias("kind"), F.when(remote, sanitised(raw)).otherwise(local).alias("target"))


def facts(pages: DataFrame) -> DataFrame:
    """Inspection facts per host, in the columns that scoring reads."""
    read = chapters(pages)
    spine = read.groupBy("host").agg(F.count(F.lit(1)).alias("spine"), F.sum("readable").alias("chars"), F.array_sort(F.collect_list(F.when(F.col("readable") < 3000, F.col("page_id").cast("string")))).alias("empty_chapters"), F.min("page_id").alias("first_page"))
    broken = references(pages).where("kind = 'broken'").groupBy("host").agg(F.array_sort(F.collect_list("target")).alias("broken_refs"))
    none = F.array().cast("array<string>")
    first = F.col("first_page") % 4
    return spine.join(broken, "host", "left").select(
        "host", F.when(F.col("first_page") % 29 == 1, F.array(F.lit("Encrypted"))).otherwise(none).alias("problems"), F.coalesce("broken_refs", none).alias("broken_refs"), "empty_chapters", F.when(first == 0, F.array(F.lit("a"))).otherwise(none).alias("missing_spine"), none.alias("repeated_refs"),
        F.col("host").alias("title"), F.when(first == 1, none).otherwise(F.array("host")).alias("authors"), F.array(F.lit("en")).alias("languages"), F.when(first == 2, "soon").when(first != 3, "2020-01-01").alias("date"), F.when(first == 1, "ISBN:1").alias("strong_identifier"),
        (first != 2).alias("cover"), F.lit(600).alias("cover_width"), F.when(first == 3, 700).otherwise(800).alias("cover_height"), (first != 0).alias("navigation"), "spine", "chars",
    )
