"""Catalog views over the driver's generic tables, so that every operator has rows to work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, d: str) -> DataFrame:
    """Declared files with content: documents as text files."""
    text = F.col("text").cast("binary")
    return table(spark, d, "documents").select((F.col("doc_id") + 1).alias("book_id"), F.lit("TXT").alias("format"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.when(F.col("text").isNull(), "Missing").otherwise("Present").alias("status"), F.octet_length("text").cast("long").alias("size"), F.sha2(text, 256).alias("sha256"))


def books(spark: SparkSession, d: str) -> DataFrame:
    """Parts as books; titles differ in case and spacing by the key mod 3."""
    key = F.col("p_partkey")
    title = F.when(key % 3 == 0, F.col("p_name")).when(key % 3 == 1, F.upper("p_name")).otherwise(F.concat(F.lit("  "), F.regexp_replace("p_name", " ", "   "), F.lit(" ")))
    return table(spark, d, "part").select((key + 1).alias("book_id"), title.alias("title"), F.col("p_brand").alias("author_sort"), F.col("p_brand").alias("publisher"), F.col("p_type").alias("series"), F.col("p_size").cast("decimal(28,10)").alias("series_index"), (key % 4 == 0).alias("has_cover"))


def author_links(spark: SparkSession, d: str) -> DataFrame:
    """(link_id, book_id, author_id): brand and type of a part, in an order by the key's parity; some links are broken."""
    part = table(spark, d, "part")
    even = F.col("p_partkey") % 2 == 0
    names = F.when(even, F.array("p_brand", "p_type")).otherwise(F.array("p_type", "p_brand"))
    rows = part.select((F.col("p_partkey") + 1).alias("book_id"), F.posexplode(names).alias("pos", "author"))
    return rows.select((F.col("book_id") * 2 + F.col("pos")).alias("link_id"), "book_id", F.when((F.col("book_id") % 97 == 0) & (F.col("pos") == 1), F.lit("?")).otherwise(F.col("author")).alias("author_id"))


def authors(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    return part.select(F.col("p_brand").alias("author_id")).unionByName(part.select(F.col("p_type").alias("author_id"))).distinct().select("author_id", F.col("author_id").alias("name"), F.when(F.col("author_id") == "Brand#1", "").otherwise(F.col("author_id")).alias("sort"))


def identifiers(spark: SparkSession, d: str) -> DataFrame:
    """Names' digits as ISBN, ASIN, OCLC and DOI values, right and wrong."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("k")).unionByName(table(spark, d, "supplier").select((F.col("s_suppkey") + 1000000).alias("k")))
    text = F.lpad(F.col("k").cast("string"), 9, "0")
    values = F.array(
        F.struct(F.lit("isbn").alias("type"), F.concat(text, (F.col("k") % 10).cast("string")).alias("value")),
        F.struct(F.lit("ISBN13").alias("type"), F.concat(F.lit("978"), text, F.lit("-"), (F.col("k") % 7).cast("string")).alias("value")),
        F.struct(F.lit(" amazon ").alias("type"), F.concat(F.lit("b"), text).alias("value")),
        F.struct(F.lit("WorldCat").alias("type"), F.concat(F.lit("ocm"), text).alias("value")),
        F.struct(F.lit("doi").alias("type"), F.concat(F.when(F.col("k") % 2 == 0, "doi:10.1/a").otherwise("10.1 /b"), text).alias("value")),
        F.struct(F.lit("other").alias("type"), F.when(F.col("k") % 3 == 0, " ").otherwise(text).alias("value")),
    )
    return rows.select(F.col("k").alias("book_id"), F.inline(values))


def members(spark: SparkSession, d: str) -> DataFrame:
    """Duplicate groups and their records: a customer's orders."""
    year = F.year("o_orderdate")
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("group_id"), F.col("o_orderkey").alias("book_id"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority")).alias("publisher"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("series"),
        F.when(F.col("o_orderkey") % 6 != 0, (F.col("o_orderkey") % 3).cast("int")).alias("series_index"), F.when(F.col("o_orderkey") % 7 != 0, year).alias("year"), (year % 2 + 2000).alias("short_year"),
        F.when(F.col("o_orderkey") % 4 == 0, F.array(F.lit("eng"))).when(F.col("o_orderkey") % 4 == 1, F.array(F.lit("eng"), F.lit("deu"))).when(F.col("o_orderkey") % 4 == 2, F.array(F.lit("fra"))).otherwise(F.array().cast("array<string>")).alias("languages"),
        F.when(F.col("o_orderkey") % 9 == 0, "Unknown").otherwise(F.concat(F.lit("Book "), (F.col("o_orderkey") % 2).cast("string"), F.when(F.col("o_orderkey") % 10 == 0, " (Second Edition)").otherwise(""))).alias("title"), F.col("o_orderpriority").alias("author_sort"), (F.col("o_orderkey") % 2 == 0).alias("has_cover"),
    )


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Files that compete for a format of a group: an order's lines."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("group_id"), F.when(F.col("l_returnflag") == "A", "EPUB").when(F.col("l_returnflag") == "N", "PDF").otherwise("MOBI").alias("format"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("book_id"), F.concat(F.lit("a\\b"), F.col("l_linenumber").cast("string")).alias("path"), F.col("l_quantity").cast("int").alias("score"), F.when(F.col("l_suppkey") % 13 != 0, F.sha2((F.col("l_suppkey") % 3).cast("string"), 256)).alias("sha256"), F.when(F.col("l_suppkey") % 13 == 0, "Missing").otherwise("Present").alias("status"))


def assessments(spark: SparkSession, d: str) -> DataFrame:
    """Findings of the candidates' EPUBs: decisive and other rules, errors and disqualifications; some EPUBs have none."""
    part = F.col("l_orderkey") * 31 + F.col("l_linenumber") * 7  # lines repeat, so the key of the file decides
    found = lambda rule, points, severity: F.struct(F.lit(rule).alias("rule"), points.cast("int").alias("points"), severity.alias("severity"))
    rules = F.array(
        found("EPUB.NAVIGATION", F.when(part % 3 == 0, -6).otherwise(4), F.when(part % 3 == 0, "Warning").otherwise(F.lit("Positive"))),
        F.when(part % 4 == 0, found("EPUB.CHAPTER.EMPTY", F.lit(-2), F.lit("Error"))), F.when(part % 8 == 0, found("EPUB.CHAPTER.EMPTY", F.lit(-2), F.lit("Error"))),
        found("EPUB.METADATA.TITLE", F.when(part % 2 == 0, -4).otherwise(3), F.when(part % 2 == 0, "Warning").otherwise(F.lit("Positive"))),
        F.when(part % 5 < 2, found("EPUB.OPEN", F.lit(0), F.lit("Disqualifying"))), F.when(part % 11 == 0, found("EPUB.ENCRYPTION", F.lit(0), F.lit("Disqualifying"))),
    )
    lines = table(spark, d, "lineitem").where("l_returnflag = 'A'").select("l_orderkey", "l_linenumber").distinct().where(part % 17 != 0)
    return lines.select(F.col("l_orderkey").alias("group_id"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("book_id"), F.inline(F.array_compact(rules)))


def journal(spark: SparkSession, d: str) -> DataFrame:
    """Execution journals: a user's events in time order."""
    kind = F.when(F.col("event_type") == "purchase", "TerminalSummary").when(F.col("event_type") == "click", "MutationStarted").otherwise(F.initcap("event_type"))
    return table(spark, d, "events").select(F.col("user_id").alias("execution_id"), "ts", "event_id", kind.alias("kind"), F.col("event_type").alias("state"), F.sha2(F.col("event_id").cast("string"), 256).alias("entry_hash"))


def snapshot(spark: SparkSession, d: str, after: bool) -> DataFrame:
    """Records of the library before, or after some were dropped and altered."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("book_id"), F.col("o_custkey").alias("group_id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("publisher"), F.round("o_totalprice", 2).cast("decimal(18,2)").alias("size"))
    if not after:
        return rows
    return rows.where("book_id % 50 <> 1").withColumn("title", F.when(F.col("book_id") % 50 == 2, "changed").otherwise(F.col("title"))).withColumn("publisher", F.when(F.col("book_id") % 50 != 3, F.col("publisher")))


def assessment_headers(spark: SparkSession, d: str) -> DataFrame:
    """One assessment per EPUB candidate's record and path; some are absent, of older bytes or by another analyzer."""
    key = F.col("l_orderkey") * 31 + F.col("l_linenumber") * 7
    lines = table(spark, d, "lineitem").where("l_returnflag = 'A'").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.when(F.col("l_suppkey") % 13 != 0, F.sha2((F.col("l_suppkey") % 3).cast("string"), 256))).alias("sha256"))
    out = (key % 5 < 2) | (key % 11 == 0)
    return lines.where(key % 17 != 0).select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("book_id"), F.lit("EPUB").alias("format"), F.concat(F.lit("a/b"), F.col("l_linenumber").cast("string")).alias("path"), F.when(out, "Disqualified").otherwise("Completed").alias("status"),
        F.when(~out, (key % 101).cast("int")).alias("score"), F.when(key % 19 == 0, "1.1").otherwise("1.0").alias("analyzer"), F.lit("1.0").alias("model"), F.when(key % 23 == 0, "old").otherwise(F.col("sha256")).alias("sha256"),
    )


def review(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Recommendations over a customer's orders and overrides of them, right and wrong in every way, by the keys' remainders."""
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("group_id"), F.col("o_orderkey").alias("book_id"), F.col("o_orderstatus").alias("format"))
    g, b = F.col("group_id"), F.col("book_id")
    candidates = orders.select("group_id", "format", "book_id", F.when(b % 9 == 0, "Missing").otherwise("Present").alias("status"))
    selections = candidates.where("status = 'Present'").groupBy("group_id", "format").agg(F.min("book_id").alias("source_id"))
    ends = orders.groupBy("group_id").agg(F.min("book_id").alias("first"), F.max("book_id").alias("last"))
    asked = F.array(*map(F.lit, ["Unreviewed", "Accepted", "ManuallyAdjusted", "Deferred", "KeepSeparate", "NotDuplicates", "Odd"]))
    action = F.when(g % 16 == 1, "Other").when(g % 3 == 0, "SelectSource").when(g % 3 == 1, "MarkUnresolved").otherwise("ExcludeFinalFormat")
    source = F.when(F.col("action") == "SelectSource", F.when(g % 10 < 7, F.col("source_id")).otherwise(-1)).when(g % 13 == 0, F.lit(5).cast("long"))
    odd = ends.where((g % 29 == 3) | (g % 31 == 4)).select("group_id", F.when(g % 29 == 3, " ").otherwise("ZIP").alias("format"), F.lit("MarkUnresolved").alias("action"), F.lit(None).cast("long").alias("source_id"))
    return {
        "generated": ends.select("group_id", F.lit("1").alias("model"), (g % 7).alias("input"), F.col("first").alias("source_id")),
        "members": orders.select("group_id", "book_id"), "selections": selections, "candidates": candidates, "separated": orders.where(b % 37 == 0).select("group_id", "book_id"),
        "overrides": ends.select("group_id", asked[(g % 7).cast("int")].alias("requested"), F.lit("1").alias("model"), F.when(g % 11 == 0, -1).otherwise(g % 7).alias("input"), F.when(g % 5 == 1, F.col("last")).when(g % 5 == 2, 0).alias("source_id")),
        "formats": selections.where(g % 4 == 1).withColumn("action", action).select("group_id", "format", "action", source.alias("source_id")).unionByName(odd),
        "retained": orders.where(b % 23 == 0).select("group_id", "book_id").unionByName(ends.where(g % 41 == 0).select("group_id", F.lit(-7).cast("long").alias("book_id"))),
    }
