"""Reading a catalog: schema and row checks, link joins, findings.

What aborts a read is returned as rows of violations (empty when all is well);
what only concerns one record is returned as findings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

FINDING = ["book_id", "format", "path", "code", "evidence"]
#: Stems that a file system reserves.
RESERVED = [*"CON PRN AUX NUL".split(), *(f"{p}{i}" for p in ("COM", "LPT") for i in range(1, 10))]


def schema_violations(tables: dict[str, DataFrame], required: dict[str, list[str]]) -> list[tuple[str, str | None]]:
    """All missing tables and columns, in order; metadata only."""
    out: list[tuple[str, str | None]] = []
    for name in sorted(required):
        have = set(tables[name].columns) if name in tables else None
        out += [(name, None)] if have is None else [(name, c) for c in required[name] if c not in have]
    return out


def book_violations(books: DataFrame) -> DataFrame:
    """(book_id, reason): ids that are not positive or not unique, blank titles."""
    repeated = F.count(F.lit(1)).over(Window.partitionBy("book_id"))
    reasons = F.array_compact(F.array(F.when(F.coalesce(F.col("book_id") <= 0, F.lit(True)), "INVALID_ID"), F.when(F.coalesce(F.trim("title") == "", F.lit(True)), "BLANK_TITLE"), F.when(F.col("n") > 1, "DUPLICATE_ID")))
    return books.withColumn("n", repeated).select("book_id", F.explode(reasons).alias("reason"))


def format_violations(formats: DataFrame) -> DataFrame:
    """(book_id, format): blank formats and formats declared twice in any case."""
    return formats.groupBy("book_id", F.upper("format").alias("format")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR format IS NULL OR trim(format) = ''").select("book_id", "format")


def single_link_violations(links: DataFrame) -> DataFrame:
    """Books with more than one link where at most one is allowed."""
    return links.groupBy("book_id").agg(F.count(F.lit(1)).alias("links")).where("links > 1")


def orphans(child: DataFrame, books: DataFrame) -> DataFrame:
    return child.join(books.select("book_id").distinct(), "book_id", "left_anti")


def resolve_authors(links: DataFrame, authors: DataFrame) -> DataFrame:
    """Links left joined to authors, with a finding code for a missing name or a blank sort name."""
    joined = links.join(authors, "author_id", "left")
    blank = F.coalesce(F.trim("name") == "", F.lit(True))
    code = F.when(blank, "AUTHOR_REFERENCE_MISSING").when(F.coalesce(F.trim("sort") == "", F.lit(True)), "CATALOG_VALUE_INVALID")
    return joined.select("book_id", "link_id", "author_id", F.when(~blank, F.col("name")).alias("name"), "sort", code.alias("code"))


def ordered_values(links: DataFrame, value: str, order: list[str]) -> DataFrame:
    """(book_id, values): a book's linked values in an explicit order."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("v"))))
    return links.groupBy("book_id").agg(F.transform(rows, lambda r: r["v"]).alias("values"))


def split_identifiers(identifiers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable identifiers, and findings for blank types or values."""
    blank = F.coalesce((F.trim("type") == "") | (F.trim("value") == ""), F.lit(True))
    issue = identifiers.where(blank).select("book_id", F.lit(None).cast("string").alias("format"), F.lit(None).cast("string").alias("path"), F.lit("CATALOG_VALUE_INVALID").alias("code"), F.coalesce("type", F.lit("")).alias("evidence"))
    return identifiers.where(~blank), issue


def parse_optional(rows: DataFrame) -> DataFrame:
    """`pubdate`, `series_index`, `has_cover` texts as values; `invalid` names those that do not parse."""
    date, index, flag = F.expr("try_to_timestamp(pubdate)"), F.expr("try_cast(series_index AS decimal(28,10))"), F.expr("try_cast(has_cover AS int)")
    bad = F.array_compact(F.array(F.when(F.col("pubdate").isNotNull() & date.isNull(), "pubdate"), F.when(F.col("series_index").isNotNull() & F.coalesce(index < 0, F.lit(True)), "series_index"), F.when(~F.coalesce(flag.isin(0, 1), F.lit(False)), "has_cover")))
    return rows.select("book_id", date.alias("publication_date"), F.expr("try_cast(substring(pubdate, 1, 4) AS int)").alias("stored_year"), F.when(index >= 0, index).alias("series_index"), F.coalesce(flag == 1, F.lit(False)).alias("has_cover"), F.array_join(bad, ",").alias("invalid"))


def resolve_paths(rows: DataFrame) -> DataFrame:
    """`path` for (directory, stem, format) that stays inside the library, else null and code MANAGED_PATH_INVALID."""
    parts = F.split(F.translate("directory", "\\", "/"), "/")
    stem_of = lambda p: F.upper(F.split(p, r"\.")[0])
    bad = lambda p: (F.trim(p) == "") | p.isin(".", "..") | p.rlike(r"[ .]$") | stem_of(p).isin(RESERVED) | p.rlike(r'[<>:"|?*\x00-\x1f]')
    stem = F.col("stem")
    wrong = (F.col("directory") == "") | F.exists(parts, bad) | bad(stem) | stem.rlike(r"[/\\]") | ~F.col("format").rlike("^[A-Za-z0-9]+$")
    path = F.concat(F.array_join(parts, "/"), F.lit("/"), stem, F.lit("."), F.lower("format"))
    return rows.select("*", F.when(~F.coalesce(wrong, F.lit(True)), path).alias("path"), F.when(F.coalesce(wrong, F.lit(True)), "MANAGED_PATH_INVALID").alias("code"))


def hash_requests(formats: DataFrame) -> DataFrame:
    """Formats with `sequence`, from 0 in (book, format, path) order; ranks by range, so no task sorts all rows."""
    spread = formats.repartitionByRange(F.col("book_id"), F.col("format"), F.col("path")).sortWithinPartitions("book_id", "format", "path").withColumn("_p", F.spark_partition_id())
    counts = spread.groupBy("_p").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy("book_id", "format", "path"))
    return spread.withColumn("_r", inside).join(F.broadcast(counts.select("_p", "before")), "_p").select(*formats.columns, (F.col("before") + F.col("_r") - 1).alias("sequence"))


def file_status(declared: DataFrame, results: DataFrame) -> DataFrame:
    """Declared formats joined to hash results by sequence; a result that is missing counts as inaccessible."""
    status = F.coalesce("outcome", F.lit("Inaccessible"))
    code = F.when(status == "Missing", "FORMAT_FILE_MISSING").when(status == "Inaccessible", "FORMAT_FILE_INACCESSIBLE").when(status == "ChangedDuringHashing", "FORMAT_FILE_CHANGED_DURING_HASHING")
    return declared.join(results, "sequence", "left").select(*declared.columns, F.when(status == "Success", "Present").otherwise(status).alias("status"), F.when(status == "Success", F.col("sha256")).alias("sha256"), code.alias("code"))


def first_findings(findings: DataFrame, order: str) -> DataFrame:
    """The first finding by `order` of each (book, format, path, code)."""
    keys = ["book_id", "format", "path", "code"]
    first = findings.groupBy(*keys).agg(F.min(F.struct(order, *[c for c in findings.columns if c not in (*keys, order)])).alias("f"))
    return first.select(*keys, "f.*")


def finding_order() -> list:
    return [F.coalesce("book_id", F.lit(0)), F.col("format").asc_nulls_first(), F.col("path").asc_nulls_first(), F.col("code")]
