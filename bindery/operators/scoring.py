"""Document quality scoring: a rule table over inspection facts, capped running penalties, a clamped score."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

#: Rules whose difference can decide between two files of one format (fixed values).
DECISIVE_RULES = [
    "EPUB.OPEN", "EPUB.ARCHIVE_SAFETY", "EPUB.PACKAGE", "EPUB.NAVIGATION", "EPUB.SPINE.NON_EMPTY",
    "EPUB.SPINE.RESOURCE_EXISTS", "EPUB.RESOURCE.INTERNAL_EXISTS", "EPUB.TEXT.SUBSTANTIAL", "EPUB.CHAPTER.EMPTY", "EPUB.STRUCTURE.REPEATED_REFERENCE",
]
#: Listed faults: rule, fact, points when there are none, points each, and the lowest sum (fixed values).
LISTED = [
    ("EPUB.SPINE.RESOURCE_EXISTS", "missing_spine", 4, -5, -20),
    ("EPUB.RESOURCE.INTERNAL_EXISTS", "broken_refs", 4, -2, -10),
    ("EPUB.CHAPTER.EMPTY", "empty_chapters", 2, -2, -10),
    ("EPUB.STRUCTURE.REPEATED_REFERENCE", "repeated_refs", 2, -4, -12),
]
#: What a problem disqualifies (fixed values).
PROBLEM_RULES = {"CannotOpen": "EPUB.OPEN", "Unreadable": "EPUB.OPEN", "UnsafeArchive": "EPUB.ARCHIVE_SAFETY", "LimitExceeded": "EPUB.ARCHIVE_SAFETY", "PackageMalformed": "EPUB.PACKAGE", "Encrypted": "EPUB.ENCRYPTION", "ChangedDuringInspection": "EPUB.FILE_CHANGED"}
#: The problem of a file that is not present, by its status (fixed values); any other status is Unreadable.
ABSENT = {"Missing": "CannotOpen", "InvalidPath": "UnsafeArchive", "Inaccessible": "Unreadable", "ChangedDuringHashing": "ChangedDuringInspection"}
SEVERITY_RANK = ["Disqualifying", "Error", "Warning", "Information", "Positive"]


def running_penalty(rank: Column, each: int, cap: int) -> Column:
    """Points of the rank-th fault (from 1), so that the running sum never passes `cap`."""
    before = (rank - 1) * each
    return F.when(before > cap, F.greatest(F.lit(each), F.lit(cap) - before)).otherwise(0)


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITY_RANK]), severity)


def _rule(rule: str, points: Column, severity: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule"), points.cast("int").alias("points"), severity.alias("severity"), F.lit("").alias("evidence"))


def _either(rule: str, holds: Column, gain: int, loss: int) -> Column:
    holds = F.coalesce(holds, F.lit(False))
    return _rule(rule, F.when(holds, gain).otherwise(loss), F.when(holds, "Positive").when(F.lit(loss < 0), "Warning").otherwise("Information"))


def _fault(rule: str, each: int, cap: int) -> Callable[[Column, Column], Column]:
    return lambda item, at: F.struct(F.lit(rule).alias("rule"), running_penalty(at + 1, each, cap).cast("int").alias("points"), F.lit("Error").alias("severity"), item.alias("evidence"))


def findings(facts: DataFrame, keys: list[str], kept: int = 100) -> DataFrame:
    """One row per finding (keys, rule, points, severity, evidence) of inspected files.

    `facts` has: problems, missing_spine, broken_refs, empty_chapters, repeated_refs
    (arrays of text), title, date, strong_identifier (texts), authors, languages
    (arrays), cover, navigation (booleans), cover_width, cover_height, spine, chars.
    Of listed faults the first `kept` in order are rows, the others one `omitted:n` row
    that costs what they would.  A file with problems has its baseline and one
    disqualifying row per problem, nothing else.
    """
    healthy = F.size(F.coalesce("problems", F.array())) == 0
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    width, height = F.col("cover_width"), F.col("cover_height")
    covered = F.when(~F.coalesce(F.col("cover"), F.lit(False)) | width.isNull() & height.isNull(), 0).when(F.coalesce(width <= 0, F.lit(True)) | F.coalesce(height <= 0, F.lit(True)), -2).when((F.least(width, height) >= 600) & (F.greatest(width, height) >= 800), 2).otherwise(-3)
    chars = F.when(F.col("chars") >= 5000, 5).when(F.col("chars") >= 500, -8).otherwise(-15)
    dated = F.when(F.col("date").isNull(), 0).when(F.expr("try_to_timestamp(date)").isNotNull(), 1).otherwise(-1)
    by_sign = lambda points: F.when(points > 0, "Positive").when(points < 0, "Warning").otherwise("Information")
    fixed = F.array(
        _rule("EPUB.OPEN", F.lit(4), F.lit("Positive")), _rule("EPUB.PACKAGE", F.lit(4), F.lit("Positive")), _rule("EPUB.ARCHIVE_SAFETY", F.lit(0), F.lit("Information")),
        _either("EPUB.METADATA.TITLE", F.trim("title") != "", 3, -4), _either("EPUB.METADATA.AUTHOR", some("authors"), 3, -4), _either("EPUB.METADATA.LANGUAGE", some("languages"), 2, -2),
        _rule("EPUB.METADATA.DATE", dated, by_sign(dated)), _either("EPUB.METADATA.STRONG_IDENTIFIER", F.col("strong_identifier").isNotNull(), 1, 0),
        _either("EPUB.COVER.PRESENT", F.col("cover"), 4, -6), _rule("EPUB.COVER.DIMENSIONS", covered, by_sign(covered)), _either("EPUB.NAVIGATION", F.col("navigation"), 4, -6),
        _either("EPUB.SPINE.NON_EMPTY", F.col("spine") > 0, 5, -20), _rule("EPUB.TEXT.SUBSTANTIAL", chars, by_sign(chars)),
    )
    base = F.array(_rule("EPUB.SCORE.BASELINE", F.lit(50), F.lit("Information")))
    lists = []
    for rule, fact, good, each, cap in LISTED:
        items = F.array_sort(F.coalesce(fact, F.array().cast("array<string>")))

        listed = F.transform(F.slice(items, 1, kept), _fault(rule, each, cap))
        left = F.size(items) - kept
        spent = F.greatest(F.lit(cap), F.lit(kept * each))
        omitted = F.struct(F.lit(rule).alias("rule"), F.greatest(F.lit(cap) - spent, left * each).cast("int").alias("points"), F.lit("Error").alias("severity"), F.concat(F.lit("omitted:"), left.cast("string")).alias("evidence"))
        lists.append(F.when(F.size(items) == 0, F.array(_rule(rule, F.lit(good), F.lit("Positive")))).when(left > 0, F.concat(listed, F.array(omitted))).otherwise(listed))
    names = F.create_map(*[F.lit(x) for pair in PROBLEM_RULES.items() for x in pair])
    broken = F.transform(F.coalesce("problems", F.array().cast("array<string>")), lambda p: F.struct(F.coalesce(F.try_element_at(names, p), F.lit("EPUB.UNSUPPORTED")).alias("rule"), F.lit(0).alias("points"), F.lit("Disqualifying").alias("severity"), p.alias("evidence")))
    return facts.select(*keys, F.explode(F.when(healthy, F.concat(base, fixed, *lists)).otherwise(F.concat(base, broken))).alias("f")).select(*keys, "f.*")


def score(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, status, score): the sum of points within 0 and 100; a disqualified file has none."""
    out = rows.groupBy(*keys).agg(F.sum("points").alias("total"), F.bool_or(F.col("severity") == "Disqualifying").alias("out"))
    return out.select(*keys, F.when(F.col("out"), "Disqualified").otherwise("Completed").alias("status"), F.when(~F.col("out"), F.greatest(F.lit(0), F.least(F.lit(100), "total"))).cast("int").alias("score"))


def rule_sums(rows: DataFrame, keys: list[str], decisive: bool = True) -> DataFrame:
    """(keys, rule, points) per rule; of the decisive rules only, unless told otherwise."""
    rows = rows.where(F.col("rule").isin(DECISIVE_RULES)) if decisive else rows
    return rows.groupBy(*keys, "rule").agg(F.sum("points").alias("points"))


def occurrences(rows: DataFrame, keys: list[str], kind: str, value: str, order: str) -> DataFrame:
    """(keys, mark): `kind:value#n` for the second and later occurrence of a value."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(*keys, kind, value).orderBy(order))
    return rows.withColumn("_n", n).where("_n > 1").select(*keys, F.concat(kind, F.lit(":"), value, F.lit("#"), F.col("_n").cast("string")).alias("mark"))


def absent_problem(status: Column) -> Column:
    """The inspection problem of a file's status; null for a present file, Unreadable for a status that is unknown or null."""
    known = F.create_map(*[F.lit(x) for pair in ABSENT.items() for x in pair])
    return F.when(~status.eqNullSafe("Present"), F.coalesce(F.try_element_at(known, F.coalesce(status, F.lit(""))), F.lit("Unreadable")))
