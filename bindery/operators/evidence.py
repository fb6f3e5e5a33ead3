"""Assessments of EPUB files as evidence: which candidate each belongs to, whether they may be compared, and what is shown of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .scoring import DECISIVE_RULES

#: Candidates and explanations that evidence shows, and the length at which its texts end (fixed values).
SHOWN, EXPLAINED, TEXT = 12, 4, 512


def _slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def assessed(candidates: DataFrame, assessments: DataFrame) -> DataFrame:
    """Candidates (book_id, path, ...) with assessment, score, analyzer, model and assessed_sha256: those of their record and path, else null.

    Assessments (book_id, path, status, score, analyzer, model, sha256); a path's backslashes are slashes.
    """
    found = assessments.select("book_id", _slashes(F.col("path")).alias("_path"), F.col("status").alias("assessment"), "score", "analyzer", "model", F.col("sha256").alias("assessed_sha256"))
    return candidates.withColumn("_path", _slashes(F.col("path"))).join(found, ["book_id", "_path"], "left").drop("_path")


def inconsistent(files: DataFrame, assessments: DataFrame) -> DataFrame:
    """(book_id, format, path, fault) of assessments of the files' records that are Repeated, NotEpub or Undeclared; empty if all are sound.

    `files` (book_id, format, path) are the declared ones.  Assessments of other records are out of scope.
    """
    declared = files.where(F.upper("format") == "EPUB").select("book_id", _slashes(F.col("path")).alias("_path")).distinct().withColumn("_declared", F.lit(True))
    scoped = assessments.join(files.select("book_id").distinct(), "book_id", "left_semi")
    once = scoped.groupBy("book_id", "format", "path").agg(F.count(F.lit(1)).alias("n")).withColumn("_path", _slashes(F.col("path")))
    fault = F.when(F.col("n") > 1, "Repeated").when(~F.col("format").eqNullSafe("EPUB"), "NotEpub").when(F.col("_declared").isNull(), "Undeclared")
    return once.join(declared, ["book_id", "_path"], "left").select("book_id", "format", "path", fault.alias("fault")).where("fault IS NOT NULL")


def incomparable(rows: DataFrame) -> DataFrame:
    """(group_id, code, cause): groups of several different present EPUBs whose assessments cannot decide between them.

    `rows` as `assessed` returns them.  Cause Fingerprint: an assessment is absent or of
    other bytes; Version: analyzers or scoring models differ.
    """
    epubs = rows.where("format = 'EPUB' AND status = 'Present'")
    fits = F.col("assessment").isNotNull() & F.coalesce(F.col("assessed_sha256") == F.col("sha256"), F.lit(False))
    one = lambda c: F.min(c).eqNullSafe(F.max(c))
    flags = epubs.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), (one("sha256") & (F.count("sha256") == F.count(F.lit(1)))).alias("same"), F.bool_and(fits).alias("fit"), (one("analyzer") & one("model")).alias("alike"))
    cause = F.when(~F.col("fit"), "Fingerprint").when(~F.col("alike"), "Version")
    return flags.where("n > 1 AND NOT same").select("group_id", F.lit("ASSESSMENT.STALE_OR_INCOMPARABLE").alias("code"), cause.alias("cause")).where("cause IS NOT NULL")


def decision_evidence(rows: DataFrame, findings: DataFrame) -> DataFrame:
    """What a format decision shows: the first SHOWN records of a group by id, and how many it omits.

    `rows` (group_id, book_id, assessment, score, analyzer, model), repeated rows once;
    `findings` (group_id, book_id, rule, severity, points, explanation).  Status is
    missing without an assessment, score not-scored without one; decisive findings and
    the first EXPLAINED explanations are joined in order and end at TEXT characters.
    """
    whole = rows.select("group_id", "book_id", "assessment", "score", "analyzer", "model").distinct()
    omitted = whole.groupBy("group_id").agg(F.greatest(F.count(F.lit(1)) - SHOWN, F.lit(0)).alias("omitted"))
    first = whole.withColumn("_place", F.row_number().over(Window.partitionBy("group_id").orderBy("book_id"))).where(F.col("_place") <= SHOWN).drop("_place")
    said = F.collect_list(F.concat_ws(":", "rule", "severity", F.col("points").cast("string")))
    why = F.slice(F.array_sort(F.collect_list(F.struct("rule", "explanation"))), 1, EXPLAINED)
    cut = lambda c: F.substring(c, 1, TEXT)
    texts = findings.where(F.col("rule").isin(DECISIVE_RULES)).groupBy("group_id", "book_id").agg(
        cut(F.array_join(F.array_sort(said), ",")).alias("findings"), cut(F.array_join(F.transform(why, lambda x: F.concat_ws(": ", x["rule"], x["explanation"])), " | ")).alias("explanations"))
    has = F.col("assessment").isNotNull()
    shown = lambda c: F.when(has, F.coalesce(c, F.lit("")))
    score = F.when(has, F.coalesce(F.col("score").cast("string"), F.lit("not-scored")))
    return first.join(texts, ["group_id", "book_id"], "left").join(omitted, "group_id").select("group_id", "book_id", F.coalesce("assessment", F.lit("missing")).alias("status"), score.alias("score"), "analyzer", "model", shown("findings").alias("findings"), shown("explanations").alias("explanations"), "omitted")
