"""Canonical orders of rows within a group: text by its bytes, nulls first, enumerations by their place in a list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Enumerations in the order in which their values sort (fixed values).
SUBJECTS = ["Group", "Metadata", "Format", "Record", "Assessment", "User"]
ISSUE_SEVERITIES = ["BlockingError", "Warning", "Information"]
BACKUP_KINDS = ["RecordMetadataSnapshot", "FormatFile", "CoverIfPresent", "ManagedPathAndFileState", "CleanupPlanArtifact", "ExecutionAudit"]


def place(column: str, values: list[str]) -> Column:
    """The value's place in `values` from 1; 0 for any other."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, values)), F.col(column)), F.lit(0))


def _id(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(0))


def numbered(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """`rows` with `ordinal`, from 1, within `key`; what is equal in the whole order may change places."""
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))


def metadata_groups(groups: DataFrame) -> DataFrame:
    """Groups by title, then authors (value by value, the shorter list first), then id, numbered within a title."""
    return numbered(groups, "title_key", [F.col("author_keys"), F.col("group_id")]).orderBy("title_key", "author_keys", "group_id")


def statements(rows: DataFrame) -> DataFrame:
    """Reasons or warnings (group_id, subject, format, book_id, code, explanation) of a recommendation in their order."""
    return numbered(rows, "group_id", [place("subject", SUBJECTS), F.col("format"), _id("book_id"), F.col("code"), F.col("explanation")])


def issues(rows: DataFrame) -> DataFrame:
    """Issues (group_id, severity, book_id, format, code, explanation) of a plan in their order."""
    return numbered(rows, "group_id", [place("severity", ISSUE_SEVERITIES), _id("book_id"), F.col("format"), F.col("code"), F.col("explanation")])


def backups(rows: DataFrame) -> DataFrame:
    """Backup requirements (group_id, kind, book_id, format, id) of a plan in their order."""
    return numbered(rows, "group_id", [place("kind", BACKUP_KINDS), _id("book_id"), F.col("format"), F.col("id")])
