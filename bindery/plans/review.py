"""Checks between snapshots, recommendations and plans: linkage, coverage, preflight, effects and lineage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.digests import field16, fold, framed


def unlinked_codes(referenced: DataFrame, listed: DataFrame) -> DataFrame:
    """(group_id, code) that a selection refers to and no reason or warning of the group lists."""
    return referenced.select("group_id", "code").distinct().join(listed.select("group_id", "code").distinct(), ["group_id", "code"], "left_anti")


def graph_mismatch(declared: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """(group_id, only_declared, only_candidates) of groups whose two key sets differ."""
    a = declared.select("group_id", *keys).distinct().withColumn("_d", F.lit(1))
    b = candidates.select("group_id", *keys).distinct().withColumn("_c", F.lit(1))
    both = a.join(b, ["group_id", *keys], "full")
    return both.groupBy("group_id").agg(F.count_if(F.col("_c").isNull()).alias("only_declared"), F.count_if(F.col("_d").isNull()).alias("only_candidates")).where("only_declared + only_candidates > 0")


def shells(groups: DataFrame, members: DataFrame) -> DataFrame:
    """(group_id, code) of groups whose declared member count is not what is there: they get an unsupported shell."""
    there = members.groupBy("group_id").agg(F.count_distinct("book_id").alias("there"))
    joined = groups.join(there, "group_id", "left")
    return joined.where(F.coalesce("there", F.lit(0)) != F.col("member_count")).select("group_id", F.lit("INPUT.INCOMPLETE").alias("code"))


def preflight(plans: DataFrame) -> DataFrame:
    """(plan_id, code): what keeps an approved plan from running.

    `plans` has plan_id, state, approved_digest, digest, stale, violations and missing_sources.
    """
    checks = [("EXECUTION.APPROVAL_INVALID", F.col("state") != "Approved"), ("EXECUTION.PLAN_TAMPERED", ~F.col("approved_digest").eqNullSafe(F.col("digest"))), ("EXECUTION.PLAN_STALE", F.col("stale")), ("EXECUTION.PLAN_UNSAFE", F.col("violations") > 0), ("EXECUTION.SOURCE_UNAVAILABLE", F.col("missing_sources") > 0)]
    return plans.select("plan_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(code)) for code, c in checks]))).alias("code"))


def effects(plan: DataFrame, target_formats: DataFrame) -> DataFrame:
    """(group_id, effect, book_id, format): what a plan does to the library, by instruction."""
    on_target = target_formats.select("group_id", "format").distinct().withColumn("_there", F.lit(True))
    moved = plan.where("kind = 'Retention' AND reason = 'RetainFromOtherRecord'").join(on_target, ["group_id", "format"], "left")
    added = moved.select("group_id", F.when(F.col("_there"), "Replace format").otherwise("Add format").alias("effect"), "book_id", "format")
    gone = plan.where("kind IN ('FormatRemoval', 'RecordRemoval')").select("group_id", F.when(F.col("kind") == "FormatRemoval", "Remove format").otherwise("Remove record").alias("effect"), "book_id", "format")
    return added.unionByName(gone)


def is_prefix(shorter: Column, longer: Column) -> Column:
    """Whether a history continues another."""
    return (F.size(shorter) <= F.size(longer)) & (F.slice(longer, 1, F.size(shorter)) == shorter)


def graph_digests(graph: DataFrame) -> DataFrame:
    """(group_id, digest) of an operation graph in execution order."""
    line = framed([F.col(c).cast("string") for c in ("operation", "phase", "dependencies")], field16)
    return graph.groupBy("group_id").agg(fold(["ordinal", "operation"], line).alias("digest"))


def findings_of(*parts: tuple[DataFrame, str]) -> DataFrame:
    """(book_id, code, severity) of several issue tables under one severity, Warning."""
    return reduce(DataFrame.unionByName, [df.select("book_id", F.lit(code).alias("code"), F.lit("Warning").alias("severity")) for df, code in parts])
