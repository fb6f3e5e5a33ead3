"""Cleanup plans as tables: eligibility, instructions, issues, staleness, lifecycle and the operation graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.digests import field8, fold, framed

#: Review statuses that block a plan, and how (fixed values).
BLOCKING_REVIEWS = {"Unreviewed": "PLAN.REVIEW_REQUIRED", "Deferred": "PLAN.REVIEW_DEFERRED", "KeepSeparate": "PLAN.RECORDS_KEEP_SEPARATE", "NotDuplicates": "PLAN.NOT_DUPLICATES"}
#: Resolutions that block a plan (fixed values).
BLOCKING_RESOLUTIONS = {"UnresolvedConflict": ["PLAN.FORMAT_UNRESOLVED"], "Unavailable": ["PLAN.SOURCE_FILE_UNAVAILABLE"], "ExplicitlyExcludedByUser": ["PLAN.FORMAT_EXCLUDED", "PLAN.UNIQUE_FORMAT_NOT_RETAINED"]}
#: Legal plan transitions (fixed values).
PLAN_EDGES = [("Draft", "Valid"), ("Draft", "Blocked"), ("Valid", "Approved"), ("Valid", "Stale"), ("Valid", "Blocked"), ("Approved", "Stale"), ("Approved", "Revoked")]
STATE_COLUMNS = ["title", "publisher", "size"]


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def eligibility(groups: DataFrame, selections: DataFrame, files: DataFrame) -> DataFrame:
    """(group_id, code, book_id, format): what keeps a group from a plan.

    `groups` has group_id, review, fresh (boolean), target_id, target_is_member, any_separated;
    `selections` (group_id, format, resolution); `files` (group_id, book_id, format, status, sha256).
    """
    none = F.lit(None)
    review = F.when(~F.coalesce(F.col("review").isin("Accepted", "ManuallyAdjusted"), F.lit(False)), F.coalesce(F.try_element_at(_map(BLOCKING_REVIEWS), F.coalesce("review", F.lit(""))), F.lit("PLAN.REVIEW_REQUIRED")))
    codes = F.array_compact(F.array(review, F.when(~F.col("fresh"), "PLAN.RECOMMENDATION_STALE"), F.when(~F.coalesce("target_is_member", F.lit(False)), "PLAN.TARGET_INVALID"), F.when(F.col("any_separated"), "PLAN.RECORDS_KEEP_SEPARATE")))
    of_group = groups.select("group_id", F.explode(F.array_distinct(codes)).alias("code"), none.cast("long").alias("book_id"), none.cast("string").alias("format"))
    blocked = F.create_map(*[x for k, v in BLOCKING_RESOLUTIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    of_format = selections.select("group_id", F.explode(F.try_element_at(blocked, F.col("resolution"))).alias("code"), none.cast("long").alias("book_id"), "format")
    wrong = F.array_compact(F.array(F.when(F.col("status") != "Present", "PLAN.SOURCE_FILE_UNAVAILABLE"), F.when(F.col("sha256").isNull(), "PLAN.SOURCE_HASH_REQUIRED")))
    of_file = files.select("group_id", F.explode(wrong).alias("code"), "book_id", "format")
    return of_group.unionByName(of_format).unionByName(of_file)


def instructions(files: DataFrame, selections: DataFrame, targets: DataFrame) -> DataFrame:
    """(group_id, kind, book_id, format, reason): retentions, file removals, record removals and backups of a plan.

    A kept file on the target is RetainInTarget, elsewhere RetainFromOtherRecord.  Every
    other file is removed: as a copy (equal fingerprint), as a reviewed replacement, or,
    if it is the kept file of another record, with that record once it is retained.
    """
    chosen = selections.where("resolution = 'Selected'").select("group_id", "format", "source_id")
    joined = files.join(targets.select("group_id", "target_id"), "group_id").join(chosen, ["group_id", "format"])
    kept = joined.where("book_id = source_id").select("group_id", "format", F.col("sha256").alias("kept_sha")).groupBy("group_id", "format").agg(F.min("kept_sha").alias("kept_sha"))
    source, target = F.col("book_id") == F.col("source_id"), F.col("book_id") == F.col("target_id")
    retained = joined.where(source).select("group_id", F.lit("Retention").alias("kind"), "book_id", "format", F.when(target, "RetainInTarget").otherwise("RetainFromOtherRecord").alias("reason"))
    removed = joined.where(~(source & target)).join(kept, ["group_id", "format"]).select("group_id", F.lit("FormatRemoval").alias("kind"), "book_id", "format", F.when(source, "RemovedWithSourceRecordAfterRetention").when(F.col("sha256") == F.col("kept_sha"), "ByteIdenticalAlternative").otherwise("ReviewedNonIdenticalReplacement").alias("reason"))
    records = joined.where(~target).select("group_id", F.lit("RecordRemoval").alias("kind"), "book_id", F.lit(None).cast("string").alias("format"), F.lit("NotTarget").alias("reason")).distinct()
    backups = joined.select("group_id", F.lit("Backup").alias("kind"), "book_id", "format", F.lit("Format").alias("reason"))
    metadata = joined.select("group_id", F.lit("Backup").alias("kind"), "book_id", F.lit(None).cast("string").alias("format"), F.lit("Metadata").alias("reason")).distinct()
    return reduce(DataFrame.unionByName, [retained, removed, records, backups, metadata])


def coverage_violations(files: DataFrame, plan: DataFrame) -> DataFrame:
    """(group_id, book_id, format): files of a plan's groups that are neither kept nor removed, or both in a way that is not allowed."""
    done = plan.where("kind IN ('Retention', 'FormatRemoval')").groupBy("group_id", "book_id", "format").agg(F.sum((F.col("kind") == "Retention").cast("int")).alias("kept"), F.sum((F.col("kind") == "FormatRemoval").cast("int")).alias("gone"), F.bool_or(F.col("reason") == "RemovedWithSourceRecordAfterRetention").alias("moved"))
    judged = files.join(plan.select("group_id").distinct(), "group_id", "left_semi").join(done, ["group_id", "book_id", "format"], "left")
    fine = (F.col("kept") + F.col("gone") == 1) | ((F.col("kept") == 1) & (F.col("gone") == 1) & F.col("moved"))
    return judged.where(~F.coalesce(fine, F.lit(False))).select("group_id", "book_id", "format")


def required_issues(plan: DataFrame, covers: DataFrame) -> DataFrame:
    """(group_id, severity, code, n): notes that every plan must carry."""
    always = ["PLAN.BACKUP_REQUIRED", "PLAN.NO_FILES_MODIFIED", "PLAN.REVIEW_BOUND", "PLAN.VERIFICATION_REQUIRED"]
    groups = plan.select("group_id").distinct()
    notes = groups.select("group_id", F.lit("Information").alias("severity"), F.explode(F.array(*map(F.lit, always))).alias("code"), F.lit(1).cast("long").alias("n"))
    replaced = plan.where("reason = 'ReviewedNonIdenticalReplacement'").groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).select("group_id", F.lit("Warning").alias("severity"), F.lit("PLAN.NON_IDENTICAL_REPLACEMENT").alias("code"), "n")
    covered = covers.where("has_cover").groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).select("group_id", F.lit("Information").alias("severity"), F.lit("PLAN.COVER_PRESENT").alias("code"), "n")
    return notes.unionByName(replaced).unionByName(covered.join(groups, "group_id", "left_semi"))


def state_diff(expected: DataFrame, current: DataFrame) -> DataFrame:
    """(group_id, book_id, change, fields): records that are missing, new or different, by a null-safe outer join."""
    e = expected.select("book_id", F.col("group_id").alias("eg"), *[F.col(c).alias(f"e_{c}") for c in STATE_COLUMNS], F.lit(True).alias("was"))
    c = current.select("book_id", F.col("group_id").alias("cg"), *[F.col(x).alias(f"c_{x}") for x in STATE_COLUMNS], F.lit(True).alias("now"))
    joined = e.join(c, "book_id", "full")
    fields = F.array_join(F.array_compact(F.array(*[F.when(~F.col(f"e_{x}").eqNullSafe(F.col(f"c_{x}")), F.lit(x)) for x in STATE_COLUMNS])), ",")
    change = F.when(F.col("now").isNull(), "Missing").when(F.col("was").isNull(), "New").when(fields != "", "Changed")
    return joined.select(F.coalesce("eg", "cg").alias("group_id"), "book_id", change.alias("change"), F.when(change == "Changed", fields).otherwise("").alias("fields")).where("change IS NOT NULL")


def stale_plans(plans: DataFrame, diff: DataFrame) -> DataFrame:
    """(group_id, changes) of plans whose records changed: PLAN.STALE."""
    return plans.join(diff.groupBy("group_id").agg(F.count(F.lit(1)).alias("changes")), "group_id").select("group_id", "changes", F.lit("PLAN.STALE").alias("code"))


def illegal_transitions(revisions: DataFrame, edges: list[tuple[str, str]], key: str = "plan_id") -> DataFrame:
    """Revisions (key, revision, from_state, to_state) that do not continue the one before by a legal edge, numbered from 1."""
    w = Window.partitionBy(key).orderBy("revision")
    legal = reduce(lambda a, b: a | b, [(F.col("from_state") == x) & (F.col("to_state") == y) for x, y in edges])
    follows = F.coalesce(F.col("from_state") == F.lag("to_state").over(w), F.row_number().over(w) == 1) & (F.col("revision") == F.row_number().over(w))
    return revisions.withColumn("ok", legal & follows).where("NOT ok").select(key, "revision", "from_state", "to_state")


def latest(plans: DataFrame, key: str = "plan_id", order: str = "revision") -> DataFrame:
    rest = [c for c in plans.columns if c not in (key, order)]
    return plans.groupBy(key).agg(F.max(order).alias(order), *[F.max_by(c, order).alias(c) for c in rest])


def operation_graph(plan: DataFrame, targets: DataFrame) -> DataFrame:
    """(group_id, ordinal, operation, phase, dependencies): checks, then additions, then record removals that wait for all before."""
    check = targets.select("group_id", F.lit(0).alias("phase_no"), F.lit("Precondition").alias("phase"), F.lit("verify:metadata").alias("operation"), F.lit("").alias("k"), F.lit(0).cast("long").alias("b"))
    kept = plan.where("kind = 'Retention'")
    same = F.col("reason") == "RetainInTarget"
    formats = kept.select("group_id", F.when(same, 1).otherwise(2).alias("phase_no"), F.when(same, "Precondition").otherwise("Constructive").alias("phase"), F.concat(F.when(same, "verify:format:").otherwise("construct:format:"), F.col("format")).alias("operation"), F.col("format").alias("k"), F.lit(0).cast("long").alias("b"))
    removal = plan.where("kind = 'RecordRemoval'").select("group_id", F.lit(3).alias("phase_no"), F.lit("Destructive").alias("phase"), F.concat(F.lit("destroy:record:"), F.col("book_id").cast("string")).alias("operation"), F.lit("").alias("k"), F.col("book_id").alias("b"))
    rows = check.join(plan.select("group_id").distinct(), "group_id", "left_semi").unionByName(formats).unionByName(removal)
    w = Window.partitionBy("group_id").orderBy("phase_no", "k", "b")
    before = F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    needs = F.when(F.col("phase_no") == 3, before).when(F.col("operation") == "verify:metadata", 0).otherwise(1)
    return rows.select("group_id", (F.row_number().over(w) - 1).alias("ordinal"), "operation", "phase", needs.cast("long").alias("dependencies"))


def graph_violations(graph: DataFrame) -> DataFrame:
    """(group_id) of graphs with a repeated operation or with anything after the first destructive one but destruction."""
    flags = graph.groupBy("group_id").agg((F.count(F.lit(1)) != F.count_distinct("operation")).alias("twice"), F.min(F.when(F.col("phase") == "Destructive", F.col("ordinal"))).alias("first"), F.max(F.when(F.col("phase") != "Destructive", F.col("ordinal"))).alias("last"))
    return flags.where("twice OR last > first").select("group_id")


def digests(plan: DataFrame) -> DataFrame:
    """(group_id, digest): SHA-256 over a plan's instructions in canonical order, null told from empty."""
    rows = plan.withColumn("_line", framed([F.col(c) for c in ("kind", "book_id", "format", "reason")], field8))
    return rows.groupBy("group_id").agg(fold(["kind", "book_id", "format", "reason"], F.col("_line")).alias("digest"))
