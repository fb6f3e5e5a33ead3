"""A reviewer's override of a recommendation: what is wrong with it, and what it makes of the recommendation."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

#: Review states and actions on a format (fixed values).
STATUSES = ["Unreviewed", "Accepted", "ManuallyAdjusted", "Deferred", "KeepSeparate", "NotDuplicates"]
ACTIONS = ["SelectSource", "MarkUnresolved", "ExcludeFinalFormat"]
APART = ["KeepSeparate", "NotDuplicates"]


class Review(NamedTuple):
    """Recommendations and the overrides of them, by group; ids are those of records."""

    generated: DataFrame  # group_id, model, input, source_id of the metadata
    members: DataFrame  # group_id, book_id
    selections: DataFrame  # group_id, format, source_id
    candidates: DataFrame  # group_id, format, book_id, status
    separated: DataFrame  # group_id, book_id that the recommendation keeps apart
    overrides: DataFrame  # group_id, requested, model, input, source_id or null
    formats: DataFrame  # group_id, format, action, source_id or null; one row a format
    retained: DataFrame  # group_id, book_id that the reviewer keeps apart


def _fault(rows: DataFrame, code: str | Column, about: str | None = None) -> DataFrame:
    named = F.lit(code) if isinstance(code, str) else code
    return rows.select("group_id", named.alias("code"), (F.col(about).cast("string") if about else F.lit(None).cast("string")).alias("about"))


def _judged(r: Review) -> tuple[DataFrame, DataFrame]:
    """(group_id, code, about) of what is wrong, and every overridden group with its flags."""
    now = r.generated.select("group_id", F.col("model").alias("_m"), F.col("input").alias("_i"), F.col("source_id").alias("_s"))
    head = r.overrides.join(now, "group_id").withColumn("live", F.col("model").eqNullSafe(F.col("_m")) & F.col("input").eqNullSafe(F.col("_i")))
    head = head.withColumn("apart", F.coalesce(F.col("requested").isin(APART), F.lit(False))).withColumn("metadata", F.coalesce("source_id", "_s"))
    live = head.where("live")
    kept = r.separated.select("group_id", "book_id").unionByName(r.retained.select("group_id", "book_id")).distinct()
    source = live.where("source_id IS NOT NULL").select("group_id", F.col("source_id").alias("book_id"))
    wanted = r.formats.join(live.select("group_id"), "group_id", "left_semi")
    own = r.selections.select("group_id", "format", F.col("source_id").alias("own"), F.lit(True).alias("known"))
    present = r.candidates.where("status = 'Present'").select("group_id", "format", F.col("book_id").alias("source_id"), F.lit(True).alias("there")).distinct()
    each = wanted.join(own, ["group_id", "format"], "left").join(present, ["group_id", "format", "source_id"], "left")
    selects = F.col("action") == "SelectSource"
    code = (
        F.when(F.trim(F.coalesce("format", F.lit(""))) == "", "FORMAT_REQUIRED").when(~F.coalesce(F.col("action").isin(ACTIONS), F.lit(False)), "FORMAT_ACTION_INVALID").when(F.col("known").isNull(), "FORMAT_NOT_REPRESENTED")
        .when(selects & F.col("there").isNull(), "FORMAT_SOURCE_UNAVAILABLE").when(~selects & F.col("source_id").isNotNull(), "FORMAT_ACTION_SOURCE_CONFLICT")
    )
    of_metadata = live.where("NOT apart AND metadata IS NOT NULL").select("group_id", F.col("metadata").alias("book_id")).join(kept, ["group_id", "book_id"], "left_semi")
    first = [
        _fault(head.where(~F.coalesce(F.col("requested").isin(STATUSES), F.lit(False))), "REVIEW_STATUS_INVALID"), _fault(head.where("NOT live"), "STALE_OVERRIDE"),
        _fault(source.join(r.members, ["group_id", "book_id"], "left_anti"), "METADATA_SOURCE_NOT_MEMBER", "book_id"),
        _fault(r.retained.join(live.select("group_id"), "group_id", "left_semi").join(r.members, ["group_id", "book_id"], "left_anti"), "RETAINED_RECORD_NOT_MEMBER", "book_id"),
        _fault(each.withColumn("_code", code).where("_code IS NOT NULL"), F.col("_code"), "format"), _fault(of_metadata, "RETAINED_METADATA_CONFLICT", "book_id"),
    ]
    faults = reduce(DataFrame.unionByName, first)
    # what follows is asked of overrides that are sound so far
    sound = live.join(faults.select("group_id").distinct(), "group_id", "left_anti")
    done = r.formats.select("group_id", "format", "action", F.col("source_id").alias("chosen"))
    laid = r.selections.join(done, ["group_id", "format"], "left").withColumn("book_id", F.when(F.col("action").isNull(), F.col("source_id")).when(selects, F.col("chosen")))
    supplied = laid.where("book_id IS NOT NULL").join(sound.where("NOT apart").select("group_id"), "group_id", "left_semi").join(kept, ["group_id", "book_id"], "left_semi")
    second = _fault(supplied, "RETAINED_FORMAT_CONFLICT", "format")
    touched = r.formats.select("group_id").unionByName(r.retained.join(r.separated, ["group_id", "book_id"], "left_anti").select("group_id")).distinct().withColumn("touched", F.lit(True))
    counts = r.members.join(kept.withColumn("_kept", F.lit(True)), ["group_id", "book_id"], "left").groupBy("group_id").agg(F.bool_and(F.col("_kept").isNotNull()).alias("all_apart"))
    sound = sound.join(second.select("group_id").distinct(), "group_id", "left_anti").join(touched, "group_id", "left").join(counts, "group_id", "left")
    sound = sound.withColumn("changed", F.col("touched").isNotNull() | ~F.col("metadata").eqNullSafe(F.col("_s")))
    adjusted = sound.where("requested = 'Accepted' AND changed")
    faults = faults.unionByName(second).unionByName(_fault(adjusted, "ACCEPTED_REQUIRES_GENERATED_SELECTION"))
    return faults, sound.where("NOT (requested = 'Accepted' AND changed)")


def override_errors(review: Review) -> DataFrame:
    """(group_id, code, about): every fault of the overrides, `about` the record or format meant.

    An override of another model or input is stale and judged no further; conflicts of
    kept-apart records with formats are sought where nothing else is wrong, and
    acceptance of a changed selection last.
    """
    return _judged(review)[0]


def reviewed(review: Review) -> DataFrame:
    """(group_id, status, source_id, effective) of the sound overrides.

    Deferred, KeepSeparate and NotDuplicates stand as asked; a changed selection is
    ManuallyAdjusted, an unchanged one Accepted or Unreviewed.  No selection is in effect
    (`effective` false, no source) where the records stay separate, by status or one by one.
    """
    sound = _judged(review)[1]
    status = F.when(F.col("apart") | (F.col("requested") == "Deferred"), F.col("requested")).when(F.col("changed"), "ManuallyAdjusted").when(F.col("requested") == "Accepted", "Accepted").otherwise("Unreviewed")
    effective = ~F.col("apart") & ~F.coalesce("all_apart", F.lit(True))
    return sound.select("group_id", status.alias("status"), F.when(effective, F.col("metadata")).alias("source_id"), effective.alias("effective"))
