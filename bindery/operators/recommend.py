"""Consolidation recommendations: which file of a format to keep, which records are redundant, how sure that is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.identifiers import canonical_type, strong
from ..functions.text import usable
from .conflicts import separate_disjoint
from .scoring import DECISIVE_RULES

KEYS = ["group_id", "format"]


def metadata_vector(rows: DataFrame, flawed: DataFrame) -> DataFrame:
    """Records with core (usable title and author), integrity, completeness (0 to 7) and strong identifier count.

    `rows` has title, author_sort, strong (array of strong identifiers), languages,
    year, publisher, series, series_index, has_cover; `flawed` the books with findings.
    """
    marked = rows.join(flawed.select("book_id").distinct().withColumn("_flawed", F.lit(True)), "book_id", "left")
    has = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    complete = [usable(F.col("author_sort")), F.size("strong") > 0, F.size("languages") > 0, F.col("year").isNotNull(), F.col("publisher").isNotNull(), F.col("series").isNotNull() & F.col("series_index").isNotNull(), F.col("has_cover")]
    total = sum((has(c) for c in complete[1:]), has(complete[0]))
    return marked.select(*rows.columns, usable(F.col("title")).alias("core"), F.col("_flawed").isNull().alias("integrity"), total.alias("completeness"), F.greatest(F.size("strong"), F.lit(0)).alias("strong_ids"))


def metadata_warnings(rows: DataFrame) -> DataFrame:
    """(group_id, book_id, code): placeholder titles; and once per group that some but not all records know languages."""
    placeholder = rows.where(~usable(F.col("title"))).select("group_id", "book_id", F.lit("METADATA.PLACEHOLDER_VALUE").alias("code"))
    known = (F.size("languages") > 0).cast("int")
    partly = rows.groupBy("group_id").agg(F.sum(known).alias("k"), F.count(F.lit(1)).alias("n")).where("k > 0 AND k < n")
    return placeholder.unionByName(partly.select("group_id", F.lit(None).cast("long").alias("book_id"), F.lit("METADATA.LANGUAGE_INCOMPLETE").alias("code")))


def invalid_identifiers(identifiers: DataFrame) -> DataFrame:
    """(book_id, code) of records with an identifier (type, value) of a strong type whose value is not valid."""
    wrong = canonical_type(F.col("type")).isNotNull() & strong(F.col("type"), F.col("value")).isNull()
    return identifiers.where(wrong).select("book_id", F.lit("IDENTIFIER.STRONG_INVALID").alias("code")).distinct()


def decisive_facts(findings: DataFrame) -> DataFrame:
    """(group_id, book_id, points, faults, out, out_decisively) of assessed EPUBs from findings (rule, points, severity).

    `points` and `faults` (an Error or Disqualifying finding) are arrays in the order of
    DECISIVE_RULES; `out` is any disqualifying finding, `out_decisively` one of a decisive rule.
    """
    grave, of = F.col("severity").isin("Error", "Disqualifying"), lambda r: F.col("rule") == r
    points = F.array(*[F.coalesce(F.sum(F.when(of(r), F.col("points"))), F.lit(0)).cast("long") for r in DECISIVE_RULES])
    faults = F.array(*[F.bool_or(of(r) & grave) for r in DECISIVE_RULES])
    disqualifying = F.col("severity") == "Disqualifying"
    return findings.groupBy("group_id", "book_id").agg(points.alias("points"), faults.alias("faults"), F.bool_or(disqualifying).alias("out"), F.bool_or(disqualifying & F.col("rule").isin(DECISIVE_RULES)).alias("out_decisively"))


def select_formats(candidates: DataFrame, delta: int = 10, findings: DataFrame | None = None, sources: DataFrame | None = None, least: int = 4) -> DataFrame:
    """The ladder of choices per (group, format).

    Nothing present: Unavailable.  One present: FORMAT.ONLY_AVAILABLE_SOURCE.  All
    present files equal: FORMAT.EXACT_BINARY_EQUIVALENT, the file of the metadata source
    (`sources`: group_id, book_id) or else of the smallest record.  The only completed
    EPUB where a decisive rule disqualifies all others: EPUB.VALID_OVER_DISQUALIFIED.  A
    completed EPUB whose score leads every other by `delta`, that is `least` points ahead
    of each in some decisive rule and has no fault which that one lacks:
    EPUB.MATERIAL_QUALITY_ADVANTAGE.  Anything else, and any present EPUB without
    assessment, stays an unresolved conflict.

    `findings` (group_id, book_id, rule, points, severity) are the EPUBs' assessments.
    Without them nothing but the scores is known: a score counts as completed and the
    lead alone decides.  One aggregation and, with findings, a window of the same
    partitioning: equality is least = greatest fingerprint (a distinct count would expand
    the rows), and rivals are compared with the best row, not with each other.
    """
    present = F.col("status") == "Present"
    rows = candidates.withColumn("_away", F.lit(0))
    if sources is not None:
        preferred = sources.groupBy("group_id").agg(F.min("book_id").alias("_source"))
        rows = candidates.join(preferred, "group_id", "left").withColumn("_away", F.when(F.col("book_id") == F.col("_source"), 0).otherwise(1))
    order = F.struct((-F.col("score")).alias("s"), F.col("book_id"))
    if findings is None:
        rows = rows.withColumn("_done", present & F.col("score").isNotNull()).withColumn("_beaten", F.lit(True)).withColumn("_rejected", F.lit(False))
    else:
        rows = rows.join(decisive_facts(findings).withColumn("format", F.lit("EPUB")), [*KEYS, "book_id"], "left")
        rows = rows.withColumn("_done", F.coalesce(present & ~F.col("out") & F.col("score").isNotNull(), F.lit(False))).withColumn("_rejected", F.coalesce(present & F.col("out_decisively"), F.lit(False)))
        w = Window.partitionBy(*KEYS).orderBy(F.desc("_done"), F.desc("score"), "book_id")
        rows = rows.withColumn("_rank", F.row_number().over(w)).withColumn("_p", F.first("points").over(w)).withColumn("_f", F.first("faults").over(w))
        ahead = F.exists(F.zip_with("_p", "points", lambda p, q: p - q >= least), lambda x: x) & ~F.exists(F.zip_with("_f", "faults", lambda p, q: p & ~q), lambda x: x)
        rows = rows.withColumn("_beaten", (F.col("_rank") == 1) | ~present | F.coalesce(ahead, F.lit(False)))
    done = F.col("_done")
    agg = rows.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("declared"), F.sum(present.cast("int")).alias("present"),
        (F.min(F.when(present, F.col("sha256"))).eqNullSafe(F.max(F.when(present, F.col("sha256")))) & F.bool_and(~present | F.col("sha256").isNotNull())).alias("all_equal"),
        F.bool_and(~present | F.col("sha256").isNotNull()).alias("known"), F.count_if(done).alias("completed"), F.count_if(F.col("_rejected")).alias("rejected"), F.bool_and("_beaten").alias("beaten"),
        F.min(F.when(present, F.struct("_away", "book_id", F.translate("path", "\\", "/").alias("path")))).alias("least"),
        F.min(F.when(done, F.struct(order.alias("o"), F.translate("path", "\\", "/").alias("path")))).alias("best"),
        F.slice(F.array_sort(F.collect_list(F.when(done & (F.col("format") == "EPUB"), F.col("score")))), -2, 2).alias("top"),
    )
    lead = F.get("top", F.lit(1)) - F.get("top", F.lit(0))
    sole = F.col("known") & (F.col("completed") == 1) & (F.col("rejected") == F.col("present") - 1)
    material = F.col("known") & (F.col("completed") == F.col("present")) & (lead >= delta) & F.col("beaten")
    reason = F.when(F.col("present") == 0, "FORMAT.NO_AVAILABLE_SOURCE").when(F.col("present") == 1, "FORMAT.ONLY_AVAILABLE_SOURCE").when(F.col("all_equal"), "FORMAT.EXACT_BINARY_EQUIVALENT").when(F.col("format") != "EPUB", "FORMAT.UNASSESSED_NONIDENTICAL_CONFLICT").when(sole, "EPUB.VALID_OVER_DISQUALIFIED").when(material, "EPUB.MATERIAL_QUALITY_ADVANTAGE").otherwise("EPUB.SCORES_TOO_CLOSE")
    out = agg.withColumn("reason", reason)
    status = F.when(F.col("present") == 0, "Unavailable").when(F.col("reason").isin("FORMAT.UNASSESSED_NONIDENTICAL_CONFLICT", "EPUB.SCORES_TOO_CLOSE"), "UnresolvedConflict").otherwise("Selected")
    by_score = F.col("reason").isin("EPUB.VALID_OVER_DISQUALIFIED", "EPUB.MATERIAL_QUALITY_ADVANTAGE")
    strength = F.when(F.col("reason") == "FORMAT.EXACT_BINARY_EQUIVALENT", "Safe").when(F.col("resolution") == "Selected", "Strong")
    out = out.withColumn("resolution", status)
    chosen = F.col("resolution") == "Selected"
    return out.select(*KEYS, "declared", "present", "resolution", "reason", F.when(chosen, F.when(by_score, F.col("best.o.book_id")).otherwise(F.col("least.book_id"))).alias("source_id"), F.when(chosen, F.when(by_score, F.col("best.path")).otherwise(F.col("least.path"))).alias("source_path"), strength.alias("strength"))


def redundant_records(candidates: DataFrame, selections: DataFrame, sources: DataFrame) -> DataFrame:
    """(group_id, book_id): records, not the metadata source, whose files are all present copies of a file kept elsewhere."""
    joined = candidates.join(selections.select(*KEYS, "source_id", "reason", "resolution"), KEYS)
    spare = (F.col("status") == "Present") & (F.col("resolution") == "Selected") & (F.col("source_id") != F.col("book_id")) & (F.col("reason") == "FORMAT.EXACT_BINARY_EQUIVALENT")
    spare_all = joined.groupBy("group_id", "book_id").agg(F.bool_and(F.coalesce(spare, F.lit(False))).alias("spare")).where("spare").drop("spare")
    return spare_all.join(sources.select("group_id", "book_id"), ["group_id", "book_id"], "left_anti")


def decisive_advantage(sums: DataFrame, pairs: DataFrame, least: int = 4) -> DataFrame:
    """(best, other, advantage): some decisive rule differs by `least` points in favour of best, and best has no fault that other lacks.

    `sums` has (book_id, rule, points) with faults below zero; `pairs` (best, other).
    """
    mine, theirs = (sums.select(F.col("book_id").alias(k), "rule", F.col("points").alias(p)) for k, p in (("best", "p"), ("other", "q")))
    a = pairs.join(mine, "best")
    b = pairs.join(theirs, "other")
    both = a.join(b, ["best", "other", "rule"], "full").withColumn("p", F.coalesce("p", F.lit(0))).withColumn("q", F.coalesce("q", F.lit(0)))
    return both.groupBy("best", "other").agg((F.bool_or(F.col("p") - F.col("q") >= least) & ~F.bool_or((F.col("p") < 0) & (F.col("q") >= 0))).alias("advantage"))


def confidence(selections: DataFrame, separated: DataFrame, warnings: DataFrame) -> DataFrame:
    """(group_id, confidence) from selections (resolution, strength, reason), separated groups and warnings (severity)."""
    flags = selections.groupBy("group_id").agg(F.bool_or(F.col("resolution") != "Selected").alias("open"), F.bool_and(F.coalesce(F.col("strength") == "Safe", F.lit(False))).alias("safe"), F.bool_or(F.coalesce(F.col("strength") == "Strong", F.lit(False))).alias("strong"), F.bool_or(F.col("reason") == "FORMAT.ONLY_AVAILABLE_SOURCE").alias("only"))
    apart = separated.select("group_id").distinct().withColumn("apart", F.lit(True))
    warned = warnings.groupBy("group_id").agg(F.bool_or(F.col("severity").isin("ManualReview", "Blocking")).alias("grave"))
    all_ = flags.join(apart, "group_id", "left").join(warned, "group_id", "left")
    grave = F.col("open") | F.coalesce("apart", F.lit(False)) | F.coalesce("grave", F.lit(False))
    level = F.when(grave, "ManualReviewRequired").when(F.col("grave").isNotNull(), "Low").when(F.col("safe"), "Deterministic").when(F.col("strong"), F.when(F.col("only"), "Medium").otherwise("High")).otherwise("Medium")
    return all_.select("group_id", level.alias("confidence"))


def apply_overrides(selections: DataFrame, overrides: DataFrame) -> DataFrame:
    """Selections with the reviewer's action per (group, format): SelectSource, MarkUnresolved or ExcludeFinalFormat.

    A source that is no candidate of the group is refused (`error`), and the generated choice stays.
    """
    joined = selections.join(overrides.select(*KEYS, "action", F.col("source_id").alias("wanted"), "wanted_is_member"), KEYS, "left")
    error = F.when((F.col("action") == "SelectSource") & ~F.coalesce("wanted_is_member", F.lit(False)), "OVERRIDE.SOURCE_OUTSIDE_GROUP")
    ok = F.col("action").isNotNull() & error.isNull()
    resolution = F.when(ok & (F.col("action") == "SelectSource"), "SelectedByUser").when(ok & (F.col("action") == "MarkUnresolved"), "UnresolvedConflict").when(ok & (F.col("action") == "ExcludeFinalFormat"), "ExplicitlyExcludedByUser").otherwise(F.col("resolution"))
    source = F.when(ok & (F.col("action") == "SelectSource"), F.col("wanted")).when(ok, F.lit(None)).otherwise(F.col("source_id"))
    return joined.select(*KEYS, resolution.alias("resolution"), source.alias("source_id"), error.alias("error"))


def reconcile(current: DataFrame, reviews: DataFrame) -> DataFrame:
    """(group_id, freshness): a review of the same model and input holds, another is stale, none is reset."""
    joined = current.join(reviews.select("group_id", F.col("model").alias("m"), F.col("input").alias("i")), "group_id", "left")
    return joined.select("group_id", F.when(F.col("m").isNull(), "Reset").when((F.col("m") == F.col("model")) & (F.col("i") == F.col("input")), "Current").otherwise("Stale").alias("freshness"))


def strong_overlap(rows: DataFrame, kind: str) -> Column:
    """The values of one identifier type in an array of `TYPE:value`."""
    return F.filter(F.col("strong"), lambda v: v.startswith(kind + ":"))


def identifier_conflicts(rows: DataFrame) -> DataFrame:
    """(group_id, book_id, code, type): members that disjoint ISBNs, DOIs, ASINs or OCLC numbers separate, each type by itself; `strong` holds `TYPE:value`."""
    each = [separate_disjoint(rows.withColumn("strong", strong_overlap(rows, t)), "strong", "IDENTIFIER.STRONG_CONFLICT").withColumn("type", F.lit(t)) for t in ("ISBN", "DOI", "ASIN", "OCLC")]
    return reduce(DataFrame.unionByName, each)


def neighbours(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Each row's next and previous `order` value in its `key`, around the ends."""
    w = Window.partitionBy(key).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn("next", F.coalesce(F.lead(order).over(w), F.first(order).over(whole))).withColumn("previous", F.coalesce(F.lag(order).over(w), F.last(order).over(whole)))
