"""Conflicts and consensus inside duplicate groups: which members disagree, and who is separated.

Three consensus rules, kept apart on purpose: `mode_consensus` (strictly most
frequent value of two or more), `separate_known` (exactly one value held twice;
only known outliers go) and `separate_disjoint` (sets; signatures held twice and
overlap decide).  All are aggregations over (group, value); groups are never
collected whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import signature


def mode_consensus(rows: DataFrame, value: str) -> DataFrame:
    """(group_id, consensus): the one most frequent non-null value with two or more; a tie or none: null."""
    counts = rows.where(F.col(value).isNotNull()).groupBy("group_id", value).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    best = counts.groupBy("group_id").agg(F.max("n").alias("n"), F.max_by(value, "n").alias("v"), F.collect_list("n").alias("all_n"))
    alone = F.size(F.filter("all_n", lambda x: x == F.col("n"))) == 1
    return rows.select("group_id").distinct().join(best.select("group_id", F.when(alone, F.col("v")).alias("consensus")), "group_id", "left")


def known_values_agree(rows: DataFrame, value: str) -> DataFrame:
    """(group_id, book_id, agrees): the value equals the consensus, or else the only known value."""
    only = rows.groupBy("group_id").agg(F.when(F.count_distinct(value) == 1, F.min(value)).alias("only"))
    said = mode_consensus(rows, value).join(only, "group_id")
    return rows.join(said, "group_id").select("group_id", "book_id", F.coalesce(F.col(value) == F.coalesce("consensus", "only"), F.lit(False)).alias("agrees"))


def separate_known(rows: DataFrame, value: str, code: str) -> DataFrame:
    """(group_id, book_id, code): members to separate because `value` conflicts.

    One distinct value: nobody.  Exactly one value held by two or more: the known
    others.  Otherwise all members, known or not.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy("group_id", value).agg(F.count(F.lit(1)).alias("n"))
    state = counts.groupBy("group_id").agg(F.count(F.lit(1)).alias("distinct"), F.sum((F.col("n") >= 2).cast("int")).alias("held"), F.max(F.when(F.col("n") >= 2, F.col(value))).alias("agreed")).where("distinct > 1")
    joined = rows.join(state, "group_id")
    goes = F.when(F.col("held") == 1, F.col(value).isNotNull() & (F.col(value) != F.col("agreed"))).otherwise(F.lit(True))
    return joined.where(goes).select("group_id", "book_id", F.lit(code).alias("code"))


def separate_disjoint(rows: DataFrame, values: str, code: str) -> DataFrame:
    """(group_id, book_id, code) for sets of which some pair in the group is disjoint.

    Disjoint pairs are looked for between distinct signatures of a group, not
    members.  One signature held twice: those that do not overlap it go, members
    without values stay; otherwise all members go.
    """
    signed = rows.withColumn("_sig", signature(F.col(values)))
    known = signed.where(F.col("_sig").isNotNull()).groupBy("group_id", "_sig").agg(F.count(F.lit(1)).alias("n"), F.first(values).alias("_set"))
    other = known.select("group_id", F.col("_sig").alias("_sig2"), F.col("_set").alias("_set2"))
    apart = known.join(other, "group_id").where((F.col("_sig") < F.col("_sig2")) & ~F.arrays_overlap("_set", "_set2")).select("group_id").distinct()
    agreed = known.groupBy("group_id").agg(F.sum((F.col("n") >= 2).cast("int")).alias("held"), F.max_by("_set", F.when(F.col("n") >= 2, F.col("n")).otherwise(0)).alias("_agreed"))
    joined = signed.join(apart, "group_id").join(agreed, "group_id")
    goes = F.when(F.col("held") == 1, F.col("_sig").isNotNull() & ~F.arrays_overlap(values, "_agreed")).otherwise(F.lit(True))
    return joined.where(goes).select("group_id", "book_id", F.lit(code).alias("code"))


def year_conflicts(rows: DataFrame, gap: int = 2) -> tuple[DataFrame, DataFrame]:
    """(group_id, severity, gap) warnings where years differ, and the members that a material gap separates."""
    spans = rows.groupBy("group_id").agg(F.min("year").alias("low"), F.max("year").alias("high")).where("high > low").withColumn("gap", F.col("high") - F.col("low"))
    warnings = spans.select("group_id", F.when(F.col("gap") >= gap, "ManualReview").otherwise("Advisory").alias("severity"), "gap")
    wide = rows.join(spans.where(F.col("gap") >= gap).select("group_id"), "group_id", "left_semi")
    return warnings, separate_known(wide, "year", "METADATA.PUBLICATION_YEAR_CONFLICT")


def series_conflicts(rows: DataFrame) -> DataFrame:
    """Members separated by different series names, or by different indexes within a series."""
    names = separate_known(rows, "series", "METADATA.SERIES_CONFLICT")
    inside = rows.where(F.col("series").isNotNull() & F.col("series_index").isNotNull())
    counts = inside.groupBy("group_id", "series", "series_index").agg(F.count(F.lit(1)).alias("n"))
    state = counts.groupBy("group_id", "series").agg(F.count(F.lit(1)).alias("distinct"), F.sum((F.col("n") >= 2).cast("int")).alias("held"), F.max(F.when(F.col("n") >= 2, F.col("series_index"))).alias("agreed")).where("distinct > 1")
    goes = F.when(F.col("held") == 1, F.col("series_index") != F.col("agreed")).otherwise(F.lit(True))
    indexes = inside.join(state, ["group_id", "series"]).where(goes).select("group_id", "book_id", F.lit("METADATA.SERIES_INDEX_CONFLICT").alias("code"))
    return names.unionByName(indexes)


def cohort(members: DataFrame, separated: DataFrame) -> DataFrame:
    """(group_id, book_id, in_cohort, outcome): members without separation; a cohort below two is all retained separately."""
    gone = separated.select("group_id", "book_id").distinct().withColumn("gone", F.lit(True))
    marked = members.select("group_id", "book_id").join(gone, ["group_id", "book_id"], "left").withColumn("stays", F.col("gone").isNull())
    size = marked.groupBy("group_id").agg(F.sum(F.col("stays").cast("int")).alias("cohort_size"))
    joined = marked.join(size, "group_id")
    return joined.select("group_id", "book_id", (F.col("stays") & (F.col("cohort_size") >= 2)).alias("in_cohort"), F.when(F.col("cohort_size") < 2, "RetainedSeparate").when(F.col("stays"), "Cohort").otherwise("Separated").alias("outcome"))


def top_source(vectors: DataFrame, order: list, same: list[str]) -> DataFrame:
    """(group_id, book_id, runner_up, tied, strength): the first record of each group by `order`, which ends in its id."""
    w = Window.partitionBy("group_id").orderBy(*order)
    ranked = vectors.withColumn("rank", F.row_number().over(w)).withColumn("runner_up", F.lead("book_id").over(w)).withColumn("next", F.lead(F.struct(*same)).over(w))
    tied = F.coalesce(F.struct(*same).eqNullSafe(F.col("next")) & F.col("runner_up").isNotNull(), F.lit(False))
    return ranked.where("rank = 1").select("group_id", "book_id", "runner_up", tied.alias("tied"), F.when(tied, "Safe").otherwise("Strong").alias("strength"))


def signal_counts(rows: DataFrame, signals: list[str]) -> DataFrame:
    """(group_id, book_id, conflicts, consistency): in how many signals a record contradicts the group's consensus, and agrees with it.

    Consensus as in `mode_consensus`; agreement also with the only known value.  Unknown values count for neither.
    """
    out, against, agrees = rows.select("group_id", "book_id", *signals), F.lit(0), F.lit(0)
    for v in signals:
        counts = rows.where(F.col(v).isNotNull()).groupBy("group_id", v).agg(F.count(F.lit(1)).alias("n"))
        best = counts.groupBy("group_id").agg(F.max("n").alias("t"), F.max_by(v, "n").alias("b"), F.collect_list("n").alias("ns"))
        shared = F.when((F.col("t") >= 2) & (F.size(F.filter("ns", lambda x: x == F.col("t"))) == 1), F.col("b"))
        out = out.join(best.select("group_id", shared.alias(f"_c_{v}"), F.when(F.size("ns") == 1, F.col("b")).alias(f"_o_{v}")), "group_id", "left")
        against = against + F.coalesce(F.col(v) != F.col(f"_c_{v}"), F.lit(False)).cast("int")
        agrees = agrees + F.coalesce(F.col(v) == F.coalesce(f"_c_{v}", f"_o_{v}"), F.lit(False)).cast("int")
    return out.select("group_id", "book_id", against.alias("conflicts"), agrees.alias("consistency"))


def metadata_source(vectors: DataFrame) -> DataFrame:
    """`top_source` by core, integrity, fewest conflicts, completeness, consistency, strong ids and id; none where no record is core-usable."""
    usable = vectors.join(vectors.where("core").select("group_id").distinct(), "group_id", "left_semi")
    same = ["core", "integrity", "conflicts", "completeness", "consistency", "strong_ids"]
    return top_source(usable, [*[F.asc(c) if c == "conflicts" else F.desc(c) for c in same], F.asc("book_id")], same)


def availability(formats: DataFrame) -> DataFrame:
    """(group_id, warns): some two non-empty format sets of a group's records are disjoint or differ in two or more.

    `formats` has (group_id, book_id, formats array); distinct sets are compared, not records.
    """
    sets = formats.where(F.size("formats") > 0).select("group_id", F.array_sort(F.array_distinct("formats")).alias("a")).distinct()
    pair = sets.join(sets.select("group_id", F.col("a").alias("b")), "group_id").where(F.array_join("a", "|") < F.array_join("b", "|"))
    differ = F.size(F.array_except("a", "b")) + F.size(F.array_except("b", "a"))
    warned = pair.groupBy("group_id").agg(F.bool_or(~F.arrays_overlap("a", "b") | (differ >= 2)).alias("warns"))
    return formats.select("group_id").distinct().join(warned, "group_id", "left").select("group_id", F.coalesce("warns", F.lit(False)).alias("warns"))


def without_formats(members: DataFrame, files: DataFrame) -> DataFrame:
    """(group_id, book_id, code) of records that declare no file at all."""
    return members.join(files.select("book_id").distinct(), "book_id", "left_anti").select("group_id", "book_id", F.lit("FORMAT.NO_DECLARED_FORMATS").alias("code"))
