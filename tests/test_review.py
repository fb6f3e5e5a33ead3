import pytest
from pyspark.sql import functions as F

from bindery.operators import conflicts, recommend, scoring
from bindery.operators.skew import dealt_join
from bindery.plans import cleanup, review


def test_unlinked_codes(spark):
    said = spark.createDataFrame([(1, "A"), (1, "B"), (2, "A")], "group_id long, code string")
    assert [(r.group_id, r.code) for r in review.unlinked_codes(said, said.where("group_id = 2 OR code = 'A'")).collect()] == [(1, "B")]


def test_graph_mismatch(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (2, "x")], "group_id long, k string")
    assert review.graph_mismatch(a, a, ["k"]).collect() == []
    out = review.graph_mismatch(a, a.where("k = 'x'").withColumn("group_id", F.lit(1).cast("long")), ["k"]).orderBy("group_id").collect()
    assert [tuple(r) for r in out] == [(1, 1, 0), (2, 1, 0)]


def test_shells_and_prefixes(spark):
    groups = spark.createDataFrame([(1, 2), (2, 2), (3, 1)], "group_id long, member_count long")
    members = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 1)], "group_id long, book_id long")
    assert sorted(r.group_id for r in review.shells(groups, members).collect()) == [2, 3]
    rows = spark.createDataFrame([([1, 2], [1, 2, 3]), ([1, 3], [1, 2, 3]), ([1, 2, 3, 4], [1, 2, 3]), ([], [])], "a array<int>, b array<int>")
    assert [r[0] for r in rows.select(review.is_prefix(F.col("a"), F.col("b"))).collect()] == [True, False, False, True]


def test_preflight(spark):
    rows = [(1, "Approved", "d", "d", False, 0, 0), (2, "Valid", None, "d", True, 2, 1), (3, "Approved", None, None, False, 0, 0)]
    out = review.preflight(spark.createDataFrame(rows, "plan_id long, state string, approved_digest string, digest string, stale boolean, violations long, missing_sources long"))
    assert sorted((r.plan_id, r.code) for r in out.collect()) == [(2, f"EXECUTION.{c}") for c in ("APPROVAL_INVALID", "PLAN_STALE", "PLAN_TAMPERED", "PLAN_UNSAFE", "SOURCE_UNAVAILABLE")]


def test_dealt_join_keeps_every_row_of_a_hot_key(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), "id")
    out = dealt_join(rows, spark.createDataFrame([(7, "hot"), (1, "one")], "k long, v string"), ["k"], F.col("id"))
    assert {r.v: r["count"] for r in out.groupBy("v").count().collect()} == {"hot": 1668, "one": 1}


CANDIDATES = "group_id long, format string, book_id long, path string, score int, sha256 string, status string"
FINDINGS = "group_id long, book_id long, rule string, points int, severity string"
NAV, OUT = (("EPUB.NAVIGATION", 4, "Positive"), ("EPUB.NAVIGATION", -6, "Warning")), ("EPUB.OPEN", 0, "Disqualifying")
ERROR = ("EPUB.CHAPTER.EMPTY", -2, "Error")


@pytest.mark.parametrize(
    ("scores", "found", "reason", "source"),
    [
        ([70, 55], [[NAV[0]], [NAV[0]]], "EPUB.SCORES_TOO_CLOSE", None),  # a lead without a decisive difference
        ([70, 55], [[NAV[0]], [NAV[1]]], "EPUB.MATERIAL_QUALITY_ADVANTAGE", 1),
        ([70, 55, 50], [[NAV[0]], [NAV[1]], [NAV[0]]], "EPUB.SCORES_TOO_CLOSE", None),  # not over every rival
        ([70, 55], [[NAV[0], ERROR], [NAV[1]]], "EPUB.SCORES_TOO_CLOSE", None),  # a fault that the rival lacks
        ([70, 55], [[NAV[0], ERROR], [NAV[1], ERROR]], "EPUB.MATERIAL_QUALITY_ADVANTAGE", 1),
        ([None, 20], [[OUT], [NAV[1]]], "EPUB.VALID_OVER_DISQUALIFIED", 2),
        ([None, 20], [[("EPUB.ENCRYPTION", 0, "Disqualifying")], [NAV[1]]], "EPUB.SCORES_TOO_CLOSE", None),  # not a decisive rule
        ([70, None], [[NAV[0]], []], "EPUB.SCORES_TOO_CLOSE", None),  # not assessed
        ([None, 20, 70], [[OUT], [NAV[1]], [NAV[0]]], "EPUB.SCORES_TOO_CLOSE", None),
    ],
)
def test_assessed_epubs(spark, scores, found, reason, source):
    rows = spark.createDataFrame([(1, "EPUB", i + 1, "p", s, f"x{i}", "Present") for i, s in enumerate(scores)], CANDIDATES)
    findings = spark.createDataFrame([(1, i + 1, *f) for i, fs in enumerate(found) for f in fs], FINDINGS)
    r = recommend.select_formats(rows, findings=findings).first()
    assert (r.reason, r.source_id, r.resolution) == (reason, source, "Selected" if source else "UnresolvedConflict")


def test_equal_files_come_from_the_metadata_source_and_unscored_ones_stay_open(spark):
    rows = spark.createDataFrame([(1, "PDF", 1, "a", 0, "x", "Present"), (1, "PDF", 2, "b", 0, "x", "Present"), (2, "EPUB", 3, "a", 90, "x", "Present"), (2, "EPUB", 4, "b", 70, "y", "Present"), (2, "EPUB", 5, "c", None, "z", "Present")], CANDIDATES)
    out = recommend.select_formats(rows, sources=spark.createDataFrame([(1, 2)], "group_id long, book_id long"))
    assert {r.group_id: (r.source_id, r.source_path) for r in out.collect()} == {1: (2, "b"), 2: (None, None)}


def test_coverage_reports_a_format_that_the_plan_omits(spark):
    files = spark.createDataFrame([(1, "EPUB", 1, "a", 9, "x", "Present"), (1, "EPUB", 2, "b", 9, "x", "Present"), (1, "PDF", 2, "c", 9, "y", "Present")], CANDIDATES)
    plan = cleanup.instructions(files, recommend.select_formats(files), spark.createDataFrame([(1, 1)], "group_id long, target_id long"))
    assert cleanup.coverage_violations(files, plan).collect() == []
    omitted = plan.where("coalesce(format, '') <> 'PDF'")
    assert [(r.book_id, r.format) for r in cleanup.coverage_violations(files, omitted).collect()] == [(2, "PDF")]


def test_identifier_conflicts_of_every_type(spark):
    rows = spark.createDataFrame([(1, 1, ["ISBN:1", "DOI:a"]), (1, 2, ["ISBN:1", "DOI:b"]), (2, 3, ["ASIN:a"]), (2, 4, ["ASIN:a"]), (2, 5, ["ASIN:b", "OCLC:1"])], "group_id long, book_id long, strong array<string>")
    assert sorted((r.book_id, r.type) for r in recommend.identifier_conflicts(rows).collect()) == [(1, "DOI"), (2, "DOI"), (5, "ASIN")]


def test_metadata_source_counts_conflicts_and_needs_a_usable_record(spark):
    rows = spark.createDataFrame([(1, 1, "A", 2020), (1, 2, "B", 2021), (1, 3, "B", None)], "group_id long, book_id long, publisher string, year int")
    assert {r.book_id: (r.conflicts, r.consistency) for r in conflicts.signal_counts(rows, ["publisher", "year"]).collect()} == {1: (1, 0), 2: (0, 1), 3: (0, 1)}
    vector = "group_id long, book_id long, core boolean, integrity boolean, conflicts int, completeness int, consistency int, strong_ids int"
    vectors = spark.createDataFrame([(1, 1, True, True, 1, 7, 0, 0), (1, 2, True, True, 0, 3, 0, 0), (1, 3, True, True, 0, 3, 1, 0), (2, 4, False, True, 0, 7, 4, 1)], vector)
    assert [(r.book_id, r.runner_up, r.tied) for r in conflicts.metadata_source(vectors).collect()] == [(3, 2, False)]


def test_finding_rows_keep_a_hundred_and_one_omitted_row(spark):
    empty = "array<string>"
    facts = spark.range(1).select(F.lit("h").alias("host"), F.transform(F.sequence(F.lit(1), F.lit(102)), lambda i: F.lpad(i.cast("string"), 4, "0")).alias("empty_chapters"), *[F.array().cast(empty).alias(c) for c in ("problems", "missing_spine", "broken_refs", "repeated_refs", "authors", "languages")], *[F.lit(None).cast("string").alias(c) for c in ("title", "date", "strong_identifier")], *[F.lit(True).alias(c) for c in ("cover", "navigation")], *[F.lit(600).alias(c) for c in ("cover_width", "cover_height", "spine", "chars")])
    rows = [r for r in scoring.findings(facts, ["host"]).collect() if r.rule == "EPUB.CHAPTER.EMPTY"]
    assert len(rows) == 101 and rows[-1].evidence == "omitted:2" and sum(r.points for r in rows) == -10
