"""Queries over the driver's tables, one per catalog operator; keys start with the inventory's ids."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .functions import digests as D, identifiers as I, text as X
from .operators import catalog, conflicts, duplicates, evidence, orders, recommend, scoring
from .plans import cleanup, overrides, review
from .sources import bridges as B, pages
from .streaming import journal

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# duplicates


@query
def G1_exact_binary_groups(spark, d):
    return duplicates.binary_groups(B.files(spark, d))


@query
def G2_O2_binary_group_members(spark, d):
    files = B.files(spark, d)
    return duplicates.binary_members(files, duplicates.binary_groups(files)).drop("size", "sha256")


@query
def O1_binary_group_ranks(spark, d):
    groups = duplicates.binary_groups(B.files(spark, d)).select("group_id", "size", "sha256")
    return groups.orderBy(F.desc("size"), "sha256").select("group_id", F.row_number().over(Window.partitionBy("size").orderBy("sha256")).alias("rank_in_size"))


def _identities(spark, d):
    resolved = catalog.resolve_authors(B.author_links(spark, d), B.authors(spark, d))
    return duplicates.identities(B.books(spark, d), resolved, resolved.where("code = 'AUTHOR_REFERENCE_MISSING'"))


@query
def F2_F3_eligible_identities(spark, d):
    return _identities(spark, d).withColumn("author_keys", F.array_join("author_keys", "|"))


@query
def G3_metadata_groups(spark, d):
    return duplicates.metadata_groups(_identities(spark, d)).withColumn("author_keys", F.array_join("author_keys", "|"))


@query
def J9_all_candidates_in_one_group(spark, d):
    return duplicates.all_in_one_group(B.candidates(spark, d), ["group_id", "format"])


@query
def J10_binary_evidence(spark, d):
    files = B.files(spark, d)
    members = duplicates.binary_members(files, duplicates.binary_groups(files))
    return duplicates.evidence_consistent(members, files.withColumn("sha256", F.when(F.col("book_id") % 17 != 0, F.col("sha256"))))


# catalog reading


@query
def S3_schema_validation(spark, d):
    tables = {n: B.table(spark, d, n) for n in ("part", "orders")}
    required = {"part": ["p_partkey", "p_name", "p_isbn"], "orders": ["o_orderkey", "o_series"], "series": ["id"]}
    return spark.createDataFrame(catalog.schema_violations(tables, required), "table_name string, column_name string")


@query
def S4_library_id(spark, d):
    rows = B.table(spark, d, "region").select(F.concat(F.lit("00000000-0000-4000-8000-00000000000"), F.col("r_regionkey").cast("string")).alias("uuid"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("uuid").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")).alias("well_formed")).select("n", "well_formed", (F.col("n") == 1).alias("single"))


@query
def S5_book_violations(spark, d):
    books = B.books(spark, d).select(F.when(F.col("book_id") % 100 == 1, F.lit(1).cast("long")).when(F.col("book_id") % 100 == 2, F.col("book_id") - 100000).otherwise(F.col("book_id")).alias("book_id"), F.when(F.col("book_id") % 50 != 3, F.col("title")).alias("title"))
    return catalog.book_violations(books)


@query
def S7_identifier_split(spark, d):
    usable, issues = catalog.split_identifiers(B.identifiers(spark, d))
    return usable.groupBy("type").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("usable")).unionByName(issues.groupBy(F.col("code").alias("type")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("issue")))


@query
def S8_format_violations(spark, d):
    rows = B.candidates(spark, d).select(F.col("group_id").alias("book_id"), F.when(F.col("score") > 48, "").when(F.col("score") % 2 == 0, F.lower("format")).otherwise(F.col("format")).alias("format"))
    return catalog.format_violations(rows)


@query
def S9_single_links(spark, d):
    return catalog.single_link_violations(B.table(spark, d, "orders").select(F.col("o_custkey").alias("book_id"), "o_orderpriority").where("o_orderpriority = '1-URGENT'"))


@query
def S10_row_counts(spark, d):
    out = None
    for name in ("customer", "orders", "part", "supplier"):
        one = B.table(spark, d, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query
def S11_managed_paths(spark, d):
    k = F.col("doc_id") % 9
    directory = F.when(k == 1, "a/../b").when(k == 2, "/a").when(k == 3, "a\\CON.x").when(k == 4, "a/b ").otherwise(F.concat(F.lit("x\\"), "source"))
    stem = F.when(k == 5, "a/b").when(k == 6, "nul").otherwise(F.concat(F.lit("Doc "), F.col("doc_id").cast("string")))
    rows = B.table(spark, d, "documents").select("doc_id", directory.alias("directory"), stem.alias("stem"), F.when(k == 7, "t-x").otherwise("TXT").alias("format"))
    return catalog.resolve_paths(rows).select("doc_id", "path", "code")


@query
def S12_P2_file_status(spark, d):
    declared = B.table(spark, d, "documents").select(F.col("doc_id").alias("sequence"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"))
    outcome = F.when(F.col("doc_id") % 10 == 0, "Missing").when(F.col("doc_id") % 10 == 1, "ChangedDuringHashing").otherwise("Success")
    results = B.table(spark, d, "documents").where("doc_id % 10 <> 2").select(F.col("doc_id").alias("sequence"), outcome.alias("outcome"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return catalog.file_status(declared, results)


@query
def J1_author_references(spark, d):
    return catalog.resolve_authors(B.author_links(spark, d), B.authors(spark, d))


@query
def J2_J3_publication_links(spark, d):
    nations = B.table(spark, d, "nation").where("n_nationkey % 5 <> 0").select(F.col("n_nationkey").alias("publisher_id"), F.col("n_name").alias("publisher"))
    return B.table(spark, d, "customer").select(F.col("c_custkey").alias("book_id"), F.col("c_nationkey").alias("publisher_id")).join(nations, "publisher_id", "left").select("book_id", "publisher", F.when(F.col("publisher").isNull(), "CATALOG_VALUE_INVALID").alias("code"))


@query
def J4_ordered_authors(spark, d):
    return catalog.ordered_values(B.author_links(spark, d).withColumnRenamed("author_id", "author"), "author", ["link_id"]).select("book_id", F.array_join("values", " & ").alias("authors"))


@query
def J5_orphans(spark, d):
    books = B.table(spark, d, "orders").where("o_orderkey % 40 <> 0").select(F.col("o_orderkey").alias("book_id"))
    return catalog.orphans(B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("book_id"), F.col("l_linenumber").alias("line")), books)


@query
def J6_W5_hash_sequence(spark, d):
    return catalog.hash_requests(B.files(spark, d).select("book_id", "format", "path"))


@query
def J7_P7_group_members(spark, d):
    identity = _identities(spark, d)
    return duplicates.metadata_members(identity, duplicates.metadata_groups(identity)).join(B.books(spark, d).select("book_id", "title", "publisher"), "book_id")


@query
def X13_optional_values(spark, d):
    k = F.col("o_orderkey")
    rows = B.table(spark, d, "orders").select(k.alias("book_id"), F.when(k % 13 == 0, "no date").when(k % 13 != 1, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("pubdate"), F.when(k % 17 == 0, "-1").when(k % 17 == 1, "x").when(k % 17 != 2, F.concat((k % 9).cast("string"), F.lit(".5"))).alias("series_index"), F.when(k % 19 == 0, "2").when(k % 19 != 1, (k % 2).cast("string")).alias("has_cover"))
    return catalog.parse_optional(rows).select("book_id", F.date_format("publication_date", "yyyy-MM-dd").alias("published"), "stored_year", F.col("series_index").cast("double").alias("series_index"), "has_cover", "invalid")


@query
def U1_U2_O4_findings(spark, d):
    line = B.table(spark, d, "lineitem")
    first = line.select(F.col("l_orderkey").alias("book_id"), F.col("l_returnflag").alias("format"), F.lit(None).cast("string").alias("path"), F.col("l_linestatus").alias("code"), (F.col("l_linenumber") + F.col("l_suppkey") * 100).alias("ordinal"), F.col("l_partkey").cast("string").alias("evidence"))
    more = B.table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("book_id"), F.lit("A").alias("format"), F.lit(None).cast("string").alias("path"), F.lit("F").alias("code"), F.lit(0).cast("long").alias("ordinal"), F.lit("order").alias("evidence"))
    return catalog.first_findings(first.unionByName(more), "ordinal").orderBy(*catalog.finding_order())


# scalar functions


@query
def X1_normalised_names(spark, d):
    text = F.concat(F.lit(" "), F.regexp_replace("p_name", " ", "  -  "), F.lit(" ( "), F.col("p_type"), F.lit(" ) ; "))
    return B.table(spark, d, "part").select("p_partkey", X.canonical(text).alias("canonical"), X.light(text).alias("light"))


@query
def X3_X7_G10_strong_identifiers(spark, d):
    rows = B.identifiers(spark, d)
    return rows.select("book_id", F.trim("type").alias("type"), I.canonical_type(F.col("type")).alias("kind"), I.strong(F.col("type"), F.col("value")).alias("strong"), I.isbn(F.col("value"), strict=False).alias("loose_isbn"))


@query
def G10_strong_identifier_counts(spark, d):
    return B.identifiers(spark, d).groupBy("book_id").agg(F.count(I.strong(F.col("type"), F.col("value"))).alias("strong"))


@query
def X8_language_signature(spark, d):
    return B.members(spark, d).select("book_id", X.signature(F.transform("languages", lambda v: F.upper(v))).alias("signature"))


@query
def X9_edition_signature(spark, d):
    k = F.col("p_partkey") % 6
    title = F.concat("p_name", F.when(k == 0, " Unabridged").when(k == 1, " (Second edition)").when(k == 2, ": 3rd Edition, revised").when(k == 3, " Anniversary Edition, illustrated").otherwise(""))
    return B.table(spark, d, "part").select("p_partkey", X.edition(title).alias("edition"))


@query
def X10_X11_group_ids(spark, d):
    part = B.table(spark, d, "part")
    return part.select("p_partkey", D.metadata_group_id(F.col("p_name"), F.array("p_brand", "p_type")).alias("metadata_id"), D.binary_group_id(F.col("p_size"), F.upper(F.sha2("p_name", 256))).alias("binary_id"))


@query
def X12_X14_F9_paths_and_clips(spark, d):
    path = F.concat(F.when(F.col("page_id") % 3 == 0, "a\\..\\").otherwise("a\\"), F.col("page_id").cast("string"))
    return B.table(spark, d, "pages").select("page_id", F.translate(path, "\\", "/").alias("path"), X.safe_path(path).alias("safe"), X.safe_path(F.col("url")).alias("url_safe"), F.sha2(F.substring(F.trim("html"), 1, 512), 256).alias("clip"))


@query
def X15_H2_framed_rows(spark, d):
    columns = [F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority"))]
    return B.table(spark, d, "orders").select("o_orderkey", F.sha2(D.framed(columns, D.field16), 256).alias("utf16"), F.sha2(D.framed(columns, D.field8), 256).alias("utf8"))


@query
def H5_unaffected_state(spark, d):
    rows = B.snapshot(spark, d, False).where("group_id % 10 <> 0")  # the others are what a plan touches
    line = D.framed([F.col("book_id").cast("string"), F.col("title"), F.col("publisher")], D.field8)
    return rows.groupBy("group_id").agg(D.fold(["book_id"], line).alias("digest"))


# filters and projections


@query
def F1_F4_epub_targets(spark, d):
    rows = B.candidates(spark, d).withColumn("format", F.when(F.col("score") % 2 == 0, F.lower("format")).otherwise(F.col("format")))
    return rows.where((F.upper("format") == "EPUB") & F.col("sha256").isNotNull()).select("group_id", "book_id", F.translate("path", "\\", "/").alias("path"))


@query
def F5_group_search(spark, d):
    asked = " ring "
    return B.books(spark, d).where(F.contains(F.upper("title"), F.upper(F.trim(F.lit(asked))))).select("book_id")


@query
def F6_F7_review_filters(spark, d):
    return B.table(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 5).alias("active"), F.count_if(~(F.col("value") > 5)).alias("deferred")).where("event_type <> 'view'")


@query
def F8_usable_values(spark, d):
    return B.members(spark, d).select("book_id", X.usable(F.col("title")).alias("usable"), X.usable(F.col("publisher")).alias("publisher_usable"))


@query
def F10_P10_candidate_split(spark, d):
    return B.candidates(spark, d).groupBy("group_id").agg(F.count_if(F.col("status") == "Present").alias("present"), F.count_if(F.col("status") != "Present").alias("unavailable"))


@query
def P5_P6_book_rows(spark, d):
    return B.files(spark, d).select("book_id", F.concat(F.format_number("size", 0), F.lit(" bytes")).alias("size_text"), F.concat("format", F.lit(" ("), "status", F.lit(")")).alias("file_text"))


@query
def P8_member_rows(spark, d):
    series = F.when(F.col("series").isNotNull(), F.concat("series", F.coalesce(F.concat(F.lit(" #"), F.col("series_index").cast("string")), F.lit(""))))
    return B.members(spark, d).select("book_id", F.coalesce(series, F.lit("")).alias("series_text"), F.array_join("languages", ", ").alias("language_text"))


# consensus and conflicts


@query
def G6_mode_consensus(spark, d):
    return conflicts.mode_consensus(B.members(spark, d), "publisher")


@query
def G7_G8_agreement(spark, d):
    rows = B.members(spark, d)
    a = conflicts.known_values_agree(rows, "publisher").withColumnRenamed("agrees", "p")
    b = conflicts.known_values_agree(rows, "series").withColumnRenamed("agrees", "s")
    return a.join(b, ["group_id", "book_id"]).select("group_id", "book_id", (F.col("p").cast("int") + F.col("s").cast("int")).alias("consistency"))


def _separated(spark, d):
    rows = B.members(spark, d)
    _, years = conflicts.year_conflicts(rows.withColumn("year", F.col("short_year")), gap=1)
    return rows, [conflicts.separate_known(rows.withColumn("edition", X.edition(F.col("title"))), "edition", "METADATA.EDITION_WORDING_CONFLICT"), years, conflicts.separate_disjoint(rows, "languages", "METADATA.LANGUAGE_CONFLICT"), conflicts.series_conflicts(rows)]


@query
def C1_language_conflicts(spark, d):
    return conflicts.separate_disjoint(B.members(spark, d), "languages", "METADATA.LANGUAGE_CONFLICT")


@query
def C2_series_conflicts(spark, d):
    return conflicts.series_conflicts(B.members(spark, d))


@query
def C3_J12_identifier_conflicts(spark, d):
    rows = B.identifiers(spark, d).withColumn("strong", I.strong(F.col("type"), F.col("value"))).where("strong LIKE 'OCLC:%'")
    sets = rows.select((F.col("book_id") % 200).alias("group_id"), "book_id", F.array(F.concat(F.lit("V"), (F.col("book_id") % 3).cast("string"))).alias("strong"))
    return conflicts.separate_disjoint(sets, "strong", "IDENTIFIER.STRONG_CONFLICT")


@query
def C3_strong_identifier_conflicts(spark, d):
    rows = B.identifiers(spark, d).withColumn("strong", I.strong(F.col("type"), F.col("value")))
    return recommend.identifier_conflicts(rows.groupBy((F.col("book_id") % 200).alias("group_id"), "book_id").agg(F.array_sort(F.collect_set("strong")).alias("strong")))


@query
def C4_C5_edition_conflicts(spark, d):
    rows = B.members(spark, d).withColumn("edition", X.edition(F.col("title")))
    return conflicts.separate_known(rows.withColumn("edition", F.coalesce("edition", F.when(F.col("book_id") % 4 == 0, "REVISED"))), "edition", "METADATA.EDITION_WORDING_CONFLICT")


@query
def C6_G9_year_conflicts(spark, d):
    warnings, separated = conflicts.year_conflicts(B.members(spark, d))
    apart = separated.groupBy("group_id").agg(F.count(F.lit(1)).alias("separated"))
    return warnings.join(apart, "group_id", "left").select("group_id", "severity", "gap", F.coalesce("separated", F.lit(0)).alias("separated"))


@query
def C7_cohorts(spark, d):
    rows = B.members(spark, d)
    return conflicts.cohort(rows, conflicts.separate_known(rows, "series", "METADATA.SERIES_CONFLICT").where("book_id % 2 = 0"))


@query
def C7_whole_cohorts(spark, d):
    rows = B.members(spark, d)
    editions = conflicts.separate_known(rows.withColumn("edition", X.edition(F.col("title"))), "edition", "METADATA.EDITION_WORDING_CONFLICT")
    languages = conflicts.separate_disjoint(rows, "languages", "METADATA.LANGUAGE_CONFLICT")
    return conflicts.cohort(rows, editions.unionByName(conflicts.year_conflicts(rows)[1]).unionByName(languages).unionByName(conflicts.series_conflicts(rows)))


def _vectors(spark, d):
    rows = B.members(spark, d).withColumn("strong", F.when(F.col("book_id") % 3 == 0, F.array(F.lit("ISBN:1"))).otherwise(F.array().cast("array<string>")))
    return recommend.metadata_vector(rows, rows.where("book_id % 8 = 0"))


@query
def C8_metadata_vector(spark, d):
    return _vectors(spark, d).select("group_id", "book_id", "core", "integrity", "completeness", "strong_ids")


@query
def C9_metadata_warnings(spark, d):
    return recommend.metadata_warnings(B.members(spark, d))


@query
def C10_U4_availability(spark, d):
    sets = B.candidates(spark, d).groupBy((F.col("group_id") % 3000).alias("group_id"), F.col("group_id").alias("book_id")).agg(F.collect_set("format").alias("formats"))
    return conflicts.availability(sets)


@query
def W1_W2_metadata_source(spark, d):
    order = [F.desc("core"), F.desc("integrity"), F.desc("completeness"), F.desc("strong_ids"), F.asc("book_id")]
    return conflicts.top_source(_vectors(spark, d), order, ["core", "integrity", "completeness", "strong_ids"])


@query
def W1_W2_G7_G8_whole_source(spark, d):
    text = lambda c: F.nullif(X.light(F.col(c)), F.lit(""))
    rows = B.members(spark, d).select("group_id", "book_id", text("publisher").alias("publisher"), X.signature(F.transform("languages", lambda v: F.upper(v))).alias("language"), "year", text("series").alias("series"))
    counts = conflicts.signal_counts(rows, ["publisher", "language", "year", "series"])
    return conflicts.metadata_source(_vectors(spark, d).join(counts, ["group_id", "book_id"]))


# recommendations


@query
def C11_C12_W3_format_selection(spark, d):
    return recommend.select_formats(B.candidates(spark, d))


@query
def C11_C12_W3_assessed_selection(spark, d):
    rows = B.candidates(spark, d)
    last = rows.groupBy("group_id").agg(F.max("book_id").alias("book_id"))  # a metadata source that is not the smallest record
    return recommend.select_formats(rows, findings=B.assessments(spark, d), sources=last)


def _sources(spark, d):
    return B.candidates(spark, d).groupBy("group_id").agg(F.min("book_id").alias("book_id"))


@query
def C13_G5_decisive_advantage(spark, d):
    rules = ["EPUB.NAVIGATION", "EPUB.CHAPTER.EMPTY", "EPUB.TEXT.SUBSTANTIAL"]
    c = B.candidates(spark, d).where("format = 'EPUB'")
    rows = c.select("book_id", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), ((F.col("score") * (i + 3)) % 11 - 5).alias("points")) for i, r in enumerate(rules)])).alias("r")).select("book_id", "r.*")
    best = c.groupBy("group_id").agg(F.min("book_id").alias("best"))
    return recommend.decisive_advantage(scoring.rule_sums(rows, ["book_id"]), c.join(best, "group_id").where("book_id <> best").select("best", F.col("book_id").alias("other")))


@query
def C14_redundant_records(spark, d):
    rows = B.candidates(spark, d)
    return recommend.redundant_records(rows, recommend.select_formats(rows), _sources(spark, d))


@query
def C15_confidence(spark, d):
    rows = B.candidates(spark, d)
    warnings = rows.where("score = 50").select("group_id", F.when(F.col("book_id") % 2 == 0, "ManualReview").otherwise("Advisory").alias("severity"))
    return recommend.confidence(recommend.select_formats(rows), rows.where("group_id % 13 = 0"), warnings)


@query
def C17_U3_overrides(spark, d):
    selections = recommend.select_formats(B.candidates(spark, d))
    k = F.col("group_id") % 5
    overrides = selections.where("group_id % 5 < 4").select("group_id", "format", F.when(k == 0, "SelectSource").when(k == 1, "MarkUnresolved").when(k == 2, "ExcludeFinalFormat").otherwise("SelectSource").alias("action"), (F.col("group_id") * 100 + 1).alias("source_id"), (k == 0).alias("wanted_is_member"))
    return recommend.apply_overrides(selections, overrides)


@query
def C18_reconcile(spark, d):
    now = B.table(spark, d, "customer").select(F.col("c_custkey").alias("group_id"), F.lit("1.0").alias("model"), (F.col("c_custkey") % 7).alias("input"))
    then = now.where("group_id % 3 <> 0").withColumn("input", F.col("group_id") % 5).withColumn("model", F.lit("1.0"))
    return recommend.reconcile(now, then)


# plans


def _plan(spark, d):
    files = B.candidates(spark, d)
    return files, cleanup.instructions(files, recommend.select_formats(files), _sources(spark, d).withColumnRenamed("book_id", "target_id"))


@query
def C19_eligibility(spark, d):
    files = B.candidates(spark, d)
    k = F.col("group_id") % 6
    groups = files.select("group_id").distinct().select("group_id", F.when(k == 0, "Unreviewed").when(k == 1, "Deferred").when(k == 2, "KeepSeparate").when(k == 3, "NotDuplicates").otherwise("Accepted").alias("review"), (F.col("group_id") % 7 != 0).alias("fresh"), (F.col("group_id") % 11 != 0).alias("target_is_member"), (F.col("group_id") % 13 == 0).alias("any_separated"))
    return cleanup.eligibility(groups, recommend.select_formats(files), files)


@query
def C20_C21_plan_instructions(spark, d):
    return _plan(spark, d)[1]


@query
def C22_U7_plan_coverage(spark, d):
    files, plan = _plan(spark, d)
    broken = plan.where("NOT (kind = 'FormatRemoval' AND book_id % 7 = 0)")
    planned = files.join(broken.select("group_id", "format").distinct(), ["group_id", "format"], "left_semi")  # C22_declared_coverage judges all files
    return cleanup.coverage_violations(planned, broken)


@query
def C22_declared_coverage(spark, d):
    files, plan = _plan(spark, d)
    return cleanup.coverage_violations(files, plan.where("NOT coalesce(format = 'MOBI' AND group_id % 5 = 0, false)"))


@query
def C23_required_issues(spark, d):
    files, plan = _plan(spark, d)
    return cleanup.required_issues(plan, files.select("group_id", (F.col("book_id") % 5 == 0).alias("has_cover")))


@query
def C24_J15_staleness(spark, d):
    diff = cleanup.state_diff(B.snapshot(spark, d, False), B.snapshot(spark, d, True))
    return cleanup.stale_plans(B.snapshot(spark, d, False).select("group_id").distinct(), diff)


@query
def J15_C29_state_diff(spark, d):
    return cleanup.state_diff(B.snapshot(spark, d, False), B.snapshot(spark, d, True))


@query
def C25_W7_plan_lifecycle(spark, d):
    states = F.array(*[F.lit(s) for s in ("Draft", "Valid", "Approved", "Stale")])
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = B.table(spark, d, "events").withColumn("revision", F.row_number().over(w))
    at = (F.col("revision") - 1) % 4
    rows = rows.select(F.col("user_id").alias("plan_id"), F.col("revision").cast("long").alias("revision"), F.get(states, at).alias("from_state"), F.when(F.col("event_type") == "error", "Revoked").otherwise(F.get(states, (at + 1) % 4)).alias("to_state"))
    return cleanup.illegal_transitions(rows, cleanup.PLAN_EDGES)


@query
def C26_operation_graph(spark, d):
    _, plan = _plan(spark, d)
    return cleanup.operation_graph(plan, _sources(spark, d))


@query
def C27_graph_violations(spark, d):
    _, plan = _plan(spark, d)
    graph = cleanup.operation_graph(plan, _sources(spark, d))
    return cleanup.graph_violations(graph.withColumn("ordinal", F.when(F.col("group_id") % 9 == 0, -F.col("ordinal")).otherwise(F.col("ordinal"))))


@query
def H3_plan_digest(spark, d):
    return cleanup.digests(_plan(spark, d)[1])


@query
def G13_latest_plan(spark, d):
    return cleanup.latest(B.table(spark, d, "orders").select(F.col("o_custkey").alias("plan_id"), F.col("o_orderkey").alias("revision"), F.col("o_orderstatus").alias("state")))


@query
def G12_backup_size(spark, d):
    return journal.backup_bytes(B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("group_id"), F.col("l_partkey").alias("size")))


@query
def G11_G17_G18_summary(spark, d):
    return B.candidates(spark, d).agg(F.count(F.lit(1)).alias("files"), F.count_distinct("group_id").alias("groups"), F.count_if(F.col("status") == "Missing").alias("missing"), F.bool_or(F.col("score") > 49).alias("any_top"), F.bool_and(F.col("score") > 0).alias("all_scored"))


# journals


@query
def W6_W8_journal_predecessors(spark, d):
    return journal.predecessors(B.journal(spark, d))


@query
def C32_journal_reconciliation(spark, d):
    seen = journal.predecessors(B.journal(spark, d)).withColumn("valid", ~F.col("after_terminal") | (F.col("execution_id") % 3 == 0))
    return journal.reconciled(seen, seen.select("execution_id").distinct().withColumn("matches", F.col("execution_id") % 2 == 0))


@query
def C28_execution_lifecycle(spark, d):
    names = F.array(*[F.lit(s) for s in ("Created", "AcquiringLease", "PreflightValidating", "ReadyForBackup", "BackingUp", "BackupVerified")])
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = B.table(spark, d, "events").withColumn("revision", F.row_number().over(w))
    at = (F.col("revision") - 1) % 6
    rows = rows.select(F.col("user_id").alias("execution_id"), F.col("revision").cast("long").alias("revision"), F.get(names, at).alias("from_state"), F.when(F.col("event_type") == "click", "Completed").otherwise(F.get(names, (at + 1) % 6)).alias("to_state"))
    return cleanup.illegal_transitions(rows, journal.EXECUTION_EDGES, "execution_id")


@query
def C31_C34_backup_gaps(spark, d):
    _, plan = _plan(spark, d)
    want = plan.where("kind = 'Backup'").select("group_id", "book_id", F.col("reason").alias("kind"), "format")
    return journal.backup_gaps(want, want.where("book_id % 10 <> 3"))


@query
def H7_journal_chain(spark, d):
    events = journal.predecessors(B.journal(spark, d)).select("execution_id", "sequence", "kind", F.col("event_id").cast("string").alias("payload"))
    lines = journal.chained(events)
    return journal.verified(lines).select("execution_id", "sequence", "previous_hash", "entry_hash", "kind", "valid")


@query
def W9_circular_neighbours(spark, d):
    return recommend.neighbours(B.table(spark, d, "nation").select("n_regionkey", "n_nationkey"), "n_regionkey", "n_nationkey")


# pages as chapters


@query
def E6_G14_readable_characters(spark, d):
    return pages.chapters(B.table(spark, d, "pages")).select("page_id", "host", "readable", (F.col("readable") < 100).alias("is_empty"))


@query
def E7_E8_references(spark, d):
    return pages.references(B.table(spark, d, "pages"))


@query
def E10_encryption(spark, d):
    return B.table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("a")).select("user_id", F.when(F.size("a") == 0, "None").when(F.forall("a", lambda x: x.isin("view", "signup", "error", "click")), "FontObfuscation").otherwise("Encrypted").alias("state"))


def _facts(spark, d):
    return pages.facts(B.table(spark, d, "pages"))


@query
def G4_W4_scores(spark, d):
    return scoring.score(scoring.findings(_facts(spark, d), ["host"]), ["host"])


@query
def O5_G15_finding_rows(spark, d):
    rows = scoring.findings(_facts(spark, d), ["host"])
    return rows.groupBy("host", "rule", "severity").agg(F.sum("points").alias("points"), F.count(F.lit(1)).alias("n"), F.min(scoring.severity_rank(F.col("severity"))).alias("rank"))


@query
def G16_repeated_references(spark, d):
    refs = pages.references(B.table(spark, d, "pages")).withColumn("place", F.concat(F.lpad(F.col("page_id").cast("string"), 12, "0"), F.lit("/"), F.lpad(F.col("position").cast("string"), 6, "0")))
    return scoring.occurrences(refs, ["host"], "kind", "target", "place")


# linkage, preflight, effects


@query
def J13_code_linkage(spark, d):
    said = recommend.select_formats(B.candidates(spark, d)).select("group_id", F.col("reason").alias("code"))
    return review.unlinked_codes(said, said.where("group_id % 3 <> 0 OR code <> 'EPUB.SCORES_TOO_CLOSE'"))


@query
def J14_U6_candidate_graph(spark, d):
    rows = B.candidates(spark, d).withColumn("path", F.translate("path", "\\", "/"))
    return review.graph_mismatch(rows.where("score <> 7"), rows.where("score <> 9"), ["book_id", "format", "path"])


@query
def J16_presentation_lookup(spark, d):
    books = B.books(spark, d).where("book_id % 6 <> 0").select("book_id", F.trim("title").alias("title"))
    return B.table(spark, d, "lineitem").groupBy((F.col("l_partkey") + 1).alias("book_id")).agg(F.count(F.lit(1)).alias("uses")).join(books, "book_id", "left")


@query
def C16_unsupported_shells(spark, d):
    rows = B.members(spark, d)
    counts = rows.groupBy("group_id").agg(F.count(F.lit(1)).alias("member_count"))
    return review.shells(counts, rows.where("book_id % 31 <> 0"))


@query
def C30_preflight(spark, d):
    k = F.col("c_custkey")
    rows = B.table(spark, d, "customer").select(k.alias("plan_id"), F.when(k % 2 == 0, "Approved").otherwise("Valid").alias("state"), (k % 5).cast("string").alias("approved_digest"), F.when(k % 7 != 0, (k % 5).cast("string")).alias("digest"), (k % 3 == 0).alias("stale"), (k % 4 - 2).alias("violations"), F.when(k % 11 == 0, 1).otherwise(0).alias("missing_sources"))
    return review.preflight(rows)


@query
def P12_execution_effects(spark, d):
    files, plan = _plan(spark, d)
    target = files.join(_sources(spark, d), ["group_id", "book_id"], "left_semi")
    return review.effects(plan, target)


@query
def P1_P13_expected_records(spark, d):
    formats = B.candidates(spark, d).groupBy("group_id").agg(F.count(F.lit(1)).alias("formats"), F.max("format").alias("last_format"))
    return B.snapshot(spark, d, False).select("book_id", "title", F.coalesce("publisher", F.lit("")).alias("publisher")).join(formats.withColumnRenamed("group_id", "book_id"), "book_id", "left").fillna(0, ["formats"])


@query
def P3_findings_of_issues(spark, d):
    missing = catalog.resolve_authors(B.author_links(spark, d), B.authors(spark, d)).where("code = 'AUTHOR_REFERENCE_MISSING'")
    _, blank = catalog.split_identifiers(B.identifiers(spark, d))
    return review.findings_of((missing, "AUTHOR_REFERENCE_MISSING"), (blank, "CATALOG_VALUE_INVALID")).groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"))


@query
def U10_U9_lineage(spark, d):
    states = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    rows = B.table(spark, d, "events").groupBy("user_id").agg(F.transform(states, lambda r: r["event_type"]).alias("now"))
    then = F.when(F.col("user_id") % 3 == 0, F.concat(F.slice("now", 1, 2), F.array(F.lit("other")))).otherwise(F.slice("now", 1, 3))
    return rows.select("user_id", review.is_prefix(then, F.col("now")).alias("continues"), (F.slice("now", 1, 3) == then).alias("same_start"))


@query
def H4_graph_digest(spark, d):
    _, plan = _plan(spark, d)
    return review.graph_digests(cleanup.operation_graph(plan, _sources(spark, d)))


# assessments as evidence


def _assessed(spark, d):
    return evidence.assessed(B.candidates(spark, d).where("format = 'EPUB'").drop("score"), B.assessment_headers(spark, d))


@query
def J8_candidate_assessments(spark, d):
    return _assessed(spark, d).drop("sha256", "assessed_sha256")


@query
def J11_assessment_evidence(spark, d):
    rows, k = B.assessment_headers(spark, d), F.col("book_id")
    wrong = rows.withColumn("format", F.when(k % 31 == 0, "PDF").otherwise(F.col("format"))).withColumn("path", F.when(k % 37 == 0, "gone/x").otherwise(F.col("path")))
    return evidence.inconsistent(B.candidates(spark, d), wrong.unionByName(wrong.where(k % 29 == 0)))


@query
def C12_assessment_currency(spark, d):
    return evidence.incomparable(_assessed(spark, d))


@query
def O9_decision_evidence(spark, d):
    # an order has too few files to omit any, so its neighbours' are one group with them
    wide = (F.col("group_id") / 64).cast("long")
    findings = B.assessments(spark, d).withColumn("explanation", F.concat(F.lit("adjusts by "), F.col("points").cast("string")))
    return evidence.decision_evidence(_assessed(spark, d).withColumn("group_id", wide), findings.withColumn("group_id", wide))


@query
def E12_absent_files(spark, d):
    k = F.col("l_linenumber") % 6
    status = F.when(k == 0, "Present").when(k == 1, "Missing").when(k == 2, "InvalidPath").when(k == 3, "Inaccessible").when(k == 4, "ChangedDuringHashing")
    rows = B.table(spark, d, "lineitem").select(status.alias("status"))
    return rows.groupBy("status", scoring.absent_problem(F.col("status")).alias("problem")).agg(F.count(F.lit(1)).alias("n"))


# orders


@query
def O3_metadata_group_order(spark, d):
    return orders.metadata_groups(duplicates.metadata_groups(_identities(spark, d))).select("group_id", "title_key", "ordinal")


@query
def O6_statement_order(spark, d):
    chosen = recommend.select_formats(B.candidates(spark, d))
    reasons = chosen.select("group_id", F.when(F.col("reason").startswith("EPUB."), "Assessment").otherwise("Format").alias("subject"), "format", F.col("source_id").alias("book_id"), F.col("reason").alias("code"), F.col("resolution").alias("explanation"))
    lines = B.candidates(spark, d).where("score > 40").select("group_id", F.lit("Record").alias("subject"), F.lit(None).cast("string").alias("format"), "book_id", F.lit("RECORD.LARGE").alias("code"), F.col("score").cast("string").alias("explanation"))
    return orders.statements(reasons.unionByName(lines.distinct()))


@query
def O7_issue_order(spark, d):
    files, plan = _plan(spark, d)
    notes = cleanup.required_issues(plan, files.select("group_id", (F.col("book_id") % 5 == 0).alias("has_cover")))
    notes = notes.select("group_id", "severity", F.lit(None).cast("long").alias("book_id"), F.lit(None).cast("string").alias("format"), "code", F.col("n").cast("string").alias("explanation"))
    missing = files.where("status = 'Missing'").select("group_id", F.lit("BlockingError").alias("severity"), "book_id", "format", F.lit("PLAN.SOURCE_FILE_UNAVAILABLE").alias("code"), F.lit("").alias("explanation")).distinct()
    return orders.issues(notes.unionByName(missing))


@query
def O10_backup_order(spark, d):
    plan = _plan(spark, d)[1].where("kind = 'Backup'").distinct()
    kind = F.when(F.col("reason") == "Format", "FormatFile").otherwise("RecordMetadataSnapshot")
    return orders.backups(plan.select("group_id", kind.alias("kind"), "book_id", "format", F.concat_ws(":", "reason", F.col("book_id").cast("string"), "format").alias("id")))


# warnings, overrides and backups


@query
def C9_invalid_identifiers(spark, d):
    return recommend.invalid_identifiers(B.identifiers(spark, d))


@query
def C10_without_formats(spark, d):
    records = B.table(spark, d, "part").select(F.col("p_size").cast("long").alias("group_id"), F.col("p_partkey").alias("book_id"))
    return conflicts.without_formats(records, B.table(spark, d, "orders").select(F.col("o_custkey").alias("book_id")))


@query
def C17_override_errors(spark, d):
    return overrides.override_errors(overrides.Review(**B.review(spark, d)))


@query
def C17_reviewed_recommendations(spark, d):
    return overrides.reviewed(overrides.Review(**B.review(spark, d)))


@query
def C31_confirmations(spark, d):
    entries = B.table(spark, d, "events").select(F.col("user_id").alias("group_id"), F.when(F.col("event_type") == "purchase", "LocalExecutionConfirmation").otherwise("ExportedFormat").alias("kind"))
    return journal.confirmation_faults(entries, entries)


@query
def C34_backup_files(spark, d):
    k, n = F.col("book_id"), F.col("l_linenumber")
    records = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("book_id"), (F.col("o_orderkey") % 2 == 0).alias("has_cover")).distinct()
    formats = B.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("book_id"), F.concat(F.lit("F"), F.col("l_linenumber").cast("string")).alias("format")).agg(F.min("l_partkey").cast("string").alias("sha256"))
    files = B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("book_id"), "l_linenumber", F.col("l_partkey").cast("string").alias("sha256")).where((k + n) % 19 != 0)
    none = F.lit(None).cast("string")
    stored = [
        files.select("book_id", F.concat(F.lit("book.f"), n.cast("string")).alias("name"), F.lit(False).alias("directory"), F.lit(1).alias("size"), F.when((k + n) % 23 == 0, "other").otherwise(F.col("sha256")).alias("sha256"), F.lit(True).alias("valid")),
        records.where(k % 17 != 0).select("book_id", F.lit("metadata.opf").alias("name"), F.lit(False).alias("directory"), F.lit(1).alias("size"), none.alias("sha256"), (k % 29 != 0).alias("valid")),
        records.where(k % 41 == 0).select("book_id", F.lit("second.OPF").alias("name"), F.lit(False).alias("directory"), F.lit(1).alias("size"), none.alias("sha256"), F.lit(True).alias("valid")),
        records.where((k % 2 == 0) & (k % 7 != 0) | (k % 13 == 0)).select("book_id", F.lit("Cover.jpg").alias("name"), F.lit(False).alias("directory"), (k % 31).cast("int").alias("size"), none.alias("sha256"), F.lit(True).alias("valid")),
        records.where(k % 43 == 0).select("book_id", F.lit("notes").alias("name"), (k % 2 == 0).alias("directory"), F.lit(1).alias("size"), none.alias("sha256"), F.lit(True).alias("valid")),
    ]
    return journal.classify_backup(records, formats, reduce(DataFrame.unionByName, stored))
