import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from bindery.operators import catalog, conflicts, duplicates, recommend, scoring
from bindery.plans import cleanup
from bindery.sources import epub
from bindery.streaming import journal

FACTS = "book_id long, problems array<string>, missing_spine array<string>, broken_refs array<string>, empty_chapters array<string>, repeated_refs array<string>, title string, date string, strong_identifier string, authors array<string>, languages array<string>, cover boolean, navigation boolean, cover_width int, cover_height int, spine int, chars int"


def facts(**changes):
    base = dict(book_id=1, problems=[], missing_spine=[], broken_refs=[], empty_chapters=[], repeated_refs=[], title="T", date="2020-01-01", strong_identifier="9780306406157", authors=["A"], languages=["en"], cover=True, navigation=True, cover_width=600, cover_height=800, spine=1, chars=6000)
    return tuple((base | changes).values())


def scored(spark, *rows, kept=100):
    df = spark.createDataFrame(list(rows), FACTS)
    found = scoring.findings(df, ["book_id"], kept)
    return {r.book_id: r for r in scoring.score(found, ["book_id"]).collect()}, found


def test_healthy_scores_100(spark):
    assert scored(spark, facts())[0][1].score == 100


def test_capped_penalties(spark):
    worst = facts(missing_spine=list("abcdef"), broken_refs=list("abcdefg"), empty_chapters=list("abcdefg"), repeated_refs=list("abcde"), title=None, authors=[], languages=None, date="bad", strong_identifier=None, cover=False, navigation=False, chars=100)
    score, found = scored(spark, worst)
    assert score[1].score == 0
    sums = {r.rule: r.points for r in scoring.rule_sums(found, ["book_id"], decisive=False).collect()}
    assert [sums[r[0]] for r in scoring.LISTED] == [-20, -10, -10, -12]


def test_omitted_faults_cost_too(spark):
    _, found = scored(spark, facts(missing_spine=[f"s{i}" for i in range(10)]), kept=1)
    rows = found.where("rule = 'EPUB.SPINE.RESOURCE_EXISTS'").orderBy("evidence").collect()
    assert [(r.evidence, r.points) for r in rows] == [("omitted:9", -15), ("s0", -5)]


def test_cover_header_and_problems(spark):
    score, found = scored(spark, facts(cover_width=0, cover_height=0), facts(book_id=2, problems=["Encrypted", "CannotOpen", "Odd"]), facts(book_id=3, problems=None))
    assert found.where("book_id = 1 AND rule = 'EPUB.COVER.DIMENSIONS'").first().points == -2
    assert (score[2].status, score[2].score) == ("Disqualified", None)
    assert {r.rule for r in found.where("book_id = 2 AND severity = 'Disqualifying'").collect()} == {"EPUB.ENCRYPTION", "EPUB.OPEN", "EPUB.UNSUPPORTED"}
    assert score[3].score == 100


def test_binary_groups_do_not_depend_on_order(spark):
    rows = [(1, "PDF", "a", 3, "x"), (1, "EPUB", "b", 3, "x"), (2, "PDF", "c", 3, "y"), (3, "PDF", "d", 4, "x"), (4, "PDF", "e", 3, None), (5, "PDF", "f", None, "x"), (6, "PDF", "g", 9, "z"), (7, "PDF", "h", 9, "z"), (7, "PDF", "h", 9, "z")]
    out = []
    for r in (rows, rows[::-1]):
        files = spark.createDataFrame(r, "book_id long, format string, path string, size long, sha256 string")
        groups = duplicates.binary_groups(files)
        members = duplicates.binary_members(files, groups)
        out.append((sorted((g.group_id, g.member_count, g.spans_records) for g in groups.collect()), sorted((m.group_id, m.book_id, m.path) for m in members.collect())))
    assert out[0] == out[1] == ([("sha256:x:3", 2, False), ("sha256:z:9", 2, True)], [("sha256:x:3", 1, "a"), ("sha256:x:3", 1, "b"), ("sha256:z:9", 6, "g"), ("sha256:z:9", 7, "h")])


def test_metadata_groups(spark):
    books = spark.createDataFrame([(1, "The Book : A Tale"), (2, "the  book:a tale"), (3, "The Book: A Tale"), (4, "Alone"), (5, None), (6, "The Book:A Tale")], "book_id long, title string")
    authors = spark.createDataFrame([(1, "Alice Smith"), (1, "Bob Jones"), (2, "Bob Jones"), (2, "alice  smith"), (3, "Alice Smith"), (4, "X"), (5, "X"), (6, "Alice Smith"), (6, "Bob Jones")], "book_id long, name string")
    identity = duplicates.identities(books, authors, spark.createDataFrame([(6,)], "book_id long"))
    groups = duplicates.metadata_groups(identity)
    assert sorted(r.book_id for r in duplicates.metadata_members(identity, groups).collect()) == [1, 2] and groups.count() == 1


def test_scale_of_metadata_groups(spark):
    n = 50_000
    base = spark.range(n).select(((F.col("id") * 7919) % n + 1).alias("book_id")).withColumn("k", ((F.col("book_id") - 1) / 2).cast("long"))
    names = F.when(F.col("book_id") % 2 == 0, F.array(F.lit("A One"), F.lit("B Two"))).otherwise(F.array(F.lit("b two"), F.lit("a  one")))
    books = base.select("book_id", F.format_string("Book %05d", "k").alias("title"))
    found = duplicates.metadata_groups(duplicates.identities(books, base.select("book_id", F.explode(names).alias("name"))))
    assert (found.count(), found.where("member_count = 2").count()) == (25_000, 25_000)


GROUP = "group_id long, book_id long, v string"


@pytest.mark.parametrize(
    ("values", "gone"),
    [(["Outlier", "C", "C"], {1}), (["A", "B", None], {1, 2, 3}), (["A", "A", "B", "B"], {1, 2, 3, 4}), (["A", "A", None, "B"], {4}), (["A", None], set()), ([None, None], set())],
)
def test_separate_known(spark, values, gone):
    rows = spark.createDataFrame([(1, i + 1, v) for i, v in enumerate(values)], GROUP)
    assert {r.book_id for r in conflicts.separate_known(rows, "v", "X").collect()} == gone


@pytest.mark.parametrize(
    ("sets", "gone"),
    [([["e"], ["e"], ["f"]], {3}), ([["e"], ["f"], []], {1, 2, 3}), ([["e", "d"], ["e"]], set()), ([["e"], ["e"], ["f"], ["f"]], {1, 2, 3, 4}), ([["e"], ["e"], ["e", "f"], ["f"], []], {4}), ([[], []], set())],
)
def test_separate_disjoint(spark, sets, gone):
    rows = spark.createDataFrame([(1, i + 1, s) for i, s in enumerate(sets)], "group_id long, book_id long, s array<string>")
    assert {r.book_id for r in conflicts.separate_disjoint(rows, "s", "X").collect()} == gone


@pytest.mark.parametrize(("values", "consensus"), [(["A", "A", "B"], "A"), (["A", "A", "B", "B"], None), (["A", "B"], None), ([None], None), (["A", "A", "A", "B", "B"], "A")])
def test_mode_consensus(spark, values, consensus):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], GROUP)
    assert [r.consensus for r in conflicts.mode_consensus(rows, "v").collect()] == [consensus]


@pytest.mark.parametrize(("years", "severity", "gone"), [([2020, 2021], "Advisory", set()), ([2020, 2022], "ManualReview", {1, 2}), ([2020, 2020, 2022], "ManualReview", {3}), ([2020, None], None, set())])
def test_years(spark, years, severity, gone):
    rows = spark.createDataFrame([(1, i + 1, y) for i, y in enumerate(years)], "group_id long, book_id long, year int")
    warnings, separated = conflicts.year_conflicts(rows)
    assert [w.severity for w in warnings.collect()] == ([severity] if severity else [])
    assert {r.book_id for r in separated.collect()} == gone


CANDIDATES = "group_id long, format string, book_id long, path string, score int, sha256 string, status string"


@pytest.mark.parametrize(
    ("rows", "resolution", "reason", "source"),
    [
        ([(1, "PDF", 1, "a", 0, "x", "Present"), (1, "PDF", 2, "b", 0, "y", "Present")], "UnresolvedConflict", "FORMAT.UNASSESSED_NONIDENTICAL_CONFLICT", None),
        ([(1, "PDF", 2, "a", 0, "x", "Present"), (1, "PDF", 1, "b", 0, "x", "Present")], "Selected", "FORMAT.EXACT_BINARY_EQUIVALENT", 1),
        ([(1, "PDF", 1, "a", 0, "x", "Missing"), (1, "PDF", 2, "b\\c", 0, "x", "Present")], "Selected", "FORMAT.ONLY_AVAILABLE_SOURCE", 2),
        ([(1, "PDF", 1, "a", 0, None, "Missing")], "Unavailable", "FORMAT.NO_AVAILABLE_SOURCE", None),
        ([(1, "EPUB", 1, "a", 70, "x", "Present"), (1, "EPUB", 2, "b", 80, "y", "Present")], "Selected", "EPUB.MATERIAL_QUALITY_ADVANTAGE", 2),
        ([(1, "EPUB", 1, "a", 71, "x", "Present"), (1, "EPUB", 2, "b", 80, "y", "Present")], "UnresolvedConflict", "EPUB.SCORES_TOO_CLOSE", None),
    ],
)
def test_format_ladder(spark, rows, resolution, reason, source):
    r = recommend.select_formats(spark.createDataFrame(rows, CANDIDATES)).first()
    assert (r.resolution, r.reason, r.source_id) == (resolution, reason, source)


def test_redundant_record(spark):
    rows = spark.createDataFrame([(1, "AZW3", 1, "a", 0, "x", "Present"), (1, "AZW3", 2, "b", 0, "x", "Present"), (1, "PDF", 3, "c", 0, "y", "Present")], CANDIDATES)
    out = recommend.redundant_records(rows, recommend.select_formats(rows), spark.createDataFrame([(1, 1)], "group_id long, book_id long")).collect()
    assert [r.book_id for r in out] == [2]


def test_paths(spark):
    rows = [("a/b", "Doc", "EPUB"), ("", "d", "x"), ("/a", "d", "x"), ("a//b", "d", "x"), ("a\\b", "d", "x"), ("a/.", "d", "x"), ("a", "con", "x"), ("a", "d ", "x"), ("a", "d", "t-x"), (None, "d", "x"), ("a", "d:e", "x")]
    out = catalog.resolve_paths(spark.createDataFrame(rows, "directory string, stem string, format string")).collect()
    assert [r.path for r in out] == ["a/b/Doc.epub", None, None, None, "a/b/d.x", None, None, None, None, None, None]


def test_plan_covers_a_thousand_formats(spark):
    files = spark.range(1000).select(F.lit(1).cast("long").alias("group_id"), F.concat(F.lit("F"), F.col("id").cast("string")).alias("format"), F.lit(1).cast("long").alias("book_id"), F.lit("p").alias("path"), F.lit(0).alias("score"), F.lit("x").alias("sha256"), F.lit("Present").alias("status"))
    plan = cleanup.instructions(files, recommend.select_formats(files), spark.createDataFrame([(1, 1)], "group_id long, target_id long")).cache()
    assert plan.where("kind = 'Retention'").count() == 1000 and cleanup.coverage_violations(files, plan).count() == 0
    again = cleanup.instructions(files.repartition(5), recommend.select_formats(files), spark.createDataFrame([(1, 1)], "group_id long, target_id long"))
    assert cleanup.digests(plan).first().digest == cleanup.digests(again).first().digest
    assert cleanup.coverage_violations(files, plan.where("format <> 'F7'").unionByName(plan.where("kind = 'Backup'"))).count() == 1


def test_lifecycles(spark):
    rows = [(1, 1, "Draft", "Valid"), (1, 2, "Valid", "Approved"), (1, 3, "Approved", "Revoked"), (2, 1, "Draft", "Approved"), (3, 1, "Draft", "Valid"), (3, 3, "Valid", "Stale"), (4, 1, "Draft", "Valid"), (4, 2, "Draft", "Blocked")]
    out = cleanup.illegal_transitions(spark.createDataFrame(rows, "plan_id long, revision long, from_state string, to_state string"), cleanup.PLAN_EDGES).collect()
    assert sorted((r.plan_id, r.revision) for r in out) == [(2, 1), (3, 3), (4, 2)]


def test_journal_chain_and_tampering(spark, tmp_path):
    events = [(e, s + 1, k, f"p{s}") for e in (1, 2, 3) for s, k in enumerate(["Started", "MutationStarted", "TerminalSummary"])]
    lines = journal.chained(spark.createDataFrame(events, "execution_id long, sequence long, kind string, payload string")).cache()
    assert journal.verified(lines).where("NOT valid").count() == 0
    bad = lines.withColumn("payload", F.when((F.col("execution_id") == 2) & (F.col("sequence") == 2), "changed").otherwise(F.col("payload")))
    assert [(r.execution_id, r.sequence) for r in journal.verified(bad).where("NOT valid").collect()] == [(2, 2)]
    short = journal.verified(bad.where("NOT (execution_id = 3 AND sequence = 3)"))
    out = journal.reconciled(short, spark.createDataFrame([(1, True), (2, True), (3, True)], "execution_id long, matches boolean"))
    assert {r.execution_id: r.recovery_required for r in out.collect()} == {1: False, 2: True, 3: True}
    bad.write.json(str(tmp_path / "j"))
    seen = []
    journal.watch(spark, str(tmp_path / "j"), lambda df: seen.extend(df.collect()), str(tmp_path / "c")).awaitTermination(60)
    assert {(r.execution_id, r.sequence) for r in seen} == {(2, 2)}


def test_backup_size_does_not_overflow(spark):
    rows = spark.createDataFrame([(1, 10), (2, 2**62), (2, 2**62)], "group_id long, size long")
    assert {r.group_id: r.needed for r in journal.backup_bytes(rows).collect()} == {1: 30 + (64 << 20), 2: 2**63 - 1}


PNG = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 800, 600) + b"\0" * 5


def archive(opf=None, chapter=None, extra=(), drop=()):
    opf = opf or '<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title> T </dc:title><dc:creator>A</dc:creator><dc:language>en</dc:language><dc:date>2020-01-01</dc:date><dc:identifier>urn:isbn:9780306406157</dc:identifier></metadata><manifest><item id="c" href="chapter.xhtml"/><item id="n" href="nav.xhtml" properties="nav"/><item id="i" href="cover.png" properties="cover-image"/></manifest><spine><itemref idref="c"/></spine></package>'
    files = {"mimetype": "application/epub+zip", "META-INF/container.xml": '<container><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>', "OEBPS/content.opf": opf, "OEBPS/nav.xhtml": "<nav/>", "OEBPS/chapter.xhtml": chapter or f"<html><body><p>{'a' * 6000}</p></body></html>", "OEBPS/cover.png": PNG} | dict(extra)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in files.items():
            if name not in drop:
                z.writestr(name, content)
    return out.getvalue()


def test_epub_inspection_scores_100(spark):
    files = spark.createDataFrame([(1, bytearray(archive())), (2, bytearray(b"no zip")), (3, None)], "book_id long, content binary")
    found = epub.inspect(files, key="book_id")
    first = found.where("book_id = 1").first()
    assert (first.chars, first.cover_width, first.cover_height, first.title, first.spine) == (6000, 800, 600, "T", 1)
    scores = {r.book_id: (r.status, r.score) for r in scoring.score(scoring.findings(found, ["book_id"]), ["book_id"]).collect()}
    assert scores == {1: ("Completed", 100), 2: ("Disqualified", None), 3: ("Disqualified", None)}
    assert epub.entries(files, key="book_id").count() == 6
    (kept,) = epub.summary(found.where("size(problems) = 0").limit(1), key="book_id").collect()
    assert (kept.opened, kept.parsed, kept.spine_items, kept.broken_references, kept.empty_chapters, kept.cover) == (True, True, 1, 0, 0, True)
    wide = found.limit(1).withColumn("authors", F.array_repeat(F.repeat(F.lit("x"), 600), 200)).withColumn("problems", F.array(F.lit("UnsafeArchive")))
    (kept,) = epub.summary(wide, key="book_id").collect()
    assert (kept.opened, kept.parsed, len(kept.authors), {len(a) for a in kept.authors}) == (False, False, 100, {512})


@pytest.mark.parametrize(
    ("data", "problem"),
    [(archive(drop=["META-INF/container.xml"]), "PackageMalformed"), (archive(opf="<package"), "PackageMalformed"), (archive(extra={"../x": "y"}), "UnsafeArchive"), (archive(extra={"MIMETYPE": "y"}), "UnsafeArchive"), (archive(extra={"big": b"\0" * (40 << 20)}), "LimitExceeded"), (archive(extra={"META-INF/encryption.xml": '<e><EncryptionMethod Algorithm="aes"/></e>'}), "Encrypted"), (archive()[:-30], "CannotOpen")],
)
def test_epub_problems(data, problem):
    assert epub.inspect_archive(data)["problems"] == [problem]


def test_epub_references():
    page = '<p>short</p><script>no letters</script><img src="gone.png"/><a href="http://H.example/x">y</a><a href="#top">z</a><a href="nav.xhtml?q#f">n</a><a href="../../up">u</a>'
    found = epub.inspect_archive(archive(chapter=page, extra={"META-INF/encryption.xml": '<e><EncryptionMethod Algorithm="http://www.idpf.org/2008/embedding"/></e>'}))
    assert found["encryption"] == "FontObfuscation" and found["remote_refs"] == ["scheme:http;host:h.example"] and found["empty_chapters"] == ["OEBPS/chapter.xhtml"]
    assert found["broken_refs"] == ["OEBPS/chapter.xhtml>../../up", "OEBPS/chapter.xhtml>gone.png"] and found["chars"] == len("shortyznu")


@pytest.mark.parametrize(
    ("data", "size"),
    [(PNG, (800, 600)), (b"GIF89a" + struct.pack("<HH", 3, 4), (3, 4)), (b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + b"\x09\0\0\x13\0\0", (10, 20)), (b"\xff\xd8\xff\xe0\0\4ab\xff\xc0\0\x0b\x08\0\x05\0\x06" + b"\0" * 4, (6, 5)), (b'<svg width="7" height="8">', (7, 8)), (b"", None), (b"\xff\xd8\xff", None), (b"BM", None)],
)
def test_image_size(data, size):
    assert epub.image_size(data) == size


def test_empty_tables(spark):
    none = spark.createDataFrame([], CANDIDATES)
    assert recommend.select_formats(none).collect() == []
    assert duplicates.binary_groups(spark.createDataFrame([], "book_id long, format string, path string, size long, sha256 string")).collect() == []
    assert conflicts.separate_known(spark.createDataFrame([], GROUP), "v", "X").collect() == []
