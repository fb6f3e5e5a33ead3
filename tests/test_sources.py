import json
import os
import sqlite3

import pytest

from bindery.sources import artifacts as A, library as L


def catalog(path, version=27, drop=None):
    c = sqlite3.connect(path)
    for name, columns in L.TABLES.items():
        if name != drop:
            c.execute(f"CREATE TABLE {name} ({columns.replace(' string', ' TEXT').replace(' long', ' INTEGER')})")
    c.execute(f"PRAGMA user_version = {version}")
    if not drop:
        c.execute("INSERT INTO library_id VALUES ('u')")
        c.executemany("INSERT INTO books VALUES (?, ?, 'S', 'p', '2020-01-01', '1.0', '1')", [(1, "One"), (2, "Twö")])
        c.executemany("INSERT INTO authors VALUES (?, ?, ?)", [(1, "Ann", "Ann"), (2, "Bob", "Bob")])
        c.executemany("INSERT INTO books_authors_link VALUES (?, ?, ?)", [(1, 1, 2), (2, 1, 1), (3, 2, 9)])
        c.execute("INSERT INTO publishers VALUES (4, 'House')")
        c.execute("INSERT INTO books_publishers_link VALUES (1, 1, 4)")
        c.executemany("INSERT INTO languages VALUES (?, ?)", [(1, "eng"), (2, "deu")])
        c.executemany("INSERT INTO books_languages_link VALUES (?, ?, ?, ?)", [(1, 1, 1, 1), (2, 1, 2, 0)])
    c.commit()
    c.close()


def test_catalogs(spark, tmp_path):
    catalog(tmp_path / "good.db")
    catalog(tmp_path / "old.db", version=26)
    catalog(tmp_path / "torn.db", drop="series")
    (tmp_path / "bytes.db").write_bytes(b"nothing")
    before = (tmp_path / "good.db").read_bytes()
    files = spark.read.format("binaryFile").load(str(tmp_path))
    found = {(os.path.basename(r.path), r.code, r.detail) for r in L.validate(files).collect()}
    assert found == {("old.db", "UnsupportedSchema", "version 26"), ("torn.db", "UnsupportedSchema", "series"), ("bytes.db", "NotSqliteDatabase", "")}
    rows = {r.book_id: r for r in L.books(files).collect()}
    assert (rows[1].title, rows[1].authors, rows[1].languages, rows[1].publisher, rows[1].series) == ("One", ["Bob", "Ann"], ["deu", "eng"], "House", None)
    assert rows[2].authors == [None] and rows[2].title == "Twö"
    assert (tmp_path / "good.db").read_bytes() == before


def test_library_location(tmp_path):
    assert [L.location_error(p) for p in (None, " ", str(tmp_path / "x"), str(tmp_path))] == ["EmptyPath", "EmptyPath", "FolderNotFound", "MetadataDatabaseNotFound"]
    (tmp_path / "metadata.db").mkdir()
    assert L.location_error(str(tmp_path)) == "MetadataDatabaseNotAFile"
    (tmp_path / "metadata.db").rmdir()
    (tmp_path / "metadata.db").write_bytes(b"")
    assert L.location_error(str(tmp_path)) is None


def test_hash_files(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "x.epub").write_bytes(b"abc")
    declared = spark.createDataFrame([(1, "a b/x.epub"), (2, "gone.pdf")], "book_id long, path string")
    found = {r.book_id: (r.status, r.size, r.sha256) for r in L.hash_files(spark, declared, str(tmp_path)).collect()}
    assert found == {1: ("Present", 3, "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"), 2: ("Missing", None, None)}


def review(**changes):
    group = {"group_id": "g", "members": [{"book_id": 1, "formats": [{"path": "a/b"}]}, {"book_id": 2, "formats": []}], "status": "Recommended", "selections": [{"format": "EPUB"}], "metadata_source": 1, "override": None}
    group |= changes.pop("group", {})
    return json.dumps({"schema": A.REVIEW_SCHEMA, "model": "1.0", "source": {"library_uuid": "u"}, "groups": [group]} | changes)


CASES = [
    (review(), None), (None, "MALFORMED_JSON"), ("{", "MALFORMED_JSON"), ('{"a": 1, "a": 2}', "MALFORMED_JSON"), ("[" * 70 + "]" * 70, "MALFORMED_JSON"), ("[" * 100_000, "MALFORMED_JSON"), (review(schema="x"), "UNSUPPORTED_SCHEMA_VERSION"), (review(model="2.0"), "UNSUPPORTED_MODEL_VERSION"),
    (review(source={}), "INVALID_SOURCE"), (review(groups={}), "INVALID_GROUPS"), (review(group={"group_id": " "}), "INVALID_GROUP_ID"), (review(group={"members": []}), "INVALID_MEMBERS"), (review(group={"members": [1, 2]}), "INVALID_MEMBER"),
    (review(group={"members": [{"book_id": 1, "formats": [{"path": "../x"}]}, {"book_id": 2, "formats": []}]}), "UNSAFE_RELATIVE_PATH"), (review(group={"status": "x"}), "INVALID_RECOMMENDATION"), (review(group={"selections": [1]}), "INVALID_FORMAT_SELECTION"), (review(group={"metadata_source": 3}), "INVALID_RECORD_SELECTION"), (review(group={"override": {"action": "x"}}), "INVALID_OVERRIDE"),
]


def test_review_artifacts(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "name int, text string")
    assert [r.code for r in A.inspect_reviews(rows).orderBy("name").collect()] == [c for _, c in CASES]
    assert {c for _, c in CASES} - {None} == set(A.REVIEW_CODES)


def test_export_is_canonical(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i}", None if i % 2 else "x") for i in range(40)], "group_id long, title string, note string")
    texts = []
    for k, df in enumerate((rows, rows.orderBy("title").repartition(7))):
        A.export(df, str(tmp_path / str(k)), A.REVIEW_SCHEMA)
        texts.append([r.value for r in spark.read.text(str(tmp_path / str(k))).collect()])
    assert sorted(texts[0]) == sorted(texts[1]) and texts[0] == sorted(texts[0], key=lambda v: json.loads(v)["group_id"])
    assert texts[0][1] == '{"schema":"recommendation-review/1.0","group_id":1,"title":"t1","note":null}'


def test_journals_and_histories(spark, tmp_path):
    (tmp_path / "j.txt").write_text('{"id": 1, "kind": "a"}\nnot json\n\n{"id": 2, "kind": "' + "x" * 1_000_001 + '"}\n')
    assert [(r.id, r.readable) for r in A.read_journal(spark, str(tmp_path / "j.txt"), "id long, kind string").collect()] == [(1, True), (None, False), (None, False)]
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "a.json").write_text('{"id": 1}')
    (tmp_path / "h" / "b.json").write_text('{"id": ')
    assert sorted((r.id or 0, r.recovery_required) for r in A.read_history(spark, str(tmp_path / "h"), "id long").collect()) == [(0, True), (1, False)]
    A.append_history(spark.range(2), str(tmp_path / "out"))
    A.append_history(spark.range(3), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_manifest_seal(spark):
    rows = [(1, f"p{i}", i, "s") for i in range(9)] + [(2, "q", 1, "s")]
    schema = "execution_id long, path string, size long, sha256 string"
    sealed = A.manifest_digest(spark.createDataFrame(rows, schema))
    assert A.seal_violations(sealed, spark.createDataFrame(rows[::-1], schema)).collect() == []
    assert [r.execution_id for r in A.seal_violations(sealed, spark.createDataFrame(rows[:-1] + [(2, "q", 2, "s")], schema)).collect()] == [2]
    assert [r.execution_id for r in A.seal_violations(sealed, spark.createDataFrame(rows[:-1], schema)).collect()] == [2]


@pytest.mark.parametrize("text", ["1", "null", '"x"'])
def test_artifacts_that_are_no_objects(text):
    assert A.review_failure(text) == "MALFORMED_JSON"


def test_plan_documents(spark):
    rows = [(1, "Retention", 7, "EPUB", "RetainInTarget"), (1, "RecordRemoval", 8, None, "NotTarget"), (2, "Backup", 9, "PDF", "Förmat")]
    plan = spark.createDataFrame(rows, "group_id long, kind string, book_id long, format string, reason string")
    states = spark.createDataFrame([(1, "Valid"), (2, "Approved"), (3, "Draft")], "group_id long, state string")
    first, second = (A.plan_documents(df, states).orderBy("group_id").collect() for df in (plan, plan.orderBy("reason").repartition(3)))
    assert [r.text for r in first] == [r.text for r in second] and len(first) == 2
    text = first[0].text
    resealed = lambda **c: json.dumps((d := json.loads(text) | c) | {"digest": A._body_digest(d)})
    invalid, unsupported = "CLEANUP_PLAN_JSON_INVALID", "UNSUPPORTED_CLEANUP_PLAN_SCHEMA"
    deep = {"kind": "x", "book_id": 1, "format": None, "reason": [[]]}
    cases = [
        (text, None), (first[1].text, None), (resealed(policy="2.0"), None), (text.replace("Valid", "Approved"), invalid), (resealed(state="x"), invalid), (resealed(extra=1), invalid), (resealed(schema="x"), unsupported), (resealed(schema=None), "CLEANUP_PLAN_SCHEMA_REQUIRED"),
        (resealed(schema=1), invalid), (resealed(issues=[""] * 10_001), invalid), (resealed(instructions=[deep]), invalid), (resealed(instructions=[1]), invalid), (resealed(group_id=True), invalid), (None, invalid), ("[]", invalid), ("{", invalid), ('{"schema": "a", "schema": "b"}', invalid), ("[" * 70 + "]" * 70, invalid),
    ]
    found = A.read_plans(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "name int, text string")).orderBy("name").collect()
    assert [r.code for r in found] == [c for _, c in cases]
    assert [(r.group_id, r.state) for r in found[:4]] == [(1, "Valid"), (2, "Approved"), (1, "Blocked"), (None, None)]
    assert [tuple(i) for i in found[0].instructions] == [("RecordRemoval", 8, None, "NotTarget"), ("Retention", 7, "EPUB", "RetainInTarget")]
    assert A.read_plans(spark.createDataFrame([], "name int, text string")).collect() == []


def test_journals_grow(spark, tmp_path):
    from bindery.streaming import journal as J

    at = str(tmp_path / "journals")
    event = lambda *rows: spark.createDataFrame(list(rows), "execution_id long, sequence long, kind string, payload string")
    J.append(event((1, 5, "Created", "a"), (1, 9, "MutationStarted", "b"), (2, 1, "Created", "")), at)
    J.append(event((1, 1, "TerminalSummary", "c"), (3, 1, "Created", "d")), at)
    J.append(event(), at)
    lines = J.verified(spark.read.schema(J.LINE).json(at)).orderBy("execution_id", "sequence").collect()
    assert [(r.execution_id, r.sequence, r.kind, r.valid) for r in lines] == [(1, 1, "Created", True), (1, 2, "MutationStarted", True), (1, 3, "TerminalSummary", True), (2, 1, "Created", True), (3, 1, "Created", True)]
    J.append(event((1, 1, "Late", "e")), at)
    assert [r.valid for r in J.verified(spark.read.schema(J.LINE).json(at)).orderBy("execution_id", "sequence").collect()] == [True, True, True, False, True, True]
