import base64
import gzip
import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bindery.llm import decontaminate, warc
from bindery.llm.decontaminate import benchmark_hits
from bindery.llm.queries import op1_warc, vocabulary

from . import cases
from .test_text_ops import components

ARC1 = (
    b"filedesc://old.arc 0.0.0.0 19970101000000 text/plain 76\n1 0 InternetArchive\nURL IP-address Archive-date Content-type Archive-length\n\n"
    b"http://a.example/x y 1.2.3.4 19970203040506 text/html 41\nHTTP/1.0 200 OK\r\nA: b\r\n\r\n<p>body\nhere</p>\n\n"
    b"dns:a.example 1.2.3.4 199702030405 text/dns 9\na 1.2.3.4\n\nhttp://a.example/raw 1.2.3.4 bad text/plain 3\nraw\n"
)
ARC2 = (
    b"filedesc://new.arc 0.0.0.0 20010101000000 text/plain 200 - - 0 new.arc 122\n2 0 reserved Alexa\n"
    b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n" + b" " * 3 + b"\n"
)


def arc2() -> bytes:
    about = ARC2.split(b"\n", 1)[1]
    head = ARC2.split(b"\n", 1)[0].rsplit(b" ", 1)[0] + b" %d\n" % len(about)
    return head + about + b"http://b.example/ 1.2.3.4 20010203040506 text/html 404 abc - 99 new.arc 27\nHTTP/1.0 404 No\r\n\r\nmissing!\n"


def test_arc_versions_become_warc(spark):
    rows = [("one.arc", bytearray(ARC1)), ("two.arc.gz", bytearray(gzip.compress(arc2()[: len(arc2()) // 2]) + gzip.compress(arc2()[len(arc2()) // 2 :]))), ("none.arc", None)]
    records = warc.read_arcs(spark.createDataFrame(rows, warc.ARCHIVES)).orderBy("archive", "position").collect()
    found = [(r.uri, r.date, r.record_type, r.content_type, bytes(r.payload)) for r in records]
    assert found == [
        ("http://a.example/x y", "1997-02-03T04:05:06Z", "response", "application/http; msgtype=response", b"<p>body\nhere</p>"),
        ("dns:a.example", "1997-02-03T04:05:00Z", "response", "text/dns", b"a 1.2.3.4"),
        ("http://a.example/raw", "1970-01-01T00:00:00Z", "resource", "text/plain", b"raw"),
        ("http://b.example/", "2001-02-03T04:05:06Z", "response", "application/http; msgtype=response", b"missing!"),
    ]
    assert all(r.payload_digest == base64.b32encode(hashlib.sha1(bytes(r.payload)).digest()).decode() for r in records)
    assert len({r.record_id for r in records}) == 4
    archives = warc.write_warcs(warc.mark_revisits(warc.read_arcs(spark.createDataFrame(rows, warc.ARCHIVES))))
    again = {r.record_id: r for r in warc.read_warcs(archives).collect()}
    assert {(r.record_id, bytes(r.payload), r.record_type) for r in records} == {(k, bytes(r.payload), r.record_type) for k, r in again.items()}


@pytest.mark.parametrize("broken", [ARC1[:200], b"no archive\n", ARC1.replace(b"text/html 41", b"text/html 4100")])
def test_broken_arc_is_an_error(broken):
    with pytest.raises(ValueError):
        list(warc.arc_records(broken))


def test_broken_warc_is_an_error():
    row = {"record_id": "urn:x", "record_type": "response", "uri": "u", "date": "d", "ip": "i", "content_type": "text/plain", "http_head": b"", "payload": b"abc", "payload_bytes": 3, "payload_digest": warc.digest(b"abc"), "key": None, "refers_to": None}
    good = warc.warc_record(row)
    assert list(warc._read("a", good))[0]["payload"] == b"abc"
    for bad in (good.replace(b"abc", b"abd"), good[:-8], b"x" + good):
        with pytest.raises(ValueError):
            list(warc._read("a", bad))


def test_revisits_of_pages(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, f"http://h/{i} ü", rng.choice(["same"] * 5 + ["", None, f"own {i} é", "x" * 100_000])) for i in range(300)] + [(400, None, "same"), (None, "u", "same"), (None, "u2", "no id\r\n\r\n")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    first = {}
    for i, _, html in rows:
        if i is not None:
            first.setdefault((html or "").encode(), i)
    expected = []
    for i, _, html in rows:
        body = (html or "").encode()
        kept = first.get(body, i)
        expected.append((str(i), len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if kept == i else "revisit", None if kept == i else kept))
    found = [(str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in op1_warc(spark, str(tmp_path)).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)
    assert warc.read_warcs(warc.write_warcs(warc.mark_revisits(warc.read_arcs(warc.write_arcs(spark.createDataFrame([], "page_id long, url string, html string")))))).collect() == []


def normal(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def leaks(docs, items, width=5, percent=80):
    """Brute force over every window of every document."""
    out = {}
    for item, text in items:
        w = normal(text)
        if not w:
            continue
        k = min(width, len(w))
        own = Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        for doc, t in docs:
            d = normal(t)
            parts = [tuple(d[i : i + k]) for i in range(len(d) - k + 1)]
            if not own.keys() & set(parts):
                continue
            last, best = max(0, len(d) - len(w)), 0
            for start in range(last + 1):
                window = Counter(parts[start : start + len(w) - k + 1])
                shared, either = sum((window & own).values()), sum((window | own).values())
                if 100 * shared >= percent * either:
                    best = max(best, shared / either)  # over all windows; the start is told of some only
                    if start == last or parts[start] in own:
                        out[doc, item] = max(out.get((doc, item), (0, 0)), (shared / either, -start))
            assert out.get((doc, item), (0, 0))[0] == best
    return out


def test_decontamination_against_brute_force(spark):
    rng = random.Random(5)
    items = [(i, " ".join(cases.words(50 + i, n, 200))) for i, n in enumerate([1, 2, 4, 5, 6, 14, 15, 20, 30, 60, 60])] + [(90, None), (91, ""), (92, "w1 w2"), (93, "w1 w2"), (None, " ".join(cases.words(7, 25, 200)))]
    docs = []
    for i in range(120):
        w, p = cases.words(1000 + i, rng.randint(0, 100), 200), (rng.choice(items)[1] or "").split()
        for _ in range(rng.randint(0, 4)):
            if p:
                at, how = rng.randrange(len(p)), rng.random()
                p[at : at + (how < 0.7)] = [] if how < 0.3 else ["edit"]
        at = rng.randint(0, len(w))
        docs.append((i, (" , " if i % 4 else " ").join(w[:at] + p + w[at:]).upper()))
    docs += [(500, None), (501, ""), (502, "w1"), (503, " ".join(["w1 w2 w3"] * 60)), (504, items[9][1]), (504, items[10][1])]
    found = benchmark_hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): (r.similarity, -r.start) for r in found} == leaks(docs, items)
    assert len(found) == len({(r.doc_id, r.item_id) for r in found}) > 20
    plan = benchmark_hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow(?!Eval)", re.sub("ArrowEvalPython", "Python", plan))


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_decontamination_finds_what_the_index_leaves(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", broadcast)
    # similarity 0.8 with a distance beyond the radius, or without an equal block
    far = [3037, 7859, 11449, 12586, 24564, 31114]
    items = [(i, " ".join(f"v{i}x{j}" for j in range(9))) for i in far] + [(97488, " ".join(f"v97488x{j}" for j in range(49)))]
    docs = [(i, t.rsplit(" ", 1)[0]) for i, t in items[:-1]] + [(97488, items[-1][1].rsplit(" ", 5)[0] + " zz97488 yy97488 xx97488 ww97488 uu97488")]
    found = benchmark_hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): (r.similarity, -r.start) for r in found} == leaks(docs, items) == {(i, i): (0.8, 0) for i, _ in items}
    assert any(r.distance > decontaminate.RADIUS for r in found)

    # other thresholds, items that share most of their text, and an index that finds next to nothing
    rng = random.Random(11)
    items = [(i, " ".join(cases.words(3, 20, 100) + cases.words(60 + i, n, 100))) for i, n in enumerate([5, 5, 10, 10, 30])] + [(i, " ".join(cases.words(80 + i, i, 40))) for i in (3, 8, 9, 9, 25)]
    docs = []
    for i in range(60):
        w = cases.words(2000 + i, rng.randint(0, 40), 100)
        p = rng.choice(items)[1].split()
        p[-1 - rng.randrange(len(p)) // 4] = f"edit{i}"
        at = rng.randint(0, len(w)) if i % 3 else 0
        docs.append((i, " ".join(w[:at] + p[: len(p) - rng.randint(0, 1)] + w[at:] * (i % 3 > 0))))
    for percent, radius in [(80, 0), (50, decontaminate.RADIUS)]:
        found = benchmark_hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), percent=percent, radius=radius).collect()
        expected = leaks(docs, items, percent=percent)
        assert {(r.doc_id, r.item_id): (r.similarity, -r.start) for r in found} == expected and len(expected) > 5


def test_decontamination_without_rows(spark):
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert benchmark_hits(cases.empty(spark), items).collect() == []
    assert benchmark_hits(cases.documents(spark), items.limit(0)).collect() == []
    hits = benchmark_hits(cases.documents(spark).withColumn("item_id", F.lit(3)), spark.createDataFrame([(1, " ".join(cases.words(2, 45)), 7)], "item_id long, text string, doc_id int")).collect()
    assert {r.doc_id for r in hits} == {4, 14, 17, None}


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(8)
    passage = " ".join(cases.words(77, 40, 300))
    shared = "This very line stands in many a document of the set"
    docs = [(i, (" ".join(x.upper() + "!!" for x in cases.words(i, 60)) if i % 10 == 0 else " ".join(cases.words(i, 90)) + (f"\n{shared}" if i % 7 == 1 else "")), "en", f"s{i % 3}", 1) for i in range(200)]
    docs += [(300 + i, docs[i + 1][1] + (" extra" if i % 2 else ""), "en", "s", 1) for i in range(8)]
    docs += [(400 + i, " ".join(cases.words(900 + i, 30)) + " " + passage + " " + " ".join(cases.words(950 + i, 30)), "en", "s", 1) for i in range(3)]
    docs += [(500, None, None, None, None), (501, "", "en", "s", 0)]
    folder = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 10 != 0), 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    now, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, folder)
        seen[name] = [r.asDict() for r in out.collect()]
        if name != "packing":
            assert out.columns == schema.replace(" long", "").replace(" string", "").split(", ")
            now = spark.createDataFrame([tuple(r.values()) for r in seen[name]], schema)
    kept = {k: {r["doc_id"]: r["text"] for r in v} for k, v in seen.items() if k != "packing"}
    assert not any(i in kept["quality"] for i in range(0, 200, 10)) and sum(i % 10 != 0 for i in kept["quality"] if i < 200) == 180
    holders = [i for i, t in kept["line_dedup"].items() if shared in (t or "").split("\n")]
    assert len(holders) == 1 and kept["line_dedup"].keys() == kept["quality"].keys()
    groups = components([(i, t) for i, t in kept["line_dedup"].items()], 5)
    assert set(kept["near_dedup"]) == {i for i, _, _, stays in groups if stays}
    assert set(kept["near_dedup"]) - set(kept["decontamination"]) == {400, 401, 402}
    assert {r["doc_id"] for r in seen["packing"]} == set(kept["decontamination"])
    total = corpus_pipeline.run(spark, folder).groupBy().sum("length").first()[0]
    assert total == sum(r["length"] for r in seen["packing"]) and vocabulary()
    del rng
