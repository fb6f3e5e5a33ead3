"""The classifiers' inner parts against plain loops, and the queries that SQL does not express on small tables."""

import hashlib
import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bindery.llm import media, toxicity
from bindery.llm._boost import fit
from bindery.llm.queries import QUERIES, vocabulary

from . import cases
from .test_text_ops import labelled, order


def table(n=400, width=5, seed=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, width)), 1)
    y = (x[:, 2] + 0.5 * x[:, 0] + rng.normal(scale=0.3, size=n) > 0.2).astype(float)
    return x, y


def test_flat_trees_score_as_a_walk_of_each_row():
    x, y = table()
    model = fit(x, y, trees=12, depth=3)
    fresh = table(seed=4)[0]

    def walk(row, at):
        while model.feature[at] >= 0:
            at = model.left[at] + (row[model.feature[at]] > model.threshold[at])
        return model.value[at]

    expected = [1 / (1 + math.exp(-(model.base + sum(walk(r, root) for root in model.roots)))) for r in fresh]
    assert np.allclose(model.score(fresh), expected, rtol=1e-12)
    assert len(model.roots) == 12 and model.score(fresh[:0]).shape == (0,)


def test_first_split_is_the_best_of_all():
    x, y = table()
    ridge, least, rate = 1.0, 8, 0.15
    model = fit(x, y, trees=1, depth=1, rate=rate, bins=64, ridge=ridge, least=least)
    p = (y.sum() + 0.5) / (len(y) + 1)
    grad, hess = y - p, np.full(len(y), p * (1 - p))

    def gain(left):
        if min(left.sum(), (~left).sum()) < least:
            return -1.0
        parts = [grad[s].sum() ** 2 / (hess[s].sum() + ridge) for s in (left, ~left)]
        return sum(parts) - grad.sum() ** 2 / (hess.sum() + ridge)

    cuts = [(f, c) for f in range(x.shape[1]) for c in np.unique(np.quantile(x[:, f], np.linspace(0, 1, 65)[1:-1]))]
    best = max(gain(x[:, f] <= c) for f, c in cuts)
    f, c = int(model.feature[0]), model.threshold[0]
    assert math.isclose(gain(x[:, f] <= c), best, rel_tol=1e-9)
    for side, at in ((x[:, f] <= c, model.left[0]), (x[:, f] > c, model.left[0] + 1)):
        assert math.isclose(model.value[at], rate * grad[side].sum() / (hess[side].sum() + ridge), rel_tol=1e-9)


def test_one_class_or_no_rows_give_a_constant():
    x, _ = table()
    for y in (np.zeros(len(x)), np.ones(len(x))):
        assert len(set(fit(x, y).score(x))) == 1
    assert fit(x[:0], np.zeros(0)).score(x)[0] == 0.5


def test_ftrl_against_a_loop_over_coordinates():
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 60).astype(float)
    rows = [np.unique(np.append(rng.integers(0, 30, 8), 100 + int(t))) for t in y]
    alpha, beta, l1, l2, passes = 0.7, 1.0, 0.8, 0.5, 3
    got, got_bias = toxicity.ftrl(rows, y, passes, alpha, beta, l1, l2)

    z, n, zb, nb = {}, {}, 0.0, 0.0

    def weight(i):
        v = z.get(i, 0.0)
        return 0.0 if abs(v) <= l1 else -(v - math.copysign(l1, v)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)

    turns = np.random.Generator(np.random.PCG64(7))
    for _ in range(passes):
        for r in turns.permutation(len(rows)):
            bias = -zb * alpha / (beta + math.sqrt(nb))
            held = {i: weight(i) for i in rows[r]}
            g = 1 / (1 + math.exp(-(sum(held.values()) + bias))) - y[r]
            for i, w in held.items():
                before = n.get(i, 0.0)
                n[i] = before + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(before)) / alpha * w
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / alpha * bias
            nb += g * g
    expected = np.array([weight(i) for i in range(len(got))])
    assert np.allclose(got, expected, atol=1e-9) and math.isclose(got_bias, -zb * alpha / (beta + math.sqrt(nb)), abs_tol=1e-9)
    assert got[100] < 0 < got[101] and 0 < np.count_nonzero(got) < 33


@pytest.mark.parametrize("model", ["quality", "toxicity"])
def test_rows_of_one_labelled_id_are_learnt_once(spark, model):
    """A third of all rows under one id changes nothing: they are equal, so the model is that of distinct rows."""
    from bindery.llm import quality, toxicity

    module, label = (quality, "quality") if model == "quality" else (toxicity, "toxic")
    rows = [(i, " ".join(cases.words(i, 30)) + (" zap" * (i % 2))) for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], f"doc_id long, {label} int")
    docs, texts = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, t) for i, t in rows[:10]], "i long, text string")
    many = docs.unionByName(docs.where("doc_id = 7").crossJoin(spark.range(60)).drop("id"))
    one, other = ([r.score for r in module.score(texts, module.train(d, labels)).orderBy("i").collect()] for d in (docs, many))
    assert one == other


def test_toxic_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = labelled(spark, True)
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = [sorted(toxicity.score(docs, toxicity.train(docs, x)).select("doc_id", "score").collect()) for x in (labels, flipped)]
    assert scores[0] == scores[1]


@pytest.mark.parametrize(("name", "label", "least"), [("op3_quality", "quality", 0.3), ("op4_toxicity", "toxic", 0.5)])
def test_classifier_queries(spark, tmp_path, name, label, least):
    docs, labels = labelled(spark, label == "toxic")
    odd = spark.createDataFrame([(1000, None), (1001, ""), (1002, "x" * 200_000), (7, "a second text of seven"), (None, "no id")], "doc_id long, text string")
    docs.unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    found = QUERIES[name](spark, str(tmp_path)).collect()
    truth = {r.doc_id: r[label] for r in labels.collect()}
    assert len(found) == 405 and sum(r.doc_id == 7 for r in found) == 2
    for r in found:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= least)
    unseen = [r for r in found if r.held_out and r.doc_id in truth and r.doc_id != 7]
    assert len(unseen) > 40 and sum(r.predicted == truth[r.doc_id] for r in unseen) >= 0.97 * len(unseen)


def test_media_query(spark, tmp_path):
    cases.documents(spark).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    expected = []
    for i, t, *_ in cases.rows():
        text = (t or "").encode()
        payload = text.ljust(max(192, -(-len(text) // 192) * 192))
        stored = media.write_media(payload)
        expected.append((order(i), len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest()))
    found = QUERIES["op5_media"](spark, str(tmp_path)).collect()
    got = [(order(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in found]
    assert sorted(got) == sorted(expected)
    assert all(r.feature and r.feature.split(";")[3] == str(r.payload_bytes // 192) for r in found)
    assert len({(r.payload_sha256, r.feature) for r in found}) == len({r.payload_sha256 for r in found})


def test_queries_that_tokenise_or_match(spark, tmp_path):
    from tokenizers import Tokenizer

    cases.documents(spark).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    passage = " ".join(cases.words(2, 45))
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    tokenizer = Tokenizer.from_file(vocabulary())
    tokenizer.encode_special_tokens = True
    lengths = sorted((order(i), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in cases.rows())
    counted = QUERIES["op7_token_counts"](spark, str(tmp_path)).collect()
    assert sorted((order(r.doc_id), r.n_tokens) for r in counted) == lengths
    hits = QUERIES["op8_decontamination"](spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.item_id) for r in hits} == {(i, 1) for i in (4, 14, 17, None)}
    pieces = QUERIES["op9_packing"](spark, str(tmp_path)).collect()
    assert sum(p.length for p in pieces) == sum(n + 1 for _, n in lengths)
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at and length > 0
            at += length
        assert at == 4096 or at & (at - 1) == 0


def fragmented(samples: list[bytes], scale: int = 1000) -> bytes:
    """A movie whose samples lie in two fragments: no tables but a trex, sizes and flags in trun."""
    box = lambda kind, *parts: struct.pack(">I4s", 8 + sum(map(len, parts)), kind) + b"".join(parts)
    full = lambda kind, flags, *parts: box(kind, struct.pack(">I", flags), *parts)
    tkhd = full(b"tkhd", 3, struct.pack(">IIIII", 0, 0, 1, 0, 0), b"\0" * 60)
    mdhd = full(b"mdhd", 0, struct.pack(">IIII", 0, 0, scale, 0), b"\0" * 4)
    hdlr = full(b"hdlr", 0, struct.pack(">I4s", 0, b"vide"), b"\0" * 13)
    entry = box(b"raw ", b"\0" * 24, struct.pack(">HH", 8, 8), b"\0" * 50)
    empty = [full(k, 0, struct.pack(">I", 0)) for k in (b"stts", b"stsc", b"stco")]
    stbl = box(b"stbl", full(b"stsd", 0, struct.pack(">I", 1), entry), full(b"stsz", 0, struct.pack(">II", 0, 0)), *empty)
    trak = box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, box(b"minf", stbl)))
    mvex = box(b"mvex", full(b"trex", 0, struct.pack(">IIIII", 1, 1, 40, 0, 0x10000)))
    out = box(b"ftyp", b"iso5", b"\0\0\0\0") + box(b"moov", full(b"mvhd", 0, struct.pack(">IIII", 0, 0, scale, 0), b"\0" * 80), trak, mvex)
    half = len(samples) // 2
    for number, part in enumerate((samples[:half], samples[half:]), 1):
        run = lambda at: full(b"trun", 0x205, struct.pack(">Iii", len(part), at, 0), *[struct.pack(">I", len(s)) for s in part])  # noqa: B023, E731
        moof = lambda at: box(b"moof", full(b"mfhd", 0, struct.pack(">I", number)), box(b"traf", full(b"tfhd", 0x20000, struct.pack(">I", 1)), run(at)))  # noqa: B023, E731
        out += moof(len(moof(0)) + 8) + box(b"mdat", *part)
    return out


def test_media_in_fragments():
    samples = [bytes([k]) * (10 + k) for k in range(9)]
    data = fragmented(samples)
    assert media.read_samples(data) == b"".join(samples)
    (track,) = media.tracks(data)
    assert (track["samples"], track["sample_bytes"], track["duration"], track["codec"]) == (9, sum(map(len, samples)), 9 * 40, "raw ")
    assert [data[k["start"] : k["start"] + k["length"]] for k in track["keyframes"]] == [samples[0], samples[4]]


def test_arcs_of_pages_beyond_a_batch(spark, monkeypatch):
    """Batches are bounded by bytes: 256 pages that together exceed the bound many times over are written and read whole."""
    from bindery.llm import warc

    pages = spark.range(256).select(F.col("id").alias("page_id"), F.lit("http://h/").alias("url"), F.concat(F.col("id").cast("string"), F.expr("repeat('x', 400000)")).alias("html")).coalesce(1)
    records = warc.read_warcs(warc.write_warcs(warc.mark_revisits(warc.read_arcs(warc.write_arcs(pages)))))
    got = records.select("key", "payload_bytes", F.octet_length("payload").alias("n")).collect()
    assert sorted((r.key, r.payload_bytes, r.n) for r in got) == [(i, len(str(i)) + 400_000, len(str(i)) + 400_000) for i in range(256)]


@pytest.mark.parametrize("hot", [3, None])
def test_a_third_of_all_rows_under_one_id(spark, hot):
    """Rows of one id are dealt to several chunks; op2, op9 and op10 stay exact."""
    from bindery.llm import _chunks
    from bindery.llm.line_dedup import drop_common_lines
    from bindery.llm.packing import pack_sequences
    from bindery.llm.substring_dedup import remove_repeats

    line = "a line of more than twenty code points in them all"
    rows = [(hot if i % 3 == 0 else 1000 + i, f"{line}\n" + " ".join(cases.words(i, 25, 5000))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    dealt = _chunks.chunked(docs, "doc_id", "text", 64 * _chunks.CHUNK_BYTES).where(F.col("doc_id").eqNullSafe(hot)).groupBy("_chunk").count().collect()
    assert len(dealt) > 20 and max(r["count"] for r in dealt) < 20
    lines = drop_common_lines(docs).collect()
    assert sum(r.n_lines for r in lines) == 600 and sum(r.n_dropped for r in lines) == 299
    assert [r.doc_id for r in lines if not r.n_dropped] == [1000 + 299]
    assert sorted((order(r.doc_id), r.n_words, r.n_removed) for r in remove_repeats(docs).collect()) == sorted((order(i), len(t.split()), 0) for i, t in rows)
    packed = pack_sequences(docs, tokenizer=vocabulary(), end=2, limit=4096).where("start = 0").groupBy("doc_id").count().collect()
    assert {order(r.doc_id): r["count"] for r in packed}[order(hot)] == 100
