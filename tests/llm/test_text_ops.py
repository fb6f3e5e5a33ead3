import hashlib
import re
import struct
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from bindery.llm import media, quality, toxicity
from bindery.llm.line_dedup import LineIndex, drop_common_lines
from bindery.llm.near_dup import near_duplicates
from bindery.llm.packing import pack_lengths, pack_sequences
from bindery.llm.queries import END_OF_TEXT, vocabulary
from bindery.llm.substring_dedup import remove_repeats
from bindery.llm.token_counts import count_tokens, write_token_files

from . import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
LEAST = -(2**63)


def order(i):
    return LEAST if i is None else i


def test_substring_dedup_against_brute_force(spark):
    rows = sorted(((order(i), t or "") for i, t, *_ in cases.rows()), key=lambda r: r)
    first, expected = {}, defaultdict(list)
    for n, (_, text) in enumerate(rows):
        w = WORD.findall(text)
        for p in range(len(w) - 19):
            first.setdefault(tuple(w[p : p + 20]), (n, p))
    for n, (i, text) in enumerate(rows):
        w = WORD.findall(text)
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            if first[tuple(w[p : p + 20])] != (n, p):
                gone[p : p + 20] = [True] * 20
        expected[i].append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    found = defaultdict(list)
    for r in remove_repeats(cases.documents(spark)).collect():
        found[order(r.doc_id)].append((r.n_words, r.n_removed, r.kept_text))
        assert sum(s.length for s in r.removed) == r.n_removed
        assert all(s.start >= 0 and s.start + s.length <= r.n_words for s in r.removed)
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in expected.items()}
    assert remove_repeats(cases.empty(spark)).collect() == []


def test_line_dedup_against_brute_force(spark):
    rows = [(order(i), t or "") for i, t, *_ in cases.rows()]
    key = lambda line: line.strip(" \t\n\v\f\r").translate(LOWER)
    holders = defaultdict(set)
    for i, text in rows:
        for line in text.split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(i)
    expected = []
    for i, text in rows:
        lines = text.split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 3 or max(holders[key(x)]) == i]
        expected.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    found = [(order(r.doc_id), r.n_lines, r.n_dropped, r.kept_text) for r in drop_common_lines(cases.documents(spark), keep=("a.b",)).collect()]
    assert sorted(found) == sorted(expected)
    assert sum(r[2] for r in found) >= 4
    assert drop_common_lines(cases.empty(spark)).collect() == []


def test_line_index_is_a_perfect_hash():
    import numpy as np

    keys = np.random.default_rng(1).integers(0, 2**63, 50_000, dtype=np.uint64)
    keys = np.unique(keys)
    index = LineIndex(keys, np.arange(len(keys)) + 1, np.arange(len(keys)) + 7)
    count, largest = index.lookup(keys)
    assert len(index.count) == len(keys)
    assert (count == np.arange(len(keys)) + 1).all() and (largest == np.arange(len(keys)) + 7).all()
    unknown, _ = index.lookup(keys + np.uint64(1))
    assert (unknown > 0).mean() < 0.01
    assert LineIndex(keys[:0], keys[:0], keys[:0]).lookup(keys[:3])[0].tolist() == [0, 0, 0]
    with pytest.raises(ValueError):
        LineIndex(np.zeros(2, np.uint64), np.ones(2), np.ones(2))


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(rows, k):
    """Brute force: rows of one id are one node."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted((LEAST if i is None else i, len(s), LEAST if i is None else find(i), i is None or find(i) == i) for i, s in sets)


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_against_brute_force(spark, width):
    rows = [(i, t) for i, t, *_ in cases.rows()]
    found = sorted((order(r.doc_id), r.n_shingles, order(r.component_id), r.kept) for r in near_duplicates(cases.documents(spark), width=width).collect())
    assert found == components(rows, width)


def test_near_duplicates_in_a_hot_group(spark):
    import random

    rng, base = random.Random(4), cases.words(9, 120)
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(99)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(base)) for i in range(200)]
    found = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect())
    assert found == components(rows, 4)
    assert near_duplicates(cases.empty(spark)).collect() == []


def test_setsketch_estimates_and_merges():
    import numpy as np

    from bindery.llm import _setsketch as S

    rng = np.random.default_rng(2)
    common, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (4000, 500, 500))
    sets = [np.concatenate([common, a]), np.concatenate([common, b]), np.concatenate([common, a, b])]
    r = S.sketch(np.concatenate(sets), np.array([len(s) for s in sets]))
    assert (np.maximum(r[0], r[1]) == r[2]).all()
    near = S.similarity(r[:1], r[1:2], np.array([4500]), np.array([4500]))[0]
    assert abs(near - 0.8) < 5 * (0.16 / S.M) ** 0.5


def test_packing_covers_every_token_without_padding(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    rows = [(i, t) for i, t, *_ in cases.rows() if i != 17 and i is not None]
    df = spark.createDataFrame(rows + [(100 + i, " ".join(cases.words(i, 900))) for i in range(40)], "doc_id long, text string")
    ids = {r.doc_id: tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2] for r in df.collect()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in pack_sequences(df, vocabulary(), 2, with_ids=True).collect():
        mine = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids == mine and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(mine)}I", *mine))
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for found, wanted in [(pieces[i], len(x)) for i, x in ids.items()] + [(s, None) for s in sequences.values()]:
        at = 0
        for start, n in sorted(found):
            assert start == at and n > 0
            at += n
        assert at == wanted if wanted else at == 4096 or at & (at - 1) == 0
    assert pack_sequences(cases.documents(spark), vocabulary(), 2).groupBy().sum("length").first()[0] > 0
    assert pack_sequences(cases.empty(spark), vocabulary(), 2).collect() == []


def test_pack_lengths():
    assert pack_lengths([], 8) == []
    assert sorted(map(tuple, pack_lengths([8, 5, 3], 8))) == [((0, 0, 8),), ((1, 0, 5), (2, 0, 3))]
    for lengths in ([7], [20, 3], [1] * 9, [5, 5, 5, 5]):
        out = pack_lengths(lengths, 8)
        sums = [sum(p[2] for p in s) for s in out]
        assert sum(sums) == sum(lengths) and all(s == 8 or s & (s - 1) == 0 for s in sums)


def test_token_counts_against_the_tokenizer(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    tokenizer.encode_special_tokens = True
    rows = cases.rows() + [(50, "<|endoftext|> a<|endoftext|>b", 0, "", 0.0, "")]
    expected = sorted((order(i), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows)
    df = spark.createDataFrame(rows, cases.SCHEMA)
    for block in (64, 1 << 18):
        found = count_tokens(write_token_files(df, vocabulary(), END_OF_TEXT, block_tokens=block), END_OF_TEXT, names="ids").collect()
        assert sorted((order(r.name), r.n_tokens) for r in found) == expected
    assert count_tokens(write_token_files(cases.empty(spark), vocabulary(), END_OF_TEXT), END_OF_TEXT, names="ids").collect() == []


def test_token_counts_of_flat_files(spark, tmp_path):
    from bindery.llm import token_counts as T

    tokens = [9, 9, 1, 2, 3, 9, 4, 5, 9, 9, 6]
    (tmp_path / "a.bin").write_bytes(struct.pack("<11I", *tokens))
    (tmp_path / "b.bin").write_bytes(b"")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    before, T.SPAN = T.SPAN, 2
    try:
        for block in (4, 8, 12, 400):
            found = count_tokens(T.file_blocks(files, block), 9, wide=True).orderBy("document").collect()
            assert [(r.document, r.start, r.n_tokens) for r in found] == [(0, 0, 0), (1, 1, 0), (2, 2, 3), (3, 6, 2), (4, 9, 0), (5, 10, 1)]
    finally:
        T.SPAN = before


def test_token_files_are_flat_and_strays_are_not_read(spark):
    from pathlib import Path

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    tokenizer.encode_special_tokens = True
    df = spark.createDataFrame([(i, f"text number {i} " * (i % 7)) for i in range(300)], "doc_id long, text string").coalesce(1)
    ranges = write_token_files(df, vocabulary(), END_OF_TEXT, block_tokens=128)
    path = Path(ranges.first().path.removeprefix("file://"))
    flat = [t for i in range(300) for t in [*tokenizer.encode(f"text number {i} " * (i % 7), add_special_tokens=False).ids, END_OF_TEXT]]
    assert path.read_bytes() == struct.pack(f"<{len(flat)}H", *flat)
    (path.parent / "0-lost.tokens").write_bytes(b"stray bytes of a lost attempt")
    assert count_tokens(ranges, END_OF_TEXT).agg({"n_tokens": "sum"}).first()[0] == len(flat) - 300
    with pytest.raises(Exception, match="ends before byte"):
        path.write_bytes(path.read_bytes()[:100])
        count_tokens(ranges, END_OF_TEXT).count()


def test_media_round_trip(spark):
    files = media.store_texts(cases.documents(spark)).cache()
    found = media.index_media(files, keep=("doc_id", "n_bytes", "media"), samples=True).collect()
    assert len(found) == len(cases.rows())
    texts = defaultdict(list)
    for i, t, *_ in cases.rows():
        texts[i].append((t or "").encode())
    for r in found:
        payload = bytes(r.payload)
        assert payload[: r.n_bytes] in texts[r.doc_id] and len(payload) % 192 == 0 and payload[r.n_bytes :].strip() == b""
        track = r.tracks[0]
        assert (track.codec, track.samples * 192, track.timescale, track.duration) == ("raw ", len(payload), 25, track.samples)
        for k in track.keyframes:
            assert bytes(r.media)[k.start : k.start + k.length] == payload[192 * k.sample : 192 * k.sample + 192]
    assert media.store_texts(cases.empty(spark)).collect() == []


def test_media_of_broken_files(spark):
    good = media.write_media(b"x" * 192)
    rows = [(0, good), (1, None), (2, b""), (3, b"not a movie at all"), (4, good[:40]), (5, good[:300]), (6, b"\0" * 64)]
    found = {r.k: r for r in media.index_media(spark.createDataFrame([(k, bytearray(m) if m is not None else None) for k, m in rows], "k int, media binary"), keep=("k",), samples=True).collect()}
    assert len(found[0].tracks) == 1 and all(found[k].payload is None for k in (1, 2, 3, 6))


def test_media_of_other_layouts():
    """64-bit box sizes, co64 offsets and two tracks of different chunking are walked alike."""
    payload = bytes(range(192)) * 130
    plain = media.write_media(payload)
    at = plain.index(b"mdat") - 4
    wide = plain[:at] + struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) + plain[at + 8 :]
    table = wide.index(b"stco") + 12
    n = struct.unpack(">I", wide[table - 4 : table])[0]
    moved = struct.pack(f">{n}I", *(x + 8 for x in struct.unpack(f">{n}I", wide[table : table + 4 * n])))
    assert media.read_samples(wide[:table] + moved + wide[table + 4 * n :]) == payload
    with pytest.raises(ValueError):
        media.write_media(b"")


def labelled(spark, toxic=False):
    rows, labels = [], []
    for i in range(400):
        bad = i % 3 == 0
        w = cases.words(i, 80)
        if toxic:
            text = " ".join(w[:40] + (["nasty", "brute"] if bad else ["kind", "soul"]) + w[40:])
        else:
            text = " ".join(x.upper() + "!!" for x in w) if bad else " ".join(w) + "."
        rows.append((i, text))
        labels.append((i, int(not bad), int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("module", "label", "toxic"), [(quality, "quality", False), (toxicity, "toxic", True)])
def test_classifiers_generalise_and_take_odd_rows(spark, module, label, toxic):
    docs, labels = labelled(spark, toxic)
    model = module.train(docs, labels, label=label)
    scored = module.score(docs, model).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).collect()
    assert len(scored) > 40 and sum((r.score >= 0.5) == bool(r[label]) for r in scored) >= 0.97 * len(scored)
    odd = module.score(cases.documents(spark), model, output="p")
    assert odd.columns == [*cases.documents(spark).columns, "p"]
    assert odd.count() == len(cases.rows()) and odd.where("p IS NULL OR p < 0 OR p > 1").count() == 0
    assert module.score(cases.documents(spark), model).columns.count("score") == 1
    nothing = module.train(cases.empty(spark), labels.limit(0), label=label)
    assert module.score(docs, nothing).select("score").distinct().count() == 1
    assert module.score(cases.empty(spark), model).collect() == []


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = labelled(spark)
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = [sorted(quality.score(docs, quality.train(docs, x)).select("doc_id", "score").collect()) for x in (labels, flipped)]
    assert scores[0] == scores[1]


def test_kept_text_hashes_as_the_query_does(spark):
    r = remove_repeats(spark.createDataFrame([(1, None)], "doc_id long, text string")).select(F.sha2("kept_text", 256)).first()[0]
    assert r == hashlib.sha256(b"").hexdigest()
