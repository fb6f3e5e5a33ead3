"""MinHash near-dedup with SetSketch registers: band, estimate jointly, verify, and lose no link.

1. Every text becomes the set of its distinct word shingles, a 128-bit print of
   the set and M registers.  Equal sets collapse to their smallest id.
2. Registers are banded.  In each bucket with company all members are compared
   with one leader (another one per band): first the joint likelihood estimate
   from both sketches, then, if that comes near the limit, the full sets.
3. Links give components.  Buckets that hold several components are compared
   again, only across components: first sketches, in blocks of a bucket, which
   gives clusters of components that may be similar; then full sets, in blocks of
   a cluster.  A block is packed once, as one row: its distinct shingles and each
   document's numbers of them; texts do not travel to other blocks, and blocks of
   a cluster's largest component are not compared with each other.  So every two
   texts that share a band are either in one component or compared, at any bucket
   size, and blocks tell joining links, never pairs.

Joins deal a key with many rows (a bucket, a leader, a component, a group of
copies) to as many tasks as its rows ask for.

Two sets at the limit of 0.8 share no band with odds of 1.4e-7, and the estimate
misses them by its margin of five deviations with odds below 1e-6.  Full sets
are compared by 64-bit shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.skew import piece
from . import _chunks as C, _setsketch as S
from ._labelled import batches
from ._skew import components, hot_join, hot_keys, tally
from ._store import release, written
from ._text import Words, column_bytes, mix, pack_sorted, pair, runs, unpack_sorted, windows

BLOCK = 128  # documents a side of a comparison of full sets
SKETCH_BLOCK = 1024
CLUSTER_BLOCK = 256
CLUSTER_SHINGLES = 1 << 19
MARGIN = 5.0
RESULT = "doc_id long, n_shingles long, component_id long, kept boolean"


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes): each text's distinct shingles, ascending, one text after the other.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z in lower case; fewer than `width` words are one shingle.
    """
    words = Words(*column_bytes(column), lower=True)
    n = len(words.counts)
    at = words.starts_of(width)
    found, doc = (windows(words.hashes, width)[at] if len(at) else np.empty(0, np.uint64)), words.doc[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < width))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            there = words.counts[short] > k
            whole[there] = pair(whole[there], words.hashes[words.first[short[there]] + k], 90 + k)
        order = np.argsort(np.concatenate([doc, short]), kind="stable")
        found, doc = np.concatenate([found, whole])[order], np.concatenate([doc, short])[order]
    size = np.bincount(doc, minlength=n)
    for end, k in zip(np.cumsum(size), size, strict=True):
        found[end - k : end].sort()
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
    return found[new], np.bincount(doc[new], minlength=n)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, print_a, print_b, registers) of (doc_id, text); an empty set has no registers."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for lo, hi in batches(part["text"]):
                found, size = shingle_sets(part["text"].slice(lo, hi - lo), width)
                end = np.cumsum(size)
                prints = []
                for salt in (31, 32):
                    total = np.concatenate([[0], np.cumsum(mix(found, salt))]).astype(np.uint64)
                    prints.append(mix(total[end] - total[end - size]).view(np.int64))
                registers = S.sketch(found, size).astype("<u2")
                yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"].slice(lo, hi - lo), "n_shingles": pa.array(size, pa.int64()), "print_a": pa.array(prints[0]), "print_b": pa.array(prints[1]), "registers": pa.array([r.tobytes() if k else None for r, k in zip(registers, size, strict=True)], pa.binary())})

    return docs.mapInArrow(run, "doc_id long, n_shingles long, print_a long, print_b long, registers binary")


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), S.M)


def _bands(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for lo in range(0, part.num_rows, 4096):
            some = part.slice(lo, 4096)
            keys = S.band_keys(_registers(some["registers"]))
            doc = some["doc_id"].to_numpy()
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys.ravel().view(np.int64)), "doc": pa.array(np.repeat(doc, keys.shape[1]))})


def _deviation(limit: float) -> float:
    return MARGIN * (limit * (1 - limit) / S.M) ** 0.5


def _likely(limit: float):
    least = limit - _deviation(limit)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for lo in range(0, part.num_rows, 8192):
                some = part.slice(lo, 8192)
                near = S.similarity(_registers(some["ra"]), _registers(some["rb"]), some["na"].to_numpy(), some["nb"].to_numpy()) >= least
                yield some.select(["a", "b"]).filter(pa.array(near))

    return run


class _Union:
    """Joins numbers; keeps the links that joined something new."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, a: int) -> int:
        while (up := self.parent.setdefault(a, a)) != a:
            self.parent[a] = a = self.parent[up]
        return a

    def link(self, a: int, b: int, as_a: int | None = None, as_b: int | None = None) -> None:
        """Join a and b; the link is told as (as_a, as_b) where those are given."""
        x, y = self.root(a), self.root(b)
        if x != y:
            self.parent[x] = y
            self.links.append((a if as_a is None else as_a, b if as_b is None else as_b))

    def table(self) -> pa.Table:
        return pa.table({"a": pa.array([x for x, _ in self.links], pa.int64()), "b": pa.array([y for _, y in self.links], pa.int64())})


def _sets(side: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    column = side["text"].combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    got = [shingle_sets(column.slice(lo, hi - lo), width) for lo, hi in batches(column)]
    return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])


def _similar(held: np.ndarray, size: np.ndarray, asked: np.ndarray, asked_size: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first query, queries x rows whether linked) in tiles of bounded memory; sets as shingle_sets gives them."""
    owner = np.repeat(np.arange(len(size)), size)
    order = np.argsort(held, kind="stable")
    held, owner = held[order], owner[order]
    first = np.concatenate([[0], np.cumsum(asked_size)])
    lo, hi = np.searchsorted(held, asked, "left"), np.searchsorted(held, asked, "right")
    weight = np.concatenate([[0], np.cumsum(hi - lo)])[first]
    q = 0
    while q < len(asked_size):
        to = max(q + 1, int(np.searchsorted(weight, weight[q] + (1 << 21), "right")) - 1)
        part = slice(first[q], first[to])
        count = (hi - lo)[part]
        at = np.repeat(lo[part], count) + runs(count)
        who = np.repeat(np.repeat(np.arange(to - q), asked_size[q:to]), count)
        shared = np.bincount(who * len(size) + owner[at], minlength=(to - q) * len(size)).reshape(to - q, -1)
        union = asked_size[q:to, None] + size[None, :] - shared
        yield q, (100 * shared >= percent * union) & (shared > 0)
        q = to


def _verify(width: int, percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Of each query the first row, if any, that it is similar to; the rows of a group are known to be one component."""
        rows, queries = (table.filter(pc.equal(table["role"], k)) for k in (0, 1))
        out = _Union()
        if rows.num_rows and queries.num_rows:
            ids, query_ids = rows["doc_id"].to_pylist(), queries["doc_id"].to_pylist()
            for q, linked in _similar(*_sets(rows, width), *_sets(queries, width), percent):
                for i in np.flatnonzero(linked.any(1)).tolist():
                    out.links.append((query_ids[q + i], ids[int(linked[i].argmax())]))
        return out.table()

    return run


def _pack_block(width: int):
    def run(table: pa.Table) -> pa.Table:
        """One row of a block's documents: their sets as numbers of the block's distinct shingles, which near copies mostly share."""
        found, size = _sets(table, width)
        known, number = np.unique(found, return_inverse=True)
        ids, comp = (table[c].to_numpy().astype(np.int64).view(np.uint64) for c in ("doc_id", "comp"))
        blob = C.join_parts(pack_sorted(known), *(C.pack_plain(x) for x in (number.astype(np.uint64), size.astype(np.uint64), ids, comp)))
        return pa.table({c: table[c].slice(0, 1) for c in ("g", "block", "nj", "nl")} | {"blob": pa.array([blob], pa.binary())})

    return run


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    known, *rest = C.split_parts(blob)
    number, size, ids, comp = (C.unpack_plain(x) for x in rest)
    return unpack_sorted(known)[number.astype(np.int64)], size.astype(np.int64), ids.view(np.int64), comp.view(np.int64)


def _verify_blocks(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Links (a, b) that join the components of two blocks of a cluster (or of one with itself) by similar documents."""
        blobs = table.sort_by("block")["blob"].to_pylist()
        out = _Union()
        if len(blobs) == 2 or table["i"][0].as_py() == table["j"][0].as_py():
            held, size, ids, comp = _unpacked(blobs[0])
            asked, asked_size, query_ids, query_comp = _unpacked(blobs[-1])
            for q, linked in _similar(held, size, asked, asked_size, percent):
                linked &= query_comp[q : q + len(linked), None] != comp[None, :]
                for i, j in zip(*(x.tolist() for x in np.nonzero(linked)), strict=True):
                    out.link(int(query_comp[q + i]), int(comp[j]), int(query_ids[q + i]), int(ids[j]))
        return out.table()

    return run


def _across(limit: float):
    least = limit - _deviation(limit)
    shared = int((limit - 2 * _deviation(limit)) * S.M)  # far below what the estimate lets through

    def run(table: pa.Table) -> pa.Table:
        """Links (a, b) that join the components with members in this block that may be similar: one less than joined, not one per pair.

        Each pair of documents is looked at in its first common band only.
        """
        key = np.int64(table["key"][0].as_py()).view(np.uint64)
        rows, queries = (table.filter(pc.equal(table["role"], k)) for k in (0, 1))
        joined = _Union()
        if rows.num_rows and queries.num_rows:
            a, b = _registers(queries["registers"]), _registers(rows["registers"])
            ka, kb = S.band_keys(a), S.band_keys(b)
            ca, cb, na, nb = queries["comp"].to_numpy(), rows["comp"].to_numpy(), queries["n_shingles"].to_numpy(), rows["n_shingles"].to_numpy()
            for q in range(0, len(a), 16):
                tile = slice(q, q + 16)
                equal = np.stack([(x == b).sum(1) for x in a[tile]])
                i, j = np.nonzero((equal >= shared) & (ca[tile][:, None] != cb[None, :]))
                i += q
                common = ka[i] == kb[j]
                here = ka[i, common.argmax(1)] == key if len(i) else np.empty(0, bool)
                i, j = i[here], j[here]
                for s in range(0, len(i), 8192):
                    x, y = i[s : s + 8192], j[s : s + 8192]
                    near = S.similarity(a[x], b[y], na[x], nb[y]) >= least
                    for c, d in zip(ca[x[near]].tolist(), cb[y[near]].tolist(), strict=True):
                        joined.link(c, d)
        return joined.table()

    return run


def _blocks(count: str, size: int) -> Column:
    return F.ceil(F.col(count) / size).cast("int")


def _all(n: Column | str) -> Column:
    return F.explode(F.sequence(F.lit(0), (F.col(n) if isinstance(n, str) else n) - 1))


def _one(n: str, salt: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), "doc_id"), F.col(n)).cast("int")


def links(nodes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc, comp) of every node that has a link; nodes are sketches, one per distinct set."""
    limit = percent / 100
    sketch = nodes.select("doc_id", "n_shingles", "registers")
    bands = nodes.select("doc_id", "registers").mapInArrow(_bands, "key long, doc long")
    buckets = bands.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(F.xxhash64("key", "doc").alias("h"), "doc")).alias("least")).where("_n > 1")
    buckets = written(buckets.select("key", "_n", F.col("least.doc").alias("leader")), compact=True)
    rows = piece(buckets.agg(F.sum("_n")).first()[0] or 0)
    members = written(hot_join(bands, buckets.drop("_n"), ["key"], F.col("doc"), hot_keys(buckets, ["key"], rows), rows))

    # every member and its bucket's leader
    pairs = written(members.where("doc <> leader").select(F.col("doc").alias("a"), F.col("leader").alias("b")).distinct(), compact=True)
    with_a = pairs.join(sketch.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), F.col("registers").alias("ra")), "a")
    leaders = sketch.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("registers").alias("rb")).join(pairs.select("b").distinct(), "b", "left_semi")
    per = piece(pairs.count())
    with_b = hot_join(with_a, leaders, ["b"], F.col("a"), hot_keys(tally(pairs, ["b"]), ["b"], per), per)
    near = written(with_b.select("a", "b", "na", "ra", "nb", "rb").mapInArrow(_likely(limit), "a long, b long"), compact=True)
    many = written(tally(near, ["b"]), compact=True)
    nj = _blocks("_n", BLOCK)
    per = piece(near.count())
    dealt = hot_join(near, many.select("b", nj.alias("nj")), ["b"], F.col("a"), hot_keys(many, ["b"], per), per)
    queries = dealt.select(F.col("b").alias("g"), F.pmod(F.xxhash64(F.lit(1), "a"), F.col("nj")).cast("int").alias("j"), F.lit(1).alias("role"), F.col("a").alias("doc_id")).join(texts, "doc_id")
    asked = many.join(texts, F.col("b") == F.col("doc_id")).select("doc_id", F.col("b").alias("g"), _all(nj).alias("j"), F.lit(0).alias("role"), "text")
    verified = queries.unionByName(asked).groupBy("g", "j").applyInArrow(_verify(width, percent), "a long, b long").where("a <> b")
    found = written(verified, compact=True)
    labels = components(found)
    release(pairs, near, many)

    # buckets that still hold several components
    placed = members.join(labels, "doc", "left").select("key", "doc", F.coalesce("comp", "doc").alias("comp"))
    shares = tally(placed, ["key", "comp"])
    open_keys = shares.groupBy("key").agg(F.max(F.struct("_n", "comp")).alias("most"), F.sum("_n").alias("_n")).where("_n > most._n")
    open_keys = written(open_keys.select("key", "_n", F.col("most.comp").alias("largest"), _blocks("_n", SKETCH_BLOCK).alias("ni"), F.ceil((F.col("_n") - F.col("most._n")) / SKETCH_BLOCK).cast("int").alias("nj")), compact=True)
    opened = written(hot_join(placed, open_keys.drop("_n"), ["key"], F.col("doc"), hot_keys(open_keys, ["key"], rows), rows).withColumnRenamed("doc", "doc_id"), compact=True)
    held = opened.join(sketch, "doc_id")
    columns = ["key", "i", "j", "role", "doc_id", "comp", "n_shingles", "registers"]
    told = held.withColumn("i", _one("ni", 2)).withColumn("j", _all("nj")).withColumn("role", F.lit(0)).select(*columns)
    asking = held.where("comp <> largest").withColumn("j", _one("nj", 3)).withColumn("i", _all("ni")).withColumn("role", F.lit(1)).select(*columns)
    across = told.unionByName(asking).groupBy("key", "i", "j").applyInArrow(_across(limit), "a long, b long")
    clusters = components(across.distinct()).select(F.col("doc").alias("comp"), F.col("comp").alias("cluster"))

    # full sets of a cluster's documents, block against block, but for the largest component with itself
    sizes = tally(labels, ["comp"])
    per = piece(labels.count())
    parts = hot_join(labels, clusters, ["comp"], F.col("doc"), hot_keys(sizes, ["comp"], per), per).select("cluster", "comp", F.col("doc").alias("doc_id"))
    alone = clusters.join(sizes, "comp", "left_anti").select("cluster", "comp", F.col("comp").alias("doc_id"))
    held = written(parts.unionByName(alone).join(nodes.select("doc_id", "n_shingles"), "doc_id"), compact=True)
    each = held.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("_n"), F.sum("n_shingles").alias("w"))
    most = each.groupBy("cluster").agg(F.max(F.struct("_n", "comp", "w")).alias("most"), F.sum("_n").alias("_n"), F.sum("w").alias("w"))
    blocks = lambda n, w: F.ceil(F.greatest(n / CLUSTER_BLOCK, w / CLUSTER_SHINGLES)).cast("int")
    most = written(most.select("cluster", "_n", F.col("most.comp").alias("largest"), blocks(F.col("_n") - F.col("most._n"), F.col("w") - F.col("most.w")).alias("nj"), blocks(F.col("most._n"), F.col("most.w")).alias("nl")), compact=True)
    per = piece(held.count())
    dealt = hot_join(held, most.drop("_n"), ["cluster"], F.col("doc_id"), hot_keys(most, ["cluster"], per), per)
    dealt = dealt.withColumn("block", F.when(F.col("comp") == F.col("largest"), F.col("nj") + _one("nl", 4)).otherwise(_one("nj", 4)))
    dealt = dealt.select(F.col("cluster").alias("g"), "block", "nj", "nl", "doc_id", "comp").join(texts, "doc_id")
    packed = dealt.groupBy("g", "block").applyInArrow(_pack_block(width), "g long, block int, nj int, nl int, blob binary")
    others = F.explode(F.sequence(F.lit(0), F.col("nj") - 1 + F.when(F.col("block") < F.col("nj"), F.col("nl")).otherwise(0)))
    packed = packed.withColumn("other", others).select("g", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "blob")
    more = packed.groupBy("g", "i", "j").applyInArrow(_verify_blocks(percent), "a long, b long")
    out = components(found.unionByName(more))
    release(buckets, members, found, open_keys, opened, held, most)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """RESULT, one row per input row: shingles in its set, the smallest id of its component, and whether that is its own.

    Documents are linked when 100 * (shared shingles) >= percent * (shingles in
    either); components follow links, and equal sets are one node.

    Null, empty and blank texts have an empty set and are linked with nothing;
    fewer than `width` words are one shingle.  Rows with one id share a component;
    a row without an id is linked with nothing, has no component and is kept.
    An empty table gives an empty result; other columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = written(sketches(texts, width))
    prints = ["n_shingles", "print_a", "print_b"]
    linkable = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    rows = found.where(linkable)
    per = piece(found.count())
    copies = written(rows.groupBy(*prints).agg(F.min("doc_id").alias("same_as"), F.count(F.lit(1)).alias("_n")).where("_n > 1"), compact=True)
    placed = hot_join(rows.drop("registers"), copies.drop("_n"), prints, F.col("doc_id"), hot_keys(copies, prints, per), per, "left").select("doc_id", "n_shingles", F.coalesce("same_as", "doc_id").alias("same_as"))
    placed = written(placed, compact=True)
    nodes = written(rows.join(placed.where("same_as <> doc_id").select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "n_shingles", "registers"))
    labels = links(nodes, texts, width, percent).withColumnRenamed("doc", "same_as")
    own = F.coalesce("comp", "same_as")
    linked = hot_join(placed, labels, ["same_as"], F.col("doc_id"), hot_keys(tally(placed, ["same_as"]), ["same_as"], per), per, "left").select("doc_id", "n_shingles", own.alias("component_id"), (F.col("doc_id") == own).alias("kept"))
    single = found.where(~linkable).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionByName(single)
