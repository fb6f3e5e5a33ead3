"""Benchmark decontamination with DataFrame functions only: SimHash windows, multi-index Hamming blocks, exact check.

A document is contaminated by an item if some window of as many words as the
item has (the whole text if it is shorter) has a similarity of `percent` or
more: the shingles of both, weighted by how often they occur, smaller weights
over larger weights.  The n-th occurrence of a shingle is a feature of its own,
so the weighted similarity is the plain one of feature sets, and a repeated
shingle moves a fingerprint no more than distinct ones do.

1. Windows worth a fingerprint: similarity needs at least percent * (item's
   shingles) places in the window that hold a shingle of the item.  Places are
   marked by the lengths of the items that have their shingle, not by the items,
   and every window of a length with enough marks is taken.  Moving a window's
   start to its first marked place, or back to the last window that fits, never
   lowers the similarity, so no other start is needed.  Nothing is lost here.
2. Which item it is, the index tells.  Equal windows of all documents become
   one, with a fingerprint of BITS = 512 bits; 56 blocks of 9 or 10 bits find the
   items of its length that have an equal block.  That is every item within 55
   bits for certain.  At a similarity of exactly 0.8 fingerprints of many features
   differ by 78 bits with a deviation of 8, and odds that no block is equal are
   8e-7, but those of four and five features differ by 96; two unrelated texts
   (256 bits apart) meet with odds of a tenth.  Those within `radius` bits are judged.
3. What the index leaves is found exactly, at any `percent`: sets of n and w
   features that reach it share at least s = percent * (n + w) / (100 + percent), so in
   any one order the first n - s + 1 and the first w - s + 1 have one in common.
   The order is from the rarest feature of the benchmark to the commonest, so that
   passages which many items share bring few pairs.  So `radius` and the blocks decide
   which way finds a pair, never whether it is found.
4. Full features judge the pairs of both ways, and hits go back to all places of
   the window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.skew import dealt_join, piece
from ._skew import tally
from ._store import written

#: Rows of benchmark tables up to which they are broadcast (100 bytes each at most); beyond, joins shuffle.
BROADCAST_ROWS = 1 << 20
LONGS = 8
BITS = 64 * LONGS
RADIUS = 128
_CUTS = (0, 9, 18, 27, 36, 45, 54, 64)  # 7 blocks of each of the 8 longs
#: Features that a window may have for 14-bit counters.
COUNTED = (1 << 14) - 1
#: Copies of a shingle's benchmark rows where these are too many to broadcast.
SALTS = 32


def _shingled(frame: DataFrame, text_col: str, widths: list[int]) -> DataFrame:
    """`frame` with n_words and, for each width, s<width>: hashes of its shingles in order."""
    words = frame.withColumn("_words", F.expr(rf"filter(split(lower(coalesce(`{text_col}`, '')), '[^\\p{{L}}\\p{{N}}]+'), w -> w <> '')"))
    hashed = words.withColumn("_h", F.expr("transform(_words, w -> xxhash64(w))")).drop("_words")
    out = hashed.withColumn("n_words", F.size("_h"))
    for k in widths:
        parts = ", ".join(f"_h[i + {j}]" for j in range(k))
        out = out.withColumn(f"s{k}", F.expr(f"CASE WHEN size(_h) < {k} THEN array() ELSE transform(sequence(0, size(_h) - {k}), i -> xxhash64({parts})) END").cast("array<bigint>"))
    return out.drop("_h")


def features(shingles: str) -> Column:
    """An array of hashes as the set of its occurrences: the n-th occurrence of x is (x, n), in an order of its own."""
    return F.expr(f"transform(array(sort_array({shingles})), t -> transform(t, (x, i) -> xxhash64(x, i - array_position(t, x))))[0]")


def fingerprint(array: str) -> Column:
    """SimHash of BITS bits, as LONGS longs: each bit is the majority's among the features' bits.

    Four bits are counted at once, in 16-bit lanes of a long; beyond COUNTED features, one at a time.
    """
    lanes = "281479271743489L"  # 0x0001000100010001
    ones = f"aggregate(g, 0L, (n, x) -> n + (shiftrightunsigned(x, j) & {lanes}))"
    most = f"shiftleft(shiftrightunsigned({ones} + (16383L - size(g) DIV 2) * {lanes}, 14) & {lanes}, j)"
    packed = f"aggregate(transform(sequence(0, 15), j -> {most}), 0L, (a, b) -> a | b)"
    each = "aggregate(g, 0, (n, x) -> n + CAST(shiftrightunsigned(x, j) & 1 AS INT))"
    plain = f"aggregate(transform(sequence(0, 63), j -> CASE WHEN 2 * {each} > size(g) THEN shiftleft(1L, j) ELSE 0L END), 0L, (a, b) -> a | b)"
    return F.expr(f"transform(transform(sequence(1, {LONGS}), c -> transform({array}, x -> xxhash64(x, c))), g -> CASE WHEN size(g) <= {COUNTED} THEN {packed} ELSE {plain} END)")


def block_values(column: str) -> Column:
    """The blocks of a fingerprint, in order."""
    cut = ", ".join(f"CAST(shiftrightunsigned(x, {a}) & {(1 << (b - a)) - 1} AS INT)" for a, b in zip(_CUTS[:-1], _CUTS[1:], strict=True))
    return F.expr(f"flatten(transform({column}, x -> array({cut})))")


def distance(a: str, b: str) -> Column:
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x ^ y)), 0, (n, x) -> n + x)")


def benchmark_hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 5, percent: int = 80, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, start, n_words, similarity, distance): each contaminated document and item, with the best window.

    Words are runs of letters and digits in lower case, shingles `width` of them
    (an item of fewer words is one shingle).  `start` counts words from 0; of the
    most similar windows it is the first that begins with a shingle of the item, or
    the text's last window.

    Null texts, and items without words, match nothing.  Items with equal words
    are each returned; null ids are kept as they are.  Rows with one id are
    checked each on its own text and returned once for an item.  Empty tables give
    an empty result; other columns are ignored, whatever their names.
    """
    asked = _shingled(items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("_text")), "_text", list(range(1, width + 1)))
    own = reduce(lambda rest, k: F.when(F.col("n_words") == k, F.col(f"s{k}")).otherwise(rest), range(1, width), F.col(f"s{width}"))
    asked = asked.where("n_words > 0").select("item_id", F.col("n_words").alias("length"), F.least(F.col("n_words"), F.lit(width)).alias("k"), own.alias("item_shingles"))
    asked = asked.withColumn("item_features", features("item_shingles")).withColumn("item", F.xxhash64("length", "item_features"))
    asked = asked.withColumn("needed", F.expr(f"CAST(({percent} * size(item_shingles) + 99) DIV 100 AS INT)"))
    asked = written(asked, compact=True)
    known = asked.agg(F.sum(F.size("item_shingles")).alias("rows"), F.count(F.lit(1)).alias("items"), F.sort_array(F.collect_set("k")).alias("widths")).first()
    widths, items_known, rows_known = known["widths"] or [width], known["items"], known["rows"] or 0
    small = max(rows_known, items_known * LONGS * (len(_CUTS) - 1)) <= BROADCAST_ROWS
    per_item = asked.dropDuplicates(["item"]).select("item", "length", "item_shingles", "item_features")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text")).withColumn("row", F.xxhash64("doc_id", "_text"))

    # places that hold a shingle of some item of a length; from here on explode_outer, since the filter that the
    # optimiser adds to explode is pushed below the projections and would hash a document again for each of its words
    anchors = asked.select("k", "length", "needed", F.explode_outer("item_shingles").alias("shingle")).distinct()
    spread = _shingled(texts, "_text", widths)
    places = reduce(DataFrame.unionByName, [spread.select("row", F.lit(k).alias("k"), F.posexplode_outer(f"s{k}").alias("place", "shingle")) for k in widths])
    if small:
        marked = places.join(F.broadcast(anchors), ["shingle", "k"])
    else:  # to count how often each shingle of the corpus occurs would cost as much as the join
        salted = anchors.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        marked = places.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, ["shingle", "k", "salt"])
    marked = marked.groupBy("row", "length", "k", "needed").agg(F.sort_array(F.collect_set("place")).alias("at"))
    starts = F.expr("transform(filter(sequence(0, size(at) - needed), j -> at[j + needed - 1] - at[j] <= length - k), j -> at[j])")
    wanted = marked.where("size(at) >= needed").withColumn("starts", starts).where("size(starts) > 0")
    wanted = written(wanted.groupBy("row").agg(F.collect_list(F.struct("length", "k", "starts")).alias("wanted")), compact=True)
    told = wanted.agg(F.sum(F.expr("aggregate(wanted, 0L, (n, w) -> n + 4 + size(w.starts))"))).first()[0] or 0

    # those windows, each with its place in a document
    again = _shingled(texts.join(F.broadcast(wanted) if told <= BROADCAST_ROWS else wanted, "row"), "_text", widths).drop("_text")
    cuts = []
    for k in widths:
        clamp = "greatest(0, least(s, n_words - w.length))"
        cut = f"flatten(transform(filter(wanted, w -> w.k = {k}), w -> transform(array_distinct(transform(w.starts, s -> {clamp})), s -> struct(w.length AS length, s AS start, slice(s{k}, s + 1, least(w.length, size(s{k}) + {k - 1}) - {k - 1}) AS shingles))))"
        cuts.append(again.select("doc_id", "n_words", F.explode_outer(F.expr(f"array_distinct({cut})")).alias("w")).select("doc_id", "n_words", "w.*"))
    cuts = reduce(DataFrame.unionByName, cuts).where("size(shingles) > 0").withColumn("head", F.col("shingles")[0]).withColumn("features", features("shingles")).drop("shingles")
    cuts = written(cuts.withColumn("window", F.xxhash64("length", "features")))

    # equal windows once; their items by the blocks
    windows = cuts.groupBy("window").agg(F.first("length").alias("length"), F.first("features").alias("features")).withColumn("print", fingerprint("features"))
    windows = written(windows)  # the optimiser would compute a fingerprint again for each use
    indexed = written(per_item.select("item", "length", "item_features", fingerprint("item_features").alias("item_print")), compact=True)
    index = indexed.select("item", "length", "item_print", block_values("item_print").alias("item_blocks"))
    index = index.select("*", F.posexplode_outer("item_blocks").alias("block", "value"))
    probed = windows.select("window", "length", "print", block_values("print").alias("blocks"))
    probes = probed.select("*", F.posexplode_outer("blocks").alias("block", "value"))
    at = ["length", "block", "value"]
    near = probes.join(F.broadcast(index.drop("item_blocks")), at) if small else dealt_join(probes, index.drop("item_blocks"), at, F.col("window"), tally(probes, at), piece(56 * windows.count()))
    near = near.where(distance("print", "item_print") <= radius)
    first_equal = F.array_position(F.zip_with("blocks", block_values("item_print"), lambda x, y: x == y), True) - 1
    near = written(near.where(F.col("block") == first_equal).select("window", "item"), compact=True)  # one row per window and item

    # the pairs that the index leaves; then full features decide
    left = _sharing(windows, indexed, percent, width, small).join(near, ["window", "item"], "left_anti")
    near = written(near.unionByName(left), compact=True)
    both = near.join(windows.select("window", "features", "print"), "window")
    judged = _with_items(both, indexed.drop("length"), small, near)
    judged = judged.withColumn("shared", F.size(F.array_intersect("features", "item_features"))).withColumn("either", F.expr("size(features) + size(item_features) - shared"))
    hits = judged.where(100 * F.col("shared") >= percent * F.col("either"))
    hits = written(hits.select("window", "item", distance("print", "item_print").alias("distance"), (F.col("shared") / F.col("either")).alias("similarity")), compact=True)
    places = cuts.select("doc_id", "n_words", "length", "start", "head", "window")
    found = dealt_join(places, hits, ["window"], F.struct("doc_id", "start"), tally(cuts, ["window"]), piece(cuts.count()))
    found = _with_items(found, per_item.select("item", "item_shingles"), small, found)
    found = found.where(F.expr("array_contains(item_shingles, head) OR start = greatest(0, n_words - length)"))
    order = F.struct(F.col("similarity"), (-F.col("start")).alias("earlier"), (-F.col("distance")).alias("nearer"))
    best = found.groupBy("doc_id", "item").agg(F.max_by(F.struct("start", F.least("length", "n_words").alias("n_words"), "similarity", "distance"), order).alias("best"))
    named = _with_items(best, asked.select("item", "item_id"), small, best)
    return named.select("doc_id", "item_id", F.col("best.start").cast("long").alias("start"), F.col("best.n_words").cast("long").alias("n_words"), "best.similarity", F.col("best.distance").cast("int").alias("distance")).distinct()


def _sharing(windows: DataFrame, items: DataFrame, percent: int, width: int, small: bool) -> DataFrame:
    """(window, item): every pair of one length that can reach `percent`, by the rarest features of both (step 3)."""
    key = ["length", "feature"]
    each = items.select("item", "length", F.explode_outer("item_features").alias("feature"))
    often = written(tally(each, key), compact=True)
    total = each.count()
    each = each.join(F.broadcast(often), key) if small else dealt_join(each, often, key, F.col("item"), often, piece(total))
    ranked = each.groupBy("item", "length").agg(F.sort_array(F.collect_list(F.struct("_n", "feature"))).alias("known"))
    # a window has no more features than the item, so `percent` of the item's is the least that they share
    first = F.expr(f"slice(known, 1, CAST(size(known) - ({percent} * size(known) + 99) DIV 100 + 1 AS INT))")
    ranked = ranked.select("item", "length", F.size("known").alias("n"), F.posexplode_outer(first).alias("before", "f"))
    ranked = ranked.select("item", "length", F.expr("n - before").alias("rest"), F.col("f.feature").alias("feature"))

    # features that no item has come first in a window's order and meet nothing: those that it has are enough
    spread = windows.select("window", "length", F.size("features").alias("w"), F.explode_outer("features").alias("feature"))
    known = spread.join(F.broadcast(often), key) if small else dealt_join(spread, often, key, F.col("window"), tally(spread, key), piece(spread.count()))
    known = known.groupBy("window", "length", "w").agg(F.sort_array(F.collect_list(F.struct("_n", "feature"))).alias("known"))
    known = known.withColumn("least", F.expr(f"CAST(({percent} * (length - least(length, {width}) + 1 + w) + {99 + percent}) DIV {100 + percent} AS INT)")).where("size(known) >= least")
    probes = known.select("window", "length", "least", F.explode_outer(F.expr("slice(known, 1, size(known) - least + 1)")).alias("f"))
    probes = written(probes.select("window", "length", "least", F.col("f.feature").alias("feature")), compact=True)
    met = probes.join(F.broadcast(ranked), key) if small else dealt_join(probes, ranked, key, F.col("window"), tally(probes, key), piece(probes.count()))
    return met.where("rest >= least").select("window", "item").distinct()


def _with_items(rows: DataFrame, items: DataFrame, small: bool, counted: DataFrame) -> DataFrame:
    """`rows` with the columns of their items; an item that many rows have is dealt."""
    if small:
        return rows.join(F.broadcast(items), "item")
    return dealt_join(rows, items, ["item"], F.xxhash64(*[c for c in rows.columns if c in ("window", "doc_id", "start")]), tally(counted, ["item"]), piece(counted.count()))
