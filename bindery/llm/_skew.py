"""Connected components, in joins that neither a star's hub nor a large component gathers into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.skew import dealt_join, piece
from ._store import release, written


def tally(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _n): rows of each key, as dealt_join takes them."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))


def hot_keys(counts: DataFrame, keys: list[str], per: int) -> DataFrame | None:
    """(keys, _n) of the keys with more than `per` rows, as a table of the driver; None where there are none.

    With `per` as `piece` gives it for the counted rows that is at most 4096 keys.
    """
    found = counts.where(F.col("_n") > per).select(*keys, "_n").toArrow()
    return counts.sparkSession.createDataFrame(found) if found.num_rows else None


def hot_join(rows: DataFrame, small: DataFrame, keys: list[str], spread: Column, hot: DataFrame | None, per: int, how: str = "inner") -> DataFrame:
    """dealt_join with keys that `hot_keys` found; without any a plain join, whose plan is a third as large."""
    return rows.join(small, keys, how) if hot is None else dealt_join(rows, small, keys, spread, hot, per, how)


def components(links: DataFrame) -> DataFrame:
    """(doc, comp) of every node of links (a, b): the smallest node that it reaches.

    Labels spread along links and then jump to their label's label, so the rounds
    grow with the logarithm of the longest path.  Each half of a round is a table in
    the shared folder, which keeps the plans short; only counts and hot keys reach
    the driver.  No links, no rows.
    """
    ways = F.explode(F.array(F.struct(F.col("a").alias("doc"), F.col("b").alias("b")), F.struct(F.col("b").alias("doc"), F.col("a").alias("b"))))
    edges = written(links.where("a <> b").select(ways.alias("e")).select("e.doc", "e.b").distinct(), compact=True)
    labels = written(edges.groupBy("doc").agg(F.least(F.col("doc"), F.min("b")).alias("comp")), compact=True)
    per_edge, per_node = piece(edges.count()), piece(labels.count())
    hubs = hot_keys(tally(edges, ["doc"]), ["doc"], per_edge)
    while True:
        near = hot_join(edges, labels, ["doc"], F.col("b"), hubs, per_edge).groupBy(F.col("b").alias("doc")).agg(F.min("comp").alias("near"))
        nearer = written(labels.join(near, "doc", "left").select("doc", F.col("comp").alias("old"), F.least("comp", "near").alias("comp")), compact=True)
        target = labels.select(F.col("doc").alias("comp"), F.col("comp").alias("_next"))
        jumped = hot_join(nearer, target, ["comp"], F.col("doc"), hot_keys(tally(nearer, ["comp"]), ["comp"], per_node), per_node, "left")
        jumped = written(jumped.select("doc", "old", F.least("comp", "_next").alias("comp")), compact=True)
        release(nearer)
        if not jumped.where("comp <> old").limit(1).count():
            release(jumped, edges)
            return labels
        release(labels)
        labels = jumped.select("doc", "comp")
        labels.stored_at = jumped.stored_at
