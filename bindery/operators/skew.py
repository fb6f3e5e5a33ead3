"""A join whose hot keys, and only those, are dealt to many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PIECES = 4096
LEAST = 256
#: For tables whose size is not known while the plan is built.
HOT_ROWS = 1 << 20


def piece(total: int) -> int:
    """Rows of one key that stay together: a 4096th of `total`, so at most 4096 keys can hold more."""
    return max(LEAST, total // PIECES)


def dealt_join(rows: DataFrame, small: DataFrame, keys: list[str], spread: Column, counts: DataFrame | None = None, per: int | None = None, how: str = "inner") -> DataFrame:
    """`rows` joined to `small`; a key with more than `per` rows is dealt to one task per `per` rows, by a hash of `spread`.

    `counts` (keys, _n) tells how many rows a key has; keys that it omits are not dealt.
    Only the hot keys are broadcast (one for each `per` rows of the table at most), and
    only their rows of `small` are copied, once per task.  Null keys match nothing.
    Without `counts` the rows are counted by key; without `per` it is `piece` of all rows,
    counted while the plan is built.
    """
    if counts is None:
        counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    if per is None:
        per = piece(rows.count())
    hot = F.broadcast(counts.where(F.col("_n") > per).select(*keys, F.ceil(F.col("_n") / per).cast("int").alias("_salts")))
    dealt = rows.join(hot, keys, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_salts")), F.lit(0)).cast("int")).drop("_salts")
    copies = small.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return dealt.join(copies, [*keys, "_salt"], how).drop("_salt")
