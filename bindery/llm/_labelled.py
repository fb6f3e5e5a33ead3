"""Labelled rows for fitting: a bounded sample, by hash of the id, of the rows that may be learnt from."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F


def held_out(id_col: str | Column) -> Column:
    """True where crc32(id as text) mod 5 is 0: never learnt from.  A null id is not held out."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(labels: DataFrame, id_col: str, label: str, bound: int) -> DataFrame:
    """(doc_id, label) of at most about `bound` labelled rows that are not held out, spread evenly by a hash of the id.

    Rows without an id or label are left out; an id with several labels has the
    smallest.  The expected size is `bound` when there are more rows than that.
    """
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out("doc_id"))
    n = rows.count()
    if n > bound:
        rows = rows.where(F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1 << 30)) < int(bound / n * (1 << 30)))
    return rows.groupBy("doc_id").agg(F.min("label").alias("label"))


def one_each(rows: DataFrame, value: str) -> DataFrame:
    """`rows` (doc_id, label, value), one an id: the least value of a repeated id, so that a sample's bound holds whatever rows share an id."""
    return rows.groupBy("doc_id", "label").agg(F.min(value).alias(value))


def batches(column: pa.Array, bytes_at_once: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column with about so much text each."""
    sizes = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    lo, held = 0, 0
    for i, s in enumerate(sizes):
        held += int(s)
        if held >= bytes_at_once:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(sizes):
        yield lo, len(sizes)


def with_score(docs: DataFrame, text_col: str, output: str, scorer: Callable[[], Callable[[pa.Array], np.ndarray]]) -> DataFrame:
    """`docs` and a double column from its texts; `scorer` is called once per task. Any column names will do."""
    names = docs.columns
    at = names.index(text_col)
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer()
        for part in parts:
            text = part.column(at)
            found = [score(text.slice(lo, hi - lo)) for lo, hi in batches(text)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.concatenate(found) if found else np.empty(0))], [*part.schema.names, "score"])

    out = rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", score double")
    keep = [i for i, n in enumerate(names) if n != output]
    return out.select(*[f"c{i}" for i in keep], "score").toDF(*[names[i] for i in keep], output)
