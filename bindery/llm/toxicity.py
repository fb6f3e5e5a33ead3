"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Items of a text are its words in lower case and their stems (first bytes), pairs
of neighbours, and pairs one or two words apart; each is present or not.  FTRL
keeps a learning rate per coordinate, and its L1 term leaves most weights at
exactly zero, so a model is a few thousand (bucket, weight) pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ._labelled import batches, one_each, sample, with_score
from ._text import U64, Words, column_bytes, mix, pair, span_hashes

BITS = 20
_NOT_WORD = np.ones(256, bool)
_NOT_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def items(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every item of every text; a null or empty text has none."""
    words = Words(*column_bytes(pc.utf8_lower(column)), blank=_NOT_WORD)
    h, doc = words.hashes, words.doc
    found, where = [mix(h, 1)], [doc]
    for size in (5, 6):
        found.append(mix(span_hashes(words.data, words.starts, np.minimum(words.ends, words.starts + size)), 1 + size))
        where.append(doc)
    for gap in (1, 2, 3):
        at = words.starts_of(gap + 1)
        found.append(pair(h[at], h[at + gap], 10 + gap) if len(at) else np.empty(0, np.uint64))
        where.append(doc[at])
    return np.concatenate(where), (np.concatenate(found) >> U64(64 - BITS)).astype(np.int64)


@dataclass(frozen=True)
class SparseModel:
    """Buckets with a weight, ascending, and the intercept."""

    bucket: np.ndarray
    weight: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.bucket] = self.weight
        return out

    def score(self, column: pa.Array, dense: np.ndarray) -> np.ndarray:
        doc, bucket = items(column)
        weighed = dense[bucket] != 0
        once = np.unique(doc[weighed] << BITS | bucket[weighed])
        total = np.bincount(once >> BITS, weights=dense[once & (1 << BITS) - 1], minlength=len(column))
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -50, 50)))


def ftrl(rows: list[np.ndarray], y: np.ndarray, passes: int = 4, alpha: float = 1.0, beta: float = 1.0, l1: float = 6.0, l2: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights by bucket and intercept, one row at a time in an order fixed by the row count."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb, nb = 0.0, 0.0
    rng = np.random.Generator(np.random.PCG64(7))
    for _ in range(passes):
        for i in rng.permutation(len(rows)):
            at = rows[i]
            za, na = z[at], n[at]
            root = np.sqrt(na)
            w = np.where(np.abs(za) <= l1, 0.0, -(za - np.sign(za) * l1) / ((beta + root) / alpha + l2))
            wb = -zb / ((beta + nb**0.5) / alpha)
            g = 1 / (1 + np.exp(-min(50.0, max(-50.0, float(w.sum()) + wb)))) - y[i]
            more = na + g * g
            z[at] = za + g - (np.sqrt(more) - root) / alpha * w
            n[at] = more
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / alpha * wb
            nb += g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    return w, -zb / ((beta + nb**0.5) / alpha)


def _item_rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for lo, hi in batches(part["text"]):
            doc, bucket = items(part["text"].slice(lo, hi - lo))
            once = np.unique(doc << BITS | bucket)
            cut = np.searchsorted(once, np.arange(hi - lo + 1) << BITS).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cut), pa.array((once & (1 << BITS) - 1).astype(np.int32)))
            yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"].slice(lo, hi - lo), "label": part["label"].slice(lo, hi - lo), "items": lists})


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", bound: int = 8_000) -> SparseModel:
    """Fit on at most about `bound` labelled documents of either label; the intercept is set right for all labelled rows.

    Rows of one id are one document: that with the least items.  Rows without an id have
    no label; without rows of both labels the score is their rate.  The driver holds the
    items of the sample's whole texts, so its memory is bounded by `bound` times these.
    """
    size = {r["label"]: r["count"] for r in sample(labels, id_col, label, 1 << 62).groupBy("label").count().collect()}
    if not size.get(0) or not size.get(1):
        rate = (size.get(1, 0) + 0.5) / (sum(size.values()) + 1.0)
        return SparseModel(np.empty(0, np.int64), np.empty(0), float(np.log(rate / (1 - rate))))
    chosen = None
    for y in (0, 1):
        some = sample(labels.where(F.col(label) == y), id_col, label, bound)
        chosen = some if chosen is None else chosen.unionByName(some)
    chosen = chosen.groupBy("doc_id").agg(F.min("label").alias("label"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text").mapInArrow(_item_rows, "doc_id long, label int, items array<int>")
    got = one_each(rows, "items").toArrow().combine_chunks()
    lists = got["items"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) and lists.num_chunks else lists
    cut, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    order = np.lexsort((np.diff(cut), got["doc_id"].to_numpy()))
    y = got["label"].to_numpy().astype(float)[order]
    if not 0 < y.sum() < len(y):
        rate = (size[1] + 0.5) / (sum(size.values()) + 1.0)
        return SparseModel(np.empty(0, np.int64), np.empty(0), float(np.log(rate / (1 - rate))))
    w, bias = ftrl([flat[cut[i] : cut[i + 1]] for i in order], y)
    bias += float(np.log(size[1] / size[0]) - np.log(y.sum() / (len(y) - y.sum())))
    bucket = np.flatnonzero(w)
    return SparseModel(bucket, w[bucket], bias)


def score(docs: DataFrame, model: SparseModel, text_col: str = "text", output: str = "score") -> DataFrame:
    """`docs` with the column `output`: the probability that the whole text is toxic.

    A null or empty text has the intercept's score, an empty table stays empty.  Other
    columns are kept; an `output` column that is there already is replaced (by exact name).
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scorer():
        dense = held.value.dense()
        return lambda text: held.value.score(text, dense)

    return with_score(docs, text_col, output, scorer)
