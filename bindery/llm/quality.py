"""Quality classifier: gradient-boosted trees over statistics of whole documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._boost import FlatTrees, fit
from ._labelled import batches, one_each, sample, with_score
from ._text import Words, column_bytes

FEATURES = (
    "log_bytes", "log_words", "bytes_per_word", "long_words", "short_words", "upper", "lower", "digit", "space", "newline", "other_ascii", "beyond_ascii",
    "bar", "stop", "comma", "mark", "hash_percent", "odd_symbols", "angle", "words_of_symbols", "words_ending_odd", "words_upper", "words_capital",
    "distinct_words", "same_as_last", "same_pair", "distinct_pairs", "top_word", "words_per_line", "lines_repeated", "words_per_stop", "slashes",
)


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(chars.encode())] = 1
    return out


_UPPER, _LOWER, _DIGIT = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("abcdefghijklmnopqrstuvwxyz"), _class("0123456789")
_ODD = _class("#$%&*@^~{}[]<>=+\\|`_!")
_BYTE_CLASSES = [_UPPER, _LOWER, _DIGIT, _class(" "), _class("\n"), _class("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"), (np.arange(256) >= 0xC0).astype(np.uint8), _class("|"), _class("."), _class(","), _class("!?"), _class("#%"), _class("$&*@^~"), _class("<>"), _class("/\\")]
_ALNUM = _UPPER | _LOWER | _DIGIT | (np.arange(256) >= 0x80).astype(np.uint8)


def features(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """One row of FEATURES for each text; a null or empty text has zeros."""
    data, offsets = column_bytes(column)
    n = len(offsets) - 1
    words = Words(data, offsets)
    size, count = np.diff(offsets), words.counts
    per = lambda flags: (lambda c: c[offsets[1:]] - c[offsets[:-1]])(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)]))
    by = lambda v: np.bincount(words.doc, weights=v, minlength=n)
    share = lambda a, b: a / np.maximum(b, 1)
    kinds = [per(k[data]) for k in _BYTE_CLASSES]
    out = {"log_bytes": np.log1p(size), "log_words": np.log1p(count), "bytes_per_word": share(size, count)}
    length = words.ends - words.starts
    out |= {"long_words": share(by(length > 14), count), "short_words": share(by(length < 3), count)}
    upper, lower, digit, space, newline, other, beyond, bar, stop, comma, mark, hashes, odd, angle, slash = kinds
    out |= {k: share(v, size) for k, v in (("upper", upper), ("lower", lower), ("digit", digit), ("space", space), ("newline", newline), ("other_ascii", other), ("beyond_ascii", beyond), ("bar", bar), ("stop", stop), ("comma", comma), ("mark", mark), ("hash_percent", hashes), ("odd_symbols", odd), ("angle", angle), ("slashes", slash))}
    alnum, ups = np.concatenate([[0], np.cumsum(_ALNUM[data], dtype=np.int64)]), np.concatenate([[0], np.cumsum(_UPPER[data], dtype=np.int64)])
    downs = np.concatenate([[0], np.cumsum(_LOWER[data], dtype=np.int64)])
    s, e = words.starts, words.ends
    out["words_of_symbols"] = share(by(alnum[e] == alnum[s]), count)
    out["words_ending_odd"] = share(by(_ODD[data[e - 1]]) if len(e) else np.zeros(n), count)
    out["words_upper"] = share(by((downs[e] == downs[s]) & (ups[e] - ups[s] > 1)), count)
    out["words_capital"] = share(by(_UPPER[data[s]]) if len(s) else np.zeros(n), count)

    def repeats(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct items and the most frequent one's count, per document."""
        order = np.lexsort((h, doc)) if len(h) else np.empty(0, np.int64)
        hs, ds = h[order], doc[order]
        new = np.ones(len(hs), bool)
        new[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
        first = np.flatnonzero(new)
        most = np.zeros(n)
        np.maximum.at(most, ds[first], np.diff(np.append(first, len(hs))))
        return np.bincount(ds[first], minlength=n), most

    distinct, most = repeats(words.hashes, words.doc)
    out["distinct_words"], out["top_word"] = share(distinct, count), share(most, count)
    same = np.zeros(len(words.hashes))
    same[1:] = (words.hashes[1:] == words.hashes[:-1]) & (words.doc[1:] == words.doc[:-1])
    out["same_as_last"] = share(by(same), count)
    at = words.starts_of(2)
    if len(at):
        pairs = words.hashes[at] * np.uint64(0x9E3779B97F4A7C15) ^ words.hashes[at + 1]
        distinct, most = repeats(pairs, words.doc[at])
        out["distinct_pairs"], out["same_pair"] = share(distinct, count - 1), share(most, count - 1)
    else:
        out["distinct_pairs"] = out["same_pair"] = np.zeros(n)
    out["words_per_line"] = count / (newline + 1)
    out["words_per_stop"] = np.log1p(count / (stop + 1))
    # share of the words that come again as the first of 4 equal words: repeated lines and passages
    at = words.starts_of(4)
    if len(at):
        h = words.hashes
        four = ((h[at] * np.uint64(3) + h[at + 1]) * np.uint64(0x9E3779B97F4A7C15) + h[at + 2]) * np.uint64(0xBF58476D1CE4E5B9) + h[at + 3]
        distinct, _ = repeats(four, words.doc[at])
        out["lines_repeated"] = 1 - share(distinct, np.bincount(words.doc[at], minlength=n))
        out["lines_repeated"][np.bincount(words.doc[at], minlength=n) == 0] = 0
    else:
        out["lines_repeated"] = np.zeros(n)
    return np.stack([np.asarray(out[f], float) for f in FEATURES], 1)


def _feature_rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for lo, hi in batches(part["text"]):
            x = features(part["text"].slice(lo, hi - lo))
            yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"].slice(lo, hi - lo), "label": part["label"].slice(lo, hi - lo), "x": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))})


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", bound: int = 20_000, trees: int = 80, depth: int = 4) -> FlatTrees:
    """Fit on a sample of at most about `bound` labelled documents; only their FEATURES reach the driver.

    Rows of one id are one document: that with the least features.  Rows without an id
    have no label; without labelled rows, or with one label alone, the score is a constant.
    """
    chosen = sample(labels, id_col, label, bound)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text").mapInArrow(_feature_rows, "doc_id long, label int, x array<double>")
    got = one_each(rows, "x").toArrow()
    x = np.asarray(got["x"].combine_chunks().flatten()).reshape(-1, len(FEATURES)) if got.num_rows else np.zeros((0, len(FEATURES)))
    y, ids = got["label"].to_numpy().astype(float), got["doc_id"].to_numpy()
    order = np.lexsort((*x.T[::-1], ids)) if len(ids) else np.empty(0, int)  # the same model whatever the partitions
    return fit(x[order], y[order], trees=trees, depth=depth)


def score(docs: DataFrame, model: FlatTrees, text_col: str = "text", output: str = "score") -> DataFrame:
    """`docs` with the column `output`: the probability of good quality, from the whole text.

    A null or empty text is scored from features of zero, an empty table stays empty.
    Other columns are kept; an `output` column that is there already is replaced (by exact name).
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    return with_score(docs, text_col, output, lambda: lambda text: held.value.score(features(text)))
