"""Line dedup: sharded minimal perfect hashes over distinct lines, probed instead of joined.

Each shard owns a range of 64-bit line hashes.  Its index is one row of a table: a
LineIndex over the distinct lines that two documents or more hold, a minimal
perfect hash (levels of bit arrays with ranks) that maps a line to a slot of
compact arrays: a 48-bit fingerprint, the number of documents and the largest
document.  Most lines of a corpus stand in one document and are not in the index;
the fingerprint turns them away.

`line_index` builds the table, `drop_lines` lets chunks of documents probe the
arrays with their distinct line hashes and learn which lines to drop;
`drop_common_lines` does both over one exchange of the texts.  A line that is not
in the index is taken for one that is with odds of 2**-48; two distinct lines of the
corpus are confused with odds of about (lines squared) / 2**65.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import _chunks as C
from ._text import ASCII_LOWER, U64, column_bytes, mix, pack_sorted, runs, span_hashes, unpack_sorted, word_spans

RESULT = "doc_id long, n_lines long, n_dropped long, kept_text string"
INDEX = "_shard int, shards int, lines long, index binary"


def _fingerprint(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """48 bits of a hash that the places in the levels do not depend on, as two arrays."""
    other = mix(keys, 999)
    return (other >> U64(48)).astype(np.uint16), (other >> U64(16)).astype(np.uint32)


class LineIndex:
    """Immutable map from distinct 64-bit hashes to small arrays, without storing the hashes."""

    def __init__(self, keys: np.ndarray, count: np.ndarray, largest: np.ndarray):
        words, rest, level = [], keys, 0
        while len(rest):
            bits = max(64, 2 * len(rest) + 63 & ~63)
            place = mix(rest, 1000 + level) % U64(bits)
            alone = np.bincount(place.astype(np.int64), minlength=bits) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            rest, level = rest[~alone[place.astype(np.int64)]], level + 1
            if level > 200:
                raise ValueError("the keys of a LineIndex must be distinct")
        self._ranked(words)
        slot = self._slots(keys)
        self.high, self.low = np.zeros(self.filled, np.uint16), np.zeros(self.filled, np.uint32)
        self.count, self.largest = np.zeros(self.filled, np.uint32), np.zeros(self.filled, np.uint64)
        self.high[slot], self.low[slot] = _fingerprint(keys)
        self.count[slot], self.largest[slot] = count, largest

    def _ranked(self, words: list[np.ndarray]) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        self.filled = 0
        for w in words:
            rank = np.concatenate([[0], np.cumsum(np.bitwise_count(w), dtype=np.int64)])
            self.levels.append((w, rank, self.filled))
            self.filled += int(rank[-1])

    def to_bytes(self) -> bytes:
        return C.join_parts(*(a.tobytes() for a in (self.high, self.low, self.count, self.largest)), *(w.tobytes() for w, _, _ in self.levels))

    @classmethod
    def from_bytes(cls, blob: bytes) -> LineIndex:
        self = cls.__new__(cls)
        high, low, count, largest, *words = C.split_parts(blob)
        self._ranked([np.frombuffer(w, "<u8") for w in words])
        self.high, self.low, self.count, self.largest = np.frombuffer(high, "<u2"), np.frombuffer(low, "<u4"), np.frombuffer(count, "<u4"), np.frombuffer(largest, "<u8")
        return self

    def _slots(self, probes: np.ndarray) -> np.ndarray:
        slot = np.full(len(probes), -1, np.int64)
        rest = np.arange(len(probes))
        for level, (words, rank, filled) in enumerate(self.levels):
            place = mix(probes[rest], 1000 + level) % U64(64 * len(words))
            word, bit = (place >> U64(6)).astype(np.int64), place & U64(63)
            here = words[word] >> bit & U64(1) == 1
            below = np.bitwise_count(words[word] & ((U64(1) << bit) - U64(1)))
            slot[rest[here]] = (filled + rank[word] + below)[here]
            rest = rest[~here]
        return slot

    def lookup(self, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents that hold each line, and the largest of them; 0 for an unknown line (but for one in 2**48 of those)."""
        if not self.filled:
            return np.zeros(len(probes), np.uint32), np.zeros(len(probes), np.uint64)
        slot = self._slots(probes)
        high, low = _fingerprint(probes)
        known = (slot >= 0) & (self.high[slot] == high) & (self.low[slot] == low)
        return np.where(known, self.count[slot], 0), np.where(known, self.largest[slot], U64(0))


class _Lines:
    """Lines of a chunk; `data` ends every document with a newline."""

    def __init__(self, table: pa.Table, least: int):
        text = pc.binary_join_element_wise(table["text"].fill_null(""), "", "\n")
        self.data, offsets = column_bytes(text)
        self.ends = np.flatnonzero(self.data == 10)
        self.starts = np.concatenate([[0], self.ends[:-1] + 1]) if len(self.ends) else np.empty(0, np.int64)
        self.doc = np.searchsorted(offsets, self.starts, "right") - 1
        word_starts, word_ends, _ = word_spans(self.data, offsets)
        words = np.searchsorted(word_starts, np.concatenate([self.starts, [len(self.data)]]))
        filled = np.flatnonzero(np.diff(words))
        begin, end = word_starts[words[filled]], word_ends[words[filled + 1] - 1]
        points = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])
        long = points[end] - points[begin] >= least
        self.keyed = filled[long]  # numbers of the lines that have a key
        self.hash = span_hashes(ASCII_LOWER[self.data], begin[long], end[long])


def _send(least: int, documents: int, shards: int):
    def send(table: pa.Table) -> pa.Table:
        """To each shard, the chunk's distinct lines, and of each the `documents` largest ids that hold it: more do not matter."""
        lines = _Lines(table, least)
        ids = C.order_key(table["doc_id"])[lines.doc[lines.keyed]]
        order = np.lexsort((ids, lines.hash))
        value, ids = lines.hash[order], ids[order]
        if not len(value):
            return C.blobs(0, [])
        new, other = np.ones((2, len(value)), bool)
        new[1:] = value[1:] != value[:-1]
        other[1:] = new[1:] | (ids[1:] != ids[:-1])
        value, ids, new = value[other], ids[other], new[other]
        first = np.flatnonzero(new)
        n = np.diff(first, append=len(value))
        kept = np.minimum(n, documents)
        ids = ids[np.repeat(first + n - kept, kept) + runs(kept)]
        value, at = value[first], np.concatenate([[0], np.cumsum(kept)])
        rows = [(s, C.join_parts(pack_sorted(value[x]), C.pack_plain(kept[x].astype(np.uint64)), C.pack_plain(ids[at[x.start] : at[x.stop]]))) for s, x in C.split_range(value, 64, shards)]
        return C.blobs(table["_chunk"][0].as_py(), rows)

    return send


def _build(shards: int):
    def build(table: pa.Table) -> pa.Table:
        sent = [C.split_parts(b) for b in table["blob"].to_pylist()]
        n = np.concatenate([C.unpack_plain(b[1]) for b in sent]).astype(np.int64)
        value = np.repeat(np.concatenate([unpack_sorted(b[0]) for b in sent]), n)
        ids = np.concatenate([C.unpack_plain(b[2]) for b in sent])
        order = np.lexsort((ids, value))
        value, ids = value[order], ids[order]
        new, other = np.ones((2, len(value)), bool)
        new[1:] = value[1:] != value[:-1]
        other[1:] = new[1:] | (ids[1:] != ids[:-1])
        first = np.flatnonzero(new)
        count = np.add.reduceat(other.astype(np.int64), first)
        largest = ids[np.append(first[1:], len(ids)) - 1]
        some = count > 1
        index = LineIndex(value[first][some], count[some], largest[some])
        return pa.table({"_shard": table["_shard"].slice(0, 1), "shards": pa.array([shards], pa.int32()), "lines": pa.array([index.filled], pa.int64()), "index": pa.array([index.to_bytes()], pa.binary())})

    return build


def _probe(documents: int):
    def probe(sent: pa.Table, stored: pa.Table) -> pa.Table:
        """Each chunk's lines that the shard's arrays know to stand in enough documents, and their largest holder."""
        out, to = [], []
        if sent.num_rows and stored.num_rows:
            index, shard = LineIndex.from_bytes(stored["index"][0].as_py()), sent["_shard"][0].as_py()
            for chunk, blob in zip(sent["_chunk"].to_pylist(), sent["blob"], strict=True):
                mine = unpack_sorted(C.split_parts(blob.as_py())[0])
                count, largest = index.lookup(mine)
                common = count >= documents
                if common.any():
                    out.append((shard, C.join_parts(pack_sorted(mine[common]), C.pack_plain(largest[common]))))
                    to.append(chunk)
        return C.blobs(0, out).set_column(0, "_chunk", pa.array(to, pa.int64()))

    return probe


def _drop(least: int, keep: int):
    extra = [f"_keep{i}" for i in range(keep)]

    def drop(table: pa.Table, answer: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_lines": pa.array([], pa.int64()), "n_dropped": pa.array([], pa.int64()), "kept_text": pa.array([], pa.string())} | {c: table[c] for c in extra})
        table = C.by_document(table)
        lines = _Lines(table, least)
        gone = np.zeros(len(lines.ends), bool)
        if answer.num_rows:
            got = [C.split_parts(b) for b in answer["blob"].to_pylist()]
            value = np.concatenate([unpack_sorted(b[0]) for b in got])
            holder = np.concatenate([C.unpack_plain(b[1]) for b in got])
            order = np.argsort(value)
            value, holder = value[order], holder[order]
            at = np.searchsorted(value, lines.hash)
            at[at == len(value)] = 0
            gone[lines.keyed] = (value[at] == lines.hash) & (holder[at] != C.order_key(table["doc_id"])[lines.doc[lines.keyed]])
        rows = table.num_rows
        mark = np.zeros(len(lines.data) + 1, np.int8)
        mark[lines.starts[~gone]] += 1
        mark[lines.ends[~gone] + 1] -= 1
        taken = lines.data[np.cumsum(mark[:-1], dtype=np.int8) > 0]
        size = np.bincount(lines.doc[~gone], weights=(lines.ends + 1 - lines.starts)[~gone], minlength=rows).astype(np.int64)
        taken = np.delete(taken, np.cumsum(size)[size > 0] - 1)  # no newline after a document's last line
        size[size > 0] -= 1
        n = np.bincount(lines.doc, minlength=rows)
        return pa.table({"doc_id": table["doc_id"], "n_lines": pa.array(n), "n_dropped": pa.array(np.bincount(lines.doc[gone], minlength=rows)), "kept_text": C.string_array(taken, size)} | {c: table[c] for c in extra})

    return drop


def _sent(texts: DataFrame, least: int, documents: int, shards: int) -> DataFrame:
    return texts.groupBy("_chunk").applyInArrow(_send(least, documents, shards), C.BLOBS)


def _dropped(docs: DataFrame, texts: DataFrame, sent: DataFrame, index: DataFrame, documents: int, least: int, keep: tuple[str, ...]) -> DataFrame:
    common = sent.groupBy("_shard").cogroup(index.groupBy("_shard")).applyInArrow(_probe(documents), C.BLOBS)
    schema = RESULT + "".join(f", _keep{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    return texts.groupBy("_chunk").cogroup(common.groupBy("_chunk")).applyInArrow(_drop(least, len(keep)), schema).withColumnsRenamed({f"_keep{i}": c for i, c in enumerate(keep)})


def line_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", documents: int = 3, least: int = 20) -> DataFrame:
    """INDEX, one row per shard that has lines: the arrays over its lines, to be stored and probed.

    Counts are exact up to `documents`, and at least that beyond.  An empty table, or
    one without lines of `least` code points, gives no rows.
    """
    total = C.text_bytes(docs, text_col)
    shards = C.shards_for(total // 64)
    return _sent(C.chunked(docs, id_col, text_col, total), least, documents, shards).groupBy("_shard").applyInArrow(_build(shards), INDEX)


def drop_lines(docs: DataFrame, index: DataFrame, id_col: str = "doc_id", text_col: str = "text", documents: int = 3, least: int = 20, keep: tuple[str, ...] = ()) -> DataFrame:
    """`docs` without the lines that a stored index knows from `documents` documents, except in the largest of these; see drop_common_lines."""
    one = index.select("shards").first()
    total = C.text_bytes(docs, text_col)
    texts = C.chunked(docs, id_col, text_col, total, keep)
    return _dropped(docs, texts, _sent(texts, least, documents, one["shards"] if one else 1), index, documents, least, keep)


def drop_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", documents: int = 3, least: int = 20, keep: tuple[str, ...] = ()) -> DataFrame:
    """Drop lines found in at least `documents` documents, except in the largest id that holds them.

    A line's key is the line without white space at its ends and with A-Z in
    lower case; lines whose key has fewer than `least` code points always stay.
    Returns RESULT and the columns `keep`, one row per input row; `kept_text`
    joins the lines that stay.

    A null or empty text is one empty line.  Rows with one id are one document
    when documents are counted, and each keeps its own row; a null id is the
    smallest.  An empty table gives an empty result; other columns are ignored,
    whatever their names.
    """
    total = C.text_bytes(docs, text_col)
    shards = C.shards_for(total // 64)
    texts = C.chunked(docs, id_col, text_col, total, keep)
    sent = _sent(texts, least, documents, shards)
    index = sent.groupBy("_shard").applyInArrow(_build(shards), INDEX)
    return _dropped(docs, texts, sent, index, documents, least, keep)
