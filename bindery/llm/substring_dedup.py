"""Substring dedup: exact repeats of `width` or more words, by fixed-block anchors.

Index: every document is cut into non-overlapping blocks of width // 2 words,
so any `width` consecutive words hold a whole block.  Probe: every rolling
window of that many words asks whether a block elsewhere (or elsewhere in the
same document) has the same words.  Extend: around each hit, the hash of every
`width`-word window that holds it is compared with its earliest occurrence;
the union of the windows that start earlier somewhere is the maximal repeat.

Both questions go through hash shards (see _chunks): anchors with 46-bit
hashes, where a false hit only costs an extension, windows with 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import _chunks as C
from ._text import U64, Words, column_bytes, contains, pack_sorted, unpack_sorted, windows

_ANCHOR_BITS = 46
RESULT = "doc_id long, n_words long, n_removed long, removed array<struct<start:int,length:int>>, kept_text string"


def _anchors(words: Words, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of the rolling block windows, and their anchor hashes."""
    at = words.starts_of(block)
    return at, windows(words.hashes, block, 7)[at] >> U64(64 - _ANCHOR_BITS)


def _send_anchors(block: int, shards: int):
    def send(table: pa.Table) -> pa.Table:
        words = Words(*column_bytes(table["text"]))
        at, value = _anchors(words, block)
        aligned = (at - words.first[words.doc[at]]) % block == 0
        value = np.sort(value << U64(1) | aligned)
        last = np.flatnonzero(np.diff(value >> U64(1), append=U64(2**64 - 1)))
        many = np.diff(last, prepend=-1) > 1
        # per distinct hash: occurs twice here, is a block here (sorted last in its run)
        sent = (value[last] >> U64(1)) << U64(2) | many.astype(np.uint64) << U64(1) | value[last] & U64(1)
        return C.blobs(table["_chunk"][0].as_py(), [(s, pack_sorted(sent[x])) for s, x in C.split_range(sent >> U64(2), _ANCHOR_BITS, shards)])

    return send


def _gather(table: pa.Table) -> tuple[list[int], list[bytes]]:
    return table["_chunk"].to_pylist(), table["blob"].to_pylist()


def _runs_of(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorting order, first place of each run of equal values, run of each sorted place."""
    order = np.argsort(value)
    ranked = value[order]
    new = np.ones(len(value), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _answer(chunks: list[int], parts: list[np.ndarray], chosen: np.ndarray, shard: int) -> pa.Table:
    out, at, to = [], 0, []
    for chunk, part in zip(chunks, parts, strict=True):
        mine = part[chosen[at : at + len(part)]]
        at += len(part)
        if len(mine):
            out.append((shard, pack_sorted(mine)))
            to.append(chunk)
    return C.blobs(0, out).set_column(0, "_chunk", pa.array(to, pa.int64()))


def _hit_anchors(table: pa.Table) -> pa.Table:
    chunks, sent = _gather(table)
    sent = [unpack_sorted(b) for b in sent]
    parts = [x >> U64(2) for x in sent]
    flags = np.concatenate(sent)
    order, first, run = _runs_of(np.concatenate(parts))
    flags = flags[order]
    block = np.bitwise_or.reduceat(flags, first) & U64(3)
    n = np.diff(first, append=len(flags))
    hit = (block & U64(1) > 0) & ((n > 1) | (block & U64(2) > 0))
    chosen = np.empty(len(order), bool)
    chosen[order] = hit[run]
    return _answer(chunks, parts, chosen, table["_shard"][0].as_py())


def _received(table: pa.Table) -> np.ndarray:
    got = [unpack_sorted(b) for b in table["blob"].to_pylist()]
    return np.sort(np.concatenate(got)) if got else np.empty(0, np.uint64)


def _send_windows(width: int, block: int, shards: int):
    def send(table: pa.Table, answer: pa.Table) -> pa.Table:
        if not table.num_rows or not answer.num_rows:
            return C.blobs(0, [])
        table = C.by_document(table)
        words = Words(*column_bytes(table["text"]))
        at, value = _anchors(words, block)
        hits = np.zeros(len(words.hashes) + 1, np.int64)
        hits[1 + at[contains(_received(answer), value)]] = 1
        hits = np.cumsum(hits)
        start = words.starts_of(width)
        start = start[hits[start + width - block + 1] > hits[start]]  # a hit block window inside
        value = windows(words.hashes, width, 11)[start] if len(start) else np.empty(0, np.uint64)
        order, first, _ = _runs_of(value)
        if not len(first):
            return C.blobs(0, [])
        owner = np.minimum.reduceat(words.doc[start][order], first)
        value = value[order][first]
        ids, subs = C.order_key(table["doc_id"]), C.order_key(table["_sub"])
        rows = []
        for s, x in C.split_range(value, 64, shards):
            docs, which = np.unique(owner[x], return_inverse=True)  # the owners are few: a list of them, and numbers
            rows.append((s, C.join_parts(pack_sorted(value[x]), C.pack_plain(which.astype(np.uint64)), C.pack_plain(ids[docs]), C.pack_plain(subs[docs]))))
        return C.blobs(table["_chunk"][0].as_py(), rows)

    return send


def _not_first(table: pa.Table) -> pa.Table:
    """To each chunk, the windows that start in an earlier document of another chunk; earlier by id, then by `_sub`."""
    chunks, sent = _gather(table)
    sent = [C.split_parts(b) for b in sent]
    parts = [unpack_sorted(b[0]) for b in sent]
    which = [C.unpack_plain(b[1]).astype(np.int64) for b in sent]
    ids, subs = (np.concatenate([C.unpack_plain(b[k])[w] for b, w in zip(sent, which, strict=True)]) for k in (2, 3))
    value = np.concatenate(parts)
    order = np.lexsort((subs, ids, value))
    value, ids, subs = value[order], ids[order], subs[order]
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    least = np.flatnonzero(new)[np.cumsum(new) - 1]
    chosen = np.empty(len(order), bool)
    chosen[order] = (ids != ids[least]) | (subs != subs[least])
    return _answer(chunks, parts, chosen, table["_shard"][0].as_py())


def _cut(width: int):
    def cut(table: pa.Table, answer: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "removed": pa.array([], pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))), "kept_text": pa.array([], pa.string())})
        table = C.by_document(table)
        text = pc.binary_join_element_wise(table["text"].fill_null(""), "", " ")  # a blank after every word
        data, offsets = column_bytes(text)
        words = Words(data, offsets)
        start = words.starts_of(width)
        value = windows(words.hashes, width, 11)[start] if len(start) else np.empty(0, np.uint64)
        later = contains(_received(answer), value)
        order = np.argsort(value, kind="stable")
        again = np.zeros(len(value), bool)
        again[1:] = value[order][1:] == value[order][:-1]
        later[order] |= again  # repeats within the chunk, all but the first
        edge = np.zeros(len(words.hashes) + 1, np.int32)
        np.add.at(edge, start[later], 1)
        np.add.at(edge, start[later] + width, -1)
        gone = np.cumsum(edge[:-1]) > 0
        before = np.concatenate([[0], np.cumsum(gone)])
        # removed spans, cut at document ends
        fresh = gone & ~np.concatenate([[False], gone[:-1]])
        fresh[words.first[:-1][words.counts > 0]] |= gone[words.first[:-1][words.counts > 0]]
        opened = np.flatnonzero(fresh)
        length = np.add.reduceat(gone, opened, dtype=np.int64) if len(opened) else np.empty(0, np.int64)
        spans = np.concatenate([[0], np.cumsum(np.bincount(words.doc[opened], minlength=len(words.counts)))]).astype(np.int32)
        removed = pa.ListArray.from_arrays(pa.array(spans, pa.int32()), pa.StructArray.from_arrays([pa.array((opened - words.first[words.doc[opened]]).astype(np.int32)), pa.array(length.astype(np.int32))], ["start", "length"]))
        # kept words with one blank each
        data = data.copy()
        data[words.ends] = 32
        keep = ~gone
        mark = np.zeros(len(data) + 2, np.int8)
        mark[words.starts[keep]] += 1
        mark[words.ends[keep] + 1] -= 1
        taken = data[np.cumsum(mark[:-2], dtype=np.int8) > 0]
        size = np.bincount(words.doc[keep], weights=(words.ends - words.starts + 1)[keep], minlength=len(words.counts)).astype(np.int64)
        end = np.cumsum(size)[size > 0] - 1
        taken = np.delete(taken, end)
        size[size > 0] -= 1
        return pa.table({"doc_id": table["doc_id"], "n_words": pa.array(words.counts), "n_removed": pa.array(np.diff(before[words.first])), "removed": removed, "kept_text": C.string_array(taken, size)})

    return cut


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20) -> DataFrame:
    """Drop every word covered by a window of `width` words that also starts earlier.

    Earlier is a smaller id, or the same document and an earlier start; windows
    are judged on the input.  Returns RESULT, one row per input row: the removed
    spans count words, `kept_text` joins the kept words by one space.

    Null or empty texts have no words and stay as empty texts.  A null id comes
    before all others; rows with one id are ordered by a hash of their text, and rows
    equal in both count as two documents of which the second repeats the first.  Texts
    of fewer than `width` words have no window.  An empty table gives an empty
    result; other columns are ignored, whatever their names.
    """
    if width < 2:
        raise ValueError("width must be at least 2")
    block = width // 2
    total = C.text_bytes(docs, text_col)
    shards = C.shards_for(total // 5)
    texts = C.chunked(docs, id_col, text_col, total)
    chunks = lambda: texts.groupBy("_chunk")
    anchors = chunks().applyInArrow(_send_anchors(block, shards), C.BLOBS).groupBy("_shard").applyInArrow(_hit_anchors, C.BLOBS)
    spans = chunks().cogroup(anchors.groupBy("_chunk")).applyInArrow(_send_windows(width, block, shards), C.BLOBS)
    repeats = spans.groupBy("_shard").applyInArrow(_not_first, C.BLOBS)
    return chunks().cogroup(repeats.groupBy("_chunk")).applyInArrow(_cut(width), RESULT)
