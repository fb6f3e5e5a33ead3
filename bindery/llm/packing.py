"""Packing: first-fit decreasing with a tournament tree of bin capacities, in random groups.

Documents are dealt by a hash of their id and text into groups of a few MB of text; each
group is tokenised and packed by itself, in one task, in bounded memory.  What
fills a sequence on its own is cut off first; first-fit decreasing places the
rests.  Then the emptiest bins are cut up to fill the gaps of the others, and a
group's last bin is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _chunks as C
from ._text import column_bytes
from ._tokens import word_tokenizer

RESULT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class CapacityTree:
    """Free room of bins; finds the leftmost bin with enough, in log(bins) steps."""

    def __init__(self, bins: int, room: int):
        self.size = 1 << max(0, (bins - 1).bit_length())
        self.room = [room] * (2 * self.size)

    def place(self, need: int) -> int:
        room, at = self.room, 1
        if room[1] < need:
            raise ValueError("no bin has enough room")
        while at < self.size:
            at *= 2
            if room[at] < need:
                at += 1
        found = at - self.size
        room[at] -= need
        while at > 1:
            at >>= 1
            best = max(room[2 * at], room[2 * at + 1])
            if room[at] == best:
                break
            room[at] = best
        return found


def pack_lengths(lengths: list[int], limit: int) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length): every token once, all full but for powers of two."""
    full, rests = [], []
    for doc, n in enumerate(lengths):
        whole = n // limit * limit
        full += [[(doc, at, limit)] for at in range(0, whole, limit)]
        if n > whole:
            rests.append((n - whole, doc, whole))
    rests.sort(key=lambda r: (-r[0], r[1]))
    tree = CapacityTree(len(rests), limit)
    bins: list[list[tuple[int, int, int]]] = []
    for n, doc, at in rests:
        k = tree.place(n)
        if k == len(bins):
            bins.append([])
        bins[k].append((doc, at, n))
    open_bins = sorted(([limit - sum(p[2] for p in b), b] for b in bins), key=lambda x: x[0])
    lo, hi = 0, len(open_bins) - 1
    while lo < hi:
        gap, taker = open_bins[lo]
        if not gap:
            lo += 1
            continue
        giver = open_bins[hi][1]
        doc, at, n = giver.pop()
        move = min(gap, n)
        taker.append((doc, at + n - move, move))
        if move < n:
            giver.append((doc, at, n - move))
        open_bins[lo][0] -= move
        open_bins[hi][0] += move
        hi -= not giver
    out = full + [b for _, b in open_bins if b]
    if open_bins and open_bins[lo][1] and 0 < open_bins[lo][0] < limit:
        out.remove(open_bins[lo][1])
        out += _powers_of_two(open_bins[lo][1])
    return out


def _powers_of_two(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    pieces, out, left = pieces[::-1], [], sum(p[2] for p in pieces)
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        sequence = []
        while room:
            doc, at, n = pieces.pop()
            take = min(room, n)
            sequence.append((doc, at, take))
            if take < n:
                pieces.append((doc, at + take, n - take))
            room -= take
        out.append(sequence)
    return out


def _pack(tokenizer: str, end: int, limit: int, with_ids: bool):
    def pack(table: pa.Table) -> pa.Table:
        table = C.by_document(table)
        ids, counts = word_tokenizer(tokenizer).encode(*column_bytes(table["text"]), end)
        first = np.cumsum(counts) - counts
        doc, start, length, sequence, offset, checks, texts = [], [], [], [], [], [], []
        raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
        for number, pieces in enumerate(pack_lengths(counts.tolist(), limit)):
            filled = 0
            for d, at, n in pieces:
                lo = int(first[d]) + at
                doc.append(d)
                start.append(at)
                length.append(n)
                sequence.append(number)
                offset.append(filled)
                checks.append(zlib.crc32(raw[4 * lo : 4 * (lo + n)]))
                if with_ids:
                    texts.append(ids[lo : lo + n])
                filled += n
        doc = np.array(doc, np.int64)
        columns = {"doc_id": table["doc_id"].combine_chunks().take(pa.array(doc)), "start": start, "length": length, "ids_crc32": checks, "doc_tokens": counts[doc], "sequence_id": np.array(sequence, np.int64) + (table["_chunk"][0].as_py() << 32), "offset": offset}
        out = pa.table({k: v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v, pa.int64()) for k, v in columns.items()})
        return out.append_column("ids", pa.array(texts, pa.list_(pa.int32()))) if with_ids else out

    return pack


def pack_sequences(docs: DataFrame, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, with_ids: bool = False) -> DataFrame:
    """Pack all documents into sequences of at most `limit` tokens.

    Returns RESULT, one row per piece of a document: its place in the document
    and in its sequence, and the CRC-32 of its ids (little-endian 32-bit); with
    `with_ids` also the ids.  `tokenizer` is the path of a vocabulary file whose
    splitter never crosses white space, which every executor can read; `end` is
    the id that closes each document.

    Null and empty texts are documents of one token.  Repeated rows are separate
    documents under the same id, dealt by text and input partition, so that no id is
    one group.  Null ids stay null.  An empty table gives an
    empty result; other columns are ignored, whatever their names.
    """
    total = C.text_bytes(docs, text_col)
    texts = C.chunked(docs, id_col, text_col, total)
    return texts.groupBy("_chunk").applyInArrow(_pack(tokenizer, end, limit, with_ids), RESULT + (", ids array<int>" if with_ids else ""))
