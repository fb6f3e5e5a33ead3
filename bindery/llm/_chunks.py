"""Text chunks and hash shards: how the exact-match operators exchange hashes.

Documents are dealt by their id and a hash of their text into chunks of about
CHUNK_BYTES of text, so an id that many rows share is spread as well; rows equal in
both are dealt by their input partition.  A chunk sends each hash shard one row holding its distinct hashes, sorted and
difference coded (3 to 6 bytes a hash instead of a 40-byte row); the shard
decides, and answers each chunk with one row.  So a key that a third of all
rows share costs one entry per chunk, never one per row, and no task gathers a
key's rows.  The text itself is shuffled once: every pass that needs it groups
by the same chunk column and reuses the exchange.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

CHUNK_BYTES = 4 << 20
TASK_BYTES = 64 << 20
SHARD_VALUES = 1 << 20
BLOBS = "_chunk long, _shard int, blob binary"


def text_bytes(docs: DataFrame, text: str) -> int:
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def shards_for(values: int) -> int:
    return min(1 << 17, max(16, math.ceil(values / SHARD_VALUES)))


def chunked(docs: DataFrame, id_col: str, text: str, total: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, _keep0, ..., _sub, _chunk); only these columns travel, and a task gets about TASK_BYTES.

    `_sub` orders rows of one id: by a hash of their text, then by their input partition.
    """
    n = max(16, math.ceil(total / CHUNK_BYTES))
    tasks = max(min(n, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), math.ceil(total / TASK_BYTES))
    kept = [F.col(f"`{c}`").alias(f"_keep{i}") for i, c in enumerate(keep)]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *kept)
    rows = rows.withColumn("_sub", F.expr("xxhash64(text) & -16777216L | spark_partition_id() & 16777215L"))
    return rows.withColumn("_chunk", F.pmod(F.xxhash64("doc_id", "_sub"), F.lit(n))).repartition(tasks, "_chunk")


def by_document(table: pa.Table) -> pa.Table:
    """A chunk's rows in document order (null ids first; equal ids by `_sub`, then text), which makes 'earlier' a row number."""
    return table.take(pc.sort_indices(table, [("doc_id", "ascending"), ("_sub", "ascending"), ("text", "ascending")], null_placement="at_start"))


def order_key(ids: pa.ChunkedArray) -> np.ndarray:
    """doc_id as uint64 in the same order; null before all."""
    return ids.fill_null(-(2**63)).to_numpy().astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)


def split_range(values: np.ndarray, bits: int, shards: int) -> Iterator[tuple[int, slice]]:
    """Slices of ascending values below 2**bits, by the shard that their range belongs to (bits <= 46 with up to 2**17 shards)."""
    shard = (values * np.uint64(shards)) >> np.uint64(bits) if bits <= 46 else ((values >> np.uint64(bits - 46)) * np.uint64(shards)) >> np.uint64(46)
    cut = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(values)]])
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        if b > a:
            yield int(shard[a]), slice(int(a), int(b))


def blobs(chunk: int, rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"_chunk": pa.array([chunk] * len(rows), pa.int64()), "_shard": pa.array([s for s, _ in rows], pa.int32()), "blob": pa.array([b for _, b in rows], pa.binary())})


def pack_plain(values: np.ndarray) -> bytes:
    """uint64 in any order: least value, then byte planes of the rest above it."""
    low = values.min() if len(values) else np.uint64(0)
    rest = values - low
    width = max(1, (int(rest.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = rest.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return int(low).to_bytes(8, "little") + bytes([width]) + np.ascontiguousarray(planes.T).tobytes()


def unpack_plain(blob: bytes) -> np.ndarray:
    width = blob[8]
    planes = np.frombuffer(blob, np.uint8, offset=9).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view("<u8") + np.uint64(int.from_bytes(blob[:8], "little"))


def join_parts(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def split_parts(blob: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(blob):
        n = int.from_bytes(blob[at : at + 4], "little")
        out.append(blob[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def string_array(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Consecutive byte runs of the given lengths as a string column."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))
