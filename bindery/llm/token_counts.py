"""Token counts: document lengths in flat token files that have no index, by a separator scan.

A flat file is nothing but token ids (little-endian, 16 or 32 bits), documents
one behind the other, each closed by one separator id.  Files are read by byte
ranges of fixed size that know nothing of documents, so a file may have any size.
Every range is searched with one vectorised comparison; what crosses its ends is
stitched by a prefix scan over range summaries (tokens, last separator), in two
levels, so no window holds more than SPAN ranges of a file or a file's spans.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ._labelled import batches
from ._store import shared_folder, written
from ._text import column_bytes
from ._tokens import word_tokenizer

SPAN = 4096
FILE_BLOCKS = 256
#: What one scanning task reads, and how many neighbouring ranges of a file stay together.
TASK_BYTES, NEIGHBOURS = 64 << 20, 16


def _opened(uri: str):
    """(filesystem, path in it) of a path as Spark names it; local, hdfs, s3 and gs folders can be opened."""
    from pyarrow import fs

    uri = re.sub(r"^(\w+):/(?!/)", r"\1:///", re.sub(r"^s3[an]:", "s3:", uri))
    return (fs.LocalFileSystem(), uri[7:]) if uri.startswith("file://") else fs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = 1 << 18, wide: bool = False) -> DataFrame:
    """(file, block, path, at, bytes, ids): flat files of the documents, written now, by ranges of `block_tokens`; several files a partition.

    The files lie in a new folder under the session's shared one and are removed
    with it when the session's JVM ends.  `ids` names, in order, the documents whose
    separator lies in the range; the scan does not use it.  Special tokens in a text
    are ordinary text, so only the writer makes separators.  A null or empty text is
    a separator alone, rows of one id are documents of their own, an empty table
    writes no file, and no other column is read, so their names may be anything.
    Files are numbered by partition: the same input partitions give the same files.
    A file's name belongs to one attempt of a task and counts only by the rows that
    the attempt commits: what a lost executor or a second attempt wrote is never read.
    """
    kind = "<u4" if wide else "<u2"
    folder = f"{shared_folder(docs.sparkSession).rstrip('/')}/bindery-{uuid.uuid4().hex}"

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, attempt = TaskContext.get().partitionId() << 24, uuid.uuid4().hex
        block, held, held_ids, size, sink = 0, [], [], 0, None

        def cut(n: int) -> pa.RecordBatch:
            nonlocal held, size, held_ids, block, sink
            flat = np.concatenate(held)
            ids = np.concatenate(held_ids)
            closed = int((flat[:n] == end).sum())
            path = f"{folder}/{file}-{attempt}.tokens"
            if sink is None:
                system, inside = _opened(path)
                system.create_dir(inside.rpartition("/")[0], recursive=True)
                sink = system.open_output_stream(inside)
            at, data = sink.tell(), flat[:n].astype(kind).tobytes()
            sink.write(data)
            out = pa.RecordBatch.from_pydict({"file": pa.array([file], pa.int64()), "block": pa.array([block], pa.int64()), "path": pa.array([path]), "at": pa.array([at], pa.int64()), "bytes": pa.array([len(data)], pa.int64()), "ids": pa.array([ids[:closed].tolist()], pa.list_(pa.int64()))})
            held, held_ids, size, block = [flat[n:]], [ids[closed:]], len(flat) - n, block + 1
            return out

        for part in parts:
            for lo, hi in batches(part["text"], 4 << 20):
                ids, _ = word_tokenizer(tokenizer, True).encode(*column_bytes(part["text"].slice(lo, hi - lo)), end)
                held.append(ids)
                held_ids.append(np.array(part["doc_id"].slice(lo, hi - lo).to_pylist(), object))
                size += len(ids)
                while size >= block_tokens:
                    yield cut(block_tokens)
                if block >= FILE_BLOCKS:  # the file ends with its last whole document
                    if size:
                        yield cut(size)
                    sink.close()
                    file, block, held, held_ids, size, sink = file + 1, 0, [], [], 0, None
        if size:
            yield cut(size)
        if sink is not None:
            sink.close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return written(rows.mapInArrow(run, "file long, block long, path string, at long, bytes long, ids array<long>"), beside=folder)


def file_blocks(files: DataFrame, block_bytes: int = 1 << 20) -> DataFrame:
    """(file, block, path, at, bytes): byte ranges of stored flat files, from spark.read.format("binaryFile") rows (path, length).

    The content is not read here and no file is held whole.  `block_bytes` must hold
    whole ids; an empty file has no ranges, and so no documents; other columns go.
    """
    starts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(block_bytes).cast("long"))
    ranges = files.where("length > 0").select("path", "length", F.posexplode(starts).alias("block", "at"))
    return ranges.select(F.col("path").alias("file"), F.col("block").cast("long").alias("block"), "path", "at", F.least(F.lit(block_bytes).cast("long"), F.col("length") - F.col("at")).alias("bytes"))


def _spread(blocks: DataFrame) -> DataFrame:
    """The ranges dealt to tasks of about TASK_BYTES, neighbours together."""
    rows, total = blocks.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    tasks = max(1, min(rows, blocks.sparkSession.sparkContext.defaultParallelism), -(-total // TASK_BYTES))
    return blocks.repartition(tasks, "file", F.floor(F.col("block") / NEIGHBOURS)).sortWithinPartitions("file", "block")


def _scan(end: int, kind: str, keep: list[str]):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, source = None, None
        for part in parts:
            n, first, last, starts, lengths = [], [], [], [], []
            for path, start, size in zip(part["path"].to_pylist(), part["at"].to_pylist(), part["bytes"].to_pylist(), strict=True):
                if path != held:
                    system, inside = _opened(path)
                    held, source = path, system.open_input_file(inside)
                data = source.read_at(size, start) if size else b""
                if len(data) != (size or 0):
                    raise EOFError(f"{path} ends before byte {start + size}")
                ids = np.frombuffer(data, kind)
                at = np.flatnonzero(ids == end)
                n.append(len(ids))
                first.append(int(at[0]) if len(at) else None)
                last.append(int(at[-1]) if len(at) else None)
                # of the documents that end here; the first one's are not known yet
                starts.append(np.append(0, at[:-1] + 1) if len(at) else at)
                lengths.append(np.append(0, np.diff(at) - 1) if len(at) else at)
            yield pa.RecordBatch.from_pydict({c: part[c] for c in keep} | {"n": pa.array(n, pa.int64()), "first": pa.array(first, pa.int64()), "last": pa.array(last, pa.int64()), "starts": pa.array(starts, pa.list_(pa.int64())), "lengths": pa.array(lengths, pa.list_(pa.int64()))})

    return run


def count_tokens(blocks: DataFrame, end: int, wide: bool = False, names: str | None = None) -> DataFrame:
    """(file, document, start, n_tokens[, name]): one row per document of flat files, in file order from 0.

    `n_tokens` and `start` (its first token in the file) leave the separator out.
    Tokens behind a file's last separator are a last document; nothing behind it
    is none, so an empty file has no documents, and a file of k separators alone
    has k documents of 0 tokens.  `blocks` has byte ranges (file, block, path, at,
    bytes) as the two functions above give; a range of null or 0 bytes has no tokens,
    one behind the file's end is an error.  Ranges need not be of one size, but
    (file, block) must be unique; no ranges give no documents.  `names`: an array
    column that names, in order, the documents whose separator is in the range.
    """
    keep = ["file", "block", *([names] if names else [])]
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}
    ranges = _spread(blocks.select(*keep, "path", "at", "bytes"))
    found = ranges.mapInArrow(_scan(end, "<u4" if wide else "<u2", keep), "".join(f"{c} {kinds[c]}, " for c in keep) + "n long, first long, last long, starts array<long>, lengths array<long>")
    found = written(found)  # read twice below; the files once
    found = found.withColumn("span", F.floor(F.col("block") / SPAN)).withColumn("ends", F.size("lengths").cast("long"))
    inside = Window.partitionBy("file", "span").orderBy("block")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    local = found.withColumn("before", zero(F.sum("n").over(earlier))).withColumn("ended", zero(F.sum("ends").over(earlier)))
    local = local.withColumn("open", F.max(F.col("before") + F.col("last") + 1).over(earlier))  # behind the last separator so far
    # the same scan over whole spans
    tail = F.max(F.struct("block", F.col("before"), F.col("n"), F.greatest("open", F.col("before") + F.col("last") + 1).alias("open")))
    spans = local.groupBy("file", "span").agg(F.sum("n").alias("span_n"), F.sum("ends").alias("span_ends"), tail.alias("tail"))
    over = Window.partitionBy("file").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("span_before", zero(F.sum("span_n").over(over))).withColumn("span_ended", zero(F.sum("span_ends").over(over)))
    spans = spans.withColumn("span_open", zero(F.max(F.col("span_before") + F.col("tail.open")).over(over)))
    joined = local.join(spans.select("file", "span", "span_before", "span_ended", "span_open"), ["file", "span"])
    at = F.col("span_before") + F.col("before")
    opened = F.coalesce(F.col("span_before") + F.col("open"), F.col("span_open"))
    zipped = F.arrays_zip("starts", "lengths", *([names] if names else []))
    rows = joined.select("file", (F.col("span_ended") + F.col("ended")).alias("base"), at.alias("at"), opened.alias("opened"), "first", F.posexplode(zipped).alias("i", "d"))
    start = F.when(F.col("i") == 0, F.col("opened")).otherwise(F.col("at") + F.col("d.starts"))
    length = F.when(F.col("i") == 0, F.col("at") + F.col("first") - F.col("opened")).otherwise(F.col("d.lengths"))
    ended = rows.select("file", (F.col("base") + F.col("i")).alias("document"), start.alias("start"), length.alias("n_tokens"), *([F.col(f"d.{names}").alias("name")] if names else []))
    whole = spans.groupBy("file").agg(F.sum("span_n").alias("total"), F.sum("span_ends").alias("document"), F.max(F.greatest("span_open", F.col("span_before") + F.col("tail.open"))).alias("start"))
    rest = whole.where("total > start").select("file", "document", "start", (F.col("total") - F.col("start")).alias("n_tokens"), *([F.lit(None).cast(kinds[names][6:-1]).alias("name")] if names else []))
    return ended.unionByName(rest)
