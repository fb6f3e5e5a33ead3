"""Execution journals: hash chains, lifecycle and reconciliation, over tables or micro-batches of journal lines."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

GENESIS = "0" * 64
#: Legal execution transitions (fixed values).
EXECUTION_EDGES = [
    ("Created", "AcquiringLease"), ("AcquiringLease", "PreflightValidating"), ("AcquiringLease", "PreflightFailed"), ("AcquiringLease", "CancelledBeforeMutation"),
    ("PreflightValidating", "ReadyForBackup"), ("PreflightValidating", "PreflightFailed"), ("PreflightValidating", "CancelledBeforeMutation"),
    ("ReadyForBackup", "BackingUp"), ("ReadyForBackup", "BackupFailed"), ("ReadyForBackup", "CancelledBeforeMutation"),
    ("BackingUp", "BackupVerified"), ("BackingUp", "BackupFailed"), ("BackingUp", "CancelledBeforeMutation"),
    ("BackupVerified", "ReadyToExecute"), ("BackupVerified", "ExecutionFailedBeforeMutation"), ("BackupVerified", "CancelledBeforeMutation"),
    ("ReadyToExecute", "Executing"), ("ReadyToExecute", "Verifying"), ("ReadyToExecute", "ExecutionFailedBeforeMutation"), ("ReadyToExecute", "CancelledBeforeMutation"),
    ("Executing", "Verifying"), ("Executing", "ExecutionPartiallyApplied"), ("Executing", "VerificationFailed"), ("Executing", "RecoveryRequired"),
    ("ExecutionPartiallyApplied", "RecoveryRequired"), ("VerificationFailed", "RecoveryRequired"),
    ("Verifying", "Completed"), ("Verifying", "VerificationFailed"), ("Verifying", "RecoveryRequired"),
]
LINE = "execution_id long, sequence long, previous_hash string, entry_hash string, kind string, payload string"


def line_hash(execution_id, sequence: int, previous: str, kind: str, payload: str) -> str:
    import hashlib

    return hashlib.sha256(f"{execution_id}|{sequence}|{previous}||{kind}|{payload}".encode()).hexdigest()


def chained(events: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """LINE rows of (execution_id, sequence, kind, payload): each entry's hash covers its predecessor's.

    With `last` (execution_id, sequence, entry_hash) the new entries follow a journal's
    last one and are numbered on from it; else sequences are kept.  A chain is
    sequential by nature, so one journal is one group of applyInPandas.
    """

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("sequence")
        out = []
        for place, r in enumerate(rows.itertuples(), 1):
            previous = out[-1][3] if out else r.start
            sequence = r.sequence if r.number < 0 else int(r.number) + place
            out.append((r.execution_id, sequence, previous, line_hash(r.execution_id, sequence, previous, r.kind, r.payload), r.kind, r.payload))
        return pd.DataFrame(out, columns=["execution_id", "sequence", "previous_hash", "entry_hash", "kind", "payload"])

    rows = events.select("execution_id", "sequence", "kind", "payload")
    if last is None:
        rows = rows.withColumns({"start": F.lit(GENESIS), "number": F.lit(-1).cast("long")})
    else:
        ends = last.select("execution_id", F.col("entry_hash").alias("start"), F.col("sequence").alias("number"))
        rows = rows.join(ends, "execution_id", "left").withColumns({"start": F.coalesce("start", F.lit(GENESIS)), "number": F.coalesce("number", F.lit(0).cast("long"))})
    return rows.groupBy("execution_id").applyInPandas(link, LINE)


def append(events: DataFrame, path: str) -> None:
    """Add events (execution_id, sequence, kind, payload), in the order of `sequence`, to the journals in a folder of JSON lines.

    Each journal's chain is continued from its last entry; one that the folder does not
    hold begins anew, and so does a folder that is empty or not there.  The lines appear together when the job commits.
    One writer at a time: a journal's lease is its caller's.
    """
    spark = events.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    last = spark.read.schema(LINE).json(path).groupBy("execution_id").agg(F.max("sequence").alias("sequence"), F.max_by("entry_hash", "sequence").alias("entry_hash")) if there else None
    chained(events, spark.createDataFrame([], "execution_id long, sequence long, entry_hash string") if last is None else last).write.mode("append").json(path)


def verified(lines: DataFrame) -> DataFrame:
    """LINE rows with `valid`: own hash right, previous hash the predecessor's, sequence without gaps from 1, nothing after the terminal summary."""
    w = Window.partitionBy("execution_id").orderBy("sequence")
    text = F.concat_ws("|", F.col("execution_id").cast("string"), F.col("sequence").cast("string"), F.col("previous_hash"), F.lit(""), F.col("kind"), F.col("payload"))
    own = F.sha2(text, 256) == F.col("entry_hash")
    follows = (F.col("previous_hash") == F.lag("entry_hash", 1, GENESIS).over(w)) & (F.col("sequence") == F.row_number().over(w))
    ended = F.coalesce(F.max((F.col("kind") == "TerminalSummary").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 0
    return lines.withColumn("valid", F.coalesce(own & follows & ended, F.lit(False)))


def predecessors(events: DataFrame) -> DataFrame:
    """Events (execution_id, ts, event_id, kind, entry_hash) with sequence, previous hash and whether a terminal summary came before."""
    w = Window.partitionBy("execution_id").orderBy("ts", "event_id")
    after = F.coalesce(F.max((F.col("kind") == "TerminalSummary").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    return events.select("execution_id", "event_id", "kind", F.row_number().over(w).cast("long").alias("sequence"), F.lag("entry_hash", 1, GENESIS).over(w).alias("previous_hash"), after.alias("after_terminal"))


def reconciled(entries: DataFrame, summaries: DataFrame) -> DataFrame:
    """(execution_id, recovery_required): a mutation began, and the journal is broken, unfinished or at odds with its summary.

    `entries` has kind and valid; `summaries` (execution_id, matches).
    """
    flags = entries.groupBy("execution_id").agg(F.bool_and("valid").alias("valid"), F.bool_or(F.col("kind") == "MutationStarted").alias("mutated"), F.bool_or(F.col("kind") == "TerminalSummary").alias("ended"))
    joined = flags.join(summaries, "execution_id", "left")
    fine = F.col("valid") & F.col("ended") & F.coalesce("matches", F.lit(False))
    return joined.select("execution_id", (~F.col("valid") | (F.col("mutated") & ~fine)).alias("recovery_required"))


def backup_gaps(required: DataFrame, entries: DataFrame) -> DataFrame:
    """Requirements (group_id, book_id, kind, format), but for ExecutionAudit, that no backup entry covers."""
    keys = ["group_id", "book_id", "kind", "format"]
    want, have = required.where("kind <> 'ExecutionAudit'").select(*keys).alias("w"), entries.select(*keys).distinct().alias("h")
    on = [F.col(f"w.{k}").eqNullSafe(F.col(f"h.{k}")) for k in keys]
    return want.join(have, on, "left_anti")


def confirmation_faults(executions: DataFrame, entries: DataFrame) -> DataFrame:
    """(group_id, code, n) of executions without exactly one local confirmation among their backup entries (group_id, kind)."""
    said = entries.where("kind = 'LocalExecutionConfirmation'").groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    joined = executions.select("group_id").distinct().join(said, "group_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.where("n <> 1").select("group_id", F.lit("EXECUTION.BACKUP_CONFIRMATION_MISSING").alias("code"), "n")


def classify_backup(records: DataFrame, formats: DataFrame, stored: DataFrame) -> DataFrame:
    """(book_id, format, code): what is wrong with the exported files of each record, every fault once.

    `records` (book_id, has_cover), `formats` (book_id, format, sha256) are expected;
    `stored` (book_id, name, directory, size, sha256, valid) found, `valid` for a bounded
    metadata file.  A record needs one valid OPF, a cover if and only if it has one, and
    each format once with the expected bytes; any other file and any directory is extra.
    """
    extension = F.upper(F.regexp_extract("name", r"\.([^.]*)$", 1))
    want = formats.select("book_id", "format", F.col("sha256").alias("_want")).withColumn("_expected", F.lit(True))
    found = stored.join(records.select("book_id").distinct(), "book_id", "left_semi").withColumn("format", extension).join(want, ["book_id", "format"], "left")
    kind = F.when(F.col("directory"), "Extra").when(F.col("format") == "OPF", "Opf").when(F.lower("name") == "cover.jpg", "Cover").when(F.col("_expected"), "Format").otherwise("Extra")
    found = found.withColumn("_kind", kind)
    is_ = lambda k: F.col("_kind") == k
    of = found.groupBy("book_id").agg(F.count_if(is_("Opf")).alias("opf"), F.bool_or(is_("Opf") & ~F.col("valid")).alias("bad"), F.count_if(is_("Cover")).alias("cover"), F.bool_or(is_("Cover") & (F.col("size") <= 0)).alias("hollow"), F.bool_or(is_("Extra")).alias("extra"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    yes = lambda c: F.coalesce(c, F.lit(False))
    codes = F.array_compact(F.array(
        F.when(n("opf") == 0, "EXECUTION.BACKUP_METADATA_MISSING").when((n("opf") > 1) | yes("bad"), "EXECUTION.BACKUP_METADATA_INVALID"),
        F.when(F.col("has_cover") & (n("cover") == 0), "EXECUTION.BACKUP_COVER_MISSING").when((n("cover") > 1) | ((n("cover") == 1) & (~F.col("has_cover") | yes("hollow"))), "EXECUTION.BACKUP_COVER_INVALID"),
        F.when(yes("extra"), "EXECUTION.UNMODELED_EXTRA_DATA"),
    ))
    of_record = records.join(of, "book_id", "left").select("book_id", F.lit(None).cast("string").alias("format"), F.explode(codes).alias("code"))
    exported = found.where(is_("Format")).groupBy("book_id", "format").agg(F.count(F.lit(1)).alias("n"), F.bool_and(yes(F.col("sha256") == F.col("_want"))).alias("equal"))
    fault = F.when(F.col("n").isNull(), "EXECUTION.BACKUP_EXPORTED_FORMAT_MISSING").when((F.col("n") > 1) | ~F.col("equal"), "EXECUTION.BACKUP_EXPORTED_FORMAT_INVALID")
    of_format = want.join(records.select("book_id"), "book_id", "left_semi").join(exported, ["book_id", "format"], "left").select("book_id", "format", fault.alias("code")).where("code IS NOT NULL")
    return of_record.unionByName(of_format)


def backup_bytes(files: DataFrame, key: str = "group_id") -> DataFrame:
    """(key, needed): three times the files and 64 MiB; beyond a long it is the largest long."""
    most = F.lit(2**63 - 1)
    return files.groupBy(key).agg(F.coalesce(F.expr("try_add(try_multiply(3L, try_sum(size)), 67108864L)"), most).alias("needed"))


def watch(spark: SparkSession, path: str, on_invalid: Callable[[DataFrame], None], checkpoint: str):
    """Structured Streaming over growing journals: each micro-batch rereads the journals it touches and reports invalid lines."""

    def check(batch: DataFrame, _: int) -> None:
        touched = batch.select("execution_id").distinct()
        on_invalid(verified(spark.read.schema(LINE).json(path).join(touched, "execution_id", "left_semi")).where("NOT valid"))

    return spark.readStream.schema(LINE).json(path).writeStream.foreachBatch(check).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


