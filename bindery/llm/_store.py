"""Tables written in the folder that driver and executors share, to cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session.

    Where it is unset, a folder of our own, but only if driver and executors are one
    process (master local): elsewhere executors would write to their own disks and a
    table read back would lack rows, so that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="bindery-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def written(frame: DataFrame, compact: bool = False, beside: str | None = None, **options: str) -> DataFrame:
    """The frame, written as Parquet in the shared folder and read again; removed by `release` or when the session's JVM ends.

    `compact`, for tables of few bytes a row and many partitions: at most four files a core.
    `beside`: a folder that the frame's tasks write to, removed at the end likewise.
    """
    spark = frame.sparkSession
    if compact:
        frame = frame.coalesce(4 * spark.sparkContext.defaultParallelism)
    path = f"{shared_folder(spark).rstrip('/')}/bindery-{uuid.uuid4().hex}"
    if beside:
        files, place = _place(spark, beside)
        files.mkdirs(place)  # only a folder that exists is removed at the end
        files.deleteOnExit(place)
    frame.write.options(**options).parquet(path)
    files, place = _place(spark, path)
    files.deleteOnExit(place)
    out = spark.read.schema(frame.schema).parquet(path)
    out.stored_at = path
    return out


def release(*frames: DataFrame) -> None:
    """Remove tables that `written` made and that no plan still to run reads."""
    for frame in frames:
        files, place = _place(frame.sparkSession, frame.stored_at)
        files.delete(place, True)
