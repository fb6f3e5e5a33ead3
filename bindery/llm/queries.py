"""The thin queries over the driver's tables: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import media, quality, toxicity, warc
from ._labelled import held_out
from ._store import written
from .decontaminate import benchmark_hits
from .line_dedup import drop_common_lines
from .near_dup import near_duplicates
from .packing import pack_sequences
from .token_counts import count_tokens, write_token_files
from .substring_dedup import remove_repeats


END_OF_TEXT = 49407  # of the vocabulary below


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    records = warc.mark_revisits(warc.read_arcs(warc.write_arcs(pages)), least=0)
    archives = written(warc.write_warcs(records), compression="none")
    return warc.read_warcs(archives).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents"), width=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, read(spark, sf_dir, "labels"), label="quality", bound=20_000)
    out = quality.score(docs, model)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), label="toxic", bound=8_000)
    out = toxicity.score(docs, model)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = media.store_texts(read(spark, sf_dir, "documents").select("doc_id", "text"))
    files = files.withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    found = media.index_media(files, keep=("doc_id", "n_bytes", "media_bytes", "media_sha256"), samples=True).withColumn("t", F.col("tracks")[0])
    last = F.element_at("t.keyframes", -1)
    feature = F.concat_ws(";", F.col("t.codec"), F.concat_ws("x", "t.width", "t.height"), F.concat_ws("/", "t.duration", "t.timescale"), "t.samples", F.size("t.keyframes").cast("string"), F.concat_ws("+", last["start"], last["length"]))
    return found.select("doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"), "media_bytes", "media_sha256", feature.alias("feature"))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), width=4, percent=80)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = write_token_files(read(spark, sf_dir, "documents"), tokenizer=vocabulary(), end=END_OF_TEXT)
    return count_tokens(blocks, END_OF_TEXT, names="ids").select(F.col("name").alias("doc_id"), "n_tokens", "file", "document", "start")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), width=5, percent=80)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_sequences(read(spark, sf_dir, "documents"), tokenizer=vocabulary(), end=2, limit=4096)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_common_lines(read(spark, sf_dir, "documents"), documents=3, least=20)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_quality": op3_quality,
    "op4_toxicity": op4_toxicity,
    "op5_media": op5_media,
    "op6_minhash": op6_minhash,
    "op7_token_counts": op7_token_counts,
    "op8_decontamination": op8_decontamination,
    "op9_packing": op9_packing,
    "op10_line_dedup": op10_line_dedup,
}
