"""Corpus cleaning: a chain of stages over `documents`, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept, and returns the columns of documents; the last returns packed sequences.

Odd rows are the same to all stages: an empty table gives an empty one, columns of
other names are not read, texts have any length, and equal rows stay as many rows
unless a stage says otherwise.  What a null id, a null text or a repeated id means is
said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bindery.llm import quality
from bindery.llm._store import written
from bindery.llm.decontaminate import benchmark_hits
from bindery.llm.line_dedup import drop_common_lines
from bindery.llm.near_dup import near_duplicates
from bindery.llm.packing import pack_sequences
from bindery.llm.queries import read, vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents with a lower quality score go.
LEAST_QUALITY = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learnt from the labels that are not held out, does not reject.

    A row is judged by its text alone, a null text as an empty one; null and repeated ids
    do not matter to the score.  Without any labels nothing is rejected.
    """
    model = quality.train(docs, read(spark, sf_dir, "labels"), label="quality", bound=20_000)
    return quality.score(docs.select(COLUMNS), model, output="_score").where(F.col("_score") >= LEAST_QUALITY).select(COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of 20 code points or more that 3 or more documents hold, but for the last of these.

    A null text is one empty line, so it stays as an empty text; the rows of one id are
    one document when holders are counted, and rows without an id are another.
    """
    kept = drop_common_lines(docs, documents=3, least=20, keep=("lang", "source"))
    return kept.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies (five-word shingles, similarity 0.8 or more).

    Documents without words are copies of nothing and stay, and so do rows without an
    id, which no row can be told from.  Rows of one id stay or go together.
    """
    others = near_duplicates(docs, width=5, percent=80).where("not kept").select("doc_id").distinct()
    return docs.select(COLUMNS).join(others, "doc_id", "left_anti").select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark (five-word shingles, similarity 0.8 or more).

    Rows of one id, or without any, stay or go together; null texts and an empty
    benchmark match nothing.
    """
    hits = benchmark_hits(docs, read(spark, sf_dir, "benchmark"), width=5, percent=80).select("doc_id").distinct()
    return docs.select(COLUMNS).join(hits, docs.doc_id.eqNullSafe(hits.doc_id), "left_anti").select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens; a null text is its end token alone, and every row is packed, also of one id."""
    return pack_sequences(docs, tokenizer=vocabulary(), end=2, limit=4096)


STAGES = [("quality", keep_quality), ("line_dedup", drop_lines), ("near_dedup", drop_near_duplicates), ("decontamination", drop_contaminated), ("packing", pack)]
#: The stages learn, sketch and tokenise: tests hold them against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over `documents`."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
