"""From raw documents to packed sequences, in five stages; each is written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerline.llm import decontaminate, line_dedup, near_dedup, packing, quality
from ledgerline.session import materialized

#: The columns of documents; all stages but the last return them.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null, empty and wordless texts go, repeated rows are judged alike.

    The verdicts are written before they are filtered: pushed down, the filter would repeat every expression that it rests on.
    """
    return materialized(quality.judged(docs.select(*COLUMNS)).select(*COLUMNS, "kept"), "judged").filter("kept").select(*COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier one matches; one of which no word is left goes. n_chars follows the text."""
    cut = line_dedup.without_repeated(docs.select(*COLUMNS))
    counted = cut.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return counted.filter(F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates; repeated rows of one doc_id all stay."""
    gone = materialized(near_dedup.near_duplicates(docs).filter("NOT kept").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti").select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; rows without doc_id or text stay."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left, with their sequences and offsets; a null or empty text is one piece of its end id."""
    pieces = materialized(packing.pieces(docs), "pieces")
    return packing.pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", near_duplicates),
    ("decontamination", without_benchmark),
    ("best_fit_packing", packed),
]

#: Tokens can't be made in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialized(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
