"""From raw documents to packed training sequences, stage by stage.

Every stage takes the documents that its predecessor kept. All but the last give
documents again, with the same columns; the last gives the pieces of the packed
sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import found_by_workers, read_table, shared_folder
from tallyloom.llm.decontamination import without_benchmark
from tallyloom.llm.language_id import accepted_documents
from tallyloom.llm.line_dedup import dedup_lines
from tallyloom.llm.packing import pack
from tallyloom.llm.simhash import keep_one

#: SQL has neither the tokenizer nor the language model; see tests/llm.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is not recognised (no letters, no fit)."""
    return accepted_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated passages; drops documents of which nothing is left by that.

    ``n_chars`` is counted anew where lines were removed.
    """
    found = dedup_lines(docs)
    kept = found.where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(
        F.col("n_chars")
    )
    return kept.withColumn("n_chars", n_chars).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group whose fingerprints are linked.

    That is, by SimHash: shingles of three words, two bits at most.
    """
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark."""
    return without_benchmark(docs, read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into training sequences."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder and read again."""
    found_by_workers(spark)
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
