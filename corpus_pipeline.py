"""The corpus pipeline: quality classifier, near duplicates, benchmark decontamination, secret scans, packing.

Every stage reads all rows and whole texts that the one before it kept; a null or empty text is an empty document, a null
doc_id stays null, repeated rows are rows of their own, columns beyond doc_id and text (whatever their names) are carried along
unread, and an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchgraph.llm.common import read, write_table
from sketchgraph.llm.decontaminate import clean_documents
from sketchgraph.llm.near_dups import near_duplicates
from sketchgraph.llm.packing import packed_documents
from sketchgraph.llm.quality_classifier import good_documents
from sketchgraph.llm.secrets import redact_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more; all of them where no rows of both labels are left to learn from."""
    return good_documents(docs, read(spark, sf_dir, "labels"))


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (similarity 0.8 or more): the one with the least doc_id (null last).

    Documents without words are like nothing else and all stay.
    """
    name = "row"
    while name in docs.columns:
        name += "_"
    numbered = write_table(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
    first = near_duplicates(numbered, 80, 100, row=name).where("first").select(F.col("row").alias(name))
    return numbered.join(first, name, "left_semi").select(docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item, items without an id included; all where the benchmark is empty."""
    return clean_documents(docs, read(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced; null texts stay null, n_chars counts the new text."""
    return redact_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's pieces with their places in sequences of at most 4096 tokens; an empty document is its end alone."""
    return packed_documents(docs)


STAGES = [("quality_classifier", quality), ("minhash_near_dups", near_dups), ("decontamination", decontaminated), ("secret_scan", secrets), ("best_fit_packing", packing)]
#: The classifier, the hashes and the network have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = write_table(docs, name)
    return docs
