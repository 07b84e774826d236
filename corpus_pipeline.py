"""A corpus pipeline of five of the llm operators: what one stage keeps is the next one's input.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread;
all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from roundsmith.llm import storage
from roundsmith.llm.decontaminate import without_leaks
from roundsmith.llm.line_quality import fit as fit_lines, label_documents
from roundsmith.llm.ngram_join import one_of_each
from roundsmith.llm.packing import pack_documents
from roundsmith.llm.pii import detect, fit as fit_pii


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are mostly content lines; the others go."""
    model = fit_lines(docs, storage.table(spark, sf_dir, "labels"))
    return label_documents(docs, model, carry=True).where("kept").select("_row.*").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id, with or without a doc_id; of rows
    that repeat a doc_id each is judged by its own text. Blank documents link with nothing and stay."""
    storage.settle(spark)
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verified benchmark item; the others go, with or without a doc_id."""
    storage.settle(spark)
    return without_leaks(docs, storage.table(spark, sf_dir, "benchmark")).select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of personal data replaced by its kind; n_chars counts what is left."""
    storage.settle(spark)
    found = detect(docs, fit_pii(docs), carry=True)
    new = {"text": F.when(F.col("_row.text").isNotNull(), F.col("masked")), "n_chars": F.length("masked").cast("long")}
    return found.select([new[c].alias(c) if c in new else F.col("_row")[c].alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 ids."""
    storage.settle(spark)
    return pack_documents(docs)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("packing", packing),
]

#: SQL cannot express the line model, the skip-chain field or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = storage.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = storage.saved(docs, f"stage{k + 1}")
    return docs
