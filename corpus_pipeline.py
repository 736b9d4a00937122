"""The corpus pipeline: documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and
read again as the next stage's docs. All but the last keep the columns of
documents (doc_id, text, lang, source, n_chars), also further ones of the input,
whatever their names.

Rows without doc_id can't be told apart by the operators: the filters pass them
on. Rows that repeat a doc_id count as one document: a filter decides for all of
them, and near_duplicate_stage and repeated_text_stage keep the one with the
smallest text (null first). Null, empty and wordless texts have no language and
go in the first stage. No documents give no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.decontaminate import contaminated
from tallyspark.llm.jaccard_join import jaccard_components
from tallyspark.llm.language_id import identify_documents
from tallyspark.llm.packing import packed
from tallyspark.llm.queries import tokenizer_path
from tallyspark.llm.spark_util import read_table, shared_folder, written
from tallyspark.llm.suffix_dedup import removed_text


def _one_row_an_id(docs: DataFrame) -> DataFrame:
    """docs, with the smallest text of the rows that repeat an id; shuffled only where some do."""
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if again.isEmpty():
        return docs
    rank = f"rank_{uuid.uuid4().hex}"
    ranked = docs.where("doc_id is not null").withColumn(rank, F.row_number().over(Window.partitionBy("doc_id").orderBy("text")))
    return written(ranked.where(F.col(rank) == 1).drop(rank).unionByName(docs.where("doc_id is null")))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of an identified language."""
    gone = identify_documents(docs).groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each component of 5-word shingle sets of similarity 0.8 or more."""
    docs = _one_row_an_id(docs)
    gone = jaccard_components(docs, ngram=5, num=80, den=100).where("doc_id <> component_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def repeated_text_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without strings of 100 bytes or more that start earlier; those with nothing left go."""
    docs = _one_row_an_id(docs)
    kept, removed = (f"{x}_{uuid.uuid4().hex}" for x in ("kept", "removed"))
    cut = removed_text(docs.select("doc_id", "text")).where("n_removed > 0").select("doc_id", F.col("text").alias(kept), F.col("n_removed").alias(removed))
    out = docs.join(cut, "doc_id", "left").where(F.col(removed).isNull() | (F.trim(kept) != ""))
    text, n_chars = F.when(F.col(removed).isNull(), F.col("text")).otherwise(F.col(kept)), F.length(kept).cast("long")
    return out.withColumns({"text": text, "n_chars": F.when(F.col(removed).isNull(), F.col("n_chars")).otherwise(n_chars)}).select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    leaks = contaminated(docs, read_table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 2048 tokens."""
    return packed(docs, tokenizer_path("word_bpe_49k.json"), capacity=2048, end_id=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("suffix_array_dedup", repeated_text_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
