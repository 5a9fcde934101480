"""Corpus cleaning and packing: toxicity, line dedup, near-dedup by SimHash and shingles, decontamination, best-fit packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import decontaminate, line_dedup, near_dedup, packing, simhash, toxicity
from loomline.llm._shared import materialise

#: Near duplicates: documents whose SimHash fingerprints (see simhash) differ in two bits at most, or whose sets of five-word shingles have
#: a Jaccard similarity of 0.8 or more, which lies further apart than fingerprints of 64 bits can be searched for.
SHINGLE, SIMILARITY = 5, 0.8


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier scores 0.5 or more. It learns from the labels of the documents at hand."""
    return toxicity.remove_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that match an earlier line; documents stay, if need be with an empty text."""
    return line_dedup.keep_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates."""
    found = simhash.united(simhash.groups(docs), near_dedup.groups(docs, SHINGLE, SIMILARITY))
    return simhash.keep_rows(docs, *found, "doc_id", "text")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark window."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the rest: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packing.pack(packing.tokenise(docs, packing.default_tokenizer()))


STAGES = [("toxicity", toxic), ("line_dedup", lines), ("near_dedup", near_duplicates), ("decontaminate", clean), ("packing", packed)]
#: SQL can't express the classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to the documents of a folder of tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, _ = materialise(stage(spark, docs, sf_dir), name)
    return docs
