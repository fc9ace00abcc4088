"""A corpus pipeline of five stages, each over all that the one before kept.

``STAGES`` are ``(name, function)`` pairs; a function takes ``(spark, docs, sf_dir)``. All but the last return the columns
of ``docs``, other columns than those of documents too; the last returns the bins that the kept texts are packed into.

In every stage a null text is an empty one and very long texts are taken whole; tables without rows give none. Rows without a doc_id stay, are nobody's copy, and are packed. Of
repeated rows one stays in the second stage; before and after it they are handled alike, each by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ballast.functions.durable import drop, scratch, ship, written
from ballast.llm import classifier, decontaminate, jaccard, packing, substring

#: Near duplicates: a Jaccard similarity of 0.8 or more between sets of five-word shingles.
SHINGLE, SIMILARITY = 5, 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier does not reject. Texts on the threshold stay."""
    ship(spark)
    return classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest doc_id; of several of that id, the one of the least text hash."""
    ship(spark)
    return jaccard.drop_near_copies(docs, shingle=SHINGLE, threshold=SIMILARITY)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without windows of 50 words that a document with a smaller doc_id has too; documents of which no word is left go."""
    ship(spark)
    return substring.remove_repeats(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of the benchmark; documents that are mostly such passages go."""
    ship(spark)
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each kept text goes."""
    ship(spark)
    return packing.pack(packing.lengths(docs))


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_passages),
    ("best-fit packing", bins),
]

#: The classifier's fit, SimHash and packing are not expressible in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents``; each stage's are written and reread, and dropped once the next one's are written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name.replace(" ", "-"))
        docs = written(stage(spark, docs, sf_dir), path)
        if last:
            drop(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
