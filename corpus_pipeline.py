"""A corpus pipeline: toxicity, exact dedup, n-gram Jaccard join, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, all columns; the
last returns the packed pieces. ``run`` writes each stage's result to the shared folder and reads
it back as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from placelink.llm import exact_dedup, mixing, ngram_join, packing, shared, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model rejects go; it is fitted on the labelled documents among ``docs``."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, shared.labels(spark, sf_dir)))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8 the smallest doc_id stays."""
    return ngram_join.one_of_each(docs, k=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates towards the target weights say."""
    return mixing.mixed_documents(docs, shared.labels(spark, sf_dir))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = shared.stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs


#: Classifiers and tokenization have no SQL form; the tests hold the stages against plain versions.
ORACLE_SQL = None
