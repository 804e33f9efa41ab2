"""The corpus pipeline: toxic documents go, one of each group of near-duplicates stays, repeated passages are taken out, documents that
hold benchmark text go, and what is left is packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from burstline.llm import decontaminate, packing, shingles, substring, tokens, toxicity
from burstline.llm.common import kept, scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores under 0.5; it learns from the labelled ones among them."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group, linked by similarity 0.8 or more of five-word shingles: SimHash fingerprints
    near each other by pivot distance tables, and what these leave apart by MinHash, both verified on the shingles."""
    return shingles.keep_one(docs)


def strip_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that a document of smaller doc_id has."""
    return substring.strip_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    return packing.pack(docs, tokens.default_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", strip_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: No SQL: trees, tokens and packing can't be expressed in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet and read again. What a stage has written for itself is deleted after it,
    and what the stages before the last have kept at the end."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark):
        for name, stage in STAGES[:-1]:
            with scratch(spark):
                docs = kept(stage(spark, docs, sf_dir), name)
        name, stage = STAGES[-1]
        return kept(stage(spark, docs, sf_dir), name)
