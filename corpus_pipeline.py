"""A training-data pipeline over documents: each stage works on all rows that the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import mixing, queries, simhash, substring, toxicity
from quillspark.llm.common import fold_of
from quillspark.sources.tables import shared_dir, table


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of score 0.5 or more; the model learns from the labelled documents outside the held-out fold."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels").filter(fold_of(F.col("doc_id"), 5) != 0))
    return toxicity.filtered(docs, model)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each component; rows without id stay."""
    found = simhash.near_duplicates(docs.filter("doc_id is not null")).filter("doc_id = component_id").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return queries.bpe_digests(docs)


#: What each stage returns is written as Parquet and read again as the next one's docs.
STAGES = [
    ("toxicity", remove_toxic),
    ("simhash near-dedup", remove_near_copies),
    ("substring dedup", remove_repeated_passages),
    ("mixing sources", mix_sources),
    ("byte-level bpe", encode),
]

#: The first two stages have no form in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; intermediate tables go to the shared folder."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
