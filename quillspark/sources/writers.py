"""Writers: wide feature tables, per-participant statistics, feedback and reviews, all by Spark's own sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def features_csv(features: DataFrame, names: list[str], path: str) -> None:
    """doc_id, index, value as one wide CSV row a document, columns in the order of names."""
    features.groupBy("doc_id").pivot("index", names).agg(F.first("value")).select("doc_id", *[F.col(f"`{n}`") for n in names]).write.csv(path, header=True)


def participants_csv(indices: DataFrame, names: list[str], path: str) -> None:
    """participant, index, value as one wide CSV row a participant."""
    indices.groupBy("participant").pivot("index", names).agg(F.first("value")).write.csv(path, header=True)


def json_lines(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def dataset(features: DataFrame, path: str) -> None:
    """Long features as Parquet, partitioned by nothing and sorted by index within files, so that a few indices can be read alone."""
    features.sortWithinPartitions("index").write.parquet(path)
