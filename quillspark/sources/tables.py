"""Table access and durable intermediate results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: MB of Parquet of texts that a task is dealt: their tokens with annotations take some hundred times as much memory.
TEXT_MB = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_tasks(spark: SparkSession, sf_dir: str, name: str) -> int:
    """How many tasks a table's texts are dealt out to: by the size of its files, so that a task's share stays the same however large they are."""
    files = spark.read.format("binaryFile").load(f"{sf_dir.rstrip('/')}/{name}.parquet")
    size = files.agg(F.sum("length")).first()[0] or 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // int(TEXT_MB * 2**20)))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, read from the session.

    It is set to a temporary folder only where it is unset and the master is local, as in tests.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    here = spark.sparkContext._jsc.sc().getCheckpointDir()
    if here.isDefined():
        return here.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="quillspark-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """An eager reliable checkpoint in the shared folder (never localCheckpoint)."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df written once as Parquet below the shared folder and read again (compressed, unlike a checkpoint)."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
