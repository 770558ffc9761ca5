"""Streams of posts: windows and sessions by event time, and merging of runs with state. Beyond what a batch library has."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def events(spark, folder: str, schema: str = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string") -> DataFrame:
    """A stream of the Parquet files of a folder; ts as TIMESTAMP, which watermarks need."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(stream: DataFrame, width: str = "7 days", late: str = "1 day") -> DataFrame:
    """start, user_id, posts: tumbling windows; posts later than late behind the newest are dropped, which bounds the state."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("posts"))
    return w.select(F.col("w.start").alias("start"), "user_id", "posts")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """start, end, user_id, posts: sessions that end after a gap."""
    s = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("posts"))
    return s.select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), "user_id", "posts")


def runs(stream: DataFrame, seconds: int = 1800, late: str = "1 day", mode: str = "append") -> DataFrame:
    """user_id, first, n: posts of a user up to some seconds after the first are one run; the open run is kept as state.

    Posts of a batch are taken in order of time. In mode append a run is given out when a later post closes it or the watermark passes its end; in mode
    update every run that a batch begins or adds to, closed or not, so that nothing stays unseen at the end of a stream: the row of a run with the greatest n is its last.
    """
    update = mode == "update"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, n = state.get if state.exists else (None, 0)
        done = []
        if state.hasTimedOut:
            state.remove()
            if not update:
                yield pd.DataFrame({"user_id": [key[0]], "first": [pd.Timestamp(first, unit="s")], "n": [n]})
            return
        times = sorted(t for b in batches for t in (b["ts"].astype("int64") // 10 ** (9 if str(b["ts"].dtype).startswith("datetime64[ns") else 6)).tolist())
        for t in times:
            if first is not None and t - first <= seconds:
                n += 1
            else:
                if first is not None:
                    done.append((key[0], pd.Timestamp(first, unit="s"), n))
                first, n = t, 1
        if update:
            done.append((key[0], pd.Timestamp(first, unit="s"), n))
        state.update((first, n))
        state.setTimeoutTimestamp(max((first + seconds + 1) * 1000, state.getCurrentWatermarkMs() + 1))
        if done:
            yield pd.DataFrame(done, columns=["user_id", "first", "n"])

    return stream.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(step, "user_id bigint, first timestamp, n int", "first bigint, n int", mode, GroupStateTimeout.EventTimeTimeout)


def once(stream: DataFrame, name: str, folder: str, mode: str = "append") -> DataFrame:
    """All that is there now through the stream, named name, into files below folder: each batch overwrites its own, so a batch that is done again counts once.

    The rows of all batches; in mode complete those of the last, which has them all.
    """
    done: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/{number}")
        done.append(number)

    q = stream.writeStream.queryName(name).foreachBatch(write).option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    spark = stream.sparkSession
    if not done:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*[f"{folder}/out/{n}" for n in (done[-1:] if mode == "complete" else done)])
