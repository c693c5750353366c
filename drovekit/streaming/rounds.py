"""The feedback loop as a stream of episodes: appended once, retired tokens and rounds rebuilt from the log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EPISODE = "episode_id string, round int, selected_tokens array<string>, reward double"


def log_of(spark: SparkSession, path: str) -> DataFrame:
    """The episode log; empty where nothing was written yet."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return spark.createDataFrame([], EPISODE)
    return spark.read.schema(EPISODE).parquet(path)


def append(batch: DataFrame, path: str) -> None:
    """Append the episodes that the log doesn't have; of several with one id the one with the first round counts, then with the least
    tokens and reward. One writer appends to a log: ``micro_rounds`` holds a run for one."""
    fresh = batch.groupBy("episode_id").agg(F.min(F.struct("round", "selected_tokens", "reward")).alias("e")).select("episode_id", "e.*")
    fresh.join(log_of(batch.sparkSession, path).select("episode_id"), "episode_id", "left_anti").write.mode("append").parquet(path)


def used_tokens(log: DataFrame) -> DataFrame:
    """(sample_token, round): what was selected, with the first round that did."""
    return log.select(F.explode("selected_tokens").alias("sample_token"), "round").groupBy("sample_token").agg(F.min("round").alias("round"))


def resume(log: DataFrame, has_selector: bool = True) -> int:
    """The number of completed rounds in the log; 0 if the selector that they made is gone."""
    return (log.agg(F.max("round")).first()[0] or 0) if has_selector else 0


def collect_feedback(episodes: DataFrame, path: str, checkpoint: str, after: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Start a query that appends a stream of episodes to the log once each, however often they or a batch come again, calls
    ``after`` with the log and the batch's number, and ends when there is no more feedback. One query a checkpoint writes."""

    def each(batch: DataFrame, number: int) -> None:
        append(batch, path)
        if after is not None:
            after(log_of(batch.sparkSession, path), number)

    return episodes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
