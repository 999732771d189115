"""Queues as streams of files, and sinks that take each row once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from talea.operators import ledger


def queue(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """``body`` of messages that arrive as lines of files in a folder; the checkpoint keeps what was read."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder).select(F.col("value").alias("body"))


def routed(messages: DataFrame) -> DataFrame:
    """The messages with why they are rejected, if they are."""
    return ledger.routed(messages)


def once(stream: DataFrame, path: str, checkpoint: str, keys: list[str], at: str | None = None, late: str = "1 day") -> DataStreamWriter:
    """A sink to Parquet that takes the first row of each key, whatever is delivered again.

    The keys seen are kept in the stream's state store, so that a micro-batch
    costs what it holds, not what was written before. With an event time
    ``at`` a key is forgotten when the watermark, ``late`` behind, has passed it.
    """
    fresh = stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys) if at else stream.dropDuplicates(keys)
    return fresh.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)


def fan_out(stream: DataFrame, subscribers: dict[str, Callable[[DataFrame], DataStreamWriter]]) -> dict[str, StreamingQuery]:
    """Starts a query of its own for each subscriber, which is given the stream and says where its rows go.

    Each keeps its own checkpoint, so that a slow one loses nothing and holds up no other.
    """
    return {name: write(stream).queryName(name).start() for name, write in subscribers.items()}
