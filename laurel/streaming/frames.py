"""Streams of raw frames: reading, content deduplication, routing and archiving."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

RESULT_TYPES = ("result.new", "result.update", "result.all")
ROUND_TYPES = ("round.all", "round.update")


def read_frames(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """JSON frames arriving as files; a Kafka source gives the same columns in production."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def with_payload_hash(frames: DataFrame, payload: str = "payload") -> DataFrame:
    return frames.withColumn("payload_hash", F.sha2(payload, 256))


def distinct_frames(
    frames: DataFrame,
    keys: Sequence[str] = ("source", "method", "payload_hash"),
    event_time: str | None = None,
    horizon: str | None = None,
) -> DataFrame:
    """Each content once. With ``horizon`` the memory of seen contents is bounded by event time, which
    is the choice for a stream that does not end; without it a content seen at any earlier time is
    dropped and its hash is kept for ever (in the RocksDB state store, on disk)."""
    if horizon:
        return frames.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark(list(keys))
    return frames.dropDuplicates(list(keys))


def route(frames: DataFrame) -> dict[str, DataFrame]:
    """Result messages, round metadata and rosters by message type; others are all but results, also
    those without a type."""
    kind = F.col("type")
    result = F.coalesce(kind.isin(*RESULT_TYPES), F.lit(False))
    return {
        "results": frames.where(result),
        "rounds": frames.where(kind.isin(*ROUND_TYPES)),
        "rosters": frames.where(kind == "users"),
        "others": frames.where(~result),
    }


def run_to_parquet(
    stream: DataFrame, path: str, checkpoint: str, mode: str = "append", name: str | None = None
) -> StreamingQuery:
    """Process everything available into Parquet files, then stop."""
    writer = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    query = writer.trigger(availableNow=True).start(path)
    query.awaitTermination()
    return query
