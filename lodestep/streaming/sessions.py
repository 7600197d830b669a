"""An extension for live logs: tool calls gathered into sessions, and routing of request streams in micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def call_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, start, end, calls, errors of each session of a stream (or table) of events.

    A session ends when a user is quiet for ``gap``; events that come more than ``late`` behind are left out, which bounds
    the state. Counts are partial sums, so a busy user costs a row of state.
    """
    seen = events.withWatermark("ts", late) if events.isStreaming else events
    s = seen.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("calls"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return s.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "calls", "errors")


def route_stream(features: DataFrame, decide: Callable[[DataFrame], DataFrame], output: str, checkpoint: str) -> StreamingQuery:
    """Applies a policy (DataFrame to DataFrame) to each micro-batch and writes it under the batch's number, once."""

    def each(batch: DataFrame, number: int) -> None:
        decide(batch).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return features.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
