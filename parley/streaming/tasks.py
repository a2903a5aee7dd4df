"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parley.functions.scalars import progress
from parley.operators.tasks import partial_results

REQUEST = "jsonrpc string, id string, method string, params map<string,string>"


def requests(spark: SparkSession, path: str) -> DataFrame:
    """id, method, params and error of JSON-RPC lines in a folder's files; blank lines are skipped."""
    lines = spark.readStream.text(path).filter(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", REQUEST).alias("r"))
    error = F.when(F.col("r.method").isNull(), F.lit("invalid_request"))
    return parsed.select(F.col("r.id").alias("id"), F.col("r.method").alias("method"), F.col("r.params").alias("params"), error.alias("error"))


def task_states(events: DataFrame, timeout: str | None = None) -> DataFrame:
    """task_id, status, n_events as they change, from a stream of task_id, seq, status.

    State is one row a task. With a timeout, a task without events for so long is
    forgotten; such a stream goes on making batches, so it never ends by itself.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        status, seq, n = state.get if state.exists else ("", -1, 0)
        for rows in batches:
            n += len(rows)
            last = rows.sort_values("seq").iloc[-1]
            if int(last["seq"]) > seq:
                status, seq = str(last["status"]), int(last["seq"])
        state.update((status, seq, n))
        if timeout:
            state.setTimeoutDuration(_milliseconds(timeout))
        yield pd.DataFrame({"task_id": [key[0]], "status": [status], "n_events": [n]})

    return events.select("task_id", "seq", "status").groupBy("task_id").applyInPandasWithState(update, "task_id string, status string, n_events long", "status string, seq long, n long", "update", GroupStateTimeout.ProcessingTimeTimeout if timeout else GroupStateTimeout.NoTimeout)


def _milliseconds(text: str) -> int:
    number, unit = text.split()
    return int(number) * {"second": 1000, "minute": 60_000, "hour": 3_600_000}[unit.rstrip("s")]


def deduplicated_starts(starts: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The first of equal starts (request_key) within the watermark of column at."""
    return starts.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(["request_key"])


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """task_id, done and percent so far, from a stream of finished chunks with their task's total; for outputMode update."""
    done = F.count("*")
    return chunks.groupBy("task_id").agg(done.alias("done"), (38 + F.floor(done / F.greatest(F.max("total"), F.lit(1)) * 28)).alias("percent"))


def partial_texts(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for a stream of finished chunks (task_id, offset_s, chunk_s, text, total) that keeps each task's text so far.

    Chunks are added to a table under path once a batch; a batch that is run again
    replaces its own rows. ``partial_view`` reads them.
    """

    def add(batch: DataFrame, number: int) -> None:
        batch.select("task_id", "offset_s", "chunk_s", "text", "total").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return add


def partial_view(spark: SparkSession, path: str) -> DataFrame:
    """task_id, done, percent, covered_s and text of what ``partial_texts`` has written; a chunk that came twice counts once."""
    rows = spark.read.parquet(path).dropDuplicates(["task_id", "offset_s"])
    total = rows.groupBy("task_id").agg(F.max("total").alias("total"))
    return partial_results(rows).join(total, "task_id").select("task_id", "done", progress(F.col("done"), F.col("total")).alias("percent"), "covered_s", "text")


def activity(events: DataFrame, window: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Events per window and type, for outputMode append; later events than the watermark are dropped by Spark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    """Process what is there and stop; a restart from the same checkpoint goes on after it."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
