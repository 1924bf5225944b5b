"""Periodic refresh: store newly landed responses as they arrive.

Parsing a response needs no state, so each micro-batch goes through the batch ingest. The cut-off
and the fills look at the whole history and therefore run as batch jobs over the stored calls
(``pipeline.run_stored``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from riffle import schemas
from riffle.functions import times
from riffle.sources import ingest, payloads, sink

# Fixed value: seconds between refreshes.
REFRESH_SECONDS = 1800


def start_refresh(
    spark: SparkSession,
    landing: str,
    gauges: DataFrame,
    path: str,
    checkpoint: str,
    once: bool = False,
    max_files: int = 10_000,
    keys: T.StructType = schemas.NO_KEYS,
) -> StreamingQuery:
    """Store landed responses every half hour, or once for all that has landed so far.

    A micro-batch is one stored run, named by the query and its number: a batch replayed after a
    failure replaces its own files, and a query with a new checkpoint adds runs of its own. Readers take all
    runs of a window, so it does not matter into how many batches a refresh was split.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        calls = ingest.parse_calls(batch, gauges, keys.names)
        sink.write_run(calls, path, f"{query}-{batch_id:010d}", times.local_now(), keys)

    landed = payloads.stream_landing(spark, landing, max_files, keys)
    writer = landed.writeStream.foreachBatch(store)
    timed = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{REFRESH_SECONDS} seconds")
    return timed.option("checkpointLocation", checkpoint).start()
