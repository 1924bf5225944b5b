"""Stored refreshes: parsed calls in parquet, reused while they are fresh.

Every refresh is a new ``run_id`` partition of calls, so nothing is overwritten while it may be read,
and parsing happens once. A row in the small run table commits it: a refresh that dies in between
leaves calls that no reader selects. Readings and audit are views of the calls of a window of runs.

A call stored twice counts once, as the newer run has it. That is settled when a run is written: the calls that it has in
common with stored runs go to a table of replaced calls, by their ids alone. A reader leaves those out and never
orders or shuffles calls with their readings. One writer at a time stores runs.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riffle import schemas
from riffle.functions import times
from riffle.operators.selection import stamp_run
from riffle.sources import ingest

# Fixed value: how old a stored refresh may be.
MAX_AGE_MINUTES = 60
#: Replaced calls, ids of some hundred bytes, up to which their table is broadcast.
BROADCAST_CALLS = 20_000

Refresh = Callable[[], DataFrame]


class Run(NamedTuple):
    run_id: str
    run_time: datetime


def run_id_of(run_time: datetime) -> str:
    return run_time.strftime("%Y%m%dT%H%M%S%f")


def write_run(
    calls: DataFrame, path: str, run_id: str, run_time: datetime, keys: T.StructType = schemas.NO_KEYS
) -> None:
    """Store one refresh under its own partition; writing the same run again replaces it.

    A column that the stored schema does not hold would be lost to readers, so it is refused. Of rows of one call within the run one
    is kept.
    """
    schema = schemas.keyed(schemas.CALLS, keys)
    stamped = stamp_run(calls, run_time)
    if set(stamped.columns) != set(schema.names):
        raise ValueError(f"calls must have the columns {schema.names}, not {stamped.columns}")
    call = _call(keys)
    stamped.select(schema.names).dropDuplicates(call).write.mode("overwrite").parquet(f"{path}/calls/run_id={run_id}")
    spark = calls.sparkSession
    own = spark.read.schema(schema).parquet(f"{path}/calls/run_id={run_id}").select(*call)
    committed = runs(spark, path)
    replaced = spark.createDataFrame([], _replaced(keys))
    if committed is not None:
        others = _stored(spark, path, committed.filter(F.col("run_id") != run_id), keys).select(*call, "run_id", "run_time")
        same = [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in call]
        common = others.alias("o").join(own.alias("n"), same).select("o.*")
        newer = F.struct("run_time", "run_id") > F.struct(times.ntz(run_time), F.lit(run_id))
        replaced = common.select(
            *call,
            F.when(newer, F.lit(run_id)).otherwise(F.col("run_id")).alias("lost"),
            F.when(newer, F.col("run_id")).otherwise(F.lit(run_id)).alias("won"),
        )
    replaced.write.mode("overwrite").parquet(f"{path}/replaced/run_id={run_id}")
    run = spark.range(1).select(times.ntz(run_time).alias("run_time"))
    run.coalesce(1).write.mode("overwrite").parquet(f"{path}/runs/run_id={run_id}")


def _call(keys: T.StructType) -> list[str]:
    """What tells calls apart."""
    return [*keys.names, "source", "gauge_id", "call_id"]


def _replaced(keys: T.StructType) -> T.StructType:
    names = [schemas.CALLS[c] for c in ("source", "gauge_id", "call_id")]
    return T.StructType([*keys.fields, *names, *[T.StructField(c, T.StringType()) for c in ("lost", "won")]])


def _stored(spark: SparkSession, path: str, chosen: DataFrame, keys: T.StructType) -> DataFrame:
    """All rows of the chosen runs, with their ``run_id``. Runs are folders, which the join prunes."""
    with_run = T.StructType([*schemas.keyed(schemas.CALLS, keys).fields, T.StructField("run_id", T.StringType())])
    stored = spark.read.schema(with_run).parquet(f"{path}/calls")
    return stored.join(chosen.select("run_id"), "run_id", "left_semi")


def runs(spark: SparkSession, path: str) -> DataFrame | None:
    """``run_id, run_time`` of all committed refreshes; None when there is none."""
    try:
        return spark.read.schema(schemas.RUNS).parquet(f"{path}/runs")
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def latest_run(spark: SparkSession, path: str) -> Run | None:
    """Newest committed refresh; None when there is none."""
    stored = runs(spark, path)
    if stored is None:
        return None
    newest = stored.agg(F.max_by("run_id", F.struct("run_time", "run_id")).alias("run_id"), F.max("run_time").alias("at")).first()
    return Run(newest["run_id"], newest["at"]) if newest["at"] is not None else None


def read_calls(
    spark: SparkSession, path: str, since: datetime | None = None, until: datetime | None = None, keys=schemas.NO_KEYS
) -> DataFrame:
    """Calls of the committed runs of a window, both ends included; of a call stored twice the newer one."""
    chosen, schema = runs(spark, path), schemas.keyed(schemas.CALLS, keys)
    if chosen is None:
        return spark.createDataFrame([], schema)
    if since is not None:
        chosen = chosen.filter(F.col("run_time") >= times.ntz(since))
    if until is not None:
        chosen = chosen.filter(F.col("run_time") <= times.ntz(until))
    stored = _stored(spark, path, chosen, keys)
    # Only what another run of the window has replaced; such calls are few, and mostly there are none.
    written = spark.read.schema(_replaced(keys)).parquet(f"{path}/replaced")
    replaced = written.join(chosen.select(F.col("run_id").alias("won")), "won", "left_semi")
    replaced = replaced.join(chosen.select(F.col("run_id").alias("lost")), "lost", "left_semi")
    replaced = replaced.select(*_call(keys), F.col("lost").alias("run_id")).distinct()
    n = replaced.count()
    if n:
        listed = F.broadcast(replaced) if n <= BROADCAST_CALLS else replaced
        same = [F.col(f"s.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*_call(keys), "run_id")]
        stored = stored.alias("s").join(listed.alias("r"), same, "left_anti")
    return stored.select(*schema.names)


def read_window(
    spark: SparkSession,
    path: str,
    gauges: DataFrame,
    since: datetime | None = None,
    until: datetime | None = None,
    keys: T.StructType = schemas.NO_KEYS,
) -> tuple[DataFrame, DataFrame]:
    """Readings and audit of all runs of a window; without ends, of the whole history.

    A response is absent only if no run of the window has it.
    """
    calls = read_calls(spark, path, since, until, keys)
    audit = ingest.audit_of(calls, gauges, keys.names)
    return ingest.readings_of(calls, keys.names), audit


def load_or_refresh(
    spark: SparkSession,
    path: str,
    as_of: datetime,
    gauges: DataFrame,
    refresh: Refresh,
    max_age_minutes: int = MAX_AGE_MINUTES,
    keys: T.StructType = schemas.NO_KEYS,
) -> tuple[DataFrame, DataFrame]:
    """The newest stored refresh if it is fresh at ``as_of``, else a new one, stored and read back.

    ``refresh`` returns parsed calls.
    """
    stored = latest_run(spark, path)
    if stored is None or as_of - stored.run_time > timedelta(minutes=max_age_minutes):
        write_run(refresh(), path, run_id_of(as_of), as_of, keys)
        return read_window(spark, path, gauges, as_of, as_of, keys)
    return read_window(spark, path, gauges, stored.run_time, stored.run_time, keys)
