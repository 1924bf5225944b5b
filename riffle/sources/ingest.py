"""Payload tables to readings and audit rows, for all gauges and sources at once."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riffle.operators.audit import expected_calls
from riffle.operators.selection import stamp_run
from riffle.sources import parsers


NOT_REGISTERED = "not registered for this source"


def parse_calls(payloads: DataFrame, gauges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per landed call, parsed by the source it came from, in one pass over the payloads.

    The registry routes each gauge to one observed source and the forecast source. A response that
    the registry does not ask for is not read; its error says so.
    """
    wanted = expected_calls(gauges).filter("known").select("gauge_id", "gauge_name", "identifier", "source")
    routed = payloads.join(wanted, ["gauge_id", "source"], "left")
    parsed = parsers.parse_all(routed.withColumn("registered", F.col("gauge_name").isNotNull()))
    missing = F.when(~F.col("registered"), F.lit(NOT_REGISTERED))
    columns = [*keys, "call_id", "gauge_id", "gauge_name", "identifier", "source", "data_source", "data_type"]
    return parsed.withColumn("error", F.coalesce(missing, "error")).select(*columns, "rows", "error", "readings")


def readings_of(calls: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Hourly readings of all calls; ``utc_time`` is null where the source reports local time."""
    stamp = [c for c in ("run_time",) if c in calls.columns]
    rows = calls.select(
        *keys,
        *stamp,
        "gauge_name",
        "gauge_id",
        F.col("data_source").alias("source"),
        "data_type",
        F.inline_outer("readings"),
    )
    # The outer form, minus its null rows: for the inner one Spark would infer a non-empty filter and
    # push it below the parsing stages, which then all run a second time, folded into one expression.
    rows = rows.filter("mountain_time IS NOT NULL")
    # A local time has no known instant, but must still order against others of its source.
    return rows.withColumn("utc_time", F.coalesce("utc_time", "mountain_time"))


def audit_of(calls: DataFrame, gauges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One audit row per call, and one for every expected call that never landed.

    With keys, calls are expected of every network of which anything landed.
    """
    columns = [*keys, "call_id", "gauge_name", "identifier", "source", "data_type", "rows", "error"]
    registry = expected_calls(gauges)
    expected = registry
    if keys:
        # The registry as one value, at most two calls per gauge, set out for each network.
        fields = F.collect_list(F.struct(*registry.columns))
        expected = calls.select(*keys).distinct().select(*keys, F.inline(registry.agg(fields).scalar()))
    arrived = calls.select(*keys, "gauge_id", "source").distinct()
    missing = expected.join(arrived, [*keys, "gauge_id", "source"], "left_anti")
    reason = F.when(F.col("known"), F.lit("no response landed")).otherwise(
        F.concat(F.lit("unknown observed source: "), F.col("source"))
    )
    absent = missing.withColumns(
        {"call_id": F.lit(None).cast("string"), "rows": F.lit(0).cast("bigint"), "error": reason}
    )
    return calls.select(*columns).unionByName(absent.select(*columns))


def read_all(
    payloads: DataFrame, gauges: DataFrame, run_time: datetime | str, keys: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Readings and audit of one refresh, both stamped with the run time.

    Without any landed response the readings are empty, with their schema.
    """
    calls = parse_calls(payloads, gauges, keys)
    return stamp_run(readings_of(calls, keys), run_time), stamp_run(audit_of(calls, gauges, keys), run_time)
