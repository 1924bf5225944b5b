"""Gauge readings bound to the ``events`` test table.

``user_id`` names the gauge (and, for many networks, the network), ``event_type`` and time the
data type (whatever lies after the last observation is a forecast), ``value`` and ``props.k`` the two
metrics. Every event becomes a reading. Several events may fall into one gauge hour,
so ``event_id`` serves as the version that decides between them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riffle import dims
from riffle.functions import times

NETWORK_KEYS = ("network_id",)
VERSION = ("event_id",)
FORECAST_TYPES = ("signup", "error")
OBSERVED_END = "2024-01-25 00:00:00"
GAUGE_COUNT = len(dims.GAUGE_IDS)
_RECLAMATION = ", ".join(str(row[0]) for row in dims.GAUGE_ROWS if row[6] == "bureau_reclamation")
SOURCE = (
    "CASE WHEN data_type = 'forecast' THEN 'noaa_forecast' "
    f"WHEN gauge_id IN ({_RECLAMATION}) THEN 'bureau_reclamation' ELSE 'usgs' END"
)


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _k() -> str:
    """``props.k``. Where the text is exactly ``{"k": <digits>}`` the digits are cut out, at a seventh
    of the cost of the JSON parser that reads every other text."""
    digits = "substring(props, 7, length(props) - 7)"
    plain = f"""props LIKE '{{"k": %}}' AND string(try_cast({digits} AS int)) = {digits}"""
    return f"if({plain}, try_cast({digits} AS int), try_cast(get_json_object(props, '$.k') AS int))"


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as one reading; nothing is deduplicated here.

    The local time is only computed where a query uses it.
    """
    types = ", ".join(repr(t) for t in FORECAST_TYPES)
    forecast = f"event_type IN ({types}) OR ts >= TIMESTAMP_NTZ'{OBSERVED_END}'"
    bound = read_events(spark, sf_dir).selectExpr(
        "event_id",
        f"user_id div {GAUGE_COUNT} AS network_id",
        f"int(user_id % {GAUGE_COUNT} + 1) AS gauge_id",
        f"if({forecast}, 'forecast', 'observed') AS data_type",
        "ts AS utc_time",
        "value",
        f"{_k()} AS k",
    )
    return bound.select(
        "*",
        times.to_local(times.floor_hour(F.col("utc_time"))).alias("mountain_time"),
        F.expr("if(k >= 5, value * 40, null) AS flow_cfs"),
        F.expr("if(k < 95, value / 15, null) AS stage_ft"),
        F.expr("if(k < 50, '00060', '00065') AS parameter_code"),
        F.expr(f"{SOURCE} AS source"),
    )


def hourly_readings(df: DataFrame, keys=()) -> DataFrame:
    """Latest event per gauge, data type and UTC hour, then moved to local time.

    Reducing first leaves the zone conversion with one row per gauge and hour instead of one per
    event. Where two UTC hours share a local one, the cleaning decides by ``event_id`` again.
    """
    observed = F.expr("data_type = 'observed'").alias("observed")
    hour = times.hour_number(F.col("utc_time")).alias("hour")
    latest = df.groupBy(*keys, "gauge_id", observed, hour).agg(
        F.expr("max_by(flow_cfs, event_id) AS flow_cfs"),
        F.expr("max_by(stage_ft, event_id) AS stage_ft"),
        F.expr("max(event_id) AS event_id"),
    )
    local = times.to_local(times.from_hour(F.col("hour")))
    typed = latest.withColumns({"mountain_time": local, "data_type": F.expr("if(observed, 'observed', 'forecast')")})
    return typed.withColumn("source", F.expr(SOURCE)).drop("hour", "observed")


def latest_observation(df: DataFrame, keys=()) -> DataFrame:
    """The cut-off bound from a narrow scan of the events; whole hours keep their order in local time."""
    newest = df.filter("data_type = 'observed'").groupBy(*keys).agg(F.max("utc_time").alias("utc_time"))
    return newest.select(*keys, times.to_local(times.floor_hour(F.col("utc_time"))).alias("max_observed"))


def distinct_readings(df: DataFrame, keys=()) -> DataFrame:
    """Latest event per gauge, data type and local hour."""
    newest = df.groupBy(*keys, "gauge_id", "data_type", "mountain_time").agg(
        F.expr("max_by(flow_cfs, event_id) AS flow_cfs"), F.expr("max_by(stage_ft, event_id) AS stage_ft")
    )
    return newest.withColumn("source", F.expr(SOURCE))
