"""Small readings tables for tests."""

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

T0 = datetime(2026, 4, 1)

READING = T.StructType(
    [
        T.StructField("gauge_id", T.IntegerType()),
        T.StructField("source", T.StringType()),
        T.StructField("data_type", T.StringType()),
        T.StructField("utc_time", T.TimestampNTZType()),
        T.StructField("mountain_time", T.TimestampNTZType()),
        T.StructField("flow_cfs", T.DoubleType()),
        T.StructField("stage_ft", T.DoubleType()),
    ]
)


def at(hours: float) -> datetime:
    return T0 + timedelta(hours=hours)


def reading(gauge, hour, flow=None, stage=None, kind="observed", utc=None):
    """One reading; ``hour`` counts from T0, or is a datetime."""
    local = hour if isinstance(hour, datetime) else at(hour)
    source = "noaa_forecast" if kind == "forecast" else "bureau_reclamation" if gauge == 13 else "usgs"
    return (gauge, source, kind, utc or local, local, flow, stage)


def table(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame(rows, READING)


def keyed(spark: SparkSession, rows_by_network) -> DataFrame:
    schema = T.StructType([T.StructField("network_id", T.LongType()), *READING.fields])
    return spark.createDataFrame([(n, *row) for n, rows in rows_by_network.items() for row in rows], schema)
