"""Row counts per source call, including the calls that brought nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: how the audit names the forecast source. The audit and the readings name sources differently.
FORECAST_SOURCE = "noaa"


def expected_calls(gauges: DataFrame) -> DataFrame:
    """One observed and one forecast call per gauge, with the identifier each call uses."""
    observed_api = F.col("observed_api")
    usgs = observed_api == "waterdata_usgs"
    reclamation = observed_api == "bureau_reclamation"
    observed = F.struct(
        F.when(usgs, F.col("waterdata_usgs_identifier"))
        .when(reclamation, F.col("bureau_reclamation_identifier"))
        .alias("identifier"),
        F.when(usgs, F.lit("usgs")).when(reclamation, F.lit("bureau_rec")).otherwise(observed_api).alias("source"),
        F.lit("observed").alias("data_type"),
        (usgs | reclamation).alias("known"),
    )
    forecast = F.struct(
        F.col("noaa_forecast_identifier").alias("identifier"),
        F.lit(FORECAST_SOURCE).alias("source"),
        F.lit("forecast").alias("data_type"),
        F.lit(True).alias("known"),
    )
    return gauges.select("gauge_id", "gauge_name", F.inline(F.array(observed, forecast)))


def audit_rows(readings: DataFrame, gauges: DataFrame) -> DataFrame:
    """Readings per expected call; calls without readings count zero."""
    counts = readings.groupBy("gauge_id", "data_type").agg(F.count(F.lit(1)).alias("rows"))
    calls = expected_calls(gauges).join(counts, ["gauge_id", "data_type"], "left")
    return calls.select(
        "gauge_name",
        "identifier",
        "source",
        "data_type",
        F.coalesce("rows", F.lit(0)).alias("rows"),
        F.when(~F.col("known"), F.concat(F.lit("unknown observed source: "), F.col("source"))).alias("error"),
    )
