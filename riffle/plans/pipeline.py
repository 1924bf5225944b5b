"""One refresh end to end: readings to current conditions, ranges, audit and clean readings."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riffle import dims, schemas
from riffle.operators import classify, clean, levels, summary
from riffle.sources import sink


class Result(NamedTuple):
    current: DataFrame
    ranges: DataFrame
    audit: DataFrame | None
    clean: DataFrame


def section_dim(spark: SparkSession) -> DataFrame:
    """The fixed section table. It never exceeds its 27 rows, so it may always be broadcast."""
    return F.broadcast(dims.sections(spark))


def river_dim(spark: SparkSession) -> DataFrame:
    """The fixed river table of 14 rows."""
    return F.broadcast(dims.rivers(spark))


def gauge_dim(spark: SparkSession) -> DataFrame:
    """The fixed gauge registry of 15 rows."""
    return F.broadcast(dims.gauges(spark))


def with_gauge_names(cleaned: DataFrame) -> DataFrame:
    """Names belong to gauges, so they are added after the readings have been reduced."""
    names = gauge_dim(cleaned.sparkSession).select("gauge_id", "gauge_name")
    return cleaned.join(names, "gauge_id", "left")


def ranges_of(cleaned: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Classified levels of every series at every time."""
    return classify.level_ranges(levels.section_levels(cleaned, keys), section_dim(cleaned.sparkSession), keys)


def view_of(cleaned: DataFrame, names: Sequence[str] = summary.DEFAULT_SECTIONS, keys: Sequence[str] = ()) -> DataFrame:
    """Level series of the named sections, derived for them alone; names that no section has give nothing."""
    chosen = levels.named_series(names)
    if not chosen:
        return summary.series_view(ranges_of(cleaned, keys), names, keys)
    sections = section_dim(cleaned.sparkSession)
    ranges = classify.level_ranges(levels.section_levels(cleaned, keys, chosen), sections, keys)
    return summary.series_view(ranges, names, keys)


def current_of(cleaned: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Current conditions, reduced straight from cleaned readings."""
    spark = cleaned.sparkSession
    return summary.current_from_readings(cleaned, section_dim(spark), river_dim(spark), keys)


def run(
    readings: DataFrame,
    audit: DataFrame | None = None,
    keys: Sequence[str] = (),
    on_duplicate: str = "error",
    version: Sequence[str] = ("utc_time",),
) -> Result:
    """Declare the whole refresh. Nothing runs until one of the results is used.

    Each result cleans the readings again; ``run_stored`` cleans once and is for callers that use several.
    """
    cleaned = clean.clean_readings(readings, keys, on_duplicate, version)
    return Result(current_of(cleaned, keys), ranges_of(cleaned, keys), audit, with_gauge_names(cleaned))


def run_stored(
    spark: SparkSession,
    path: str,
    into: str,
    since: datetime | None = None,
    keys: T.StructType = schemas.NO_KEYS,
) -> Result:
    """The refresh over the stored calls of a window, its clean readings written once under ``into``.

    Runs may hold the same hour of a gauge several times; the one of the newest run counts.
    """
    readings, audit = sink.read_window(spark, path, gauge_dim(spark), since, keys=keys)
    version = ("run_time", "utc_time")
    with_gauge_names(clean.clean_readings(readings, keys.names, "latest", version)).write.mode("overwrite").parquet(into)
    cleaned = spark.read.parquet(into)
    return Result(current_of(cleaned, keys.names), ranges_of(cleaned, keys.names), audit, cleaned)
