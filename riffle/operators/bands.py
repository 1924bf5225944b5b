"""Chart bands: background rectangles that show the flow classes behind a level series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riffle.functions import numbers, times
from riffle.functions.labels import BLUE, GREEN, RED, YELLOW
from riffle.operators.classify import THRESHOLDS

# Fixed value: head room above the top threshold or level.
HEADROOM = 1.1


def section_bounds(ranges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Level extremes over both flow types, and the time extent of the standard series."""
    standard_time = F.when(F.col("flow_type") == "standard", F.col("mountain_time"))
    return ranges.groupBy(*keys, "section_id").agg(
        F.min("river_level").cast("double").alias("level_min"),
        F.max("river_level").cast("double").alias("level_max"),
        F.min(standard_time).alias("x_min"),
        F.max(standard_time).alias("x_max"),
    )


MONTH = "month"
_EXTREMES = {"level_min": F.min, "level_max": F.max, "x_min": F.min, "x_max": F.max}


def monthly_extrema(ranges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, section_id, month, level_min, level_max, x_min, x_max``: what ``section_bounds`` needs, by month.

    A table of these, one row per section and month, stands for a history of any length.
    """
    month = F.coalesce(times.month_number(F.col("mountain_time")), F.lit(0)).alias(MONTH)
    return section_bounds(ranges.select("*", month), [*keys, MONTH]).select(*keys, "section_id", MONTH, *_EXTREMES)


def merge_extrema(stored: DataFrame, more: DataFrame, keys: Sequence[str] = (), replace: bool = False) -> DataFrame:
    """Two tables of monthly extrema as one. With ``replace`` the second one's months are whole and take the place of the
    first one's, section by section, as when late hours have been corrected; else both count."""
    place = [*keys, "section_id", MONTH]
    if replace:
        return stored.join(more.select(*place), place, "left_anti").unionByName(more)
    both = stored.unionByName(more)
    return both.groupBy(*place).agg(*[of(name).alias(name) for name, of in _EXTREMES.items()])


def bounds_of_extrema(extrema: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The bounds that ``section_bounds`` finds in the whole history."""
    return extrema.groupBy(*keys, "section_id").agg(*[of(name).alias(name) for name, of in _EXTREMES.items()])


def _bands(*edges: tuple) -> Column:
    """Array of bands from (y1, y2, colour) triples."""
    return F.array(
        *[
            F.struct(
                F.lit(low).cast("double").alias("y1"), F.lit(high).cast("double").alias("y2"), F.lit(color).alias("color")
            )
            for low, high, color in edges
        ]
    )


def _band_array() -> Column:
    """The bands worth drawing, given where the series lies relative to the thresholds."""
    low, medium, high, top = (F.col(t) for t in THRESHOLDS)
    level_min, level_max = F.col("level_min"), F.col("level_max")
    below = _bands((0.0, low, RED), (low, medium, BLUE))
    above = _bands((high, top, YELLOW), (top, level_max * HEADROOM, RED))
    in_lower_half = _bands(
        (low / 2, low, RED), (low, medium, BLUE), (medium, high, GREEN), (high, (high * 2 + top) / 3, YELLOW)
    )
    ceiling = top * HEADROOM
    in_upper_half = _bands(
        ((low + medium) / 2, medium, BLUE), (medium, high, GREEN), (high, top, YELLOW), (top, ceiling, RED)
    )
    everything = _bands(
        (0.0, low, RED), (low, medium, BLUE), (medium, high, GREEN), (high, top, YELLOW), (top, ceiling, RED)
    )
    return (
        F.when(level_max < low, below)
        .when(level_min > top, above)
        .when((level_min > low) & (level_max < high), in_lower_half)
        .when(level_min > medium, in_upper_half)
        .otherwise(everything)
    )


def _banded(bounds: DataFrame, sections: DataFrame) -> DataFrame:
    dim = sections.select("section_id", *THRESHOLDS)
    return bounds.join(dim, "section_id").withColumn("bands", _band_array())


def section_bands(bounds: DataFrame, sections: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Two to five bands per section, with the time extent and the axis domain they span."""
    banded = _banded(bounds, sections)
    return banded.select(
        *keys,
        "section_id",
        "x_min",
        "x_max",
        F.array_min(F.col("bands.y1")).alias("domain_min"),
        F.array_max(F.col("bands.y2")).alias("domain_max"),
        F.inline("bands"),
    )


def chart_domain(bounds: DataFrame, sections: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Axis domain per section, one row each."""
    return _banded(bounds, sections).select(
        *keys,
        "section_id",
        F.array_min(F.col("bands.y1")).alias("domain_min"),
        F.array_max(F.col("bands.y2")).alias("domain_max"),
    )


def clamped_series(ranges: DataFrame, domain: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Level series cut off at the axis domain of its section."""
    level = F.col("river_level").cast("double")
    # At most one domain row per section and network; its runtime size decides how to join.
    return ranges.join(domain, [*keys, "section_id"]).select(
        *keys,
        "section_id",
        "section_name",
        "flow_type",
        "mountain_time",
        numbers.clamp(level, F.col("domain_min"), F.col("domain_max")).alias("river_level"),
    )


def clamped_history(ranges: DataFrame, sections: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``clamped_series`` within the domain of the same ranges, which are derived once.

    A section's series are gathered by month, at most a few rows per hour of it, and the months' extremes give the
    domain, so what a window sees is a row per month and series.
    """
    series = [*keys, "section_id", "section_name", "flow_type"]
    month = F.coalesce(times.month_number(F.col("mountain_time")), F.lit(0)).alias(MONTH)
    level = F.col("river_level").cast("double")
    standard_time = F.when(F.col("flow_type") == "standard", F.col("mountain_time"))
    months = ranges.select("*", month).groupBy(*series, MONTH).agg(
        F.collect_list(F.struct("mountain_time", level.alias("level"))).alias("points"),
        F.min(level).alias("level_min"),
        F.max(level).alias("level_max"),
        F.min(standard_time).alias("x_min"),
        F.max(standard_time).alias("x_max"),
    )
    whole = Window.partitionBy(*keys, "section_id")
    bounded = months.withColumns({name: of(name).over(whole) for name, of in _EXTREMES.items()})
    banded = _banded(bounded, sections)
    domain = {"domain_min": F.array_min(F.col("bands.y1")), "domain_max": F.array_max(F.col("bands.y2"))}
    rows = banded.withColumns(domain).select(*series, *domain, F.inline("points"))
    clamped = numbers.clamp(F.col("level"), F.col("domain_min"), F.col("domain_max"))
    return rows.select(*keys, "section_id", "section_name", "flow_type", "mountain_time", clamped.alias("river_level"))
