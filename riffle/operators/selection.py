"""Source-side selection, catalogue look-ups and ingest audit counts over tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riffle.functions import times

# What one source request may ask for.
PARAMETER_CODES = ("00060", "00065")
LOOKBACK_HOURS = 24
ROW_CAP = 1000
# End of fixed values.


def source_filter(df: DataFrame, gauge_ids: Sequence[int], codes: Sequence[str] = PARAMETER_CODES) -> DataFrame:
    """Readings of the given locations and parameter codes."""
    return df.filter(F.col("gauge_id").isin(list(gauge_ids)) & F.col("parameter_code").isin(list(codes)))


def lookback(df: DataFrame, as_of: datetime | str, column: str = "mountain_time", hours: int = LOOKBACK_HOURS) -> DataFrame:
    """Rows of the last ``hours`` before ``as_of``; both bounds are literals, so they reach the scan."""
    end = times.ntz(as_of)
    start = end - F.make_dt_interval(F.lit(0), F.lit(hours))
    return df.filter((F.col(column) >= start) & (F.col(column) <= end))


def source_cap(
    df: DataFrame, order: Sequence[str], cap: int = ROW_CAP, by: Sequence[str] = ("gauge_id",), spread: int = 64
) -> DataFrame:
    """First ``cap`` rows per group in the given order, which must be total.

    Ranking runs twice: within ``spread`` slices of each group, then over the survivors. Each map
    task ranks before it shuffles, and a crowded group is never gathered whole.
    """
    ordering = [F.col(c) for c in order]
    slices = Window.partitionBy(*by, "slice").orderBy(*ordering)
    groups = Window.partitionBy(*by).orderBy(*ordering)
    sliced = df.withColumn("slice", F.pmod(F.xxhash64(*order), F.lit(spread)))
    survivors = sliced.withColumn("place", F.row_number().over(slices)).filter(F.col("place") <= cap)
    ranked = survivors.withColumn("place", F.row_number().over(groups)).filter(F.col("place") <= cap)
    return ranked.drop("slice", "place")


def parameter_pivot(df: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Flow and stage columns from narrow rows of (parameter code, value)."""
    flow, stage = (F.max(F.when(F.col("parameter_code") == code, F.col(value))) for code in PARAMETER_CODES)
    return df.groupBy(*by).agg(flow.alias("flow_cfs"), stage.alias("stage_ft"))


def stamp_run(df: DataFrame, run_time: datetime | str) -> DataFrame:
    """Add the local wall clock of the run, given as a job parameter."""
    return df.withColumn("run_time", times.ntz(run_time))


def is_fresh(run_time: Column, as_of: Column, max_age_minutes: int) -> Column:
    return run_time >= as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(max_age_minutes))


def section_names(sections: DataFrame) -> DataFrame:
    """Names to choose from."""
    return sections.select("section_name").distinct()


def section_lookup(sections: DataFrame, name: str) -> DataFrame:
    """The record of one section."""
    return sections.filter(F.col("section_name") == name).limit(1)


def section_links(sections: DataFrame, *columns: str) -> DataFrame:
    """One row per link and video; sections with neither do not appear."""
    nothing = F.array().cast("array<string>")

    def tagged(kind: str) -> Column:
        url = F.coalesce(F.col(kind), nothing)
        return F.transform(url, lambda u: F.struct(F.lit(kind).alias("kind"), u.alias("url")))

    media = F.concat(tagged("link"), tagged("video"))
    return sections.filter(F.size(media) > 0).select("section_id", "section_name", *columns, F.inline(media))
