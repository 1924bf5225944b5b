"""Gap-free gauge matrices and the section levels derived from them.

A matrix has one row per network, time and data type, and one column per gauge series. It is
built and filled in calendar-month blocks: both the pivot and the fill window run on the same
(network, month) partitioning, and only one carry row per block crosses block borders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riffle import dims
from riffle.functions import labels, times

INDEX = ("mountain_time", "data_type")
BLOCK = "time_block"


def _with_block(df: DataFrame) -> DataFrame:
    # Not nullable, so joining on it adds no null filter that would tell the two readers of one
    # shuffle apart and keep Spark from reusing it.
    return df.withColumn(BLOCK, F.coalesce(times.month_number(F.col("mountain_time")), F.lit(0)))


def series_matrix(clean: DataFrame, series: dict[str, tuple[str, int]], keys: Sequence[str] = ()) -> DataFrame:
    """Pivot ``{column: (metric, gauge_id)}``; the block column stays in the result.

    Cleaned readings are unique per gauge and time, so each cell holds at most one value.
    """
    blocked = _with_block(clean).repartition(*keys, BLOCK)
    cells = [
        F.expr(f"max({metric}) FILTER (WHERE gauge_id = {gauge}) AS `{column}`")
        for column, (metric, gauge) in series.items()
    ]
    return blocked.groupBy(*keys, BLOCK, *INDEX).agg(*cells)


def gauge_matrix(
    clean: DataFrame, metric: str, keys: Sequence[str] = (), gauge_ids: Sequence[int] = dims.GAUGE_IDS
) -> DataFrame:
    """One column per gauge, named by its number."""
    return series_matrix(clean, {str(g): (metric, g) for g in gauge_ids}, keys).drop(BLOCK)


def fill_gaps(matrix: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Fill each column forward, then backward, then with zero, along time within a network.

    Forward fill runs per block. What crosses a border is the last value of the earlier blocks; a
    leading gap takes the first value of the whole series.
    """
    blocked = matrix if BLOCK in matrix.columns else _with_block(matrix)
    network = ", ".join(keys) or "0"
    series = f"PARTITION BY {', '.join([*keys, BLOCK])} ORDER BY {', '.join(INDEX)}"
    months = f"PARTITION BY {network} ORDER BY {BLOCK}"
    so_far = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    earlier = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    whole = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"

    # One row per network and month.
    edges = blocked.groupBy(*keys, BLOCK).agg(
        *[F.expr(f"max_by(`{c}`, mountain_time) FILTER (WHERE `{c}` IS NOT NULL) AS `last_{c}`") for c in columns],
        *[F.expr(f"min_by(`{c}`, mountain_time) FILTER (WHERE `{c}` IS NOT NULL) AS `first_{c}`") for c in columns],
    )
    carry = edges.selectExpr(
        *keys,
        BLOCK,
        *[
            f"coalesce(last(`last_{c}`) IGNORE NULLS OVER ({months} {earlier}), "
            f"first(`first_{c}`) IGNORE NULLS OVER ({months} {whole}), 0D) AS `before_{c}`"
            for c in columns
        ],
    )
    forward = blocked.selectExpr(
        *keys, BLOCK, *INDEX, *[f"last(`{c}`) IGNORE NULLS OVER ({series} {so_far}) AS `{c}`" for c in columns]
    )
    return forward.join(carry, [*keys, BLOCK]).selectExpr(
        *keys, *INDEX, *[f"coalesce(`{c}`, `before_{c}`) AS `{c}`" for c in columns]
    )


def filled_gauges(clean: DataFrame, metric: str, keys: Sequence[str] = ()) -> DataFrame:
    """Gauge matrix of one metric without gaps."""
    columns = {str(g): (metric, g) for g in dims.GAUGE_IDS}
    return fill_gaps(series_matrix(clean, columns, keys), list(columns), keys)


def formula(series: dims.Series, column_of=str) -> str:
    """Signed sum of gauge columns, evaluated from left to right."""
    signed = [f"{'-' if term < 0 else '+'} `{column_of(abs(term))}`" for term in series.terms]
    return " ".join(signed).removeprefix("+ ")


def section_levels_wide(clean: DataFrame, metric: str, keys: Sequence[str] = ()) -> DataFrame:
    """One column per derived series (``section_id_1`` to ``section_id_27`` and the ``_max`` ones)."""
    filled = filled_gauges(clean, metric, keys)
    return filled.selectExpr(*keys, *INDEX, *[f"{formula(s)} AS {s.column}" for s in dims.SERIES])


def to_long(wide: DataFrame, flow_unit: str, keys: Sequence[str] = ()) -> DataFrame:
    """Unpivot derived series columns; section and flow type come from the column name."""
    ids = [*keys, *INDEX]
    names = [c for c in wide.columns if c not in ids]
    long = wide.unpivot(ids, names, "series", "river_level")
    return long.select(
        *ids,
        F.col("river_level").cast("float").alias("river_level"),
        labels.section_of_column(F.col("series")).alias("section_id"),
        labels.flow_type_of_column(F.col("series")).alias("flow_type"),
        F.lit(flow_unit).alias("flow_unit"),
    )


def level_union(feet: DataFrame, cfs: DataFrame) -> DataFrame:
    """All series in both units, duplicates kept."""
    return feet.unionByName(cfs)


def named_series(names: Sequence[str]) -> list[dims.Series]:
    """The series of the named sections."""
    ids = {row[0] for row in dims.SECTION_ROWS if row[3] in names}
    return [s for s in dims.SERIES if s.section_id in ids]


def unit_levels(chosen: Sequence[dims.Series] = dims.SERIES) -> str:
    """The series, each in the unit of its own section, as an ``inline`` over the filled columns."""

    def one(s: dims.Series) -> str:
        unit = dims.UNIT_OF_SECTION[s.section_id]
        level = formula(s, lambda gauge: f"{dims.METRIC_OF_UNIT[unit]}_{gauge}")
        return f"struct(float({level}), {s.section_id}, '{s.flow_type}', '{unit}')"

    rows = ", ".join(one(s) for s in chosen)
    return f"inline(array({rows})) AS (river_level, section_id, flow_type, flow_unit)"


def unit_series(chosen: Sequence[dims.Series] = dims.SERIES) -> dict[str, tuple[str, int]]:
    """Only the gauge series that some section uses in its own unit."""
    pairs = {(dims.METRIC_OF_UNIT[dims.UNIT_OF_SECTION[s.section_id]], abs(term)) for s in chosen for term in s.terms}
    return {f"{metric}_{gauge}": (metric, gauge) for metric, gauge in sorted(pairs)}


def section_levels(
    clean: DataFrame, keys: Sequence[str] = (), chosen: Sequence[dims.Series] = dims.SERIES
) -> DataFrame:
    """Long levels of the series in their sections' units, from one matrix of both metrics.

    Equals the union of both units after the section join has discarded the foreign unit. Only the
    gauges that the chosen series need are pivoted and filled; the times are those of all gauges.
    """
    series = unit_series(chosen)
    filled = fill_gaps(series_matrix(clean, series, keys), list(series), keys)
    return filled.selectExpr(*keys, *INDEX, unit_levels(chosen))


def section_levels_long(
    clean: DataFrame, coefficients: DataFrame, metric: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Levels from a coefficient table instead of fixed formulas.

    A sum has no fixed order, so it is rounded to six decimals before the narrowing cast.
    """
    filled = filled_gauges(clean, metric, keys)
    ids = [*keys, *INDEX]
    gauges = filled.unpivot(ids, [str(g) for g in dims.GAUGE_IDS], "gauge", "value")
    terms = gauges.withColumn("gauge_id", F.col("gauge").cast("int")).join(coefficients, "gauge_id")
    level = F.round(F.sum(F.col("coef") * F.col("value")), 6).cast("float")
    return terms.groupBy(*ids, "section_id", "flow_type").agg(level.alias("river_level"))
