"""Current conditions and the forecast and section views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riffle import dims
from riffle.functions import labels, numbers
from riffle.operators import classify, levels

# Sections shown in the forecast view unless others are asked for (fixed value).
DEFAULT_SECTIONS = ("Staircase", "The Canyon")


def latest_section(ranges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Latest observed level per section and flow type, rounded for its unit.

    ``max_by`` keeps one candidate per group in every task, so no series is gathered or sorted.
    """
    newest = (
        ranges.filter(F.col("data_type") == "observed")
        .groupBy(*keys, "section_name", "flow_type")
        .agg(
            F.expr("max_by(river_level, mountain_time) AS level"),
            F.expr(f"max_by({labels.code_sql('flow_range', labels.CLASSES)}, mountain_time) AS class_code"),
            F.expr("max_by(flow_unit = 'feet', mountain_time) AS in_feet"),
            F.expr("max_by(river_id, mountain_time) AS river_id"),
        )
    )
    unit = F.expr("if(in_feet, 'feet', 'cfs')")
    return newest.select(
        *keys,
        "section_name",
        "flow_type",
        numbers.round_level(F.col("level"), unit).alias("river_level"),
        F.expr(f"{labels.text_sql('class_code', labels.CLASSES)} AS flow_range"),
        "river_id",
    )


def snapshot_levels(clean: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Levels of every series at the network's latest observed time, without the dense matrix.

    At that time forward fill yields each gauge's last observed value; a gauge never observed
    takes its first forecast, and one without any value zero. Both ends are plain aggregates, so
    the history is reduced in the map tasks to one row per gauge.
    """
    metrics = sorted(set(dims.METRIC_OF_UNIT.values()))
    gauges = clean.groupBy(*keys, "gauge_id").agg(
        F.expr("max(mountain_time) FILTER (WHERE data_type = 'observed') AS observed_until"),
        *[
            F.expr(f"{pick}({m}, mountain_time) FILTER (WHERE data_type {kind} AND {m} IS NOT NULL) AS {name}_{m}")
            for m in metrics
            for pick, kind, name in (("max_by", "= 'observed'", "last"), ("min_by", "<> 'observed'", "next"))
        ],
    )
    # Only nulls become zero; NaN is a value.
    cells = [
        F.expr(f"coalesce(max(coalesce(last_{m}, next_{m})) FILTER (WHERE gauge_id = {g}), 0D) AS {column}")
        for column, (m, g) in levels.unit_series().items()
    ]
    networks = gauges.groupBy(*keys).agg(F.max("observed_until").alias("mountain_time"), *cells)
    return networks.filter("mountain_time IS NOT NULL").selectExpr(
        *keys, "mountain_time", "'observed' AS data_type", levels.unit_levels()
    )


def snapshot_ranges(clean: DataFrame, sections: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Classified levels at the latest observed time; equals the newest rows of the full ranges."""
    return classify.level_ranges(snapshot_levels(clean, keys), sections, keys)


def snapshot_section(clean: DataFrame, sections: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``latest_section`` straight from cleaned readings."""
    return snapshot_ranges(clean, sections, keys).select(
        *keys,
        "section_name",
        "flow_type",
        numbers.round_level(F.col("river_level"), F.col("flow_unit")).alias("river_level"),
        "flow_range",
        "river_id",
    )


def current_pivot(latest: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per section: standard and max level with their classes side by side."""
    code = labels.code_sql("flow_range", labels.CLASSES)
    wide = latest.groupBy(*keys, "section_name", "river_id").agg(
        F.expr("max(river_level) FILTER (WHERE flow_type = 'standard') AS river_level"),
        F.expr(f"max({code}) FILTER (WHERE flow_type = 'standard') AS class_code"),
        F.expr("max(river_level) FILTER (WHERE flow_type = 'max') AS river_level_max"),
        F.expr(f"max({code}) FILTER (WHERE flow_type = 'max') AS class_code_max"),
    )
    return wide.selectExpr(
        *keys,
        "section_name",
        "river_id",
        "river_level",
        f"{labels.text_sql('class_code', labels.CLASSES)} AS flow_range",
        "river_level_max",
        f"{labels.text_sql('class_code_max', labels.CLASSES)} AS flow_range_max",
    )


def current_rivers(pivoted: DataFrame, rivers: DataFrame) -> DataFrame:
    """Add the river name; sections of an unknown river go."""
    return pivoted.join(rivers.select("river_id", "river_name"), "river_id")


def with_rank(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", labels.flow_rank(F.col("flow_range")))


def summarise(latest: DataFrame, rivers: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Display table of latest levels; sections of a river with equal values share a row.

    Without keys the rows come in display order; with keys they are ordered within each network.
    """
    ranked = with_rank(current_rivers(current_pivot(latest, keys), rivers))
    merged = ranked.groupBy(
        *keys, "river_name", "river_level", "flow_range", "river_level_max", "flow_range_max", "rank"
    ).agg(labels.joined_names(F.col("section_name")).alias("sections"))
    order = [F.asc("rank"), F.desc_nulls_first("river_level"), F.asc("sections")]
    # A total order over many networks would cost a range shuffle of them all and serve no reader.
    ordered = merged.repartition(*keys).sortWithinPartitions(*keys, *order) if keys else merged.orderBy(*order)
    return ordered.select(
        *keys,
        "sections",
        numbers.display_level(F.col("river_level")).alias("river_level"),
        "flow_range",
        numbers.display_level(F.col("river_level_max")).alias("river_level_max"),
        "flow_range_max",
    )


def current_levels(ranges: DataFrame, rivers: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Current conditions from the full table of ranges."""
    return summarise(latest_section(ranges, keys), rivers, keys)


def current_from_readings(
    clean: DataFrame, sections: DataFrame, rivers: DataFrame, keys: Sequence[str] = ()
) -> DataFrame:
    """Current conditions straight from cleaned readings; same rows as ``current_levels``."""
    return summarise(snapshot_section(clean, sections, keys), rivers, keys)


def with_colors(current: DataFrame) -> DataFrame:
    """Background colours of the two level columns; none where there is no class."""
    return current.withColumns(
        {
            "color": labels.flow_color(F.col("flow_range")),
            "color_max": labels.flow_color(F.col("flow_range_max")),
        }
    )


def series_view(ranges: DataFrame, names: Sequence[str] = DEFAULT_SECTIONS, keys: Sequence[str] = ()) -> DataFrame:
    """Level series of the named sections, max series labelled as such."""
    label = labels.series_label(F.col("section_name"), F.col("flow_type"))
    return ranges.filter(F.col("section_name").isin(list(names))).select(
        *keys, label.alias("section_name"), "mountain_time", "river_level", "flow_type"
    )
