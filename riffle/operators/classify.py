"""Thresholds applied to section levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riffle.functions import labels

THRESHOLDS = ("min_level", "medium_level", "high_level", "max_level")


def level_ranges(levels: DataFrame, sections: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Join levels to their sections in the section's own unit and classify each level."""
    dim = sections.select("section_id", "river_id", "section_name", "flow_unit", *THRESHOLDS)
    joined = levels.join(dim, ["section_id", "flow_unit"])
    return joined.select(
        *keys,
        "mountain_time",
        "data_type",
        "river_level",
        "section_id",
        "flow_type",
        "flow_unit",
        "river_id",
        "section_name",
        labels.flow_range(F.col("river_level"), *[F.col(t) for t in THRESHOLDS]).alias("flow_range"),
    )
