"""Flow classes, colours, series labels and derived-column names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Classes in ascending order of level, display ranks, colours, suffixes and sources.
CLASSES = ("Too Low", "Low", "Medium", "High", "Too High")
RANKS = {"High": 1, "Medium": 2, "Low": 3, "Too High": 4, "Too Low": 5}
RED, BLUE, GREEN, YELLOW = "#E74C3C", "#89CFF0", "#2ECC71", "#FFEA00"
CLASS_COLORS = {"Too Low": RED, "Low": BLUE, "Medium": GREEN, "High": YELLOW, "Too High": RED}
MAX_LABEL = " (Max)"
SOURCES = ("usgs", "bureau_reclamation", "noaa_forecast")
# End of fixed values.


def _quoted(value) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(value, str) else str(value)


def array_sql(values) -> str:
    return f"array({', '.join(_quoted(v) for v in values)})"


def lookup(key: Column, mapping: dict) -> Column:
    """Literal map lookup; null when the key is absent."""
    pairs = ", ".join(f"{_quoted(k)}, {_quoted(v)}" for k, v in mapping.items())
    return F.try_element_at(F.expr(f"map({pairs})"), key)


def code_sql(column: str, values) -> str:
    """Position of a text in a fixed list; any other text is an error.

    Aggregating codes keeps hash aggregation, which text buffers would turn into a sort.
    """
    position = f"int(array_position({array_sql(values)}, {column}))"
    unknown = f"int(raise_error(concat('value outside the fixed list: ', {column})))"
    return f"CASE WHEN {column} IS NULL THEN NULL WHEN {position} > 0 THEN {position} ELSE {unknown} END"


def text_sql(code: str, values) -> str:
    return f"try_element_at({array_sql(values)}, {code})"


def flow_rank(flow_range: Column) -> Column:
    """Display rank of a class; a class without a rank is an error."""
    rank = lookup(flow_range, RANKS)
    message = F.concat(F.lit("no rank for flow range: "), F.coalesce(flow_range, F.lit("null")))
    return F.coalesce(rank, F.raise_error(message).cast("int"))


def flow_color(flow_range: Column) -> Column:
    return lookup(flow_range, CLASS_COLORS)


def series_label(section_name: Column, flow_type: Column) -> Column:
    return F.when(flow_type == "standard", section_name).otherwise(F.concat(section_name, F.lit(MAX_LABEL)))


def section_of_column(name: Column) -> Column:
    return F.regexp_replace(name, "^section_id_|_max$", "").cast("int")


def flow_type_of_column(name: Column) -> Column:
    return F.when(name.contains("_max"), F.lit("max")).otherwise(F.lit("standard"))


def flow_range(level: Column, low: Column, medium: Column, high: Column, top: Column) -> Column:
    """Class of a level; a level on a threshold belongs to the class above it."""
    too_low, lower, middle, higher, too_high = (F.lit(name) for name in CLASSES)
    return (
        F.when(level < low, too_low)
        .when(level < medium, lower)
        .when(level < high, middle)
        .when(level < top, higher)
        .otherwise(too_high)
    )


def joined_names(name: Column) -> Column:
    return F.array_join(F.array_sort(F.collect_list(name)), ", ")
