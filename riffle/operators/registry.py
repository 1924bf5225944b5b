"""Section levels for any registry: gauges and formulas come as tables and may differ from network to network.

The grid of a network is its times by the gauge series that its formulas use. Nothing is pivoted, so neither the number
of gauges nor that of sections shows in the plan. A month of a series is one row with an array of its values, so what
moves between tasks grows with readings, series and months; cells of the grid are only made inside a row. A month's times are
numbered in order, and only one carry value per series and month crosses a month's border.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riffle import dims
from riffle.operators.levels import BLOCK, INDEX, _with_block

SERIES = ("gauge_id", "flow_unit")


def terms_of(coefficients: DataFrame, sections: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Coefficients with the unit of their section. Either table may hold the keys; one that does not holds for all networks."""
    shared = [k for k in keys if k in coefficients.columns and k in sections.columns]
    units = sections.select(*[k for k in keys if k in sections.columns], "section_id", "flow_unit")
    return coefficients.join(units, [*shared, "section_id"])


def _numbered(clean: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Readings by (network, month), each with the ``number`` of its time, from 1."""
    blocked = _with_block(clean).select(*keys, BLOCK, *INDEX, "gauge_id", *dims.METRIC_OF_UNIT.values()).repartition(*keys, BLOCK)
    order = f"PARTITION BY {', '.join([*keys, BLOCK])} ORDER BY {', '.join(INDEX)}"
    return blocked.selectExpr("*", f"dense_rank() OVER ({order}) AS number")


def _months(numbered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, time_block, times``: the times of each network and month, in order."""
    each = numbered.select(*keys, BLOCK, F.struct("number", *INDEX).alias("time"))
    return each.groupBy(*keys, BLOCK).agg(F.array_sort(F.collect_set("time")).alias("times"))


def _packed(numbered: DataFrame, series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, time_block, gauge_id, flow_unit, size, numbers, known, before``: of each month of a wanted series the known values
    with the numbers of their times, how many times there are, and the value that holds before the first known one."""
    blocks = numbered.groupBy(*keys, BLOCK).agg(F.max("number").alias("size"))
    if all(k in series.columns for k in keys) and keys:
        wanted = blocks.join(series.select(*keys, *SERIES).distinct(), list(keys))
    else:
        # One list for all networks, as one value: it is a registry, not data.
        listed = series.select(*SERIES).distinct().agg(F.collect_list(F.struct(*SERIES))).scalar()
        wanted = blocks.select("*", F.inline(listed))
    units = [F.struct(F.lit(unit).alias("flow_unit"), F.col(metric).alias("value")) for unit, metric in dims.METRIC_OF_UNIT.items()]
    values = numbered.select(*keys, BLOCK, "mountain_time", "number", "gauge_id", F.inline(F.array(*units))).filter("value IS NOT NULL")
    # A reading without a time is a row of the grid, but its value belongs nowhere.
    values = values.filter("mountain_time IS NOT NULL")
    place = [*keys, BLOCK, *SERIES]
    held = values.groupBy(*place).agg(F.array_sort(F.collect_list(F.struct("number", "value"))).alias("pairs"))
    held = held.select(*place, F.col("pairs.number").alias("numbers"), F.col("pairs.value").alias("known"))
    months = f"PARTITION BY {', '.join([*keys, *SERIES])} ORDER BY {BLOCK}"
    # Arrays are far larger than the planner takes them for, so the hint keeps them from being broadcast.
    return wanted.join(held.hint("merge"), place, "left").selectExpr(
        *place,
        "size",
        "coalesce(numbers, CAST(array() AS array<int>)) AS numbers",
        "coalesce(known, CAST(array() AS array<double>)) AS known",
        f"coalesce(last(get(known, size(known) - 1)) IGNORE NULLS OVER ({months} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), "
        f"first(get(known, 0)) IGNORE NULLS OVER ({months} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0D) AS before",
    )


def _unpacked(row: str = "") -> str:
    """The value at each time of the month, as an array: every known one holds until the next."""
    numbers, known, size = f"{row}numbers", f"{row}known", f"{row}size"
    lead = f"array_repeat({row}before, coalesce(get({numbers}, 0), {size} + 1) - 1)"
    until = f"coalesce(get({numbers}, i + 1), {size} + 1)"
    return f"concat({lead}, flatten(transform({known}, (x, i) -> array_repeat(x, {until} - get({numbers}, i)))))"


def filled_series(clean: DataFrame, series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, time_block, mountain_time, data_type, gauge_id, flow_unit, value``: a value at every time of the network for every
    wanted series: the last one before, else the first one after, else zero.

    ``series`` has ``gauge_id, flow_unit`` and, where networks differ, the keys. A gauge without readings is zero. Times are
    those of all readings of a network, wanted or not.
    """
    numbered = _numbered(clean, keys)
    met = _packed(numbered, series, keys).join(_months(numbered, keys), [*keys, BLOCK])
    met = met.selectExpr(*keys, BLOCK, *SERIES, "times", f"{_unpacked()} AS value")
    filled = met.select(*keys, BLOCK, *SERIES, F.inline(F.arrays_zip("times", "value")))
    return filled.select(*keys, BLOCK, *[f"times.{c}" for c in INDEX], *SERIES, "value")


def section_levels(clean: DataFrame, coefficients: DataFrame, sections: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, mountain_time, data_type, river_level, section_id, flow_type, flow_unit``: each section in its own unit.

    ``coefficients`` has ``section_id, flow_type, gauge_id, coef``, ``sections`` has ``section_id, flow_unit``; see ``terms_of``
    for keys. A sum has no fixed order, so it is rounded to twelve decimals, far below what the narrowing cast keeps. The fill
    is that of ``filled_series``, still packed by month when it meets the formulas.
    """
    terms = terms_of(coefficients, sections, keys)
    own = [k for k in keys if k in terms.columns]
    if own and len(own) < len(keys):
        raise ValueError(f"formulas must hold all of {list(keys)} or none")
    numbered = _numbered(clean, keys)
    packed = _packed(numbered, terms.select(*own, *SERIES), keys)
    met = packed.join(terms.select(*own, *SERIES, "section_id", "flow_type", "coef"), [*own, *SERIES])
    of_section = [*keys, BLOCK, "section_id", "flow_type", "flow_unit"]
    part = F.struct("coef", "size", "numbers", "known", "before")
    # By month, so that the months' times meet the sums without moving them.
    parts = met.repartition(*keys, BLOCK).groupBy(*of_section).agg(F.collect_list(part).alias("parts"))
    # Null coefficients do not count, as in sum().
    summed = parts.join(_months(numbered, keys), [*keys, BLOCK]).selectExpr(
        *of_section,
        "times",
        "aggregate(parts, array_repeat(CAST(NULL AS DOUBLE), size(times)), (sums, part) -> "
        f"zip_with(sums, {_unpacked('part.')}, (s, v) -> coalesce(coalesce(s, 0D) + part.coef * v, s))) AS sums",
    )
    each = summed.select(*of_section, F.inline(F.arrays_zip("times", "sums")))
    level = F.round("sums", 12).cast("float").alias("river_level")
    return each.select(*keys, *[f"times.{c}" for c in INDEX], level, "section_id", "flow_type", "flow_unit")
