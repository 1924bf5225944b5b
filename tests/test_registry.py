"""Levels of any registry, and level extremes by month."""

import random
import re
from datetime import timedelta

from helpers import T0, keyed, reading, table
from pyspark.sql import functions as F
from test_clean import random_rows

from riffle import dims
from riffle.operators import bands, clean, levels, registry
from riffle.plans import pipeline

COLUMNS = ["mountain_time", "data_type", "river_level", "section_id", "flow_type", "flow_unit"]


def rows_of(df, *columns):
    return sorted(map(str, df.select(*(columns or COLUMNS)).collect()))


def test_built_in_tables_give_the_levels_of_the_wide_path(spark):
    cleaned = clean.clean_readings(table(spark, random_rows(5)), on_duplicate="latest")
    found = registry.section_levels(cleaned, dims.coefficients(spark), dims.sections(spark))
    assert rows_of(found) == rows_of(levels.section_levels(cleaned))


def test_networks_have_formulas_and_gauges_of_their_own(spark):
    rows = {1: [reading(901, 0, 2.0), reading(902, 1, 5.0)], 2: [reading(901, 0, 7.0), reading(2, 2, 1.0)]}
    formulas = [(1, 70, "standard", 901, 1.0), (1, 70, "standard", 902, -0.5), (2, 70, "standard", 901, 3.0), (2, 71, "standard", 5, 1.0)]
    coefficients = spark.createDataFrame(formulas, "network_id long, section_id int, flow_type string, gauge_id int, coef double")
    sections = spark.createDataFrame([(70, "cfs"), (71, "cfs")], "section_id int, flow_unit string")
    found = registry.section_levels(keyed(spark, rows), coefficients, sections, ("network_id",))
    levels_found = sorted((r.network_id, r.section_id, r.mountain_time.hour, r.river_level) for r in found.collect())
    # Gauge 902 is filled backwards, a gauge that never reports is zero, and every time of a network counts.
    assert levels_found == [(1, 70, 0, -0.5), (1, 70, 1, -0.5), (2, 70, 0, 21.0), (2, 70, 2, 21.0), (2, 71, 0, 0.0), (2, 71, 2, 0.0)]


def test_no_readings_and_no_formulas(spark):
    empty = table(spark, [])
    assert registry.section_levels(empty, dims.coefficients(spark), dims.sections(spark)).count() == 0
    none = dims.coefficients(spark).filter("false")
    assert registry.section_levels(table(spark, [reading(1, 0, 1.0)]), none, dims.sections(spark)).count() == 0


def gappy_networks():
    """Two networks over three months with late, sparse and silent gauges; no times in the month between for network 2."""
    random.seed(4)
    rows = {}
    for network, months in ((1, (0, 31, 62)), (2, (0, 62))):
        hours = [24 * day + random.randrange(24) for day in months for _ in range(6)]
        rows[network] = [
            reading(gauge, hour, random.choice([None, hour / 7 + gauge]), random.choice([None, hour / 3.0]))
            for hour in sorted(set(hours))
            for gauge in (1, 2, 3)
            if random.random() < 0.5 and (gauge < 3 or hour > 24 * 40)
        ]
    return rows


FORMULAS = [(7, "standard", 1, 1.5), (7, "standard", 2, -1.0), (7, "max", 3, 2.0), (8, "standard", 4, 1.0), (9, "standard", 3, None), (9, "standard", 1, 4.0), (10, "standard", 2, None)]
UNITS = {7: "cfs", 8: "cfs", 9: "feet", 10: "feet"}


def formula_tables(spark):
    coefficients = spark.createDataFrame(FORMULAS, "section_id int, flow_type string, gauge_id int, coef double")
    return coefficients, spark.createDataFrame(list(UNITS.items()), "section_id int, flow_unit string")


def test_months_are_filled_and_summed_as_by_hand(spark):
    networks = gappy_networks()
    expected, series = [], []
    for network, rows in networks.items():
        times = sorted({row[4] for row in rows})

        def filled(gauge, unit, rows=rows, times=times):
            known = {row[4]: row[5 if unit == "cfs" else 6] for row in rows if row[0] == gauge}
            known = {time: value for time, value in known.items() if value is not None}
            first = known[min(known)] if known else 0.0
            return [next((known[t] for t in reversed(times[: i + 1]) if t in known), first) for i in range(len(times))]

        series += [(network, t, g, u, v) for g, u in {(f[2], UNITS[f[0]]) for f in FORMULAS} for t, v in zip(times, filled(g, u))]
        for section, kind in {f[:2] for f in FORMULAS}:
            terms = [(c, filled(g, UNITS[section])) for s, k, g, c in FORMULAS if (s, k) == (section, kind) and c is not None]
            for i, time in enumerate(times):
                level = sum(c * values[i] for c, values in terms) if terms else None
                expected.append((network, time, section, kind, None if level is None else round(level, 3)))
    coefficients, sections = formula_tables(spark)
    found = registry.section_levels(keyed(spark, networks), coefficients, sections, ("network_id",)).collect()
    short = [(r.network_id, r.mountain_time, r.section_id, r.flow_type, None if r.river_level is None else round(r.river_level, 3)) for r in found]
    close = {row[:4]: row[4] for row in expected}
    assert len(short) == len(expected) and {row[:4] for row in short} == set(close)
    for row in short:
        assert (row[4] is None) == (close[row[:4]] is None) and (row[4] is None or abs(row[4] - close[row[:4]]) < 0.01), row
    wanted = coefficients.join(sections, "section_id").select("gauge_id", "flow_unit")
    long = registry.filled_series(keyed(spark, networks), wanted, ("network_id",))
    assert sorted((r.network_id, r.mountain_time, r.gauge_id, r.flow_unit, r.value) for r in long.collect()) == sorted(series)


def test_a_reading_without_a_time_is_a_time_but_no_value(spark):
    timeless = (1, "usgs", "observed", None, None, 50.0, 50.0)
    found = registry.section_levels(keyed(spark, {1: [timeless, reading(1, 0, 2.0)]}), *formula_tables(spark), ("network_id",))
    levels_found = {(r.mountain_time, r.river_level) for r in found.filter("section_id = 7 AND flow_type = 'standard'").collect()}
    assert levels_found == {(None, 3.0), (T0, 3.0)}


def test_cells_of_the_grid_are_not_moved(spark):
    hours = [reading(1, T0 + timedelta(hours=i), 1.0, 2.0) for i in range(48)]
    found = registry.section_levels(keyed(spark, {1: hours}), *formula_tables(spark), ("network_id",))
    plan = found._jdf.queryExecution().executedPlan().toString()
    # What moves is a reading or a month of a series, never a value at one time, and arrays are not broadcast.
    dealt = re.findall(r"Exchange hashpartitioning\((.*?)\)", plan)
    assert dealt and not [keys for keys in dealt if "mountain_time" in keys]
    assert re.search(r"SortMergeJoin .*LeftOuter", plan)


def test_extremes_by_month_merge_into_those_of_the_history(spark):
    cleaned = clean.clean_readings(table(spark, random_rows(9)), on_duplicate="latest")
    ranges = pipeline.ranges_of(cleaned)
    whole = bands.section_bounds(ranges)
    columns = ["section_id", "level_min", "level_max", "x_min", "x_max"]
    early, late = (bands.monthly_extrema(ranges.filter(f"hour(mountain_time) % 2 = {i}")) for i in range(2))
    assert rows_of(bands.bounds_of_extrema(bands.merge_extrema(early, late)), *columns) == rows_of(whole, *columns)
    # Corrected months take the place of those stored.
    wrong = bands.monthly_extrema(ranges.withColumn("river_level", F.col("river_level") + 1e6))
    corrected = bands.merge_extrema(wrong, bands.monthly_extrema(ranges), replace=True)
    assert rows_of(bands.bounds_of_extrema(corrected), *columns) == rows_of(whole, *columns)


def test_clamped_history_derives_the_domain_of_the_same_ranges(spark):
    cleaned = clean.clean_readings(table(spark, random_rows(3)), on_duplicate="latest")
    ranges, sections = pipeline.ranges_of(cleaned), pipeline.section_dim(spark)
    domain = bands.chart_domain(bands.section_bounds(ranges), sections)
    columns = ["section_id", "flow_type", "mountain_time", "river_level"]
    expected = rows_of(bands.clamped_series(ranges, domain), *columns)
    assert rows_of(bands.clamped_history(ranges, sections), *columns) == expected
