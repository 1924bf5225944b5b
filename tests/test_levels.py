"""Matrices, gap filling, derived levels and classification."""

import random
from datetime import datetime, timedelta

import pytest
from helpers import at, keyed, reading, table
from pyspark.sql import functions as F
from test_clean import random_rows

from riffle import dims
from riffle.functions import labels
from riffle.operators import bands, classify, clean, levels, summary
from riffle.plans import fixed_values as fixed
from riffle.plans import pipeline


def column(df, name, *keys):
    return [tuple(r) for r in df.select(*keys, "mountain_time", name).orderBy(*keys, "mountain_time").collect()]


def test_dims(spark):
    assert (dims.rivers(spark).count(), dims.gauges(spark).count(), dims.sections(spark).count()) == (14, 15, 27)
    assert (len(dims.SERIES), len(dims.COEFFICIENT_ROWS)) == (30, 37)
    assert dims.RIVER_ROWS == fixed.RIVERS and dims.GAUGE_ROWS == fixed.GAUGES and dims.SECTION_ROWS == fixed.SECTIONS
    assert sorted(dims.COEFFICIENT_ROWS) == sorted(fixed.COEFFICIENTS)
    assert (labels.RANKS, labels.CLASS_COLORS) == (fixed.RANKS, fixed.CLASS_COLORS)
    first = dims.sections(spark).filter("section_id = 1").first()
    assert first.link is None and first.video is None and first.high_level == 8000.0
    assert len(dims.sections(spark).filter("section_id = 10").first().video) == 6


def test_fill(spark):
    # Gauge 1 has a gap inside and a leading one; gauge 2 only sets the time axis.
    rows = [reading(1, 1, 1.0), reading(1, 3, 2.0), *[reading(2, h) for h in range(4)]]
    filled = levels.filled_gauges(table(spark, rows), "flow_cfs")
    assert [v for _, v in column(filled, "1")] == [1.0, 1.0, 1.0, 2.0]
    assert [v for _, v in column(filled, "2")] == [0.0] * 4
    assert [v for _, v in column(filled, "7")] == [0.0] * 4


def test_fill_crosses_into_the_forecast(spark):
    rows = [reading(1, 0, 1.0), reading(2, 1, 5.0, kind="forecast"), reading(1, 2, 3.0, kind="forecast")]
    filled = levels.filled_gauges(table(spark, rows), "flow_cfs")
    assert [v for _, v in column(filled, "1")] == [1.0, 1.0, 3.0]
    assert [v for _, v in column(filled, "2")] == [5.0, 5.0, 5.0]


def test_nan_is_not_filled(spark):
    rows = [reading(1, 0, 1.0), reading(1, 1, float("nan")), reading(1, 2)]
    filled = levels.filled_gauges(table(spark, rows), "flow_cfs")
    assert [str(v) for _, v in column(filled, "1")] == ["1.0", "nan", "nan"]
    now = summary.snapshot_levels(table(spark, rows)).filter("section_id = 16").first()
    assert str(now.river_level) == "nan"


def fill_by_hand(series):
    out, last = [], None
    first = next((v for v in series if v is not None), 0.0)
    for v in series:
        last = v if v is not None else last
        out.append(first if last is None else last)
    return out


def test_fill_over_months_and_networks_against_brute_force(spark):
    rng = random.Random(5)
    start = datetime(2025, 11, 20)
    times = [start + timedelta(hours=17 * i) for i in range(150)]
    networks, expected = {}, {}
    for network in range(3):
        rows = []
        for gauge in range(1, 16):
            # Some gauges are silent for whole months, one altogether.
            share = 0.0 if gauge == 4 + network else 0.03 if gauge % 3 else 0.6
            series = [rng.random() if rng.random() < share else None for _ in times]
            rows += [reading(gauge, t, v) for t, v in zip(times, series) if v is not None or gauge == 1]
            expected[network, gauge] = fill_by_hand(series)
        networks[network] = rows
    keys = ("network_id",)
    filled = levels.filled_gauges(keyed(spark, networks), "flow_cfs", keys)
    by_network = {}
    for r in filled.orderBy("network_id", "mountain_time").collect():
        by_network.setdefault(r.network_id, []).append(r)
    for (network, gauge), values in expected.items():
        assert [r[str(gauge)] for r in by_network[network]] == values
    alone = levels.filled_gauges(table(spark, networks[1]), "flow_cfs")
    assert [v for _, v in column(alone, "3")] == expected[1, 3]


def test_formulas(spark):
    rows = [reading(g, 0, float(v)) for g, v in {2: 1, 3: 2, 4: 10, 5: 20, 6: 3, 13: 7}.items()]
    wide = levels.section_levels_wide(table(spark, rows), "flow_cfs").first()
    assert (wide.section_id_8, wide.section_id_8_max, wide.section_id_10) == (30.0, -4.0, -1.0)
    assert (wide.section_id_25, wide.section_id_25_max, wide.section_id_1) == (7.0, 2.0, 1.0)
    ranges = pipeline.ranges_of(table(spark, rows))
    negative = ranges.filter("section_id = 8 AND flow_type = 'max'").first()
    assert (negative.river_level, negative.flow_range) == (-4.0, "Too Low")


@pytest.fixture(scope="module")
def cleaned(spark):
    return clean.clean_readings(table(spark, random_rows(2))).cache()


def same(a, b):
    b = b.select(a.columns)
    return a.count() == b.count() and a.exceptAll(b).count() == 0


def test_all_ways_to_the_ranges_agree(spark, cleaned):
    ranges = pipeline.ranges_of(cleaned).cache()
    union = levels.level_union(
        levels.to_long(levels.section_levels_wide(cleaned, "stage_ft"), "feet"),
        levels.to_long(levels.section_levels_wide(cleaned, "flow_cfs"), "cfs"),
    )
    assert union.count() == 2 * ranges.count()
    assert same(classify.level_ranges(union, dims.sections(spark)), ranges)
    by_coefficient = levels.section_levels_long(cleaned, dims.coefficients(spark), "flow_cfs")
    cfs = union.filter("flow_unit = 'cfs'").drop("flow_unit")
    rounded = F.round(F.col("river_level").cast("double"), 1)
    assert same(by_coefficient.withColumn("river_level", rounded), cfs.withColumn("river_level", rounded))
    # One row per time and series, and no level is missing.
    assert ranges.count() == cleaned.select("mountain_time", "data_type").distinct().count() * 30
    assert ranges.filter("river_level IS NULL").count() == 0
    # The class never falls as the level rises.
    rank = F.array_position(F.expr("array('Too Low', 'Low', 'Medium', 'High', 'Too High')"), F.col("flow_range"))
    spans = ranges.groupBy("section_id", rank.alias("rank")).agg(F.min("river_level"), F.max("river_level")).collect()
    by_section = {}
    for section, r, low, high in sorted(spans):
        assert by_section.get(section, float("-inf")) <= low
        by_section[section] = high


def test_both_ways_to_the_current_levels_agree(spark, cleaned):
    ranges = pipeline.ranges_of(cleaned)
    full = summary.current_levels(ranges, dims.rivers(spark)).collect()
    assert full == pipeline.current_of(cleaned).collect()
    assert same(summary.latest_section(ranges), summary.snapshot_section(cleaned, dims.sections(spark)))
    # Every section appears once.
    names = [n for row in full for n in row.sections.split(", ")]
    assert sorted(names) == sorted(row[3] for row in dims.SECTION_ROWS)
    ranks = [{"High": 1, "Medium": 2, "Low": 3, "Too High": 4, "Too Low": 5}[r.flow_range] for r in full]
    assert ranks == sorted(ranks)


def test_snapshot_takes_the_first_forecast_of_an_unobserved_gauge(spark):
    rows = [
        reading(1, 0, 5.0),
        reading(2, 1, 900.0, kind="forecast"),
        reading(2, 2, 100.0, kind="forecast"),
        reading(3, 0, 50.0),
        reading(3, 1, 70.0, kind="forecast"),
    ]
    df = table(spark, rows)
    now = {(r.section_id, r.flow_type): r.river_level for r in summary.snapshot_levels(df).collect()}
    assert (now[1, "standard"], now[5, "standard"], now[10, "standard"]) == (900.0, 50.0, 850.0)
    newest = pipeline.ranges_of(df).filter("data_type = 'observed'").collect()
    assert {(r.section_id, r.flow_type): r.river_level for r in newest} == now
    assert summary.snapshot_levels(table(spark, [reading(1, 0, 5.0, kind="forecast")])).count() == 0


def test_sections_with_equal_values_share_a_row(spark):
    rows = [reading(2, 0, 6500.0), reading(10, 0, stage=3.456)]
    current = {r.sections: r for r in pipeline.current_of(table(spark, rows)).collect()}
    assert current["Lower Main, The Main"].river_level == "6,500"
    assert current["Middle Fork Salmon"].river_level == "3.46"
    assert current["Lower Main, The Main"].river_level_max == "" and current["Lower Main, The Main"].flow_range_max is None
    colored = summary.with_colors(pipeline.current_of(table(spark, rows))).filter("sections = 'Lower Main, The Main'").first()
    assert (colored.color, colored.color_max) == ("#2ECC71", None)


def series(spark, values, section=1, flow_type="standard"):
    rows = [(at(i), section, flow_type, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "mountain_time timestamp_ntz, section_id int, flow_type string, river_level double")


R, B, G, Y = "#E74C3C", "#89CFF0", "#2ECC71", "#FFEA00"
# Section 1 has the thresholds 1500, 4000, 8000 and 15000.
BANDS = {
    "all below": ([900, 1000], [(0, 1500, R), (1500, 4000, B)]),
    "all above": ([16000, 20000], [(8000, 15000, Y), (15000, 22000, R)]),
    "lower half": ([1600, 7000], [(750, 1500, R), (1500, 4000, B), (4000, 8000, G), (8000, 31000 / 3, Y)]),
    "upper half": ([5000, 9000], [(2750, 4000, B), (4000, 8000, G), (8000, 15000, Y), (15000, 16500, R)]),
    "everything": ([1000, 9000], [(0, 1500, R), (1500, 4000, B), (4000, 8000, G), (8000, 15000, Y), (15000, 16500, R)]),
    "touching the lowest threshold": (
        [1000, 1500],
        [(0, 1500, R), (1500, 4000, B), (4000, 8000, G), (8000, 15000, Y), (15000, 16500, R)],
    ),
}


@pytest.mark.parametrize("case", BANDS)
def test_bands(spark, case):
    values, expected = BANDS[case]
    ranges = series(spark, values)
    out = bands.section_bands(bands.section_bounds(ranges), dims.sections(spark)).orderBy("y1").collect()
    assert [r.color for r in out] == [c for *_, c in expected]
    assert [(r.y1, r.y2) for r in out] == [pytest.approx(pair) for *pair, _ in expected]
    assert {(r.x_min, r.x_max) for r in out} == {(at(0), at(1))}
    assert {(r.domain_min, r.domain_max) for r in out} == {(min(r.y1 for r in out), max(r.y2 for r in out))}


def test_bounds_use_both_types_but_standard_times(spark):
    ranges = series(spark, [2000, 3000]).unionByName(series(spark, [9000, 1, 9000], flow_type="max"))
    bound = bands.section_bounds(ranges).first()
    assert (bound.level_min, bound.level_max, bound.x_min, bound.x_max) == (1.0, 9000.0, at(0), at(1))


def test_clamped_series(spark):
    ranges = series(spark, [5000, 9000, 20000]).withColumn("section_name", F.lit("The Main"))
    domain = bands.chart_domain(bands.section_bounds(ranges), dims.sections(spark))
    out = bands.clamped_series(ranges, domain).orderBy("mountain_time").collect()
    assert [r.river_level for r in out] == [5000.0, 9000.0, 16500.0]


def test_views(spark):
    rows = [reading(3, 0, 5.0), reading(13, 0, 6.0)]
    ranges = pipeline.ranges_of(table(spark, rows))
    view = summary.series_view(ranges, ["The Cabarton"])
    assert sorted((r.section_name, r.river_level) for r in view.collect()) == [("The Cabarton", 6.0), ("The Cabarton (Max)", 5.0)]
    assert {r.section_name for r in summary.series_view(ranges).collect()} == {"Staircase", "The Canyon", "The Canyon (Max)"}
