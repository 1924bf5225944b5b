"""Column functions."""

from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from riffle.functions import labels, numbers, times


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def each(spark, fn, values, kind):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def test_parse_instant(spark):
    texts = [
        "2026-04-01T12:00:45Z",
        "2026-04-01T12:00:00+00:00",
        "2026-04-01T12:00:00-07:00",
        "2026-04-01T12:00:00+0530",
        "2026-04-01T12:00:00",
        "2026-04-01 12:00:00Z",
        "2026-13-01T12:00:00Z",
        "",
        None,
    ]
    assert each(spark, times.parse_instant, texts, "string") == [
        datetime(2026, 4, 1, 12, 0, 45),
        datetime(2026, 4, 1, 12),
        datetime(2026, 4, 1, 19),
        datetime(2026, 4, 1, 6, 30),
        None,
        None,
        None,
        None,
        None,
    ]


def test_parse_local(spark):
    texts = ["2026-03-08 02:30", "2026-03-08 02:30:00", "2026-03-08", " 2026-03-08 02:30", None]
    assert each(spark, times.parse_local, texts, "string") == [datetime(2026, 3, 8, 2, 30), None, None, None, None]


CLOCKS = [
    (datetime(2026, 7, 1, 18), datetime(2026, 7, 1, 12)),
    (datetime(2026, 1, 1, 18), datetime(2026, 1, 1, 11)),
    (datetime(2026, 11, 1, 7), datetime(2026, 11, 1, 1)),
    (datetime(2026, 11, 1, 8), datetime(2026, 11, 1, 1)),
    (datetime(2026, 3, 8, 8), datetime(2026, 3, 8, 1)),
    (datetime(2026, 3, 8, 9), datetime(2026, 3, 8, 3)),
]


@pytest.mark.parametrize("zone", ["UTC", "America/Denver", "Asia/Kolkata"])
def test_times_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert each(spark, times.to_local, [utc for utc, _ in CLOCKS], "timestamp_ntz") == [local for _, local in CLOCKS]
        # 02:30 does not exist in Denver on this day; a wall clock keeps it.
        gap = [datetime(2026, 3, 8, 2, 30, 45, 5), None]
        assert each(spark, times.floor_hour, gap, "timestamp_ntz") == [datetime(2026, 3, 8, 2), None]
        assert each(spark, times.floor_minute, gap, "timestamp_ntz") == [datetime(2026, 3, 8, 2, 30), None]
        hours = each(spark, lambda c: times.from_hour(times.hour_number(c)), gap + [datetime(1969, 12, 31, 23, 59)], "timestamp_ntz")
        assert hours == [datetime(2026, 3, 8, 2), None, datetime(1969, 12, 31, 23)]
        assert one(spark, times.parse_instant(F.lit("2026-03-08T02:30:00Z"))) == datetime(2026, 3, 8, 2, 30)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_lenient_double(spark):
    texts = [" 1234.50 ", "NO RECORD", "", "3.1\r", "1,234", None, "1.5d", "2f", "0x1p3", "1e3", "-.5", "7.", "Infinity", "1e", "."]
    want = [1234.5, None, None, 3.1, None, None, None, None, None, 1000.0, -0.5, 7.0, float("inf"), None, None]
    assert each(spark, numbers.lenient_double, texts, "string") == want


def test_display_level(spark):
    values = [1234.0, 3.5, None, -1234.0, 1234567.5, float("nan"), 0.0]
    assert each(spark, numbers.display_level, values, "double") == ["1,234", "3.50", "", "-1,234", "1,234,567.50", "", "0"]


def test_round_level(spark):
    feet = each(spark, lambda c: numbers.round_level(c, F.lit("feet")), [3.456, 2.125, None], "float")
    assert [None if v is None else round(v, 4) for v in feet] == [3.46, 2.12, None]
    cfs = each(spark, lambda c: numbers.round_level(c, F.lit("cfs")), [1234.2, -4.5, 7.0, float("nan")], "float")
    assert cfs[:3] == [1235.0, -4.0, 7.0] and cfs[3] != cfs[3]


def test_clamp_keeps_null(spark):
    assert each(spark, lambda c: numbers.clamp(c, F.lit(1.0), F.lit(2.0)), [0.0, 1.5, 9.0, None], "double") == [1.0, 1.5, 2.0, None]


def test_flow_range_thresholds(spark):
    bounds = [F.lit(v) for v in (1500.0, 4000.0, 8000.0, 15000.0)]
    levels = [1499.9, 1500.0, 4000.0, 8000.0, 15000.0, None, float("nan")]
    assert each(spark, lambda c: labels.flow_range(c, *bounds), levels, "double") == [
        "Too Low", "Low", "Medium", "High", "Too High", "Too High", "Too High",
    ]


def test_flow_rank_rejects_other_classes(spark):
    assert each(spark, labels.flow_rank, list(labels.CLASSES), "string") == [5, 3, 2, 1, 4]
    with pytest.raises(PySparkException, match="no rank for flow range: Flood"):
        each(spark, labels.flow_rank, ["Flood"], "string")


def test_colors(spark):
    assert each(spark, labels.flow_color, ["High", "Flood", None], "string") == [labels.YELLOW, None, None]


def test_column_names(spark):
    names = ["section_id_8", "section_id_23_max"]
    assert each(spark, labels.section_of_column, names, "string") == [8, 23]
    assert each(spark, labels.flow_type_of_column, names, "string") == ["standard", "max"]


def test_codes_round_trip_and_reject(spark):
    df = spark.createDataFrame([("High",), (None,)], "v string")
    code = df.selectExpr(f"{labels.code_sql('v', labels.CLASSES)} AS c")
    back = code.selectExpr(f"{labels.text_sql('c', labels.CLASSES)} AS v")
    assert [r.v for r in back.collect()] == ["High", None]
    with pytest.raises(PySparkException, match="outside the fixed list"):
        spark.createDataFrame([("Flood",)], "v string").selectExpr(labels.code_sql("v", labels.CLASSES)).collect()
