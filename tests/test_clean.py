"""Cut-off, conflicts, uniqueness."""

import random
from datetime import datetime

import pytest
from helpers import at, keyed, reading, table
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from riffle.operators import clean, selection


def slots(df, *extra):
    rows = df.select(*extra, "gauge_id", "data_type", "mountain_time", "flow_cfs").collect()
    return sorted(tuple(r) for r in rows)


def test_cutoff_is_global(spark):
    rows = [reading(1, 10, 5.0), reading(2, 10, 6.0, kind="forecast"), reading(2, 11, 7.0, kind="forecast")]
    expected = [(1, "observed", at(10), 5.0), (2, "forecast", at(11), 7.0)]
    assert slots(clean.forecast_cutoff(table(spark, rows))) == expected
    assert slots(clean.clean_readings(table(spark, rows))) == expected


def test_cutoff_per_network(spark):
    late = [reading(1, 20, 5.0), reading(1, 15, 6.0, kind="forecast")]
    early = [reading(1, 10, 5.0), reading(1, 15, 6.0, kind="forecast")]
    unseen = [reading(1, 15, 6.0, kind="forecast")]
    df = keyed(spark, {1: late, 2: early, 3: unseen})
    expected = [
        (1, 1, "observed", at(20), 5.0),
        (2, 1, "forecast", at(15), 6.0),
        (2, 1, "observed", at(10), 5.0),
    ]
    keys = ("network_id",)
    assert slots(clean.forecast_cutoff(df, keys), "network_id") == expected
    assert slots(clean.clean_readings(df, keys), "network_id") == expected


def test_no_observations_leave_nothing(spark):
    assert slots(clean.clean_readings(table(spark, [reading(1, 1, 2.0, kind="forecast")]))) == []


def test_conflict_filter(spark):
    rows = [
        reading(1, 1, 1.0),
        reading(1, 1, 2.0, kind="forecast"),
        reading(1, 2, 3.0, kind="forecast"),
        reading(1, 3, 4.0, kind="forecast"),
        reading(1, 3, 5.0, kind="forecast"),
        reading(1, 4, 6.0),
        reading(1, 4, 7.0),
    ]
    kept = sorted(r.flow_cfs for r in clean.conflict_filter(table(spark, rows)).collect())
    assert kept == [1.0, 3.0, 6.0, 7.0]


# Both instants are 01:00 in Denver.
FIRST, SECOND = datetime(2026, 11, 1, 7), datetime(2026, 11, 1, 8)
LOCAL = datetime(2026, 11, 1, 1)


def test_autumn_duplicate_observed(spark):
    df = table(spark, [reading(1, LOCAL, 1.0, utc=FIRST), reading(1, LOCAL, 2.0, utc=SECOND)])
    assert clean.duplicate_keys(df).first().copies == 2
    with pytest.raises(PySparkException, match="duplicate observed readings remain after cleaning: gauge 1"):
        clean.clean_readings(df).collect()
    assert slots(clean.clean_readings(df, on_duplicate="latest")) == [(1, "observed", LOCAL, 2.0)]


def test_autumn_duplicate_forecast(spark):
    rows = [
        reading(1, datetime(2026, 10, 31), 9.0),
        reading(1, LOCAL, 1.0, kind="forecast", utc=FIRST),
        reading(1, LOCAL, 2.0, kind="forecast", utc=SECOND),
    ]
    observed = (1, "observed", datetime(2026, 10, 31), 9.0)
    assert slots(clean.clean_readings(table(spark, rows))) == [observed]
    latest = clean.clean_readings(table(spark, rows), on_duplicate="latest")
    assert slots(latest) == [(1, "forecast", LOCAL, 2.0), observed]


def test_latest_keeps_a_null_value(spark):
    df = table(spark, [reading(1, LOCAL, 1.0, utc=FIRST), reading(1, LOCAL, None, utc=SECOND)])
    assert slots(clean.clean_readings(df, on_duplicate="latest")) == [(1, "observed", LOCAL, None)]


def test_several_version_columns(spark):
    rows = [reading(1, LOCAL, 1.0, utc=SECOND), reading(1, LOCAL, 2.0, utc=SECOND)]
    df = table(spark, rows).withColumn("run", F.col("flow_cfs"))
    kept = clean.clean_readings(df, on_duplicate="latest", version=("utc_time", "run"))
    assert slots(kept) == [(1, "observed", LOCAL, 2.0)]


def random_rows(seed, gauges=15, hours=60, observed_until=40):
    """Readings without observed duplicates; forecasts overlap the observations."""
    rng = random.Random(seed)
    rows = []
    for gauge in range(1, gauges + 1):
        for hour in range(hours):
            if hour <= observed_until and rng.random() < 0.5:
                rows.append(reading(gauge, hour, *values(rng)))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                rows.append(reading(gauge, hour, *values(rng), kind="forecast"))
    rng.shuffle(rows)
    return rows


def values(rng):
    return (
        None if rng.random() < 0.2 else rng.randrange(0, 2_000_000) / 100,
        None if rng.random() < 0.2 else rng.randrange(0, 900) / 100,
    )


def brute_force(rows):
    bound = max((r[4] for r in rows if r[2] == "observed"), default=None)
    kept = [r for r in rows if r[2] == "observed" or (bound is not None and r[4] > bound)]
    counts = {}
    for r in kept:
        counts[r[0], r[4]] = counts.get((r[0], r[4]), 0) + 1
    return sorted((r[0], r[2], r[4], r[5]) for r in kept if r[2] == "observed" or counts[r[0], r[4]] == 1)


def none_first(rows):
    return sorted(rows, key=lambda r: [(v is not None, v) for v in r])


def test_clean_against_brute_force(spark):
    rows = random_rows(1)
    cleaned = clean.clean_readings(table(spark, rows))
    got = [tuple(r) for r in cleaned.select("gauge_id", "data_type", "mountain_time", "flow_cfs").collect()]
    assert none_first(got) == none_first(brute_force(rows))
    assert clean.duplicate_keys(cleaned).count() == 0
    bound = cleaned.filter("data_type = 'observed'").agg(F.max("mountain_time")).first()[0]
    assert cleaned.filter("data_type = 'forecast'").agg(F.min("mountain_time")).first()[0] > bound
    # Cleaning again changes nothing.
    again = clean.clean_readings(cleaned)
    assert again.exceptAll(cleaned).count() == 0 and cleaned.exceptAll(again).count() == 0
    # The staged operators give the same rows as the single aggregation.
    staged = clean.conflict_filter(clean.forecast_cutoff(table(spark, rows)))
    staged = [tuple(r) for r in staged.select("gauge_id", "data_type", "mountain_time", "flow_cfs").collect()]
    assert none_first(staged) == none_first(got)


def test_hourly(spark):
    rows = [reading(1, 0, utc=datetime(2026, 4, 1, 12, 0, 45)), reading(1, 0, utc=datetime(2026, 4, 1, 12, 15))]
    out = clean.to_hourly_mountain(table(spark, rows).drop("mountain_time")).collect()
    assert [(r.utc_time, r.mountain_time) for r in out] == [(datetime(2026, 4, 1, 12), datetime(2026, 4, 1, 6))]


def test_source_cap_is_exact_for_a_crowded_gauge(spark):
    rows = spark.range(5000).selectExpr("id", "int(if(id % 10 < 9, 1, 2)) AS gauge_id", "5000 - id AS at")
    capped = selection.source_cap(rows, order=("at", "id"), cap=100)
    got = {g: sorted(r.id for r in capped.filter(f"gauge_id = {g}").collect()) for g in (1, 2)}
    everything = [(5000 - i, i, 1 if i % 10 < 9 else 2) for i in range(5000)]
    for gauge in (1, 2):
        assert got[gauge] == sorted(i for _, i, g in sorted(everything) if g == gauge)[-100:]


def test_lookback_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "r")
    table(spark, [reading(1, h, float(h)) for h in range(48)]).write.parquet(path)
    recent = selection.lookback(spark.read.parquet(path), at(30))
    assert sorted(r.flow_cfs for r in recent.collect()) == [float(h) for h in range(6, 31)]
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(mountain_time,2026-04-01T06:00)" in plan


def test_props_number_with_and_without_the_short_cut(spark):
    from riffle.sources import events

    texts = ['{"k": 7}', '{"k": 07}', '{"k": +7}', '{"k":8}', '{"j": 1, "k": 9}', '{"k": 1, "j": 2}', '{"k": "3"}', "{", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, props string")
    both = df.selectExpr("i", f"{events._k()} AS k", "try_cast(get_json_object(props, '$.k') AS int) AS slow").orderBy("i")
    rows = both.collect()
    assert [r.k for r in rows] == [r.slow for r in rows]
    assert [rows[0].k, rows[3].k, rows[4].k] == [7, 8, 9]
