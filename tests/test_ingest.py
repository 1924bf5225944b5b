"""Landed responses to readings and audit rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riffle import dims, schemas
from riffle.plans import pipeline
from riffle.sources import ingest, payloads, sink
from riffle.streaming import refresh

RUN = datetime(2026, 4, 1, 7, 30)

FORECAST_KCFS = '{"primaryUnits":"kcfs","data":[{"validTime":"2026-04-01T12:00:00Z","primary":1.5,"secondary":3.0}]}'
FORECAST_FEET = '{"primaryUnits":"ft","data":[{"validTime":"2026-04-01T12:00:00Z","primary":3.0,"secondary":1.5}]}'
FORECAST_EMPTY = '{"primaryUnits":"kcfs","data":[]}'
OBSERVED = """{"features":[
 {"properties":{"time":"2026-04-01T12:00:00+00:00","parameter_code":"00060","value":"1500"}},
 {"properties":{"time":"2026-04-01T12:00:00+00:00","parameter_code":"00065","value":"3.2"}},
 {"properties":{"time":"2026-04-01T12:15:00+00:00","parameter_code":"00065","value":"3.3"}}]}"""
CSV = "DateTime,csci_q,csci_gh\n2026-04-01 10:00, 1234.50 ,NO RECORD\n2026-04-01 10:15,12.0, 3.1\n2026-04-01 11:00,,3.20\n"


def land(spark, rows):
    numbered = [(source, gauge, f"call-{i}", text) for i, (source, gauge, text) in enumerate(rows)]
    return spark.createDataFrame(numbered, schemas.PAYLOADS)


def readings(spark, rows):
    calls = ingest.parse_calls(land(spark, rows), dims.gauges(spark))
    columns = ["gauge_id", "source", "data_type", "mountain_time", "flow_cfs", "stage_ft"]
    return [tuple(r) for r in ingest.readings_of(calls).select(columns).orderBy("gauge_id", "mountain_time").collect()]


def audit(spark, rows, gauges=None):
    gauges = dims.gauges(spark) if gauges is None else gauges
    calls = ingest.parse_calls(land(spark, rows), gauges)
    table = ingest.audit_of(calls, gauges)
    return {(r.gauge_name, r.source): (r.identifier, r.data_type, r.rows, r.error) for r in table.collect()}


def test_forecast_units(spark):
    rest = ("noaa_forecast", "forecast", datetime(2026, 4, 1, 6), 1500.0, 3.0)
    assert readings(spark, [("noaa", 1, FORECAST_KCFS), ("noaa", 2, FORECAST_FEET)]) == [(1, *rest), (2, *rest)]


def test_empty_forecast_is_audited_without_error(spark):
    assert readings(spark, [("noaa", 1, FORECAST_EMPTY)]) == []
    found = audit(spark, [("noaa", 1, FORECAST_EMPTY)])
    assert found[(dims.GAUGE_NAMES[1], "noaa")] == ("13337000", "forecast", 0, None)
    assert found[(dims.GAUGE_NAMES[1], "usgs")] == ("USGS-13337000", "observed", 0, "no response landed")
    assert len(found) == 30


def test_observed_pivot_and_audit_counts_before_hour_filter(spark):
    expected = [(2, "usgs", "observed", datetime(2026, 4, 1, 6), 1500.0, 3.2)]
    assert readings(spark, [("usgs", 2, OBSERVED)]) == expected
    assert audit(spark, [("usgs", 2, OBSERVED)])[(dims.GAUGE_NAMES[2], "usgs")][2:] == (2, None)


def test_observed_with_one_parameter(spark):
    text = '{"features":[{"properties":{"time":"2026-04-01T12:00:45Z","parameter_code":"00060","value":"7"}}]}'
    assert readings(spark, [("usgs", 2, text)]) == [(2, "usgs", "observed", datetime(2026, 4, 1, 6), 7.0, None)]


def test_long_observed_responses(spark):
    start = datetime(2026, 4, 1)
    features = []
    for i in range(3000):
        time = (start + timedelta(hours=i)).strftime("%Y-%m-%dT%H:%M:%SZ")
        codes = ("00060", "00065", "00010") if i % 3 == 0 else ("00065",) if i % 3 == 1 else ("00010",)
        features += [_observed(time, f'"{code}"', f'"{i + int(code)}"') for code in codes]
    text = '{"features":[' + ",".join(sorted(features, key=hash)) + "]}"
    calls = ingest.parse_calls(land(spark, [("usgs", 2, text)]), dims.gauges(spark))
    rows = sorted((r.utc_time, r.flow_cfs, r.stage_ft) for r in ingest.readings_of(calls).collect())
    assert rows == [
        (start + timedelta(hours=i), i + 60.0 if i % 3 == 0 else None, i + 65.0 if i % 3 < 2 else None) for i in range(3000)
    ]


def test_csv(spark):
    assert readings(spark, [("bureau_rec", 13, CSV)]) == [
        (13, "bureau_reclamation", "observed", datetime(2026, 4, 1, 10), 1234.5, None),
        (13, "bureau_reclamation", "observed", datetime(2026, 4, 1, 11), None, 3.2),
    ]
    # This source counts rows after the hour filter.
    assert audit(spark, [("bureau_rec", 13, CSV)])[(dims.GAUGE_NAMES[13], "bureau_rec")] == ("CSCI", "observed", 2, None)


def test_csv_columns_bind_by_name_and_respect_quotes(spark):
    text = 'csci_gh,"DateTime",note,csci_q\r\n3.5,2026-04-01 10:00,"a, b","12"\r\n'
    expected = [(13, "bureau_reclamation", "observed", datetime(2026, 4, 1, 10), 12.0, 3.5)]
    assert readings(spark, [("bureau_rec", 13, text)]) == expected


def _observed(time="2026-04-01T12:00:00Z", code='"00060"', value='"1"'):
    return f'{{"properties":{{"time":"{time}","parameter_code":{code},"value":{value}}}}}'


BROKEN = {
    "not json": ("usgs", 2, '{"features":[', "malformed payload"),
    "bad value": ("usgs", 2, f'{{"features":[{_observed()},{_observed("2026-04-01T13:00:00Z", value="null")}]}}', "unreadable value"),
    "bad time": ("usgs", 2, f'{{"features":[{_observed(time="yesterday")}]}}', "unreadable time"),
    "no code": ("usgs", 2, f'{{"features":[{_observed(code="null")}]}}', "record without code"),
    "repeated": ("usgs", 2, f'{{"features":[{_observed()},{_observed()}]}}', "repeated record"),
    "null flow": ("noaa", 2, '{"primaryUnits":"ft","data":[{"validTime":"2026-04-01T12:00:00Z","primary":1}]}', "point without flow"),
    "forecast time": ("noaa", 2, '{"primaryUnits":"kcfs","data":[{"validTime":"2026-04-01 12:00","primary":1}]}', "unreadable time"),
    "foreign header": ("bureau_rec", 13, CSV.replace("csci", "xxxx"), "unexpected header"),
    "csv time": ("bureau_rec", 13, CSV + "END DATA,,\n", "unreadable time"),
    "empty file": ("bureau_rec", 13, "", "unexpected header"),
}


def test_a_malformed_record_fails_its_call_only(spark):
    rows = [(source, gauge, case, text) for case, (source, gauge, text, _) in BROKEN.items()]
    rows.append(("noaa", 1, "good", FORECAST_KCFS))
    calls = ingest.parse_calls(spark.createDataFrame(rows, schemas.PAYLOADS), dims.gauges(spark))
    found = {r.call_id: (r.rows, r.error) for r in calls.select("call_id", "rows", "error").collect()}
    assert found == {"good": (1, None), **{case: (0, error) for case, (*_, error) in BROKEN.items()}}
    assert [r.gauge_id for r in ingest.readings_of(calls).collect()] == [1]


def test_routing_follows_the_registry(spark):
    # Gauge 13 is not a usgs gauge, gauge 2 is no reclamation gauge, and there is no gauge 99.
    rows = [("usgs", 13, OBSERVED), ("bureau_rec", 2, CSV), ("noaa", 99, FORECAST_KCFS), ("other", 2, "x")]
    assert readings(spark, rows) == []
    calls = ingest.parse_calls(land(spark, rows), dims.gauges(spark))
    table = ingest.audit_of(calls, dims.gauges(spark)).filter("call_id IS NOT NULL").collect()
    assert sorted((r.call_id, r.source, r.rows, r.error) for r in table) == [
        (f"call-{i}", source, 0, ingest.NOT_REGISTERED) for i, (source, *_) in enumerate(rows)
    ]


def test_each_payload_is_read_for_its_own_parser_only(spark, tmp_path):
    """A branch per source reads the folder of that source; the branch of what is not parsed reads no payload."""
    rows = [("usgs", 2, OBSERVED), ("noaa", 1, FORECAST_KCFS), ("bureau_rec", 13, CSV), ("other", 2, "x")]
    for i, (source, gauge, text) in enumerate(rows):
        folder = tmp_path / f"source={source}" / f"gauge_id={gauge}"
        folder.mkdir(parents=True)
        (folder / f"{i}.txt").write_text(text)
    calls = ingest.parse_calls(payloads.read_landing(spark, str(tmp_path)), dims.gauges(spark))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = calls._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    scans = [line for line in plan.splitlines() if "FileScan text" in line]
    with_text = [line for line in scans if "struct<value:string>" in line]
    assert len(scans) == 4 and len(with_text) == 3
    for source in ("usgs", "noaa", "bureau_rec"):
        assert len([line for line in with_text if f"= {source})" in line.split("PartitionFilters")[1]]) == 1
    found = {r.source: (r.rows, r.error) for r in calls.collect()}
    assert found.pop("other") == (0, ingest.NOT_REGISTERED)
    assert all(n > 0 and error is None for n, error in found.values()) and len(found) == 3


def test_unknown_observed_source_keeps_the_forecast(spark):
    api = F.when(F.col("gauge_id") == 1, F.lit("xyz")).otherwise(F.col("observed_api"))
    gauges = dims.gauges(spark).withColumn("observed_api", api)
    rows = [("usgs", 1, OBSERVED), ("noaa", 1, FORECAST_KCFS)]
    calls = ingest.parse_calls(land(spark, rows), gauges)
    assert [r.source for r in ingest.readings_of(calls).collect()] == ["noaa_forecast"]
    found = audit(spark, rows, gauges)
    assert found[(dims.GAUGE_NAMES[1], "xyz")] == (None, "observed", 0, "unknown observed source: xyz")
    assert found[(dims.GAUGE_NAMES[1], "noaa")][2:] == (1, None)


def test_nothing_landed_gives_empty_readings(spark):
    table, calls = ingest.read_all(land(spark, []), dims.gauges(spark), RUN)
    assert table.count() == 0
    assert {f.name for f in schemas.READINGS.fields} <= set(table.columns)
    assert calls.filter("rows = 0 and error is not null").count() == 30


@pytest.fixture
def landing(tmp_path):
    for source, gauge, name, text in [
        ("usgs", 2, "a.json", OBSERVED),
        ("bureau_rec", 13, "b.csv", CSV),
        ("noaa", 2, "c.json", FORECAST_KCFS.replace("T12", "T20")),
    ]:
        folder = tmp_path / "landing" / f"source={source}" / f"gauge_id={gauge}"
        folder.mkdir(parents=True)
        (folder / name).write_text(text)
    return str(tmp_path / "landing")


def test_landing_files(spark, landing):
    table, calls = ingest.read_all(payloads.read_landing(spark, landing), dims.gauges(spark), RUN)
    found = {(r.gauge_id, r.source, r.mountain_time.hour, r.run_time) for r in table.collect()}
    assert found == {
        (2, "usgs", 6, RUN),
        (13, "bureau_reclamation", 10, RUN),
        (13, "bureau_reclamation", 11, RUN),
        (2, "noaa_forecast", 14, RUN),
    }
    assert calls.filter("error is null").count() == 3


def test_stored_refresh_is_reused_for_an_hour(spark, landing, tmp_path):
    path = str(tmp_path / "store")
    made = []

    def refresh_at(as_of):
        def run():
            made.append(as_of)
            return ingest.parse_calls(payloads.read_landing(spark, landing), dims.gauges(spark))

        return sink.load_or_refresh(spark, path, as_of, dims.gauges(spark), run)

    first = refresh_at(RUN)
    assert (first[0].count(), first[1].count()) == (4, 30)
    refresh_at(RUN.replace(hour=8, minute=30))
    assert made == [RUN]
    late = RUN.replace(hour=8, minute=30, second=1)
    readings_again, _ = refresh_at(late)
    assert made == [RUN, late]
    assert {r.run_time for r in readings_again.collect()} == {late}


def test_landed_files_to_current_levels(spark, landing, tmp_path):
    def refresh_now():
        return ingest.parse_calls(payloads.read_landing(spark, landing), dims.gauges(spark))

    store = str(tmp_path / "store")
    readings_table, audit_table = sink.load_or_refresh(spark, store, RUN, dims.gauges(spark), refresh_now)
    result = pipeline.run(readings_table, audit_table, on_duplicate="latest")
    stored = pipeline.run_stored(spark, store, str(tmp_path / "clean"))
    for one, other in zip(result, stored):
        assert sorted(map(str, one.select(sorted(one.columns)).collect())) == sorted(
            map(str, other.select(sorted(other.columns)).collect())
        )
    # The latest observation is at 11:00 on gauge 13, so only the forecast for 14:00 counts.
    rows = result.clean.select("gauge_id", "gauge_name", "data_type", "mountain_time", "run_time").collect()
    assert {(r.gauge_id, r.data_type, r.mountain_time.hour) for r in rows} == {
        (2, "observed", 6),
        (13, "observed", 10),
        (13, "observed", 11),
        (2, "forecast", 14),
    }
    assert all(r.gauge_name == dims.GAUGE_NAMES[r.gauge_id] and r.run_time == RUN for r in rows)
    assert result.ranges.count() == 4 * 30
    current = {name: r for r in result.current.collect() for name in r.sections.split(", ")}
    assert (current["The Main"].river_level, current["The Main"].flow_range) == ("1,500", "Low")
    assert (current["The Cabarton"].river_level, current["The Cabarton"].river_level_max) == ("1,235", "0")


def flat(df, drop=("run_time",)):
    return sorted(map(str, df.select(sorted(set(df.columns) - set(drop))).collect()))


def test_streaming_refresh_equals_the_batch_however_it_is_split(spark, landing, tmp_path):
    path, gauges = str(tmp_path / "store"), dims.gauges(spark)

    def stream(checkpoint):
        query = refresh.start_refresh(spark, landing, gauges, path, str(tmp_path / checkpoint), once=True, max_files=1)
        query.awaitTermination(120)

    for _ in range(2):
        stream("cp")
    assert sink.runs(spark, path).count() == 3
    table, audit = ingest.read_all(payloads.read_landing(spark, landing), gauges, RUN)
    for _ in range(2):
        stored = sink.read_window(spark, path, gauges)
        assert (flat(stored[0]), flat(stored[1])) == (flat(table), flat(audit))
        # A new checkpoint reads all files again: it neither replaces stored runs nor doubles their calls.
        stream("another")
    assert sink.runs(spark, path).count() == 6


def test_networks_keep_apart_from_landing_to_current_levels(spark, tmp_path):
    late = OBSERVED.replace("T12", "T18")
    networks = {1: [("usgs", 2, OBSERVED), ("noaa", 2, FORECAST_KCFS.replace("T12", "T15"))], 2: [("usgs", 2, late), ("noaa", 2, FORECAST_KCFS.replace("T12", "T15"))]}
    gauges, keys = dims.gauges(spark), schemas.NETWORK
    for network, rows in networks.items():
        for source, gauge, text in rows:
            folder = tmp_path / "landing" / f"network_id={network}" / f"source={source}" / f"gauge_id={gauge}"
            folder.mkdir(parents=True)
            (folder / "a.json").write_text(text)
    calls = ingest.parse_calls(payloads.read_landing(spark, str(tmp_path / "landing"), keys), gauges, keys.names)
    path = str(tmp_path / "store")
    sink.write_run(calls, path, "one", RUN, keys)
    with pytest.raises(ValueError):
        sink.write_run(calls, path, "two", RUN)
    result = pipeline.run_stored(spark, path, str(tmp_path / "clean"), keys=keys)
    assert sorted(map(tuple, result.audit.groupBy("network_id").count().collect())) == [(1, 30), (2, 30)]
    for network, rows in networks.items():
        table, _ = ingest.read_all(land(spark, rows), gauges, RUN)
        alone = pipeline.run(table, on_duplicate="latest")
        mine = result.current.filter(F.col("network_id") == network).drop("network_id")
        assert flat(mine) == flat(alone.current)
        assert flat(result.ranges.filter(F.col("network_id") == network).drop("network_id")) == flat(alone.ranges)
    # The forecast of 15:00 is past the last observation of the first network only.
    assert sorted((r.network_id, r.data_type) for r in result.clean.collect()) == [(1, "forecast"), (1, "observed"), (2, "observed")]
