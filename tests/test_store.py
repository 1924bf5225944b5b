"""The store of calls, and landed files packed into payload tables."""

import re
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from test_ingest import FORECAST_KCFS, OBSERVED, RUN, flat, land

from riffle import dims, schemas
from riffle.sources import compaction, ingest, payloads, sink


def parsed(spark, rows):
    return ingest.parse_calls(land(spark, rows), dims.gauges(spark))


def flows(spark, path, **window):
    calls = sink.read_calls(spark, path, **window)
    return sorted((r.call_id, r.run_time, r.flow) for r in calls.select("call_id", "run_time", F.col("readings")[0].flow_cfs.alias("flow")).collect())


def test_a_call_stored_again_counts_as_the_newer_run_has_it(spark, tmp_path):
    path, other = str(tmp_path / "store"), OBSERVED.replace("1500", "1700")
    later, latest = RUN + timedelta(hours=1), RUN + timedelta(hours=2)
    sink.write_run(parsed(spark, [("usgs", 2, OBSERVED), ("usgs", 3, OBSERVED)]), path, "b", later)
    sink.write_run(parsed(spark, [("usgs", 2, other)]), path, "c", latest)
    # A run of an earlier time that is written last does not replace newer ones.
    sink.write_run(parsed(spark, [("usgs", 2, other), ("usgs", 3, other), ("usgs", 4, other)]), path, "a", RUN)
    whole = [("call-0", latest, 1700.0), ("call-1", later, 1500.0), ("call-2", RUN, 1700.0)]
    assert flows(spark, path) == whole
    # What is outside the window neither counts nor replaces.
    assert flows(spark, path, until=later) == [("call-0", later, 1500.0), *whole[1:]]
    assert flows(spark, path, since=later) == whole[:2]
    # A run that is written again replaces itself.
    sink.write_run(parsed(spark, [("usgs", 2, other)]), path, "c", latest)
    assert flows(spark, path) == whole


def test_repeated_rows_of_a_call_in_one_run_count_once(spark, tmp_path):
    path, calls = str(tmp_path / "store"), parsed(spark, [("usgs", 2, OBSERVED)])
    sink.write_run(calls.unionByName(calls), path, "a", RUN)
    assert len(flows(spark, path)) == 1


def test_reading_a_window_shuffles_no_readings(spark, tmp_path):
    path = str(tmp_path / "store")
    for n in range(3):
        sink.write_run(parsed(spark, [("usgs", 2, OBSERVED)] * (n + 1)), path, f"r{n}", RUN + timedelta(hours=n))
    table, _ = sink.read_window(spark, path, dims.gauges(spark))
    utils = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils
    plan = utils.explainString(table._jdf.queryExecution(), "formatted")
    exchanged = [part for part in plan.split("\n\n") if re.match(r"\(\d+\) (Exchange|Sort|Window)\b", part)]
    assert not [part for part in exchanged if "readings" in part or "rows#" in part], plan
    assert sink.read_calls(spark, path).count() == 3


@pytest.fixture
def landing(tmp_path):
    for source, gauge, text, many in [("usgs", 2, OBSERVED, 7), ("noaa", 2, FORECAST_KCFS, 5), ("usgs", 3, OBSERVED, 4)]:
        folder = tmp_path / "landing" / f"source={source}" / f"gauge_id={gauge}"
        folder.mkdir(parents=True)
        for i in range(many):
            (folder / f"{i}.json").write_text(text)
    return str(tmp_path / "landing")


def test_bins_hold_stretches_of_bytes(spark):
    sizes = [("noaa" if i % 3 else "usgs", f"call-{i:04}", 10 + i % 7) for i in range(500)]
    binned = compaction.bins(spark.createDataFrame(sizes, "source string, call_id string, bytes long"), 100)
    rows = sorted(tuple(r) for r in binned.collect())
    begun = {}
    for source, _, size, number in rows:
        assert number == begun.get(source, 0) // 100
        begun[source] = begun.get(source, 0) + size
    assert len(rows) == 500


def test_landed_files_are_packed_exactly_once(spark, landing, tmp_path, monkeypatch):
    path, one = str(tmp_path / "packed"), len(OBSERVED.encode())
    expected = flat(payloads.read_landing(spark, landing))
    # A run that dies before it commits leaves nothing that is read.
    with monkeypatch.context() as killed:
        def die(*args, **kwargs):
            raise RuntimeError("killed")

        killed.setattr(type(spark), "range", die)
        with pytest.raises(RuntimeError):
            compaction.compact(spark, landing, path, file_bytes=3 * one)
    assert compaction.read_compacted(spark, path).count() == 0
    assert flat(compaction.read_both(spark, landing, path)) == expected
    assert compaction.compact(spark, landing, path, file_bytes=3 * one) == 16
    assert flat(compaction.read_compacted(spark, path)) == expected
    files = compaction.read_compacted(spark, path).select("source", F.input_file_name().alias("file")).distinct()
    assert files.filter("source = 'usgs'").count() == 4
    # Nothing new has landed; then one file has.
    assert compaction.compact(spark, landing, path) == 0
    (tmp_path / "landing" / "source=usgs" / "gauge_id=2" / "new.json").write_text(OBSERVED)
    assert compaction.read_both(spark, landing, path).count() == 17
    assert compaction.compact(spark, landing, path) == 1
    packed = compaction.read_compacted(spark, path)
    assert flat(packed) == flat(payloads.read_landing(spark, landing))
    assert [tuple(r) for r in compaction.batches(spark, path).select("files", "batch").orderBy("batch").collect()] == [(16, 1), (1, 2)]
    # A filter on the source prunes folders.
    plan = packed.filter("source = 'noaa'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "source" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert set(packed.columns) == set(schemas.PAYLOADS.names)
