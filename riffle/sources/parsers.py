"""Payload text to calls, one parser per landed source.

A parser adds ``rows`` (counted for the audit), ``error`` and ``readings`` to each payload, without
a shuffle. A call with any malformed record fails as a whole: it contributes no readings and an
audit row with the error. Other calls are unaffected.

The parsers work in stages, so that each payload is decoded once however often it is consulted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riffle.functions import labels, numbers, times

# The payload fields that are read, the unit that marks the flow field, the flow
# factor (which applies whatever the unit), parameter codes and CSV headers.
FORECAST_DOC = (
    "primaryUnits STRING, data ARRAY<STRUCT<validTime: STRING, primary: DOUBLE, secondary: DOUBLE>>, broken STRING"
)
OBSERVED_DOC = (
    "features ARRAY<STRUCT<properties: STRUCT<time: STRING, parameter_code: STRING, value: STRING>>>, broken STRING"
)
FLOW_UNIT = "kcfs"
FLOW_FACTOR = 1000
FLOW_CODE, STAGE_CODE = "00060", "00065"
CSV_TIME = "DateTime"
CSV_FLOW_SUFFIX, CSV_STAGE_SUFFIX = "_q", "_gh"
# Data source and data type of each landed source.
LANDED = {
    "usgs": ("usgs", "observed"),
    "bureau_rec": ("bureau_reclamation", "observed"),
    "noaa": ("noaa_forecast", "forecast"),
}
# End of fixed values.

_JSON = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}
# A comma outside double quotes.
_CSV_COMMA = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def unit_fields(unit: Column, primary: Column, secondary: Column) -> tuple[Column, Column]:
    """Flow and stage of a forecast point: the unit says which field is which."""
    flow_first = F.coalesce(unit == FLOW_UNIT, F.lit(False))
    flow = F.when(flow_first, primary).otherwise(secondary) * FLOW_FACTOR
    return flow, F.when(flow_first, secondary).otherwise(primary)


def _first_error(**checks: Column) -> Column:
    """Name of the first check that fails; null when none does."""
    return F.coalesce(*[F.when(failed, F.lit(name.replace("_", " "))) for name, failed in checks.items()])


def _reading(utc: Column, local: Column, flow: Column, stage: Column) -> Column:
    return F.struct(
        utc.alias("utc_time"), local.alias("mountain_time"), flow.alias("flow_cfs"), stage.alias("stage_ft")
    )


def _finish(df: DataFrame, rows: Column, readings: Column) -> DataFrame:
    """Counted rows and readings of a call that has no error."""
    ok = F.col("error").isNull()
    return df.withColumns(
        {
            "rows": F.when(ok, rows).otherwise(0).cast("bigint"),
            "readings": F.when(ok, readings).otherwise(F.slice(readings, 1, 0)),
        }
    )


def _minute(time: Column) -> Column:
    """Epoch seconds of the minute a time text falls into; null when it is unreadable."""
    # One mention of the parsed time: inside a lambda every mention is evaluated.
    return F.floor(times.parse_epoch(time) / 60) * 60


def _on_hour(at: Column) -> Column:
    return F.pmod(at, F.lit(3600)) == 0


def _utc_reading(at: Column, flow: Column, stage: Column) -> Column:
    utc = times.from_epoch(at)
    return _reading(utc, times.to_local(utc), flow, stage)


def forecast_calls(payloads: DataFrame) -> DataFrame:
    """Forecast JSON: one reading per point, flow scaled to cubic feet per second."""
    unit = F.col("doc.primaryUnits")

    def point(p: Column) -> Column:
        flow, stage = unit_fields(unit, p["primary"], p["secondary"])
        return F.struct(_minute(p["validTime"]).alias("at"), flow.alias("flow"), stage.alias("stage"))

    points = F.col("points")
    decoded = payloads.withColumn("doc", F.from_json("payload", FORECAST_DOC, _JSON))
    pointed = decoded.withColumn("points", F.transform("doc.data", point))
    checked = pointed.withColumn(
        "error",
        _first_error(
            malformed_payload=F.col("doc").isNull() | F.col("doc.broken").isNotNull(),
            point_without_flow=F.exists(points, lambda p: p["flow"].isNull()),
            unreadable_time=F.exists(points, lambda p: p["at"].isNull()),
        ),
    )
    on_hour = F.filter(points, lambda p: _on_hour(p["at"]))
    hourly = F.transform(on_hour, lambda p: _utc_reading(p["at"], p["flow"], p["stage"]))
    return _finish(checked, F.coalesce(F.array_size(points), F.lit(0)), hourly).drop("doc", "points")


def observed_calls(payloads: DataFrame) -> DataFrame:
    """Observed JSON: narrow records pivoted to one reading per time text.

    A response holds a day of one gauge, so the pivot stays inside the record.
    """

    def record(f: Column) -> Column:
        p = f["properties"]
        return F.struct(
            p["time"].alias("time"),
            _minute(p["time"]).alias("at"),
            p["parameter_code"].alias("code"),
            numbers.lenient_double(p["value"]).alias("value"),
        )

    records, hours = F.col("records"), F.col("hours")
    decoded = payloads.withColumn("doc", F.from_json("payload", OBSERVED_DOC, _JSON))
    listed = decoded.withColumn("records", F.transform("doc.features", record))
    cells = F.transform(records, lambda r: F.concat_ws("|", r["time"], r["code"]))
    checked = listed.withColumn(
        "error",
        _first_error(
            malformed_payload=F.col("doc").isNull() | F.col("doc.broken").isNotNull(),
            record_without_code=F.exists(records, lambda r: r["code"].isNull()),
            unreadable_value=F.exists(records, lambda r: r["value"].isNull()),
            unreadable_time=F.exists(records, lambda r: r["at"].isNull()),
            repeated_record=F.array_size(F.array_distinct(cells)) < F.array_size(records),
        ),
    ).withColumn("hours", F.filter(records, lambda r: _on_hour(r["at"])))

    # Times, flows and stages of a response, sorted so that what belongs to one time stands together:
    # the time itself, then its flow, then its stage, each at most once.
    def entries(rank: int, chosen: Column, value) -> Column:
        return F.transform(
            chosen,
            lambda r: F.struct(r["time"].alias("time"), F.lit(rank).alias("rank"), r["at"].alias("at"), value(r).alias("value")),
        )

    def of(code: str) -> Column:
        return F.filter(hours, lambda r: r["code"] == code)

    merged = F.col("merged")
    sorted_entries = F.array_sort(
        F.concat(
            F.array_distinct(entries(0, hours, lambda r: F.lit(None).cast("double"))),
            entries(1, of(FLOW_CODE), lambda r: r["value"]),
            entries(2, of(STAGE_CODE), lambda r: r["value"]),
        )
    )

    def reading(entry: Column, i: Column) -> Column:
        def value(rank: int) -> Column:
            following = [F.get(merged, i + step) for step in range(1, rank + 1)]
            found = [F.when((e["time"] == entry["time"]) & (e["rank"] == rank), e["value"]) for e in following]
            return F.coalesce(*found)

        return F.when(entry["rank"] == 0, _utc_reading(entry["at"], value(1), value(2)))

    distinct_times = F.array_distinct(F.transform(records, lambda r: r["time"]))
    rows = F.coalesce(F.array_size(distinct_times), F.lit(0))
    paired = F.filter(F.transform(merged, reading), lambda r: r.isNotNull())
    done = _finish(checked.withColumn("merged", sorted_entries), rows, paired)
    return done.drop("doc", "records", "hours", "merged")


def csv_calls(payloads: DataFrame) -> DataFrame:
    """Observed CSV in local time; its headers carry the lower-cased site identifier."""

    def cells(line: Column) -> Column:
        return F.transform(F.split(line, _CSV_COMMA), lambda cell: F.regexp_replace(cell, r'^\s*"|"\s*$', ""))

    def position(name: Column) -> Column:
        return F.array_position("header", name).cast("int") - 1

    site = F.lower("identifier")
    split = payloads.withColumn("lines", F.filter(F.split("payload", r"\r?\n"), lambda line: F.trim(line) != ""))
    placed = split.withColumn("header", F.coalesce(cells(F.get("lines", F.lit(0))), F.split(F.lit(""), ","))).withColumns(
        {
            "time_at": position(F.lit(CSV_TIME)),
            "flow_at": position(F.concat(site, F.lit(CSV_FLOW_SUFFIX))),
            "stage_at": position(F.concat(site, F.lit(CSV_STAGE_SUFFIX))),
        }
    )
    found = (F.col("time_at") >= 0) & (F.col("flow_at") >= 0) & (F.col("stage_at") >= 0)
    known = F.coalesce(found, F.lit(False))

    def reading(row: Column) -> Column:
        return _reading(
            F.lit(None).cast("timestamp_ntz"),
            times.parse_local(F.get(row, F.col("time_at"))),
            numbers.lenient_double(F.get(row, F.col("flow_at"))),
            numbers.lenient_double(F.get(row, F.col("stage_at"))),
        )

    body = F.slice("lines", F.lit(2), F.greatest(F.array_size("lines") - 1, F.lit(0)))
    records = F.col("records")
    listed = placed.withColumn("rows", F.transform(body, cells)).withColumn("records", F.transform("rows", reading))
    checked = listed.withColumn(
        "error",
        _first_error(
            unexpected_header=~known,
            unreadable_time=F.exists(records, lambda r: r["mountain_time"].isNull()),
        ),
    )
    hourly = checked.withColumn("records", F.filter(records, lambda r: times.on_the_hour(r["mountain_time"])))
    done = _finish(hourly, F.array_size(records), records)
    return done.drop("lines", "header", "time_at", "flow_at", "stage_at", "records")


PARSERS = {"usgs": observed_calls, "bureau_rec": csv_calls, "noaa": forecast_calls}


def parse_all(payloads: DataFrame) -> DataFrame:
    """Calls of all sources: a branch per parser over the payloads of its own source, so that only the folders of
    that source are read for it and no parser's expressions meet rows of another.

    ``payloads`` carries ``identifier``, the name the gauge has at that source, and ``registered``; what is not registered, or
    whose source has no parser, is not parsed, and its payload is not read. It has no readings, and an unknown source null
    for its data source.
    """
    parsed = F.col("registered") & F.coalesce(F.col("source").isin(*PARSERS), F.lit(False))
    branches = [parser(payloads.filter(F.col("registered") & (F.col("source") == source))) for source, parser in PARSERS.items()]
    kept = [c for c in payloads.columns if c != "payload"]
    nothing = {"rows": F.lit(0).cast("bigint"), "error": F.lit(None).cast("string")}
    readings = {"readings": F.array().cast(branches[0].schema["readings"].dataType)}
    branches.append(payloads.filter(~parsed).select(*kept).withColumns(nothing | readings))
    found = branches[0].select(*kept, *nothing, *readings)
    for branch in branches[1:]:
        found = found.unionByName(branch.select(*kept, *nothing, *readings))
    kinds = zip(("data_source", "data_type"), zip(*LANDED.values()))
    return found.withColumns({name: labels.lookup(F.col("source"), dict(zip(LANDED, values))) for name, values in kinds})
