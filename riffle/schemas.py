"""Declared schemas of every table; nothing is inferred."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import types as T

_TYPES = {
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "float": T.FloatType(),
    "string": T.StringType(),
    "timestamp_ntz": T.TimestampNTZType(),
    "array<string>": T.ArrayType(T.StringType()),
}

_ARROW = {
    T.IntegerType: pa.int32(),
    T.LongType: pa.int64(),
    T.DoubleType: pa.float64(),
    T.StringType: pa.string(),
    T.ArrayType: pa.list_(pa.string()),
}


def _struct(text: str) -> T.StructType:
    fields = [part.split() for part in text.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


def arrow_type(data_type: T.DataType) -> pa.DataType:
    return _ARROW[type(data_type)]


RIVERS = _struct("river_id int, river_name string")

GAUGES = _struct(
    "gauge_id int, gauge_name string, river_id int, waterdata_usgs_identifier string, "
    "bureau_reclamation_identifier string, noaa_forecast_identifier string, "
    "observed_api string, forecast_api string, lat double, lon double"
)

SECTIONS = _struct(
    "section_id int, river_id int, section string, section_name string, flow_unit string, "
    "min_level double, medium_level double, high_level double, max_level double, "
    "lat double, lon double, american_whitewater string, state string, "
    "link array<string>, video array<string>"
)

COEFFICIENTS = _struct("section_id int, flow_type string, gauge_id int, coef double")

# utc_time is the instant behind mountain_time; cleaning needs it where two instants share a local hour.
READINGS = _struct(
    "gauge_name string, gauge_id int, source string, data_type string, "
    "utc_time timestamp_ntz, mountain_time timestamp_ntz, flow_cfs double, stage_ft double, run_time timestamp_ntz"
)

AUDIT = _struct(
    "call_id string, gauge_name string, identifier string, source string, data_type string, rows bigint, "
    "error string, run_time timestamp_ntz"
)

READING = _struct("utc_time timestamp_ntz, mountain_time timestamp_ntz, flow_cfs double, stage_ft double")

# One parsed response, with its readings.
CALLS = T.StructType(
    [
        *_struct(
            "call_id string, gauge_id int, gauge_name string, identifier string, source string, data_source string, "
            "data_type string, rows bigint, error string"
        ).fields,
        T.StructField("readings", T.ArrayType(READING)),
        T.StructField("run_time", T.TimestampNTZType()),
    ]
)

RUNS = _struct("run_id string, run_time timestamp_ntz")

# What tells many networks of gauges apart; a key column leads any of the tables above.
NETWORK = _struct("network_id bigint")
NO_KEYS = T.StructType([])


def keyed(schema: T.StructType, keys: T.StructType) -> T.StructType:
    return T.StructType([*keys.fields, *schema.fields])


# One landed response of one source call.
PAYLOADS = _struct("source string, gauge_id int, call_id string, payload string")
