"""The registered queries. Each reads whole test tables and returns a lazy DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riffle import dims
from riffle.functions import numbers, times
from riffle.operators import audit, bands, classify, clean, levels, registry, selection, summary
from riffle.plans import pipeline
from riffle.sources import events, ingest, parsers

Query = Callable[[SparkSession, str], DataFrame]

# Job parameters of the registered runs.
AS_OF = "2024-01-25 00:00:00"
STAMP = "2024-01-25 06:30:00"
RECORD_OF = "Staircase"

_REGISTRY: dict[str, Query] = {}


def _query(fn: Query) -> Query:
    _REGISTRY[fn.__name__] = fn
    return fn


def registered() -> dict[str, Query]:
    return dict(_REGISTRY)


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.readings(spark, sf_dir)


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).filter(F.col("data_type") == "observed")


def _clean(spark: SparkSession, sf_dir: str, keys=()) -> DataFrame:
    raw = _raw(spark, sf_dir)
    hourly = events.hourly_readings(raw, keys)
    bound = events.latest_observation(raw, keys)
    return clean.clean_readings(hourly, keys, on_duplicate="latest", version=events.VERSION, latest=bound)


def _ranges(spark: SparkSession, sf_dir: str, keys=()) -> DataFrame:
    return pipeline.ranges_of(_clean(spark, sf_dir, keys), keys)


def _snapshot(spark: SparkSession, sf_dir: str, keys=()) -> DataFrame:
    return summary.snapshot_section(_clean(spark, sf_dir, keys), pipeline.section_dim(spark), keys)


def _doubles(df: DataFrame) -> DataFrame:
    """Levels as doubles, so that results compare exactly across engines."""
    narrow = [f.name for f in df.schema.fields if f.dataType.typeName() == "float"]
    return df.withColumns({name: F.col(name).cast("double") for name in narrow}) if narrow else df


# Source-side selection


@_query
def src_filter(spark, sf_dir):
    usgs = [row[0] for row in dims.GAUGE_ROWS if row[6] == "waterdata_usgs"]
    kept = selection.source_filter(_observed(spark, sf_dir), usgs)
    return kept.select("event_id", "gauge_id", "parameter_code", "value")


@_query
def lookback_24h(spark, sf_dir):
    recent = selection.lookback(_raw(spark, sf_dir), AS_OF, "utc_time")
    return recent.select("event_id", "gauge_id", "data_type", "utc_time")


@_query
def source_cap(spark, sf_dir):
    rows = _observed(spark, sf_dir).select("event_id", "gauge_id", "utc_time")
    return selection.source_cap(rows, order=("utc_time", "event_id"))


# Ingest, over responses that Spark renders from the events: one response per event


def _landed(spark: SparkSession, sf_dir: str, keys=()) -> DataFrame:
    """Responses as they would land. Some land at a source their gauge is not registered for
    (k below 10) and some are cut short (k equal to 7 or 17)."""
    local = times.to_local(F.col("utc_time"))
    # Half of the responses keep their minutes, the others are on the hour.
    keep_minutes = F.col("k") < 50

    def text(ts: Column) -> Column:
        return F.when(keep_minutes, ts).otherwise(times.floor_hour(ts)).cast("string")

    iso = F.concat(F.translate(F.substring(text(F.col("utc_time")), 1, 19), " ", "T"), F.lit("Z"))
    properties = F.struct(iso.alias("time"), "parameter_code", F.col("value").cast("string").alias("value"))
    observed = F.to_json(F.struct(F.array(F.struct(properties.alias("properties"))).alias("features")))
    unit = F.when(keep_minutes, F.lit("kcfs")).otherwise(F.lit("ft")).alias("primaryUnits")
    point = F.struct(iso.alias("validTime"), F.col("value").alias("primary"), (F.col("value") / 15).alias("secondary"))
    forecast = F.to_json(F.struct(unit, F.array(point).alias("data")))
    stage = F.when(F.col("k") < 90, (F.col("value") / 15).cast("string")).otherwise(F.lit("NO RECORD"))
    header = F.lit("DateTime,csci_q,csci_gh\n")
    csv = F.concat(header, F.substring(text(local), 1, 16), F.lit(","), F.col("value"), F.lit(", "), stage, F.lit("\n"))

    at_home = F.col("k") >= 10
    reclamation = (F.col("gauge_id") == 13) == at_home
    source = (
        F.when(F.col("data_type") == "forecast", F.lit("noaa"))
        .when(reclamation, F.lit("bureau_rec"))
        .otherwise(F.lit("usgs"))
    )
    body = F.when(source == "noaa", forecast).when(source == "usgs", observed).otherwise(csv)
    cut_short = F.col("k").isin(7, 17)
    return _raw(spark, sf_dir).select(
        *keys,
        source.alias("source"),
        "gauge_id",
        F.col("event_id").cast("string").alias("call_id"),
        F.when(cut_short, F.lit("{")).otherwise(body).alias("payload"),
    )


def _calls(spark: SparkSession, sf_dir: str, keys=()) -> DataFrame:
    return ingest.parse_calls(_landed(spark, sf_dir, keys), pipeline.gauge_dim(spark), keys)


@_query
def source_route(spark, sf_dir):
    rows = ingest.readings_of(_calls(spark, sf_dir))
    return rows.select("gauge_id", "gauge_name", "source", "data_type", "mountain_time", "flow_cfs", "stage_ft")


def _audit(spark: SparkSession, sf_dir: str, keys=()) -> DataFrame:
    rows = ingest.audit_of(_calls(spark, sf_dir, keys), pipeline.gauge_dim(spark), keys)
    # Responses are one per event here, so the audit is shown per gauge and outcome.
    return rows.groupBy(*keys, "gauge_name", "identifier", "source", "data_type", "error").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("rows").alias("rows")
    )


@_query
def ingest_audit(spark, sf_dir):
    return _audit(spark, sf_dir)


@_query
def ingest_audit_networks(spark, sf_dir):
    return _audit(spark, sf_dir, events.NETWORK_KEYS)


@_query
def json_props(spark, sf_dir):
    doc = F.from_json("props", "k INT, missing INT")
    return events.read_events(spark, sf_dir).select(
        "event_id", doc["k"].alias("k"), F.coalesce(doc["missing"], F.lit(0)).alias("missing")
    )


@_query
def lenient_cast(spark, sf_dir):
    padded = F.concat(F.lit("  "), F.col("value").cast("string"), F.lit(" "))
    odd = F.expr("try_element_at(array('NO RECORD', '1.5d', '2f', '0x1p3', '  ', '1e3', 'NaN'), k + 1)")
    text = F.coalesce(odd, padded)
    return _raw(spark, sf_dir).select("event_id", numbers.lenient_double(text).alias("number"))


@_query
def unit_normalise(spark, sf_dir):
    unit = F.when(F.col("k") < 40, F.lit("kcfs")).when(F.col("k") < 80, F.lit("ft"))
    flow, stage = parsers.unit_fields(unit, F.col("value"), F.col("value") / 15)
    return _raw(spark, sf_dir).select("event_id", flow.alias("flow_cfs"), stage.alias("stage_ft"))


# Time


@_query
def to_mountain(spark, sf_dir):
    return events.read_events(spark, sf_dir).select("event_id", times.to_local(F.col("ts")).alias("mountain_time"))


@_query
def hourly_only(spark, sf_dir):
    rows = _raw(spark, sf_dir).drop("mountain_time")
    return clean.to_hourly_mountain(rows).select("event_id", "utc_time", "mountain_time")


@_query
def parse_times(spark, sf_dir):
    wall = F.substring(F.col("utc_time").cast("string"), 1, 19)
    k = F.col("k")
    offset = (
        F.when(k < 20, F.lit("Z")).when(k < 40, F.lit("+00:00")).when(k < 60, F.lit("-07:00")).otherwise(F.lit("+0530"))
    )
    iso = F.when(k < 95, F.concat(F.translate(wall, " ", "T"), offset)).otherwise(F.lit("not a time"))
    local = F.when(k >= 5, F.substring(wall, 1, 16)).otherwise(wall)
    return _raw(spark, sf_dir).select(
        "event_id", times.parse_instant(iso).alias("instant"), times.parse_local(local).alias("local_time")
    )


@_query
def stamp_run(spark, sf_dir):
    return selection.stamp_run(_raw(spark, sf_dir), STAMP).select("event_id", "gauge_id", "run_time")


@_query
def freshness(spark, sf_dir):
    stored = _raw(spark, sf_dir).groupBy("gauge_id").agg(F.max("utc_time").alias("run_time"))
    fresh = selection.is_fresh(F.col("run_time"), times.ntz("2024-01-30 23:00:00"), 60)
    return stored.select("gauge_id", "run_time", fresh.alias("fresh"))


# Cleaning


@_query
def param_pivot(spark, sf_dir):
    return selection.parameter_pivot(_observed(spark, sf_dir), by=("gauge_id", "mountain_time"))


@_query
def forecast_cutoff(spark, sf_dir):
    rows = events.distinct_readings(_raw(spark, sf_dir))
    kept = clean.forecast_cutoff(rows)
    return kept.select("gauge_id", "data_type", "mountain_time", "flow_cfs", "stage_ft")


@_query
def conflict_filter(spark, sf_dir):
    rows = _raw(spark, sf_dir).select("event_id", "gauge_id", "source", "data_type", "mountain_time")
    return clean.conflict_filter(rows)


@_query
def clean_readings(spark, sf_dir):
    """Strict form: a second observed reading in a gauge hour would be an error."""
    rows = selection.stamp_run(events.distinct_readings(_raw(spark, sf_dir)), STAMP)
    return pipeline.with_gauge_names(clean.clean_readings(rows))


@_query
def clean_readings_latest(spark, sf_dir):
    return _clean(spark, sf_dir)


@_query
def clean_readings_networks(spark, sf_dir):
    return _clean(spark, sf_dir, events.NETWORK_KEYS)


@_query
def dup_keys(spark, sf_dir):
    return clean.duplicate_keys(_raw(spark, sf_dir))


# Levels


def _prefixed(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({str(g): f"g{g}" for g in dims.GAUGE_IDS})


@_query
def gauge_matrix(spark, sf_dir):
    return _prefixed(levels.gauge_matrix(_clean(spark, sf_dir), "flow_cfs"))


@_query
def filled_gauges(spark, sf_dir):
    return _prefixed(levels.filled_gauges(_clean(spark, sf_dir), "flow_cfs"))


@_query
def filled_gauges_ft(spark, sf_dir):
    return _prefixed(levels.filled_gauges(_clean(spark, sf_dir), "stage_ft"))


@_query
def filled_gauges_networks(spark, sf_dir):
    keys = events.NETWORK_KEYS
    return _prefixed(levels.filled_gauges(_clean(spark, sf_dir, keys), "flow_cfs", keys))


@_query
def section_levels_cfs(spark, sf_dir):
    return levels.section_levels_wide(_clean(spark, sf_dir), "flow_cfs")


@_query
def section_levels_ft(spark, sf_dir):
    return levels.section_levels_wide(_clean(spark, sf_dir), "stage_ft")


def _long(spark: SparkSession, sf_dir: str, unit: str) -> DataFrame:
    wide = levels.section_levels_wide(_clean(spark, sf_dir), dims.METRIC_OF_UNIT[unit])
    return levels.to_long(wide, unit)


@_query
def section_unpivot(spark, sf_dir):
    return _doubles(_long(spark, sf_dir, "cfs"))


@_query
def level_union(spark, sf_dir):
    return _doubles(levels.level_union(_long(spark, sf_dir, "feet"), _long(spark, sf_dir, "cfs")))


@_query
def section_levels_long(spark, sf_dir):
    coefficients = F.broadcast(dims.coefficients(spark))
    return _doubles(levels.section_levels_long(_clean(spark, sf_dir), coefficients, "flow_cfs"))


@_query
def registry_levels(spark, sf_dir):
    found = registry.section_levels(_clean(spark, sf_dir), dims.coefficients(spark), dims.sections(spark))
    return _doubles(found)


@_query
def registry_levels_networks(spark, sf_dir):
    """Each network has formulas of its own: other gauges, twice the weight where its number is odd, and no
    sections of which every third is missing, another third in each."""
    keys = events.NETWORK_KEYS
    networks = _raw(spark, sf_dir).select(*keys).distinct()
    formulas = dims.coefficients(spark)
    listed = formulas.agg(F.collect_list(F.struct(*formulas.columns))).scalar()
    own = networks.select(*keys, F.inline(listed)).filter("(network_id + section_id) % 3 <> 0")
    moved = F.expr(f"int((gauge_id + network_id) % {events.GAUGE_COUNT} + 1)")
    own = own.withColumns({"gauge_id": moved, "coef": F.expr("coef * (1 + network_id % 2)")})
    return _doubles(registry.section_levels(_clean(spark, sf_dir, keys), own, dims.sections(spark), keys))


# Section catalogue


@_query
def dim_sections(spark, sf_dir):
    """The section table with its river and the clean readings that feed each section."""
    per_gauge = _clean(spark, sf_dir).groupBy("gauge_id").agg(F.count(F.lit(1)).alias("readings"))
    fed = dims.coefficients(spark).join(per_gauge, "gauge_id", "left")
    per_section = fed.groupBy("section_id").agg(F.sum(F.coalesce("readings", F.lit(0))).alias("readings"))
    named = summary.current_rivers(pipeline.section_dim(spark), pipeline.river_dim(spark))
    return named.join(per_section, "section_id").select(
        "section_id", "section_name", "river_name", "flow_unit", *classify.THRESHOLDS, "lat", "lon", "state", "readings"
    )


@_query
def section_names(spark, sf_dir):
    return selection.section_names(_snapshot(spark, sf_dir))


@_query
def section_lookup(spark, sf_dir):
    """One section's record, beside its current levels."""
    record = selection.section_lookup(dims.sections(spark), RECORD_OF)
    now = _snapshot(spark, sf_dir).select("section_name", "flow_type", "river_level")
    columns = ("section_id", "section_name", "american_whitewater", "lat", "lon", "flow_type", "river_level")
    return _doubles(now.join(F.broadcast(record), "section_name").select(*columns))


@_query
def section_links(spark, sf_dir):
    """Links and videos of each section, with the section's current class."""
    now = _snapshot(spark, sf_dir).filter(F.col("flow_type") == "standard").select("section_name", "flow_range")
    links = selection.section_links(dims.sections(spark))
    return links.join(now, "section_name").select("section_id", "section_name", "kind", "url", "flow_range")


# Classification and current conditions


@_query
def level_ranges(spark, sf_dir):
    return _doubles(_ranges(spark, sf_dir))


@_query
def level_ranges_networks(spark, sf_dir):
    return _doubles(_ranges(spark, sf_dir, events.NETWORK_KEYS))


@_query
def level_ranges_from_union(spark, sf_dir):
    """Both units for every series, then the section join discards the foreign one."""
    both = levels.level_union(_long(spark, sf_dir, "feet"), _long(spark, sf_dir, "cfs"))
    return _doubles(classify.level_ranges(both, pipeline.section_dim(spark)))


@_query
def latest_section(spark, sf_dir):
    return _doubles(summary.latest_section(_ranges(spark, sf_dir)))


@_query
def latest_section_networks(spark, sf_dir):
    return _doubles(_snapshot(spark, sf_dir, events.NETWORK_KEYS))


@_query
def current_pivot(spark, sf_dir):
    return _doubles(summary.current_pivot(_snapshot(spark, sf_dir)))


@_query
def current_rivers(spark, sf_dir):
    pivoted = summary.current_pivot(_snapshot(spark, sf_dir))
    return _doubles(summary.current_rivers(pivoted, pipeline.river_dim(spark)))


@_query
def flow_rank(spark, sf_dir):
    ranked = summary.with_rank(summary.current_pivot(_snapshot(spark, sf_dir)))
    return ranked.select("section_name", "flow_range", "rank")


@_query
def current_levels(spark, sf_dir):
    """Flagship: current conditions, reduced straight from the readings."""
    return pipeline.current_of(_clean(spark, sf_dir))


@_query
def current_levels_from_ranges(spark, sf_dir):
    """The same table by way of the full ranges."""
    return summary.current_levels(_ranges(spark, sf_dir), pipeline.river_dim(spark))


@_query
def current_levels_networks(spark, sf_dir):
    keys = events.NETWORK_KEYS
    return pipeline.current_of(_clean(spark, sf_dir, keys), keys)


@_query
def flow_color(spark, sf_dir):
    return summary.with_colors(pipeline.current_of(_clean(spark, sf_dir)))


# Views and charts


@_query
def forecast_view(spark, sf_dir):
    return _doubles(pipeline.view_of(_clean(spark, sf_dir)))


@_query
def section_view(spark, sf_dir):
    return _doubles(pipeline.view_of(_clean(spark, sf_dir), ("The Cabarton",)))


@_query
def section_bounds(spark, sf_dir):
    return bands.section_bounds(_ranges(spark, sf_dir))


@_query
def section_bounds_by_month(spark, sf_dir):
    return bands.bounds_of_extrema(bands.monthly_extrema(_ranges(spark, sf_dir)))


@_query
def section_bands(spark, sf_dir):
    return bands.section_bands(bands.section_bounds(_ranges(spark, sf_dir)), pipeline.section_dim(spark))


@_query
def section_bands_networks(spark, sf_dir):
    keys = events.NETWORK_KEYS
    bounds = bands.section_bounds(_ranges(spark, sf_dir, keys), keys)
    return bands.section_bands(bounds, pipeline.section_dim(spark), keys)


@_query
def clamped_series(spark, sf_dir):
    return bands.clamped_history(_ranges(spark, sf_dir), pipeline.section_dim(spark))


# Audit


@_query
def audit_rows(spark, sf_dir):
    return audit.audit_rows(_raw(spark, sf_dir), pipeline.gauge_dim(spark))
