"""DuckDB SQL for the registered queries, written from the rules rather than from the Spark plans.

The SQL keeps to the plain form of each rule (windows over whole series, one wide row per time)
and has its own copy of the fixed values, which is what makes it an independent check.
"""

from __future__ import annotations

from riffle.operators import summary
from riffle.plans import fixed_values as fixed
from riffle.plans import queries as q

GAUGES = [r[0] for r in fixed.GAUGES]
RECLAMATION = ", ".join(str(r[0]) for r in fixed.GAUGES if r[6] == "bureau_reclamation")
SERIES = sorted({(section, kind != "standard", kind) for section, kind, _, _ in fixed.COEFFICIENTS})


def _lit(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, float):
        return f"CAST({value!r} AS DOUBLE)"
    if isinstance(value, list):
        return "[" + ", ".join(_lit(v) for v in value) + "]"
    return f"CAST({value} AS INTEGER)"


def _values(name: str, columns: str, rows) -> str:
    body = ", ".join("(" + ", ".join(_lit(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {body})"


SECTIONS = _values(
    "sections",
    "section_id, river_id, section, section_name, flow_unit, min_level, medium_level, high_level, max_level, "
    "lat, lon, american_whitewater, state, link, video",
    fixed.SECTIONS,
)
RIVERS = _values("rivers", "river_id, river_name", fixed.RIVERS)
GAUGE_TABLE = _values(
    "gauges",
    "gauge_id, gauge_name, river_id, waterdata_usgs_identifier, bureau_reclamation_identifier, "
    "noaa_forecast_identifier, observed_api, forecast_api, lat, lon",
    fixed.GAUGES,
)
COEFFICIENTS = _values("coefficients", "section_id, flow_type, gauge_id, coef", fixed.COEFFICIENTS)

LOCAL = "timezone('America/Denver', timezone('UTC', {}))"
FORECAST = "(event_type IN ('signup', 'error') OR ts >= TIMESTAMP '2024-01-25 00:00:00')"
RAW = f"""raw AS (
  SELECT event_id, value, ts AS utc_time, CAST(user_id // 15 AS BIGINT) AS network_id, k,
         CAST(user_id % 15 + 1 AS INTEGER) AS gauge_id,
         CASE WHEN {FORECAST} THEN 'forecast' ELSE 'observed' END AS data_type,
         CASE WHEN {FORECAST} THEN 'noaa_forecast'
              WHEN user_id % 15 + 1 IN ({RECLAMATION}) THEN 'bureau_reclamation' ELSE 'usgs' END AS source,
         date_trunc('hour', {LOCAL.format("ts")}) AS mountain_time,
         CASE WHEN k >= 5 THEN value * 40 END AS flow_cfs,
         CASE WHEN k < 95 THEN value / 15 END AS stage_ft,
         CASE WHEN k < 50 THEN '00060' ELSE '00065' END AS parameter_code
  FROM (SELECT *, CAST(props ->> 'k' AS INTEGER) AS k FROM events))"""


def _chain(net: bool = False) -> str:
    """Binding and cleaning: raw, readings, clean."""
    k = "network_id, " if net else ""
    return f"""{RAW},
readings AS (
  SELECT * FROM raw
  QUALIFY row_number() OVER (PARTITION BY {k}gauge_id, data_type, mountain_time ORDER BY event_id DESC) = 1),
bound AS (
  SELECT {k}max(mountain_time) AS max_observed FROM readings WHERE data_type = 'observed'
  {"GROUP BY network_id" if net else ""}),
after_bound AS (
  SELECT r.* FROM readings r {"JOIN bound USING (network_id)" if net else "CROSS JOIN bound"}
  WHERE data_type = 'observed' OR mountain_time > max_observed),
clean AS (
  SELECT * FROM after_bound
  QUALIFY count(source) OVER (PARTITION BY {k}gauge_id, mountain_time) = 1 OR data_type = 'observed')"""


def _formula(section: int, kind: str) -> str:
    terms = [(gauge, sign) for s, k, gauge, sign in fixed.COEFFICIENTS if (s, k) == (section, kind)]
    return " ".join(f"{'-' if sign < 0 else '+'} g{gauge}" for gauge, sign in terms).removeprefix("+ ")


def _column(section: int, kind: str) -> str:
    return f"section_id_{section}" + ("" if kind == "standard" else "_max")


def _matrix(metric: str, net: bool = False) -> str:
    k = "network_id, " if net else ""
    cells = ", ".join(f"max({metric}) FILTER (WHERE gauge_id = {g}) AS g{g}" for g in GAUGES)
    return f"matrix_{metric} AS (SELECT {k}mountain_time, data_type, {cells} FROM clean GROUP BY ALL)"


def _filled(metric: str, net: bool = False) -> str:
    k = "network_id, " if net else ""
    part = "PARTITION BY network_id" if net else ""
    cells = ", ".join(
        f"coalesce(last_value(g{g} IGNORE NULLS) OVER back, first_value(g{g} IGNORE NULLS) OVER ahead, 0) AS g{g}"
        for g in GAUGES
    )
    return f"""{_matrix(metric, net)},
filled_{metric} AS (
  SELECT {k}mountain_time, data_type, {cells} FROM matrix_{metric}
  WINDOW back AS ({part} ORDER BY mountain_time, data_type ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         ahead AS ({part} ORDER BY mountain_time, data_type ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


def _wide(metric: str, net: bool = False) -> str:
    k = "network_id, " if net else ""
    cells = ", ".join(f"{_formula(s, kind)} AS {_column(s, kind)}" for s, _, kind in SERIES)
    return f"""{_filled(metric, net)},
wide_{metric} AS (SELECT {k}mountain_time, data_type, {cells} FROM filled_{metric})"""


def _long(metric: str, unit: str, net: bool = False) -> str:
    k = "network_id, " if net else ""
    items = ", ".join(
        f"{{'section_id': CAST({s} AS INTEGER), 'flow_type': '{kind}', 'level': {_column(s, kind)}}}"
        for s, _, kind in SERIES
    )
    return f"""{_wide(metric, net)},
long_{metric} AS (
  SELECT {k}mountain_time, data_type, CAST(level AS FLOAT) AS river_level, section_id, flow_type, '{unit}' AS flow_unit
  FROM (SELECT {k}mountain_time, data_type, unnest([{items}], recursive := true) FROM wide_{metric}))"""


def _ranges(net: bool = False) -> str:
    k = "network_id, " if net else ""
    return f"""{_chain(net)}, {_long("stage_ft", "feet", net)}, {_long("flow_cfs", "cfs", net)},
{SECTIONS}, {RIVERS},
levels AS (SELECT * FROM long_stage_ft UNION ALL SELECT * FROM long_flow_cfs),
ranges AS (
  SELECT {k}mountain_time, data_type, CAST(river_level AS DOUBLE) AS river_level, section_id, flow_type,
         flow_unit, river_id, section_name,
         CASE WHEN CAST(river_level AS DOUBLE) < min_level THEN 'Too Low'
              WHEN CAST(river_level AS DOUBLE) < medium_level THEN 'Low'
              WHEN CAST(river_level AS DOUBLE) < high_level THEN 'Medium'
              WHEN CAST(river_level AS DOUBLE) < max_level THEN 'High' ELSE 'Too High' END AS flow_range
  FROM levels JOIN sections USING (section_id, flow_unit))"""


def _latest(net: bool = False) -> str:
    k = "network_id, " if net else ""
    return f"""{_ranges(net)},
latest AS (
  SELECT {k}section_name, flow_type, flow_range, river_id,
         CAST(CAST(CASE WHEN flow_unit = 'feet' THEN round_even(river_level, 2) ELSE ceil(river_level) END AS FLOAT)
              AS DOUBLE) AS river_level
  FROM (SELECT * FROM ranges WHERE data_type = 'observed'
        QUALIFY row_number() OVER (PARTITION BY {k}section_name, flow_type ORDER BY mountain_time DESC) = 1))"""


def _pivot(net: bool = False) -> str:
    k = "network_id, " if net else ""
    return f"""{_latest(net)},
pivoted AS (
  SELECT {k}section_name, river_id,
         max(river_level) FILTER (WHERE flow_type = 'standard') AS river_level,
         max(flow_range) FILTER (WHERE flow_type = 'standard') AS flow_range,
         max(river_level) FILTER (WHERE flow_type = 'max') AS river_level_max,
         max(flow_range) FILTER (WHERE flow_type = 'max') AS flow_range_max
  FROM latest GROUP BY ALL)"""


RANK = "CASE flow_range " + " ".join(f"WHEN '{c}' THEN {r}" for c, r in fixed.RANKS.items()) + " END"


def _shown(column: str) -> str:
    return f"""CASE WHEN {column} IS NULL THEN ''
       WHEN {column} = floor({column}) THEN format('{{:,}}', CAST({column} AS BIGINT))
       ELSE format('{{:,.2f}}', {column}) END AS {column}"""


def _current(net: bool = False) -> str:
    k = "network_id, " if net else ""
    return f"""{_pivot(net)},
merged AS (
  SELECT {k}river_name, river_level, flow_range, river_level_max, flow_range_max,
         string_agg(section_name, ', ' ORDER BY section_name) AS sections
  FROM pivoted JOIN rivers USING (river_id) GROUP BY ALL),
current_levels AS (
  SELECT {k}sections, {_shown("river_level")}, flow_range, {_shown("river_level_max")}, flow_range_max FROM merged)"""


def _color(column: str, name: str) -> str:
    cases = " ".join(f"WHEN '{c}' THEN '{color}'" for c, color in fixed.CLASS_COLORS.items())
    return f"CASE {column} {cases} END AS {name}"


def _view(names) -> str:
    chosen = ", ".join(_lit(n) for n in names)
    return f"""WITH {_ranges()}
SELECT CASE WHEN flow_type = 'standard' THEN section_name ELSE section_name || ' (Max)' END AS section_name,
       mountain_time, river_level, flow_type
FROM ranges WHERE section_name IN ({chosen})"""


def _bounds(net: bool = False) -> str:
    k = "network_id, " if net else ""
    return f"""{_ranges(net)},
bounds AS (
  SELECT {k}section_id, min(river_level) AS level_min, max(river_level) AS level_max,
         min(mountain_time) FILTER (WHERE flow_type = 'standard') AS x_min,
         max(mountain_time) FILTER (WHERE flow_type = 'standard') AS x_max
  FROM ranges GROUP BY ALL)"""


# Branch number, y1, y2 and colour of every band.
_BANDS = [
    (1, "0", "a", "R"), (1, "a", "b", "B"),
    (2, "c", "d", "Y"), (2, "d", "level_max * 1.1", "R"),
    (3, "a / 2", "a", "R"), (3, "a", "b", "B"), (3, "b", "c", "G"), (3, "c", "(c * 2 + d) / 3", "Y"),
    (4, "(a + b) / 2", "b", "B"), (4, "b", "c", "G"), (4, "c", "d", "Y"), (4, "d", "d * 1.1", "R"),
    (5, "0", "a", "R"), (5, "a", "b", "B"), (5, "b", "c", "G"), (5, "c", "d", "Y"), (5, "d", "d * 1.1", "R"),
]
_COLORS = {"R": fixed.RED, "B": fixed.BLUE, "G": fixed.GREEN, "Y": fixed.YELLOW}


def _bands(net: bool = False) -> str:
    k = "network_id, " if net else ""

    def double(text: str) -> str:
        return f"CAST({text.replace('1.1', 'CAST(1.1 AS DOUBLE)')} AS DOUBLE)"

    union = "\n  UNION ALL ".join(
        f"SELECT {k}section_id, x_min, x_max, {double(y1)} AS y1, {double(y2)} AS y2, '{_COLORS[c]}' AS color "
        f"FROM branched WHERE branch = {branch}"
        for branch, y1, y2, c in _BANDS
    )
    return f"""{_bounds(net)},
branched AS (
  SELECT bounds.*, min_level AS a, medium_level AS b, high_level AS c, max_level AS d,
         CASE WHEN level_max < min_level THEN 1 WHEN level_min > max_level THEN 2
              WHEN level_min > min_level AND level_max < high_level THEN 3
              WHEN level_min > medium_level THEN 4 ELSE 5 END AS branch
  FROM bounds JOIN sections USING (section_id)),
band_rows AS ({union}),
bands AS (
  SELECT *, min(y1) OVER (PARTITION BY {k}section_id) AS domain_min,
         max(y2) OVER (PARTITION BY {k}section_id) AS domain_max FROM band_rows)"""


MATRIX_COLUMNS = "mountain_time, data_type, " + ", ".join(f"g{g}" for g in GAUGES)

LANDED = f"""landed AS (
  SELECT r.*, g.gauge_name, g.noaa_forecast_identifier AS noaa, g.waterdata_usgs_identifier AS usgs,
         g.bureau_reclamation_identifier AS reclamation, g.observed_api,
         CASE WHEN data_type = 'forecast' THEN 'noaa'
              WHEN (gauge_id = 13) = (k >= 10) THEN 'bureau_rec' ELSE 'usgs' END AS landed_source,
         CASE WHEN k < 50 THEN date_trunc('second', utc_time) ELSE date_trunc('hour', utc_time) END AS at_utc
  FROM raw r JOIN gauges g USING (gauge_id)),
routed AS (
  SELECT *, date_trunc('minute', at_utc) AS minute_utc, k IN (7, 17) AS cut_short
  FROM landed
  WHERE landed_source = 'noaa' OR (landed_source = 'usgs') = (observed_api = 'waterdata_usgs')),
astray AS (SELECT * FROM landed WHERE event_id NOT IN (SELECT event_id FROM routed)),
calls AS (
  SELECT *, minute(minute_utc) = 0 AS on_hour,
         CASE WHEN NOT cut_short THEN NULL WHEN landed_source = 'bureau_rec' THEN 'unexpected header'
              ELSE 'malformed payload' END AS error
  FROM routed)"""


def _audit(net: bool = False) -> str:
    k, of = ("network_id, ", "e.network_id, ") if net else ("", "")
    return f"""WITH {RAW}, {GAUGE_TABLE}, {LANDED},
registry AS (
  SELECT gauge_id, gauge_name,
    CASE observed_api WHEN 'waterdata_usgs' THEN 'usgs' ELSE 'bureau_rec' END AS source,
    'observed' AS data_type,
    coalesce(waterdata_usgs_identifier, bureau_reclamation_identifier) AS identifier FROM gauges
  UNION ALL
  SELECT gauge_id, gauge_name, 'noaa', 'forecast', noaa_forecast_identifier FROM gauges),
expected AS (SELECT * FROM registry {"CROSS JOIN (SELECT DISTINCT network_id FROM landed)" if net else ""})
SELECT {of}e.gauge_name, e.identifier, e.source, e.data_type,
  CASE WHEN c.event_id IS NULL THEN 'no response landed' ELSE c.error END AS error,
  count(*) AS calls,
  CAST(sum(CASE WHEN c.event_id IS NULL OR c.error IS NOT NULL THEN 0
    WHEN c.landed_source = 'bureau_rec' AND NOT c.on_hour THEN 0 ELSE 1 END) AS BIGINT) AS rows
FROM expected e LEFT JOIN calls c ON c.gauge_id = e.gauge_id AND c.landed_source = e.source
  {"AND c.network_id = e.network_id" if net else ""}
GROUP BY ALL
UNION ALL
SELECT {k}NULL, NULL, landed_source, CASE landed_source WHEN 'noaa' THEN 'forecast' ELSE 'observed' END,
  'not registered for this source', count(*), 0
FROM astray GROUP BY ALL"""


def sql() -> dict[str, str]:
    chain, net = _chain(), _chain(True)
    queries = {
        "src_filter": f"""WITH {RAW} SELECT event_id, gauge_id, parameter_code, value FROM raw
            WHERE data_type = 'observed' AND source = 'usgs' AND parameter_code IN ('00060', '00065')""",
        "lookback_24h": f"""WITH {RAW} SELECT event_id, gauge_id, data_type, utc_time FROM raw
            WHERE utc_time BETWEEN TIMESTAMP '{q.AS_OF}' - INTERVAL 24 HOUR AND TIMESTAMP '{q.AS_OF}'""",
        "source_cap": f"""WITH {RAW} SELECT event_id, gauge_id, utc_time FROM raw WHERE data_type = 'observed'
            QUALIFY row_number() OVER (PARTITION BY gauge_id ORDER BY utc_time, event_id) <= 1000""",
        "source_route": f"""WITH {RAW}, {GAUGE_TABLE}, {LANDED}
            SELECT gauge_id, gauge_name, source, data_type, {LOCAL.format("minute_utc")} AS mountain_time,
              CASE landed_source WHEN 'bureau_rec' THEN value
                WHEN 'usgs' THEN CASE WHEN parameter_code = '00060' THEN value END
                ELSE CASE WHEN k < 50 THEN value ELSE value / 15 END * 1000 END AS flow_cfs,
              CASE landed_source WHEN 'bureau_rec' THEN CASE WHEN k < 90 THEN value / 15 END
                WHEN 'usgs' THEN CASE WHEN parameter_code = '00065' THEN value END
                ELSE CASE WHEN k < 50 THEN value / 15 ELSE value END END AS stage_ft
            FROM calls WHERE error IS NULL AND on_hour""",
        "ingest_audit": _audit(),
        "ingest_audit_networks": _audit(True),
        "json_props": """SELECT event_id, CAST(props ->> 'k' AS INTEGER) AS k,
            coalesce(CAST(props ->> 'missing' AS INTEGER), CAST(0 AS INTEGER)) AS missing FROM events""",
        "lenient_cast": f"""WITH {RAW} SELECT event_id, TRY_CAST(trim(
            CASE k WHEN 0 THEN 'NO RECORD' WHEN 1 THEN '1.5d' WHEN 2 THEN '2f' WHEN 3 THEN '0x1p3' WHEN 4 THEN '  '
              WHEN 5 THEN '1e3' WHEN 6 THEN 'NaN' ELSE '  ' || CAST(value AS VARCHAR) || ' ' END) AS DOUBLE) AS number
            FROM raw""",
        "unit_normalise": f"""WITH {RAW} SELECT event_id,
            CASE WHEN k < 40 THEN value ELSE value / 15 END * 1000 AS flow_cfs,
            CASE WHEN k < 40 THEN value / 15 ELSE value END AS stage_ft FROM raw""",
        "to_mountain": f"SELECT event_id, {LOCAL.format('ts')} AS mountain_time FROM events",
        "hourly_only": f"""WITH {RAW} SELECT event_id, date_trunc('minute', utc_time) AS utc_time,
            {LOCAL.format("date_trunc('minute', utc_time)")} AS mountain_time FROM raw WHERE minute(utc_time) = 0""",
        "parse_times": f"""WITH {RAW} SELECT event_id,
            CASE WHEN k >= 95 THEN NULL WHEN k < 40 THEN date_trunc('second', utc_time)
              WHEN k < 60 THEN date_trunc('second', utc_time) + INTERVAL 7 HOUR
              ELSE date_trunc('second', utc_time) - INTERVAL 330 MINUTE END AS instant,
            CASE WHEN k >= 5 THEN date_trunc('minute', utc_time) END AS local_time FROM raw""",
        "stamp_run": f"WITH {RAW} SELECT event_id, gauge_id, TIMESTAMP '{q.STAMP}' AS run_time FROM raw",
        "freshness": f"""WITH {RAW} SELECT gauge_id, max(utc_time) AS run_time,
            max(utc_time) >= TIMESTAMP '2024-01-30 23:00:00' - INTERVAL 60 MINUTE AS fresh FROM raw GROUP BY ALL""",
        "param_pivot": f"""WITH {RAW} SELECT gauge_id, mountain_time,
            max(value) FILTER (WHERE parameter_code = '00060') AS flow_cfs,
            max(value) FILTER (WHERE parameter_code = '00065') AS stage_ft
            FROM raw WHERE data_type = 'observed' GROUP BY ALL""",
        "forecast_cutoff": f"WITH {chain} SELECT gauge_id, data_type, mountain_time, flow_cfs, stage_ft FROM after_bound",
        "conflict_filter": f"""WITH {RAW} SELECT event_id, gauge_id, source, data_type, mountain_time FROM raw
            QUALIFY count(source) OVER (PARTITION BY gauge_id, mountain_time) = 1 OR data_type = 'observed'""",
        "clean_readings": f"""WITH {chain}, {GAUGE_TABLE}
            SELECT gauge_id, gauge_name, source, data_type, mountain_time, flow_cfs, stage_ft,
            TIMESTAMP '{q.STAMP}' AS run_time FROM clean JOIN gauges USING (gauge_id)""",
        "clean_readings_latest": f"""WITH {chain}
            SELECT gauge_id, source, data_type, mountain_time, flow_cfs, stage_ft FROM clean""",
        "clean_readings_networks": f"""WITH {net}
            SELECT network_id, gauge_id, source, data_type, mountain_time, flow_cfs, stage_ft FROM clean""",
        "dup_keys": f"""WITH {RAW} SELECT gauge_id, mountain_time, count(*) AS copies FROM raw
            GROUP BY ALL HAVING count(*) > 1""",
        "gauge_matrix": f"WITH {chain}, {_matrix('flow_cfs')} SELECT {MATRIX_COLUMNS} FROM matrix_flow_cfs",
        "filled_gauges": f"WITH {chain}, {_filled('flow_cfs')} SELECT {MATRIX_COLUMNS} FROM filled_flow_cfs",
        "filled_gauges_ft": f"WITH {chain}, {_filled('stage_ft')} SELECT {MATRIX_COLUMNS} FROM filled_stage_ft",
        "filled_gauges_networks": f"""WITH {net}, {_filled("flow_cfs", True)}
            SELECT network_id, {MATRIX_COLUMNS} FROM filled_flow_cfs""",
        "section_levels_cfs": f"WITH {chain}, {_wide('flow_cfs')} SELECT * FROM wide_flow_cfs",
        "section_levels_ft": f"WITH {chain}, {_wide('stage_ft')} SELECT * FROM wide_stage_ft",
        "section_unpivot": f"""WITH {chain}, {_long("flow_cfs", "cfs")}
            SELECT * REPLACE (CAST(river_level AS DOUBLE) AS river_level) FROM long_flow_cfs""",
        "level_union": f"""WITH {_ranges()}
            SELECT * REPLACE (CAST(river_level AS DOUBLE) AS river_level) FROM levels""",
        "section_levels_long": f"""WITH {chain}, {_long("flow_cfs", "cfs")}
            SELECT mountain_time, data_type, section_id, flow_type, CAST(river_level AS DOUBLE) AS river_level
            FROM long_flow_cfs""",
        "registry_levels": f"""WITH {_ranges()}
            SELECT mountain_time, data_type, river_level, section_id, flow_type, flow_unit FROM ranges""",
        "registry_levels_networks": f"""WITH {net}, {SECTIONS}, {COEFFICIENTS},
            terms AS (
              SELECT network_id, section_id, flow_type, flow_unit, (gauge_id + network_id) % {len(GAUGES)} + 1 AS gauge_id,
                     coef * (1 + network_id % 2) AS coef
              FROM (SELECT DISTINCT network_id FROM raw), coefficients JOIN sections USING (section_id)
              WHERE (network_id + section_id) % 3 <> 0),
            times AS (SELECT DISTINCT network_id, mountain_time, data_type FROM clean),
            grid AS (
              SELECT t.*, gauge_id, flow_unit, CASE flow_unit WHEN 'cfs' THEN flow_cfs ELSE stage_ft END AS value
              FROM times t JOIN (SELECT DISTINCT network_id, gauge_id, flow_unit FROM terms) USING (network_id)
              LEFT JOIN clean USING (network_id, mountain_time, data_type, gauge_id)),
            filled AS (
              SELECT *, coalesce(last_value(value IGNORE NULLS) OVER back, first_value(value IGNORE NULLS) OVER ahead, 0) AS level
              FROM grid WINDOW
                back AS (PARTITION BY network_id, gauge_id, flow_unit ORDER BY mountain_time, data_type
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                ahead AS (PARTITION BY network_id, gauge_id, flow_unit ORDER BY mountain_time, data_type
                          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
            SELECT network_id, mountain_time, data_type, section_id, flow_type, flow_unit,
              CAST(CAST(round(sum(coef * level), 12) AS FLOAT) AS DOUBLE) AS river_level
            FROM filled JOIN terms USING (network_id, gauge_id, flow_unit)
            GROUP BY network_id, mountain_time, data_type, section_id, flow_type, flow_unit""",
        "dim_sections": f"""WITH {chain}, {SECTIONS}, {RIVERS}, {COEFFICIENTS},
            per_gauge AS (SELECT gauge_id, count(*) AS n FROM clean GROUP BY ALL)
            SELECT section_id, section_name, river_name, flow_unit, min_level, medium_level, high_level, max_level,
              lat, lon, state, CAST(sum(coalesce(n, 0)) AS BIGINT) AS readings
            FROM sections JOIN rivers USING (river_id) JOIN coefficients USING (section_id)
            LEFT JOIN per_gauge USING (gauge_id) GROUP BY ALL""",
        "section_names": f"WITH {_latest()} SELECT DISTINCT section_name FROM latest",
        "section_lookup": f"""WITH {_latest()} SELECT section_id, section_name, american_whitewater, lat, lon,
            flow_type, river_level FROM latest JOIN sections USING (section_name)
            WHERE section_name = {_lit(q.RECORD_OF)}""",
        "section_links": f"""WITH {_latest()}, tagged AS (
              SELECT section_id, section_name, 'link' AS kind, unnest(link) AS url FROM sections UNION ALL
              SELECT section_id, section_name, 'video' AS kind, unnest(video) AS url FROM sections)
            SELECT section_id, section_name, kind, url, flow_range FROM tagged
            JOIN latest USING (section_name) WHERE flow_type = 'standard'""",
        "level_ranges": f"WITH {_ranges()} SELECT * FROM ranges",
        "level_ranges_from_union": f"WITH {_ranges()} SELECT * FROM ranges",
        "level_ranges_networks": f"WITH {_ranges(True)} SELECT * FROM ranges",
        "latest_section": f"WITH {_latest()} SELECT * FROM latest",
        "latest_section_networks": f"WITH {_latest(True)} SELECT * FROM latest",
        "current_pivot": f"WITH {_pivot()} SELECT * FROM pivoted",
        "current_rivers": f"WITH {_pivot()} SELECT * FROM pivoted JOIN rivers USING (river_id)",
        "flow_rank": f"WITH {_pivot()} SELECT section_name, flow_range, CAST({RANK} AS INTEGER) AS rank FROM pivoted",
        "current_levels": f"WITH {_current()} SELECT * FROM current_levels",
        "current_levels_from_ranges": f"WITH {_current()} SELECT * FROM current_levels",
        "current_levels_networks": f"WITH {_current(True)} SELECT * FROM current_levels",
        "flow_color": f"""WITH {_current()} SELECT *, {_color("flow_range", "color")},
            {_color("flow_range_max", "color_max")} FROM current_levels""",
        "forecast_view": _view(summary.DEFAULT_SECTIONS),
        "section_view": _view(["The Cabarton"]),
        "section_bounds": f"WITH {_bounds()} SELECT * FROM bounds",
        "section_bounds_by_month": f"WITH {_bounds()} SELECT * FROM bounds",
        "section_bands": f"WITH {_bands()} SELECT * FROM bands",
        "section_bands_networks": f"WITH {_bands(True)} SELECT * FROM bands",
        "clamped_series": f"""WITH {_bands()},
            domain AS (SELECT DISTINCT section_id, domain_min, domain_max FROM bands)
            SELECT section_id, section_name, flow_type, mountain_time,
              greatest(domain_min, least(domain_max, river_level)) AS river_level
            FROM ranges JOIN domain USING (section_id)""",
        "audit_rows": f"""WITH {RAW}, {GAUGE_TABLE}, expected AS (
              SELECT gauge_id, gauge_name, 'observed' AS data_type,
                CASE observed_api WHEN 'waterdata_usgs' THEN 'usgs' ELSE 'bureau_rec' END AS source,
                coalesce(waterdata_usgs_identifier, bureau_reclamation_identifier) AS identifier FROM gauges
              UNION ALL SELECT gauge_id, gauge_name, 'forecast', 'noaa', noaa_forecast_identifier FROM gauges),
            counts AS (SELECT gauge_id, data_type, count(*) AS n FROM raw GROUP BY ALL)
            SELECT gauge_name, identifier, source, data_type, coalesce(n, 0) AS rows, CAST(NULL AS VARCHAR) AS error
            FROM expected LEFT JOIN counts USING (gauge_id, data_type)""",
    }
    return queries
