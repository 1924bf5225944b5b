"""From readings to one row per gauge and local hour.

``keys`` names optional partition columns (for example ``("network_id",)``). Every rule applies
per combination of them; with no keys all readings form one network.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riffle.functions import labels, times

SLOT = ("gauge_id", "mountain_time")
DATA_TYPES = ("observed", "forecast")


def _is_observed() -> Column:
    return F.col("data_type") == "observed"


def hourly(df: DataFrame, column: str = "utc_time") -> DataFrame:
    """Rows whose minute, after dropping the seconds, is zero; the column is cut to the minute."""
    floored = times.floor_minute(F.col(column))
    return df.withColumn(column, floored).filter(times.on_the_hour(F.col(column)))


def to_hourly_mountain(df: DataFrame) -> DataFrame:
    """Hourly rows with ``mountain_time`` derived from ``utc_time``, which is kept as the instant."""
    return hourly(df).withColumn("mountain_time", times.to_local(F.col("utc_time")))


def latest_observation(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Latest observed time: one row in all without keys, else one row per key combination."""
    observed = df.filter(_is_observed())
    return observed.groupBy(*keys).agg(F.max("mountain_time").alias("max_observed"))


def forecast_cutoff(
    df: DataFrame, keys: Sequence[str] = (), latest: DataFrame | None = None, is_observed: Column | None = None
) -> DataFrame:
    """Drop forecasts at or before the latest observation of the network.

    Without any observation there is no bound to pass, so every forecast goes.
    """
    latest = latest_observation(df, keys) if latest is None else latest
    is_observed = _is_observed() if is_observed is None else is_observed
    if not keys:
        return df.filter(is_observed | (F.col("mountain_time") > latest.scalar()))
    # One row per network. No hint: the runtime size decides between broadcast and shuffle.
    kept = df.join(latest, list(keys)).filter(is_observed | (F.col("mountain_time") > F.col("max_observed")))
    return kept.drop("max_observed")


def conflict_filter(
    df: DataFrame, keys: Sequence[str] = (), sources: Sequence[str] = labels.SOURCES
) -> DataFrame:
    """Keep every observed row, and a forecast only where it is alone at its gauge and time.

    A counting window would bring all copies of a crowded hour into one task. Here observed rows
    pass straight through, and a lone forecast is recovered from its group's pre-aggregated count.
    ``source`` is never null: ingest stamps it.
    """
    ids = [*keys, *SLOT]
    carried = [c for c in df.columns if c not in ids]
    texts = {"source": sources, "data_type": DATA_TYPES}
    # A lone forecast is the only one of its kind, so any maximum returns its values. Known texts travel as codes.
    coded = df.withColumns({f"{c}_code": F.expr(labels.code_sql(c, texts[c])) for c in carried if c in texts})
    held = {c: f"{c}_code" if c in texts else c for c in carried}
    groups = coded.groupBy(*ids).agg(
        F.count("source").alias("copies"),
        F.expr("count(1) FILTER (WHERE data_type <> 'observed') AS forecasts"),
        *[F.expr(f"max(`{h}`) FILTER (WHERE data_type <> 'observed') AS `{h}`") for h in held.values()],
    )
    back = [f"{labels.text_sql(h, texts[c])} AS {c}" if c in texts else f"`{c}`" for c, h in held.items()]
    lone = groups.filter("copies = 1 AND forecasts = 1").selectExpr(*ids, *back)
    return df.filter(_is_observed()).unionByName(lone)


def duplicate_keys(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Gauge and time combinations that occur more than once, with their counts."""
    counted = df.groupBy(*keys, *SLOT).agg(F.count(F.lit(1)).alias("copies"))
    return counted.filter(F.col("copies") > 1)


def clean_readings(
    df: DataFrame,
    keys: Sequence[str] = (),
    on_duplicate: str = "error",
    version: Sequence[str] = ("utc_time",),
    latest: DataFrame | None = None,
    sources: Sequence[str] = labels.SOURCES,
) -> DataFrame:
    """Forecast cut-off, conflict filter and uniqueness in one aggregation per gauge and hour.

    All rows of a slot share its time, so the cut-off can be applied to slots instead of readings:
    at or before the bound only the observed rows count, and past it there are none. That leaves
    one shuffle of pre-aggregated rows, whatever the number of readings per slot.

    ``on_duplicate="error"`` fails when two observed rows share a slot, and drops all forecasts of
    a slot that has several. ``"latest"`` keeps the row with the greatest ``version`` instead,
    which must be unique within gauge, time and data type. ``latest`` overrides where the bound of
    the cut-off is read from (columns: keys and ``max_observed``). ``sources`` are the texts that may
    occur as source.
    """
    if on_duplicate not in ("error", "latest"):
        raise ValueError(f"unknown on_duplicate: {on_duplicate}")
    strict = on_duplicate == "error"
    values = ["flow_cfs", "stage_ft"]
    kept = [c for c in ("run_time",) if c in df.columns]
    coded = df.withColumn("source_code", F.expr(labels.code_sql("source", sources)))
    carried = [*values, *kept, "source_code"]
    # Several version columns compare as a struct, which Spark aggregates by sorting.
    order = version[0] if len(version) == 1 else f"struct({', '.join(version)})"

    def pick(column: str) -> str:
        # In strict mode the picked row is the only one of its kind, so any maximum returns it.
        return f"max({column})" if strict else f"max_by({column}, {order})"

    kinds = {"observed": "data_type = 'observed'", "forecast": "data_type <> 'observed'"}
    slots = coded.groupBy(*keys, *SLOT).agg(
        *[F.expr(f"count(1) FILTER (WHERE {test}) AS {kind}_rows") for kind, test in kinds.items()],
        *[
            F.expr(f"{pick(c)} FILTER (WHERE {test}) AS {kind}_{c}")
            for kind, test in kinds.items()
            for c in carried
        ],
    )
    has_observed = F.col("observed_rows") > 0
    bound = latest_observation(df, keys) if latest is None else latest
    slots = forecast_cutoff(slots, keys, bound, has_observed)
    if strict:
        slots = slots.filter("observed_rows > 0 OR forecast_rows = 1").filter(
            "CASE WHEN observed_rows <= 1 THEN true ELSE boolean(raise_error(concat("
            "'duplicate observed readings remain after cleaning: gauge ', gauge_id, ' at ', mountain_time))) END"
        )

    def chosen(column: str) -> str:
        return f"if(observed_rows > 0, observed_{column}, forecast_{column})"

    return slots.selectExpr(
        *keys,
        "gauge_id",
        f"{labels.text_sql(chosen('source_code'), sources)} AS source",
        "if(observed_rows > 0, 'observed', 'forecast') AS data_type",
        "mountain_time",
        *[f"{chosen(c)} AS {c}" for c in [*values, *kept]],
    )
