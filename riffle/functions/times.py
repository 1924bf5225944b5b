"""Time columns. All of them stay TIMESTAMP_NTZ, so no result depends on the session time zone."""

from __future__ import annotations

from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

# The local zone and the two accepted text forms.
LOCAL_ZONE = "America/Denver"
INSTANT_FORM = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(Z|[+-]\d\d:?\d\d)$"
LOCAL_FORM = r"^\d{4}-\d\d-\d\d \d\d:\d\d$"
# End of fixed values.


def parse_epoch(text: Column) -> Column:
    """ISO text with ``Z`` or an offset as epoch seconds; null when it does not have that form.

    The cast sees an explicit offset in every accepted text, so the session zone plays no part.
    """
    return F.when(text.rlike(INSTANT_FORM), F.unix_seconds(text.try_cast("timestamp")))


def from_epoch(seconds: Column) -> Column:
    """Epoch seconds as UTC wall clock."""
    return F.timestamp_add("SECOND", seconds, ntz("1970-01-01 00:00:00"))


def parse_instant(text: Column) -> Column:
    """ISO text with ``Z`` or an offset as UTC wall clock; null when it does not have that form."""
    return from_epoch(parse_epoch(text))


def parse_local(text: Column) -> Column:
    """``yyyy-MM-dd HH:mm`` text, already local; null when it does not have that form."""
    return F.when(text.rlike(LOCAL_FORM), text.try_cast("timestamp_ntz"))


def floor_minute(ts: Column) -> Column:
    return ts - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.extract(F.lit("SECOND"), ts))


def floor_hour(ts: Column) -> Column:
    # date_trunc would go through the session zone and shift times on a spring-forward day.
    return ts - F.make_dt_interval(F.lit(0), F.lit(0), F.minute(ts), F.extract(F.lit("SECOND"), ts))


def hour_number(ts: Column) -> Column:
    """Whole hours since 1970 on the clock of ``ts``: a cheaper grouping key than the hour itself."""
    return F.unix_date(ts.cast("date")) * 24 + F.hour(ts)


def from_hour(number: Column) -> Column:
    return F.timestamp_add("HOUR", number, ntz("1970-01-01 00:00:00"))


def on_the_hour(ts: Column) -> Column:
    return F.minute(ts) == 0


def to_local(utc: Column, zone: str = LOCAL_ZONE) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def month_number(ts: Column) -> Column:
    """Calendar months since year 0, the time block used to spread long series over tasks."""
    return F.year(ts) * 12 + F.month(ts) - 1


def ntz(value: datetime | str) -> Column:
    text = value if isinstance(value, str) else value.isoformat(sep=" ")
    return F.lit(text).cast("timestamp_ntz")


def local_now(zone: str = LOCAL_ZONE) -> datetime:
    """Wall clock in the local zone, for callers that stamp a run with the present time."""
    return datetime.now(ZoneInfo(zone)).replace(tzinfo=None)
