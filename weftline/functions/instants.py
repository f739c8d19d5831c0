"""Instants as milliseconds since 1970 (UTC wall clock), free of the session's time zone."""

from __future__ import annotations

from datetime import UTC, date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000


def millis(when: str | date | datetime) -> int:
    """Of an ISO date or timestamp, or of a Python one."""
    if isinstance(when, str):
        when = datetime.fromisoformat(when)
    if not isinstance(when, datetime):
        when = datetime(when.year, when.month, when.day)
    return round((when if when.tzinfo else when.replace(tzinfo=UTC)).timestamp() * 1000)


def epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def timestamp(ms: Column) -> Column:
    return epoch() + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (ms.cast("decimal(18,0)") / 1000).cast("decimal(18,6)"))


def day(ms: Column) -> Column:
    return F.date_from_unix_date(F.floor(ms / DAY).cast("int"))


def ms_of(value: Column, kind: str) -> Column:
    """Milliseconds of a stored date or timestamp."""
    if kind == "date":
        return F.unix_date(value).cast("long") * DAY
    gap = value.cast("timestamp_ntz") - epoch()
    parts = [F.extract(F.lit(p), gap) for p in ("DAY", "HOUR", "MINUTE", "SECOND")]
    return ((parts[0].cast("long") * 24 + parts[1]) * 60 + parts[2]) * 60_000 + (parts[3] * 1000).cast("long")
