"""Instants and local days. The session time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Europe/London"


def local(ts: Column, zone: str = ZONE) -> Column:
    return F.from_utc_timestamp(ts.cast("timestamp"), zone)


def local_day(ts: Column, zone: str = ZONE) -> Column:
    return F.to_date(local(ts, zone))


def from_local(x: Column, zone: str = ZONE) -> Column:
    """The instant of a local time; of two in an autumn overlap, the later."""
    u = F.to_utc_timestamp(x, zone)
    later = u + F.expr("interval 1 hour")
    return F.when(F.from_utc_timestamp(later, zone) == x, later).otherwise(u)


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_rfc3339(x: Column) -> Column:
    """An instant with seconds and an offset; null for all else."""
    whole = F.regexp_replace(x, r"(:\d\d)[.,]\d+", "$1")
    good = whole.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(Z|[+-]\d\d:\d\d)$")
    return F.when(good, F.try_to_timestamp(whole, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))


def labels(ts: Column) -> dict[str, Column]:
    t = local(ts)
    return {"date_long": F.date_format(t, "EEEE, d MMMM yyyy"), "date_short": F.date_format(t, "EEE d MMM"), "time_short": F.date_format(t, "HH:mm"), "year": F.date_format(t, "yyyy")}
