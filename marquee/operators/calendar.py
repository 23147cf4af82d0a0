"""What is on, by local day."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions.time import local_day

WINDOWS = ("all", "today", "week")


def upcoming(events: DataFrame, today: date, start: str = "start_at") -> DataFrame:
    return events.filter(local_day(F.col(start)) >= F.lit(today))


def in_window(events: DataFrame, window: str, today: date, start: str = "start_at") -> DataFrame:
    """Upcoming events of all days, today, or today and the six days after; another name is all."""
    day = local_day(F.col(start))
    until = {"today": 1, "week": 7}.get(window)
    found = events.filter(day >= F.lit(today))
    return found if until is None else found.filter(day < F.date_add(F.lit(today), until))


def not_on(events: DataFrame, day: date, start: str = "start_at") -> DataFrame:
    return events.filter(local_day(F.col(start)) != F.lit(day))


def at_venue(events: DataFrame, slug: str, venues: DataFrame | None = None) -> DataFrame:
    """Events of a venue; '' and, with ``venues``, an unknown slug are no filter."""
    if not slug or (venues is not None and venues.filter(F.col("slug") == slug).isEmpty()):
        return events
    return events.filter(F.col("venue_slug") == slug)


def displayed(events: DataFrame) -> DataFrame:
    return events.orderBy("start_at", "slug")


def by_local_date(events: DataFrame) -> DataFrame:
    """Events with local_date, days in order and each day's events in display order. The sort deals a
    day with very many events over several tasks."""
    return events.withColumn("local_date", local_day(F.col("start_at"))).orderBy("local_date", "start_at", "slug")


def day_lines(events: DataFrame) -> DataFrame:
    """local_date, n and slugs (in display order) of each day; only start and slug are gathered."""
    row = F.array_sort(F.collect_list(F.struct("start_at", "slug")))
    return events.groupBy(local_day(F.col("start_at")).alias("local_date")).agg(F.count("*").alias("n"), F.transform(row, lambda e: e["slug"]).alias("slugs")).orderBy("local_date")


def events_page(star: DataFrame, venues: DataFrame, window: str, venue: str, today: date) -> DataFrame:
    return by_local_date(in_window(at_venue(star, venue, venues), window, today))


def home(star: DataFrame, today: date) -> dict[str, DataFrame]:
    """Upcoming, today's and the rest of the week's events, the first three and the first of all."""
    coming = displayed(upcoming(star, today))
    return {"upcoming": coming, "today": displayed(in_window(star, "today", today)), "week": displayed(not_on(in_window(star, "week", today), today)), "top": coming.limit(3), "featured": coming.limit(1)}


def venue_page(star: DataFrame, slug: str, today: date) -> DataFrame:
    return displayed(upcoming(at_venue(star, slug), today))


def event_page(star: DataFrame, venues: DataFrame, slug: str) -> DataFrame:
    """The event with its venue; no row if either is missing."""
    v = venues.select(F.col("slug").alias("venue_slug"), F.struct(*venues.columns).alias("venue"))
    return star.filter(F.col("slug") == slug).join(v, "venue_slug").limit(1)
