"""The bootstrap relation and the registry of sources."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions.time import from_local, rfc3339

VENUE_COLUMNS = ("id", "slug", "name", "address", "neighbourhood", "description", "website", "origin")
# The seed venues, events and sources.
VENUES = [
    (1, "leadmill", "The Leadmill", "6 Leadmill Road, Sheffield", "City Centre", "A long-running Sheffield venue for touring bands and club nights.", "https://leadmill.co.uk/events/live-music/", "seed"),
    (2, "yellow-arch", "Yellow Arch Studios", "30-36 Burton Road, Sheffield", "Neepsend", "A studio and venue space for live shows, club nights, and independent promoters.", "https://www.yellowarch.com/events/", "seed"),
    (3, "sidney-and-matilda", "Sidney & Matilda", "Rivelin Works, 46 Sidney Street, Sheffield", "Cultural Industries Quarter", "A venue and gallery space with mixed bills, DJs, and late-night shows.", "https://www.sidneyandmatilda.com/", "seed"),
]
SOURCES = [
    (1, "The Leadmill live music listings", "https://leadmill.co.uk/events/live-music/"),
    (2, "Yellow Arch what's on", "https://www.yellowarch.com/events/"),
    (3, "Sidney & Matilda listings", "https://www.sidneyandmatilda.com/"),
]
EVENTS = [
    (1, "matinee-noise-at-the-leadmill", 1, 1, "Matinee Noise", datetime(2026, 5, 8, 19, 30), datetime(2026, 5, 8, 23, 0), "Indie / alt", "A Friday bill with local support and a touring headliner."),
    (2, "neepsend-afterhours", 2, 2, "Abbeydale Afterhours", datetime(2026, 5, 14, 20, 0), datetime(2026, 5, 14, 23, 30), "Jazz / soul", "A midweek set with keys, brass, and soul."),
    (3, "courtyard-wildcards", 3, 3, "Courtyard Wildcards", datetime(2026, 5, 22, 18, 45), datetime(2026, 5, 22, 22, 45), "Punk / garage", "A garage and punk double bill."),
    (4, "leadmill-late-room", 1, 1, "Late Room", datetime(2026, 6, 5, 22, 0), datetime(2026, 6, 6, 1, 0), "DJ / club", "A late-room dance set."),
]
CHECKED = datetime(2026, 4, 19, 10, 0)
# The sources that runs read.
REGISTRY = [
    {"key": "sidney-and-matilda", "name": "Sidney & Matilda listings", "url": "https://www.sidneyandmatilda.com/", "page_mode": "linked_ics", "staged_as": "Sidney & Matilda manual ingest", "calendar_name": "Sidney & Matilda Google Calendar ICS", "run_notes": "manual Sidney & Matilda snapshot + ICS parse report"},
    {"key": "yellow-arch", "name": "Yellow Arch listings", "url": "https://www.yellowarch.com/events/", "page_mode": "source_page", "staged_as": "Yellow Arch manual ingest", "calendar_name": "", "run_notes": "manual Yellow Arch source-page parse report"},
]


def venues(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(VENUES, "id long, slug string, name string, address string, neighbourhood string, description string, website string, origin string")


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SOURCES, "id long, name string, url string")


def events(spark: SparkSession) -> DataFrame:
    """Seed events, their local times as UTC text."""
    e = spark.createDataFrame([(*row, CHECKED) for row in EVENTS], "id long, slug string, venue_id long, source_id long, name string, start_at timestamp_ntz, end_at timestamp_ntz, genre string, description string, last_checked_at timestamp_ntz")
    for c in ("start_at", "end_at", "last_checked_at"):
        e = e.withColumn(c, rfc3339(from_local(F.col(c).cast("timestamp"))))
    return e.withColumn("status", F.lit("Listed")).withColumn("origin", F.lit("seed"))


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(r.values()) for r in REGISTRY], ", ".join(f"{k} string" for k in REGISTRY[0]))


def staged_names(spark: SparkSession) -> DataFrame:
    """source and staged_as: what review groups of a source are named after. Blank is the first source."""
    r = registry(spark)
    return r.select(F.col("key").alias("source"), "staged_as").unionByName(r.filter(F.col("key") == REGISTRY[0]["key"]).select(F.lit("").alias("source"), "staged_as"))


def bootstrapped(venues_now: DataFrame, events_now: DataFrame, sources_now: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables, with the seed in them if there is neither a venue nor an event."""
    spark = venues_now.sparkSession
    if not venues_now.isEmpty() or not events_now.isEmpty():
        return venues_now, events_now, sources_now
    return venues(spark), events(spark), sources(spark)


def configured(wanted: DataFrame, configs: DataFrame) -> DataFrame:
    """``wanted`` (key and others) with the config of its source: a blank or null key is the first's, an unknown
    one an error. Columns of ``configs`` have a source_ ahead."""
    c = configs.select(*(F.col(x).alias(f"source_{x}") for x in configs.columns))
    key = F.trim(F.coalesce("key", F.lit("")))
    named = wanted.withColumn("_key", F.when(key == "", REGISTRY[0]["key"]).otherwise(key))
    joined = named.join(c, F.col("_key") == F.col("source_key"), "left").drop("_key")
    return joined.withColumn("error", F.when(F.col("source_key").isNull(), F.concat(F.lit("unsupported source "), "key")))


def source_config(key: str) -> dict[str, str]:
    """The source of a key; blank is the first, an unknown key an error."""
    wanted = key.strip() or REGISTRY[0]["key"]
    for row in REGISTRY:
        if row["key"] == wanted:
            return row
    raise LookupError(f"unsupported source {key!r}")
