"""Reviews on the versioned store: drafts, resolutions and rejections as batches that commit whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.operators import reviews
from marquee.store.place import written
from marquee.store.versioned import Kind, Store, Transaction, transact

TABLES = {
    "groups": Kind(("id",), "id"),
    "candidates": Kind(("group_id", "id"), "group_id"),
    "choices": Kind(("group_id", "field"), "group_id"),
    "venues": Kind(("slug",), "slug"),
    "sources": Kind(("name", "url"), "name", numbered=True),
    "events": Kind(("slug",), "slug", numbered=True),
}


def open_desk(spark: SparkSession, root: str, buckets: int = 64) -> Store:
    return Store(spark, root, TABLES, buckets)


def _closed(groups: DataFrame, ids: DataFrame, now: Column, status: str | None) -> DataFrame:
    """The rows of ``groups`` in ``ids`` (group_id), touched and, with a status, closed."""
    hit = groups.join(ids.withColumnRenamed("group_id", "id"), "id", "left_semi")
    return hit.withColumns({"updated_at": now} | ({"status": F.lit(status)} if status else {}))


def _chosen(good: DataFrame, now: Column) -> DataFrame:
    return good.select("group_id", "field", "candidate_id", "value", now.alias("updated_at"))


def _batch(store: Store, wanted: DataFrame, work: Callable[[Transaction, DataFrame], tuple[DataFrame, dict[str, DataFrame]]], tries: int) -> DataFrame:
    outcomes: list[DataFrame] = []

    def run(transaction: Transaction) -> dict[str, DataFrame]:
        outcome, changes = work(transaction, wanted)
        outcomes.append(written(outcome, "outcome"))
        return changes

    transact(store, run, tries)
    return outcomes[-1]


def drafting(transaction: Transaction, wanted: DataFrame, now: Column) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The outcome of a draft (group_id, error), and the rows that it changes."""
    ids = wanted.select("group_id")
    groups = transaction.rows("groups", ids)
    good, fine, outcome = reviews.drafted(groups, transaction.rows("candidates", ids), wanted)
    good = written(good, "draft")
    return outcome, {"choices": _chosen(good, now), "groups": _closed(groups, fine, now, None)}


def resolving(transaction: Transaction, wanted: DataFrame, now: Column) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The outcome of a resolution (group_id, slug, error), and the rows that it changes: choices, groups
    and the catalogue. Reads the buckets of its groups and, of the catalogue, those of its slugs and names."""
    ids = wanted.select("group_id")
    groups = transaction.rows("groups", ids)
    checked = reviews.checked_choices(wanted, groups, transaction.rows("candidates", ids))
    resolved = written(reviews.resolved_events(checked, groups, now), "resolved")
    venues = transaction.rows("venues", resolved.select("venue_slug"))
    events = written(reviews.publishable(resolved, venues), "events")
    near = reviews.Store(groups, groups, venues, transaction.rows("sources", events.select("source_name")), transaction.rows("events", events.select("slug")))
    made, placed = reviews.placed_events(near, events, transaction.top("sources"), transaction.top("events"))
    outcome = events.select("group_id", "slug", "error")
    fine = outcome.filter("error is null").select("group_id")
    return outcome, {"sources": made, "events": placed, "choices": _chosen(checked.join(fine, "group_id", "left_semi"), now), "groups": _closed(groups, fine, now, "resolved")}


def rejecting(transaction: Transaction, wanted: DataFrame, now: Column) -> tuple[DataFrame, dict[str, DataFrame]]:
    groups = transaction.rows("groups", wanted.select("group_id"))
    outcome = reviews.closings(groups, wanted.select("group_id").distinct(), "rejected")
    return outcome, {"groups": _closed(groups, outcome.filter("error is null").select("group_id"), now, "rejected")}


def save_draft(store: Store, wanted: DataFrame, now: Column, tries: int = 5) -> DataFrame:
    """Saves the choices ``wanted`` (group_id, field, candidate_id) as one version; group_id and error of
    each group asked for. A group takes all of its choices or, if any is in error, none."""
    return _batch(store, wanted, lambda t, w: drafting(t, w, now), tries)


def resolve(store: Store, wanted: DataFrame, now: Column, tries: int = 5) -> DataFrame:
    """Resolves groups by the choices ``wanted`` as one version: each is closed, with its choices, and its event
    stands in the catalogue, or none of this. group_id, slug and error of each group asked for. If another
    batch was first, groups that it closed are in error."""
    return _batch(store, wanted, lambda t, w: resolving(t, w, now), tries)


def reject(store: Store, wanted: DataFrame, now: Column, tries: int = 5) -> DataFrame:
    """Closes the groups ``wanted`` (group_id) as rejected; group_id, status and error of each."""
    return _batch(store, wanted, lambda t, w: rejecting(t, w, now), tries)


def restore_choices(store: Store, wanted: DataFrame, version: int, tries: int = 5) -> int:
    """Gives the groups ``wanted`` (group_id) the choices that they had at an earlier version, as a version of
    its own, whose number it returns; choices that they had not yet are deleted."""

    def run(transaction: Transaction) -> dict[str, DataFrame]:
        now = transaction.rows("choices", wanted).join(wanted, "group_id", "left_semi")
        buckets = sorted(transaction.read["choices"])
        then = store.rows("choices", store.manifest(version), buckets).join(wanted, "group_id", "left_semi")
        new = now.join(then, ["group_id", "field"], "left_anti").withColumn("_deleted", F.lit(True))
        return {"choices": then.withColumn("_deleted", F.lit(False)).unionByName(new)}

    return transact(store, run, tries)
