"""Review groups: listings, detail, choices, resolution and publishing, over append logs."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.text import field_label, first_non_empty, origin_run_id, slug, trim
from marquee.functions.time import parse_rfc3339, rfc3339
from marquee.operators.catalog import latest, new_sources, with_ids
from marquee.operators.runs import positive

#: The canonical fields, in order.
FIELDS = ("name", "venue_slug", "start_at", "end_at", "genre", "status", "description", "source_name", "source_url")
CLOSED = ("resolved", "rejected")


def with_counts(groups: DataFrame, candidates: DataFrame, choices: DataFrame) -> DataFrame:
    """Each child is counted before the join, so the counts don't multiply."""
    c = candidates.groupBy("group_id").agg(F.count("*").alias("candidate_count"))
    d = choices.groupBy("group_id").agg(F.count_distinct("field").alias("draft_count"))
    joined = groups.join(c, groups["id"] == c["group_id"], "left").drop("group_id").join(d, groups["id"] == d["group_id"], "left").drop("group_id")
    return joined.fillna(0, ["candidate_count", "draft_count"])


def open_groups(groups: DataFrame, candidates: DataFrame, choices: DataFrame) -> DataFrame:
    return with_counts(groups.filter("status = 'open'"), candidates, choices).orderBy(F.desc("updated_at"), F.desc("id"))


def closed_groups(groups: DataFrame, candidates: DataFrame, choices: DataFrame, limit: int) -> DataFrame:
    found = with_counts(groups.filter(F.col("status").isin(*CLOSED)), candidates, choices)
    return found.orderBy(F.desc("updated_at"), F.desc("id")).limit(positive(limit)).withColumn("origin_run_id", origin_run_id(F.col("notes")))


def names_run(notes: Column, run_id: Column) -> Column:
    """Whether notes name the run, both as text in any case and as the id that they parse to."""
    text = run_id.cast("string")
    like = F.lower(notes).contains(F.concat(F.lit("import run "), text)) | F.lower(notes).contains(F.concat(F.lit("manual ingest run "), text))
    return like & (origin_run_id(notes) == run_id)


def groups_for_run(groups: DataFrame, candidates: DataFrame, choices: DataFrame, run_id: int) -> DataFrame:
    found = groups.filter(F.col("status").isin("open", *CLOSED) & names_run(F.col("notes"), F.lit(run_id)))
    return with_counts(found, candidates, choices).orderBy(F.desc("updated_at"), F.desc("id"))


def status_rank(status: Column) -> Column:
    return F.when(status == "open", 0).when(status == "resolved", 1).when(status == "rejected", 2).otherwise(3)


def status_summary(runs: DataFrame, groups: DataFrame) -> DataFrame:
    """``runs`` with summary: how many of their groups have each status, or none."""
    run = origin_run_id(F.col("notes"))
    own = groups.withColumn("run_id", run).filter(names_run(F.col("notes"), F.col("run_id")))
    status = F.when(trim(F.col("status")) == "", "unknown").otherwise(trim(F.col("status")))
    per = status_text(own.groupBy("run_id", status.alias("status")).agg(F.count("*").alias("n")))
    return runs.join(per, runs["id"] == per["run_id"], "left").drop("run_id").fillna("none", ["summary"])


def status_text(counts: DataFrame) -> DataFrame:
    """run_id and summary of counts (run_id, status, n)."""
    item = F.struct(status_rank(F.col("status")).alias("rank"), "status", "n")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.concat_ws(" ", x["n"].cast("string"), x["status"])), ", ")
    return counts.groupBy("run_id").agg(text.alias("summary"))


def unpivoted(candidates: DataFrame) -> DataFrame:
    """A row for each candidate and canonical field: group_id, id, position, ordinal, field, value."""
    fields = F.array(*(F.struct(F.lit(i).alias("ordinal"), F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for i, f in enumerate(FIELDS)))
    return candidates.select("group_id", "id", "position", F.explode(fields).alias("f")).select("group_id", "id", "position", "f.*")


def review_detail(candidates: DataFrame, choices: DataFrame) -> DataFrame:
    """Fields by candidate, with chosen, in order of field and position."""
    d = choices.select("group_id", "field", F.col("candidate_id").alias("id"), F.lit(True).alias("chosen"))
    return unpivoted(candidates).join(d, ["group_id", "field", "id"], "left").fillna(False, ["chosen"]).orderBy("group_id", "ordinal", "position", "id")


def load_group(groups: DataFrame, candidates: DataFrame, choices: DataFrame, group_id: int) -> DataFrame:
    """The group with its candidates (ordered) and its choices by field."""
    own = candidates.filter(F.col("group_id") == group_id)
    first = ["position", "id"]
    rows = own.agg(F.array_sort(F.collect_list(F.struct(*first, *(c for c in own.columns if c not in first)))).alias("candidates"))
    chosen = choices.filter(F.col("group_id") == group_id).agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("candidate_id", "value")))).alias("choices"))
    return groups.filter(F.col("id") == group_id).crossJoin(rows).crossJoin(chosen)


def numbered(candidates: DataFrame, groups: DataFrame) -> DataFrame:
    """Candidates (group_id, ordinal and fields), trimmed, with a 1-based position, their blank source
    taken from the group; error where the name is blank."""
    g = groups.select(F.col("id").alias("group_id"), F.col("source_name").alias("_name"), F.col("source_url").alias("_url"))
    joined = candidates.join(g, "group_id").withColumn("position", F.col("ordinal") + 1)
    own = {"source_name": "_name", "source_url": "_url"}
    texts = [c for c in ("external_id", *FIELDS, "provenance") if c in candidates.columns]
    joined = joined.withColumns({c: F.coalesce(F.nullif(trim(F.col(c)), F.lit("")), own[c]) if c in own else trim(F.col(c)) for c in texts})
    return joined.withColumn("error", F.when(F.col("name") == "", "blank name")).drop("_name", "_url")


def checked_choices(wanted: DataFrame, groups: DataFrame, candidates: DataFrame) -> DataFrame:
    """``wanted`` (group_id, field, candidate_id) with the candidate's value, and error."""
    values = unpivoted(candidates).select("group_id", F.col("id").alias("candidate_id"), "field", "value")
    state = groups.select(F.col("id").alias("group_id"), F.col("status").alias("_status"))
    joined = wanted.join(state, "group_id", "left").join(values, ["group_id", "candidate_id", "field"], "left")
    error = F.when(F.col("_status").isNull(), "no such group").when(F.col("_status") != "open", "group is closed").when(~F.col("field").isin(*FIELDS), "unknown field").when(F.col("value").isNull(), "candidate is not in the group")
    return joined.withColumn("error", error).drop("_status")


def resolved_events(checked: DataFrame, groups: DataFrame, now: Column) -> DataFrame:
    """One event for each group whose choices have all fields, each once, and no error; else error."""
    agg = [F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in FIELDS]
    wide = checked.groupBy("group_id").agg(F.count("*").alias("n"), F.count_distinct("field").alias("fields"), F.max("error").alias("choice_error"), *agg)
    g = groups.select(F.col("id").alias("group_id"), F.col("source_name").alias("_name"), F.col("source_url").alias("_url"))
    w = wide.join(g, "group_id", "left")
    w = w.withColumns({f: trim(F.coalesce(f, F.lit(""))) for f in FIELDS})
    w = w.withColumns({"source_name": first_non_empty(F.col("source_name"), F.col("_name")), "source_url": first_non_empty(F.col("source_url"), F.col("_url"))})
    start, end = parse_rfc3339(F.col("start_at")), parse_rfc3339(F.col("end_at"))
    needed = (*FIELDS[:4], "source_name", "source_url")
    missing = F.array_join(F.filter(F.array(*(F.when(F.col(f) == "", F.lit(f)) for f in needed)), lambda x: x.isNotNull()), ", ")
    error = (
        F.when((F.col("n") != len(FIELDS)) | (F.col("fields") != len(FIELDS)), "not every field once")
        .when(F.col("choice_error").isNotNull(), F.col("choice_error"))
        .when(missing != "", F.concat(F.lit("missing "), missing))
        .when(start.isNull() | end.isNull(), "malformed time")
        .when((slug(F.col("name")) == "") | (slug(F.col("venue_slug")) == ""), "no slug")
    )
    out = w.select("group_id", "name", "venue_slug", start.alias("start_at"), end.alias("end_at"), "genre", "status", "description", "source_name", "source_url", F.lit("live").alias("origin"), now.alias("last_checked_at"), error.alias("error"))
    return out.withColumn("slug", live_slug(F.col("name"), F.col("venue_slug"), F.col("start_at")))


class Store(NamedTuple):
    """groups (id, status, updated_at, ...), choices (group_id, field, candidate_id, value,
    updated_at), venues (id, slug), sources (id, name, url) and events (id, slug, venue_id,
    source_id, ...), as they are after the operations so far."""

    groups: DataFrame
    choices: DataFrame
    venues: DataFrame
    sources: DataFrame
    events: DataFrame


def _upserted_choices(choices: DataFrame, good: DataFrame, now: Column) -> DataFrame:
    """Of choices for a field of a group, the new one counts."""
    new = good.select("group_id", "field", "candidate_id", "value", now.alias("updated_at"))
    own = choices.select("group_id", "field", "candidate_id", "value", "updated_at")
    log = own.withColumn("_version", F.lit(0)).unionByName(new.withColumn("_version", F.lit(1)))
    return latest(log, ["group_id", "field"], "_version").drop("_version")


def _touched(groups: DataFrame, ids: DataFrame, now: Column, status: str | None = None) -> DataFrame:
    """``groups`` with updated_at, and status if given, of those in ``ids`` (group_id)."""
    hit = ids.select(F.col("group_id").alias("id"), F.lit(True).alias("_hit"))
    new = {"updated_at": now} | ({"status": F.lit(status)} if status else {})
    joined = groups.join(hit, "id", "left")
    return joined.select(*(F.when(F.col("_hit"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in groups.columns))


def save_draft(store: Store, candidates: DataFrame, wanted: DataFrame, now: Column) -> tuple[Store, DataFrame]:
    """The store with the choices ``wanted`` (group_id, field, candidate_id), and group_id and error of
    each group asked for. A group takes all of its choices or, if any is in error, none."""
    good, fine, outcome = drafted(store.groups, candidates, wanted)
    return store._replace(choices=_upserted_choices(store.choices, good, now), groups=_touched(store.groups, fine, now)), outcome


def drafted(groups: DataFrame, candidates: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The choices that save_draft() saves, the groups (group_id) that take them, and its outcome."""
    checked = checked_choices(wanted, groups, candidates)
    outcome = checked.groupBy("group_id").agg(F.max("error").alias("error"))
    fine = outcome.filter("error is null").select("group_id")
    return checked.join(fine, "group_id", "left_semi").dropDuplicates(["group_id", "field"]), fine, outcome


def resolve(store: Store, candidates: DataFrame, wanted: DataFrame, now: Column) -> tuple[Store, DataFrame]:
    """The store with the events of the groups that ``wanted`` (group_id, field, candidate_id) resolves,
    and group_id, slug and error of each group asked for.

    A group is resolved whole or not at all: its choices are saved, its event goes in under its slug (in
    place of the one that has it) with its venue and source, which is made where it is missing, and
    the group is closed. Of two groups with one slug, the one with the larger id counts.
    """
    checked = checked_choices(wanted, store.groups, candidates)
    events = publishable(resolved_events(checked, store.groups, now), store.venues)
    outcome = events.select("group_id", "slug", "error")
    made, placed = placed_events(store, events, store.sources, store.events)
    kept = store.events.join(placed.select("slug"), "slug", "left_anti")
    fine = outcome.filter("error is null").select("group_id")
    choices = _upserted_choices(store.choices, checked.join(fine, "group_id", "left_semi"), now)
    sources = store.sources.unionByName(made.select(store.sources.columns))
    events_now = kept.select(*store.events.columns).unionByName(placed)
    return store._replace(groups=_touched(store.groups, fine, now, "resolved"), choices=choices, sources=sources, events=events_now), outcome


def placed_events(store: Store, events: DataFrame, source_ids: DataFrame, event_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sources that the good ones of publishable() ``events`` make, and the rows that these are in the
    catalogue. Of the store only rows with their slugs, and sources with their names, are needed; new ids go on
    from those of ``source_ids`` and ``event_ids``."""
    good = events.filter("error is null")
    made = new_sources(store.sources, good.select(F.col("source_name").alias("name"), F.col("source_url").alias("url")), source_ids)
    sources = store.sources.select("id", "name", "url").unionByName(made.select("id", "name", "url"))
    ids = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.col("url").alias("source_url"))
    rows = latest(good.drop("error"), ["slug"], "group_id").join(ids, ["source_name", "source_url"])
    own = store.events.select("slug", F.col("id").alias("_id"))
    placed = rows.join(own, "slug", "left").withColumns({c: rfc3339(F.col(c)) for c in ("start_at", "end_at")})
    columns = [c for c in store.events.columns if c != "id"]
    have = [F.col(c) if c in placed.columns else F.lit(None).alias(c) for c in columns]
    old = placed.filter("_id is not null").select(F.col("_id").alias("id"), *have)
    new = with_ids(placed.filter("_id is null").select(*have), event_ids)
    return made, old.unionByName(new.select("id", *columns)).select(*store.events.columns)


def candidate_label(position: Column, external_id: Column) -> Column:
    own = F.when(F.coalesce(external_id, F.lit("")) != "", F.concat(F.lit(" ("), external_id, F.lit(")"))).otherwise("")
    return F.concat(F.lit("Candidate "), position.cast("string"), own)


def review_summary(candidates: DataFrame, choices: DataFrame) -> DataFrame:
    """part, group_id, ordinal, label, value and candidate of what a review shows beside its fields:
    canonical (each field of a duplicate, chosen or not), preview (the chosen fields) and single (the
    fields of a lone candidate). choices: group_id, field, candidate_id, value."""
    size = candidates.groupBy("group_id").agg(F.count("*").alias("n"))
    fields = F.array(*(F.struct(F.lit(i).alias("ordinal"), F.lit(f).alias("field")) for i, f in enumerate(FIELDS)))
    each = size.select("group_id", "n", F.explode(fields).alias("f")).select("group_id", "n", "f.*")
    who = candidates.select("group_id", F.col("id").alias("candidate_id"), candidate_label(F.col("position"), F.col("external_id")).alias("candidate"))
    told = choices.select("group_id", "field", "candidate_id", "value").join(who, ["group_id", "candidate_id"], "left").withColumn("candidate", F.coalesce("candidate", F.lit("Unknown candidate")))
    rows = each.join(told, ["group_id", "field"], "left").withColumn("label", field_label(F.col("field")))
    columns = ("group_id", "ordinal", "label", "value", "candidate")
    canonical = rows.filter("n > 1").select(F.lit("canonical").alias("part"), *columns)
    preview = rows.filter("candidate_id is not null").select(F.lit("preview").alias("part"), *columns)
    lone = unpivoted(candidates).join(size.filter("n = 1"), "group_id")
    single = lone.select(F.lit("single").alias("part"), "group_id", "ordinal", field_label(F.col("field")).alias("label"), "value", F.lit(None).cast("string").alias("candidate"))
    return canonical.unionByName(preview).unionByName(single)


def live_slug(name: Column, venue: Column, start: Column) -> Column:
    return F.concat_ws("-", F.lit("live"), slug(name), slug(venue), F.date_format(start, "yyyyMMddHHmmss"))


def publishable(events: DataFrame, venues: DataFrame) -> DataFrame:
    """Events with their venue's id; error where there is no such venue."""
    v = venues.select(F.col("slug").alias("venue_slug"), F.col("id").alias("venue_id"))
    joined = events.join(v, "venue_slug", "left")
    return joined.withColumn("error", F.coalesce("error", F.when(F.col("venue_id").isNull(), "no such venue")))


def closings(groups: DataFrame, group_ids: DataFrame, status: str) -> DataFrame:
    """Log rows that close open groups; error where a group is unknown or closed."""
    joined = group_ids.join(groups.select(F.col("id").alias("group_id"), F.col("status").alias("_status")), "group_id", "left")
    error = F.when(F.col("_status").isNull(), "no such group").when(F.col("_status") != "open", "group is closed")
    return joined.select("group_id", F.lit(status).alias("status"), error.alias("error"))
