"""Conversations rebuilt from quotations.

The leading ``>`` marks of a line give its quote level; consecutive lines of a level are a passage.
Passages, their lines and their sentences are normalised (marks off, white space collapsed, lower
case) and hashed; those that messages say themselves are the originals, so a quotation of a part of
a passage is found as well. A reply's parent is the message that its outermost quotation with an
original is from: the latest earlier one in its conversation, or else the first in any other. A
message follows the root of its chain of parents, and what is left of it after the quotes is what it
says. A text is parsed line by line in one task, in time that grows with its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marquee.llm.common import batch, discard, materialize, materialized, tidy

_MARKS = re.compile(r"[ \t]{0,3}(?:>[ \t]?)+")
_LINE_END = re.compile(r"\r\n|\r|\n")
#: The end of a line that introduces a quotation, right before it or before blank lines ahead of it.
_LEAD = re.compile(r"\b(?:wrote|writes|said|schrieb|a écrit|escribió)\s?:\s*+\Z", re.I)
#: Between sentences.
_SENTENCE = r"(?<=[.!?][\"')\]]{0,3})\s+|(?<=[。！？])"
#: Turns that one group of a window has at most; a conversation's or thread's later turns are others.
TURNS_PER_GROUP = 1024


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """(what the message says itself, its passages as (level, text)). Lines of one level without a
    blank line between are a passage; a line that introduces a quote is not said."""
    lines = []
    for line in _LINE_END.split(text or ""):
        m = _MARKS.match(line)
        lines.append((m[0].count(">"), line[m.end() :]) if m else (0, line))
    # The level of the next line that is not blank.
    following, ahead = [0] * len(lines), -1
    for k in range(len(lines) - 1, -1, -1):
        following[k] = ahead
        if lines[k][1].strip():
            ahead = lines[k][0]
    said, found, level_open = [], [], -1
    for k, (level, line) in enumerate(lines):
        lead = following[k] > level and _LEAD.search(line)
        if level == 0 and not lead:
            said.append(line)
        if not line.strip() or lead:
            level_open = -1
        elif level == level_open:
            found[-1][1].append(line)
        else:
            found.append((level, [line]))
            level_open = level
    return re.sub(r"\n{3,}", "\n\n", "\n".join(said)).strip(), [(level, "\n".join(x)) for level, x in found]


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, content and passages (array of level and text) of each message."""
    passage = pa.struct([("level", pa.int32()), ("text", pa.string())])
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("content", pa.string()), ("passages", pa.list_(passage))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [parse(t) for t in b.column(3).to_pylist()]
            yield batch(schema, [b.column(0), b.column(1), b.column(2).cast(pa.string()), [c for c, _ in rows], [[{"level": level, "text": x} for level, x in p] for _, p in rows]])

    columns = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), "text")
    return columns.mapInArrow(tidy(run), "conv_id long, turn long, role string, content string, passages array<struct<level: int, text: string>>")


def normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " ")))


def latest_before(quoted: DataFrame, own: DataFrame) -> DataFrame:
    """conv_id, hash, said, turn and near (the latest turn below it that says the same in its
    conversation, where there is one) of each of ``quoted``.

    A running maximum over both kinds of rows, in groups of TURNS_PER_GROUP turns, and one over the
    groups: no pairs are formed, and a passage that a long conversation repeats is many groups.
    """
    keys = ["conv_id", "hash", "said"]
    group = F.floor(F.col("turn") / TURNS_PER_GROUP).alias("group")
    asked = quoted.select(*keys, "turn").distinct().select(*keys, "turn", group, F.lit(None).cast("long").alias("from_turn"))
    both = asked.unionByName(own.select(*keys, "turn", group, F.col("turn").alias("from_turn")))
    running = Window.partitionBy(*keys, "group").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    here = both.withColumn("inner", F.max("from_turn").over(running)).filter("from_turn is null")
    ends = own.groupBy(*keys, group).agg(F.max("turn").alias("end"))
    places = ends.unionByName(here.filter("inner is null").select(*keys, "group", F.lit(None).cast("long").alias("end")).distinct())
    earlier = Window.partitionBy(*keys).orderBy("group").rangeBetween(Window.unboundedPreceding, -1)
    outer = places.withColumn("before", F.max("end").over(earlier)).groupBy(*keys, "group").agg(F.max("before").alias("before"))
    found = here.join(outer, [*keys, "group"], "left").select(*keys, "turn", F.coalesce("inner", "before").alias("near"))
    return found.filter("near is not null")


def quotation_links(messages: DataFrame) -> DataFrame:
    """conv_id, turn, parent_conv, parent_turn of each message of parsed() with a quotation that is found.

    Quoted passages of all levels, and their lines and sentences, are looked up. Of those found, the
    lowest level counts, in it whole passages before parts, then the first in the text; parts that
    only another conversation has come last. Originals are aggregated by hash before the join: for a
    passage that very many messages hold, one row for each conversation and hash, and one with the
    first two conversations for each hash, as one of them is not the reply's own.
    """
    text = F.col("p.text")
    units = F.array_distinct(F.transform(F.concat(F.array(text), F.split(text, "\n"), F.split(text, _SENTENCE)), normal))
    cut = messages.select("conv_id", "turn", F.posexplode("passages").alias("at", "p")).select("conv_id", "turn", "at", F.col("p.level").alias("level"), F.posexplode(units).alias("place", "said"))
    cut = cut.filter("said != ''").withColumn("hash", F.xxhash64("said"))
    quoted = materialize(cut.filter("level > 0"), "quotes")
    wanted = quoted.select("hash", "said").distinct()
    own = materialize(cut.filter("level = 0").join(wanted, ["hash", "said"], "left_semi").select("conv_id", "turn", "hash", "said").distinct(), "originals")
    by_conv = own.groupBy("hash", "said", "conv_id").agg(F.min("turn").alias("turn"))
    order = Window.partitionBy("hash", "said").orderBy("conv_id")
    two = by_conv.withColumn("r", F.row_number().over(order)).filter("r <= 2").select("hash", "said", F.struct("conv_id", "turn").alias("m"))
    firsts = two.groupBy("hash", "said").agg(F.min("m").alias("first"), F.max("m").alias("second"))
    here = latest_before(quoted, own)
    other = F.when(F.col("first.conv_id") != F.col("conv_id"), F.col("first")).when(F.col("second.conv_id") != F.col("conv_id"), F.col("second"))
    parent = F.when(F.col("near").isNotNull(), F.struct("conv_id", F.col("near").alias("turn"))).otherwise(other)
    every = quoted.join(firsts, ["hash", "said"]).join(here, ["conv_id", "turn", "hash", "said"], "left").withColumn("parent", parent).filter("parent is not null")
    part = F.col("place") > 0
    rank = F.struct((part & F.col("near").isNull()).alias("far"), "level", part.alias("part"), "at", "place", "parent")
    chosen = every.groupBy("conv_id", "turn").agg(F.min(rank).alias("c"))
    return chosen.select("conv_id", "turn", F.col("c.parent.conv_id").alias("parent_conv"), F.col("c.parent.turn").alias("parent_turn"))


def thread_roots(links: DataFrame) -> DataFrame:
    """conv_id, turn, root_turn, depth of messages with a parent in their conversation, by pointer
    jumping: a round doubles how far each message sees."""
    last = at = materialize(links.filter("parent_conv = conv_id").select("conv_id", "turn", F.col("parent_turn").alias("root_turn"), F.lit(1).alias("depth")), "threads")
    while True:
        up = at.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("above"), F.col("depth").alias("more"))
        seen = at.join(up, ["conv_id", "root_turn"], "left")
        new = seen.select("conv_id", "turn", F.coalesce("above", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("above").isNotNull().alias("moved"))
        new = materialize(new, "threads")
        discard(last)
        last, at = new, new.drop("moved")
        if new.filter("moved").isEmpty():
            return at


def reply_order(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, content, quoted (passages), parent_conv, parent_turn, root_turn, depth
    and position of every message.

    position orders a conversation by the turn of the thread's root, then by turn, so that each
    reply comes after what it answers. Null and empty texts have empty content and no quotes. Rows
    that repeat a conv_id and turn count as one message if they are equal, and otherwise share
    their links, ordered by role and content; rows with a null conv_id or turn are not linked.
    Quotes that are found nowhere are dropped from the content like the others.
    """
    rows = materialize(parsed(messages.select("conv_id", "turn", "role", "text").distinct()), "messages")
    whole = rows.filter("conv_id is not null and turn is not null")
    links = materialized(lambda: quotation_links(whole).distinct(), "quote-links")
    roots = thread_roots(links)
    said = rows.select("conv_id", "turn", "role", "content", F.transform(F.filter("passages", lambda p: p["level"] > 0), lambda p: p["text"]).alias("quoted"))
    joined = said.join(links, ["conv_id", "turn"], "left").join(roots, ["conv_id", "turn"], "left")
    joined = joined.withColumn("root_turn", F.coalesce("root_turn", "turn")).withColumn("depth", F.coalesce("depth", F.lit(0)))
    roots_of, turns_of = (F.floor(F.col(c) / TURNS_PER_GROUP) for c in ("root_turn", "turn"))
    placed = materialize(joined.withColumn("roots", roots_of).withColumn("turns", turns_of), "replies")
    # Three counts, none over one long group: rows before the group of roots, before the group of turns
    # of the same root in it, and before the row there.
    local = Window.partitionBy("conv_id", "root_turn", "turns").orderBy("turn", "role", "content")
    fine = placed.groupBy("conv_id", "roots", "root_turn", "turns").agg(F.count("*").alias("n"))
    within = Window.partitionBy("conv_id", "roots").orderBy("root_turn", "turns").rowsBetween(Window.unboundedPreceding, -1)
    fine = fine.withColumn("inner", F.coalesce(F.sum("n").over(within), F.lit(0)))
    over = Window.partitionBy("conv_id").orderBy("roots").rowsBetween(Window.unboundedPreceding, -1)
    coarse = placed.groupBy("conv_id", "roots").agg(F.count("*").alias("n")).withColumn("outer", F.coalesce(F.sum("n").over(over), F.lit(0)))
    ranked = placed.withColumn("local", F.row_number().over(local) - 1)

    fine = fine.select(F.col("conv_id").alias("_conv"), F.col("root_turn").alias("_root"), F.col("turns").alias("_turns"), "inner")
    coarse = coarse.select(F.col("conv_id").alias("_own"), F.col("roots").alias("_roots"), "outer")
    same = lambda **names: [F.col(a).eqNullSafe(F.col(b)) for a, b in names.items()]
    out = ranked.join(fine, same(conv_id="_conv", root_turn="_root", turns="_turns")).join(coarse, same(conv_id="_own", roots="_roots"))
    columns = ("conv_id", "turn", "role", "content", "quoted", "parent_conv", "parent_turn", "root_turn", "depth")
    return out.select(*columns, (F.col("outer") + F.col("inner") + F.col("local")).alias("position"))


def chat_lines(ordered: DataFrame) -> DataFrame:
    """reply_order()'s rows as chat template lines, one for each message: conv_id, position, line."""
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), "content", F.lit("<|end|>"))
    return ordered.select("conv_id", "position", line.alias("line"))
