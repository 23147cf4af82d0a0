"""A manifest of a dataset as a Merkle tree, and proofs that single rows belong to it.

Every row is a leaf. The leaves of a source, by doc_id, form a tree of fan-out 16; the roots of the
sources, by source, form the top tree in the same way. Only the digests of rows are hashed in SQL; the
trees are built and read by supersteps over RDDs, as Pregel does:

Upwards, a vertex that has its digest sends it to its parent. A parent that has messages of all its
children hashes them, is complete, and is a sender of the next superstep; one that lacks some waits. A
source's root sends to the top tree, so small sources wait there for large ones.

Downwards, a complete vertex hands each child the siblings of that child and the path that it was handed
itself, a superstep for each level of the top tree and then of the sources' trees, until each block of 16
leaves has its path. There rows are verified: a leaf, folded with its siblings, must give the root.

No vertex has over 16 children and no message more than 15 digests a level, so a source that holds a third
of all rows is only a wider tree. The complete vertices of a superstep and the messages that wait are written
to the shared folder and read again: that cuts the lineage, and a lost executor costs one superstep at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import discard, materialize, ranked

FAN_OUT = 16
#: Vertices or messages that a task of a superstep takes, about.
TASK_ROWS = 20_000
#: The tree over the sources; sources' trees are numbered from 0.
TOP = -1

_VERTEX = "tree long, level int, at long, digest string, children array<string>, below array<int>"
_STATE = f"{_VERTEX}, of long, held array<struct<tree: long, level: int, at: long, of: long, slot: int, digest: string, below: int>>"
_PATH = "tree long, level int, at long, root string, subroot string, slots array<int>, siblings array<array<string>>"
_PROOF = "doc_id long, source string, position long, leaf string, found string, subroot string, root string, slots array<int>, siblings array<array<string>>, proof_sha256 string, folded_root string, verified boolean"


def h(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def leaf_digest(text: Column | None = None) -> Column:
    """sha256 of doc_id, source, lang, n_chars and text: `-` for a null, else length in bytes, colon, value."""

    def field(c: Column) -> Column:
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    fields = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.col("text") if text is None else text]
    return F.sha2(F.concat(*map(field, fields)), 256)


def tampered_text() -> Column:
    """The text, in lower case (A-Z alone) where 5 divides the crc32 of the decimal doc_id; under a null id as it is."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, lower).otherwise(F.col("text"))


def leaves(docs: DataFrame, found: Column) -> DataFrame:
    """tree, at, of, source, doc_id, leaf, found: every row with its place in the tree of its source and
    the number of leaves there. ``found`` is the text as it is now, to be verified."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), leaf_digest().alias("leaf"), leaf_digest(found).alias("found"))
    placed = ranked(rows, ["doc_id", "leaf", "found"], by="source", name="leaves").withColumnsRenamed({"position": "at", "size": "of"})
    sources = ranked(placed.groupBy("source").agg(F.count("*").alias("rows")), ["source"], name="sources")
    numbered = sources.select(F.col("source").alias("_source"), F.col("position").alias("tree"), F.col("size").alias("trees"))
    return placed.join(numbered, F.col("source").eqNullSafe(F.col("_source"))).select("tree", "trees", "at", "of", "source", "doc_id", "leaf", "found")


# upwards


def _sent(tree: int, level: int, at: int, of: int, trees: int, digest: str) -> Iterator[tuple]:
    """The message of a vertex, one of ``of`` on its level, to its parent; a source's root sends to the
    top tree, and the root of all to nobody."""
    if of > 1:
        yield tree, level + 1, at // FAN_OUT, of, at % FAN_OUT, digest, level
    elif tree != TOP and trees > 1:
        yield TOP, 1, tree // FAN_OUT, trees, tree % FAN_OUT, digest, level


def _gathered(key: tuple[int, int, int], messages: Iterator[tuple]) -> tuple:
    """A row of _STATE: the vertex if all its children have sent, else their messages, held."""
    got = sorted(messages)
    (tree, level, at), of = key, got[0][3]
    if len(got) < min(FAN_OUT, of - FAN_OUT * at):
        held = [(tree, level, at, of, slot, digest, below) for slot, digest, below, _ in got]
        return None, None, None, None, None, None, None, held
    digests = [m[1] for m in got]
    return tree, level, at, h(digests), digests, [m[2] for m in got], -(-of // FAN_OUT), []


def _tasks(n: int) -> int:
    return max(1, -(-n // TASK_ROWS))


def build(leaf_table: DataFrame) -> list[DataFrame]:
    """The supersteps: tables of complete vertices (tree, level, at, digest, and of each child its digest
    and level) and of held messages. The vertices of sources' trees are complete in the superstep of their
    level. The root of all is the highest vertex of the top tree or, with one source, of its tree; a leaf
    that is alone has no vertex above it. ``leaf_table`` is materialised; an empty one gives none.
    """
    spark = leaf_table.sparkSession
    first, n = leaf_table.select("trees").first(), leaf_table.count()
    trees, steps = first.trees if first else 0, []
    sent = leaf_table.select("tree", "at", "of", "leaf").rdd.flatMap(lambda r: _sent(r[0], 0, r[1], r[2], trees, r[3]))
    while n:
        by_parent = sent.map(lambda m: ((m[0], m[1], m[2]), (m[4], m[5], m[6], m[3]))).groupByKey(_tasks(n))
        steps.append(materialize(spark.createDataFrame(by_parent.map(lambda kv: _gathered(*kv)), _STATE, verifySchema=False), "superstep"))
        n = steps[-1].count()
        sent = steps[-1].rdd.flatMap(lambda v: v[7] or _sent(v[0], v[1], v[2], v[6], trees, v[3]))
    return steps


# downwards


def _handed(vertex: tuple, path: tuple) -> Iterator[tuple]:
    """What a vertex hands to its children: the path that it was handed, with each child's siblings ahead."""
    (tree, level, at, _, children, below), (root, subroot, slots, siblings) = vertex, path
    for slot, (child, child_level) in enumerate(zip(children, below)):
        others = children[:slot] + children[slot + 1 :]
        place = FAN_OUT * at + slot
        if tree == TOP and level == 1:
            yield place, child_level, 0, root, child, [slot, *slots], [others, *siblings]
        else:
            yield tree, child_level, place, root, subroot, [slot, *slots], [others, *siblings]


def paths(steps: list[DataFrame], leaf_table: DataFrame) -> DataFrame:
    """The paths handed to the blocks of 16 leaves (level 1), and to leaves that are alone in their source
    (level 0): tree, level, at, root, subroot, slots and siblings of the levels above, the lowest first."""
    spark = leaf_table.sparkSession
    top = F.col("tree") == TOP
    vertices = [x.filter("tree is not null").drop("of", "held") for x in steps]
    tops = materialize(reduce(DataFrame.unionByName, [v.filter(top) for v in vertices], spark.createDataFrame([], _VERTEX)), "top")
    levels = [(tops.filter(F.col("level") == r.level), top & (F.col("level") == r.level), r.n) for r in tops.groupBy("level").agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect()]
    levels += [(vertices[k - 1].filter(~top), ~top & (F.col("level") == k), vertices[k - 1].count()) for k in range(len(vertices), 1, -1)]
    highest = tops.orderBy(F.desc("level")).limit(1).collect()
    for v in reversed(vertices):
        highest = highest or v.limit(1).collect()
    if highest:
        start = [(r.tree, r.level, r.at, r.digest, None if r.tree == TOP else r.digest, [], []) for r in highest]
    else:
        start = [(r.tree, 0, 0, r.leaf, r.leaf, [], []) for r in leaf_table.limit(1).collect()]
    pending = materialize(spark.createDataFrame(start, _PATH), "paths")
    for level, here, n in levels:
        theirs = level.rdd.map(lambda v: ((v[0], v[1], v[2]), tuple(v)))
        handed = pending.filter(here).rdd.map(lambda p: ((p[0], p[1], p[2]), tuple(p[3:])))
        sent = theirs.cogroup(handed, _tasks(n)).flatMap(lambda kv: (m for v in kv[1][0] for p in kv[1][1] for m in _handed(v, p)))
        before, pending = pending, materialize(spark.createDataFrame(sent, _PATH, verifySchema=False).unionByName(pending.filter(~here)), "paths")
        discard(before)
    return pending


def _verified(key: tuple[int, int, int], group: tuple) -> Iterator[tuple]:
    """The proofs of the leaves of a block."""
    rows, handed = sorted(group[0], key=lambda r: r[0]), list(group[1])
    (root, subroot, slots, above), level = handed[0], key[1]
    digests = [r[3] for r in rows]
    for slot, (at, source, doc_id, leaf, found) in enumerate(rows):
        if level:
            own, siblings = [slot, *slots], [digests[:slot] + digests[slot + 1 :], *above]
        else:
            own, siblings = slots, above
        folded = found
        for s, others in zip(own, siblings):
            folded = h([*others[:s], folded, *others[s:]])
        proof = h([d for others in siblings for d in others])
        yield doc_id, source, at, leaf, found, subroot, root, own, siblings, proof, folded, folded == root


def proofs(docs: DataFrame, found: Column | None = None) -> DataFrame:
    """The proof of every row of ``docs`` (doc_id, text, source, lang, n_chars) and whether it holds for
    ``found``, the text as it is now: by default the text itself.

    doc_id, source, position within the source, leaf, found (the leaf of the present text), subroot, root,
    slots and siblings level by level, proof_sha256, folded_root, verified. Nulls are values of their own:
    a null source is one source and comes first, as a null doc_id does in its source. Rows with one
    doc_id are ordered by their digests, and rows that repeat are leaves each. An empty table gives an
    empty one. Other columns are not read.
    """
    spark = docs.sparkSession
    table = materialize(leaves(docs, F.col("text") if found is None else found), "leaves")
    n = table.count()
    if not n:
        return spark.createDataFrame([], _PROOF)
    handed = paths(build(table), table)
    by_block = table.rdd.map(lambda r: ((r[0], int(r[3] > 1), r[2] // FAN_OUT), (r[2], r[4], r[5], r[6], r[7])))
    to_block = handed.rdd.map(lambda p: ((p[0], p[1], p[2]), tuple(p[3:])))
    return spark.createDataFrame(by_block.cogroup(to_block, _tasks(n)).flatMap(lambda kv: _verified(*kv)), _PROOF, verifySchema=False)
