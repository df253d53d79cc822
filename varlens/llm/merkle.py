"""Merkle dataset manifest by incremental witnesses.

Rows are appended, in order, to one binary tree per group (consecutive pairs of
nodes are hashed; a last one alone is hashed alone, until one node is left),
and the groups' roots, in the order of the groups, to a last tree.  An append
opens a subtree of height 0; two open subtrees of one height close into their
parent, and each then extends the partial witnesses of its leaves by the
other's digest, so a leaf's witness grows as later siblings complete.

Spread over the cluster: rows are ranked within their group by one range
partitioning; aligned blocks of ``BLOCK`` ranks are appended independently; the
block roots are the next round's appends, in blocks again, until every group
has one node.  The rounds are then walked back: a block's rows take their own
witness in the block and then that of the block's root.  No task holds more
than one block, whatever the size of a group, and only digests are shuffled.

Defined results: null values count in a leaf as ``-``; a null group is a group
of its own, before all others; a null id comes before all others in its group;
rows that tie in the order follow their digests, so equal rows are
interchangeable; an empty table has an empty manifest; empty and long texts are
hashed whole; only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varlens.llm.common import stored

#: Rows of a block; a power of two, so that blocks are whole subtrees.
BLOCK = 1024
#: monotonically_increasing_id: the partition is above this bit, the row's place below.
_PART = 33


def leaf(*fields: Column) -> Column:
    """Digest of a row: of each field ``-`` if null, else its bytes' count, ``:``, its text."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Appender:
    """Streaming append with a stack of open subtrees (height, digest, first leaf).

    ``witnesses[i]`` lists, level by level, ``L`` or ``R`` (the sibling's side)
    and the sibling's digest, or ``-`` where the node was alone."""

    def __init__(self, track: bool = True):
        self.open: list[tuple[int, str, int]] = []
        self.count = 0
        self.witnesses: list[list[str]] | None = [] if track else None

    def append(self, node: str) -> None:
        if self.witnesses is not None:
            self.witnesses.append([])
        self.open.append((0, node, self.count))
        self.count += 1
        while len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
            self._join()

    def _extend(self, first: int, stop: int, entry: str) -> None:
        if self.witnesses is not None:
            for i in range(first, stop):
                self.witnesses[i].append(entry)

    def _join(self) -> None:
        _, right, middle = self.open.pop()
        height, left, first = self.open.pop()
        self._extend(first, middle, "R" + right)
        self._extend(middle, self.count, "L" + left)
        self.open.append((height + 1, _hash(left + right), first))

    def close(self, height: int = 0) -> str:
        """Raises what is open to one node, of ``height`` at least."""
        while len(self.open) > 1 or self.open[-1][0] < height:
            if len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
                self._join()
            else:
                level, digest, first = self.open.pop()
                self._extend(first, self.count, "-")
                self.open.append((level + 1, _hash(digest), first))
        return self.open[0][1]


def _ordered(part: pa.Table, block: int) -> tuple[pa.Table, int]:
    """A block's rows by rank, and the height its root must have."""
    part = part.combine_chunks().sort_by("rank")
    return part, block.bit_length() - 1 if part["size"][0].as_py() > block else 0


def _roots(nodes: DataFrame, block: int) -> DataFrame:
    """The roots of the blocks: the next round's nodes."""
    def root(part: pa.Table) -> pa.Table:
        part, height = _ordered(part, block)
        tree = Appender(track=False)
        for node in part["node"].to_pylist():
            tree.append(node)
        size = -(-part["size"][0].as_py() // block)
        return pa.table({"g": part["g"].slice(0, 1), "rank": [part["rank"][0].as_py() // block], "size": [size], "node": [tree.close(height)]})

    kept = nodes.select("g", "rank", "size", "node", F.floor(F.col("rank") / block).alias("block"))
    return kept.groupBy("g", "block").applyInArrow(root, "g string, rank long, size long, node string")


def _attach(nodes: DataFrame, parents: DataFrame, block: int) -> DataFrame:
    """Each node's witness: inside its block, then that of the block's root."""
    names = nodes.columns

    def extend(part: pa.Table, parent: pa.Table) -> pa.Table:
        part, height = _ordered(part, block)
        tree = Appender()
        for node in part["node"].to_pylist():
            tree.append(node)
        tree.close(height)
        above = parent["witness"][0].as_py()
        out = {n: part[n] for n in names}
        out["witness"] = pa.array([w + above for w in tree.witnesses], pa.list_(pa.string()))
        for n in ("subroot", "root"):
            out[n] = pa.array([parent[n][0].as_py()] * part.num_rows, pa.string())
        return pa.table(out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema) + ", witness array<string>, subroot string, root string"
    blocks = nodes.withColumn("__block", F.floor(F.col("rank") / block))
    above = parents.select(F.col("g").alias("__g"), F.col("rank").alias("__rank"), "witness", "subroot", "root")
    return blocks.groupBy("g", "__block").cogroup(above.groupBy("__g", "__rank")).applyInArrow(extend, schema)


def _ranked(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Adds ``rank`` (from 0, within ``g`` by ``order``) and ``size`` of ``g``.

    Range partitions are numbered in order, so a row's rank is the rows of its
    group in earlier partitions plus its place in its own; the table of
    (group, partition) counts has at most one row more per partition than groups."""
    keys = [F.col("g"), *order]
    dealt = stored(rows.repartitionByRange(*keys, F.rand(7)).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("__part", F.shiftright("__at", _PART))
    counts = dealt.groupBy("g", "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy("g").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    places = counts.select(F.col("g"), "__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"),
                           F.sum("__n").over(Window.partitionBy("g")).alias("size"))
    return dealt.join(places, ["g", "__part"]).withColumn("rank", F.col("__at") + F.col("__shift")).drop("__at", "__part", "__shift")


def _rounds(nodes: DataFrame, block: int) -> list[DataFrame]:
    """``nodes`` and the rounds of block roots above, until each group has one node."""
    rounds, most = [nodes], nodes.agg(F.max("size")).first()[0] or 0
    while most > 1:
        rounds.append(stored(_roots(rounds[-1], block)))
        most = -(-most // block)
    return rounds


def manifest(rows: DataFrame, node: str, group: str, order: Sequence[str]) -> DataFrame:
    """Adds to ``rows`` (digest column ``node``) the columns ``witness`` (see
    ``Appender``, from the row's level up to the root), ``subroot`` (of the
    row's ``group``, a string column; null first, then bytewise) and ``root``.

    Rows of a group are appended by ``order`` (ascending, null first), then by
    ``node``.  All columns of ``rows`` are carried, under their names."""
    block = BLOCK
    inner = {c: f"c{i}" for i, c in enumerate(rows.columns)}
    named = rows.select(*[F.col(f"`{c}`").alias(n) for c, n in inner.items()],
                        F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`")), F.lit("")).alias("g"), F.col(f"`{node}`").alias("node"))
    by = [F.col(inner[o]).asc_nulls_first() for o in order] + [F.col("node")]
    below = _rounds(stored(_ranked(named, by)), block)
    subroots = below[-1].select(F.lit("").alias("g"), F.col("g").alias("name"), "node")
    top = _rounds(stored(_ranked(subroots, [F.col("name")])), block)
    found = top[-1].select("g", "rank", F.array().cast("array<string>").alias("witness"), F.lit("").alias("subroot"), F.col("node").alias("root"))
    for nodes in reversed(top[:-1]):
        found = _attach(nodes, found, block)
    if len(top) == 1:
        found = found.join(top[0].select("g", "name", "node"), "g")
    found = stored(found.select(F.col("name").alias("g"), F.lit(0).cast("long").alias("rank"), "witness", F.col("node").alias("subroot"), "root"))
    if len(below) == 1:
        found = below[0].join(found.drop("rank"), "g")
    for nodes in reversed(below[:-1]):
        found = _attach(nodes, found, block)
    return found.select(*[F.col(n).alias(c) for c, n in inner.items()], "witness", "subroot", "root")


def proof(witness: Column) -> Column:
    """The siblings' digests, level by level."""
    return F.filter(F.transform(witness, lambda s: F.substring(s, 2, 64)), lambda s: s != "")


def fold(node: Column, witness: Column) -> Column:
    """The root that ``node`` and the witness's siblings give."""
    def up(below: Column, entry: Column) -> Column:
        sibling = F.substring(entry, 2, 64)
        return F.sha2(F.when(F.substring(entry, 1, 1) == "L", F.concat(sibling, below)).otherwise(F.concat(below, sibling)), 256)
    return F.aggregate(witness, node, up)
