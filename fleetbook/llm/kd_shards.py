"""Sharding by a k-d tree over metadata: weighted median splits until leaves reach the target bytes.

A document's size is the UTF-8 bytes of its text plus 1. Its coordinates are its
source and language (the bytes after the values' common beginning, read as a
number), the logarithm of its n_chars, and its id. A node of the tree
that must make ``k`` shards is split along its widest dimension (extent
relative to the whole table's) at the point where ``k // 2`` of ``k`` parts of its
bytes lie below, until every leaf makes one shard.

The medians are found without sorting: all nodes of a level count the
bytes in ``BINS`` equal bins of their dimension, the bin that holds a node's
median is cut into bins again, and so on until it weighs little. Where one
coordinate holds too much (a hot source), the same goes on along a hash of the text.

Groups are equal texts: a group takes the coordinates of its least (source,
lang, n_chars, doc_id), so it lies at one point and stays in one shard, unless
it weighs over 1/``GRAIN`` of a shard: then it is dealt by a hash of the id into
pieces, neighbours in the tree, between which a median may fall. The groups that
have pieces are at most ``2 * GRAIN * shards``. Shards are near equal in bytes
for any skew; a single row that weighs more than a shard stays whole.

The tree, ``shards - 1`` cuts, is held on the driver and applied as one
expression, so ``shards`` is at most ``MAX_SHARDS``. Rows that share id and
text are one unit (by row where the id is null). Defined cases: a null text has no bytes
and equals the empty one; null coordinates come first; texts are measured
whole; an empty table gives no rows; shards can be empty where there
are fewer units than shards. Only id, text, source, lang and n_chars are read,
so other columns may have any name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .ranks import ranked

#: Bins of a histogram, parts of a shard that a unit weighs at most, most shards.
BINS, GRAIN, MAX_SHARDS = 256, 128, 1024
DIMS = ("c0", "c1", "c2", "c3")
#: Along a dimension, units are told apart by the text's hash, then by the piece.
AXES = ("key", "piece")


@dataclass
class Node:
    """A part of the tree: a leaf with a shard's number, or a cut between two parts."""

    shards: range
    weight: int = 0
    dim: str | None = None
    cut: tuple = ()
    left: Node | None = None
    right: Node | None = None

    def leaves(self) -> list[Node]:
        return [self] if self.left is None else self.left.leaves() + self.right.leaves()

    def below(self) -> Column:
        """Does a row lie before the cut (coordinate, key, piece)?"""
        values = (self.dim, *AXES)[: len(self.cut)]
        out = F.lit(False)
        for name, value in reversed(list(zip(values, self.cut, strict=True))):
            out = (F.col(name) < F.lit(value)) | ((F.col(name) == F.lit(value)) & out)
        return out

    def number(self) -> Column:
        """The first shard of the leaf in which a row lies."""
        if self.left is None:
            return F.lit(self.shards.start)
        return F.when(self.below(), self.left.number()).otherwise(self.right.number())


@dataclass
class Search:
    """Where a node's median can lie: values ``low`` to ``high`` of the axis after those fixed."""

    node: Node
    goal: float
    low: list  # least and greatest values of (dim, key, piece) in the region
    high: list
    weight: int
    before: int = 0
    axis: int = 0

    @property
    def column(self) -> str:
        return (self.node.dim, *AXES)[self.axis]

    def inside(self) -> Column:
        out = F.lit(True)
        for name, value in zip((self.node.dim, *AXES), self.low[: self.axis], strict=False):
            out &= F.col(name) == F.lit(value)
        return out & F.col(self.column).between(F.lit(self.low[self.axis]), F.lit(self.high[self.axis]))

    def bin(self) -> Column:
        low, high = self.low[self.axis], self.high[self.axis]
        if self.axis == 0:
            return F.least(F.floor((F.col(self.column) - F.lit(low)) / F.lit(high - low) * BINS), F.lit(BINS - 1)).cast("int")
        return F.floor((F.col(self.column) - F.lit(low)) / F.lit(max(1, -(-(high - low + 1) // BINS)))).cast("int")

    def cut_at(self, value) -> None:
        self.node.cut = (*self.low[: self.axis], value)

    def narrow(self, bins: list, tolerance: float) -> bool:
        """Go on in the bin where the goal lies, or cut beside it; True when done."""
        for row in bins:
            if self.before + row["weight"] >= self.goal or row is bins[-1]:
                break
            self.before += row["weight"]
        low, high = [row[f"low{i}"] for i in range(3)], [row[f"high{i}"] for i in range(3)]
        axis = self.axis
        while axis < 3 and low[axis] == high[axis]:
            axis += 1
        if row["weight"] <= tolerance or axis == 3:
            if self.goal - self.before <= self.before + row["weight"] - self.goal:
                self.cut_at(low[self.axis])
            else:
                self.cut_at(math.nextafter(high[self.axis], math.inf) if self.axis == 0 else high[self.axis] + 1)
            return True
        self.low, self.high, self.weight, self.axis = low, high, row["weight"], axis
        return False


def _by_leaf(leaves: list[Node], tree: Node, value) -> Column:
    """``value(leaf)`` of the leaf in which a row lies; null outside of ``leaves``."""
    if tree.left is None:
        return value(tree) if tree in leaves else F.lit(None)
    return F.when(tree.below(), _by_leaf(leaves, tree.left, value)).otherwise(_by_leaf(leaves, tree.right, value))


def kd_tree(units: DataFrame, shards: int, tolerance: float) -> Node:
    """The tree over stored rows of (size, c0..c3, key, piece)."""
    tree = Node(range(shards))
    extent: dict[str, float] = {}
    while open_ := [x for x in tree.leaves() if len(x.shards) > 1]:
        extremes = [f(c).alias(f"{n}_{c}") for c in (*DIMS, *AXES) for n, f in (("low", F.min), ("high", F.max))]
        sums = units.groupBy(tree.number().alias("leaf")).agg(F.sum("size").alias("weight"), *extremes).collect()
        by = {row["leaf"]: row for row in sums}
        extent = extent or {c: by[0][f"high_{c}"] - by[0][f"low_{c}"] if by else 0 for c in DIMS}
        searches = []
        for node in open_:
            half = len(node.shards) // 2
            row = by.get(node.shards.start)
            if row is None:  # no rows: any cut will do
                node.dim, node.cut = DIMS[0], (0.0,)
            else:
                node.weight = row["weight"]
                node.dim = max(DIMS, key=lambda c: (row[f"high_{c}"] - row[f"low_{c}"]) / (extent[c] or 1))
                axes = (node.dim, *AXES)
                low, high = [row[f"low_{c}"] for c in axes], [row[f"high_{c}"] for c in axes]
                searches.append(Search(node, node.weight * half / len(node.shards), low, high, node.weight))
        for s in searches:
            whole = {"weight": s.weight} | {f"low{i}": x for i, x in enumerate(s.low)} | {f"high{i}": x for i, x in enumerate(s.high)}
            if s.low[0] == s.high[0] and s.narrow([whole], tolerance):
                s.weight = 0
        active = [s for s in searches if s.weight]
        while active:
            of = {id(s.node): s for s in active}
            nodes = [s.node for s in active]
            bins = _by_leaf(nodes, tree, lambda x: F.when(of[id(x)].inside(), of[id(x)].bin()))
            axes = [_by_leaf(nodes, tree, lambda x: F.col(x.dim)), F.col("key"), F.col("piece")]
            low_high = [f(a).alias(f"{n}{i}") for i, a in enumerate(axes) for n, f in (("low", F.min), ("high", F.max))]
            counted = units.groupBy(tree.number().alias("leaf"), bins.alias("bin")).agg(F.sum("size").alias("weight"), *low_high).filter("bin is not null").collect()
            rows: dict[int, list] = {}
            for row in sorted(counted, key=lambda r: r["bin"]):
                rows.setdefault(row["leaf"], []).append(row.asDict())
            active = [s for s in active if not s.narrow(rows[s.node.shards.start], tolerance)]
        for node in open_:
            half = len(node.shards) // 2
            node.left, node.right = Node(node.shards[:half]), Node(node.shards[half:])
    return tree


def _common_length(a: str | None, b: str | None) -> int:
    """Bytes that the least and greatest text, and so all, begin with."""
    x, y = (a or "").encode(), (b or "").encode()
    return next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))


def _text_axis(name: str, skip: int) -> Column:
    """Six bytes of a text as a number; 0 for null."""
    shown = F.rpad(F.hex(F.substring(F.encode(F.col(name), "UTF-8"), skip + 1, 6)), 12, "0")
    return F.coalesce(F.conv(shown, 16, 10).cast("double") + 1, F.lit(0.0))


def _units(docs: DataFrame, shards: int) -> tuple[DataFrame, int]:
    """Stored rows with coordinates, key and piece, and their total size."""
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"),
        (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("crc"), F.shiftrightunsigned(F.xxhash64(body), 2).alias("key"), F.monotonically_increasing_id().alias("tie"),
    )
    rows = staged(rows, "kd-rows")
    seen = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"), F.count("*").alias("n"), F.min("source").alias("s0"), F.max("source").alias("s1"), F.min("lang").alias("l0"), F.max("lang").alias("l1")).first()
    bound, most = seen["total"] / (shards * GRAIN), seen["n"] / (shards * GRAIN)
    place = F.struct("source", "lang", "n_chars", "doc_id")
    heavy = rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min(place).alias("place")).filter((F.col("bytes") > bound) | (F.col("rows") > most))
    pieces = F.greatest(F.ceil(F.col("bytes") / max(1, bound)), F.lit(1)).cast("int")
    heavy = staged(heavy.select("key", "place", pieces.alias("pieces")), "kd-heavy")
    # of groups over either bound there are fewer than 2 * GRAIN * shards
    known = rows.join(F.broadcast(heavy), "key", "left")
    salt = F.when(F.col("doc_id").isNull(), F.xxhash64("tie")).otherwise(F.xxhash64("doc_id"))
    many = known.filter("pieces is not null").withColumn("piece", F.pmod(salt, F.col("pieces")).cast("int")).drop("pieces")
    few = known.filter("pieces is null").withColumn("place", F.min(place).over(Window.partitionBy("key"))).withColumn("piece", F.lit(0)).drop("pieces")
    n_chars = F.coalesce(F.log1p(F.greatest(F.col("place.n_chars"), F.lit(0)).cast("double")) + 1, F.lit(0.0))
    coordinates = (_text_axis("place.source", _common_length(seen["s0"], seen["s1"])), _text_axis("place.lang", _common_length(seen["l0"], seen["l1"])), n_chars, F.coalesce(F.col("place.doc_id").cast("double"), F.lit(0.0)))
    located = few.unionByName(many).select("doc_id", "size", "crc", "key", "piece", "tie", *[c.alias(d) for c, d in zip(coordinates, DIMS, strict=True)])
    return staged(located, "kd-units"), seen["total"]


def kd_shards(docs: DataFrame, target_bytes: int | None = None, shards: int | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``bytes``: shards are near equal in bytes. Give their number or the
    bytes that a shard may have. Slots count a shard's rows by id from 0.
    """
    if shards is None:
        total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(1).cast("long"))).first()[0] or 0
        shards = max(1, -(-total // target_bytes))
    if not 1 <= shards <= MAX_SHARDS:
        raise ValueError(f"{shards} shards; from 1 to {MAX_SHARDS} can be made")
    units, total = _units(docs, shards)
    tree = kd_tree(units, shards, total / (shards * GRAIN * 8))
    rows = units.select("doc_id", "size", "crc", "tie", tree.number().alias("shard"))
    placed = ranked(rows, ["shard"], [F.col("doc_id").asc_nulls_first(), F.col("size").asc(), F.col("crc").asc(), F.col("tie").asc()], "kd-ranked")
    return placed.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("rank").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
