"""Merkle manifest of a dataset by nested-struct rollup.

Rows of a group (a source) are leaves in the order of their ids. A leaf's rank
in its group, written in digits to the base ``FANOUT``, says where it hangs:
grouping the lowest digit away makes one node of at most ``FANOUT`` children, a
struct that holds its digit, its hash and its children's structs; the next
grouping nests these, and so on for the ``DIGITS`` digits of a block. A block is
one row of ``FANOUT ** DIGITS`` leaves at most, whatever the size of the group.
Blocks are the leaves of the next tier, which is rolled up alike, until a
group has one block; the groups' hashes are then rolled up to the root.

Proofs go down the same structs: a transform pairs every child with the hashes
to its left and right, and an explode makes rows of them, from the top tier's
blocks to the leaves. A tier hands its blocks' upper proofs down by a grouping of
both by (group, block). No join takes part in roll-up and proofs.

Defined cases: a null value is written ``-``; a null group is a group of its own
and comes first; a null id comes first in its group; rows of one id are ordered by
leaf, and equal rows are leaves of their own; texts are hashed whole, whatever
their length; an empty table gives no rows. Only the named columns are read,
so others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged
from .ranks import ranked

#: Children of a node, and digits (levels) of a block.
FANOUT, DIGITS = 16, 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

_PATH = "array<struct<left:string,right:string>>"


def leaf_hash(values: list[Column]) -> Column:
    """sha256 of the values' encodings: ``-`` for null, else byte count, ``:``, value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(path, leaf, lambda node, run: F.sha2(F.concat(run["left"], node, run["right"]), 256))


def siblings(path: Column) -> Column:
    """All sibling hashes of a proof, level by level and left to right, as one text."""
    return F.array_join(F.transform(path, lambda run: F.concat(run["left"], run["right"])), "")


def _several(level: int) -> Column:
    """Are there several nodes of ``level`` in a tree with ``n`` leaves?"""
    return F.col("n") > FANOUT**level


def _rolled(nodes: DataFrame, name: str) -> DataFrame:
    """(tree, block, n, hash, kids) of (tree, n, rank, hash, kids): blocks of nested structs, stored."""
    digits = [f"d{k}" for k in range(DIGITS)]
    columns = [F.floor(F.col("rank") / FANOUT**k).cast("long") % FANOUT for k in range(DIGITS)]
    block = F.floor(F.col("rank") / FANOUT**DIGITS).cast("long").alias("block")
    rows = nodes.select("tree", "n", block, *[c.cast("int").alias(d) for c, d in zip(columns, digits, strict=True)], "hash", "kids")
    rows = rows.repartition("tree", "block")
    for k, digit in enumerate(digits):
        child = F.struct(F.col(digit).alias("digit"), "hash", "kids")
        rows = rows.groupBy("tree", "block", "n", *digits[k + 1 :]).agg(F.sort_array(F.collect_list(child)).alias("kids"))
        joined = F.sha2(F.array_join("kids.hash", ""), 256)
        rows = rows.withColumn("hash", F.when(_several(k), joined).otherwise(F.col("kids.hash")[0]))
    return staged(rows, name)


def _tiers(leaves: DataFrame, name: str) -> list[DataFrame]:
    """Blocks of every tier over (tree, n, rank, hash, kids), the last with one block per tree."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    tiers = [_rolled(leaves, f"{name}-0")]
    while (most := -(-most // FANOUT**DIGITS)) > 1:
        blocks = tiers[-1].select("tree", F.ceil(F.col("n") / FANOUT**DIGITS).alias("n"), F.col("block").alias("rank"), "hash", F.struct("block").alias("kids"))
        tiers.append(_rolled(blocks, f"{name}-{len(tiers)}"))
    return tiers


def _opened(blocks: DataFrame) -> DataFrame:
    """(tree, above, hash, kids, path) of the leaves below blocks that have ``above`` and ``path``."""
    hashes, path = F.col("kids.hash"), F.col("path")

    def child(kid, i):
        beside = F.struct(F.array_join(F.slice(hashes, 1, i), "").alias("left"), F.array_join(F.slice(hashes, i + 2, FANOUT), "").alias("right"))
        longer = F.when(F.col("several"), F.concat(F.array(beside), path)).otherwise(path)
        return F.struct(kid["hash"].alias("hash"), kid["kids"].alias("kids"), longer.alias("path"))

    rows = blocks
    for k in reversed(range(DIGITS)):
        rows = rows.withColumn("several", _several(k))
        rows = rows.select("tree", "n", "above", F.explode(F.transform("kids", child)).alias("one")).select("tree", "n", "above", "one.*")
    return rows.drop("n")


def _handed_down(blocks: DataFrame, notes: DataFrame) -> DataFrame:
    """``blocks`` with the (above, path) that ``notes`` have for their (tree, block)."""
    above = notes.schema["above"].dataType
    own = blocks.select("tree", "block", "n", "kids", F.lit(None).cast(above).alias("above"), F.lit(None).cast(_PATH).alias("path"))
    told = notes.select("tree", "block", F.lit(None).cast("long").alias("n"), F.lit(None).cast(blocks.schema["kids"].dataType).alias("kids"), "above", "path")
    both = own.unionByName(told).groupBy("tree", "block")
    return both.agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("n", "kids", "above", "path")])


def _proved(tiers: list[DataFrame], top: DataFrame) -> DataFrame:
    """Opens all tiers from the top one down; ``top`` notes (tree, block, above, path) of its blocks."""
    notes = top
    for blocks in reversed(tiers):
        rows = _opened(_handed_down(blocks, notes))
        if blocks is not tiers[0]:
            notes = rows.select("tree", F.col("kids.block").alias("block"), "above", "path")
    return rows


def manifest(docs: DataFrame, columns: tuple = COLUMNS, group: str = "source", order: str = "doc_id", carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row: (order), leaf, subroot, root, path and the columns of ``carry``.

    ``path`` lists, from the leaf to the root, the joined hashes to the left and to
    the right in each run on the way: ``fold(leaf, path)`` is the root.
    ``carry`` computes further columns from the row.
    """
    more = F.struct(F.col(order).alias("id"), *[c.alias(k) for k, c in (carry or {}).items()])
    rows = staged(docs.select(F.col(group).alias("tree"), leaf_hash([F.col(c) for c in columns]).alias("hash"), more.alias("kids"), F.monotonically_increasing_id().alias("tie")), "merkle-leaves")
    leaves = ranked(rows, ["tree"], [F.col("kids.id").asc_nulls_first(), F.col("hash").asc(), F.col("tie").asc()], "merkle-ranked")
    tiers = _tiers(leaves.select("tree", "n", "rank", "hash", "kids"), "merkle-tier")
    groups = tiers[-1].select("tree", "hash")
    subroots = ranked(groups, [], [F.col("tree").asc_nulls_first()], "merkle-groups")
    over = _tiers(subroots.select(F.lit(0).alias("tree"), "n", "rank", "hash", F.struct(F.col("tree").alias("group")).alias("kids")), "merkle-over")
    empty = F.array().cast(_PATH).alias("path")
    proved = _proved(over, over[-1].select("tree", "block", F.struct(F.col("hash").alias("root")).alias("above"), empty))
    notes = proved.select(F.col("kids.group").alias("tree"), F.lit(0).cast("long").alias("block"), F.struct("above.root", F.col("hash").alias("subroot")).alias("above"), "path")
    return _proved(tiers, notes).select(F.col("kids.id").alias(order), F.col("hash").alias("leaf"), "above.subroot", "above.root", "path", *[f"kids.{k}" for k in carry or {}])


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def audit(docs: DataFrame, every: int = 5) -> DataFrame:
    """The manifest's digests, and what becomes of the proofs when texts are tampered with.

    Where ``every`` divides the crc32 of the decimal doc_id, the text is lower-cased
    (A-Z) before its leaf is folded with the original siblings. A null doc_id is
    never tampered with.
    """
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0, F.lit(False))
    changed = leaf_hash([lowered(F.col(c)) if c == "text" else F.col(c) for c in COLUMNS])
    rows = manifest(docs, carry={"tampered": F.when(touched, changed)})
    folded = fold(F.coalesce("tampered", "leaf"), F.col("path"))
    rows = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
