"""Mixing sources to target weights by a low-discrepancy schedule.

Sources, in code point order with null last, weigh 5, 2, 1, repeating. Their
targets share the corpus's words by weight; a target stops at ``max_epochs``
times its source's size and the excess is reshared by weight. The schedule has
one slot for every block of ``block`` words. Slot ``j`` takes the point
``frac(j * golden ratio)``, kept as 31-bit integers, and the cumulative target
share in which the point falls names its source; a slot's rank among its
source's slots names the block. A source's blocks are equal pieces of its
documents in shuffled order (by a hash of the id), read round and round; a
document's ``taken`` words are its pieces in scheduled blocks.

Everything is DataFrame work: points meet shares by an equi-join on a piece of
the unit interval, ranks and stream offsets come from windows over small
chunks plus sums over chunk totals, so no source's rows meet in one task.

Defined cases: a null text has size 0; documents of size 0 are never taken;
repeated rows are separate documents with the same id; a null source is a
source of its own. Only id, text and source are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, staged

#: Weights by the source's place in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: 2**31 and the odd integer nearest 2**31 divided by the golden ratio.
UNIT, GOLDEN = 1 << 31, 1327217885
#: Rows of a chunk, on average.
CHUNK = 1024


def word_count(text: str | Column) -> Column:
    """Number of runs of ``[^\\x20\\x09-\\x0D]``; 0 for null."""
    col = F.col(text) if isinstance(text, str) else text
    marked = F.regexp_replace(col, r"[^\x20\x09-\x0D]+", "x")
    return F.coalesce(F.length(F.regexp_replace(marked, r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, max_epochs: int = 3, weights: tuple = WEIGHTS) -> DataFrame:
    """(source, source_size, target, place) from (source, size): one row per source.

    Sources are sorted by the words they can give per unit of weight. The
    first ones give all they can; the rest share what is left by weight, from
    the first place on where that share is within reach.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    per = per.withColumn("place", place).withColumn("weight", w).withColumn("cap", F.col("source_size") * max_epochs)
    by = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before, whole = by.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = (
        per.withColumn("all_size", F.sum("source_size").over(whole))
        .withColumn("left_size", F.col("all_size") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("rate", F.col("left_size").cast("double") / F.col("left_weight"))
        .withColumn("open", F.col("rate") <= F.col("cap") / F.col("weight"))
        .withColumn("final_rate", F.first(F.when(F.col("open"), F.col("rate")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    share = F.least(F.col("cap").cast("double"), F.col("final_rate") * F.col("weight"))
    target = F.when(F.col("final_rate").isNull(), F.col("cap").cast("double")).otherwise(share)
    per = per.withColumn("target", target)
    up_to = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = F.round(F.sum("target").over(up_to) / F.greatest(F.sum("target").over(whole), F.lit(1e-300)) * UNIT).cast("long")
    per = per.withColumn("hi", F.when(F.row_number().over(Window.orderBy(F.col("place").desc())) == 1, F.lit(UNIT)).otherwise(edge))
    per = per.withColumn("lo", F.lag("hi", 1, 0).over(Window.orderBy("place")))
    return per.select("source", "source_size", "target", "place", "lo", "hi", (F.col("cap")).alias("cap"))


def schedule(targets: DataFrame, slots: int) -> DataFrame:
    """(slot, place, rank): every slot's source, and its number among that source's slots.

    ``targets`` has (place, lo, hi): pieces of [0, 2**31) that cover it.
    """
    spark = targets.sparkSession
    step = max(1, -(-slots // CHUNK))
    width = -(-UNIT // step)
    points = spark.range(slots).select(F.col("id").alias("slot"), ((F.col("id") % UNIT) * GOLDEN % UNIT).alias("point")).withColumn("piece", F.floor(F.col("point") / width).cast("long"))
    pieces = targets.filter("hi > lo").select("place", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / width).cast("long"), F.floor((F.col("hi") - 1) / width).cast("long"))).alias("piece"))
    owned = points.join(pieces, "piece").filter("point >= lo and point < hi").select("slot", "place", F.floor(F.col("slot") / CHUNK).cast("long").alias("chunk"))
    inside = owned.withColumn("nth", F.row_number().over(Window.partitionBy("place", "chunk").orderBy("slot")) - 1)
    return _offset(inside, F.lit(1)).select("slot", "place", (F.col("before") + F.col("nth")).alias("rank"))


def _offset(rows: DataFrame, amount: Column) -> DataFrame:
    """Add ``before``: the sum of ``amount`` over the earlier chunks of the row's place."""
    totals = rows.groupBy("place", "chunk").agg(F.sum(amount).alias("total"))
    by = Window.partitionBy("place").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(totals.select("place", "chunk", F.coalesce(F.sum("total").over(by), F.lit(0)).alias("before")), ["place", "chunk"])


def streams(sizes: DataFrame, targets: DataFrame, rows: int, seed: int = 0) -> DataFrame:
    """Each document's place in its source's shuffled word stream: adds ``at``.

    Documents are ordered by a hash of seed and id; chunks are equal ranges of the hash.
    """
    chunks = max(1, -(-rows // CHUNK))
    keyed = (
        sizes.join(targets.select("source", "place", "source_size", "target", "cap"), sizes["source"].eqNullSafe(targets["source"]))
        .select("doc_id", "size", "place", "source_size", "target", "cap", F.md5(F.concat(F.lit(f"{seed}:"), id_text("doc_id"))).alias("draw"))
        .withColumn("chunk", F.floor(F.conv(F.substring("draw", 1, 8), 16, 10).cast("long") * chunks / (1 << 32)).cast("long"))
    )
    by = Window.partitionBy("place", "chunk").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = keyed.withColumn("nth", F.coalesce(F.sum("size").over(by), F.lit(0)))
    return _offset(inside, F.col("size")).withColumn("at", F.col("before") + F.col("nth")).drop("before", "nth", "chunk", "draw")


def block_length(words: int) -> int:
    """Words of a block: 128, and less for corpora of under 256,000 words."""
    return max(1, min(128, words // 2000))


def mix(docs: DataFrame, max_epochs: int = 3, seed: int = 0) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    sizes = staged(docs.select("doc_id", "source", word_count("text").alias("size")), "mix-sizes")
    words, rows = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    targets = staged(source_targets(sizes, max_epochs).coalesce(1), "mix-targets")
    block = block_length(words)
    slots = schedule(targets, -(-words // block))
    placed = streams(sizes, targets, rows, seed)
    # a document comes round once an epoch; its words lie in one block or more
    reach = F.least(F.col("cap"), F.ceil(F.col("target")).cast("long") + F.lit(64 * block))
    epochs = F.expr(f"sequence(0, {max_epochs - 1})")
    turns = placed.withColumn("row", F.struct("doc_id", "size", "source_size", "target", "place", "at")).select("row", "cap", reach.alias("reach"), F.explode(epochs).alias("epoch"))
    turns = turns.select("row", "cap", "epoch", "reach", (F.col("row.at") + F.col("epoch") * F.col("row.source_size")).alias("from"))
    last = F.col("from") + F.col("row.size") - 1
    blocks = F.when((F.col("row.size") > 0) & (F.col("from") < F.col("reach")), F.sequence(F.floor(F.col("from") / block).cast("long"), F.floor(last / block).cast("long")))
    pieces = turns.withColumn("block", F.explode_outer(blocks)).filter("block is not null or epoch = 0")
    begin, end = F.greatest(F.col("from"), F.col("block") * block), F.least(last + 1, (F.col("block") + 1) * block, F.col("cap"))
    pieces = pieces.select("row", F.col("row.place").alias("place"), F.col("block").alias("rank"), (end - begin).alias("words"))
    used = pieces.join(slots, ["place", "rank"], "left").withColumn("got", F.when(F.col("slot").isNotNull(), F.col("words")).otherwise(0))
    return used.groupBy("row").agg(F.sum("got").alias("taken"), F.sum(F.when(F.col("row.size") == 0, 1).otherwise(0)).alias("empty")).select(
        "row.doc_id", "row.size", "row.source_size", "row.target", F.col("taken").cast("long").alias("taken"), F.explode(F.sequence(F.lit(1), F.greatest(F.col("empty"), F.lit(1)))).alias("copy")
    ).drop("copy")


def mixed_rows(docs: DataFrame, max_epochs: int = 3, seed: int = 0) -> DataFrame:
    """The mix as whole rows: each id's rows are repeated as often as the mix
    takes the id's words, rounded half up; ids taken by less than half go.

    Rows that share an id share its words and so its number of copies.
    """
    taken = mix(docs, max_epochs, seed).groupBy("doc_id").agg(F.sum("taken").alias("taken"), F.sum("size").alias("words"))
    copies = F.floor(F.col("taken") / F.col("words") + 0.5).cast("int")
    plan = taken.filter("words > 0").select(F.struct("doc_id", copies.alias("copies")).alias("mix_plan")).filter("mix_plan.copies > 0")
    rows = docs.select(F.struct("*").alias("mix_row"))
    joined = rows.join(plan, F.col("mix_row.doc_id").eqNullSafe(F.col("mix_plan.doc_id")))
    return joined.select("mix_row", F.explode(F.sequence(F.lit(1), F.col("mix_plan.copies")))).select("mix_row.*")
