"""Exact ranks of rows within groups, without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged


def ranked(rows: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """Stored ``rows`` with ``rank`` (from 0, by ``order``, nulls first) in its group and
    ``n``, the group's rows.

    Rows are range partitioned by group and order, so a hot group is spread over
    many tasks; a row's place in its sorted partition, less the place at
    which its group begins there, plus the group's rows in earlier partitions is
    its rank. What is summed is one row per group and partition. Rows that
    are equal in group and order are told apart by ``order``'s last column,
    where that matters. Columns ``at`` and ``part`` are taken.
    """
    keys = [F.col(g).asc_nulls_first() for g in group] + order
    laid = staged(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), name)
    part = F.shiftright("at", 33)
    runs = laid.groupBy(*group, part.alias("part")).agg(F.min("at").alias("begin"), F.count("*").alias("rows"))
    whole = Window.partitionBy(*group)
    before = F.coalesce(F.sum("rows").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(*[F.col(g).alias(f"run_{g}") for g in group], "part", (before - F.col("begin")).alias("shift"), F.sum("rows").over(whole).alias("n"))
    on = part == F.col("part")
    for g in group:
        on &= F.col(g).eqNullSafe(F.col(f"run_{g}"))
    return laid.join(runs, on).withColumn("rank", F.col("at") + F.col("shift")).select(*rows.columns, "rank", "n")
