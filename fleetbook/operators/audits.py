"""Constraint audits: unique keys, foreign keys and delete effects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetbook.schemas import FOREIGN_KEYS, UNIQUE_KEYS
from fleetbook.session import written


# The source database compares text case-, accent- and trailing-space-
# insensitively; pass this as ``collation`` to judge keys the same way.
SOURCE_COLLATION = "UNICODE_CI_AI_RTRIM"


def duplicate_keys(df: DataFrame, key: list[str] | tuple[str, ...], collation: str | None = None) -> DataFrame:
    """Groups of a unique key holding more than one row (NULL key parts never
    collide, as in a SQL unique index). With ``collation``, text key parts
    are compared under it (e.g. ``'Jose '`` equals ``'JOSÉ'``)."""
    key = list(key)
    nn = df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key]))
    if collation:
        text = {f.name for f in df.schema.fields if f.dataType.typeName() == "string"}
        nn = nn.select(*[F.collate(k, collation).alias(k) if k in text else F.col(k) for k in key])
    return nn.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def duplicate_entries(entries: DataFrame) -> DataFrame:
    return duplicate_keys(entries, UNIQUE_KEYS["daily_entries"])


def duplicate_dni(drivers: DataFrame) -> DataFrame:
    return duplicate_keys(drivers, UNIQUE_KEYS["drivers"])


def orphans(child: DataFrame, fk: str, parent: DataFrame, child_name: str,
            parent_name: str, parent_key: str = "id") -> DataFrame:
    """Distinct non-NULL foreign-key values with no parent row, how many child rows
    carry each and how many tenants these belong to (NULL: the child has no tenant).

    The child is first reduced to its distinct values per tenant (partial
    aggregation), then matched with the parent keys by a left join and a NULL
    test. Unlike an anti-join, the optimizer does not push this below the
    aggregation, so for a parent too large to broadcast only distinct values
    are shuffled, never every child row.
    """
    owner = F.col("owner_user_id") if "owner_user_id" in child.columns else F.lit(None).cast("bigint")
    vals = child.where(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("value"), owner.alias("owner")).agg(
        F.count(F.lit(1)).alias("n"))
    vals = vals.groupBy("value").agg(F.sum("n").alias("rows"), F.nullif(F.count("owner"), F.lit(0).cast("bigint")).alias("owners"))
    keys = parent.select(F.col(parent_key).alias("_pk")).distinct()
    missing = vals.join(keys, vals.value == keys._pk, "left").where(F.col("_pk").isNull())
    return missing.select(F.lit(child_name).alias("child_table"), F.lit(fk).alias("fk_column"),
                          F.lit(parent_name).alias("parent_table"), "value", "rows", "owners")


def orphan_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Every foreign key of the data model that the tables hold, checked for missing parents."""
    parts = [orphans(tables[k.child], k.column, tables[k.parent], k.child, k.parent) for k in FOREIGN_KEYS
             if k.child in tables and k.parent in tables and k.column in tables[k.child].columns]
    return reduce(DataFrame.unionByName, parts)


def driver_delete_effects(drivers: DataFrame, requests: DataFrame, entries: DataFrame,
                          cars: DataFrame, users: DataFrame) -> DataFrame:
    """Effects of deleting drivers: entries RESTRICT the delete; cars and users
    linked to the driver would have their link set to NULL."""
    return delete_effects(drivers, requests, [
        ("entries_count", entries, "driver_id", "restrict"),
        ("cars_unlinked", cars, "current_driver_id", "set_null"),
        ("users_unlinked", users, "driver_id", "set_null"),
    ])


def unique_violations(tables: dict[str, DataFrame], collation: str | None = None) -> DataFrame:
    """Every unique key of the data model with its violating groups, the key
    values joined into one text (``|``-separated)."""
    parts = []
    for name, key in UNIQUE_KEYS.items():
        if name not in tables:
            continue
        dup = duplicate_keys(tables[name], key, collation)
        parts.append(dup.select(F.lit(name).alias("table_name"), F.lit(",".join(key)).alias("key_columns"),
                                F.concat_ws("|", *[F.col(k).cast("string").cast("string collate UTF8_BINARY")
                                                   for k in key]).alias("key_value"),
                                "rows"))
    return reduce(DataFrame.unionByName, parts)


def delete_effects(parent: DataFrame, requests: DataFrame,
                   effects: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """Effects of deleting parent rows, per requested existing id.

    ``effects`` lists ``(column name, child table, foreign key, action)`` with
    action ``restrict`` (the delete is blocked while such rows exist),
    ``set_null`` or ``cascade``; each column counts the child rows affected.
    Each child is semi-joined with the (small) requested ids before counting.
    """
    req = parent.join(requests.select("id").distinct(), "id", "left_semi").select("id")
    out = req
    z = F.lit(0).cast("bigint")
    for name, child, fk, _ in effects:
        hit = child.join(req.withColumnRenamed("id", fk), fk, "left_semi")
        counts = hit.groupBy(F.col(fk).alias("id")).agg(F.count(F.lit(1)).alias(name))
        out = out.join(counts, "id", "left")
    cols = [F.coalesce(name, z).alias(name) for name, *_ in effects]
    restricting = [F.coalesce(name, z) > 0 for name, _, _, action in effects if action == "restrict"]
    blocked = reduce(lambda a, b: a | b, restricting) if restricting else F.lit(False)
    return out.select("id", *cols, blocked.alias("blocked"))


def car_delete_effects(cars: DataFrame, requests: DataFrame, entries: DataFrame) -> DataFrame:
    """Deleting cars: entries restrict the delete."""
    return delete_effects(cars, requests, [("entries_count", entries, "car_id", "restrict")])


def user_delete_effects(users: DataFrame, requests: DataFrame, tokens: DataFrame, entries: DataFrame,
                        expenses: DataFrame, notes: DataFrame) -> DataFrame:
    """Deleting users: their tokens are deleted with them; entries, expenses
    and notes they created or edited keep existing with the link set to NULL."""
    return delete_effects(users, requests, [
        ("tokens_deleted", tokens, "user_id", "cascade"),
        ("entries_unlinked", entries, "created_by", "set_null"),
        ("expenses_unlinked", expenses, "created_by", "set_null"),
        ("notes_unlinked", notes, "updated_by", "set_null"),
    ])


def period_mismatches(entries: DataFrame) -> DataFrame:
    """Rows whose stored period columns disagree with their date (year and
    month of the calendar, ISO week): reports by date and by stored period
    differ on them."""
    d = F.col("entry_date")
    same = (F.col("year_number").eqNullSafe(F.year(d)) & F.col("month_number").eqNullSafe(F.month(d))
            & F.col("week_number").eqNullSafe(F.weekofyear(d)))
    return entries.where(~same)


def places(rows: DataFrame, col: str, collation: str = SOURCE_COLLATION) -> DataFrame:
    """(id, ``col``, place): the rank of each text among the distinct ones under a collation
    (NULL has no place).

    Distinct texts are ranked by counting: they are ordered in a range sort, a text's
    place is its position in its sorted part plus the sizes of the parts before.
    """
    name = F.collate(col, collation)
    distinct = rows.where(F.col(col).isNotNull()).select(name.alias("name")).distinct().repartitionByRange("name").sortWithinPartitions("name")
    laid = written(distinct.withColumn("at", F.monotonically_increasing_id()).withColumn("name", F.col("name").cast("string")), "places")
    part = F.shiftright("at", 33)
    sizes = laid.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = laid.join(sizes, part == F.col("part")).select(F.collate("name", collation).alias("_name"), (F.col("before") + F.col("at") % (1 << 33) + 1).alias("place"))
    return rows.join(placed, name == F.col("_name"), "left").select("id", col, "place")
