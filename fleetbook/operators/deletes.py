"""Deletes with their referential actions.

A batch asks for rows of several tables to go. Each request is a statement of
its own: it fails as a whole while a row that restricts it exists, otherwise the
row goes, rows that cascade from it go with it, and references to whatever went
are cleared. Requests on referring tables run before those on the tables they
refer to, so one batch can remove a driver's entries and then the driver.

The foreign keys form a small graph without cycles; for each table with requests
the graph is walked once. What travels is the requests' ids: children are found
by joins with them, and a large child table is read, filtered and rewritten
without a shuffle of its own where the ids are few enough to broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetbook.schemas import FOREIGN_KEYS

DELETED, RESTRICTED, NOT_FOUND = "deleted", "restricted", "not_found"


def delete_order(keys=FOREIGN_KEYS) -> list[str]:
    """Tables, referring ones before those they refer to."""
    tables = sorted({k.child for k in keys} | {k.parent for k in keys})
    out: list[str] = []
    while len(out) < len(tables):
        out += [t for t in tables if t not in out and all(k.child in out for k in keys if k.parent == t)]
    return out


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _cascaded(tables: dict[str, DataFrame], table: str, asked: DataFrame, keys) -> dict[str, DataFrame]:
    """Rows that would go, by table: (id, root), root being the requested id."""
    gone = {table: asked.select("id", F.col("id").alias("root"))}
    for parent in reversed(delete_order(keys)):
        for k in keys:
            if k.parent != parent or k.action != "cascade" or parent not in gone or k.child not in tables:
                continue
            up = gone[parent].select(F.col("id").alias(k.column), "root")
            down = tables[k.child].select("id", k.column).join(up, k.column).select("id", "root")
            gone[k.child] = _union([gone[k.child], down]) if k.child in gone else down
    return gone


def apply_deletes_of(tables: dict[str, DataFrame], table: str, requests: DataFrame, keys=FOREIGN_KEYS) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables afterwards, outcome of each requested id) of requests on one table."""
    asked = requests.select("id").distinct()
    found = tables[table].select("id").join(asked, "id", "left_semi")
    gone = _cascaded(tables, table, found, keys)
    holds = [
        tables[k.child].select(F.col(k.column).alias("id")).where("id is not null").distinct().join(gone[k.parent], "id").select("root")
        for k in keys if k.action == "restrict" and k.parent in gone and k.child in tables
    ]
    blocked = _union(holds).distinct() if holds else gone[table].select("root").limit(0)
    free = {t: rows.join(blocked, "root", "left_anti").select("id").distinct() for t, rows in gone.items()}
    after = dict(tables)
    for t, ids in free.items():
        after[t] = after[t].join(ids, "id", "left_anti").select(*tables[t].columns)
    for k in keys:
        if k.action != "set_null" or k.parent not in free or k.child not in tables or k.column not in tables[k.child].columns:
            continue
        hit = free[k.parent].select(F.col("id").alias("_gone_id"), F.lit(0).cast("bigint").alias("_gone_slot"))
        # rows without a reference (often many) match nothing: spread, or one task would hold them all
        slot = F.when(F.col(k.column).isNull(), F.xxhash64(*[F.col(c) for c in tables[k.child].columns])).otherwise(F.lit(0))
        rows = after[k.child].withColumn("_slot", slot)
        rows = rows.join(hit, (F.col(k.column) == F.col("_gone_id")) & (F.col("_slot") == F.col("_gone_slot")), "left")
        cleared = F.when(F.col("_gone_id").isNull(), F.col(k.column)).alias(k.column)
        after[k.child] = rows.select(*[cleared if c == k.column else F.col(c) for c in tables[k.child].columns])
    f, b = found.withColumn("_found", F.lit(True)), blocked.select(F.col("root").alias("id"), F.lit(True).alias("_blocked"))
    outcome = F.when(F.col("_found").isNull(), NOT_FOUND).when(F.col("_blocked").isNotNull(), RESTRICTED).otherwise(DELETED)
    said = asked.join(f, "id", "left").join(b, "id", "left").select(F.lit(table).alias("table_name"), "id", outcome.alias("outcome"))
    return after, said


def apply_delete_batch(tables: dict[str, DataFrame], requests: dict[str, DataFrame], keys=FOREIGN_KEYS) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables afterwards, outcomes) of a batch of requests, by table."""
    outcomes = []
    for table in delete_order(keys):
        if table in requests:
            tables, said = apply_deletes_of(tables, table, requests[table], keys)
            outcomes.append(said)
    return tables, _union(outcomes)
