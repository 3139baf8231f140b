"""Stored fleet tables: read, write, stage.

* ``read_jdbc`` reads a table from the relational source in parallel: the
  id range is split into ``num_partitions`` slices read by separate tasks
  (``partitionColumn``/``lowerBound``/``upperBound``), with filters and
  column pruning pushed into the generated SQL by Spark.
* ``write_table`` writes a table as parquet; entries lie in a folder per
  month of ``entry_date`` (a column of the writer's own, not shown to readers),
  so a file's date statistics span one month and a date filter skips the
  row groups of other months; rows are sorted by tenant inside the files, so
  tenant filters skip row groups.
* ``rewrite_months`` applies a batch of changes to a stored table by rewriting
  only the month folders that it touches, once, however often the job is retried.
* ``StagedTables`` serves the stored tables to the same query bodies that
  run on the test-data derivations.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetbook.schemas import TABLES
from fleetbook.session import checkpoint_dir
from fleetbook.sources.fixtures import TestdataTables

# Tables stored in a folder per month, and by the month of which column.
PARTITIONING = {"daily_entries": "entry_date", "entries_unique": "entry_date", "entries": "entry_date"}
# The writer's own column that names the folder.
FOLDER = "stored_month"
# Row order inside each file: tenant first, so parquet row-group statistics
# let a tenant filter skip other tenants' row groups, then driver / date.
CLUSTERING = {
    "daily_entries": ("owner_user_id", "driver_id", "entry_date"),
    "entries_unique": ("owner_user_id", "driver_id", "entry_date"),
    "entries": ("owner_user_id", "driver_id", "entry_date"),
    "general_expenses": ("owner_user_id", "expense_date"),
    "drivers": ("owner_user_id", "id"),
    "cars": ("owner_user_id", "id"),
    "users": ("owner_user_id", "id"),
}

FLEET_TABLES = ("drivers", "cars", "users", "daily_entries", "entries_unique", "general_expenses",
                "weekly_money_notes", "access_tokens", "legacy_entries")


def read_jdbc(spark: SparkSession, url: str, table: str, props: dict[str, str],
              lower: int, upper: int, num_partitions: int, id_col: str = "id") -> DataFrame:
    """Parallel JDBC read of one table, cast to the data model's types."""
    df = spark.read.jdbc(url, table, column=id_col, lowerBound=lower, upperBound=upper,
                         numPartitions=num_partitions, properties=props)
    schema = TABLES.get(table)
    if schema is None:
        return df
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields if f.name in df.columns]
    return df.select(*cols)


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Read a stored table; columns that the data model declares get their declared types."""
    df = spark.read.parquet(f"{path}/{name}").drop(FOLDER)
    declared = {f.name: f.dataType for f in TABLES[name].fields} if name in TABLES else {}
    return df.select(*[F.col(c).cast(declared[c]).alias(c) if c in declared and declared[c] != kind else F.col(c)
                       for c, kind in ((f.name, f.dataType) for f in df.schema.fields)])


def write_table(df: DataFrame, path: str, name: str, mode: str = "overwrite", options: dict[str, str] | None = None) -> None:
    """Write a table as parquet, partitioned where the data model says so.

    A ``REBALANCE`` on the partition columns groups each folder's rows into
    few tasks, and adaptive execution splits a folder that is too big (a
    busy month) over several tasks and merges small ones, so files stay near
    the advisory size instead of one file per task per folder or one task
    per month. Within files, rows are sorted by ``CLUSTERING``.
    """
    month_of = PARTITIONING.get(name)
    parts = [FOLDER] if month_of in df.columns else []
    if parts:
        df = df.withColumn(FOLDER, F.date_format(month_of, "yyyy-MM"))
    order = [c for c in CLUSTERING.get(name, ()) if c in df.columns]
    out = df.hint("rebalance", *parts) if parts else df.hint("rebalance")
    if order:
        out = out.sortWithinPartitions(*order)
    writer = out.write.mode(mode).options(**(options or {}))
    if parts:
        writer = writer.partitionBy(*parts)
    writer.parquet(f"{path}/{name}")


def _there(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def touched_months(judged: DataFrame, entries: DataFrame) -> DataFrame:
    """Months (``yyyy-MM``) of a judged batch of entry edits: those that its accepted edits
    move entries from and to. ``entries`` are the stored ones before the batch."""
    ok = judged.where(F.col("reasons") == "")
    left = entries.select("id", "entry_date").join(ok.select("id").distinct(), "id", "left_semi")
    both = ok.select("entry_date").unionByName(left.select("entry_date"))
    return both.select(F.date_format("entry_date", "yyyy-MM").alias(FOLDER)).distinct()


def rewrite_months(spark: SparkSession, path: str, name: str, batch_id: str, months: DataFrame,
                   change: Callable[[DataFrame], DataFrame]) -> bool:
    """Apply ``change`` to the stored rows of ``months`` and rewrite these month folders only.

    Two steps, each safe to repeat. The new rows of the months are first written
    beside the table, under the batch's id; this step is complete when Spark has
    committed it, and a retry does not compute it again, so a change that depends on
    the stored rows sees each of them once. Then they replace the months'
    folders (dynamic partition overwrite; a month that has no rows left is
    removed), which a retry does with the same rows. A marker ends the batch:
    applying its id again changes nothing. False: it had been applied before.

    ``months`` is one row per month, collected for partition pruning; the
    table's other folders are neither read nor written.
    """
    spot = f"{path}/_batches/{name}/{batch_id}"
    if _there(spark, f"{spot}/applied/_SUCCESS"):
        return False
    if not _there(spark, f"{spot}/rows/_SUCCESS"):
        months.coalesce(1).write.mode("overwrite").parquet(f"{spot}/months")
        wanted = [r[0] for r in spark.read.parquet(f"{spot}/months").collect()]
        stored = spark.read.parquet(f"{path}/{name}")
        part = stored.where(F.col(FOLDER).cast("string").isin(wanted)) if wanted else stored.where(F.lit(False))
        change(part.drop(FOLDER)).write.mode("overwrite").parquet(f"{spot}/rows")
    wanted = {r[0] for r in spark.read.parquet(f"{spot}/months").collect()}
    rows = spark.read.parquet(f"{spot}/rows")
    full = {r[0] for r in rows.select(F.date_format(PARTITIONING[name], "yyyy-MM")).distinct().collect()}
    if not full <= wanted:
        raise ValueError(f"batch {batch_id} writes months it does not name: {sorted(full - wanted)}")
    write_table(rows, path, name, options={"partitionOverwriteMode": "dynamic"})
    for month in wanted - full:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/{FOLDER}={month}")
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    spark.range(1).write.mode("overwrite").parquet(f"{spot}/applied")
    return True


def stage_fleet_tables(tables: TestdataTables, path: str | None = None,
                       names=FLEET_TABLES) -> str:
    """Write the derived fleet tables once (under the shared checkpoint folder
    by default) and return the folder."""
    path = path or f"{checkpoint_dir(tables.spark).rstrip('/')}/fleet_tables"
    for name in names:
        write_table(getattr(tables, name), path, name)
    return path


class StagedTables(TestdataTables):
    """Fleet tables read from stored parquet; raw test tables (for the input
    batches) still come from ``sf_dir``."""

    def __init__(self, spark: SparkSession, sf_dir: str, path: str):
        super().__init__(spark, sf_dir)
        self.path = path.rstrip("/")

    def _t(self, name: str) -> DataFrame:
        return read_table(self.spark, self.path, name)

    @cached_property
    def drivers(self) -> DataFrame:
        return self._t("drivers")

    @cached_property
    def cars(self) -> DataFrame:
        return self._t("cars")

    @cached_property
    def users(self) -> DataFrame:
        return self._t("users")

    @cached_property
    def daily_entries(self) -> DataFrame:
        return self._t("daily_entries")

    @cached_property
    def entries_unique(self) -> DataFrame:
        return self._t("entries_unique")

    @cached_property
    def general_expenses(self) -> DataFrame:
        return self._t("general_expenses")

    @cached_property
    def weekly_money_notes(self) -> DataFrame:
        return self._t("weekly_money_notes")

    @cached_property
    def access_tokens(self) -> DataFrame:
        return self._t("access_tokens")

    @cached_property
    def legacy_entries(self) -> DataFrame:
        return self._t("legacy_entries")

    @cached_property
    def supplier_count(self) -> Column:
        return self.raw("supplier").select(F.count(F.lit(1))).scalar()

    @cached_property
    def customer_count(self) -> Column:
        return self.raw("customer").select(F.count(F.lit(1))).scalar()
