"""Backfills: schema evolution, legacy cost folding and tenant-owner inference.

They run in this order, each reading the previous one's output: users (B4),
then drivers and cars (B5), entries (B6), driver users (B7) and expenses
(B8). Statement semantics are kept: assignments within one update run left
to right (B3 reads the new total), and the owner inference takes the
smallest candidate tenant per driver or car.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetbook.schemas import MONEY

LEGACY_COSTS = ("wash_cost", "tolls_cost", "maintenance_cost", "other_expenses")

# Columns a migration adds when they are missing, with defaults.
ENTRY_COLUMN_DEFAULTS = (
    ("period_type", "'day'"),
    ("app_expenses", "CAST(0 AS DECIMAL(12,2))"),
    ("cash_collected", "CAST(0 AS DECIMAL(12,2))"),
    ("rental_amount", "CAST(0 AS DECIMAL(12,2))"),
    ("rental_billing_status", "'pending'"),
    ("fuel_cost", "CAST(0 AS DECIMAL(12,2))"),
    ("distance_km", "CAST(0 AS DECIMAL(10,2))"),
    ("total_expenses", "CAST(0 AS DECIMAL(12,2))"),
    ("net_total", "CAST(0 AS DECIMAL(12,2))"),
)
# Named accounts of the workspace migration.
ADMIN_USERNAME = "admin"
PERSONAL_USERNAME = "personal"
DEMO_DRIVER_USERNAME = "chofer"
DEMO_DRIVER_NAME = "Chofer Demo"
DEMO_PLATE = "AA000AA"
DEFAULT_ADMIN_ID = 1


def evolve_schema(df: DataFrame, defaults=ENTRY_COLUMN_DEFAULTS) -> DataFrame:
    """Add each missing column with its default; existing columns are kept."""
    for name, expr in defaults:
        if name not in df.columns:
            df = df.withColumn(name, F.expr(expr))
    return df


def _zero() -> Column:
    return F.lit(0).cast(MONEY)


def fold_legacy_costs(df: DataFrame) -> DataFrame:
    """Normalise an evolved entry table and fold the four legacy cost columns.

    Runs only when all four legacy columns exist; otherwise it is the plain
    clean-up of ``clean_entries``. Zero app expenses / total expenses take
    the legacy sum; a zero net becomes gross minus the legacy sum.
    """
    if not set(LEGACY_COSTS) <= set(df.columns):
        return clean_entries(df)
    legacy = (F.coalesce("wash_cost", _zero()) + F.coalesce("tolls_cost", _zero())
              + F.coalesce("maintenance_cost", _zero()) + F.coalesce("other_expenses", _zero()))
    return (df.withColumn("period_type", F.when(F.col("period_type") == "week", "week").otherwise("day"))
              .withColumn("app_expenses", F.when(F.col("app_expenses") == 0, legacy)
                          .otherwise(F.col("app_expenses")).cast(MONEY))
              .withColumn("cash_collected", F.coalesce("cash_collected", _zero()))
              .withColumn("rental_amount", F.coalesce("rental_amount", _zero()))
              .withColumn("rental_billing_status",
                          F.when(F.col("rental_billing_status") == "invoiced", "invoiced").otherwise("pending"))
              .withColumn("distance_km", F.coalesce("distance_km", F.lit(0).cast("decimal(10,2)")))
              .withColumn("total_expenses", F.when(F.col("total_expenses") == 0, legacy)
                          .otherwise(F.col("total_expenses")).cast(MONEY))
              .withColumn("net_total", F.when(F.col("net_total") == 0, F.col("gross_income") - legacy)
                          .otherwise(F.col("net_total")).cast(MONEY)))


def clean_entries(df: DataFrame) -> DataFrame:
    """Clean-up without legacy columns; assignments apply left to right, so a
    zero net becomes gross minus the already cleaned total."""
    return (df.withColumn("period_type", F.when(F.col("period_type") == "week", "week").otherwise("day"))
              .withColumn("app_expenses", F.coalesce("app_expenses", _zero()))
              .withColumn("cash_collected", F.coalesce("cash_collected", _zero()))
              .withColumn("rental_amount", F.coalesce("rental_amount", _zero()))
              .withColumn("rental_billing_status",
                          F.when(F.col("rental_billing_status") == "invoiced", "invoiced").otherwise("pending"))
              .withColumn("distance_km", F.coalesce("distance_km", F.lit(0).cast("decimal(10,2)")))
              .withColumn("total_expenses", F.coalesce("total_expenses", _zero()))
              .withColumn("net_total", F.when(F.col("net_total") == 0,
                                              F.col("gross_income") - F.col("total_expenses"))
                          .otherwise(F.col("net_total")).cast(MONEY)))


def _named_id(users: DataFrame, username: str) -> Column:
    """Smallest id of the user with this username, as a scalar subquery."""
    return users.where(F.col("username") == username).select(F.min("id")).scalar()


def admin_id(users: DataFrame) -> Column:
    return F.coalesce(_named_id(users, ADMIN_USERNAME), F.lit(DEFAULT_ADMIN_ID).cast("bigint"))


def backfill_users(users: DataFrame) -> DataFrame:
    """A user without owner owns itself; the personal account owns itself;
    the demo admin and demo driver belong to the admin."""
    adm, personal = admin_id(users), _named_id(users, PERSONAL_USERNAME)
    owner = F.coalesce(F.col("owner_user_id"), F.col("id"))
    owner = F.when((F.col("username") == PERSONAL_USERNAME) & personal.isNotNull(), personal).otherwise(owner)
    owner = F.when(F.col("username").isin(ADMIN_USERNAME, DEMO_DRIVER_USERNAME), adm).otherwise(owner)
    return users.withColumn("owner_user_id", owner.cast("bigint"))


def inferred_owners(entries: DataFrame, users: DataFrame, key: str, adm: Column) -> DataFrame:
    """Per driver or car: the smallest tenant among the creators of its entries
    (a creator's owner, else the creator id, else the admin)."""
    u = users.select(F.col("id").alias("_u_id"), F.col("owner_user_id").alias("_u_owner"))
    e = entries.where(F.col("created_by").isNotNull())
    e = e.join(u, e.created_by == u._u_id, "left")
    cand = F.coalesce(F.col("_u_owner"), F.col("created_by"), adm)
    return e.groupBy(F.col(key).alias("_o_key")).agg(F.min(cand).alias("_o_owner"))


def backfill_dimension(dim: DataFrame, entries: DataFrame, users: DataFrame, key: str,
                       demo_col: str, demo_value: str) -> DataFrame:
    adm = admin_id(users)
    owners = inferred_owners(entries, users, key, adm)
    j = dim.join(owners, dim.id == owners._o_key, "left")
    owner = F.coalesce(F.col("_o_owner"), adm)
    owner = F.when(F.col(demo_col) == demo_value, adm).otherwise(owner)
    return j.select(*[owner.cast("bigint").alias(c) if c == "owner_user_id" else dim[c] for c in dim.columns])


def backfill_drivers(drivers, entries, users) -> DataFrame:
    """Driver owners inferred from the creators of their entries."""
    return backfill_dimension(drivers, entries, users, "driver_id", "full_name", DEMO_DRIVER_NAME)


def backfill_cars(cars, entries, users) -> DataFrame:
    """Car owners inferred from the creators of their entries."""
    return backfill_dimension(cars, entries, users, "car_id", "plate", DEMO_PLATE)


def _with_creator(rows: DataFrame, u: DataFrame) -> DataFrame:
    """Rows with their creator's ``_u_owner``. Rows without a creator (many,
    and all one key) are routed around the join."""
    made = rows.where(F.col("created_by").isNotNull()).join(u, F.col("created_by") == u._u_id, "left").drop("_u_id")
    none = rows.where(F.col("created_by").isNull()).withColumn("_u_owner", F.lit(None).cast("bigint"))
    return made.unionByName(none)


def backfill_entries(entries: DataFrame, users: DataFrame, drivers: DataFrame) -> DataFrame:
    """Entry owner: the creator's owner, else the driver's owner, else the admin."""
    u = users.select(F.col("id").alias("_u_id"), F.col("owner_user_id").alias("_u_owner"))
    d = drivers.select(F.col("id").alias("_d_id"), F.col("owner_user_id").alias("_d_owner"))
    j = _with_creator(entries, u).join(d, F.col("driver_id") == d._d_id, "left")
    owner = F.coalesce(F.col("_u_owner"), F.col("_d_owner"), admin_id(users)).cast("bigint")
    return j.select(*[owner.alias(c) if c == "owner_user_id" else F.col(c) for c in entries.columns])


def backfill_driver_users(users: DataFrame, drivers: DataFrame) -> DataFrame:
    """A driver user linked to an existing driver takes the driver's owner."""
    d = drivers.select(F.col("id").alias("_d_id"), F.col("owner_user_id").alias("_d_owner"))
    j = users.join(d, users.driver_id == d._d_id, "left")
    take = (F.col("role") == "driver") & F.col("_d_id").isNotNull()
    owner = F.when(take, F.col("_d_owner")).otherwise(F.col("owner_user_id")).cast("bigint")
    return j.select(*[owner.alias(c) if c == "owner_user_id" else users[c] for c in users.columns])


def backfill_expenses(expenses: DataFrame, users: DataFrame) -> DataFrame:
    """Expense owner: the creator's owner, else the admin."""
    u = users.select(F.col("id").alias("_u_id"), F.col("owner_user_id").alias("_u_owner"))
    j = _with_creator(expenses, u)
    owner = F.coalesce(F.col("_u_owner"), admin_id(users)).cast("bigint")
    return j.select(*[owner.alias(c) if c == "owner_user_id" else F.col(c) for c in expenses.columns])


def workspace_migration(users, drivers, cars, entries, expenses) -> dict[str, DataFrame]:
    """The whole owner backfill, in statement order."""
    u1 = backfill_users(users)
    d1 = backfill_drivers(drivers, entries, u1)
    c1 = backfill_cars(cars, entries, u1)
    e1 = backfill_entries(entries, u1, d1)
    u2 = backfill_driver_users(u1, d1)
    x1 = backfill_expenses(expenses, u2)
    return {"users": u2, "drivers": d1, "cars": c1, "daily_entries": e1, "general_expenses": x1}
