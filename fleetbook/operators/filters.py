"""Row filters: tenant scope, entry scope, period, billing status, activity.

Every filter is a Column predicate built from literals when the parameters
are Python scalars, so Catalyst folds contradictions (owner <= 0, unlinked
driver user) into an empty relation and pushes the rest into the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetbook.functions.periods import PeriodRange
from fleetbook.scope import IntLike, Scope


def owner_predicate(owner: IntLike, col: str = "owner_user_id") -> Column:
    """Tenant filter; an owner <= 0 (no session tenant) matches nothing."""
    if isinstance(owner, Column):
        return F.when(owner > 0, F.col(col) == owner).otherwise(F.lit(False))
    if owner is None or owner <= 0:
        return F.lit(False)
    return F.col(col) == F.lit(owner)


def owner_scope(df: DataFrame, owner: IntLike, col: str = "owner_user_id") -> DataFrame:
    return df.where(owner_predicate(owner, col))


def _id_predicate(value: IntLike, col: str) -> Column:
    """Negative id: nothing; positive id: equality; zero: everything."""
    if isinstance(value, Column):
        return (F.when(value < 0, F.lit(False))
                .when(value > 0, F.col(col) == value)
                .otherwise(F.lit(True)))
    if value < 0:
        return F.lit(False)
    if value > 0:
        return F.col(col) == F.lit(value)
    return F.lit(True)


def entry_predicate(scope: Scope, driver_col: str = "driver_id", car_col: str = "car_id",
                    owner_col: str = "owner_user_id") -> Column:
    """Entry scope: the owner filter applies to admins only; a driver user is
    scoped by its driver alone. Requested car ids <= 0 mean all cars."""
    pred = owner_predicate(scope.owner_user_id, owner_col) if scope.is_admin else F.lit(True)
    pred = pred & _id_predicate(scope.resolved_driver(), driver_col)
    car = scope.resolved_car()
    if car > 0:
        pred = pred & (F.col(car_col) == F.lit(car))
    return pred


def entry_scope(df: DataFrame, scope: Scope) -> DataFrame:
    return df.where(entry_predicate(scope))


def in_period(df: DataFrame, rng: PeriodRange, col: str = "entry_date") -> DataFrame:
    """Inclusive date range (``BETWEEN start AND end``)."""
    return df.where(F.col(col).between(F.lit(rng.start), F.lit(rng.end)))


def by_billing_status(df: DataFrame, status: str) -> DataFrame:
    """``all`` keeps every row; ``pending`` / ``invoiced`` filter on equality."""
    if status in ("pending", "invoiced"):
        return df.where(F.col("rental_billing_status") == F.lit(status))
    return df


def active_only(df: DataFrame) -> DataFrame:
    """Active dimension rows: ``status = 'active'`` or ``is_active = 1``."""
    if "status" in df.columns:
        return df.where(F.col("status") == "active")
    return df.where(F.col("is_active") == 1)


def billable(df: DataFrame) -> DataFrame:
    """Entries whose billing status may change (rental > 0)."""
    return df.where(F.col("rental_amount") > 0)


def roster_scope(df: DataFrame, scope: Scope, kind: str) -> DataFrame:
    """Dimension scope of a roster.

    Admins see their owner's rows. A driver user sees its own driver row
    (``kind='drivers'``) or the cars currently assigned to it
    (``kind='cars'``); an unlinked driver user sees nothing.
    """
    if scope.is_admin:
        return owner_scope(df, scope.owner_user_id)
    driver = scope.resolved_driver()
    col = "id" if kind == "drivers" else "current_driver_id"
    if isinstance(driver, Column):
        return df.where(F.when(driver < 0, F.lit(False)).otherwise(F.col(col) == driver))
    if driver < 0:
        return df.where(F.lit(False))
    return df.where(F.col(col) == F.lit(driver))
