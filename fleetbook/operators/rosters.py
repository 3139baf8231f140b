"""Rosters: drivers, cars and users with pre-aggregated statistics, pick lists.

Statistics are aggregated before they are joined (one row per driver / car),
so the joins that follow are dimension-sized. Lifetime statistics cover all
entries of a driver or car, whatever the owner; the outer dimension decides
which rows are shown. A roster reads the entries once: lifetime and period
sums are conditional sums of the same grouped aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetbook.functions import display as D
from fleetbook.functions.amounts import is_blank
from fleetbook.functions.periods import PeriodRange
from fleetbook.operators.filters import active_only, in_period, owner_scope, roster_scope
from fleetbook.operators.ranking import first_car
from fleetbook.schemas import MONEY_SUM
from fleetbook.scope import IntLike, Scope


def _z(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0).cast(MONEY_SUM)).alias(c)


def lifetime_stats(entries: DataFrame, key: str, *more: Column) -> DataFrame:
    """Entry count, sums and last date per driver or car (all owners, all
    time), and any ``more`` aggregates of the same groups."""
    return entries.groupBy(key).agg(
        F.count(F.lit(1)).alias("entries_count"),
        F.sum("gross_income").alias("income_total"),
        F.sum("total_expenses").alias("expenses_total"),
        F.sum("net_total").alias("net_total"),
        F.max("entry_date").alias("last_entry_date"),
        *more,
    )


def cars_per_driver(cars: DataFrame) -> DataFrame:
    """Active cars currently assigned, per driver: count and ordered labels.

    The label list is the feature (one text per driver listing its cars); it
    is built by an ordered string aggregate, partially combined per task.
    """
    c = active_only(cars).where(F.col("current_driver_id").isNotNull())
    labels = F.expr("listagg(concat(brand, ' ', model, ' - ', plate), ', ') "
                    "WITHIN GROUP (ORDER BY brand ASC, model ASC, plate ASC)")
    return c.groupBy("current_driver_id").agg(
        F.count(F.lit(1)).alias("cars_count"), labels.alias("car_labels"))


def driver_billing(entries: DataFrame, rng: PeriodRange, status: str = "pending") -> DataFrame:
    """Rental per driver in the period: selected status, pending, invoiced, total."""
    return in_period(entries, rng).groupBy("driver_id").agg(*billing_sums(F.lit(True), status))


def billing_sums(inside: Column, status: str) -> list[Column]:
    """The rental sums of the rows for which ``inside`` holds, by billing status."""
    st = F.col("rental_billing_status")
    r = F.when(inside, F.col("rental_amount"))
    selected = st == status if status in ("pending", "invoiced") else F.lit(True)
    zero = F.lit(0).cast("decimal(12,2)")
    return [
        F.sum(F.when(selected, r).otherwise(zero)).alias("rental_selected_total"),
        F.sum(F.when(st == "pending", r).otherwise(zero)).alias("rental_pending_total"),
        F.sum(F.when(st == "invoiced", r).otherwise(zero)).alias("rental_invoiced_total"),
        F.sum(r).alias("rental_total"),
    ]


def driver_roster(drivers: DataFrame, cars: DataFrame, entries: DataFrame, scope: Scope,
                  rng: PeriodRange, status: str = "pending") -> DataFrame:
    """Driver roster: scoped drivers with lifetime stats, assigned cars and
    billing of the selected period (default status: pending)."""
    d = roster_scope(drivers, scope, "drivers")
    inside = F.col("entry_date").between(F.lit(rng.start), F.lit(rng.end))
    stats = lifetime_stats(entries, "driver_id", *billing_sums(inside, status)).withColumnRenamed("driver_id", "_s_id")
    cpd = cars_per_driver(cars).withColumnRenamed("current_driver_id", "_c_id")
    out = (d.join(stats, d.id == stats._s_id, "left")
            .join(cpd, d.id == cpd._c_id, "left"))
    return (out.select(
        *[d[x] for x in d.columns],
        F.coalesce("entries_count", F.lit(0)).cast("bigint").alias("entries_count"),
        _z("income_total"), _z("expenses_total"), _z("net_total"), "last_entry_date",
        F.coalesce("cars_count", F.lit(0)).cast("bigint").alias("cars_count"), "car_labels",
        _z("rental_selected_total"), _z("rental_pending_total"),
        _z("rental_invoiced_total"), _z("rental_total"),
        D.label_of("status", D.ACTIVE_LABELS).alias("status_label"),
        *([D.fallback("phone", D.EMPTY_DASH).alias("phone_label")] if "phone" in d.columns else []),
        D.fallback("dni", D.EMPTY_DASH).alias("dni_label"),
        D.fallback("car_labels", D.EMPTY_DASH).alias("car_labels_label"))
        .orderBy("status", "full_name"))


def billing_totals(roster: DataFrame) -> DataFrame:
    """Totals of the billing columns over a driver roster (one row)."""
    cols = ("rental_selected_total", "rental_pending_total", "rental_invoiced_total", "rental_total")
    return roster.agg(*[F.coalesce(F.sum(c), F.lit(0).cast(MONEY_SUM)).cast(MONEY_SUM).alias(c)
                        for c in cols])


def car_roster(cars: DataFrame, drivers: DataFrame, entries: DataFrame, scope: Scope) -> DataFrame:
    """Car roster: scoped cars, current driver of the same owner, lifetime stats."""
    c = roster_scope(cars, scope, "cars")
    d = drivers.select(F.col("id").alias("_d_id"), F.col("owner_user_id").alias("_d_owner"),
                       F.col("full_name").alias("driver_name"))
    stats = (lifetime_stats(entries, "car_id").drop("last_entry_date")
             .withColumnRenamed("car_id", "_s_id"))
    out = (c.join(d, (d._d_id == c.current_driver_id) & (d._d_owner == c.owner_user_id), "left")
            .join(stats, c.id == stats._s_id, "left"))
    return (out.select(
        *[c[x] for x in c.columns], "driver_name",
        F.coalesce("entries_count", F.lit(0)).cast("bigint").alias("entries_count"),
        _z("income_total"), _z("expenses_total"), _z("net_total"),
        D.label_of("status", D.ACTIVE_LABELS).alias("status_label"),
        *([D.fallback("year", D.EMPTY_DASH).alias("year_label")] if "year" in c.columns else []),
        D.fallback("driver_name", D.NO_DRIVER).alias("driver_label"))
        .orderBy("status", "brand", "model", "plate"))


def user_roster(users: DataFrame, drivers: DataFrame, owner: IntLike) -> DataFrame:
    """Users of an owner with their linked driver (only a driver of the same owner)."""
    u = owner_scope(users, owner)
    d = drivers.select(F.col("id").alias("_d_id"), F.col("owner_user_id").alias("_d_owner"),
                       F.col("full_name").alias("driver_name"))
    out = u.join(d, (d._d_id == u.driver_id) & (d._d_owner == u.owner_user_id), "left")
    return (out.select(
        *[u[x] for x in u.columns], "driver_name",
        D.label_of("role", D.ROLE_LABELS).alias("role_label"),
        F.when(F.col("is_active") == 1, F.lit(D.ACTIVE_LABELS["active"]))
        .otherwise(F.lit(D.ACTIVE_LABELS["inactive"])).alias("active_label"),
        D.fallback("driver_name", D.EMPTY_DASH).alias("driver_label"))
        .orderBy(F.col("is_active").desc(), F.col("role").asc(), F.col("full_name").asc()))


def assignable_cars(cars: DataFrame, drivers: DataFrame, owner: IntLike,
                    editing_driver_id: IntLike | None = None) -> DataFrame:
    """Active cars of an owner offered when assigning a car to a driver.

    Each car carries its current driver (same owner only). The label is
    ``brand model - plate`` with ``(asignado a X)`` added when the car is held
    by a driver and is not the car selected for the driver being edited (the
    first of that driver's cars in label order).
    """
    c = active_only(owner_scope(cars, owner))
    d = drivers.select(F.col("id").alias("_d_id"), F.col("owner_user_id").alias("_d_owner"),
                       F.col("full_name").alias("driver_name"))
    out = c.join(d, (d._d_id == c.current_driver_id) & (d._d_owner == c.owner_user_id), "left")
    if editing_driver_id is None:
        selected = F.lit(False)
    else:
        ed = editing_driver_id if isinstance(editing_driver_id, Column) else F.lit(editing_driver_id)
        sel = (first_car(cars, owner).where(F.col("current_driver_id") == ed)
               .select(F.col("car_id").alias("_sel_id")))
        out = out.join(sel, out.id == sel._sel_id, "left")
        selected = F.col("_sel_id").isNotNull()
    base = F.concat(F.trim(F.concat(F.col("brand"), F.lit(" "), F.col("model"))),
                    F.lit(" - "), F.col("plate"))
    held = ~selected & ~is_blank("driver_name")
    label = F.when(held, F.concat(base, F.lit(" (asignado a "), F.col("driver_name"), F.lit(")"))
                   ).otherwise(base)
    return (out.select("id", "brand", "model", "plate", "current_driver_id", "driver_name",
                       selected.alias("is_selected"), label.alias("label"))
               .orderBy("brand", "model", "plate"))


def driver_cars(cars: DataFrame, entries: DataFrame, driver_id: IntLike) -> DataFrame:
    """Distinct cars a driver holds now or has ever driven (any owner).

    Written as two branches (current holder; left-semi join with the
    driver's entries) and a distinct union, instead of a left join with an
    OR across both sides, so each branch filters before it joins.
    """
    d = driver_id if isinstance(driver_id, Column) else F.lit(driver_id)
    now = cars.where(F.col("current_driver_id") == d)
    driven = entries.where(F.col("driver_id") == d).select(F.col("car_id"))
    ever = cars.join(driven, cars.id == driven.car_id, "left_semi")
    return (now.unionByName(ever)
               .select("id", D.car_label().alias("label"))
               .distinct()
               .orderBy("label"))


def pick_drivers(drivers: DataFrame, scope: Scope, only_active: bool = False) -> DataFrame:
    """Driver pick list: an admin's drivers by name; a driver user's own row."""
    d = active_only(drivers) if only_active else drivers
    if scope.is_admin:
        d = owner_scope(d, scope.owner_user_id)
    else:
        linked = scope.linked_driver_id
        if linked is None:
            d = d.where(F.lit(False))
        else:
            d = d.where(F.col("id") == (linked if isinstance(linked, Column) else F.lit(linked)))
    return d.select("id", "full_name").orderBy("full_name")


def pick_cars(cars: DataFrame, entries: DataFrame, scope: Scope, for_form: bool = False) -> DataFrame:
    """Car pick list.

    Admin: the owner's cars (active only on the load form) by brand, model.
    Driver user: on the load form, active cars currently assigned to it; on
    reports, every car it holds or has driven. Unlinked: nothing.
    """
    if scope.is_admin:
        c = active_only(cars) if for_form else cars
        c = owner_scope(c, scope.owner_user_id)
        return c.select("id", D.car_label().alias("label"), "brand", "model").orderBy("brand", "model") \
                .drop("brand", "model")
    linked = scope.linked_driver_id
    if linked is None:
        return cars.where(F.lit(False)).select("id", D.car_label().alias("label"))
    if for_form:
        ld = linked if isinstance(linked, Column) else F.lit(linked)
        c = active_only(cars).where(F.col("current_driver_id") == ld)
        return c.select("id", D.car_label().alias("label"), "brand", "model").orderBy("brand", "model") \
                .drop("brand", "model")
    return driver_cars(cars, entries, linked)
