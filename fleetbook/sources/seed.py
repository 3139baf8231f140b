"""The demo rows of a fresh installation, as inline DataFrames.

Week number, month, year and the note's Monday are derived from ``today``
by the same period expressions the jobs use (ISO week, calendar month and
year, Monday of the ISO week). Password hashes are never loaded.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetbook.functions import periods as P

# The installation's demo rows.
SEED_DRIVERS = [(1, 1, "Chofer Demo", "+54 11 0000-0000", "00000000", "active",
                 "Registro demo para probar el rol chofer.")]
SEED_CARS = [(1, 1, "Toyota", "Etios", "AA000AA", 2020, "active", 1, "Auto demo asignado al chofer demo.")]
SEED_USERS = [(1, "Administrador", "admin", "admin", None, 1, 1),
              (2, "Usuario Personal", "personal", "admin", None, 2, 1),
              (3, "Chofer Demo", "chofer", "driver", 1, 1, 1)]
SEED_ENTRY = (1, 1, "day", 1, 1, "85000", "3000", "18000", "7000", "pending", "22000", "180.50", "28000", "57000",
              "Carga diaria demo.", 1, 1)
SEED_EXPENSE = (1, 1, "12000", "Gasto de flota demo.", 1, 1)
SEED_NOTE = (1, 1, "Demo: se registro el destino del dinero semanal para controlar alquileres, gastos de flota y "
                   "saldo disponible.", 1, 1)


def seed_tables(spark: SparkSession, today: dt.date) -> dict[str, DataFrame]:
    drivers = spark.createDataFrame(SEED_DRIVERS, "id long, owner_user_id long, full_name string, phone string, "
                                                  "dni string, status string, notes string")
    cars = spark.createDataFrame(SEED_CARS, "id long, owner_user_id long, brand string, model string, plate string, "
                                            "year int, status string, current_driver_id long, notes string")
    users = spark.createDataFrame(SEED_USERS, "id long, full_name string, username string, role string, "
                                              "driver_id long, owner_user_id long, is_active int")
    (eid, owner, ptype, drv, car, gross, app, cash, rental, status, fuel, km, total, net, obs, cb, ub) = SEED_ENTRY
    entries = spark.createDataFrame(
        [(eid, owner, ptype, today, drv, car, Decimal(gross), Decimal(app), Decimal(cash), Decimal(rental), status,
          Decimal(fuel), Decimal(km), Decimal(total), Decimal(net), obs, cb, ub)],
        "id long, owner_user_id long, period_type string, entry_date date, driver_id long, car_id long, "
        "gross_income decimal(12,2), app_expenses decimal(12,2), cash_collected decimal(12,2), "
        "rental_amount decimal(12,2), rental_billing_status string, fuel_cost decimal(12,2), "
        "distance_km decimal(10,2), total_expenses decimal(12,2), net_total decimal(12,2), observations string, "
        "created_by long, updated_by long")
    entries = P.with_period_columns(entries)
    xid, xowner, amount, xobs, xcb, xub = SEED_EXPENSE
    expenses = spark.createDataFrame([(xid, xowner, today, Decimal(amount), xobs, xcb, xub)],
                                     "id long, owner_user_id long, expense_date date, amount decimal(12,2), "
                                     "observations string, created_by long, updated_by long")
    nid, nowner, text, ncb, nub = SEED_NOTE
    notes = (spark.createDataFrame([(nid, nowner, today, text, ncb, nub)],
                                   "id long, owner_user_id long, d date, notes string, created_by long, updated_by long")
             .select("id", "owner_user_id", P.week_start_of("d").alias("week_start"),
                     F.date_add(P.week_start_of("d"), 6).alias("week_end"), "notes", "created_by", "updated_by"))
    return {"drivers": drivers, "cars": cars, "users": users, "daily_entries": entries,
            "general_expenses": expenses, "weekly_money_notes": notes}
