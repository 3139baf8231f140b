"""Table schemas of the fleet-accounting data model as Spark types.

Unsigned integer keys become ``bigint``; ENUM columns become ``string`` with
an allowed-value list (see ``ENUMS``); money is ``decimal(12,2)``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)
DISTANCE = T.DecimalType(10, 2)
# Sum of money keeps Spark's natural widening: sum(decimal(12,2)) is decimal(22,2).
MONEY_SUM = T.DecimalType(22, 2)

# Allowed ENUM values, in declaration order, and their defaults.
ENUMS = {
    "period_type": (("day", "week"), "day"),
    "rental_billing_status": (("pending", "invoiced"), "pending"),
    "status": (("active", "inactive"), "active"),
    "role": (("admin", "driver"), "driver"),
    "report_period": (("day", "week", "month"), "week"),
    "status_filter": (("all", "pending", "invoiced"), "all"),
}


def _f(name, dtype, nullable=True):
    return T.StructField(name, dtype, nullable)


DRIVERS = T.StructType([
    _f("id", T.LongType(), False), _f("owner_user_id", T.LongType(), False),
    _f("full_name", T.StringType(), False), _f("phone", T.StringType()),
    _f("dni", T.StringType()), _f("status", T.StringType(), False),
    _f("notes", T.StringType()), _f("created_at", T.TimestampType()),
    _f("updated_at", T.TimestampType()),
])

CARS = T.StructType([
    _f("id", T.LongType(), False), _f("owner_user_id", T.LongType(), False),
    _f("brand", T.StringType(), False), _f("model", T.StringType(), False),
    _f("plate", T.StringType(), False), _f("year", T.IntegerType()),
    _f("status", T.StringType(), False), _f("current_driver_id", T.LongType()),
    _f("notes", T.StringType()), _f("created_at", T.TimestampType()),
    _f("updated_at", T.TimestampType()),
])

USERS = T.StructType([
    _f("id", T.LongType(), False), _f("full_name", T.StringType(), False),
    _f("username", T.StringType(), False), _f("role", T.StringType(), False),
    _f("driver_id", T.LongType()), _f("owner_user_id", T.LongType()),
    _f("is_active", T.IntegerType(), False), _f("last_login_at", T.TimestampNTZType()),
    _f("created_at", T.TimestampType()), _f("updated_at", T.TimestampType()),
])

DAILY_ENTRIES = T.StructType([
    _f("id", T.LongType(), False), _f("owner_user_id", T.LongType(), False),
    _f("period_type", T.StringType(), False), _f("entry_date", T.DateType(), False),
    _f("driver_id", T.LongType(), False), _f("car_id", T.LongType(), False),
    _f("gross_income", MONEY, False), _f("app_expenses", MONEY, False),
    _f("cash_collected", MONEY, False), _f("rental_amount", MONEY, False),
    _f("rental_billing_status", T.StringType(), False), _f("fuel_cost", MONEY, False),
    _f("distance_km", DISTANCE, False), _f("total_expenses", MONEY, False),
    _f("net_total", MONEY, False), _f("week_number", T.IntegerType(), False),
    _f("month_number", T.IntegerType(), False), _f("year_number", T.IntegerType(), False),
    _f("observations", T.StringType()), _f("created_by", T.LongType()),
    _f("updated_by", T.LongType()), _f("created_at", T.TimestampType()),
    _f("updated_at", T.TimestampType()),
])

GENERAL_EXPENSES = T.StructType([
    _f("id", T.LongType(), False), _f("owner_user_id", T.LongType(), False),
    _f("expense_date", T.DateType(), False), _f("amount", MONEY, False),
    _f("observations", T.StringType()), _f("created_by", T.LongType()),
    _f("updated_by", T.LongType()), _f("created_at", T.TimestampType()),
    _f("updated_at", T.TimestampType()),
])

WEEKLY_MONEY_NOTES = T.StructType([
    _f("id", T.LongType(), False), _f("owner_user_id", T.LongType(), False),
    _f("week_start", T.DateType(), False), _f("week_end", T.DateType(), False),
    _f("notes", T.StringType(), False), _f("created_by", T.LongType()),
    _f("updated_by", T.LongType()), _f("created_at", T.TimestampType()),
    _f("updated_at", T.TimestampType()),
])

_TOKEN = [
    _f("id", T.LongType(), False), _f("user_id", T.LongType(), False),
    _f("selector", T.StringType()), _f("user_agent", T.StringType()),
    _f("ip_address", T.StringType()), _f("expires_at", T.TimestampNTZType(), False),
    _f("used_at", T.TimestampNTZType()), _f("created_at", T.TimestampNTZType()),
]
REMEMBER_TOKENS = T.StructType(_TOKEN)
PASSWORD_RESETS = T.StructType(_TOKEN)
# Both kinds together, told apart by ``kind`` (remember, reset), as the token audits read them.
ACCESS_TOKENS = T.StructType([*_TOKEN, _f("kind", T.StringType(), False)])

TABLES = {
    "drivers": DRIVERS,
    "cars": CARS,
    "users": USERS,
    "daily_entries": DAILY_ENTRIES,
    "general_expenses": GENERAL_EXPENSES,
    "weekly_money_notes": WEEKLY_MONEY_NOTES,
    "remember_tokens": REMEMBER_TOKENS,
    "password_resets": PASSWORD_RESETS,
    "access_tokens": ACCESS_TOKENS,
}

# Unique keys of the data model (used by the constraint audits).
UNIQUE_KEYS = {
    "daily_entries": ("period_type", "entry_date", "driver_id", "car_id"),
    "drivers": ("owner_user_id", "dni"),
    "cars": ("owner_user_id", "plate"),
    "users": ("username",),
    "weekly_money_notes": ("owner_user_id", "week_start"),
}

# Entry amounts that a load carries; the rest of an entry row is derived.
ENTRY_AMOUNTS = ("gross_income", "app_expenses", "cash_collected", "rental_amount",
                 "fuel_cost", "distance_km")


class ForeignKey(NamedTuple):
    child: str
    column: str
    parent: str
    action: str  # on delete of the parent row: restrict, set_null or cascade


# The foreign keys of the data model and what they do when the parent row is deleted.
FOREIGN_KEYS = (
    ForeignKey("cars", "current_driver_id", "drivers", "set_null"),
    ForeignKey("users", "driver_id", "drivers", "set_null"),
    ForeignKey("access_tokens", "user_id", "users", "cascade"),
    ForeignKey("daily_entries", "driver_id", "drivers", "restrict"),
    ForeignKey("daily_entries", "car_id", "cars", "restrict"),
    ForeignKey("daily_entries", "created_by", "users", "set_null"),
    ForeignKey("daily_entries", "updated_by", "users", "set_null"),
    ForeignKey("general_expenses", "created_by", "users", "set_null"),
    ForeignKey("general_expenses", "updated_by", "users", "set_null"),
    ForeignKey("weekly_money_notes", "created_by", "users", "set_null"),
    ForeignKey("weekly_money_notes", "updated_by", "users", "set_null"),
)
