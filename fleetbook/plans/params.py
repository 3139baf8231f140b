"""Request parameters of the registered queries (one report session each).

Fixed values chosen for the checks: tenant 1, March 1997 (inside the
1995-2001 span of the test data), week 1997-W10, and as the driver the
smallest driver id of tenant 1 (a scalar subquery, so it follows the data).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetbook.functions.periods import period_range

OWNER = 1
AS_OF = dt.date(1997, 3, 5)
DAY = "1997-03-05"
WEEK = "1997-W10"
MONTH = "1997-03"
TOKENS_AS_OF = dt.datetime(2024, 2, 15, 0, 0, 0)

MONTH_RANGE = period_range("month", month=MONTH, as_of=AS_OF)
WEEK_RANGE = period_range("week", week=WEEK, as_of=AS_OF)
DAY_RANGE = period_range("day", date=DAY, as_of=AS_OF)


def first_driver_of_owner(drivers, owner: int = OWNER) -> Column:
    """Smallest driver id of an owner, as a lazy scalar subquery."""
    return drivers.where(F.col("owner_user_id") == owner).select(F.min("id")).scalar()


def first_holder_of_owner(drivers, cars, owner: int = OWNER) -> Column:
    """Smallest id of an owner's drivers that currently hold a car (scalar subquery)."""
    mine = drivers.where(F.col("owner_user_id") == owner).select(F.col("id").alias("_h_id"))
    held = cars.join(mine, cars.current_driver_id == mine._h_id, "left_semi")
    return held.select(F.min("current_driver_id")).scalar()


# SQL text of the same parameters for the DuckDB oracle.
SQL_DRIVER = f"(SELECT MIN(id) FROM drivers WHERE owner_user_id = {OWNER})"
SQL_MONTH = f"DATE '{MONTH_RANGE.start_s}' AND DATE '{MONTH_RANGE.end_s}'"
SQL_WEEK = f"DATE '{WEEK_RANGE.start_s}' AND DATE '{WEEK_RANGE.end_s}'"
SQL_DAY = f"DATE '{DAY_RANGE.start_s}' AND DATE '{DAY_RANGE.end_s}'"
SQL_HOLDER = (f"(SELECT MIN(c.current_driver_id) FROM cars c JOIN drivers d ON d.id = c.current_driver_id "
              f"WHERE d.owner_user_id = {OWNER})")
