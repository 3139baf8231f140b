"""Period rollups of the report page and fleet net results.

All are grouped aggregations with partial (map-side) aggregation, so a hot
day, week or owner is combined inside each task before the shuffle and the
shuffle carries at most one row per group per task.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetbook.functions import periods as P
from fleetbook.functions.periods import PeriodRange
from fleetbook.operators.entries import entry_list
from fleetbook.operators.filters import entry_scope, in_period, owner_scope
from fleetbook.schemas import MONEY_SUM
from fleetbook.scope import Scope


def _sums(*pairs):
    return [F.sum(src).alias(name) for src, name in pairs]


def daily_rollup(entries: DataFrame, scope: Scope, rng: PeriodRange) -> DataFrame:
    """Income, deductions, net and rental per entry date in the period."""
    e = in_period(entry_scope(entries, scope), rng)
    return (e.groupBy("entry_date")
             .agg(*_sums(("gross_income", "income"), ("total_expenses", "expenses"),
                         ("net_total", "net"), ("rental_amount", "rental")))
             .orderBy("entry_date"))


def weekly_comparison(entries: DataFrame, scope: Scope, limit: int = 8) -> DataFrame:
    """Latest ``limit`` (calendar year, ISO week) groups of the whole scope.

    The period selection does not apply. The year is the calendar year, so
    a late-December date in ISO week 1 merges with January of that year.
    Groups are those of the stored period columns.
    """
    e = entry_scope(entries, scope)
    return (e.groupBy("year_number", "week_number")
             .agg(F.min("entry_date").alias("start_date"), F.max("entry_date").alias("end_date"),
                  *_sums(("gross_income", "income"), ("total_expenses", "expenses"),
                         ("net_total", "net")))
             .orderBy(F.col("start_date").desc())
             .limit(limit))


def monthly_comparison(entries: DataFrame, scope: Scope, limit: int = 8) -> DataFrame:
    """Latest ``limit`` (year, month) groups of the whole scope."""
    e = entry_scope(entries, scope)
    return (e.groupBy("year_number", "month_number")
             .agg(*_sums(("gross_income", "income"), ("total_expenses", "expenses"),
                         ("net_total", "net")))
             .orderBy(F.col("year_number").desc(), F.col("month_number").desc())
             .limit(limit))


def period_totals(daily: DataFrame) -> DataFrame:
    """Totals of a daily rollup and the average net per active day.

    The average divides by the number of dates with entries (not by the
    number of entries, and not by the days of the period); 0 without any.
    """
    z = F.lit(0).cast(MONEY_SUM)
    days = F.count(F.lit(1))
    net = F.coalesce(F.sum("net"), z)
    return daily.agg(
        F.coalesce(F.sum("income"), z).cast(MONEY_SUM).alias("income"),
        F.coalesce(F.sum("expenses"), z).cast(MONEY_SUM).alias("expenses"),
        net.cast(MONEY_SUM).alias("net"),
        F.coalesce(F.sum("rental"), z).cast(MONEY_SUM).alias("rental"),
        days.alias("active_days"),
        F.when(days > 0, F.round(net / days, 2)).otherwise(F.lit(0)).cast(MONEY_SUM)
        .alias("average_daily"),
    )


def _rental_minus_expenses(rental_rows: DataFrame, expense_rows: DataFrame) -> DataFrame:
    """One row: sum of rental, sum of fleet expenses and their difference.

    Both inputs are stacked and aggregated once (a single global aggregate,
    partial per task) instead of joining two one-row results.
    """
    z = F.lit(0).cast(MONEY_SUM)
    stacked = (rental_rows.select(F.col("rental_amount").alias("_r"), F.lit(None).cast("decimal(12,2)").alias("_x"))
               .unionByName(expense_rows.select(F.lit(None).cast("decimal(12,2)").alias("_r"),
                                                F.col("amount").alias("_x"))))
    return (stacked.agg(F.coalesce(F.sum("_r"), z).alias("rental_total"),
                        F.coalesce(F.sum("_x"), z).alias("fleet_expenses"))
                   .withColumn("fleet_net", (F.col("rental_total") - F.col("fleet_expenses")).cast(MONEY_SUM)))


def fleet_net_report(entries: DataFrame, expenses: DataFrame, scope: Scope,
                     rng: PeriodRange) -> DataFrame:
    """Report fleet net: rental of the scoped period minus the owner's fleet
    expenses of the period; expenses count only for an admin with no driver
    and no car selected (otherwise they are 0)."""
    e = in_period(entry_scope(entries, scope), rng)
    show = scope.show_fleet()
    ge = in_period(owner_scope(expenses, scope.owner_user_id), rng, "expense_date")
    ge = ge.where(show if not isinstance(show, bool) else F.lit(show))
    return _rental_minus_expenses(e, ge).withColumn(
        "show_fleet", show if not isinstance(show, bool) else F.lit(show))


def fleet_net_panel(entries: DataFrame, drivers: DataFrame, cars: DataFrame,
                    expenses: DataFrame, scope: Scope, rng: PeriodRange,
                    status: str = "all") -> DataFrame:
    """Panel fleet net: rental of the listed (status-filtered, inner-joined)
    entries minus all of the owner's fleet expenses of the period."""
    listed = entry_list(entries, drivers, cars, scope, rng, status)
    ge = (in_period(owner_scope(expenses, scope.owner_user_id), rng, "expense_date")
          if scope.is_admin else expenses.where(F.lit(False)))
    show = scope.show_fleet()
    out = _rental_minus_expenses(listed, ge)
    show_col = show if not isinstance(show, bool) else F.lit(show)
    return (out.withColumn("fleet_net", F.when(show_col, F.col("fleet_net"))
                           .otherwise(F.lit(0)).cast(MONEY_SUM))
               .withColumn("show_fleet", show_col))


def requested_totals(requests: DataFrame, entries: DataFrame, as_of: dt.date) -> DataFrame:
    """Totals of every requested period: a table of requests (request_id, owner_user_id,
    driver_id or NULL for all, period_text, date_text, week_text, month_text) answered at once.

    A period is at most a month, so a request is laid out in its days; entries are
    summed by tenant and day first, for each driver and for all (partial sums,
    whatever the number of entries), and a request's day meets one sum, whatever
    the number of drivers. The planner takes the days for as many rows as there are
    requests, so it is told not to broadcast them; the sums lie where they were grouped.
    """
    kind, start, end = P.request_bounds("period_text", "date_text", "week_text", "month_text", as_of)
    r = requests.select("request_id", "owner_user_id", F.col("driver_id").alias("_driver"), kind.alias("period"), start.alias("start_date"), end.alias("end_date"))
    zero = F.lit(0).cast("bigint")
    days = r.select("request_id", "owner_user_id", F.col("_driver").isNull().alias("_all"), F.coalesce("_driver", zero).alias("_driver"),
                    F.explode(F.sequence("start_date", "end_date")).alias("entry_date"))
    # every entry counts for its driver, where it has one, and for all of its tenant
    own = F.when(F.col("driver_id").isNotNull(), F.struct(F.lit(False).alias("all"), F.col("driver_id").cast("bigint").alias("driver")))
    whose = F.explode(F.array(own, F.struct(F.lit(True).alias("all"), zero.alias("driver"))))
    sums = entries.select("owner_user_id", "entry_date", "gross_income", "net_total", whose.alias("_w")).where(F.col("_w").isNotNull()).groupBy(
        F.col("owner_user_id").alias("_s_owner"), F.col("entry_date").alias("_s_date"), F.col("_w.all").alias("_s_all"), F.col("_w.driver").alias("_s_driver")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("gross_income").alias("gross"), F.sum("net_total").alias("net"))
    hits = days.hint("merge").join(sums, (F.col("owner_user_id") == F.col("_s_owner")) & (F.col("entry_date") == F.col("_s_date"))
                                   & (F.col("_all") == F.col("_s_all")) & (F.col("_driver") == F.col("_s_driver")))
    totals = hits.groupBy("request_id").agg(F.sum("n").alias("entries"), F.count_distinct("entry_date").alias("days"),
                                            F.sum("gross").cast(MONEY_SUM).alias("gross"), F.sum("net").cast(MONEY_SUM).alias("net"))
    z = F.lit(0).cast("bigint")
    return r.join(totals, "request_id", "left").select(
        "request_id", "period", "start_date", "end_date", F.coalesce("entries", z).alias("entries"), F.coalesce("days", z).alias("days"),
        *[F.coalesce(F.col(c), F.lit(0).cast(MONEY_SUM)).alias(c) for c in ("gross", "net")])
