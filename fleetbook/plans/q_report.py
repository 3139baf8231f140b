"""Report page queries: daily rollup, totals, rankings, comparisons, fleet net."""

from __future__ import annotations

from fleetbook.functions import display as D
from fleetbook.operators import rollups, ranking
from fleetbook.operators.filters import entry_scope, in_period
from fleetbook.plans.catalog import query
from fleetbook.plans.params import AS_OF, MONTH_RANGE, OWNER, first_driver_of_owner
from fleetbook.scope import Scope
from fleetbook.sources.standins import StandinBatches

ADMIN = Scope.admin(OWNER)


def _daily(t):
    return rollups.daily_rollup(t.daily_entries, ADMIN, MONTH_RANGE)


@query("scan_entries")
def scan_entries(t):
    """Whole entry fact table, every column."""
    return t.daily_entries


@query("daily_rollup")
def daily_rollup(t):
    """Daily sums of tenant 1 in March 1997."""
    return _daily(t)


@query("daily_rollup_signed")
def daily_rollup_signed(t):
    """Daily rollup with the sign class and money text of each day's net."""
    return _daily(t).select("*", D.sign_class("net").alias("net_class"),
                            D.money("net").alias("net_text"))


@query("requested_totals")
def requested_totals(t):
    """Every posted report request (day, week or month of a tenant, all drivers or one) with its totals."""
    return rollups.requested_totals(StandinBatches(t).period_requests, t.daily_entries, AS_OF)


@query("period_totals")
def period_totals(t):
    """Totals of the daily rollup and average net per active day."""
    return rollups.period_totals(_daily(t))


@query("best_days")
def best_days(t):
    """Three best days by net (ties: earlier date first)."""
    return ranking.best_days(_daily(t))


@query("worst_days")
def worst_days(t):
    """Three worst days by net (ties: earlier date first)."""
    return ranking.worst_days(_daily(t))


@query("weekly_comparison")
def weekly_comparison(t):
    """Latest 8 (calendar year, ISO week) groups of tenant 1."""
    return rollups.weekly_comparison(t.daily_entries, ADMIN)


@query("monthly_comparison")
def monthly_comparison(t):
    """Latest 8 (year, month) groups of tenant 1."""
    return rollups.monthly_comparison(t.daily_entries, ADMIN)


@query("fleet_net_report")
def fleet_net_report(t):
    """Rental of March 1997 minus tenant 1's fleet expenses of March 1997."""
    return rollups.fleet_net_report(t.daily_entries, t.general_expenses, ADMIN, MONTH_RANGE)


@query("daily_rollup_driver")
def daily_rollup_driver(t):
    """Daily rollup for a driver user (scoped by its driver only, any owner)."""
    drv = first_driver_of_owner(t.drivers)
    return rollups.daily_rollup(t.daily_entries, Scope.driver_user(drv), MONTH_RANGE)


@query("entries_in_period")
def entries_in_period(t):
    """Entries of tenant 1 in the inclusive range of March 1997."""
    return in_period(entry_scope(t.daily_entries, ADMIN), MONTH_RANGE)
