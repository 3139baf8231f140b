"""Whole screens as sets of lazy DataFrames, from raw request parameters.

A screen request arrives as text (query-string values). Each page function
cleans it the way the screens do (allow-listed period and status, syntax-
checked dates with ``as_of`` as today, integer ids), resolves the session's
scope, and returns every section of the screen as a DataFrame. Nothing is
collected: the caller decides what to show or write.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetbook.functions import periods as P
from fleetbook.operators import entries as E
from fleetbook.operators import ranking, rollups
from fleetbook.operators import rosters as R
from fleetbook.scope import Scope

PERIODS = ("day", "week", "month")
STATUSES = ("all", "pending", "invoiced")


def _int(v) -> int:
    """PHP-style integer of a request value (leading digits, else 0)."""
    if v is None:
        return 0
    if isinstance(v, int):
        return v
    s = str(v).strip()
    sign = -1 if s.startswith("-") else 1
    s = s.lstrip("+-")
    digits = ""
    for ch in s:
        if not ch.isdigit():
            break
        digits += ch
    return sign * int(digits) if digits else 0


def _choice(v, allowed, default):
    return v if v in allowed else default


def request_range(req: dict, as_of: dt.date, prefix: str = "", week_dates: bool = False) -> P.PeriodRange:
    period = _choice(req.get(prefix + "period"), PERIODS, "week")
    return P.period_range(period, req.get(prefix + "date"), req.get(prefix + "week"),
                          req.get(prefix + "month"), as_of, week_dates)


def request_scope(session: Scope, req: dict) -> Scope:
    """The session with the requested driver / car of this request."""
    return Scope(session.role, session.owner_user_id, session.linked_driver_id,
                 _int(req.get("driver_id")), _int(req.get("car_id")), session.user_id)


def _pick_lists(t, scope: Scope, for_form: bool = False) -> dict[str, DataFrame]:
    if scope.is_admin or scope.linked_driver_id is not None:
        return {"pick_drivers": R.pick_drivers(t.drivers, scope, only_active=for_form),
                "pick_cars": R.pick_cars(t.cars, t.daily_entries, scope, for_form=for_form)}
    empty = t.drivers.where(F.lit(False))
    return {"pick_drivers": empty.select("id", "full_name"),
            "pick_cars": t.cars.where(F.lit(False)).select("id", F.lit(None).cast("string").alias("label"))}


def report_page(t, session: Scope, req: dict, as_of: dt.date) -> dict[str, DataFrame]:
    """Report screen: daily rollup, totals, fleet net, best / worst days, comparisons."""
    scope = request_scope(session, req)
    rng = request_range(req, as_of, week_dates=True)
    daily = rollups.daily_rollup(t.daily_entries, scope, rng)
    return {
        **_pick_lists(t, scope),
        "daily": daily,
        "totals": rollups.period_totals(daily),
        "fleet": rollups.fleet_net_report(t.daily_entries, t.general_expenses, scope, rng),
        "best_days": ranking.best_days(daily),
        "worst_days": ranking.worst_days(daily),
        "weekly_comparison": rollups.weekly_comparison(t.daily_entries, scope),
        "monthly_comparison": rollups.monthly_comparison(t.daily_entries, scope),
    }


def panel_page(t, session: Scope, req: dict, as_of: dt.date) -> dict[str, DataFrame]:
    """Entry panel: listed entries, rental split, and for admins the fleet
    expenses, fleet net and (weekly period) the week note."""
    scope = request_scope(session, req)
    rng = request_range(req, as_of)
    status = _choice(req.get("rental_status"), STATUSES, "all")
    listed = E.entry_list(t.daily_entries, t.drivers, t.cars, scope, rng, status)
    page = {**_pick_lists(t, scope), "entries": listed, "rental_split": E.rental_split(listed)}
    if scope.is_admin:
        page["expenses"] = E.expense_list(t.general_expenses, t.users, scope.owner_user_id, rng)
        page["fleet"] = rollups.fleet_net_panel(t.daily_entries, t.drivers, t.cars, t.general_expenses,
                                                scope, rng, status)
        if _choice(req.get("period"), PERIODS, "week") == "week":
            page["weekly_note"] = E.weekly_note(t.weekly_money_notes, t.users, scope.owner_user_id, rng.start)
    return page


def drivers_page(t, session: Scope, req: dict, as_of: dt.date) -> dict[str, DataFrame]:
    """Driver roster with billing of the selected period (default status pending)."""
    rng = request_range(req, as_of, "billing_")
    status = _choice(req.get("billing_status"), STATUSES, "pending")
    roster = R.driver_roster(t.drivers, t.cars, t.daily_entries, session, rng, status)
    page = {"drivers": roster, "billing_totals": R.billing_totals(roster)}
    if session.is_admin:
        edit = _int(req.get("edit")) or None
        page["assignable_cars"] = R.assignable_cars(t.cars, t.drivers, session.owner_user_id, edit)
    return page


def cars_page(t, session: Scope, req: dict, as_of: dt.date) -> dict[str, DataFrame]:
    """Car roster with current driver and lifetime statistics."""
    return {"cars": R.car_roster(t.cars, t.drivers, t.daily_entries, session)}


def users_page(t, session: Scope, req: dict, as_of: dt.date) -> dict[str, DataFrame]:
    """Users of the tenant and the active drivers they can be linked to."""
    return {"users": R.user_roster(t.users, t.drivers, session.owner_user_id),
            "drivers": R.pick_drivers(t.drivers, session, only_active=True)}


PAGES = {"report": report_page, "panel": panel_page, "drivers": drivers_page, "cars": cars_page,
         "users": users_page}
