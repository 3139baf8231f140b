"""Entry panel queries: entry list, rental split, expenses, week note, fleet net."""

from __future__ import annotations

from fleetbook.operators import entries as E
from fleetbook.operators import rollups
from fleetbook.plans.catalog import query
from fleetbook.plans.params import MONTH_RANGE, OWNER, WEEK_RANGE
from fleetbook.scope import Scope

ADMIN = Scope.admin(OWNER)


@query("entry_list")
def entry_list(t):
    """Tenant 1's entries of March 1997 with driver name, car label and labels."""
    return E.entry_list(t.daily_entries, t.drivers, t.cars, ADMIN, MONTH_RANGE, "all")


@query("rental_split")
def rental_split(t):
    """Total / pending / invoiced rental over the listed entries."""
    return E.rental_split(E.entry_list(t.daily_entries, t.drivers, t.cars, ADMIN, MONTH_RANGE, "all"))


@query("expense_list")
def expense_list(t):
    """Tenant 1's fleet expenses of March 1997 with the creator's name."""
    return E.expense_list(t.general_expenses, t.users, OWNER, MONTH_RANGE)


@query("weekly_note")
def weekly_note(t):
    """Tenant 1's note of week 1997-W10 with its last editor."""
    return E.weekly_note(t.weekly_money_notes, t.users, OWNER, WEEK_RANGE.start)


@query("fleet_net_panel")
def fleet_net_panel(t):
    """Rental of the pending entries listed for March 1997 minus all fleet expenses."""
    return rollups.fleet_net_panel(t.daily_entries, t.drivers, t.cars, t.general_expenses,
                                   ADMIN, MONTH_RANGE, "pending")
