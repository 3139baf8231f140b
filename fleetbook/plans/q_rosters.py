"""Roster and pick-list queries."""

from __future__ import annotations

from fleetbook.operators import ranking, rosters as R
from fleetbook.plans.catalog import query
from fleetbook.plans.params import MONTH_RANGE, OWNER, first_driver_of_owner, first_holder_of_owner
from fleetbook.scope import Scope

ADMIN = Scope.admin(OWNER)


def _roster(t):
    return R.driver_roster(t.drivers, t.cars, t.daily_entries, ADMIN, MONTH_RANGE, "pending")


@query("driver_roster")
def driver_roster(t):
    """Tenant 1's drivers with lifetime stats, assigned cars and March 1997 billing."""
    return _roster(t)


@query("billing_totals")
def billing_totals(t):
    """Billing totals over the driver roster."""
    return R.billing_totals(_roster(t))


@query("driver_billing")
def driver_billing(t):
    """Rental per driver in March 1997: pending selected, pending, invoiced, total."""
    return R.driver_billing(t.daily_entries, MONTH_RANGE, "pending")


@query("cars_per_driver")
def cars_per_driver(t):
    """Active assigned cars per driver: count and ordered label list."""
    return R.cars_per_driver(t.cars)


@query("car_roster")
def car_roster(t):
    """Tenant 1's cars with current driver of the same owner and lifetime stats."""
    return R.car_roster(t.cars, t.drivers, t.daily_entries, ADMIN)


@query("user_roster")
def user_roster(t):
    """Tenant 1's users with their linked driver of the same owner."""
    return R.user_roster(t.users, t.drivers, OWNER)


@query("assignable_cars")
def assignable_cars(t):
    """Active cars of tenant 1 offered when editing the tenant's first driver."""
    return R.assignable_cars(t.cars, t.drivers, OWNER, first_driver_of_owner(t.drivers))


@query("first_car")
def first_car(t):
    """First active car (label order) of each current driver of tenant 1."""
    return ranking.first_car(t.cars, OWNER)


@query("driver_cars")
def driver_cars(t):
    """Cars the first driver of tenant 1 holds now or has ever driven."""
    return R.driver_cars(t.cars, t.daily_entries, first_driver_of_owner(t.drivers))


@query("pick_drivers")
def pick_drivers(t):
    """Driver pick list of tenant 1's admin."""
    return R.pick_drivers(t.drivers, ADMIN)


@query("pick_cars")
def pick_cars(t):
    """Load-form car pick list of a driver user (holding cars): active cars assigned to it."""
    drv = first_holder_of_owner(t.drivers, t.cars)
    return R.pick_cars(t.cars, t.daily_entries, Scope.driver_user(drv, OWNER), for_form=True)


@query("car_roster_driver")
def car_roster_driver(t):
    """Car roster of a driver user (holding cars): the cars currently assigned to its driver."""
    drv = first_holder_of_owner(t.drivers, t.cars)
    return R.car_roster(t.cars, t.drivers, t.daily_entries, Scope.driver_user(drv, OWNER))


@query("driver_roster_driver")
def driver_roster_driver(t):
    """Driver roster of a driver user (holding cars): its own driver row with stats and billing."""
    drv = first_holder_of_owner(t.drivers, t.cars)
    return R.driver_roster(t.drivers, t.cars, t.daily_entries, Scope.driver_user(drv, OWNER),
                           MONTH_RANGE, "pending")
