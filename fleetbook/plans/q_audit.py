"""Audit, backfill, access-token and list-count queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetbook.operators import access as W
from fleetbook.operators import audits as Q
from fleetbook.operators import backfill as B
from fleetbook.operators import changes as C
from fleetbook.operators import deletes as D
from fleetbook.operators import entries as E
from fleetbook.operators import filters as FL
from fleetbook.plans.catalog import query
from fleetbook.plans.params import MONTH_RANGE, OWNER, TOKENS_AS_OF
from fleetbook.scope import Scope
from fleetbook.sources.standins import StandinBatches

ADMIN = Scope.admin(OWNER)


@query("duplicate_entries")
def duplicate_entries(t):
    """Entry unique-key groups holding more than one row."""
    return Q.duplicate_entries(t.daily_entries)


@query("duplicate_dni")
def duplicate_dni(t):
    """(tenant, dni) groups holding more than one driver."""
    return Q.duplicate_dni(t.drivers)


@query("orphan_entries")
def orphan_entries(t):
    """Foreign-key values without a parent row, over every foreign key, of an import without constraints:
    how many rows carry each and how many tenants they belong to."""
    return Q.orphan_report({
        "daily_entries": StandinBatches(t).imported_entries, "drivers": t.drivers, "cars": t.cars, "users": t.users,
        "general_expenses": t.general_expenses, "weekly_money_notes": t.weekly_money_notes,
        "access_tokens": t.access_tokens})


@query("delete_effects")
def delete_effects(t):
    """Effects of deleting every inactive driver (restricting entries, unlinked cars and users)."""
    req = t.drivers.where(F.col("status") == "inactive").select("id")
    return Q.driver_delete_effects(t.drivers, req, t.daily_entries, t.cars, t.users)


def _delete_batch(t):
    """Inactive drivers, cars and users asked to go, after the driver form saves (new drivers have no entries yet)."""
    s = StandinBatches(t)
    saved = C.apply_driver_saves(t.drivers, t.cars, C.judge_driver_saves(s.driver_saves, t.drivers, t.cars, t.users), t.users)
    tables = {"drivers": saved["drivers"], "cars": saved["cars"], "users": t.users, "daily_entries": t.daily_entries,
              "general_expenses": t.general_expenses, "weekly_money_notes": t.weekly_money_notes, "access_tokens": t.access_tokens}
    inactive = {n: tables[n].where(F.col("status") == "inactive").select("id") for n in ("drivers", "cars")}
    return D.apply_delete_batch(tables, inactive | {"users": t.users.where(F.col("is_active") == 0).select("id")})


@query("delete_outcomes")
def delete_outcomes(t):
    """Every delete request: deleted, or restricted by rows that refer to it."""
    return _delete_batch(t)[1]


@query("deleted_drivers")
def deleted_drivers(t):
    """Drivers after the delete batch (entries restrict the delete)."""
    return _delete_batch(t)[0]["drivers"]


@query("deleted_cars")
def deleted_cars(t):
    """Cars after the delete batch: links to deleted drivers are cleared."""
    return _delete_batch(t)[0]["cars"]


@query("deleted_users")
def deleted_users(t):
    """Users after the delete batch."""
    return _delete_batch(t)[0]["users"]


@query("deleted_tokens")
def deleted_tokens(t):
    """Access tokens after the delete batch: those of deleted users went with them."""
    return _delete_batch(t)[0]["access_tokens"]


@query("deleted_entries")
def deleted_entries(t):
    """Entries after the delete batch: creators that were deleted are cleared."""
    return _delete_batch(t)[0]["daily_entries"]


@query("deleted_expenses")
def deleted_expenses(t):
    """Fleet expenses after the delete batch: creators that were deleted are cleared."""
    return _delete_batch(t)[0]["general_expenses"]


@query("deleted_notes")
def deleted_notes(t):
    """Week notes after the delete batch: editors that were deleted are cleared."""
    return _delete_batch(t)[0]["weekly_money_notes"]


@query("unique_names")
def unique_names(t):
    """Usernames that the source database holds for equal (case, accents and blanks behind do not count)."""
    names = StandinBatches(t).account_names
    first = names.groupBy(F.collate("username", Q.SOURCE_COLLATION).alias("name")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("id").alias("first_id"))
    return first.where(F.col("rows") > 1).select("first_id", "rows")


@query("names_in_order")
def names_in_order(t):
    """Usernames with their place in the source database's order (equal names share a place)."""
    names = StandinBatches(t).account_names
    return Q.places(names, "username", Q.SOURCE_COLLATION)


# --- backfills -------------------------------------------------------------------

LEGACY_COLS = list(B.LEGACY_COSTS)


@query("evolve_schema")
def evolve_schema(t):
    """Legacy entries with the missing columns added at their defaults."""
    return B.evolve_schema(t.legacy_entries)


@query("fold_legacy_costs")
def fold_legacy_costs(t):
    """Legacy entries evolved, normalised, and legacy costs folded into the amounts."""
    return B.fold_legacy_costs(B.evolve_schema(t.legacy_entries))


@query("clean_entries")
def clean_entries(t):
    """Entries without legacy columns evolved and cleaned (zero net = gross - total)."""
    return B.fold_legacy_costs(B.evolve_schema(t.legacy_entries.drop(*LEGACY_COLS)))


def _migration(t):
    s = StandinBatches(t)
    return B.workspace_migration(s.legacy_users, s.legacy_drivers, s.legacy_cars, t.daily_entries, t.general_expenses)


@query("backfill_users")
def backfill_users(t):
    """Users given an owner (own id when missing; named accounts fixed)."""
    return B.backfill_users(StandinBatches(t).legacy_users)


@query("backfill_drivers")
def backfill_drivers(t):
    """Drivers with owners inferred from their entries' creators."""
    return _migration(t)["drivers"]


@query("backfill_cars")
def backfill_cars(t):
    """Cars with owners inferred from their entries' creators."""
    return _migration(t)["cars"]


@query("backfill_entries")
def backfill_entries(t):
    """Entries owned by their creator's, else their driver's, owner."""
    return _migration(t)["daily_entries"]


@query("backfill_driver_users")
def backfill_driver_users(t):
    """Users after driver users take their driver's owner."""
    return _migration(t)["users"]


@query("backfill_expenses")
def backfill_expenses(t):
    """Fleet expenses owned by their creator's owner."""
    return _migration(t)["general_expenses"]


# --- access tokens -----------------------------------------------------------------

@query("valid_tokens")
def valid_tokens(t):
    """Tokens usable at 2024-02-15 00:00 (unexpired, unused, active user)."""
    return W.valid_tokens(t.access_tokens, t.users, TOKENS_AS_OF)


@query("purge_tokens")
def purge_tokens(t):
    """Tokens left after the purges of new requests and completed resets."""
    s = StandinBatches(t)
    return W.purge_tokens(t.access_tokens, s.token_requests, s.token_resets)


@query("last_access")
def last_access(t):
    """Users with their last access stamped from token use."""
    return W.last_access(t.users, t.access_tokens)


@query("token_expiry")
def token_expiry(t):
    """Remember-me and reset expiry of every token from its creation time."""
    return W.token_expiry(t.access_tokens)


# --- list counts -------------------------------------------------------------------

@query("list_counts")
def list_counts(t):
    """Row counts of the lists a tenant-1 admin sees for March 1997."""
    period = F.col("entry_date").between(F.lit(MONTH_RANGE.start), F.lit(MONTH_RANGE.end))
    mine = FL.entry_scope(t.daily_entries, ADMIN).where(period)
    # joins on the unique ids of users, drivers and cars do not change the other lists' counts
    lists: dict[str, DataFrame] = {
        "entries": E.entry_list(t.daily_entries, t.drivers, t.cars, ADMIN, MONTH_RANGE),
        "expenses": FL.in_period(FL.owner_scope(t.general_expenses, OWNER), MONTH_RANGE, "expense_date"),
        "days": mine.select("entry_date").distinct(),
        "drivers": FL.roster_scope(t.drivers, ADMIN, "drivers"),
        "cars": FL.roster_scope(t.cars, ADMIN, "cars"),
        "users": FL.owner_scope(t.users, OWNER),
    }
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("list"), "rows")
             for name, df in lists.items()]
    return reduce(DataFrame.unionByName, parts)


@query("unique_violations")
def unique_violations(t):
    """Violating groups of every unique key (entries, dni, plate, username, week note)."""
    return Q.unique_violations({"daily_entries": t.daily_entries, "drivers": t.drivers, "cars": t.cars,
                                "users": t.users, "weekly_money_notes": t.weekly_money_notes})


@query("delete_effects_cars")
def delete_effects_cars(t):
    """Effects of deleting every inactive car (entries restrict the delete)."""
    req = t.cars.where(F.col("status") == "inactive").select("id")
    return Q.car_delete_effects(t.cars, req, t.daily_entries)


@query("delete_effects_users")
def delete_effects_users(t):
    """Effects of deleting every inactive user (tokens cascade; created / edited rows unlinked)."""
    req = t.users.where(F.col("is_active") == 0).select("id")
    return Q.user_delete_effects(t.users, req, t.access_tokens, t.daily_entries, t.general_expenses,
                                 t.weekly_money_notes)
