"""Change-application queries (C-rows) and their reject reports (Q6, Q7)."""

from __future__ import annotations

from fleetbook.operators import changes as C
from fleetbook.operators import loads as L
from fleetbook.plans.catalog import query
from fleetbook.plans.params import AS_OF
from fleetbook.sources.standins import StandinBatches, user_manager


def _entry_edits(t, amounts=True):
    return C.judge_entry_edits(StandinBatches(t).entry_edits, t.entries, t.users, t.drivers, t.cars, amounts)


@query("apply_entry_updates")
def apply_entry_updates(t):
    """Entries after the posted edits (whole forms by id; keys may move), as if applied in posting order."""
    return C.apply_entry_edits(t.entries, _entry_edits(t))


@query("apply_billing_status")
def apply_billing_status(t):
    """Entries after billing-status posts by admins of the entry's tenant; the last post on an entry holds."""
    return C.apply_billing_status(t.entries, StandinBatches(t).billing_changes, t.users)


@query("billing_change_audit")
def billing_change_audit(t):
    """Every billing-status post: applied, superseded by a later one, or why it is rejected."""
    return C.judge_billing_changes(t.entries, StandinBatches(t).billing_changes, t.users)


@query("apply_status")
def apply_status(t):
    """Drivers after activate / deactivate requests by admins of their tenant."""
    s = StandinBatches(t)
    return C.apply_status(t.drivers, s.status_changes, t.users)


@query("apply_deletes")
def apply_deletes(t):
    """Entries after the allowed delete requests."""
    return C.apply_deletes(t.entries, StandinBatches(t).entry_deletes, t.users)


@query("upsert_notes")
def upsert_notes(t):
    """Week notes after posted notes (insert or overwrite; creator kept)."""
    s = StandinBatches(t)
    return C.upsert_notes(t.weekly_money_notes, s.note_posts, t.users, AS_OF)


@query("apply_assignments")
def apply_assignments(t):
    """Cars after the car-assignment posts, as if applied in posting order."""
    s = StandinBatches(t)
    return C.apply_assignments(t.cars, s.assignments, t.users)


@query("assignment_rejects")
def assignment_rejects(t):
    """Car-assignment posts that are rejected, with reasons."""
    s = StandinBatches(t)
    return C.assignment_rejects(t.cars, s.assignments, t.users)


@query("apply_dimension_updates")
def apply_dimension_updates(t):
    """Drivers after the accepted driver edits (name, dni, status)."""
    return C.apply_driver_edits(t.drivers, C.judge_driver_edits(StandinBatches(t).driver_edits, t.drivers, t.users))


@query("driver_edit_rejects")
def driver_edit_rejects(t):
    """Driver edits that are rejected, with reasons."""
    s = StandinBatches(t)
    j = C.judge_driver_edits(s.driver_edits, t.drivers, t.users)
    return j.where(j.reasons != "")


@query("change_rejects")
def change_rejects(t):
    """Entry edits and deletes that are rejected, with reasons (session, ownership, driver, form rules, key taken)."""
    return C.entry_change_rejects(_entry_edits(t, amounts=False), t.entries, t.users, StandinBatches(t).entry_deletes)


def _user_edits(t):
    return C.judge_user_edits(StandinBatches(t).user_edits, t.users, t.drivers, user_manager(t.users, "username"))


@query("user_rejects")
def user_rejects(t):
    """User edits rejected, with every failed rule (manager, fields, driver, self-lock, tenant, username)."""
    j = _user_edits(t)
    return j.where(j.reasons != "")


@query("apply_user_edits")
def apply_user_edits(t):
    """Users after the accepted user edits."""
    return C.apply_user_edits(t.users, _user_edits(t))


@query("apply_status_cars")
def apply_status_cars(t):
    """Cars after activate / deactivate requests by admins of their tenant."""
    s = StandinBatches(t)
    return C.apply_status(t.cars, s.car_status_changes, t.users)


@query("apply_expense_deletes")
def apply_expense_deletes(t):
    """Fleet expenses after delete requests by admins of their tenant."""
    s = StandinBatches(t)
    return C.apply_expense_deletes(t.general_expenses, s.expense_deletes, t.users)


@query("apply_note_deletes")
def apply_note_deletes(t):
    """Week notes after delete posts by admins of their tenant."""
    s = StandinBatches(t)
    return C.apply_note_deletes(t.weekly_money_notes, s.note_deletes, t.users, AS_OF)


def _car_edits(t):
    return C.judge_car_edits(L.clean_car_forms(StandinBatches(t).car_edits), t.cars, t.users)


@query("apply_car_edits")
def apply_car_edits(t):
    """Cars after the accepted car edit forms (cleaned, tenant-checked, plate free at that time)."""
    return C.apply_car_edits(t.cars, _car_edits(t))


@query("car_edit_rejects")
def car_edit_rejects(t):
    """Car edit forms that are rejected, with reasons."""
    j = _car_edits(t)
    return j.where(j.reasons != "")


@query("note_rejects")
def note_rejects(t):
    """Week-note posts that are rejected (no session, not admin, empty note)."""
    s = StandinBatches(t)
    return C.note_post_rejects(s.note_posts, t.users)


def _driver_saves(t):
    return C.judge_driver_saves(StandinBatches(t).driver_saves, t.drivers, t.cars, t.users)


@query("driver_saves")
def driver_saves(t):
    """Drivers after the driver form saves (edits and creations, whole-save rules)."""
    return C.apply_driver_saves(t.drivers, t.cars, _driver_saves(t), t.users)["drivers"]


@query("driver_save_cars")
def driver_save_cars(t):
    """Cars after the car assignments of the accepted driver form saves."""
    return C.apply_driver_saves(t.drivers, t.cars, _driver_saves(t), t.users)["cars"]


@query("driver_save_rejects")
def driver_save_rejects(t):
    """Driver form saves that fail as a whole, with reasons."""
    j = _driver_saves(t)
    return j.where(j.reasons != "").drop("writes_driver")
