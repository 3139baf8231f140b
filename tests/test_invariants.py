"""Invariants over the sf0.01 tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetbook.operators import changes as C
from fleetbook.operators import entries as E
from fleetbook.operators import loads as L
from fleetbook.operators import ranking, rollups
from fleetbook.plans.params import AS_OF, MONTH_RANGE, OWNER
from fleetbook.scope import Scope
from fleetbook.sources.standins import StandinBatches

ADMIN = Scope.admin(OWNER)


def test_daily_net_sums_to_period_total(tables_check):
    t = tables_check
    daily = rollups.daily_rollup(t.daily_entries, ADMIN, MONTH_RANGE)
    total = daily.agg(F.sum("net")).first()[0]
    assert rollups.period_totals(daily).first().net == total
    assert ranking.best_days(daily).count() <= 3 and ranking.worst_days(daily).count() <= 3


def test_pending_plus_invoiced_is_total(tables_check):
    t = tables_check
    r = E.rental_split(E.entry_list(t.daily_entries, t.drivers, t.cars, ADMIN, MONTH_RANGE)).first()
    assert r.rental_pending + r.rental_invoiced == r.rental_total


def test_accepted_plus_rejected_is_input(tables_check):
    t = tables_check
    forms = StandinBatches(t).entry_forms
    v = L.validate_entry_loads(L.clean_entry_forms(forms, t.users, AS_OF), t.drivers, t.cars)
    acc, rej = L.split_loads(v, t.entries_unique)
    assert acc.count() + rej.count() == forms.count()
    # no accepted key exists already or repeats
    keys = ["period_type", "entry_date", "driver_id", "car_id"]
    assert acc.join(t.entries_unique, keys, "left_semi").count() == 0
    assert acc.groupBy(*keys).count().where("count > 1").count() == 0


def test_delete_then_append_is_identity(tables_check):
    t = tables_check
    base = t.entries
    after = C.apply_deletes(base, StandinBatches(t).entry_deletes, t.users)
    assert after.columns == base.columns
    gone = base.exceptAll(after)
    assert gone.count() > 0
    restored = L.append_rows(after, gone)
    assert restored.exceptAll(base).count() == 0 and base.exceptAll(restored).count() == 0
