"""Load-validation rules on hand-made rows, and plan properties of stored tables."""

from __future__ import annotations

import datetime as dt
import tempfile
from decimal import Decimal

from fleetbook.operators import loads as L
from fleetbook.operators import rollups
from fleetbook.functions.periods import period_range, week_range
from fleetbook.scope import Scope
from fleetbook.sources.tables import read_table, write_table

d = dt.date
AS_OF = d(1997, 3, 5)
FORM = ("form_seq long, posted_by long, period_type_text string, entry_date_text string, entry_week_text string, "
        "driver_id_text string, car_id_text string, gross_text string, app_text string, cash_text string, "
        "rental_text string, fuel_text string, km_text string, status_text string, observations_text string")


def _dims(spark):
    users = spark.createDataFrame(
        [(1, "admin", 1, None), (2, "driver", 1, 10), (3, "driver", 1, None), (4, "admin", None, None)],
        "id long, role string, owner_user_id long, driver_id long")
    drivers = spark.createDataFrame([(10, 1, "active"), (11, 1, "inactive"), (12, 2, "active")],
                                    "id long, owner_user_id long, status string")
    cars = spark.createDataFrame([(100, 1, "active", 10), (101, 1, "active", None), (102, 2, "active", 12),
                                  (103, 1, "inactive", 10)],
                                 "id long, owner_user_id long, status string, current_driver_id long")
    return users, drivers, cars


def _form(seq, poster, driver="10", car="100", date="1997-03-04", ptype="day", week="1997-W10",
          status="invoiced"):
    return (seq, poster, ptype, date, week, driver, car, "1.000,50", "100", "", "7000", "12abc", "10.5", status, " x ")


def test_validation_reasons(spark):
    users, drivers, cars = _dims(spark)
    forms = spark.createDataFrame([
        _form(1, 1),                               # admin, all fine
        _form(2, 1, driver="11"),                  # inactive driver
        _form(3, 1, driver="12", car="102"),       # other tenant's driver and car
        _form(4, 1, driver="0", car=""),           # nothing selected
        _form(5, 2, driver="12", car="100"),       # driver user: own driver forced, car assigned
        _form(6, 2, car="101"),                    # driver user, car not assigned to it
        _form(7, 3),                               # unlinked driver user
        _form(8, None),                            # no session
        _form(9, 1, date="1997-02-31"),            # impossible date
        _form(10, 1, ptype="week", week="1997-W99", date="junk"),  # weekly: week start, rolls over
        _form(11, 4, driver="10", car="100"),      # admin without owner: own id is the tenant
    ], FORM)
    v = L.validate_entry_loads(L.clean_entry_forms(forms, users, AS_OF), drivers, cars)
    got = {r.form_seq: r for r in v.collect()}
    assert got[1].reasons == "" and got[1].gross_income == Decimal("1000.50")
    assert got[1].fuel_cost == Decimal("12.00") and got[1].rental_billing_status == "invoiced"
    assert got[2].reasons == "driver_not_in_owner"
    assert got[3].reasons == "driver_not_in_owner,car_not_in_owner"
    assert got[4].reasons == "no_driver,no_car"
    assert got[5].reasons == "" and got[5].driver_id == 10 and got[5].rental_billing_status == "pending"
    assert got[6].reasons == "car_not_assigned"
    assert got[7].reasons == "no_driver"
    assert got[8].reasons == "no_session"
    assert got[9].reasons == "bad_date"
    assert got[10].reasons == "" and got[10].entry_date == week_range("1997-W99")[0] == d(1998, 11, 16)
    assert got[10].entry_week == "1997-W99"
    assert got[11].reasons == "driver_not_in_owner,car_not_in_owner"


def test_duplicates_against_table_and_batch(spark):
    users, drivers, cars = _dims(spark)
    forms = spark.createDataFrame([_form(1, 1, date="1997-03-04"), _form(2, 1, date="1997-03-05"),
                                   _form(3, 1, date="1997-03-05"), _form(4, 1, date="1997-03-06")], FORM)
    existing = spark.createDataFrame([("day", d(1997, 3, 4), 10, 100)],
                                     "period_type string, entry_date date, driver_id long, car_id long")
    v = L.validate_entry_loads(L.clean_entry_forms(forms, users, AS_OF), drivers, cars)
    acc, rej = L.split_loads(v, existing)
    assert sorted(r.form_seq for r in acc.collect()) == [2, 4]           # of equal loads the first stays
    assert {r.form_seq: r.reasons for r in rej.collect()} == {
        1: "duplicate", 3: "duplicate"}
    # cut into two batches, the result is the same
    first, rest = v.where("form_seq <= 2"), v.where("form_seq > 2")
    a1, _ = L.split_loads(first, existing)
    a2, _ = L.split_loads(rest, existing.unionByName(a1.select(*existing.columns)))
    assert sorted(r.form_seq for r in a1.unionByName(a2).collect()) == [2, 4]
    e = L.derive_entries(acc.where("form_seq = 4")).first()
    assert (e.owner_user_id, e.total_expenses, e.net_total) == (1, Decimal("7100.00"), Decimal("-6099.50"))
    assert (e.week_number, e.month_number, e.year_number, e.created_by) == (10, 3, 1997, 1)


def test_stored_entries_are_filtered_by_date(spark):
    path = tempfile.mkdtemp(prefix="fleetbook-store-")
    rows = [(1, "day", d(1997, m, 3), 10, 100, Decimal("10.00"), Decimal("1.00"), Decimal("9.00"), Decimal("0.00"),
             10, m, 1997) for m in range(1, 13)]
    e = spark.createDataFrame(rows, "owner_user_id long, period_type string, entry_date date, driver_id long, "
                                    "car_id long, gross_income decimal(12,2), total_expenses decimal(12,2), "
                                    "net_total decimal(12,2), rental_amount decimal(12,2), week_number int, "
                                    "month_number int, year_number int")
    write_table(e, path, "daily_entries")
    stored = read_table(spark, path, "daily_entries")
    q = rollups.daily_rollup(stored, Scope.admin(1), period_range("month", month="1997-03"))
    plan = q._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: [")[1].split("]")[0]
    assert "EqualTo(owner_user_id,1)" in pushed and "GreaterThanOrEqual(en" in pushed
    assert len(stored.inputFiles()) >= 12 and "stored_month" not in stored.columns
    assert [r.entry_date for r in q.collect()] == [d(1997, 3, 3)]


def test_change_targets_on_stored_entries(spark):
    from fleetbook.operators import changes as C

    path = tempfile.mkdtemp(prefix="fleetbook-tgt-")
    rows = [(1, "day", d(1997, m, 3), 10, 100, Decimal("10.00"), m, 1997) for m in range(1, 13)]
    e = spark.createDataFrame(rows, "owner_user_id long, period_type string, entry_date date, driver_id long, "
                                    "car_id long, gross_income decimal(12,2), month_number int, year_number int")
    write_table(e, path, "entries_unique")
    stored = read_table(spark, path, "entries_unique")
    users = spark.createDataFrame([(1, "admin", 1, None)], "id long, role string, owner_user_id long, driver_id long")
    ch = spark.createDataFrame([("day", d(1997, 3, 3), 10, 100, 1), ("day", d(1997, 4, 3), 10, 100, 1)],
                               "period_type string, entry_date date, driver_id long, car_id long, posted_by long")
    tgt = C.entry_change_targets(ch, stored, users, key=C.ENTRY_KEY)
    assert sorted(r.reasons for r in tgt.collect()) == ["", ""]
