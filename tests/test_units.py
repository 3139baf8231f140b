"""Operator semantics on hand-made rows (the data model's hard cases)."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fleetbook.functions import amounts as A
from fleetbook.functions import display as D
from fleetbook.functions import periods as P
from fleetbook.operators import backfill as B
from fleetbook.operators import changes as C
from fleetbook.operators import filters as FL
from fleetbook.operators import ranking, rollups
from fleetbook.operators.entries import entry_math
from fleetbook.scope import Scope

d = dt.date


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


# --- entry math (the seed's worked example) -------------------------------------

def test_seed_entry_math(spark):
    df = spark.createDataFrame(
        [(Decimal("85000.00"), Decimal("3000.00"), Decimal("18000.00"), Decimal("7000.00"), Decimal("22000.00"))],
        "gross_income decimal(12,2), app_expenses decimal(12,2), cash_collected decimal(12,2), "
        "rental_amount decimal(12,2), fuel_cost decimal(12,2)")
    r = one(entry_math(df))
    assert r.total_expenses == Decimal("28000.00")
    assert r.net_total == Decimal("57000.00")  # fuel is not deducted


def test_entry_math_missing_amounts_count_as_zero(spark):
    df = spark.createDataFrame([(Decimal("100.00"), None, None, None)],
                               "gross_income decimal(12,2), app_expenses decimal(12,2), "
                               "cash_collected decimal(12,2), rental_amount decimal(12,2)")
    r = one(entry_math(df))
    assert (r.total_expenses, r.net_total) == (Decimal("0.00"), Decimal("100.00"))


# --- amount parsing ------------------------------------------------------------------

@pytest.mark.parametrize("text,value", [
    ("1.234", "1.23"), ("1.234,5", "1234.50"), ("12abc", "12.00"), ("", "0.00"), ("abc", "0.00"),
    (" 7000 ", "7000.00"), ("-3,555", "-3.56"), ("2.675", "2.68"), (".5", "0.50"), ("+4", "4.00"),
    ("1e3", "1000.00"), ("1.117,00", "1117.00"), (None, "0.00"),
    ("1,2,3", "1.20"), ("1.234.567,89", "1234567.89"), ("0x1A", "0.00"), ("-", "0.00"), (" .5e-3", "0.00"),
    ("-2.675", "-2.68"), ("5.", "5.00"), ("1e", "1.00"), ("+.5", "0.50"),
])
def test_parse_amount(spark, text, value):
    df = spark.createDataFrame([(text,)], "t string")
    assert one(df.select(A.parse_amount("t").alias("v"))).v == Decimal(value)


# --- periods ----------------------------------------------------------------------------

def test_iso_week_with_calendar_year(spark):
    df = spark.createDataFrame([(d(2024, 12, 30),), (d(2027, 1, 1),), (d(1996, 1, 1),)], "x date")
    rows = {r.x: r for r in df.select(
        "x", P.week_number("x").alias("w"), P.year_number("x").alias("y"),
        P.iso_week_text("x").alias("t"), P.week_start_of("x").alias("m")).collect()}
    assert (rows[d(2024, 12, 30)].w, rows[d(2024, 12, 30)].y) == (1, 2024)
    assert rows[d(2024, 12, 30)].t == "2025-W01"
    assert (rows[d(2027, 1, 1)].w, rows[d(2027, 1, 1)].y) == (53, 2027)
    assert rows[d(2027, 1, 1)].t == "2026-W53"
    assert rows[d(1996, 1, 1)].m == d(1996, 1, 1)


@pytest.mark.parametrize("text", ["2026-W49", "1997-W10", "2020-W53", "2021-W00", "2026-W99", "2009-W01"])
def test_week_bounds_text_matches_resolver(spark, text):
    df = spark.createDataFrame([(text,)], "w string")
    s, e = P.week_bounds_of_text("w")
    r = one(df.select(s.alias("s"), e.alias("e")))
    assert (r.s, r.e) == P.week_range(text)
    if text[6:] not in ("00", "99", "53"):
        assert r.s == dt.date.fromisocalendar(int(text[:4]), int(text[6:]), 1)


def test_week_bounds_rolls_over():
    assert P.week_range("2026-W99")[0] > d(2027, 1, 1)
    assert P.week_range("2021-W00")[0] == d(2020, 12, 28)


def test_month_bounds(spark):
    df = spark.createDataFrame([("1997-02",), ("1996-02",), ("1997-13",), ("bad",)], "m string")
    f, l = P.month_bounds_of_text("m")
    got = {r.m: (r.f, r.l) for r in df.select("m", f.alias("f"), l.alias("l")).collect()}
    assert got["1997-02"] == (d(1997, 2, 1), d(1997, 2, 28))
    assert got["1996-02"][1] == d(1996, 2, 29)
    assert got["1997-13"] == (None, None) and got["bad"] == (None, None)


def test_period_range_resolver():
    assert P.period_range("week", week="1997-W10").start == d(1997, 3, 3)
    assert P.period_range("month", month="1997-03").end == d(1997, 3, 31)
    assert P.period_range("day", date="junk", as_of=d(1997, 3, 5)).start == d(1997, 3, 5)
    assert P.period_range("year", week="1997-W10").label == "Semana 10, 1997"  # unknown period -> week
    assert P.valid_week_or_current("x", d(2024, 12, 30)) == "2025-W01"
    assert P.period_range("week", week="1997-W10", week_dates=True).label == "03/03/1997 - 09/03/1997"


@pytest.mark.parametrize("kind, text", [("day", "2026-02-31"), ("month", "2026-13"), ("month", "9999-12"), ("week", "0000-W01")])
def test_impossible_dates_give_an_empty_range(spark, kind, text):
    r = P.period_range(kind, **{"date" if kind == "day" else kind: text})
    df = spark.createDataFrame([(d(1997, 3, 5),), (d(1970, 1, 1),)], "entry_date date")
    from fleetbook.operators.filters import in_period

    assert r.start > r.end and in_period(df, r).count() == 0


# --- display -----------------------------------------------------------------------------

def test_money_and_numbers(spark):
    df = spark.createDataFrame([(Decimal("1234567.50"),), (Decimal("2.50"),), (Decimal("-0.40"),),
                                (Decimal("-1234.50"),)], "x decimal(12,2)")
    got = [r.m for r in df.select(D.money("x").alias("m")).collect()]
    assert got == ["$ 1.234.568", "$ 3", "$ 0", "$ -1.235"]
    r = one(spark.createDataFrame([(Decimal("1234.5"),)], "x decimal(12,2)")
            .select(D.number_ar("x", 2).alias("n")))
    assert r.n == "1.234,50"


def test_fallback_treats_zero_text_as_empty(spark):
    df = spark.createDataFrame([(None,), ("",), ("0",), ("x",)], "v string")
    assert [r.f for r in df.select(D.fallback("v", "-").alias("f")).collect()] == ["-", "-", "-", "x"]


def test_dates_and_labels(spark):
    df = spark.createDataFrame([(d(1997, 3, 5),), (None,)], "x date")
    got = [(r.a, r.b) for r in df.select(D.date_ar("x").alias("a"), P.month_label("x").alias("b")).collect()]
    assert got == [("05/03/1997", "Marzo 1997"), ("-", None)]


# --- scope --------------------------------------------------------------------------------

@pytest.fixture()
def entries(spark):
    rows = [(1, 10, 100, d(1997, 3, 3), Decimal("10.00")), (1, 11, 101, d(1997, 3, 4), Decimal("20.00")),
            (2, 10, 102, d(1997, 3, 4), Decimal("30.00")), (2, 12, 100, d(1997, 3, 10), Decimal("40.00"))]
    return spark.createDataFrame(rows, "owner_user_id long, driver_id long, car_id long, entry_date date, "
                                       "net_total decimal(12,2)")


@pytest.mark.parametrize("scope,expected", [
    (Scope.admin(1), 2),
    (Scope.admin(0), 0),                          # no tenant: nothing
    (Scope.admin(1, driver_id=10), 1),
    (Scope.admin(1, driver_id=-1), 0),            # negative driver: nothing
    (Scope.admin(2, car_id=-5), 2),               # negative car: all cars
    (Scope.admin(2, car_id=100), 1),
    (Scope.driver_user(10, owner_user_id=1), 2),  # driver users are not owner-scoped
    (Scope.driver_user(None, owner_user_id=1), 0),
    (Scope("driver", 1, 10, requested_driver_id=11), 2),  # request overridden by own driver
])
def test_entry_scope(entries, scope, expected):
    assert FL.entry_scope(entries, scope).count() == expected


def test_scalar_subquery_scope(spark, entries):
    drv = entries.where(F.col("owner_user_id") == 2).select(F.max("driver_id")).scalar()
    assert FL.entry_scope(entries, Scope.driver_user(drv)).count() == 1


# --- rollups and rankings -------------------------------------------------------------------

def test_rankings_break_ties_by_earlier_date(spark):
    rows = [(d(1997, 3, 1), Decimal("5")), (d(1997, 3, 2), Decimal("9")), (d(1997, 3, 3), Decimal("9")),
            (d(1997, 3, 4), Decimal("1")), (d(1997, 3, 5), Decimal("1")), (d(1997, 3, 6), Decimal("9"))]
    daily = spark.createDataFrame(rows, "entry_date date, net decimal(22,2)")
    assert [r.entry_date.day for r in ranking.best_days(daily).collect()] == [2, 3, 6]
    assert [r.entry_date.day for r in ranking.worst_days(daily).collect()] == [4, 5, 1]


def test_period_totals_empty_and_average(spark):
    schema = "entry_date date, income decimal(22,2), expenses decimal(22,2), net decimal(22,2), rental decimal(22,2)"
    empty = one(rollups.period_totals(spark.createDataFrame([], schema)))
    assert (empty.active_days, empty.average_daily, empty.net) == (0, Decimal("0.00"), Decimal("0.00"))
    rows = [(d(1997, 3, 1), Decimal(1), Decimal(0), Decimal("10.00"), Decimal(0)),
            (d(1997, 3, 2), Decimal(1), Decimal(0), Decimal("0.01"), Decimal(0)),
            (d(1997, 3, 3), Decimal(1), Decimal(0), Decimal("-5.00"), Decimal(0))]
    r = one(rollups.period_totals(spark.createDataFrame(rows, schema)))
    assert r.active_days == 3 and r.average_daily == Decimal("1.67")   # 5.01 / 3 = 1.67


def test_weekly_groups_use_calendar_year(spark):
    rows = [(d(2024, 1, 1), 2024, 1), (d(2024, 12, 30), 2024, 1), (d(2024, 12, 23), 2024, 52)]
    e = spark.createDataFrame([(1, 1, 1, r[0], r[1], r[2], Decimal(1), Decimal(1), Decimal(1)) for r in rows],
                              "owner_user_id long, driver_id long, car_id long, entry_date date, year_number int, "
                              "week_number int, gross_income decimal(12,2), total_expenses decimal(12,2), "
                              "net_total decimal(12,2)")
    got = {(r.year_number, r.week_number): (r.start_date, r.end_date)
           for r in rollups.weekly_comparison(e, Scope.admin(1)).collect()}
    assert got[(2024, 1)] == (d(2024, 1, 1), d(2024, 12, 30))


# --- change application ---------------------------------------------------------------------

def _simulate_assignments(cars, posts, tenant_of, role_of):
    """Sequential reference: apply posts one by one in (seq, driver) order."""
    holder = {c["id"]: c["current_driver_id"] for c in cars}
    owner = {c["id"]: c["owner_user_id"] for c in cars}
    active = {c["id"]: c["status"] == "active" for c in cars}
    for p in sorted(posts, key=lambda p: (p["change_seq"], p["driver_id"])):
        if role_of.get(p["posted_by"]) != "admin":
            continue
        o = tenant_of[p["posted_by"]]
        car = p["car_id"]
        if car is not None and not (car in owner and owner[car] == o and active[car]):
            continue
        for c in holder:
            if owner[c] == o and holder[c] == p["driver_id"]:
                holder[c] = None
        if car is not None:
            holder[car] = p["driver_id"]
    return holder


@pytest.mark.parametrize("seed", range(6))
def test_assignments_closed_form_matches_sequential(spark, seed):
    rnd = random.Random(seed)
    cars = [{"id": i, "owner_user_id": rnd.randint(1, 2), "status": rnd.choice(["active", "active", "inactive"]),
             "current_driver_id": rnd.choice([None, 1, 2, 3, 4])} for i in range(1, 13)]
    users = [(100 + k, "admin" if k < 3 else "driver", 1 + k % 2) for k in range(5)]
    posts = [{"change_seq": rnd.randint(1, 15), "posted_by": rnd.choice([u[0] for u in users] + [999]),
              "driver_id": rnd.randint(1, 4), "car_id": rnd.choice([None] + list(range(1, 14)))}
             for _ in range(25)]
    cars_df = spark.createDataFrame(cars, "id long, owner_user_id long, status string, current_driver_id long")
    users_df = spark.createDataFrame(users, "id long, role string, owner_user_id long").withColumn(
        "driver_id", F.lit(None).cast("long"))
    posts_df = spark.createDataFrame(posts, "change_seq long, posted_by long, driver_id long, car_id long")
    got = {r.id: r.current_driver_id for r in C.apply_assignments(cars_df, posts_df, users_df).collect()}
    want = _simulate_assignments(cars, posts, {u[0]: u[2] for u in users}, {u[0]: u[1] for u in users})
    assert got == want


def test_upsert_notes_is_idempotent(spark):
    notes = spark.createDataFrame([(1, d(1997, 3, 3), d(1997, 3, 9), "old", 5, 7)],
                                  "owner_user_id long, week_start date, week_end date, notes string, "
                                  "created_by long, updated_by long")
    users = spark.createDataFrame([(10, "admin", 1, None), (11, "driver", 1, None)],
                                  "id long, role string, owner_user_id long, driver_id long")
    posts = spark.createDataFrame([(1, 10, "1997-W10", " new "), (2, 10, "1997-W11", "x"),
                                   (3, 10, "1997-W11", "  "), (4, 11, "1997-W12", "y")],
                                  "change_seq long, posted_by long, week_text string, notes_text string")
    once = C.upsert_notes(notes, posts, users, d(1997, 3, 5))
    twice = C.upsert_notes(once, posts, users, d(1997, 3, 5))
    a = sorted(map(tuple, once.collect()))
    assert a == sorted(map(tuple, twice.collect()))
    by_week = {r.week_start: r for r in once.collect()}
    assert by_week[d(1997, 3, 3)].notes == "new" and by_week[d(1997, 3, 3)].created_by == 5
    assert by_week[d(1997, 3, 10)].created_by == 10        # inserted
    assert d(1997, 3, 17) not in by_week                  # driver users may not post


def test_billing_status_admin_only_and_allow_list(spark):
    e = spark.createDataFrame([(7, 10, 1, "invoiced", None)],
                              "id long, driver_id long, owner_user_id long, rental_billing_status string, updated_by long")
    users = spark.createDataFrame([(1, "admin", 1, None), (2, "admin", 2, None), (3, "driver", 1, 10)],
                                  "id long, role string, owner_user_id long, driver_id long")
    ch = spark.createDataFrame([(1, 7, "bogus", 1)], "change_seq long, id long, status_text string, posted_by long")
    r = one(C.apply_billing_status(e, ch, users))
    assert r.rental_billing_status == "pending" and r.updated_by == 1
    for poster in (2, 3):   # other tenant's admin; driver user
        r = one(C.apply_billing_status(e, ch.withColumn("posted_by", F.lit(poster).cast("long")), users))
        assert r.updated_by is None


def test_billing_status_last_post_holds(spark):
    e = spark.createDataFrame([(7, 10, 1, "pending", None)],
                              "id long, driver_id long, owner_user_id long, rental_billing_status string, updated_by long")
    users = spark.createDataFrame([(1, "admin", 1, None), (2, "admin", 1, None), (3, "driver", 1, 10)],
                                  "id long, role string, owner_user_id long, driver_id long")
    ch = spark.createDataFrame([(5, 7, "invoiced", 1), (9, 7, "pending", 2), (8, 7, "invoiced", 1), (10, 7, "invoiced", 3), (11, 8, "pending", 1)],
                               "change_seq long, id long, status_text string, posted_by long")
    r = one(C.apply_billing_status(e, ch, users))
    assert (r.rental_billing_status, r.updated_by) == ("pending", 2)
    assert {x.change_seq: x.outcome for x in C.judge_billing_changes(e, ch, users).collect()} == {
        5: "superseded", 8: "superseded", 9: "applied", 10: "not_admin", 11: "not_found"}


# --- backfills ---------------------------------------------------------------------------------

def test_clean_entries_reads_new_total(spark):
    df = spark.createDataFrame([("weekly", Decimal("100.00"), None, Decimal("0.00"))],
                               "period_type string, gross_income decimal(12,2), total_expenses decimal(12,2), "
                               "net_total decimal(12,2)")
    r = one(B.clean_entries(B.evolve_schema(df)))
    assert (r.period_type, r.total_expenses, r.net_total) == ("day", Decimal("0.00"), Decimal("100.00"))


def test_fold_needs_all_four_legacy_columns(spark):
    base = spark.createDataFrame([(Decimal("100.00"), Decimal("0"), Decimal("0"), Decimal("0"), Decimal("5.00"))],
                                 "gross_income decimal(12,2), app_expenses decimal(12,2), "
                                 "total_expenses decimal(12,2), net_total decimal(12,2), wash_cost decimal(12,2)")
    partial = one(B.fold_legacy_costs(B.evolve_schema(base)))
    assert partial.app_expenses == Decimal("0.00") and partial.net_total == Decimal("100.00")
    full = base.select("*", *[F.lit(None).cast("decimal(12,2)").alias(c)
                              for c in ("tolls_cost", "maintenance_cost", "other_expenses")])
    r = one(B.fold_legacy_costs(B.evolve_schema(full)))
    assert (r.app_expenses, r.total_expenses, r.net_total) == (Decimal("5.00"), Decimal("5.00"), Decimal("95.00"))


# --- seed rows ---------------------------------------------------------------------------------

def test_seed_installation(spark):
    from fleetbook.operators import rosters
    from fleetbook.sources.seed import seed_tables

    s = seed_tables(spark, d(2026, 12, 2))
    e = s["daily_entries"]
    stored = one(e)
    recomputed = one(entry_math(e))
    assert (recomputed.total_expenses, recomputed.net_total) == (stored.total_expenses, stored.net_total)
    assert (stored.week_number, stored.month_number, stored.year_number) == (49, 12, 2026)
    note = one(s["weekly_money_notes"])
    assert (note.week_start, note.week_end) == (d(2026, 11, 30), d(2026, 12, 6))
    rng = P.period_range("week", week="2026-W49")
    r = one(rosters.driver_roster(s["drivers"], s["cars"], e, Scope.admin(1), rng, "pending"))
    assert r.car_labels == "Toyota Etios - AA000AA" and r.cars_count == 1
    assert r.rental_selected_total == Decimal("7000.00") and r.net_total == Decimal("57000.00")
    fleet = one(rollups.fleet_net_report(e, s["general_expenses"], Scope.admin(1), rng))
    assert fleet.fleet_net == Decimal("-5000.00")   # 7000 rental - 12000 fleet expenses


def test_orphans_and_unique_keys(spark):
    from fleetbook.operators import audits as Q

    child = spark.createDataFrame([(1, 10), (2, 10), (3, 11), (4, None), (5, 12)], "id long, driver_id long")
    parent = spark.createDataFrame([(10,), (12,)], "id long")
    got = [(r.value, r.rows) for r in Q.orphans(child, "driver_id", parent, "c", "p").collect()]
    assert got == [(11, 1)]
    drivers = spark.createDataFrame([(1, 1, "7"), (2, 1, "7"), (3, 2, "7"), (4, 1, None), (5, 1, None)],
                                    "id long, owner_user_id long, dni string")
    dup = Q.unique_violations({"drivers": drivers}).collect()
    assert [(r.key_value, r.rows) for r in dup] == [("1|7", 2)]   # NULL dni never collide


def test_unique_keys_under_source_collation(spark):
    from fleetbook.operators import audits as Q

    users = spark.createDataFrame([(1, "Jose  "), (2, "JOSÉ"), (3, "ana"), (4, "Ana")], "id long, username string")
    assert Q.duplicate_keys(users, ["username"]).count() == 0            # binary: all distinct
    got = sorted(r.rows for r in Q.duplicate_keys(users, ["username"], Q.SOURCE_COLLATION).collect())
    assert got == [2, 2]
    v = Q.unique_violations({"users": users}, Q.SOURCE_COLLATION).collect()
    assert sorted(r.rows for r in v) == [2, 2]


def test_sizing_conf():
    from fleetbook.session import sizing_conf

    big = sizing_conf(100 * 1024 ** 4, 4000)
    assert int(big["spark.sql.shuffle.partitions"]) == 819_200         # 128 MB a reducer, whatever the input
    assert int(big["spark.sql.files.maxPartitionBytes"]) == 256 * 1024 ** 2
    assert int(sizing_conf(60 * 1024 ** 2, 8)["spark.sql.shuffle.partitions"]) == 24   # 3 waves minimum


def test_user_edit_rules(spark):
    users = spark.createDataFrame(
        [(1, "Per", "personal", "admin", None, 1, 1), (2, "Ana", "ana", "driver", None, 1, 1),
         (3, "Bob", "bob", "driver", None, 1, 1), (4, "Eve", "eve", "driver", None, 2, 1)],
        "id long, full_name string, username string, role string, driver_id long, owner_user_id long, "
        "is_active int")
    drivers = spark.createDataFrame([(10, 1), (11, 2)], "id long, owner_user_id long")
    edits = spark.createDataFrame([
        (1, 3, 1, "Bob", "ana", "driver", None, 1),     # username of another user
        (2, 2, 1, "Ana", "ann", "admin", 10, 1),        # admin: driver link dropped; fine
        (3, 1, 1, "Per", "personal", "driver", None, 1),  # demotes itself
        (4, 4, 1, "Eve", "eve", "driver", 11, 1),       # user and driver of another tenant
        (5, 3, 2, "Bob", "bobby", "driver", None, 1),   # posted by a non-manager
        (6, 3, 1, "Bob", "ana", "driver", None, 1),     # by now the username is free
    ], "change_seq long, id long, posted_by long, full_name_text string, username_text string, role_text string, "
       "driver_id long, is_active int")
    judged = C.judge_user_edits(edits, users, drivers)
    got = {r.change_seq: r for r in judged.collect()}
    assert got[1].reasons == "duplicate_username"
    assert got[2].reasons == "" and got[2].driver_id is None and got[2].role == "admin"
    assert got[3].reasons == "self_lock"
    assert got[4].reasons == "driver_not_in_owner,user_not_in_owner"
    assert got[5].reasons == "not_user_manager"
    assert got[6].reasons == ""
    applied = {r.id: r for r in C.apply_user_edits(users, judged).collect()}
    assert applied[2].username == "ann" and applied[2].role == "admin" and applied[3].username == "ana"


def test_driver_form_saves_are_whole(spark):
    drivers = spark.createDataFrame([(1, 1, "Ana", "7", "active"), (2, 2, "Bob", None, "active")],
                                    "id long, owner_user_id long, full_name string, dni string, status string")
    cars = spark.createDataFrame([(10, 1, "B", "M", "P10", "active", None), (11, 1, "B", "M", "P11", "inactive", None),
                                  (12, 1, "B", "M", "P12", "active", 2)],
                                 "id long, owner_user_id long, brand string, model string, plate string, "
                                 "status string, current_driver_id long")
    users = spark.createDataFrame([(100, "admin", 1, None)], "id long, role string, owner_user_id long, driver_id long")
    posts = spark.createDataFrame([
        (1, 100, 1, "Ana B", "8", "active", "11"),    # car 11 inactive: whole save fails
        (2, 100, 2, "Bob X", "", "active", "12"),     # driver of tenant 2: no driver edit, car 12 still given
        (3, 100, 0, "Cid", "7", "activo", "10"),      # new driver, dni 7 taken by Ana
        (4, 100, 0, "Dan", "", "activo", "10"),       # new driver gets car 10
    ], "change_seq long, posted_by long, id long, full_name_text string, dni_text string, status_text string, "
       "assigned_car_text string")
    judged = C.judge_driver_saves(posts, drivers, cars, users)
    j = {r.change_seq: r.reasons for r in judged.collect()}
    assert j == {1: "car_unavailable", 2: "", 3: "duplicate_dni", 4: ""}
    out = C.apply_driver_saves(drivers, cars, judged, users)
    d = {r.id: r for r in out["drivers"].collect()}
    assert d[1].full_name == "Ana" and d[2].full_name == "Bob"          # unchanged
    assert sorted(d) == [1, 2, 6]                                         # Cid rejected
    assert d[6].full_name == "Dan" and d[6].owner_user_id == 1 and d[6].status == "active"  # id = max 2 + seq 4
    c = {r.id: r.current_driver_id for r in out["cars"].collect()}
    assert c == {10: 6, 11: None, 12: 2}


def test_new_ids_from_given_base(spark):
    from fleetbook.operators import loads as L

    rows = spark.createDataFrame([(3,), (5,)], "form_seq long")
    existing = spark.createDataFrame([(7,)], "id long")
    assert sorted(r.i for r in rows.select(L.new_ids(rows, existing).alias("i")).collect()) == [10, 12]
    assert sorted(r.i for r in rows.select(L.new_ids(rows, existing, id_base=100).alias("i")).collect()) == [103, 105]


def test_car_label_list_per_driver(spark):
    from fleetbook.operators import rosters as R

    cars = spark.createDataFrame([
        (1, "Toyota", "Etios", "BB2", "active", 7), (2, "Fiat", "Uno", "ZZ9", "active", 7),
        (3, "Toyota", "Etios", "AA1", "active", 7), (4, "Ford", None, "CC3", "active", 7),
        (5, "Audi", "A1", "DD4", "inactive", 7), (6, "Kia", "Rio", "EE5", "active", None)],
        "id long, brand string, model string, plate string, status string, current_driver_id long")
    r = one(R.cars_per_driver(cars))
    assert r.current_driver_id == 7 and r.cars_count == 4          # inactive and unassigned cars excluded
    assert r.car_labels == "Fiat Uno - ZZ9, Toyota Etios - AA1, Toyota Etios - BB2"   # NULL label skipped
