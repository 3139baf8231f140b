"""Joins that bring no hot or missing key into one task, and requests that meet one sum a day."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetbook.operators import deletes as D
from fleetbook.operators import loads as L
from fleetbook.operators import rollups
from fleetbook.schemas import ForeignKey
from fleetbook.sources.fixtures import TestdataTables

AS_OF = dt.date(1997, 3, 15)
PLAIN = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}


@pytest.fixture
def shuffled(spark):
    """Joins by shuffle, without adaptive execution."""
    was = {k: spark.conf.get(k) for k in PLAIN}
    for k, v in PLAIN.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in was.items():
        spark.conf.set(k, v)


def most_in_a_task(df, where="true"):
    n = [r[1] for r in df.where(where).groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(n) / sum(n)


FORMS = ("form_seq long, posted_by long, period_type_text string, entry_date_text string, entry_week_text string, driver_id_text string, car_id_text string, gross_text string, "
         "app_text string, cash_text string, rental_text string, fuel_text string, km_text string, status_text string, observations_text string")


def forms(spark, n, poster, car):
    return spark.createDataFrame([(i, poster(i), "day", "1997-03-05", "", "1", car(i), "1", "", "", "", "", "", "pending", "") for i in range(n)], FORMS)


def users(spark):
    return spark.createDataFrame([(1, "admin", 1, None), (1, "driver", 2, 7), (None, "admin", 3, None)], "id long, role string, owner_user_id long, driver_id long")


def test_posters_are_spread(shuffled, monkeypatch):
    monkeypatch.setattr(L, "KEY_ROWS", 50)
    for poster in (lambda i: None, lambda i: 1):
        assert most_in_a_task(L.clean_entry_forms(forms(shuffled, 2000, poster, lambda i: "1"), users(shuffled), AS_OF)) < 0.5


def test_spread_join_equals_left_join(shuffled, monkeypatch):
    monkeypatch.setattr(L, "KEY_ROWS", 3)
    rows = shuffled.createDataFrame([(i, None if i % 5 == 0 else 1 if i % 2 else i % 7) for i in range(200)] + [(None, 1)], "seq long, k long")
    table = users(shuffled).select(F.col("id").alias("t"), "role")
    got = L.spread_join(rows, table, "k", "t", "seq").select("seq", "k", "t", "role")
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.join(table, rows.k == table.t, "left").collect()))


def test_forms_without_a_car_are_spread(shuffled):
    drivers = shuffled.createDataFrame([(1, 1, "active")], "id long, owner_user_id long, status string")
    cars = shuffled.createDataFrame([(1, 1, "active", 1), (0, 1, "active", 1), (0, 2, "active", 1)], "id long, owner_user_id long, status string, current_driver_id long")
    cleaned = L.clean_entry_forms(forms(shuffled, 2000, lambda i: 1, lambda i: ""), users(shuffled).where("role = 'admin'"), AS_OF)
    judged = L.validate_entry_loads(cleaned, drivers, cars)
    assert most_in_a_task(judged) < 0.5
    # each car of that id is met once, as before
    assert judged.groupBy("reasons").count().collect() == [("no_car", 4000)]


def test_rows_without_reference_are_spread(shuffled):
    key = ForeignKey("entries", "created_by", "users", "set_null")
    tables = {"users": shuffled.range(5).select("id"), "entries": shuffled.range(2000).select("id", F.when(F.col("id") < 10, F.col("id") % 5).alias("created_by"))}
    after, _ = D.apply_deletes_of(tables, "users", shuffled.range(3).select("id"), (key,))
    assert most_in_a_task(after["entries"]) < 0.5
    assert {r.created_by for r in after["entries"].collect()} == {None, 3, 4} and after["entries"].count() == 2000


def test_only_accepted_candidates_travel(spark):
    v = spark.range(10).select(F.col("id").alias("form_seq"), (F.col("id") % 3).alias("k"), F.when(F.col("id") > 5, "bad").otherwise("").alias("reasons"))
    got = L.batch_key_conflicts(v, spark.createDataFrame([(2,)], "k long"), ["k"], eligible=F.col("reasons") == "", others=False)
    assert {r.form_seq: r._conflict for r in got.collect()} == {0: None, 1: None, 2: "duplicate", 3: "duplicate", 4: "duplicate", 5: "duplicate"}


def test_owners_do_not_shuffle_entries(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    try:
        plan = TestdataTables(spark, "/root/testdata/sf0.01").daily_entries._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "hashpartitioning(l_suppkey" not in plan


def test_a_requested_day_meets_one_sum(spark):
    day = dt.date(1997, 3, 5)
    entries = spark.range(300).select(F.lit(1).cast("long").alias("owner_user_id"), F.when(F.col("id") % 10 > 0, F.col("id") % 100).alias("driver_id"), F.lit(day).alias("entry_date"),
                                      F.lit(2).cast("decimal(12,2)").alias("gross_income"), F.lit(1).cast("decimal(12,2)").alias("net_total"))
    asked = [(1, 1, None), (2, 1, 7), (3, 1, 10), (4, 2, None), (5, None, None), (1, 1, 7), (None, 1, 7)]
    requests = spark.createDataFrame([(*r, "day", "1997-03-05", "", "") for r in asked],
                                     "request_id long, owner_user_id long, driver_id long, period_text string, date_text string, week_text string, month_text string")
    df = rollups.requested_totals(requests, entries, AS_OF)
    got = {(r.request_id, r.entries, r.days, int(r.gross), int(r.net)) for r in df.collect()}
    assert got == {(1, 303, 1, 606, 303), (2, 3, 1, 6, 3), (3, 0, 0, 0, 0), (4, 0, 0, 0, 0), (5, 0, 0, 0, 0), (None, 0, 0, 0, 0)}
    joins = [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x]
    assert len(joins) == 1 and "_driver" in joins[0]


def test_requested_days_are_not_broadcast(spark):
    # as many rows as requests, the planner thinks; a month request has thirty
    requests = spark.range(50).select(F.col("id").alias("request_id"), (F.col("id") % 1 + 1).alias("owner_user_id"), F.when(F.col("id") % 2 == 0, F.col("id") % 5).alias("driver_id"),
                                      F.lit("month").alias("period_text"), F.lit("").alias("date_text"), F.lit("").alias("week_text"), F.lit("1997-03").alias("month_text"))
    entries = spark.range(400).select(F.lit(1).cast("long").alias("owner_user_id"), F.when(F.col("id") % 10 > 0, F.col("id") % 5).alias("driver_id"),
                                      F.date_add(F.lit(dt.date(1997, 3, 1)), (F.col("id") % 31).cast("int")).alias("entry_date"),
                                      F.lit(2).cast("decimal(12,2)").alias("gross_income"), F.lit(1).cast("decimal(12,2)").alias("net_total"))
    df = rollups.requested_totals(requests, entries, AS_OF)
    got = {r.request_id: (r.entries, r.days) for r in df.collect()}
    per = {d: sum(1 for i in range(400) if i % 10 and i % 5 == d) for d in range(5)}
    days = {d: len({i % 31 for i in range(400) if i % 10 and i % 5 == d}) for d in range(5)}
    assert got == {i: (400, 31) if i % 2 else (per[i % 5], days[i % 5]) for i in range(50)}
    met = [x for x in df._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in x and "_s_driver" in x]
    assert len(met) == 1 and "SortMergeJoin" in met[0], met


def test_a_taken_key_is_no_single_task(shuffled):
    # all rows want one stored key: in the step that looks at the stored keys they stay where they are
    batch = shuffled.range(2000).select(F.col("id").alias("form_seq"), F.lit(1).cast("long").alias("k"))
    df = L.batch_key_conflicts(batch, shuffled.range(1, 3).select(F.col("id").alias("k")), ["k"])
    assert most_in_a_task(df) < 0.5
    assert df.groupBy("_conflict").count().collect() == [("duplicate", 2000)]


def test_a_batch_is_not_judged_again_for_its_keys(spark):
    batch = spark.range(20).select(F.col("id").alias("form_seq"), F.when(F.col("id") > 2, F.col("id") % 7).alias("k"))
    stored = spark.createDataFrame([(3,), (3,), (None,)], "k long")
    df = L.batch_key_conflicts(batch, stored, ["k"])
    got = {r.form_seq: r._conflict for r in df.collect()}
    assert got == {i: "duplicate" if i > 9 or i == 3 else None for i in range(20)}
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 20") == 1


def test_accepted_loads_drop_unsound_ones_before_the_sessions(spark):
    cars = spark.createDataFrame([(1, 1, "active", 1)], "id long, owner_user_id long, status string, current_driver_id long")
    drivers = spark.createDataFrame([(1, 1, "active")], "id long, owner_user_id long, status string")
    f = forms(spark, 40, lambda i: None if i % 5 == 0 else 1, lambda i: "" if i % 4 == 0 else "1")
    f = f.withColumn("gross_text", F.when(F.col("form_seq") == 3, F.lit("9" * 30)).otherwise("1")).withColumn("driver_id_text", F.when(F.col("form_seq") == 7, "2").otherwise("1"))
    v = L.validate_entry_loads(L.clean_entry_forms(f, users(spark).where("role = 'admin'"), AS_OF), drivers, cars)
    assert "_bad_amount" not in v.columns
    accepted, rejected = L.split_loads(v, spark.createDataFrame([], v.schema))
    assert [r.form_seq for r in accepted.collect()] == [1]
    reasons = {r.form_seq: r.reasons for r in rejected.collect()}
    assert len(reasons) == 39 and (reasons[3], reasons[4], reasons[5], reasons[7]) == ("bad_amount", "no_car", "no_session", "driver_not_in_owner")
    assert reasons[0] == "no_session,no_car" and reasons[2] == "duplicate"
    plan = accepted._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [x for x in plan if "Join LeftOuter" in x and "posted_by" in x and "_at" in x]
