"""A hot key (one driver with a third of all rows) stays correct and is
combined before the shuffle."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from fleetbook.operators import changes as C
from fleetbook.operators import rosters as R

HOT = 7


def _entries(spark, n=120_000):
    k = F.col("id")
    return spark.range(n).select(
        F.lit(1).cast("long").alias("owner_user_id"),
        F.lit("day").alias("period_type"),
        F.date_add(F.lit(dt.date(1997, 1, 1)), (k % 300).cast("int")).alias("entry_date"),
        F.when(k % 3 == 0, F.lit(HOT)).otherwise(k % 997 + 100).cast("long").alias("driver_id"),
        (k % 5000).alias("car_id"),
        (F.lit(10) + k % 7).cast("decimal(12,2)").alias("gross_income"),
        F.lit(1).cast("decimal(12,2)").alias("total_expenses"),
        (F.lit(9) + k % 7).cast("decimal(12,2)").alias("net_total"),
        F.lit(0).cast("decimal(12,2)").alias("app_expenses"),
        F.lit(0).cast("decimal(12,2)").alias("cash_collected"),
        F.lit(1).cast("decimal(12,2)").alias("rental_amount"),
        F.lit("pending").alias("rental_billing_status"),
    )


def test_hot_driver_stats(spark):
    e = _entries(spark)
    stats = R.lifetime_stats(e, "driver_id")
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "partial_sum" in plan      # combined inside each task
    hot = stats.where(F.col("driver_id") == HOT).first()
    assert hot.entries_count == 40_000
    assert hot.income_total == e.where(F.col("driver_id") == HOT).agg(F.sum("gross_income")).first()[0]
    assert stats.agg(F.sum("entries_count")).first()[0] == 120_000


def test_hot_key_newest_change(spark):
    # a third of all changes target one key: one winner, chosen inside each task first
    ch = spark.range(90_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id")).cast("long").alias("k"),
        F.col("id").alias("change_seq"), (F.col("id") * 2).alias("v"))
    newest = C.newest_per_key(ch, ["k"], "change_seq")
    assert "partial_max" in newest._jdf.queryExecution().executedPlan().toString()
    hot = newest.where(F.col("k") == 1).first()
    assert (hot.change_seq, hot.v) == (89_997, 179_994)
    assert newest.count() == 60_000   # id 1 also maps to the hot key 1


def test_hot_driver_updates(spark):
    # a third of the posts move one driver's entries, another third want one and the same key
    e = _entries(spark, 30_000).withColumn("car_id", F.col("car_id") + 1).dropDuplicates(["period_type", "entry_date", "driver_id", "car_id"])
    e = e.select(F.expr("(datediff(entry_date, date'1990-01-01') * 1100 + driver_id) * 5002 + car_id").cast("long").alias("id"), "*",
                 F.lit(0).cast("decimal(12,2)").alias("fuel_cost"), F.lit(0).cast("decimal(10,2)").alias("distance_km"),
                 F.lit(None).cast("string").alias("observations"), F.lit(None).cast("long").alias("updated_by"))
    users = spark.createDataFrame([(1, "admin", 1, None)], "id long, role string, owner_user_id long, driver_id long")
    drivers = e.select(F.col("driver_id").alias("id"), F.lit(1).cast("long").alias("owner_user_id"), F.lit("active").alias("status")).distinct()
    cars = spark.range(1, 5001).select("id", F.lit(1).cast("long").alias("owner_user_id"), F.lit("active").alias("status"),
                                    F.lit(None).cast("long").alias("current_driver_id"))
    hot = F.col("driver_id") == HOT
    wanted = F.col("id") % 3 == 1
    edits = e.where(hot | wanted).select(
        F.col("id").alias("change_seq"), "id", F.lit(1).cast("long").alias("posted_by"), "period_type",
        F.when(hot, F.date_add("entry_date", 1000)).otherwise(F.lit(dt.date(2001, 1, 1))).alias("entry_date"),
        F.when(hot, F.col("driver_id")).otherwise(F.lit(HOT)).alias("driver_id"),
        F.when(hot, F.col("car_id")).otherwise(F.lit(1)).alias("car_id"),
        F.lit(100).cast("decimal(12,2)").alias("gross_income"), "app_expenses", "cash_collected", "rental_amount", "fuel_cost", "distance_km",
        F.lit("pending").alias("status_text"), F.lit("x").alias("observations"))
    judged = C.judge_entry_edits(edits, e, users, drivers, cars)
    reasons = {r.reasons: r["count"] for r in judged.groupBy("reasons").count().collect()}
    n_hot, n_cold = e.where(hot).count(), e.where(~hot & wanted).count()
    assert reasons == {"": n_hot + 1, "duplicate": n_cold - 1}
    out = C.apply_entry_edits(e, judged)
    changed = out.where("updated_by is not null")
    assert changed.count() == n_hot + 1 and changed.where("gross_income <> 100 or net_total <> 99").count() == 0
    assert out.count() == e.count()
    assert out.where("updated_by is null").select(*e.columns).join(e, e.columns[:6], "left_anti").count() == 0
