"""The latest-weeks / latest-months widgets against brute force."""

from __future__ import annotations

import datetime as dt
import random
import tempfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fleetbook.operators import rollups
from fleetbook.scope import Scope
from fleetbook.sources.tables import read_table, write_table

SCHEMA = ("owner_user_id long, driver_id long, car_id long, entry_date date, gross_income decimal(12,2), "
          "total_expenses decimal(12,2), net_total decimal(12,2)")


def _entries(spark, seed):
    rnd = random.Random(seed)
    days = []
    for _ in range(rnd.randint(3, 60)):
        y = rnd.choice([2015, 2018, 2019, 2020, 2021, 2024])
        # favour the year edges, where ISO weeks cross calendar years
        d = rnd.choice([dt.date(y, 12, rnd.randint(25, 31)), dt.date(y, 1, rnd.randint(1, 5)),
                        dt.date(y, rnd.randint(1, 12), rnd.randint(1, 28))])
        days.append((rnd.choice([1, 1, 2]), 1, 1, d, Decimal(rnd.randint(1, 99)), Decimal(1),
                     Decimal(rnd.randint(-9, 99))))
    df = spark.createDataFrame(days, SCHEMA)
    return (df.withColumn("week_number", F.weekofyear("entry_date"))
              .withColumn("month_number", F.month("entry_date"))
              .withColumn("year_number", F.year("entry_date")))


def _brute_weeks(e, limit=8):
    e = e.where(F.col("owner_user_id") == 1)
    return (e.groupBy("year_number", "week_number")
             .agg(F.min("entry_date").alias("start_date"), F.max("entry_date").alias("end_date"),
                  F.sum("gross_income").alias("income"), F.sum("total_expenses").alias("expenses"),
                  F.sum("net_total").alias("net"))
             .orderBy(F.col("start_date").desc()).limit(limit))


def _brute_months(e, limit=8):
    e = e.where(F.col("owner_user_id") == 1)
    return (e.groupBy("year_number", "month_number")
             .agg(F.sum("gross_income").alias("income"), F.sum("total_expenses").alias("expenses"),
                  F.sum("net_total").alias("net"))
             .orderBy(F.col("year_number").desc(), F.col("month_number").desc()).limit(limit))


@pytest.mark.parametrize("seed", range(8))
def test_comparisons_equal_brute_force(spark, seed):
    e = _entries(spark, seed)
    for limit in (1, 3, 8):
        got = sorted(map(tuple, rollups.weekly_comparison(e, Scope.admin(1), limit).collect()))
        want = sorted(map(tuple, _brute_weeks(e, limit).collect()))
        assert got == want, (seed, limit)
        got = sorted(map(tuple, rollups.monthly_comparison(e, Scope.admin(1), limit).collect()))
        want = sorted(map(tuple, _brute_months(e, limit).collect()))
        assert got == want, (seed, limit)


def test_rows_with_other_stored_periods_are_kept(spark):
    # a stored month that disagrees with the date must not make rows vanish
    from fleetbook.operators.audits import period_mismatches
    from fleetbook.operators.filters import in_period
    from fleetbook.functions.periods import period_range

    path = tempfile.mkdtemp(prefix="fleetbook-cmp-")
    df = _entries(spark, 1).limit(1).withColumn("entry_date", F.lit(dt.date(1997, 3, 5)))
    df = df.withColumn("week_number", F.lit(10)).withColumn("month_number", F.lit(7)).withColumn("year_number", F.lit(1990))
    write_table(df, path, "daily_entries")
    stored = read_table(spark, path, "daily_entries")
    assert stored.columns == df.columns
    assert in_period(stored, period_range("month", month="1997-03")).count() == 1
    assert period_mismatches(stored).count() == 1
    whole = stored.withColumn("owner_user_id", F.lit(1).cast("long"))
    assert [r.month_number for r in rollups.monthly_comparison(whole, Scope.admin(1)).collect()] == [7]
