"""Fleet tables derived from the driver-generated test parquet.

The test data is a TPC-H-like star schema; these derivations map it onto the
fleet data model (suppliers are drivers, parts are cars, customers are
users, line items are entry loads, orders are fleet expenses, events are
access tokens). Ids are shifted by +1 because 0 means "all" in request
parameters. The derivations follow the view definitions that come with the
test data; like stored rows, entries carry their derived columns (deductions,
net, week / month / year), which the operators that derive them
(``entry_math``, ``with_period_columns``) are checked against.

Joins here are left to Spark's planner: ``nation`` has a fixed size (25 rows by
the TPC-H definition) and is looked up in a map; supplier / customer / part
grow with the scale factor and are joined by whatever AQE picks from measured
sizes.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetbook.schemas import DISTANCE, MONEY


def _money(c: Column) -> Column:
    return c.cast(MONEY)


class TestdataTables:
    """Lazily built fleet tables over ``{sf_dir}/{table}.parquet``."""

    __test__ = False  # not a pytest test class

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # --- counts used as scalar subqueries (kept lazy) ---------------------
    @cached_property
    def supplier_count(self) -> Column:
        return self.raw("supplier").select(F.count(F.lit(1))).scalar()

    @cached_property
    def customer_count(self) -> Column:
        return self.raw("customer").select(F.count(F.lit(1))).scalar()

    @cached_property
    def part_count(self) -> Column:
        return self.raw("part").select(F.count(F.lit(1))).scalar()

    @cached_property
    def _regions(self) -> Column:
        """Regions of each nation as one map (25 nations by definition), a scalar subquery."""
        n = self.raw("nation").where("n_nationkey is not null").groupBy("n_nationkey")
        n = n.agg(F.collect_list(F.struct("n_regionkey")).alias("r"))
        return n.select(F.map_from_entries(F.collect_list(F.struct("n_nationkey", "r")))).scalar()

    def _with_region(self, rows: DataFrame, nation: str) -> DataFrame:
        """``rows`` with ``n_regionkey``, those of a nation that is there (a row per nation row).

        Looked up, not joined: the planner takes a join's size for the product of its
        sides, so tables small enough to broadcast would be shuffled with the large ones.
        """
        return rows.withColumn("_r", F.explode(self._regions[F.col(nation)])).select(*rows.columns, "_r.n_regionkey")

    # --- dimensions ------------------------------------------------------
    @cached_property
    def drivers(self) -> DataFrame:
        s = self.raw("supplier")
        return (
            self._with_region(s, "s_nationkey")
            .select(
                (F.col("s_suppkey") + 1).cast("bigint").alias("id"),
                (F.col("n_regionkey") + 1).cast("bigint").alias("owner_user_id"),
                F.col("s_name").alias("full_name"),
                F.when(F.col("s_suppkey") % 10 == 0, F.lit(None).cast("string"))
                .otherwise((F.lit(30000000) + F.col("s_suppkey") % 90).cast("string"))
                .alias("dni"),
                F.when(F.col("s_acctbal") < 0, "inactive").otherwise("active").alias("status"),
            )
        )

    @cached_property
    def cars(self) -> DataFrame:
        p = self.raw("part")
        k = F.col("p_partkey")
        return p.select(
            (k + 1).cast("bigint").alias("id"),
            (k % 5 + 1).cast("bigint").alias("owner_user_id"),
            F.col("p_brand").alias("brand"),
            F.col("p_type").alias("model"),
            F.concat(F.lit("P"), k.cast("string")).alias("plate"),
            F.when(F.col("p_size") > 45, "inactive").otherwise("active").alias("status"),
            F.when(k % 4 == 0, F.lit(None).cast("bigint"))
            .otherwise((k % self.supplier_count + 1).cast("bigint"))
            .alias("current_driver_id"),
        )

    @cached_property
    def users(self) -> DataFrame:
        c = self.raw("customer")
        k = F.col("c_custkey")
        building = F.col("c_mktsegment") == "BUILDING"
        return (
            self._with_region(c, "c_nationkey")
            .select(
                (k + 1).cast("bigint").alias("id"),
                F.col("c_name").alias("full_name"),
                F.lower("c_name").alias("username"),
                F.when(building, "admin").otherwise("driver").alias("role"),
                F.when(building | (k % 3 == 0), F.lit(None).cast("bigint"))
                .otherwise((k % self.supplier_count + 1).cast("bigint"))
                .alias("driver_id"),
                (F.col("n_regionkey") + 1).cast("bigint").alias("owner_user_id"),
                F.when(F.col("c_acctbal") < 0, F.lit(0)).otherwise(F.lit(1)).alias("is_active"),
            )
        )

    # --- facts -----------------------------------------------------------
    @cached_property
    def entry_amounts(self) -> DataFrame:
        li = self.raw("lineitem")
        sup = self.raw("supplier").select("s_suppkey", "s_nationkey")
        owners = self._with_region(sup, "s_nationkey").select(
            "s_suppkey", (F.col("n_regionkey") + 1).cast("bigint").alias("owner_user_id"))
        weekly = F.col("l_returnflag") == "R"
        ship = F.to_date("l_shipdate")
        gross = _money(F.col("l_extendedprice"))
        return li.join(owners, li.l_suppkey == owners.s_suppkey).select(
            "owner_user_id",
            F.when(weekly, "week").otherwise("day").alias("period_type"),
            F.when(weekly, F.trunc(ship, "week")).otherwise(ship).alias("entry_date"),
            (F.col("l_suppkey") + 1).alias("driver_id"),
            (F.col("l_partkey") + 1).alias("car_id"),
            gross.alias("gross_income"),
            _money(F.round(gross * F.col("l_discount").cast("decimal(4,2)"), 2)).alias("app_expenses"),
            _money(F.round(gross * F.col("l_tax").cast("decimal(4,2)"), 2)).alias("cash_collected"),
            _money(F.col("l_quantity") * 1000).alias("rental_amount"),
            F.when(F.col("l_linestatus") == "F", "invoiced").otherwise("pending")
            .alias("rental_billing_status"),
            _money(F.col("l_quantity") * 10).alias("fuel_cost"),
            F.col("l_quantity").cast(DISTANCE).alias("distance_km"),
            F.when(F.col("l_orderkey") % 7 == 0, F.lit(None).cast("bigint"))
            .otherwise((F.col("l_orderkey") % self.customer_count + 1).cast("bigint"))
            .alias("created_by"),
        )

    @cached_property
    def daily_entries(self) -> DataFrame:
        return self._derived(self.entry_amounts)

    @staticmethod
    def _derived(amounts: DataFrame) -> DataFrame:
        deductions = F.col("app_expenses") + F.col("cash_collected") + F.col("rental_amount")
        d = F.col("entry_date")
        return amounts.select(
            "owner_user_id", "period_type", "entry_date", "driver_id", "car_id",
            "gross_income", "app_expenses", "cash_collected", "rental_amount",
            "rental_billing_status", "fuel_cost", "distance_km", "created_by",
            _money(deductions).alias("total_expenses"),
            _money(F.col("gross_income") - deductions).alias("net_total"),
            F.weekofyear(d).cast("int").alias("week_number"),
            F.month(d).cast("int").alias("month_number"),
            F.year(d).cast("int").alias("year_number"),
        )

    @cached_property
    def entries_unique(self) -> DataFrame:
        """One row per unique key (period_type, entry_date, driver_id, car_id).

        The kept row is the largest by (gross, rental, app, cash, created_by,
        status); written as a grouped ``max`` of a struct, which aggregates
        partially before the shuffle, so a hot key costs no more than a cold one.
        Columns derived from the others decide nothing and are derived anew behind it.
        """
        key = ["period_type", "entry_date", "driver_id", "car_id"]
        order = ["gross_income", "rental_amount", "app_expenses", "cash_collected",
                 "created_by", "rental_billing_status"]
        rest = [c for c in self.entry_amounts.columns if c not in key + order]
        best = F.max(F.struct(*[F.col(c) for c in order + rest])).alias("m")
        return self._derived(self.entry_amounts.groupBy(*key).agg(best)
                             .select(*key, *[F.col(f"m.{c}").alias(c) for c in order + rest]))

    @cached_property
    def entries(self) -> DataFrame:
        """Stored entries with their id, observations and last editor.

        The id is the unique key as a number: day and kind of period, driver, car.
        """
        e = self.entries_unique
        day = F.datediff("entry_date", F.lit("1990-01-01").cast("date")).cast("bigint")
        kind = day * 2 + F.when(F.col("period_type") == "week", 1).otherwise(0)
        number = (kind * (self.supplier_count + 1) + F.col("driver_id")) * (self.part_count + 1) + F.col("car_id")
        return e.select(number.cast("bigint").alias("id"), *e.columns, F.lit(None).cast("string").alias("observations"),
                        F.lit(None).cast("bigint").alias("updated_by"))

    @cached_property
    def general_expenses(self) -> DataFrame:
        o = self.raw("orders")
        cust = self.raw("customer").select("c_custkey", "c_nationkey")
        owners = self._with_region(cust, "c_nationkey").select(
            "c_custkey", (F.col("n_regionkey") + 1).cast("bigint").alias("owner_user_id"))
        return o.join(owners, o.o_custkey == owners.c_custkey).select(
            (F.col("o_orderkey") + 1).alias("id"),
            "owner_user_id",
            F.to_date("o_orderdate").alias("expense_date"),
            _money(F.col("o_totalprice")).alias("amount"),
            F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(F.col("o_orderpriority"))
            .alias("observations"),
            F.when(F.col("o_orderkey") % 7 == 0, F.lit(None).cast("bigint"))
            .otherwise(F.col("o_custkey") + 1).alias("created_by"),
        )

    @cached_property
    def weekly_money_notes(self) -> DataFrame:
        ge = self.general_expenses.where(F.col("observations") == "1-URGENT")
        return (
            ge.groupBy("owner_user_id", F.trunc("expense_date", "week").alias("week_start"))
            .agg(F.max("id").alias("last_order"), F.max("created_by").alias("updated_by"))
            .select(
                "owner_user_id", "week_start",
                F.date_add("week_start", 6).alias("week_end"),
                F.concat(F.lit("note "), F.col("last_order").cast("string")).alias("notes"),
                "updated_by",
            )
        )

    @cached_property
    def access_tokens(self) -> DataFrame:
        ev = self.raw("events")
        return ev.select(
            F.col("event_id").alias("id"),
            (F.col("user_id") + 1).alias("user_id"),
            F.col("ts").alias("created_at"),
            (F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("expires_at"),
            F.when(F.col("event_id") % 5 == 0, F.col("ts") + F.expr("INTERVAL 1 HOURS"))
            .alias("used_at"),
            F.when(F.col("event_type").isin("click", "view"), "remember").otherwise("reset").alias("kind"),
        )

    @cached_property
    def raw_amounts(self) -> DataFrame:
        li = self.raw("lineitem")
        k = F.col("l_orderkey")
        comma_text = F.concat(
            F.lit("1."),
            F.replace((F.lit(100) + F.col("l_quantity")).cast("decimal(12,2)").cast("string"),
                      F.lit("."), F.lit(",")))
        plain_text = F.concat(F.lit(" "), _money(F.col("l_extendedprice")).cast("string"), F.lit(" "))
        return li.select(
            "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_shipdate",
            F.when(k % 11 == 0, "").when(k % 13 == 0, "abc")
            .when(F.col("l_linenumber") % 2 == 0, comma_text)
            .otherwise(plain_text).alias("amount_text"),
        )

    @cached_property
    def legacy_entries(self) -> DataFrame:
        e = self.entries_unique
        zero = F.lit(0).cast(MONEY)
        return e.select(
            "owner_user_id", "period_type", "entry_date", "driver_id", "car_id", "gross_income",
            _money(F.when(F.col("driver_id") % 2 == 0, zero).otherwise(F.col("app_expenses")))
            .alias("app_expenses"),
            F.when(F.col("car_id") % 3 == 0, F.lit(None)).otherwise(F.col("fuel_cost")).alias("wash_cost"),
            F.when(F.col("car_id") % 5 == 0, F.lit(None)).otherwise(F.col("distance_km")).alias("tolls_cost"),
            F.col("cash_collected").alias("maintenance_cost"),
            F.lit(None).cast(MONEY).alias("other_expenses"),
            _money(F.when(F.col("driver_id") % 3 == 0, zero).otherwise(F.col("total_expenses")))
            .alias("total_expenses"),
            _money(F.when(F.col("driver_id") % 3 == 0, zero).otherwise(F.col("net_total")))
            .alias("net_total"),
        )


def testdata_tables(spark: SparkSession, sf_dir: str) -> TestdataTables:
    return TestdataTables(spark, sf_dir)
