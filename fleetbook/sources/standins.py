"""Input batches for the load, change and audit jobs, derived from the test tables.

In production these batches are what users post (load forms, edits, status
changes, deletes). Here each is derived from a test table so that its size
grows with the scale factor. Every derivation only fills the raw fields a
batch carries (text as typed, ids as posted, the posting user); cleaning,
validation, scoping and application are the jobs' work, done by the
operators.
"""

from __future__ import annotations

from decimal import Decimal
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetbook.sources.fixtures import TestdataTables


def _money_times(price, factor):
    """price (as cents) times an exact decimal factor, rounded to cents."""
    return F.round(price.cast("decimal(12,2)") * factor, 2).cast("decimal(12,2)")


def user_manager(users: DataFrame, col: str) -> Column:
    """``col`` of the account that manages users in the batches: the admin with the
    first username (a scalar subquery; the fixed account name is not in the test data)."""
    return users.where(F.col("role") == "admin").select(F.min_by(col, "username")).scalar()


class StandinBatches:
    def __init__(self, t: TestdataTables):
        self.t = t

    def _with_tenant_admin(self, df: DataFrame, owner: str) -> DataFrame:
        """``df`` with ``tenant_admin``: the first admin of the row's tenant.

        Tenants are the regions, of fixed number: looked up in a map like these, since the planner
        would take the joined table for too large to broadcast and shuffle what it is joined with.
        """
        u = self.t.users.where((F.col("role") == "admin") & F.col("owner_user_id").isNotNull())
        first = u.groupBy("owner_user_id").agg(F.min("id").alias("tenant_admin"))
        admins = first.select(F.map_from_entries(F.collect_list(F.struct("owner_user_id", "tenant_admin")))).scalar()
        return df.withColumn("tenant_admin", admins[F.col(owner)])

    @cached_property
    def entry_forms(self) -> DataFrame:
        """Posted entry load forms, one per line item, all fields as text: the first three lines of an
        order by the first admin of the driver's tenant, for cars of that tenant."""
        d = self._with_tenant_admin(self.t.drivers.select((F.col("id") - 1).alias("l_suppkey"), "owner_user_id"), "owner_user_id")
        li = self.t.raw("lineitem").join(d, "l_suppkey", "left")
        ship = F.to_date("l_shipdate").cast("string")
        ln = F.col("l_linenumber")
        return li.select(
            (F.col("l_orderkey") * 10 + ln).alias("form_seq"),
            F.when(F.col("l_orderkey") % 7 == 0, F.lit(None).cast("bigint"))
            .when(ln <= 3, F.col("tenant_admin"))
            .otherwise((F.col("l_orderkey") % self.t.customer_count + 1).cast("bigint"))
            .alias("posted_by"),
            F.when(F.col("l_returnflag") == "R", "week").when(F.col("l_returnflag") == "A", "day")
            .otherwise("daily").alias("period_type_text"),
            F.when(ln == 7, F.concat(F.substring(ship, 1, 8), F.lit("31")))
            .when(ln == 6, F.lit("ayer")).otherwise(ship).alias("entry_date_text"),
            F.concat(F.year("l_shipdate").cast("string"), F.lit("-W"),
                     F.lpad((ln * 8).cast("string"), 2, "0")).alias("entry_week_text"),
            (F.col("l_suppkey") + 1).cast("string").alias("driver_id_text"),
            F.when(ln == 5, F.lit("")).when(ln <= 3, (F.col("owner_user_id") + F.floor(F.col("l_partkey") / 5) * 5).cast("string"))
            .otherwise((F.col("l_partkey") + 2).cast("string")).alias("car_id_text"),
            F.concat(F.lit(" "), F.col("l_extendedprice").cast("decimal(12,2)").cast("string"))
            .alias("gross_text"),
            F.replace(_money_times(F.col("l_extendedprice"), F.col("l_discount").cast("decimal(4,2)"))
                      .cast("string"), F.lit("."), F.lit(",")).alias("app_text"),
            F.lit("").alias("cash_text"),
            (F.col("l_quantity") * 1000).cast("bigint").cast("string").alias("rental_text"),
            F.concat((F.col("l_quantity") * 10).cast("bigint").cast("string"), F.lit("abc"))
            .alias("fuel_text"),
            F.col("l_quantity").cast("string").alias("km_text"),
            F.when(F.col("l_linestatus") == "F", "invoiced").otherwise("facturado")
            .alias("status_text"),
            F.concat(F.lit("  "), F.col("l_returnflag"), F.lit(" ")).alias("observations_text"),
        )

    @cached_property
    def expense_forms(self) -> DataFrame:
        """Posted fleet expense forms, one per order."""
        o = self.t.raw("orders")
        return o.select(
            (F.col("o_orderkey") + 1).alias("form_seq"),
            (F.col("o_custkey") + 1).alias("posted_by"),
            F.when(F.col("o_orderstatus") == "P", F.lit("01/02/1997"))
            .otherwise(F.to_date("o_orderdate").cast("string")).alias("expense_date_text"),
            F.when(F.col("o_orderpriority") == "5-LOW", F.lit("0"))
            .when(F.col("o_orderpriority") == "3-MEDIUM",
                  F.replace(F.col("o_totalprice").cast("decimal(12,2)").cast("string"),
                            F.lit("."), F.lit(",")))
            .otherwise(F.col("o_totalprice").cast("decimal(12,2)").cast("string")).alias("amount_text"),
            F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit(" ")).alias("observations_text"),
        )

    @cached_property
    def driver_forms(self) -> DataFrame:
        """Posted new-driver forms, one per customer, posted by that customer's own user."""
        c = self.t.raw("customer")
        k = F.col("c_custkey")
        return c.select(
            (k + 1).alias("form_seq"),
            (k + 1).alias("posted_by"),
            F.concat(F.lit("  "), F.col("c_name"), F.lit(" ")).alias("full_name_text"),
            F.when(k % 4 == 0, F.lit("")).otherwise((F.lit(30000000) + k % 97).cast("string"))
            .alias("dni_text"),
            F.when(F.col("c_acctbal") < 100, F.lit("inactive")).otherwise(F.lit("activo"))
            .alias("status_text"),
        )

    @cached_property
    def car_forms(self) -> DataFrame:
        """Posted car edit forms, one per part (the form edits the car of that part)."""
        p = self.t.raw("part")
        k = F.col("p_partkey")
        return p.select(
            (k + 1).alias("form_seq"),
            (k * 13 % self.t.customer_count + 1).alias("posted_by"),
            F.concat(F.lit(" "), F.col("p_brand")).alias("brand_text"),
            F.when(F.col("p_size") == 1, F.lit(" ")).otherwise(F.col("p_type")).alias("model_text"),
            F.concat(F.lit(" p"), k.cast("string"), F.lit(" ")).alias("plate_text"),
            F.when(F.col("p_size") > 40, F.lit("")).otherwise((F.lit(1990) + F.col("p_size")).cast("string"))
            .alias("year_text"),
            F.when(F.col("p_size") % 3 == 0, F.lit("inactive")).otherwise(F.lit("active"))
            .alias("status_text"),
        )

    @cached_property
    def token_details(self) -> DataFrame:
        """Access-token rows with selector, user agent and address as stored."""
        ev = self.t.raw("events")
        sha = F.sha2(F.col("event_id").cast("string"), 256)
        return ev.select(
            F.col("event_id").alias("id"),
            F.when(F.col("event_type") == "error", F.upper(F.substring(sha, 1, 24)))
            .otherwise(F.substring(sha, 1, 24)).alias("selector"),
            F.when(F.col("event_type") == "view", F.col("props")).otherwise(sha).alias("token_hash"),
            F.repeat(F.concat(F.col("event_type"), F.when(F.col("event_id") % 3 == 0, F.lit(" ñ€\U0001f600 ")).otherwise(F.lit(" "))), 40).alias("user_agent"),
            F.repeat(F.col("props"), 5).alias("ip_address"),
        )

    def _posted_entries(self) -> DataFrame:
        """Stored entries with the account that posts their changes: their tenant's first admin, for
        every eighth the user linked to their driver, for another eighth any user."""
        k = F.col("id")
        poster = (F.when(k % 8 == 1, F.col("driver_id") + self.t.supplier_count)
                  .when(k % 8 == 2, k % self.t.customer_count + 1).otherwise(F.col("tenant_admin")))
        return self._with_tenant_admin(self.t.entries, "owner_user_id").withColumn("posted_by", poster)

    @cached_property
    def billing_changes(self) -> DataFrame:
        """Billing-status posts by entry id: one for every entry, and a later one for every third."""
        e = self._posted_entries()
        k = F.col("id")
        status = F.when(F.col("rental_billing_status") == "pending", F.lit("invoiced")).otherwise(F.lit("facturado"))
        posts = F.array(F.struct((k * 2).alias("change_seq"), status.alias("status_text")),
                        F.when(k % 3 == 0, F.struct((k * 2 + 1).alias("change_seq"), F.lit("pending").alias("status_text"))))
        return e.select("id", "posted_by", F.explode(posts).alias("p")).where("p is not null").select(
            "p.change_seq", "id", "p.status_text", "posted_by")

    @cached_property
    def entry_edits(self) -> DataFrame:
        """Edited entries, posted as whole forms by entry id.

        Every entry is moved to its month's first day (every fifth one as a weekly entry) and to one of its
        tenant's first cars, so several want one key; some ten days of posts later, every third one moves
        on to the next day and frees the key. Every hundredth names an entry that is not there.
        """
        e = self._posted_entries()
        k = F.col("id")
        ten_days = F.lit(20).cast("bigint") * (self.t.supplier_count + 1) * (self.t.part_count + 1)
        own_car = F.col("driver_id") + self.t.supplier_count * (1 + k % 3)
        car = F.when(k % 8 == 1, own_car).otherwise(F.col("owner_user_id") + 5 * (F.col("car_id") % 9))
        month = F.trunc("entry_date", "month")
        first = F.struct((k * 2).alias("change_seq"), F.when(k % 100 == 99, k + 1).otherwise(k).alias("id"),
                         F.when(k % 5 == 0, F.lit("week")).otherwise(F.lit("day")).alias("period_type"), month.alias("entry_date"),
                         F.lit(Decimal("1.1")).alias("rate"), F.lit("invoiced").alias("status_text"))
        later = F.struct(((k + ten_days) * 2 + 1).alias("change_seq"), k.alias("id"), F.lit("day").alias("period_type"),
                         F.date_add(month, 1).alias("entry_date"), F.lit(Decimal("1.2")).alias("rate"), F.lit("facturado").alias("status_text"))
        posts = F.array(first, F.when(k % 3 == 0, later))
        x = e.withColumn("car", car).withColumn("p", F.explode(posts)).where("p is not null")
        return x.select(
            "p.change_seq", "p.id", "posted_by", "p.period_type", "p.entry_date", "driver_id", F.col("car").alias("car_id"),
            _money_times(F.col("gross_income"), F.col("p.rate")).alias("gross_income"), "app_expenses",
            F.lit(0).cast("decimal(12,2)").alias("cash_collected"), "rental_amount", "fuel_cost", "distance_km", "p.status_text",
            F.concat(F.lit("edit "), F.col("p.change_seq").cast("string")).alias("observations"),
        )

    @cached_property
    def entry_deletes(self) -> DataFrame:
        """Delete requests by entry id: every weekly entry."""
        e = self._posted_entries().where(F.col("period_type") == "week")
        return e.select("id", "posted_by")

    @cached_property
    def status_changes(self) -> DataFrame:
        """Activate / deactivate requests for every driver, posted by a user each."""
        d = self.t.drivers
        return d.select(
            F.col("id"),
            F.when(F.col("status") == "active", F.lit("inactivo")).otherwise(F.lit("active"))
            .alias("status_text"),
            (F.col("id") * 3 % self.t.customer_count + 1).alias("posted_by"),
        )

    @cached_property
    def note_posts(self) -> DataFrame:
        """Week-note posts: one per order with priority 2-HIGH."""
        o = self.t.raw("orders").where(F.col("o_orderpriority") == "2-HIGH")
        return o.select(
            (F.col("o_orderkey") + 1).alias("change_seq"),
            (F.col("o_custkey") + 1).alias("posted_by"),
            F.concat(F.extract(F.lit("YEAROFWEEK"), F.to_date("o_orderdate")).cast("string"),
                     F.lit("-W"), F.lpad(F.weekofyear("o_orderdate").cast("string"), 2, "0"))
            .alias("week_text"),
            F.when(F.col("o_orderstatus") == "F", F.lit("  "))
            .otherwise(F.concat(F.lit(" posted "), F.col("o_orderkey").cast("string")))
            .alias("notes_text"),
        )

    @cached_property
    def assignments(self) -> DataFrame:
        """Car assignment posts, one per line item: the supplier's driver gets the part's car, or no
        car on lines returned as 'N'."""
        li = self.t.raw("lineitem")
        return li.select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("change_seq"),
            (F.col("l_orderkey") % self.t.customer_count + 1).alias("posted_by"),
            (F.col("l_suppkey") + 1).alias("driver_id"),
            F.when(F.col("l_returnflag") == "N", F.lit(None).cast("bigint"))
            .otherwise(F.col("l_partkey") + 1).alias("car_id"),
        )

    @cached_property
    def user_edits(self) -> DataFrame:
        """User edit posts, the last user first: one per user, posted by the user itself (every fifth id), the
        next user id (every third) or else the account that manages users. Of seven users one wants the next
        one's username, which that one may have given up."""
        u = self.t.users
        k = F.col("id")
        return u.select(
            (self.t.customer_count + 1 - k).alias("change_seq"), "id",
            F.when(k % 5 == 0, k).when(k % 3 == 0, k + 1).otherwise(user_manager(u, "id")).alias("posted_by"),
            F.upper(F.col("full_name")).alias("full_name_text"),
            F.when(k % 7 == 1, F.concat("username", F.lit(".x")))
            .when(k % 7 == 0, F.format_string("customer#%09d", k)).otherwise(F.col("username")).alias("username_text"),
            F.when(F.col("role") == "admin", F.lit("driver")).otherwise(F.lit("admin")).alias("role_text"),
            F.when(F.col("role") == "admin", k % self.t.supplier_count + 1).alias("driver_id"),
            F.when(k % 4 == 0, F.lit(0)).otherwise(F.lit(1)).alias("is_active"),
        )

    @cached_property
    def driver_edits(self) -> DataFrame:
        """Driver edit posts, one per customer row, most by the tenant's first admin; drivers of a tenant
        want each other's dni."""
        c = self.t.raw("customer").withColumn("id", F.col("c_custkey") % self.t.supplier_count + 1)
        k = F.col("c_custkey")
        d = self._with_tenant_admin(self.t.drivers.select("id", "owner_user_id"), "owner_user_id")
        return c.join(d, "id", "left").select(
            (k + 1).alias("change_seq"), "id",
            F.when(k % 10 == 0, k * 11 % self.t.customer_count + 1).otherwise(F.col("tenant_admin")).alias("posted_by"),
            F.when(k % 9 == 0, F.lit(" ")).otherwise(F.upper("c_name")).alias("full_name_text"),
            F.when(k % 6 == 0, F.lit("")).otherwise((F.lit(30000000) + k * 7 % 90).cast("string")).alias("dni_text"),
            F.when(F.col("c_acctbal") > 5000, F.lit("inactive")).otherwise(F.lit("active")).alias("status_text"),
        )

    @cached_property
    def car_edits(self) -> DataFrame:
        """Car edit forms, the last car first, most by the tenant's first admin: of three cars one takes a new
        plate and two want plates that others may have given up."""
        p = self.t.raw("part").withColumn("owner", (F.col("p_partkey") % 5 + 1).cast("bigint"))
        k = F.col("p_partkey")
        plate = (F.when(k % 3 == 1, F.concat(F.lit("n"), k.cast("string")))
                 .when(k % 3 == 2, F.concat(F.lit(" p"), (k + 5).cast("string")))
                 .otherwise(F.concat(F.lit("P"), (k + 10).cast("string"), F.lit(" "))))
        return self._with_tenant_admin(p, "owner").select(
            (self.t.part_count - k).alias("form_seq"), (k + 1).cast("bigint").alias("id"),
            F.when(k % 10 == 0, k * 13 % self.t.customer_count + 1).otherwise(F.col("tenant_admin")).alias("posted_by"),
            F.concat(F.lit(" "), F.col("p_brand")).alias("brand_text"),
            F.when(F.col("p_size") == 1, F.lit(" ")).otherwise(F.col("p_type")).alias("model_text"),
            plate.alias("plate_text"),
            F.when(F.col("p_size") > 40, F.lit("")).otherwise((F.lit(1990) + F.col("p_size")).cast("string")).alias("year_text"),
            F.when(F.col("p_size") % 3 == 0, F.lit("inactive")).otherwise(F.lit("active")).alias("status_text"),
        )

    @cached_property
    def legacy_users(self) -> DataFrame:
        """Users as before the workspace migration: inactive ones have no owner yet, and the accounts of the
        first installation are there under their names."""
        u = self.t.users
        k = F.col("id")
        named = F.when(k == 2, F.lit("admin")).when(k == 3, F.lit("chofer")).when(k == 5, F.lit("personal")).otherwise(F.col("username"))
        return (u.withColumn("owner_user_id", F.when(F.col("is_active") == 0, F.lit(None).cast("bigint")).otherwise(F.col("owner_user_id")))
                 .withColumn("username", named))

    @cached_property
    def legacy_drivers(self) -> DataFrame:
        """Drivers with the demo driver of the first installation."""
        return self.t.drivers.withColumn("full_name", F.when(F.col("id") == 2, F.lit("Chofer Demo")).otherwise(F.col("full_name")))

    @cached_property
    def legacy_cars(self) -> DataFrame:
        """Cars with the demo car of the first installation."""
        return self.t.cars.withColumn("plate", F.when(F.col("id") == 2, F.lit("AA000AA")).otherwise(F.col("plate")))

    @cached_property
    def imported_entries(self) -> DataFrame:
        """Entries as an import without constraints would bring them: some name drivers, cars or creators
        that are not there, and some have stored periods of another date."""
        k = F.col("car_id") * 7 + F.col("driver_id") + F.dayofyear("entry_date")
        far = F.lit(1_000_000).cast("bigint")
        shifted = {"driver_id": F.when(k % 50 == 0, far + F.col("driver_id")).otherwise(F.col("driver_id")),
                   "car_id": F.when(k % 70 == 1, far + F.col("car_id") % 97).otherwise(F.col("car_id")),
                   "created_by": F.when(k % 90 == 2, far + F.col("created_by") % 89).otherwise(F.col("created_by")),
                   "week_number": F.when(k % 40 == 3, F.col("week_number") % 52 + 1).otherwise(F.col("week_number")).cast("int"),
                   "year_number": F.when(k % 60 == 4, F.col("year_number") + 1).otherwise(F.col("year_number")).cast("int")}
        e = self.t.daily_entries
        return e.select(*[shifted[c].alias(c) if c in shifted else F.col(c) for c in e.columns])

    @cached_property
    def period_requests(self) -> DataFrame:
        """Report requests as posted, one per customer: day, week, month or an unknown kind, of a
        tenant, every other one for one driver, some with texts that are no dates."""
        c = self.t.raw("customer")
        k = F.col("c_custkey")
        day = F.date_add(F.lit("1996-12-20").cast("date"), (k % 800).cast("int"))
        return c.select(
            (k + 1).alias("request_id"), (k % 5 + 1).cast("bigint").alias("owner_user_id"),
            F.when(k % 2 == 0, F.lit(None).cast("bigint")).otherwise(k % self.t.supplier_count + 1).alias("driver_id"),
            F.when(k % 7 == 0, F.lit("year")).when(k % 3 == 0, F.lit("day")).when(k % 3 == 1, F.lit("week")).otherwise(F.lit("month")).alias("period_text"),
            F.when(k % 11 == 0, F.lit("1997-02-31")).when(k % 13 == 0, F.lit("hoy")).otherwise(day.cast("string")).alias("date_text"),
            F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0")).alias("week_text"),
            F.when(k % 17 == 0, F.lit("1997-13")).otherwise(F.date_format(day, "yyyy-MM")).alias("month_text"),
        )

    @cached_property
    def account_names(self) -> DataFrame:
        """Usernames as typed: in capitals, with accents or blanks behind, several for one name."""
        c = self.t.raw("customer")
        k = F.col("c_custkey")
        name = F.concat(F.lit("josé pérez "), (k % 400).cast("string"))
        typed = (F.when(k % 4 == 0, F.upper(name)).when(k % 4 == 1, F.concat(F.translate(name, "éáí", "eai"), F.lit("  ")))
                 .when(k % 4 == 2, F.initcap(name)).otherwise(F.concat(F.lit("ñandú "), (k % 300).cast("string"))))
        return c.select((k + 1).alias("id"), typed.alias("username"))

    @cached_property
    def token_requests(self) -> DataFrame:
        """New reset requests: users of sign-up events with value above 200."""
        ev = self.t.raw("events").where((F.col("event_type") == "signup") & (F.col("value") > 200))
        return ev.select((F.col("user_id") + 1).alias("user_id"))

    @cached_property
    def token_resets(self) -> DataFrame:
        """Completed resets: users of purchase events with value above 250."""
        ev = self.t.raw("events").where((F.col("event_type") == "purchase") & (F.col("value") > 250))
        return ev.select((F.col("user_id") + 1).alias("user_id"))

    @cached_property
    def car_status_changes(self) -> DataFrame:
        """Activate / deactivate requests for every car, posted by a user each."""
        c = self.t.cars
        return c.select(
            F.col("id"),
            F.when(F.col("status") == "active", F.lit("inactive")).otherwise(F.lit("active"))
            .alias("status_text"),
            (F.col("id") * 5 % self.t.customer_count + 1).alias("posted_by"),
        )

    @cached_property
    def expense_deletes(self) -> DataFrame:
        """Delete requests for the fleet expenses without observations, posted by their creator."""
        ge = self.t.general_expenses.where(F.col("observations") == "")
        return ge.select("id", F.col("created_by").alias("posted_by"))

    @cached_property
    def note_deletes(self) -> DataFrame:
        """Week-note delete posts: one per order with priority 4-NOT SPECIFIED."""
        o = self.t.raw("orders").where(F.col("o_orderpriority") == "4-NOT SPECIFIED")
        return o.select(
            (F.col("o_custkey") + 1).alias("posted_by"),
            F.concat(F.extract(F.lit("YEAROFWEEK"), F.to_date("o_orderdate")).cast("string"),
                     F.lit("-W"), F.lpad(F.weekofyear("o_orderdate").cast("string"), 2, "0"))
            .alias("week_text"),
        )

    @cached_property
    def user_forms(self) -> DataFrame:
        """Posted new-user forms: one per customer, posted by the customer's own user (every fourth) or
        else by the account that manages users."""
        c = self.t.raw("customer")
        k = F.col("c_custkey")
        return c.select(
            (k + 1).alias("form_seq"),
            F.when(k % 4 == 0, k + 1).otherwise(user_manager(self.t.users, "id")).alias("posted_by"),
            F.concat(F.lit(" "), F.col("c_name"), F.lit(" Jr")).alias("full_name_text"),
            F.when(k % 2 == 0, F.concat(F.lower("c_name"), F.lit(".jr"))).otherwise(F.lower("c_name"))
            .alias("username_text"),
            F.when(k % 5 == 0, F.lit("")).otherwise(F.lit("secret")).alias("password_text"),
            F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("admin")).otherwise(F.lit("chofer"))
            .alias("role_text"),
            F.when(k % 3 == 0, F.lit("")).otherwise((k % self.t.supplier_count + 1).cast("string"))
            .alias("driver_id_text"),
            F.when(F.col("c_acctbal") < 0, F.lit(0)).otherwise(F.lit(1)).alias("is_active"),
        )

    @cached_property
    def driver_saves(self) -> DataFrame:
        """Driver form saves, one per customer row, most by the tenant's first admin: every fourth creates a
        driver, the others edit one; most choose a car, of their tenant or any."""
        c = self.t.raw("customer").withColumn("driver", F.col("c_custkey") % self.t.supplier_count + 1)
        k = F.col("c_custkey")
        d = self._with_tenant_admin(self.t.drivers.select(F.col("id").alias("driver"), "owner_user_id"), "owner_user_id")
        car = F.when(k % 5 == 0, F.lit("")).when(k % 7 == 0, (k * 17 % self.t.part_count + 1).cast("string")).otherwise(
            (F.col("owner_user_id") + 5 * (k % 30)).cast("string"))
        return c.join(d, "driver", "left").select(
            (k + 1).alias("change_seq"),
            F.when(k % 10 == 0, k * 11 % self.t.customer_count + 1).otherwise(F.col("tenant_admin")).alias("posted_by"),
            F.when(k % 4 == 0, F.lit(0).cast("bigint")).otherwise(F.col("driver")).alias("id"),
            F.when(k % 9 == 0, F.lit(" ")).otherwise(F.concat(F.col("c_name"), F.lit(" "))).alias("full_name_text"),
            F.when(k % 6 == 0, F.lit("")).otherwise((F.lit(30000000) + k * 7 % 90).cast("string")).alias("dni_text"),
            F.when(F.col("c_acctbal") > 5000, F.lit("inactive")).otherwise(F.lit("active")).alias("status_text"),
            car.alias("assigned_car_text"),
        )
