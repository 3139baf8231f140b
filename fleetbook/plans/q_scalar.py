"""Scalar-function, scope-filter and display queries (N-, F-, P-rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetbook.functions import amounts as A
from fleetbook.functions import display as D
from fleetbook.functions import periods as P
from fleetbook.operators import filters as FL
from fleetbook.operators.audits import period_mismatches
from fleetbook.operators.entries import entry_list
from fleetbook.plans.catalog import query
from fleetbook.plans.params import AS_OF, MONTH_RANGE, OWNER, first_driver_of_owner
from fleetbook.scope import Scope
from fleetbook.sources.standins import StandinBatches

ADMIN = Scope.admin(OWNER)


@query("period_columns")
def period_columns(t):
    """ISO week, month, calendar year, ISO year and Monday of every entry date."""
    d = t.daily_entries.select("entry_date").distinct()
    return d.select("entry_date", P.week_number("entry_date").alias("week_number"),
                    P.month_number("entry_date").alias("month_number"),
                    P.year_number("entry_date").alias("year_number"),
                    P.iso_year("entry_date").alias("iso_year"),
                    P.week_start_of("entry_date").alias("week_start"))


@query("iso_week_text")
def iso_week_text(t):
    """``YYYY-Www`` text of every entry date and the week label built from it."""
    d = t.daily_entries.select("entry_date").distinct()
    w = P.iso_week_text("entry_date")
    return d.select("entry_date", w.alias("week_text"),
                    F.concat(F.lit(P.WEEK_LABEL + " "), F.substring(w, 7, 2), F.lit(", "),
                             F.substring(w, 1, 4)).alias("week_label"))


@query("week_bounds")
def week_bounds(t):
    """Monday..Sunday of every week text posted on the load forms (weeks past
    the year's last week roll over into the next year)."""
    forms = StandinBatches(t).entry_forms.select(F.col("entry_week_text").alias("week_text")).distinct()
    start, end = P.week_bounds_of_text("week_text")
    return forms.select("week_text", start.alias("week_start"), end.alias("week_end"))


@query("month_bounds")
def month_bounds(t):
    """First and last day of every month with fleet expenses, from its ``YYYY-MM`` key."""
    m = t.general_expenses.select(P.month_key("expense_date").alias("month_text")).distinct()
    first, last = P.month_bounds_of_text("month_text")
    return m.select("month_text", first.alias("month_start"), last.alias("month_end"),
                    P.month_label(first).alias("month_label"))


@query("clean_periods")
def clean_periods(t):
    """Request date / week / month texts of the load forms, checked for syntax,
    defaulting to the as-of day, week and month."""
    f = StandinBatches(t).entry_forms
    month_text = F.substring("entry_date_text", 1, 7)
    return f.select(
        "form_seq",
        P.valid_or_default("entry_date_text", P.DATE_RE, P.valid_date_or_today(None, AS_OF)).alias("day"),
        P.valid_or_default("entry_week_text", P.WEEK_RE, P.valid_week_or_current(None, AS_OF)).alias("week"),
        P.valid_or_default(month_text, P.MONTH_RE, P.valid_month_or_current(None, AS_OF)).alias("month"))


@query("format_money")
def format_money(t):
    """Money and number texts of every entry (es-AR separators)."""
    e = t.daily_entries
    return e.select(*A_KEY, D.money("net_total").alias("net_text"),
                    D.money("total_expenses").alias("expenses_text"),
                    D.money("gross_income", 2).alias("gross_text"),
                    D.number_ar("distance_km", 2).alias("km_text"))


A_KEY = ("period_type", "entry_date", "driver_id", "car_id", "gross_income", "created_by")


@query("format_dates")
def format_dates(t):
    """Date text, month label and month key of every expense."""
    ge = t.general_expenses
    return ge.select("id", D.date_ar("expense_date").alias("date_text"),
                     P.month_label("expense_date").alias("month_label"),
                     P.month_key("expense_date").alias("month_key"))


@query("car_labels")
def car_labels(t):
    """``brand model - plate`` label of every car."""
    return t.cars.select("id", D.car_label().alias("label"))


@query("parse_amounts")
def parse_amounts(t):
    """es-AR amount texts parsed to decimal(12,2)."""
    r = t.raw_amounts
    return r.select("l_orderkey", "l_linenumber", "amount_text",
                    A.parse_amount("amount_text").alias("amount"))


@query("clean_enums")
def clean_enums(t):
    """Posted period types and billing statuses through their allow-lists."""
    f = StandinBatches(t).entry_forms
    return f.select("form_seq", "period_type_text", "status_text",
                    A.clean_enum("period_type_text", "period_type").alias("period_type"),
                    A.clean_enum("status_text", "rental_billing_status").alias("rental_billing_status"))


@query("pattern_flags")
def pattern_flags(t):
    """Token-format and legacy-hash flags of stored access-token rows."""
    d = StandinBatches(t).token_details
    return d.select("id", A.is_token_format("selector").alias("selector_ok"),
                    A.is_legacy_hash("token_hash").alias("hash_is_legacy"))


@query("hash_column")
def hash_column(t):
    """SHA-256 hex of every username."""
    return t.users.select("id", "username", A.sha256_hex("username").alias("username_sha256"))


@query("access_audit")
def access_audit(t):
    """Stored user agent / address clipped to their columns' bytes, never inside a character."""
    d = StandinBatches(t).token_details
    ua, ip = A.clip("user_agent", A.USER_AGENT_LEN), A.clip("ip_address", A.IP_ADDRESS_LEN)
    return d.select("id", ua.alias("user_agent"), ip.alias("ip_address"),
                    F.octet_length(ua).alias("user_agent_len"), F.octet_length(ip).alias("ip_address_len"))


@query("scope_owner")
def scope_owner(t):
    """Cars of tenant 1."""
    return FL.owner_scope(t.cars, OWNER)


@query("scope_driver")
def scope_driver(t):
    """Entries a driver user sees: its own driver's, of any owner."""
    drv = first_driver_of_owner(t.drivers)
    return FL.entry_scope(t.daily_entries, Scope.driver_user(drv, OWNER))


@query("scope_entry")
def scope_entry(t):
    """Admin of tenant 1 asking for its first driver and a negative car id (= all cars)."""
    drv = first_driver_of_owner(t.drivers)
    return FL.entry_scope(t.daily_entries, Scope.admin(OWNER, driver_id=drv, car_id=-5))


@query("scope_cases")
def scope_cases(t):
    """Entries that each kind of session sees: admins with and without a tenant, a
    driver asked for or a negative one, a driver user and an unlinked one."""
    drv = first_driver_of_owner(t.drivers)
    cases = {
        "admin": Scope.admin(OWNER),
        "admin without a tenant": Scope.admin(0),
        "admin, negative driver": Scope.admin(OWNER, driver_id=-1),
        "admin, one driver": Scope.admin(OWNER, driver_id=drv),
        "driver user": Scope.driver_user(drv, OWNER),
        "unlinked driver user": Scope.driver_user(None, OWNER),
    }
    counts = [F.count_if(FL.entry_predicate(scope)).alias(name) for name, scope in cases.items()]
    return t.daily_entries.agg(*counts).unpivot([], list(cases), "scope", "entries")


@query("period_column_mismatches")
def period_column_mismatches(t):
    """Imported entries whose stored week, month or year is not that of their date."""
    return period_mismatches(StandinBatches(t).imported_entries)


@query("entries_by_status")
def entries_by_status(t):
    """Tenant 1's invoiced entries of March 1997."""
    e = FL.in_period(FL.entry_scope(t.daily_entries, ADMIN), MONTH_RANGE)
    return FL.by_billing_status(e, "invoiced")


@query("active_drivers")
def active_drivers(t):
    """Active drivers of tenant 1 (load-form pick list)."""
    return FL.active_only(FL.owner_scope(t.drivers, OWNER)).select("id", "full_name").orderBy("full_name")


@query("billable_entries")
def billable_entries(t):
    """Listed entries whose billing status may change (rental > 0)."""
    return FL.billable(entry_list(t.daily_entries, t.drivers, t.cars, ADMIN, MONTH_RANGE))


@query("lookup_by_key")
def lookup_by_key(t):
    """Point lookup of one driver by id within its tenant."""
    drv = first_driver_of_owner(t.drivers)
    return FL.owner_scope(t.drivers, OWNER).where(F.col("id") == drv)
