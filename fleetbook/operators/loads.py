"""Load jobs: posted forms -> cleaned rows -> validated -> derived -> appended.

A batch holds forms posted by many users; each form is judged in the
session of the user who posted it (role, tenant, linked driver), joined in
from the users table. All rules are column expressions over joins with the
dimension tables; there is no per-row Python.

Duplicate checks against the (large) existing table read its keys in the
batch's date range only (row groups of other dates are skipped) and let them
meet the batch's first rows of a key; no amounts and no other rows of the table travel.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetbook.functions import periods as P
from fleetbook.functions.amounts import clean_enum, empty_to_null, parse_amount, trim, upper_trim
from fleetbook.operators.entries import entry_math
from fleetbook.schemas import ENTRY_AMOUNTS, UNIQUE_KEYS

ENTRY_KEY = list(UNIQUE_KEYS["daily_entries"])

# Rejection reason codes of the load jobs.
R_NO_SESSION = "no_session"
R_NOT_ADMIN = "not_admin"
R_NO_DRIVER = "no_driver"
R_NO_CAR = "no_car"
R_OTHER_DRIVER = "other_driver"
R_DRIVER_NOT_IN_OWNER = "driver_not_in_owner"
R_CAR_NOT_IN_OWNER = "car_not_in_owner"
R_CAR_NOT_ASSIGNED = "car_not_assigned"
R_BAD_DATE = "bad_date"
R_DUPLICATE = "duplicate"
R_BAD_AMOUNT = "bad_amount"
R_BAD_YEAR = "bad_year"
R_NO_AMOUNT = "no_amount"
R_NO_NAME = "no_name"
R_MISSING_FIELDS = "missing_fields"


def parse_int(text) -> Column:
    """Integer prefix of a text, 0 when there is none (PHP ``(int)`` cast)."""
    t = trim(text)
    return F.coalesce(F.regexp_extract(t, r"^[+-]?[0-9]+", 0).try_cast("bigint"), F.lit(0).cast("bigint"))


#: Rows of one key that may meet in a task, about.
KEY_ROWS = 200_000


def spread_join(rows: DataFrame, table: DataFrame, key: str, table_key: str, seq_col: str) -> DataFrame:
    """``rows`` left-joined with ``table`` on ``key`` = ``table_key``, with no task for a hot key.

    A key of more than ``KEY_ROWS`` rows is cut by ``seq_col`` into parts of about that
    many, and its table rows are repeated for each part; NULL keys, which match nothing, lie
    anywhere. Hot keys are counted first, from the key column alone: there is at
    most one for every ``KEY_ROWS`` rows, so they are broadcast.
    """
    n = rows.groupBy(F.col(key).alias("_hot")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_hot").isNotNull() & (F.col("_n") > KEY_ROWS))
    hot = F.broadcast(n.select("_hot", F.ceil(F.col("_n") / KEY_ROWS).cast("bigint").alias("_parts")))
    spot = F.xxhash64(seq_col)
    slot = F.when(F.col(key).isNull(), spot).otherwise(F.pmod(spot, F.coalesce("_parts", F.lit(1).cast("bigint"))))
    r = rows.join(hot, rows[key] == hot["_hot"], "left").withColumn("_slot", slot).drop("_hot", "_parts")
    t = table.join(hot, table[table_key] == hot["_hot"], "left")
    t = t.withColumn("_at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_parts", F.lit(1).cast("bigint")) - 1))).drop("_hot", "_parts")
    return r.join(t, (F.col(key) == F.col(table_key)) & (F.col("_slot") == F.col("_at")), "left").drop("_slot", "_at")


def poster_sessions(users: DataFrame) -> DataFrame:
    """Session of each user: role, tenant (owner, else own id), linked driver."""
    return users.select(
        F.col("id").alias("_p_id"), F.col("role").alias("_p_role"),
        F.coalesce(F.col("owner_user_id"), F.col("id")).alias("_p_tenant"),
        F.col("driver_id").alias("_p_driver"))


def with_poster(batch: DataFrame, users: DataFrame, col: str = "posted_by") -> DataFrame:
    """Attach the posting user's session: role, tenant (owner, else own id), linked driver."""
    u = poster_sessions(users)
    return batch.join(u, batch[col] == u._p_id, "left")


def reasons_of(*checks: tuple[Column, str]) -> Column:
    """Comma-joined reason codes of the checks that hold (empty text: none)."""
    return F.concat_ws(",", *[F.when(cond, F.lit(code)) for cond, code in checks])


def clean_entry_forms(forms: DataFrame, users: DataFrame, as_of: dt.date) -> DataFrame:
    """Parse posted entry forms in the poster's session.

    Period type and billing status are allow-listed; dates, weeks are checked
    for syntax with ``as_of`` as "today"; a weekly load is dated on the Monday
    of its week, a daily load gets the ISO week of its date. A driver user
    always loads for its own driver and its status is always pending.
    Amounts are es-AR texts; one out of range is NULL (``bad_amount``). A job
    whose source has few splits should repartition the forms first.
    """
    # texts are cleaned in a projection of their own, before the sessions come: what follows
    # uses them several times, and cleaned values are what travels
    f = forms.select(
        "form_seq", "posted_by",
        clean_enum("period_type_text", "period_type").alias("period_type"),
        P.valid_or_default("entry_date_text", P.DATE_RE, P.valid_date_or_today(None, as_of)).alias("_date"),
        P.valid_or_default("entry_week_text", P.WEEK_RE, P.valid_week_or_current(None, as_of)).alias("_week"),
        parse_int("driver_id_text").alias("_driver"),
        parse_int("car_id_text").alias("car_id"),
        F.transform(F.array("gross_text", "app_text", "cash_text", "rental_text", "fuel_text", "km_text"), parse_amount).alias("_amounts"),
        clean_enum("status_text", "rental_billing_status").alias("_status"),
        trim("observations_text").alias("observations"),
    )
    weekly = F.col("period_type") == "week"
    day = F.try_to_date("_date", "yyyy-MM-dd")
    f = f.withColumn("_day", F.when(weekly, P.week_bounds_of_text(F.col("_week"))[0]).otherwise(day)).drop("_date")
    amount = dict(zip(("gross_income", "app_expenses", "cash_collected", "rental_amount", "fuel_cost", "distance_km"),
                      (F.col("_amounts")[i] for i in range(6)), strict=True))
    amount["distance_km"] = amount["distance_km"].try_cast("decimal(10,2)")
    # whether one is out of range is said before the sessions come: who wants no amounts does not move them
    f = f.select("*", *[c.alias(name) for name, c in amount.items()]).drop("_amounts")
    f = f.withColumn("_bad_amount", _any_missing(list(amount)))
    f = spread_join(f, poster_sessions(users), "posted_by", "_p_id", "form_seq")
    is_driver, is_admin = F.col("_p_role") == "driver", F.col("_p_role") == "admin"
    return f.select(
        "form_seq", "posted_by", "_p_role", "_p_tenant", "_p_driver", "period_type",
        F.col("_day").alias("entry_date"),
        F.when(weekly, F.col("_week")).otherwise(P.iso_week_text(F.col("_day"))).alias("entry_week"),
        F.when(is_driver, F.coalesce(F.col("_p_driver"), F.lit(0))).otherwise(F.col("_driver")).alias("driver_id"), "car_id",
        "gross_income", "app_expenses", "cash_collected", "rental_amount",
        F.when(is_admin, F.col("_status")).otherwise(F.lit("pending")).alias("rental_billing_status"),
        "fuel_cost", "distance_km", "observations", "_bad_amount",
    )


def _any_missing(cols: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])


#: Parts of the forms without a car.
CAR_PARTS = 1024


def validate_entry_loads(cleaned: DataFrame, drivers: DataFrame, cars: DataFrame) -> DataFrame:
    """Attach the rejection reasons of each cleaned load (empty: accepted).

    Basic rules first (session, driver, car, own driver for driver users);
    only loads that pass them are checked against the dimensions: for admins
    the driver and car must be active rows of the tenant, for driver users
    the car must be active and assigned to the driver. An impossible
    calendar date (``2001-02-31``) is rejected as well.
    """
    d = drivers.select(F.col("id").alias("_vd_id"), F.col("owner_user_id").alias("_vd_owner"),
                       F.col("status").alias("_vd_status"))
    c = cars.select(F.col("id").alias("_vc_id"), F.col("owner_user_id").alias("_vc_owner"),
                    F.col("status").alias("_vc_status"), F.col("current_driver_id").alias("_vc_driver"))
    # forms without a car (id 0) are many: parted, with any car of such an id repeated for each part
    parts = F.sequence(F.lit(0), F.lit(CAR_PARTS - 1))
    c = c.withColumn("_at", F.explode(F.when(F.col("_vc_id") <= 0, parts).otherwise(F.array(F.lit(0)))))
    spot = F.pmod(F.xxhash64("form_seq"), F.lit(CAR_PARTS)).cast("int")
    x = cleaned.withColumn("_slot", F.when(F.col("car_id") <= 0, spot).otherwise(F.lit(0)))
    x = (x.join(d, F.col("driver_id") == d._vd_id, "left")
          .join(c, (F.col("car_id") == c._vc_id) & (F.col("_slot") == c._at), "left"))
    role = F.col("_p_role")
    no_session = role.isNull()
    no_driver = F.col("driver_id") <= 0
    no_car = F.col("car_id") <= 0
    other = (role == "driver") & (F.col("driver_id") != F.coalesce(F.col("_p_driver"), F.lit(0)))
    basic_ok = ~no_session & ~no_driver & ~no_car & ~F.coalesce(other, F.lit(False))
    admin_ok = basic_ok & (role == "admin")
    driver_ok = basic_ok & (role == "driver")
    driver_in_owner = F.coalesce((F.col("_vd_owner") == F.col("_p_tenant")) & (F.col("_vd_status") == "active"),
                                 F.lit(False))
    car_in_owner = F.coalesce((F.col("_vc_owner") == F.col("_p_tenant")) & (F.col("_vc_status") == "active"),
                              F.lit(False))
    car_assigned = F.coalesce((F.col("_vc_driver") == F.col("driver_id")) & (F.col("_vc_status") == "active"),
                              F.lit(False))
    reasons = reasons_of(
        (no_session, R_NO_SESSION), (no_driver, R_NO_DRIVER), (no_car, R_NO_CAR),
        (F.coalesce(other, F.lit(False)), R_OTHER_DRIVER),
        (admin_ok & ~driver_in_owner, R_DRIVER_NOT_IN_OWNER),
        (admin_ok & ~car_in_owner, R_CAR_NOT_IN_OWNER),
        (driver_ok & ~car_assigned, R_CAR_NOT_ASSIGNED),
        (F.col("entry_date").isNull(), R_BAD_DATE),
        (F.col("_bad_amount") if "_bad_amount" in cleaned.columns else _any_missing([c for c in ENTRY_AMOUNTS if c in cleaned.columns]), R_BAD_AMOUNT),
    )
    return x.select(*[c for c in cleaned.columns if c != "_bad_amount"], reasons.alias("reasons"))


def derive_entries(accepted: DataFrame) -> DataFrame:
    """Accepted loads as entry rows: tenant as owner, derived amounts and periods."""
    e = accepted.withColumn("owner_user_id", F.col("_p_tenant")) \
                .withColumn("created_by", F.col("posted_by")) \
                .withColumn("updated_by", F.col("posted_by"))
    e = P.with_period_columns(entry_math(e))
    return e.drop("_p_role", "_p_tenant", "_p_driver", "reasons", "entry_week")


def within_batch_dates(existing: DataFrame, keys: DataFrame) -> DataFrame:
    """Stored entries restricted to the date range of a batch's keys.

    ``entry_date`` is part of the key, so the bounds (scalar subqueries over
    the small batch) lose nothing, and row groups outside them are skipped.
    """
    if "entry_date" not in keys.columns:
        return existing
    bounds = keys.select(F.struct(F.min("entry_date").alias("lo"), F.max("entry_date").alias("hi"))).scalar()
    return existing.where(F.col("entry_date").between(bounds.getField("lo"), bounds.getField("hi")))


#: Parts in which a key's rows are looked at before they meet.
SPREAD = 32


def batch_key_conflicts(batch: DataFrame, existing: DataFrame, key: list[str],
                        seq_col: str = "form_seq", eligible: Column | None = None, others: bool = True) -> DataFrame:
    """The batch with ``_conflict`` set where a row's key is taken: by a stored
    row or by an earlier row of the batch (the first row of a key stays).

    Only ``eligible`` rows with a whole key take keys. The rows go through one
    plan once. A key's rows are first compared inside ``SPREAD`` parts, then the
    first ones of the parts (``SPREAD`` rows of a key at most) with one another and
    with the stored key. All other rows are spread by their sequence in that
    second step, so neither a hot key nor NULL keys meet in one task. Stored
    keys are cut to the batch's dates and meet its rows where these lie already; the batch
    is not judged again for its keys. Without ``others`` only the eligible rows come back, and travel.
    """
    counts = F.lit(True) if eligible is None else F.coalesce(eligible, F.lit(False))
    for c in key:
        counts = counts & F.col(c).isNotNull()
    stored = within_batch_dates(existing.select(*key), batch.select(*key)).distinct()
    part = F.pmod(F.xxhash64(seq_col), F.lit(SPREAD))
    alone = -1 - F.pmod(F.xxhash64(seq_col), F.lit(1 << 40))
    group = Window.partitionBy(*key, "_slot")
    b = batch if others or eligible is None else batch.where(eligible)
    b = b.withColumn("_counts", counts).withColumn("_slot", F.when(F.col("_counts"), part).otherwise(alone))
    b = b.withColumn("_later", F.col("_counts") & (F.col(seq_col) > F.first(seq_col).over(group.orderBy(seq_col))))
    b = b.withColumn("_slot", F.when(F.col("_counts") & ~F.col("_later"), F.lit(0).cast("bigint")).otherwise(alone))
    # stored keys stand with the first rows in the second step: a join would bring all rows of a key together again
    stored = stored.select(*key, F.lit(0).cast("bigint").alias("_slot"), F.lit(True).alias("_stored"))
    b = b.unionByName(stored, allowMissingColumns=True)
    first, taken = F.min(F.when(F.col("_counts"), F.col(seq_col))).over(group), F.max("_stored").over(group)
    b = b.select("*", first.alias("_first"), taken.alias("_taken")).where(F.col("_stored").isNull())
    later = F.col("_later") | ((F.col("_slot") == 0) & ((F.col(seq_col) > F.col("_first")) | F.col("_taken").isNotNull()))
    return b.select(*batch.columns, F.when(later, F.lit(R_DUPLICATE)).alias("_conflict"))


def split_loads(validated: DataFrame, existing: DataFrame, key: list[str] = ENTRY_KEY):
    """(accepted, rejected) of a validated entry batch, duplicates included.

    The accepted rows are among those without a reason so far, and only these travel
    for them; both are lazy plans that judge every row once.
    """
    judged = batch_key_conflicts(validated, existing, key, eligible=F.col("reasons") == "")
    judged = judged.withColumn("reasons", F.coalesce("_conflict", "reasons")).drop("_conflict")
    # what every load without a reason has, as filters that go below the joins with sessions, drivers and cars
    sound = validated.where(F.col("_p_role").isNotNull() & (F.col("car_id") > 0) & F.col("entry_date").isNotNull()
                            & ~_any_missing([c for c in ENTRY_AMOUNTS if c in validated.columns]))
    accepted = batch_key_conflicts(sound, existing, key, eligible=F.col("reasons") == "", others=False)
    return accepted.where(F.col("_conflict").isNull()).drop("_conflict"), judged.where(F.col("reasons") != "")


def append_rows(base: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Table after appending: base rows plus new rows in the base schema."""
    return base.unionByName(new_rows.select(*base.columns))


# --- fleet expenses ---------------------------------------------------------

def clean_expense_forms(forms: DataFrame, users: DataFrame, as_of: dt.date) -> DataFrame:
    """Parse posted expense forms; only admins may post, amount must be > 0."""
    f = with_poster(forms, users)
    amount = parse_amount("amount_text")
    reasons = reasons_of(
        (F.col("_p_role").isNull(), R_NO_SESSION),
        (F.col("_p_role") == "driver", R_NOT_ADMIN),
        (amount <= 0, R_NO_AMOUNT), (amount.isNull(), R_BAD_AMOUNT))
    date_txt = P.valid_or_default("expense_date_text", P.DATE_RE, P.valid_date_or_today(None, as_of))
    return f.select(
        "form_seq", "posted_by",
        F.col("_p_tenant").alias("owner_user_id"),
        F.try_to_date(date_txt, "yyyy-MM-dd").alias("expense_date"),
        amount.alias("amount"),
        trim("observations_text").alias("observations"),
        reasons.alias("reasons"))


def new_ids(rows: DataFrame, existing: DataFrame, seq_col: str = "form_seq",
            id_base: int | Column | None = None) -> Column:
    """Ids for appended rows: above every existing id, in the batch's own
    sequence (the posting order carried by each form); no global ranking.

    ``id_base`` is the largest id already taken, when the deployment keeps it
    (e.g. the previous batch's last id); only without it is the existing
    table's id column scanned for its maximum.
    """
    if id_base is None:
        top = existing.select(F.coalesce(F.max("id"), F.lit(0))).scalar()
    else:
        top = id_base if isinstance(id_base, Column) else F.lit(id_base)
    return (top + F.col(seq_col)).cast("bigint")


def append_expenses(expenses: DataFrame, forms: DataFrame, users: DataFrame, as_of: dt.date,
                    id_base: int | Column | None = None) -> DataFrame:
    """Expense table after appending the valid posted expenses."""
    cleaned = clean_expense_forms(forms, users, as_of)
    ok = cleaned.where(F.col("reasons") == "")
    new = ok.select(new_ids(ok, expenses, id_base=id_base).alias("id"), "owner_user_id", "expense_date", "amount",
                    "observations", F.col("posted_by").alias("created_by"))
    return append_rows(expenses, new)


# --- dimensions -------------------------------------------------------------

def clean_driver_forms(forms: DataFrame, users: DataFrame) -> DataFrame:
    """Parse posted new-driver forms: trimmed name (required), empty dni to
    NULL, allow-listed status; only admins may post."""
    f = with_poster(forms, users)
    name = trim("full_name_text")
    return f.select(
        "form_seq", "posted_by", F.col("_p_tenant").alias("owner_user_id"),
        name.alias("full_name"),
        empty_to_null("dni_text").alias("dni"),
        clean_enum("status_text", "status").alias("status"),
        reasons_of((F.col("_p_role").isNull(), R_NO_SESSION),
                   (F.col("_p_role") == "driver", R_NOT_ADMIN),
                   (name == "", R_NO_NAME)).alias("reasons"))


def append_drivers(drivers: DataFrame, forms: DataFrame, users: DataFrame,
                   id_base: int | Column | None = None) -> DataFrame:
    """Driver table after appending valid new drivers whose dni is free in the tenant."""
    cleaned = clean_driver_forms(forms, users).where(F.col("reasons") == "")
    checked = batch_key_conflicts(cleaned, drivers, ["owner_user_id", "dni"])
    ok = checked.where(F.col("_conflict").isNull())
    new = ok.select(new_ids(ok, drivers, id_base=id_base).alias("id"), "owner_user_id", "full_name", "dni", "status")
    return append_rows(drivers, new)


def clean_car_forms(forms: DataFrame) -> DataFrame:
    """Parse car edit forms: trimmed brand / model, upper-case plate, year or
    NULL, allow-listed status; brand, model and plate are required."""
    brand, model, plate = trim("brand_text"), trim("model_text"), upper_trim("plate_text")
    year = F.when(trim("year_text") == "", F.lit(None).cast("bigint")).otherwise(parse_int("year_text"))
    bad_year = year.isNotNull() & year.try_cast("int").isNull()
    poster = [c for c in ("id", "posted_by") if c in forms.columns]
    return forms.select(
        "form_seq", *poster, brand.alias("brand"), model.alias("model"), plate.alias("plate"),
        year.try_cast("int").alias("year"),
        clean_enum("status_text", "status").alias("status"),
        reasons_of(((brand == "") | (model == "") | (plate == ""), R_MISSING_FIELDS),
                   (bad_year, R_BAD_YEAR)).alias("reasons"))


def judge_car_forms(forms: DataFrame, cars: DataFrame, users: DataFrame) -> DataFrame:
    """New-car forms in the poster's session, with reasons: admins only,
    brand / model / plate required, plate free in the tenant; of forms with
    one plate the first stays."""
    c = with_poster(clean_car_forms(forms), users)
    c = c.withColumn("owner_user_id", F.col("_p_tenant"))
    base = reasons_of((F.col("_p_role").isNull(), R_NO_SESSION), (F.col("_p_role") == "driver", R_NOT_ADMIN),
                      (F.col("reasons").contains(R_MISSING_FIELDS), R_MISSING_FIELDS),
                      (F.col("reasons").contains(R_BAD_YEAR), R_BAD_YEAR))
    c = c.withColumn("reasons", base)
    ok = c.where(F.col("reasons") == "")
    checked = batch_key_conflicts(ok, cars, ["owner_user_id", "plate"])
    dup = checked.where(F.col("_conflict").isNotNull()).select("form_seq", F.col("_conflict").alias("_dup"))
    return (c.join(dup, "form_seq", "left")
             .withColumn("reasons", F.concat_ws(",", F.when(F.col("reasons") != "", F.col("reasons")),
                                                F.col("_dup")))
             .select("form_seq", "posted_by", "owner_user_id", "brand", "model", "plate", "year", "status",
                     "reasons"))


def append_cars(cars: DataFrame, forms: DataFrame, users: DataFrame,
                id_base: int | Column | None = None) -> DataFrame:
    """Car table after appending the accepted new cars (no current driver yet)."""
    ok = judge_car_forms(forms, cars, users).where(F.col("reasons") == "")
    new = ok.select(new_ids(ok, cars, id_base=id_base).alias("id"), "*",
                    F.lit(None).cast("bigint").alias("current_driver_id"))
    return append_rows(cars, new)


# Only an admin with this username may manage users.
USER_MANAGERS = ("personal",)
R_NOT_MANAGER = "not_user_manager"
R_NO_PASSWORD = "no_password"
R_DRIVER_NOT_IN_TENANT = "driver_not_in_owner"
R_DUPLICATE_USERNAME = "duplicate_username"


def is_user_manager(managers: tuple[str, ...] | Column) -> Column:
    """Whether the poster (role ``_p_role``, username ``_m_username``) manages users."""
    named = F.col("_m_username") == managers if isinstance(managers, Column) else F.col("_m_username").isin(*managers)
    return F.coalesce((F.col("_p_role") == "admin") & named, F.lit(False))


def judge_user_forms(forms: DataFrame, users: DataFrame, drivers: DataFrame,
                     managers: tuple[str, ...] | Column = USER_MANAGERS) -> DataFrame:
    """New-user forms with reasons: the poster must be a user manager; name,
    username and password are required; the role is allow-listed (default
    driver) and an admin gets no driver; a linked driver must belong to the
    tenant; the username must be free, and of forms with one username the
    first stays. The password itself is never stored here."""
    mgr = users.select(F.col("id").alias("_m_id"), F.col("username").alias("_m_username"))
    p = with_poster(forms, users).join(mgr, F.col("posted_by") == F.col("_m_id"), "left")
    role = clean_enum("role_text", "role")
    driver = F.when(role == "admin", F.lit(None).cast("bigint")).otherwise(
        F.when(trim("driver_id_text") == "", F.lit(None).cast("bigint")).otherwise(parse_int("driver_id_text")))
    d = drivers.select(F.col("id").alias("_d_id"), F.col("owner_user_id").alias("_d_owner"))
    p = (p.select("*", role.alias("role"), driver.alias("driver_id"),
                  trim("full_name_text").alias("full_name"), trim("username_text").alias("username"),
                  F.col("_p_tenant").alias("owner_user_id"))
          .join(d, (F.col("driver_id") == d._d_id) & (F.col("_p_tenant") == d._d_owner), "left"))
    is_manager = is_user_manager(managers)
    p = p.withColumn("reasons", reasons_of(
        (~is_manager, R_NOT_MANAGER),
        ((F.col("full_name") == "") | (F.col("username") == ""), R_MISSING_FIELDS),
        (F.coalesce(F.col("password_text"), F.lit("")) == "", R_NO_PASSWORD),
        (F.col("driver_id").isNotNull() & F.col("_d_id").isNull(), R_DRIVER_NOT_IN_TENANT)))
    ok = p.where(F.col("reasons") == "")
    checked = batch_key_conflicts(ok, users, ["username"])
    dup = (checked.where(F.col("_conflict").isNotNull())
                  .select("form_seq", F.lit(R_DUPLICATE_USERNAME).alias("_dup")))
    return (p.join(dup, "form_seq", "left")
             .withColumn("reasons", F.concat_ws(",", F.when(F.col("reasons") != "", F.col("reasons")),
                                                F.col("_dup")))
             .select("form_seq", "posted_by", "full_name", "username", "role", "driver_id", "owner_user_id",
                     "is_active", "reasons"))


def append_users(users: DataFrame, forms: DataFrame, drivers: DataFrame,
                 managers: tuple[str, ...] | Column = USER_MANAGERS, id_base: int | Column | None = None) -> DataFrame:
    """User table after appending the accepted new users."""
    ok = judge_user_forms(forms, users, drivers, managers).where(F.col("reasons") == "")
    new = ok.select(new_ids(ok, users, id_base=id_base).alias("id"), "*")
    return append_rows(users, new)
