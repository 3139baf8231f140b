"""Change application: posted edits, status changes, deletes and upserts as
batch table transforms ``(base, changes) -> new base``.

Every change is judged in the session of the user who posted it (joined
from the users table): the tenant must own the target row, driver users may
only touch their own driver's entries, and admin-only changes from other
users are ignored. When a key receives several allowed changes, the newest
(largest ``change_seq``) wins, as if they had been applied in order. Edits that
claim a unique key (an entry's key, a dni, a plate, a username) are judged in
posting order as well: a post is accepted when no other row holds the key at
that time, counting what earlier posts took and freed (``claims.settle``).

Scale: the change batch is the small side, and every function is one lazy
plan. Targets are found by semi-joining the base with the
batch's keys (batch as the broadcast build side), the surviving change per
key is reduced by a grouped ``max`` of a struct (partial aggregation, safe
under hot keys), and the base is then left-joined once with that per-key
result. For a small batch the base is never shuffled or grouped.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetbook.functions import periods as P
from fleetbook.functions.amounts import clean_enum, trim
from fleetbook.operators.claims import GUARDED, TAKEN, settle, whole_key
from fleetbook.operators.entries import entry_math_columns
from fleetbook.operators.loads import (R_BAD_AMOUNT, R_BAD_DATE, R_BAD_YEAR, R_CAR_NOT_ASSIGNED, R_CAR_NOT_IN_OWNER,
                                       R_DRIVER_NOT_IN_OWNER, R_DUPLICATE, R_MISSING_FIELDS, R_NO_CAR, R_NO_DRIVER,
                                       USER_MANAGERS, is_user_manager, reasons_of, with_poster, within_batch_dates)
from fleetbook.schemas import ENTRY_AMOUNTS, UNIQUE_KEYS

ENTRY_KEY = list(UNIQUE_KEYS["daily_entries"])

# Rejection reason codes of the change jobs.
R_NO_SESSION = "no_session"
R_NOT_ADMIN = "not_admin"
R_NOT_FOUND = "not_found"
R_OTHER_OWNER = "other_owner"
R_OTHER_DRIVER = "other_driver"
R_EMPTY_NOTE = "empty_note"
R_CAR_UNAVAILABLE = "car_unavailable"
R_NO_NAME = "no_name"
R_MISSING = "missing_fields"
R_NOT_MANAGER = "not_user_manager"
R_SELF_LOCK = "self_lock"
R_USER_NOT_IN_OWNER = "user_not_in_owner"
R_DUPLICATE_USERNAME = "duplicate_username"
R_DUPLICATE_DNI = "duplicate_dni"
R_DUPLICATE_PLATE = "duplicate_plate"


def newest_per_key(changes: DataFrame, key: list[str], seq_col: str | None) -> DataFrame:
    """One change per key: the largest ``seq_col`` (ties and batches without a
    sequence: the largest row), as a grouped ``max`` of a struct, which
    aggregates partially before the shuffle."""
    cols = [c for c in changes.columns if c not in key]
    if seq_col:
        # the sequence decides; equal sequences fall back to the largest row
        cols = [seq_col] + [c for c in cols if c != seq_col]
    best = F.max(F.struct(*[F.col(c) for c in cols]))
    return changes.groupBy(*key).agg(best.alias("_m")).select(*key, *[F.col(f"_m.{c}").alias(c) for c in cols])


def entry_change_targets(changes: DataFrame, entries: DataFrame, users: DataFrame,
                         admin_only: bool = False, key: list[str] | tuple[str, ...] = ("id",)) -> DataFrame:
    """Changes with their target entry's owner / driver and a rejection reason.

    Allowed: an admin of the entry's tenant; a driver user of the entry's
    tenant whose driver is the entry's driver (unless ``admin_only``).
    Targets are named by id, or by another unique ``key``. They are found by
    semi-joining the entries with the batch's keys (the batch is the build
    side), so only matching entry keys leave their tasks.
    """
    key = list(key)
    keys = changes.select(*key).distinct()
    stored = within_batch_dates(entries, keys) if "entry_date" in key else entries
    extra = [] if "driver_id" in key else [F.col("driver_id").alias("_t_driver")]
    tgt = stored.select(*key, F.col("owner_user_id").alias("_t_owner"), *extra).join(keys, key, "left_semi")
    c = with_poster(changes, users).join(tgt, key, "left")
    if not extra:
        c = c.withColumn("_t_driver", F.col("driver_id"))
    role = F.col("_p_role")
    found = F.col("_t_owner").isNotNull()
    other_owner = found & (F.col("_t_owner") != F.col("_p_tenant"))
    other_driver = found & (role == "driver") & (F.col("_t_driver") != F.coalesce(F.col("_p_driver"), F.lit(0)))
    return c.withColumn("reasons", reasons_of(
        (role.isNull(), R_NO_SESSION),
        (F.lit(admin_only) & (role == "driver"), R_NOT_ADMIN),
        (role.isNotNull() & ~found, R_NOT_FOUND),
        (other_owner, R_OTHER_OWNER),
        (other_driver, R_OTHER_DRIVER),
    ))


def _private(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("_p_") or c.startswith("_t_")]


def judge_entry_edits(edits: DataFrame, entries: DataFrame, users: DataFrame, drivers: DataFrame,
                      cars: DataFrame, amounts: bool = True) -> DataFrame:
    """Entry edits (whole forms by entry id) with their cleaned values and a reason ('' : accepted).

    Without ``amounts`` the edits are judged alike, but do not take their amounts and observations along.

    In the order in which the form judges a post: session, entry there, of the
    poster's tenant; a driver user's entry must *at that time* be its own
    driver's; driver and car chosen; for admins both must be active rows of the
    tenant, for driver users the car must be active and assigned to them; a
    proper date and amounts; last, the new key (period type, date, driver, car)
    must be free at that time. A driver user always saves for its own driver
    and cannot change the billing status; a weekly entry is dated on its Monday.
    """
    carried = [*ENTRY_AMOUNTS, "observations"] if amounts else []
    bad_amount = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in ENTRY_AMOUNTS])
    slim = edits.select("change_seq", "id", "posted_by", *ENTRY_KEY, "status_text", *carried, bad_amount.alias("_bad_amount"))
    e = with_poster(slim, users)
    role, tenant, own = F.col("_p_role"), F.col("_p_tenant"), F.coalesce("_p_driver", F.lit(0).cast("bigint"))
    date = F.when(F.col("period_type") == "week", F.trunc("entry_date", "week")).otherwise(F.col("entry_date"))
    e = (e.withColumn("period_type", clean_enum("period_type", "period_type")).withColumn("entry_date", date)
          .withColumn("driver_id", F.when(role == "driver", own).otherwise(F.col("driver_id"))))
    ids = edits.select("id").distinct()
    tgt = entries.select("id", F.col("owner_user_id").alias("_t_owner"), whole_key(ENTRY_KEY).alias("_t_key")).join(ids, "id", "left_semi")
    d = drivers.select(F.col("id").alias("_d_id"), F.col("owner_user_id").alias("_d_owner"), F.col("status").alias("_d_status"))
    v = cars.select(F.col("id").alias("_v_id"), F.col("owner_user_id").alias("_v_owner"),
                    F.col("status").alias("_v_status"), F.col("current_driver_id").alias("_v_driver"))
    e = e.join(tgt, "id", "left").join(d, e.driver_id == d._d_id, "left").join(v, e.car_id == v._v_id, "left")
    found = F.col("_t_owner").isNotNull()
    early = reasons_of((role.isNull(), R_NO_SESSION), (role.isNotNull() & ~found, R_NOT_FOUND),
                       (found & (F.col("_t_owner") != tenant), R_OTHER_OWNER))
    chosen = (F.col("driver_id") > 0) & (F.col("car_id") > 0)
    holds = lambda c: F.coalesce(c, F.lit(False))
    driver_ok = holds((F.col("_d_owner") == tenant) & (F.col("_d_status") == "active"))
    car_ok = holds((F.col("_v_owner") == tenant) & (F.col("_v_status") == "active"))
    assigned = holds((F.col("_v_driver") == F.col("driver_id")) & (F.col("_v_status") == "active"))
    form = reasons_of(
        (~holds(F.col("driver_id") > 0), R_NO_DRIVER), (~holds(F.col("car_id") > 0), R_NO_CAR),
        (holds(chosen) & (role == "admin") & ~driver_ok, R_DRIVER_NOT_IN_OWNER),
        (holds(chosen) & (role == "admin") & ~car_ok, R_CAR_NOT_IN_OWNER),
        (holds(chosen) & (role == "driver") & ~assigned, R_CAR_NOT_ASSIGNED),
        (F.col("entry_date").isNull(), R_BAD_DATE), (F.col("_bad_amount"), R_BAD_AMOUNT))
    e = e.withColumn("_early", early).withColumn("_form", form)
    e = e.select("change_seq", "id", "posted_by", *ENTRY_KEY, *carried, "_p_role", "_p_driver",
                 F.when(role == "admin", clean_enum("status_text", "rental_billing_status")).alias("rental_billing_status"),
                 "_early", "_form", ((F.col("_early") == "") & (F.col("_form") == "")).alias("may"), "_t_key")
    # only a driver user's post hangs on whose entry it is, and only one that would be told so
    free = F.coalesce(F.col("_p_role") != "driver", F.lit(True)) | (F.col("_early") != "")

    def admissible(had: Column) -> Column:
        return F.coalesce(F.col("_p_role") != "driver", F.lit(True)) | (had.getField("driver_id") == F.col("_p_driver"))

    judged = settle(e, entries, ENTRY_KEY, guard=admissible, guard_columns=("_p_role", "_p_driver"), free=free, stored="_t_key")
    reasons = (F.when(F.col("_early") != "", F.col("_early")).when(F.col("outcome") == GUARDED, R_OTHER_DRIVER)
               .when(F.col("_form") != "", F.col("_form")).when(F.col("outcome") == TAKEN, R_DUPLICATE).otherwise(""))
    return judged.withColumn("reasons", reasons).drop("_early", "_form", "_p_role", "_p_driver", "_t_key")


def apply_entry_edits(entries: DataFrame, judged: DataFrame) -> DataFrame:
    """Entries after the accepted edits of a judged batch.

    An edited entry takes key, amounts and observations of its last accepted
    edit and the billing status of the last one that carries a status (an
    admin's); deductions, net and period columns are derived anew.
    """
    given = [*ENTRY_KEY, *ENTRY_AMOUNTS, "observations"]
    ok = judged.where((F.col("reasons") == "") & F.col("may") & F.col("outcome").isNull())
    last = F.max(F.struct("change_seq", *given, "posted_by")).alias("_n")
    status = F.max(F.when(F.col("rental_billing_status").isNotNull(), F.struct("change_seq", "rental_billing_status"))).alias("_s")
    n = ok.groupBy(F.col("id").alias("_n_id")).agg(last, status)
    j = entries.join(n, entries["id"] == n["_n_id"], "left")
    hit = F.col("_n_id").isNotNull()
    new = {c: F.when(hit, F.col(f"_n.{c}")).otherwise(F.col(c)).alias(c) for c in given}
    new["updated_by"] = F.when(hit, F.col("_n.posted_by")).otherwise(F.col("updated_by")).alias("updated_by")
    new["rental_billing_status"] = F.coalesce("_s.rental_billing_status", "rental_billing_status").alias("rental_billing_status")
    out = j.select(*[new.get(c, F.col(c)) for c in entries.columns], hit.alias("_hit"))
    total, net = entry_math_columns()
    out = out.withColumn("_total", total).withColumn("_net", net)
    for c, fresh in (("total_expenses", "_total"), ("net_total", "_net")):
        out = out.withColumn(c, F.when(F.col("_hit"), F.col(fresh)).otherwise(F.col(c)))
    stored = [c for c in ("week_number", "month_number", "year_number") if c in entries.columns]
    kept = {c: F.col(c).alias(f"_was_{c}") for c in stored}
    out = P.with_period_columns(out.select("*", *kept.values()).drop(*stored))
    for c in stored:
        out = out.withColumn(c, F.when(F.col("_hit"), F.col(c)).otherwise(F.col(f"_was_{c}")))
    return out.select(*entries.columns)


def judge_billing_changes(entries: DataFrame, changes: DataFrame, users: DataFrame) -> DataFrame:
    """Billing-status posts with ``outcome``: ``applied``, ``superseded`` by a later allowed
    post on the entry, or the reason why it is rejected. A status outside
    (pending, invoiced) is stored as pending."""
    judged = entry_change_targets(changes, entries, users, admin_only=True)
    last = judged.where(F.col("reasons") == "").groupBy(F.col("id").alias("_l_id")).agg(F.max("change_seq").alias("_last"))
    j = judged.join(last, judged["id"] == last["_l_id"], "left")
    outcome = (F.when(F.col("reasons") != "", F.col("reasons"))
               .when(F.col("change_seq") == F.col("_last"), "applied").otherwise("superseded"))
    return j.select("change_seq", "id", "posted_by", clean_enum("status_text", "rental_billing_status").alias("rental_billing_status"),
                    outcome.alias("outcome"))


def apply_billing_status(entries: DataFrame, changes: DataFrame, users: DataFrame) -> DataFrame:
    """Entries after billing-status posts (admins of the entry's tenant only), by
    entry id; of several posts on one entry the last in sequence holds."""
    judged = entry_change_targets(changes, entries, users, admin_only=True)
    ok = judged.where(F.col("reasons") == "").select(
        F.col("id").alias("_n_id"), clean_enum("status_text", "rental_billing_status").alias("_n_status"),
        F.col("posted_by").alias("_n_by"), "change_seq")
    newest = newest_per_key(ok, ["_n_id"], "change_seq").drop("change_seq")
    j = entries.join(newest, entries["id"] == newest["_n_id"], "left")
    hit = F.col("_n_id").isNotNull()
    new = {"rental_billing_status": F.when(hit, F.col("_n_status")).otherwise(F.col("rental_billing_status")).alias("rental_billing_status"),
           "updated_by": F.when(hit, F.col("_n_by")).otherwise(F.col("updated_by")).alias("updated_by")}
    return j.select(*[new.get(c, F.col(c)) for c in entries.columns])


def apply_deletes(entries: DataFrame, deletes: DataFrame, users: DataFrame) -> DataFrame:
    """Entries after allowed delete requests by entry id (tenant's admins; driver users own entries)."""
    judged = entry_change_targets(deletes, entries, users)
    gone = judged.where(F.col("reasons") == "").select("id").distinct()
    return entries.join(gone, "id", "left_anti").select(*entries.columns)


def entry_change_rejects(judged_edits: DataFrame, entries: DataFrame, users: DataFrame, deletes: DataFrame) -> DataFrame:
    """Rejected entry edits (of a judged batch) and deletes with their reasons."""
    d = entry_change_targets(deletes, entries, users)
    cols = ["id", "posted_by", "reasons"]
    parts = [x.where(F.col("reasons") != "").select(F.lit(kind).alias("change"), *cols) for kind, x in (("update", judged_edits), ("delete", d))]
    return parts[0].unionByName(parts[1])


def apply_status(dim: DataFrame, changes: DataFrame, users: DataFrame,
                 seq_col: str | None = None) -> DataFrame:
    """Drivers or cars after activate / deactivate requests.

    Only admins of the row's tenant; any value other than ``active`` stores
    ``inactive``.
    """
    c = with_poster(changes, users).where(F.col("_p_role") == "admin")
    c = c.select(F.col("id").alias("_n_id"), F.col("_p_tenant").alias("_n_owner"),
                 F.when(F.col("status_text") == "active", F.lit("active")).otherwise(F.lit("inactive"))
                 .alias("_n_status"), *([seq_col] if seq_col else []))
    newest = newest_per_key(c, ["_n_id", "_n_owner"], seq_col)
    j = dim.join(newest, (dim.id == newest._n_id) & (dim.owner_user_id == newest._n_owner), "left")
    return j.select(*[F.when(F.col("_n_id").isNotNull(), F.col("_n_status")).otherwise(dim.status).alias("status")
                      if x == "status" else dim[x] for x in dim.columns])


def upsert_notes(notes: DataFrame, posts: DataFrame, users: DataFrame, as_of: dt.date,
                 seq_col: str = "change_seq") -> DataFrame:
    """Week notes after posted notes: insert, or overwrite week_end, notes and
    updated_by of the (tenant, week) note; created_by is kept. Admins only;
    an empty note is rejected; the week text defaults to the as-of week."""
    p = with_poster(posts, users)
    week = P.valid_or_default("week_text", P.WEEK_RE, P.valid_week_or_current(None, as_of))
    start, end = P.week_bounds_of_text(week)
    text = trim("notes_text")
    ok = (p.where((F.col("_p_role") == "admin") & (text != ""))
           .select(F.col("_p_tenant").alias("owner_user_id"), start.alias("week_start"),
                   end.alias("_n_end"), text.alias("_n_notes"), F.col("posted_by").alias("_n_by"), seq_col))
    newest = newest_per_key(ok, ["owner_user_id", "week_start"], seq_col).withColumn("_n_hit", F.lit(True))
    base = notes if "created_by" in notes.columns else notes.withColumn("created_by", F.lit(None).cast("bigint"))
    base = base.withColumn("_o_hit", F.lit(True))
    j = base.join(newest, ["owner_user_id", "week_start"], "full_outer")
    hit, old = F.col("_n_hit").isNotNull(), F.col("_o_hit").isNotNull()
    return j.select(
        "owner_user_id", "week_start",
        F.when(hit, F.col("_n_end")).otherwise(F.col("week_end")).alias("week_end"),
        F.when(hit, F.col("_n_notes")).otherwise(F.col("notes")).alias("notes"),
        F.when(old, F.col("created_by")).otherwise(F.col("_n_by")).alias("created_by"),
        F.when(hit, F.col("_n_by")).otherwise(F.col("updated_by")).alias("updated_by"),
    )


def note_post_rejects(posts: DataFrame, users: DataFrame) -> DataFrame:
    """Week-note posts that ``upsert_notes`` does not apply, with reasons."""
    p = with_poster(posts, users)
    reasons = reasons_of((F.col("_p_role").isNull(), R_NO_SESSION),
                         (F.col("_p_role") == "driver", R_NOT_ADMIN),
                         (trim("notes_text") == "", R_EMPTY_NOTE))
    return p.select(*posts.columns, reasons.alias("reasons")).where(F.col("reasons") != "")


def apply_assignments(cars: DataFrame, assignments: DataFrame, users: DataFrame,
                      seq_col: str = "change_seq") -> DataFrame:
    """Cars after car-assignment posts, with the result of applying them in order.

    One post (driver d, car c or none, by an admin of tenant o) first clears
    every car of tenant o held by d, then gives car c (active, of tenant o)
    to d; a post naming an unavailable car is rejected as a whole.

    Closed form of the sequential result: a car named by posts ends with the
    driver of the last post naming it, unless that driver posted again later
    in the car's tenant (which cleared it); a car never named keeps its
    holder unless the holder posted in the car's tenant. Two grouped
    aggregates and two joins, no ordering of the whole batch.
    """
    p = with_poster(assignments, users).where(F.col("_p_role") == "admin")
    avail = cars.where(F.col("status") == "active").select(
        F.col("id").alias("_a_id"), F.col("owner_user_id").alias("_a_owner"))
    p = p.join(avail, (p.car_id == avail._a_id) & (p._p_tenant == avail._a_owner), "left")
    # the valid posts feed two aggregates: computed once
    valid = (p.where(F.col("car_id").isNull() | F.col("_a_id").isNotNull())
                      .select("driver_id", "car_id", "_p_tenant", seq_col))
    last_post = (valid.groupBy(F.col("_p_tenant").alias("_lp_owner"), F.col("driver_id").alias("_lp_driver"))
                      .agg(F.max(seq_col).alias("_lp_seq")))
    # posts with equal sequence numbers are ordered by driver id
    last_set = (valid.where(F.col("car_id").isNotNull())
                     .groupBy(F.col("car_id").alias("_ls_car"))
                     .agg(F.max(F.struct(F.col(seq_col).alias("s"), F.col("driver_id").alias("d"))).alias("_ls"))
                     .select("_ls_car", F.col("_ls.d").alias("_ls_driver"), F.col("_ls.s").alias("_ls_seq")))
    c = cars.join(last_set, cars.id == last_set._ls_car, "left")
    named = F.col("_ls_car").isNotNull()
    holder = F.when(named, F.col("_ls_driver")).otherwise(F.col("current_driver_id"))
    c = c.withColumn("_holder", holder).withColumn("_since", F.when(named, F.col("_ls_seq")))
    c = c.join(last_post, (c.owner_user_id == last_post._lp_owner) & (c._holder == last_post._lp_driver), "left")
    cleared = F.col("_lp_seq").isNotNull() & (F.col("_since").isNull() | (F.col("_lp_seq") > F.col("_since")))
    new_holder = F.when(cleared, F.lit(None).cast("bigint")).otherwise(F.col("_holder"))
    return c.select(*[new_holder.alias(x) if x == "current_driver_id" else F.col(x) for x in cars.columns])


def assignment_rejects(cars: DataFrame, assignments: DataFrame, users: DataFrame) -> DataFrame:
    """Assignment posts that are rejected: no session, not admin, car unavailable."""
    p = with_poster(assignments, users)
    avail = cars.where(F.col("status") == "active").select(
        F.col("id").alias("_a_id"), F.col("owner_user_id").alias("_a_owner"))
    p = p.join(avail, (p.car_id == avail._a_id) & (p._p_tenant == avail._a_owner), "left")
    reasons = reasons_of((F.col("_p_role").isNull(), R_NO_SESSION),
                         (F.col("_p_role") == "driver", R_NOT_ADMIN),
                         (F.col("car_id").isNotNull() & F.col("_a_id").isNull(), R_CAR_UNAVAILABLE))
    return p.select(*assignments.columns, reasons.alias("reasons")).where(F.col("reasons") != "")


# --- users ---------------------------------------------------------------------

def _settled(judged: DataFrame, rows: DataFrame, key: list[str], code: str, **how) -> DataFrame:
    """Judged posts (``reasons`` of all other rules), each held to the unique ``key`` in posting order."""
    posts = judged.withColumn("may", F.col("reasons") == "")
    out = settle(posts, rows, key, **how)
    return out.withColumn("reasons", F.when(F.col("outcome") == TAKEN, F.lit(code)).otherwise(F.col("reasons"))).drop("may", "outcome")


def _with_last(rows: DataFrame, accepted: DataFrame, given: list[str], seq: str = "change_seq") -> DataFrame:
    """``rows`` with the ``given`` columns of each row's last accepted edit."""
    n = newest_per_key(accepted.select("id", seq, *given), ["id"], seq).drop(seq)
    n = n.select(F.col("id").alias("_n_id"), *[F.col(c).alias(f"_n_{c}") for c in given])
    j = rows.join(n, rows["id"] == n["_n_id"], "left")
    hit = F.col("_n_id").isNotNull()
    return j.select(*[F.when(hit, F.col(f"_n_{c}")).otherwise(rows[c]).alias(c) if c in given else rows[c] for c in rows.columns])


def judge_user_edits(edits: DataFrame, users: DataFrame, drivers: DataFrame,
                     managers: tuple[str, ...] | Column = USER_MANAGERS) -> DataFrame:
    """User edits with cleaned values and rejection reasons.

    The poster must be an admin whose username is a user manager. Name and
    username are required; the role is allow-listed (default driver) and an
    admin loses its driver link; a linked driver must belong to the tenant;
    a poster may not demote or deactivate itself; the edited user must belong
    to the tenant; at that point of the batch no other user may hold the new
    username.
    """
    mgr = users.select(F.col("id").alias("_m_id"), F.col("username").alias("_m_username"))
    p = with_poster(edits, users).join(mgr, F.col("posted_by") == F.col("_m_id"), "left")
    role = clean_enum("role_text", "role")
    driver = F.when(role == "admin", F.lit(None).cast("bigint")).otherwise(F.col("driver_id"))
    p = p.withColumn("role", role).withColumn("linked_driver", driver)
    d = drivers.select(F.col("id").alias("_d_id"), F.col("owner_user_id").alias("_d_owner"))
    t = users.select(F.col("id").alias("_u_id"), F.col("owner_user_id").alias("_u_owner"))
    p = (p.join(d, (p.linked_driver == d._d_id) & (p._p_tenant == d._d_owner), "left")
          .join(t, (p.id == t._u_id) & (p._p_tenant == t._u_owner), "left"))
    reasons = reasons_of(
        (~is_user_manager(managers), R_NOT_MANAGER),
        ((trim("full_name_text") == "") | (trim("username_text") == ""), R_MISSING),
        (F.col("linked_driver").isNotNull() & F.col("_d_id").isNull(), R_DRIVER_NOT_IN_OWNER),
        ((F.col("id") == F.col("posted_by")) & ((F.col("role") != "admin") | (F.col("is_active") != 1)),
         R_SELF_LOCK),
        (F.col("_u_id").isNull(), R_USER_NOT_IN_OWNER),
    )
    judged = p.select("change_seq", "id", "posted_by", trim("full_name_text").alias("full_name"),
                      trim("username_text").alias("username"), "role",
                      F.col("linked_driver").alias("driver_id"), "is_active", reasons.alias("reasons"))
    return _settled(judged, users, ["username"], R_DUPLICATE_USERNAME)


def apply_user_edits(users: DataFrame, judged: DataFrame) -> DataFrame:
    """Users after the accepted edits of a judged batch."""
    return _with_last(users, judged.where(F.col("reasons") == ""), ["full_name", "username", "role", "driver_id", "is_active"])


# --- drivers ---------------------------------------------------------------------

def judge_driver_edits(edits: DataFrame, drivers: DataFrame, users: DataFrame) -> DataFrame:
    """Driver edits with cleaned values and reasons: admins of the driver's
    tenant only, name required, empty dni to NULL, allow-listed status, and at
    that point of the batch no other driver of the tenant may hold the new dni."""
    p = with_poster(edits, users)
    tgt = drivers.select(F.col("id").alias("_t_id"), F.col("owner_user_id").alias("_t_owner"))
    p = p.join(tgt, (p.id == tgt._t_id) & (p._p_tenant == tgt._t_owner), "left")
    name = trim("full_name_text")
    reasons = reasons_of(
        (F.col("_p_role").isNull(), R_NO_SESSION),
        (F.col("_p_role") == "driver", R_NOT_ADMIN),
        (F.col("_p_role").isNotNull() & F.col("_t_id").isNull(), R_OTHER_OWNER),
        (name == "", R_NO_NAME),
    )
    judged = p.select("change_seq", "id", "posted_by", F.col("_p_tenant").alias("owner_user_id"), name.alias("full_name"),
                      F.nullif(trim("dni_text"), F.lit("")).alias("dni"), clean_enum("status_text", "status").alias("status"),
                      reasons.alias("reasons"))
    return _settled(judged, drivers, ["owner_user_id", "dni"], R_DUPLICATE_DNI).drop("owner_user_id")


def apply_driver_edits(drivers: DataFrame, judged: DataFrame) -> DataFrame:
    """Drivers after the accepted edits (name, dni, status) of a judged batch."""
    return _with_last(drivers, judged.where(F.col("reasons") == ""), ["full_name", "dni", "status"])


# --- expenses, notes, cars ----------------------------------------------------------

def apply_expense_deletes(expenses: DataFrame, deletes: DataFrame, users: DataFrame) -> DataFrame:
    """Fleet expenses after delete requests by admins of the expense's tenant."""
    p = with_poster(deletes, users).where(F.col("_p_role") == "admin")
    gone = (p.select(F.col("id").alias("_g_id"), F.col("_p_tenant").alias("_g_owner")).distinct())
    out = expenses.join(gone, (expenses.id == gone._g_id) & (expenses.owner_user_id == gone._g_owner), "left_anti")
    return out.select(*expenses.columns)


def apply_note_deletes(notes: DataFrame, deletes: DataFrame, users: DataFrame, as_of: dt.date) -> DataFrame:
    """Week notes after delete posts (admins; the note of the poster's tenant and week)."""
    p = with_poster(deletes, users).where(F.col("_p_role") == "admin")
    week = P.valid_or_default("week_text", P.WEEK_RE, P.valid_week_or_current(None, as_of))
    start, _ = P.week_bounds_of_text(week)
    gone = p.select(F.col("_p_tenant").alias("owner_user_id"), start.alias("week_start")).distinct()
    return notes.join(gone, ["owner_user_id", "week_start"], "left_anti").select(*notes.columns)


def judge_car_edits(cleaned_forms: DataFrame, cars: DataFrame, users: DataFrame) -> DataFrame:
    """Cleaned car edit forms (``form_seq`` is their order, ``id`` the car) with
    reasons: admins of the car's tenant only, brand / model / plate required, and
    at that point of the batch no other car of the tenant may hold the plate."""
    p = with_poster(cleaned_forms, users)
    tgt = cars.select(F.col("id").alias("_t_id"), F.col("owner_user_id").alias("_t_owner"))
    p = p.join(tgt, (p.id == tgt._t_id) & (p._p_tenant == tgt._t_owner), "left")
    reasons = reasons_of(
        (F.col("_p_role").isNull(), R_NO_SESSION),
        (F.col("_p_role") == "driver", R_NOT_ADMIN),
        (F.col("_p_role").isNotNull() & F.col("_t_id").isNull(), R_OTHER_OWNER),
        (F.col("reasons").contains(R_MISSING_FIELDS), R_MISSING_FIELDS),
        (F.col("reasons").contains(R_BAD_YEAR), R_BAD_YEAR),
    )
    judged = p.select("form_seq", "id", "posted_by", F.col("_p_tenant").alias("owner_user_id"), "brand", "model", "plate",
                      "year", "status", reasons.alias("reasons"))
    return _settled(judged, cars, ["owner_user_id", "plate"], R_DUPLICATE_PLATE, seq="form_seq").drop("owner_user_id")


def apply_car_edits(cars: DataFrame, judged: DataFrame) -> DataFrame:
    """Cars after the accepted edits (brand, model, plate, year, status) of a judged batch."""
    given = [c for c in ("brand", "model", "plate", "year", "status") if c in cars.columns]
    return _with_last(cars, judged.where(F.col("reasons") == ""), given, seq="form_seq")


# --- the driver form: driver fields and car assignment in one save ------------------------

def judge_driver_saves(posts: DataFrame, drivers: DataFrame, cars: DataFrame, users: DataFrame) -> DataFrame:
    """Driver form posts with reasons; a post is one save that succeeds or fails whole.

    ``id`` 0 creates a driver, otherwise it edits driver ``id`` (an edit of a
    driver of another tenant changes no driver row, but its car assignment
    still runs, as in the original form). Rules in order: admins only; name
    required; a chosen car must be an active car of the tenant; at that point
    of the batch no other driver of the tenant may hold the dni.
    """
    p = with_poster(posts, users)
    name = trim("full_name_text")
    dni = F.nullif(trim("dni_text"), F.lit(""))
    car = F.when(trim("assigned_car_text") == "", F.lit(None).cast("bigint")).otherwise(
        trim("assigned_car_text").try_cast("bigint"))
    p = p.select("*", name.alias("full_name"), dni.alias("dni"), car.alias("car_id"),
                 clean_enum("status_text", "status").alias("status"))
    avail = cars.where(F.col("status") == "active").select(F.col("id").alias("_a_id"),
                                                          F.col("owner_user_id").alias("_a_owner"))
    p = p.join(avail, (p.car_id == avail._a_id) & (p._p_tenant == avail._a_owner), "left")
    tgt = drivers.select(F.col("id").alias("_t_id"), F.col("owner_user_id").alias("_t_owner"))
    p = p.join(tgt, (p.id == tgt._t_id) & (p._p_tenant == tgt._t_owner), "left")
    writes = (F.col("id") == 0) | F.col("_t_id").isNotNull()
    # checked in the form's order: each rule only when the earlier ones passed
    admin = F.col("_p_role") == "admin"
    reasons = reasons_of(
        (F.col("_p_role").isNull(), R_NO_SESSION),
        (F.col("_p_role") == "driver", R_NOT_ADMIN),
        (admin & (F.col("full_name") == ""), R_NO_NAME),
        (admin & (F.col("full_name") != "") & F.col("car_id").isNotNull() & F.col("_a_id").isNull(), R_CAR_UNAVAILABLE),
    )
    # a new driver is a row of its own; ids below 0 name no stored driver
    judged = p.select("change_seq", "posted_by", "id", F.col("_p_tenant").alias("owner_user_id"), "full_name", "dni", "status",
                      "car_id", writes.alias("writes_driver"), F.when(F.col("id") > 0, F.col("id")).otherwise(-F.col("change_seq")).alias("_row"),
                      reasons.alias("reasons"))
    settled = _settled(judged, drivers.withColumnRenamed("id", "_row"), ["owner_user_id", "dni"], R_DUPLICATE_DNI,
                       entity="_row", claims=F.col("writes_driver"))
    return settled.drop("_row")


def apply_driver_saves(drivers: DataFrame, cars: DataFrame, judged: DataFrame, users: DataFrame,
                       id_base: int | None = None) -> dict:
    """Drivers and cars after the accepted saves of a judged batch.

    Edits of the tenant's drivers take the newest save per driver; creations
    get ids above the current maximum in posting order; then every accepted
    save runs its car assignment (clear the driver's cars in the tenant, give
    the chosen car), applied as in ``apply_assignments``. ``id_base`` (the
    largest id taken, when the deployment keeps it) saves a scan for it.
    """
    ok = judged.where(F.col("reasons") == "")
    top = (drivers.select(F.coalesce(F.max("id"), F.lit(0))).scalar() if id_base is None
           else F.lit(id_base).cast("bigint"))
    saved_id = F.when(F.col("id") > 0, F.col("id")).otherwise(top + F.col("change_seq")).cast("bigint")
    edited = _with_last(drivers, ok.where((F.col("id") > 0) & F.col("writes_driver")), ["full_name", "dni", "status"])
    created = ok.where(F.col("id") == 0).select(saved_id.alias("id"), "owner_user_id", "full_name", "dni", "status")
    new_drivers = edited.unionByName(created.select(*drivers.columns))
    assignments = ok.select("change_seq", "posted_by", saved_id.alias("driver_id"), "car_id")
    return {"drivers": new_drivers, "cars": apply_assignments(cars, assignments, users)}
