"""Edits that claim unique keys, against posting them one by one."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fleetbook.operators import changes as C
from fleetbook.operators import claims

KEY = ("period_type", "entry_date", "driver_id", "car_id")


@pytest.mark.parametrize("seed,range_posts", [(0, 1000), (1, 20), (2, 7)])
def test_claims_equal_one_by_one(spark, seed, range_posts):
    """Random claims, some stored twice already, some null, some guarded, over one or many ranges of the sequence."""
    rnd = random.Random(seed)
    keys = [*range(6), None]
    stored = {i: rnd.choice(keys) for i in range(1, 11)}
    posts = [(q, rnd.randint(1, 13), rnd.choice(keys), rnd.random() < .85, rnd.random() < .9, rnd.choice([None, None, 0, 1, 2]))
             for q in rnd.sample(range(1000), 60)]
    rows = spark.createDataFrame(list(stored.items()), "id long, k long")
    df = spark.createDataFrame(posts, "change_seq long, id long, k long, may boolean, w boolean, must long")

    def guard(had):
        return F.col("must").isNull() | had.getField("k").eqNullSafe(F.col("must"))

    got = {r.change_seq: r.outcome for r in claims.settle(df, rows, ["k"], claims=F.col("w"), guard=guard, guard_columns=("must",),
                                                          range_posts=range_posts).collect()}
    want, now = {}, dict(stored)
    for q, i, k, may, writes, must in sorted(posts):
        want[q] = None
        if must is not None and now.get(i) != must:
            want[q] = "guarded"
        elif may and writes and k is not None and any(v == k for j, v in now.items() if j != i):
            want[q] = "taken"
        elif may and writes:
            now[i] = k
    assert got == want


def test_long_chain_of_refusals(spark):
    """Every post wants the key that the one before fails to leave."""
    n = 12
    rows = spark.createDataFrame([(i, i) for i in range(n + 1)], "id long, k long")
    posts = spark.createDataFrame([(i, i, i - 1, True) for i in range(1, n + 1)], "change_seq long, id long, k long, may boolean")
    assert {r.outcome for r in claims.settle(posts, rows, ["k"]).collect()} == {"taken"}
    freed = posts.unionByName(spark.createDataFrame([(0, 0, 99, True)], posts.schema))
    assert {r.outcome for r in claims.settle(freed, rows, ["k"]).collect()} == {None}
    assert claims.settle(posts.limit(0), rows, ["k"]).collect() == []


def one_by_one(entries, edits, users, drivers, cars):
    """The entry form, post after post."""
    rows, out = {e["id"]: dict(e) for e in entries}, {}
    for p in sorted(edits, key=lambda x: x["change_seq"]):
        user, row = users.get(p["posted_by"]), rows.get(p["id"])
        reasons = []
        if user is None:
            reasons = ["no_session"]
        elif row is None:
            reasons = ["not_found"]
        elif row["owner_user_id"] != user["tenant"]:
            reasons = ["other_owner"]
        elif user["role"] == "driver" and row["driver_id"] != user["driver"]:
            reasons = ["other_driver"]
        else:
            driver = p["driver_id"] if user["role"] == "admin" else user["driver"] or 0
            car = cars.get(p["car_id"])
            day = p["entry_date"]
            if p["period_type"] == "week" and day:
                day -= dt.timedelta(days=day.weekday())
            if driver <= 0:
                reasons.append("no_driver")
            if p["car_id"] <= 0:
                reasons.append("no_car")
            if not reasons and user["role"] == "admin":
                d = drivers.get(driver)
                if not (d and d["owner"] == user["tenant"] and d["status"] == "active"):
                    reasons.append("driver_not_in_owner")
                if not (car and car["owner"] == user["tenant"] and car["status"] == "active"):
                    reasons.append("car_not_in_owner")
            if not reasons and user["role"] == "driver" and not (car and car["driver"] == driver and car["status"] == "active"):
                reasons.append("car_not_assigned")
            if day is None:
                reasons.append("bad_date")
            if p["gross_income"] is None:
                reasons.append("bad_amount")
            key = (p["period_type"], day, driver, p["car_id"])
            if not reasons and any(tuple(r[k] for k in KEY) == key for i, r in rows.items() if i != p["id"]):
                reasons = ["duplicate"]
            if not reasons:
                row.update(zip(KEY, key, strict=True))
                row.update(gross_income=p["gross_income"], observations=p["observations"], updated_by=p["posted_by"],
                           total_expenses=Decimal("3.00"), net_total=p["gross_income"] - 3, year_number=day.year)
                if user["role"] == "admin":
                    row["rental_billing_status"] = p["status_text"] if p["status_text"] in ("pending", "invoiced") else "pending"
        out[p["change_seq"]] = ",".join(reasons)
    return out, rows


@pytest.mark.parametrize("seed", range(3))
def test_entry_edits_equal_one_by_one(spark, seed):
    rnd = random.Random(seed)
    day = lambda: dt.date(1997, 3, rnd.randint(3, 6))
    drivers = {i: {"owner": 1 + i // 4, "status": "inactive" if i == 3 else "active"} for i in range(1, 6)}
    cars = {i: {"owner": 1 + i // 5, "status": "inactive" if i == 4 else "active", "driver": i} for i in range(1, 7)}
    users = {1: {"role": "admin", "tenant": 1, "driver": None}, 2: {"role": "driver", "tenant": 1, "driver": 1},
             3: {"role": "driver", "tenant": 1, "driver": 2}, 4: {"role": "admin", "tenant": 2, "driver": None},
             5: {"role": "driver", "tenant": 1, "driver": None}}
    entries, seen = [], set()
    while len(entries) < 12:
        key = (rnd.choice(["day", "day", "week"]), day(), rnd.randint(1, 2), rnd.randint(1, 3))
        if key not in seen:
            seen.add(key)
            entries.append(dict(zip(KEY, key, strict=True)) | {
                "id": len(entries) + 1, "owner_user_id": 1, "gross_income": Decimal("5.00"), "total_expenses": Decimal("1.00"),
                "net_total": Decimal("4.00"), "rental_billing_status": "pending", "observations": None, "updated_by": None, "year_number": 1990})
    edits = [{"change_seq": q, "id": rnd.randint(1, 13), "posted_by": rnd.choice([1, 1, 1, 2, 2, 3, 4, 5, 9]),
              "period_type": rnd.choice(["day", "day", "day", "week"]), "entry_date": None if rnd.random() < .03 else day(),
              "driver_id": rnd.choice([1, 1, 2, 2, 3, 0]), "car_id": rnd.choice([1, 1, 2, 2, 3, 4, 0]),
              "gross_income": None if rnd.random() < .03 else Decimal(f"{q}.00"), "status_text": rnd.choice(["invoiced", "x"]),
              "observations": f"o{q}"} for q in rnd.sample(range(10, 900), 90)]
    zero, one_ = F.lit(0).cast("decimal(12,2)"), F.lit(1).cast("decimal(12,2)")
    kinds = "period_type string, entry_date date, driver_id long, car_id long"
    e_df = spark.createDataFrame(entries, f"id long, owner_user_id long, {kinds}, gross_income decimal(12,2), total_expenses decimal(12,2), "
                                 "net_total decimal(12,2), rental_billing_status string, observations string, updated_by long, year_number int")
    amounts = [one_.alias(c) for c in ("app_expenses", "cash_collected", "rental_amount")] + [zero.alias("fuel_cost"), zero.cast("decimal(10,2)").alias("distance_km")]
    e_df = e_df.select("*", *amounts)
    x_df = spark.createDataFrame(edits, f"change_seq long, id long, posted_by long, {kinds}, gross_income decimal(12,2), status_text string, observations string")
    x_df = x_df.select("*", *amounts)
    u_df = spark.createDataFrame([(i, u["role"], u["tenant"], u["driver"]) for i, u in users.items()], "id long, role string, owner_user_id long, driver_id long")
    d_df = spark.createDataFrame([(i, d["owner"], d["status"]) for i, d in drivers.items()], "id long, owner_user_id long, status string")
    c_df = spark.createDataFrame([(i, c["owner"], c["status"], c["driver"]) for i, c in cars.items()], "id long, owner_user_id long, status string, current_driver_id long")
    judged = C.judge_entry_edits(x_df, e_df, u_df, d_df, c_df)
    want, rows = one_by_one(entries, edits, users, drivers, cars)
    got = {r.change_seq: r.reasons for r in judged.collect()}
    assert got == want and "duplicate" in want.values() and "other_driver" in want.values() and "" in want.values()
    after = {r.id: r.asDict() for r in C.apply_entry_edits(e_df, judged).collect()}
    for i, row in rows.items():
        assert {k: after[i][k] for k in row} == row


def test_edits_of_dimensions_equal_one_by_one(spark):
    """Drivers trade their dni; the first claim in order wins, a freed value can be taken."""
    rnd = random.Random(5)
    base = {i: (1 + i % 2, f"{rnd.randint(1, 9)}") for i in range(1, 9)}
    drivers = spark.createDataFrame([(i, o, f"n{i}", d, "active") for i, (o, d) in base.items()],
                                    "id long, owner_user_id long, full_name string, dni string, status string")
    users = spark.createDataFrame([(1, "admin", 1, None), (2, "admin", 2, None), (3, "driver", 1, None)],
                                  "id long, role string, owner_user_id long, driver_id long")
    edits = [(q, rnd.randint(1, 9), rnd.choice([1, 1, 2, 2, 3, None]), rnd.choice([" a ", "b", " "]) if rnd.random() < .3 else f"m{q}",
              rnd.choice([" ", *"123456789"]), rnd.choice(["inactive", "?"])) for q in rnd.sample(range(500), 60)]
    df = spark.createDataFrame(edits, "change_seq long, id long, posted_by long, full_name_text string, dni_text string, status_text string")
    judged = C.judge_driver_edits(df, drivers, users)
    got = {r.change_seq: r.reasons for r in judged.collect()}
    now, names, want = dict(base), {}, {}
    for q, i, by, name, dni, _ in sorted(edits, key=lambda e: e[0]):
        role, tenant = {1: ("admin", 1), 2: ("admin", 2), 3: ("driver", 1), None: (None, None)}[by]
        mine = i in base and base[i][0] == tenant
        reasons = [c for bad, c in ((role is None, "no_session"), (role == "driver", "not_admin"), (role is not None and not mine, "other_owner"),
                                    (not name.strip(), "no_name")) if bad]
        dni = dni.strip() or None
        if not reasons and dni and any(v == (tenant, dni) for j, v in now.items() if j != i):
            reasons = ["duplicate_dni"]
        if not reasons:
            now[i], names[i] = (tenant, dni), name.strip()
        want[q] = ",".join(reasons)
    assert got == want
    after = {r.id: r for r in C.apply_driver_edits(drivers, judged).collect()}
    assert {i: (r.owner_user_id, r.dni) for i, r in after.items()} == now
    assert all(after[i].full_name == n for i, n in names.items())


def test_only_contested_posts_are_judged_in_rounds(spark, monkeypatch):
    """Posts that alone want a free key are settled without rounds; two that want one key, and rows whose key is wanted, are not."""
    seen, keep = [], claims.written

    def counted(df, name):
        out = keep(df, name)
        seen.append((name, out.count()))
        return out

    monkeypatch.setattr(claims, "written", counted)
    rows = spark.range(100).select("id", F.col("id").alias("k"))
    posts = spark.range(50).select(F.col("id").alias("change_seq"), "id", F.when(F.col("id") == 1, 1002).when(F.col("id") == 3, 4).otherwise(F.col("id") + 1000).alias("k"), (F.col("id") != 9).alias("may"))
    got = {r.change_seq: r.outcome for r in claims.settle(posts, rows, ["k"]).collect()}
    # 1 takes what 2 wants; 3 wants what 4 leaves only later
    assert got == {i: "taken" if i in (2, 3) else None for i in range(50)}
    assert {n for name, n in seen if name == "claims-round"} == {4}


@pytest.mark.parametrize("seed,range_posts", [(3, 1000), (4, 5)])
def test_free_posts_and_stored_keys(spark, seed, range_posts):
    """As one by one, when the caller says which posts no guard stops and brings the stored keys."""
    rnd = random.Random(seed)
    stored = {i: rnd.choice([*range(30), None]) for i in range(1, 31)}
    posts = [(q, rnd.randint(1, 35), rnd.choice([*range(30), None]), rnd.random() < .7, rnd.choice([None, None, *range(10)]))
             for q in rnd.sample(range(1000), 80)]
    rows = spark.createDataFrame(list(stored.items()), "id long, k long")
    df = spark.createDataFrame(posts, "change_seq long, id long, k long, may boolean, must long")
    df = df.join(rows.select("id", claims.whole_key(["k"]).alias("was")), "id", "left")
    got = {r.change_seq: r.outcome for r in claims.settle(
        df, rows, ["k"], guard=lambda had: F.col("must").isNull() | had.getField("k").eqNullSafe(F.col("must")), guard_columns=("must",),
        range_posts=range_posts, free=F.col("must").isNull(), stored="was").collect()}
    want, now = {}, dict(stored)
    for q, i, k, may, must in sorted(posts, key=lambda p: p[0]):
        want[q] = None
        if must is not None and now.get(i) != must:
            want[q] = "guarded"
        elif may and k is not None and any(v == k for j, v in now.items() if j != i):
            want[q] = "taken"
        elif may:
            now[i] = k
    assert got == want and {"taken", "guarded"} < set(want.values())
