"""Batches on stored tables: touched months only, deletes with their effects, requests as rows, names, clips."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from fleetbook.functions import amounts as A
from fleetbook.functions import periods as P
from fleetbook.operators import audits, changes, deletes, rollups
from fleetbook.sources.fixtures import TestdataTables
from fleetbook.sources.standins import StandinBatches
from fleetbook.sources.tables import read_table, rewrite_months, touched_months, write_table

d = dt.date


# --- rewriting touched months ----------------------------------------------------------------

def files_of(path, name):
    return {p.relative_to(path): p.stat().st_mtime_ns for p in Path(path, name).rglob("*.parquet")}


def stored_rows(spark, path, name):
    return sorted(map(str, read_table(spark, path, name).collect()))


@pytest.fixture
def edited(spark, tmp_path):
    """Stored entries, and a batch of edits judged on them."""
    t = TestdataTables(spark, SF_SMALL)
    path = str(tmp_path)
    write_table(t.entries, path, "entries")
    entries = read_table(spark, path, "entries")
    edits = StandinBatches(t).entry_edits.where(F.col("entry_date").between(d(1997, 3, 1), d(1997, 4, 30)))
    judged = changes.judge_entry_edits(edits, entries, t.users, t.drivers, t.cars)
    want = sorted(map(str, changes.apply_entry_edits(entries, judged).collect()))
    months = touched_months(judged, entries)
    assert 0 < months.count() < 5
    return path, judged, months, want


def test_only_touched_months_are_rewritten_once(spark, edited):
    path, judged, months, want = edited
    touched = {r[0] for r in months.collect()}
    before = files_of(path, "entries")
    seen = []

    def change(rows):
        seen.append(rows.select(F.date_format("entry_date", "yyyy-MM")).distinct().count())
        return changes.apply_entry_edits(rows, judged)

    assert rewrite_months(spark, path, "entries", "batch-1", months, change)
    after = files_of(path, "entries")
    month = lambda f: f.parts[1].split("=")[1]
    assert {f: x for f, x in before.items() if month(f) not in touched} == {f: x for f, x in after.items() if month(f) not in touched}
    assert all(f not in after for f in before if month(f) in touched) and seen == [len(touched)]
    assert stored_rows(spark, path, "entries") == want
    assert not rewrite_months(spark, path, "entries", "batch-1", months, change)
    assert files_of(path, "entries") == after and len(seen) == 1


def test_a_retry_after_a_failure_applies_the_batch_once(spark, edited, monkeypatch):
    from fleetbook.sources import tables as S

    path, judged, months, want = edited
    calls = []

    def change(rows):
        calls.append(1)
        return changes.apply_entry_edits(rows, judged)

    def lost(*a, **k):
        raise RuntimeError("executor lost")

    with monkeypatch.context() as m:
        m.setattr(S, "write_table", lost)
        with pytest.raises(RuntimeError):
            rewrite_months(spark, path, "entries", "b", months, change)
    assert rewrite_months(spark, path, "entries", "b", months, change)
    assert stored_rows(spark, path, "entries") == want and len(calls) == 1


def test_a_month_without_rows_goes(spark, tmp_path):
    path = str(tmp_path)
    e = spark.createDataFrame([(1, d(1997, 3, 3), 1, 1), (2, d(1997, 4, 3), 1, 1)], "id long, entry_date date, owner_user_id long, driver_id long")
    write_table(e, path, "entries")
    months = spark.createDataFrame([("1997-03",), ("1997-04",)], "stored_month string")
    move = lambda rows: rows.withColumn("entry_date", F.lit(d(1997, 4, 9)))
    assert rewrite_months(spark, path, "entries", "x", months, move)
    assert sorted((r.id, r.entry_date) for r in read_table(spark, path, "entries").collect()) == [(1, d(1997, 4, 9)), (2, d(1997, 4, 9))]
    assert not Path(path, "entries", "stored_month=1997-03").exists()
    with pytest.raises(ValueError):
        rewrite_months(spark, path, "entries", "y", months.limit(1), lambda rows: move(spark.createDataFrame([(9, d(1997, 4, 1), 1, 1)], e.schema)))


# --- deletes ------------------------------------------------------------------------------------

def fleet(spark):
    return {
        "drivers": spark.createDataFrame([(1,), (2,), (3,)], "id long"),
        "cars": spark.createDataFrame([(10, 1), (11, 2), (12, None)], "id long, current_driver_id long"),
        "users": spark.createDataFrame([(20, 2), (21, 3), (22, None)], "id long, driver_id long"),
        "access_tokens": spark.createDataFrame([(30, 20), (31, 20), (32, 22)], "id long, user_id long"),
        "daily_entries": spark.createDataFrame([(40, 1, 10, 20, None), (41, 1, 11, 22, 20)], "id long, driver_id long, car_id long, created_by long, updated_by long"),
        "general_expenses": spark.createDataFrame([(50, 20), (51, None)], "id long, created_by long"),
    }


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id long")


def test_deletes_restrict_clear_and_cascade(spark):
    t = fleet(spark)
    after, said = deletes.apply_delete_batch(t, {"drivers": ids(spark, 1, 2, 2, 9), "cars": ids(spark, 11, 12), "users": ids(spark, 20)})
    assert {(r.table_name, r.id): r.outcome for r in said.collect()} == {
        ("drivers", 1): "restricted", ("drivers", 2): "deleted", ("drivers", 9): "not_found",
        ("cars", 11): "restricted", ("cars", 12): "deleted", ("users", 20): "deleted"}
    rows = {n: sorted(map(tuple, df.collect()), key=repr) for n, df in after.items()}
    assert rows["drivers"] == [(1,), (3,)]
    assert rows["cars"] == [(10, 1), (11, None)]                       # the link to driver 2 is cleared
    assert rows["users"] == [(21, 3), (22, None)]
    assert rows["access_tokens"] == [(32, 22)]                        # the user's tokens went along
    assert rows["daily_entries"] == [(40, 1, 10, None, None), (41, 1, 11, 22, None)]
    assert rows["general_expenses"] == [(50, None), (51, None)]
    assert {n: df.schema for n, df in after.items()} == {n: df.schema for n, df in t.items()}


def test_a_batch_removes_entries_before_their_driver(spark):
    t = fleet(spark)
    after, said = deletes.apply_delete_batch(t, {"drivers": ids(spark, 1), "daily_entries": ids(spark, 40, 41)})
    assert {r.outcome for r in said.collect()} == {"deleted"} and after["daily_entries"].count() == 0 and after["drivers"].count() == 2
    # as statements of their own, drivers first
    kept, said = deletes.apply_deletes_of(t, "drivers", ids(spark, 1))
    assert said.first().outcome == "restricted" and kept["drivers"].count() == 3


def test_a_restricted_cascade_blocks_the_request(spark):
    from fleetbook.schemas import ForeignKey

    keys = (ForeignKey("b", "a_id", "a", "cascade"), ForeignKey("c", "b_id", "b", "cascade"), ForeignKey("x", "c_id", "c", "restrict"))
    t = {"a": ids(spark, 1, 2), "b": spark.createDataFrame([(5, 1), (6, 2)], "id long, a_id long"),
         "c": spark.createDataFrame([(7, 5), (8, 6)], "id long, b_id long"), "x": spark.createDataFrame([(9, 7)], "id long, c_id long")}
    assert deletes.delete_order(keys) == ["x", "c", "b", "a"]
    after, said = deletes.apply_delete_batch(t, {"a": ids(spark, 1, 2)}, keys)
    assert {r.id: r.outcome for r in said.collect()} == {1: "restricted", 2: "deleted"}
    assert {n: [r.id for r in df.collect()] for n, df in after.items()} == {"a": [1], "b": [5], "c": [7], "x": [9]}


# --- requests, names, clips -----------------------------------------------------------------------

def test_requested_totals_equal_the_resolver(spark):
    """Bounds of every request as the single-request resolver gives them, totals by brute force."""
    t = TestdataTables(spark, SF_SMALL)
    as_of = d(1997, 3, 5)
    requests = StandinBatches(t).period_requests
    entries = [(r.owner_user_id, r.driver_id, r.entry_date, r.gross_income, r.net_total) for r in t.daily_entries.collect()]
    got = {r.request_id: r for r in rollups.requested_totals(requests, t.daily_entries, as_of).collect()}
    asked = requests.collect()
    assert len(got) == len(asked) == 150
    for q in asked:
        r = got[q.request_id]
        want = P.period_range(q.period_text, q.date_text, q.week_text, q.month_text, as_of)
        bounds = (want.start, want.end) if want.start <= want.end else (None, None)
        assert (r.start_date, r.end_date) == bounds, q
        hits = [e for e in entries if bounds[0] and e[0] == q.owner_user_id and bounds[0] <= e[2] <= bounds[1] and q.driver_id in (None, e[1])]
        assert (r.entries, r.days, r.gross, r.net) == (len(hits), len({e[2] for e in hits}), sum((e[3] for e in hits), Decimal("0.00")), sum((e[4] for e in hits), Decimal("0.00")))
    assert {r.period for r in got.values()} == {"day", "week", "month"}


def test_places_under_the_source_collation(spark):
    names = spark.createDataFrame([(1, "Zoe"), (2, "jose"), (3, "JOSÉ  "), (4, "ana"), (5, "Ñandú"), (6, None), (7, "nandu")], "id long, username string")
    got = {r.id: r.place for r in audits.places(names, "username").collect()}
    assert got == {4: 1, 2: 2, 3: 2, 5: 3, 7: 3, 1: 4, 6: None}


@pytest.mark.parametrize("text", ["", "abc", "ñ" * 5, "a€b€c€", "\U0001f600\U0001f600", "aa\U0001f600é€", None])
def test_clip_by_bytes(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    for n in range(9):
        want = None if text is None else text.encode()[:n].decode(errors="ignore")
        assert df.select(A.clip("t", n)).first()[0] == want, n
