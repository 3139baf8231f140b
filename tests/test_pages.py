"""Whole screens from raw request parameters."""

from __future__ import annotations

import datetime as dt

from conftest import SF_SMALL
from fleetbook.plans import pages
from fleetbook.scope import Scope
from fleetbook.sources.fixtures import TestdataTables

AS_OF = dt.date(1997, 3, 5)


def test_request_cleaning():
    assert pages._int("12abc") == 12 and pages._int("") == 0 and pages._int("-3") == -3 and pages._int(None) == 0
    r = pages.request_range({"period": "year", "week": "bad"}, AS_OF)      # unknown period -> week
    assert (r.start, r.end) == (dt.date(1997, 3, 3), dt.date(1997, 3, 9))
    r = pages.request_range({"billing_period": "month", "billing_month": "1997-02"}, AS_OF, "billing_")
    assert (r.start, r.end) == (dt.date(1997, 2, 1), dt.date(1997, 2, 28))
    s = pages.request_scope(Scope.driver_user(7, 1), {"driver_id": "99", "car_id": "-4"})
    assert s.resolved_driver() == 7 and s.resolved_car() == 0


def test_every_page_runs(spark):
    t = TestdataTables(spark, SF_SMALL)
    req = {"period": "month", "month": "1997-03", "rental_status": "pending", "billing_period": "month",
           "billing_month": "1997-03", "edit": "1"}
    for session in (Scope.admin(1), Scope.driver_user(1, 1), Scope.driver_user(None, 1)):
        for name, fn in pages.PAGES.items():
            sections = fn(t, session, req, AS_OF)
            assert sections
            for df in sections.values():
                df.write.format("noop").mode("overwrite").save()
    admin_panel = pages.panel_page(t, Scope.admin(1), {"period": "week", "week": "1997-W10"}, AS_OF)
    assert {"entries", "rental_split", "expenses", "fleet", "weekly_note"} <= set(admin_panel)
    unlinked = pages.report_page(t, Scope.driver_user(None, 1), {"period": "month", "month": "1997-03"}, AS_OF)
    assert unlinked["daily"].count() == 0 and unlinked["pick_cars"].count() == 0
