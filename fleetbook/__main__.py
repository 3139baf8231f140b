"""Command line: show one screen's sections, or store the fleet tables.

    python -m fleetbook page report --sf-dir /root/testdata/sf0.01 --role admin --owner 1 \\
        --param period=week --param week=1997-W10
    python -m fleetbook stage --sf-dir /root/testdata/sf0.1 --out <shared folder>

``page`` prints up to ``--rows`` rows of each section (screens are small);
``stage`` writes the fleet tables derived from a test folder as partitioned
parquet.
"""

from __future__ import annotations

import argparse
import datetime as dt

from fleetbook.plans.pages import PAGES
from fleetbook.scope import Scope
from fleetbook.session import build_session
from fleetbook.sources.fixtures import TestdataTables
from fleetbook.sources.tables import StagedTables, stage_fleet_tables


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="fleetbook")
    sub = ap.add_subparsers(dest="cmd", required=True)
    pg = sub.add_parser("page")
    pg.add_argument("name", choices=sorted(PAGES))
    pg.add_argument("--sf-dir", required=True)
    pg.add_argument("--tables", help="folder of stored fleet tables (default: derive from --sf-dir)")
    pg.add_argument("--role", choices=("admin", "driver"), default="admin")
    pg.add_argument("--owner", type=int, default=1)
    pg.add_argument("--driver", type=int, help="linked driver of a driver user")
    pg.add_argument("--as-of", default=None, help="today, YYYY-MM-DD")
    pg.add_argument("--param", action="append", default=[], help="request parameter key=value")
    pg.add_argument("--rows", type=int, default=20)
    st = sub.add_parser("stage")
    st.add_argument("--sf-dir", required=True)
    st.add_argument("--out", default=None)
    a = ap.parse_args(argv)

    spark = build_session()
    if a.cmd == "stage":
        print(stage_fleet_tables(TestdataTables(spark, a.sf_dir), a.out))
        return
    t = StagedTables(spark, a.sf_dir, a.tables) if a.tables else TestdataTables(spark, a.sf_dir)
    session = (Scope.admin(a.owner) if a.role == "admin" else Scope.driver_user(a.driver, a.owner))
    req = dict(p.split("=", 1) for p in a.param)
    as_of = dt.date.fromisoformat(a.as_of) if a.as_of else dt.date.today()
    for section, df in PAGES[a.name](t, session, req, as_of).items():
        print(f"== {section}")
        df.show(a.rows, truncate=False)


if __name__ == "__main__":
    main()
