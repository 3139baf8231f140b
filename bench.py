"""Benchmark: every registered query at one scale factor.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS
(default 8), BENCH_MODE (``staged`` default, ``derived``, or ``both``),
BENCH_SHUFFLE (initial shuffle partitions, default twice the cores; at sf0.1
8 was slower and 32 no faster), BENCH_EVENTLOG (a folder: write Spark's event
log there for stage and task times).

* derived: each query as registered, deriving the fleet tables from the
  TPC-H-like parquet inside the query (what the correctness check runs).
* staged: the fleet tables are derived once and stored as parquet (entries
  partitioned by year/month), as a deployment holds them, and the same query
  bodies run against the stored tables.

Every query is executed in full with a ``noop`` sink (no rows are collected
to the driver). Prints ONE JSON line; progress goes to stderr.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from fleetbook.plans.catalog import query_bodies  # noqa: E402
from fleetbook.session import build_session, checkpoint_dir  # noqa: E402
from fleetbook.sources.fixtures import TestdataTables  # noqa: E402
from fleetbook.sources.tables import StagedTables, stage_fleet_tables  # noqa: E402


def run_all(bodies, tables, label, errors):
    times = {}
    for name in sorted(bodies):
        t0 = time.perf_counter()
        try:
            bodies[name](tables).write.format("noop").mode("overwrite").save()
        except Exception as ex:  # keep going; the failure is reported in the JSON line
            errors[f"{label}:{name}"] = str(ex).splitlines()[0][:300]
            print(f"[{label}] {name}: FAILED {errors[f'{label}:{name}']}", file=sys.stderr, flush=True)
            continue
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"[{label}] {name}: {times[name]:.2f}s", file=sys.stderr, flush=True)
    return times


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    mode = os.environ.get("BENCH_MODE", "staged")
    extra = {"spark.driver.memory": "16g", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32m"}
    if os.environ.get("BENCH_EVENTLOG"):  # stage / task times for later reading, in a scratch folder
        extra.update({"spark.eventLog.enabled": "true", "spark.eventLog.dir": os.environ["BENCH_EVENTLOG"]})
    spark = build_session(
        master=f"local[{cpus}]", shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE", max(8, 2 * cpus))),
        extra=extra)
    # the cluster's shared checkpoint folder when configured; a scratch folder otherwise
    checkpoint_dir(spark)
    bodies = query_bodies()
    derived = TestdataTables(spark, sf_dir)

    # warm-up (JVM, codegen caches): one small query, not timed
    bodies["car_labels"](derived).write.format("noop").mode("overwrite").save()

    sf_name = Path(sf_dir).name.replace("sf", "")
    try:
        sf = float(sf_name)
    except ValueError:
        sf = sf_name
    errors: dict[str, str] = {}
    out = {"metric": "total_query_seconds", "unit": "sec", "sf": sf,
           "cpus": cpus, "mode": mode, "n_queries": len(bodies)}
    if mode in ("derived", "both"):
        times = run_all(bodies, derived, "derived", errors)
        out["derived_total"] = round(sum(times.values()), 3)
        out["derived_queries"] = times
    if mode in ("staged", "both"):
        t0 = time.perf_counter()
        path = stage_fleet_tables(derived)
        out["stage_seconds"] = round(time.perf_counter() - t0, 3)
        times = run_all(bodies, StagedTables(spark, sf_dir, path), "staged", errors)
        out["staged_total"] = round(sum(times.values()), 3)
        out["queries"] = times
    else:
        out["queries"] = out["derived_queries"]
    out["value"] = out.get("staged_total", out.get("derived_total"))
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
