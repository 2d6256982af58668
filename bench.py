"""Benchmark: run the headline queries at one scale factor, print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list; default: every registered query), BENCH_REPEAT
(default 1; best of N).  Each query is timed end to end: plan construction
(including the cohort materialization) plus full execution of its result into the
``noop`` sink (every row computed, none shipped to Python, so the time is
Spark's, not Py4J pickling).  Row counts are taken afterwards, untimed.

Reported beside, not in, the headline sum:

* ``layout_seconds``: deriving the 16 relations from the test tables and storing
  them bucketed (done once, before the queries);
* ``report_set_seconds``: the KPI row plus all nine proofs built together on one
  shared cohort;
* ``duckdb_seconds`` (only with BENCH_DUCKDB=1): DuckDB running the 30 oracle
  statements, which derive the relations anew each time, and
  ``duckdb_stored_seconds``: the same statements on relations that DuckDB has
  stored before, as Spark's were, with ``duckdb_layout_seconds`` for storing them.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from blotter.operators.reports import report_set  # noqa: E402
from blotter.params import Params  # noqa: E402
from blotter.plans.oracle import FIXTURES, oracle_queries  # noqa: E402
from blotter.plans.registry import QUERIES, catalog_for  # noqa: E402
from blotter.plans.session import build_session  # noqa: E402
from blotter.sources.schemas import RELATIONS  # noqa: E402


def duckdb_times(sf_dir: str, cpus: int) -> dict[str, float]:
    """DuckDB on the oracle statements: deriving the relations each time, and on stored ones."""
    import duckdb
    con = duckdb.connect(config={"threads": cpus})
    for table in ("orders", "lineitem", "part", "customer"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    statements = oracle_queries()

    def timed(sqls) -> float:
        t0 = time.perf_counter()
        for sql in sqls:
            con.execute(sql).fetchall()
        return round(time.perf_counter() - t0, 3)

    out = {"duckdb_seconds": timed(statements.values())}
    out["duckdb_layout_seconds"] = timed(
        f"CREATE TABLE stored.{name} AS WITH {FIXTURES} SELECT * FROM {name}" if name != "stored" else "CREATE SCHEMA stored"
        for name in ("stored", *RELATIONS))
    con.execute("SET search_path = 'stored,main'")
    out["duckdb_stored_seconds"] = timed(sql.replace(f"WITH {FIXTURES},", "WITH") for sql in statements.values())
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = max(1, int(os.environ.get("BENCH_REPEAT", "1")))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(QUERIES)
    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus,
                          extra={"spark.driver.memory": "16g"})
    t0 = time.perf_counter()
    catalog_for(spark, sf_dir)
    layout_seconds = round(time.perf_counter() - t0, 3)
    # Warm-up: JVM class loading and the one-off lookup size checks.
    QUERIES["metrics_summary"](spark, sf_dir).collect()

    times: dict[str, float] = {}
    rows: dict[str, int] = {}
    for name in names:
        best = None
        for _ in range(repeat):
            t0 = time.perf_counter()
            df = QUERIES[name](spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
        rows[name] = df.count()
    t0 = time.perf_counter()
    with report_set(catalog_for(spark, sf_dir), Params()) as reports:
        for df in reports.values():
            df.write.format("noop").mode("overwrite").save()
    set_seconds = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "rows": rows,
        "layout_seconds": layout_seconds,
        "report_set_seconds": set_seconds,
        **(duckdb_times(sf_dir, cpus) if os.environ.get("BENCH_DUCKDB") == "1" else {}),
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
