"""Benchmark: run the registered queries on one scale factor, print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list; default: all but those that run streams or write tables of
their own, whose time is that of many small jobs), BENCH_DRIVER_MEMORY (default 16g).
Each query is executed in full with the no-op sink (no driver collection).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from civicflow.session import get_spark  # noqa: E402
from civicflow.plans.queries import QUERIES  # noqa: E402
from civicflow.plans.stored import STORED_QUERIES  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or [n for n in QUERIES if n not in STORED_QUERIES]
    spark = get_spark(app_name="civicflow-bench", master=f"local[{cpus}]", shuffle_partitions=cpus,
                      extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    spark.sparkContext.setLogLevel("ERROR")
    # warm-up: JVM, code generation, the Parquet reader, regex and Python workers
    spark.range(1000).selectExpr("sum(id)").collect()
    (spark.read.parquet(f"{sf_dir}/region.parquet").selectExpr("max(r_name rlike 'a|b')").collect())
    spark.range(16).repartition(cpus).mapInPandas(lambda it: it, "id long").collect()
    times: dict[str, float] = {}
    errors: dict[str, str] = {}
    for name in names:
        t0 = time.time()
        try:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t0, 3)
        except Exception as e:  # noqa: BLE001 - report and continue
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
        print(f"# {name}: {times.get(name, 'ERROR')}", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
