"""Run registered queries and print row counts and timings (dev helper)."""
import sys
import time

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])
from civicflow.session import get_spark  # noqa: E402
from civicflow.plans.queries import QUERIES  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
names = sys.argv[2:] or list(QUERIES)
spark = get_spark(master="local[8]", shuffle_partitions=8)
spark.sparkContext.setLogLevel("ERROR")
for n in names:
    t = time.time()
    try:
        df = QUERIES[n](spark, sf)
        rows = df.collect()
        print(f"{n:28s} rows={len(rows):6d} {time.time()-t:6.2f}s cols={df.columns}", flush=True)
    except Exception as e:  # noqa: BLE001
        print(f"{n:28s} ERROR {type(e).__name__}: {str(e)[:600]}", flush=True)
