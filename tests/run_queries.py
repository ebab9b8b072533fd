"""Check all (or the named) queries at a scale: python tests/run_queries.py [sf] [name ...]"""

import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

import __spark_entry__ as entry  # noqa: E402
from mendframe.plans.registry import QUERIES  # noqa: E402
from oracle import compare, connect  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

if __name__ == "__main__":
    scale = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    names = sys.argv[2:] or sorted(entry.queries())
    sf = f"/root/testdata/sf{scale}"
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf), 0
    for name in names:
        t = time.time()
        try:
            rows, problem = compare(spark, con, QUERIES[name], sf)
        except Exception as e:  # report and go on
            rows, problem = -1, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += problem is not None
        twin = "sql" if QUERIES[name].sql else "rows"
        print(f"{'FAIL' if problem else 'ok':4} {twin:4} {time.time() - t:6.2f}s {rows:8d} {name} {problem or ''}", flush=True)
    print("failed:", bad, "of", len(names))
