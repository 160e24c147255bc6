"""Run registered queries against their SQL checks: run_checks.py [sf_dir] [name ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checking import compare, connect  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracle, con = entry.queries(), entry.oracle_sql(), connect(sf_dir)
    bad = 0
    for name in wanted or queries:
        began = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracle:
                result = compare(df, con, oracle[name]) or f"ok ({df.count()} rows)"
            else:
                result = f"rows only ({df.count()} rows)"
        except Exception as error:  # noqa: BLE001
            result = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        bad += not result.startswith(("ok", "rows only"))
        print(f"{name:28s} {time.time() - began:6.1f}s {result}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
