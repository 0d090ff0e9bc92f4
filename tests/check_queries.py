"""Compare queries with their SQL by hand: python tests/check_queries.py [sf dir] [name ...]."""

import sys
import time

sys.path.insert(0, __file__.rsplit("/", 2)[0])
sys.path.insert(0, __file__.rsplit("/", 1)[0])

import oracle  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from holdfast.session import get_session  # noqa: E402

if __name__ == "__main__":
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session(master="local[8]", cores=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle.connect(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            if name in sqls:
                problems = oracle.compare(spark, con, queries[name], sqls[name], sf_dir)
            else:
                rows = queries[name](spark, sf_dir).count()
                problems = [] if rows else ["no rows"]
        except Exception as error:  # noqa: BLE001
            problems = [f"{type(error).__name__}: {str(error)[:1500]}"]
        bad += bool(problems)
        print("ok  " if not problems else "FAIL", name, f"{time.time() - start:.2f}s", *problems, sep=" ", flush=True)
    print("failed:", bad)
