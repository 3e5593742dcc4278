"""Run every registered job against its DuckDB oracle: python tests/run_oracles.py [sf_dir] [names...]"""

import json
import sys
import time

sys.path.insert(0, "/root/repo")
sys.path.insert(0, "/root/repo/tests")

import __spark_entry__ as E  # noqa: E402
from harness import compare, duck  # noqa: E402

from cohortflow.session import get_spark  # noqa: E402

sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
names = sys.argv[2:] or list(E.queries())
spark = get_spark()
con = duck(sf_dir)
ok = 0
for name in names:
    fn = E.queries()[name]
    sql = E.oracle_sql().get(name)
    t0 = time.time()
    try:
        df = fn(spark, sf_dir)
        if sql is None:
            n = df.count()
            print(json.dumps({"q": name, "rows_only": n, "sec": round(time.time() - t0, 2)}))
            ok += 1
            continue
        r = compare(df, con, sql)
    except Exception as e:  # noqa: BLE001
        print(json.dumps({"q": name, "error": str(e)[:1500]}))
        continue
    r["q"] = name
    r["sec"] = round(time.time() - t0, 2)
    ok += bool(r["values_match"])
    print(json.dumps(r, default=str)[:2000])
print(f"{ok}/{len(names)} ok")
