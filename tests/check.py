"""Run registered queries against their SQL twins: check.py [sf] [name ...]."""

import os
import sys
import time
import traceback

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

from oracle import compare, connect  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from binloom.session import local_session  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
names = sys.argv[2:]
sf_dir = f"/root/testdata/sf{sf}"
spark = local_session()
con = connect(sf_dir)
queries, oracles = entry.queries(), entry.oracle_sql()
failed = 0
for name, query in queries.items():
    if names and name not in names:
        continue
    begun = time.time()
    try:
        df = query(spark, sf_dir)
        if name in oracles:
            result = compare(df, con, oracles[name]) or "ok"
        else:
            result = f"ok (rows only: {df.count()})"
    except Exception as error:  # report and go on with the next query
        result = f"ERROR {str(error)[:900]}"
        if len(names) == 1:
            traceback.print_exc()
    failed += not result.startswith("ok")
    print(f"{name:32s} {time.time() - begun:6.1f}s {result}", flush=True)
print("failed", failed, "of", len(names) or len(queries))
