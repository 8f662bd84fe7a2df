"""Run every registered query against its DuckDB oracle (what the driver's check does).

Usage: python tests/check_all.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))
sys.path.insert(0, HERE)

import __spark_entry__ as entry  # noqa: E402
from oracle_util import compare, duck  # noqa: E402
from promptlens.session import build_session  # noqa: E402


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = build_session()
    con = duck(sf)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if name in sqls:
                problems, n = compare(df, con, sqls[name])
            else:
                n, problems = df.count(), ["(no oracle)"]
        except Exception as e:  # noqa: BLE001
            n, problems = -1, [f"ERROR {type(e).__name__}: {str(e)[:800]}"]
        ok = not problems or problems == ["(no oracle)"]
        bad += 0 if ok else 1
        print(f"{'OK ' if ok else 'BAD'} {name:24s} rows={n:<7d} {time.time() - t:6.1f}s {'; '.join(problems)}",
              flush=True)
    print(f"{len(qs)} queries, {len(sqls)} oracles, {bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
