"""Compare every registered query with its check SQL at one scale.

Usage: python tools/check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sightline.plans import all_checks, all_queries  # noqa: E402
from sightline.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def canonical(frame):
    frame = frame[sorted(frame.columns)]
    rows = []
    for row in frame.itertuples(index=False):
        rows.append(tuple("" if v is None or v is pd.NA or v != v else repr(float(v)) if isinstance(v, float) else str(v) for v in row))
    return sorted(rows)


def main() -> int:
    args = sys.argv[1:]
    sf = args[0] if args else "/root/testdata/sf0.01"
    spark = build_session(
        "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    checks, bad = all_checks(), 0
    for name, fn in all_queries().items():
        if len(args) > 1 and name not in args[1:]:
            continue
        began = time.time()
        try:
            got = fn(spark, sf).toPandas()
            took = time.time() - began
            if name not in checks:
                print(f"rows {name} {len(got)} {took:.2f}s", flush=True)
                continue
            want = db.execute(checks[name]).df()
            types = {c: (str(got[c].dtype), str(want[c].dtype)) for c in got if c in want and got[c].dtype != want[c].dtype}
            a, b = canonical(got), canonical(want) if sorted(got.columns) == sorted(want.columns) else None
            good = a == b
            bad += not good
            print(f"{'ok  ' if good else 'FAIL'} {name} {len(got)} {len(want)} {took:.2f}s {types or ''}", flush=True)
            if not good:
                print("   columns", sorted(got.columns), sorted(want.columns))
                if b is not None:
                    print("   only spark", sorted(set(a) - set(b))[:3])
                    print("   only check", sorted(set(b) - set(a))[:3])
        except Exception as error:
            bad += 1
            print(f"FAIL {name} {type(error).__name__}: {str(error)[:600]}", flush=True)
    print("failures:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
