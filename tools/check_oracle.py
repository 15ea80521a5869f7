"""Run registered queries in Spark and their oracle SQL in DuckDB; report matches.

usage: python tools/check_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tessera.plans import ORACLES, QUERIES  # noqa: E402
from tessera.plans.compare import duck_digest, duckdb_connect, spark_digest  # noqa: E402
from tessera.session import build_session  # noqa: E402


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")] or list(QUERIES)
    spark = build_session()
    con = duckdb_connect(sf_dir)
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            s = spark_digest(QUERIES[name](spark, sf_dir))
        except Exception as exc:  # noqa: BLE001
            print(f"{name:32s} SPARK ERROR {type(exc).__name__}: {str(exc)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in ORACLES:
            print(f"{name:32s} rows-only  n={s[0]} cols={s[1]} {ts:.1f}s")
            continue
        t1 = time.time()
        try:
            d = duck_digest(con, ORACLES[name])
        except Exception as exc:  # noqa: BLE001
            print(f"{name:32s} DUCKDB ERROR {type(exc).__name__}: {str(exc)[:400]}")
            bad += 1
            continue
        td = time.time() - t1
        ok = s == d
        bad += not ok
        status = "OK " if ok else "MISMATCH"
        print(f"{name:32s} {status} spark n={s[0]} duck n={d[0]} {ts:.1f}s/{td:.1f}s"
              + ("" if ok else f"\n    spark cols={s[1]}\n    duck  cols={d[1]}"))
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
