"""Compare every query with its SQL twin: python tools/check.py [sf] [section or query prefix ...]"""

from __future__ import annotations

import math
import sys
import time
from importlib import import_module
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from studyspark.plans.catalog import SECTIONS  # noqa: E402
from studyspark.schemas import TABLES  # noqa: E402
from studyspark.session import local_session  # noqa: E402


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) and type(a) is type(b)
    return a == b and type(a) is type(b)


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    spark = local_session("check")
    bad = 0
    for section in SECTIONS:
        try:
            catalog = import_module(f"studyspark.plans.{section}").catalog
        except ModuleNotFoundError:
            continue
        for name, query in catalog.queries.items():
            if wanted and not any(section == w or name.startswith(w) for w in wanted):
                continue
            try:
                t = time.time()
                df = query(spark, folder)
                cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
                spent = time.time() - t
            except Exception as e:
                bad += 1
                print(f"ERROR {name}: {str(e)[:600]}", flush=True)
                continue
            if name not in catalog.sql:
                print(f"rows  {name}: {len(got)} rows {spent:.2f}s", flush=True)
                continue
            try:
                t = time.time()
                cur = con.execute(catalog.sql[name])
                want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
                duck = time.time() - t
            except Exception as e:
                bad += 1
                print(f"SQLERR {name}: {str(e)[:600]}", flush=True)
                continue
            ok = cols == want_cols and len(got) == len(want) and all(
                all(same(x, y) for x, y in zip(g, w)) for g, w in zip(got, want)
            )
            print(f"{'ok   ' if ok else 'DIFF '} {name}: {len(got)} vs {len(want)} rows {spent:.2f}s duck {duck:.2f}s", flush=True)
            if not ok:
                bad += 1
                print("   ", cols, want_cols)
                gs, ws = set(map(repr, got)), set(map(repr, want))
                for g in sorted(gs - ws)[:4]:
                    print("    spark", g[:400])
                for w in sorted(ws - gs)[:4]:
                    print("    sql  ", w[:400])
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
