"""Run every registered query against its DuckDB oracle (what the driver does).

usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

import duckdb  # noqa: E402

from valuelens.plans.listing import TABLES  # noqa: E402


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, sf_dir: str, names=None, verbose=True):
    from valuelens.plans.registry import all_queries

    con = duck(sf_dir)
    results = {}
    for name, q in all_queries().items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            df = q.fn(spark, sf_dir)
            rows = [tuple(r) for r in df.collect()]
            cols = df.columns
        except Exception as e:  # noqa: BLE001
            results[name] = ("spark-error", repr(e)[:300])
            if verbose:
                print(f"{name}: SPARK ERROR {e!r}"[:400], flush=True)
            continue
        dt = time.time() - t0
        if not q.sql:
            results[name] = ("rows-only", len(rows))
            if verbose:
                print(f"{name}: rows-only {len(rows)} rows {dt:.1f}s", flush=True)
            continue
        try:
            cur = con.execute(q.sql)
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            results[name] = ("sql-error", repr(e)[:300])
            if verbose:
                print(f"{name}: SQL ERROR {e!r}"[:400], flush=True)
            continue
        c1, r1 = canon(cols, rows)
        c2, r2 = canon(dcols, drows)
        ok = c1 == c2 and r1 == r2
        results[name] = ("ok" if ok else "MISMATCH", len(rows), len(drows))
        if verbose:
            print(f"{name}: {'ok' if ok else 'MISMATCH'} spark={len(rows)} duck={len(drows)} {dt:.1f}s", flush=True)
            if not ok:
                if c1 != c2:
                    print("   cols spark", c1, "\n   cols duck ", c2)
                else:
                    s1, s2 = set(r1), set(r2)
                    print("   only spark:", sorted(s1 - s2, key=repr)[:3])
                    print("   only duck: ", sorted(s2 - s1, key=repr)[:3])
    return results


if __name__ == "__main__":
    from valuelens.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = set(sys.argv[2:]) or None
    spark = local_session()
    res = compare(spark, sf, names)
    bad = {k: v for k, v in res.items() if v[0] not in ("ok", "rows-only")}
    print(f"{len(res) - len(bad)}/{len(res)} fine; bad: {sorted(bad)}")
