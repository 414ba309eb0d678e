"""Run registered queries in Spark and their DuckDB oracles; compare results.

Usage: python tools/oracle_check.py [sf_dir] [name ...]
Compares column names, row counts and the multiset of rows (values
normalised: arrays to tuples, numpy scalars to Python). Prints one line per
query and a summary.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def norm(v, ndigits=None):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, ndigits) if ndigits is not None else v
    if isinstance(v, decimal.Decimal):
        return norm(float(v), ndigits)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x, ndigits) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x, ndigits)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(norm(x, ndigits) for x in v)
    if hasattr(v, "tolist"):
        return norm(v.tolist(), ndigits)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def keyed(rows, cols, ndigits=None):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i], ndigits) for i in order) for r in rows]
    return sorted(out, key=repr)


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def check(spark, sf_dir, names=None, verbose=True):
    from glossa.catalog import oracle_sql, queries

    qs, sqls = queries(), oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in (names or list(qs)):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            cols = df.columns
            rows = [tuple(r) for r in df.collect()]
            ts = time.time() - t0
        except Exception as e:  # noqa: BLE001
            results[name] = ("spark-error", str(e).splitlines()[0][:300])
            if verbose:
                print(f"{name:28s} SPARK ERROR {str(e)[:2000]}", flush=True)
            continue
        if name not in sqls:
            results[name] = ("rows-only", len(rows))
            if verbose:
                print(f"{name:28s} rows-only n={len(rows)} spark={ts:.1f}s", flush=True)
            continue
        t1 = time.time()
        try:
            cur = con.execute(sqls[name])
            dcols = [c[0] for c in cur.description]
            drows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            results[name] = ("sql-error", str(e).splitlines()[0][:300])
            if verbose:
                print(f"{name:28s} SQL ERROR {str(e)[:1500]}", flush=True)
            continue
        td = time.time() - t1
        status = "match"
        detail = ""
        if sorted(cols) != sorted(dcols):
            status, detail = "cols", f"{sorted(cols)} vs {sorted(dcols)}"
        elif len(rows) != len(drows):
            status, detail = "count", f"{len(rows)} vs {len(drows)}"
        else:
            a, b = keyed(rows, cols), keyed(drows, dcols)
            if a != b:
                if keyed(rows, cols, 6) == keyed(drows, dcols, 6):
                    status = "float"
                else:
                    status = "values"
                    diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
                    detail = repr(diff)[:600]
        results[name] = (status, detail)
        if verbose:
            print(f"{name:28s} {status:6s} n={len(rows)} spark={ts:.1f}s duck={td:.1f}s {detail}", flush=True)
    return results


if __name__ == "__main__":
    from glossa.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = build_session("local[8]", 8)
    res = check(spark, sf, names)
    bad = {k: v for k, v in res.items() if v[0] not in ("match", "rows-only")}
    print(f"SUMMARY {len(res) - len(bad)}/{len(res)} ok; bad: {sorted(bad)}")
