"""Run queries against their SQL in DuckDB: ``python tests/check_oracles.py [prefix ...]``."""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def oracle_connection(folder):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def _plain(v):
    import datetime
    import decimal

    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime) and v.time() == datetime.time():
        return v.date()
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(_plain(x) for x in v.values())
    return v


def _key(row):
    out = []
    for v in row:
        out.append((v is None, f"{v:.9g}" if isinstance(v, float) else str(v)))
    return out


def compare(df, con, sql):
    """None when equal, else a short text."""
    names = sorted(df.columns)
    got = [tuple(_plain(r[c]) for c in names) for r in df.collect()]
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    if sorted(cols) != names:
        return f"columns {names} != {sorted(cols)}"
    at = [cols.index(c) for c in names]
    want = [tuple(_plain(r[i]) for i in at) for r in cur.fetchall()]
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    got.sort(key=_key)
    want.sort(key=_key)
    bad, inexact = 0, 0
    first = ""
    for g, w in zip(got, want):
        for c, a, b in zip(names, g, w):
            if a == b:
                if type(a) is not type(b) and not first:
                    first = f"(type of {c}: {type(a).__name__} {type(b).__name__})"
                    inexact += 1
                continue
            if isinstance(a, (int, float)) and isinstance(b, (int, float)) and math.isclose(
                a, b, rel_tol=1e-9, abs_tol=1e-9
            ):
                inexact += 1
                first = first or f"(inexact {c}: {a!r} {b!r})"
                continue
            bad += 1
            if bad == 1:
                first = f"{c}: {a!r} != {b!r} in {g} / {w}"
    if bad:
        return f"{bad} cells differ, {first}"
    return f"~ {inexact} {first}" if inexact else None


def main(prefixes):
    import __spark_entry__ as entry
    from salestide.session import local_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(folder)
    oracles = entry.oracle_sql()
    failed = 0
    for name, fn in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            if name in oracles:
                df = spark.createDataFrame(df.toArrow()) if os.environ.get("SPLIT") else df
                spent = time.time() - start
                result = compare(df, con, oracles[name])
            else:
                result = f"~ rows only: {len(df.collect())}"
        except Exception as e:  # noqa: BLE001 - report and go on
            result = f"{type(e).__name__} {str(e)[:600]}"
        if os.environ.get("SPLIT"):
            print(f"   spark only {spent:.2f}s")
        ok = result is None or result.startswith("~")
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {time.time() - start:6.2f}s {name} {result or ''}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
