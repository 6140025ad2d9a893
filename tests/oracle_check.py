"""Run registered queries against their DuckDB oracle (like the driver).

usage: python tests/oracle_check.py [sf_dir] [name ...]
Prints one line per query: rows, schema and value-hash agreement.
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402


from casework.session import get_spark  # noqa: E402
from casework.sources.tables import TABLES  # noqa: E402


def _norm(v, digits):
    import pandas as pd
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, digits) if digits is not None else v
    if hasattr(v, "item"):
        return _norm(v.item(), digits)
    return v


def _rows(pdf, digits):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(x, digits) for x in rec))
    return cols, sorted(out, key=repr)


def _hash(rows):
    h = hashlib.sha256()
    for r in rows:
        h.update(repr(r).encode())
    return h.hexdigest()[:12]


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def check(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sp = fn(spark, sf_dir).toPandas()
    t1 = time.time()
    if sql is None:
        return dict(name=name, rows=len(sp), oracle=None, sec=round(t1 - t0, 2))
    dk = con.execute(sql).df()
    # whole numbers with nulls: pandas holds Spark's as floats
    dk = dk.astype({c: float for c, t in dk.dtypes.items() if str(t) in ("Int64", "Int32")})
    res = dict(name=name, rows=len(sp), oracle_rows=len(dk), sec=round(t1 - t0, 2))
    cs, rs = _rows(sp, None)
    cd, rd = _rows(dk, None)
    res["schema"] = cs == cd
    if cs != cd:
        res["cols"] = (cs, cd)
    res["exact"] = _hash(rs) == _hash(rd)
    if not res["exact"]:
        _, rs6 = _rows(sp, 6)
        _, rd6 = _rows(dk, 6)
        res["approx6"] = rs6 == rd6
        if not res["approx6"]:
            a, b = set(rs6), set(rd6)
            res["only_spark"] = list(a - b)[:3]
            res["only_oracle"] = list(b - a)[:3]
    return res


def main():
    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf_dir, args = args[0], args[1:]
    import __spark_entry__ as E
    spark = get_spark("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    qs, orc = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if args and name not in args:
            continue
        try:
            r = check(spark, con, name, fn, orc.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            r = dict(name=name, error=repr(e)[:400])
        ok = r.get("oracle") is None and "error" not in r and "schema" not in r or (
            r.get("schema") and r.get("exact") and r.get("rows") == r.get("oracle_rows"))
        bad += 0 if ok else 1
        print(("OK  " if ok else "BAD ") + str(r), flush=True)
    print(f"done, {bad} bad")


if __name__ == "__main__":
    main()
