"""Compare a registered Spark query with its DuckDB oracle.

Columns are sorted by name, rows are sorted, and values compared exactly
and with a relative float tolerance.
"""

from __future__ import annotations

import math
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, digits):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if math.isinf(v):
            return "inf" if v > 0 else "-inf"
        if digits is None:
            return v
        return float(f"{v:.{digits}g}")
    if hasattr(v, "tolist"):
        return _norm(v.tolist(), digits)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    if hasattr(v, "item"):
        return v.item()
    return v


def _rows(cols, records, digits):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i], digits) for i in order) for r in records]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def compare(spark, con, name, fn, sql, sf_dir, digits=9):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    scols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = {"name": name, "spark_rows": len(srows), "sec": round(t1 - t0, 2)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    d = con.sql(sql)
    dcols = d.columns
    drows = d.fetchall()
    res["duck_rows"] = len(drows)
    if sorted(scols) != sorted(dcols):
        res["status"] = f"COLUMNS {sorted(scols)} vs {sorted(dcols)}"
        return res
    exact = _rows(scols, srows, None) == _rows(dcols, drows, None)
    close = _rows(scols, srows, digits) == _rows(dcols, drows, digits)
    res["exact"] = exact
    res["status"] = "ok" if close else "MISMATCH"
    if not close:
        a, b = _rows(scols, srows, digits), _rows(dcols, drows, digits)
        diffs = [(x, y) for x, y in zip(a, b) if x != y]
        res["first_diff"] = diffs[:2]
    return res


def main(argv):
    sys.path.insert(0, "/root/repo")
    import importlib

    entry = importlib.import_module("__spark_entry__")
    from cardinal.session import get_session

    sf_dir = "/root/testdata/sf0.01"
    names = argv[1:]
    spark = get_session()
    con = duck(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        try:
            r = compare(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            r = {"name": name, "status": f"ERROR {type(e).__name__}: {str(e)[:300]}"}
        if r["status"] not in ("ok", "rows-only"):
            bad += 1
        print(r, flush=True)
    print("BAD", bad)


if __name__ == "__main__":
    main(sys.argv)
