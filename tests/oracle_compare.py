"""Run a registered Spark query and its DuckDB SQL side by side and compare.

Usage: python tests/oracle_compare.py [sf_dir] [name ...]
Compares row count, column names, and the multiset of rows (doubles to 1e-9
relative), the way the driver's correctness check does.
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


EXACT = False  # set by --exact: compare doubles bit for bit (only -0.0 == 0.0)


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if EXACT:
            return v + 0.0
        return round(v, 6) if abs(v) < 1e12 else float(f"{v:.12g}")
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


_TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
          "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN", "float": "FLOAT", "smallint": "SMALLINT"}


def _types_match(sdf, cur) -> list:
    duck_types = {d[0]: str(d[1]).upper() for d in cur.description}
    bad = []
    for f in sdf.schema.fields:
        want = _TYPES.get(f.dataType.simpleString(), f.dataType.simpleString().upper())
        got = duck_types.get(f.name)
        if got is not None and got != want and not (want.startswith("ARRAY") or got.endswith("[]")):
            bad.append((f.name, want, got))
    return bad


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, sf_dir: str, name: str, query, sql: str | None, con=None) -> dict:
    t0 = time.time()
    sdf = query(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    t1 = time.time()
    res = {"name": name, "spark_rows": len(srows), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        res["match"] = None
        return res
    con = con or duck(sf_dir)
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    res["duck_rows"] = len(drows)
    res["cols_match"] = sorted(scols) == sorted(dcols)
    tbad = _types_match(sdf, cur)
    if tbad:
        res["type_mismatch"] = tbad
    if not res["cols_match"]:
        res["spark_cols"], res["duck_cols"] = sorted(scols), sorted(dcols)
    a, b = _rows(scols, srows), _rows(dcols, drows)
    res["match"] = res["cols_match"] and a == b and not tbad
    if not res["match"]:
        res["only_spark"] = list((a - b).elements())[:3]
        res["only_duck"] = list((b - a).elements())[:3]
    return res


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as E
    from gridmeter.session import get_spark

    global EXACT
    if "--exact" in argv:
        EXACT = True
        argv = [a for a in argv if a != "--exact"]
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    spark = get_spark("local[8]", **{"spark.sql.shuffle.partitions": "8"})
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for n in names or sorted(qs):
        try:
            r = compare(spark, sf_dir, n, qs[n], sqls.get(n), con)
        except Exception as e:  # report and keep going
            r = {"name": n, "error": repr(e)[:800]}
        ok = r.get("match")
        bad += ok is False or "error" in r
        print(("OK  " if ok else ("--  " if ok is None and "error" not in r else "BAD ")), r, flush=True)
    print("failures:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
