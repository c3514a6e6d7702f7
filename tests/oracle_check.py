"""Compare a registered Spark query with its DuckDB oracle on the same tables.

Usable from pytest and as a script:
    python tests/oracle_check.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, dt.datetime):
        if v.tzinfo is not None:
            v = v.astimezone(dt.timezone.utc).replace(tzinfo=None)
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, dict):
        return tuple(sorted((str(k), _norm(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    out.sort(key=lambda t: tuple((x is None, repr(x)) for x in t))
    return [cols[i] for i in order], out


_SPARK_TO_DUCK = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE", "float": "FLOAT",
    "smallint": "SMALLINT", "tinyint": "TINYINT",
}


def _spark_type(dt_) -> str:
    s = dt_.simpleString()
    if s.startswith("array<"):
        return "LIST"
    if s.startswith("struct<"):
        return "STRUCT"
    if s.startswith("map<"):
        return "MAP"
    return _SPARK_TO_DUCK.get(s, s.upper())


def _duck_type(t) -> str:
    s = str(t)
    if s.endswith("[]"):
        return "LIST"
    if s.startswith("STRUCT"):
        return "STRUCT"
    if s.startswith("MAP"):
        return "MAP"
    return s


def _close(a, b) -> bool:
    if a == b:
        return True
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    if isinstance(a, tuple) and isinstance(b, tuple) and len(a) == len(b):
        return all(_close(x, y) for x, y in zip(a, b))
    return False


def compare(spark, name: str, sf_dir: str, con=None, show: int = 3) -> dict:
    import __spark_entry__ as E
    con = con or duck(sf_dir)
    t0 = time.time()
    sdf = E.queries()[name](spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    sql = E.oracle_sql().get(name)
    res = {"name": name, "spark_rows": len(srows), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        res["status"] = "no-oracle"
        return res
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    res["oracle_rows"] = len(drows)
    stypes = {f.name: _spark_type(f.dataType) for f in sdf.schema.fields}
    dtypes = {d[0]: _duck_type(d[1]) for d in cur.description}
    bad_types = {c: (stypes.get(c), dtypes.get(c)) for c in stypes if stypes.get(c) != dtypes.get(c)}
    if bad_types:
        res["types"] = bad_types
    scols, sn = _rows(sdf.columns, srows)
    dcols_s, dn = _rows(dcols, drows)
    if scols != dcols_s:
        res["status"] = "columns"
        res["detail"] = {"spark": scols, "oracle": dcols_s}
        return res
    if len(sn) != len(dn):
        res["status"] = "rowcount"
        return res
    if sn == dn:
        res["status"] = "exact" if not bad_types else "TYPES"
        return res
    diffs = [(a, b) for a, b in zip(sn, dn) if a != b]
    res["status"] = "close" if all(_close(a, b) for a, b in diffs) else "MISMATCH"
    res["n_diff"] = len(diffs)
    res["cols"] = scols
    res["examples"] = diffs[:show]
    return res


def main(argv):
    from promolift.session import build_session
    import __spark_entry__ as E
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:] or sorted(E.queries())
    spark = build_session("local[8]")
    con = duck(sf_dir)
    bad = 0
    for n in names:
        try:
            r = compare(spark, n, sf_dir, con)
        except Exception as exc:  # report and continue
            r = {"name": n, "status": "ERROR", "error": repr(exc)[:600]}
        if r["status"] not in ("exact", "no-oracle"):
            bad += 1
        print(r, flush=True)
    print(f"done: {len(names)} queries, {bad} not exact")


if __name__ == "__main__":
    main(sys.argv)
