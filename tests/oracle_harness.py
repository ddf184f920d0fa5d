"""Side-by-side check of registered queries against their DuckDB oracle SQL
(row count, column names and order-insensitive values), the same shape of
check the driver runs. Used by the tests and by ``python -m tests.oracle_harness``.
Test tooling only: it pulls small results to the driver to compare them."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys

import duckdb
import numpy as np
import pandas as pd

RAW_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
              "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in RAW_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _canon(v):
    if v is None:
        return None
    if isinstance(v, float) and math.isnan(v):
        return None
    if v is pd.NaT:
        return None
    if isinstance(v, (np.integer,)):
        return int(v)
    if isinstance(v, (np.floating, float)):
        return round(float(v), 6)
    if isinstance(v, np.bool_):
        return bool(v)
    if isinstance(v, decimal.Decimal):
        return str(v.normalize()) if v == v.to_integral_value() else str(v)
    if isinstance(v, (pd.Timestamp, dt.datetime)):
        return pd.Timestamp(v).isoformat()
    if isinstance(v, np.ndarray):
        return tuple(_canon(x) for x in v.tolist())
    if isinstance(v, (list, tuple)):
        return tuple(_canon(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _canon(x)) for k, x in v.items()))
    return v


def frame_rows(pdf: pd.DataFrame) -> tuple[list[str], list[tuple]]:
    cols = sorted(pdf.columns)
    rows = [tuple(_canon(r[c]) for c in cols) for r in pdf.to_dict("records")]
    rows.sort(key=lambda r: tuple((x is None, str(x)) for x in r))
    return cols, rows


def compare(spark, con, name: str, build, sql: str, sf_dir: str) -> dict:
    sdf = build(spark, sf_dir).toPandas()
    odf = con.sql(sql).fetch_arrow_table().to_pandas()
    scols, srows = frame_rows(sdf)
    ocols, orows = frame_rows(odf)
    res = {"name": name, "spark_rows": len(srows), "oracle_rows": len(orows),
           "columns_match": scols == ocols, "values_match": srows == orows}
    if scols != ocols:
        res["spark_cols"], res["oracle_cols"] = scols, ocols
    elif srows != orows:
        s, o = set(srows), set(orows)
        res["only_spark"] = list(s - o)[:3]
        res["only_oracle"] = list(o - s)[:3]
    res["ok"] = res["columns_match"] and res["values_match"]
    return res


def main(argv=None):
    argv = argv or sys.argv[1:]
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    only = set(argv[1:])
    import os
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as E
    from shopframe.session import get_session
    spark = get_session()
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name, build in qs.items():
        if only and name not in only:
            continue
        if name not in sqls:
            n = build(spark, sf_dir).count()
            print(f"[rows-only] {name}: {n} rows")
            continue
        try:
            r = compare(spark, con, name, build, sqls[name], sf_dir)
        except Exception as e:  # noqa: BLE001
            r = {"name": name, "ok": False, "error": repr(e)[:400]}
        bad += not r["ok"]
        print(("OK  " if r["ok"] else "FAIL"), r)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
