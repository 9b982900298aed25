"""Run each registered query and its DuckDB oracle on the same parquet tables and compare
row count, column names and an order-insensitive multiset of rows (doubles rounded to 6 places).

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, int):
        return v
    return str(v)


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i].lower())
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return [columns[i].lower() for i in order], sorted(out, key=repr)


def compare(spark, sf_dir: str, name: str, fn, sql: str, con=None) -> dict:
    con = con or duck(sf_dir)
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols, s_rows = rows_of(sdf.columns, [tuple(r) for r in sdf.collect()])
    t1 = time.time()
    res = con.execute(sql)
    d_cols_raw = [d[0] for d in res.description]
    d_cols, d_rows = rows_of(d_cols_raw, res.fetchall())
    report = {"name": name, "spark_rows": len(s_rows), "oracle_rows": len(d_rows),
              "columns_match": s_cols == d_cols, "values_match": s_rows == d_rows,
              "spark_sec": round(t1 - t0, 2)}
    if s_cols != d_cols:
        report["spark_cols"], report["oracle_cols"] = s_cols, d_cols
    elif s_rows != d_rows:
        ss, dd = set(s_rows), set(d_rows)
        report["only_spark"] = sorted(ss - dd, key=repr)[:3]
        report["only_oracle"] = sorted(dd - ss, key=repr)[:3]
    report["ok"] = report["columns_match"] and report["values_match"]
    return report


def main(argv: list[str]) -> int:
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    wanted = set(argv[2:])
    import __spark_entry__ as ent
    from cuebook.session import local_session

    spark = local_session(8)
    qs, oracles = ent.queries(), ent.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name, fn in qs.items():
        if wanted and name not in wanted:
            continue
        if name not in oracles:
            t0 = time.time()
            n = fn(spark, sf_dir).count()
            print(f"{name:32s} NO-ORACLE rows={n} {time.time() - t0:.1f}s", flush=True)
            continue
        try:
            rep = compare(spark, sf_dir, name, fn, oracles[name], con)
        except Exception as exc:  # noqa: BLE001
            bad += 1
            print(f"{name:32s} ERROR {type(exc).__name__}: {str(exc)[:300]}", flush=True)
            continue
        bad += 0 if rep["ok"] else 1
        print(f"{name:32s} {'OK ' if rep['ok'] else 'BAD'} {rep}", flush=True)
    print(f"failures: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
