"""Runs a registered query in Spark and its oracle SQL in DuckDB and compares the rows.

    python -m tests.oracle [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import datetime
import math
import time
import traceback
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return v + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    return v


KINDS = {
    "bigint": "int", "int": "int", "tinyint": "int", "smallint": "int", "double": "float", "float": "float",
    "string": "str", "boolean": "bool", "timestamp": "ts", "date": "date",
    "BIGINT": "int", "INTEGER": "int", "TINYINT": "int", "SMALLINT": "int", "HUGEINT": "HUGEINT", "DOUBLE": "float",
    "FLOAT": "float", "VARCHAR": "str", "BOOLEAN": "bool", "TIMESTAMP": "ts", "DATE": "date",
}


def run_oracle(sql: str, sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    rows = cur.fetchall()
    types = dict((r[0], r[1]) for r in con.execute(f"DESCRIBE {sql}").fetchall())
    con.close()
    return names, types, rows


def compare(df, sql: str, sf_dir: str) -> tuple[bool, str]:
    rows = [tuple(r) for r in df.collect()]
    t0 = time.time()
    names, types, expected = run_oracle(sql, sf_dir)
    sql_time = time.time() - t0
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    kinds = {c: KINDS.get(t, t) for c, t in df.dtypes}
    okinds = {c: KINDS.get(t, t) for c, t in types.items()}
    bad = {c: (kinds[c], okinds[c]) for c in kinds if kinds[c] != okinds[c]}
    if bad:
        return False, f"types {bad}"
    order = sorted(df.columns)
    si, oi = [df.columns.index(c) for c in order], [names.index(c) for c in order]
    got = Counter(tuple(cell(r[i]) for i in si) for r in rows)
    want = Counter(tuple(cell(r[i]) for i in oi) for r in expected)
    if got == want:
        return True, f"{len(rows)} rows (sql {sql_time:.1f}s)"
    extra, missing = list((got - want).items())[:3], list((want - got).items())[:3]
    return False, f"rows {len(rows)} vs {len(expected)}\n   {order}\n   spark: {extra}\n   sql:   {missing}"


def main() -> None:
    from panelstat import registry
    from panelstat.session import local_session

    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--show", action="store_true")
    ap.add_argument("--explain", action="store_true")
    ap.add_argument("--family", help="only the queries of one registry module")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark = local_session()
    sf_dir = f"/root/testdata/sf{args.sf}"
    failed = []
    entries = registry.load()
    if args.family:
        from importlib import import_module

        args.names += list(import_module(f"panelstat.registry.{args.family}").QUERIES)
    wanted = [n for n in entries if not args.names or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args.names)]
    for name in wanted:
        fn, sql = entries[name]
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if args.explain:
                df.explain("formatted")
            if args.show:
                df.show(8, truncate=False)
            if sql is None:
                ok, msg = True, f"rows only: {len(df.collect())}"
            else:
                ok, msg = compare(df, sql, sf_dir)
        except Exception as e:  # report and go on
            ok, msg = False, "".join(traceback.format_exception_only(e))[:1500]
        print(f"{'ok  ' if ok else 'FAIL'} {name:40s} {time.time() - start:6.2f}s  {msg}", flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(wanted) - len(failed)}/{len(wanted)} ok", failed)


if __name__ == "__main__":
    main()
