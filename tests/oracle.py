"""Run registered queries beside their DuckDB twins and compare the rows."""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.5f}".replace("-0.00000", "0.00000")
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(str, map(_cell, v))) + "]"
    return type(v).__name__ + ":" + str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql, sf_dir):
    """None when equal, else a description of the first difference."""
    df = fn(spark, sf_dir)
    mine = [tuple(r) for r in df.collect()]
    if sql is None:
        return (None if mine else "no rows"), len(mine)
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    theirs = rel.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}", len(mine)
    a, b = rows_of(df.columns, mine), rows_of(names, theirs)
    if a == b:
        return None, len(a)
    only_a = sorted(set(a) - set(b))[:3]
    only_b = sorted(set(b) - set(a))[:3]
    return f"rows {len(a)} vs {len(b)}\n  spark only {only_a}\n  sql only   {only_b}"[:1800], len(a)


def main(argv):
    from gumshoe.session import get_spark
    import __spark_entry__ as entry

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = get_spark("oracle", "local[8]")
    con = connect(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    wanted = [q for q in queries if not argv or any(q == a or (a.endswith("*") and q.startswith(a[:-1])) for a in argv)]
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            problem, n = compare(spark, con, queries[name], sqls.get(name), sf_dir)
        except Exception as exc:  # report and go on with the next query
            problem, n = (str(exc)[:1500] if os.environ.get("SHORT", "1") == "1" else traceback.format_exc()), 0
        took = time.time() - start
        mark = "ok " if problem is None else "BAD"
        bad += problem is not None
        note = "" if name in sqls else "(rows only)"
        print(f"{mark} {name:32s} {n:8d} rows {took:6.2f}s {note}{'' if problem is None else chr(10) + str(problem)}", flush=True)
    print(f"{len(wanted)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
