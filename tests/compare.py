"""Run registered queries beside their SQL twins and report differences.

    python tests/compare.py [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, int):
        return float(v)
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else round(v, 9) + 0.0
    return str(v)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    data = [tuple(_plain(r[i]) for i in order) for r in rows]
    return names, sorted(data, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def compare(df, con, sql):
    """None when equal, else a description."""
    a_names, a = canonical(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    b_names, b = canonical([d[0] for d in cur.description], cur.fetchall())
    if a_names != b_names:
        return f"columns {a_names} vs {b_names}"
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}: {a[:2]} vs {b[:2]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, first {bad[0][0]} vs {bad[0][1]}"
    return None if a else "no rows on either side"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from casemill.session import build_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    wanted = sys.argv[1:]
    queries, sqls = entry.queries(), entry.oracle_sql()
    failed = []
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t0 = time.perf_counter()
        try:
            if name in sqls:
                problem = compare(fn(spark, folder), con, sqls[name])
            else:
                rows = fn(spark, folder).collect()
                problem = None if rows else "no rows"
                print("      rows only:", len(rows), str(rows[:1])[:160])
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        took = time.perf_counter() - t0
        print(f"{'ok  ' if problem is None else 'FAIL'} {took:6.2f}s {name}" + (f"  {problem}" if problem else ""))
        if problem:
            failed.append(name)
    print("failed:", failed)
