"""Runs a query and its SQL side by side; used by the tests and by hand.

python -m tests.oracle [sf] [name ...]
"""

import datetime
import decimal
import math
import sys
import time

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def plain(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int,)):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        f = float(v)
        return "nan" if math.isnan(f) else repr(f)
    if isinstance(v, datetime.datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, folder, name, job, sql):
    df = job(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want = rows_of(columns, cur.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns differ: {sorted(df.columns)} / {sorted(columns)}"
    if got == want:
        return None
    a, b = [r for r in got if r not in set(want)], [r for r in want if r not in set(got)]
    return f"rows {len(got)} / {len(want)}; only ours {len(a)}: {a[:2]}; only sql {len(b)}: {b[:2]}"


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from glimmerline.session import build_session
    import __spark_entry__ as entry

    folder = f"/root/testdata/{sys.argv[1]}"
    spark = build_session("oracle", master="local[8]", **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("OFF")
    con = connect(folder)
    names = sys.argv[2:] or list(entry.queries())
    sqls = entry.oracle_sql()
    for name in names:
        t = time.time()
        try:
            if name in sqls:
                bad = compare(spark, con, folder, name, entry.queries()[name], sqls[name])
                n = ""
            else:
                df = entry.queries()[name](spark, folder)
                bad, n = None, f"rows={df.count()} (no sql)"
            print("OK " if not bad else "BAD", name, n, round(time.time() - t, 1), (bad or "")[:900], flush=True)
        except Exception as e:  # noqa: BLE001
            print("ERR", name, round(time.time() - t, 1), type(e).__name__, str(e)[:700].replace("\n", " "), flush=True)
