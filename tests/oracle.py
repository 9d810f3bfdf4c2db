"""Compare registered queries with their SQL in DuckDB.

``python tests/oracle.py sf_dir [key ...]`` prints one line per query.
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def normal(rows, names) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(repr(row[i]) for i in order) for row in rows))


def compare(spark, con, sf_dir: str, fn, sql: str) -> tuple[bool, str]:
    df = fn(spark, sf_dir)
    at = time.time()
    got_names, got = df.columns, [tuple(r) for r in df.collect()]
    spent = time.time() - at
    cur = con.execute(sql)
    want_names, want = [d[0] for d in cur.description], cur.fetchall()
    if sorted(got_names) != sorted(want_names):
        return False, f"columns {sorted(got_names)} vs {sorted(want_names)}"
    a, b = normal(got, got_names), normal(want, want_names)
    if a == b:
        return True, f"{len(a)} rows, collect {spent:.2f}s"
    extra, missing = [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2]
    return False, f"rows {len(a)} vs {len(b)}\n   spark {str(extra)[:1500]}\n   duck  {str(missing)[:1500]}\n   cols {sorted(got_names)}"


def main() -> None:
    from runsieve.session import local_session
    from __spark_entry__ import oracle_sql, queries

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark, con = local_session(8), duck(sf_dir)
    known, sqls, bad = queries(), oracle_sql(), 0
    for name, fn in known.items():
        if wanted and name not in wanted:
            continue
        at = time.time()
        try:
            if name in sqls:
                ok, text = compare(spark, con, sf_dir, fn, sqls[name])
            else:
                ok, text = True, f"{fn(spark, sf_dir).count()} rows (no sql)"
        except Exception as exc:  # noqa: BLE001
            ok, text = False, f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {time.time() - at:6.2f}s {text}", flush=True)
    print("failures:", bad, "of", len(known))


if __name__ == "__main__":
    main()
