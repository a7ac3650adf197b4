"""Runs a registered query and its SQL on the same files and compares them.

    python tests/oracle_compare.py [name ...]      (folder from $SF_DIR, default sf0.01)
"""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "NULL" if v != v else repr(float(f"{v:.12g}"))
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    if hasattr(v, "isoformat"):
        return str(v)
    try:
        if type(v).__name__ == "Decimal":
            return repr(float(v))
    except Exception:
        pass
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> tuple[int, str]:
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return len(got), f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return len(got), f"rows {len(got)} != {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return len(got), f"cols {got_cols}\n   got  {a}\n   want {b}"
    return len(got), ""


def main(names: list[str]) -> int:
    import __spark_entry__ as entry
    from wardline.session import local_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = local_session("compare", "8"), connect(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    assert set(sqls) <= set(queries), set(sqls) - set(queries)
    bad = 0
    for name in names or list(queries):
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in sqls:
                n, problem = compare(df, con, sqls[name])
            else:
                n, problem = len(df.collect()), ""
        except Exception as exc:  # noqa: BLE001
            n, problem = -1, "".join(traceback.format_exception_only(exc))[:1500]
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += bool(problem)
        state = "BAD" if problem else ("ok " if name in sqls else "rows")
        print(f"{state} {name:38s} {n:7d} rows {time.time() - start:6.2f}s {problem}", flush=True)
    print(f"{bad} bad of {len(names or queries)}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
