"""Runs a registered query and its SQL and compares rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(row[i]) for i in order) for row in rows)


def kind(name):
    name = str(name).lower()
    for family, parts in {"int": ("int", "long"), "float": ("double", "float"), "string": ("string", "varchar"),
                          "bool": ("bool",), "time": ("timestamp",)}.items():
        if any(p in name for p in parts):
            return family if "[" not in name and "array" not in name else f"array {family}"
    return name


def compare(spark, sf_dir, build, sql, con=None):
    """(ok, message, seconds, number of rows)."""
    started = time.time()
    frame = build(spark, sf_dir)
    got = [tuple(r) for r in frame.collect()]
    seconds = time.time() - started
    if sql is None:
        return True, "rows only", seconds, len(got)
    con = con or connect(sf_dir)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    kinds = {d[0]: kind(d[1]) for d in cursor.description}
    want = cursor.fetchall()
    if sorted(frame.columns) != sorted(names):
        return False, f"columns {sorted(frame.columns)} != {sorted(names)}", seconds, len(got)
    wrong = {n: (kind(t), kinds[n]) for n, t in frame.dtypes if kind(t) != kinds[n]}
    if wrong:
        return False, f"types {wrong}", seconds, len(got)
    left, right = rows_of(frame.columns, got), rows_of(names, want)
    if left == right:
        return True, "equal", seconds, len(got)
    extra = [r for r in left if r not in set(right)][:2]
    absent = [r for r in right if r not in set(left)][:2]
    return False, f"rows {len(left)} vs {len(right)}\n  spark {str(extra)[:900]}\n  sql   {str(absent)[:900]}", seconds, len(got)


def main():
    sys.path.insert(0, str(__import__("pathlib").Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from tests.conftest import make_session

    spark = make_session()
    sf_dir = sys.argv[1]
    chosen = sys.argv[2:] or list(entry.queries())
    queries, sql, con, bad = entry.queries(), entry.oracle_sql(), connect(sf_dir), []
    for name in chosen:
        try:
            ok, message, seconds, count = compare(spark, sf_dir, queries[name], sql.get(name), con)
        except Exception as failure:
            ok, message, seconds, count = False, f"{type(failure).__name__}: {str(failure)[:1500]}", 0, 0
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {seconds:6.2f}s {count:7d} {message}", flush=True)
        if not ok:
            bad.append(name)
    print(len(chosen) - len(bad), "of", len(chosen), "ok", bad)


if __name__ == "__main__":
    main()
