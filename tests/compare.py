"""Run registered queries and their oracle SQL side by side.

``python tests/compare.py <table folder> [query …]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return value


def row_key(row):
    return tuple((v is None, str(type(v).__name__), v if v is not None else 0) for v in row)


def differences(spark_df, con, sql: str) -> str | None:
    """None if both sides agree, else a short description."""
    names = sorted(spark_df.columns)
    got_types = dict(spark_df.dtypes)
    got = [tuple(normal(v) for v in r) for r in spark_df.select(*names).collect()]
    rel = con.execute(sql)
    theirs = [d[0] for d in rel.description]
    if sorted(theirs) != names:
        return f"columns {names} against {sorted(theirs)}"
    order = [theirs.index(n) for n in names]
    want = [tuple(normal(r[i]) for i in order) for r in rel.fetchall()]
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    got.sort(key=row_key)
    want.sort(key=row_key)
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    if bad:
        pairs = zip(names, *bad[0], strict=True)
        told = [(n, got_types[n], g, w) for n, g, w in pairs if g != w][:6]
        return f"{len(bad)} of {len(got)} rows differ: {told}"
    return None


def main() -> None:
    import __spark_entry__ as driver
    from answerframe.session import local_session

    folder, *chosen = sys.argv[1:]
    spark = local_session()
    con = connect(folder)
    sql = driver.oracle_sql()
    for name, fn in driver.queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            if name in sql:
                state = differences(df, con, sql[name]) or "ok"
            else:
                state = f"rows only: {df.count()}"
        except Exception as error:  # noqa: BLE001
            state = f"FAILED {type(error).__name__}: {str(error)[:700]}"
        print(f"{name:32s} {time.time() - start:6.1f}s  {state}", flush=True)


if __name__ == "__main__":
    main()
