"""Compare queries with their SQL equivalent on DuckDB.

``python -m tests.oracle [sf dir] [name ...]`` runs them and prints one line each.
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

import __spark_entry__ as entry

DEFAULT_DIR = "/root/testdata/sf0.01"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, bool) or value is None:
        return str(value)
    return str(value)


def canonical(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def spark_result(spark, name: str, sf_dir: str):
    df = entry.queries()[name](spark, sf_dir)
    return canonical(df.columns, df.collect())


def sql_result(con, name: str):
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    return canonical(columns, cursor.fetchall())


def difference(got, want) -> str | None:
    if got[0] != want[0]:
        return f"columns {got[0]} instead of {want[0]}"
    if got[1] == want[1]:
        return None
    extra = [r for r in got[1] if r not in set(want[1])][:2]
    lacking = [r for r in want[1] if r not in set(got[1])][:2]
    return f"{len(got[1])} rows instead of {len(want[1])}; extra {extra}; lacking {lacking}"


def main() -> None:
    from lodestone.session import build_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and os.path.isdir(args[0]) else DEFAULT_DIR
    spark = build_session(
        "oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                 "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    for name in entry.queries():
        if args and name not in args:
            continue
        start = time.time()
        try:
            got = spark_result(spark, name, sf_dir)
            spent = time.time() - start
            if name in entry.oracle_sql():
                start = time.time()
                problem = difference(got, sql_result(con, name))
                verdict = "ok" if problem is None else f"DIFFERS: {problem[:600]}"
                verdict += f" (sql {time.time() - start:.1f}s)"
            else:
                verdict = "rows only"
        except Exception as error:
            got, spent, verdict = ((), ()), time.time() - start, f"FAILED: {str(error)[:700]}"
        print(f"{name}: {len(got[1])} rows, {spent:.1f}s, {verdict}", flush=True)


if __name__ == "__main__":
    main()
