"""Run queries and their SQL side by side: ``python -m checks.compare [folder] [name part ...]``."""

from __future__ import annotations

import sys
import time

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def oracle(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, values as text, rows sorted."""
    def text(x) -> str:
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and np.isnan(x)):
            return "null"
        if isinstance(x, (bool, np.bool_)):
            return str(bool(x))
        if isinstance(x, (float, np.floating)):
            return repr(round(float(x), 6) + 0.0)
        if isinstance(x, (int, np.integer)):
            return str(int(x))
        return str(x)

    out = pd.DataFrame({c: [text(v) for v in df[c].astype(object)] for c in sorted(df.columns)})
    return out.sort_values(list(out.columns)).reset_index(drop=True) if len(out.columns) else out


def kinds(df: pd.DataFrame) -> dict[str, str]:
    return {c: {"i": "int", "u": "int", "f": "float", "b": "bool"}.get(df[c].dtype.kind, "text") for c in sorted(df.columns)}


def compare(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> str | None:
    """None if equal, else what differs."""
    if sorted(spark_rows.columns) != sorted(sql_rows.columns):
        return f"columns {sorted(spark_rows.columns)} / {sorted(sql_rows.columns)}"
    if len(spark_rows) != len(sql_rows):
        return f"rows {len(spark_rows)} / {len(sql_rows)}"
    a, b = canonical(spark_rows), canonical(sql_rows)
    if not a.equals(b):
        bad = (a != b).any(axis=1)
        return f"{int(bad.sum())} of {len(a)} rows differ\n{a[bad].head(4)}\n{b[bad].head(4)}"
    if len(a) and kinds(spark_rows) != kinds(sql_rows):
        return f"types {kinds(spark_rows)} / {kinds(sql_rows)}"
    return None


def run(spark: SparkSession, folder: str, names: list[str]) -> dict[str, str]:
    from checks.catalogue import ORACLES, QUERIES

    con = oracle(folder)
    failed = {}
    for name in names:
        start = time.time()
        try:
            got = QUERIES[name](spark, folder).toPandas()
            spark_s = time.time() - start
            if name in ORACLES:
                start = time.time()
                cursor = con.execute(ORACLES[name])
                problem = compare(got, cursor.df())
                sql_s = time.time() - start
            else:
                problem, sql_s = (None if len(got) else "no rows"), 0.0
        except Exception as e:  # report and go on with the others
            problem, spark_s, sql_s = f"{type(e).__name__}: {str(e)[:1500]}", time.time() - start, 0.0
            got = []
        print(f"{'ok  ' if problem is None else 'FAIL'} {name:34s} {len(got):8d} rows  spark {spark_s:6.2f}s  sql {sql_s:6.2f}s",
              flush=True)
        if problem:
            failed[name] = problem
            print("     " + problem.replace("\n", "\n     "), flush=True)
    return failed


def main() -> None:
    from checks.catalogue import QUERIES
    from rankwell.session import build_session

    args = sys.argv[1:]
    folder = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    names = [n for n in QUERIES if not args or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="16g",
                          spark__ui__enabled="false", spark__driver__host="127.0.0.1")
    spark.sparkContext.setLogLevel("ERROR")
    start = time.time()
    failed = run(spark, folder, names)
    print(f"{len(names) - len(failed)} of {len(names)} passed in {time.time() - start:.0f}s")
    for name in failed:
        print("  FAIL", name)


if __name__ == "__main__":
    main()
