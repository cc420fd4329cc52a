"""Compare registered queries with their SQL on DuckDB: ``python tests/oracle_check.py SF_DIR [name ..]``."""

from __future__ import annotations

import datetime as dt
import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    """Comparable form of one value; numbers keep their kind."""
    if value is None:
        return ("0null", "")
    if isinstance(value, bool):
        return ("bool", value)
    if isinstance(value, int):
        return ("int", value)
    if isinstance(value, float):
        return ("float", "nan" if math.isnan(value) else float(f"{value:.12g}"))
    if isinstance(value, dt.datetime):
        return ("ts", value.isoformat())
    return (type(value).__name__, value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark, con, name: str, sf_dir: str, queries, oracles) -> str | None:
    """None when equal, else what differs."""
    df = queries[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "NestedLoop" in plan or "Cartesian" in plan:
        return "the plan joins without a key"
    mine = rows_of(df.columns, df.collect())
    answer = con.execute(oracles[name])
    columns = [c[0] for c in answer.description]
    theirs = rows_of(columns, answer.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} / {sorted(columns)}"
    if mine == theirs:
        return None
    extra = [row for row in mine if row not in set(theirs)][:2]
    missing = [row for row in theirs if row not in set(mine)][:2]
    return f"rows {len(mine)} / {len(theirs)}; only here {extra}; only there {missing}"


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    sf_dir, names = sys.argv[1], sys.argv[2:]
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in names or queries:
        if name not in oracles:
            print(f"{name:24s} no SQL", flush=True)
            continue
        start = time.time()
        try:
            problem = compare(spark, con, name, sf_dir, queries, oracles)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        print(f"{name:24s} {'ok  ' if problem is None else 'DIFF'} {time.time() - start:6.2f}s {problem or ''}"[:1500], flush=True)


if __name__ == "__main__":
    main()
