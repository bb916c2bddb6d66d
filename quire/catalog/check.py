"""Run queries against their SQL formulation: ``python -m quire.catalog.check <sf_dir> [name ...]``."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def session(cpus: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def canonical(rows: pd.DataFrame) -> list[tuple]:
    columns = sorted(rows.columns)

    def plain(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v) or v is pd.NaT:
            return None
        if hasattr(v, "item"):
            v = v.item()
        return round(v, 6) if isinstance(v, float) else v

    return sorted((tuple(plain(v) for v in r) for r in rows[columns].itertuples(index=False, name=None)), key=repr)


def compare(spark: SparkSession, con, fn, sql: str, sf_dir: str) -> str:
    """'' when both sides agree, else what differs."""
    ours = fn(spark, sf_dir).toPandas()
    theirs = con.execute(sql).df()
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} != {sorted(theirs.columns)}"
    a, b = canonical(ours), canonical(theirs)
    if a == b:
        return ""
    extra, lacking = [r for r in a if r not in b][:2], [r for r in b if r not in a][:2]
    return f"rows {len(a)} vs {len(b)}; only ours {str(extra)[:700]}; only SQL {str(lacking)[:700]}"


def main(sf_dir: str, names: list[str]) -> int:
    from quire.catalog import all_queries, all_sql

    spark, con = session(), database(sf_dir)
    queries, sql, failed = all_queries(), all_sql(), 0
    for name, fn in queries.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            if name in sql:
                problem = compare(spark, con, fn, sql[name], sf_dir)
            else:
                problem = "" if fn(spark, sf_dir).count() >= 0 else "no rows"
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s{' (rows only)' if name not in sql else ''} {problem}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1], sys.argv[2:]), 1))
