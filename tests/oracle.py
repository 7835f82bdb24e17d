"""Compare registered queries with their DuckDB SQL: ``python -m tests.oracle [SF] [NAME...]``."""

from __future__ import annotations

import math
import os
import sys
import time

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session(cpus: int = 8):
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.sql.warehouse.dir", "/tmp/maskwell-warehouse").getOrCreate()
    )


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(x):
    """A value in a form that both engines share; rows of floats compare after rounding to 9 digits."""
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if hasattr(x, "asDict"):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in x.items())
    if hasattr(x, "tzinfo") and x.tzinfo is not None:
        return x.replace(tzinfo=None)
    return x


def difference(spark, name: str, sf_dir: str, queries: dict, sql: dict) -> str:
    """Empty if rows and column names agree."""
    df = queries[name](spark, sf_dir)
    cols = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = duck(sf_dir).sql(sql[name])
    if sorted(rel.columns) != cols:
        return f"columns {cols} and {sorted(rel.columns)}"
    at = [rel.columns.index(c) for c in cols]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    if len(ours) != len(theirs):
        return f"{len(ours)} rows, oracle {len(theirs)}"
    return next((f"{cols}: {a} is not {b}" for a, b in zip(ours, theirs) if a != b), "")


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    import __spark_entry__ as entry

    queries, sql, spark = entry.queries(), entry.oracle_sql(), session()
    for name in sys.argv[2:] or sorted(queries):
        began = time.time()
        try:
            if name in sql:
                said = difference(spark, name, f"/root/testdata/sf{sf}", queries, sql)
                print("DIFF" if said else "ok", name, said[:600], f"{time.time() - began:.1f}s", flush=True)
            else:
                print("rows", name, len(queries[name](spark, f"/root/testdata/sf{sf}").collect()), f"{time.time() - began:.1f}s", flush=True)
        except Exception as error:  # noqa: BLE001  a report of all queries goes on after a failure
            print("ERROR", name, str(error)[:700].replace("\n", " | "), flush=True)


if __name__ == "__main__":
    main()
