"""Compare registered queries with their SQL counterparts: python tests/oracle_check.py [names] """

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES.split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    for c in df.columns:
        if str(df[c].dtype) in ("object", "str", "string"):
            df[c] = df[c].where(df[c].notna(), None)
        else:
            df[c] = df[c].astype("float64")
    return df.sort_values(list(df.columns), ignore_index=True)


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """What differs between two results, ignoring row and column order; None if nothing does."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = _normal(got.copy()), _normal(want.copy())
    for c in a.columns:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            i = int((~same).idxmax())
            return f"{c}: {int((~same).sum())} of {len(a)} differ, row {i}: {a.loc[i].to_dict()} != {b.loc[i].to_dict()}"
    return None


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g").config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf)
    oracle = entry.oracle_sql()
    for name, run in entry.queries().items():
        if sys.argv[1:] and name not in sys.argv[1:]:
            continue
        start = time.time()
        try:
            got = run(spark, sf).toPandas()
            took = time.time() - start
            if name not in oracle:
                print(f"{name:24s} rows-only {len(got)} {took:.1f}s", flush=True)
                continue
            start = time.time()
            want = con.execute(oracle[name]).df()
            result = differences(got, want) or "ok"
        except Exception as error:  # report and go on with the next query
            took, result = time.time() - start, f"FAILED {str(error)[:600]}"
            got = []
        print(f"{name:24s} {len(got)} {took:.1f}s sql {time.time() - start:.1f}s {result}", flush=True)


if __name__ == "__main__":
    main()
