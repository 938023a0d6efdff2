"""Run registered queries and their SQL twins side by side: python tests/oracle_check.py SF [name ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows_of(df) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = [tuple("NULL" if v is None or v is pd.NA or v != v else repr(v.item() if hasattr(v, "item") else v) for v in r)
            for r in df.itertuples(index=False)]
    return sorted(rows)


def kinds(df) -> dict[str, str]:
    def kind(s):
        v = s.dropna()
        return "none" if v.empty else type(v.iloc[0].item() if hasattr(v.iloc[0], "item") else v.iloc[0]).__name__
    return {c: kind(df[c]) for c in df.columns}


def compare(spark_df, duck_df) -> str | None:
    a, b = spark_df.toPandas(), duck_df
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(set(a.columns) ^ set(b.columns))}"
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    ka, kb = kinds(a), kinds(b)
    bad = {c: (ka[c], kb[c]) for c in ka if ka[c] != kb[c]}
    if bad and not all({x, y} <= {"int", "float"} for x, y in bad.values()):
        return f"types {bad}"
    num = [c for c, kk in bad.items()]
    for c in num:
        a[c], b[c] = a[c].astype("float64"), b[c].astype("float64")
    ra, rb = rows_of(a), rows_of(b)
    diff = [(x, y) for x, y in zip(ra, rb) if x != y]
    if diff:
        return f"{len(diff)} of {len(ra)} rows differ; columns {sorted(a.columns)}\n   spark {diff[0][0]}\n   sql   {diff[0][1]}"
    return f"EMPTY" if not ra else None


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry
    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, failed = connect(sf_dir), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t0 = time.time()
        try:
            out = fn(spark, sf_dir)
            if name in oracles:
                problem = compare(out, con.execute(oracles[name]).df())
            else:
                n = len(out.toPandas())
                problem = None if n else "EMPTY"
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - t0:.1f}s{'' if name in oracles else ' (rows only)'} {problem or ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    raise SystemExit(main())
