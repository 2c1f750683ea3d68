"""Compare registered queries with their SQL form in DuckDB: python tests/oracle.py [sf] [names]."""

import math
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def normalised(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(
        (tuple(plain(row[i]) for i in order) for row in rows), key=repr
    )


def compare(spark, con, name, run, sql, folder):
    frame = run(spark, folder)
    got = normalised(frame.columns, [tuple(r) for r in frame.collect()])
    result = con.execute(sql)
    want = normalised([d[0] for d in result.description], result.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if got[1] != want[1]:
        missing = [r for r in want[1] if r not in set(got[1])][:3]
        extra = [r for r in got[1] if r not in set(want[1])][:3]
        return f"rows {len(got[1])} vs {len(want[1])}; missing {missing}; extra {extra}"
    return f"ok ({len(got[1])} rows)"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    scale = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{scale}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(folder)
    runs, sqls = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or list(runs):
        started = time.time()
        try:
            if name in sqls:
                outcome = compare(spark, con, name, runs[name], sqls[name], folder)
            else:
                outcome = f"rows only ({runs[name](spark, folder).count()} rows)"
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            outcome = f"FAILED {type(error).__name__}: {str(error)[:600]}"
        print(f"{name:32s} {time.time() - started:6.1f}s  {outcome}", flush=True)
