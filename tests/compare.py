"""Run registered queries on Spark and DuckDB and compare: python tests/compare.py SF_DIR [NAME...]"""

from __future__ import annotations

import math
import sys
from collections import Counter
from decimal import Decimal
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, float):  # only these have a tolerance; whole numbers, decimals and strings are compared exactly
        return ("float", f"{x:.9g}" if x else "0")
    if isinstance(x, (bool, int)):
        return int(x)
    if isinstance(x, Decimal):
        return x.normalize()
    if isinstance(x, (list, tuple)):
        return tuple(map(cell, x))
    return x if isinstance(x, (str, bytes)) else str(x)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(cell(r[i]) for i in order) for r in data)


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}/*.parquet')" if p.is_dir() else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, con, fn, sql, sf_dir) -> str:
    df = fn(spark, sf_dir)
    got = rows(df.columns, df.collect())
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want = rows(names, rel.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if got != want:
        return f"{sum(got.values())} and {sum(want.values())} rows; only Spark {list((got - want).items())[:2]}; only DuckDB {list((want - got).items())[:2]}"
    return "" if got else "no rows"


if __name__ == "__main__":
    import os

    root = Path(__file__).resolve().parents[1]
    sys.path.insert(0, str(root))
    os.environ["PYTHONPATH"], os.environ["PYSPARK_PYTHON"] = str(root), sys.executable
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    session = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "/tmp/silt-compare").getOrCreate()
    session.sparkContext.setLogLevel("OFF")
    con = duck(sys.argv[1])
    sqls = e.oracle_sql()
    for name, fn in e.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:] or not sys.argv[2:] and (name == "pipeline" or name.startswith("op")):
            continue
        try:
            why = compare(session, con, fn, sqls[name], sys.argv[1]) if name in sqls else f"(no SQL) {fn(session, sys.argv[1]).count()} rows"
        except Exception as x:  # noqa: BLE001
            why = f"{type(x).__name__}: {str(x)[:400]}"
        print(name, why or "ok", flush=True)
