"""Runs a registered query in Spark and its SQL in DuckDB and compares the results.

Usage: python tests/oracle.py [folder] [name-prefix ...]
"""
from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def session(cpus: int = 8, partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName("fraudloom")
        .config("spark.sql.shuffle.partitions", str(partitions)).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.execution.arrow.pyspark.enabled", "true").getOrCreate()
    )


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return v + 0.0
    if hasattr(v, "__float__") and not isinstance(v, int):
        return float(v) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    body = [tuple(cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(body, key=lambda r: tuple((x is None, str(type(x).__name__ in ("int", "float") and float(x) or x)) for x in r))


def same(a, b, tol=2e-6):
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return abs(a - b) <= tol * max(1.0, abs(a), abs(b))
    return a == b


def compare(spark, con, name, fn, sql, folder, digits=6):
    df = fn(spark, folder)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return f"rows={len(got[1])} (no sql)"
    from fraudloom.plans.registry import ORACLES  # noqa: F401

    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    want = table(cols, rel.fetchall())
    if got[0] != want[0]:
        return f"COLUMNS {got[0]} vs {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"ROWS {len(got[1])} vs {len(want[1])}"
    exact = got[1] == want[1]
    for g, w in zip(got[1], want[1]):
        if not all(same(x, y) for x, y in zip(g, w)):
            return f"VALUES {got[0]}\n   spark {g}\n   duck  {w}"
    if not exact:
        g, w = next((g, w) for g, w in zip(got[1], want[1]) if g != w)
        return f"ok rows={len(got[1])} INEXACT\n   spark {g}\n   duck  {w}"
    return f"ok rows={len(got[1])}"


def write_schemas(spark, folder):
    """Analyses every query (no job is needed for most) and stores its column types."""
    from fraudloom.plans import catalogue

    lines = []
    for name, fn in catalogue.QUERIES.items():
        if name in catalogue.ORACLES:
            df = fn(spark, folder)
            lines.append(f'    "{name}": "{", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)}",')
    head = '"""Result schema of every query (written by `python tests/oracle.py --schemas`)."""\nSCHEMAS: dict[str, str] = {\n'
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "fraudloom/plans/result_schemas.py")
    with open(path, "w") as out:
        out.write(head + "\n".join(lines) + "\n}\n")


def main():
    if "--schemas" in sys.argv:
        spark = session()
        spark.sparkContext.setLogLevel("ERROR")
        return write_schemas(spark, "/root/testdata/sf0.001")
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    from fraudloom.plans import catalogue

    spark, con = session(), duck(folder)
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name, fn in catalogue.QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t0 = time.time()
        try:
            out = compare(spark, con, name, fn, catalogue.ORACLES.get(name), folder)
        except Exception as exc:
            out = "ERROR " + str(exc)[:1500]
        bad += not out.startswith(("ok", "rows"))
        print(f"{name:34s} {time.time() - t0:6.2f}s {out}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
