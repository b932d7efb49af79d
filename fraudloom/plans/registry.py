"""Named queries over a table folder, each beside the ANSI SQL that checks it."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from .result_schemas import SCHEMAS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, digits: int | None = 6):
    """Register a query. Doubles are rounded to `digits` so that summation order cannot show."""

    def add(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            df = fn(Tables(spark, folder))
            return rounded(df, digits) if digits is not None else df

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = typed(sql, SCHEMAS.get(name, ""), digits)
        return fn

    return add


SQL_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN", "string": "VARCHAR", "double": "DOUBLE"}


def typed(sql: str, schema: str, digits: int | None) -> str:
    """The check with the column types and the rounding of the Spark result."""
    out = []
    for field in filter(None, schema.split(", ")):
        name, kind = field.split(" ")
        value = f'CAST("{name}" AS {SQL_TYPES[kind]})'
        out.append(f'round({value} + 1e-11::DOUBLE, {digits}) + 0.0 AS "{name}"' if kind == "double" and digits is not None else f'{value} AS "{name}"')
    return f"SELECT {', '.join(out)} FROM ({sql})" if out else sql


def rounded(df: DataFrame, digits: int) -> DataFrame:
    real = (DoubleType, FloatType)
    # the nudge settles exact decimal ties the same way whatever the last bit; + 0.0 removes -0.0
    return df.select(*[(F.round(F.col(f.name) + 1e-11, digits) + 0.0).alias(f.name) if isinstance(f.dataType, real) else F.col(f.name) for f in df.schema.fields])


class Tables:
    """Lazy parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
