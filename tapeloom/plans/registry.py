"""Query registry: each entry pairs a Spark query with SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.operators.ordered import sized

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round floating columns half up; whole types become BIGINT, so both engines print alike."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.floor(c.cast("double") * F.lit(10.0**digits) + F.lit(0.5)) / F.lit(10.0**digits)
        elif isinstance(field.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        out.append(c.alias(field.name))
    return df.select(*out)


def rounded_sql(sql: str, doubles: str, digits: int = DIGITS) -> str:
    names = doubles.split()
    if not names:
        return sql
    scale = f"{10**digits}.0::DOUBLE"
    parts = [f"floor({n}::DOUBLE * {scale} + 0.5::DOUBLE) / {scale} AS {n}" for n in names]
    return f"SELECT * REPLACE ({', '.join(parts)}) FROM ({sql}) AS q"


def query(name: str, sql: str | None = None, doubles: str = "", digits: int = DIGITS):
    """Register a query. ``doubles`` names the floating columns of the SQL, which get rounded."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} exists")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ticks = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("symbol"))
            with sized(ticks, ["symbol"], times=8):  # views copy a row once, as-of joins stack two views
                return rounded(fn(spark, sf_dir), digits)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = rounded_sql(sql, doubles, digits)
        return fn

    return add
