"""Reading the fixture tables and normalising what the engine needs at ingest."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, through Spark's reader only (any store Spark can reach)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_utc(df: DataFrame, *columns: str) -> DataFrame:
    """Zone-less timestamps as UTC instants, so that epoch arithmetic is allowed."""
    return df.withColumns({c: F.col(c).cast("timestamp") for c in columns})


def finite(df: DataFrame) -> DataFrame:
    """Non-finite doubles and floats become NULL: 'missing' has one spelling inside the engine."""
    bad = lambda c: F.isnan(c) | F.col(c).isin(float("inf"), float("-inf"))
    return df.withColumns(
        {f.name: F.when(~bad(f.name), F.col(f.name)) for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    )
