"""Reading the tables of TESTDATA.md."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(c: Column | str) -> Column:
    """Microseconds since 1970-01-01; the tables' timestamps have no zone and mean UTC."""
    return F.unix_micros(F.to_utc_timestamp(F.col(c) if isinstance(c, str) else c, F.current_timezone()))
