"""Reading the tables of a folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def dealt(rows: DataFrame, key: Column) -> DataFrame:
    """Rows that a query makes many rows of each, dealt by their key to as many tasks as shuffles have: a small file is one
    task's, however much is printed of its rows; what is grouped or ordered by the key then stays in its task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def money(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")


def grouped(c: Column) -> Column:
    """An amount as printed: thousands grouped, two decimals, no sign."""
    return F.format_number(F.abs(c), 2)
