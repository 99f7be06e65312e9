"""Scans: Parquet tables, JDBC tables, and views over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A Parquet table, or some of its columns; what a query doesn't name isn't read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def jdbc(spark: SparkSession, url: str, query: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """A table or parenthesised query by JDBC; with a numeric key, in `parts` ranges read by as many tasks."""
    read = spark.read.format("jdbc").option("url", url).option("dbtable", query).options(**options)
    if key:
        read = read.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return read.load()


def views(tables: dict[str, DataFrame]) -> None:
    """Name DataFrames for SQL."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
