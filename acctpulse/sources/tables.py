"""Table scans, query strings and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One parquet table; projections and filters reach the scan."""
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def catalog_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def run_query(spark: SparkSession, query: str) -> DataFrame:
    """A SQL string as a lazy, distributed result."""
    return spark.sql(query)


def replace_table(df: DataFrame, name: str, *cluster_by: str) -> None:
    """Create or replace a table from a result.

    ``cluster_by`` range-partitions and sorts the files, so that later reads of
    one account or period skip most of them.
    """
    if cluster_by:
        df = df.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by)
    df.write.mode("overwrite").saveAsTable(name)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header row. The writer leaves one file per partition."""
    df.write.mode("overwrite").option("header", True).csv(path)
