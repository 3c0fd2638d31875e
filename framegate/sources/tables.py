"""The tables of a data folder."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a folder; columns and filters reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
