"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header and ISO dates, one file per partition."""
    df.write.mode(mode).option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Parquet table, optionally partitioned; rows of a partition are spread over tasks as they are."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def replace_years(new: DataFrame, path: str, date: str = "date") -> None:
    """Overwrite only the year partitions that occur in ``new``."""
    (
        new.withColumn("year", F.year(date)).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)
    )
