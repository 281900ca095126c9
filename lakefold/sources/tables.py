"""Table access: one parquet file or folder per table, explicit projections so that scans prune."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakefold.session import ship


def table(spark: SparkSession, root: str, name: str, *columns: str) -> DataFrame:
    """Table ``name`` under ``root``, projected to ``columns`` when given."""
    ship(spark)
    df = spark.read.parquet(f"{root}/{name}.parquet")
    return df.select(*columns) if columns else df
