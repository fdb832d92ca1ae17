"""Writers of stage results: parquet for data, one JSON text per row with sorted keys, CSV and XML."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, *by: str) -> None:
    """Replaces the table; partitioned by the named columns."""
    w = df.write.mode("overwrite").option("compression", "zstd")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines with keys in order, so that equal rows are equal texts."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Nested columns as JSON."""
    flat = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f.name) for f in df.schema]
    df.select(*flat).write.mode("overwrite").option("header", "true").csv(path)


def write_xml(df: DataFrame, path: str, row: str = "row") -> None:
    df.write.mode("overwrite").option("rowTag", row).xml(path)
