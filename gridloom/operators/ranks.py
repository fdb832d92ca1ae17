"""Row numbers and medians per key that hold when one key has a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import Scratch


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "ord") -> DataFrame:
    """df with `name`: each row's number from 1 among those of its keys, in the ascending order of
    the columns (nulls first; ties in any order).

    In two levels, so that no key is ordered in one task: rows are spread by ranges of
    (keys, order) and written, numbered within each range, and the counts of a key's earlier
    ranges are added. A key has as many counts as ranges that hold it."""
    scratch = Scratch(df.sparkSession, "ranks")
    spread = scratch.save(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "spread")
    by = [*keys, "_part"]
    inside = spread.withColumn("_in", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    sizes = spread.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).drop("_n")
    named = before.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), "_before")
    on = inside["_part"] == named["_p"]
    for i, k in enumerate(keys):
        on = on & inside[k].eqNullSafe(named[f"_k{i}"])
    return inside.join(named, on).withColumn(name, (F.col("_in") + F.col("_before")).cast("long")).drop("_part", "_in", "_p", "_before", *[f"_k{i}" for i in range(len(keys))])


def quantiles(df: DataFrame, keys: Sequence[str], value: str, at: Sequence[tuple[str, float]]) -> DataFrame:
    """keys and, for each (name, fraction), the quantile of the non-null values, interpolated
    linearly between the two nearest ranks. Values are ranked in two levels; only the ranks asked
    for are gathered."""
    rows = ranked(df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")), keys, ["_v"], "_r")
    n = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.join(n, list(keys))
    out = []
    for name, f in at:
        place = (F.col("_n") - 1) * F.lit(f)
        low = F.max(F.when(F.col("_r") == F.floor(place) + 1, F.col("_v")))
        high = F.max(F.when(F.col("_r") == F.ceil(place) + 1, F.col("_v")))
        weight = F.max(place - F.floor(place))
        out.append((low + (high - low) * weight).alias(name))
    keep = F.lit(False)
    for _, f in at:
        place = (F.col("_n") - 1) * F.lit(f)
        keep = keep | (F.col("_r") == F.floor(place) + 1) | (F.col("_r") == F.ceil(place) + 1)
    return rows.where(keep).groupBy(*keys).agg(*out)
