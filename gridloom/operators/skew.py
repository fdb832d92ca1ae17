"""Joins that hold when one key has a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is heavy at max(HEAVY_ROWS, all rows / HEAVY_KEYS): there are HEAVY_KEYS of them at most,
#: whatever the input, which bounds what is broadcast.
HEAVY_ROWS = 20_000
HEAVY_KEYS = 5_000


def same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality on all keys."""
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(right[k])
    return on


def heavy_keys(counts: DataFrame, keys: Sequence[str], n: str, heavy_rows: int = HEAVY_ROWS, max_keys: int = HEAVY_KEYS) -> tuple[DataFrame, int]:
    """The keys whose `n` sums to the heavy limit or more, and how many there are.
    `counts` is pre-aggregated (one row per key, or per key and period) and is read twice."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    limit = max(heavy_rows, -(-total // max_keys))
    if total < limit:
        return counts.select(*keys).limit(0), 0
    heavy = counts.groupBy(*keys).agg(F.sum(n).alias("_n")).where(F.col("_n") >= limit).select(*keys)
    return heavy, heavy.count()


def lookup(rows: DataFrame, facts: DataFrame, keys: Sequence[str], heavy: DataFrame, n_heavy: int) -> DataFrame:
    """Left join of `rows` to `facts` (one row per key). Rows of heavy keys are
    joined to a broadcast of those keys' facts, of n_heavy rows at most; all others by
    a shuffle in which no key is large."""
    named = facts.select(*[F.col(k).alias(f"_f_{k}") for k in keys], *[c for c in facts.columns if c not in keys], F.lit(True).alias("_found"))
    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        on = F.lit(True)
        for k in keys:
            on = on & left[k].eqNullSafe(right[f"_f_{k}"])
        return left.join(right, on, "left").drop(*[f"_f_{k}" for k in keys])
    if not n_heavy:
        return joined(rows, named)
    flag = heavy.select(*[F.col(k).alias(f"_h_{k}") for k in keys], F.lit(True).alias("_heavy"))
    on_flag, on_fact = F.lit(True), F.lit(True)
    for k in keys:
        on_flag = on_flag & rows[k].eqNullSafe(flag[f"_h_{k}"])
        on_fact = on_fact & named[f"_f_{k}"].eqNullSafe(flag[f"_h_{k}"])
    drop = [*[f"_h_{k}" for k in keys], "_heavy"]
    marked = rows.join(F.broadcast(flag), on_flag, "left")
    few = named.join(F.broadcast(flag), on_fact, "left_semi")
    hot = joined(marked.where(F.col("_heavy")).drop(*drop), F.broadcast(few))
    rest = joined(marked.where(F.col("_heavy").isNull()).drop(*drop), named)
    return hot.unionByName(rest)
