"""Running totals over long ordered groups without putting a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_totals(df: DataFrame, group: str, order: str, block: Column,
                   values: dict[str, Column]) -> DataFrame:
    """Add one column per entry of ``values``: its sum over the earlier rows of the group.

    ``block`` must not decrease along ``order`` within a group. Totals are taken
    per block first, carried over the (few) blocks of a group, and finished inside
    each block, so the largest task holds one block.
    """
    staged = df.withColumn("_block", block)
    for name, value in values.items():
        staged = staged.withColumn(f"_v_{name}", value)
    per_block = staged.groupBy(F.col(group).alias("_g"), F.col("_block").alias("_b")).agg(
        *[F.sum(f"_v_{name}").alias(f"_s_{name}") for name in values])
    before = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_block.select("_g", "_b", *[
        F.coalesce(F.sum(f"_s_{name}").over(before), F.lit(0)).alias(f"_c_{name}") for name in values])
    inside = Window.partitionBy(group, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = staged.join(carried, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_block") == F.col("_b")))
    totals = [
        (F.col(f"_c_{name}") + F.coalesce(F.sum(f"_v_{name}").over(inside), F.lit(0))).alias(name)
        for name in values
    ]
    return joined.select(*[F.col(c) for c in df.columns], *totals)
