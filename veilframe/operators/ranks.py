"""Ranks and running sums over groups of any size, without a group ever meeting in one task.

Rows are dealt by range, and what a range holds of a group is counted; a row's rank is its place among these plus what the
ranges before hold. A window over one row for each range and group runs the counts up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import stored


def _ranges(df: DataFrame, *order: str) -> DataFrame:
    """df in the order of its ranges, with _part (the range) and _at (ascending in it), written so that both stay."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "ranges")


def ranked(df: DataFrame, group: str, order: str) -> DataFrame:
    """df with _rank (gapless from 0 in each group, by order) and _size (of the group). A null group is a group."""
    rows = _ranges(df, group, order)
    heads = rows.groupBy(group, "_part").agg(F.min("_at").alias("_least"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_size", F.sum("_n").over(Window.partitionBy(group)))
    heads = heads.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), "_least", "_before", "_size")
    joined = rows.join(heads, rows[group].eqNullSafe(heads["_g"]) & (rows["_part"] == heads["_p"]))
    return joined.withColumn("_rank", F.col("_at") - F.col("_least") + F.col("_before")).drop("_g", "_p", "_part", "_at", "_least", "_before")


def running(df: DataFrame, order: str, values: dict[str, Column]) -> DataFrame:
    """df with running sums of values over all rows in the order of a column of any kind, nulls first; rows of equal order come
    in any order. The only rows that meet in one task are one for each range."""
    rows = _ranges(df.withColumns({f"_v_{k}": v for k, v in values.items()}), order)
    totals = rows.groupBy("_part").agg(*(F.sum(f"_v_{k}").alias(f"_s_{k}") for k in values))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_part", *(F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_s_{k}") for k in values))
    inner = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    done = rows.withColumns({f"_w_{k}": F.sum(f"_v_{k}").over(inner) for k in values}).join(totals, "_part")
    summed = done.withColumns({k: F.coalesce(F.col(f"_w_{k}"), F.lit(0)) + F.col(f"_s_{k}") for k in values})
    return summed.drop("_part", "_at", *(f"_{x}_{k}" for x in "vsw" for k in values))
