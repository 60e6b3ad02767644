"""Running totals over groups of any size, without a group ever meeting in one task.

Rows are dealt by ranges of group and order, so that a hot group spreads over many tasks; each task runs its rows up as they
stream past it. A group that goes on over several ranges then gets what the ranges before hold of it: at most two groups of a
range do, so the table of these offsets has a size bounded by the number of ranges and is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize


def _fold(group: str, sums: Sequence[str], xors: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, {}  # the group of the row before, and its totals up to there
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(group).to_numpy()
            new = np.empty(len(keys), bool)
            new[0], new[1:] = last is None or keys[0] != last, keys[1:] != keys[:-1]
            first = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))  # where each row's group begins here
            goes_on = first == 0 if not new[0] else np.zeros(len(keys), bool)
            columns = {}
            for name in ("", *sums):
                values = batch.column(name).to_numpy() if name else np.ones(len(keys), np.int64)
                total = np.cumsum(values)
                columns[name] = total - (total - values)[first] + np.where(goes_on, held.get(name, 0), 0)
            for name in xors:
                values = batch.column(name).to_numpy()
                total = np.bitwise_xor.accumulate(values)
                columns[name] = total ^ (total ^ values)[first] ^ np.where(goes_on, held.get(name, 0), 0)
            last, held = keys[-1], {name: column[-1] for name, column in columns.items()}
            arrays = [pa.array(columns[name], pa.int64()) for name in ("", *sums, *xors)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, "rank", *(f"run_{c}" for c in (*sums, *xors))])

    return run


def running(df: DataFrame, group: str, order: Sequence[str], sums: Sequence[str] = (), xors: Sequence[str] = ()) -> DataFrame:
    """df with rank (from 1 in each group, in the order of the columns order, nulls first), and run_<c>, the running sum or
    exclusive or of each column c up to its row. group, sums and xors are longs without nulls; rows of equal order come in any
    order. The result is written to the shared folder."""
    dealt = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_part", F.spark_partition_id().cast("long"))
    new = ["rank", *(f"run_{c}" for c in (*sums, *xors))]
    schema = T.StructType([*dealt.schema.fields, *(T.StructField(c, T.LongType()) for c in new)])
    rows = materialize(dealt.mapInArrow(_fold(group, sums, xors), schema), "running")
    # what each range holds of its first and last group, and of these what the ranges before hold
    ends = rows.groupBy("_part").agg(F.min(group).alias("_lo"), F.max(group).alias("_hi"))
    held = rows.join(F.broadcast(ends), "_part").filter((F.col(group) == F.col("_lo")) | (F.col(group) == F.col("_hi")))
    held = held.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_o_rank"), *(F.sum(c).alias(f"_o_run_{c}") for c in sums), *(F.bit_xor(c).alias(f"_o_run_{c}") for c in xors))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    total = [F.sum(f"_o_{c}").over(before).alias(f"_o_{c}") for c in new[: 1 + len(sums)]] + [F.bit_xor(f"_o_run_{c}").over(before).alias(f"_o_run_{c}") for c in xors]
    offsets = materialize(held.select(group, "_part", *total).filter("_o_rank is not null"), "offsets")
    if not offsets.limit(1).count():
        return rows.drop("_part")
    joined = rows.join(F.broadcast(offsets), [group, "_part"], "left")
    whole = {c: F.col(c) + F.coalesce(F.col(f"_o_{c}"), F.lit(0)) for c in new[: 1 + len(sums)]}
    whole |= {f"run_{c}": F.col(f"run_{c}").bitwiseXOR(F.coalesce(F.col(f"_o_run_{c}"), F.lit(0))) for c in xors}
    return joined.withColumns(whole).drop("_part", *(f"_o_{c}" for c in new))
