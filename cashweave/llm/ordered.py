"""Sums along a global order: a range sort, sums inside each block, and one offset a block.

No task holds more than its block: a group with a third of all rows lies in many blocks,
and what meets over all of them is one row for each group and block.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from cashweave.llm.common import Batches, in_tasks, restage

BLOCK_ROWS = 50_000


def block_count(rows: int, most: int) -> int:
    """Blocks of about `BLOCK_ROWS`; beyond `most` tasks the blocks grow, as in any sort of Spark's."""
    return max(1, min(most, -(-rows // BLOCK_ROWS)))


def in_blocks(df: DataFrame, order: Sequence[str], blocks: int) -> DataFrame:
    """Sorted globally: partition p holds the rows before those of partition p + 1. The order must be total."""
    return df.repartitionByRange(blocks, *order).sortWithinPartitions(*order)


def sums_before(df: DataFrame, group: str, value: str, order: Sequence[str], blocks: int) -> DataFrame:
    """`df` with `_before`: the sum of `value` over the rows of the same `group` that stand earlier in `order`.

    `group` is a long without nulls, `value` a long without nulls, (group, order) a total order.
    """
    schema = StructType([*df.schema.fields, StructField("_block", LongType()), StructField("_inside", LongType())])

    def run(batches: Batches) -> Batches:
        block, last, carried = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            groups = batch.column(group).to_numpy(zero_copy_only=False)
            values = batch.column(value).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
            before = np.cumsum(values) - values
            base = before[starts]
            if groups[0] == last:
                base[0] -= carried
            before = before - np.repeat(base, np.diff(np.r_[starts, len(groups)]))
            last, carried = groups[-1], int(before[-1] + values[-1])
            extra = [pa.array(np.full(len(groups), block, np.int64)), pa.array(before.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=schema.names)

    inside, _ = restage(in_tasks(in_blocks(df, [group, *order], blocks), run, schema), "in-order")
    sums = inside.groupBy(group, "_block").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(group, "_block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    joined = inside.join(offsets, [group, "_block"])
    return joined.select(*df.columns, (F.col("_inside") + F.col("_offset")).alias("_before"))
