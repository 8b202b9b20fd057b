"""Dense numbering of rows in a total order, without a window."""

from __future__ import annotations

from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootweave.storage import cut


def numbered(df: DataFrame, *order: Column | str, name: str = "n") -> DataFrame:
    """df with the row's place (from 0) in the order.

    Rows are range-partitioned and sorted by the order, and a row's place within its partition is read from its row id.
    The partitions' sizes (one row each) give the offsets. The sorted rows are checkpointed, so both see the same partitions.
    """
    held = cut(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = sorted(map(tuple, held.groupBy(part.alias("part")).agg(F.count("*").alias("size")).collect()))  # one row a partition
    before = list(accumulate([0, *(n for _, n in sizes)]))[: len(sizes)]
    offsets = df.sparkSession.createDataFrame(pa.table({"__part": pa.array([p for p, _ in sizes], pa.int64()), "__before": pa.array(before, pa.int64())}))
    own = held.withColumn("__part", part).join(F.broadcast(offsets), "__part")  # one row a partition
    return own.withColumn(name, (F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("__part", "__at", "__before")
