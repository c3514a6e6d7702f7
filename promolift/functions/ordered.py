"""Order within groups, without a window per group.

A window partitioned by a key sorts all rows of a key in one task. Here rows are
range-sorted on (group, order) once, so that a hot group spreads over many
partitions; what a row needs from the rows before it comes from its own
partition and a table of one row per partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize


def with_previous(df: DataFrame, group: list[str], order: str, name: str, staged: list[str] | None = None) -> DataFrame:
    """``df`` (not null in ``order``, distinct in ``group`` and ``order``) with the
    column ``name``: the next smaller ``order`` of the same group, null for the
    first. The sorted rows are written once; their path is added to ``staged``."""
    key = F.struct(*group, order)
    # partition numbers are stamped and written, so that both reads agree on them
    rows = materialize(df.orderBy(*group, order).withColumn("_part", F.spark_partition_id()), "ordered", staged)
    inside = Window.partitionBy("_part").orderBy(*group, order)
    # one row per partition of the sort
    ends = rows.groupBy("_part").agg(F.max(key).alias("_last"))
    before = ends.select("_part", F.lag("_last").over(Window.orderBy("_part")).alias("_before"))
    rows = (rows.join(F.broadcast(before), "_part")
            .withColumn("_prev", F.coalesce(F.lag(key).over(inside), F.col("_before"))))
    same = F.lit(True)
    for c in group:
        same &= F.col(f"_prev.{c}").eqNullSafe(F.col(c))
    return rows.withColumn(name, F.when(same, F.col(f"_prev.{order}"))).drop("_part", "_before", "_prev")
