"""Positions in a global order, without a task that holds all rows or a whole group.

Rows are dealt by ranges of the order and sorted in their partitions; a row's position is its place there plus the rows of
earlier partitions.  What is added are as many numbers as there are partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import scratch_dir

#: Bits of monotonically_increasing_id that number the rows of a partition.
_ROW_BITS = 33


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sorted_parts(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """``df`` sorted by ``order``, with the number of its partition as ``__part`` and the place there, from 0, as ``__at``.

    Written to the shared scratch folder, so that every reader sees the same partitions.
    """
    by = [_column(c) for c in order]
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__id", F.monotonically_increasing_id())
    path = scratch_dir(df.sparkSession)
    placed.write.parquet(path)
    rows = df.sparkSession.read.schema(placed.schema).parquet(path)
    part = F.shiftright("__id", _ROW_BITS).cast("int")
    return rows.withColumn("__part", part).withColumn("__at", F.col("__id") - F.shiftleft(part.cast("long"), _ROW_BITS)).drop("__id")


def _earlier(parts: DataFrame, keys: Sequence[str], measure: Column) -> DataFrame:
    """Sum of ``measure`` over earlier partitions, by partition and ``keys``: at most a row for each partition and key met in it."""
    w = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.groupBy("__part", *keys).agg(measure.alias("__m")).withColumn("__earlier", F.coalesce(F.sum("__m").over(w), F.lit(0))).drop("__m")


def global_positions(df: DataFrame, order: Sequence[str | Column], name: str = "position") -> DataFrame:
    """``df`` with the position of each row in ``order``, from 1.  ``order`` may mix directions; make it total, or ties fall anyhow."""
    parts = sorted_parts(df, order)
    earlier = F.broadcast(_earlier(parts, [], F.count(F.lit(1))))
    return parts.join(earlier, "__part").withColumn(name, F.col("__at") + F.col("__earlier") + 1).drop("__part", "__at", "__earlier")


def group_positions(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "position") -> DataFrame:
    """``df`` with the position of each row in its group, from 1; a group may be larger than any task."""
    parts = sorted_parts(df, [*keys, *order])
    own = F.row_number().over(Window.partitionBy("__part", *keys).orderBy("__at"))
    # only groups that reach over the end of a partition have rows in earlier ones: one such group a partition at most
    carried = _earlier(parts, keys, F.count(F.lit(1))).filter(F.col("__earlier") > 0)
    carried = F.broadcast(carried.select(F.col("__part").alias("__p"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__earlier"))
    met = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        met = met & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    numbered = parts.withColumn(name, own).join(carried, met, "left")
    return numbered.select(*df.columns, (F.col(name) + F.coalesce("__earlier", F.lit(0))).alias(name))


def running_sums(df: DataFrame, order: Sequence[str | Column], value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before each in ``order``."""
    parts = sorted_parts(df, order)
    earlier = F.broadcast(_earlier(parts, [], F.sum(value)))
    inside = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    total = F.coalesce(F.sum(value).over(inside), F.lit(0)) + F.col("__earlier")
    return parts.join(earlier, "__part").withColumn(name, total).drop("__part", "__at", "__earlier")
