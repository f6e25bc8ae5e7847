"""Keyed upserts, guarded updates and run states in batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(base: DataFrame, delta: DataFrame, key: str, order: Sequence[str], flag: str = "change") -> DataFrame:
    """Latest row per key of both; ``change``: new, updated or kept.  Rows without a key are skipped; the delta wins ties."""
    both = base.withColumn("__side", F.lit(0)).unionByName(delta.withColumn("__side", F.lit(1))).filter(F.col(key).isNotNull())
    w = Window.partitionBy(key)
    last = w.orderBy(*[F.desc_nulls_last(c) for c in order], F.desc("__side"))
    change = F.when(F.col("__had") == 1, "new").when(F.col("__side") == 1, "updated").otherwise("kept")
    return (
        both.withColumn("__had", F.min("__side").over(w))
        .withColumn("__rn", F.row_number().over(last))
        .filter(F.col("__rn") == 1)
        .withColumn(flag, change)
        .drop("__side", "__had", "__rn")
    )


def guarded_update(base: DataFrame, updates: DataFrame, key: str, column: str, new: str, guard: Column) -> DataFrame:
    """Sets ``column`` to the update's ``new`` where the guard holds and the new value is not null.

    The guard reads base columns and ``new``; comparing with the old value makes a second run change nothing.
    """
    joined = base.join(updates.select(key, F.col(new).alias("__new")), key, "left")
    use = F.col("__new").isNotNull() & F.coalesce(guard, F.lit(False))
    return joined.withColumns({column: F.when(use, F.col("__new")).otherwise(F.col(column)), "updated": use}).drop("__new")


def run_state(df: DataFrame, key: str, ok: Column) -> DataFrame:
    """done wins over failed, whatever the order of the attempts."""
    return df.groupBy(key).agg(F.when(F.max(F.coalesce(ok, F.lit(False))), "done").otherwise("failed").alias("state"), F.count(F.lit(1)).alias("n"))


def signature(parts: Sequence[Column]) -> Column:
    """Sorted distinct configuration parts."""
    return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*parts)))), "|")


def reusable(todo: DataFrame, manifest: DataFrame, key: str, statuses: Sequence[str], signature_now: str) -> tuple[DataFrame, DataFrame]:
    """(rows to reuse, rows to do): finished under the same configuration, or not."""
    good = manifest.filter(F.col("status").isin(*statuses) & (F.col("signature") == signature_now))
    return todo.join(good.select(key), key, "left_semi"), todo.join(good.select(key), key, "left_anti")
