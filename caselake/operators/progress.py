"""Latest attempts, backlogs, progress views and key selections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import group_positions


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row of each key by ``order``, later columns break ties; larger is later."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in order])
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == 1).drop("__rn")


def first_seen(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each key in the order of arrival."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == 1).drop("__rn")


def best_status(df: DataFrame, keys: Sequence[str], status: str, ranking: Mapping[str, int], names: Sequence[str], default: str, extra: Sequence[Column] = ()) -> DataFrame:
    """Best status of each key by rank (high wins), number of attempts, and further aggregates in the same pass."""
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in ranking.items() for x in kv]), F.col(status))
    labels = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (len(names) - i, n)])
    best = F.coalesce(F.element_at(labels, F.max(rank)), F.lit(default))
    return df.groupBy(*keys).agg(best.alias("best_status"), F.count(F.lit(1)).alias("attempts"), *extra)


def with_rollup(left: DataFrame, rollup: DataFrame, key: str, status: str, default: str) -> DataFrame:
    """Left rows with what is known of them, and a default status where nothing is."""
    return left.join(rollup, key, "left").withColumn(status, F.coalesce(status, F.lit(default)))


def without_match(left: DataFrame, right: DataFrame, key: str, valid: Column | None = None) -> DataFrame:
    """Rows without any (valid) row on the right; also: all keys less those done."""
    right = right if valid is None else right.filter(valid)
    return left.join(right.select(key), key, "left_anti")


def restrict(left: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return left.join(keys.select(key), key, "left_semi")


def needs_work(left: DataFrame, right: DataFrame, key: str, done: Column) -> DataFrame:
    """Rows that have no item at all or some that are not done: one rollup and one join, no EXISTS under OR."""
    per = right.groupBy(key).agg(F.count(F.lit(1)).alias("n_items"), F.count_if(~F.coalesce(done, F.lit(False))).alias("n_open"))
    return left.join(per, key, "left").filter(F.col("n_items").isNull() | (F.col("n_open") > 0))


def overlap_counts(own: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Keys in both, only here, only there."""
    a = own.select(key).distinct().withColumn("__a", F.lit(1))
    b = other.select(key).distinct().withColumn("__b", F.lit(1))
    both = a.join(b, key, "full_outer")
    return both.agg(
        F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("shared"),
        F.count_if(F.col("__b").isNull()).alias("only_own"),
        F.count_if(F.col("__a").isNull()).alias("only_other"),
    )


def additional_by_term(own: DataFrame, known: DataFrame, key: str, term: str) -> DataFrame:
    """Keys that only ``own`` has, by term, with the smallest of them as an example."""
    return own.join(known.select(key), key, "left_anti").groupBy(term).agg(F.count_distinct(key).alias("n"), F.min(key).alias("example"))


def attempt_totals(df: DataFrame, status: str, statuses: Sequence[str], size: str, key: str) -> DataFrame:
    """One row: attempts by status, total size and distinct keys."""
    each = [F.count_if(F.col(status) == s).alias(f"n_{s}") for s in statuses]
    return df.agg(F.count(F.lit(1)).alias("n"), *each, F.sum(size).alias("total_size"), F.count_distinct(key).alias("n_keys"))


def backlog(df: DataFrame, key: str, flags: Mapping[str, Column]) -> DataFrame:
    """Counts per key of all rows and of each flag, and a ``Total`` row."""
    # rolled up over the grouping only: a null key is a group of its own, named Unknown
    named = df.withColumn("__k", F.coalesce(F.col(key).cast("string"), F.lit("Unknown")))
    return (
        named.rollup("__k")
        .agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in flags.items()])
        .select(F.coalesce("__k", F.lit("Total")).alias(key), "total", *flags)
    )


def sum_of_max(df: DataFrame, keys: Sequence[str], value: str, by: Sequence[str] = ()) -> DataFrame:
    """Sum of each key's maximum: attempts that were repeated count once."""
    per = df.groupBy(*by, *[k for k in keys if k not in by]).agg(F.max(value).alias("__m"))
    return per.groupBy(*by).agg(F.sum("__m").alias("total"), F.count(F.lit(1)).alias("n_keys"))


def interleave(df: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Round robin over groups: rows numbered within their group, the number first and then the group.

    Numbers come from :func:`group_positions`, so no task needs to hold a group.
    """
    return group_positions(df, [group], order, "turn").orderBy("turn", group)


def capped_sample(df: DataFrame, group: str, order: Sequence[Column], per_group: int, total: int, group_order: Column) -> DataFrame:
    """At most ``per_group`` rows of a group and ``total`` in all, dealt round robin; ``order`` is the seeded draw."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("turn", F.row_number().over(w)).filter(F.col("turn") <= per_group).orderBy("turn", group_order, group).limit(total)


def stratified_sample(df: DataFrame, plan: DataFrame, cells: Sequence[str], order: Sequence[Column], quota: str = "quota") -> DataFrame:
    """Each cell's quota of rows, in the order of the draw.

    No task keeps more rows of a cell than the largest quota: that bound is a number, so Spark applies it before the shuffle.
    """
    w = Window.partitionBy(*cells).orderBy(*order)
    most = plan.agg(F.max(quota)).first()[0] or 0
    drawn = df.withColumn("turn", F.row_number().over(w)).filter(F.col("turn") <= most)
    return drawn.join(plan.select(*cells, quota), list(cells)).filter(F.col("turn") <= F.col(quota)).drop(quota)


def one_per_bucket_then_fill(df: DataFrame, bucket: str, order: Sequence[Column], total: int) -> DataFrame:
    w = Window.partitionBy(bucket).orderBy(*order)
    return df.withColumn("turn", F.row_number().over(w)).orderBy((F.col("turn") > 1), *order).limit(total)


def first_missing(df: DataFrame, keys: Sequence[str], day: str, start: str, stop: str) -> DataFrame:
    """First day of the range that a key lacks (null if it has all), from its days present."""
    n = F.datediff(F.lit(stop).cast("date"), F.lit(start).cast("date")) + 1
    days = (
        df.select(*keys, F.datediff(F.col(day), F.lit(start).cast("date")).alias("__d"))
        .filter((F.col("__d") >= 0) & (F.col("__d") < n))
        .distinct()
    )
    w = Window.partitionBy(*keys).orderBy("__d")
    # where the days are in place, day number and row number are equal
    run = days.withColumn("__rn", F.row_number().over(w) - 1).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_days"), F.count_if(F.col("__rn") == F.col("__d")).alias("__run")
    )
    missing = F.when(F.col("__run") < n, F.date_add(F.lit(start).cast("date"), F.col("__run").cast("int")))
    return run.select(*keys, "n_days", missing.alias("first_missing"))


def transition_matrix(df: DataFrame, old: Column, new: Column, demoted: Sequence[str] = ()) -> DataFrame:
    """Counts of (old, new), whether it is a change, and whether it is a demotion to be skipped."""
    rows = df.select(old.alias("old"), new.alias("new"))
    changed = ~F.col("old").eqNullSafe(F.col("new"))
    skipped = changed & F.coalesce(F.col("new").isin(*demoted), F.lit(True)) if demoted else F.lit(False)
    return rows.groupBy("old", "new").agg(F.count(F.lit(1)).alias("n")).withColumns({"changed": changed, "skipped": skipped})


def attempt_status(error: Column, files: Column, listed: Column) -> Column:
    """error / no_files / partial / success of an attempt."""
    return (
        F.when(error.isNotNull(), "error")
        .when(F.coalesce(files, F.lit(0)) == 0, "no_files")
        .when(files < listed, "partial")
        .otherwise("success")
    )
