"""Outcome-rate tables, modes, imputation, distributions and series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import running_sums


def outcome_rates(
    df: DataFrame,
    keys: Sequence[str],
    outcome: str,
    outcomes: Sequence[str],
    approved: Sequence[str],
    refused: Sequence[str],
    min_total: int = 0,
) -> DataFrame:
    """Counts by outcome, total, decided, and rates in percent (null over a zero denominator).

    Approval and refusal rates are shares of the decided rows, ``no_decision_share`` of all rows.
    """
    o = F.col(outcome)
    agg = df.groupBy(*keys).agg(
        *[F.count_if(o == x).alias(f"n_{x}") for x in outcomes],
        F.count(F.lit(1)).alias("total"),
        F.count_if(o.isin(*approved)).alias("__a"),
        F.count_if(o.isin(*refused)).alias("__r"),
    )
    decided = F.col("__a") + F.col("__r")
    return agg.filter(F.col("total") >= min_total).select(
        *keys,
        *[f"n_{x}" for x in outcomes],
        "total",
        decided.alias("decided"),
        F.round(F.try_divide(F.col("__a") * 100.0, decided), 4).alias("approval_rate"),
        F.round(F.try_divide(F.col("__r") * 100.0, decided), 4).alias("refusal_rate"),
        F.round(F.try_divide((F.col("total") - decided) * 100.0, F.col("total")), 4).alias("no_decision_share"),
    )


def subset_rows(df: DataFrame, flags: Mapping[str, tuple[str, str]], name: str = "subset") -> DataFrame:
    """One row per named subset that a row belongs to: flag column -> (name if set, name of the complement).

    One pass over the input; subsets overlap.
    """
    parts = [F.when(F.coalesce(F.col(f), F.lit(False)), a).otherwise(b) for f, (a, b) in flags.items()]
    return df.withColumn(name, F.explode(F.array(*parts)))


def mode_by(df: DataFrame, keys: Sequence[str], value: str, out: str = "mode") -> DataFrame:
    """Most frequent non-null value of each group, ties to the smaller value."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    least = counts.groupBy(*keys, "__n").agg(F.min(value).alias("__v"))
    return least.groupBy(*keys).agg(F.max_by("__v", "__n").alias(out))


def impute_mode(df: DataFrame, keys: Sequence[str], value: str, fallback: str, out: str) -> DataFrame:
    """Fills missing values with the group's mode, then with ``fallback``."""
    modes = mode_by(df, keys, value, "__mode")
    return df.join(modes, list(keys), "left").withColumn(out, F.coalesce(value, "__mode", F.lit(fallback))).drop("__mode")


def dominant_rates(df: DataFrame, keys: Sequence[str], hit: Column, category: str, min_total: int) -> DataFrame:
    """Group rate of ``hit`` in percent with HAVING total >= ``min_total`` and the dominant category."""
    rates = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("total"), F.round(F.avg(F.when(hit, 100.0).otherwise(0.0)), 4).alias("rate"))
        .filter(F.col("total") >= min_total)
    )
    return rates.join(mode_by(df, keys, category), list(keys))


def rule_counts(df: DataFrame, raw: str, label: Column, rule: Column | None = None) -> DataFrame:
    """How often each raw value got each label (and by which rule): the audit of a rule list."""
    cols = [F.col(raw).alias("raw"), label.alias("label")] + ([rule.alias("rule")] if rule is not None else [])
    out = df.select(*cols)
    return out.groupBy(*out.columns).agg(F.count(F.lit(1)).alias("n"))


def notable(df: DataFrame, rate: str, total: str, baseline: float, margin: float = 5.0, least: int = 100) -> DataFrame:
    """Segments whose rate is at least ``margin`` points over the baseline and that are large enough."""
    return df.filter((F.col(rate) >= baseline + margin) & (F.col(total) >= least))


def histogram(df: DataFrame, value: str, width: float) -> DataFrame:
    """Equi-width bins aligned to multiples of ``width``; the last bin is closed, empty bins are listed."""
    edges = df.agg(
        (F.floor(F.min(value) / width) * width).cast("double").alias("lo"),
        (F.ceil(F.max(value) / width) * width).cast("double").alias("hi"),
    ).withColumn("bins", F.greatest(F.round((F.col("hi") - F.col("lo")) / width), F.lit(1)).cast("long"))
    every = edges.filter(F.col("lo").isNotNull()).select(
        "lo", "bins", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1)).alias("bin")
    )
    counted = (
        df.filter(F.col(value).isNotNull())
        .crossJoin(F.broadcast(edges))  # one row
        .select(F.least(F.floor((F.col(value) - F.col("lo")) / width), F.col("bins") - 1).alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return every.join(counted, "bin", "left").select(
        "bin",
        (F.col("lo") + F.col("bin") * width).alias("low"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("high"),
        F.coalesce("n", F.lit(0).cast("long")).alias("n"),
    )


def spread(df: DataFrame, value: str) -> DataFrame:
    """n, median, exclusive quartiles (position p * (n + 1), clipped) and maximum.

    Ranks come from counts of the distinct values, so nothing is gathered in one row or task.
    """
    rows = df.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    total = rows.count()
    if not total:
        return rows.sparkSession.createDataFrame([], "n long, q1 double, median double, q3 double, maximum double").select("*")
    wanted = {}
    for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        at = min(max(p * (total + 1), 1.0), float(total))
        low = int(at)
        wanted[name] = (low, min(low + 1, total), at - low)
    ranked = _value_ranks(rows, "v")

    def at(i: int):
        return F.max(F.when((F.col("__before") < i) & (F.lit(i) <= F.col("__before") + F.col("__c")), F.col("v")))

    return ranked.agg(
        F.lit(total).cast("long").alias("n"),
        *[F.round(at(lo) + (at(hi) - at(lo)) * w, 6).alias(name) for name, (lo, hi, w) in wanted.items()],
        F.round(F.max("v"), 6).alias("maximum"),
    )


def _value_ranks(df: DataFrame, value: str) -> DataFrame:
    """Distinct values with how often they occur (``__c``) and how many rows come before them (``__before``).

    Values are dealt by ranges that Spark samples, so outliers do not crowd the others into one task.
    """
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("__c"))
    return running_sums(counts, [value], "__c", "__before")


def outcome_mix(df: DataFrame, keys: Sequence[str], outcome: str, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Shares of the total, in percent, of groups of outcomes."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        *[
            F.round(F.count_if(F.col(outcome).isin(*members)) * 100.0 / F.count(F.lit(1)), 4).alias(f"share_{g}")
            for g, members in groups.items()
        ],
    )


def coverage_series(own: DataFrame, other: DataFrame, year: str, partial: Sequence[int] = ()) -> DataFrame:
    """Own against external counts on the years that both have, without partial years, as a ratio."""
    a = own.groupBy(year).agg(F.sum("n").alias("own"))
    b = other.groupBy(year).agg(F.sum("n").alias("external"))
    both = a.join(b, year)
    if partial:
        both = both.filter(~F.col(year).isin(*partial))
    return both.withColumn("ratio", F.round(F.try_divide(F.col("own") * 1.0, F.col("external")), 6))


def series_summary(series: DataFrame, year: str, ratio: str) -> DataFrame:
    """Of a yearly series: the mean ratio, and the last year with its ratio."""
    return series.agg(F.avg(ratio).alias("mean_ratio"), F.max(year).alias("last_year"), F.max_by(ratio, year).alias("last_ratio"))


def extremes(df: DataFrame, name: str, value: str) -> DataFrame:
    """Group with the highest and the lowest value, and the spread."""
    order = F.struct(F.col(value), F.col(name))
    return df.filter(F.col(value).isNotNull()).agg(
        F.max_by(name, order).alias("highest"),
        F.min_by(name, order).alias("lowest"),
        F.round(F.max(value) - F.min(value), 6).alias("spread"),
    )


def usage_cost(df: DataFrame, tokens_in: str, tokens_out: str, price_in: float, price_out: float) -> DataFrame:
    """Token totals and their cost per million."""
    a, b = F.sum(tokens_in), F.sum(tokens_out)
    return df.agg(a.alias("tokens_in"), b.alias("tokens_out"), F.round((a * price_in + b * price_out) / 1e6, 6).alias("cost"))


def cross_tab(df: DataFrame, row: str, column: str, values: Sequence[str], prefix: str = "n_") -> DataFrame:
    """Counts of ``values`` of ``column`` by ``row``, 0 where a pair does not occur, and the total of all values."""
    each = [F.count_if(F.col(column) == v).alias(f"{prefix}{v}") for v in values]
    return df.groupBy(row).agg(*each, F.count(F.lit(1)).alias("total"))


def unit_rollup(df: DataFrame, keys: Sequence[str], member: str, unit: str, has: Column) -> DataFrame:
    """Units and distinct members by ``keys``, units without what ``has`` asks for, and their percentage."""
    present = F.coalesce(has, F.lit(False))
    return df.groupBy(*keys).agg(
        F.count_distinct(unit).alias("n_units"),
        F.count_distinct(member).alias("n_members"),
        F.count_if(~present).alias("n_missing"),
        F.round(F.count_if(present) * 100.0 / F.count(F.lit(1)), 4).alias("pct_present"),
    )


def tally(df: DataFrame, bucket: Column, keys: Sequence[str] = (), name: str = "bucket") -> DataFrame:
    """Rows by a derived bucket, and its percent of the rows of its ``keys``."""
    counts = df.groupBy(*keys, bucket.alias(name)).agg(F.count(F.lit(1)).alias("n"))
    whole = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__all"))
    joined = counts.join(whole, list(keys)) if keys else counts.join(F.broadcast(whole))
    return joined.withColumn("pct", F.round(F.col("n") * 100.0 / F.col("__all"), 4)).drop("__all")
