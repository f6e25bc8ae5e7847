"""Reconciliation of two geographies and proportional allocation."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bridge_rows(df: DataFrame, authority: str, area: str, status: str, keep: Sequence[str], override: DataFrame | None = None) -> DataFrame:
    """Authority to area pairs of accepted statuses, with overrides for authorities that have one, without repeats."""
    rows = df.filter(F.col(status).isin(*keep)).select(F.col(authority).alias("authority"), F.col(area).alias("area"))
    if override is not None:
        mine = override.select("authority", "area")
        rows = rows.join(mine.select("authority").distinct(), "authority", "left_anti").unionByName(mine)
    return rows.filter(F.col("area").isNotNull()).distinct()


def area_bridge(
    df: DataFrame,
    authority: str,
    area: str,
    status: str,
    keep: Sequence[str],
    key: Callable[[Column], Column],
    suffix: str = "",
    successors: Mapping[str, str] | None = None,
    direct: Mapping[str, str] | None = None,
) -> DataFrame:
    """``(authority, area)``, each pair once: the rows of accepted statuses, and the ``direct`` pairs on top of them.

    Authorities are trimmed and lower-cased; areas are trimmed, lose ``suffix``, are written by ``key``, and give way to their successor where
    ``successors`` has one.  Rows with a blank authority or area go.
    """
    plain = F.trim(F.col(area))
    bare = F.when(plain.endswith(suffix), F.substring(plain, F.lit(1), F.length(plain) - len(suffix))).otherwise(plain) if suffix else plain
    name = key(bare)
    if successors:
        name = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in successors.items() for x in kv]), name), name)
    rows = df.filter(F.trim(F.col(status)).isin(*keep) & (bare != "")).select(F.lower(F.trim(F.col(authority))).alias("authority"), name.alias("area"))
    if direct:
        rows = rows.unionByName(df.sparkSession.createDataFrame(list(direct.items()), "authority string, area string"))
    return rows.filter((F.col("authority") != "") & F.col("area").isNotNull()).distinct()


def area_matrix(own: DataFrame, bridge: DataFrame, external: DataFrame, years: Sequence[int], summary: tuple[int, int]) -> DataFrame:
    """Own counts by area and year beside external ones, one row per area, with a tag.

    ``own``: (authority, year, n); ``bridge``: (authority, area); ``external``: (area, year, n).  An authority outside the bridge stands for
    the area of its name, if there is one; else it has a row of its own, tagged ``unmapped``.  The counts of an authority of several
    areas are split by their external totals, equally where these are 0, and rounded half to even.  Other tags: ``matched``, ``right_only`` (no own
    counts), ``left_only``.  ``pct``: own in percent of external within the years of ``summary``, null without external counts.
    """
    mine, theirs = [F.col(f"own_{y}") for y in years], [F.col(f"ext_{y}") for y in years]
    plus = lambda cols: sum(cols, F.lit(0).cast("long"))

    def wide(df: DataFrame, key: str, prefix: str) -> DataFrame:
        sums = [F.coalesce(F.sum(F.when(F.col("year") == y, F.col("n"))), F.lit(0)).cast("long").alias(f"{prefix}_{y}") for y in years]
        return df.groupBy(key).agg(*sums, F.count_if(F.col("year").between(years[0], years[-1])).alias(f"{prefix}_rows"))

    authorities, areas = wide(own, "authority", "own"), wide(external, "area", "ext").withColumn("weight", plus(theirs))
    outside = authorities.select("authority").join(bridge, "authority", "left_anti")
    same = outside.join(areas.select(F.col("area").alias("authority")), "authority", "left_semi").withColumn("area", F.col("authority"))
    pairs = bridge.unionByName(same).join(areas.select("area", "weight"), "area", "left")
    by_authority = Window.partitionBy("authority")
    total, k = F.sum(F.coalesce("weight", F.lit(0))).over(by_authority), F.count(F.lit(1)).over(by_authority)
    share = F.when(total > 0, F.coalesce("weight", F.lit(0)) / total).otherwise(F.lit(1.0) / k)
    dealt = pairs.select("authority", "area", share.alias("share"), (k > 1).alias("joint")).join(authorities, "authority")
    split = [F.sum(F.bround(c * F.col("share"), 0).cast("long")).alias(f"own_{y}") for c, y in zip(mine, years, strict=True)]
    members = [F.array_join(F.array_sort(F.collect_set("authority")), "; ").alias("authorities"), F.count_distinct("authority").alias("n_authorities")]
    left = dealt.groupBy("area").agg(*split, *members, F.max("joint").alias("joint"))
    right = areas.filter(F.col("ext_rows") > 0).drop("ext_rows", "weight")
    lone = outside.join(same.select("authority"), "authority", "left_anti").join(authorities, "authority").select(
        F.col("authority").alias("area"), *mine, F.col("authority").alias("authorities"), F.lit(1).cast("long").alias("n_authorities"), F.lit(False).alias("joint"), F.lit(True).alias("lone")
    )
    # the areas of lone authorities are no external ones, so they stay apart from the others
    both = left.withColumn("lone", F.lit(False)).join(right, "area", "full_outer").unionByName(lone, allowMissingColumns=True)
    filled = both.select("area", "authorities", "n_authorities", "joint", "lone", *[F.coalesce(c, F.lit(0).cast("long")).alias(f"{p}_{y}") for p, cs in (("own", mine), ("ext", theirs)) for c, y in zip(cs, years, strict=True)])
    inside = [i for i, y in enumerate(years) if summary[0] <= y <= summary[1]]
    own_sum, ext_sum = plus([mine[i] for i in inside]), plus([theirs[i] for i in inside])
    tag = (
        F.when(F.col("lone"), "unmapped")
        .when((plus(theirs) > 0) & (plus(mine) > 0), "matched")
        .when(plus(theirs) > 0, "right_only")
        .otherwise("left_only")
    )
    return filled.select(
        "area", tag.alias("match"), F.coalesce("authorities", F.lit("")).alias("authorities"), F.coalesce("n_authorities", F.lit(0).cast("long")).alias("n_authorities"),
        F.coalesce("joint", F.lit(False)).alias("joint"), *mine, *theirs, plus(theirs).alias("external"), F.when(ext_sum > 0, F.round(own_sum * 100.0 / ext_sum, 1)).alias("pct"),
    )


def build_bridge(authorities: DataFrame, name: str, joint: Mapping[str, Sequence[str]], no_area: Sequence[str], aliases: Mapping[str, str], areas: DataFrame, area: str, key: Column) -> DataFrame:
    """(authority, area, status), one row per area, in the order of priority: joint, no area, alias, name, unmatched.

    ``key`` normalises a column called ``__name``.
    """
    pairs = [F.lit(x) for k, v in joint.items() for x in (k, "|".join(v))] or [F.lit(""), F.lit("")]
    alias = [F.lit(x) for kv in aliases.items() for x in kv] or [F.lit(""), F.lit("")]
    col = F.col(name)
    status = (
        F.when(col.isin(*joint), "joint")
        .when(col.isin(*no_area), "no_area")
        .when(F.element_at(F.create_map(*alias), col).isNotNull(), "alias")
    )
    wanted = F.coalesce(F.element_at(F.create_map(*pairs), col), F.element_at(F.create_map(*alias), col), col)
    rows = authorities.select(name, status.alias("__s"), F.explode(F.split(wanted, r"\|")).alias("__name")).withColumn("__k", key)
    known = areas.select(F.col(area).alias("area"), F.col(area).alias("__name")).select("area", key.alias("__k")).groupBy("__k").agg(F.min("area").alias("area"))
    joined = rows.join(known, "__k", "left")
    final = F.when(F.col("__s") == "no_area", "no_area").when(F.col("area").isNull(), "unmatched").otherwise(F.coalesce("__s", F.lit("matched")))
    return joined.select(name, F.when(F.col("__s").eqNullSafe("no_area"), F.lit(None)).otherwise(F.col("area")).alias("area"), final.alias("status"))


def coverage(own: DataFrame, bridge: DataFrame, external: DataFrame, years: tuple[int, int]) -> DataFrame:
    """Own rows per area against external counts, within a range of years; areas without external counts go.

    ``own``: (authority, year, n); ``external``: (area, year, n).  Both sides are added up before they meet.
    """
    inside = F.col("year").between(*years)
    a = own.filter(inside).join(bridge, "authority").groupBy("area").agg(F.sum("n").alias("own"))
    b = external.filter(inside).groupBy("area").agg(F.sum("n").alias("external"))
    return a.join(b, "area").filter(F.col("external") > 0).withColumn("coverage", F.round(F.col("own") / F.col("external"), 6))


def roll_up(df: DataFrame, parent: str) -> DataFrame:
    """Coverage of parents from that of their members."""
    return df.groupBy(parent).agg(
        F.sum("own").alias("own"), F.sum("external").alias("external"), F.count(F.lit(1)).alias("members"),
        F.round(F.try_divide(F.sum("own") * 1.0, F.sum("external")), 6).alias("coverage"),
    )


def reconcile(left: DataFrame, right: DataFrame, keys: Sequence[str], left_n: Sequence[str], right_n: Sequence[str]) -> DataFrame:
    """Full outer join with a tag: matched, left_only or right_only; missing counts are 0."""
    a = left.select(*keys, *left_n, F.lit(True).alias("__l"))
    b = right.select(*keys, *right_n, F.lit(True).alias("__r"))
    tag = F.when(F.col("__l") & F.col("__r"), "matched").when(F.col("__l"), "left_only").otherwise("right_only")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in (*left_n, *right_n)]
    return a.join(b, list(keys), "full_outer").select(*keys, *counts, tag.alias("match"))


def year_matrix(df: DataFrame, keys: Sequence[str], year: str, n: str, years: Sequence[int]) -> DataFrame:
    """Counts pivoted to one column per listed year, and their total."""
    wide = df.groupBy(*keys).pivot(year, list(years)).agg(F.sum(n))
    cols = [F.coalesce(F.col(str(y)), F.lit(0).cast("long")) for y in years]
    return wide.select(*keys, *[c.alias(f"y{y}") for c, y in zip(cols, years, strict=True)], sum(cols, F.lit(0).cast("long")).alias("total"))


def allocate_by_share(parents: DataFrame, children: DataFrame, parent: str, n: str, weight: str, out: str = "allocated") -> DataFrame:
    """Splits a parent's count over its children by weight, equally where all weights are 0; half-even rounding."""
    whole = Window.partitionBy(parent)
    total, members = F.sum(weight).over(whole), F.count(F.lit(1)).over(whole)
    share = F.when(total > 0, F.col(weight) / total).otherwise(1.0 / members)
    return children.withColumn("__share", share).join(parents.select(parent, n), parent).withColumn(out, F.bround(F.col(n) * F.col("__share"), 0).cast("long")).drop("__share")


def allocate_equally(df: DataFrame, parent: str, n: str, out: str = "allocated") -> DataFrame:
    """1/k of the parent's count to each of its k rows, half-up rounding."""
    return df.withColumn(out, F.floor(F.col(n) / F.count(F.lit(1)).over(Window.partitionBy(parent)) + 0.5))


def common_years(*sides: DataFrame, below: int | None = None) -> DataFrame:
    """First and last year, and number of years, that all sides (column ``year``) have, of those before ``below``."""
    years = sides[0].select("year")
    for other in sides[1:]:
        years = years.intersect(other.select("year"))
    if below is not None:
        years = years.filter(F.col("year") < below)
    return years.distinct().agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count(F.lit(1)).alias("n_years"))


def match_statuses(df: DataFrame, authority: str, status: str, n: str, order: Sequence[str]) -> DataFrame:
    """Rows by status, and authorities and their counts with each authority taken once, by its first row in ``order``."""
    place = F.row_number().over(Window.partitionBy(authority).orderBy(*order))
    first = F.col("__rn") == 1
    return df.withColumn("__rn", place).groupBy(status).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(first).alias("n_authorities"), F.sum(F.when(first, F.col(n)).otherwise(0)).alias("n_apps")
    )
