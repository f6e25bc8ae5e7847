"""Scans, lookups, statistics files and sinks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalars import suppressed_number


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_file_order(df: DataFrame, name: str) -> DataFrame:
    """A table just read from Parquet files, with the place of each row in them: the file's path, then the row in it."""
    return df.withColumn(name, F.struct("_metadata.file_path", "_metadata.row_index"))


def scan(df: DataFrame, columns: Sequence[str], optional: Sequence[str] = (), equals: Mapping[str, object] | None = None) -> DataFrame:
    """Projection with optional equality filters; an optional column that is missing comes as null."""
    for name, value in (equals or {}).items():
        df = df.filter(F.col(name) == value)
    have = set(df.columns)
    return df.select(*columns, *[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in optional])


def lookup(df: DataFrame, key: str, value: str, order: str | None = None) -> DataFrame:
    """Two-column lookup: blank keys go, the last row of a key (by ``order``, else the largest value) wins."""
    rows = df.filter(F.trim(key) != "")
    last = F.max_by(value, order) if order else F.max(value)
    return rows.groupBy(F.trim(key).alias(key)).agg(last.alias(value))


def read_lookup(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    rows = spark.read.csv(path, header=True).select(key, value, F.monotonically_increasing_id().alias("__row"))
    return lookup(rows, key, value, "__row")


def year_counts(df: DataFrame, year: str, n: str) -> DataFrame:
    """(year, n) as numbers; rows where either is blank or no integer are skipped."""
    out = df.select(F.trim(year).try_cast("int").alias("year"), F.trim(n).try_cast("long").alias("n"))
    return out.dropna()


def area_year_counts(df: DataFrame, name: str, code: str, year: str, n: str, key: Column, order: str) -> DataFrame:
    """Counts by normalised area and year, with the first display name and code."""
    rows = df.withColumn("area_key", key)
    return rows.groupBy("area_key", F.col(year).alias("year")).agg(
        F.sum(n).alias("n"), F.min_by(name, order).alias("area_name"), F.min_by(code, order).alias("area_code")
    )


def suppressed_stats(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Wide yearly statistics to (keys, year, value): the year is the first number of four digits in a header,
    suppression markers become null."""
    wide = [F.struct(F.regexp_extract(F.lit(c), r"(\d{4})", 1).cast("int").alias("year"), suppressed_number(F.col(f"`{c}`")).alias("value")) for c in columns]
    return df.select(*keys, F.explode(F.array(*wide)).alias("x")).select(*keys, "x.year", "x.value")


def read_suppressed_stats(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    raw = spark.read.csv(path, header=True, multiLine=True)
    tidy = raw.toDF(*[" ".join(c.split()) for c in raw.columns])
    return suppressed_stats(tidy, keys, [c for c in tidy.columns if c not in keys])


def read_json_records(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_partitioned(df: DataFrame, path: str, by: Sequence[str]) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def report_columns(df: DataFrame) -> DataFrame:
    """Cells as a report writes them: one decimal, lists joined by pipes, no tabs or line breaks, TRUE / FALSE."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            c = F.format_string("%.1f", F.round(c, 1).cast("double"))
            c = F.when(F.col(f"`{name}`").isNotNull(), c)
        elif kind.startswith("array"):
            c = F.array_join(c.cast("array<string>"), "|")
        elif kind == "boolean":
            c = F.when(c, "TRUE").when(~c, "FALSE")
        elif kind == "string":
            c = F.trim(F.regexp_replace(c, r"[\t\r\n]+", " "))
        out.append(c.alias(name))
    return df.select(*out)


def write_report(df: DataFrame, path: str, kind: str = "tsv") -> None:
    ready = report_columns(df)
    if kind == "json":
        ready.write.mode("overwrite").json(path)
    elif kind in ("csv", "tsv"):
        ready.write.mode("overwrite").csv(path, header=True, sep="\t" if kind == "tsv" else ",")
    else:
        raise ValueError(f"unknown kind of report: {kind}")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below the cluster's shared one (``spark.checkpoint.dir``); a local session without one gets a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="spark-caselake-")
    return f"{shared.rstrip('/')}/{uuid.uuid4().hex}"
