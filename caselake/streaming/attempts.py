"""Structured Streaming over an append-only log: upsert, best status, first seen."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.progress import best_status
from ..sources.stored import StoredTable


def read_log(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def stream_upsert(stream: DataFrame, target: str, checkpoint: str, key: str, order: Sequence[str], buckets: int = 16) -> DataFrame:
    """Merges each micro-batch into a :class:`StoredTable` at ``target``; returns its state when the input is used up.

    A batch is the version of its number: it rewrites the buckets of its keys only, and one that comes again after a failure
    changes nothing.  A start without new files returns what earlier ones have left.
    """
    spark, schema = stream.sparkSession, stream.schema

    def merge(batch: DataFrame, batch_id: int) -> None:
        StoredTable(batch.sparkSession, target, key, order, schema, buckets).merge(batch, batch_id)

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return StoredTable(spark, target, key, order, schema, buckets).read()


def stream_best_status(stream: DataFrame, checkpoint: str, target: str, keys: Sequence[str], status: str, ranking: Mapping[str, int], names: Sequence[str], default: str, extra: Sequence[Column] = ()) -> DataFrame:
    """Running best status per key in update mode; returns the last state of every key.

    What a batch updates is merged into a :class:`StoredTable`, so the target holds one row a key however many batches ran.
    """
    spark = stream.sparkSession
    state = best_status(stream, keys, status, ranking, names, default, extra)
    own = F.to_json(F.struct(*keys)).alias("__key")
    schema = state.select(own, "*", F.lit(0).cast("long").alias("__batch")).schema

    def put(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(own, "*", F.lit(batch_id).cast("long").alias("__batch"))
        StoredTable(batch.sparkSession, target, "__key", ["__batch"], schema).merge(rows, batch_id)

    query = (
        state.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return StoredTable(spark, target, "__key", ["__batch"], schema).read().select(*state.columns)


def stream_first_seen(stream: DataFrame, checkpoint: str, target: str, keys: Sequence[str], event_time: str, delay: str) -> DataFrame:
    """Rows whose key was not seen within ``delay`` before; returns what was written."""
    spark = stream.sparkSession
    fresh = stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))
    query = fresh.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)
