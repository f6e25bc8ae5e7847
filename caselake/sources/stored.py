"""Keyed tables on a file system: upserts that rewrite only the buckets they touch and survive a stop at any step.

Layout of a table's folder::

    data/v=N/bucket=B/*.parquet    rows of bucket B, as version N wrote them
    commits/N.json                 for every bucket the version that holds it; written last

A version exists once its commit does.  A merge reads the buckets that its rows fall in, writes them anew under its own version
and then commits; buckets without new rows keep the version they had.  Whatever a stopped merge left is overwritten by
its next attempt, and a commit that cannot be read counts as none.  Files that the last two commits do not name are deleted.
One writer at a time; readers see the last commit.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.incremental import upsert


class StoredTable:
    """One row a key, the latest by ``order``; ``buckets`` is fixed by the first commit."""

    def __init__(self, spark: SparkSession, path: str, key: str, order: Sequence[str], schema: StructType, buckets: int = 16):
        self.spark, self.path, self.key, self.order, self.schema = spark, path.rstrip("/"), key, list(order), schema
        self.buckets = buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def merge(self, rows: DataFrame, version: int | None = None) -> int:
        """Upserts ``rows``; returns the version that holds them.

        ``version``: a number that names the input, as of a stream's batch; a merge of a version that is committed changes
        nothing, so a batch may come again.  Without it the next number is taken.  Rows without a key are skipped; of equal
        keys the latest by ``order`` stays, new rows win ties.  No rows make a version that names the same files.
        """
        last, held, buckets = self._last()
        version = last + 1 if version is None else version
        if version <= last:
            return last
        own = rows.sparkSession
        rows = rows.select(*self.schema.names).filter(F.col(self.key).isNotNull())
        bucket = F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int")
        touched = sorted(r[0] for r in rows.select(bucket.alias("b")).distinct().collect())
        if touched:
            base = self._read(own, {b: held[b] for b in touched if b in held})
            merged = upsert(base, rows, self.key, self.order).select(*self.schema.names, bucket.alias("bucket"))
            merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/v={version}")
        self._commit(version, {**held, **{b: version for b in touched}}, buckets)
        self._clean()
        return version

    def read(self) -> DataFrame:
        """The rows of the last commit; none where there is no commit."""
        return self._read(self.spark, self._last()[1])

    def _read(self, spark: SparkSession, held: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/data/v={v}/bucket={b}" for b, v in sorted(held.items())]
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def _versions(self, folder: str) -> list[int]:
        at = self._path(f"{self.path}/{folder}")
        names = [s.getPath().getName() for s in self._files.listStatus(at)] if self._files.exists(at) else []
        numbers = [n.removeprefix("v=").removesuffix(".json") for n in names]
        return sorted(int(n) for n in numbers if n.isdigit())

    def _held(self, version: int) -> dict | None:
        stream = self._files.open(self._path(f"{self.path}/commits/{version}.json"))
        try:
            reader = self.spark._jvm.java.io.BufferedReader(self.spark._jvm.java.io.InputStreamReader(stream, "UTF-8"))
            return json.loads(reader.readLine() or "")
        except ValueError:
            return None
        finally:
            stream.close()

    def _last(self) -> tuple[int, dict[int, int], int]:
        """Number of the last commit (-1: none), the version of each bucket, and the number of buckets."""
        for version in reversed(self._versions("commits")):
            found = self._held(version)
            if found is not None:
                return version, {int(b): v for b, v in found["held"].items()}, found["buckets"]
        return -1, {}, self.buckets

    def _commit(self, version: int, held: dict[int, int], buckets: int) -> None:
        stream = self._files.create(self._path(f"{self.path}/commits/{version}.json"), True)
        try:
            stream.write(bytearray(json.dumps({"buckets": buckets, "held": held}).encode() + b"\n"))
        finally:
            stream.close()

    def _clean(self) -> None:
        commits = self._versions("commits")
        named: set[int] = set()
        for version in commits[-2:]:
            named |= {version, *((self._held(version) or {}).get("held", {}).values())}
        for version in commits[:-2]:
            self._files.delete(self._path(f"{self.path}/commits/{version}.json"), False)
        for version in self._versions("data"):
            if version not in named and version <= commits[-1]:
                self._files.delete(self._path(f"{self.path}/data/v={version}"), True)


def manifest_upsert(path: str, rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Puts ``rows`` into the manifest at ``path``, one row a key, and returns the manifest.

    A run that is stopped leaves the manifest of the last finished one; no step deletes rows that only it holds.
    """
    stored = StoredTable(rows.sparkSession, path, key, order, rows.schema)
    stored.merge(rows)
    return stored.read()
