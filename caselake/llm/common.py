"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that count as white space in every operator: space and U+0009 to U+000D.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Default folder of the public tokenizer vocabularies (a parameter wherever they are used).
VOCAB_DIR = "/opt/tokenizers"
#: Fixed value: the split pattern that the byte-level vocabularies were made with.
BYTE_BPE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(col, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    It is read from the session.  Where it is unset, a local session gets a temporary folder; on a
    cluster, where every machine has its own such folders, that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        active = spark.sparkContext._jsc.sc().getCheckpointDir()
        if active.isDefined():
            return active.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-caselake-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back.

    Cuts the lineage like ``checkpoint()`` but computes ``df`` once; the files survive the loss of
    any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    for scope in _OPEN.get():
        scope.tables.append(out)
    return out


class TableScope:
    """Notes the tables that :func:`materialize` writes while it is open, by this thread only.

    ``discard_but(keep)`` deletes them once ``keep`` holds all that was wanted of them.  Tables of other threads and of other
    scopes are left alone, so that queries may run side by side; a table written in nested scopes belongs to all of them.
    """

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def __enter__(self) -> TableScope:
        self._before = _OPEN.set((*_OPEN.get(), self))
        return self

    def __exit__(self, *error: object) -> None:
        _OPEN.reset(self._before)

    def discard_but(self, *keep: DataFrame) -> None:
        discard(*[t for t in self.tables if not any(t is k for k in keep)])
        self.tables = list(keep)


#: The open scopes of this thread.
_OPEN: ContextVar[tuple[TableScope, ...]] = ContextVar("open_table_scopes", default=())


def discard(*tables: DataFrame | None) -> None:
    """Deletes the files of tables from :func:`materialize` that nothing reads any more; others are left alone."""
    for t in tables:
        found = None if t is None else t.__dict__.pop("_written_to", None)
        if found is not None:
            spark = t.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(found)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def id_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus, F.lit(0))


def sample_fraction(df: DataFrame, bound: int, key: str) -> DataFrame:
    """About ``bound`` rows of ``df``, chosen by a hash of ``key`` (all rows where there are fewer).

    Used only to fit models; the same rows come back on every run.
    """
    n = df.count()
    if n <= bound:
        return df
    limit = int(bound / n * (1 << 20))
    return df.filter(F.pmod(F.xxhash64(F.lit(11), F.col(key)), F.lit(1 << 20)) < limit)


def map_texts(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    make: Callable[[], Callable[[list[str | None]], dict]],
    fields: str,
    block_chars: int = 8_000_000,
    block_rows: int = 2_000,
) -> DataFrame:
    """``id_col`` and ``fields`` for every row, computed from the whole text in Arrow batches.

    ``make`` is called once per task; what it returns gets a list of texts and gives a dict of
    columns of that length.  Ids pass through untouched, nulls included.  A batch is handed over in
    blocks of at most ``block_rows`` texts and about ``block_chars`` characters, so that what a
    function holds is bounded by the longest text.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    own = StructType.fromDDL(fields)
    out = StructType([docs.schema[id_col], *own.fields])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            start = 0
            while start < len(texts):
                stop, chars = start, 0
                while stop < len(texts) and stop - start < block_rows and (stop == start or chars < block_chars):
                    chars += len(texts[stop] or "")
                    stop += 1
                got = work(texts[start:stop])
                columns = [ids.slice(start, stop - start).cast(arrow.field(0).type)]
                columns += [pa.array(got[f.name], type=f.type) for f in list(arrow)[1:]]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)
                start = stop

    return docs.select(F.col(id_col), F.col(text_col).alias("__text")).mapInArrow(run, out)
