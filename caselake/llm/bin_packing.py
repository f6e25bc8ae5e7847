"""Variable-capacity best-fit packing.

Documents are packed into sequences of several permitted lengths.  Within a shard, items go longest
first into the open bin that they fill best; where none has room, a bin is opened: of the size of least
cost per token that the pieces still to come can fill, so that the sizes follow the demand that is left.  Opening always the size of
least cost per token, or always one permitted size, is tried too; the cheapest outcome over the whole shard is kept, and at the end
each bin is downsized to the smallest permitted length that holds its contents.

Shards are dealt by a hash of the id; their number follows the input, so a shard's lengths (not its
texts) fit in one task whatever the size of the table.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import VOCAB_DIR, map_texts, materialize, table
from .tokenizer import load_byte_bpe

Piece = tuple[int, int]  # item, offset in it


def split_item(length: int, largest: int) -> list[tuple[int, int]]:
    """(offset, length) pieces of at most ``largest`` that cover an item without loss; none for length 0."""
    return [(at, min(largest, length - at)) for at in range(0, length, largest)]


def pack_into(pieces: list[tuple[int, int, int]], open_size: Callable[[int, int], int], capacities: Sequence[int], cost):
    """Best-fit decreasing; ``open_size`` says which size to open for a piece that no bin has room for, given the tokens
    of this piece and all after it.

    ``pieces``: (length, item, offset), longest first.  Returns the total cost after downsizing and
    the bins, each a list of pieces.
    """
    room: list[tuple[int, int]] = []  # (free, bin), ascending
    bins: list[list[tuple[int, int, int]]] = []
    left = sum(p[0] for p in pieces)
    for piece in pieces:
        length = piece[0]
        at = bisect_left(room, (length, -1))
        if at < len(room):
            free, b = room.pop(at)
            bins[b].append(piece)
        else:
            free, b = open_size(length, left), len(bins)
            bins.append([piece])
        left -= length
        if free > length:
            insort(room, (free - length, b))
    total = sum(cost(downsized(sum(p[0] for p in b), capacities)) for b in bins)
    return total, bins


def opening_policies(capacities: Sequence[int], cost: Callable[[int], float]) -> list[Callable[[int, int], int]]:
    """By the demand left: the size of least cost per token that the remaining pieces can fill.  Then the size of least cost per
    token, and for each permitted size: that size, or the least that holds the piece."""

    def by_demand(n: int, left: int) -> int:
        return min((c for c in capacities if c >= n), key=lambda c: (cost(c) / min(c, left), c))

    def cheapest(n: int, left: int) -> int:
        return min((c for c in capacities if c >= n), key=lambda c: (cost(c) / c, c))

    return [by_demand, cheapest, *[lambda n, left, c=c: next(x for x in capacities if x >= max(n, c)) for c in capacities]]


def downsized(used: int, capacities: Sequence[int]) -> int:
    return next(c for c in capacities if c >= used)


def pack_jointly(items: list[tuple[int, int]], capacities: Sequence[int], cost: Callable[[int], float]):
    """The cheapest packing over all opening policies: bins of (length, item, offset), in order of opening.

    ``items``: (item, length); ties go by item, so the outcome does not depend on the order given.
    """
    capacities = sorted(set(capacities))
    pieces = [(n, item, at) for item, length in items for at, n in split_item(length, capacities[-1])]
    pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
    best = None
    for open_size in opening_policies(capacities, cost):
        got = pack_into(pieces, open_size, capacities, cost)
        if best is None or got[0] < best[0]:
            best = got
    return best[1] if best else []


def sequence_cost(overhead: float = 64.0, quadratic: float = 1 / 16384) -> Callable[[int], float]:
    """Cost of a sequence: a fixed overhead, its length, and attention that grows with the square."""
    return lambda c: overhead + c + quadratic * c * c


def shard_count(total: int, rows: int, shard_tokens: int, shard_rows: int) -> int:
    return max(1, math.ceil(total / shard_tokens), math.ceil(rows / shard_rows))


def pack(
    lengths: DataFrame,
    id_col: str = "doc_id",
    length_col: str = "n_tokens",
    capacities: Sequence[int] = (512, 1024, 2048, 4096, 8192),
    cost: Callable[[int], float] | None = None,
    shard_tokens: int = 16_000_000,
    shard_rows: int = 100_000,
) -> DataFrame:
    """One row per piece: ``id_col``, ``piece`` offset, length, bin, bin capacity and place in the bin.

    Columns: ``shard``, ``bin`` (from 0 in its shard), ``capacity``, ``used``, ``start`` (place in the bin),
    ``id_col``, ``piece_offset``, ``piece_length``.  Items longer than the largest capacity are split
    without loss.  Null or non-positive lengths (empty texts) give one row with null bin columns and
    length 0, so no row is lost; repeated rows are packed once each, spread over all shards.  An empty table gives an empty table.
    Which shard a row is dealt to depends on how the input is split; a task that is run again makes the same rows.
    """
    if not capacities or min(capacities) <= 0:
        raise ValueError("capacities must be positive")
    cost = cost or sequence_cost()
    kind = lengths.schema[id_col].dataType.simpleString()
    rows = lengths.select(F.col(id_col).alias("id"), F.coalesce(F.col(length_col), F.lit(0)).cast("long").alias("n"))
    total, n_rows = rows.filter(F.col("n") > 0).agg(F.sum("n"), F.count(F.lit(1))).first()
    n_shards = shard_count(total or 0, n_rows, shard_tokens, shard_rows)
    # the running number spreads rows that are alike in id and length
    number = F.monotonically_increasing_id()
    dealt = rows.filter(F.col("n") > 0).withColumn("shard", F.pmod(F.xxhash64("id", "n", number), F.lit(n_shards)).cast("int"))
    schema = (
        f"shard int, bin bigint, capacity int, used int, start int, id {kind}, piece_offset bigint, piece_length int"
    )

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("id", "ascending"), ("n", "ascending")]).combine_chunks()
        n = group.column("n").to_pylist()
        bins = pack_jointly(list(enumerate(n)), capacities, cost)
        out = {k: [] for k in ("bin", "capacity", "used", "start", "item", "piece_offset", "piece_length")}
        for b, pieces in enumerate(bins):
            used = sum(p[0] for p in pieces)
            size, start = downsized(used, sorted(capacities)), 0
            for length, item, at in pieces:
                for k, v in zip(out, (b, size, used, start, item, at, length), strict=True):
                    out[k].append(v)
                start += length
        take = pa.array(out.pop("item"), pa.int64())
        ids = group.column("id").combine_chunks().take(take)
        shard = pa.array([group.column("shard")[0].as_py()] * len(take), pa.int32())
        return pa.table(
            {
                "shard": shard,
                "bin": pa.array(out["bin"], pa.int64()),
                **{k: pa.array(out[k], pa.int32()) for k in ("capacity", "used", "start")},
                "id": ids,
                "piece_offset": pa.array(out["piece_offset"], pa.int64()),
                "piece_length": pa.array(out["piece_length"], pa.int32()),
            }
        )

    packed = dealt.groupBy("shard").applyInArrow(run, schema)
    nothing = rows.filter(F.col("n") <= 0).select(
        *[F.lit(None).cast(t).alias(c) for c, t in (("shard", "int"), ("bin", "bigint"), ("capacity", "int"), ("used", "int"), ("start", "int"))],
        "id",
        F.lit(0).cast("bigint").alias("piece_offset"),
        F.lit(0).alias("piece_length"),
    )
    return packed.unionByName(nothing).withColumnRenamed("id", id_col)


def token_lengths(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = "byte_bpe_50k.tiktoken",
    vocab_dir: str = VOCAB_DIR,
) -> DataFrame:
    """``id_col`` and ``n_tokens`` of every whole text (null: 0)."""

    def make():
        encoder = load_byte_bpe(vocab_dir, vocabulary)
        return lambda texts: {"n_tokens": [encoder.count(t) for t in texts]}

    return map_texts(docs, id_col, text_col, make, "n_tokens bigint")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Packs ``docs`` by the token lengths of their texts; see :func:`pack`."""
    return pack(materialize(token_lengths(docs, id_col, text_col), "lengths"), id_col, **options)


def op4_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in sequences of 512 to 8192 tokens."""
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
