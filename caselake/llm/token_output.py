"""Token-ID output: documents packed into fixed-length id matrices.

Texts are tokenised and overlong ones split without loss; a block of pieces is packed by
best-fit-decreasing, finding the fullest bin that still has room in a segment tree over bin
capacities.  Every row is one sequence: its ids (unsigned 16-bit little-endian, padded), the cumulative
lengths of its segments, and positions that start anew with each segment.

A block is a bounded number of tokens of one input split, so nothing is shuffled: ids are written where
they were made, and a task that is run again makes the same rows from the same split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import VOCAB_DIR, table
from .tokenizer import load_byte_bpe


class CapacityTree:
    """Segment tree over free space 0..capacity: how many open bins have just so much room.

    Finds the least free space of at least ``need`` in O(log capacity).
    """

    def __init__(self, capacity: int) -> None:
        self.size = 1
        while self.size < capacity + 1:
            self.size *= 2
        self.count = [0] * (2 * self.size)

    def add(self, free: int, n: int) -> None:
        i = free + self.size
        while i:
            self.count[i] += n
            i //= 2

    def at_least(self, need: int) -> int:
        """The least free space >= ``need`` that a bin has, or -1."""
        i = need + self.size
        if self.count[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.count[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return -1


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers; items longest first, ties in the order given, each into the fullest bin with room."""
    tree, by_room, bins = CapacityTree(capacity), [[] for _ in range(capacity + 1)], []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[item]
        free = tree.at_least(n)
        if free < 0:
            free, b = capacity, len(bins)
            bins.append([])
        else:
            b = by_room[free].pop()
            tree.add(free, -1)
        bins[b].append(item)
        if free > n:
            by_room[free - n].append(b)
            tree.add(free - n, 1)
    return bins


FIELDS = (
    "n_segments int, n_tokens int, input_ids binary, cu_seqlens array<int>, position_ids binary, "
    "doc_ids array<{id}>, piece_offsets array<bigint>"
)


def packed_rows(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 2048,
    block_tokens: int = 2_000_000,
    end_id: int | None = 50256,
    pad_id: int = 50256,
    vocabulary: str = "byte_bpe_50k.tiktoken",
    vocab_dir: str = VOCAB_DIR,
) -> DataFrame:
    """One row per packed sequence of ``length`` ids.

    ``input_ids`` and ``position_ids``: ``length`` unsigned 16-bit little-endian numbers; ``cu_seqlens``
    (from 0) bounds the segments, so ``n_tokens`` is its last entry and the rest is ``pad_id`` at
    position 0.  ``doc_ids`` and ``piece_offsets`` say, for each segment, whose tokens it holds from
    which token on: a text's segments, by offset, are its tokens (``end_id`` last, if given).

    A vocabulary with ids beyond 65,535 is refused.  Null and empty texts hold only the ``end_id`` (with none, they have no segment).  Repeated rows are
    packed once each, null ids are kept; an empty table gives no rows; extra columns are not read.
    """
    if not (1 <= length < 65_536 and 0 <= pad_id < 65_536 and 0 <= (end_id or 0) < 65_536):
        raise ValueError("positions and ids must fit 16 bits")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tail = load_byte_bpe(vocab_dir, vocabulary), [] if end_id is None else [end_id]
        if encoder.largest_id > 65_535:
            raise ValueError(f"ids of {vocabulary} do not fit 16 bits")
        pieces, owners, offsets, total, id_type = [], [], [], 0, None

        def flush() -> pa.RecordBatch:
            bins = best_fit_decreasing([len(p) for p in pieces], length)
            ids = np.full((len(bins), length), pad_id, dtype="<u2")
            positions = np.zeros((len(bins), length), dtype="<u2")
            bounds = []
            for r, items in enumerate(bins):
                at, cut = 0, [0]
                for i in items:
                    n = len(pieces[i])
                    ids[r, at : at + n] = pieces[i]
                    positions[r, at : at + n] = np.arange(n)
                    at += n
                    cut.append(at)
                bounds.append(cut)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([len(b) for b in bins], pa.int32()),
                    pa.array([c[-1] for c in bounds], pa.int32()),
                    pa.array([row.tobytes() for row in ids], pa.binary()),
                    pa.array(bounds, pa.list_(pa.int32())),
                    pa.array([row.tobytes() for row in positions], pa.binary()),
                    pa.array([[owners[i] for i in b] for b in bins], pa.list_(id_type)),
                    pa.array([[offsets[i] for i in b] for b in bins], pa.list_(pa.int64())),
                ],
                ["n_segments", "n_tokens", "input_ids", "cu_seqlens", "position_ids", "doc_ids", "piece_offsets"],
            )

        for batch in batches:
            id_type = batch.schema.field(0).type
            for owner, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = np.concatenate([encoder.encode(text), tail]).astype("<u2")
                for at in range(0, len(tokens), length):
                    pieces.append(tokens[at : at + length])
                    owners.append(owner)
                    offsets.append(at)
                total += len(tokens)
                if total >= block_tokens:
                    yield flush()
                    pieces, owners, offsets, total = [], [], [], 0
        if pieces:
            yield flush()

    return docs.select(F.col(id_col), F.col(text_col).alias("__text")).mapInArrow(run, FIELDS.format(id=kind))


def write_packed(docs: DataFrame, path: str, **options) -> None:
    """Writes the packed rows as Parquet: one file of id matrices per task."""
    packed_rows(docs, **options).write.parquet(path)


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as packed sequences of 2048 token ids."""
    return packed_rows(table(spark, sf_dir, "documents").select("doc_id", "text"))
