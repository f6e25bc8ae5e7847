"""Suffix-array dedup: bytes covered by a string of ``span`` bytes that starts elsewhere too are removed.

Prefix doubling ranks positions by growing strings: a round pairs the rank of the string so far with the bytes that
extend it, Spark sorts the distinct pairs, and their order gives the next rank.  Positions whose pair is unique leave;
the others go on until the strings are ``span`` bytes long.

Three facts keep the rounds small, and none loses a match.

* Every string of ``span`` bytes contains an anchor: the leftmost of its 48-byte grams with the least hash.  Equal strings
  have it at the same place, so the first round ranks anchors (about one byte in eighty) for all starts they stand for.
* Anchors whose whole neighbourhoods agree (all strings they stand for) repeat as a whole.  One member stands for such a
  class in later rounds, so copies cost no more than their anchors.
* Starts of an anchor travel in blocks of 16, then 4, then 1, with strings of ``span - 15``, ``span - 3`` and ``span``
  bytes.  A block whose strings and surroundings agree in all members is settled at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, table
from .components import join_per_key

#: Bytes of an anchor's gram, and starts of a block.
GRAM, BLOCK = 48, 16
#: Bytes of a text that are hashed at once.
PIECE = 1 << 22
#: Numbers of document keys are looked up by broadcast modulo this.
BUCKETS = 1 << 20

_ODD, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all grams of ``GRAM`` bytes, by doubling the length of the hashed strings."""
    with np.errstate(over="ignore"):
        h, power, length, held = (data.astype(np.uint64) + np.uint64(1)) * _ODD, _STEP, 1, {}
        while length * 2 <= GRAM:
            held[length] = (h, power)
            h, power, length = h[:-length] * power + h[length:], power * power, length * 2
        if length < GRAM:
            tail, tail_power = held[GRAM - length]
            n = len(data) - GRAM + 1
            h = h[:n] * tail_power + tail[length : length + n]
        h = (h ^ (h >> np.uint64(32))) * _ODD
        return h ^ (h >> np.uint64(29))


def anchors(data: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(anchor, hash, first start, last start)``: every start of a ``span`` bytes string, dealt to its anchor.

    The anchor of a start is the leftmost gram in its string whose hash has the least upper half.
    """
    found: list[tuple[np.ndarray, ...]] = []
    window = span - GRAM + 1
    for base in range(0, len(data) - span + 1, PIECE):
        piece = data[base : base + PIECE + span - 1]
        h = gram_hashes(piece)
        least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while width < window:
            step = min(width, window - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        last = np.r_[first[1:], len(at)] - 1
        here = at[first]
        found.append((here + base, h[here], first + base, last + base))
    if not found:
        empty = np.empty(0, np.int64)
        return empty, empty.astype(np.uint64), empty, empty
    at, h, first, last = (np.concatenate(c) for c in zip(*found))
    # an anchor whose starts were cut by the end of a piece is one anchor
    new = np.r_[True, at[1:] != at[:-1]]
    ends = np.r_[np.flatnonzero(new)[1:], len(at)] - 1
    return at[new], h[new], first[new], last[ends]


def covered(starts: list[tuple[int, int]], span: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes under strings that start in the given ranges."""
    runs: list[list[int]] = []
    for first, last in sorted(starts):
        if runs and first <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], last + span)
        else:
            runs.append([first, last + span])
    return [(a, b) for a, b in runs]


def _anchor_rows(docs: DataFrame, span: int) -> DataFrame:
    """``id, th, a, lo, hi, key, ctx`` for every anchor; ``ctx`` tells apart what surrounds it, as far as its starts reach."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = StructType([docs.schema["id"], *StructType.fromDDL("th int, a int, lo int, hi int, key long, ctx long").fields])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            rows, columns, n = [], [], 0
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_py()
                if text is not None and len(text) >= span:
                    a, h, lo, hi = anchors(np.frombuffer(text, np.uint8), span)
                    ctx = [xxh3_64_intdigest(text[s : e + span], p - s) for p, s, e in zip(a.tolist(), lo.tolist(), hi.tolist())]
                    columns.append((a, lo, hi, h.view(np.int64), np.array(ctx, np.uint64).view(np.int64)))
                    rows.append(np.full(len(a), i))
                    n += len(a)
                if rows and (n > 100_000 or i + 1 == batch.num_rows):
                    take = pa.array(np.concatenate(rows))
                    own = [batch.column(0).take(take).cast(arrow.field(0).type), batch.column(1).take(take)]
                    both = [np.concatenate(c) for c in zip(*columns)]
                    own += [pa.array(c, type=arrow.field(j + 2).type) for j, c in enumerate([c.astype(np.int32) for c in both[:3]] + both[3:])]
                    yield pa.RecordBatch.from_arrays(own, schema=arrow)
                    rows, columns, n = [], [], 0

    return docs.select("id", "th", "text").mapInArrow(run, out)


def _block_rows(texts: DataFrame, span: int) -> DataFrame:
    """``id, th, rank, a, b, core, left, right`` for the blocks of the anchors listed in ``reps``.

    Block ``b`` of anchor ``a`` holds the starts ``a - t`` for ``t`` from ``16 b`` to ``16 b + 15``: ``core`` is what their strings share,
    ``left`` and ``right`` what they reach beyond, cut where the text ends.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = StructType([texts.schema["id"], *StructType.fromDDL("th int, rank long, a int, b int, core binary, left binary, right binary").fields])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, got = [], []
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_py()
                for r in batch.column(3)[i].as_py():
                    a = r["a"]
                    for b in range((a - r["hi"]) // BLOCK, (a - r["lo"]) // BLOCK + 1):
                        start, end = a - BLOCK * b, a + span - BLOCK * b - BLOCK + 1
                        left, right = text[max(0, start - BLOCK + 1) : start], text[end : end + BLOCK - 1]
                        got.append((r["rank"], a, b, text[start:end], left, right))
                        rows.append(i)
                if rows and (len(rows) > 20_000 or i + 1 == batch.num_rows):
                    take = pa.array(rows)
                    own = [batch.column(0).take(take).cast(arrow.field(0).type), batch.column(1).take(take)]
                    yield pa.RecordBatch.from_arrays(own + [pa.array(c, type=arrow.field(j + 2).type) for j, c in enumerate(zip(*got))], schema=arrow)
                    rows, got = [], []

    return texts.select("id", "th", "text", "reps").mapInArrow(run, out)


def _ranked(rows: DataFrame, pair: list[str], around: Column | None = None) -> DataFrame:
    """A round: pairs met more than once, in sorted order, with their ``rank`` and count ``n``; ``alike``: all agree in ``around`` too."""
    measures = [F.count(F.lit(1)).alias("n")]
    if around is not None:
        measures += [F.min(around).alias("__least"), F.max(around).alias("__most")]
    repeated = rows.groupBy(*pair).agg(*measures).filter(F.col("n") > 1)
    if around is not None:
        repeated = repeated.withColumn("alike", F.col("__least") == F.col("__most")).drop("__least", "__most")
    ordered = repeated.repartitionByRange(*pair).sortWithinPartitions(*pair)
    return materialize(ordered.withColumn("new", F.monotonically_increasing_id()), "ranks")


def _met(rows: DataFrame, ranks: DataFrame, pair: list[str]) -> DataFrame:
    """Rows whose pair is repeated, with the new rank in place of the pair; a number ``b`` of the block stays."""
    keyed = join_per_key(rows.withColumn("__k", F.struct(*pair)).drop(*[c for c in pair if c != "b"]), ranks.withColumn("__k", F.struct(*pair)).drop(*pair), "__k")
    return keyed.drop("__k").withColumnRenamed("new", "rank")


def repeated_starts(docs: DataFrame, span: int = 200) -> DataFrame:
    """``id, th, first, last``: ranges of starts of strings of ``span`` bytes that also start elsewhere.

    ``docs``: ``id``, ``th`` and ``text`` (binary, or null); ``id`` and ``th`` tell rows apart unless they are copies.
    """
    if span < GRAM + 2 * BLOCK:
        raise ValueError(f"span must be at least {GRAM + 2 * BLOCK} bytes")
    every = materialize(_anchor_rows(docs, span), "anchors")
    ranks = _ranked(every, ["key"])
    near = materialize(_met(every, ranks, ["key"]), "anchors").drop("n")
    discard(every, ranks)
    # anchors that agree in all their surroundings: they repeat, and one of them stands for all
    surroundings = near.groupBy("rank", "ctx").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("id", "th", "a", "lo", "hi")])
    surroundings = materialize(surroundings, "surroundings")
    pair = F.struct("rank", "ctx")
    twice = surroundings.filter(F.col("n") > 1).select(pair.alias("__k"), "n")
    ranges = [join_per_key(near.withColumn("__k", pair), twice, "__k").select("id", "th", F.col("lo").alias("first"), F.col("hi").alias("last"))]

    mixed = surroundings.groupBy("rank").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    listed = join_per_key(surroundings.drop("n"), mixed, "rank").groupBy("id", "th").agg(F.collect_list(F.struct("rank", "a", "lo", "hi")).alias("reps"))
    listed = materialize(listed, "listed")
    bucket = F.pmod(F.xxhash64("id", "th"), F.lit(BUCKETS))
    some = F.broadcast(listed.select(bucket.alias("__bucket")).distinct())
    texts = docs.withColumn("__bucket", bucket).join(some, "__bucket", "left_semi").drop("__bucket")
    listed = listed.select(F.col("id").alias("__id"), F.col("th").alias("__th"), "reps")
    texts = texts.join(listed, F.col("id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")))
    blocks = _block_rows(texts, span).withColumn("h", F.xxhash64("core")).withColumn("g", F.xxhash64(F.lit(5), "core"))
    blocks = materialize(blocks.select("id", "th", "a", "b", "rank", "h", "g", "left", "right"), "blocks")

    def step(rows: DataFrame, pair: list[str], low: Column, size: int) -> DataFrame:
        """Ranks the pairs; blocks that agree all around are settled, the rest is returned."""
        ranks = _ranked(rows, pair, F.xxhash64("left", "right"))
        found = materialize(_met(rows, ranks, pair), "blocks")
        discard(ranks)
        whole = (F.length("left") >= size - 1) & (F.length("right") >= size - 1)
        ranges.append(found.filter(F.col("alike") & whole).select("id", "th", (F.col("a") - low - size + 1).alias("first"), (F.col("a") - low).alias("last")))
        return found.filter(~(F.col("alike") & whole)).select("id", "th", "a", "b", "rank", "left", "right")

    # strings of span - 15 bytes
    rest = step(blocks, ["rank", "b", "h", "g"], F.col("b") * BLOCK, BLOCK)
    # of span - 3 bytes: the fourth q of a block takes 4q bytes from the left and 12 - 4q from the right
    fourths = rest.withColumn("q", F.explode(F.expr("sequence(0, 3)"))).filter("length(left) >= 4 * q and length(right) >= 12 - 4 * q")
    fourths = fourths.select(
        "id", "th", "a", "b", "rank", "q",
        F.expr("concat(substring(left, length(left) - 4 * q + 1, 4 * q), substring(right, 1, 12 - 4 * q))").alias("more"),
        F.expr("substring(left, greatest(length(left) - 4 * q - 2, 1), length(left) - 4 * q - greatest(length(left) - 4 * q - 2, 1) + 1)").alias("left"),
        F.expr("substring(right, 13 - 4 * q, 3)").alias("right"),
    )
    rest = step(fourths.withColumn("b", F.col("b") * 4 + F.col("q")).drop("q"), ["rank", "b", "more"], F.col("b") * 4, 4)
    # of span bytes: single starts
    single = rest.withColumn("s", F.explode(F.expr("sequence(0, 3)"))).filter("length(left) >= s and length(right) >= 3 - s")
    single = single.select("id", "th", "rank", "s", (F.col("a") - F.col("b") * 4 - F.col("s")).alias("first"), F.expr("concat(substring(left, length(left) - s + 1, s), substring(right, 1, 3 - s))").alias("more"))
    ends = _met(single, _ranked(single, ["rank", "s", "more"]), ["rank", "s", "more"])
    ranges.append(ends.select("id", "th", "first", F.col("first").alias("last")))
    out = ranges[0]
    for r in ranges[1:]:
        out = out.unionByName(r)
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 200) -> DataFrame:
    """``id_col, kept (binary), n_bytes, n_removed, n_spans, spans (array of start and end)`` for every row.

    A byte goes if a string of ``span`` bytes that covers it also starts anywhere else, in the same text or in another; all
    such strings are judged on the texts as they came.  Texts are UTF-8 bytes, so what is kept may begin or end within a character.

    Null text is empty; texts shorter than ``span`` stay whole.  Repeated rows are copies of each other, so all of their bytes go
    (from ``span`` bytes on); rows that share an id but not a text, and rows without an id, are told apart by their text.  Other columns
    are never read.  An empty table gives an empty table.  Anchor neighbourhoods and cores are compared by 128 bits of hashes.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    source = docs.select(F.col(id_col).alias("id"), F.hash(text_col).alias("th"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    starts = repeated_starts(source, span).distinct().groupBy("id", "th").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    starts = starts.select(F.col("id").alias("__id"), F.col("th").alias("__th"), "ranges")
    both = source.join(starts, F.col("id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")), "left").select("id", "text", "ranges")
    out = StructType([source.schema["id"], *StructType.fromDDL("kept binary, n_bytes long, n_removed long, n_spans long, spans array<struct<start: int, end: int>>").fields])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for i in range(batch.num_rows):
                text, ranges = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                runs = covered([(r["first"], r["last"]) for r in ranges or []], span)
                kept = [text[a:b] for a, b in zip([0] + [e for _, e in runs], [s for s, _ in runs] + [len(text)])]
                spans = [{"start": s, "end": e} for s, e in runs]
                got.append((b"".join(kept), len(text), sum(e - s for s, e in runs), len(runs), spans))
            columns = list(zip(*got)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(arrow.field(0).type)] + [pa.array(c, type=arrow.field(j + 1).type) for j, c in enumerate(columns)], schema=arrow
            )

    return both.mapInArrow(run, out).withColumnRenamed("id", id_col)


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the bytes kept, for every document."""
    kept = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
