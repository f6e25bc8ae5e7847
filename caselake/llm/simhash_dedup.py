"""SimHash near-dedup through a segment-popcount embedding.

A 64-bit fingerprint is cut into segments; the counts of set bits per segment are its coordinates.
The Manhattan distance of two embeddings never exceeds the Hamming distance of the fingerprints, so
it prunes without losing a link.  The range join within ``radius`` runs on a grid: segments are
dealt into ``radius + m`` blocks, of which at least ``m`` must be equal for any two points within the
radius, so every choice of ``m`` blocks gives one cell.  ``m`` follows the number of fingerprints, so that cells stay small;
the result does not depend on it.  Pairs that meet in a cell are held against the Manhattan bound and then
verified exactly on the bits.

Copies are one fingerprint class from the start, and dense groups are joined through hubs
(:mod:`.cells`): neither is expanded into pairs.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cells import deal, hot_keys, linked_components, shared_cells
from .common import discard, map_texts, materialize, sample_fraction, table
from .components import join_per_key

BITS = 64
#: For comparisons of whole numbers with multiples of a similarity.
SLACK = 1e-6


def shingle_hashes(text: str | None, shingle_words: int) -> np.ndarray:
    """XXH64 (seed 42) of every word shingle, repeats included; none without a word.

    Fewer words than ``shingle_words``: the whole sequence is the one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    view = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    k = min(shingle_words, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist(), strict=True)
    return np.array([digest(view[i:j], 42) for i, j in spans], dtype=np.uint64)


def majority_bits(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half the hashes; as a signed 64-bit integer."""
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(">i8")[0])


#: Least segments of the hash range whose members are counted for a whole set.
SEGMENTS = 128
#: Hashes that a segment of a larger set holds at most, on average.
PER_SEGMENT = 4


def segments_for(n: int) -> int:
    """Segments for a set of ``n`` hashes, a power of two: with a fixed number, the counts of unlike large sets come to lie within the bound."""
    return max(SEGMENTS, 1 << (max(1, -(-n // PER_SEGMENT)) - 1).bit_length())


def segment_counts(hashes: np.ndarray, segments: int = SEGMENTS) -> bytes:
    """How many hashes of a set lie in each of ``segments`` equal parts of their range; counts end at 255.

    The popcounts by segment of the set written as bits: the Manhattan distance of two sets' counts never exceeds
    the number of hashes that only one of them has.
    """
    shift = np.uint64(64 - (segments - 1).bit_length())
    return np.minimum(np.bincount((hashes >> shift).astype(np.int64), minlength=segments), 255).astype(np.uint8).tobytes()


def counts_apart(xs: list[bytes], ys: list[bytes], block: int = 256) -> np.ndarray:
    """The Manhattan distance of every two sets' counts, the finer ones added up to the segments of the coarser; ``block`` pairs at a time."""
    apart = np.zeros(len(xs), dtype=np.int64)
    sizes = np.array([(len(x), len(y)) for x, y in zip(xs, ys, strict=True)]).reshape(-1, 2)
    for own in np.unique(sizes, axis=0):
        same = np.flatnonzero((sizes == own).all(axis=1))
        for at in (same[i : i + block] for i in range(0, len(same), block)):
            raw = (np.frombuffer(b"".join(c[i] for i in at), np.uint8).reshape(len(at), own.min(), -1) for c in (xs, ys))
            x, y = (c.sum(axis=2, dtype=np.int32) for c in raw)
            apart[at] = np.abs(x - y).sum(axis=1)
    return apart


def fingerprint(text: str | None, shingle_words: int) -> int:
    """SimHash of the word shingles, as a signed 64-bit integer; 0 without a word."""
    return majority_bits(shingle_hashes(text, shingle_words))


def with_fingerprint(docs: DataFrame, id_col: str, text_col: str, shingle_words: int) -> DataFrame:
    """``(id, fp)`` for every row."""

    def make():
        return lambda texts: {"fp": [fingerprint(t, shingle_words) for t in texts]}

    return map_texts(docs, id_col, text_col, make, "fp bigint").withColumnRenamed(id_col, "id")


def _signed(n: int) -> int:
    return n - (1 << BITS) if n >= 1 << (BITS - 1) else n


def embedding(fp: Column, width: int) -> Column:
    """The popcount of every segment of ``width`` bits, each written as so many ones at the low end of its segment.

    Two embeddings differ in as many bits as their counts' Manhattan distance.
    """
    if width == 1:
        return fp
    if width == 2:
        low, high = F.lit(_signed(0x5555555555555555)), F.lit(_signed(0xAAAAAAAAAAAAAAAA))
        any_bit = fp.bitwiseOR(F.shiftrightunsigned(fp, 1)).bitwiseAND(low)
        return any_bit.bitwiseOR(fp.bitwiseAND(F.shiftleft(fp, 1)).bitwiseAND(high))
    out = F.lit(0).cast("long")
    for at in range(0, BITS, width):
        ones = F.bit_count(fp.bitwiseAND(F.lit(_signed((1 << width) - 1 << at & (1 << BITS) - 1))))
        filled = F.call_function("shiftleft", F.lit(1).cast("long"), ones) - 1
        out = out.bitwiseOR(F.shiftleft(filled, at))
    return out


def blocks_to_agree(n: int, radius: int, segment_width: int) -> int:
    """How many blocks make a cell for ``n`` fingerprints: members of all grids against pairs that meet by chance.

    A segment of a random fingerprint agrees with another's as often as two binomial counts do.
    """
    alike = sum(math.comb(segment_width, i) ** 2 for i in range(segment_width + 1)) / 4**segment_width
    segments = math.ceil(BITS / segment_width)

    def cost(m: int) -> float:
        return math.comb(radius + m, m) * n * (1 + 0.05 * n * alike ** (segments * m / (radius + m)))

    return min(range(1, max(1, min(5, segments - radius)) + 1), key=cost)


def grid_cells(fps: DataFrame, radius: int, segment_width: int, agree: int) -> DataFrame:
    """``(key, node)``: a row for every choice of ``agree`` out of ``radius + agree`` blocks of the segments of ``fp``.

    Keys are hashes of the chosen coordinates; two cells with one key are one larger cell.
    """
    n_blocks, n_segments = radius + agree, math.ceil(BITS / segment_width)
    if n_segments < n_blocks:
        raise ValueError("radius and segment_width leave a block without a segment")
    segment = [(1 << segment_width) - 1 << at & (1 << BITS) - 1 for at in range(0, BITS, segment_width)]
    blocks = [sum(segment[i::n_blocks]) for i in range(n_blocks)]
    masks = [_signed(sum(chosen)) for chosen in combinations(blocks, agree)]
    placed = fps.select("fp", embedding(F.col("fp"), segment_width).alias("e"))
    keys = [F.xxhash64(F.lit(t), F.col("e").bitwiseAND(F.lit(m))) for t, m in enumerate(masks)]
    return placed.select(F.explode(F.array(*keys)).alias("key"), F.col("fp").alias("node"))


def within_radius(a: Column, b: Column, radius: int, segment_width: int) -> Column:
    """The Manhattan bound on the embeddings, then the bits themselves."""
    bound = F.bit_count(embedding(a, segment_width).bitwiseXOR(embedding(b, segment_width)))
    return (bound <= radius) & (F.bit_count(a.bitwiseXOR(b)) <= radius)


def similar_fingerprints(fps: DataFrame, radius: int = 4, segment_width: int = 2) -> DataFrame:
    """Pairs ``(a, b)``, ``a < b``, of distinct values of column ``fp`` at ``radius`` or fewer bits.

    This lists every pair; where only components are wanted, :func:`fingerprint_components` spares those of dense groups.
    """
    distinct = fps.select("fp").filter(F.col("fp").isNotNull()).distinct()
    cells = grid_cells(distinct, radius, segment_width, blocks_to_agree(distinct.count(), radius, segment_width))
    left, right = cells.select("key", F.col("node").alias("a")), cells.select("key", F.col("node").alias("b"))
    near = (F.col("a") < F.col("b")) & within_radius(F.col("a"), F.col("b"), radius, segment_width)
    return left.join(right, "key").filter(near).select("a", "b").distinct()


def fingerprint_components(fps: DataFrame, radius: int = 4, segment_width: int = 2) -> DataFrame:
    """``(fp, root)`` of every distinct ``fp``: the smallest fingerprint reachable over links of ``radius`` or fewer bits."""
    distinct = materialize(fps.select("fp").filter(F.col("fp").isNotNull()).distinct(), "fingerprint_classes")
    agree = blocks_to_agree(distinct.count(), radius, segment_width)
    cells = shared_cells(grid_cells(distinct, radius, segment_width, agree))

    def bound(x, y) -> Column:
        return within_radius(x("node"), y("node"), radius, segment_width)

    # the bound is the exact check already
    roots = linked_components(cells, [], bound, lambda pairs: pairs)
    discard(cells)
    return distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("component", "fp").alias("root")
    )


def near_duplicate_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 4,
    radius: int = 4,
    segment_width: int = 2,
) -> DataFrame:
    """``(id_col, fp, component_id)`` per row of ``docs``.

    ``component_id`` is the smallest id that can be reached over links of ``radius`` or fewer
    differing bits, the row's own id included.  Rows without a word have fingerprint 0 and link like
    any other; repeated rows come back once each; ties do not arise, since the smallest id names
    a component.  A null id takes part in linking but never names a component unless all ids there are null.
    An empty table gives an empty table; extra columns are not read.
    """
    fps = materialize(with_fingerprint(docs, id_col, text_col, shingle_words), "fingerprints")
    roots = materialize(fingerprint_components(fps, radius, segment_width), "roots")
    classes = fps.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    named = classes.join(roots, "fp")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    by_fp = join_per_key(named.select("fp", "root", F.col("n").alias("rows")), least, "root")
    return join_per_key(fps, by_fp.select("fp", "component_id", F.col("rows").alias("n")), "fp").select(
        F.col("id").alias(id_col), "fp", "component_id"
    )


def similar_text_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 5,
    similarity: float = 0.8,
    radius: int = 4,
) -> DataFrame:
    """``(id_col, component_id)`` per row: groups of texts linked by a Jaccard similarity of shingle sets.

    Texts with equal sets (a digest of 128 bits) are one class (copies).  The classes' fingerprints, over sets, go through
    the popcount embedding first (:func:`fingerprint_components`); each class is held against its group's
    smallest one on the whole sets, so that equal fingerprints alone link nothing.

    A similarity of 0.8 allows for some 10 differing bits, which no radius catches surely.  The rest comes from a
    prefix-filtered set join, which loses no pair: the hashes of every set are put in one order, and two sets of
    the similarity share one of the first ``n - ceil(similarity * n) + 1`` of each.  Each of these is a cell
    (:mod:`.cells`).  Pairs that meet in a cell and are not in one component yet are held against the bounds on lengths and on positions
    in the order, then against the Manhattan bound on popcounts by segment (:func:`segment_counts`), then on the whole sets.  The order is by hash, but shingles that are frequent in a sample come last
    (:func:`frequent_shingles`).

    Null and empty texts are one class.  Repeated rows come back once each.  Rows that share an id but not a text have one
    component; in links the text with the smallest hash stands for them.  A null id takes part in no link but among equal sets.
    An empty table gives an empty table; extra columns are not read.
    """
    frequent = frequent_shingles(docs, id_col, text_col, shingle_words)

    def make():
        def work(texts: list[str | None]) -> dict:
            out = {"text_hash": [], "digest": [], "n": [], "fp": [], "counts": [], "cells": []}
            for t in texts:
                held = np.unique(shingle_hashes(t, shingle_words))
                late = np.isin(held, frequent)
                order = np.concatenate((held[~late], held[late]))
                out["text_hash"].append(text_hash(t))
                out["digest"].append(xxhash.xxh3_128_digest(held.tobytes()))
                out["n"].append(len(held))
                out["fp"].append(majority_bits(held))
                out["counts"].append(segment_counts(held, segments_for(len(held))))
                out["cells"].append(order[: len(held) - math.ceil(similarity * len(held) - SLACK) + 1].view(np.int64))
            return out

        return work

    made = map_texts(docs, id_col, text_col, make, "text_hash bigint, digest binary, n int, fp bigint, counts binary, cells array<bigint>", block_chars=1_000_000)
    sets = materialize(made, "shingle_sets").withColumnRenamed(id_col, "id")
    # one row of each id, then one id of each digest
    rows = sets.select("id", "text_hash", "digest", "n", "fp", "counts")
    firsts = rows.groupBy("id").agg(F.min(F.struct("text_hash", "digest", "n", "fp", "counts")).alias("r")).select("id", "r.*")
    classes = materialize(
        firsts.groupBy("digest").agg(
            F.min("id").alias("cls"), F.min_by("text_hash", "id").alias("text_hash"), F.first("n").alias("n_shingles"),
            F.first("fp").alias("fp"), F.first("counts").alias("counts"), F.count(F.lit(1)).alias("n"),
        ),
        "classes",
    )
    # the cells of one row of each class; those of one member, and those of texts without a word, are of no use
    lone = classes.filter(F.col("cls").isNotNull() & (F.col("n_shingles") > 0))
    known = sets.select("id", "text_hash", "digest", "cells", "n").join(
        lone.select("digest", "text_hash", F.col("cls").alias("id")), ["digest", "id", "text_hash"], "left_semi"
    )
    members = known.select(F.col("id").alias("node"), "n", F.posexplode("cells").alias("pos", "key")).select(
        "key", "node", (F.col("n") - F.col("pos")).alias("left"), "n"
    )
    cells = shared_cells(members.dropDuplicates(["key", "node"]) if _ids_repeat(sets) else members)

    def close(n: Column, m: Column) -> Column:
        return F.least(n, m) >= similarity * F.greatest(n, m) - SLACK

    def bound(x, y) -> Column:
        reach = similarity / (1 + similarity) * (x("n") + y("n")) - SLACK
        return close(x("n"), y("n")) & (F.least(x("left"), y("left")) >= reach)

    sketches = lone.select(F.col("cls").alias("id"), F.col("n_shingles").alias("n"), "counts")

    def verify(pairs: DataFrame) -> DataFrame:
        if pairs.isEmpty():
            return pairs
        close_ones = materialize(within_counts(pairs, sketches, similarity), "close")
        links = verified_pairs(docs, id_col, text_col, close_ones, shingle_words, similarity)
        if links is not close_ones:
            discard(close_ones)
        return links

    groups = lone.join(fingerprint_components(lone, radius), "fp").select("cls", "n_shingles", "root")
    hubs = groups.groupBy("root").agg(
        F.min(F.struct("cls", "n_shingles")).alias("hub"), F.count(F.lit(1)).alias("n")
    )
    star = (
        join_per_key(groups, hubs, "root")
        .filter((F.col("cls") != F.col("hub.cls")) & close(F.col("n_shingles"), F.col("hub.n_shingles")))
        .select(F.col("cls").alias("a"), F.col("hub.cls").alias("b"))
    )
    star = materialize(star, "pairs")
    roots = linked_components(cells, ["n", "left"], bound, verify, verify(star))
    named = classes.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select(
        "digest", "n", F.coalesce("component", "cls").alias("component_id")
    )
    by_id = join_per_key(firsts.select("id", "digest"), named, "digest")
    return (
        sets.select("id")
        .join(by_id.select(F.col("id").alias("own"), "component_id"), F.col("id").eqNullSafe(F.col("own")))
        .select(F.col("id").alias(id_col), "component_id")
    )


def within_counts(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` whose popcounts by segment allow for the similarity.

    Sets of ``n`` and ``m`` hashes at a Jaccard similarity of ``s`` or more differ in ``(n + m) (1 - s) / (1 + s)`` at most.
    ``sketches``: ``id``, ``n`` and ``counts``.
    """
    import pyarrow as pa

    kind = dict(pairs.dtypes)["a"]
    both = pairs.select("a", "b")
    for end in ("a", "b"):
        both = both.join(sketches.select(F.col("id").alias(end), F.col("n").alias(f"n_{end}"), F.col("counts").alias(f"c_{end}")), end)
    both = both.select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"), "c_a", "c_b")

    def run(batches):
        for batch in batches:
            apart = counts_apart(batch.column(3).to_pylist(), batch.column(4).to_pylist())
            keep = apart <= batch.column(2).to_numpy() * ((1 - similarity) / (1 + similarity)) + SLACK
            chosen = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([chosen.column(0), chosen.column(1)], ["a", "b"])

    return both.mapInArrow(run, f"a {kind}, b {kind}")


def text_hash(text: str | None) -> int:
    """A signed 64-bit hash that tells apart the texts of rows with one id."""
    return int(np.uint64(xxhash.xxh64_intdigest((text or "").encode("utf-8", "surrogatepass"), 42)).view(np.int64))


def _ids_repeat(sets: DataFrame) -> bool:
    """Whether a row occurs twice: then a class has several rows with the same cells."""
    return bool(sets.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).limit(1).count())


def frequent_shingles(
    docs: DataFrame, id_col: str, text_col: str, shingle_words: int, sample: int = 10_000, least: int = 10, most: int = 100_000
) -> np.ndarray:
    """Hashes of at most ``most`` shingles that ``least`` or more of about ``sample`` texts hold, in ascending order.

    They only set the order of a prefix join: whatever is in the list, no pair is lost.
    """
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for t in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(t, shingle_words)).view(np.int64))], ["key"])

    texts = sample_fraction(docs.select(id_col, text_col), sample, id_col).select(text_col)
    counts = texts.mapInArrow(run, "key bigint").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    rows = counts.orderBy(F.desc("n"), "key").limit(most).select("key").toArrow()
    return np.sort(rows["key"].to_numpy().astype(np.int64).view(np.uint64))


def verified_pairs(
    docs: DataFrame, id_col: str, text_col: str, pairs: DataFrame, shingle_words: int, similarity: float, most_broadcast: int = 1_000_000
) -> DataFrame:
    """The pairs ``(a, b)`` of ids whose texts' shingle sets (by their 64-bit hashes) have the Jaccard similarity.

    ``pairs`` is read several times, so it should be a written table.  Only texts of the pairs are shuffled: up to
    ``most_broadcast`` ids of pairs they are found by a broadcast of the ids, beyond that by a join of all rows on the id.  An end
    ``b`` with many partners is dealt into parts.
    """
    import pyarrow as pa

    kind, n_pairs = dict(pairs.dtypes)["a"], pairs.count()
    if not n_pairs:
        return pairs
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    wanted = F.broadcast(ends) if 2 * n_pairs <= most_broadcast else ends
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("id").isNotNull())
    found = source.join(wanted, "id", "left_semi").withColumn("text", F.coalesce("text", F.lit("")))
    # of the rows of an id the one that similar_text_classes takes too
    texts = materialize(found.groupBy("id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("r")).select("id", "r.text"), "texts")
    hot = hot_keys(pairs, "b")
    dealt = deal(pairs.select("a", "b"), hot, "b", "a").select("a", "b", "part")
    # the text of b once for its part, before those of its partners: a row holds one text
    heads = dealt.select("b", "part").distinct().join(texts.withColumnRenamed("id", "b"), "b")
    partners = dealt.join(texts.withColumnRenamed("id", "a"), "a").select("b", "part", "a", "text")
    both = heads.select("b", "part", F.lit(None).cast(kind).alias("a"), "text").unionByName(partners)
    both = both.repartition("b", "part").sortWithinPartitions("b", "part", F.asc_nulls_first("a"))

    def run(batches):
        held = None
        for batch in batches:
            keep = []
            for a, text in zip(batch.column(2), batch.column(3), strict=True):
                mine = np.unique(shingle_hashes(text.as_py(), shingle_words))
                if not a.is_valid:
                    held = mine
                    keep.append(False)
                    continue
                common = len(np.intersect1d(mine, held, assume_unique=True))
                keep.append(common >= similarity * (len(mine) + len(held) - common) - SLACK)
            chosen = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([chosen.column(2), chosen.column(0)], ["a", "b"])

    links = materialize(both.mapInArrow(run, f"a {kind}, b {kind}"), "links")
    discard(texts)
    return links


def keep_one_per_class(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id names their class: one document of each group stays.

    ``classes``: ``id_col`` and ``component_id``.  Rows that share an id are one document; of such rows all stay if
    that id stays.
    """
    keep = (
        classes.filter(F.col(id_col).eqNullSafe(F.col("component_id")))
        .select(F.col(id_col).alias("__simhash_id"))
        .distinct()
    )
    return docs.join(keep, F.col(id_col).eqNullSafe(F.col("__simhash_id")), "left_semi")


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = near_duplicate_classes(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
