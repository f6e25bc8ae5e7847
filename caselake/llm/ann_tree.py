"""Approximate nearest neighbours in a hierarchical k-means tree.

The tree is fitted on a bounded sample; every vector is then filed in a leaf by descending to the
nearest centre at each level.  A query walks the tree best-bin-first: a priority queue holds branches by
the distance of their centres, so leaves come out roughly nearest first.  How many leaves a query
visits is calibrated: for sample queries the true neighbours are found by brute force over all rows,
and the number of visits is widened until the wanted share of them lies in visited leaves.  Leaves lie
in blocks of a bounded number of rows; a block holds its visitors against the rows of the leaves that
they visit and gives each its nearest, so what is shuffled follows the queries, not the candidates.

Distances inside a block are first taken quickly, by a matrix product on vectors from which the sample's mean is
subtracted.  Every row that the rounding of this product could place among the nearest is then measured on the original vectors,
so that ranks, distances and ties are those of the plain formula.

Vectors with the same components are one entry with its smallest ids, as many as an answer can need,
so a vector that a third of the rows share is neither one huge leaf nor a loss.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialize, sample_fraction, table


#: Components beyond this are clipped for the tree and for quick distances, so that no square overflows.
LIMIT = 1e100


def bounded(x: np.ndarray) -> np.ndarray:
    return np.clip(x, -LIMIT, LIMIT)


def beyond(x: np.ndarray) -> np.ndarray:
    """Rows that :func:`bounded` changes."""
    return (np.abs(x) > LIMIT).any(axis=1)


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances; where a square overflows, the differences are scaled first."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = np.sqrt(((x - q) ** 2).sum(axis=1))
    for i in np.flatnonzero(~np.isfinite(out)):
        half = np.abs(x[i] / 2 - q / 2)
        with np.errstate(over="ignore"):
            out[i] = 2 * half.max() * np.sqrt(((half / half.max()) ** 2).sum())
    return out


@dataclass
class Node:
    centers: np.ndarray | None = None
    children: list[Node] = field(default_factory=list)
    leaf: int = -1


@dataclass
class Tree:
    root: Node
    n_leaves: int
    mean: np.ndarray

    def file(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of every vector."""
        out = np.empty(len(vectors), dtype=np.int64)
        todo = [(self.root, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            if node.leaf >= 0:
                out[rows] = node.leaf
            elif len(rows):
                near = _nearest(vectors[rows], node.centers)
                todo += [(child, rows[near == i]) for i, child in enumerate(node.children)]
        return out

    def visit(self, query: np.ndarray, n: int) -> list[int]:
        """The first ``n`` leaves, best bin first."""
        queue, tick, leaves = [(0.0, 0, self.root)], 0, []
        while queue and len(leaves) < n:
            _, _, node = heapq.heappop(queue)
            while node.leaf < 0:
                away = ((node.centers - query) ** 2).sum(axis=1)
                best = int(away.argmin())
                for i, child in enumerate(node.children):
                    if i != best:
                        tick += 1
                        heapq.heappush(queue, (float(away[i]), tick, child))
                node = node.children[best]
            leaves.append(node.leaf)
        return leaves


def _nearest(vectors: np.ndarray, centers: np.ndarray) -> np.ndarray:
    out = np.empty(len(vectors), dtype=np.int64)
    norms = (centers**2).sum(axis=1)
    for at in range(0, len(vectors), 8192):
        out[at : at + 8192] = (norms - 2 * vectors[at : at + 8192] @ centers.T).argmin(axis=1)
    return out


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    centers = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = _nearest(x, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
    return centers


def grow(sample: np.ndarray, branching: int, leaf_rows: int, seed: int = 7) -> Tree:
    """A tree whose leaves hold at most ``leaf_rows`` sample vectors each, unless they are all alike."""
    rng, count = np.random.default_rng(seed), 0

    def build(rows: np.ndarray) -> Node:
        nonlocal count
        if len(rows) > leaf_rows:
            x = sample[rows]
            centers = np.unique(_kmeans(x, min(branching, len(rows)), rng), axis=0)
            near = _nearest(x, centers)
            used = np.unique(near)
            if len(used) > 1:
                return Node(centers[used], [build(rows[near == i]) for i in used])
        count += 1
        return Node(leaf=count - 1)

    root = build(np.arange(len(sample)))
    if not len(sample):
        return Tree(root, count, np.zeros(0))
    # rows far larger than most would take all precision from the others
    sizes = np.abs(sample).max(axis=1)
    return Tree(root, count, sample[sizes <= 1e3 * np.median(sizes)].mean(axis=0))


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)


def rounding_reach(norms: np.ndarray, own: np.ndarray, dim: int) -> np.ndarray:
    """A bound on the error of squared distances taken as ``|x|^2 - 2 qx + |q|^2``, by query and row.

    A sum of ``dim`` products, in any order, is off by less than ``dim + 1`` roundings of the sum of their sizes; the four terms' sizes add up to
    ``(|x| + |q|)^2`` at most, and subtracting the mean before costs some roundings more.
    """
    sizes = np.sqrt(norms)[None, :] + np.sqrt(own)[:, None]
    return 4 * (dim + 8) * np.finfo(np.float64).eps * sizes**2


def nearest_rows(quick: np.ndarray, reach: np.ndarray, k: int, clipped: np.ndarray | bool = False) -> np.ndarray:
    """Every row that may be among the ``k`` nearest when ``quick`` is off by ``reach`` at most; infinite ones are out.

    Distances of ``clipped`` rows may be larger than ``quick`` by any amount.
    """
    far = np.where(clipped, np.inf, quick + reach)
    limit = np.partition(far, k - 1)[k - 1] if len(far) > k else np.inf
    return np.flatnonzero((quick - reach <= limit) & np.isfinite(quick))


def valid_vectors(df: DataFrame, vec_col: str) -> DataFrame:
    """Rows whose vector is neither null, empty nor zero and has finite components only."""
    v = F.col(vec_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df.filter(v.isNotNull() & (F.size(v) > 0) & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0))


def nearest_neighbours(
    df: DataFrame,
    queries: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 10,
    target_recall: float = 0.95,
    sample_rows: int = 65_536,
    rows_per_leaf: int = 64,
    rows_per_block: int = 4_096,
    queries_per_group: int = 4_096,
    most_leaves: int = 16_384,
    branching: int = 8,
    calibration_queries: int = 64,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``id_col`` and ``score`` (Euclidean distance) of the ``k`` nearest found.

    Every row of ``queries`` (same columns as ``df``, rows of it) is held against all rows of ``df``
    but those with its own id.  Ties go to the smaller id.  Rows with a null id, and vectors that
    are null, empty, zero, of another length than most, or hold null or non-finite components, take no part.
    Repeated rows with one id and vector are one candidate; a query id with several vectors asks with the smallest.  Fewer candidates than ``k``: all of
    them come back.  Components of any finite size are measured exactly; a distance beyond the doubles is infinite.  An empty table gives
    an empty result.  Extra columns are not read.

    The tree is fitted on about ``sample_rows`` rows and has at most about ``most_leaves`` leaves, so
    what tasks get as a broadcast is bounded; all rows are filed in it.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()

    def tidy(x: DataFrame) -> DataFrame:
        return valid_vectors(x.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")), "v").filter(
            F.col("id").isNotNull()
        )

    sizes = tidy(df).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = spark.createDataFrame([], f"query_id {kind}, rank int, {id_col} {kind}, score double")
    if sizes is None:
        return empty
    dim, n = sizes["d"], sizes["count"]
    base = tidy(df).filter(F.size("v") == dim)
    asked = materialize(tidy(queries).filter(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v")), "ann-queries")

    chosen = sample_fraction(base, sample_rows, "id").orderBy("id").select("v").toArrow()["v"].combine_chunks()
    sample = bounded(_vectors(chosen, dim))
    wanted = min(most_leaves, max(1, math.ceil(n / rows_per_leaf)))
    tree = grow(sample, branching, max(1, len(sample) // wanted))

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaves = tree.file(bounded(_vectors(b.column(1), dim))) if b.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(leaves)], ["id", "v", "leaf"])

    entries = distinct_vectors(base, k + 1)
    index = materialize(entries.mapInArrow(filed, f"id array<{kind}>, v array<double>, leaf bigint"), "ann-index")

    visits = calibrate(base, asked, tree, dim, k, target_recall, calibration_queries)

    # leaves are dealt to blocks of about rows_per_block rows; a larger leaf is spread over several blocks
    counts = {r["leaf"]: r["n"] for r in index.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
    first, parts = deal_blocks(counts, tree.n_leaves, rows_per_block)
    leaf_block = F.get(F.lit(first), F.col("leaf").cast("int")) + F.pmod(
        F.xxhash64("v"), F.get(F.lit(parts), F.col("leaf").cast("int"))
    )
    # the visitors of a block come in groups of bounded size, each of which meets all rows of the block
    groups = max(1, math.ceil(asked.count() / queries_per_group))
    stored = index.select(
        leaf_block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "leaf", "id", "v"
    )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, blocks, leaves = [], [], []
            for i, q in enumerate(bounded(_vectors(b.column(1), dim)) if b.num_rows else ()):
                own: dict[int, list[int]] = {}
                for leaf in tree.visit(q, visits):
                    for block in range(first[leaf], first[leaf] + parts[leaf]):
                        own.setdefault(block, []).append(leaf)
                at += [i] * len(own)
                blocks += own.keys()
                leaves += own.values()
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(rows),
                    b.column(1).take(rows),
                    pa.array(blocks, pa.int64()),
                    pa.array(leaves, pa.list_(pa.int64())),
                ],
                ["query_id", "q", "block", "leaves"],
            )

    probes = (
        asked.select("id", "v")
        .mapInArrow(walk, f"query_id {kind}, q array<double>, block bigint, leaves array<bigint>")
        .withColumn("group", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int"))
    )

    def nearest_in_block(asking: pa.Table, held: pa.Table) -> pa.Table:
        out_q, out_id, out_d = [], [], []
        if asking.num_rows and held.num_rows:
            x = _vectors(held.column("v").combine_chunks(), dim)
            leaf, ids = held.column("leaf").to_numpy(), held.column("id").to_pylist()
            centred, large = bounded(x) - tree.mean, beyond(x)
            norms = (centred**2).sum(axis=1)
            query_ids, all_leaves = asking.column("query_id").to_pylist(), asking.column("leaves").to_pylist()
            q = _vectors(asking.column("q").combine_chunks(), dim)
            for at in range(0, len(q), 128):
                part, wide = bounded(q[at : at + 128]) - tree.mean, beyond(q[at : at + 128])
                own_norms = (part**2).sum(axis=1)
                quick = norms + own_norms[:, None] - 2 * (part @ centred.T)
                reach = rounding_reach(norms, own_norms, dim)
                for j, row in enumerate(quick):
                    row[~np.isin(leaf, all_leaves[at + j])] = np.inf
                    near = nearest_rows(row, reach[j], k + 1, large | wide[j])  # one of them may be the query itself
                    away = distances(x[near], q[at + j])
                    own = query_ids[at + j]
                    best = sorted((float(d), i) for d, n in zip(away, near, strict=True) for i in ids[n] if i != own)[:k]
                    out_q += [own] * len(best)
                    out_d += [d for d, _ in best]
                    out_id += [i for _, i in best]
        kind_of = asking.schema.field("query_id").type
        return pa.table(
            {"query_id": pa.array(out_q, kind_of), "id": pa.array(out_id, kind_of), "score": pa.array(out_d, pa.float64())}
        )

    near = Window.partitionBy("query_id").orderBy("score", "id")
    found = (
        probes.groupBy("block", "group")
        .cogroup(stored.groupBy("block", "group"))
        .applyInArrow(nearest_in_block, f"query_id {kind}, id {kind}, score double")
        .withColumn("rank", F.row_number().over(near))
        .filter(F.col("rank") <= k)
    )
    return found.select("query_id", "rank", F.col("id").alias(id_col), "score")


def distinct_vectors(base: DataFrame, most_ids: int) -> DataFrame:
    """``(id, v)``: every distinct vector once, with an array of its ``most_ids`` smallest ids.

    Vectors meet by a 128-bit hash, so that those without an equal are not shuffled; per hash only the smallest ids leave a task.
    """
    hashes = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")]
    narrow = base.select("id", *hashes).distinct()
    order = Window.partitionBy("h1", "h2").orderBy("id")
    firsts = narrow.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most_ids)
    ids = materialize(firsts.groupBy("h1", "h2").agg(F.array_sort(F.collect_list("id")).alias("ids")), "ann-ids")
    if ids.count() == base.count():
        return base.select(F.array("id").alias("id"), "v")
    kept = ids.select("h1", "h2", "ids", F.element_at("ids", 1).alias("id"))
    rows = base.select("id", "v", *hashes).join(kept, ["id", "h1", "h2"]).dropDuplicates(["id", "h1", "h2"])
    return rows.select(F.col("ids").alias("id"), "v")


def deal_blocks(counts: dict[int, int], n_leaves: int, most: int) -> tuple[list[int], list[int]]:
    """First block and number of blocks of each leaf: neighbouring leaves share a block up to ``most`` rows."""
    first, parts, block, filled = [], [], 0, 0
    for leaf in range(n_leaves):
        n = counts.get(leaf, 0)
        if n > most:
            block += filled > 0
            parts.append(math.ceil(n / most))
            first.append(block)
            block, filled = block + parts[-1], 0
            continue
        if filled + n > most:
            block, filled = block + 1, 0
        first.append(block)
        parts.append(1)
        filled += n
    return first, parts


def calibrate(
    base: DataFrame, asked: DataFrame, tree: Tree, dim: int, k: int, target: float, n_queries: int
) -> int:
    """Leaf visits for which ``target`` of the true neighbours of sample queries lie in visited leaves."""
    rows = asked.orderBy(F.xxhash64("id"), "id").limit(n_queries).collect()
    if not rows or tree.n_leaves == 1:
        return tree.n_leaves
    ids, q = [r["id"] for r in rows], np.array([r["v"] for r in rows], dtype=np.float64)
    id_type = to_arrow_type(asked.schema["id"].dataType)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k nearest of each sample query among a task's rows, and their leaves."""
        heap: list[list[tuple[float, int, int]]] = [[] for _ in ids]
        for b in batches:
            if not b.num_rows:
                continue
            x, held = _vectors(b.column(1), dim), b.column(0).to_pylist()
            leaves, large, wide = tree.file(bounded(x)), beyond(x), beyond(q)
            centred, part = bounded(x) - tree.mean, bounded(q) - tree.mean
            norms, own_norms = (centred**2).sum(axis=1), (part**2).sum(axis=1)
            quick = norms + own_norms[:, None] - 2 * (part @ centred.T)
            reach = rounding_reach(norms, own_norms, dim)
            for j, one in enumerate(q):
                near = nearest_rows(quick[j], reach[j], k + 1, large | wide[j])
                away = distances(x[near], one)
                found = [(float(d), held[i], int(leaves[i])) for d, i in zip(away, near, strict=True) if held[i] != ids[j]]
                heap[j] = sorted(heap[j] + found)[:k]
        rows = [(j, *entry) for j, h in enumerate(heap) for entry in h]
        j, d, i, leaf = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(j, pa.int32()), pa.array(d, pa.float64()), pa.array(i, id_type), pa.array(leaf, pa.int64())], ["j", "d", "id", "leaf"]
        )

    order = Window.partitionBy("j").orderBy("d", "id", "leaf")
    truth = (
        base.select("id", "v")
        .mapInArrow(best, f"j int, d double, id {dict(asked.dtypes)['id']}, leaf bigint")
        .withColumn("r", F.row_number().over(order))
        .filter(F.col("r") <= k)
        .collect()
    )
    place = [{leaf: i + 1 for i, leaf in enumerate(tree.visit(one, tree.n_leaves))} for one in bounded(q)]
    needed = sorted(place[r["j"]][r["leaf"]] for r in truth)
    return needed[min(len(needed) - 1, math.ceil(target * len(needed)) - 1)] if needed else tree.n_leaves


def op8_ann_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every vector whose id is divisible by 100, among all others."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest_neighbours(vectors, vectors.filter(F.col("vec_id") % 100 == 0))
