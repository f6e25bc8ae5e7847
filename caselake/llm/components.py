"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Rows that a key may hold before they are joined by broadcast, and most such keys.
HOT_ROWS, MOST_HOT = 1_024, 50_000


#: Edges up to which one task finds the components: some 10 MB, whatever the data.
FEW_EDGES = 100_000


def connected_components(edges: DataFrame, max_rounds: int = 40, few_edges: int = FEW_EDGES) -> DataFrame:
    """``(node, component)`` for every node of ``edges`` (columns ``a`` and ``b``).

    ``edges`` is read twice, so it should be a written table.  ``component`` is the smallest node that can be reached.  Up to
    ``few_edges`` edges, a bound that does not grow with the data, are merged in one task as they are; a shuffle and rounds of joins
    over so few rows would cost more than the rows.  Beyond it: alternates large-star and small-star
    steps until the edge set no longer changes; every round is written to the shared folder, so
    neither the edges nor the components pass through the driver, which only gets two sums a round.
    Edges with a null end and self-loops are ignored; no edges give no rows.  Raises if it has not settled in ``max_rounds``.
    """
    edges = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    if edges.count() <= few_edges:
        return _merged(edges)
    edges = materialize(edges.distinct(), "edges")
    state = _state(edges)
    for _ in range(max_rounds):
        if not state[0]:
            break
        hot = state[1] > HOT_ROWS
        after = materialize(_small_star(_large_star(edges, hot), hot), "edges")
        discard(edges)
        edges, before, state = after, state, _state(after)
        if before[::2] == state[::2]:
            break
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _merged(edges: DataFrame) -> DataFrame:
    """The components of a bounded number of edges ``(u, v)``, in one task."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    kind = edges.schema["u"].dataType
    arrow = to_arrow_type(kind)

    def run(batches):
        root: dict = {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                low, high = sorted((find(u), find(v)))
                root[high] = low
        nodes = list(root)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, arrow), pa.array([find(x) for x in nodes], arrow)], ["node", "component"])

    name = kind.simpleString()
    return edges.select("u", "v").coalesce(1).mapInArrow(run, f"node {name}, component {name}")


def _state(edges: DataFrame) -> tuple:
    """Number of edges, most edges of a node, and a sum of hashes that tells edge sets apart."""
    own = F.xxhash64("u", "v").cast("decimal(38,0)")
    ends = F.array(F.struct(F.col("u").alias("x"), own.alias("h")), F.struct(F.col("v").alias("x"), F.lit(0).cast("decimal(38,0)").alias("h")))
    nodes = edges.select(F.explode(ends).alias("e")).groupBy("e.x").agg(F.count(F.lit(1)).alias("n"), F.sum("e.h").alias("h"))
    n, most, total = nodes.agg(F.sum("n"), F.max("n"), F.sum("h")).first()
    return (n or 0) // 2, most or 0, total


def join_per_key(rows: DataFrame, per_key: DataFrame, key: str, hot: bool = True) -> DataFrame:
    """``rows`` joined to ``per_key``, which has one row a key and the number of its rows as ``n``.

    The ``MOST_HOT`` largest keys are joined by broadcast, so that none of them sends its rows to one task; any other
    key holds less than a 50,000th of the rows.  ``hot``: whether there is a key of over ``HOT_ROWS`` rows at all.
    """
    if not hot:
        return rows.join(per_key.drop("n"), key)
    large = F.broadcast(per_key.filter(F.col("n") > HOT_ROWS).orderBy(F.desc("n"), key).limit(MOST_HOT).drop("n"))
    rare = rows.join(large.select(key), key, "left_anti").join(per_key.drop("n"), key)
    return rows.join(large, key).unionByName(rare)


def _large_star(edges: DataFrame, hot: bool) -> DataFrame:
    """Links each larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    return (
        join_per_key(both, least, "u", hot)
        .filter(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame, hot: bool) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    joined = join_per_key(edges, least, "u", hot)
    return (
        joined.filter(F.col("v") != F.col("m"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(least.select("u", F.col("m").alias("v")))
        .distinct()
    )
