"""Ranked lexical search: term at a time, rarest first, with a limit on new accumulators.

Each item's terms are taken in batches of growing posting volume, rarest first.  A batch adds its impacts to the
accumulators of (item, document) and may create new ones.  After it, the k best partial scores of an item, completed by
their documents' other terms, give a floor of its final kth score (at least the kth partial score itself).  Once the
largest impacts of the terms still to come cannot reach that floor together, no document without an accumulator can
enter the result, so none is created any more.  Accumulators that can still reach the floor survive, and their
documents' remaining terms are added exactly.

Documents become rows of (length, terms that some item asks for, their counts), written once.  A batch is a join of
those with the batch's terms and a sum per (item, document); frequent terms, whose postings are the bulk, only meet
survivors.  No score is approximate and no list is cut.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, discard, map_texts, materialize, table

#: Fixed value: a term is a run of ASCII letters and digits and of any characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Up to so many distinct query terms are sent to the tasks that read documents; more are met by a join.
MOST_SENT = 200_000


def text_pieces(text: str, size: int = 4_000_000) -> Iterator[str]:
    """A long text in pieces that end between terms."""
    between, start = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"), 0
    while len(text) - start > size:
        m = between.search(text, start + size)
        if m is None:
            break
        yield text[start : m.start()]
        start = m.end()
    yield text[start:]


def term_counter(wanted: frozenset[str] | None):
    """For :func:`map_texts`: number of terms, and the wanted terms with their counts (None: all)."""

    def make():
        find, lower = re.compile(TERM).findall, str.maketrans(UPPER, LOWER)

        def work(texts: list[str | None]) -> dict:
            lengths, terms, counts = [], [], []
            for text in texts:
                held: Counter = Counter()
                for piece in text_pieces(text or ""):
                    held.update(find(piece.translate(lower)))
                lengths.append(sum(held.values()))
                found = sorted(held if wanted is None else held.keys() & wanted)
                terms.append(found)
                counts.append([held[t] for t in found])
            return {"n": lengths, "terms": terms, "counts": counts}

        return work

    return make


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    first_postings: int = 4_096,
    growth: int = 4,
) -> DataFrame:
    """``item_col, rank, id_col, score``: the ``k`` highest-scoring documents of every item, best first, ties by ascending id.

    N documents have a term, L terms in all; a term found in df documents weighs w = floor(1000 ln((2N+2)/(2df+1))); a
    document of n terms has m = 10 + (90 n N div L) and scores the sum of w * (10**9 tf div (1000 tf + 8m)) over the item's terms.

    ``first_postings``: postings per item in the first batch; each later batch reaches ``growth`` times as far.  Null and empty texts have
    no terms: such documents are in no result and do not count, such items have no rows.  Rows that share an item id are one item with the
    terms of all its texts; null is an id.  Repeated documents are documents of their own, each with a rank; equal scores with null
    ids come first.  Other columns are never read.  Empty tables give an empty result.
    """
    spark = docs.sparkSession
    asked = (
        map_texts(items.select(F.struct(F.col(item_col).alias("item")).alias("key"), F.col(item_text_col).alias("text")), "key", "text", term_counter(None), "n long, terms array<string>, counts array<long>")
        .select(F.col("key.item").alias("item"), F.explode("terms").alias("term"))
        .distinct()
    )
    asked = materialize(asked, "asked")
    vocabulary = asked.select("term").distinct()
    sent = [r[0] for r in vocabulary.limit(MOST_SENT + 1).collect()]
    wanted = frozenset(sent) if len(sent) <= MOST_SENT else None
    source = docs.select(F.struct(F.col(id_col).alias("id")).alias("key"), F.col(text_col).alias("text"))
    counted = map_texts(source, "key", "text", term_counter(wanted), "n long, terms array<string>, counts array<long>")
    index = materialize(counted.filter(F.col("n") > 0).select(F.monotonically_increasing_id().alias("r"), F.col("key.id").alias("id"), "n", "terms", "counts"), "terms")
    n_docs, n_terms = index.agg(F.count(F.lit(1)), F.sum("n")).first()

    m = F.expr(f"10 + ((90 * n * {n_docs}L) div {n_terms or 1}L)")
    postings = index.select("r", "n", F.arrays_zip("terms", "counts").alias("p")).select("r", "n", F.explode("p").alias("p")).select("r", "n", F.col("p.terms").alias("term"), F.col("p.counts").alias("tf"))
    if wanted is None:
        postings = postings.join(vocabulary, "term")
    postings = postings.select("r", "term", _impact(F.col("tf"), m).alias("g"))
    weighed = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("g").alias("g"))
    weight = F.floor(F.lit(1000.0) * F.log((2.0 * n_docs + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long")
    order = Window.partitionBy("item").orderBy("df", "term")
    queue = (
        asked.join(weighed.withColumn("w", weight).filter(F.col("w") > 0), "term")
        .withColumn("bound", F.col("w") * F.col("g"))
        .withColumn("before", F.sum("df").over(order.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("left", F.sum("bound").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("p", F.row_number().over(order))
        .withColumn("turn", F.greatest(F.lit(0), F.ceil(F.log(F.coalesce("before", F.lit(0)) / first_postings + F.lit(1e-9)) / F.log(F.lit(float(growth))))).cast("int"))
    )
    queue = materialize(queue.select("item", "term", "w", "left", "p", "turn"), "queue")
    if wanted is not None:
        discard(asked)

    def scores(pairs: DataFrame, terms: DataFrame) -> DataFrame:
        """``item, r, id, score``: what ``terms`` (of, term, w) add to the pairs' ``score``."""
        held_terms = pairs.join(index, "r").select("item", "r", "id", "score", "n", F.explode_outer(F.arrays_zip("terms", "counts")).alias("pair"))
        met = held_terms.join(terms, F.col("item").eqNullSafe(F.col("of")) & (F.col("pair.terms") == F.col("term")), "left")
        gain = F.coalesce(F.col("w") * _impact(F.col("pair.counts"), m), F.lit(0))
        return met.groupBy("item", "r").agg(F.first("id").alias("id"), (F.first("score") + F.sum(gain)).alias("score"))

    def rest_of(stops: DataFrame) -> DataFrame:
        """Terms that no batch has taken yet."""
        return queue.join(stops.withColumnRenamed("p", "stop"), F.col("item").eqNullSafe(F.col("of"))).filter(F.col("p") > F.col("stop")).drop("item")

    held, floors, stops = None, None, None
    for turn in range((queue.agg(F.max("turn")).first()[0] or 0) + 1):
        batch = queue.filter(F.col("turn") == turn)
        if floors is not None:
            batch = batch.join(floors, F.col("item").eqNullSafe(F.col("of")), "left").filter(F.col("left") >= F.coalesce("floor", F.lit(0)))
        batch = materialize(batch.select("item", "term", "w", "p"), "batch")
        if batch.isEmpty():
            discard(batch)
            continue
        fresh = postings.join(batch, "term").select("item", "r", (F.col("w") * F.col("g")).alias("score"))
        fresh = fresh if held is None else fresh.unionByName(held)
        after = materialize(fresh.groupBy("item", "r").agg(F.sum("score").alias("score")), "accumulators")
        reached = batch.groupBy(F.col("item").alias("of")).agg(F.max("p").alias("p"))
        new_stops = materialize(reached if stops is None else reached.unionByName(stops).groupBy("of").agg(F.max("p").alias("p")), "stops")
        # the k best so far, with all their terms: the least of their scores is a floor at least as high as the kth partial score
        best = Window.partitionBy("item").orderBy(F.desc("score"))
        leaders = after.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= k).drop("k")
        whole = scores(leaders, rest_of(new_stops)).groupBy(F.col("item").alias("of")).agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n"))
        new_floors = materialize(whole.filter(F.col("n") == k).drop("n"), "floors")
        discard(batch, held, stops, floors)
        held, stops, floors = after, new_stops, new_floors
    if held is None:
        kinds = f"{item_col} {_kind(items, item_col)}, rank int, {id_col} {_kind(docs, id_col)}, score long"
        return spark.createDataFrame([], kinds)

    rest = rest_of(stops).select("of", "term", "w", "left")
    limits = floors.join(rest.groupBy(F.col("of").alias("o")).agg(F.max("left").alias("left")), F.col("of").eqNullSafe(F.col("o")), "left").select("of", F.col("floor") - F.coalesce("left", F.lit(0)))
    limits = limits.toDF("of", "least")
    survivors = held.join(limits, F.col("item").eqNullSafe(F.col("of")), "left").filter(F.col("score") >= F.coalesce("least", F.lit(0)))
    scored = scores(survivors.select("item", "r", "score"), rest.drop("left"))
    first = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("id"), "r")
    top = scored.filter(F.col("score") > 0).withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
    return top.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def _impact(tf: Column, m: Column) -> Column:
    """``10**9 tf div (1000 tf + 8m)``, in longs."""
    return F.call_function("div", F.lit(1_000_000_000).cast("long") * tf, F.lit(1000) * tf + F.lit(8) * m)


def _kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def op12_term_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, rank, doc_id and score of the ten best documents for every benchmark item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


OP12_SQL = r"""
WITH doc_terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), item_terms AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), lengths AS (SELECT doc_id, count(*) AS n FROM doc_terms GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths),
postings AS (SELECT doc_id, term, count(*) AS tf FROM doc_terms GROUP BY doc_id, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM postings, totals GROUP BY term
), scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // terms)))))::BIGINT AS score
  FROM item_terms JOIN postings USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), totals
  GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
  FROM scores WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
