"""Global order, groups larger than a partition, ranks beside outliers, and short quotes without all pairs."""

import pytest
from caselake.operators import corpus, order, rates
from pyspark.sql import functions as F


@pytest.fixture(autouse=True)
def small_partitions(spark):
    """Partitions of few rows stay apart."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def test_positions_in_a_mixed_order(spark):
    df = spark.range(2000).select("id", (F.col("id") % 7).alias("a"), F.when(F.col("id") % 11 > 0, F.col("id") % 13).alias("b")).repartition(5)
    got = order.global_positions(df, ["a", F.desc_nulls_last("b"), "id"]).orderBy("position").collect()
    want = sorted(((r["a"], r["b"] is None, -(r["b"] or 0), r["id"]) for r in df.collect()))
    assert [r["id"] for r in got] == [w[3] for w in want] and [r["position"] for r in got] == list(range(1, 2001))
    assert order.global_positions(df.limit(0), ["a"]).count() == 0


def test_a_group_may_reach_over_partitions(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 10 > 0, F.lit(None).cast("string")).otherwise("x").alias("g")).repartition(6)
    got = order.group_positions(df, ["g"], ["id"], "turn")
    assert order.sorted_parts(df, ["g", "id"]).filter("g is null").select("__part").distinct().count() > 1
    seen: dict = {}
    for r in got.orderBy("id").collect():
        seen[r["g"]] = seen.get(r["g"], 0) + 1
        assert r["turn"] == seen[r["g"]]
    assert got.columns == ["id", "g", "turn"]


def test_running_sums_and_ranks_beside_an_outlier(spark):
    values = [float(i % 50) for i in range(400)] + [1e12, -1e12]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    ranked = rates._value_ranks(df, "v").orderBy("v").collect()
    total = 0
    for r in ranked:
        assert r["__before"] == total
        total += r["__c"]
    parts = order.sorted_parts(df.distinct(), ["v"]).groupBy("__part").count().agg(F.max("count")).first()[0]
    assert total == 402 and parts < 40
    assert tuple(rates.spread(df, "v").first())[1:3] == (12.0, 24.5)


def test_short_quotes_meet_by_their_rarest_characters(spark):
    texts = ["two words", "Zwei Worte", "", None, "..", "a b … c d", "sechse", "nothing of it", "part one … other part", "one two three four five six"]
    quotes = spark.createDataFrame(list(enumerate(texts)), "item long, quote string")
    bodies = ["here are two  words", "ZWEI worte and two wordsmiths", None, "", "sechsecke", "the other part and part one", "one two three four five six seven"]
    sources = spark.createDataFrame(list(enumerate(bodies)), "doc long, body string")
    for most in (1_000_000, 0):
        got = corpus.ground_quotes(quotes, sources, "item", "quote", "doc", "body", most)
        assert "CartesianProduct" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()
        assert sorted(map(tuple, got.collect())) == [(0, 0, "ok"), (0, 1, "ok"), (1, 1, "ok"), (6, 4, "ok"), (8, 5, "ok"), (9, 6, "ok")]
    assert [r["item"] for r in corpus.empty_quotes(quotes, "quote").orderBy("item").collect()] == [4, 5]
