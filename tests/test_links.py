"""Links by strings that are part of others, against a comparison of all pairs."""

import random
import re

from caselake.operators import linkage
from caselake.plans import registry
from pyspark.sql import functions as F


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_link_by_parts_is_link_by_block_by_evidence(spark):
    deal = random.Random(4)
    word = lambda letters, most: None if deal.random() < 0.1 else "".join(deal.choice(letters) for _ in range(deal.randint(0, most)))
    block = lambda: deal.choice(["x", "y", None])
    apps = spark.createDataFrame([(i % 250, block(), word("AÉ/1", 6), word("A/12", 5), word("AÉ1 2", 14)) for i in range(300)], "uid int, block string, u string, n string, d string")
    cases = spark.createDataFrame([(i % 90, block(), word("AÉ/12", 7)) for i in range(100)], "case_id int, block string, c string")
    for least, described in ((2, 3), (4, 6), (0, 0)):
        evidence = linkage.reference_evidence({"uid": F.col("u"), "name": F.col("n")}, F.col("c"), F.col("d"), least, described)
        want = rows(linkage.link_by_block(apps, cases, "uid", "case_id", ["block"], evidence))
        assert rows(linkage.link_by_parts(apps, cases, "uid", "case_id", ["block"], {"uid": "u", "name": "n"}, "c", "d", least, described)) == want
        assert {r[3] for r in want} >= {"uid", "name"}


def test_reference_links_make_no_pairs_of_whole_blocks(spark, sf_dir):
    df = registry.queries()["link_t2_reference"](spark, sf_dir)
    assert df.count() >= 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join [" in plan and not re.search(r"Join \[block#\d+L?\], \[block#\d+L?\]|CartesianProduct", plan)


def test_contained_patterns(spark):
    patterns = spark.createDataFrame([("x", "1/2"), ("x", "1/2"), ("x", ""), ("y", "É"), ("y", "ÉÉ"), (None, "a"), ("x", None)], "b string, p string")
    texts = spark.createDataFrame([("x", "21/21/2"), ("x", ""), ("y", "AÉ"), ("y", "1/2"), (None, "a"), ("x", None)], "b string, t string")
    want = sorted([("x", "1/2", "21/21/2"), ("x", "", "21/21/2"), ("x", "", ""), ("y", "É", "AÉ")], key=repr)
    for most in (100, 0):
        assert rows(linkage.contained(patterns, texts, ["b"], "p", "t", most)) == want
