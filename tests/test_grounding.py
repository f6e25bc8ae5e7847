"""Quotes of few words in quote_grounding against its SQL."""

import duckdb
from caselake.plans import registry


def test_quotes_of_few_words(spark, tmp_path):
    long = "unverhaeltnismaessigkeitsgrundsatz bundesverfassungsgerichtsentscheidung und mehr"
    nearly = " ".join(f"w{i}" for i in range(20))
    texts = [long, "x" * 80, "two words", "one two three four five six seven eight nine", "nowhere to be found", nearly + " … " + nearly, "..."]
    quotes = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    sources = [f"before {long} after", "y" * 9 + "x" * 80, "Two Words here", "zero one two three four five six seven eight nine", nearly.replace("w17", "other") + " and more"]
    docs = spark.createDataFrame(list(enumerate(sources)), "doc_id long, text string")
    for name, df in (("benchmark", quotes), ("documents", docs)):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name in ("benchmark", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = sorted(con.execute(registry.oracle_sql()["quote_grounding"]).fetchall())
    got = sorted(tuple(r) for r in registry.queries()["quote_grounding"](spark, str(tmp_path)).collect())
    assert got == want and [r[3] for r in got] == ["ok"] * 4 + ["missing", "near_verbatim", "ok"]
