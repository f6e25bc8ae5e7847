"""Ranked search against a plain score of every document."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from caselake.llm import term_search as ts

DOCS = "doc_id long, text string, item_id long, rank int, n int, term string"
ITEMS = "item_id long, text string, doc_id long, w int"


def tokens(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(ts.TERM, lower)


def plain(docs, items, k):
    rows = [(i, Counter(tokens(t))) for i, t in docs if tokens(t)]
    n_docs, n_terms = len(rows), sum(sum(c.values()) for _, c in rows)
    df = Counter(t for _, c in rows for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(tokens(t))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, c in rows:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if s > 0:
                scores.append((-s, i is not None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def run(spark, docs, items, k=10, **more):
    d = spark.createDataFrame([(i, t, 1, 2, 3, "x") for i, t in docs], DOCS)
    q = spark.createDataFrame([(i, t, 5, 6) for i, t in items], ITEMS)
    return sorted(map(tuple, ts.search(d, q, k, **more).collect()), key=repr)


def corpus(seed, n):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(120)] + ["ß1", "日本", "É"]
    odds = 1 / np.arange(1, len(words) + 1)
    text = lambda size: " ".join(rng.choice(words, size, p=odds / odds.sum()))
    docs = [(i, text(int(rng.integers(1, 40)))) for i in range(n)]
    return docs + [(n + i, t) for i, t in docs[: n // 5]], [(i, text(int(rng.integers(1, 20)))) for i in range(12)]


@pytest.mark.parametrize("first,growth,k", [(1, 2, 3), (20, 4, 10), (10**6, 4, 1)])
def test_as_by_scoring_every_document(spark, first, growth, k):
    docs, items = corpus(first, 150)
    assert run(spark, docs, items, k, first_postings=first, growth=growth) == plain(docs, items, k)


def test_more_terms_than_are_sent(spark, monkeypatch):
    docs, items = corpus(9, 60)
    monkeypatch.setattr(ts, "MOST_SENT", 5)
    assert run(spark, docs, items, 4, first_postings=10) == plain(docs, items, 4)


def test_nulls_ties_repeats_and_long_texts(spark):
    docs = [(1, None), (2, ""), (3, "... !"), (4, "Apple pie"), (5, "apple PIE"), (5, "apple pie"), (None, "apple pie"), (6, "pear"), (7, "pear " * 1_200_000 + "fig"), (8, "x" * 5_000_000)]
    items = [(1, "APPLE"), (1, "fig"), (2, None), (3, "nothing here"), (None, "pear, Fig"), (4, "")]
    assert run(spark, docs, items, 3) == plain(docs, items, 3)
    assert run(spark, [], items) == [] and run(spark, docs, []) == [] and run(spark, docs[:3], items) == []
    # among 600 documents a term that every one has weighs nothing
    every = [(i, "a") for i in range(600)]
    assert run(spark, every, [(1, "a")]) == plain(every, [(1, "a")], 10) == []


def test_long_texts_come_in_pieces_between_terms():
    text = "ab cd " * 10
    assert " ".join(p for p in ts.text_pieces(text, 7)).split() == text.split()
    assert list(ts.text_pieces("x" * 20, 7)) == ["x" * 20]


def test_query_and_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    assert sorted(map(tuple, ts.op12_term_search(spark, sf_dir).collect())) == sorted(con.sql(ts.OP12_SQL).fetchall())
