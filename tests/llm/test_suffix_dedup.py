"""Repeated byte strings against a count of all strings."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from caselake.llm import suffix_dedup as sd

DOCS = "doc_id long, text string, id string, th string, rank int, n int"


def plain(rows, span):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(d[s : s + span] for _, d in data for s in range(len(d) - span + 1))
    out = []
    for i, d in data:
        gone = bytearray(len(d))
        for s in range(len(d) - span + 1):
            if seen[d[s : s + span]] > 1:
                gone[s : s + span] = b"\1" * span
        runs = sum(1 for p in range(len(d)) if gone[p] and not (p and gone[p - 1]))
        out.append((i, bytes(b for b, g in zip(d, gone) if not g), len(d), sum(gone), runs))
    return sorted(out, key=repr)


def run(spark, rows, span):
    df = spark.createDataFrame([(i, t, "x", "y", 1, 2) for i, t in rows], DOCS).repartition(3)
    got = sd.remove_repeats(df, span=span).collect()
    for r in got:
        assert all(e - s >= span for s, e in r["spans"]) and sum(e - s for s, e in r["spans"]) == r["n_removed"]
    return sorted(((r["doc_id"], bytes(r["kept"]), r["n_bytes"], r["n_removed"], r["n_spans"]) for r in got), key=repr)


def edited(rng, text, n):
    chars = list(text)
    for _ in range(n):
        p = int(rng.integers(0, len(chars)))
        chars[p : p + int(rng.integers(0, 2))] = rng.choice(list("abcé"), int(rng.integers(0, 3))).tolist()
    return "".join(chars)


@pytest.mark.parametrize("span,seed", [(80, 1), (97, 2), (200, 3)])
def test_as_by_counting_all_strings(spark, span, seed):
    rng = np.random.default_rng(seed)
    text = lambda n: "".join(rng.choice(list("abcdeé \n"), n))
    passages = [text(int(rng.integers(span // 2, 3 * span))) for _ in range(8)]
    rows = [(i, text(int(rng.integers(0, 2 * span))) + passages[i % 8] + text(int(rng.integers(0, span)))) for i in range(40)]
    base = text(8 * span)
    rows += [(100 + i, edited(rng, base, i)) for i in range(14)] + [(120, base), (121, base)]
    # strings that end and begin at the ends of texts, of exactly the length and one less
    edge = text(span)
    rows += [(130, edge), (131, "x" + edge), (132, edge + "y"), (133, edge[1:] + "z"), (134, "z" + edge[:-1]), (135, edge[:-1])]
    assert run(spark, rows, span) == plain(rows, span)


def test_runs_of_equal_and_periodic_bytes(spark):
    rows = [(1, "a" * 700), (2, "b" + "a" * 205 + "b"), (3, "a" * 200), (4, "ab" * 150), (5, "abc" * 90), (6, "abc" * 67), (7, "-" * 199), (8, "-" * 201)]
    assert run(spark, rows, 200) == plain(rows, 200)


def test_nulls_repeats_and_shared_ids(spark):
    rng = np.random.default_rng(7)
    one, two = ("".join(rng.choice(list("abcdef"), 300)) for _ in range(2))
    rows = [(1, None), (2, ""), (3, "short"), (4, one), (4, one), (5, two), (5, two[:250] + "x"), (None, two[20:] + one), (None, None), (6, "é" * 120)]
    assert run(spark, rows, 200) == plain(rows, 200)
    assert run(spark, [], 200) == []
    with pytest.raises(ValueError):
        run(spark, rows, 60)


def test_anchors_of_texts_longer_than_a_piece(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 101, 3000).astype(np.uint8)
    whole = sd.anchors(data, 200)
    monkeypatch.setattr(sd, "PIECE", 256)
    assert all((a == b).all() for a, b in zip(whole, sd.anchors(data, 200)))
    assert whole[2][0] == 0 and whole[3][-1] == 2800 and (whole[2][1:] == whole[3][:-1] + 1).all()


def test_query_finds_planted_passages(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = [(i, n, gone, runs, hashlib.sha256(kept).hexdigest()) for i, kept, n, gone, runs in plain(rows, 200)]
    assert sorted(map(tuple, sd.op13_suffix_dedup(spark, sf_dir).collect())) == sorted(want)
