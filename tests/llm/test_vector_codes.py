"""Vector codes against plain k-means in Python's integers."""

import math

import duckdb
import numpy as np
import pytest
from caselake.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<double>, label int, x string, row int, part int"


def plain(rows, parts, entries, rounds, scale=1024):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0], r[1]))
    whole = [[int(v) * scale if abs(v) > 1e15 else math.floor(v * scale) for v in r[1]] for r in rows]
    ends = vc.part_ends(len(whole[0]), parts)
    books = [[v[a:b] for v in whole[:entries]] for a, b in zip(ends, ends[1:])]

    def near(p, v):
        own = v[ends[p] : ends[p + 1]]
        return min((sum((a - b) ** 2 for a, b in zip(own, e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        at = [[near(p, v)[1] for v in whole] for p in range(parts)]
        for p in range(parts):
            for i in range(len(books[p])):
                mine = [v[ends[p] : ends[p + 1]] for v, a in zip(whole, at[p]) if a == i]
                if mine:
                    books[p][i] = [sum(c) // len(mine) for c in zip(*mine)]
    out = []
    for r, v in zip(rows, whole):
        got = [near(p, v) for p in range(parts)]
        out.append((r[0], tuple(g[1] for g in got), str(sum(g[0] for g in got))))
    return out, books


def check(spark, rows, parts=2, entries=8, rounds=4, usable=None, **more):
    df = spark.createDataFrame([(i, v, label, "x", 1, 2) for i, v, label in rows], SCHEMA).repartition(3)
    coded, books = vc.train_codes(df, parts=parts, entries=entries, rounds=rounds, **more)
    assert [c for c in coded.columns if c not in ("codes", "error")] == ["vec_id", "label", "x", "row", "part"]
    want, want_books = plain(rows if usable is None else usable, parts, entries, rounds)
    assert sorted((repr(r["vec_id"]), tuple(r["codes"]), r["error"]) for r in coded.collect()) == sorted((repr(i), c, e) for i, c, e in want)
    assert books == want_books


@pytest.mark.parametrize("entries,most,least", [(8, 3, 1), (40, 16, 4), (1, 16, 4)])
def test_codes_are_those_of_plain_k_means(spark, entries, most, least):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(9, 10)) * 0.3
    rows = [(i, (centres[i % 9] + rng.normal(size=10) * 0.05).tolist(), i % 4) for i in range(200)]
    check(spark, rows, parts=3, entries=entries, most_bounds=most, least_bounds=least)


def test_ties_repeats_and_unusable_rows(spark):
    grid = [(i, [float(a), float(b), float(b), float(a)], None) for i, (a, b) in enumerate([(0, 0), (0, 2), (2, 0), (1, 1), (1, 0), (0, 1), (2, 2)] * 3)]
    bad = [(50, None, 1), (51, [1.0, None, 0.0, 0.0], 1), (52, [float("nan"), 0.0, 0.0, 0.0], 1), (53, [float("inf"), 0.0, 0.0, 0.0], 1), (54, [1.0], 1)]
    usable = grid + [(3, [0.5, 0.5, 0.5, 0.5], 2), (None, [9.0, 9.0, 9.0, 9.0], 2), (None, [9.0, 9.0, 9.0, 9.0], 2)]
    check(spark, usable + bad, entries=5, usable=usable)


@pytest.mark.parametrize("huge", [3e5, 1e9, 1e200, 1.7e308])
def test_components_of_any_size(spark, huge):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4).tolist(), 0) for i in range(60)]
    check(spark, rows + [(70, [huge, -huge, 1.0, 1.0], 1), (2, [0.1, huge, -huge, 3.0], 1)], entries=6)


def test_empty_tables_and_short_vectors(spark):
    coded, books = vc.train_codes(spark.createDataFrame([], SCHEMA))
    assert coded.count() == 0 and books == [[], [], [], []]
    check(spark, [(1, [], 0), (2, [], 0)])
    check(spark, [(1, [0.5, 1.0, -0.25], 0), (2, [0.5, 1.0, 2.0], 0), (3, [0.4, 1.0, 2.0], 0)], entries=2)


def test_bounds_hold_back_most_distances(spark):
    """Rows of clear groups keep their entry without a look at all entries, and the lists shrink."""
    rng = np.random.default_rng(8)
    x = np.floor(rng.normal(size=(400, 4)) * 2 + 200 * rng.integers(0, 12, size=(400, 1)))
    old = vc.Codebook([[200 * i + 3] * 4 for i in range(12)])
    new = vc.Codebook([[200 * i] * 4 for i in range(12)])
    own, _, near, bounds = vc.assign_all(x, old, 4)
    got = vc.reassign(x, own, near, bounds, new, new.drift(old))
    assert (got[4] == 0).mean() > 0.9
    assert (got[0] == ((x[:, None, :] - new.values) ** 2).sum(2).argmin(1)).all()
    assert vc.next_width([380, 10, 10, 0, 0], 4, 1) == 1 and vc.next_width([0, 0, 0, 0, 9], 4, 1) == 4


def test_query_and_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    want = con.sql(vc.OP11_SQL).fetchall()
    got = vc.op11_vector_codes(spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == sorted(want)
