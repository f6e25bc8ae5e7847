"""Queries whose order leaves ties or meets nulls, against their SQL on small tables written for it."""

import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from caselake.plans import registry

duckdb = pytest.importorskip("duckdb")


def _same(spark, folder, name):
    con = duckdb.connect()
    for path in folder.iterdir():
        con.sql(f"create view {path.stem} as select * from '{path}'")
    df = registry.queries()[name](spark, str(folder))
    rel = con.sql(registry.oracle_sql()[name])
    at = [list(rel.columns).index(c) for c in df.columns]
    want = sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)
    assert sorted(map(tuple, df.collect()), key=repr) == want
    return df.columns, want


def _day(n):
    return datetime.datetime(2000, 1, 1) + datetime.timedelta(days=n)


@pytest.mark.parametrize("name", ["case_facts", "refused_withdrawn_table"])
def test_first_line_of_ties_and_nulls(spark, tmp_path, name):
    """Lines that tie in date and number: the first in the file; a line without a date comes after those with one."""
    n, per = 40, 4
    lines = [(k, j) for j in range(per) for k in range(n)]
    # the first line of every third order has no date; all others tie in date and number
    shipped = [None if k % 3 == 0 and j == 0 else _day(k) for k, j in lines]
    tables = {
        "nation": {"n_nationkey": pa.array([0], pa.int32()), "n_name": ["here"]},
        "customer": {"c_custkey": [0], "c_nationkey": pa.array([0], pa.int32())},
        "part": {"p_partkey": range(n * per), "p_name": [f"part {i}" for i in range(n * per)], "p_brand": ["b"] * (n * per)},
        "orders": {
            "o_orderkey": range(n), "o_custkey": [0] * n, "o_orderstatus": ["FPO"[k % 3 if k % 5 else 0] for k in range(n)], "o_totalprice": [1e5] * n,
            "o_orderdate": pa.array([_day(0)] * n, pa.timestamp("us")), "o_orderpriority": ["1-URGENT"] * n,
        },
        "lineitem": {
            "l_orderkey": [k for k, _ in lines], "l_partkey": [per * k + (7 * j + k) % per for k, j in lines], "l_linenumber": pa.array([1] * len(lines), pa.int32()),
            "l_returnflag": ["RAN"[j % 3] for _, j in lines], "l_linestatus": ["OF"[j % 2] for _, j in lines], "l_shipdate": pa.array(shipped, pa.timestamp("us")),
        },
    }
    for table, columns in tables.items():
        pq.write_table(pa.table({c: v if isinstance(v, pa.Array) else pa.array(list(v)) for c, v in columns.items()}), tmp_path / f"{table}.parquet")
    columns, rows = _same(spark, tmp_path, name)
    names = {r[0]: r[-1] for r in rows}
    assert names[1] == "part 5" and names[0] == "part 3"


def test_request_rows_of_empty_and_unknown_texts(spark, tmp_path):
    """Empty texts within the budget count as documents; a source of nothing else has no row; a text of unknown length comes last and counts as the cap."""
    texts = {
        "empty first": [("", 0), ("x" * 50, 50), ("", 0), ("y" * 60, 60)],
        "all empty": [("", 0), ("", 0)],
        "used up": [(c * 390, 390) for c in "abcd"] + [("", 0)],
        "unknown": [("z" * 30, None), (None, None), ("é" * 20, 20)],
        "no text": [(None, 70), ("w" * 10, 10)],
        None: [("v" * 10, 10), ("", 0)],
    }
    rows = [(i, source, text, n) for i, (source, text, n) in enumerate((s, *t) for s, ts in texts.items() for t in ts)]
    ids, sources, words, lengths = zip(*rows, strict=True)
    table = {"doc_id": pa.array(ids, pa.int64()), "text": pa.array(words), "lang": pa.array(["en"] * len(ids)), "source": pa.array(sources), "n_chars": pa.array(lengths, pa.int64())}
    pq.write_table(pa.table(table), tmp_path / "documents.parquet")
    columns, want = _same(spark, tmp_path, "request_rows")
    assert {r[0]: r[1:] for r in want}["empty first"] == (4, 110) and "all empty" not in {r[0] for r in want}
