import datetime as dt

import pytest
from caselake.operators import corpus, curate, geo, incremental, linkage, progress, quality, rates
from caselake.sources import tables
from pyspark.sql import functions as F


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def test_outcome_rates_zero_denominator(spark):
    df = spark.createDataFrame([("a", "yes"), ("a", "no"), ("b", "open")], "k string, o string")
    got = rates.outcome_rates(df, ["k"], "o", ["yes", "no", "open"], ["yes"], ["no"])
    assert rows(got, "k", "total", "decided", "refusal_rate", "no_decision_share") == [("a", 2, 2, 50.0, 0.0), ("b", 1, 0, None, 100.0)]


def test_mode_ties_and_fallback(spark):
    df = spark.createDataFrame([("a", "y"), ("a", "x"), ("a", None), ("b", None)], "k string, v string")
    assert rows(rates.mode_by(df, ["k"], "v")) == [("a", "x")]
    assert rows(rates.impute_mode(df, ["k"], "v", "none", "w"), "k", "w") == [("a", "x"), ("a", "x"), ("a", "y"), ("b", "none")]


def test_spread_is_exclusive(spark):
    got = rates.spread(spark.createDataFrame([(x,) for x in (4, 1, 3, 2)], "v int"), "v").first()
    assert (got["n"], got["q1"], got["median"], got["q3"], got["maximum"]) == (4, 1.25, 2.5, 3.75, 4.0)
    assert rates.spread(spark.createDataFrame([], "v int"), "v").count() == 0


def test_histogram_last_bin_closed(spark):
    got = rates.histogram(spark.createDataFrame([(0.0,), (10.0,), (30.0,)], "v double"), "v", 10.0)
    assert rows(got, "low", "n") == [(0.0, 1), (10.0, 1), (20.0, 1)]


@pytest.fixture
def link_sides(spark):
    apps = spark.createDataFrame(
        [(1, ["leeds"], "R/1", None, "p1", "s1"), (2, ["leeds", "north"], "R/2", "R/9", "p2", "s2"), (3, ["york"], "R/3", None, "p2", "s3")],
        "uid long, names array<string>, ref_a string, ref_b string, post string, sig string",
    )
    cases = spark.createDataFrame(
        [(10, ["leeds"], "R/1", "p1", "s1"), (11, ["york"], "R/9", "p2", "s2"), (12, ["leeds"], None, None, None)],
        "case_id long, case_names array<string>, case_ref string, post string, case_sig string",
    )
    return apps, cases


def test_linkage_tiers(link_sides):
    apps, cases = link_sides
    t1 = linkage.link_by_reference(apps, cases, "uid", {"a": "ref_a", "b": "ref_b"}, "case_id", "case_ref", "names", "case_names")
    assert rows(t1, "uid", "case_id") == [(1, 10)]  # R/9 meets, but the authorities differ
    t2 = linkage.link_by_block(apps, cases, "uid", "case_id", ["post"], [("sig", F.col("sig") == F.col("case_sig"))])
    assert rows(t2, "uid", "case_id", "match_detail") == [(1, 10, "sig"), (2, 11, "sig")]
    t3 = linkage.link_unique_block(apps, cases, "uid", "case_id", ["post"], "sig", "case_sig")
    assert rows(t3, "uid", "case_id") == [(1, 10)]  # two applications share p2
    best = linkage.resolve_links([t1, t2, t3], "uid", "case_id")
    assert rows(best, "uid", "case_id", "tier", "confidence") == [(1, 10, "t1", "high"), (2, 11, "t2", "high")]


@pytest.mark.parametrize(
    "uid, name, case, described, want",
    [
        ("AB/12/345", None, "AB/12/345/FUL", "", "uid"),
        ("AB/12/345/FUL", None, "12/345", "", "uid"),
        ("AB/12", "XY/9988/77", "Q/9988/77", "", "name_tail"),
        ("A/1", "B/2", "A/1", "", None),  # too short to prove anything
        ("ZZ/7777", None, "123456", "SEE APPEAL 123456", "description"),
        ("ZZ/7777", None, "12345", "SEE APPEAL 12345", None),
        (None, None, "AB/12/345", None, None),
    ],
)
def test_reference_evidence(spark, uid, name, case, described, want):
    df = spark.createDataFrame([(1, 2, uid, name, case, described, "x")], "uid int, case_id int, u string, n string, c string, d string, block string")
    evidence = linkage.reference_evidence({"uid": F.col("u"), "name": F.col("n")}, F.col("c"), F.col("d"))
    got = linkage.link_by_block(df.select("uid", "u", "n", "d", "block"), df.select("case_id", "c", "block"), "uid", "case_id", ["block"], evidence).collect()
    assert [r["match_detail"] for r in got] == ([want] if want else [])


def test_allocation_keeps_total(spark):
    parents = spark.createDataFrame([("p", 10), ("q", 9)], "parent string, n long")
    children = spark.createDataFrame([("p", "a", 3), ("p", "b", 1), ("q", "c", 0), ("q", "d", 0)], "parent string, child string, w long")
    got = geo.allocate_by_share(parents, children, "parent", "n", "w")
    assert rows(got, "child", "allocated") == [("a", 8), ("b", 2), ("c", 4), ("d", 4)]  # 7.5, 2.5, 4.5, 4.5 to even


def test_bridge_priorities(spark):
    names = spark.createDataFrame([("Joint Board",), ("Nowhere Office",), ("Old Town",), ("York Council",), ("Atlantis",)], "name string")
    areas = spark.createDataFrame([("York",), ("Leeds",), ("Hull",)], "area string")
    key = F.trim(F.regexp_replace(F.lower("__name"), " council$", ""))
    got = geo.build_bridge(names, "name", {"Joint Board": ["York", "Leeds"]}, ["Nowhere Office"], {"Old Town": "Hull"}, areas, "area", key)
    assert rows(got) == sorted(
        [("Joint Board", "York", "joint"), ("Joint Board", "Leeds", "joint"), ("Nowhere Office", None, "no_area"), ("Old Town", "Hull", "alias"), ("York Council", "York", "matched"), ("Atlantis", None, "unmatched")], key=repr
    )


def test_latest_and_needs_work(spark):
    log = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("b", 2, 3)], "k string, ts int, id int")
    assert rows(progress.latest_per_key(log, ["k"], ["ts", "id"]), "k", "id") == [("a", 2), ("b", 3)]
    items = spark.createDataFrame([("a", "done"), ("b", None), ("c", "done"), ("c", "open")], "k string, s string")
    keys = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "k string")
    assert rows(progress.needs_work(keys, items, "k", F.col("s") == "done"), "k") == [("b",), ("c",), ("d",)]


def test_backlog_total_and_null_key(spark):
    df = spark.createDataFrame([("x", True), ("x", False), (None, True)], "k string, f boolean")
    assert rows(progress.backlog(df, "k", {"n": F.col("f")})) == [("Total", 3, 2), ("Unknown", 1, 1), ("x", 2, 1)]


def test_interleave_is_a_permutation(spark):
    df = spark.createDataFrame([(g, i) for g, n in (("a", 3), ("b", 1)) for i in range(n)], "g string, i int")
    assert [(r["g"], r["i"]) for r in progress.interleave(df, "g", ["i"]).collect()] == [("a", 0), ("b", 0), ("a", 1), ("a", 2)]


def test_first_missing(spark):
    day = lambda d: dt.date(2024, 1, d)
    df = spark.createDataFrame([("a", day(1)), ("a", day(2)), ("a", day(4)), ("b", day(2)), ("c", day(1)), ("c", day(2)), ("c", day(3)), ("c", day(4))], "k string, d date")
    got = progress.first_missing(df, ["k"], "d", "2024-01-01", "2024-01-04")
    assert rows(got, "k", "first_missing") == [("a", day(3)), ("b", day(1)), ("c", None)]


def test_attempt_status(spark):
    df = spark.createDataFrame([("x", 0, 0), (None, 0, 3), (None, 2, 3), (None, 3, 3)], "e string, f int, l int")
    assert [r[0] for r in df.select(progress.attempt_status(F.col("e"), F.col("f"), F.col("l"))).collect()] == ["error", "no_files", "partial", "success"]


def test_budget_is_never_exceeded(spark):
    df = spark.createDataFrame([("a", i, n) for i, n in enumerate((5000, 5000, 5000, 100, None))], "k string, r int, n long")
    got = corpus.char_budget(df, "k", "r", "n", F.lit(4000), 10_000)
    assert rows(got, "r", "taken") == [(0, 4000), (1, 4000), (2, 2000), (3, 0), (4, 0)]


def test_pack_chunks_matches_a_loop(spark):
    sizes = [5, 5, 3, 12, 1, 9, 10]
    df = spark.createDataFrame([("s", i, n) for i, n in enumerate(sizes)], "s string, i int, n long")
    want, chunk, used = [], -1, 0
    for n in sizes:
        if chunk < 0 or used + n > 10:
            chunk, used = chunk + 1, 0
        used += n
        want.append(chunk)
    got = corpus.pack_chunks(df, "s", "i", "n", 10).orderBy("i")
    assert [r["chunk"] for r in got.collect()] == want


def test_pack_chunks_over_many_batches(spark):
    sizes = [(i * 7919) % 13 for i in range(30_000)]
    df = spark.createDataFrame([("s", i, n or None) for i, n in enumerate(sizes)] + [(None, 1, 99)], "s string, i int, n long")
    chunk, used, want = 0, 0, []
    for i, n in enumerate(sizes):
        if i and used + n > 50:
            chunk, used = chunk + 1, 0
        used += n
        want.append(chunk)
    got = corpus.pack_chunks(df, "s", "i", "n", 50)
    assert [r["chunk"] for r in got.filter("s = 's'").orderBy("i").collect()] == want
    assert rows(got.filter("s is null"), "i", "n", "chunk") == [(1, 99, 0)]


def test_request_table_and_assembly(spark):
    df = spark.createDataFrame([("k", 2, "later", 3), ("k", 1, "first", 5), ("j", 1, None, 0)], "k string, r int, t string, taken long")
    assert rows(corpus.assemble(df, "k", "r", "r", "t", "|"), "k", "text") == [("k", "first|later")]
    assert rows(corpus.request_table(df, "k", "r", "t", [])) == [("k", '{"documents":[{"rank":1,"text":"first"},{"rank":2,"text":"lat"}]}')]


def test_label_pairs(spark):
    df = spark.createDataFrame([(["b", "a", "a"],), (["a", "b", "c"],), ([],), (None,)], "l array<string>")
    assert [tuple(r) for r in corpus.label_pairs(df, "l").collect()] == [("a", "b", 2), ("a", "c", 1), ("b", "c", 1)]


def test_upper_median(spark):
    df = spark.createDataFrame([("a", n) for n in (1, 2, 3, 4)], "k string, w int")
    assert corpus.corpus_stats(df, ["k"], "w", {}).first()["median_words"] == 3


def test_external_outlink(spark):
    html = '<a href="/">h</a><a href="https://own.example/x">o</a><a href="https://ext.example/doc/1">e</a>'
    df = spark.createDataFrame([(1, html), (2, '<a href="../y">o</a>'), (3, None)], "page long, html string")
    links = corpus.outlinks(df, "page", "html", F.lit("https://own.example/a/b"))
    assert sorted(map(tuple, links.collect())) == [(1, 0, "https://own.example/", True), (1, 1, "https://own.example/x", True), (1, 2, "https://ext.example/doc/1", False), (2, 0, "https://own.example/y", True)]
    assert rows(corpus.first_link(links, "page", F.lit(True))) == [(1, "https://ext.example/doc/1")]


def test_checks_and_normalise(spark):
    df = spark.createDataFrame([(1, 5.0, 9.0, ["a"], ["a", "b"]), (2, 5.0, 5.3, ["c"], ["a"]), (3, None, 1.0, None, None)], "id int, x double, y double, s array<string>, t array<string>")
    got = quality.consistency_checks(df, ["id"], [("hard", "sum", quality.differs(F.col("x"), F.col("y"), 0.6), F.col("y")), ("soft", "subset", quality.not_subset(F.col("s"), F.col("t")), F.lit(None))])
    assert rows(got) == [(1, "hard", "sum", "9.0"), (2, "soft", "subset", None)]
    steps = [("x", F.col("id") == 1, F.lit(0.0)), ("y", F.col("x") == 0, F.lit(-1.0))]
    assert rows(quality.normalise_records(df, steps), "id", "x", "y")[0] == (1, 0.0, -1.0)
    merged = quality.merge_lists(df, "s", "t")
    assert rows(merged, "id", "s") == [(1, ["a", "b"]), (2, ["c", "a"]), (3, None)]
    near = quality.differs_from_all(F.lit(5.0), [F.lit(9.0), F.lit(None).cast("double")], 0.5)
    assert df.select(near).first()[0] is True


def test_header_and_body(spark):
    cells = [(1, ["Report", None, None]), (2, ["name", "size", "price"]), (3, ["a", "1", "2"]), (4, ["b", "3", ""]), (5, ["", None, None]), (6, ["note", None, None])]
    df = spark.createDataFrame([("s", i, c) for i, c in cells], "sheet string, row int, cells array<string>")
    heads = curate.header_rows(df, ["sheet"], "row", "cells")
    assert rows(heads, "sheet", "header_row") == [("s", 2)]
    assert rows(curate.table_body(df, heads, ["sheet"], "row", "cells"), "row", "cells") == [(3, ["a", "1", "2"]), (4, ["b", "3", ""])]
    wide = spark.createDataFrame([("s", 1, ["name", "size", "", None]), ("s", 2, ["a"]), ("s", 3, ["b", "2", "x", "y"])], "sheet string, row int, cells array<string>")
    first = wide.filter("row = 1").selectExpr("sheet", "row AS header_row")
    assert rows(curate.table_body(wide, first, ["sheet"], "row", "cells"), "row", "cells") == [(2, ["a", None]), (3, ["b", "2"])]
    assert rows(curate.sheet_dictionary(df, ["sheet"], "cells")) == [("s", 6, 3, 0)]


def test_clean_metrics(spark):
    df = spark.createDataFrame([(1, "m", 1.0), (2, "m", 1.0), (3, None, None)], "i int, name string, v double")
    clean, dropped = curate.clean_metrics(df, [("no_name", F.col("name").isNull()), ("no_value", F.col("v").isNull())], ["name"], ["i"])
    assert rows(clean, "i") == [(1,)] and rows(dropped, "i", "drop_reason") == [(2, "duplicate"), (3, "no_value")]


def test_aliases_and_sparse_json(spark):
    df = spark.createDataFrame([(None, "x", " "), ("y", "z", "w")], "b string, c string, d string")
    assert [r[0] for r in df.select(curate.coalesce_alias(df, ["a", "b", "c"])).collect()] == ["x", "y"]
    assert [r[0] for r in df.select(curate.first_existing(df, ["a", "c"])).collect()] == ["x", "z"]
    assert rows(curate.sparse_json(df, ["b", "c", "d"]), "payload", "n_filled")[0] == ('{"b":"y","c":"z","d":"w"}', 3)


def test_upsert_and_guard_are_idempotent(spark):
    base = spark.createDataFrame([("a", 1, "old"), (None, 1, "x")], "k string, t int, v string")
    delta = spark.createDataFrame([("a", 2, "new"), ("b", 1, "first")], "k string, t int, v string")
    assert rows(incremental.upsert(base, delta, "k", ["t"]), "k", "v", "change") == [("a", "new", "updated"), ("b", "first", "new")]
    ups = spark.createDataFrame([("a", "set"), ("b", None)], "k string, n string")
    once = incremental.guarded_update(base, ups, "k", "v", "n", F.col("v") == "old")
    assert rows(once.filter("k = 'a'"), "v", "updated") == [("set", True)]
    assert rows(incremental.guarded_update(once.drop("updated"), ups, "k", "v", "n", F.col("v") == "old").filter("k = 'a'"), "v", "updated") == [("set", False)]


def test_reuse_by_signature(spark):
    todo = spark.createDataFrame([(1,), (2,), (3,)], "d long")
    manifest = spark.createDataFrame([(1, "ok", "s1"), (2, "ok", "s0"), (3, "failed", "s1")], "d long, status string, signature string")
    again, rest = incremental.reusable(todo, manifest, "d", ["ok"], "s1")
    assert rows(again) == [(1,)] and rows(rest) == [(2,), (3,)]


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([("a", "1"), ("a", "2"), (" ", "3")], "k string, v string")
    assert rows(tables.lookup(df, "k", "v")) == [("a", "2")]
    assert tables.scan(df, ["k"], ["extra"], {"v": "1"}).first()["extra"] is None
    (tmp_path / "x.csv").write_text('area,"Financial\nyear 2021/22",2022/23\nYork,"1,200",[c]\n')
    assert rows(tables.read_suppressed_stats(spark, str(tmp_path / "x.csv"), ["area"])) == [("York", 2021, 1200.0), ("York", 2022, None)]
    assert rows(tables.year_counts(spark.createDataFrame([("2020", "5"), ("x", "1"), ("2021", "")], "y string, n string"), "y", "n")) == [(2020, 5)]
    out = spark.createDataFrame([(1.25, ["a", "b"], True, "x\ty")], "d double, l array<string>, f boolean, s string")
    assert rows(tables.report_columns(out)) == [("1.3", "a|b", "TRUE", "x y")]
    tables.write_report(out, str(tmp_path / "report"))
    tables.write_partitioned(df, str(tmp_path / "parts"), ["k"])
    assert spark.read.parquet(str(tmp_path / "parts")).count() == 3
