"""Packing, mixing, neighbours, token output and the pipeline."""

import itertools
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from caselake.llm import ann_tree, bin_packing, fertility_rules, source_mixing, token_output, tokenizer
from caselake.llm.tokenizer import load_byte_bpe

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id string, tokens int, pos int"


def documents(spark, texts, first=1):
    return spark.createDataFrame([(first + i, t, "en", "s", len(t or ""), "x", 1, 2) for i, t in enumerate(texts)], COLUMNS)


# --- packing ---------------------------------------------------------------------------------------------------

CAPS = (4, 8, 16)


def checked(items, bins):
    parts = defaultdict(list)
    for b in bins:
        assert sum(p[0] for p in b) <= max(CAPS)
        for n, item, at in b:
            parts[item].append((at, n))
    for item, length in items:
        at = 0
        for start, n in sorted(parts.pop(item, [])):
            assert start == at
            at += n
        assert at == length
    assert not parts


def test_packing_is_lossless_and_never_worse_than_one_size():
    rng = np.random.default_rng(5)
    cost = bin_packing.sequence_cost(1.0, 0.01)
    for _ in range(50):
        items = [(i, int(n)) for i, n in enumerate(rng.integers(1, 40, rng.integers(1, 30)))]
        bins = bin_packing.pack_jointly(items, CAPS, cost)
        checked(items, bins)
        assert bins == bin_packing.pack_jointly(items[::-1], CAPS, cost)
        total = sum(cost(bin_packing.downsized(sum(p[0] for p in b), CAPS)) for b in bins)
        for c in CAPS:
            pieces = sorted(((n, i, a) for i, length in items for a, n in bin_packing.split_item(length, max(CAPS))), key=lambda p: (-p[0], p[1], p[2]))
            one = bin_packing.pack_into(pieces, lambda n, left, c=c: next(x for x in CAPS if x >= max(n, c)), CAPS, cost)
            assert total <= one[0] + 1e-9


def test_small_packings_are_near_the_optimum():
    cost = lambda c: float(c)
    rng = np.random.default_rng(2)
    for _ in range(20):
        sizes = rng.integers(1, 9, 5).tolist()
        best = min(
            sum(bin_packing.downsized(sum(sizes[i] for i in range(5) if g[i] == b), CAPS) for b in set(g))
            for g in itertools.product(range(5), repeat=5)
            if all(sum(sizes[i] for i in range(5) if g[i] == b) <= max(CAPS) for b in set(g))
        )
        bins = bin_packing.pack_jointly(list(enumerate(sizes)), CAPS, cost)
        assert sum(bin_packing.downsized(sum(p[0] for p in b), CAPS) for b in bins) <= 1.5 * best


def test_pack_frame_edges(spark):
    df = spark.createDataFrame([(1, 3), (2, 40), (3, 0), (4, None), (5, 5), (5, 5), (None, 2)], "doc_id long, n_tokens long")
    got = bin_packing.pack(df, capacities=CAPS).collect()
    total = Counter()
    for r in got:
        total[r["doc_id"]] += r["piece_length"]
        assert r["bin"] is None or r["start"] + r["piece_length"] <= r["used"] <= r["capacity"]
    assert total == {1: 3, 2: 40, 3: 0, 4: 0, 5: 10, None: 2}
    with pytest.raises(ValueError):
        bin_packing.pack(df, capacities=())


def test_many_shards(spark):
    df = spark.range(500).selectExpr("id AS doc_id", "id % 13 AS n_tokens")
    got = bin_packing.pack(df, capacities=CAPS, shard_tokens=300).collect()
    assert len({r["shard"] for r in got if r["shard"] is not None}) > 3
    used = defaultdict(int)
    for r in got:
        if r["bin"] is not None:
            used[r["shard"], r["bin"]] += r["piece_length"]
    assert sum(used.values()) == sum(i % 13 for i in range(500))
    assert all(used[r["shard"], r["bin"]] == r["used"] for r in got if r["bin"] is not None)


# --- token output ----------------------------------------------------------------------------------------------


def slow_best_fit(lengths, capacity):
    free, bins = [], []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [b for b in range(len(bins)) if free[b] >= lengths[item]]
        if fits:
            b = min(fits, key=lambda b: free[b])
        else:
            b = len(bins)
            bins.append([])
            free.append(capacity)
        bins[b].append(item)
        free[b] -= lengths[item]
    return Counter(tuple(sorted(lengths[i] for i in b)) for b in bins)


def test_segment_tree_best_fit_matches_a_scan():
    rng = np.random.default_rng(8)
    for _ in range(60):
        capacity = int(rng.integers(1, 40))
        lengths = rng.integers(1, capacity + 1, rng.integers(0, 60)).tolist()
        bins = token_output.best_fit_decreasing(lengths, capacity)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        assert len(bins) == sum(slow_best_fit(lengths, capacity).values())
        assert all(sum(lengths[i] for i in b) <= capacity for b in bins)


def test_round_trip(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(80)
    docs = docs.union(spark.createDataFrame([(90_001, None), (90_002, ""), (None, "no id"), (90_003, "word " * 5_000)], docs.schema))
    rows = token_output.packed_rows(docs, length=512).collect()
    encoder, pieces = load_byte_bpe(), defaultdict(dict)
    for r in rows:
        ids, pos, cut = np.frombuffer(r["input_ids"], "<u2"), np.frombuffer(r["position_ids"], "<u2"), r["cu_seqlens"]
        assert len(ids) == len(pos) == 512 and cut[0] == 0 and cut[-1] == r["n_tokens"] and len(cut) == r["n_segments"] + 1
        assert (ids[cut[-1] :] == 50256).all() and not pos[cut[-1] :].any()
        for d, at, a, b in zip(r["doc_ids"], r["piece_offsets"], cut, cut[1:], strict=False):
            assert pos[a:b].tolist() == list(range(b - a))
            pieces[d][at] = ids[a:b].tolist()
    for d, text in docs.collect():
        tokens = [x for _, p in sorted(pieces[d].items()) for x in p]
        assert tokens[-1] == 50256 and encoder.decode(tokens[:-1]) == (text or "")


# --- mixing ----------------------------------------------------------------------------------------------------


def test_projected_gradient_reaches_targets(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.3, 0.3, 0.3], 400)
    t = rng.integers(1, 200, 400)
    df = spark.createDataFrame([(i, int(t[i]), *map(float, p[i])) for i in range(400)], "id long, tokens long, p0 double, p1 double, p2 double")
    targets = [0.6, 0.3, 0.1]
    rated, shares = source_mixing.fit_rates(df, targets, rounds=60, tolerance=1e-6, least_gain=0)
    r = np.array([x["rate"] for x in rated.orderBy("id").collect()])
    got = (p * (t * r)[:, None]).sum(0) / t.sum()
    assert (r >= 0).all() and np.allclose(got, targets, atol=1e-4) and np.allclose(shares, got)
    # the same steps without Spark
    share, rate = t / t.sum(), np.ones(400)
    h = (p * share[:, None]).T @ p + 1e-6 * np.eye(3)
    for _ in range(60):
        g = (p * (share * rate)[:, None]).sum(0) - targets
        if np.abs(g).max() <= 1e-6:
            break
        rate = np.maximum(0, rate - p @ np.linalg.solve(h, g))
    assert np.allclose(rate, r, atol=1e-6)


def test_mix_separates_domains(spark):
    fine = [f"calm words about gardens number {i}" for i in range(40)]
    junk = [f"### win $$$ now {i} ### $$$" for i in range(40)]
    df = documents(spark, fine + junk + [None, ""])
    labels = spark.createDataFrame([(i, "fine" if i <= 40 else "junk") for i in range(1, 81) if i % 2], "doc_id long, domain string")
    got = {r["doc_id"]: r for r in source_mixing.mix(df, labels, {"fine": 0.8, "junk": 0.2}).collect()}
    assert len(got) == 82 and all(abs(sum(r["posterior"].values()) - 1) < 1e-9 for r in got.values())
    assert all(got[i]["posterior"]["fine"] > 0.9 for i in range(1, 41)) and all(got[i]["posterior"]["junk"] > 0.9 for i in range(41, 81))
    total = sum(r["tokens"] for r in got.values())
    fit = {d: sum(r["rate"] * r["tokens"] * r["posterior"][d] for r in got.values()) / total for d in ("fine", "junk")}
    assert abs(fit["fine"] - 0.8) < 0.01 and abs(fit["junk"] - 0.2) < 0.01
    assert got[81]["tokens"] == got[82]["tokens"] == 0
    mixed = source_mixing.apply_mix(df, spark.createDataFrame([(r["doc_id"], r["copies"]) for r in got.values()], "doc_id long, copies long"))
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({d: r["copies"] for d, r in got.items() if r["copies"]})


def test_kept_domains_lose_no_document(spark):
    fine = [f"calm words about gardens number {i}" for i in range(60)]
    junk = [f"### win $$$ now {i} ### $$$" for i in range(6)]
    labels = spark.createDataFrame([(i, "fine" if i <= 60 else "junk") for i in range(1, 67)], "doc_id long, domain string")
    got = source_mixing.mix(documents(spark, fine + junk), labels, {"fine": 0.5, "junk": 0.5}, keep=("fine",)).collect()
    assert all(r["copies"] >= 1 for r in got if r["doc_id"] <= 60)
    fit = {d: sum(r["rate"] * r["tokens"] * r["posterior"][d] for r in got) for d in ("fine", "junk")}
    assert abs(fit["fine"] / fit["junk"] - 1) < 0.02


def test_mix_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, domain string")
    got = source_mixing.mix(documents(spark, ["a b", "c"]), labels, {"x": 1.0}).collect()
    assert [(r["posterior"], r["copies"]) for r in got] == [({"all": 1.0}, 1)] * 2


def test_mixing_runs_no_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = source_mixing.label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    names, biases, model = source_mixing.fit_classifier(docs, labels, "doc_id", "text", "domain")
    plan = source_mixing.domain_posteriors(docs, names, biases, model, "doc_id", "text")._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


# --- neighbours ------------------------------------------------------------------------------------------------


def test_recall_and_exact_scores(spark, sf_dir):
    x = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    ids, v = x["vec_id"].to_numpy(), np.stack(x["embedding"]).astype(float)
    got = defaultdict(dict)
    for r in ann_tree.op8_ann_tree(spark, sf_dir).collect():
        got[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    hit = 0
    for q in ids[ids % 100 == 0]:
        away = np.sqrt(((v - v[ids == q][0]) ** 2).sum(1))
        away[ids == q] = np.inf
        assert sorted(got[q]) == list(range(1, 11))
        for n, s in got[q].values():
            assert abs(away[ids == n][0] - s) < 1e-12
        assert [got[q][i] for i in range(1, 11)] == sorted(got[q].values(), key=lambda a: (a[1], a[0]))
        hit += len({n for n, _ in got[q].values()} & set(ids[np.lexsort((ids, away))[:10]]))
    assert hit / (10 * len(got)) >= 0.9


def test_neighbour_edges(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (1, [1.0, 0.0]), (8, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann_tree.nearest_neighbours(df, df.filter("vec_id in (0, 3, 4, 5)"), k=10).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in sorted(got)] == [(0, 1, 1, 0.0), (0, 2, 8, 1.0), (0, 3, 2, 2**0.5)]


def test_many_equal_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(300)] + [(1000 + i, [float(i), 3.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann_tree.nearest_neighbours(df, df.filter("vec_id = 5"), k=10, rows_per_leaf=4).collect()
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10]


def brute_neighbours(rows, asked, k=10):
    ids, v = [i for i, _ in rows], np.array([x for _, x in rows])
    out = {}
    for q in asked:
        away = np.sqrt(((v - v[ids.index(q)]) ** 2).sum(1))
        out[q] = sorted((float(d), i) for d, i in zip(away, ids, strict=True) if i != q)[:k]
    return out


def neighbours(spark, rows, asked, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in sorted(ann_tree.nearest_neighbours(df, df.filter(df.vec_id.isin(asked)), target_recall=1.0, **options).collect()):
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    return got


def test_one_hot_vectors_tie_by_id(spark):
    rows = [(i, [float(i == j) for j in range(200)]) for i in range(200)]
    got = neighbours(spark, rows, [0, 100], rows_per_leaf=400)
    assert got == brute_neighbours(rows, [0, 100]) and [i for _, i in got[100]] == list(range(10))


def test_vectors_far_from_zero(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=8) + 1e8).tolist()) for i in range(400)]
    got, want = neighbours(spark, rows, [0, 100, 200], rows_per_leaf=800), brute_neighbours(rows, [0, 100, 200])
    assert {q: [i for _, i in x] for q, x in got.items()} == {q: [i for _, i in x] for q, x in want.items()}


def test_more_ties_than_places(spark):
    rows = [(i, [float(i % 3), float(i % 7), 1.0]) for i in range(600)]
    rows += [(1000 + i, [float(np.cos(i)), float(np.sin(i)), 1.0]) for i in range(90)]
    assert neighbours(spark, rows, [0, 100, 1000], rows_per_leaf=2000, queries_per_group=1) == brute_neighbours(rows, [0, 100, 1000])


# --- long runs -------------------------------------------------------------------------------------------------


def test_long_runs_give_the_ids_of_the_uncut_encoder():
    plain, rng = load_byte_bpe(), np.random.default_rng(2)
    cut = tokenizer.ByteBpe(plain.encoding, long_run=3)
    kinds = [" ", "\n", "\t", "\u3000", "a", "Z", "7", ".", "'s", "\u00e9", "\x1c"]
    texts = ["".join(rng.choice(kinds) * int(rng.integers(1, 9)) for _ in range(int(rng.integers(1, 12)))) for _ in range(3_000)]
    for t in [*texts, " " * 9, "a" + " " * 9, " " * 9 + "a", "\n" * 9 + " b"]:
        assert cut.encode(t).tolist() == plain.encoding.encode_ordinary(t)


def test_texts_of_one_run_pass_every_token_operator(spark):
    runs = [" " * 5_000_000, "\n" * 5_000_000 + "x", "a" * 5_000_000, "word " + "\t " * 1_000_000 + "end"]
    df = documents(spark, runs).select("doc_id", "text", "lang")
    encoder = load_byte_bpe()
    sizes = {i: encoder.count(t) for i, t in enumerate(runs, 1)}
    got = Counter()
    for r in bin_packing.pack_documents(df).collect():
        got[r["doc_id"]] += r["piece_length"]
    assert got == sizes
    for r in token_output.packed_rows(df, end_id=None).select("doc_ids", "cu_seqlens").collect():
        for d, a, b in zip(r["doc_ids"], r["cu_seqlens"], r["cu_seqlens"][1:], strict=False):
            got[d] -= b - a
    assert not any(got.values())
    assert sorted(r["n_words"] for r in fertility_rules.judge_texts(df).collect()) == [0, 1, 1, 2]


def test_ids_beyond_16_bits_are_refused(spark):
    with pytest.raises(ValueError):
        token_output.packed_rows(documents(spark, ["x"]), end_id=100_000)


# --- pipeline --------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(90_001, None, None, None, None), (90_002, "12 34", "en", "s", 5), (90_003, "", None, "s", 0)], docs.schema)
    docs = docs.union(odd)
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "packing":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), docs.schema)
            sizes.append(docs.count())
            if name == "language":
                assert docs.filter("doc_id >= 90001").count() == 0 and sizes[0] == 200
            if name == "near_duplicates":
                assert docs.count() == docs.select("doc_id").distinct().count() < sizes[-2]
        else:
            ids = {r["doc_id"] for r in out.collect()}
            assert ids == {r["doc_id"] for r in docs.collect()}


def test_exact_copies_leave_one(spark):
    texts = [f"alpha beta gamma {i} delta epsilon zeta eta theta iota kappa" for i in range(6)] + ["alpha beta gamma 0 delta epsilon zeta eta theta iota kappa"] * 5
    df = documents(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")
    kept = corpus_pipeline.near_duplicate_stage(spark, df, "")
    assert sorted(r["doc_id"] for r in kept.collect() if r["text"] == texts[-1]) == [1]


# --- rows alike, huge vectors, few and many links ----------------------------------------------------------------


def test_rows_alike_are_spread_over_the_shards(spark):
    rows = spark.range(30_000).selectExpr("cast(null as long) as doc_id", "7L as n_tokens").repartition(4)
    packed = bin_packing.pack(rows, shard_rows=3_000)
    sizes = [r["count"] for r in packed.groupBy("shard").count().collect()]
    assert sum(sizes) == 30_000 and len(sizes) == 10 and max(sizes) < 4_500


@pytest.mark.parametrize("huge", [1e150, 1e200, 1.7e308])
def test_neighbours_beside_huge_vectors(spark, huge):
    rng = np.random.default_rng(1)
    vectors = {i: rng.normal(size=8).tolist() for i in range(300)}
    vectors[40] = [huge, 0.0] + [1.0] * 6
    vectors[41] = [huge / 3, 0.0] + [1.0] * 6
    vectors[50] = [-huge / 2, huge / 2] + [0.0] * 6
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    got = ann_tree.nearest_neighbours(df, df.filter("vec_id % 10 = 0"), target_recall=1.0, rows_per_leaf=300).collect()

    def away(a, b):
        half = [abs(x / 2 - y / 2) for x, y in zip(a, b)]
        return 2 * max(half) * float(np.sqrt(sum((h / max(half)) ** 2 for h in half)))

    with np.errstate(over="ignore"):
        for q in range(0, 300, 10):
            mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
            want = sorted((away(vectors[q], v), i) for i, v in vectors.items() if i != q)[:10]
            assert [m[1] for m in mine] == [i for _, i in want]
            assert np.allclose([m[2] for m in mine], [d for d, _ in want], rtol=1e-12)


def test_components_of_few_edges_are_those_of_rounds(spark):
    from caselake.llm.components import connected_components

    rng = np.random.default_rng(2)
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(None, 1), (5, 5)], "a long, b long")
    one, many = (sorted(map(tuple, connected_components(edges, few_edges=n).collect())) for n in (10_000, 0))
    assert one == many and len(one) > 100
    assert connected_components(edges.limit(0)).count() == 0
