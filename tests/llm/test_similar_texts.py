"""Classes of similar texts against brute force over all pairs."""

import pytest
import numpy as np
from caselake.llm import simhash_dedup


def shingle_set(text, k=5):
    words = text.encode().lower().split()
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def brute_force(ids, texts, least):
    sets = [shingle_set(t) for t in texts]
    parent, links = {i: i for i in ids}, []
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if min(len(a), len(b)) >= least * max(len(a), len(b)) and jaccard(a, b) >= least:
                links.append((ids[i], ids[j]))
                x, y = find(parent, ids[i]), find(parent, ids[j])
                parent[max(x, y)] = min(x, y)
    return {i: find(parent, i) for i in ids}, links


def test_similar_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    want, links = brute_force([r[0] for r in rows], [r[1] for r in rows], 0.8)
    got = {r["doc_id"]: r["component_id"] for r in simhash_dedup.similar_text_classes(docs).collect()}
    assert set(got) == set(want)
    assert all(want[d] == want[c] for d, c in got.items())  # no class joins what brute force keeps apart
    assert len(links) > 50 and np.mean([got[a] == got[b] for a, b in links]) > 0.9


def test_planted_copies_and_a_dense_group(spark):
    rng = np.random.default_rng(9)
    vocabulary = [f"w{i}" for i in range(5_000)]
    fresh = lambda n: rng.choice(vocabulary, n).tolist()

    def changed(words, n):
        out = list(words)
        for i in rng.choice(len(out), n, replace=False).tolist():
            out[i] = f"new{rng.integers(10**9)}"
        return out

    texts, groups = [], []
    for g in range(30):  # pairs with 1 of 300 words, up to 5 of 300, changed
        base = fresh(300)
        texts += [base, changed(base, 1 + g % 5)]
        groups += [g, g]
    base = fresh(300)
    for _ in range(150):  # copies with 2 words changed: any two are at about 0.87
        texts.append(changed(base, 2))
        groups.append(100)
    for i in range(200):
        texts.append(fresh(300))
        groups.append(1000 + i)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash_dedup.similar_text_classes(df).collect()}
    first = {}
    for i, g in enumerate(groups):
        first.setdefault(g, i)
    assert np.mean([got[i] == first[g] for i, g in enumerate(groups) if g < 1000]) > 0.97
    assert all(got[i] == i for i, g in enumerate(groups) if g >= 1000)


def test_dominating_repeats(spark):
    rng = np.random.default_rng(4)
    fresh = lambda n: [f"w{i}" for i in rng.integers(0, 10**6, n)]
    refrain, phrase, base = ["one", "two", "three"] * 200, fresh(30), fresh(300)
    texts = [fresh(250) + refrain, fresh(300) + refrain, base + phrase, base + phrase * 40]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash_dedup.similar_text_classes(df).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 2}  # a refrain alone links nothing, a repeated phrase parts nothing


def test_isolated_pairs_at_the_limit(spark):
    rng = np.random.default_rng(6)
    texts = []
    for i in range(150):  # pairs at 0.8 to 0.86, some just below
        n = int(rng.integers(60, 400))
        base = [f"w{x}" for x in rng.integers(0, 10**9, n)]
        cut = int(n * (0.19 if i % 3 else 0.14) * 5 / 5.1)
        texts += [" ".join(base), " ".join(base[: n - cut])]
    want, links = brute_force(range(len(texts)), texts, 0.8)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash_dedup.similar_text_classes(df).collect()}
    assert len(links) > 100 and got == want


def test_segment_counts_bound_the_difference():
    rng = np.random.default_rng(7)
    for _ in range(300):
        pool = np.unique(rng.integers(0, 2**64, int(rng.integers(2, 60_000)), dtype=np.uint64))
        a, b = (pool[rng.random(len(pool)) < p] for p in rng.random(2))
        x, y = (np.frombuffer(simhash_dedup.segment_counts(s), np.uint8).astype(int) for s in (a, b))
        assert len(x) == simhash_dedup.SEGMENTS and np.abs(x - y).sum() <= len(np.setxor1d(a, b))


def test_finer_counts_bound_the_difference():
    rng = np.random.default_rng(8)
    sets = []
    for _ in range(300):
        pool = np.unique(rng.integers(0, 2**64, int(rng.integers(2, 60_000)), dtype=np.uint64))
        sets.append([pool[rng.random(len(pool)) < p] for p in rng.random(2)])
    counts = [[simhash_dedup.segment_counts(s, simhash_dedup.segments_for(len(s))) for s in both] for both in sets]
    apart = simhash_dedup.counts_apart(*map(list, zip(*counts)), block=7)
    assert any(len(x) != len(y) for x, y in counts) and len(simhash_dedup.counts_apart([], [])) == 0
    for (a, b), (x, y), d in zip(sets, counts, apart):
        x, y = (np.frombuffer(c, np.uint8).astype(int).reshape(min(len(x), len(y)), -1).sum(axis=1) for c in (x, y))
        assert d == np.abs(x - y).sum() <= len(np.setxor1d(a, b))


def test_long_unlike_texts_are_not_read_in_pairs(spark, monkeypatch):
    """Texts that share a passage meet in a cell; whole texts are joined for those pairs only that may be similar."""
    rng = np.random.default_rng(12)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    passage = fresh(1_800)
    texts = [passage + fresh(4_200) for _ in range(8)]
    texts.append(texts[3][:-300] + fresh(300))
    seen, verified = [], simhash_dedup.verified_pairs

    def noted(docs, id_col, text_col, pairs, *more):
        seen.extend(tuple(sorted(r)) for r in pairs.collect())
        return verified(docs, id_col, text_col, pairs, *more)

    monkeypatch.setattr(simhash_dedup, "verified_pairs", noted)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash_dedup.similar_text_classes(df).collect()}
    assert got == {i: i for i in range(8)} | {8: 3} and set(seen) == {(3, 8)}


def test_verified_pairs_of_a_text_with_many_partners(spark):
    """Null texts, ends on both sides and an end that is dealt into parts."""
    from caselake.llm.common import materialize

    base = [f"w{i}" for i in range(40)]
    texts = {0: " ".join(base), 1: None, 2: "", 3: "other words of no text here at all"}
    texts |= {i: " ".join([*base, *(f"x{i}-{j}" for j in range(i % 20))]) for i in range(10, 2_600)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    pairs = [(i, 0) for i in range(10, 2_600)] + [(0, 3), (1, 2), (3, 1), (11, 12), (12, 13)]
    links = simhash_dedup.verified_pairs(docs, "doc_id", "text", materialize(spark.createDataFrame(pairs, "a long, b long")), 5, 0.8)
    want = sorted(p for p in pairs if jaccard(*(shingle_set(texts[i] or "") for i in p)) >= 0.8)
    assert 900 < len(want) < 2_000 and sorted(map(tuple, links.select("a", "b").collect())) == want


def test_rows_of_one_id_and_rows_without_one(spark):
    texts = ["alpha beta gamma delta epsilon zeta", "one two three four five six seven"]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[0]), (3, texts[1]), (None, texts[0]), (None, None), (4, None), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0), (r["component_id"] or 0)) for r in simhash_dedup.similar_text_classes(df).collect())
    assert len(got) == len(rows) and [g for g in got if g[0] == 4] == [(4, 4), (4, 4)] and (5, 4) in got
    assert len({c for d, c in got if d == 1}) == 1


def test_scopes_delete_their_own_tables_only(spark):
    import threading

    from caselake.llm.common import TableScope, materialize

    before = materialize(spark.range(3), "before")
    other = []
    with TableScope() as outer:
        with TableScope() as inner:
            dropped, kept = materialize(spark.range(5), "dropped"), materialize(spark.range(7), "kept")
            beside = threading.Thread(target=lambda: other.append(materialize(spark.range(9), "other")))
            beside.start()
            beside.join()
        inner.discard_but(kept)
        assert [t.count() for t in (before, kept, *other)] == [3, 7, 9]
        with pytest.raises(Exception):
            dropped.count()
    outer.discard_but()
    with pytest.raises(Exception):
        kept.count()
    assert [t.count() for t in (before, *other)] == [3, 9]
