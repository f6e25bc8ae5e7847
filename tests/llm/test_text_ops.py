"""Operators on texts against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from caselake.llm import cells, components, fertility_rules, language_id, line_dedup, registry, secret_scan, simhash_dedup, toxic_crf
from caselake.llm.components import connected_components
from pyspark.sql import functions as F

ALL_OPS = sorted(registry.QUERIES, key=lambda n: int(n[2:].split("_")[0]))


def documents(spark, texts, first=1):
    """doc_id and text, with columns whose names the operators use inside."""
    rows = [(first + i, t, "en", "s", 0, "x", 1.0, "y") for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, score double, h string"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()


# --- line dedup ------------------------------------------------------------------------------------------------

LINE = "a line of more than twenty characters"


def test_line_dedup_cases(spark):
    texts = [f"{LINE}\nown", f"  {LINE.upper()}\t\nother\n", f"{LINE}\n{LINE}\nlast", None, "", "short\nshort"]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.drop_repeated_lines(documents(spark, texts)).collect()}
    assert got == {
        1: ("own", 2, 1),
        2: ("other\n", 3, 1),
        3: (texts[2], 3, 0),  # the largest id that holds the line keeps all of it
        4: ("", 1, 0),
        5: ("", 1, 0),
        6: ("short\nshort", 2, 0),
    }


def test_line_dedup_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, LINE), (1, LINE), (None, LINE)], "doc_id long, text string")
    assert all(r["n_dropped"] == 0 for r in line_dedup.drop_repeated_lines(df).collect())  # two documents only
    df = df.union(spark.createDataFrame([(7, LINE)], "doc_id long, text string"))
    got = sorted(((r["doc_id"] or 0), r["n_dropped"]) for r in line_dedup.drop_repeated_lines(df).collect())
    assert got == [(0, 1), (1, 1), (1, 1), (7, 0)]


def test_lines_of_very_many_documents(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_ROWS", 4)
    rows = [(i, f"{LINE}\n" + (f"{LINE} again\n" if i % 4 == 0 else "") + f"own {i}") for i in range(20)] + [(None, LINE)] * 3
    got = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in got:
        if r["doc_id"] is None:
            assert (r["text"], r["n_dropped"]) == ("", 1)
        elif r["doc_id"] == 19:
            assert r["n_dropped"] == 0
        else:
            assert r["n_dropped"] == (1 if r["doc_id"] % 4 or r["doc_id"] == 16 else 2)


# --- SimHash ---------------------------------------------------------------------------------------------------


def slow_fingerprint(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def slow_components(ids, fps, radius):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                x, y = find(a), find(ids[j])
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_matches_brute_force(spark, sf_dir, docs):
    got = registry.QUERIES["op2_simhash_dedup"](spark, sf_dir).collect()
    fps = [slow_fingerprint(t, 4) for t in docs["text"]]
    want = slow_components(docs["doc_id"].tolist(), fps, 4)
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {d: f"{f:016x}" for d, f in zip(docs["doc_id"], fps, strict=True)}
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_similar_fingerprints_lose_no_link(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.int64)
    values = {int(b) for b in base}
    for b in base.tolist():
        for flips in (1, 3, 4, 5):
            v = b
            for bit in rng.choice(63, flips, replace=False).tolist():
                v ^= 1 << bit
            values.add(v)
    values |= {0, -1, 1, -2}
    values = sorted(values)
    want = {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= 4}
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    got = [(r["a"], r["b"]) for r in simhash_dedup.similar_fingerprints(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_embeddings_differ_by_the_manhattan_distance(spark):
    rng = np.random.default_rng(1)
    values = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 200)] + [0, -1, 1, -(2**63)]
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    for width in (1, 2, 3, 4, 8, 16):
        got = df.select(simhash_dedup.embedding(F.col("fp"), width).alias("e")).collect()
        counts = [[(v >> at & (1 << min(width, 64 - at)) - 1).bit_count() for at in range(0, 64, width)] for v in values]
        for i in range(0, len(values) - 1):
            distance = sum(abs(x - y) for x, y in zip(counts[i], counts[i + 1], strict=True))
            assert ((got[i]["e"] ^ got[i + 1]["e"]) & (1 << 64) - 1).bit_count() == distance


def test_dense_and_hot_cells_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(8)
    values = set()
    for center in rng.integers(0, 2**62, 3).tolist():
        for _ in range(120):  # a crowd around one value: many within 4 bits of each other, many not
            v = center
            for bit in rng.choice(40, int(rng.integers(0, 5)), replace=False).tolist():
                v ^= 1 << bit
            values.add(v)
    values = sorted(values | set(rng.integers(0, 2**62, 100).tolist()))
    for module in (cells, components):
        monkeypatch.setattr(module, "PART_ROWS" if module is cells else "HOT_ROWS", 8)
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    got = {r["fp"]: r["root"] for r in simhash_dedup.fingerprint_components(df).collect()}
    assert got == slow_components(values, values, 4)


def test_null_ends_take_no_part(spark):
    edges = spark.createDataFrame([(1, 2), (None, 2), (3, None), (4, 4), (2, 5)], "a long, b long")
    assert sorted(tuple(r) for r in connected_components(edges).collect()) == [(1, 1), (2, 1), (5, 1)]


def test_simhash_edge_rows(spark):
    texts = [None, "", " \n", "one", "ONE", "one two three four five", "one two three four five", "\x00 é  x" * 9]
    got = {r["doc_id"]: r["component_id"] for r in simhash_dedup.near_duplicate_classes(documents(spark, texts)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 6, 8: 8}
    df = documents(spark, texts)
    kept = simhash_dedup.keep_one_per_class(df, simhash_dedup.similar_text_classes(df))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 6, 8] and kept.columns == documents(spark, texts).columns


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 140)] + [(5, 5), (139, 100)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)}


# --- quality rules ---------------------------------------------------------------------------------------------


def slow_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if n[w] > 1:
            covered |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_base_counts_match_brute_force(spark, docs):
    texts = docs["text"].tolist() + [None, "", "a b c a b c", "x y z \x0b\x0c\r\n q", "##\n##\n \n \n", "a b a b a b a", "w " * 20_000]
    got = {r["doc_id"]: r for r in fertility_rules.judge_texts(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i + 1]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == slow_base(t), t
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_bands_reject_odd_texts_and_keep_plain_ones(spark, docs):
    plain = [t for t in docs["text"][docs["lang"] == "en"] if len(t.split()) > 80 and not re.search(r"[#%$*&]{3}|!!|\|", t)][:60]
    odd = " ".join(hashlib.sha256(str(i).encode()).hexdigest()[:12] for i in range(300))
    script = "ᚠᚱᛇ " * 30 + " ".join("ᚠᚱ" + str(i) for i in range(200))
    got = {r["doc_id"]: r for r in fertility_rules.judge_texts(documents(spark, [*plain, odd, script])).collect()}
    assert not got[len(plain) + 1]["kept"] and not got[len(plain) + 2]["kept"]
    assert got[len(plain) + 2]["byte_share"] > 0.5
    fine = [got[i + 1] for i in range(len(plain)) if not got[i + 1]["base_failed"]]
    assert len(fine) > 10 and all(r["kept"] for r in fine)


# --- language ID -----------------------------------------------------------------------------------------------


def slow_profile(text, size):
    counts = Counter()
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        padded = f"_{word}_"
        counts.update(g for n in (1, 2, 3) for i in range(len(padded) - n + 1) if (g := padded[i : i + n]) != "_")
    pack = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    return [pack(g) for g, _ in sorted(counts.items(), key=lambda x: (-x[1], pack(x[0])))][:size]


def test_out_of_place_distance_matches_brute_force(spark, docs):
    df = spark.createDataFrame(docs[["doc_id", "text", "lang"]])
    profiles = language_id.fit_profiles(df, "text", "lang")
    joined = {lang: " ".join(t for t, x in zip(docs["text"], docs["lang"], strict=True) if x == lang) for lang in set(docs["lang"])}
    assert profiles == {lang: slow_profile(t, 300) for lang, t in joined.items()}
    texts = docs["text"].head(20).tolist() + ["Ünïcode 123 x", "a", "İı ß ſ"]
    for r in language_id.identify(documents(spark, texts), profiles).collect():
        own = slow_profile(texts[r["doc_id"] - 1], 300)
        far = {
            lang: sum(abs(i - p.index(g)) if g in p else 300 for i, g in enumerate(own)) for lang, p in sorted(profiles.items())
        }
        best = min(far, key=lambda lang: (far[lang], lang))
        assert r["lang_pred"] == best and abs(r["score"] - (1 - far[best] / (300 * len(own)))) < 1e-12


def test_profiles_for_the_most_frequent_languages_only(spark):
    rows = [("alpha beta", "a")] * 5 + [("gamma delta", "b")] * 3 + [("epsilon", "c"), ("zeta", None)]
    df = spark.createDataFrame(rows, "text string, lang string")
    assert sorted(language_id.fit_profiles(df, "text", "lang", most=2)) == ["a", "b"]


def test_language_accuracy_and_unknown(spark, sf_dir, docs):
    got = {r["doc_id"]: r for r in registry.QUERIES["op7_language_id"](spark, sf_dir).collect()}
    held = [d for d in docs["doc_id"] if zlib.crc32(str(d).encode()) % 4 == 2]
    assert sorted(d for d in got if got[d]["held_out"]) == sorted(held)
    lang = dict(zip(docs["doc_id"], docs["lang"], strict=True))
    assert np.mean([got[d]["lang_pred"] == lang[d] for d in held]) > 0.97
    out = language_id.identify(documents(spark, [None, "", "12 34 ² !", "the"]), {"en": slow_profile("the end", 300)}).collect()
    assert [(r["lang_pred"], r["score"] > 0) for r in out] == [("und", False)] * 3 + [("en", True)]
    assert [r["lang_pred"] for r in language_id.identify(documents(spark, ["the"]), {}).collect()] == ["und"]


# --- secrets ---------------------------------------------------------------------------------------------------


def slow_secrets(text):
    found = []
    rules = (
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 8),
        ("access", r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 16),
        ("hex", r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 32),
    )
    for place, (kind, rx, flags, ok) in enumerate(rules):
        found += [(m.start(), place, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(rx, text or "", flags) if ok(m)]
    return ",".join(x[2] for x in sorted(found))


RANDOM = "Zx9Qf7Lw2Kp8Vn3Rt6Yb1Mc"


def test_secret_spans(spark, docs):
    texts = docs["text"].tolist() + [
        None, "", f"x {RANDOM} y", 'PassWord : "hunter2hunter2" Key', "token=short", "AKIA" + "Z" * 12, "AKIAX", "a" * 32, "f" * 31,
        "api_key='secret=abcdefgh12'", "very_long_identifier_name_here", "SomeCamelCaseIdentifier", "https://host/path/to/some/page",
        "123e4567-e89b-12d3-a456-426614174000", "é" * 50 + " token = " + "ab" * 20,
    ]
    got = {r["doc_id"]: r for r in secret_scan.find_secrets(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want, r = slow_secrets(t), got[i + 1]
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), t
        kinds = Counter(x.split(":")[0] for x in want.split(",") if x)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))
    at = len(docs)
    assert got[at + 3]["spans"] == f"opaque:2:{2 + len(RANDOM)}"
    assert [got[at + k]["n_opaque"] for k in (11, 12, 13, 14)] == [0] * 4


# --- toxicity --------------------------------------------------------------------------------------------------


def test_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    chain = toxic_crf.Chain(np.zeros(toxic_crf.BUCKETS), 0.0, 0.4, -0.7, 0.3, 1.1)
    lengths = np.array([1, 4, 3])
    e = rng.normal(size=8)
    starts = np.array([0, 1, 5])
    p, _ = toxic_crf.marginals(e, starts, lengths, chain)
    step = {(0, 0): 0.0, (0, 1): chain.to_one, (1, 0): chain.to_zero, (1, 1): chain.stay_one}
    for s, n in zip(starts, lengths, strict=True):
        total, ones = 0.0, np.zeros(n)
        for bits in range(2**n):
            y = [bits >> i & 1 for i in range(n)]
            w = np.exp(sum(e[s + i] for i in range(n) if y[i]) + chain.start * y[0] + sum(step[y[i], y[i + 1]] for i in range(n - 1)))
            total += w
            ones += w * np.array(y)
        assert np.allclose(p[s : s + n], ones / total)


def test_toxic_scores(spark):
    rng = np.random.default_rng(6)
    filler = [f"{a}{b}" for a in ("ba", "co", "di", "fu", "ge", "ho") for b in ("lan", "mer", "nis", "pot", "rus")]
    plain = lambda: " ".join(rng.choice(filler, 12))
    insults = ["idiot", "moron", "scumbag"]
    texts = [plain() if i % 2 == 0 else f"{plain()} {insults[i % 3]} {plain()}" for i in range(240)]
    df = documents(spark, texts)
    labels = spark.createDataFrame([(i + 1, i % 2) for i in range(len(texts))] + [(10_000, 1), (3, None)], "doc_id long, toxic int")
    chain = toxic_crf.fit(df, labels)
    test = documents(spark, ["what an Idiot!", "balan comer dinis", None, "", "MORON moron " * 5_000, "what an Idiot!"])
    got = {r["doc_id"]: r for r in toxic_crf.score_documents(test, chain).collect()}
    assert [got[i]["predicted"] for i in range(1, 7)] == [1, 0, 0, 0, 1, 1]
    assert got[1]["spans"] == "8:14" and got[1]["score"] == got[6]["score"] and got[3]["score"] == got[4]["score"]
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_long_lines_take_part_in_the_fit(spark):
    rng = np.random.default_rng(3)
    plain = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(240):  # all in one line, most of them far beyond 4,000 characters
        words = rng.choice(plain, 1_500).tolist()
        if i % 3 == 0:
            words[int(rng.integers(0, 1_500))] = "vilest"
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    chain = toxic_crf.fit(docs, labels, least_judged=10)
    assert chain is not None
    score = toxic_crf.make_scorer(chain)
    bad, good = score([" ".join(plain[:900] + ["vilest"] + plain[:900]), " ".join(plain * 5)])["max_marginal"]
    assert bad > 0.5 > good


def test_toxicity_on_held_out_rows(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    got = {r["doc_id"]: r for r in registry.QUERIES["op1_toxic_crf"](spark, sf).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(got[d]["score"], y) for d, y in labels.items() if got[d]["held_out"]]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg]) > 0.8


def test_no_labels_scores_zero(spark):
    df = documents(spark, ["a b", None])
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxic_crf.fit(df, labels) is None
    assert [r["score"] for r in toxic_crf.score_documents(df, None).collect()] == [0.0, 0.0]


# --- all -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ALL_OPS)
def test_empty_tables(spark, sf_dir, tmp_path, name):
    for t in ("documents", "labels", "embeddings"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert registry.QUERIES[name](spark, str(tmp_path)).count() == 0


# --- a readable path does not hide a random part, letters of one case are tested -----------------------------------


def test_secret_parts(spark):
    letters = "qzvkxjwpfhbgmtrcydnulsoeiaqxzkvj"
    texts = [
        f"get /com/account/settings/download/verification/{RANDOM}/documents/public/information now",
        f"key {letters} and {letters.upper()}",
        "internationalization/electroencephalography INTERNATIONALIZATION Krankenversicherung counterrevolutionary",
        f"objects/{'0123456789abcdef' * 2 + '01234567'}/download/documents/public",
    ]
    rows = secret_scan.find_secrets(documents(spark, texts)).select("doc_id", "spans", "n_opaque").collect()
    got = {r["doc_id"]: r for r in rows}
    first = min(got)
    spans = got[first]["spans"].split(":")
    assert got[first]["n_opaque"] == 1 and texts[0][int(spans[1]) : int(spans[2])] == RANDOM
    assert [got[first + i]["n_opaque"] for i in (1, 2, 3)] == [2, 0, 0]


def test_secret_letter_groups(spark):
    """Random groups of letters joined by separators are found, names of words are not; short groups and digests say nothing."""
    import random

    draw = random.Random(3)
    noise = ["-".join("".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(5)) for _ in range(300)]
    names = ["very_long_identifier_name_here", "SomeCamelCaseIdentifier", "user/account/settings/page", "MAX_CONNECTION_TIMEOUT_SECONDS", "a-b-c-d-e-f-g-h-i-j", "2024-01-02-03-04-05", "123e4567-e89b-12d3-a456-426614174000"]
    rows = secret_scan.find_secrets(documents(spark, noise + names)).select("doc_id", "spans", "n_opaque").collect()
    got = {r["doc_id"]: r for r in rows}
    first = min(got)
    found = [got[first + i]["spans"] == f"opaque:0:{len(x)}" for i, x in enumerate(noise)]
    assert sum(found) >= 294
    assert [got[first + len(noise) + i]["n_opaque"] for i in range(len(names))] == [0] * len(names)


def test_fertility_counts_of_many_characters(spark):
    """A text of many distinct characters is counted in one pass, as a text of few is."""
    text = "".join(chr(0x4E00 + i % 5_000) for i in range(60_000)) + " # ab"
    r = fertility_rules.measure_texts(documents(spark, [text])).first()
    assert (r["n_words"], r["word_chars"], r["n_symbols"], r["script"]) == (3, len(text) - 2, 1, "CJK")
