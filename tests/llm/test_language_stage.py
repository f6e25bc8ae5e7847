"""The language stage of the pipeline on texts of no known language."""

import math
import random
from collections import Counter

import corpus_pipeline
from caselake.llm.language_id import above_floors, collect_profiles, fit_floors, fit_profiles, identify, identify_by_table, profile_rows, training_rows
from pyspark.sql import functions as F


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string")


def test_noise_goes_and_clean_texts_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(5)
    noise = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(80)) for _ in range(10)]
    other = ["Москва столица России и крупный город страны с большой историей " * 5]
    more = spark.createDataFrame([(10**9 + i, t, None) for i, t in enumerate(noise + other)], "doc_id long, text string, lang string")
    kept = {r[0] for r in corpus_pipeline.language_stage(spark, docs.unionByName(more), sf_dir).select("doc_id").collect()}
    labelled = {r[0] for r in docs.filter("lang is not null and text rlike '\\\\p{L}'").select("doc_id").collect()}
    assert labelled <= kept and not any(i >= 10**9 for i in kept)


def test_no_labels_keep_texts_with_a_letter(spark, sf_dir):
    rows = [("some words here", None), ("12 34 !", None), (None, None), ("Ω", None)]
    kept = corpus_pipeline.language_stage(spark, frame(spark, rows), sf_dir).collect()
    assert sorted(r["doc_id"] for r in kept) == [0, 3]


def test_rare_language_keeps_its_training_rows(spark):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4_000 == 1, "pl").otherwise("en").alias("lang"))
    everything = {r["lang"]: r["count"] for r in training_rows(docs, "doc_id", bound=10**6).groupBy("lang").count().collect()}
    got = {r["lang"]: r["count"] for r in training_rows(docs, "doc_id", bound=500).groupBy("lang").count().collect()}
    assert got["pl"] == everything["pl"] > 0 and 350 < got["en"] < 650


def test_every_labelled_row_trains(spark, sf_dir):
    """Half of the rows of a large language look otherwise: those that a sample by hash of 20,000 of them leaves out."""
    part = F.pmod(F.xxhash64(F.lit(11), F.col("id")), F.lit(1 << 20)) / (1 << 20)
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(part < 0.5, "aa").otherwise("zz").alias("text"), F.lit("en").alias("lang"))
    kept = corpus_pipeline.language_stage(spark, docs, sf_dir)
    assert {r["text"]: r["count"] for r in kept.groupBy("text").count().collect()} == {r["text"]: r["count"] for r in docs.groupBy("text").count().collect()}


def test_every_language_gets_a_profile(spark, sf_dir):
    rows = [(chr(0x4E00 + 2 * i) + chr(0x4E01 + 2 * i), f"l{i}") for i in range(1_010) for _ in range(8)] + [("zz", None)]
    kept = {r["doc_id"] for r in corpus_pipeline.language_stage(spark, frame(spark, rows), sf_dir).collect()}
    assert kept == set(range(len(rows) - 1))


def test_profiles_in_turns_are_those_in_one_pass(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(60).select("text", "lang").collect()]
    labelled = frame(spark, rows + [("aa", "x"), ("zz yy", "v"), ("zz yy", "w"), ("12", "u")])
    table = profile_rows(labelled, "text", "lang")
    profiles = collect_profiles(table)
    assert profiles == fit_profiles(labelled, "text", "lang") and {"en", "v", "w", "x"} < set(profiles) and "u" not in profiles
    texts = [t for t, _ in rows] + ["zz yy", "ЖЖ", "", None, "12", "zz yy"]
    asked = spark.createDataFrame([(i % 62 or None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    order = lambda df: sorted(map(tuple, df.collect()), key=repr)
    whole = order(identify(asked, profiles))
    assert order(identify_by_table(asked, table, block=3)) == whole
    inside = identify_by_table(asked.select(F.struct("*").alias("row")), table, "row", "row.text", block=2)
    assert order(inside.select("row.doc_id", "lang_pred", "score")) == whole


def test_counts_are_whole_where_tasks_send_them_in_parts(spark):
    rng = random.Random(3)
    texts = ["".join(chr(0x4E00 + min(int(rng.expovariate(0.001)), 9_000)) for _ in range(3_000)) for _ in range(150)]
    counts = Counter()
    for t in texts:
        padded = f"_{t}_"
        counts.update(g for n in (1, 2, 3) for i in range(len(padded) - n + 1) if (g := padded[i : i + n]) != "_")
    pack = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    best = [pack(g) for g, _ in sorted(counts.items(), key=lambda x: (-x[1], pack(x[0])))][:300]
    rows = frame(spark, [(t, lang) for t in texts for lang in ("a", "b")])
    assert len(counts) > 500_000
    for n in (1, 3):
        assert collect_profiles(profile_rows(rows.repartition(n), "text", "lang")) == {"a": best, "b": best}


def test_floors_are_exact_quartiles(spark):
    rng = random.Random(9)
    rows = [("en", rng.random() ** 0.02) for _ in range(50_000)] + [("de", rng.choice([0.9, 0.95, 1.0])) for _ in range(101)]
    rows += [("pl", 0.5)] * 99 + [("und", 0.0)] * 200

    def floor(scores):
        low, high = (sorted(scores)[math.ceil(p * len(scores)) - 1] for p in (0.25, 0.75))
        return max(0.0, low - max(0.5 * (high - low), 0.001))

    scored = spark.createDataFrame(rows, "lang_pred string, score double")
    fitted = fit_floors(scored.repartition(7), width=0.5, least_reach=0.001)
    got = {r["lang_pred"]: r["floor"] for r in fitted.collect()}
    expected = {lang: floor([x for k, x in rows if k == lang]) for lang in ("en", "de")} | {None: floor([x for k, x in rows if k != "und"])}
    assert got == expected
    kept = Counter(map(tuple, above_floors(scored, fitted).collect()))
    assert kept == Counter((k, x) for k, x in rows if k != "und" and x >= expected.get(k, expected[None]))


def test_few_labelled_rows_have_no_floor(spark):
    scored = spark.createDataFrame([("en", i / 100) for i in range(99)] + [("und", 0.0)] * 9, "lang_pred string, score double")
    assert fit_floors(scored).count() == 0 and above_floors(scored, fit_floors(scored)).count() == 99
