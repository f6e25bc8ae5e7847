"""Fertility metrics and bands against slow versions."""

import math
from collections import Counter

from caselake.llm import fertility_rules
from caselake.llm.tokenizer import load_byte_bpe, load_pieces


def test_metrics(spark):
    texts = ["the quick brown fox # jumps", "naïve café – 漢字 and more", "кошка сидит на окне", "x" * 50, "😀😀 𝔘 ok"]
    encoder, pieces = load_byte_bpe(), load_pieces()
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in fertility_rules.measure_texts(rows).collect()}
    for i, t in enumerate(texts):
        ids = list(encoder.encode(t))
        shares = [n / len(ids) for n in Counter(ids).values()]
        spelled = sum(pieces.is_byte(p) for p in pieces.encode(t))
        assert math.isclose(got[i]["chars_per_token"], len(t) / len(ids))
        assert math.isclose(got[i]["byte_share"], spelled / len(t.encode()))
        assert math.isclose(got[i]["entropy"], -sum(s * math.log2(s) for s in shares), abs_tol=1e-12)


def test_bands(spark):
    """Quartiles of all rows of a language, widened; few rows of one take the script's band."""
    rows = [("aa", "LATIN", 2 + i / 50, 0.1 * (i % 3), 5.0) for i in range(120)] + [("bb", "LATIN", 9.0, 0.0, 5.0)] * 7
    measured = spark.createDataFrame(rows, "lang string, script string, chars_per_token double, byte_share double, entropy double")
    got = {r["__own_lang"]: r for r in fertility_rules.fit_bands(measured, ["lang", "script"], width=2.0).collect()}
    assert (got["aa"]["band"], got["bb"]["band"]) == ("lang", "script")

    def limits(values, floor):
        held = sorted(values)
        low, high = (held[math.ceil(p * len(held)) - 1] for p in (0.25, 0.75))
        reach = max(2.0 * (high - low), floor)
        return low - reach, high + reach

    for lang, group in (("aa", rows[:120]), ("bb", rows)):
        for j, (metric, floor) in enumerate((("chars_per_token", 0.3), ("byte_share", 0.02), ("entropy", 1.5))):
            low, high = limits([r[2 + j] for r in group], floor)
            assert math.isclose(got[lang][f"low_{metric}"], low) and math.isclose(got[lang][f"high_{metric}"], high)
