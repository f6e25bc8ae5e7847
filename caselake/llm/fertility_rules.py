"""Quality rules on tokeniser fertility.

A public byte-level BPE measures how well a text packs: characters per token and token entropy.  The
byte-fallback share is the share of a text's bytes in characters that a public BPE with byte fallback
has no piece for and must spell out byte by byte.  Texts of a language that the vocabularies know pack
alike; encoded data, mixed scripts and keyboard noise do not.  The rejection bands are fitted per
language (or per script where the language is unknown) over all documents: the quartiles, widened on
both sides by ``width`` interquartile ranges.
"""

from __future__ import annotations

import unicodedata
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, VOCAB_DIR, map_texts, materialize, table
from .tokenizer import load_byte_bpe, load_pieces

SYMBOLS = "#*$%&|<>"
METRICS = ("chars_per_token", "byte_share", "entropy")
#: Bands are one row for each language or script; up to this number they are broadcast.
MOST_BROADCAST_BANDS = 10_000


def split_words(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` in UTF-8: bytes split at ASCII white space only."""
    return text.encode("utf-8", "surrogatepass").split()


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that the text has twice or more, the first one included."""
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    total, covered = 0, 0  # covered: end of the words counted so far
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + 3 - max(i, covered)
            covered = i + 3
    return total


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line of the text."""
    lines = [x for x in text.split("\n") if x.strip(ASCII_SPACE)]
    return len(lines) - len(set(lines))


def script_of(chars: dict[str, int]) -> str:
    """The script of most letters of ``chars`` (character -> count), by the first word of their Unicode names; ``NONE`` without a letter."""
    seen: Counter = Counter()
    for c, n in chars.items():
        if c.isalpha():
            seen[unicodedata.name(c, "UNKNOWN").split(" ")[0]] += n
    return min(seen, key=lambda s: (-seen[s], s)) if seen else "NONE"


#: Distinct characters up to which each is counted by a search of its own.
FEW_CHARS = 128


class _Vocabulary:
    """What the tokenisers say of a text."""

    def __init__(self, vocab_dir: str, vocabulary: str, pieces: str) -> None:
        self.encoder, self.pieces = load_byte_bpe(vocab_dir, vocabulary), load_pieces(vocab_dir, pieces)
        #: character -> bytes that it falls back to; white space is normalised and never falls back
        self.fallback: dict[str, int] = {}

    def fallback_bytes(self, char: str) -> int:
        n = self.fallback.get(char)
        if n is None:
            spelled = not char.isspace() and self.pieces.piece_to_id(char) == self.pieces.unk_id()
            n = len(char.encode("utf-8", "surrogatepass")) if spelled else 0
            self.fallback[char] = n
        return n

    def measure(self, text: str, chars: dict[str, int]) -> tuple[float, float, float]:
        """Characters per token, byte-fallback share, token entropy in bits."""
        ids = self.encoder.encode(text)
        share = np.unique(ids, return_counts=True)[1] / len(ids)
        spelled = sum(n * chars[c] for c in chars if (n := self.fallback_bytes(c)))
        return len(text) / len(ids), spelled / len(text.encode("utf-8", "surrogatepass")), float(-(share * np.log2(share)).sum())


def measure_texts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = "byte_bpe_50k.tiktoken",
    pieces: str = "piece_bpe_32k.model",
    vocab_dir: str = VOCAB_DIR,
) -> DataFrame:
    """Base counts, script and the fertility metrics of every whole text (null text: no words, null metrics)."""

    def make():
        vocab = _Vocabulary(vocab_dir, vocabulary, pieces)
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "script", *METRICS)

        def work(texts: list[str | None]) -> dict:
            out = {k: [] for k in names}
            for text in texts:
                text = text or ""
                words = split_words(text)
                distinct = set(text)
                # a search for each of few characters is quickest; with many, one pass counts them all
                chars = {c: text.count(c) for c in distinct} if len(distinct) <= FEW_CHARS else Counter(text)
                row = (
                    len(words),
                    len(text) - sum(chars.get(c, 0) for c in ASCII_SPACE),
                    sum(chars.get(c, 0) for c in SYMBOLS),
                    duplicate_lines(text),
                    repeated_words(words),
                    script_of(chars),
                    *(vocab.measure(text, chars) if words else (None, None, None)),
                )
                for k, v in zip(names, row, strict=True):
                    out[k].append(v)
            return out

        return work

    return map_texts(
        docs,
        id_col,
        text_col,
        make,
        "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
        "script string, chars_per_token double, byte_share double, entropy double",
    )


def fit_bands(
    measured: DataFrame, levels: list[str], width: float = 4.0, floors: dict[str, float] | None = None, least_rows: int = 100
) -> DataFrame:
    """Lowest and highest accepted value of each metric for every combination of ``levels``, from the quartiles over all rows.

    A combination has the band of its first level, if ``least_rows`` or more rows have that value, else of the next, at last of the
    whole table: a few rows always lie inside their own quartiles.  ``floors`` gives the least half-width of a
    metric's band, for groups whose values hardly differ.
    """
    floors = {"chars_per_token": 0.3, "byte_share": 0.02, "entropy": 1.5} | (floors or {})
    cuts = [F.percentile_approx(m, [0.25, 0.75], 10_000).alias(f"q_{m}") for m in METRICS]
    each = [F.struct(F.lit(c).alias("level"), F.col(c).alias("value")) for c in levels]
    every = F.struct(F.lit("all").alias("level"), F.lit(None).cast("string").alias("value"))
    groups = measured.select(*METRICS, F.explode(F.array(*each, every)).alias("g")).filter((F.col("g.level") == "all") | F.col("g.value").isNotNull())
    cols = [F.col("g.level").alias("level"), F.col("g.value").alias("value"), "n"]
    for m in METRICS:
        low, high = F.get(f"q_{m}", F.lit(0)), F.get(f"q_{m}", F.lit(1))
        reach = F.greatest((high - low) * width, F.lit(floors[m]))
        cols += [(low - reach).alias(f"low_{m}"), (high + reach).alias(f"high_{m}")]
    bands = materialize(groups.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *cuts).select(*cols), "bands")
    limits = [f"{side}_{m}" for m in METRICS for side in ("low", "high")]
    out = measured.select(*levels).distinct()
    chosen = None
    for c in [*levels, "all"]:
        own = F.struct(F.lit(c).alias("band"), *limits)
        enough = F.lit(True) if c == "all" else F.col("n") >= least_rows
        known = bands.filter((F.col("level") == c) & enough).select(F.col("value").alias(f"__{c}"), own.alias(f"__b_{c}"))
        out = out.join(known, F.lit(True) if c == "all" else F.col(c) == F.col(f"__{c}"), "left")
        chosen = F.col(f"__b_{c}") if chosen is None else F.coalesce(chosen, F.col(f"__b_{c}"))
    return out.select(*[F.col(c).alias(f"__own_{c}") for c in levels], chosen.alias("b")).select(*[f"__own_{c}" for c in levels], "b.*")


def _outside(metric: str) -> Column:
    return ~F.coalesce(F.col(metric).between(F.col(f"low_{metric}"), F.col(f"high_{metric}")), F.lit(True))


def judge_texts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str | None = "lang",
    min_words: int = 50,
    width: float = 4.0,
    least_rows: int = 100,
    **vocabularies,
) -> DataFrame:
    """One row per row of ``docs``: base counts, metrics, ``base_failed`` and ``kept``.

    ``base_failed``: fewer than ``min_words`` words, or more than half of the words in repeated
    3-word windows.  ``kept``: not base-failed and every metric inside the band of the document's
    language; where that is null (or ``lang_col`` is None), or fewer than ``least_rows`` such documents pass the base, the
    script's band counts, or else the whole table's.  Null and empty
    texts have no words and fail.  The ids of repeated rows repeat.  An empty table gives an empty table.
    ``width`` 4 leaves out only texts far from all others of their language.
    """
    source = docs.select(
        F.struct(F.col(id_col).alias("id"), (F.col(lang_col) if lang_col else F.lit(None).cast("string")).alias("lang")).alias("key"),
        F.col(text_col).alias("text"),
    )
    measured = measure_texts(source, "key", "text", **vocabularies)
    base_failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    measured = materialize(
        measured.select(
            F.col("key.id").alias("__id"),
            F.col("key.lang").alias("lang"),
            *[c for c in measured.columns if c != "key"],
        ).withColumn("base_failed", base_failed),
        "fertility",
    )
    bands = materialize(fit_bands(measured.filter(~F.col("base_failed")), ["lang", "script"], width, least_rows=least_rows), "chosen_bands")
    if bands.count() <= MOST_BROADCAST_BANDS:
        bands = F.broadcast(bands)  # else Spark chooses: a dirty language column can hold any number of values
    own = F.col("lang").eqNullSafe(F.col("__own_lang")) & F.col("script").eqNullSafe(F.col("__own_script"))
    joined = measured.join(bands, own, "left")
    rejected = F.lit(False)
    for m in METRICS:
        rejected = rejected | _outside(m)
    return joined.select(
        F.col("__id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & ~rejected).alias("kept"),
        *METRICS,
        F.when(F.col("band") == "lang", F.concat(F.lit("lang "), "lang"))
        .when(F.col("band") == "script", F.concat(F.lit("script "), "script"))
        .otherwise(F.col("band"))
        .alias("band"),
    )


def op3_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, fertility metrics and the verdict for every document."""
    return judge_texts(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
