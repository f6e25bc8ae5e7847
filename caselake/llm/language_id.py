"""Language identification with rank-order profiles.

A profile is the list of a language's most frequent letter n-grams (1 to 3 characters of words
padded with ``_``), most frequent first, ties in a fixed order.  A document is compared with each
profile by the out-of-place distance: for each of its own most frequent n-grams, how far its rank is
from the rank in the profile, or the whole profile length where the profile lacks it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import running_sums
from .common import discard, id_remainder, map_texts, materialize, table

UNKNOWN = "und"
#: Tables of one row for each language are broadcast up to this number.
MOST_BROADCAST_LANGUAGES = 10_000


def broadcast_if_few(by_language: DataFrame, name: str) -> DataFrame:
    """Written, then broadcast if it is small; else Spark chooses the join: a dirty language column can hold any number of values."""
    out = materialize(by_language, name)
    return F.broadcast(out) if out.count() <= MOST_BROADCAST_LANGUAGES else out


class Ngrams:
    """Counts the n-grams of texts; an n-gram is its code points, 21 bits each, packed in one integer."""

    SEPARATOR = ord("_")

    def __init__(self, longest: int) -> None:
        if not 1 <= longest <= 3:
            raise ValueError("longest must be 1, 2 or 3")
        self.longest = longest
        self.letter = np.full(0x110000, 2, dtype=np.uint8)  # 2: not looked up yet

    def count(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams in ascending order and their counts; none where the text has no letter."""
        raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kind = self.letter[raw]
        if (kind == 2).any():
            for c in np.unique(raw[kind == 2]).tolist():
                self.letter[c] = chr(c).isalpha()
            kind = self.letter[raw]
        is_letter = kind == 1
        if not is_letter.any():
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        chars = np.full(len(raw) + 2, self.SEPARATOR, dtype=np.int64)
        chars[1:-1][is_letter] = raw[is_letter]
        inner = np.zeros(len(chars), dtype=bool)
        inner[1:-1] = is_letter
        # each run of other characters is one separator
        keep = inner | np.r_[True, inner[:-1]]
        chars, inner = chars[keep], inner[keep]
        parts = [chars[inner]]
        if self.longest > 1:
            both = inner[:-1] | inner[1:]
            parts.append((chars[:-1] << 21 | chars[1:])[both])
        if self.longest > 2:
            parts.append((chars[:-2] << 42 | chars[1:-1] << 21 | chars[2:])[inner[1:-1]])
        return np.unique(np.concatenate(parts), return_counts=True)


def top_ranked(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent n-grams, most frequent first, ties by code points."""
    return grams[np.argsort(-counts, kind="stable")[:size]]


def profile_rows(labelled: DataFrame, text_col: str, lang_col: str, size: int = 300, longest: int = 3) -> DataFrame:
    """``lang``, ``gram`` and ``rank`` (from 1) of the ``size`` most frequent n-grams of each non-null language of ``labelled``.

    Every row is counted: partial sums by task, added up by Spark.
    """
    from pyspark.sql import Window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ngrams = Ngrams(longest)
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}  # language: n-grams in ascending order, counts
        parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}  # not yet in sums
        held = waiting = 0

        def add_up() -> None:
            nonlocal held, waiting
            for lang, own in parts.items():
                if lang in sums:
                    held -= len(sums[lang][0])
                    own.append(sums[lang])
                grams, counts = (np.concatenate(x) for x in zip(*own, strict=True))
                order = np.argsort(grams, kind="stable")
                grams, counts = grams[order], counts[order]
                first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
                sums[lang] = grams[first], np.add.reduceat(counts, first)
                held += len(first)
            parts.clear()
            waiting = 0

        def flush() -> pa.RecordBatch:
            nonlocal held
            add_up()
            langs = [pa.repeat(pa.scalar(lang, pa.string()), len(grams)) for lang, (grams, _) in sums.items()]
            grams, counts = (np.concatenate([np.empty(0, dtype=np.int64), *(x[i] for x in sums.values())]) for i in (0, 1))
            sums.clear()
            held = 0
            names = pa.concat_arrays([pa.array([], pa.string()), *langs])
            return pa.RecordBatch.from_arrays([names, pa.array(grams), pa.array(counts)], ["lang", "gram", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grams, counts = ngrams.count(text or "")
                if not len(grams):
                    continue
                parts.setdefault(lang, []).append((grams, counts))
                waiting += len(grams)
                if waiting > 200_000:
                    add_up()
                    if held > 500_000:
                        yield flush()
        yield flush()

    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return (
        labelled.filter(F.col(lang_col).isNotNull())
        .select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
        .mapInArrow(run, "lang string, gram bigint, n bigint")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= size)
        .select("lang", "gram", "rank")
    )


def collect_profiles(rows: DataFrame) -> dict[str, list[int]]:
    """Profiles from :func:`profile_rows` in the driver."""
    profiles: dict[str, list[int]] = {}
    for r in rows.orderBy("lang", "rank").collect():
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


def fit_profiles(
    labelled: DataFrame, text_col: str, lang_col: str, size: int = 300, longest: int = 3, most: int = 1_000
) -> dict[str, list[int]]:
    """``size`` n-grams for each non-null language of ``labelled``, see :func:`profile_rows`.

    Profiles go to the driver and to all tasks, so at most ``most`` languages, those of most rows, get one.
    """
    known = labelled.filter(F.col(lang_col).isNotNull())
    names = known.groupBy(lang_col).agg(F.count(F.lit(1)).alias("__n")).orderBy(F.desc("__n"), lang_col).limit(most).select(lang_col)
    return collect_profiles(profile_rows(known.join(F.broadcast(names), lang_col, "left_semi"), text_col, lang_col, size, longest))


def identify(
    docs: DataFrame,
    profiles: dict[str, list[int]],
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 300,
    longest: int = 3,
) -> DataFrame:
    """``id_col``, ``lang_pred`` and ``score`` for every row.

    ``score`` is 1 less the distance as a share of its maximum, 0 to 1.  The nearest profile wins,
    ties by language name.  ``und`` with score 0: null text, text without a letter, or no profile.
    Whole texts are read; repeated rows come back once each; an empty table gives an empty table.
    """
    langs = sorted(profiles)

    known = np.array(sorted({g for p in profiles.values() for g in p}), dtype=np.int64)
    ranks = np.full((len(known) + 1, len(langs)), size, dtype=np.int32)  # the last row: in no profile
    for j, lang in enumerate(langs):
        ranks[np.searchsorted(known, profiles[lang]), j] = np.arange(len(profiles[lang]))

    def make():
        ngrams = Ngrams(longest)

        def work(texts: list[str | None]) -> dict:
            preds, scores = [], []
            for text in texts:
                grams, counts = ngrams.count(text or "")
                if not len(grams) or not langs:
                    preds.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                own = top_ranked(grams, counts, size)
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                places = ranks[np.where(known[at] == own, at, len(known))]
                away = np.where(places == size, size, np.abs(places - np.arange(len(own))[:, None]))
                total = away.sum(axis=0)
                best = int(total.argmin())
                preds.append(langs[best])
                scores.append(1.0 - float(total[best]) / (len(own) * size))
            return {"lang_pred": preds, "score": scores}

        return work

    return map_texts(docs, id_col, text_col, make, "lang_pred string, score double", block_chars=1_000_000)


def identify_by_table(
    docs: DataFrame, profiles: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 300, longest: int = 3, block: int = 128
) -> DataFrame:
    """:func:`identify` with the profiles of any number of languages, in a table (:func:`profile_rows`).

    Up to ``block`` languages are one pass.  More take turns of about as many, dealt by a hash of the name; each row keeps the nearest
    language so far, so neither the driver nor a task holds more than a turn's profiles.  ``text_col`` may lie inside ``id_col``.
    """
    turns = max(1, -(-profiles.select("lang").distinct().count() // block))
    if turns == 1:
        return identify(docs, collect_profiles(profiles), id_col, text_col, size, longest)
    columns = dict.fromkeys([id_col, text_col.split(".")[0]])
    best = docs.select(*columns, F.lit(None).cast("string").alias("__lang"), F.lit(-1.0).alias("__score"))
    for turn in range(turns):
        own = collect_profiles(profiles.filter(F.pmod(F.xxhash64("lang"), F.lit(turns)) == turn))
        if not own:
            continue
        # text_col is read from the row itself, so it goes along once
        rows = best.select(F.struct(*best.columns).alias("__row"))
        seen = identify(rows, own, "__row", f"__row.{text_col}", size, longest)
        # the share of the same maximum: scores are equal where distances are
        tie = (F.col("score") == F.col("__row.__score")) & (F.col("lang_pred") < F.col("__row.__lang"))
        nearer = (F.col("score") > F.col("__row.__score")) | tie
        after = materialize(
            seen.select(
                *[F.col(f"__row.{c}").alias(c) for c in columns],
                F.when(nearer, F.col("lang_pred")).otherwise(F.col("__row.__lang")).alias("__lang"),
                F.when(nearer, F.col("score")).otherwise(F.col("__row.__score")).alias("__score"),
            ),
            "nearest_so_far",
        )
        discard(best)
        best = after
    return best.select(id_col, F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))


def fit_floors(scored: DataFrame, width: float = 3.0, least_reach: float = 0.25, least_rows: int = 100) -> DataFrame:
    """``lang_pred`` and ``floor``: lowest score of a text of each predicted language, from ``scored`` labelled rows (``lang_pred``, ``score``).

    The lower quartile less ``width`` interquartile ranges, ``least_reach`` at least.  Null stands for all rows.  There is no row for
    fewer than ``least_rows`` rows.  A quartile is the smallest score that a quarter (three quarters) of the rows do not exceed, exactly:
    equal scores are counted first, and the counts summed in the order of scores by ranges.
    """
    counts = scored.filter(F.col("lang_pred") != UNKNOWN).groupBy("lang_pred", "score").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select(F.explode(F.array("lang_pred", F.lit(None).cast("string"))).alias("lang_pred"), "score", "n")
    counts = counts.groupBy("lang_pred", "score").agg(F.sum("n").alias("n"))
    sums = running_sums(counts, ["lang_pred", "score"], "n", "before")
    groups = sums.groupBy(F.col("lang_pred").alias("__lang")).agg(F.sum("n").alias("rows"), F.min("before").alias("start"))
    groups = broadcast_if_few(groups.filter(F.col("rows") >= least_rows), "language_counts")

    def quantile(share: float) -> Column:
        return F.max(F.when(F.col("before") < F.col("start") + F.ceil(F.col("rows") * share), F.col("score")))

    cuts = (
        sums.join(groups, F.col("lang_pred").eqNullSafe(F.col("__lang")))
        .groupBy("lang_pred")
        .agg(quantile(0.25).alias("low"), quantile(0.75).alias("high"))
    )
    reach = F.greatest(width * (F.col("high") - F.col("low")), F.lit(least_reach))
    return cuts.select("lang_pred", F.greatest(F.lit(0.0), F.col("low") - reach).alias("floor"))


def above_floors(scored: DataFrame, floors: DataFrame) -> DataFrame:
    """Rows of ``scored`` at or above the floor of their predicted language, or that of all rows where it has none; ``UNKNOWN`` ones go."""
    floors = materialize(floors, "floors")
    pooled = floors.filter(F.col("lang_pred").isNull()).first()
    own = broadcast_if_few(floors.filter(F.col("lang_pred").isNotNull()).withColumnRenamed("lang_pred", "__lang"), "language_floors")
    known = scored.filter(F.col("lang_pred") != UNKNOWN).join(own, F.col("lang_pred") == F.col("__lang"), "left")
    return known.filter(F.col("score") >= F.coalesce("floor", F.lit(pooled["floor"] if pooled else 0.0))).select(*scored.columns)


def training_rows(
    docs: DataFrame, id_col: str, modulus: int = 4, held_out: int = 2, bound: int | None = 20_000, lang_col: str = "lang"
) -> DataFrame:
    """About ``bound`` rows of each language whose id's crc32 does not leave ``held_out``; all of a language with fewer.

    Chosen by a hash of the id; only languages of more than ``bound`` rows are listed in the driver.  Without a bound: every such row.
    """
    rows = docs.filter(id_remainder(id_col, modulus) != held_out)
    if bound is None:
        return rows
    large = rows.groupBy(lang_col).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > bound) & F.col(lang_col).isNotNull())
    limits = {r[0]: int(bound / r["n"] * (1 << 20)) for r in large.collect()}
    if not limits:
        return rows
    limit = F.try_element_at(F.create_map(*[F.lit(x) for f in limits.items() for x in f]), F.col(lang_col))
    return rows.filter(F.pmod(F.xxhash64(F.lit(11), F.col(id_col)), F.lit(1 << 20)) < F.coalesce(limit, F.lit(1 << 20)))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; profiles come from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = fit_profiles(training_rows(docs.filter(F.col("lang").isNotNull()), "doc_id"), "text", "lang")
    return identify(docs, profiles).select(
        "doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score"
    )
