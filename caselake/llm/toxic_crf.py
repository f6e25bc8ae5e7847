"""Toxicity with a linear-chain conditional random field.

Labels come by document, the field learns from labelled tokens.  A word or a word's beginning is toxic
where it is found in far more toxic than other training documents (copies counted once); tokens of
the sampled lines are labelled by that list, and a two-label linear-chain CRF is fitted on features of
the word, its beginnings and the word before it.  Forward-backward marginals of a document's tokens aggregate to a calibrated
document score and to the offsets of offending words.

The chain runs over each line of the whole text.  The model is a few hundred KB, whatever the input.
"""

from __future__ import annotations

import string
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_remainder, map_texts, sample_fraction, table

BUCKETS = 1 << 17
SPAN_FLOOR = 0.5


#: Stripped from both ends of a word.
PUNCTUATION = string.punctuation + "\u2018\u2019\u201c\u201d\u00ab\u00bb\u2026\u00a1\u00bf"


def normal(raw: str) -> str:
    """Lower case without the punctuation on both ends."""
    return raw.strip(PUNCTUATION).lower()


#: Words of a piece in which a line is offered to the fit; scoring reads lines as they are.
PIECE_WORDS = 400


#: Lengths of the beginnings of words that count as features and as entries of the token list.
STEMS = (4, 5, 6)


def features(raw: str) -> tuple[int, ...]:
    """Buckets of the word, of its beginnings, and (last) of what it is to the word after it."""
    word = normal(raw)
    h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
    stems = [zlib.crc32(word[:n].encode("utf-8", "surrogatepass"), n) % BUCKETS for n in STEMS]
    return h % BUCKETS, *stems, (h * 2654435761 + 97) % 4294967291 % BUCKETS


def is_listed(raw: str, listed: set[str]) -> bool:
    word = normal(raw)
    return word in listed or any(f"{word[:n]}*" in listed for n in STEMS)


#: Bucket of the feature that the start of a line gives its first word.
LINE_START = 1


@dataclass
class Chain:
    """Weights of label 1 against label 0; transitions are logs, against 0 -> 0."""

    weights: np.ndarray
    bias: float
    start: float
    to_one: float
    to_zero: float
    stay_one: float
    calibration: tuple[float, ...] = (0.0, 0.0, 0.0)


def marginals(e: np.ndarray, starts: np.ndarray, lengths: np.ndarray, chain: Chain) -> tuple[np.ndarray, np.ndarray]:
    """P(label 1) of every token, and for each token the odds message from behind it (for pair marginals).

    ``e``: emissions of all sequences end to end; ``starts`` and ``lengths``: where each sequence lies.
    Steps run over positions, vectorised over the sequences that still have a token there.
    """
    gain = np.exp(np.clip(e, -30, 30))
    a01, a10, a11 = np.exp([chain.to_one, chain.to_zero, chain.stay_one])
    order = np.argsort(-lengths, kind="stable")
    at, long = starts[order], lengths[order]
    alive = np.searchsorted(-long, -np.arange(1, (long[0] if len(long) else 0) + 1), side="right")
    fwd, bwd = np.empty(len(e)), np.ones(len(e))
    odds = None
    for t, n in enumerate(alive.tolist()):
        here = at[:n] + t
        if t == 0:
            odds = gain[here] * np.exp(chain.start)
        else:
            odds = odds[:n]
            odds = gain[here] * (a01 + a11 * odds) / (1 + a10 * odds)
        fwd[here] = odds = np.clip(odds, 1e-15, 1e15)
    for t in range(len(alive) - 2, -1, -1):
        here = at[: alive[t + 1]] + t
        x = gain[here + 1] * bwd[here + 1]
        bwd[here] = np.clip((a10 + a11 * x) / (1 + a01 * x), 1e-15, 1e15)
    both = fwd * bwd
    return both / (1 + both), fwd


def fit_chain(lines: list[tuple[list[str], bool]], toxic_words: set[str], rounds: int = 60, l2: float = 1e-4) -> Chain:
    """Maximum likelihood by Adagrad over labelled token lines.

    ``lines``: the tokens of a line, and whether its document is toxic.  A token is labelled 1 if it
    is listed and its document is toxic: documents that are not have no toxic token.
    """
    tokens = [raw for line, _ in lines for raw in line]
    lengths = np.array([len(line) for line, _ in lines if line], dtype=np.int64)
    chain = Chain(np.zeros(BUCKETS), -2.0, 0.0, -1.0, 0.0, 0.0)
    if not tokens or not toxic_words:
        return chain
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    feats = np.array([features(raw) for raw in tokens], dtype=np.int64)
    feats[1:, -1] = feats[:-1, -1].copy()
    feats[starts, -1] = LINE_START
    y = np.array([toxic and is_listed(raw, toxic_words) for line, toxic in lines for raw in line], dtype=np.float64)
    inner = np.ones(len(tokens), dtype=bool)
    inner[starts] = False
    after = np.flatnonzero(inner)  # tokens that have one before them
    w, extra = chain.weights, np.array([chain.bias, chain.start, chain.to_one, chain.to_zero, chain.stay_one])
    sums_w, sums_x = np.full(BUCKETS, 1e-6), np.full(5, 1e-6)
    y01 = (1 - y[after - 1]) * y[after]
    y10 = y[after - 1] * (1 - y[after])
    y11 = y[after - 1] * y[after]
    n = float(len(lengths))
    for _ in range(rounds):
        chain = Chain(w, *extra)
        e = w[feats].sum(axis=1) + extra[0]
        p, fwd = marginals(e, starts, lengths, chain)
        # pair marginals from the forward odds before and the marginal here
        a01, a10, a11 = np.exp(extra[2:])
        f, q = fwd[after - 1], p[after]
        p01 = q * a01 / (a01 + a11 * f)
        p11 = q - p01
        p10 = (1 - q) * a10 * f / (1 + a10 * f)
        miss = y - p
        grad = np.bincount(feats.ravel(), np.repeat(miss, feats.shape[1]), minlength=BUCKETS) / n - l2 * w
        more = np.array(
            [miss.sum(), miss[starts].sum(), (y01 - p01).sum(), (y10 - p10).sum(), (y11 - p11).sum()]
        ) / n - l2 * extra
        sums_w += grad**2
        sums_x += more**2
        w = w + 0.5 * grad / np.sqrt(sums_w)
        extra = np.clip(extra + 0.3 * more / np.sqrt(sums_x), -12, 12)
    return Chain(w, *extra)


class _Words(dict):
    """raw word -> row in the tables of its emission and of what it adds to the next word."""

    def __init__(self, chain: Chain, limit: int = 500_000) -> None:
        super().__init__()
        self.weights, self.bias = chain.weights.tolist(), float(chain.bias)
        self.limit, self.own, self.next = limit, [], []

    def __missing__(self, raw: str) -> int:
        *own, after = features(raw)
        self.own.append(sum([self.weights[i] for i in own]) + self.bias)
        self.next.append(self.weights[after])
        self[raw] = len(self.own) - 1
        return len(self.own) - 1

    def trim(self) -> None:
        if len(self) > self.limit:
            self.clear()
            self.own, self.next = [], []


def offsets(text: str, words: list[str], flagged: list[int]) -> list[tuple[int, int]]:
    """Where the flagged words of a text lie; neighbours are one span."""
    wanted, at, spans = set(flagged), 0, []
    for i, w in enumerate(words):
        at = text.index(w, at)
        if i in wanted:
            if i - 1 in wanted and spans:
                spans[-1] = (spans[-1][0], at + len(w))
            else:
                spans.append((at, at + len(w)))
        at += len(w)
    return spans


def make_scorer(chain: Chain):
    """A function texts -> highest marginal, sum of marginals, number of tokens, offending spans."""
    first = float(chain.weights[LINE_START])
    table_of = _Words(chain)

    def work(texts: list[str | None]) -> dict:
        table_of.trim()
        ids, lengths, per_doc, words_of = [], [], [], []
        for text in texts:
            n, words = 0, []
            for line in (text or "").split("\n"):
                found = line.split()
                if found:
                    words += found
                    lengths.append(len(found))
                    n += len(found)
            ids += map(table_of.__getitem__, words)
            per_doc.append(n)
            words_of.append(words)
        sizes = np.array(per_doc, dtype=np.int64)
        tops, sums, spans = np.zeros(len(texts)), np.zeros(len(texts)), [""] * len(texts)
        if ids:
            ids = np.array(ids, dtype=np.int64)
            lens = np.array(lengths, dtype=np.int64)
            starts = np.concatenate(([0], np.cumsum(lens)[:-1]))
            before = np.empty(len(ids))
            before[1:] = np.array(table_of.next)[ids[:-1]]
            before[starts] = first
            p, _ = marginals(np.array(table_of.own)[ids] + before, starts, lens, chain)
            full = np.flatnonzero(sizes)
            begins = (np.cumsum(sizes) - sizes)[full]
            tops[full] = np.maximum.reduceat(p, begins)
            sums[full] = np.add.reduceat(p, begins)
            for i, begin in zip(full.tolist(), begins.tolist(), strict=True):
                if tops[i] >= SPAN_FLOOR:
                    flagged = np.flatnonzero(p[begin : begin + per_doc[i]] >= SPAN_FLOOR).tolist()
                    spans[i] = ",".join(f"{a}:{b}" for a, b in offsets(texts[i], words_of[i], flagged))
        return {"max_marginal": tops, "sum_marginals": sums, "n_tokens": sizes, "spans": spans}

    return work


FIELDS = "max_marginal double, sum_marginals double, n_tokens bigint, spans string"


NOT_WORD = r"[^\p{L}\p{N}]+"


def _stems(words: Column, n: int) -> Column:
    long = F.filter(words, lambda w: F.length(w) >= n)
    return F.transform(long, lambda w: F.concat(F.substring(w, 1, n), F.lit("*")))


def toxic_token_list(
    labelled: DataFrame, min_share: float = 0.01, min_docs: int = 5, min_ratio: float = 8.0, most: int = 5_000
) -> set[str]:
    """Words, and beginnings of words (written ``stem*``), of toxic training documents that others hardly have.

    Reads columns ``text`` and ``toxic``.  At most ``most`` entries, the most frequent first; a list of that bound goes to the driver.
    """
    n = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return set()
    words = F.array_distinct(F.split(F.lower("text"), NOT_WORD))
    units = F.array_distinct(F.concat(words, *[_stems(words, n) for n in STEMS]))
    found = (
        labelled.select("toxic", F.explode(units).alias("word"))
        .filter(F.col("word") != "")
        .groupBy("word")
        .agg(F.count_if(F.col("toxic") == 1).alias("n1"), F.count_if(F.col("toxic") == 0).alias("n0"))
        .filter(F.col("n1") >= max(min_docs, min_share * n1))
        .filter((F.col("n1") / n1) >= min_ratio * (F.col("n0") + 1) / (n0 + 1))
        .orderBy(F.desc("n1"), "word")
        .limit(most)
    )
    return {r["word"] for r in found.collect()}


def one_per_family(labelled: DataFrame) -> DataFrame:
    """One of the rows that share their least hash over 3-word shingles: copies must not make a word look frequent."""
    words = F.split("text", r"\s+")
    n = F.size("__w")
    shingles = F.transform(
        F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))),
        lambda i: F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2)),
    )
    keyed = labelled.withColumn("__w", words).withColumn("__family", F.array_min(shingles))
    return (
        keyed.groupBy("__family", "toxic")
        .agg(F.min_by(F.struct("doc_id", "text"), "doc_id").alias("one"))
        .select("one.doc_id", "one.text", "toxic")
    )


def _logit(p: float) -> float:
    p = min(max(p, 1e-4), 1 - 1e-4)
    return float(np.log(p / (1 - p)))


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression with a small penalty, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1.0 * np.eye(len(b))
        step = np.linalg.solve(h, x.T @ (y - p) - 1.0 * b)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(b.tolist())


def fit(
    docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0, bound: int = 10_000, max_lines: int = 6_000,
    least_judged: int = 50,
) -> Chain | None:
    """Fits the field on rows that are labelled and not held out; None where there are no labels of both kinds.

    ``bound`` rows at most fit the model (chosen by a hash of the id); ``max_lines`` lines of them fit
    the weights, half of them with a toxic token where there are enough; lines come in pieces of ``PIECE_WORDS`` words.
    A fifth of the rows calibrate the score only; where these hold fewer than ``least_judged`` rows of a label, all rows do both.
    """
    known = (
        labels.filter(F.col("toxic").isin(0, 1) & (id_remainder("doc_id", modulus) != held_out))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    chosen = sample_fraction(known, bound, "doc_id")
    rows = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .join(chosen, "doc_id")
        .persist()
    )
    # a fifth of the rows calibrate the score and take no part in the fit, unless they are too few of a kind
    apart = F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(5)) == 0
    judged, used = rows.filter(apart), rows.filter(~apart)
    kinds = judged.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    if min(kinds) < least_judged:
        judged, used = rows, rows
    families = one_per_family(used).persist()
    try:
        words = toxic_token_list(families)
        if not words:
            return None
        tokens = F.split(F.lower("line"), NOT_WORD)
        units = F.concat(tokens, *[_stems(tokens, n) for n in STEMS])
        whole = families.select("doc_id", "toxic", F.posexplode(F.split("text", "\n")).alias("row", "line"))
        own = F.filter(F.split("line", r"\s+"), lambda w: w != "")
        starts = F.sequence(F.lit(0), F.greatest(F.size(own) - 1, F.lit(0)), F.lit(PIECE_WORDS))
        pieces = F.transform(starts, lambda i: F.array_join(F.slice(own, i + 1, PIECE_WORDS), " "))
        lines = whole.select("doc_id", "toxic", "row", F.posexplode(pieces).alias("piece", "line")).filter(F.col("line") != "")
        lines = lines.withColumn("hit", F.arrays_overlap(units, F.lit(sorted(words))))
        order = [F.xxhash64(F.lit(3), "doc_id", "row", "piece"), F.col("doc_id"), F.col("row"), F.col("piece")]
        sample = [r for hit in (True, False) for r in lines.filter(F.col("hit") == hit).orderBy(*order).limit(max_lines // 2).collect()]
        chain = fit_chain([(x, r["toxic"] == 1) for r in sample if (x := r["line"].split())], words)
        seen = map_texts(
            judged.select(F.struct("doc_id", "toxic").alias("key"), "text"), "key", "text", lambda: make_scorer(chain), FIELDS
        ).select("key.toxic", "max_marginal", "sum_marginals").collect()
        x = np.array([(_logit(r[1]), np.log1p(r[2])) for r in seen])
        chain.calibration = _calibrate(x, np.array([float(r[0]) for r in seen]))
        return chain
    finally:
        families.unpersist()
        rows.unpersist()


def _score(chain: Chain) -> Column:
    b0, b1, b2 = chain.calibration
    top = F.least(F.greatest("max_marginal", F.lit(1e-4)), F.lit(1 - 1e-4))
    z = F.lit(b0) + b1 * F.log(top / (1 - top)) + b2 * F.log1p("sum_marginals")
    return 1 / (1 + F.exp(-z))


def score_documents(docs: DataFrame, chain: Chain | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``score`` (0 to 1), ``predicted``, ``max_marginal`` and ``spans`` (start:end, code points) per row.

    Null and empty texts have no tokens and get the score of a document without any marginal.  With
    no model (no labels of both kinds) every score is 0.  Repeated rows come back once each; an empty
    table gives an empty table; extra columns are not read.
    """
    if chain is None:
        return docs.select(
            id_col,
            F.lit(0.0).alias("score"),
            F.lit(0).alias("predicted"),
            F.lit(0.0).alias("max_marginal"),
            F.lit("").alias("spans"),
        )
    marks = map_texts(docs, id_col, text_col, lambda: make_scorer(chain), FIELDS)
    return marks.withColumn("score", _score(chain)).select(
        id_col, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "max_marginal", "spans"
    )


def op1_toxic_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels are learnt only from rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    scored = score_documents(docs, fit(docs, labels))
    return scored.select(
        "doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "max_marginal", "spans"
    )
