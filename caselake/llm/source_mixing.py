"""Mixing to target weights with soft domain membership, in DataFrame operations only.

A naive Bayes classifier, learnt from a labelled table, gives every document a posterior over domains.
Nonnegative document rates then follow from projected-gradient least squares: the expected token total
of a domain, the sum of rate x tokens x posterior over all documents, has to match its target.

A rate depends on its document's posterior and on the steps taken so far, which are K numbers each
for K domains; so a pass recomputes all rates from the table of posteriors and those steps, sums K
totals, and has no other state to lose.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, sample_fraction, table

#: Letters of a word that count: beginnings stand for their inflections.
STEM = 5


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def document_features(text: Column) -> Column:
    """Distinct word beginnings and runs of other signs."""
    stems = F.transform(_words(text), lambda w: F.substring(w, 1, STEM))
    signs = F.filter(F.split(text, r"[\p{L}\p{N}\s]+"), lambda w: w != "")
    return F.array_distinct(F.concat(stems, signs))


def token_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")).cast("long")


def fit_classifier(
    docs: DataFrame,
    labelled: DataFrame,
    id_col: str,
    text_col: str,
    domain_col: str,
    bound: int = 10_000,
    most_features: int = 4_000,
    min_docs: int = 5,
    least_chi_square: float = 20.0,
    most_domains: int = 64,
) -> tuple[list[str], list[float], DataFrame | None]:
    """Domain names, the log odds of a document without any feature, and a table (feature, w0, w1, ...) of what each adds.

    Fitted on about ``bound`` labelled rows; the table has at most ``most_features`` rows, those whose
    share differs most between domains, so it can be broadcast.  Without labelled rows there is one domain.
    """
    known = labelled.filter(F.col(domain_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(domain_col).cast("string").alias("domain")
    )
    known = known.groupBy("id").agg(F.min("domain").alias("domain"))
    rows = sample_fraction(known, bound, "id").join(
        docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "id"
    )
    sizes = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) > most_domains:
        raise ValueError(f"{len(sizes)} domains; at most {most_domains} are taken")
    names = sorted(sizes)
    if not names:
        return ["all"], [0.0], None
    total = sum(sizes.values())
    priors = [float(sizes[d] / total) for d in names]
    counts = (
        rows.select("domain", F.explode(document_features(F.col("text"))).alias("feature"))
        .groupBy("feature")
        .agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("domain") == d).alias(f"n{k}") for k, d in enumerate(names)])
        .persist()
    )
    try:
        # occurrences by domain: a domain of long documents must not claim every feature
        found = counts.agg(F.sum("n"), *[F.sum(f"n{k}") for k in range(len(names))]).first()
        shares = [max(x or 0, 1) / max(found[0] or 0, 1) for x in found[1:]]
        # per domain: the share of its documents with the feature
        rates = [(F.col(f"n{k}") + p) / (sizes[d] + 1.0) for k, (d, p) in enumerate(zip(names, priors, strict=True))]
        whole = (F.col("n") + 1.0) / (total + 2.0)
        lifts = [F.log(r / (1 - r) / (whole / (1 - whole))).alias(f"w{k}") for k, r in enumerate(rates)]
        lacks = [F.log((1 - r) / (1 - whole)).alias(f"l{k}") for k, r in enumerate(rates)]
        # chi-square against the domains' shares of all occurrences
        apart = sum((F.col(f"n{k}") - F.col("n") * s) ** 2 / (F.col("n") * s) for k, s in enumerate(shares))
        model = (
            counts.filter(F.col("n") >= min_docs)
            .withColumn("apart", apart)
            .filter(F.col("apart") >= least_chi_square)
            .orderBy(F.desc("apart"), "feature")
            .limit(most_features)
        )
        model = materialize(model.select("feature", *lifts, *lacks), "mixing-model")
        # a document starts as if it lacked every feature
        lack = model.agg(*[F.sum(f"l{k}") for k in range(len(names))]).first()
        biases = [math.log(p) + (x or 0.0) for p, x in zip(priors, lack, strict=True)]
        return names, biases, model.select("feature", *[f"w{k}" for k in range(len(names))])
    finally:
        counts.unpersist()


def domain_posteriors(
    docs: DataFrame, names: list[str], biases: list[float], model: DataFrame | None, id_col: str, text_col: str, temperature: float = 2.0
) -> DataFrame:
    """``(id, tokens, p0, p1, ...)`` for every distinct id; the posteriors of a document add up to 1."""
    k = range(len(names))
    text = F.coalesce(F.col(text_col), F.lit(""))
    if model is None:
        return docs.groupBy(F.col(id_col).alias("id")).agg(F.sum(token_count(text)).alias("tokens")).withColumn("p0", F.lit(1.0))
    # counted before the explode, or Spark would count them again for every feature
    counted = docs.select(F.col(id_col).alias("id"), token_count(text).alias("n"), document_features(text).alias("all"))
    features = counted.select("id", "n", F.posexplode_outer("all").alias("pos", "feature"))
    scored = (
        # most_features rows at most
        features.join(F.broadcast(model), "feature", "left")
        .groupBy("id")
        .agg(
            F.sum(F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("n")).otherwise(0)).alias("tokens"),
            *[F.sum(F.coalesce(f"w{i}", F.lit(0.0))).alias(f"s{i}") for i in k],
        )
    )
    logits = [(F.lit(biases[i]) + F.col(f"s{i}")) / temperature for i in k]
    top = F.greatest(*logits) if len(names) > 1 else logits[0]
    parts = scored.select("id", "tokens", *[F.exp(x - top).alias(f"e{i}") for i, x in enumerate(logits)])
    total = sum((F.col(f"e{i}") for i in k), F.lit(0.0))
    return parts.select("id", "tokens", *[(F.col(f"e{i}") / total).alias(f"p{i}") for i in k])


def _rate(steps: list[list[float]], n: int) -> Column:
    """The rate after ``steps``: from 1, each step moves it along the posterior and cuts it off at 0."""
    rate = F.lit(1.0)
    for step in steps:
        rate = F.greatest(F.lit(0.0), rate - sum((F.col(f"p{i}") * step[i] for i in range(n)), F.lit(0.0)))
    return rate


def _solve(h: list[list[float]], g: list[float], ridge: float = 1e-6) -> list[float]:
    """x with (h + ridge) x = g, by elimination; h is a small Gram matrix."""
    n = len(g)
    a = [[*row, g[i]] for i, row in enumerate(h)]
    for i in range(n):
        a[i][i] += ridge
    for i in range(n):
        p = max(range(i, n), key=lambda r: abs(a[r][i]))
        a[i], a[p] = a[p], a[i]
        for r in range(n):
            if r != i:
                f = a[r][i] / a[i][i]
                a[r] = [x - f * y for x, y in zip(a[r], a[i], strict=True)]
    return [a[i][n] / a[i][i] for i in range(n)]


def fit_rates(posteriors: DataFrame, targets: list[float], rounds: int = 20, tolerance: float = 1e-3, least_gain: float = 0.01) -> tuple[DataFrame, list[float]]:
    """``posteriors`` with ``rate``, and the share of the token budget that each domain gets.

    ``targets``: wanted share of each domain, of a budget of all tokens.  Minimises the squared
    residuals, weighted by the inverse Gram matrix of the posteriors, over rates of at least 0; ends at
    ``tolerance``, when a round gains less than ``least_gain`` of the loss, or after ``rounds``.
    """
    n = len(targets)
    total = posteriors.agg(F.sum("tokens")).first()[0]
    if not total:
        return posteriors.withColumn("rate", F.lit(1.0)), [0.0] * n
    share = F.col("tokens") / F.lit(float(total))
    gram = posteriors.agg(
        *[F.sum(share * F.col(f"p{i}") * F.col(f"p{j}")).alias(f"h{i}_{j}") for i in range(n) for j in range(n)]
    ).first()
    h = [[gram[f"h{i}_{j}"] for j in range(n)] for i in range(n)]
    steps: list[list[float]] = []
    last = None
    while True:
        got = (
            posteriors.select(*[f"p{i}" for i in range(n)], share.alias("share"), _rate(steps, n).alias("rate"))
            .agg(*[F.sum(F.col("share") * F.col("rate") * F.col(f"p{i}")) for i in range(n)])
            .first()
        )
        residual = [got[i] - targets[i] for i in range(n)]
        step = _solve(h, residual)
        loss = sum(x * y for x, y in zip(step, residual, strict=True))
        settled = last is not None and last - loss < least_gain * last
        if max(map(abs, residual)) <= tolerance or settled or len(steps) == rounds:
            return posteriors.withColumn("rate", _rate(steps, n)), list(got)
        steps.append(step)
        last = loss


def mix(
    docs: DataFrame,
    labelled: DataFrame,
    targets: dict[str, float],
    id_col: str = "doc_id",
    text_col: str = "text",
    domain_col: str = "domain",
    seed: int = 5,
    keep: Sequence[str] = (),
    headroom: float = 1.1,
    **classifier,
) -> DataFrame:
    """One row per distinct id: ``id_col``, ``tokens``, ``posterior`` (domain -> probability), ``rate``, ``copies``.

    ``targets`` are wanted shares by domain (they are scaled to add up to 1; domains not named get 0).
    The token budget is that of all documents, or more where a domain named in ``keep`` would else get less than
    ``headroom`` times its present tokens: documents of such a domain are repeated rather than lost.
    ``copies`` realises the rate: its whole part, and one more where a hash of the id falls below the rest.

    Null and empty texts have no tokens; their rate follows from their posterior, the priors.  Rows
    that share an id, null included, are one document whose tokens add up.  Without labelled rows there is one
    domain and every rate is 1.  An empty table gives an empty table; extra columns are not read.
    """
    names, biases, model = fit_classifier(docs, labelled, id_col, text_col, domain_col, **classifier)
    posteriors = materialize(domain_posteriors(docs, names, biases, model, id_col, text_col), "posteriors")
    wanted = [float(targets.get(d, 0.0)) for d in names]
    wanted = [w / sum(wanted) for w in wanted] if sum(wanted) else [1.0 / len(names)] * len(names)
    if keep:
        now = posteriors.agg(F.sum("tokens"), *[F.sum(F.col("tokens") * F.col(f"p{i}")) for i in range(len(names))]).first()
        grown = [headroom * now[i + 1] / now[0] / w for i, (d, w) in enumerate(zip(names, wanted, strict=True)) if d in keep and w and now[0]]
        wanted = [w * max([1.0, *grown]) for w in wanted]
    rated, _ = fit_rates(posteriors, wanted)
    draw = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    pairs = [x for i, d in enumerate(names) for x in (F.lit(d), F.col(f"p{i}"))]
    return rated.select(
        F.col("id").alias(id_col),
        "tokens",
        F.create_map(*pairs).alias("posterior"),
        "rate",
        (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")).alias("copies"),
    )


def apply_mix(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with every row as often as ``copies`` says."""
    copies = mixed.select(F.col(id_col).alias("__mix_id"), F.col("copies").alias("__mix_n")).filter(F.col("__mix_n") > 0)
    joined = docs.join(copies, F.col(id_col).eqNullSafe(F.col("__mix_id")))
    return joined.withColumn("__mix_at", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__mix_n")))).select(*docs.columns)


#: Shares that the query and the pipeline aim at, and the domains whose documents are repeated rather than lost.
TARGETS = {"clean": 0.86, "junk": 0.07, "toxic": 0.07}
KEPT = ("clean",)


def label_domains(labels: DataFrame) -> DataFrame:
    """``(doc_id, domain)`` from quality and toxicity labels."""
    domain = F.when(F.col("quality") == 0, "junk").when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", domain.alias("domain")).filter(F.col("domain").isNotNull())


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain posteriors and fitted rates of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mix(docs, label_domains(table(spark, sf_dir, "labels")), TARGETS, keep=KEPT)
