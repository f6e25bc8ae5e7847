"""Tiered record linkage, name cascades and annotator agreement."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_token_subset


def with_provenance(parts: Mapping[str, DataFrame], name: str = "source_db") -> DataFrame:
    """Union of corpora by column name, with the name of each row's corpus."""
    out = None
    for key, df in parts.items():
        df = df.withColumn(name, F.lit(key))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no corpora given")
    return out


def link_by_reference(apps: DataFrame, cases: DataFrame, uid: str, refs: Mapping[str, str], case: str, case_ref: str, left_names: str | None = None, right_names: str | None = None) -> DataFrame:
    """Tier 1: any of an application's references equals the case's, and the authorities agree.

    ``refs`` maps the name of each reference to its column; every one that meets is a link of its own.
    Authorities are token arrays; they agree where one holds the other.
    """
    named = F.lit(None).cast("array<string>")
    each = F.array(*[F.struct(F.lit(name).alias("name"), F.col(c).alias("ref")) for name, c in refs.items()])
    left = apps.select(F.col(uid), (F.col(left_names) if left_names else named).alias("__l"), F.explode(each).alias("__r"))
    left = left.select(uid, "__l", F.col("__r.name").alias("__name"), F.col("__r.ref").alias("__ref")).filter(F.col("__ref").isNotNull())
    right = cases.filter(F.col(case_ref).isNotNull()).select(
        F.col(case), F.col(case_ref).alias("__ref"), (F.col(right_names) if right_names else named).alias("__r")
    )
    found = left.join(right, "__ref")
    if left_names:
        found = found.filter(is_token_subset(F.col("__l"), F.col("__r")))
    return found.select(uid, case, F.lit("t1").alias("tier"), F.concat(F.lit("ref_source="), "__name").alias("match_detail")).distinct()


def _tail(ref: Column) -> Column:
    return F.when(ref.contains("/"), F.regexp_replace(ref, "^[^/]*/", ""))


def reference_evidence(refs: Mapping[str, Column], case_ref: Column, description: Column, least: int = 4, least_described: int = 6) -> list[tuple[str, Column]]:
    """Evidence for :func:`link_by_block`, in order: per reference, itself or its tail against the case's, one holding the other; then a description that names the case.

    References and tails of fewer than ``least`` characters prove nothing; nor does a case's reference of fewer than
    ``least_described`` in a description.
    """
    out = []
    for name, ref in refs.items():
        tail = _tail(ref)
        long = F.length(ref) >= least
        out.append((name, long & (case_ref.contains(ref) | ref.contains(case_ref))))
        out.append((f"{name}_tail", long & (F.length(tail) >= least) & (case_ref.contains(tail) | tail.contains(case_ref))))
    out.append(("description", (F.length(case_ref) >= least_described) & description.contains(case_ref)))
    return out


def _first_evidence(evidence: Sequence[tuple[str, Column]]) -> Column:
    return F.coalesce(*[F.when(F.coalesce(condition, F.lit(False)), name) for name, condition in evidence])


def link_by_block(apps: DataFrame, cases: DataFrame, uid: str, case: str, block: Sequence[str], evidence: Sequence[tuple[str, Column]]) -> DataFrame:
    """Tier 2: the same block, and some evidence; the first evidence that holds names the match.

    ``evidence`` conditions read the columns of both sides.  Null block keys never meet.
    """
    found = apps.join(cases, list(block)).withColumn("match_detail", _first_evidence(evidence)).filter(F.col("match_detail").isNotNull())
    return found.select(uid, case, F.lit("t2").alias("tier"), "match_detail").distinct()


def contained(patterns: DataFrame, texts: DataFrame, block: Sequence[str], pattern: str, text: str, most_broadcast: int = 200_000) -> DataFrame:
    """(block, pattern, text) of every pattern that is part of a text of its block, once each.

    From each place of a text the parts that begin and are as long as some pattern meet the patterns as equals, so no pair is made that does
    not hold.  Meant for references and other short texts.  Patterns are broadcast up to ``most_broadcast`` rows.
    """
    rows = patterns.select(*block, pattern).filter(F.col(pattern).isNotNull())
    few = rows.limit(most_broadcast + 1).count() <= most_broadcast
    sought = rows.distinct()
    held = texts.select(*block, text).filter(F.col(text).isNotNull()).distinct()
    # at most as many as there are characters, times the longest pattern's; the place after a text's end is that of the empty pattern
    kinds = rows.select(F.substring(pattern, 1, 1).alias("__first"), F.length(pattern).alias("__n")).distinct()
    places = held.select(*block, text, F.explode(F.sequence(F.lit(1), F.length(text) + 1)).alias("__at"))
    begun = places.withColumn("__first", F.substring(F.col(text), F.col("__at"), F.lit(1))).join(F.broadcast(kinds), "__first")
    begun = begun.filter(F.col("__at") + F.col("__n") - 1 <= F.length(text))
    parts = begun.select(*block, text, F.substring(F.col(text), F.col("__at"), F.col("__n")).alias(pattern))
    return parts.join(F.broadcast(sought) if few else sought, [*block, pattern]).select(*block, pattern, text).distinct()


def link_by_parts(
    apps: DataFrame, cases: DataFrame, uid: str, case: str, block: Sequence[str], refs: Mapping[str, str], case_ref: str, description: str, least: int = 4, least_described: int = 6
) -> DataFrame:
    """:func:`link_by_block` by :func:`reference_evidence`, without a comparison of all pairs of a block.

    ``refs`` maps the name of each reference to its column.  References, tails and descriptions first meet the cases' references as
    strings, by :func:`contained`; only rows of strings that meet become pairs.
    """
    evidence = reference_evidence({name: F.col(c) for name, c in refs.items()}, F.col(case_ref), F.col(description), least, least_described)
    rows = apps.select(*dict.fromkeys([uid, *block, *refs.values(), description]))

    def strings(*columns: Column) -> DataFrame:
        each = rows.select("*", F.explode(F.array(*columns)).alias("__s"))
        return each.filter(F.length("__s") >= least).hint("merge")  # many more rows than their files' size tells: not to be broadcast

    references = [F.col(c) for c in refs.values()]
    tails = [_tail(c) for c in references]
    described = rows.withColumn("__s", F.col(description)).hint("merge")
    own = cases.select(*block, case_ref)
    in_cases = contained(strings(*references, *tails), own, block, "__s", case_ref)
    in_references = contained(own, strings(*references), block, case_ref, "__s")
    in_descriptions = contained(own.filter(F.length(case_ref) >= least_described), described, block, case_ref, "__s")
    met = in_cases.unionByName(in_references).distinct()
    on = [*block, "__s"]
    pairs = strings(*references, *tails).join(met, on).unionByName(described.join(in_descriptions, on)).drop("__s")
    found = pairs.withColumn("match_detail", _first_evidence(evidence)).filter(F.col("match_detail").isNotNull())
    links = found.select(uid, *block, case_ref, "match_detail").distinct().join(cases.select(case, *block, case_ref), [*block, case_ref])
    return links.select(uid, case, F.lit("t2").alias("tier"), "match_detail").distinct()


def link_unique_block(apps: DataFrame, cases: DataFrame, uid: str, case: str, block: Sequence[str], left_sig: str, right_sig: str) -> DataFrame:
    """Tier 3: a block with exactly one application and one case, whose signatures are equal."""
    one_app = apps.groupBy(*block).agg(F.min(uid).alias(uid), F.max(uid).alias("__u"), F.min(left_sig).alias("__a"), F.max(left_sig).alias("__a2"))
    one_case = cases.groupBy(*block).agg(F.min(case).alias(case), F.max(case).alias("__c"), F.min(right_sig).alias("__b"), F.max(right_sig).alias("__b2"))
    single = (F.col(uid) == F.col("__u")) & (F.col(case) == F.col("__c")) & (F.col("__a") == F.col("__a2")) & (F.col("__b") == F.col("__b2"))
    return one_app.join(one_case, list(block)).filter(single & (F.col("__a") == F.col("__b"))).select(
        uid, case, F.lit("t3").alias("tier"), F.lit("unique_block").alias("match_detail")
    )


#: Confidence of the three tiers.
CONFIDENCE = {"t1": "high", "t2": "high", "t3": "medium"}


def resolve_links(tiers: Sequence[DataFrame], uid: str, case: str, confidence: Mapping[str, str] = CONFIDENCE) -> DataFrame:
    """Best tier of each pair, then of each case: one row per case, ties to the smaller uid.  ``confidence``: tiers, best first."""
    order = list(confidence)
    hits = tiers[0]
    for t in tiers[1:]:
        hits = hits.unionByName(t)
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("tier"))
    by_case = Window.partitionBy(case).orderBy("__rank", uid, "match_detail")
    level = F.element_at(F.create_map(*[F.lit(x) for kv in confidence.items() for x in kv]), F.col("tier"))
    return (
        hits.withColumn("__rank", rank)
        .withColumn("__rn", F.row_number().over(by_case))
        .filter(F.col("__rn") == 1)
        .select(uid, case, "tier", "match_detail", level.alias("confidence"))
    )


def attach_best(cases: DataFrame, links: DataFrame, case: str, payload: Sequence[str]) -> DataFrame:
    """Cases with their accepted match and a JSON payload that leaves nulls out."""
    return cases.join(links, case, "left").withColumn("payload", F.to_json(F.struct(*payload)))


def linkage_summary(hits: DataFrame, uid: str, keys: Sequence[str] = ("tier",)) -> DataFrame:
    """Distinct applications and links by tier, corpus, corpus and tier, or confidence: whatever ``keys`` names."""
    return hits.groupBy(*keys).agg(F.countDistinct(uid).alias("n_apps"), F.count(F.lit(1)).alias("n_links"))


def name_cascade(df: DataFrame, candidates: Sequence[Column], lookup: DataFrame, key: str, values: Sequence[str], left_key: str) -> DataFrame:
    """First candidate key that the lookup knows: exact, alias, stripped, squeezed, in the order given.

    One join on the exploded candidates of the distinct names, then the best step of each name.
    """
    names = df.select(left_key).distinct().filter(F.col(left_key).isNotNull())
    steps = names.select(left_key, F.posexplode(F.array(*candidates)).alias("__step", "__key"))
    best = (
        steps.join(lookup.select(F.col(key).alias("__key"), *values), "__key")
        .groupBy(left_key)
        .agg(*[F.min_by(v, "__step").alias(v) for v in values], F.min("__step").alias("match_step"))
    )
    return df.join(best, left_key, "left")


def agreement(a: DataFrame, b: DataFrame, key: str, left: str, right: str, collapse: Mapping[str, str]) -> DataFrame:
    """Two annotators' labels: equal in full, equal after collapsing, the final label, and whether to review."""

    def collapsed(c: Column) -> Column:
        table = F.create_map(*[F.lit(x) for kv in collapse.items() for x in kv])
        return F.coalesce(F.element_at(table, c), c)

    joined = a.select(key, F.col(left).alias("label_a")).join(b.select(key, F.col(right).alias("label_b")), key)
    same = F.coalesce(F.col("label_a") == F.col("label_b"), F.lit(False))
    close = F.coalesce(collapsed(F.col("label_a")) == collapsed(F.col("label_b")), F.lit(False))
    return joined.select(
        key,
        "label_a",
        "label_b",
        same.alias("agree_full"),
        close.alias("agree_collapsed"),
        F.when(same, F.col("label_a")).when(close, collapsed(F.col("label_a"))).alias("final_label"),
        (~close).alias("needs_review"),
    )


def combined_verdict(df: DataFrame, signature: Column, lookup: str, out: str = "verdict", default: str = "unknown") -> DataFrame:
    """What the address shows wins over what is known of the authority."""
    return df.withColumn(out, F.coalesce(signature, F.col(lookup), F.lit(default)))


def agreement_rates(df: DataFrame) -> DataFrame:
    """Of :func:`agreement`'s rows: how many, percent that agree in full and after collapsing, and how many to review."""

    def pct(c: str) -> Column:
        return F.round(F.avg(F.col(c).cast("int")) * 100.0, 4)

    return df.agg(
        F.count(F.lit(1)).alias("n"), pct("agree_full").alias("pct_full"), pct("agree_collapsed").alias("pct_collapsed"), F.count_if("needs_review").alias("n_review")
    )
