"""Consistency checks, record normalisation and grounding counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Check = tuple[str, str, Column, Column]  # severity, name, condition of the fault, detail


def consistency_checks(df: DataFrame, keys: Sequence[str | Column], checks: Sequence[Check]) -> DataFrame:
    """One row per record and failed check: severity, check, detail.  An unknown condition is no fault."""
    if not checks:
        raise ValueError("no checks given")
    found = F.array_compact(
        F.array(
            *[
                F.when(
                    F.coalesce(bad, F.lit(False)),
                    F.struct(F.lit(sev).alias("severity"), F.lit(name).alias("check"), detail.cast("string").alias("detail")),
                )
                for sev, name, bad, detail in checks
            ]
        )
    )
    out = df.select(*keys, F.explode(found).alias("__f"))
    return out.select(*out.columns[:-1], "__f.severity", "__f.check", "__f.detail")


def differs(a: Column, b: Column, tolerance: float) -> Column:
    return F.abs(a - b) > tolerance


def differs_from_all(value: Column, candidates: Sequence[Column], tolerance: float) -> Column:
    """The value is near none of the candidates that are known."""
    known = F.array_compact(F.array(*candidates))
    return (F.size(known) > 0) & ~F.exists(known, lambda c: F.abs(value - c) <= tolerance)


def not_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>")))) > 0


def both_filled(a: Column, b: Column) -> Column:
    return a.isNotNull() & b.isNotNull()


def only_one_filled(value: Column, evidence: Column) -> Column:
    """A value without its evidence."""
    return value.isNotNull() & (evidence.isNull() | (F.trim(evidence) == ""))


def flag_against_list(flag: Column, items: Column, member: str) -> Column:
    """A boolean that contradicts a list."""
    return flag.isNotNull() & (flag != F.coalesce(F.array_contains(items, member), F.lit(False)))


def normalise_records(df: DataFrame, steps: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    """Conditional rewrites (column, condition, new value), one after the other: later steps see earlier ones."""
    for name, condition, value in steps:
        df = df.withColumn(name, F.when(F.coalesce(condition, F.lit(False)), value).otherwise(F.col(name)))
    return df


def merge_lists(df: DataFrame, into: str, other: str) -> DataFrame:
    """Ordered union; null stays null only where both lists are null: null means not applicable, empty none found."""
    empty = F.array().cast("array<string>")
    both = F.array_union(F.coalesce(into, empty), F.coalesce(other, empty))
    return df.withColumn(into, F.when(F.col(into).isNull() & F.col(other).isNull(), F.lit(None)).otherwise(both))


def status_counts(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Counts per field and status value, null statuses included: rows are counted by all fields together before they are taken apart."""
    text = df.select(*[F.col(f).cast("string").alias(f) for f in fields]).groupBy(*fields).agg(F.count(F.lit(1)).alias("__n"))
    long = text.select("__n", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("status")) for f in fields])).alias("x"))
    return long.groupBy("x.field", "x.status").agg(F.sum("__n").alias("n"))


GRANTING = ("approved", "prior_approval_granted")
REFUSING = ("refused", "prior_approval_refused")


def record_checks(db_tolerance: float = 0.6) -> list[Check]:
    """The ten checks of an extracted record, over the columns that their conditions name; lists may be null."""
    none = F.array().cast("array<string>")
    outcome, stance = F.col("decision_outcome"), F.coalesce("hp_component_stance", F.lit(""))
    reasons, considered = F.coalesce("council_refusal_reasons", none), F.coalesce("council_considerations", none)
    granted, refused = F.coalesce(outcome.isin(*GRANTING), F.lit(False)), outcome.isin(*REFUSING)
    relevant = F.col("hp_relevance") == "hp_relevant"
    conditions = (F.coalesce("n_conditions", F.lit(0)) != 0) | (F.size(F.coalesce("condition_types", none)) > 0) | F.coalesce(F.col("hp_specific_conditions") != "", F.lit(False))
    specific, correction, rating = (F.col(f"noise_{c}_db") for c in ("specific_level", "character_correction", "rating_level"))
    limit, exceedance = F.col("noise_limit_db"), F.col("noise_exceedance_db")
    differences = [rating - F.col("noise_background_night_db"), rating - F.col("noise_background_day_db"), rating - limit]
    turbine = F.coalesce("includes_wind_turbine", F.lit(False))
    noisy = F.arrays_overlap(reasons, F.array(F.lit("sound_noise"), F.lit("setback_boundary")))
    nothing = F.lit(None)
    return [
        ("HARD", "extraction_error", F.col("error").isNotNull(), F.col("error")),
        ("HARD", "conditions_on_refusal", ~granted & conditions, outcome),
        ("HARD", "refusal_ground_stance", (F.col("hp_refusal_ground") != "") & (stance != "unacceptable"), F.col("hp_refusal_ground")),
        ("REVIEW", "rating_arithmetic", differs(specific + correction, rating, db_tolerance), rating),
        ("REVIEW", "exceedance_arithmetic", differs_from_all(exceedance, differences, db_tolerance), exceedance),
        ("REVIEW", "limit_double_fill", both_filled(limit, F.nullif(F.col("noise_limit_relative"), F.lit(""))), limit),
        ("REVIEW", "stance_not_assessed", relevant & refused & (stance == "not_separately_assessed"), nothing),
        ("REVIEW", "noise_refusal_stance", relevant & refused & (stance != "unacceptable") & noisy, stance),
        ("REVIEW", "reasons_not_subset", refused & not_subset(reasons, considered), F.array_join(F.array_sort(F.array_except(reasons, considered)), "|")),
        ("REVIEW", "wind_turbine_mismatch", flag_against_list(turbine, F.col("bundled_works"), "wind_turbine"), turbine),
        ("REVIEW", "age_without_evidence", only_one_filled(F.nullif(F.col("building_age"), F.lit("")), F.col("building_age_evidence")), F.col("building_age")),
    ]


def check_records(df: DataFrame, keys: Sequence[str], **options) -> DataFrame:
    """:func:`record_checks` of every record; of one whose extraction failed only that is reported."""
    found = consistency_checks(df, [*keys, F.col("error").isNotNull().alias("__failed")], record_checks(**options))
    return found.filter(~F.col("__failed") | (F.col("check") == "extraction_error")).drop("__failed")
