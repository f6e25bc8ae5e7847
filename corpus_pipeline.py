"""A corpus pipeline: five stages, each an operator of ``caselake.llm`` on what its predecessor kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read
again as the next stage's ``docs``.  All but the last return the columns of ``documents``.

In every stage: an empty table gives an empty table; repeated rows are judged alike, and each that stays comes back;
further columns, whatever their names, are carried along and never read; nothing depends on the order of rows.  What
a stage makes of null and empty texts, of null ids and of ties stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselake.llm.bin_packing import pack_documents
from caselake.llm.common import TableScope, discard, materialize, table
from caselake.llm.language_id import above_floors, fit_floors, identify_by_table, profile_rows, training_rows
from caselake.llm.line_dedup import drop_repeated_lines
from caselake.llm.simhash_dedup import keep_one_per_class, similar_text_classes
from caselake.llm.source_mixing import KEPT, TARGETS, apply_mix, label_domains, mix


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language that the profiles know go: null texts, texts without a letter, scores below the floor.

    Profiles come from all labelled rows that are not held out, for every language; ``lang`` of the others is not read.  The floors are
    fitted over the same rows, all of them, by exact quartiles (:func:`fit_floors`).  Without profiles every text with a letter stays.
    A null id counts as not held out; profiles at equal distance: the first name.
    """
    labelled = docs.filter(F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    profiles = materialize(profile_rows(training_rows(labelled, "doc_id", bound=None), "text", "lang"), "profiles")
    if profiles.isEmpty():
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    scored = materialize(identify_by_table(rows, profiles, "row", "row.text"), "scored")
    training = training_rows(scored.filter(F.col("row.lang").isNotNull()), "row.doc_id", bound=None)
    return above_floors(scored, fit_floors(training)).select("row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 or more characters that 3 or more documents share stay in one document only, that of the largest id.

    A null text becomes an empty one; a text may become empty and stays as a row.  Rows of one id are one document, and so are rows
    without an id, which are smaller than all others.  ``n_chars`` is counted anew.
    """
    kept = drop_repeated_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more on five-word shingles, the one with the smallest id stays.

    Null and empty texts are copies of one another.  Rows of one id are one document: they stay or go together.  Rows without an
    id stay only where no id has the same text.
    """
    return keep_one_per_class(docs, similar_text_classes(docs, shingle_words=5, similarity=0.8))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their fitted rate says, so that clean, junk and toxic tokens meet ``TARGETS``.

    Null and empty texts have no tokens; their rate follows from the domains' shares.  Rows of one id, or without one, are one document and
    drawn alike.  Without labels there is one domain and every row stays once.
    """
    labels = label_domains(table(spark, sf_dir, "labels"))
    return apply_mix(docs, mix(docs, labels, TARGETS, keep=KEPT))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's place in sequences of 512 to 8192 tokens.

    Null and empty texts have a row without a bin; texts of any length are split without loss; equal lengths go by id.
    """
    return pack_documents(docs)


STAGES = [
    ("language", language_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The rows of run() depend on hashes of shingles, a fitted classifier and best-fit packing, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with TableScope() as scope:
            kept = materialize(stage(spark, docs, sf_dir), name)
        scope.discard_but(kept)
        discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
