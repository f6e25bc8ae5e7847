"""Line dedup: lines that many documents share go, except in one document.

Lines are exploded, normalised and hashed (128 bits); distinct documents are counted per hash;
lines over the threshold are dropped and the others are put together again in their order.
Only hashes and ids are shuffled for the counts.  Counts are taken on (hash, document) pairs dealt by
both, so a line that a third of the documents share is pre-aggregated on many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, ascii_lower, table
from .components import HOT_ROWS, MOST_HOT


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def _hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(7), key).alias("b"))


def drop_repeated_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 20,
    min_docs: int = 3,
) -> DataFrame:
    """``docs`` with ``text_col`` replaced by what is kept, plus ``n_lines`` and ``n_dropped``.

    A key (line, stripped of ASCII white space and A-Z lower-cased) of at least ``min_chars`` code
    points that is found in at least ``min_docs`` documents loses all its lines except in the largest
    ``id_col`` that holds it.

    Null or empty text is one empty line.  Rows that share an id are one document in the counts, and
    each comes back; rows with a null id are one document, smaller than all others.  Input columns
    named ``n_lines`` or ``n_dropped`` are replaced.  An empty table gives an empty table.
    """
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    pairs = (
        docs.select(F.col(id_col).alias("id"), F.explode(lines).alias("line"))
        .select("id", line_key(F.col("line")).alias("key"))
        .filter(F.length("key") >= min_chars)
        .select("id", _hash(F.col("key")).alias("h"))
        .select("id", "h.a", "h.b")
        .distinct()
    )
    common = (
        pairs.groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper"))
        .filter(F.col("n") >= min_docs)
    )
    # lines of very many documents are looked up by broadcast and then dealt by document
    hot = common.filter(F.col("n") > HOT_ROWS).orderBy(F.desc("n"), "a", "b").limit(MOST_HOT)
    hot = F.broadcast(hot.select("a", "b", F.col("keeper").alias("__k"), F.lit(True).alias("__hot")))
    dealt = pairs.join(hot, ["a", "b"], "left").withColumn("__a", F.when(F.col("__hot"), F.xxhash64(F.lit(3), "id")).otherwise(F.col("a")))
    met = common.select(F.col("a").alias("__a"), F.col("b").alias("__b"), "keeper", F.lit(True).alias("__met"))
    found = dealt.join(met, (dealt["__a"] == met["__a"]) & (dealt["b"] == met["__b"]), "left")
    keeper = F.when(F.col("__hot"), F.col("__k")).otherwise(F.col("keeper"))
    dropped = (
        found.filter((F.col("__hot") | F.col("__met")) & ~F.col("id").eqNullSafe(keeper))
        .groupBy("id")
        .agg(F.collect_list(F.struct("a", "b")).alias("gone"))
        .select(F.col("id").alias("__line_id"), F.col("gone").alias("__line_gone"))
    )
    rest = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    joined = docs.select(*rest).join(dropped, F.col(id_col).eqNullSafe(F.col("__line_id")), "left")

    def stays(line: Column) -> Column:
        key = line_key(line)
        return (F.length(key) < min_chars) | ~F.array_contains(F.col("__line_gone"), _hash(key))

    kept = F.when(F.col("__line_gone").isNull(), lines).otherwise(F.filter(lines, stays))
    out = joined.withColumn("__line_kept", kept)
    return out.select(
        *[
            F.array_join("__line_kept", "\n").alias(c) if c == text_col else F.col(c)
            for c in rest
        ],
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size("__line_kept")).cast("long").alias("n_dropped"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the text kept, for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


OP5_SQL = """
WITH exploded AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM exploded
), common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.keeper AS gone
  FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
