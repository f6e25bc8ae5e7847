"""Document selection, budgets, assembly and label statistics."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.rules import matches
from ..functions.scalars import days_between, extension, grounding, normalise_quotes, quote_segments, resolve_url, unescape, url_host


def top_ranked(df: DataFrame, key: str, order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key; end ``order`` with a unique column."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def char_budget(df: DataFrame, key: str, rank: str, length: str, cap: Column, budget: int, least: int = 200) -> DataFrame:
    """Characters taken from each ranked document: its length up to ``cap``, as the key's budget allows.

    A document is skipped once ``least`` or fewer characters of the budget are left; ``in_budget`` tells one that is not,
    even if it is empty and nothing is taken.  One window: what is used before a row is the sum of the capped lengths before it.
    """
    w = Window.partitionBy(key).orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)
    capped = F.least(F.coalesce(F.col(length), F.lit(0)), cap)
    left = F.lit(budget) - F.coalesce(F.sum(capped).over(w), F.lit(0))
    return df.withColumns({"taken": F.when(left > least, F.least(capped, left)).otherwise(0).cast("long"), "in_budget": left > least})


def pack_chunks(df: DataFrame, shard: str, order: str, size: str, most: int) -> DataFrame:
    """Greedy packing in order within a shard: a chunk ends where the next item would exceed ``most``; an oversize item stands alone.

    ``shard``, ``order``, ``size`` (null: 0) and ``chunk`` (from 0 in its shard) of every row.  A shard is sorted by Spark and
    read as a stream, so no more than a batch of it is held at once.
    """
    rows = df.select(shard, order, F.coalesce(F.col(size).cast("long"), F.lit(0)).alias(size))
    sorted_rows = rows.repartition(shard).sortWithinPartitions(shard, order)
    schema = StructType([*rows.schema.fields, StructField("chunk", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        began, last, chunk, used = False, None, 0, 0
        for batch in batches:
            chunks = []
            for own, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not began or own != last:
                    began, last, chunk, used = True, own, 0, n
                elif used + n > most:
                    chunk, used = chunk + 1, n
                else:
                    used += n
                chunks.append(chunk)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chunks, pa.int64())], [*batch.schema.names, "chunk"])

    return sorted_rows.mapInArrow(run, schema)


def assemble(df: DataFrame, key: str, priority: str, tie: str, text: str, sep: str = "\n\n") -> DataFrame:
    """One text per key, its documents by priority and then by ``tie``."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(priority).alias("p"), F.col(tie).alias("t"), F.col(text).alias("x"))))
    return df.filter(F.col(text).isNotNull()).groupBy(key).agg(F.array_join(F.transform(parts, lambda s: s["x"]), sep).alias("text"), F.count(F.lit(1)).alias("n_documents"))


def request_table(docs: DataFrame, key: str, rank: str, text: str, header: Sequence[str]) -> DataFrame:
    """One JSON request per key: header fields and the ranked texts cut to what :func:`char_budget` took.

    Empty texts within the budget are listed too; a key of nothing else has no request.  Without the budget's ``in_budget`` only texts
    of which something is taken are known.
    """
    part = F.struct(F.col(rank).alias("rank"), F.expr(f"substring({text}, 1, cast(taken as int))").alias("text"))
    listed = F.col("in_budget") if "in_budget" in docs.columns else F.col("taken") > 0
    grouped = docs.filter(listed).groupBy(key, *header).agg(F.array_sort(F.collect_list(part)).alias("documents"), F.max("taken").alias("__most"))
    return grouped.filter(F.col("__most") > 0).select(key, F.to_json(F.struct(*header, "documents")).alias("request"))


def merge_selection(base: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Keeps a key's old selection unless the key has a new one."""
    return base.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def label_tally(df: DataFrame, labels: str, n_documents: int | None = None) -> DataFrame:
    """Documents per label and their percentage of all documents."""
    total = df.count() if n_documents is None else n_documents
    tally = df.select(F.explode(F.array_distinct(labels)).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return tally.withColumn("pct", F.round(F.col("n") * 100.0 / F.lit(float(total or 1)), 4))


def label_pairs(df: DataFrame, labels: str, top: int = 50) -> DataFrame:
    """The most frequent unordered pairs of labels within a document, ties by name."""
    own = F.array_sort(F.array_distinct(labels))
    pairs = F.flatten(
        F.transform(own, lambda a: F.transform(F.filter(own, lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    )
    return (
        df.select(F.explode(pairs).alias("p"))
        .groupBy(F.col("p.a").alias("label_a"), F.col("p.b").alias("label_b"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "label_a", "label_b")
        .limit(top)
    )


def corpus_stats(df: DataFrame, keys: Sequence[str], words: str, status: Mapping[str, Column]) -> DataFrame:
    """Counts by status, and the least, upper-median and most words per group."""
    n = F.count(words)
    ordered = F.col("__w")
    # the upper middle element is the smallest value whose cumulative count exceeds n / 2
    counts = df.groupBy(*keys, F.col(words).alias("__w")).agg(F.count(F.lit(1)).alias("__c"), *[F.count_if(c).alias(k) for k, c in status.items()])
    w = Window.partitionBy(*keys).orderBy("__w")
    run = counts.withColumn("__upto", F.sum("__c").over(w)).withColumn("__all", F.sum("__c").over(Window.partitionBy(*keys)))
    return run.groupBy(*keys).agg(
        F.sum("__c").alias("n"),
        *[F.sum(k).alias(k) for k in status],
        F.min(ordered).alias("min_words"),
        F.min(F.when(F.col("__upto") > F.floor(F.col("__all") / 2), ordered)).alias("median_words"),
        F.max(ordered).alias("max_words"),
    )


def outlinks(df: DataFrame, key: str, html: str, page: Column) -> DataFrame:
    """(key, pos, url, own): targets of a page's anchors in their order, resolved against its address; ``own``: on the page's own host, or on none."""
    found = F.regexp_extract_all(F.col(html), F.lit(r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:"([^"]*)"|'([^']*)')"""), F.lit(0))
    rows = df.select(key, page.alias("__page"), F.posexplode(found).alias("pos", "tag"))
    reference = F.regexp_extract("tag", r"""(?is)["']([^"']*)["']$""", 1)
    url = resolve_url(F.col("__page"), unescape(reference))
    host = url_host(F.col("url"))
    own = host.isNull() | host.eqNullSafe(url_host(F.col("__page")))
    return rows.withColumn("url", url).select(key, "pos", "url", own.alias("own"))


def first_link(links: DataFrame, key: str, good: Column) -> DataFrame:
    """First link of each page that leads to another host and is ``good``."""
    return links.filter(~F.col("own") & good).groupBy(key).agg(F.min_by("url", "pos").alias("url"))


def ground_quotes(
    quotes: DataFrame, sources: DataFrame, item: str, quote: str, key: str, text: str, most_broadcast: int = 1_000_000
) -> DataFrame:
    """``(item, key, status)`` of every quote and every source in which it is ``ok`` or ``near_verbatim``, over whole texts.

    A five-word shingle of a quote can only be part of a source that has the shingle's three inner words in a row, so
    sources and quotes meet by hashes of such triples; their keys are broadcast up to ``most_broadcast`` rows.  Only sources
    that hold half of the triples of a quote's first segment of five words are read again with it.  Segments of fewer words must be
    contained whole, so a quote of such segments alone meets the sources that hold the rarest six characters in a row of its longest
    one.  A quote without a segment is ``ok`` in every source; it has no rows here (:func:`empty_quotes`).
    """
    segments = quote_segments(F.col(quote))
    words = F.split(F.get(F.filter(segments, lambda x: F.size(F.split(x, " ")) >= 5), F.lit(0)), " ")
    longest = F.aggregate(segments, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))
    asked = quotes.filter(F.col(quote) != "").select(item, quote, words.alias("__words"), longest.alias("__longest"))

    def triples(array: Column, first: int, n: Column) -> Column:
        return F.transform(F.sequence(F.lit(first), n), lambda i: F.xxhash64(F.array_join(F.slice(array, i, 3), " ")))

    keys = (
        asked.filter(F.col("__words").isNotNull())
        .select(item, (F.size("__words") - 4).alias("__n"), F.explode(triples(F.col("__words"), 2, F.size("__words") - 3)).alias("__key"))
        .groupBy(item, "__n", "__key")
        .agg(F.count(F.lit(1)).alias("__w"))
    )
    held = sources.filter(F.col(text).isNotNull()).select(key, normalise_quotes(F.col(text)).alias("__source"))
    own = F.split("__source", " ")
    parts = held.select(key, own.alias("__own")).filter(F.size("__own") >= 3)
    parts = parts.select(key, F.explode(F.array_distinct(triples(F.col("__own"), 1, F.size("__own") - 2))).alias("__key"))
    few = keys.count() <= most_broadcast
    hits = parts.join(F.broadcast(keys) if few else keys, "__key").groupBy(key, item, "__n").agg(F.sum("__w").alias("__hits"))
    met = hits.filter(2 * F.col("__hits") >= F.col("__n")).select(key, item)

    short = asked.filter(F.col("__words").isNull() & (F.col("__longest") != ""))
    if not short.isEmpty():
        grams = lambda c: F.regexp_extract_all(c, F.lit("(?s)(?=(.{6}))"), F.lit(1))  # noqa: E731  all runs of six characters
        sought = short.select(item, F.explode(F.array_distinct(grams(F.col("__longest")))).alias("__gram"))
        any_of = sought.select("__gram").distinct()
        places = held.select(key, F.explode(F.array_distinct(grams(F.col("__source")))).alias("__gram"))
        places = places.join(F.broadcast(any_of) if any_of.count() <= most_broadcast else any_of, "__gram")
        counts = places.groupBy("__gram").agg(F.count(F.lit(1)).alias("__c"))
        order = F.struct(F.coalesce("__c", F.lit(0)), "__gram")
        rarest = sought.join(counts, "__gram", "left").groupBy(item).agg(F.min_by("__gram", order).alias("__gram"))
        met = met.unionByName(places.join(rarest, "__gram").select(key, item))
    pairs = held.join(met, key).join(asked.select(item, quote), item)
    status = grounding(F.col(quote), F.col("__source"))
    return pairs.select(item, key, status.alias("status")).filter(F.col("status") != "missing")


def empty_quotes(quotes: DataFrame, quote: str) -> DataFrame:
    """Quotes with text but without a segment: they say nothing that could be missing."""
    return quotes.filter((F.col(quote) != "") & (F.size(quote_segments(F.col(quote))) == 0))


def budget_warnings(df: DataFrame, key: str, rank: str, length: str, critical: Column) -> DataFrame:
    """Critical documents that :func:`char_budget` did not take whole: ``dropped`` or ``truncated``."""
    lost = critical & (F.col("taken") < F.coalesce(F.col(length), F.lit(0)))
    return df.filter(lost).select(key, rank, length, "taken", F.when(F.col("taken") == 0, "dropped").otherwise("truncated").alias("warning"))


def files_of(docs: DataFrame, apps: DataFrame, key: str, path: str, extensions: Sequence[str]) -> DataFrame:
    """Documents of known cases whose file has one of the extensions (in lower case)."""
    return docs.filter(extension(F.col(path)).isin(*extensions)).join(apps, key)


def unhandled_extensions(docs: DataFrame, path: str, handled: Sequence[str]) -> DataFrame:
    """Documents by extension, of extensions that no extractor handles; null: no extension."""
    own = extension(F.col(path))
    return docs.filter(own.isNull() | ~own.isin(*handled)).groupBy(own.alias("extension")).agg(F.count(F.lit(1)).alias("n"))


def enrich(apps: DataFrame, key: str, sides: Sequence[tuple[DataFrame, Sequence[str], Sequence[str]]]) -> DataFrame:
    """Cases with columns of other tables: of each (table, columns, order) the first row of the case, nulls where there is none.

    Without an order the columns themselves are the order.  In an order nulls come last; end it with the rows' places
    (:func:`~caselake.sources.tables.with_file_order`) where its columns leave ties.
    """
    out = apps
    for side, columns, order in sides:
        by = [part for c in order for part in (F.col(c).isNull(), F.col(c))]
        row = F.min_by(F.struct(*columns), F.struct(*by)) if order else F.min(F.struct(*columns))
        first = side.groupBy(key).agg(row.alias("__row")).select(key, *[F.col(f"__row.{c}").alias(c) for c in columns])
        out = out.join(first, key, "left")
    return out


def case_facts(
    apps: DataFrame, outcome: Column, flags: Mapping[str, Column], start: str, decision: str, text: str, keep: Sequence[str] = ("refused", "withdrawn")
) -> DataFrame:
    """The flat table of cases with the outcomes in ``keep``: the outcome, days to the decision, flags, and the text in one line."""
    facts = apps.withColumn("outcome_bucket", outcome).filter(F.col("outcome_bucket").isin(*keep))
    return facts.withColumns(
        {
            "days_to_decision": days_between(F.col(start), F.col(decision)),
            **{name: F.coalesce(c, F.lit(False)) for name, c in flags.items()},
            text: F.regexp_replace(F.coalesce(text, F.lit("")), r"[\t\n]", " "),
        }
    )


def unreadable(df: DataFrame, status: str, failed: Sequence[str], columns: Sequence[str], pattern: str) -> DataFrame:
    """Documents whose extraction failed and whose ``columns`` together hold the pattern."""
    named = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns])
    return df.filter(F.col(status).isin(*failed) & matches(named, pattern))
