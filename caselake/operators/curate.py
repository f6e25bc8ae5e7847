"""Curation of untidy tables: headers, bodies, profiles, long facts."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ladders import DIMENSION_NAMES, METRIC_FAMILIES, METRIC_NAMES
from ..functions.rules import compile_ladder, value_map
from ..functions.scalars import norm_text, period_token, slug, squeeze, to_iso_date, to_number


def first_existing(df: DataFrame, aliases: Sequence[str]) -> Column:
    """First column of the list that the table has; null without one."""
    name = next((a for a in aliases if a in df.columns), None)
    return F.col(name) if name else F.lit(None).cast("string")


def coalesce_alias(df: DataFrame, aliases: Sequence[str]) -> Column:
    """First non-null value among the columns of the list that the table has."""
    found = [F.col(a) for a in aliases if a in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def header_rows(df: DataFrame, keys: Sequence[str], row: str, cells: str, first_rows: int = 40) -> DataFrame:
    """Best header row of each sheet among its first rows (numbered from 1), with its score and the confidence in it.

    A row scores 1.6 for each filled cell, 3 for cells that are all distinct, 2.5 for cells that all hold a letter, less 0.08 for
    each row above it; an empty row -1000.  Confidence is the lead over the next best as a share of the score, 1 for a lone row.
    """
    filled = F.filter(cells, lambda c: c.isNotNull() & (F.trim(c) != ""))
    n = F.size(filled)
    distinct = F.size(F.array_distinct(filled)) / n
    text = F.size(F.filter(filled, lambda c: c.rlike(r"\p{L}"))) / n
    score = n * 1.6 + distinct * 3.0 + text * 2.5 - (F.col(row) - 1) * 0.08
    scored = df.filter(F.col(row) <= first_rows).select(*keys, row, n.alias("width"), F.when(n > 0, score).otherwise(-1000.0).alias("score"))
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), row)
    ranked = scored.withColumn("__rn", F.row_number().over(w)).withColumn("__next", F.lead("score").over(w))
    lead = F.least(F.greatest((F.col("score") - F.col("__next")) / (F.abs("score") + 1e-6), F.lit(0.0)), F.lit(1.0))
    return ranked.filter(F.col("__rn") == 1).select(
        *keys, F.col(row).alias("header_row"), "width", F.round("score", 6).alias("score"), F.round(F.coalesce(lead, F.lit(1.0)), 6).alias("confidence")
    )


def table_body(df: DataFrame, headers: DataFrame, keys: Sequence[str], row: str, cells: str) -> DataFrame:
    """Rows after the header up to the first blank key cell, as wide as the header is without blank cells at its end."""
    blank = F.coalesce(F.trim(F.get(cells, F.lit(0))) == "", F.lit(True))
    filled = F.transform(cells, lambda c, i: F.when(F.coalesce(F.trim(c) != "", F.lit(False)), i + 1).otherwise(0))
    placed = df.join(headers.select(*keys, "header_row"), list(keys))
    widths = placed.filter(F.col(row) == F.col("header_row")).groupBy(*keys).agg(F.max(F.greatest(F.array_max(filled), F.lit(0))).alias("__width"))
    below = placed.filter(F.col(row) > F.col("header_row")).join(widths, list(keys))
    stop = below.filter(blank).groupBy(*keys).agg(F.min(row).alias("__stop"))
    return (
        below.join(stop, list(keys), "left")
        .filter(F.col("__stop").isNull() | (F.col(row) < F.col("__stop")))
        .withColumn(cells, F.transform(F.sequence(F.lit(1), F.col("__width")), lambda i: F.get(cells, i - 1)))
        .drop("__stop", "__width", "header_row")
    )


def sparse_json(df: DataFrame, columns: Sequence[str], out: str = "payload") -> DataFrame:
    """Filled cells as JSON, and how many there are."""
    cells = {c: F.when(F.trim(F.col(c).cast("string")) != "", F.col(c)) for c in columns}
    filled = sum((c.isNotNull().cast("int") for c in cells.values()), F.lit(0))
    return df.withColumn(out, F.to_json(F.struct(*[v.alias(k) for k, v in cells.items()]))).withColumn("n_filled", filled)


def sheet_dictionary(df: DataFrame, keys: Sequence[str], cells: str) -> DataFrame:
    filled = F.size(F.filter(cells, lambda c: c.isNotNull() & (F.trim(c) != "")))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.max(filled).alias("max_filled"), F.min(filled).alias("min_filled"))


def _long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    pairs = [F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns]
    return df.select(F.explode(F.array(*pairs)).alias("x")).select("x.field", "x.value")


def _as_number(c: Column) -> Column:
    return c.try_cast("double")


def numeric_profile(df: DataFrame, columns: Sequence[str], least: int = 5, share: float = 0.6, parse: Callable[[Column], Column] = _as_number) -> DataFrame:
    """Non-null count, share that parses as a number, and whether the column counts as numeric: one aggregate of two counts a column."""
    text = {c: F.col(c).cast("string") for c in columns}
    counted = df.agg(*[x.alias(f"{kind}{i}") for i, c in enumerate(columns) for kind, x in (("n", F.count(text[c])), ("p", F.count(parse(text[c]))))])
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"n{i}").alias("n"), F.col(f"p{i}").alias("__p")) for i, c in enumerate(columns)])
    agg = counted.select(F.explode(rows).alias("x")).select("x.*")
    ratio = F.round(F.try_divide(F.col("__p") * 1.0, F.col("n")), 6)
    return agg.select("field", "n", ratio.alias("ratio"), ((F.col("n") >= least) & F.coalesce(F.col("__p") >= share * F.col("n"), F.lit(False))).alias("is_numeric"))


def metric_facts(df: DataFrame, provenance: Sequence[str] = (), least: int = 5, share: float = 0.6, names: Mapping[str, Sequence[str]] = DIMENSION_NAMES) -> DataFrame:
    """Long facts from a wide sheet whose metrics are chosen by what they hold.

    Columns of ``least`` or more values of which ``share`` read as numbers are metrics, the rest, but for ``provenance``, dimensions: the
    plan follows from one aggregate of two counts a column.  A fact has the canonical dimensions of ``names`` (the first filled column of each
    list, null without one), ``period_type``, the metric's name, value and unit, and the breakouts that its name asks for.  Values that are no number
    have no fact; without a metric there is none at all.
    """
    typed = [c for c in df.columns if c not in provenance]
    metrics = [r["field"] for r in numeric_profile(df, typed, least, share, to_number).filter("is_numeric").collect()]
    dimensions = [c for c in typed if c not in metrics]
    own = {name: F.coalesce(*[norm_text(F.col(c).cast("string")) for c in columns if c in dimensions], F.lit(None).cast("string")) for name, columns in names.items()}
    pairs = [F.struct(F.lit(m).alias("metric_name"), to_number(F.col(m).cast("string")).alias("metric_value")) for m in metrics]
    none = F.array().cast("array<struct<metric_name:string,metric_value:double>>")
    long = df.select(*[c.alias(n) for n, c in own.items()], *provenance, F.explode(F.array(*pairs) if pairs else none).alias("x"))
    long = long.select(*own, *provenance, "x.metric_name", "x.metric_value").filter(F.col("metric_value").isNotNull())
    name, value = F.lower("metric_name"), F.col("metric_value")
    percent = name.rlike("percent|%")
    breakouts = {
        "volume_received": name.contains("received"),
        "volume_decided": name.contains("decided"),
        "volume_allowed": name.contains("allowed"),
        "allow_rate": name.contains("allow") & name.rlike("percent|rate"),
        "timeliness_days": name.contains("days"),
        "timeliness_percent": percent,
    }
    kind = F.when(F.col("period").rlike(r"(?i)\bq[1-4]\b"), "quarter").when(F.col("period").rlike(r"^\d{4}$"), "year")
    unit = F.when(percent, "percent").when(name.contains("days"), "days").otherwise("count")
    return long.withColumns({"period_type": kind, "metric_unit": unit, **{n: F.when(c, value) for n, c in breakouts.items()}})


def recover_metrics(
    df: DataFrame, name: str, period: str, value: str, context: Sequence[str], names: Mapping[str, str] = METRIC_NAMES
) -> DataFrame:
    """Every row, marked in one scan: ``metric_name``, ``period``, ``period_type``, ``metric_family`` and ``drop_reason``.

    A missing period is recovered from a metric's name that is one (:func:`period_token`).  Names that are numbers, time stamps or words that
    begin with a month's name, with or without a year, are no names; the first filled column of ``context`` takes their place.  Reasons, the later
    overruling the earlier: no name left, no value, a number for a name.  ``drop_reason`` is null for clean rows.
    """
    raw = F.coalesce(squeeze(F.col(name)), F.lit(""))
    key = slug(raw)
    is_number = raw.rlike(r"^\d+(\.\d+)?$")
    junk = (key == "") | key.rlike(r"^\d+$|^\d{4}(_\d{2}){5}$") | key.rlike(r"^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z_]*(\d{2,4})?$")
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    filled = lambda c: F.nullif(squeeze(F.col(c).cast("string")), F.lit(""))
    instead = F.coalesce(*[slug(filled(c)) for c in context]) if context else F.lit(None).cast("string")
    clean = F.when(junk, instead).otherwise(F.coalesce(F.try_element_at(known, key), key))
    marked = df.withColumns({"__name": clean, "__period": F.coalesce(filled(period), period_token(raw)), "__number": is_number})
    marked = marked.withColumns(
        {
            name: F.col("__name"),
            period: F.col("__period"),
            "period_type": F.when(F.col("__period").rlike(r"^\d{4}-\d{2}-01$"), "month"),
            "drop_reason": F.when(F.col("__number"), "numeric_metric_token").when(F.col(value).isNull(), "missing_metric_value").when(F.col("__name").isNull(), "missing_metric_name"),
        }
    )
    families = compile_ladder([(label, [[(name, op, v) for _, op, v in clauses] for clauses in rule]) for label, rule in METRIC_FAMILIES], "other")
    return marked.withColumn("metric_family", families).drop("__name", "__period", "__number")


def field_profile(df: DataFrame, columns: Sequence[str], silent: Sequence[str] = ("", "none", "unknown")) -> DataFrame:
    """Most common value of each field; informative values come before markers of silence; ties to the smaller value."""
    counts = _long(df, columns).filter(F.col("value").isNotNull()).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    told = (~F.lower("value").isin(*silent)).cast("int")
    w = Window.partitionBy("field").orderBy(told.desc(), F.desc("n"), "value")
    return counts.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == 1).select("field", F.col("value").alias("top_value"), "n")


def to_long_facts(df: DataFrame, dimensions: Sequence[str], metrics: Sequence[str], units: Mapping[str, str] | None = None) -> DataFrame:
    """One row per dimension row and metric, with unit; missing values go."""
    pairs = [F.struct(F.lit(m).alias("metric_name"), F.col(m).cast("double").alias("metric_value")) for m in metrics]
    long = df.select(*dimensions, F.explode(F.array(*pairs)).alias("x")).select(*dimensions, "x.metric_name", "x.metric_value")
    if units:
        table = F.create_map(*[F.lit(x) for kv in units.items() for x in kv])
        long = long.withColumn("unit", F.coalesce(F.element_at(table, F.col("metric_name")), F.lit("count")))
    return long.filter(F.col("metric_value").isNotNull())


def clean_metrics(df: DataFrame, reasons: Sequence[tuple[str, Column]], keys: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Clean and dropped rows: a later reason overrules an earlier one; of equal rows the first stays.

    Repeats are found by ``keys`` among the rows without a reason, in the order of arrival.
    """
    reason = F.lit(None).cast("string")
    for name, condition in reasons:
        reason = F.when(F.coalesce(condition, F.lit(False)), name).otherwise(reason)
    marked = df.withColumn("drop_reason", reason)
    w = Window.partitionBy(F.col("drop_reason").isNull(), *keys).orderBy(*order)
    repeat = F.col("drop_reason").isNull() & (F.row_number().over(w) > 1)
    marked = marked.withColumn("drop_reason", F.when(repeat, "duplicate").otherwise(F.col("drop_reason")))
    return marked.filter(F.col("drop_reason").isNull()).drop("drop_reason"), marked.filter(F.col("drop_reason").isNotNull())


def case_table(df: DataFrame, aliases: Mapping[str, Sequence[str]], texts: Sequence[str], dates: Sequence[str], numbers: Sequence[str], maps: Mapping[str, Mapping[str, str]], keep: Sequence[str]) -> DataFrame:
    """A case table under canonical names: the first column of each alias list, tidied by kind.

    ``maps`` gives the value maps of coded columns; other values become null.  Rows without any of ``keep`` go; columns
    that the table does not have are null.
    """
    out = {}
    for name, names in aliases.items():
        c = first_existing(df, names)
        if name in dates:
            c = to_iso_date(norm_text(c.cast("string")))
        elif name in numbers:
            c = to_number(c.cast("string"))
        elif name in maps:
            c = value_map(norm_text(c.cast("string")), maps[name], keep_other=False)
        elif name in texts:
            c = norm_text(c.cast("string"))
        out[name] = c.alias(name)
    return df.select(*out.values()).filter(F.coalesce(*[F.col(k).cast("string") for k in keep]).isNotNull())
