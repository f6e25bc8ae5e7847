"""Rules over several columns, metrics chosen by what columns hold, and recovery of metrics, bound to the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ladders
from ..functions import rules as R
from ..operators import curate
from ..sources.tables import parquet
from .bound import query

# --- documents under rules of several columns --------------------------------------------------------------------

_TYPES = ["Decision Notice", " committee report ", "Case Report", "Noise Assessment", "Heritage Statement", "Consultee Reply", "Plan", "Supporting Info", "Other", None]
_DESCRIPTIONS = ["Statutory reply", "Noise impact study", "MCS sheet", "Vaillant manual", "South elevation", "supporting letter", "Report of works", "A statement", "misc", None, ""]
_FILES = ["calc_020.pdf", "ACOUSTIC_v2.pdf", "Decision_Notice.pdf", "case officer.doc", "bs4142.pdf", "listed building.pdf", "ASHP.pdf", "my brochure", "x.pdf", None, "dashp.pdf", "refused.txt", "delegated.pdf"]


def _pick(values: list, key: str) -> Column:
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), (F.col(key) % len(values)).cast("int"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as documents with types, descriptions and file names in all combinations."""
    return parquet(spark, sf_dir, "part").select(
        "p_partkey", _pick(_TYPES, "p_partkey").alias("document_type"), _pick(_DESCRIPTIONS, "p_partkey").alias("description"),
        _pick(_FILES, "p_partkey").alias("file_name"), _pick(_FILES, "p_partkey").alias("path"),
    )


def _sql_list(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


_SQL_DOCUMENTS = f"""d AS (SELECT p_partkey, lower(coalesce({_sql_list(_TYPES)}[p_partkey % {len(_TYPES)} + 1], '')) AS t, lower(coalesce({_sql_list(_DESCRIPTIONS)}[p_partkey % {len(_DESCRIPTIONS)} + 1], '')) AS s,
  lower(coalesce({_sql_list(_FILES)}[p_partkey % {len(_FILES)} + 1], '')) AS f FROM part)"""


@query(
    f"""WITH {_SQL_DOCUMENTS}, b AS (SELECT *, t || ' ' || s || ' ' || f AS x FROM d)
SELECT CASE WHEN contains(x, 'mcs') AND (contains(x, '020') OR contains(x, 'calc')) THEN 'mcs_calculator' WHEN contains(t, 'consult') OR contains(s, 'statutory reply') THEN 'consultee_response'
  WHEN contains(s, 'noise impact') OR contains(t, 'noise impact') THEN 'noise_impact_assessment' WHEN contains(x, 'acoustic') THEN 'acoustic_report' WHEN regexp_matches(s, 'spec|manufacturer|vaillant|daikin') THEN 'manufacturer_spec'
  WHEN contains(t, 'drawing') OR contains(s, 'elevation') OR contains(t, 'plan') THEN 'drawing_or_plan' WHEN contains(t, 'supporting') OR contains(s, 'supporting') THEN 'supporting_information'
  WHEN contains(t, 'report') OR contains(s, 'report') THEN 'report' WHEN contains(t, 'statement') OR contains(s, 'statement') THEN 'statement' ELSE 'other' END AS bucket, count(*) AS n FROM b GROUP BY 1"""
)
def candidate_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = R.compile_ladder(ladders.CANDIDATE_BUCKETS, "other")
    return _documents(spark, sf_dir).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


_SQL_RANKS = f"""{_SQL_DOCUMENTS}, r AS (SELECT *, trim(t) AS k FROM d),
q AS (SELECT p_partkey, CASE WHEN k IN ('decision', 'decision notice') THEN 0 WHEN k = 'committee report' THEN 1 WHEN k = 'case report' THEN 2 WHEN k = 'noise assessment' THEN 3 WHEN k = 'heritage statement' THEN 4
  WHEN regexp_matches(f, 'decision[_ ](notice|letter)|refus(al|ed)?|permission|granted|approval|approved') THEN 5 WHEN regexp_matches(f, 'officer|delegated|report[_ ](of[_ ]handling|recommendation)|committee[_ ]report') THEN 6
  WHEN regexp_matches(f, 'acoustic|noise[_ ]?(assessment|report|impact)|sound[_ ]assessment|bs[_ ]?(4142|8233)|mcs[_ ]?020') THEN 7 WHEN regexp_matches(f, 'heritage|design[_ ]?and[_ ]?access|listed[_ ]?building') THEN 8 ELSE 9 END AS primary_rank,
  CASE WHEN regexp_matches(f, 'air[_ ]source|heat[_ ]pump|\\bashp\\b|brochure') THEN 0 ELSE 1 END AS named FROM r),
z AS (SELECT p_partkey, primary_rank, CASE WHEN primary_rank = 9 THEN named ELSE 0 END AS tie_break FROM q)"""


@query(f"WITH {_SQL_RANKS} SELECT p_partkey, primary_rank, tie_break FROM z")
def document_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of two levels: by type, by file name, and among the rest products by name first."""
    rank = _document_rank()
    return _documents(spark, sf_dir).select("p_partkey", rank["primary"].alias("primary_rank"), rank["tie_break"].alias("tie_break"))


def _document_rank() -> Column:
    rules = [(R.rank(n), alternatives) for n, alternatives in ladders.DOCUMENT_RANKS]
    other = R.compile_ladder([(0, [[("file_name", "matches", ladders.NAMED_PRODUCT)]])], 1)
    return R.compile_ladder(rules, R.rank(9, other))


@query(f"WITH {_SQL_RANKS} SELECT p_brand, arg_min(p_partkey, (primary_rank, tie_break, p_partkey)) AS first_document FROM z JOIN part USING (p_partkey) GROUP BY 1")
def first_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document of each brand that ranks first on both levels."""
    brands = parquet(spark, sf_dir, "part").select("p_partkey", "p_brand")
    docs = _documents(spark, sf_dir).withColumn("rank", _document_rank()).join(brands, "p_partkey")
    return docs.groupBy("p_brand").agg(F.min_by("p_partkey", F.struct("rank", "p_partkey")).alias("first_document"))


# --- metrics ---------------------------------------------------------------------------------------------------


@query(
    """WITH s AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE ' ' || l_returnflag END AS region, l_linestatus AS authority, CASE WHEN l_linenumber % 3 > 0 THEN 'Q' || quarter(l_shipdate) || ' ' || year(l_shipdate) ELSE year(l_shipdate)::VARCHAR END AS quarter,
  l_quantity AS decided, l_orderkey % 100 AS pct_allowed, CASE WHEN l_orderkey % 10 < 6 THEN l_linenumber::VARCHAR ELSE 'n/a' END AS days, CASE WHEN l_orderkey % 100 < 59 THEN '7' ELSE 'none yet' END AS mixed FROM lineitem),
d AS (SELECT *, coalesce(trim(region), authority) AS geography, CASE WHEN quarter LIKE 'Q%' THEN 'quarter' ELSE 'year' END AS period_type FROM s),
l AS (SELECT geography, period_type, quarter AS period, unnest([{'m': 'appeals decided', 'v': decided, 'u': 'count'}, {'m': 'percent allowed', 'v': pct_allowed, 'u': 'percent'}, {'m': 'days', 'v': try_cast(days AS DOUBLE), 'u': 'days'}]) AS x FROM d)
SELECT geography, period_type, period, x.m AS metric_name, x.u AS metric_unit, count(*) AS n, round(sum(x.v), 2) AS total, round(sum(CASE WHEN x.m = 'appeals decided' THEN x.v END), 2) AS decided, round(sum(CASE WHEN x.m = 'percent allowed' THEN x.v END), 2) AS allow_rate, round(sum(CASE WHEN x.m = 'days' THEN x.v END), 2) AS days
FROM l WHERE x.v IS NOT NULL GROUP BY ALL"""
)
def chosen_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An untidy sheet of lines: three columns are metrics by their share of numbers, one falls just short of it."""
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    year = F.year("l_shipdate").cast("string")
    sheet = parquet(spark, sf_dir, "lineitem").select(
        F.when(line % 2 != 0, F.concat(F.lit(" "), "l_returnflag")).alias("region"),
        F.col("l_linestatus").alias("authority"),
        F.when(line % 3 != 0, F.concat(F.lit("Q"), F.quarter("l_shipdate").cast("string"), F.lit(" "), year)).otherwise(F.concat(year, F.lit(" "))).alias("quarter"),
        F.concat(F.lit("£"), F.format_number("l_quantity", 2)).alias("appeals decided"),
        F.concat((key % 100).cast("string"), F.lit("%")).alias("percent allowed"),
        F.when(key % 10 < 6, line.cast("string")).when(key % 10 < 8, "n/a").alias("days"),
        F.when(key % 100 < 59, "7").otherwise("none yet").alias("mixed"),
    )
    facts = curate.metric_facts(sheet)
    sums = [F.round(F.sum(c), 2).alias(n) for c, n in (("metric_value", "total"), ("volume_decided", "decided"), ("allow_rate", "allow_rate"), ("timeliness_days", "days"))]
    return facts.groupBy("geography", "period_type", "period", "metric_name", "metric_unit").agg(F.count(F.lit(1)).alias("n"), *sums)


@query(
    r"""WITH t AS (SELECT event_id, event_type, value, CASE event_id % 10 WHEN 0 THEN strftime(ts, '%b') || ' 24' WHEN 1 THEN strftime(ts, '%Y-%m-%d') || ' 00:00:00' WHEN 2 THEN ' 12.5 ' WHEN 3 THEN 'S78 planning appeals: number allowed' WHEN 4 THEN 'Percent  share' WHEN 5 THEN 'March'
  WHEN 6 THEN ' ' WHEN 7 THEN 'working days' WHEN 8 THEN 'sept_' || (1980 + event_id % 130) ELSE NULL END AS name, CASE WHEN event_id % 7 = 0 THEN ' 2023-Q1 ' WHEN event_id % 7 = 1 THEN ' ' END AS period FROM events),
r AS (SELECT *, coalesce(trim(regexp_replace(name, '\s+', ' ', 'g')), '') AS raw FROM t),
g AS (SELECT *, CASE event_id % 10 WHEN 0 THEN strptime(raw, '%b %y') WHEN 1 THEN strptime(raw, '%Y-%m-%d %H:%M:%S') WHEN 8 THEN CASE WHEN substr(raw, 6)::INT BETWEEN 1990 AND 2100 THEN make_timestamp(substr(raw, 6)::INT, 9, 1, 0, 0, 0) END END AS named FROM r),
m AS (SELECT *, CASE event_id % 10 WHEN 3 THEN 's78_allowed_count' WHEN 4 THEN 'percent_share' WHEN 2 THEN '12_5' WHEN 7 THEN 'working_days' ELSE CASE WHEN event_id % 3 > 0 THEN event_type END END AS metric_name,
  coalesce(nullif(trim(period), ''), strftime(named, '%Y-%m-01')) AS p FROM g)
SELECT metric_name, p AS period, CASE WHEN regexp_matches(p, '^\d{4}-\d{2}-01$') THEN 'month' END AS period_type,
  CASE WHEN regexp_matches(metric_name, 'received|decided|allowed|count|total') THEN 'volume' WHEN regexp_matches(metric_name, 'percent|rate|share') THEN 'rate_percent' WHEN contains(metric_name, 'day') THEN 'timeliness_days' ELSE 'other' END AS metric_family,
  CASE WHEN event_id % 10 = 2 THEN 'numeric_metric_token' WHEN value IS NULL OR value < 5 THEN 'missing_metric_value' WHEN metric_name IS NULL THEN 'missing_metric_name' END AS drop_reason, count(*) AS n FROM m GROUP BY ALL"""
)
def recovered_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as metrics whose names are months, time stamps, numbers, blanks or names, with a context for some of them."""
    event, day = F.col("event_id"), F.col("ts")
    names = [
        F.concat(F.date_format(day, "MMM"), F.lit(" 24")), F.date_format(day, "yyyy-MM-dd 00:00:00"), F.lit(" 12.5 "), F.lit("S78 planning appeals: number allowed"), F.lit("Percent  share"),
        F.lit("March"), F.lit(" "), F.lit("working days"), F.concat(F.lit("sept_"), (event % 130 + 1980).cast("string")),
    ]
    rows = parquet(spark, sf_dir, "events").select(
        F.get(F.array(*names), (event % 10).cast("int")).alias("metric_name"),
        F.when(event % 7 == 0, " 2023-Q1 ").when(event % 7 == 1, " ").alias("period"),
        F.when(F.col("value") >= 5, F.col("value")).alias("value"),
        F.lit(" ").alias("stage"), F.when(event % 3 > 0, F.col("event_type")).alias("procedure"),
    )
    marked = curate.recover_metrics(rows, "metric_name", "period", "value", ["stage", "procedure"])
    return marked.groupBy("metric_name", "period", "period_type", "metric_family", "drop_reason").agg(F.count(F.lit(1)).alias("n"))
