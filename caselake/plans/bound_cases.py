"""Further case-record operators bound to the tables, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions import ladders
from ..functions import rules as R
from ..functions import scalars as S
from ..operators import corpus, curate, geo, incremental, linkage, progress, quality, rates
from ..sources import stored, tables
from ..sources.tables import parquet
from .bound import SQL, char_budget, host_rewrite, quality_class, query
from .bound_more import agreement, consistency, coverage_year, equal_share

# --- addresses -------------------------------------------------------------------------------------------------

_SQL_URL = """CASE page_id % 8 WHEN 0 THEN 'https://x.example/Online-Applications/' || page_id WHEN 1 THEN 'https://x.example/AniteIM.WebSearch/' || page_id
  WHEN 2 THEN url WHEN 3 THEN '' WHEN 4 THEN 'https://h.example/applicationDetails.do?id=' || page_id WHEN 5 THEN 'https://h.example/publisher/mvc/' || page_id
  WHEN 6 THEN 'https://h.example/pr7/s/register-view?c__r=Arcus_BE' ELSE NULL END"""


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the addresses of several portals, blank ones, and a nation as authority."""
    page = F.col("page_id")
    shaped = R.first_case(
        [
            (page % 8 == 0, F.concat(F.lit("https://x.example/Online-Applications/"), page.cast("string"))),
            (page % 8 == 1, F.concat(F.lit("https://x.example/AniteIM.WebSearch/"), page.cast("string"))),
            (page % 8 == 2, F.col("url")),
            (page % 8 == 3, ""),
            (page % 8 == 4, F.concat(F.lit("https://h.example/applicationDetails.do?id="), page.cast("string"))),
            (page % 8 == 5, F.concat(F.lit("https://h.example/publisher/mvc/"), page.cast("string"))),
            (page % 8 == 6, "https://h.example/pr7/s/register-view?c__r=Arcus_BE"),
        ]
    )
    portal = F.when(page % 5 == 0, "publisher").when(page % 5 == 1, "")
    return parquet(spark, sf_dir, "pages").select("page_id", (page % 30).cast("int").alias("n_nationkey"), shaped.alias("link"), portal.alias("portal"))


def _sql_rules(col: str, rules: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({col}, '{p}', 'i') THEN '{label}'" for label, p in rules) + " END"


@query(
    f"""WITH p AS (SELECT page_id, page_id % 30 AS k, {_SQL_URL} AS link FROM pages)
SELECT page_id, coalesce({_sql_rules("link", ladders.URL_SIGNATURES)}, 'family_' || n_regionkey, 'unknown') AS verdict FROM p LEFT JOIN nation ON k = n_nationkey"""
)
def url_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The portal that an address shows, else the authority's."""
    families = parquet(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("family_"), F.col("n_regionkey").cast("string")).alias("family"))
    rows = _urls(spark, sf_dir).join(families, "n_nationkey", "left")
    return linkage.combined_verdict(rows, R.first_match(F.col("link"), ladders.URL_SIGNATURES), "family").select("page_id", "verdict")


def _sql_ladder(col: str) -> str:
    rungs = " ".join(f"WHEN {' OR '.join(f'contains(lower({col}), {t!r})' for t in terms)} THEN '{label}'" for label, terms in ladders.BACKENDS)
    return f"CASE {rungs} ELSE 'other_bespoke' END"


@query(
    f"""WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'publisher' WHEN 1 THEN '' END AS portal, {_SQL_URL} AS link FROM pages)
SELECT CASE WHEN link IS NULL OR link = '' THEN CASE WHEN portal = 'publisher' THEN 'publisher_no_url' ELSE 'no_url' END WHEN portal = 'publisher' THEN 'publisher' ELSE {_sql_ladder("link")} END AS backend, count(*) AS n FROM p GROUP BY 1"""
)
def backends(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = R.backend(F.col("link"), F.col("portal"), ladders.BACKENDS, "publisher", "other_bespoke")
    return _urls(spark, sf_dir).groupBy(own.alias("backend")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH p AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN ' North ' WHEN 1 THEN 'SOUTH' END AS a,
  CASE page_id % 4 WHEN 0 THEN 'https://North.example/Search//' WHEN 1 THEN 'https://maps.south.example/x.aspx?tab=1' WHEN 2 THEN 'https://north.example/search/1' END AS u FROM pages)
SELECT page_id, CASE WHEN lower(trim(a)) = 'north' AND regexp_replace(lower(u), '/+$', '') = 'https://north.example/search' THEN 'north_direct'
  WHEN lower(trim(a)) = 'south' AND contains(lower(u), 'maps.south.example/x.aspx') THEN 'south_maps' END AS family FROM p"""
)
def recovery_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page_id")
    authority = F.when(page % 3 == 0, " North ").when(page % 3 == 1, "SOUTH")
    url = F.when(page % 4 == 0, "https://North.example/Search//").when(page % 4 == 1, "https://maps.south.example/x.aspx?tab=1").when(page % 4 == 2, "https://north.example/search/1")
    routes = [("north_direct", "north", "https://north.example/search", True), ("south_maps", "south", "maps.south.example/x.aspx", False)]
    return parquet(spark, sf_dir, "pages").select("page_id", R.route_family(authority, url, routes).alias("family"))


@query(
    """WITH l AS (SELECT page_id, page_id % 3 AS k, url FROM pages),
c AS (SELECT page_id, CASE k WHEN 0 THEN 'https://a.example/' WHEN 1 THEN 'no address' ELSE 'https://a.example/case/' || page_id END AS first_url, url AS second_url FROM l)
SELECT page_id, CASE WHEN regexp_matches(first_url, '^https?://') AND regexp_extract(first_url, '^https?://[^/?#]+([^?#]*)', 1) NOT IN ('', '/') THEN first_url
  WHEN g THEN NULL ELSE second_url END AS url, CASE WHEN regexp_matches(first_url, '^https?://') AND regexp_extract(first_url, '^https?://[^/?#]+([^?#]*)', 1) NOT IN ('', '/') THEN 'first' WHEN g THEN NULL ELSE 'second' END AS method
FROM (SELECT *, NOT regexp_matches(second_url, '^https?://') OR contains(p, 'login') OR contains(p, 'search.do') OR CASE WHEN length(p) > 1 THEN regexp_replace(p, '/+$', '') ELSE p END IN ('', '/', '/home', '/index.html', '/search') AS g
  FROM (SELECT *, lower(regexp_extract(second_url, '^https?://[^/?#]+([^?#]*)', 1)) AS p FROM c))"""
)
def usable_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("page_id") % 3
    first = F.when(turn == 0, "https://a.example/").when(turn == 1, "no address").otherwise(F.concat(F.lit("https://a.example/case/"), F.col("page_id").cast("string")))
    hint = S.usable_hint([(first, "first"), (F.col("url"), "second")])
    return parquet(spark, sf_dir, "pages").select("page_id", hint["url"].alias("url"), hint["method"].alias("method"))


@query(
    """WITH h AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS host FROM pages)
SELECT host IN ('thther.example.org', 'therha.example.com', 'therin.example.net') AS moved, count(*) AS n, count(DISTINCT host) AS n_hosts FROM h GROUP BY 1"""
)
def host_rewrite_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = host_rewrite(spark, sf_dir)
    moved = F.coalesce(S.url_host(F.col("new_url")) != F.col("host"), F.lit(False))
    return rows.groupBy(moved.alias("moved")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("host").alias("n_hosts"))


# --- sheets and case tables ------------------------------------------------------------------------------------

_SHEET_NAMES = ["Table 1", "Figure 2", "Annex A", "Annex BQR", "Table of contents", "Notes", "Data set"]


@query(
    """WITH g AS (SELECT p_brand, p_size % 7 AS k, count(*) AS n, min(p_size) % 5 AS cols, (count(*) % 10) / 100.0::DOUBLE AS conf FROM part GROUP BY 1, 2),
s AS (SELECT *, ['Table 1', 'Figure 2', 'Annex A', 'Annex BQR', 'Table of contents', 'Notes', 'Data set'][k + 1] AS name, CASE WHEN k = 6 OR p_brand LIKE '%1' THEN 'Casework_Database.xlsx' ELSE 'stats.xlsx' END AS file FROM g),
v AS (SELECT p_brand, name, CASE WHEN file LIKE 'Case%' THEN CASE WHEN name = 'Data set' OR (cols >= 15 AND n >= 1000) THEN {'c': 'case_level', 'r': 'casework main dataset sheet', 'v': conf < 0.05::DOUBLE} ELSE {'c': 'metadata_chart', 'r': 'casework workbook support/reference sheet', 'v': true} END
  WHEN name = 'Table of contents' THEN {'c': 'exclude', 'r': 'index/contents sheet', 'v': false} WHEN name = 'Figure 2' THEN {'c': 'metadata_chart', 'r': 'chart helper/figure sheet', 'v': false}
  WHEN name = 'Annex BQR' THEN {'c': 'metadata_chart', 'r': 'background quality report helper sheet', 'v': false} WHEN name = 'Table 1' THEN {'c': 'aggregate_timeseries', 'r': 'tabular quarterly statistics', 'v': conf < 0.03::DOUBLE}
  WHEN name = 'Annex A' THEN CASE WHEN n >= 20 AND cols >= 3 THEN {'c': 'aggregate_timeseries', 'r': 'annex tabular statistics', 'v': conf < 0.03::DOUBLE} ELSE {'c': 'metadata_chart', 'r': 'annex notes/chart support', 'v': true} END
  WHEN cols <= 1 AND n <= 30 THEN {'c': 'exclude', 'r': 'single-cell note/title sheet', 'v': false} WHEN n >= 15 AND cols >= 2 THEN {'c': 'aggregate_timeseries', 'r': 'default statistical table classification', 'v': conf < 0.03::DOUBLE}
  ELSE {'c': 'metadata_chart', 'r': 'fallback non-tabular sheet', 'v': true} END AS x FROM s)
SELECT p_brand, name, x.c AS class, x.r AS reason, x.v AS review FROM v"""
)
def sheet_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by brand and size as sheets of two workbooks."""
    sheets = parquet(spark, sf_dir, "part").groupBy("p_brand", (F.col("p_size") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n"), (F.min("p_size") % 5).alias("cols"))
    name = F.get(F.array(*map(F.lit, _SHEET_NAMES)), F.col("k"))
    file = F.when((F.col("k") == 6) | F.col("p_brand").endswith("1"), "Casework_Database.xlsx").otherwise("stats.xlsx")
    verdict = R.sheet_class(file, name, F.col("cols"), F.col("n"), (F.col("n") % 10) / 100.0)
    return sheets.select("p_brand", name.alias("name"), verdict.alias("x")).select("p_brand", "name", "x.class", "x.reason", "x.review")


@query(
    """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN ' n/a ' ELSE 'APP/' || o_orderkey END AS ref, CASE o_orderstatus WHEN 'F' THEN 'Dismissed ' WHEN 'O' THEN 'ALLOWED' ELSE 'pending' END AS verdict,
  CASE WHEN o_orderkey % 7 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%d/%m/%Y') END AS decided, CASE o_orderkey % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' ELSE '-' END AS aonb, CASE WHEN o_orderkey % 5 = 0 THEN '1,' || lpad((o_orderkey % 1000)::VARCHAR, 3, '0') ELSE '?' END AS homes FROM orders),
c AS (SELECT CASE WHEN ref LIKE 'APP%' THEN ref END AS case_number, CASE verdict WHEN 'Dismissed ' THEN 'dismissed' WHEN 'ALLOWED' THEN 'allowed' END AS decision_outcome,
  CASE WHEN decided <> 'soon' THEN strptime(decided, '%d/%m/%Y')::DATE END AS decision_date, CASE aonb WHEN 'Yes' THEN 'TRUE' WHEN 'no' THEN 'FALSE' END AS in_aonb, CASE WHEN homes <> '?' THEN replace(homes, ',', '')::DOUBLE END AS residences FROM o)
SELECT case_number, decision_outcome, decision_date, in_aonb, residences, NULL::VARCHAR AS inspector FROM c WHERE case_number IS NOT NULL OR decision_outcome IS NOT NULL OR decision_date IS NOT NULL"""
)
def case_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as an untidy sheet of appeal cases."""
    key = F.col("o_orderkey")
    sheet = parquet(spark, sf_dir, "orders").select(
        F.when(key % 11 == 0, " n/a ").otherwise(F.concat(F.lit("APP/"), key.cast("string"))).alias("Case Ref"),
        F.when(F.col("o_orderstatus") == "F", "Dismissed ").when(F.col("o_orderstatus") == "O", "ALLOWED").otherwise("pending").alias("Decision"),
        F.when(key % 7 == 0, "soon").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("Decided on"),
        F.when(key % 3 == 0, "Yes").when(key % 3 == 1, "no").otherwise("-").alias("AONB"),
        F.when(key % 5 == 0, F.concat(F.lit("1,"), F.lpad((key % 1000).cast("string"), 3, "0"))).otherwise("?").alias("Homes"),
    )
    aliases = {"case_number": ["Case Number", "Case Ref"], "decision_outcome": ["Decision"], "decision_date": ["Decision Date", "Decided on"], "in_aonb": ["AONB"], "residences": ["Homes"], "inspector": ["Inspector"]}
    maps = {"decision_outcome": {"dismissed": "dismissed", "allowed": "allowed"}, "in_aonb": {"yes": "TRUE", "no": "FALSE"}}
    return curate.case_table(sheet, aliases, ["case_number", "inspector"], ["decision_date"], ["residences"], maps, ["case_number", "decision_outcome", "decision_date"])


@query(
    """SELECT p_partkey FROM part WHERE p_size % 3 < 2 AND (regexp_matches(coalesce(p_name, '') || ' ' || coalesce(p_type, '') || ' ' || coalesce(p_brand, ''), 'green|brass|#1', 'i'))"""
)
def unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text failed and whose names hold a keyword."""
    parts = parquet(spark, sf_dir, "part").withColumn("status", F.when(F.col("p_size") % 3 == 0, "no_text").when(F.col("p_size") % 3 == 1, "extract_error").otherwise("ok"))
    return corpus.unreadable(parts, "status", ["no_text", "extract_error"], ["p_name", "p_type", "p_brand"], "green|brass|#1").select("p_partkey")


# --- geography, rates ------------------------------------------------------------------------------------------


@query(
    """WITH a AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders), b AS (SELECT DISTINCT year(l_shipdate) AS y FROM lineitem)
SELECT min(y) AS first_year, max(y) AS last_year, count(*) AS n_years FROM (SELECT y FROM a INTERSECT SELECT y FROM b) WHERE y < 1998"""
)
def common_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = parquet(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"))
    shipped = parquet(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("year"))
    return geo.common_years(own.distinct(), shipped.distinct(), below=1998)


_SQL_BRIDGE = """b AS (SELECT n_name, n_nationkey, unnest(CASE n_nationkey % 3 WHEN 0 THEN ['joint', 'joint'] WHEN 1 THEN ['matched'] ELSE ['new_unitary', 'unmatched'] END) AS status,
  unnest(CASE n_nationkey % 3 WHEN 1 THEN [0] ELSE [0, 1] END) AS place FROM nation)"""


@query(
    f"""WITH {_SQL_BRIDGE}, n AS (SELECT c_nationkey, count(*) AS apps FROM customer GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY n_name ORDER BY place) AS rn FROM b LEFT JOIN n ON c_nationkey = n_nationkey)
SELECT status, count(*) AS n_rows, count(*) FILTER (rn = 1) AS n_authorities, (sum(CASE WHEN rn = 1 THEN apps ELSE 0 END))::BIGINT AS n_apps FROM r GROUP BY 1"""
)
def match_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bridge in which some authorities have two areas: each counts once."""
    third = F.col("n_nationkey") % 3
    areas = F.when(third == 0, F.array(F.lit("joint"), F.lit("joint"))).when(third == 1, F.array(F.lit("matched"))).otherwise(F.array(F.lit("new_unitary"), F.lit("unmatched")))
    bridge = parquet(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.posexplode(areas).alias("place", "status"))
    apps = parquet(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("apps"))
    return geo.match_statuses(bridge.join(apps, "n_nationkey", "left"), "n_name", "status", "apps", ["place"])


@query(
    """SELECT o_orderstatus, count(*) FILTER (o_orderpriority = '1-URGENT') AS "n_1-URGENT", count(*) FILTER (o_orderpriority = '2-HIGH') AS "n_2-HIGH", count(*) AS total FROM orders GROUP BY 1"""
)
def cross_tab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.cross_tab(parquet(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority", ["1-URGENT", "2-HIGH"])


@query(
    """WITH a AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'fine' ELSE 'junk' END AS a FROM labels),
b AS (SELECT doc_id, CASE WHEN text IS NULL OR NOT regexp_matches(text, '\\S') THEN 'fine' WHEN regexp_matches(text, '#{3}|%{3}') THEN 'junk' WHEN regexp_matches(text, ' \\| ') THEN 'table' ELSE 'fine' END AS b FROM documents),
j AS (SELECT a, b, CASE b WHEN 'table' THEN 'junk' ELSE b END AS c FROM a JOIN b USING (doc_id))
SELECT count(*) AS n, round(avg((a = b)::INT) * 100.0::DOUBLE, 4) AS pct_full, round(avg((a = c)::INT) * 100.0::DOUBLE, 4) AS pct_collapsed, count(*) FILTER (a <> c) AS n_review FROM j"""
)
def agreement_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.agreement_rates(agreement(spark, sf_dir))


@query(
    """SELECT n_name, l_returnflag, count(DISTINCT l_orderkey) AS n_units, count(DISTINCT l_suppkey) AS n_members, count(*) FILTER (NOT (l_discount > 0)) AS n_missing,
  round(count(*) FILTER (l_discount > 0) * 100.0::DOUBLE / count(*), 4) AS pct_present FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2"""
)
def unit_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = parquet(spark, sf_dir, "supplier").join(parquet(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey")
    lines = parquet(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_discount", F.col("l_suppkey").alias("s_suppkey"))
    joined = lines.join(places.select("s_suppkey", "n_name"), "s_suppkey")
    return rates.unit_rollup(joined, ["n_name", "l_returnflag"], "s_suppkey", "l_orderkey", F.col("l_discount") > 0)


@query(
    """WITH u AS (SELECT user_id, count(*) AS k, any_value(event_type ORDER BY event_id) AS kind FROM events GROUP BY 1),
b AS (SELECT kind, CASE WHEN k < 60 THEN 'small' WHEN k < 70 THEN 'medium' ELSE 'large' END AS bucket FROM u), n AS (SELECT kind, bucket, count(*) AS n FROM b GROUP BY 1, 2)
SELECT kind, bucket, n, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY kind), 4) AS pct FROM n"""
)
def effort_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = parquet(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("k"), F.min_by("event_type", "event_id").alias("kind"))
    return rates.tally(users, S.size_class(F.col("k"), 60, 70), ["kind"])


@query("""WITH o AS (SELECT o_orderstatus AS s, count(*) AS k, count(*) FILTER (o_orderpriority = '1-URGENT') AS u FROM orders GROUP BY 1) SELECT s AS status, round(u * 100.0::DOUBLE / k, 1) AS pct_urgent FROM o""")
def pct_urgent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parquet(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("u"))
    return rows.select("status", S.pct(F.col("u"), F.col("k")).alias("pct_urgent"))


# --- linkage summaries and checks ------------------------------------------------------------------------------


@query(
    """WITH s AS (SELECT o_orderkey, o_totalprice, o_orderstatus, o_orderdate, sum(l_extendedprice) AS total, min(l_shipdate) AS first_ship, count(*) FILTER (l_linestatus = 'O') AS n_open FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)
SELECT severity, sum(n)::BIGINT AS n FROM (SELECT 'hard' AS severity, count(*) AS n FROM s WHERE first_ship < o_orderdate UNION ALL SELECT 'soft', count(*) FROM s WHERE o_orderstatus = 'F' AND n_open > 0
  UNION ALL SELECT 'soft', count(*) FROM s WHERE abs(o_totalprice - total) > 0.2 * o_totalprice) GROUP BY 1 HAVING sum(n) > 0"""
)
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistency(spark, sf_dir).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


_SQL_RECORDS = """r AS (SELECT o_orderkey AS uid, o_orderkey % 97 AS k, CASE WHEN o_orderkey % 50 = 49 THEN 'timeout' END AS error,
  CASE o_orderstatus WHEN 'F' THEN 'refused' WHEN 'P' THEN 'prior_approval_refused' WHEN 'O' THEN 'approved' END AS outcome,
  CASE o_orderkey % 4 WHEN 0 THEN 'unacceptable' WHEN 1 THEN 'acceptable' WHEN 2 THEN 'not_separately_assessed' END AS stance,
  CASE WHEN o_orderkey % 3 = 0 THEN 'hp_relevant' ELSE 'other' END AS relevance, CASE WHEN o_orderkey % 10 = 0 THEN (o_orderkey % 7)::INT END AS n_conditions,
  CASE WHEN o_orderkey % 12 = 0 THEN ['noise'] WHEN o_orderkey % 12 = 1 THEN []::VARCHAR[] END AS condition_types, CASE o_orderkey % 9 WHEN 0 THEN 'noise' WHEN 1 THEN '' END AS ground,
  CASE o_orderkey % 5 WHEN 0 THEN ['sound_noise', 'design'] WHEN 1 THEN ['design'] WHEN 2 THEN []::VARCHAR[] END AS reasons, CASE o_orderkey % 6 WHEN 0 THEN ['design'] WHEN 1 THEN ['design', 'sound_noise'] END AS considered,
  CASE WHEN o_orderkey % 2 = 0 THEN 30.0::DOUBLE END AS specific, 5.0::DOUBLE AS correction, CASE WHEN o_orderkey % 8 < 6 THEN 35.0::DOUBLE + o_orderkey % 3 END AS rating,
  CASE WHEN o_orderkey % 7 = 0 THEN 30.0::DOUBLE END AS night, CASE WHEN o_orderkey % 7 = 1 THEN 33.0::DOUBLE END AS day, CASE WHEN o_orderkey % 11 = 0 THEN 34.0::DOUBLE END AS lim,
  CASE WHEN o_orderkey % 13 < 5 THEN 3.0::DOUBLE END AS exceedance, CASE o_orderkey % 22 WHEN 0 THEN 'background' WHEN 11 THEN '' END AS relative, CASE o_orderkey % 16 WHEN 0 THEN 'hours' WHEN 1 THEN '' END AS specific_conditions, CASE o_orderkey % 14 WHEN 0 THEN true WHEN 1 THEN false END AS turbine,
  CASE WHEN o_orderkey % 28 IN (0, 2) THEN ['wind_turbine'] END AS works, CASE o_orderkey % 15 WHEN 0 THEN '1930s' WHEN 1 THEN '' END AS age, CASE o_orderkey % 30 WHEN 0 THEN 'built in 1932' END AS proof FROM orders)"""


@query(
    f"""WITH {_SQL_RECORDS}, d AS (SELECT *, list_filter([rating - night, rating - day, rating - lim], lambda x: x IS NOT NULL) AS diffs, outcome IN ('refused', 'prior_approval_refused') AS refused,
  coalesce(stance, '') AS st, coalesce(reasons, []) AS rs, coalesce(considered, []) AS cs FROM r),
f AS (SELECT uid, error, unnest([CASE WHEN error IS NOT NULL THEN {{'s': 'HARD', 'c': 'extraction_error', 'd': error}} END,
  CASE WHEN NOT coalesce(outcome = 'approved', false) AND (coalesce(n_conditions, 0) <> 0 OR len(coalesce(condition_types, [])) > 0 OR coalesce(specific_conditions, '') <> '') THEN {{'s': 'HARD', 'c': 'conditions_on_refusal', 'd': outcome}} END,
  CASE WHEN ground <> '' AND st <> 'unacceptable' THEN {{'s': 'HARD', 'c': 'refusal_ground_stance', 'd': ground}} END,
  CASE WHEN abs(specific + correction - rating) > 0.6 THEN {{'s': 'REVIEW', 'c': 'rating_arithmetic', 'd': rating::VARCHAR}} END,
  CASE WHEN exceedance IS NOT NULL AND len(diffs) > 0 AND len(list_filter(diffs, lambda x: abs(exceedance - x) <= 0.6)) = 0 THEN {{'s': 'REVIEW', 'c': 'exceedance_arithmetic', 'd': exceedance::VARCHAR}} END,
  CASE WHEN lim IS NOT NULL AND relative <> '' THEN {{'s': 'REVIEW', 'c': 'limit_double_fill', 'd': lim::VARCHAR}} END,
  CASE WHEN relevance = 'hp_relevant' AND refused AND st = 'not_separately_assessed' THEN {{'s': 'REVIEW', 'c': 'stance_not_assessed', 'd': NULL}} END,
  CASE WHEN relevance = 'hp_relevant' AND refused AND st <> 'unacceptable' AND list_has_any(rs, ['sound_noise', 'setback_boundary']) THEN {{'s': 'REVIEW', 'c': 'noise_refusal_stance', 'd': st}} END,
  CASE WHEN refused AND NOT list_has_all(cs, rs) THEN {{'s': 'REVIEW', 'c': 'reasons_not_subset', 'd': array_to_string(list_sort(list_filter(rs, lambda x: NOT list_contains(cs, x))), '|')}} END,
  CASE WHEN coalesce(turbine, false) <> coalesce(list_contains(works, 'wind_turbine'), false) THEN {{'s': 'REVIEW', 'c': 'wind_turbine_mismatch', 'd': coalesce(turbine, false)::VARCHAR}} END,
  CASE WHEN age <> '' AND proof IS NULL THEN {{'s': 'REVIEW', 'c': 'age_without_evidence', 'd': age}} END]) AS x FROM d)
SELECT uid, x.s AS severity, x.c AS "check", x.d AS detail FROM f WHERE x IS NOT NULL AND (error IS NULL OR x.c = 'extraction_error')"""
)
def record_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as extracted records, with every kind of fault."""
    key = F.col("o_orderkey")

    def turn(n: int, values: dict) -> Column:
        return R.first_case([(key % n == i, v) for i, v in values.items()])

    def words(*xs: str) -> Column:
        return F.array(*map(F.lit, xs)).cast("array<string>")

    columns = {
        "uid": key,
        "error": F.when(key % 50 == 49, "timeout"),
        "decision_outcome": R.first_case([(F.col("o_orderstatus") == s, v) for s, v in (("F", "refused"), ("P", "prior_approval_refused"), ("O", "approved"))]),
        "hp_component_stance": turn(4, {0: "unacceptable", 1: "acceptable", 2: "not_separately_assessed"}),
        "hp_relevance": F.when(key % 3 == 0, "hp_relevant").otherwise("other"),
        "n_conditions": F.when(key % 10 == 0, (key % 7).cast("int")),
        "condition_types": turn(12, {0: words("noise"), 1: words()}),
        "hp_refusal_ground": turn(9, {0: "noise", 1: ""}),
        "council_refusal_reasons": turn(5, {0: words("sound_noise", "design"), 1: words("design"), 2: words()}),
        "council_considerations": turn(6, {0: words("design"), 1: words("design", "sound_noise")}),
        "noise_specific_level_db": F.when(key % 2 == 0, F.lit(30.0)),
        "noise_character_correction_db": F.lit(5.0),
        "noise_rating_level_db": F.when(key % 8 < 6, F.lit(35.0) + key % 3),
        "noise_background_night_db": F.when(key % 7 == 0, F.lit(30.0)),
        "noise_background_day_db": F.when(key % 7 == 1, F.lit(33.0)),
        "noise_limit_db": F.when(key % 11 == 0, F.lit(34.0)),
        "noise_exceedance_db": F.when(key % 13 < 5, F.lit(3.0)),
        "noise_limit_relative": turn(22, {0: "background", 11: ""}),
        "hp_specific_conditions": turn(16, {0: "hours", 1: ""}),
        "includes_wind_turbine": turn(14, {0: True, 1: False}),
        "bundled_works": F.when((key % 28).isin(0, 2), words("wind_turbine")),
        "building_age": turn(15, {0: "1930s", 1: ""}),
        "building_age_evidence": F.when(key % 30 == 0, "built in 1932"),
    }
    return quality.check_records(parquet(spark, sf_dir, "orders").select(*[c.alias(n) for n, c in columns.items()]), ["uid"])


@query(
    """WITH c AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'even' ELSE 'odd' END AS source_db, c_custkey, c_nationkey, floor(c_acctbal / 100)::BIGINT AS b, c_mktsegment AS sig FROM customer),
s AS (SELECT s_suppkey, s_nationkey, floor(s_acctbal / 100)::BIGINT AS b, CASE WHEN s_suppkey % 2 = 0 THEN 'BUILDING' ELSE 'MACHINERY' END AS sig FROM supplier)
SELECT source_db, tier, count(DISTINCT c_custkey) AS n_apps, count(*) AS n_links FROM (SELECT c.source_db, c.c_custkey, CASE WHEN c.sig = s.sig THEN 't2' ELSE 't3' END AS tier FROM c JOIN s ON c_nationkey = s_nationkey AND c.b = s.b) GROUP BY 1, 2"""
)
def link_summary_by_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of customers and suppliers of one block, by corpus and tier."""
    customers = parquet(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("block"), F.floor(F.col("c_acctbal") / 100).alias("b"), F.col("c_mktsegment").alias("sig"))
    parts = {"even": customers.filter(F.col("c_custkey") % 2 == 0), "odd": customers.filter(F.col("c_custkey") % 2 != 0)}
    sellers = parquet(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("block"), F.floor(F.col("s_acctbal") / 100).alias("b"), F.when(F.col("s_suppkey") % 2 == 0, "BUILDING").otherwise("MACHINERY").alias("own"))
    hits = linkage.with_provenance(parts).join(sellers, ["block", "b"]).withColumn("tier", F.when(F.col("sig") == F.col("own"), "t2").otherwise("t3"))
    return linkage.linkage_summary(hits, "c_custkey", ["source_db", "tier"])


# --- documents -------------------------------------------------------------------------------------------------


@query(
    """WITH r AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents), k AS (SELECT *, least(coalesce(n_chars, 0), CASE WHEN rank <= 2 THEN 6000 ELSE 2000 END) AS c FROM r WHERE rank <= 10),
b AS (SELECT *, 15000 - coalesce(sum(c) OVER (PARTITION BY source ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM k),
t AS (SELECT *, (CASE WHEN room > 200 THEN least(c, room) ELSE 0 END)::BIGINT AS taken FROM b)
SELECT source, rank, n_chars, taken, CASE WHEN taken = 0 THEN 'dropped' ELSE 'truncated' END AS warning FROM t WHERE rank <= 4 AND taken < n_chars"""
)
def budget_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = char_budget(spark, sf_dir).join(parquet(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return corpus.budget_warnings(taken, "source", "rank", "n_chars", F.col("rank") <= 4)


_SQL_FILES = """f AS (SELECT p_partkey, p_partkey % 100 + 1 AS s_suppkey, 'files/' || p_brand || '/' || p_partkey || CASE p_size % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PDF' WHEN 2 THEN '.docx' WHEN 3 THEN '.msg' ELSE '' END AS path FROM part)"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.get(F.array(*map(F.lit, (".pdf", ".PDF", ".docx", ".msg", ""))), F.col("p_size") % 5)
    path = F.concat(F.lit("files/"), "p_brand", F.lit("/"), F.col("p_partkey").cast("string"), ending)
    return parquet(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 100 + 1).alias("s_suppkey"), path.alias("path"))


@query(f"WITH {_SQL_FILES} SELECT p_partkey, s_name, path FROM f JOIN supplier USING (s_suppkey) WHERE lower(path) LIKE '%.pdf'")
def pdf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of suppliers that a PDF extractor would read."""
    apps = parquet(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return corpus.files_of(_files(spark, sf_dir), apps, "s_suppkey", "path", ["pdf"]).select("p_partkey", "s_name", "path")


@query(f"WITH {_SQL_FILES}, e AS (SELECT nullif(lower(regexp_extract(path, '\\.([A-Za-z0-9]{{1,8}})$', 1)), '') AS extension FROM f) SELECT extension, count(*) AS n FROM e WHERE extension IS NULL OR extension NOT IN ('pdf', 'docx') GROUP BY 1")
def unhandled_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.unhandled_extensions(_files(spark, sf_dir), "path", ["pdf", "docx"])


@query(
    """WITH l AS (SELECT l_orderkey, arg_min({'f': l_returnflag, 'm': l_linestatus, 's': l_shipdate, 'p': l_partkey}, {'a': l_shipdate, 'b': l_linenumber}) AS r, count(*) AS n_lines FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'refused' WHEN 'P' THEN 'withdrawn' ELSE 'other' END AS outcome_bucket, o_orderpriority, o_orderdate FROM orders)
SELECT o_orderkey, outcome_bucket, datediff('day', o_orderdate::DATE, (r.s)::DATE) AS days_to_decision, coalesce(regexp_matches(o_orderpriority, 'urgent', 'i') OR r.f = 'R', false) AS is_urgent,
  coalesce(r.m = 'O', false) AS is_open, coalesce(p_name, '') AS excerpt FROM o LEFT JOIN l ON o_orderkey = l_orderkey LEFT JOIN part ON p_partkey = r.p WHERE outcome_bucket <> 'other'"""
)
def case_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as refused or withdrawn cases, with what their first line says of them."""
    lines = tables.with_file_order(parquet(spark, sf_dir, "lineitem"), "place")
    lines = lines.select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", "l_linestatus", "l_shipdate", "l_linenumber", "l_partkey", "place")
    parts = parquet(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("excerpt"))
    apps = parquet(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("start"))
    rows = corpus.enrich(apps, "o_orderkey", [(lines, ["l_returnflag", "l_linestatus", "l_shipdate", "l_partkey"], ["l_shipdate", "l_linenumber", "place"])])
    rows = rows.join(parts, "l_partkey", "left").withColumn("decided", F.date_format("l_shipdate", "yyyy-MM-dd"))
    flags = R.boost_flags(R.flag_columns({"is_urgent": [("o_orderpriority", "urgent")], "is_open": [("l_linestatus", "^O$")]}), F.array("l_returnflag"), {"is_urgent": "R"})
    outcome = R.first_match(F.col("o_orderstatus"), [("refused", "F"), ("withdrawn", "P")], "other", "other")
    facts = corpus.case_facts(rows, outcome, flags, "start", "decided", "excerpt")
    return facts.select("o_orderkey", "outcome_bucket", "days_to_decision", "is_urgent", "is_open", "excerpt")


@query(
    """WITH m AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS run FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0)
SELECT doc_id, source, run FROM m"""
)
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over documents, the second of which replaces rows of the first."""
    docs = parquet(spark, sf_dir, "documents").select("doc_id", "source")
    path = tables.scratch_dir(spark)
    stored.manifest_upsert(path, docs.filter(F.col("doc_id") % 2 == 0).withColumn("run", F.lit(1)), "doc_id", ["run"])
    return stored.manifest_upsert(path, docs.filter(F.col("doc_id") % 3 == 0).withColumn("run", F.lit(2)), "doc_id", ["run"])


@query("SELECT event_id, event_type FROM events WHERE event_id % 5 > 0 UNION ALL SELECT NULL, NULL FROM events WHERE event_id % 5 = 0")
def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of JSON, some of them broken, read back by schema: a broken line is a row of nulls."""
    path = tables.scratch_dir(spark)
    line = F.when(F.col("event_id") % 5 == 0, "{broken").otherwise(F.to_json(F.struct("event_id", "event_type", "value")))
    parquet(spark, sf_dir, "events").select(line.alias("value")).write.text(path)
    schema = StructType([StructField("event_id", LongType()), StructField("event_type", StringType())])
    return tables.read_json_records(spark, path, schema)


@query(
    """SELECT o_orderstatus AS status, printf('%.1f', round(avg(o_totalprice), 1)) AS mean_price, array_to_string(list_sort(list(DISTINCT o_orderpriority)), '|') AS priorities, CASE WHEN count(*) > 3000 THEN 'TRUE' ELSE 'FALSE' END AS is_many FROM orders GROUP BY 1"""
)
def report_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of orders by status, written as tab-separated text and read again."""
    path = tables.scratch_dir(spark)
    rows = parquet(spark, sf_dir, "orders").groupBy(F.concat("o_orderstatus", F.lit("\t")).alias("status")).agg(
        F.avg("o_totalprice").alias("mean_price"), F.array_sort(F.collect_set("o_orderpriority")).alias("priorities"), (F.count(F.lit(1)) > 3000).alias("is_many")
    )
    tables.write_report(rows, path)
    return spark.read.csv(path, header=True, sep="\t")


@query("SELECT p_brand AS brand, p_size AS size, count(*) AS n FROM part WHERE p_brand LIKE '%1' GROUP BY 1, 2")
def partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written by brand and size; only the wanted folders are read."""
    path = tables.scratch_dir(spark)
    parts = parquet(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("brand"), (F.col("p_size")).alias("size"))
    tables.write_partitioned(parts.repartition("brand"), path, ["brand"])
    own = spark.read.schema("p_partkey long, size int, brand string").parquet(path).filter(F.col("brand").endswith("1"))
    return own.groupBy("brand", "size").agg(F.count(F.lit(1)).alias("n"))


# --- statistics files and scalars ------------------------------------------------------------------------------


@query(
    """WITH y AS (SELECT CASE WHEN o_orderkey % 9 = 0 THEN 'n/a' WHEN o_orderkey % 9 = 1 THEN ' ' ELSE ' ' || year(o_orderdate) || ' ' END AS y FROM orders), c AS (SELECT y, count(*)::VARCHAR AS n FROM y GROUP BY 1)
SELECT trim(y)::INT AS year, n::BIGINT AS n FROM c WHERE regexp_matches(trim(y), '^[0-9]+$')"""
)
def year_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by year as text, in which some years are no numbers."""
    key = F.col("o_orderkey") % 9
    year = F.when(key == 0, "n/a").when(key == 1, " ").otherwise(F.concat(F.lit(" "), F.year("o_orderdate").cast("string"), F.lit(" ")))
    counts = parquet(spark, sf_dir, "orders").groupBy(year.alias("y")).agg(F.count(F.lit(1)).cast("string").alias("n"))
    return tables.year_counts(counts, "y", "n")


@query(
    """WITH c AS (SELECT c_nationkey AS area, year(o_orderdate) AS year, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE year(o_orderdate) IN (1995, 1996) GROUP BY 1, 2),
a AS (SELECT DISTINCT c_nationkey AS area FROM customer), y AS (SELECT unnest([1995, 1996])::INT AS year)
SELECT area, year, CASE WHEN n % 4 > 0 THEN (n * 1000)::DOUBLE END AS value FROM a CROSS JOIN y LEFT JOIN c USING (area, year)"""
)
def suppressed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide table of yearly figures with separators and suppression marks, as a statistics office prints it."""
    orders = parquet(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("year"))
    counts = parquet(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("area")).join(orders, "c_custkey", "left").groupBy("area").pivot("year", [1995, 1996]).agg(F.count(F.lit(1)).alias("n"))
    cells = [F.when(F.col(f"`{y}`") % 4 > 0, F.format_number(F.col(f"`{y}`") * 1000, 0)).when(F.col(f"`{y}`") > 0, "[c]").alias(f"Year {y}") for y in (1995, 1996)]
    return tables.suppressed_stats(counts.select("area", *cells), ["area"], ["Year 1995", "Year 1996"])


@query(
    """WITH a AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'Land at Mill Farm, Ab1 2cd' WHEN 1 THEN (c_custkey % 300) || ' High Street' WHEN 2 THEN 'Plot rear of ' || c_mktsegment || ' House' WHEN 3 THEN 'Flat 12a, 7 Low Road sw1a 1AA' WHEN 4 THEN 'The site' END AS t FROM customer),
b AS (SELECT c_custkey, nullif(regexp_extract(upper(t), '\\b([A-Z]{1,2}[0-9][0-9A-Z]?)\\s*([0-9][A-Z]{2})\\b', 1), '') AS o, regexp_extract(upper(t), '\\b([A-Z]{1,2}[0-9][0-9A-Z]?)\\s*([0-9][A-Z]{2})\\b', 2) AS i,
  regexp_extract_all(regexp_replace(upper(t), '\\b([A-Z]{1,2}[0-9][0-9A-Z]?)\\s*([0-9][A-Z]{2})\\b', '', 'g'), '[A-Z0-9]+') AS w FROM a)
SELECT c_custkey, o || ' ' || i AS postcode, coalesce(list_filter(w, lambda x: regexp_matches(x, '^[0-9]{1,5}$'))[1], list_filter(w, lambda x: x NOT IN ('LAND', 'AT', 'OF', 'REAR', 'PLOT', 'THE', 'SITE'))[1]) AS signature,
  CASE substr(o, 1, 2) WHEN 'SW' THEN 'London' WHEN 'AB' THEN 'Scotland' ELSE 'Unknown' END AS region FROM b"""
)
def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    text = R.first_case(
        [
            (key % 6 == 0, "Land at Mill Farm, Ab1 2cd"),
            (key % 6 == 1, F.concat((key % 300).cast("string"), F.lit(" High Street"))),
            (key % 6 == 2, F.concat(F.lit("Plot rear of "), "c_mktsegment", F.lit(" House"))),
            (key % 6 == 3, "Flat 12a, 7 Low Road sw1a 1AA"),
            (key % 6 == 4, "The site"),
        ]
    )
    code = S.postcode(text)
    return parquet(spark, sf_dir, "customer").select(
        "c_custkey", code.alias("postcode"), S.address_signature(text).alias("signature"), S.prefix_lookup(code, {"SW": "London", "A": "Elsewhere", "AB": "Scotland"}).alias("region")
    )


@query(
    """WITH n AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'Royal Borough of Kensington' WHEN 1 THEN 'St. ' || c_mktsegment || ' City Council' WHEN 2 THEN 'Eden District' WHEN 3 THEN 'The Council' END AS t FROM customer)
SELECT c_custkey, CASE name WHEN 'KENSINGTON' THEN 'KENSINGTON CHELSEA' WHEN 'EDEN' THEN 'WESTMORLAND FURNESS' ELSE nullif(name, '') END AS authority FROM (SELECT c_custkey, array_to_string([x FOR x IN
  string_split(regexp_replace(regexp_replace(replace(upper(t), '&', ' AND '), '\\bST\\b', 'SAINT', 'g'), '[^A-Z0-9]+', ' ', 'g'), ' ')
  IF x <> '' AND x NOT IN ('AND', 'AUTHORITY', 'BOROUGH', 'CITY', 'COUNCIL', 'COUNTY', 'DISTRICT', 'LONDON', 'METROPOLITAN', 'OF', 'ROYAL', 'THE', 'UNITARY')], ' ') AS name FROM n)"""
)
def canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of authorities, some of which merged into others."""
    key = F.col("c_custkey")
    name = R.first_case(
        [(key % 5 == 0, "Royal Borough of Kensington"), (key % 5 == 1, F.concat(F.lit("St. "), "c_mktsegment", F.lit(" City Council"))), (key % 5 == 2, "Eden District"), (key % 5 == 3, "The Council")]
    )
    return parquet(spark, sf_dir, "customer").select("c_custkey", S.canonical_name(name, aliases=ladders.AUTHORITY_ALIASES).alias("authority"))


@query(
    """WITH d AS (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 12 < 11 THEN d END AS day, CASE o_orderkey % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'refused' ELSE 'Other' END AS verdict FROM d"""
)
def coded_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in eleven written forms and one that is none, and decisions through a value map."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    number = F.dayofmonth(day)
    suffix = F.when(number.isin(11, 12, 13), "th").when(number % 10 == 1, "st").when(number % 10 == 2, "nd").when(number % 10 == 3, "rd").otherwise("th")
    forms = ["yyyy-MM-dd", "dd/MM/yyyy", "d/M/yyyy", "dd-MM-yyyy", "d MMMM yyyy", "d MMM yyyy", "dd.MM.yy", "MMMM d, yyyy", "yyyy/MM/dd HH:mm:ss"]
    texts = [F.date_format(day, f) for f in forms]
    texts += [F.concat(number.cast("string"), suffix, F.lit("  "), F.date_format(day, "MMMM yyyy")), F.upper(F.date_format(day, "dd-MMM-yy"))]
    written = R.first_case([(key % 12 == i, t) for i, t in enumerate(texts)], "32/13/1999")
    verdict = R.first_case([(key % 4 == 0, " Granted"), (key % 4 == 1, "DISMISSED ")], "Other")
    maps = {"granted": "approved", "dismissed": "refused"}
    return parquet(spark, sf_dir, "orders").select("o_orderkey", S.to_iso_date(written).alias("day"), R.value_map(verdict, maps).alias("verdict"))


@query(
    """WITH p AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 0 ELSE coalesce(n_chars, 0) END AS a, doc_id % 4 AS pages, CASE WHEN doc_id % 5 = 0 THEN 'unreadable' WHEN doc_id % 7 = 0 THEN 'image_only' WHEN doc_id % 3 = 0 THEN 'good' ELSE 'poor' END AS qa,
  CASE WHEN doc_id % 11 = 0 THEN 'crash' END AS ea, CASE doc_id % 17 WHEN 0 THEN ' noise ' WHEN 1 THEN 'spec_calc' WHEN 2 THEN 'plan' END AS family,
  CASE WHEN doc_id % 6 = 0 THEN 0 ELSE coalesce(n_chars, 0) + (doc_id % 40 - 10) * 50 END AS b, CASE WHEN doc_id % 2 = 0 THEN 'good' ELSE 'poor' END AS qb, CASE WHEN doc_id % 13 = 0 THEN 'crash' END AS eb FROM documents),
r AS (SELECT *, CASE WHEN trim(family) IN ('noise', 'spec_calc') THEN 'family_override' WHEN ea IS NOT NULL THEN 'primary_error' WHEN qa = 'image_only' THEN 'image_only' WHEN pages > 0 AND a / pages < 600 THEN 'few_chars' END AS reason FROM p),
v AS (SELECT reason, reason IS NOT NULL AND eb IS NULL AND b > 0 AND CASE WHEN reason IN ('family_override', 'primary_error', 'image_only') OR ea IS NOT NULL OR qa = 'image_only' THEN true WHEN qb = 'good' AND qa <> 'good' THEN true
  WHEN reason = 'few_chars' THEN b >= a + 500 OR 2 * b >= 3 * a ELSE b > a END AS accepted FROM r)
SELECT reason, accepted, count(*) AS n FROM v GROUP BY ALL"""
)
def fallback_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a document is extracted a second time, and whether that is taken."""
    key, chars = F.col("doc_id"), F.coalesce("n_chars", F.lit(0))
    quality = R.first_case([(key % 5 == 0, "unreadable"), (key % 7 == 0, "image_only"), (key % 3 == 0, "good")], "poor")
    primary = F.struct(
        F.when(key % 5 == 0, 0).otherwise(chars).alias("char_count"), (key % 4).alias("page_count"), quality.alias("quality"), F.when(key % 11 == 0, "crash").alias("error")
    )
    second = F.struct(
        F.when(key % 6 == 0, 0).otherwise(chars + (key % 40 - 10) * 50).alias("char_count"),
        F.when(key % 2 == 0, "good").otherwise("poor").alias("quality"),
        F.when(key % 13 == 0, "crash").alias("error"),
    )
    family = R.first_case([(key % 17 == 0, " noise "), (key % 17 == 1, "spec_calc"), (key % 17 == 2, "plan")])
    rows = parquet(spark, sf_dir, "documents").select(primary.alias("p"), second.alias("f"), family.alias("family"))
    rows = rows.withColumn("reason", S.fallback_reason(F.col("p"), F.col("family"), 600.0))
    rows = rows.withColumn("accepted", S.accept_fallback(F.col("p"), F.col("f"), F.col("reason")))
    return rows.groupBy("reason", "accepted").agg(F.count(F.lit(1)).alias("n"))


# --- progress, paths, lookups ----------------------------------------------------------------------------------


@query("SELECT source, count(DISTINCT doc_id) AS n, min(doc_id) AS example FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) GROUP BY 1")
def additional_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = parquet(spark, sf_dir, "documents").select("doc_id", "source")
    return progress.additional_by_term(docs, parquet(spark, sf_dir, "labels"), "doc_id", "source")


@query(
    """SELECT count(*) AS n, count(*) FILTER (event_type = 'purchase') AS n_purchase, count(*) FILTER (event_type = 'error') AS n_error, sum(event_id % 1000)::BIGINT AS total_size, count(DISTINCT user_id) AS n_keys FROM events"""
)
def attempt_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parquet(spark, sf_dir, "events").select("event_type", "user_id", (F.col("event_id") % 1000).alias("bytes"))
    return progress.attempt_totals(rows, "event_type", ["purchase", "error"], "bytes", "user_id")


@query(
    """WITH c AS (SELECT c_custkey, 50 + c_custkey % 10 AS lat, c_custkey % 8 - 6 AS lng FROM customer WHERE c_custkey % 17 > 0)
SELECT CASE WHEN lat BETWEEN 55 AND 61 AND lng BETWEEN -8 AND -1 THEN 'north' WHEN lat BETWEEN 51 AND 53 AND lng BETWEEN -6 AND -3 THEN 'west' WHEN lat BETWEEN 49 AND 56 AND lng BETWEEN -6 AND 2 THEN 'south' ELSE 'Unknown' END AS area,
  count(*) AS n, round(avg(lat), 4) AS mean_lat, round(avg(lng), 4) AS mean_lng FROM c GROUP BY 1"""
)
def areas_by_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases by the box that holds them, with the middle of each."""
    key = F.col("c_custkey")
    cases = parquet(spark, sf_dir, "customer").filter(key % 17 > 0).select((key % 10 + 50).alias("lat"), (key % 8 - 6).alias("lng"))
    boxes = [("north", 55, -8, 61, -1), ("west", 51, -6, 53, -3), ("south", 49, -6, 56, 2)]
    return cases.groupBy(S.box_region(F.col("lat"), F.col("lng"), boxes).alias("area")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("lat"), 4).alias("mean_lat"), F.round(F.avg("lng"), 4).alias("mean_lng")
    )


@query(SQL["coverage_year"].replace("SELECT year, own::BIGINT", "SELECT round(avg(ratio), 6) AS mean_ratio, max(year)::INT AS last_year, arg_max(ratio, year) AS last_ratio FROM (SELECT year, own::BIGINT", 1) + ")")
def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.series_summary(coverage_year(spark, sf_dir), "year", "ratio").withColumn("mean_ratio", F.round("mean_ratio", 6))


@query(f"SELECT CASE WHEN allocated < 50 THEN 'small' WHEN allocated < 70 THEN 'medium' ELSE 'large' END AS size_class, count(*) AS n, sum(allocated)::BIGINT AS total FROM ({SQL['equal_share']}) GROUP BY 1")
def equal_share_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal shares, put into classes anew."""
    shares = equal_share(spark, sf_dir)
    return shares.groupBy(S.size_class(F.col("allocated"), 50, 70).alias("size_class")).agg(F.count(F.lit(1)).alias("n"), F.sum("allocated").alias("total"))


@query("SELECT 'g' || n_regionkey AS name, 'v' || max(n_nationkey) AS value FROM nation WHERE n_regionkey > 0 GROUP BY n_regionkey")
def lookup_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup file with repeated and blank keys: the last row of a key counts."""
    path = tables.scratch_dir(spark)
    name = F.when(F.col("n_regionkey") > 0, F.concat(F.lit(" g"), F.col("n_regionkey").cast("string"))).otherwise(" ")
    rows = parquet(spark, sf_dir, "nation").select(name.alias("name"), F.concat(F.lit("v"), F.col("n_nationkey").cast("string")).alias("value"), "n_nationkey")
    rows.repartition(1).sortWithinPartitions("n_nationkey").drop("n_nationkey").write.csv(path, header=True)
    return tables.read_lookup(spark, path, "name", "value")


@query(f"WITH {_SQL_FILES} SELECT string_split(path, '/')[1] || '/' || string_split(path, '/')[2] AS folder, min(regexp_replace(path, '^.*Brand', '')) AS first_tail, count(*) AS n FROM f GROUP BY 1")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir).select(S.top_folders(F.col("path")).alias("folder"), S.path_tail(F.col("path"), "Brand").alias("tail"))
    return files.groupBy("folder").agg(F.min("tail").alias("first_tail"), F.count(F.lit(1)).alias("n"))


@query(
    """WITH m AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'v1|x' ELSE 'x' END AS s, CASE p_size % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'poor' ELSE 'error' END AS status FROM part WHERE p_partkey % 5 > 0)
SELECT p_size, count(*) FILTER (s = 'v1|x' AND status IN ('ok', 'poor')) AS n_reused, count(*) FILTER (NOT coalesce(s = 'v1|x' AND status IN ('ok', 'poor'), false)) AS n_todo FROM part LEFT JOIN m USING (p_partkey) GROUP BY 1"""
)
def reuse_by_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose extraction is on record under the present settings, and those to do, by size."""
    parts = parquet(spark, sf_dir, "part").select("p_partkey", "p_size")
    settings = incremental.signature([F.lit("x"), F.when(F.col("p_size") % 2 == 0, "v1"), F.lit("x")])
    status = F.when(F.col("p_size") % 3 == 0, "ok").when(F.col("p_size") % 3 == 1, "poor").otherwise("error")
    known = parts.filter(F.col("p_partkey") % 5 > 0).select("p_partkey", settings.alias("signature"), status.alias("status"))
    reused, todo = incremental.reusable(parts, known, "p_partkey", ["ok", "poor"], "v1|x")
    both = reused.withColumn("reused", F.lit(True)).unionByName(todo.withColumn("reused", F.lit(False)))
    return both.groupBy("p_size").agg(F.count_if("reused").alias("n_reused"), F.count_if(~F.col("reused")).alias("n_todo"))


@query(f"WITH q AS ({SQL['quality_class']}), d AS (SELECT lang, quality FROM q JOIN documents USING (doc_id)), n AS (SELECT lang, quality, count(*) AS n FROM d GROUP BY 1, 2) SELECT lang, quality, n, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY lang), 4) AS pct FROM n")
def quality_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = quality_class(spark, sf_dir).join(parquet(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("none")).alias("lang")), "doc_id")
    return rates.tally(docs, F.col("quality"), ["lang"], "quality")


@query(
    f"""WITH p AS (SELECT page_id, {_SQL_URL} AS link, page_id % 3 AS n, page_id % 7 > 0 AS has_hint, {_sql_rules(_SQL_URL, ladders.URL_SIGNATURES)} AS sig FROM pages),
g AS (SELECT *, lower(regexp_extract(link, '^https?://[^/?#]+([^?#]*)', 1)) AS path FROM p),
k AS (SELECT page_id, CASE WHEN (link IS NULL OR link = '') AND n > 0 AND has_hint THEN 'blank' WHEN link <> '' AND (contains(path, 'login') OR contains(path, 'search.do') OR CASE WHEN length(path) > 1 THEN regexp_replace(path, '/+$', '') ELSE path END IN ('', '/', '/home', '/index.html', '/search')) THEN 'generic'
  WHEN sig IS NULL AND link <> '' THEN 'vague' END AS why FROM g)
SELECT page_id, why FROM k WHERE why IS NOT NULL"""
)
def recovery_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases whose address is worth a search: blank with documents and a hint, generic, or of no known portal."""
    rows, page = _urls(spark, sf_dir), F.col("page_id")
    filled = F.coalesce(F.col("link") != "", F.lit(False))
    why = R.first_case(
        [
            (~filled & (page % 3 > 0) & (page % 7 > 0), "blank"),
            (filled & S.is_generic_url(F.col("link")), "generic"),
            (filled & R.first_match(F.col("link"), ladders.URL_SIGNATURES).isNull(), "vague"),
        ]
    )
    return rows.select("page_id", why.alias("why")).filter(F.col("why").isNotNull())


@query(
    """WITH t AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN ' ' || p_brand || ' ' WHEN 1 THEN ' ' END AS given, p_name || ' ' || p_type AS x FROM part)
SELECT coalesce(nullif(trim(given), ''), CASE WHEN regexp_matches(x, 'promo', 'i') THEN 'promotion' WHEN regexp_matches(x, 'steel|tin', 'i') THEN 'metal' ELSE 'other' END) AS kind, count(*) AS n FROM t GROUP BY 1"""
)
def given_or_ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A given type where there is one, else rules over name and description."""
    given = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit(" "), "p_brand", F.lit(" "))).when(F.col("p_size") % 4 == 1, " ")
    kind = R.value_or_rules(given, [F.col("p_name"), F.col("p_type")], [("promotion", "promo"), ("metal", "steel|tin")], "other")
    return parquet(spark, sf_dir, "part").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


_SQL_PERIODS = """WITH t AS (SELECT lower(CASE event_id % 9 WHEN 0 THEN event_type || ' ' || strftime(ts, '%b %Y') WHEN 1 THEN strftime(ts, '%Y-%m') || ' x' WHEN 2 THEN 'Q1 ' || year(ts) WHEN 3 THEN 'decimal ' || year(ts)
  WHEN 4 THEN 'Marketing ' || year(ts) || ' q' || (event_id % 4 + 1) WHEN 5 THEN 'Dismissed Mar ' || (event_id % 80 + 20) WHEN 6 THEN strftime(ts, '%Y-%m') || '-00 3000' WHEN 7 THEN 'in 1850 or Sept_' || (1985 + event_id % 10) ELSE event_type END) AS t FROM events),
x AS (SELECT *, regexp_extract(t, '\\b(\\d{4})-(0[1-9]|1[0-2])\\b', ['y', 'm']) AS iso,
  regexp_extract(t, '\\b(january|february|march|april|may|june|july|august|september|october|november|december|sept|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec)[\\s_.,-]*(\\d{4}|\\d{2})\\b', ['m', 'y']) AS word,
  regexp_extract(t, '\\bq([1-4])\\b', 1) AS q, regexp_extract(t, '\\b(19\\d\\d|20\\d\\d|2100)\\b', 1) AS y FROM t),
p AS (SELECT *, try_cast(iso.y AS INT) AS iy, try_cast(word.y AS INT) + CASE WHEN length(word.y) = 2 THEN 2000 ELSE 0 END AS wy,
  CASE WHEN try_cast(y AS INT) BETWEEN 1990 AND 2100 THEN y END AS yy, list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], word.m[:3]) AS wm FROM x),
k AS (SELECT CASE WHEN iy BETWEEN 1990 AND 2100 THEN iso.y || '-' || iso.m WHEN wy BETWEEN 1990 AND 2100 THEN printf('%04d-%02d', wy, wm) WHEN q <> '' AND yy IS NOT NULL THEN yy || '-Q' || q ELSE yy END AS period FROM p)"""


@query(f"{_SQL_PERIODS} SELECT CASE WHEN period LIKE '%Q%' THEN 'quarter' WHEN length(period) = 4 THEN 'year' WHEN period IS NOT NULL THEN 'month' END AS period_type, period, count(*) AS n FROM k GROUP BY ALL")
def period_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods in texts of nine kinds: named and ISO months, quarters, years, years out of bounds, and words that only begin like months."""
    event, day = F.col("event_id"), F.col("ts")
    year = F.year(day).cast("string")
    texts = [
        F.concat_ws(" ", "event_type", F.date_format(day, "MMM yyyy")),
        F.concat(F.date_format(day, "yyyy-MM"), F.lit(" x")),
        F.concat(F.lit("Q1 "), year),
        F.concat(F.lit("decimal "), year),
        F.concat(F.lit("Marketing "), year, F.lit(" q"), (event % 4 + 1).cast("string")),
        F.concat(F.lit("Dismissed Mar "), (event % 80 + 20).cast("string")),
        F.concat(F.date_format(day, "yyyy-MM"), F.lit("-00 3000")),
        F.concat(F.lit("in 1850 or Sept_"), (event % 10 + 1985).cast("string")),
    ]
    text = R.first_case([(event % 9 == i, t) for i, t in enumerate(texts)], F.col("event_type"))
    rows = parquet(spark, sf_dir, "events").select(S.period_type(text).alias("period_type"), S.period_key(text).alias("period"))
    return rows.groupBy("period_type", "period").agg(F.count(F.lit(1)).alias("n"))
