"""Codes and buckets by parts of texts, reconciliation of two geographies, and the wide table of cases, bound to the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ladders
from ..functions import rules as R
from ..functions import scalars as S
from ..operators import corpus, geo, progress
from ..sources.tables import parquet, with_file_order
from .bound import query

# --- codes and buckets -------------------------------------------------------------------------------------------

_ERRORS = [
    "[Errno -2] Name or service not known", "nodename nor servname provided", "Client error '403 Forbidden'", "404 Not Found", "Server error 500", "Server disconnected", "Connection reset by peer",
    "Read timed out", "Timeout after 30 s", "SSL: CERTIFICATE_VERIFY_FAILED", "TLS handshake failed", "Captcha shown", "Request blocked", "Access Denied", "403 after timeout", "no idea", "", None,
]
_TYPES = ["Listed Building Consent", "Conservation Area", "Outline", "Non-Material Amendment", "Minor works", "Discharge of Condition", "Works to a Tree", "Advertisement", "Full application", "Listed outline", "", None]
_DECISIONS = ["Refuse", "Application REFUSED", "Permission refused", "Refusal", "Grant subject to conditions", "Conditional Approval", "Permitted", "Condition discharged", "Withdrawn", "withdraw by applicant", "Pending", "", None]
_PAPERS = [
    "Decision Notice", "Officer Report", "Delegated report", "Noise survey", "BS4142 survey", "Heat loss sheet", "MCS 020", "Consultee", "Public comment", "Site Location", "Elevations", "Application Form", "Letter",
    "Acoustic decision", "Report final plan", "", None,
]
_WORKS = ["Loft conversion", "Rear EXTENSION and pump", "Restore barn", "store room", "garden room", "renovations", "Heat pump only", "change of use", "two-storey side", "unannexed land", "", None]


def _pick(values: list, key: str) -> Column:
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), (F.col(key) % len(values)).cast("int"))


def _sql_pick(values: list, key: str) -> str:
    inside = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"lower([{inside}][{key} % {len(values)} + 1])"


@query(
    f"""WITH e AS (SELECT event_type, {_sql_pick(_ERRORS, 'event_id')} AS e FROM events)
SELECT event_type, CASE WHEN regexp_matches(e, 'name or service not known|nodename nor servname') THEN 'dns_error' WHEN regexp_matches(e, '403') THEN 'http_403' WHEN regexp_matches(e, '404') THEN 'http_404'
  WHEN regexp_matches(e, '500') THEN 'http_500' WHEN regexp_matches(e, 'server disconnected|connection reset') THEN 'connection_reset' WHEN regexp_matches(e, 'timeout|timed out') THEN 'timeout'
  WHEN regexp_matches(e, 'certificate|ssl|tls') THEN 'tls_error' WHEN regexp_matches(e, 'captcha|block|access denied') THEN 'blocked' ELSE 'unknown' END AS code, count(*) AS n FROM e GROUP BY ALL"""
)
def failure_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts by the code of their error."""
    code = R.contains_ladder(_pick(_ERRORS, "event_id"), ladders.FAILURE_CODES, "unknown")
    return parquet(spark, sf_dir, "events").groupBy("event_type", code.alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH t AS (SELECT o_orderkey, {_sql_pick(_TYPES, 'o_orderkey')} AS t, {_sql_pick(_DECISIONS, '(o_orderkey // 3)')} AS d FROM orders)
SELECT CASE WHEN regexp_matches(t, 'listed|heritage|conservation') THEN 'heritage' WHEN regexp_matches(t, 'outline') THEN 'outline' WHEN regexp_matches(t, 'amendment|non-material|minor') THEN 'amendment'
  WHEN regexp_matches(t, 'condition|discharge') THEN 'conditions' WHEN regexp_matches(t, 'tree') THEN 'trees' WHEN regexp_matches(t, 'advert') THEN 'advertising' ELSE 'full' END AS type_bucket,
  CASE WHEN regexp_matches(d, 'refus(e|al)') THEN 'refused' WHEN regexp_matches(d, 'permit|permission|approve|conditional|grant|discharge') THEN 'approved' WHEN regexp_matches(d, 'withdraw') THEN 'withdrawn' ELSE 'other' END AS decision,
  count(*) AS n FROM t GROUP BY ALL"""
)
def type_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases by the bucket of their type and their coarse decision."""
    rows = parquet(spark, sf_dir, "orders").select("o_orderkey", F.floor(F.col("o_orderkey") / 3).cast("long").alias("third"))
    kind = R.contains_ladder(_pick(_TYPES, "o_orderkey"), ladders.APPLICATION_TYPES, "full")
    decision = R.contains_ladder(_pick(_DECISIONS, "third"), ladders.COARSE_DECISIONS, "other")
    return rows.groupBy(kind.alias("type_bucket"), decision.alias("decision")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH t AS (SELECT p_partkey, concat_ws(' ', {_sql_pick(_PAPERS, 'p_partkey')}, lower(p_name)) AS x FROM part)
SELECT CASE WHEN contains(x, 'decision') THEN 'decision' WHEN regexp_matches(x, 'officer report|delegated report|report final') THEN 'officer_report' WHEN regexp_matches(x, 'noise|sound|acoustic|bs4142') THEN 'noise'
  WHEN regexp_matches(x, 'heat loss|manual sound calculator|technical specification|mcs 020') THEN 'spec_calc' WHEN regexp_matches(x, 'consultee|environmental health|comment|response') THEN 'consultee'
  WHEN regexp_matches(x, 'drawing|plan|elevation|site location') THEN 'drawing' WHEN contains(x, 'application form') THEN 'application_form' ELSE 'other' END AS family, count(*) AS n FROM t GROUP BY 1"""
)
def paper_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the family that their type and description name."""
    text = F.concat_ws(" ", _pick(_PAPERS, "p_partkey"), "p_name")
    family = R.contains_ladder(text, ladders.DOCUMENT_FAMILIES, "other")
    return parquet(spark, sf_dir, "part").groupBy(family.alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""SELECT p_brand, count(*) FILTER (coalesce(regexp_matches({_sql_pick(_WORKS, 'p_partkey')}, '\\b(extension|extn|loft|conversion|garage|outbuilding|annex|porch|store|garden room|demolition|new dwelling|new build|change of use|alteration|orangery|conservatory|summerhouse|first floor|two storey|two-storey|single storey|single-storey|side extension|rear extension|listed building|refurbishment|renovat)'), false)) AS bundled,
  count(*) AS n FROM part GROUP BY 1"""
)
def bundled_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions that name other works; a null one names none."""
    bundled = R.matches(_pick(_WORKS, "p_partkey"), rf"\b({'|'.join(ladders.BUNDLED_WORKS)})")
    return parquet(spark, sf_dir, "part").groupBy("p_brand").agg(F.count_if(bundled).alias("bundled"), F.count(F.lit(1)).alias("n"))


@query(
    """WITH d AS (SELECT page_id % 90 AS s_suppkey, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN '' END AS link FROM pages)
SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM d WHERE regexp_matches(link, '^https?://'))"""
)
def pending_without_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases without any document that has a valid address: documents with a blank one or none do not count."""
    page = F.col("page_id")
    link = F.when(page % 3 == 0, F.col("url")).when(page % 3 == 1, "")
    docs = parquet(spark, sf_dir, "pages").select((page % 90).alias("s_suppkey"), link.alias("link"))
    return progress.without_match(parquet(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), docs, "s_suppkey", F.col("link").rlike("^https?://"))


# --- two geographies ---------------------------------------------------------------------------------------------

YEARS = [1993, 1994, 1995, 1996, 1997]
_SQL_AREAS = f"""own AS (SELECT lower(n_name) AS authority, year(o_orderdate) AS year, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
ext AS (SELECT lower(n_name) AS area, year(l_shipdate) AS year, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey % 5 <> 4 GROUP BY ALL),
said AS (SELECT ' ' || n_name || ' ' AS authority, CASE n_nationkey % 6 WHEN 0 THEN 'matched' WHEN 1 THEN 'joint' WHEN 2 THEN 'new_unitary' WHEN 3 THEN 'no_area' WHEN 4 THEN 'unmatched' ELSE 'matched' END AS status,
  'NATION_' || (n_nationkey + CASE n_nationkey % 6 WHEN 2 THEN 3 ELSE 0 END) % 25 || ' LPA' AS area FROM nation
  UNION ALL SELECT n_name, 'joint', 'NATION_' || (n_nationkey + 1) % 25 FROM nation WHERE n_nationkey % 6 = 1),
bridge AS (SELECT DISTINCT lower(trim(authority)) AS authority, CASE WHEN a = 'nation_5' THEN 'nation_7' ELSE a END AS area FROM (SELECT *, lower(regexp_replace(area, ' LPA$', '')) AS a FROM said) WHERE status IN ('matched', 'joint', 'new_unitary')
  UNION SELECT * FROM (VALUES ('nation_3', 'nation_10'), ('nation_9', 'nation_9'))),
mapped AS (SELECT * FROM bridge UNION SELECT authority, authority FROM own WHERE authority NOT IN (SELECT authority FROM bridge) AND authority IN (SELECT area FROM ext)),
w AS (SELECT area, sum(n) AS weight FROM ext WHERE year BETWEEN {YEARS[0]} AND {YEARS[-1]} GROUP BY 1),
share AS (SELECT authority, area, count(*) OVER a > 1 AS joint, CASE WHEN sum(coalesce(weight, 0)) OVER a > 0 THEN coalesce(weight, 0)::DOUBLE / (sum(coalesce(weight, 0)) OVER a)::DOUBLE ELSE 1.0::DOUBLE / count(*) OVER a END AS part
  FROM mapped LEFT JOIN w USING (area) WHERE authority IN (SELECT authority FROM own) WINDOW a AS (PARTITION BY authority)),
cells AS (SELECT area, authority, joint, year, round_even(n * part, 0)::BIGINT AS n FROM share JOIN own USING (authority)),
l AS (SELECT area, {', '.join(f'coalesce(sum(n) FILTER (year = {y}), 0)::BIGINT AS own_{y}' for y in YEARS)}, string_agg(DISTINCT authority, '; ' ORDER BY authority) AS authorities, count(DISTINCT authority) AS n_authorities, bool_or(joint) AS joint, false AS lone FROM cells GROUP BY 1
  UNION ALL SELECT authority, {', '.join(f'coalesce(sum(n) FILTER (year = {y}), 0)::BIGINT' for y in YEARS)}, authority, 1, false, true FROM own WHERE authority NOT IN (SELECT authority FROM mapped) GROUP BY authority),
r AS (SELECT area, {', '.join(f'coalesce(sum(n) FILTER (year = {y}), 0)::BIGINT AS ext_{y}' for y in YEARS)} FROM ext WHERE area IN (SELECT area FROM w) GROUP BY 1),
f AS (SELECT area, coalesce(authorities, '') AS authorities, coalesce(n_authorities, 0) AS n_authorities, coalesce(joint, false) AS joint, coalesce(lone, false) AS lone, {', '.join(f'coalesce({p}_{y}, 0) AS {p}_{y}' for p in ('own', 'ext') for y in YEARS)} FROM l FULL JOIN r USING (area))
SELECT area, CASE WHEN lone THEN 'unmapped' WHEN {' + '.join(f'ext_{y}' for y in YEARS)} > 0 AND {' + '.join(f'own_{y}' for y in YEARS)} > 0 THEN 'matched' WHEN {' + '.join(f'ext_{y}' for y in YEARS)} > 0 THEN 'right_only' ELSE 'left_only' END AS match,
  authorities, n_authorities, joint, {', '.join(f'{p}_{y}' for p in ('own', 'ext') for y in YEARS)}, ({' + '.join(f'ext_{y}' for y in YEARS)})::BIGINT AS external,
  CASE WHEN ext_1994 + ext_1995 + ext_1996 > 0 THEN round((own_1994 + own_1995 + own_1996) * 100.0::DOUBLE / (ext_1994 + ext_1995 + ext_1996), 1) END AS pct FROM f"""


@query(f"WITH {_SQL_AREAS}")
def area_matrix_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of customers' nations beside lines of suppliers' nations: joint authorities, successors, direct pairs, areas without a partner."""
    nation = parquet(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    key = F.col("n_nationkey")
    status = _pick(["matched", "joint", "new_unitary", "no_area", "unmatched", "matched"], "n_nationkey")
    area = F.concat(F.lit("NATION_"), ((key + F.when(key % 6 == 2, 3).otherwise(0)) % 25).cast("string"), F.lit(" LPA"))
    said = nation.select(F.concat(F.lit(" "), "n_name", F.lit(" ")).alias("authority"), status.alias("status"), area.alias("area"))
    second = nation.filter(key % 6 == 1).select(F.col("n_name").alias("authority"), F.lit("joint").alias("status"), F.concat(F.lit("NATION_"), ((key + 1) % 25).cast("string")).alias("area"))
    bridge = geo.area_bridge(
        said.unionByName(second), "authority", "area", "status", ["matched", "joint", "new_unitary"], F.lower, " LPA", {"nation_5": "nation_7"}, {"nation_3": "nation_10", "nation_9": "nation_9"}
    )
    # counts by small keys first, names after
    own = parquet(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("year")).join(parquet(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey")), "o_custkey")
    ext = parquet(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.year("l_shipdate").alias("year")).join(parquet(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey")), "s_suppkey")
    count = lambda df: df.groupBy("n_nationkey", "year").agg(F.count(F.lit(1)).alias("n")).join(nation, "n_nationkey")
    return geo.area_matrix(
        count(own).select(F.lower("n_name").alias("authority"), "year", "n"), bridge, count(ext).filter(key % 5 != 4).select(F.lower("n_name").alias("area"), "year", "n"), YEARS, (1994, 1996)
    )


# --- the wide table of cases -------------------------------------------------------------------------------------

_TEXTS = ["Pump at flat 3", "Listed\tbuilding, pump", "Pump\nin conservation area", "Pump with noise survey", "Sound assessment of a pump", "Wind turbine", "Pump", None]
_LABELS = ["noise; heritage_listed", "flat_apartment", "heritage_conservation_area; noise", "amenity", None]
_BOOSTS = {"is_flat": "flat_apartment", "is_conservation_area": "heritage_conservation_area", "is_heritage_listed": "heritage_listed", "mentions_noise": "noise"}
_FLAGS = {
    "is_flat": r"\bflat\b", "is_conservation_area": "conservation area", "is_heritage_listed": "listed", "mentions_noise": "noise", "mentions_sound_assessment": "sound assessment", "is_wind_turbine": "wind turbine",
}


def _sql_raw(values: list, key: str) -> str:
    inside = ", ".join("NULL" if v is None else "'" + v.replace("\t", "' || chr(9) || '").replace("\n", "' || chr(10) || '") + "'" for v in values)
    return f"[{inside}][{key} % {len(values)} + 1]"


_SQL_FLAGS = ", ".join(f"coalesce(regexp_matches(lower(d), '{p}'), false) OR coalesce(list_contains(marks, '{_BOOSTS.get(n, '')}'), false) AS {n}" for n, p in _FLAGS.items())


@query(
    f"""WITH l AS (SELECT l_orderkey AS o_orderkey, arg_min({{'s': l_shipdate, 'p': l_partkey}}, {{'a': l_shipdate, 'b': l_linenumber}}) AS r, count(*) AS n_files FROM lineitem GROUP BY 1),
b AS (SELECT o.*, r, coalesce(n_files, 0) AS n_files, n_name, {_sql_raw(_TEXTS, 'o_orderkey')} AS d, CASE WHEN o_orderkey % 3 > 0 THEN {_sql_raw(_LABELS, 'o_orderkey')} END AS labels,
  {_sql_raw(_TYPES, 'o_orderkey')} AS t FROM orders o JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN l USING (o_orderkey) WHERE o_orderstatus IN ('F', 'P')),
m AS (SELECT *, string_split(labels, '; ') AS marks, 'files/' || p_brand || '/' || p_partkey || '/a.pdf' AS path, p_name FROM b LEFT JOIN part ON p_partkey = r.p)
SELECT o_orderkey AS application_uid, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'R/' || o_orderkey END AS reference, n_name AS authority_name, CASE o_orderstatus WHEN 'F' THEN 'refused' ELSE 'withdrawn' END AS outcome_bucket, o_orderstatus AS decision_raw,
  coalesce(strftime(r.s, '%Y-%m-%d'), '') AS decision_date, strftime(o_orderdate, '%Y-%m-%d') AS start_date, strftime(o_orderdate + INTERVAL 7 DAY, '%Y-%m-%d') AS consulted_date, datediff('day', o_orderdate::DATE, (r.s)::DATE) AS days_to_decision,
  coalesce(regexp_replace(d, '[\t\n]', ' ', 'g'), '') AS description, o_orderkey % 300 || ' High Street AB1 2CD' AS address_text, 'AB1 2CD' AS postcode, o_totalprice / 10000 AS lat, CASE WHEN o_orderkey % 4 > 0 THEN -o_totalprice / 100000 END AS lng,
  coalesce(t, '') AS application_type, CASE WHEN regexp_matches(lower(t), 'listed|heritage|conservation') THEN 'heritage' WHEN regexp_matches(lower(t), 'outline') THEN 'outline' WHEN regexp_matches(lower(t), 'amendment|non-material|minor') THEN 'amendment'
    WHEN regexp_matches(lower(t), 'condition|discharge') THEN 'conditions' WHEN regexp_matches(lower(t), 'tree') THEN 'trees' WHEN regexp_matches(lower(t), 'advert') THEN 'advertising' ELSE 'full' END AS app_type_bucket,
  CASE WHEN o_totalprice < 50000 THEN 'small' WHEN o_totalprice < 200000 THEN 'medium' ELSE 'large' END AS app_size, o_orderpriority AS source_scrape, {_SQL_FLAGS},
  'https://register.example/case?ref=' || o_orderkey AS case_url, CASE WHEN o_orderkey % 5 > 0 THEN 'https://portal.example/docs/' || o_orderkey ELSE '' END AS documentation_url, CASE WHEN o_orderkey % 5 > 0 THEN 'https://portal.example' ELSE '' END AS base_url,
  CASE WHEN o_orderkey % 5 > 0 THEN 'portal' ELSE 'no_url' END AS portal_type, n_files AS n_documents, CASE WHEN path IS NULL THEN '' ELSE array_to_string(string_split(path, '/')[:2], '/') END AS folder, coalesce(labels, '') AS refusal_labels, len(marks) AS n_labels,
  CASE WHEN labels IS NOT NULL THEN o_orderkey % 2 = 0 END AS used_section, coalesce(regexp_matches(lower(d), 'pump'), false) AS mentions_pump, CASE WHEN labels IS NOT NULL THEN n_files END AS n_text_docs, coalesce(p_name, '') AS text_excerpt FROM m"""
)
def refused_withdrawn_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide table of refused and withdrawn cases: what the case, its first file and the labels of its texts say, in 36 columns."""
    key = F.col("o_orderkey")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    orders = parquet(spark, sf_dir, "orders").filter(F.col("o_orderstatus").isin("F", "P"))
    lines = with_file_order(parquet(spark, sf_dir, "lineitem"), "place").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate", "l_linenumber", "l_partkey", "place")
    n_files = lines.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n_files"))
    people = parquet(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    parts = parquet(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_name")
    rows = corpus.enrich(orders, "o_orderkey", [(lines, ["l_shipdate", "l_partkey"], ["l_shipdate", "l_linenumber", "place"]), (n_files, ["n_files"], [])])
    rows = rows.join(people, "o_custkey").join(parquet(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey").join(parts, "l_partkey", "left")
    rows = rows.withColumns(
        {
            "description": _pick(_TEXTS, "o_orderkey"), "labels": F.when(key % 3 > 0, _pick(_LABELS, "o_orderkey")), "application_type": F.coalesce(_pick(_TYPES, "o_orderkey"), F.lit("")),
            "start_date": day("o_orderdate"), "decision_date": day("l_shipdate"), "n_files": F.coalesce("n_files", F.lit(0).cast("long")),
            "documentation_url": F.when(key % 5 > 0, F.concat(F.lit("https://portal.example/docs/"), key.cast("string"))),
        }
    )
    labels = F.split("labels", "; ")
    flags = R.boost_flags(R.flag_columns({n: [("description", p)] for n, p in _FLAGS.items()}), labels, _BOOSTS)
    outcome = R.first_match(F.col("o_orderstatus"), [("refused", "F"), ("withdrawn", "P")], "other", "other")
    facts = corpus.case_facts(rows, outcome, flags, "start_date", "decision_date", "description")
    path = F.concat(F.lit("files/"), "p_brand", F.lit("/"), F.col("l_partkey").cast("string"), F.lit("/a.pdf"))
    address = F.concat((key % 300).cast("string"), F.lit(" High Street AB1 2CD"))
    blank = lambda c: F.coalesce(c, F.lit(""))
    return facts.select(
        key.alias("application_uid"), F.when(key % 7 == 0, "").otherwise(F.concat(F.lit("R/"), key.cast("string"))).alias("reference"), F.col("n_name").alias("authority_name"),
        "outcome_bucket", F.col("o_orderstatus").alias("decision_raw"), blank(F.col("decision_date")).alias("decision_date"), "start_date", day(F.date_add("o_orderdate", 7)).alias("consulted_date"), "days_to_decision",
        "description", address.alias("address_text"), S.postcode(address).alias("postcode"), (F.col("o_totalprice") / 10000).alias("lat"), F.when(key % 4 > 0, -F.col("o_totalprice") / 100000).alias("lng"),
        "application_type", R.contains_ladder(F.col("application_type"), ladders.APPLICATION_TYPES, "full").alias("app_type_bucket"), S.size_class(F.col("o_totalprice"), 50000, 200000).alias("app_size"),
        F.col("o_orderpriority").alias("source_scrape"), *_FLAGS, S.url_template(F.lit("https://register.example/case"), key.cast("string")).alias("case_url"), blank(F.col("documentation_url")).alias("documentation_url"),
        blank(S.url_base(F.col("documentation_url"))).alias("base_url"), R.backend(F.col("documentation_url"), F.lit(None).cast("string"), [("portal", ["portal."])], "known", "other").alias("portal_type"),
        F.col("n_files").alias("n_documents"), blank(S.top_folders(path)).alias("folder"), blank(F.col("labels")).alias("refusal_labels"), F.when(F.col("labels").isNotNull(), F.size(labels)).alias("n_labels"),
        F.when(F.col("labels").isNotNull(), key % 2 == 0).alias("used_section"), R.matches(F.col("description"), "pump").alias("mentions_pump"),
        F.when(F.col("labels").isNotNull(), F.col("n_files")).alias("n_text_docs"), blank(F.col("p_name")).alias("text_excerpt"),
    )
