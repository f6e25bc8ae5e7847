"""Linkage, geography, quality, curation, incremental and streaming operators bound to the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import scalars as S
from ..operators import curate, geo, incremental, linkage, progress, quality, rates
from ..sources.tables import parquet, scratch_dir
from ..streaming import attempts
from .bound import _ORDERS_NATION, STATUS_NAMES, STATUS_RANKS, _orders_by_nation, query

# --- linkage: customers as applications, orders as cases -------------------------------------------------------


def _apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their nation's name as authority, two reference spellings and a signature."""
    c = parquet(spark, sf_dir, "customer").join(
        parquet(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey"
    )
    return c.select(
        F.col("c_custkey").alias("uid"),
        S.name_tokens(F.col("n_name")).alias("app_tokens"),
        S.reference_key(F.col("c_name")).alias("ref_a"),
        F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("X/"), S.reference_key(F.col("c_name")))).alias("ref_b"),
        F.col("c_nationkey").alias("block_a"),
        F.floor(F.col("c_acctbal") / 100).alias("block_b"),
        F.col("c_mktsegment").alias("sig"),
        F.col("c_name").alias("app_name"),
    )


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers whose reference is a customer's name."""
    s = parquet(spark, sf_dir, "supplier").join(
        parquet(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey"
    )
    key = F.col("s_suppkey") * 5
    return s.select(
        F.col("s_suppkey").alias("case_id"),
        S.name_tokens(F.concat(F.col("n_name"), F.lit(" Council"))).alias("case_tokens"),
        F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("CUSTOMER#"), F.lpad(key.cast("string"), 9, "0"))).otherwise(
            F.concat(F.lit("X/CUSTOMER#"), F.lpad(key.cast("string"), 9, "0"))
        ).alias("case_ref"),
        F.col("s_nationkey").alias("block_a"),
        F.floor(F.col("s_acctbal") / 100).alias("block_b"),
        F.when(F.col("s_suppkey") % 2 == 0, "BUILDING").otherwise("MACHINERY").alias("case_sig"),
        F.substring("s_name", -2, 2).alias("case_tail"),
    )


_APPS = """apps AS (SELECT c_custkey AS uid, list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(upper(n_name), '&', ' AND ', 'g'), '[^A-Z0-9]+', ' ', 'g')), ' '), lambda w: w NOT IN ('', 'THE', 'OF', 'AND', 'COUNCIL', 'AUTHORITY')))) AS tokens,
  upper(c_name) AS ref_a, CASE WHEN c_custkey % 3 = 0 THEN 'X/' || upper(c_name) END AS ref_b, c_nationkey AS block_a,
  floor(c_acctbal / 100)::BIGINT AS block_b, c_mktsegment AS sig, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
cases AS (SELECT s_suppkey AS case_id, list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(upper(n_name), '[^A-Z0-9]+', ' ', 'g')), ' '), lambda w: w NOT IN ('', 'THE', 'OF', 'AND', 'COUNCIL', 'AUTHORITY')))) AS tokens,
  CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'X/' END || 'CUSTOMER#' || lpad((s_suppkey * 5)::VARCHAR, 9, '0') AS case_ref, s_nationkey AS block_a,
  floor(s_acctbal / 100)::BIGINT AS block_b, CASE WHEN s_suppkey % 2 = 0 THEN 'BUILDING' ELSE 'MACHINERY' END AS case_sig, right(s_name, 2) AS case_tail
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
_REFS = "(SELECT uid, tokens, 'ref_source=a' AS match_detail, ref_a AS ref FROM apps UNION ALL SELECT uid, tokens, 'ref_source=b', ref_b FROM apps)"
_T1 = f"""t1 AS (SELECT DISTINCT uid, case_id, 't1' AS tier, match_detail FROM {_REFS} a JOIN cases c ON c.case_ref = a.ref)"""
_T2 = """t2 AS (SELECT DISTINCT uid, case_id, 't2' AS tier, CASE WHEN contains(c_name, case_tail) THEN 'tail' WHEN sig = case_sig THEN 'signature' END AS match_detail
  FROM apps a JOIN cases c ON a.block_a = c.block_a AND a.block_b = c.block_b WHERE contains(c_name, case_tail) OR sig = case_sig)"""
_T3 = """ua AS (SELECT block_a, block_b, min(uid) AS uid, min(sig) AS sig FROM apps GROUP BY 1, 2 HAVING count(*) = 1),
uc AS (SELECT block_a, block_b, min(case_id) AS case_id, min(case_sig) AS case_sig FROM cases GROUP BY 1, 2 HAVING count(*) = 1),
t3 AS (SELECT uid, case_id, 't3' AS tier, 'unique_block' AS match_detail FROM ua JOIN uc USING (block_a, block_b) WHERE sig = case_sig)"""


REFS = {"a": "ref_a", "b": "ref_b"}


def _t1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.link_by_reference(_apps(spark, sf_dir), _cases(spark, sf_dir), "uid", REFS, "case_id", "case_ref")


def _t2(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = [("tail", F.col("app_name").contains(F.col("case_tail"))), ("signature", F.col("sig") == F.col("case_sig"))]
    return linkage.link_by_block(_apps(spark, sf_dir), _cases(spark, sf_dir), "uid", "case_id", ["block_a", "block_b"], evidence)


def _t3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.link_unique_block(_apps(spark, sf_dir), _cases(spark, sf_dir), "uid", "case_id", ["block_a", "block_b"], "sig", "case_sig")


@query(f"WITH {_APPS}, {_T1} SELECT * FROM t1")
def link_t1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t1(spark, sf_dir)


@query(
    f"""WITH {_APPS} SELECT DISTINCT uid, case_id, 't1' AS tier, match_detail FROM {_REFS} a JOIN cases c ON c.case_ref = a.ref
WHERE list_has_all(a.tokens, c.tokens) OR list_has_all(c.tokens, a.tokens)"""
)
def link_t1_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.link_by_reference(
        _apps(spark, sf_dir), _cases(spark, sf_dir), "uid", REFS, "case_id", "case_ref", "app_tokens", "case_tokens"
    )


@query(f"WITH {_APPS}, {_T2} SELECT * FROM t2")
def link_t2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t2(spark, sf_dir)


@query(f"WITH {_APPS}, {_T3} SELECT * FROM t3")
def link_t3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t3(spark, sf_dir)


_RESOLVED = f"""{_APPS}, {_T1}, {_T2}, {_T3}, h AS (SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3),
r AS (SELECT uid, case_id, tier, match_detail, row_number() OVER (PARTITION BY case_id ORDER BY tier, uid, match_detail) AS rn FROM h)"""


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.resolve_links([_t1(spark, sf_dir), _t2(spark, sf_dir), _t3(spark, sf_dir)], "uid", "case_id")


@query(
    f"""WITH {_RESOLVED} SELECT uid, case_id, tier, match_detail, CASE tier WHEN 't3' THEN 'medium' ELSE 'high' END AS confidence FROM r WHERE rn = 1"""
)
def link_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir)


@query(f"WITH {_RESOLVED} SELECT tier, count(DISTINCT uid) AS n_apps, count(*) AS n_links FROM h GROUP BY 1")
def link_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _t1(spark, sf_dir).unionByName(_t2(spark, sf_dir)).unionByName(_t3(spark, sf_dir))
    return linkage.linkage_summary(hits, "uid")


@query(
    f"""WITH {_RESOLVED}, b AS (SELECT * FROM r WHERE rn = 1) SELECT s_suppkey AS case_id, uid IS NOT NULL AS matched, tier,
  '{{"case_id":' || s_suppkey || CASE WHEN uid IS NULL THEN '' ELSE ',"uid":' || uid || ',"tier":"' || tier || '"' END || '}}' AS payload
FROM supplier LEFT JOIN b ON s_suppkey = b.case_id"""
)
def link_attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = parquet(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("case_id"))
    out = linkage.attach_best(cases, _resolved(spark, sf_dir), "case_id", ["case_id", "uid", "tier"])
    return out.select("case_id", F.col("uid").isNotNull().alias("matched"), "tier", "payload")


_T2_REFERENCE = """WITH a AS (SELECT c_custkey AS uid, c_nationkey AS block, upper(c_name) AS r1, 'X/' || right(c_name, 5) AS r2, upper(c_mktsegment) || ' AT CASE ' || right(c_name, 6) AS d FROM customer),
c AS (SELECT s_suppkey AS case_id, s_nationkey AS block, CASE s_suppkey % 4 WHEN 0 THEN 'REG/CUSTOMER#' || lpad((s_suppkey * 3)::VARCHAR, 9, '0') || '/A' WHEN 1 THEN lpad((s_suppkey * 5)::VARCHAR, 5, '0') || '/B'
  WHEN 2 THEN lpad((s_suppkey * 7)::VARCHAR, 6, '0') ELSE 'Q' || s_suppkey END AS ref FROM supplier),
p AS (SELECT *, regexp_replace(r2, '^[^/]*/', '') AS t2 FROM a JOIN c USING (block))
SELECT * FROM (SELECT uid, case_id, 't2' AS tier, CASE WHEN contains(ref, r1) OR contains(r1, ref) THEN 'uid' WHEN contains(ref, r2) OR contains(r2, ref) THEN 'name'
  WHEN length(t2) >= 4 AND (contains(ref, t2) OR contains(t2, ref)) THEN 'name_tail' WHEN length(ref) >= 6 AND contains(d, ref) THEN 'description' END AS match_detail FROM p) WHERE match_detail IS NOT NULL"""


@query(_T2_REFERENCE)
def link_t2_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers of a nation, by whether one's reference is part of the other's."""
    apps = parquet(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("uid"),
        F.col("c_nationkey").alias("block"),
        F.upper("c_name").alias("r1"),
        F.concat(F.lit("X/"), F.substring("c_name", -5, 5)).alias("r2"),
        F.concat(F.upper("c_mktsegment"), F.lit(" AT CASE "), F.substring("c_name", -6, 6)).alias("d"),
    )
    key = F.col("s_suppkey")

    def digits(times: int, width: int):
        return F.lpad((key * times).cast("string"), width, "0")

    ref = (
        F.when(key % 4 == 0, F.concat(F.lit("REG/CUSTOMER#"), digits(3, 9), F.lit("/A")))
        .when(key % 4 == 1, F.concat(digits(5, 5), F.lit("/B")))
        .when(key % 4 == 2, digits(7, 6))
        .otherwise(F.concat(F.lit("Q"), key.cast("string")))
    )
    cases = parquet(spark, sf_dir, "supplier").select(key.alias("case_id"), F.col("s_nationkey").alias("block"), ref.alias("ref"))
    return linkage.link_by_parts(apps, cases, "uid", "case_id", ["block"], {"uid": "r1", "name": "r2"}, "ref", "d")


ALIASES = {"old england": "NATION_3", "holland": "NATION_7"}


@query(
    """WITH v AS (SELECT c_custkey, lower(CASE c_custkey % 4 WHEN 0 THEN n_name WHEN 1 THEN n_name || ' Council'
    WHEN 2 THEN 'Old England' ELSE 'nowhere ' || c_custkey END) AS spelled FROM customer JOIN nation ON c_nationkey = n_nationkey),
k AS (SELECT lower(n_name) AS key, n_name FROM nation UNION SELECT trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')), n_name FROM nation),
s AS (SELECT c_custkey, 0 AS step, spelled AS key FROM v UNION ALL
  SELECT c_custkey, 1, lower(alias) FROM v JOIN (VALUES ('old england', 'NATION_3'), ('holland', 'NATION_7')) a(name, alias) ON spelled = name UNION ALL
  SELECT c_custkey, 2, trim(regexp_replace(trim(regexp_replace(spelled, '[^a-z0-9]+', ' ', 'g')), ' council$', '')) FROM v),
m AS (SELECT c_custkey, step, n_name, row_number() OVER (PARTITION BY c_custkey ORDER BY step) AS rn FROM s JOIN k USING (key))
SELECT v.c_custkey, n_name AS resolved, step AS match_step FROM v LEFT JOIN m ON v.c_custkey = m.c_custkey AND rn = 1"""
)
def authority_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = parquet(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    c = parquet(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")).join(nation, "n_nationkey")
    spelled = R.first_case(
        [
            (F.col("c_custkey") % 4 == 0, F.col("n_name")),
            (F.col("c_custkey") % 4 == 1, F.concat("n_name", F.lit(" Council"))),
            (F.col("c_custkey") % 4 == 2, F.lit("Old England")),
        ],
        F.concat(F.lit("nowhere "), F.col("c_custkey").cast("string")),
    )
    rows = c.select("c_custkey", spelled.alias("spelled"))
    alias = F.element_at(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv]), F.lower("spelled"))
    steps = [F.lower("spelled"), F.lower(alias), S.area_name_key(F.col("spelled"))]
    keys = F.array_distinct(F.array(F.lower("n_name"), S.area_name_key(F.col("n_name"))))
    known = nation.select(F.explode(keys).alias("key"), F.col("n_name").alias("resolved"))
    return linkage.name_cascade(rows, steps, known, "key", ["resolved"], "spelled").select("c_custkey", "resolved", "match_step")


# --- geography -------------------------------------------------------------------------------------------------


def _own_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders_by_nation(spark, sf_dir).select(F.col("n_name").alias("authority"), F.year("o_orderdate").alias("year"))
    return rows.groupBy("authority", "year").agg(F.count(F.lit(1)).alias("n"))


def _external_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = parquet(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.year("l_shipdate").alias("year"))
    per = lines.groupBy("s_suppkey", "year").agg(F.count(F.lit(1)).alias("n"))
    supplier = parquet(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"))
    nation = parquet(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("area"))
    return per.join(supplier, "s_suppkey").join(nation, "n_nationkey").groupBy("area", "year").agg(F.sum("n").alias("n"))


def _bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = parquet(spark, sf_dir, "nation").select(F.col("n_name").alias("authority"), F.col("n_name").alias("area"), F.lit("matched").alias("status"))
    return geo.bridge_rows(nation, "authority", "area", "status", ["matched", "joint"])


_OWN = f"own AS (SELECT n_name AS area, year(o_orderdate)::INT AS year, count(*) AS n FROM {_ORDERS_NATION} GROUP BY 1, 2)"
_EXT = """ext AS (SELECT n_name AS area, year(l_shipdate)::INT AS year, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2)"""
_COVER = f"""{_OWN}, {_EXT}, c AS (SELECT area, own::BIGINT AS own, external::BIGINT AS external, round(own / external::DOUBLE, 6) AS coverage
  FROM (SELECT area, sum(n) AS own FROM own WHERE year BETWEEN 1993 AND 1997 GROUP BY 1)
  JOIN (SELECT area, sum(n) AS external FROM ext WHERE year BETWEEN 1993 AND 1997 GROUP BY 1) USING (area))"""


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.coverage(_own_years(spark, sf_dir), _bridge(spark, sf_dir), _external_years(spark, sf_dir), (1993, 1997))


@query(f"WITH {_COVER} SELECT * FROM c")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coverage(spark, sf_dir)


@query(
    f"""WITH {_COVER} SELECT r_name, sum(own)::BIGINT AS own, sum(external)::BIGINT AS external, count(*) AS members,
  round(sum(own) / sum(external)::DOUBLE, 6) AS coverage FROM c JOIN nation ON area = n_name JOIN region ON n_regionkey = r_regionkey GROUP BY 1"""
)
def coverage_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = parquet(spark, sf_dir, "nation").select(F.col("n_name").alias("area"), F.col("n_regionkey").alias("r_regionkey"))
    region = parquet(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return geo.roll_up(_coverage(spark, sf_dir).join(nation, "area").join(region, "r_regionkey"), "r_name")


@query(
    f"""WITH {_OWN}, {_EXT} SELECT year, own::BIGINT AS own, external::BIGINT AS external, round(own / external::DOUBLE, 6) AS ratio
FROM (SELECT year, sum(n) AS own FROM own GROUP BY 1) JOIN (SELECT year, sum(n) AS external FROM ext GROUP BY 1) USING (year) WHERE year <> 1998"""
)
def coverage_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.coverage_series(_own_years(spark, sf_dir), _external_years(spark, sf_dir), "year", [1998])


@query(f"WITH {_COVER} SELECT area, external - own AS gap FROM c ORDER BY gap DESC, area LIMIT 10")
def coverage_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = _coverage(spark, sf_dir).select("area", (F.col("external") - F.col("own")).alias("gap"))
    return gaps.orderBy(F.desc("gap"), "area").limit(10)


@query(f"WITH {_COVER} SELECT arg_max(area, (coverage, area)) AS highest, arg_min(area, (coverage, area)) AS lowest, round(max(coverage) - min(coverage), 6) AS spread FROM c")
def coverage_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.extremes(_coverage(spark, sf_dir), "area", "coverage")


YEARS = [1993, 1994, 1995, 1996]


@query(
    f"""WITH {_OWN}, {_EXT}, o AS (SELECT area, {', '.join(f'sum(n) FILTER (year = {y})::BIGINT AS o{y}' for y in YEARS)} FROM own GROUP BY 1),
e AS (SELECT area, sum(n) FILTER (year BETWEEN 1993 AND 1996)::BIGINT AS external FROM ext GROUP BY 1)
SELECT coalesce(o.area, e.area) AS area, {', '.join(f'coalesce(o{y}, 0) AS y{y}' for y in YEARS)},
  ({' + '.join(f'coalesce(o{y}, 0)' for y in YEARS)})::BIGINT AS total, coalesce(external, 0) AS external,
  CASE WHEN o.area IS NOT NULL AND e.area IS NOT NULL THEN 'matched' WHEN o.area IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS match
FROM o FULL JOIN e ON o.area = e.area"""
)
def area_year_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = geo.year_matrix(_own_years(spark, sf_dir).withColumnRenamed("authority", "area"), ["area"], "year", "n", YEARS)
    ext = _external_years(spark, sf_dir).groupBy("area").agg(F.sum(F.when(F.col("year").between(1993, 1996), F.col("n"))).alias("external"))
    return geo.reconcile(own, ext, ["area"], [*[f"y{y}" for y in YEARS], "total"], ["external"])


@query(
    """WITH p AS (SELECT n_regionkey, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
w AS (SELECT n_nationkey, n_name, n_regionkey, count(s_suppkey) AS weight FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL),
s AS (SELECT *, sum(weight) OVER (PARTITION BY n_regionkey) AS t, count(*) OVER (PARTITION BY n_regionkey) AS k FROM w)
SELECT n_name, round_even(n * (CASE WHEN t > 0 THEN weight / t::DOUBLE ELSE 1.0::DOUBLE / k END), 0)::BIGINT AS allocated FROM s JOIN p USING (n_regionkey)"""
)
def share_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = parquet(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    per = parquet(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    parents = per.join(nation, "n_nationkey").groupBy("n_regionkey").agg(F.sum("n").alias("n"))
    weight = parquet(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("w"))
    children = nation.join(weight, "n_nationkey", "left").withColumn("weight", F.coalesce("w", F.lit(0)))
    return geo.allocate_by_share(parents, children, "n_regionkey", "n", "weight").select("n_name", "allocated")


@query(
    """WITH p AS (SELECT n_regionkey, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
SELECT n_name, floor(n / (count(*) OVER (PARTITION BY n_regionkey))::DOUBLE + 0.5)::BIGINT AS allocated FROM nation JOIN p USING (n_regionkey)"""
)
def equal_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = parquet(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    per = parquet(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    parents = per.join(nation, "n_nationkey").groupBy("n_regionkey").agg(F.sum("n").alias("n"))
    return geo.allocate_equally(nation.join(parents, "n_regionkey"), "n_regionkey", "n").select("n_name", "allocated")


# --- quality ---------------------------------------------------------------------------------------------------

@query(
    """WITH t AS (SELECT p_brand AS old, CASE WHEN regexp_matches(lower(p_type), 'promo') THEN 'Brand#11' WHEN p_size > 25 THEN 'Brand#22' ELSE p_brand END AS new FROM part)
SELECT old, new, count(*) AS n, old IS DISTINCT FROM new AS changed, (old IS DISTINCT FROM new) AND new = 'Brand#22' AS skipped FROM t GROUP BY ALL"""
)
def transition_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = parquet(spark, sf_dir, "part")
    new = R.first_case([(R.matches(F.col("p_type"), "promo"), "Brand#11"), (F.col("p_size") > 25, "Brand#22")], F.col("p_brand"))
    return progress.transition_matrix(part, F.col("p_brand"), new, ["Brand#22"])


_RULED = """CASE WHEN regexp_matches(text, '#{3}|%{3}') THEN 'junk' WHEN regexp_matches(text, ' \\| ') THEN 'table' ELSE 'fine' END"""


@query(
    f"""WITH a AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'fine' ELSE 'junk' END AS label_a FROM labels), b AS (SELECT doc_id, {_RULED} AS label_b FROM documents),
j AS (SELECT doc_id, label_a, label_b, replace(label_b, 'table', 'junk') AS cb FROM a JOIN b USING (doc_id))
SELECT doc_id, label_a, label_b, label_a = label_b AS agree_full, label_a = cb AS agree_collapsed,
  CASE WHEN label_a = label_b THEN label_a WHEN label_a = cb THEN label_a END AS final_label, label_a <> cb AS needs_review FROM j"""
)
def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = parquet(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "fine").otherwise("junk").alias("a"))
    b = parquet(spark, sf_dir, "documents").select("doc_id", R.first_match(F.col("text"), [("junk", "#{3}|%{3}"), ("table", " \\| ")], "fine", "fine").alias("b"))
    return linkage.agreement(a, b, "doc_id", "a", "b", {"table": "junk"})


@query(
    """WITH s AS (SELECT o_orderkey, o_totalprice, o_orderstatus, o_orderdate, sum(l_extendedprice) AS total, min(l_shipdate) AS first_ship,
  count(*) FILTER (l_linestatus = 'O') AS n_open FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)
SELECT o_orderkey, 'hard' AS severity, 'shipped_before_order' AS "check", strftime(first_ship, '%Y-%m-%d') AS detail FROM s WHERE first_ship < o_orderdate
UNION ALL SELECT o_orderkey, 'soft', 'open_line_on_filled_order', n_open::VARCHAR FROM s WHERE o_orderstatus = 'F' AND n_open > 0
UNION ALL SELECT o_orderkey, 'soft', 'total_differs', NULL FROM s WHERE abs(o_totalprice - total) > 0.2 * o_totalprice"""
)
def consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = parquet(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum("l_extendedprice").alias("total"), F.min("l_shipdate").alias("first_ship"), F.count_if(F.col("l_linestatus") == "O").alias("n_open")
    )
    rows = parquet(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate").join(lines, "o_orderkey")
    checks = [
        ("hard", "shipped_before_order", F.col("first_ship") < F.col("o_orderdate"), F.date_format("first_ship", "yyyy-MM-dd")),
        ("soft", "open_line_on_filled_order", (F.col("o_orderstatus") == "F") & (F.col("n_open") > 0), F.col("n_open")),
        ("soft", "total_differs", F.abs(F.col("o_totalprice") - F.col("total")) > 0.2 * F.col("o_totalprice"), F.lit(None)),
    ]
    return quality.consistency_checks(rows, ["o_orderkey"], checks)


# --- curation --------------------------------------------------------------------------------------------------

LINE_FIELDS = ["l_quantity", "l_discount", "l_returnflag", "l_linestatus"]


@query(
    """WITH u AS (SELECT 'l_quantity' AS field, l_quantity::VARCHAR AS v FROM lineitem UNION ALL SELECT 'l_discount', l_discount::VARCHAR FROM lineitem
  UNION ALL SELECT 'l_returnflag', l_returnflag FROM lineitem UNION ALL SELECT 'l_linestatus', l_linestatus FROM lineitem UNION ALL
  SELECT 'code', CASE WHEN l_partkey % 3 = 0 THEN l_returnflag WHEN l_partkey % 7 > 0 THEN (l_partkey % 7)::VARCHAR END FROM lineitem),
c AS (SELECT field, count(v) AS n, count(try_cast(v AS DOUBLE)) AS k FROM u GROUP BY 1)
SELECT field, n, round(k / n, 4) AS ratio, n >= 5 AND k / n >= 0.6 AS is_numeric FROM c"""
)
def numeric_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = F.when(F.col("l_partkey") % 3 == 0, F.col("l_returnflag")).when(F.col("l_partkey") % 7 > 0, (F.col("l_partkey") % 7).cast("string"))
    lines = parquet(spark, sf_dir, "lineitem").select(*LINE_FIELDS, mixed.alias("code"))
    return curate.numeric_profile(lines, [*LINE_FIELDS, "code"]).withColumn("ratio", F.round("ratio", 4))


@query(
    """WITH u AS (SELECT 'l_returnflag' AS field, l_returnflag AS value FROM lineitem UNION ALL SELECT 'l_linestatus', l_linestatus FROM lineitem),
c AS (SELECT field, value, count(*) AS n, row_number() OVER (PARTITION BY field ORDER BY (lower(value) NOT IN ('n', 'o')) DESC, count(*) DESC, value) AS rn FROM u GROUP BY 1, 2)
SELECT field, value AS top_value, n FROM c WHERE rn = 1"""
)
def field_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["l_returnflag", "l_linestatus"]
    return curate.field_profile(parquet(spark, sf_dir, "lineitem").select(*fields), fields, ("n", "o"))


@query(
    """SELECT l_returnflag, metric_name, round(sum(metric_value), 2) AS total, count(*) AS n, CASE metric_name WHEN 'l_quantity' THEN 'items' ELSE 'count' END AS unit FROM (
  SELECT l_returnflag, 'l_quantity' AS metric_name, l_quantity AS metric_value FROM lineitem UNION ALL SELECT l_returnflag, 'l_tax', l_tax FROM lineitem) GROUP BY ALL"""
)
def unpivot_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = parquet(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_tax")
    facts = curate.to_long_facts(lines, ["l_returnflag"], ["l_quantity", "l_tax"], {"l_quantity": "items"})
    return facts.groupBy("l_returnflag", "metric_name", "unit").agg(F.round(F.sum("metric_value"), 2).alias("total"), F.count(F.lit(1)).alias("n"))


@query(
    """WITH b AS (SELECT 'sheet' || p_brand AS sheet, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) + 3 AS r,
  [p_partkey::VARCHAR, p_size::VARCHAR, p_retailprice::VARCHAR, '1'] AS cells FROM part),
t AS (SELECT * FROM b UNION ALL SELECT DISTINCT sheet, 1, ['Parts of the brand'] FROM b UNION ALL SELECT DISTINCT sheet, 2, []::VARCHAR[] FROM b
  UNION ALL SELECT DISTINCT sheet, 3, ['part key', 'size', 'retail price', 'units'] FROM b),
s AS (SELECT sheet, r, len(cells) AS w, CASE WHEN len(cells) = 0 THEN -1000.0::DOUBLE ELSE len(cells) * 1.6::DOUBLE + len(list_distinct(cells)) / len(cells) * 3.0::DOUBLE
  + len(list_filter(cells, lambda c: regexp_matches(c, '[A-Za-z]'))) / len(cells) * 2.5::DOUBLE - (r - 1) * 0.08::DOUBLE END AS score FROM t WHERE r <= 40),
k AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY score DESC, r) AS rn, lead(score) OVER (PARTITION BY sheet ORDER BY score DESC, r) AS nxt FROM s)
SELECT sheet, r AS header_row, w::INT AS width, round(score, 6) AS score,
  round(CASE WHEN nxt IS NULL THEN 1.0 ELSE greatest(0.0, least(1.0, (score - nxt) / (abs(score) + 1e-6))) END, 6) AS confidence FROM k WHERE rn = 1"""
)
def header_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by brand as sheets: a title row, a blank row, the header row, then the parts."""
    part = parquet(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size", "p_retailprice")
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    text = [F.col(c).cast("string") for c in ("p_partkey", "p_size", "p_retailprice")]
    body = part.select(F.concat(F.lit("sheet"), "p_brand").alias("sheet"), (place + 3).cast("long").alias("row"), F.array(*text, F.lit("1")).alias("cells"))
    tops = body.select("sheet").distinct().select("sheet", F.explode(F.array(
        F.struct(F.lit(1).cast("long").alias("row"), F.array(F.lit("Parts of the brand"), F.lit(None), F.lit(None), F.lit(None)).alias("cells")),
        F.struct(F.lit(2).cast("long").alias("row"), F.array(F.lit(""), F.lit(None), F.lit(None), F.lit(None)).alias("cells")),
        F.struct(F.lit(3).cast("long").alias("row"), F.array(*map(F.lit, ("part key", "size", "retail price", "units"))).alias("cells")),
    )).alias("x")).select("sheet", "x.row", "x.cells")
    return curate.header_rows(body.unionByName(tops), ["sheet"], "row", "cells")


@query(
    """WITH e AS (SELECT event_id, event_type, value, strftime(ts, '%Y-%m') AS period, user_id FROM events),
m AS (SELECT *, CASE WHEN event_type = 'error' THEN 'error_metric' WHEN value IS NULL OR value < 1 THEN 'no_value' END AS r FROM e),
d AS (SELECT *, row_number() OVER (PARTITION BY r IS NULL, user_id, event_type, period ORDER BY event_id) AS rn FROM m)
SELECT coalesce(r, CASE WHEN rn > 1 THEN 'duplicate' END, 'clean') AS outcome, period, count(*) AS n FROM d GROUP BY ALL"""
)
def metric_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = parquet(spark, sf_dir, "events").select("event_id", "event_type", "value", "user_id", "ts")
    named = events.withColumn("name", F.concat_ws(" ", "event_type", F.date_format("ts", "MMM yyyy"))).withColumn("period", S.period_key(F.col("name")))
    reasons = [("no_value", F.col("value").isNull() | (F.col("value") < 1)), ("error_metric", F.col("event_type") == "error")]
    clean, dropped = curate.clean_metrics(named, reasons, ["user_id", "event_type", "period"], ["event_id"])
    both = clean.withColumn("outcome", F.lit("clean")).unionByName(dropped.withColumnRenamed("drop_reason", "outcome"))
    return both.groupBy("outcome", "period").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH d AS (SELECT DISTINCT user_id, event_type, datediff('day', DATE '2024-01-01', ts::DATE) AS k FROM events WHERE ts::DATE BETWEEN DATE '2024-01-01' AND DATE '2024-01-31'),
g AS (SELECT user_id, event_type, list(k) AS ks, count(*) AS n_days FROM d GROUP BY 1, 2)
SELECT user_id, event_type, n_days, (DATE '2024-01-01' + list_filter(range(0, 31), lambda x: NOT list_contains(ks, x))[1]::INT) AS first_missing FROM g"""
)
def first_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = parquet(spark, sf_dir, "events").select("user_id", "event_type", F.to_date("ts").alias("day"))
    return progress.first_missing(events, ["user_id", "event_type"], "day", "2024-01-01", "2024-01-31")


@query(
    """WITH e AS (SELECT floor(min(c_acctbal) / 1000) * 1000 AS lo, ceil(max(c_acctbal) / 1000) * 1000 AS hi FROM customer),
b AS (SELECT unnest(range(0, greatest(round((hi - lo) / 1000), 1)::BIGINT)) AS bin, lo, greatest(round((hi - lo) / 1000), 1)::BIGINT AS k FROM e),
c AS (SELECT least(floor((c_acctbal - lo) / 1000)::BIGINT, greatest(round((hi - lo) / 1000), 1)::BIGINT - 1) AS bin, count(*) AS n FROM customer, e GROUP BY 1)
SELECT b.bin, lo + b.bin * 1000 AS low, lo + (b.bin + 1) * 1000 AS high, coalesce(n, 0) AS n FROM b LEFT JOIN c ON b.bin = c.bin"""
)
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.histogram(parquet(spark, sf_dir, "customer").select("c_acctbal"), "c_acctbal", 1000.0)


@query(
    """WITH s AS (SELECT list_sort(list(c_acctbal)) AS v, count(*) AS n FROM customer WHERE c_acctbal IS NOT NULL),
p AS (SELECT v, n, 0.25 * (n + 1) AS a, 0.5 * (n + 1) AS b, 0.75 * (n + 1) AS c FROM s)
SELECT n, round(v[floor(a)::BIGINT] + (v[least(floor(a) + 1, n)::BIGINT] - v[floor(a)::BIGINT]) * (a - floor(a))::DOUBLE, 6) AS q1,
  round(v[floor(b)::BIGINT] + (v[least(floor(b) + 1, n)::BIGINT] - v[floor(b)::BIGINT]) * (b - floor(b))::DOUBLE, 6) AS median,
  round(v[floor(c)::BIGINT] + (v[least(floor(c) + 1, n)::BIGINT] - v[floor(c)::BIGINT]) * (c - floor(c))::DOUBLE, 6) AS q3,
  round(v[n], 6) AS maximum FROM p"""
)
def spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.spread(parquet(spark, sf_dir, "customer").select("c_acctbal"), "c_acctbal")


@query(
    f"""SELECT n_name, count(*) AS total, round(count(*) FILTER (o_orderstatus IN ('F', 'P')) * 100.0::DOUBLE / count(*), 4) AS share_decided,
  round(count(*) FILTER (o_orderstatus = 'O') * 100.0::DOUBLE / count(*), 4) AS share_open FROM {_ORDERS_NATION} GROUP BY 1"""
)
def outcome_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.outcome_mix(_orders_by_nation(spark, sf_dir), ["n_name"], "o_orderstatus", {"decided": ["F", "P"], "open": ["O"]})


# --- incremental and streams -----------------------------------------------------------------------------------

EVENT_COLUMNS = ["user_id", "event_id", "ts", "event_type", "value"]


@query(
    """WITH e AS (SELECT *, (event_id % 10 >= 7)::INT AS side FROM events), r AS (SELECT user_id, event_id, event_type, side,
  min(side) OVER (PARTITION BY user_id) AS had, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC, side DESC) AS rn FROM e WHERE user_id IS NOT NULL)
SELECT user_id, event_id, event_type, CASE WHEN had = 1 THEN 'new' WHEN side = 1 THEN 'updated' ELSE 'kept' END AS change FROM r WHERE rn = 1"""
)
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = parquet(spark, sf_dir, "events").select(*EVENT_COLUMNS)
    base, delta = events.filter(F.col("event_id") % 10 < 7), events.filter(F.col("event_id") % 10 >= 7)
    return incremental.upsert(base, delta, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type", "change")


@query(
    """WITH b AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS segment FROM customer), u AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'REVIEWED' END AS new_segment FROM customer)
SELECT c_custkey, CASE WHEN new_segment IS NOT NULL AND segment IS NULL THEN new_segment ELSE segment END AS segment,
  new_segment IS NOT NULL AND segment IS NULL AS updated FROM b JOIN u USING (c_custkey)"""
)
def guarded_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = parquet(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    base = c.select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("segment"))
    updates = c.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.lit("REVIEWED")).alias("new_segment"))
    return incremental.guarded_update(base, updates, "c_custkey", "segment", "new_segment", F.col("segment").isNull())


@query("SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN 'done' ELSE 'failed' END AS state, count(*) AS n FROM events GROUP BY 1")
def run_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.run_state(parquet(spark, sf_dir, "events"), "user_id", F.col("event_type") == "purchase")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of four files, one of which arrives at a time."""
    events, path = parquet(spark, sf_dir, "events"), scratch_dir(spark)
    events.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(path)
    return attempts.read_log(spark, path, events.schema, 1)


@query(
    """SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"""
)
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    home = scratch_dir(spark)
    stream = _event_stream(spark, sf_dir).select(*EVENT_COLUMNS)
    return attempts.stream_upsert(stream, f"{home}/target", f"{home}/state", "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT user_id, CASE max(CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 WHEN 'view' THEN 1 END) WHEN 3 THEN 'purchase' WHEN 2 THEN 'click' WHEN 1 THEN 'view' ELSE 'failed' END AS best_status, count(*) AS attempts FROM events GROUP BY 1")
def stream_best_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    home = scratch_dir(spark)
    return attempts.stream_best_status(_event_stream(spark, sf_dir), f"{home}/state", f"{home}/target", ["user_id"], "event_type", STATUS_RANKS, STATUS_NAMES, "failed")


@query("SELECT user_id, event_type FROM events GROUP BY 1, 2")
def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    home = scratch_dir(spark)
    stream = _event_stream(spark, sf_dir).select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return attempts.stream_first_seen(stream, f"{home}/state", f"{home}/target", ["user_id", "event_type"], "ts", "40 days").select("user_id", "event_type")
