"""The operators bound to the star-schema, event and document tables, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import scalars as S
from ..operators import corpus, order, progress, rates
from ..sources.tables import parquet, scan

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- rules and rates -------------------------------------------------------------------------------------------

PART_RULES = [
    ("promo", "promo"),
    ("metal", "brass|steel|copper|tin|nickel"),
    ("standard", "standard"),
    ("economy", "economy"),
]
_PART_CASE = """CASE WHEN p_type IS NULL OR regexp_replace(p_type, '\\s+', '', 'g') = '' THEN 'Missing'
  WHEN regexp_matches(lower(p_type), 'promo') THEN 'promo'
  WHEN regexp_matches(lower(p_type), 'brass|steel|copper|tin|nickel') THEN 'metal'
  WHEN regexp_matches(lower(p_type), 'standard') THEN 'standard'
  WHEN regexp_matches(lower(p_type), 'economy') THEN 'economy' ELSE 'other' END"""


@query(
    f"""SELECT p_type AS raw, {_PART_CASE} AS label,
  CASE WHEN regexp_matches(lower(p_type), 'promo') THEN 0
  WHEN regexp_matches(lower(p_type), 'brass|steel|copper|tin|nickel') THEN 1
  WHEN regexp_matches(lower(p_type), 'standard') THEN 2
  WHEN regexp_matches(lower(p_type), 'economy') THEN 3 ELSE -1 END AS rule, count(*) AS n
FROM part GROUP BY ALL"""
)
def first_match_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = scan(parquet(spark, sf_dir, "part"), ["p_type"])
    kind = F.col("p_type")
    return rates.rule_counts(part, "p_type", R.first_match(kind, PART_RULES, "Missing", "other"), R.first_match_index(kind, PART_RULES))


FAMILY_RULES = [
    ("licence", "licen[sc]e", None),
    ("credential", "(password|secret|token|api_?key)\\s*[:=]", "example"),
    ("contact", "[a-z0-9._]+@[a-z0-9.]+", None),
]


@query(
    """SELECT coalesce(family, 'none') AS family, lang, count(*) AS n FROM (
  SELECT lang, CASE
    WHEN regexp_matches(lower(text), '#{3}|%{3}') AND NOT regexp_matches(lower(text), 'licen[sc]e') THEN NULL
    WHEN regexp_matches(lower(text), 'licen[sc]e') THEN 'licence'
    WHEN regexp_matches(lower(text), '(password|secret|token|api_?key)\\s*[:=]') AND NOT regexp_matches(lower(text), 'example') THEN 'credential'
    WHEN regexp_matches(lower(text), '[a-z0-9._]+@[a-z0-9.]+') THEN 'contact' END AS family
  FROM documents) GROUP BY ALL"""
)
def document_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = parquet(spark, sf_dir, "documents").select("text", "lang")
    family = R.first_match_with_veto(F.col("text"), FAMILY_RULES, "#{3}|%{3}", "licen[sc]e")
    return docs.select("lang", F.coalesce(family, F.lit("none")).alias("family")).groupBy("family", "lang").agg(F.count(F.lit(1)).alias("n"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(parquet(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"])


def _orders_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = parquet(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    nations = parquet(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return _orders(spark, sf_dir).join(customers, "o_custkey").join(nations, "n_nationkey")


def _rates(df: DataFrame, keys: list[str], least: int = 0) -> DataFrame:
    return rates.outcome_rates(df, keys, "o_orderstatus", ["F", "O", "P"], ["F"], ["P"], least)


_RATES = """count(*) FILTER (o_orderstatus = 'F') AS "n_F", count(*) FILTER (o_orderstatus = 'O') AS "n_O",
  count(*) FILTER (o_orderstatus = 'P') AS "n_P", count(*) AS total,
  count(*) FILTER (o_orderstatus IN ('F', 'P')) AS decided,
  round(count(*) FILTER (o_orderstatus = 'F') * 100.0::DOUBLE / nullif(count(*) FILTER (o_orderstatus IN ('F', 'P')), 0), 4) AS approval_rate,
  round(count(*) FILTER (o_orderstatus = 'P') * 100.0::DOUBLE / nullif(count(*) FILTER (o_orderstatus IN ('F', 'P')), 0), 4) AS refusal_rate,
  round(count(*) FILTER (o_orderstatus NOT IN ('F', 'P')) * 100.0::DOUBLE / count(*), 4) AS no_decision_share"""
_ORDERS_NATION = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"


@query(f"SELECT n_name, {_RATES} FROM {_ORDERS_NATION} GROUP BY n_name")
def outcome_rates_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rates(_orders_by_nation(spark, sf_dir), ["n_name"]).orderBy(F.col("refusal_rate").desc_nulls_last(), "n_name")


@query(f"SELECT year(o_orderdate)::INT AS start_year, {_RATES} FROM orders WHERE year(o_orderdate) < 1998 GROUP BY 1")
def outcome_rates_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).withColumn("start_year", S.year_of(F.col("o_orderdate").cast("string")))
    return _rates(rows.filter(F.col("start_year") < 1998), ["start_year"])


@query(f"SELECT o_orderpriority, {_RATES} FROM orders GROUP BY 1")
def outcome_rates_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rates(_orders(spark, sf_dir), ["o_orderpriority"])


@query(
    f"""WITH r AS (SELECT n_name, count(*) AS total, round(avg(CASE WHEN o_orderstatus = 'P' THEN 100.0::DOUBLE ELSE 0 END), 4) AS rate
  FROM {_ORDERS_NATION} GROUP BY 1 HAVING count(*) >= 50),
k AS (SELECT n_name, o_orderpriority, count(*) AS n FROM {_ORDERS_NATION} GROUP BY 1, 2),
m AS (SELECT n_name, o_orderpriority AS top, row_number() OVER (PARTITION BY n_name ORDER BY n DESC, o_orderpriority) AS rn FROM k)
SELECT r.n_name, total, rate, top AS mode FROM r JOIN m ON r.n_name = m.n_name AND rn = 1 ORDER BY rate DESC, n_name LIMIT 10"""
)
def rates_having_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders_by_nation(spark, sf_dir)
    out = rates.dominant_rates(rows, ["n_name"], F.col("o_orderstatus") == "P", "o_orderpriority", 50)
    return out.orderBy(F.col("rate").desc_nulls_last(), "n_name").limit(10)


@query(
    """WITH c AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS segment FROM customer),
k AS (SELECT c_nationkey, segment, count(*) AS n FROM c WHERE segment IS NOT NULL GROUP BY 1, 2),
m AS (SELECT c_nationkey, segment AS top, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, segment) AS rn FROM k)
SELECT c.c_custkey, coalesce(segment, top, 'Unknown') AS imputed FROM c LEFT JOIN m ON c.c_nationkey = m.c_nationkey AND rn = 1"""
)
def impute_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = parquet(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("segment")
    )
    return rates.impute_mode(c, ["c_nationkey"], "segment", "Unknown", "imputed").select("c_custkey", "imputed")


@query(
    """WITH f AS (SELECT p_retailprice, coalesce(regexp_matches(lower(p_type), 'economy'), false) AS a,
  coalesce(p_size <= 10, false) AS b FROM part),
u AS (SELECT p_retailprice, unnest([CASE WHEN a THEN 'economy' ELSE 'not_economy' END, CASE WHEN b THEN 'small' ELSE 'not_small' END]) AS subset FROM f)
SELECT subset, count(*) AS n, round(avg(p_retailprice), 4) AS mean_price FROM u GROUP BY 1"""
)
def flag_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = parquet(spark, sf_dir, "part").select("p_type", "p_size", "p_retailprice")
    flags = R.flag_columns({"economy": [("p_type", "economy")]}) | {"small": F.col("p_size") <= 10}
    rows = rates.subset_rows(part.withColumns(flags), {"economy": ("economy", "not_economy"), "small": ("small", "not_small")})
    return rows.groupBy("subset").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_retailprice"), 4).alias("mean_price"))


LABEL_RULES = [
    ("licence", "licen[sc]e"),
    ("secret", "secret|password|token"),
    ("mail", "@"),
    ("symbols", "#{3}|%{3}"),
    ("table", " \\| "),
    ("shout", "!!"),
]
_LABELS = """list_filter([CASE WHEN regexp_matches(lower(text), 'licen[sc]e') THEN 'licence' END,
  CASE WHEN regexp_matches(lower(text), 'secret|password|token') THEN 'secret' END,
  CASE WHEN regexp_matches(lower(text), '@') THEN 'mail' END,
  CASE WHEN regexp_matches(lower(text), '#{3}|%{3}') THEN 'symbols' END,
  CASE WHEN regexp_matches(lower(text), ' \\| ') THEN 'table' END,
  CASE WHEN regexp_matches(lower(text), '!!') THEN 'shout' END], lambda x: x IS NOT NULL)"""


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = parquet(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", R.multi_label(F.col("text"), LABEL_RULES).alias("labels"))


@query(
    f"""WITH d AS (SELECT unnest({_LABELS}) AS label FROM documents)
SELECT label, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM documents), 4) AS pct FROM d GROUP BY 1"""
)
def label_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.label_tally(_labelled(spark, sf_dir), "labels", parquet(spark, sf_dir, "documents").count())


@query(
    f"""WITH d AS (SELECT doc_id, unnest({_LABELS}) AS l FROM documents)
SELECT a.l AS label_a, b.l AS label_b, count(*) AS n FROM d a JOIN d b ON a.doc_id = b.doc_id AND a.l < b.l
GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 50"""
)
def label_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.label_pairs(_labelled(spark, sf_dir), "labels", 50)


# --- attempts and backlogs -------------------------------------------------------------------------------------


@query(
    """SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn = 1 AND event_type = 'error'"""
)
def latest_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = parquet(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    latest = progress.latest_per_key(events, ["user_id"], ["ts", "event_id"])
    return latest.filter(F.col("event_type") == "error").select("user_id", "event_id", "event_type")


STATUS_NAMES = ["purchase", "click", "view"]
STATUS_RANKS = {"purchase": 3, "click": 2, "view": 1}
_BEST = """CASE max(CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 WHEN 'view' THEN 1 END)
  WHEN 3 THEN 'purchase' WHEN 2 THEN 'click' WHEN 1 THEN 'view' ELSE 'failed' END"""


def _best(events: DataFrame) -> DataFrame:
    return progress.best_status(events, ["user_id"], "event_type", STATUS_RANKS, STATUS_NAMES, "failed", [F.max("event_id").alias("last_event")])


@query(f"SELECT user_id, {_BEST} AS best_status, count(*) AS attempts, max(event_id) AS last_event FROM events GROUP BY 1")
def best_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(parquet(spark, sf_dir, "events").select("user_id", "event_type", "event_id"))


@query(
    f"""WITH b AS (SELECT user_id, {_BEST} AS best_status, count(*) AS attempts FROM events GROUP BY 1),
j AS (SELECT c_custkey, coalesce(best_status, 'not_started') AS status, coalesce(attempts, 0) AS attempts FROM customer LEFT JOIN b ON c_custkey = user_id)
SELECT (c_custkey % 10)::BIGINT AS shard, count(*) AS total, count(*) FILTER (status = 'purchase') AS n_done,
  count(*) FILTER (status = 'not_started') AS n_not_started, sum(attempts)::BIGINT AS attempts,
  round(count(*) FILTER (status = 'purchase') / count(*)::DOUBLE, 4) AS done_ratio,
  CASE WHEN count(*) < 100 THEN 'small' WHEN count(*) < 1000 THEN 'medium' ELSE 'large' END AS size_class
FROM j GROUP BY 1"""
)
def progress_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _best(parquet(spark, sf_dir, "events").select("user_id", "event_type", "event_id")).withColumnRenamed("user_id", "c_custkey")
    rows = progress.with_rollup(parquet(spark, sf_dir, "customer").select("c_custkey"), best, "c_custkey", "best_status", "not_started")
    done = F.count_if(F.col("best_status") == "purchase")
    return (
        rows.groupBy((F.col("c_custkey") % 10).alias("shard"))
        .agg(
            F.count(F.lit(1)).alias("total"),
            done.alias("n_done"),
            F.count_if(F.col("best_status") == "not_started").alias("n_not_started"),
            F.sum(F.coalesce("attempts", F.lit(0))).alias("attempts"),
            F.round(done / F.count(F.lit(1)), 4).alias("done_ratio"),
        )
        .withColumn("size_class", S.size_class(F.col("total"), 100, 1000))
    )


@query(
    """SELECT event_type, round(sum(m), 4) AS total, count(*) AS n_keys FROM (SELECT event_type, user_id, max(value) AS m FROM events GROUP BY 1, 2) GROUP BY 1"""
)
def sum_of_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = progress.sum_of_max(parquet(spark, sf_dir, "events").select("event_type", "user_id", "value"), ["user_id"], "value", ["event_type"])
    return out.withColumn("total", F.round("total", 4))


@query(
    """WITH l AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_linestatus <> 'F') AS n_open FROM lineitem GROUP BY 1),
j AS (SELECT o_orderpriority, n, n_open FROM orders LEFT JOIN l ON o_orderkey = l_orderkey)
SELECT coalesce(o_orderpriority, 'Total') AS o_orderpriority, count(*) AS total, count(*) FILTER (n IS NOT NULL) AS have_lines,
  count(*) FILTER (n IS NULL) AS no_lines, count(*) FILTER (n_open > 0) AS runnable FROM j GROUP BY ROLLUP (o_orderpriority)"""
)
def backlog_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = parquet(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linestatus")
    per = lines.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_linestatus") != "F").alias("n_open"))
    rows = _orders(spark, sf_dir).select("o_orderkey", "o_orderpriority").join(per, "o_orderkey", "left")
    return progress.backlog(
        rows, "o_orderpriority", {"have_lines": F.col("n").isNotNull(), "no_lines": F.col("n").isNull(), "runnable": F.col("n_open") > 0}
    )


@query(
    """SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
  OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus <> 'F')"""
)
def needs_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = parquet(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linestatus")
    return progress.needs_work(_orders(spark, sf_dir).select("o_orderkey"), lines, "o_orderkey", F.col("l_linestatus") == "F").select("o_orderkey")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.without_match(parquet(spark, sf_dir, "documents").select("doc_id", "source"), parquet(spark, sf_dir, "labels"), "doc_id")


@query(
    """SELECT count(*) FILTER (l.doc_id IS NOT NULL AND d.doc_id IS NOT NULL) AS shared, count(*) FILTER (l.doc_id IS NULL) AS only_own,
  count(*) FILTER (d.doc_id IS NULL) AS only_other FROM (SELECT DISTINCT doc_id FROM documents) d
  FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id"""
)
def overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.overlap_counts(parquet(spark, sf_dir, "documents"), parquet(spark, sf_dir, "labels"), "doc_id")


@query(
    """WITH l AS (SELECT d.doc_id, d.source FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))
SELECT source, count(*) AS n FROM l GROUP BY 1"""
)
def restrict_to_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = parquet(spark, sf_dir, "labels").filter(F.col("quality") == 1)
    docs = progress.restrict(parquet(spark, sf_dir, "documents").select("doc_id", "source"), keys, "doc_id")
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


# --- selection and sampling ------------------------------------------------------------------------------------


@query(
    "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents"
)
def interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.interleave(parquet(spark, sf_dir, "documents").select("doc_id", "source"), "source", ["doc_id"])


@query(
    """WITH t AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents)
SELECT doc_id, source, turn, row_number() OVER (ORDER BY turn, source) AS position FROM t"""
)
def interleave_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of the round robin itself, as a column."""
    turns = progress.interleave(parquet(spark, sf_dir, "documents").select("doc_id", "source"), "source", ["doc_id"])
    return order.global_positions(turns, ["turn", "source"])


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderstatus, o_orderdate DESC, o_totalprice DESC, o_orderkey) AS position FROM orders")
def mixed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by status ascending, then latest and largest first."""
    orders = parquet(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice")
    by = ["o_orderstatus", F.desc("o_orderdate"), F.desc("o_totalprice"), "o_orderkey"]
    return order.global_positions(orders, by).select("o_orderkey", "position")


def _draw() -> list:
    """The order of a seeded draw, by key arithmetic so that SQL can repeat it."""
    return [F.pmod(F.col("doc_id") * 7919, F.lit(1009)), F.col("doc_id")]


@query(
    """SELECT doc_id, source, turn FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id * 7919 % 1009, doc_id) AS turn FROM documents)
WHERE turn <= 5 ORDER BY turn, source LIMIT 60"""
)
def capped_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = parquet(spark, sf_dir, "documents").select("doc_id", "source")
    return progress.capped_sample(docs, "source", _draw(), 5, 60, F.col("source"))


@query(
    """WITH p AS (SELECT lang, greatest(1, count(*) // 50) AS quota FROM documents GROUP BY 1)
SELECT doc_id, lang, turn FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id * 7919 % 1009, doc_id) AS turn FROM documents) d
JOIN p USING (lang) WHERE turn <= quota"""
)
def stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = parquet(spark, sf_dir, "documents").select("doc_id", "lang")
    plan = docs.groupBy("lang").agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / 50)).alias("quota"))
    return progress.stratified_sample(docs, plan, ["lang"], _draw())


@query(
    """SELECT doc_id, source, turn FROM (SELECT doc_id, source, doc_id * 7919 % 1009 AS k, row_number() OVER (PARTITION BY source ORDER BY doc_id * 7919 % 1009, doc_id) AS turn FROM documents)
ORDER BY turn > 1, k, doc_id LIMIT 40"""
)
def bucket_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = parquet(spark, sf_dir, "documents").select("doc_id", "source")
    return progress.one_per_bucket_then_fill(docs, "source", _draw(), 40)


@query(
    """SELECT doc_id, source, rank FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY
  CASE WHEN regexp_matches(lower(text), 'licen[sc]e') THEN 0 WHEN regexp_matches(lower(text), 'secret|password|token') THEN 1 ELSE 2 END, n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 3"""
)
def topk_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = parquet(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", "text")
    tier = R.first_case([(R.matches(F.col("text"), p), i) for i, (_, p) in enumerate(LABEL_RULES[:2])], 2)
    rows = docs.select("doc_id", "source", "n_chars", tier.alias("tier"))
    return corpus.top_ranked(rows, "source", [F.col("tier"), F.desc("n_chars"), F.col("doc_id")], 3).select("doc_id", "source", "rank")


@query(
    """WITH r AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
k AS (SELECT *, least(n_chars, CASE WHEN rank <= 2 THEN 6000 ELSE 2000 END) AS c FROM r WHERE rank <= 10),
p AS (SELECT *, 15000 - coalesce(sum(c) OVER (PARTITION BY source ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM k)
SELECT doc_id, source, rank, (CASE WHEN room > 200 THEN least(c, room) ELSE 0 END)::BIGINT AS taken FROM p"""
)
def char_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = parquet(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    ranked = corpus.top_ranked(docs, "source", [F.desc("n_chars"), F.col("doc_id")], 10)
    cap = F.when(F.col("rank") <= 2, 6000).otherwise(2000)
    return corpus.char_budget(ranked, "source", "rank", "n_chars", cap, 15000).select("doc_id", "source", "rank", "taken")


@query(
    """WITH RECURSIVE r AS (SELECT source, doc_id, coalesce(n_chars, 0) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
g AS (SELECT source, doc_id, n, rn, 0::BIGINT AS chunk, n AS used FROM r WHERE rn = 1 UNION ALL
  SELECT r.source, r.doc_id, r.n, r.rn, CASE WHEN g.used + r.n > 20000 THEN g.chunk + 1 ELSE g.chunk END, CASE WHEN g.used + r.n > 20000 THEN r.n ELSE g.used + r.n END
  FROM g JOIN r ON r.source IS NOT DISTINCT FROM g.source AND r.rn = g.rn + 1)
SELECT source, doc_id, n AS n_chars, chunk FROM g"""
)
def pack_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = parquet(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return corpus.pack_chunks(docs, "source", "doc_id", "n_chars", 20_000)


@query(
    """WITH r AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS rank FROM documents)
SELECT source, count(*) AS n_documents, sha256(string_agg(d.text, chr(10) || chr(10) ORDER BY r.rank)) AS text_sha FROM r JOIN documents d USING (doc_id, source) WHERE rank <= 3 GROUP BY 1"""
)
def assemble_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = parquet(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", "text")
    top = corpus.top_ranked(docs, "source", [F.col("n_chars"), F.col("doc_id")], 3)
    return corpus.assemble(top, "source", "rank", "doc_id", "text").select("source", "n_documents", F.sha2("text", 256).alias("text_sha"))


_WORDS = "len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> ''))"
_HITS = "(contains(lower(text), 'the')::INT + contains(lower(text), 'und')::INT + contains(lower(text), 'que')::INT + contains(lower(text), 'est')::INT)"
_CLASS = f"""CASE WHEN coalesce(length(text), 0) = 0 THEN 'unreadable' WHEN length(text) < 200 THEN 'image_only'
  WHEN {_WORDS} < 40 OR {_HITS} = 0 THEN 'poor' ELSE 'good' END"""
KEYWORDS = ["the", "und", "que", "est"]


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = parquet(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    words, hits = S.word_count(F.col("text")), R.keyword_hits(F.col("text"), KEYWORDS)
    rows = docs.select("doc_id", "lang", F.length("text").alias("chars"), words.alias("words"), hits.alias("hits"))
    return rows.withColumn("quality", S.text_quality(F.col("chars"), F.col("words"), F.col("hits")))


@query(f"SELECT doc_id, {_WORDS}::INT AS words, {_HITS} AS hits, {_CLASS} AS quality FROM documents")
def quality_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).select("doc_id", "words", "hits", "quality")


@query(
    f"""WITH m AS (SELECT lang, {_WORDS}::INT AS words, {_CLASS} AS q FROM documents)
SELECT lang, count(*)::BIGINT AS n, count(*) FILTER (q = 'good')::BIGINT AS n_good, min(words) AS min_words,
  list_sort(list(words))[len(list(words)) // 2 + 1] AS median_words, max(words) AS max_words FROM m GROUP BY 1"""
)
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.corpus_stats(_metrics(spark, sf_dir), ["lang"], "words", {"n_good": F.col("quality") == "good"})


# --- text, pages and URLs --------------------------------------------------------------------------------------


@query(
    r"""SELECT doc_id, trim(regexp_split_to_array(substr(rest, 1, 8000), '\n')[1]) AS section FROM (
  SELECT doc_id, substr(text, strpos(text, 'censed under') + length('censed under')) AS rest FROM documents WHERE contains(text, 'censed under'))"""
)
def section_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = parquet(spark, sf_dir, "documents").select("doc_id", S.section(F.col("text"), "(?-i)censed under", ["\n"]).alias("section"))
    return docs.filter(F.col("section").isNotNull())


def _plain(x: str) -> str:
    """SQL of normalise_quotes."""
    plain = "'''''\"\"--- '"
    return rf"trim(regexp_replace(lower(translate({x}, '‘’“”–—−' || chr(160), {plain})), '\s+', ' ', 'g'))"


_GROUNDED = rf"""WITH q AS (SELECT item_id, list_filter(list_transform(regexp_split_to_array(text, '\[?(?:…|\.\s*\.\s*\.)\]?'),
    lambda x: trim({_plain("x")}, ' "''.,;:!?()[]-')), lambda x: length(x) >= 6) AS segs FROM benchmark WHERE text <> ''),
s AS (SELECT doc_id, {_plain("text")} AS source FROM documents WHERE text IS NOT NULL),
g AS (SELECT item_id, unnest(segs) AS seg, generate_subscripts(segs, 1) AS k FROM q),
h AS (SELECT item_id, k, seg, unnest(list_transform(range(1, greatest(len(string_split(seg, ' ')) - 4, 1) + 1), lambda i: array_to_string(string_split(seg, ' ')[i:i + 4], ' '))) AS sh FROM g),
o AS (SELECT item_id, doc_id, k, bool_and(contains(source, seg)) AS whole, avg(contains(source, sh)::INT) AS share FROM h, s GROUP BY item_id, doc_id, k),
p AS (SELECT item_id, doc_id, CASE WHEN bool_and(whole) THEN 'ok' WHEN min(share) >= 0.5 THEN 'near_verbatim' ELSE 'missing' END AS status FROM o GROUP BY 1, 2
  UNION ALL SELECT item_id, doc_id, 'ok' FROM q, s WHERE len(segs) = 0)"""


@query(
    f"""{_GROUNDED} SELECT item_id, count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status = 'near_verbatim') AS n_near,
  CASE WHEN bool_or(status = 'ok') THEN 'ok' WHEN bool_or(status = 'near_verbatim') THEN 'near_verbatim' ELSE 'missing' END AS status FROM p GROUP BY 1"""
)
def quote_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text against every document, both whole: in how many it is found, in how many nearly."""
    quotes = parquet(spark, sf_dir, "benchmark").select("item_id", "text").filter(F.col("text") != "")
    docs = parquet(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"))
    found = corpus.ground_quotes(quotes, docs, "item_id", "text", "doc_id", "body").groupBy("item_id").agg(
        F.count_if(F.col("status") == "ok").alias("n_ok"), F.count_if(F.col("status") == "near_verbatim").alias("n_near")
    )
    everywhere = docs.filter(F.col("body").isNotNull()).agg(F.count(F.lit(1)).alias("n_ok"), F.lit(0).cast("long").alias("n_near"))
    found = found.unionByName(corpus.empty_quotes(quotes, "text").select("item_id").join(F.broadcast(everywhere)))
    none = F.lit(0).cast("long")
    status = F.when(F.col("n_ok") > 0, "ok").when(F.col("n_near") > 0, "near_verbatim").otherwise("missing")
    return quotes.select("item_id").join(found, "item_id", "left").select(
        "item_id", F.coalesce("n_ok", none).alias("n_ok"), F.coalesce("n_near", none).alias("n_near"), status.alias("status")
    )


@query(f"{_GROUNDED} SELECT d.source, status, count(*) AS n FROM p JOIN documents d USING (doc_id) WHERE status <> 'missing' GROUP BY ALL")
def grounding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark text, by source and status."""
    docs = parquet(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"), "source")
    quotes = parquet(spark, sf_dir, "benchmark").select("item_id", "text")
    found = corpus.ground_quotes(quotes, docs.select("doc_id", "body"), "item_id", "text", "doc_id", "body")
    counts = found.join(docs.select("doc_id", "source"), "doc_id").groupBy("source", "status").agg(F.count(F.lit(1)).alias("n"))
    empty = corpus.empty_quotes(quotes, "text").agg(F.count(F.lit(1)).alias("e")).filter(F.col("e") > 0)
    each = docs.filter(F.col("body").isNotNull()).groupBy("source").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(empty))
    each = each.select("source", F.lit("ok").alias("status"), (F.col("n") * F.col("e")).alias("n"))
    return counts.unionByName(each).groupBy("source", "status").agg(F.sum("n").alias("n"))


@query(
    r"""WITH t AS (SELECT page_id, regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gis') AS x FROM pages),
t2 AS (SELECT page_id, regexp_replace(x, '<(br|/p|/div|/li|/tr|/h[1-6]|/table)[^>]*>', chr(10), 'gi') AS x FROM t),
t3 AS (SELECT page_id, regexp_replace(x, '<[^>]+>', ' ', 'g') AS x FROM t2),
t4 AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS x FROM t3),
t5 AS (SELECT page_id, regexp_replace(x, '[ \t\r]+', ' ', 'g') AS x FROM t4)
SELECT page_id, sha256(trim(regexp_replace(x, ' ?\n[ \n]*', chr(10), 'g'))) AS text_sha FROM t5"""
)
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = parquet(spark, sf_dir, "pages").select("page_id", S.html_to_text(F.col("html")).alias("text"))
    return pages.select("page_id", F.sha2("text", 256).alias("text_sha"))


_LINKED = [
    """<a href="/own/a">o</a><link href="https://style.example/x"><a href="https://ext.example/doc/1">e</a>""",
    """<a href="//ext.example/a/b?q=1">e</a><a href="https://late.example/z">l</a>""",
    """<a href="../up">u</a><a href="https://ext.example/Login?x">g</a>""",
    """<a class="x" href='https://EXT.example/Case?id=5&amp;v=2'>e</a>""",
    """<a href="#top">t</a><a href="mailto:x@y.example">m</a><a href="https://ext.example/s#advancedSearch">g</a><A HREF="http://two.example/ok">k</A>""",
    "",
]


@query(
    r"""WITH h AS (SELECT page_id, url, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS own, CASE page_id % 6 """
    + " ".join(f"WHEN {i} THEN '{x.replace(chr(39), chr(39) * 2)}'" for i, x in enumerate(_LINKED))
    + r""" END || html AS html FROM pages),
l AS (SELECT page_id, own, url AS page, unnest(regexp_extract_all(html, '<a\s[^>]*?href\s*=\s*(?:"[^"]*"|''[^'']*'')', 0, 'is')) AS tag, unnest(range(len(regexp_extract_all(html, '<a\s[^>]*?href\s*=\s*(?:"[^"]*"|''[^'']*'')', 0, 'is')))) AS pos FROM h),
r AS (SELECT *, replace(regexp_extract(tag, '["'']([^"'']*)["'']$', 1), '&amp;', '&') AS ref FROM l),
u AS (SELECT page_id, own, pos, CASE WHEN ref LIKE '//%' THEN regexp_extract(page, '^([a-z]+:)', 1) || ref ELSE ref END AS url FROM r WHERE ref LIKE '//%' OR regexp_matches(ref, '^https?://')),
g AS (SELECT *, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS host, lower(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)) AS path, lower(regexp_extract(url, '#(.*)$', 1)) AS part FROM u)
SELECT page_id, first(url ORDER BY pos) AS url FROM g
WHERE host <> own AND CASE WHEN length(path) > 1 THEN regexp_replace(path, '/+$', '') ELSE path END NOT IN ('', '/', '/home', '/index.html', '/search')
  AND NOT contains(path, 'login') AND NOT contains(path, 'search.do') AND part <> 'advancedsearch' GROUP BY 1"""
)
def outlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First link of a page that leads elsewhere and is no landing page."""
    added = F.element_at(F.array(*map(F.lit, _LINKED)), (F.col("page_id") % 6 + 1).cast("int"))
    pages = parquet(spark, sf_dir, "pages").select("page_id", "url", F.concat(added, "html").alias("html"))
    links = corpus.outlinks(pages, "page_id", "html", F.col("url"))
    return corpus.first_link(links, "page_id", ~S.is_generic_url(F.col("url")))


@query(
    r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS base, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, coalesce(nullif(regexp_extract(url, '^https?://[^/?#]+(.*/)', 1), ''), '/') AS folder FROM pages)
SELECT page_id, CASE page_id % 8 WHEN 0 THEN base || coalesce(nullif(regexp_replace(folder, '[^/]+/$', ''), ''), '/') || 'x' WHEN 1 THEN base || folder || 'y?z=/../1' WHEN 2 THEN base || path || '?q=2' WHEN 3 THEN base || folder || 'w/' WHEN 4 THEN base || '/abs'
  WHEN 5 THEN regexp_extract(url, '^(https?:)', 1) || '//other.example' WHEN 6 THEN 'https://other.example/a/../b' ELSE regexp_extract(url, '^([^#]*)', 1) || '#part' END AS target FROM p"""
)
def resolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of every kind, resolved against the address of their page."""
    kinds = ["../x", "./y?z=/../1", "?q=2", "z/../w/v/..", "/../abs", "//other.example", "https://other.example/a/../b", "#part"]
    reference = F.element_at(F.array(*map(F.lit, kinds)), (F.col("page_id") % 8 + 1).cast("int"))
    return parquet(spark, sf_dir, "pages").select("page_id", S.resolve_url(F.col("url"), reference).alias("target"))


@query(
    """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'It’s ' || page_id || ' – café' WHEN 1 THEN 'It’s Ā😀' WHEN 2 THEN '&lt; & &nosuch; &#xD800; &' WHEN 3 THEN '€’' ELSE '©½ÿ&' END AS text FROM pages"""
)
def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimal, hexadecimal and named entities, code page numbers, and what is none."""
    key = F.col("page_id").cast("string")
    texts = [
        F.concat(F.lit("It&#8217;s "), key, F.lit(" &ndash; caf&eacute;")),
        F.lit("It&#x2019;s &#X100;&#128512;"),
        F.lit("&amp;lt; &amp; &nosuch; &#xD800; &"),
        F.lit("&#128;&#146;"),
        F.lit("&copy;&frac12;&yuml;&"),
    ]
    return parquet(spark, sf_dir, "pages").select("page_id", S.unescape(F.get(F.array(*texts), (F.col("page_id") % 5).cast("int"))).alias("text"))


MOVED_HOSTS = dict.fromkeys(("thther.example.org", "therha.example.com", "therin.example.net"), "moved.example.org")


@query(
    r"""WITH h AS (SELECT page_id, url, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS host FROM pages)
SELECT page_id, host, CASE WHEN host IN ('thther.example.org', 'therha.example.com', 'therin.example.net') THEN regexp_replace(url, '^https?://[^/:?#]+', 'https://moved.example.org') ELSE url END AS new_url FROM h"""
)
def host_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = parquet(spark, sf_dir, "pages").select("page_id", "url")
    return pages.select(
        "page_id", S.url_host(F.col("url")).alias("host"), S.rewrite_host(F.col("url"), MOVED_HOSTS).alias("new_url")
    )


@query(
    """WITH e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"k": " ' || event_type || ' "}' WHEN 1 THEN props WHEN 2 THEN '{"k": {"v": "x"}}' ELSE '{"k": "x' END AS p FROM events)
SELECT event_id, CASE WHEN json_valid(p) THEN CASE WHEN json_type(p, '$.k') = 'VARCHAR' THEN nullif(trim(json_extract_string(p, '$.k')), '') END END AS k FROM e"""
)
def json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of strings, numbers, objects, and some that are cut off."""
    turn = F.col("event_id") % 4
    payload = (
        F.when(turn == 0, F.concat(F.lit('{"k": " '), "event_type", F.lit(' "}')))
        .when(turn == 1, F.col("props"))
        .when(turn == 2, '{"k": {"v": "x"}}')
        .otherwise('{"k": "x')
    )
    return parquet(spark, sf_dir, "events").select("event_id", S.json_text(payload, "k").alias("k"))
