"""Gate queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatework.functions import fixed
from gatework.functions.codes import prefix
from gatework.operators import gates, lookup
from gatework.plans import sqltext as q
from gatework.plans.derived import derived, with_sources


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.valid_codes(derived(spark, sf_dir, "codes"))


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.all_gates(derived(spark, sf_dir, "records"), codes(spark, sf_dir), derived(spark, sf_dir, "rates"))


def gate(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    records = derived(spark, sf_dir, "records")
    df = {
        "flag_invalid_naics_code": lambda: gates.code_gates(records, codes(spark, sf_dir)),
        "flag_incomplete_naics_code": lambda: gates.code_gates(records, codes(spark, sf_dir)),
        "flag_name_naics_mismatch": lambda: gates.name_gate(records),
        "flag_ein_multi_naics": lambda: gates.entity_gate(records),
        "flag_naics_count_anomaly": lambda: gates.rarity_gate(records),
        "flag_emp_size_anomaly": lambda: gates.size_gate(records),
        "flag_injury_rate_outlier": lambda: gates.rate_gates(records, derived(spark, sf_dir, "rates")),
        "flag_high_emp_zero_injury": lambda: gates.rate_gates(records, derived(spark, sf_dir, "rates")),
    }[name]()
    return df.select("id", "naics_code", name)


def event_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate 6 on events: values far from their user's quartiles."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return gates.size_gate(events, key="user_id", value=F.col("value"), out="outlier", floor=0.0).select("event_id", "user_id", "outlier")


def item_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate 4 on lineitems: orders with several return flags."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("k", F.col("l_orderkey").cast("string"))
    return gates.entity_gate(items, "k", "l_returnflag", "multi").select("l_orderkey", "l_linenumber", "multi")


def pair_rarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate 5 on orders: customers' rare priorities."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return gates.rarity_gate(orders, ("o_custkey", "o_orderpriority"), 3, "rare").select("o_orderkey", "rare")


def cascade_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lookup by prefixes of a code in its variants."""
    df = derived(spark, sf_dir, "records").select("id", "naics_code")
    rates = derived(spark, sf_dir, "rates")
    df = lookup.cascade(df, F.col("naics_code"), rates, (6, 5, 4, 3, 2), "rate", "matched")
    df = lookup.cascade(df, F.col("naics_code"), rates, (6, 4, 3, 2), "rate_no5")
    return lookup.has_prefix(df, F.col("naics_code"), rates.select("prefix"), "any_prefix")


def code_standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """current, retired or invalid, the parent and the note of every distinct code."""
    df = derived(spark, sf_dir, "records").select("naics_code").distinct()
    return lookup.code_status(df, F.col("naics_code"), lookup.last_titles(derived(spark, sf_dir, "codes")), "status", "parent", "note")


def keyword_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = derived(spark, sf_dir, "codes")
    k = lookup.keyword_index(lists).select("code", F.col("title").alias("keyword_title"), F.array_join(F.array_sort("keywords"), " ").alias("keywords"))
    t = lookup.first_titles(lists).withColumnRenamed("title", "first_title").join(lookup.last_titles(lists).withColumnRenamed("title", "last_title"), "code")
    return t.join(k, "code", "left")


def title_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = derived(spark, sf_dir, "records").select("naics_code").distinct()
    return lookup.title_tree(df, F.col("naics_code"), lookup.first_titles(derived(spark, sf_dir, "codes")), "tree")


COLUMNS = ["id", *fixed.FLAGS, "n_flags", "priority_tier", "bls_benchmark", "bls_matched_naics", "trir"]
QUERIES = {f"q_gate{i}_{n.removeprefix('flag_')}": (lambda spark, sf_dir, n=n: gate(n, spark, sf_dir)) for i, n in enumerate(fixed.FLAGS, 1)}
ORACLES = {f"q_gate{i}_{n.removeprefix('flag_')}": with_sources(f"WITH {q.FLAGGED} SELECT id, naics_code, {n} FROM flagged", "records", "codes", "rates") for i, n in enumerate(fixed.FLAGS, 1)}
QUERIES |= {
    "q_priority_tier": lambda spark, sf_dir: flagged(spark, sf_dir).select(*COLUMNS).withColumn("trir", F.round("trir", 6)),
    "q_flag_counts": lambda spark, sf_dir: flagged(spark, sf_dir).groupBy("priority_tier").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in fixed.FLAGS]),
    "q_gate4_items": item_flags,
    "q_gate5_pairs": pair_rarity,
    "q_gate6_events": event_sizes,
    "q_cascade": cascade_rates,
    "q_code_standing": code_standing,
    "q_keyword_titles": keyword_titles,
    "q_title_tree": title_trees,
    "q_code_prefixes": lambda spark, sf_dir: codes(spark, sf_dir).groupBy(F.length("code").alias("digits")).agg(F.count("*").alias("n"), F.count_distinct(prefix(F.col("code"), 2)).alias("sectors")),
}
J5, V5, P5 = q.cascade("c", "r.naics_code", (6, 5, 4, 3, 2))
J4, V4, _ = q.cascade("d", "r.naics_code", (6, 4, 3, 2))
LAST = "last AS (SELECT code, arg_max(title, vintage) AS title FROM codes GROUP BY code)"
STATUS_JOINS = " ".join(f"LEFT JOIN last AS p{n} ON substring(r.naics_code, 1, {n}) = p{n}.code" for n in (5, 4, 3, 2))
PARENT = "coalesce(p5.code, p4.code, p3.code, p2.code)"
PARENT_TITLE = "CASE WHEN p5.code IS NOT NULL THEN p5.title WHEN p4.code IS NOT NULL THEN p4.title WHEN p3.code IS NOT NULL THEN p3.title ELSE p2.title END"
PAGE_WORDS = f"list_sort(list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z]{{3,}}'), lambda w: NOT list_contains({q.array(fixed.PAGE_STOPWORDS)}, w))))"
ORACLES |= {
    "q_priority_tier": with_sources(f"WITH {q.FLAGGED} SELECT {', '.join(COLUMNS[:-1])}, round(trir, 6) AS trir FROM flagged", "records", "codes", "rates"),
    "q_flag_counts": with_sources(f"WITH {q.FLAGGED} SELECT priority_tier, count(*) AS n, {', '.join(f'sum({c})::BIGINT AS {c}' for c in fixed.FLAGS)} FROM flagged GROUP BY 1", "records", "codes", "rates"),
    "q_gate4_items": "SELECT l_orderkey, l_linenumber, (count(DISTINCT l_returnflag) OVER (PARTITION BY l_orderkey) > 1)::INT AS multi FROM lineitem",
    "q_gate5_pairs": "SELECT o_orderkey, (count(*) OVER (PARTITION BY o_custkey, o_orderpriority) < 3)::INT AS rare FROM orders",
    "q_gate6_events": """WITH b AS (SELECT user_id, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events WHERE value >= 0 GROUP BY 1 HAVING count(*) >= 10)
SELECT event_id, e.user_id, (CASE WHEN value >= 0 AND (value < greatest(0.0, q1 - 3 * (q3 - q1)) OR value > q3 + 3 * (q3 - q1)) THEN 1 ELSE 0 END) AS outlier FROM events e LEFT JOIN b ON e.user_id = b.user_id""",
    "q_cascade": with_sources(f"SELECT r.id, r.naics_code, {V5} AS rate, {P5} AS matched, {V4} AS rate_no5, {P5} IS NOT NULL AS any_prefix FROM records AS r {J5} {J4}", "records", "rates"),
    "q_code_standing": with_sources(
        f"""WITH {LAST}, now AS (SELECT code FROM last WHERE length(code) = 6), r AS (SELECT DISTINCT naics_code FROM records),
s AS (SELECT r.naics_code, r.naics_code IN (SELECT code FROM now) AS cur, {PARENT} AS p, {PARENT_TITLE} AS t, (suffix(r.naics_code, '00') AND substring(r.naics_code, 1, 4) IN (SELECT code FROM last)) OR (suffix(r.naics_code, '0') AND substring(r.naics_code, 1, 5) IN (SELECT code FROM last)) AS padded FROM r {STATUS_JOINS})
SELECT naics_code, CASE WHEN cur THEN 'current' WHEN p IS NOT NULL THEN 'retired' ELSE 'invalid' END AS status, CASE WHEN NOT cur THEN p END AS parent,
CASE WHEN cur THEN '' WHEN p IS NULL THEN 'Code ' || naics_code || ' does not exist in any NAICS edition. May be a legacy SIC code or data entry error. Requires manual review to assign a valid 6-digit NAICS.'
 WHEN padded THEN 'Code ' || naics_code || ' appears to be a zero-padded ' || length(p) || '-digit code (' || p || ': ' || t || '). Should be filed as a specific 6-digit code under ' || p || '.'
 ELSE 'Code ' || naics_code || ' was retired from NAICS. Nearest current parent: ' || p || ' (' || t || '). Update to a current 6-digit code under ' || p || '.' END AS note FROM s""",
        "records", "codes",
    ),
    "q_keyword_titles": with_sources(
        f"""WITH f AS (SELECT code, arg_min(title, vintage) AS first_title, arg_max(title, vintage) AS last_title FROM codes GROUP BY 1),
k AS (SELECT code, title, {PAGE_WORDS} AS kw, vintage FROM codes WHERE length(code) = 6), b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY code ORDER BY len(kw) DESC, vintage) = 1)
SELECT f.code, first_title, last_title, b.title AS keyword_title, array_to_string(kw, ' ') AS keywords FROM f LEFT JOIN b ON f.code = b.code""",
        "codes",
    ),
    "q_title_tree": with_sources(f"WITH {q.TITLES} SELECT c.code AS naics_code, {q.TREE} AS tree FROM (SELECT DISTINCT naics_code AS code FROM records) AS c {q.TREE_JOINS}", "records", "codes"),
    "q_code_prefixes": with_sources(f"WITH {q.VALID} SELECT length(code)::INT AS digits, count(*) AS n, count(DISTINCT substring(code, 1, 2)) AS sectors FROM valid GROUP BY 1", "codes"),
}
