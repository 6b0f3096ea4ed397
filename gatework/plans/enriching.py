"""Enrichment queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatework.functions import fixed
from gatework.functions.text import company_key
from gatework.operators import enrich, fuzzy, lookup, reports
from gatework.plans import sqltext as q
from gatework.plans.derived import derived, with_sources
from gatework.plans.gating import flagged

CLASSES = ["id", "match_status", "naics_verified", "naics_description", "confidence"]


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes need no flags."""
    return enrich.classify(derived(spark, sf_dir, "records"))


def seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1999's records seeded from the results of 1998, then 1997."""
    prior = derived(spark, sf_dir, "results").where("year in ('1997', '1998')").withColumn("seed_ord", F.when(F.col("year") == "1998", 0).otherwise(1))
    targets = derived(spark, sf_dir, "records").where("year = '1999'")
    return enrich.seed_from_prior(targets, prior).select("id", "seeded", "scrape_match_status", "suggested_naics")


def crosswalked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes mapped from their first three digits to up to six others."""
    lists = derived(spark, sf_dir, "codes").where("length(code) = 6").groupBy("code").agg(F.min_by("title", "vintage").alias("mapped_title"))
    table = lists.select(F.substring("code", 1, 3).alias("sic"), F.col("code").alias("mapped_code"), "mapped_title", F.col("code").cast("bigint").alias("ord"))
    df = derived(spark, sf_dir, "records").withColumn("sic", F.when(F.col("ord") % 4 != 0, F.substring("naics_code", 1, 3)))
    return enrich.registrant_verdict(df.select("id", "sic", "naics_code"), table, "sic").select("id", "scrape_match_status", "suggested_naics", "suggested_description")


def contractors(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = derived(spark, sf_dir, "results")
    listed = F.when(F.col("ord") % 3 == 0, "").otherwise(F.concat(F.lit("238220Y; "), F.col("naics_code"), F.lit("N;12Y")))
    primary = F.when(F.col("ord") % 2 == 0, F.col("suggested_naics")).otherwise("")
    v = enrich.contractor_verdict(primary, listed, F.col("naics_code"))
    return df.select("id", v.alias("v")).select("id", "v.match_status", "v.suggested_naics", "v.confidence")


def versions(df: DataFrame, kind: str) -> DataFrame:
    """Another source's results for some of the ids, as in the SQL twin."""
    k = 3 if kind == "EDGAR" else 5
    status = F.when(F.col("ord") % 4 == 0, f"{kind}_CONFIRMED").when(F.col("ord") % 4 == 1, f"{kind}_SUGGESTED").otherwise(f"{kind}_NOT_FOUND")
    new = {f: F.lit("") for f in fixed.ENRICHMENT} | {"scrape_match_status": status, "suggested_naics": F.when(F.col("ord") % 4 <= 1, F.lit(str(k) * 6)).otherwise(""), "suggested_description": F.when(F.col("ord") % 8 == 1, kind).otherwise("")}
    return df.where(F.col("ord") % k == 0).withColumns(new)


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = derived(spark, sf_dir, "results")
    out = enrich.merged(base, versions(base, "EDGAR"), source="edgar")
    return enrich.merged(out, versions(base, "SAM"), source="sam")


def status_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.status_changes(derived(spark, sf_dir, "results"), merged(spark, sf_dir))


def fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of the records up to 1997, given to all records of their companies."""
    results, records = derived(spark, sf_dir, "results").where("year <= '1997'"), derived(spark, sf_dir, "records")
    out = enrich.fanned_out(results, records, lookup.last_titles(derived(spark, sf_dir, "codes")))
    return out.select("id", "scrape_match_status", "suggested_naics", "website_url", "naics_code_status")


def near_names(spark: SparkSession, sf_dir: str, block: str | None = "block") -> DataFrame:
    """Parts of even keys matched with those of odd keys in another spelling, within a brand or among all."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    left = parts.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("block"), F.upper("p_name").alias("name"))
    right = parts.where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("match"), F.col("p_brand").alias("block"), F.upper(F.concat("p_name", F.lit("s"))).alias("name"))
    return fuzzy.best_matches(left, right, block, 85.0 if block else 80.0).withColumn("score", F.round("score", 6))


def near_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of distinct part names of a brand within two edits: the bound of the fuzzy join, which SQL can check."""
    names = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_brand", "p_name").distinct()
    a, b = names.withColumnRenamed("p_name", "a"), names.withColumnRenamed("p_name", "b")
    return a.join(b, "p_brand").where("a < b").withColumn("edits", F.levenshtein("a", "b")).where("edits <= 2")


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.createDataFrame(
        [("bolt", "^bolt", None, ["332722", "238220"], "332722", "Bolts", 1), ("eagle-h", "eagle", "hotel", ["721110"], "721110", "Hotels", 2), ("eagle", "eagle", None, ["551112"], "551112", "Holdings", 3)],
        "company_id string, pattern string, unit_pattern string, codes array<string>, code string, title string, ord int",
    )
    junk = spark.createDataFrame([("yelp.com",), ("dnb.com",)], "domain string")
    out = enrich.known_companies(enrich.without_junk(derived(spark, sf_dir, "results"), junk), table)
    return out.select("id", "scrape_match_status", "suggested_naics", "website_url", "company_id")


HARD = "(flag_invalid_naics_code + flag_name_naics_mismatch + flag_naics_count_anomaly > 0)"
PRIO = "CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in fixed.MERGE_PRIORITY.items()) + " ELSE 0 END"
CHOICE = "CASE scrape_match_status " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in fixed.CHOICE_PRIORITY.items()) + " ELSE 0 END"
KEY = f"lower(trim(replace({q.FIRM}, '_', ' ')))"
FOUND = "CASE WHEN ord % 4 = 0 THEN '{k}_CONFIRMED' WHEN ord % 4 = 1 THEN '{k}_SUGGESTED' ELSE '{k}_NOT_FOUND' END"


def merge_step(source: str, kind: str, k: int) -> str:
    new, wins = FOUND.replace("{k}", kind), f"(ord % {k} = 0 AND ({PRIO.replace('{c}', '(' + FOUND.replace('{k}', kind) + ')')}) > ({PRIO.replace('{c}', 'st')}))"
    return f"SELECT id, ord, CASE WHEN {wins} THEN {new} ELSE st END AS st, CASE WHEN {wins} AND ord % 4 <= 1 THEN '{str(k) * 6}' ELSE sug END AS sug, CASE WHEN {wins} AND ord % 8 = 1 THEN '{kind}' ELSE descr END AS descr FROM {source}"


MERGED = f"m0 AS (SELECT id, ord, scrape_match_status AS st, suggested_naics AS sug, suggested_description AS descr FROM results), m1 AS ({merge_step('m0', 'EDGAR', 3)}), m2 AS ({merge_step('m1', 'SAM', 5)})"
USELESS = "('SCRAPE_FAILED', 'NO_WEBSITE', '')"

def near_twin(block: str, threshold: int) -> str:
    """All pairs of a block: lengths and DuckDB's own edit distance leave few, whose common subsequence is folded over the
    letters of one name as bits of the other."""
    words = lambda c: f"array_to_string(list_sort(list_filter(regexp_split_to_array(lower({c}), '\\s+'), lambda w: w <> '')), ' ')"
    return f"""WITH l AS (SELECT p_partkey AS key, {block} AS block, {words('p_name')} AS a FROM part WHERE p_partkey % 2 = 0 AND length(p_name) >= 3),
r AS (SELECT {block} AS block, {words("p_name || 's'")} AS b, min(p_partkey) AS match FROM part WHERE p_partkey % 2 = 1 GROUP BY 1, 2),
n AS (SELECT DISTINCT block, a FROM l),
p AS (SELECT block, a, b, match FROM n JOIN r USING (block) WHERE 200 * least(length(a), length(b)) >= {threshold} * (length(a) + length(b)) AND 100 * levenshtein(a, b) <= (100 - {threshold}) * (length(a) + length(b))),
m AS (SELECT *, (1::HUGEINT << length(a)::INT) - 1 AS whole,
 list_transform(string_split(b, ''), lambda c: coalesce(list_sum(list_transform(range(length(a)), lambda i: CASE WHEN a[i + 1] = c THEN 1::HUGEINT << i::INT ELSE 0::HUGEINT END)), 0)::HUGEINT) AS masks FROM p),
s AS (SELECT *, 200.0::DOUBLE * (length(a) - bit_count(list_reduce(list_prepend(whole, masks), lambda v, x: ((v + (v & x)) | (v - (v & x))) & whole))) / (length(a) + length(b)) AS score FROM m),
best AS (SELECT block, a, match, score FROM s WHERE score >= {threshold} QUALIFY row_number() OVER (PARTITION BY block, a ORDER BY score DESC, match) = 1)
SELECT key, match, round(score, 6) AS score FROM l JOIN best USING (block, a)"""


QUERIES = {
    "q_classify_first_match": lambda spark, sf_dir: classified(spark, sf_dir).select(*CLASSES),
    "q_top_corrections": lambda spark, sf_dir: reports.top_changes(classified(spark, sf_dir)),
    "q_route_uncertain": lambda spark, sf_dir: enrich.routed(enrich.classify(flagged(spark, sf_dir))).select("id", "n_flags", "match_status", "confidence"),
    "q_sample_diverse": lambda spark, sf_dir: enrich.diverse(flagged(spark, sf_dir)).select("id", "n_flags", company_key(F.col("company_name"), F.col("establishment_name")).alias("company")),
    "q_seed_prior": seeded,
    "q_crosswalk_precedence": crosswalked,
    "q_contractor_verdict": contractors,
    "q_priority_merge": lambda spark, sf_dir: merged(spark, sf_dir).select("id", "scrape_match_status", "suggested_naics", "suggested_description"),
    "q_status_diff": status_diff,
    "q_best_of_company": lambda spark, sf_dir: enrich.best_of_company(derived(spark, sf_dir, "results")).select("name_key", "enrichment.scrape_match_status", "enrichment.suggested_naics"),
    "q_fanout": fan_out,
    "q_known_companies": known,
    "q_fuzzy_bucket": near_names,
    "q_fuzzy_global": lambda s, d: near_names(s, d, None),
    "q_fuzzy_bounds": near_bounds,
}
ORACLES = {
    "q_classify_first_match": with_sources(f"WITH {q.FLAGGED}, {q.CLASSIFIED} SELECT {', '.join(CLASSES)} FROM classified", "records", "codes", "rates"),
    "q_top_corrections": with_sources(f"WITH {q.FLAGGED}, {q.CLASSIFIED} SELECT naics_code, naics_verified, count(*) AS n FROM classified WHERE match_status = 'CORRECTED' GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 20", "records", "codes", "rates"),
    "q_route_uncertain": with_sources(f"WITH {q.FLAGGED}, {q.CLASSIFIED} SELECT id, n_flags, 'UNCERTAIN' AS match_status, 'low' AS confidence FROM classified WHERE match_status <> 'CORRECTED' AND (n_flags >= 2 OR (n_flags = 1 AND {HARD}))", "records", "codes", "rates"),
    "q_sample_diverse": with_sources(
        f"WITH {q.FLAGGED} SELECT id, n_flags, {KEY} AS company FROM flagged WHERE trim({q.FIRM}) <> '' QUALIFY row_number() OVER (PARTITION BY lower(trim({q.FIRM})) ORDER BY n_flags DESC, ord) = 1", "records", "codes", "rates"
    ),
    "q_seed_prior": with_sources(
        f"""WITH p AS (SELECT *, lower(trim(company_name)) AS cn, lower(trim(city)) AS ct FROM results WHERE year IN ('1997', '1998') AND trim(company_name) <> '' AND trim(city) <> ''),
s AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY cn, ct ORDER BY (scrape_match_status IN {USELESS})::INT, CASE year WHEN '1998' THEN 0 ELSE 1 END, ord) = 1)
SELECT t.id, s.id IS NOT NULL AS seeded, CASE WHEN s.id IS NULL THEN NULL WHEN s.scrape_match_status IN {USELESS} THEN s.scrape_match_status
 WHEN regexp_matches(s.scrape_match_status, '^(KC|EDGAR|SAM)_') THEN CASE WHEN s.scraped_keywords = '' THEN 'SCRAPE_FAILED' WHEN s.suggested_naics <> '' AND s.suggested_naics = t.naics_code THEN 'CONFIRMED' WHEN s.suggested_naics <> '' THEN 'SUGGESTED' ELSE 'UNCERTAIN' END
 WHEN t.naics_code = s.naics_code THEN s.scrape_match_status WHEN s.suggested_naics <> '' AND s.suggested_naics = t.naics_code THEN 'CONFIRMED' WHEN s.scrape_match_status = 'CONFIRMED' THEN 'SUGGESTED' ELSE s.scrape_match_status END AS scrape_match_status, s.suggested_naics
FROM records AS t LEFT JOIN s ON lower(trim(t.company_name)) = cn AND lower(trim(t.city)) = ct WHERE t.year = '1999'""",
        "records", "results",
    ),
    "q_crosswalk_precedence": with_sources(
        """WITH w AS (SELECT substring(code, 1, 3) AS sic, code, arg_min(title, vintage) AS title FROM codes WHERE length(code) = 6 GROUP BY 1, 2), r AS (SELECT id, naics_code, CASE WHEN ord % 4 <> 0 THEN substring(naics_code, 1, 3) END AS sic FROM records),
j AS (SELECT r.id, r.sic, w.code, w.title, CASE WHEN w.code = r.naics_code THEN 1 WHEN substring(w.code, 1, 4) = substring(r.naics_code, 1, 4) THEN 2 ELSE 3 END AS how FROM r LEFT JOIN w ON r.sic = w.sic),
b AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY id ORDER BY CASE WHEN code IS NULL THEN 9 ELSE how END, code) = 1)
SELECT id, CASE WHEN sic IS NULL THEN 'EDGAR_NOT_FOUND' WHEN code IS NULL THEN 'EDGAR_SIC_NO_CROSSWALK' WHEN how = 1 THEN 'EDGAR_CONFIRMED' ELSE 'EDGAR_SUGGESTED' END AS scrape_match_status, coalesce(code, '') AS suggested_naics, coalesce(title, '') AS suggested_description FROM b""",
        "records", "codes",
    ),
    "q_contractor_verdict": with_sources(
        """WITH c AS (SELECT id, naics_code AS r, CASE WHEN ord % 2 = 0 THEN suggested_naics ELSE '' END AS p, CASE WHEN ord % 3 = 0 THEN [] ELSE list_concat(['238220'], CASE WHEN length(naics_code) >= 6 THEN [substring(naics_code, 1, 6)] ELSE [] END) END AS l FROM results)
SELECT id, CASE WHEN p = '' AND len(l) = 0 THEN 'SAM_NO_NAICS' WHEN p = r OR list_contains(l, r) THEN 'SAM_CONFIRMED' ELSE 'SAM_SUGGESTED' END AS match_status,
 CASE WHEN p = '' AND len(l) = 0 THEN '' WHEN p = r OR list_contains(l, r) THEN r WHEN p <> '' THEN p ELSE l[1] END AS suggested_naics, CASE WHEN p = '' AND len(l) = 0 THEN 'low' WHEN p = r OR list_contains(l, r) THEN 'high' ELSE 'medium' END AS confidence FROM c""",
        "results",
    ),
    "q_priority_merge": with_sources(f"WITH {MERGED} SELECT id, st AS scrape_match_status, sug AS suggested_naics, descr AS suggested_description FROM m2", "results"),
    "q_status_diff": with_sources(
        f"WITH {MERGED}, b AS (SELECT st, count(*) AS n FROM m0 GROUP BY 1), a AS (SELECT st, count(*) AS n FROM m2 GROUP BY 1) SELECT coalesce(a.st, b.st) AS status, coalesce(b.n, 0) AS before, coalesce(a.n, 0) AS after, coalesce(a.n, 0) - coalesce(b.n, 0) AS diff FROM a FULL JOIN b ON a.st = b.st",
        "results",
    ),
    "q_best_of_company": with_sources(f"SELECT {KEY} AS name_key, scrape_match_status, suggested_naics FROM results WHERE {KEY} <> '' QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY {CHOICE} DESC, ord) = 1", "results"),
    "q_fanout": with_sources(
        f"""WITH seen AS (SELECT * FROM results WHERE year <= '1997'), best AS (SELECT {KEY} AS k, * FROM seen WHERE {KEY} <> '' QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY {CHOICE} DESC, ord) = 1),
last AS (SELECT DISTINCT code FROM codes), r AS (SELECT id, naics_code, {KEY} AS k FROM records WHERE year > '1997')
SELECT id, scrape_match_status, suggested_naics, website_url, naics_code_status FROM seen UNION ALL
SELECT r.id, scrape_match_status, suggested_naics, website_url, CASE WHEN r.naics_code = '' THEN naics_code_status WHEN length(r.naics_code) = 6 AND r.naics_code IN (SELECT code FROM last) THEN 'current'
 WHEN {' OR '.join(f'substring(r.naics_code, 1, {n}) IN (SELECT code FROM last)' for n in (5, 4, 3, 2))} THEN 'retired' ELSE 'invalid' END FROM r JOIN best ON r.k = best.k""",
        "results", "records", "codes",
    ),
    "q_known_companies": with_sources(
        r"""WITH h AS (SELECT *, regexp_replace(lower(regexp_extract(website_url, '^[A-Za-z]+://([^/:?#]*)', 1)), '^www\.', '') AS host FROM results),
j AS (SELECT *, scrape_match_status IN ('UNCERTAIN', 'SCRAPE_FAILED', 'SUGGESTED') AND (host IN ('yelp.com', 'dnb.com') OR suffix(host, '.yelp.com') OR suffix(host, '.dnb.com')) AS junk FROM h),
k AS (SELECT id, naics_code, CASE WHEN junk THEN 'SCRAPE_FAILED' ELSE scrape_match_status END AS st, CASE WHEN junk THEN '' ELSE suggested_naics END AS sug, CASE WHEN junk THEN '' ELSE website_url END AS url,
 CASE WHEN starts_with(lower(company_name), 'bolt') THEN 'bolt' WHEN contains(lower(company_name), 'eagle') AND contains(lower(establishment_name), 'hotel') THEN 'eagle-h' WHEN contains(lower(company_name), 'eagle') THEN 'eagle' END AS kc FROM j),
t AS (SELECT *, kc IS NOT NULL AND st IN ('SCRAPE_FAILED', 'UNCERTAIN', 'NO_WEBSITE') AS takes, CASE kc WHEN 'bolt' THEN ['332722', '238220'] WHEN 'eagle-h' THEN ['721110'] ELSE ['551112'] END AS codes FROM k)
SELECT id, CASE WHEN takes AND list_contains(codes, naics_code) THEN 'KC_CONFIRMED' WHEN takes THEN 'KC_SUGGESTED' ELSE st END AS scrape_match_status, CASE WHEN takes AND list_contains(codes, naics_code) THEN naics_code WHEN takes THEN codes[1] ELSE sug END AS suggested_naics, url AS website_url, CASE WHEN takes THEN kc END AS company_id FROM t""",
        "results",
    ),
    "q_fuzzy_bucket": near_twin("p_brand", 85),
    "q_fuzzy_global": near_twin("''", 80),
    "q_fuzzy_bounds": "WITH n AS (SELECT DISTINCT p_brand, p_name FROM part) SELECT a.p_brand, a.p_name AS a, b.p_name AS b, levenshtein(a.p_name, b.p_name)::INT AS edits FROM n a JOIN n b ON a.p_brand = b.p_brand AND a.p_name < b.p_name WHERE levenshtein(a.p_name, b.p_name) <= 2",
}
