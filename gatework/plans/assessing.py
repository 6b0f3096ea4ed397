"""Assessment queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatework.functions.codes import canonical, overlap_score, sector, sector_name
from gatework.functions.text import description_tokens
from gatework.operators import assess, enrich, lookup
from gatework.plans import sqltext as q
from gatework.plans.derived import derived, with_sources
from gatework.plans.gating import codes, flagged


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.first_titles(derived(spark, sf_dir, "codes"))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefixes on a target list: four digits of every ninth code."""
    return derived(spark, sf_dir, "codes").where("length(code) = 6 and cast(code as bigint) % 9 = 0").selectExpr("substring(code, 1, 4) as t").distinct()


def material(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess.materiality(derived(spark, sf_dir, "results"), derived(spark, sf_dir, "rates"), targets(spark, sf_dir))


def contradicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess.contradictions(derived(spark, sf_dir, "results"), titles(spark, sf_dir))


def triaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess.triage(derived(spark, sf_dir, "results"), titles(spark, sf_dir), derived(spark, sf_dir, "rates"))


def token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct descriptions' tokens, and their overlap with those of a fixed text."""
    fixed_tokens = description_tokens(F.lit("hospital and nursing services, trucking of lumber"))
    d = derived(spark, sf_dir, "records").select("industry_description").distinct()
    return d.select("industry_description", F.array_join(description_tokens(F.col("industry_description")), " ").alias("tokens"), overlap_score(description_tokens(F.col("industry_description")), fixed_tokens).alias("score"))


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sector(F.col("naics_code"))
    return derived(spark, sf_dir, "records").groupBy(s.alias("sector")).agg(F.count("*").alias("n")).withColumns({"canonical": canonical(F.col("sector")), "name": sector_name(F.col("sector"))})


def resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all records, those up to 1999 with results."""
    results = derived(spark, sf_dir, "results").where("year <= '1999'")
    return assess.resolution(enrich.classify(flagged(spark, sf_dir)), results)


def newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess.batch_quality(assess.latest(derived(spark, sf_dir, "results"), 500), codes(spark, sf_dir))


NEW = "passed", "n", "actionable", "failed", "with_url", "empty_suggestions", "bad_suggestions"
QUALITY = """form AS (SELECT *, CASE WHEN suggested_naics = '' THEN 'empty' WHEN NOT regexp_full_match(suggested_naics, '[0-9]+') OR length(suggested_naics) <> 6 THEN 'bad' WHEN suggested_naics IN (SELECT code FROM valid) THEN 'valid' ELSE 'bad' END AS f FROM batch),
a AS (SELECT count(*) AS n, count(*) FILTER (scrape_match_status IN ('CONFIRMED', 'SUGGESTED')) AS actionable, count(*) FILTER (scrape_match_status = 'SCRAPE_FAILED') AS failed, count(*) FILTER (website_url <> '') AS with_url,
  count(*) FILTER (website_url <> '' AND f = 'empty') AS empty_suggestions, count(*) FILTER (f = 'bad') AS bad_suggestions FROM form),
b AS (SELECT *, actionable / n::DOUBLE AS actionable_rate, failed / n::DOUBLE AS failure_rate, empty_suggestions / with_url::DOUBLE AS empty_rate FROM a)
SELECT *, failure_rate <= 0.10 AND actionable_rate >= 0.25 AND bad_suggestions = 0 AS passed FROM b"""

QUERIES = {
    "q_materiality": lambda spark, sf_dir: material(spark, sf_dir).select("id", "reported_dart_rate", "suggested_dart_rate", F.round("dart_ratio", 9).alias("dart_ratio"), "crosses_sector", "materiality_class"),
    "q_materiality_gaps": lambda spark, sf_dir: (lambda s: s.select(*[F.round(c, 9).alias(c) if c != "n" else F.col(c) for c in s.columns]))(assess.gap_summary(material(spark, sf_dir).withColumn("dart_ratio", F.round("dart_ratio", 9)))),
    "q_contradiction": lambda spark, sf_dir: contradicted(spark, sf_dir).select("id", "outcome", F.round("r_score", 9).alias("r_score"), F.round("s_score", 9).alias("s_score"), "reported_overlap", "suggested_overlap", "crosses_sector"),
    "q_nuggets": lambda spark, sf_dir: assess.nuggets(contradicted(spark, sf_dir).withColumn("score_gap", F.round("score_gap", 9))).select("id", "score_gap"),
    "q_token_overlap": lambda spark, sf_dir: token_overlap(spark, sf_dir).withColumn("score", F.round("score", 9)),
    "q_consistent_companies": lambda spark, sf_dir: assess.consistent_companies(derived(spark, sf_dir, "results")),
    "q_triage_ladder": lambda spark, sf_dir: triaged(spark, sf_dir).select("id", "triage_tier"),
    "q_triage_reasons": lambda spark, sf_dir: triaged(spark, sf_dir).select("id", "triage_tier", "triage_reason"),
    "q_tier_group": lambda spark, sf_dir: triaged(spark, sf_dir).groupBy("triage_tier").agg(F.count("*").alias("n")).withColumn("tier_group", assess.tier_group(F.col("triage_tier"))),
    "q_resolution_summary": resolution,
    "q_batch_qa": lambda spark, sf_dir: assess.batch_quality(derived(spark, sf_dir, "results"), codes(spark, sf_dir)),
    "q_batch_qa_latest": newest,
    "q_sectors": sectors,
}
ORACLES = {
    "q_materiality": with_sources(f"WITH {q.MATERIAL} SELECT id, reported_dart_rate, suggested_dart_rate, round(dart_ratio, 9) AS dart_ratio, crosses_sector, materiality_class FROM material", "results", "codes", "rates"),
    "q_materiality_gaps": with_sources(
        f"""WITH {q.MATERIAL}, g AS (SELECT list_sort(list(round(dart_ratio, 9))) AS v FROM material WHERE dart_ratio IS NOT NULL), k AS (SELECT v, len(v) AS n FROM g)
SELECT n, round(list_sum(v) / n, 9) AS mean, round((v[(n - 1) // 2 + 1] + v[n // 2 + 1]) / 2, 9) AS median, v[n // 4 + 1] AS p25, v[n * 3 // 4 + 1] AS p75, v[n * 9 // 10 + 1] AS p90 FROM k""",
        "results", "codes", "rates",
    ),
    "q_contradiction": with_sources(
        f"WITH {q.SCORED}, {q.CONTRADICTED} SELECT id, outcome, round(r_score, 9) AS r_score, round(s_score, 9) AS s_score, array_to_string(list_sort(list_intersect(desc_tk, r_tk)), ', ') AS reported_overlap, array_to_string(list_sort(list_intersect(desc_tk, s_tk)), ', ') AS suggested_overlap, crosses_sector FROM contradicted",
        "results", "codes",
    ),
    "q_nuggets": with_sources(f"WITH {q.SCORED}, {q.CONTRADICTED} SELECT id, round(score_gap, 9) AS score_gap FROM contradicted WHERE outcome = 'contradiction' AND round(score_gap, 9) >= 0.10 ORDER BY 2 DESC, id LIMIT 40", "results", "codes"),
    "q_token_overlap": with_sources(
        f"WITH t AS (SELECT DISTINCT industry_description FROM records), u AS (SELECT industry_description, {q.tokens('industry_description')} AS tk, {q.tokens(q.quoted('hospital and nursing services, trucking of lumber'))} AS other FROM t) SELECT industry_description, array_to_string(tk, ' ') AS tokens, round(CASE WHEN len(tk) > 0 THEN len(list_intersect(tk, other)) / len(tk)::DOUBLE ELSE 0 END, 9) AS score FROM u",
        "records",
    ),
    "q_consistent_companies": with_sources(f"WITH {q.CONSISTENT} SELECT * FROM consistent", "results"),
    "q_triage_ladder": with_sources(f"WITH {q.SCORED}, {q.TRIAGED} SELECT id, triage_tier FROM triaged", "results", "codes"),
    "q_triage_reasons": with_sources(f"WITH {q.SCORED}, {q.TRIAGED}, {q.REASONED} SELECT id, triage_tier, triage_reason FROM reasoned", "results", "codes", "rates"),
    "q_tier_group": with_sources(f"WITH {q.SCORED}, {q.TRIAGED} SELECT triage_tier, count(*) AS n, {q.GROUP} AS tier_group FROM triaged GROUP BY triage_tier", "results", "codes"),
    "q_resolution_summary": with_sources(
        f"""WITH {q.FLAGGED}, {q.CLASSIFIED}, web AS (SELECT id AS wid, scrape_match_status AS w FROM results WHERE year <= '1999')
SELECT CASE WHEN match_status = 'CORRECTED' THEN 'CORRECTED (keyword rule)' WHEN n_flags = 0 THEN 'CLEAN (0 flags)' WHEN n_flags = 1 AND match_status = 'CONFIRMED' THEN 'CONFIRMED (1 flag, classifier OK)'
 WHEN w IN ('CONFIRMED', 'EDGAR_CONFIRMED', 'SAM_CONFIRMED') THEN 'CONFIRMED (web/EDGAR/SAM)' WHEN w IN ('SUGGESTED', 'EDGAR_SUGGESTED', 'SAM_SUGGESTED') THEN 'SUGGESTED (needs review)' WHEN w = 'UNCERTAIN' THEN 'UNCERTAIN (inconclusive)'
 WHEN w IN ('SCRAPE_FAILED', 'NO_WEBSITE') THEN 'UNRESOLVED (no data)' WHEN w IS NOT NULL THEN 'OTHER (' || w || ')' ELSE 'UNCERTAIN (not in scrape results)' END AS resolution, count(*) AS n FROM classified LEFT JOIN web ON id = wid GROUP BY 1""",
        "records", "codes", "rates", "results",
    ),
    "q_batch_qa": with_sources(f"WITH {q.VALID}, batch AS (SELECT * FROM results), {QUALITY}", "results", "codes"),
    "q_batch_qa_latest": with_sources(f"WITH {q.VALID}, batch AS (SELECT * FROM results ORDER BY ord DESC LIMIT 500), {QUALITY}", "results", "codes"),
    "q_sectors": with_sources(
        f"SELECT substring(naics_code, 1, 2) AS sector, count(*) AS n, {q.canonical('min(naics_code)')} AS canonical, CASE substring(min(naics_code), 1, 2) {' '.join(f'WHEN {q.quoted(s)} THEN {q.quoted(n)}' for s, n in q.fixed.SECTOR_NAMES.items())} ELSE 'Sector ' || substring(min(naics_code), 1, 2) END AS name FROM records GROUP BY 1",
        "records",
    ),
}
