"""Report queries, by year of the derived records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatework.functions import fixed
from gatework.operators import reports, validation
from gatework.plans import sqltext as q
from gatework.plans.assessing import contradicted, material, triaged
from gatework.plans.derived import derived, with_sources
from gatework.plans.gating import flagged

#: All years of the derived records.
YEARS = ["1995", "1996", "1997", "1998", "1999", "2000", "2001"]
HALF = len(YEARS) // 2


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def real_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contradicted(spark, sf_dir).where("outcome = 'contradiction'")


def allotted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return validation.allocation(docs.groupBy(F.col("lang").alias("tier")).agg(F.count("*").alias("n")), 50)


def sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty documents by language, allotted by share, drawn by hash."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("lang").alias("tier"))
    return validation.stratified(docs, allotted(spark, sf_dir).select("tier", "allotted"), "tier", 202606)


def reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as reviews: quality is the truth, toxic what was suggested."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    strata = F.element_at(F.array(*map(F.lit, fixed.STRATA)), (F.col("doc_id") % 5 + 1).cast("int"))
    code = lambda c: F.when(F.col("doc_id") % 11 == 0, "UNK").when(F.col("doc_id") % 13 == 0, "").otherwise(F.concat(F.lit("54194"), c.cast("string"), F.when(F.col("doc_id") % 2 == 0, ".0").otherwise("")))
    return labels.select(strata.alias("stratum"), code(F.col("quality")).alias("reviewer_naics"), F.lit("541941").alias("reported_naics"), F.concat(F.lit("54194"), F.col("toxic").cast("string")).alias("suggested_naics"))


def sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reviewers would get for all results."""
    rows = triaged(spark, sf_dir)
    sample = rows.select("id", "suggested_naics", "triage_tier", F.element_at(F.array(*map(F.lit, fixed.STRATA)), (F.col("ord") % 5 + 1).cast("int")).alias("stratum"))
    return validation.review_sheet(sample, derived(spark, sf_dir, "records")).drop("reviewer_naics", "reviewer_notes")


def half_mean(column: str, years: list[str]) -> str:
    return f"(({' + '.join(f'{column}{y}' for y in years)}) / {len(years)}.0::DOUBLE)"


def both(spark: SparkSession, sf_dir: str):
    return flagged(spark, sf_dir), YEARS


ALL = ("records", "codes", "rates", "results")
PER = ", ".join
SECTOR = q.report_sector("naics_code")
SY = f"sy AS (SELECT {SECTOR} AS sector, year, sum(n_flags)::BIGINT AS flagged, count(*) AS total, sum(n_flags) / count(*)::DOUBLE AS rate FROM flagged WHERE {SECTOR} <> '' GROUP BY 1, 2), sr AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY rate DESC, sector) AS rank FROM sy)"
OVERVIEW = f"""f AS (SELECT year, count(*) AS total_records, count(*) FILTER (n_flags > 0) AS total_flagged FROM flagged GROUP BY 1),
t AS (SELECT year, count(*) AS triage_rows, count(*) FILTER ({q.GROUP} = 'AUTO-RESOLVE') AS auto_resolved, count(*) FILTER ({q.GROUP} = 'HUMAN REVIEW') AS human_review, count(*) FILTER ({q.GROUP} = 'NO DATA') AS no_data FROM triaged GROUP BY 1),
m AS (SELECT year, count(*) AS assessed, count(*) FILTER (materiality_class = 'MATERIAL') AS material_count FROM material GROUP BY 1),
o AS (SELECT f.*, triage_rows, auto_resolved, human_review, no_data, assessed, material_count, round(total_flagged / total_records::DOUBLE, 9) AS flag_rate, round(auto_resolved / triage_rows::DOUBLE, 9) AS auto_resolve_pct, round(material_count / assessed::DOUBLE, 9) AS material_pct FROM f JOIN t USING (year) JOIN m USING (year))"""
FULL = f"{q.FLAGGED}, {q.SCORED}, {q.TRIAGED}, {q.MATERIAL}"
TREND = "CASE WHEN {b} > {a} * 1.1::DOUBLE THEN 'increasing' WHEN {b} < {a} * 0.9::DOUBLE THEN 'decreasing' ELSE 'stable' END"
A, B = q.report_sector("naics_code", "Unknown"), q.report_sector("suggested_naics", "Unknown")
ALLOT = """c AS (SELECT lang AS tier, count(*) AS n FROM documents GROUP BY 1), r AS (SELECT tier, n, n::DOUBLE / sum(n) OVER () * (50 - 2 * count(*) OVER ()) AS raw, 50 - 2 * count(*) OVER () AS rest FROM c),
w AS (SELECT *, floor(raw) AS whole, row_number() OVER (ORDER BY raw - floor(raw) DESC, tier) AS k FROM r), allot AS (SELECT tier, n, (2 + whole + (k <= rest - sum(whole) OVER ())::INT)::BIGINT AS allotted FROM w)"""
STRATA = f"{q.array(fixed.STRATA)}[doc_id % 5 + 1]"
POOL = "CASE stratum " + " ".join(f"WHEN '{k}' THEN {p}" for k, (_, p) in fixed.STRATA.items()) + " END"
METRICS = f"""v AS (SELECT {STRATA} AS stratum, '54194' || quality AS truth, '54194' || toxic AS sug FROM labels WHERE doc_id % 11 <> 0 AND doc_id % 13 <> 0),
s AS (SELECT stratum, count(*) AS n_scored, {POOL} AS pool_size, round(count(*) FILTER (truth = '541941') / count(*)::DOUBLE, 4) AS reported_accuracy, count(*) FILTER (truth = '541941') AS n_reported_correct, count(*) FILTER (truth <> '541941') AS n_reported_wrong, count(*) FILTER (truth = sug) AS ok FROM v GROUP BY 1),
strata AS (SELECT stratum, n_scored, pool_size, reported_accuracy, n_reported_correct, n_reported_wrong, CASE WHEN stratum IN ('AUTO_RESOLVED', 'MANUAL_REVIEW') THEN round(ok / n_scored::DOUBLE, 4) END AS suggestion_accuracy, CASE WHEN stratum IN ('AUTO_RESOLVED', 'MANUAL_REVIEW') THEN ok END AS n_suggestion_correct,
 CASE WHEN stratum = 'CLEAN' THEN n_reported_wrong END AS false_negatives, CASE WHEN stratum NOT IN ('CLEAN', 'NO_DATA') THEN n_reported_correct END AS false_positives, CASE WHEN stratum NOT IN ('CLEAN', 'NO_DATA') THEN n_reported_wrong END AS true_positives FROM s)"""

QUERIES = {
    "q_r1_overview": lambda s, d: rounded(reports.overview(flagged(s, d), triaged(s, d), material(s, d))),
    "q_r2_flag_prevalence": lambda s, d: reports.flag_prevalence(*both(s, d)),
    "q_r3_tiers": lambda s, d: reports.tier_distribution(triaged(s, d), YEARS),
    "q_r4_persistent": lambda s, d: rounded(reports.persistent_entities(flagged(s, d))),
    "q_r5_stability": lambda s, d: rounded(reports.sector_stability(*both(s, d))),
    "q_r5b_flows": lambda s, d: rounded(reports.sector_flows(real_contradictions(s, d), flagged(s, d))),
    "q_r6_states": lambda s, d: rounded(reports.state_patterns(*both(s, d))),
    "q_r7_materiality_grid": lambda s, d: rounded(reports.materiality_grid(material(s, d), YEARS)),
    "q_r8_sector_pairs": lambda s, d: reports.sector_pairs(real_contradictions(s, d)),
    "q_r9_flag_trend": lambda s, d: rounded(reports.flag_trend(flagged(s, d), triaged(s, d), material(s, d), real_contradictions(s, d))),
    "q_r10_sizes": lambda s, d: rounded(reports.size_patterns(*both(s, d)).drop("place")),
    "q_r11_trends": lambda s, d: rounded(reports.sector_trends(*both(s, d))),
    "q_allocation": allotted,
    "q_stratified_sample": lambda s, d: sampled(s, d).select("id", "tier"),
    "q_review_sheet": sheet,
    "q_validation_strata": lambda s, d: validation.stratum_metrics(reviewed(s, d)),
    "q_validation_metrics": lambda s, d: rounded(validation.overall_metrics(validation.stratum_metrics(reviewed(s, d)))),
}
ORACLES = {
    "q_r1_overview": with_sources(f"WITH {FULL}, {OVERVIEW} SELECT * FROM o", *ALL),
    "q_r2_flag_prevalence": with_sources(
        f"WITH {q.FLAGGED}, l AS ({' UNION ALL '.join(f'SELECT {q.quoted(label)} AS flag_name, year, {c} AS v FROM flagged' for c, label in fixed.FLAGS.items())}), "
        f"w AS (SELECT flag_name, {PER(f'sum(v) FILTER (year = {q.quoted(y)})::BIGINT AS count_{y}' for y in YEARS)} FROM l GROUP BY 1) SELECT *, {TREND.replace('{a}', half_mean('count_', YEARS[:HALF])).replace('{b}', half_mean('count_', YEARS[HALF:]))} AS trend_direction FROM w",
        "records", "codes", "rates",
    ),
    "q_r3_tiers": with_sources(
        f"WITH {q.SCORED}, {q.TRIAGED} SELECT triage_tier AS tier, CASE triage_tier {' '.join(f'WHEN {q.quoted(t)} THEN {q.quoted(n)}' for t, n in fixed.TIER_NOTES.items())} ELSE '' END AS description, {PER(f'count(*) FILTER (year = {q.quoted(y)}) AS count_{y}' for y in YEARS)} FROM triaged GROUP BY 1",
        "results", "codes",
    ),
    "q_r4_persistent": with_sources(
        f"""WITH {q.FLAGGED}, x AS (SELECT trim(ein) AS ein, year, n_flags, CASE WHEN trim(company_name) <> '' THEN trim(company_name) ELSE trim(establishment_name) END AS name, naics_code, ord FROM flagged WHERE n_flags > 0 AND trim(ein) <> ''),
y AS (SELECT ein, year, arg_min(name, ord) FILTER (name <> '') AS name FROM x GROUP BY 1, 2), z AS (SELECT ein, arg_max(name, year) FILTER (name IS NOT NULL) AS company_name FROM y GROUP BY 1),
c AS (SELECT ein, count(DISTINCT year) AS years_flagged, sum(n_flags)::BIGINT AS total_flags, list_sort(list(DISTINCT naics_code) FILTER (naics_code <> '')) AS codes FROM x GROUP BY 1)
SELECT c.ein, coalesce(company_name, '') AS company_name, array_to_string(codes, '; ') AS naics_codes, years_flagged, total_flags, round(total_flags / years_flagged::DOUBLE, 9) AS flags_per_year,
 array_to_string(list_sort(list_distinct(list_filter(list_transform(codes, lambda k: CASE substring(k, 1, 2) {' '.join(f"WHEN '{s}' THEN '{n}'" for s, n in fixed.REPORT_NAMES.items())} END), lambda n: n IS NOT NULL))), '; ') AS sectors_seen
FROM c JOIN z ON c.ein = z.ein ORDER BY years_flagged DESC, total_flags DESC, c.ein LIMIT 20""",
        "records", "codes", "rates",
    ),
    "q_r5_stability": with_sources(
        f"""WITH {q.FLAGGED}, {SY}, k AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY year) AS t, rank() OVER (PARTITION BY sector ORDER BY rank) AS own FROM sr WHERE year IN {q.listed(YEARS)})
SELECT sector, round(avg(rank), 9) AS mean_rank, round(sum(rate) / {len(YEARS)}, 9) AS mean_rate, CASE WHEN max(rank) - min(rank) <= 2 THEN 'Very Stable' WHEN max(rank) - min(rank) <= 5 THEN 'Stable' WHEN max(rank) - min(rank) <= 10 THEN 'Moderate' ELSE 'Volatile' END AS consistency,
 CASE WHEN count(*) >= 3 THEN round(1.0::DOUBLE - 6.0::DOUBLE * sum((rank - t) * (rank - t))::DOUBLE / (count(*) * (count(*) * count(*) - 1)), 9) END AS rho_raw, CASE WHEN count(*) >= 3 AND max(own) > min(own) THEN round(corr(own, t), 9) END AS rho, {PER(f"coalesce(round(max(rate) FILTER (year = '{y}'), 9), 0) AS rate_{y}, max(rank) FILTER (year = '{y}') AS rank_{y}" for y in YEARS)} FROM k GROUP BY 1""",
        "records", "codes", "rates",
    ),
    "q_r5b_flows": with_sources(
        f"""WITH {q.FLAGGED}, {q.SCORED}, {q.CONTRADICTED}, p AS (SELECT {A} AS a, {B} AS b FROM contradicted WHERE outcome = 'contradiction' AND crosses_sector), p2 AS (SELECT * FROM p WHERE a <> b),
u AS (SELECT a AS sector, 1 AS o, 0 AS i, 0 AS f FROM p2 UNION ALL SELECT b, 0, 1, 0 FROM p2 UNION ALL SELECT {SECTOR}, 0, 0, n_flags FROM flagged WHERE n_flags > 0 AND {SECTOR} <> ''),
s AS (SELECT sector, sum(o)::BIGINT AS cross_sector_outflows, sum(i)::BIGINT AS cross_sector_inflows, sum(f)::BIGINT AS total_flagged FROM u GROUP BY 1)
SELECT *, cross_sector_inflows - cross_sector_outflows AS net_flow, CASE WHEN cross_sector_inflows > cross_sector_outflows THEN 'net importer' WHEN cross_sector_inflows < cross_sector_outflows THEN 'net exporter' ELSE 'balanced' END AS net_direction, CASE WHEN total_flagged > 0 THEN round(abs(cross_sector_inflows - cross_sector_outflows) / total_flagged::DOUBLE, 9) END AS distortion FROM s""",
        *ALL,
    ),
    "q_r6_states": with_sources(
        f"""WITH {q.FLAGGED}, w AS (SELECT upper(trim(state)) AS state, {PER(f"count(*) FILTER (year = '{y}') AS total_{y}, count(*) FILTER (year = '{y}' AND n_flags > 0) AS flagged_{y}" for y in YEARS)} FROM flagged WHERE trim(state) <> '' GROUP BY 1),
r AS (SELECT *, {PER(f"CASE WHEN total_{y} > 0 THEN flagged_{y} / total_{y}::DOUBLE ELSE 0 END AS r_{y}" for y in YEARS)} FROM w), a AS (SELECT *, ({' + '.join(f'r_{y}' for y in YEARS)}) / {len(YEARS)} AS m FROM r)
SELECT state, {PER(f'total_{y}, flagged_{y}, round(r_{y}, 9) AS rate_{y}' for y in YEARS)}, round(m, 9) AS avg_rate, round(sqrt(({' + '.join(f'(r_{y} - m) * (r_{y} - m)' for y in YEARS)}) / {len(YEARS)}), 9) AS std_dev, row_number() OVER (ORDER BY round(m, 12) DESC, state) AS rank FROM a""",
        "records", "codes", "rates",
    ),
    "q_r7_materiality_grid": with_sources(
        f"WITH {q.MATERIAL}, g AS (SELECT * FROM (VALUES {PER(f'({q.quoted(y)})' for y in YEARS)}) AS y(year), (VALUES {PER(f'({q.quoted(c)})' for c in fixed.MATERIALITY)}) AS c(materiality_class)), n AS (SELECT year, materiality_class, count(*) AS n FROM material GROUP BY 1, 2), j AS (SELECT g.*, coalesce(n, 0) AS count FROM g LEFT JOIN n USING (year, materiality_class)) SELECT *, round(CASE WHEN sum(count) OVER (PARTITION BY year) > 0 THEN count / (sum(count) OVER (PARTITION BY year))::DOUBLE ELSE 0 END, 9) AS pct FROM j",
        "results", "codes", "rates",
    ),
    "q_r8_sector_pairs": with_sources(f"WITH {q.SCORED}, {q.CONTRADICTED}, p AS (SELECT {A} AS reported_sector, {B} AS suggested_sector FROM contradicted WHERE outcome = 'contradiction') SELECT reported_sector, suggested_sector, count(*) AS count FROM p WHERE reported_sector <> suggested_sector GROUP BY 1, 2", "results", "codes"),
    "q_r9_flag_trend": with_sources(
        f"WITH {FULL}, {q.CONTRADICTED}, {OVERVIEW}, x AS (SELECT year, count(*) FILTER (crosses_sector) AS n FROM contradicted WHERE outcome = 'contradiction' GROUP BY 1) SELECT o.year, total_records, total_flagged AS flagged, flag_rate, material_pct AS material_rate, coalesce(x.n, 0) AS cross_sector_count, round(coalesce(x.n, 0) / total_flagged::DOUBLE, 9) AS cross_sector_rate FROM o LEFT JOIN x ON o.year = x.year",
        *ALL,
    ),
    "q_r10_sizes": with_sources(
        f"""WITH {q.FLAGGED}, e AS (SELECT *, try_cast(annual_average_employees AS DOUBLE) AS n FROM flagged), b AS (SELECT *, CASE WHEN n < 10 THEN '<10' WHEN n < 50 THEN '10-49' WHEN n < 250 THEN '50-249' WHEN n < 500 THEN '250-499' WHEN n IS NOT NULL THEN '500+' END AS bucket FROM e),
w AS (SELECT k.bucket AS size_bucket, {PER(f"count(*) FILTER (year = '{y}') AS total_{y}, count(*) FILTER (year = '{y}' AND n_flags > 0) AS flagged_{y}" for y in YEARS)} FROM (VALUES {PER(f"('{x}')" for x in fixed.SIZE_BUCKETS)}) AS k(bucket) LEFT JOIN b ON k.bucket = b.bucket GROUP BY 1)
SELECT *, {PER(f"round(CASE WHEN total_{y} > 0 THEN flagged_{y} / total_{y}::DOUBLE ELSE 0 END, 9) AS rate_{y}" for y in YEARS)} FROM w""",
        "records", "codes", "rates",
    ),
    "q_r11_trends": with_sources(
        f"WITH {q.FLAGGED}, {SY}, w AS (SELECT sector, {PER(f'coalesce(max(rate) FILTER (year = {q.quoted(y)}), 0) AS r_{y}' for y in YEARS)} FROM sr GROUP BY 1) SELECT sector, {PER(f'round(r_{y}, 9) AS rate_{y}' for y in YEARS)}, round(({' + '.join(f'r_{y}' for y in YEARS)}) / {len(YEARS)}, 9) AS mean_rate, {TREND.replace('{a}', half_mean('r_', YEARS[:HALF])).replace('{b}', half_mean('r_', YEARS[HALF:]))} AS direction FROM w",
        "records", "codes", "rates",
    ),
    "q_allocation": f"WITH {ALLOT} SELECT * FROM allot",
    "q_stratified_sample": f"WITH {ALLOT} SELECT doc_id AS id, lang AS tier FROM documents JOIN allot ON lang = tier QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('202606:' || doc_id), doc_id) <= allotted",
    "q_review_sheet": with_sources(
        f"""WITH {q.SCORED}, {q.TRIAGED}, s AS (SELECT *, {q.array(fixed.STRATA)}[ord % 5 + 1] AS stratum FROM triaged)
SELECT id, stratum, establishment_name, company_name, CASE WHEN city <> '' AND state <> '' AND zip_code <> '' THEN street_address || ', ' || city || ', ' || state || ' ' || zip_code ELSE array_to_string(list_filter([street_address, city, state, zip_code], lambda x: x <> ''), ', ') END AS full_address, industry_description, naics_code AS reported_naics,
 CASE WHEN suggested_naics <> '' THEN coalesce(try_cast(try_cast(suggested_naics AS DOUBLE) AS BIGINT)::VARCHAR, suggested_naics) WHEN stratum = 'CLEAN' THEN 'No flags raised' WHEN stratum = 'FLAGGED_NOT_PROMOTED' THEN 'Flagged but not promoted to triage' WHEN triage_tier = 'T5_NO_ALTERNATIVE' THEN 'No web presence found'
 WHEN triage_tier = 'T5e_WEBSITE_UNSCRAPEABLE' THEN 'Website found but unscrapeable' WHEN triage_tier = 'T5f_NO_NAICS_SIGNAL' THEN 'Website scraped, no NAICS signal' ELSE 'No suggestion available' END AS suggested_naics FROM s""",
        "results", "codes",
    ),
    "q_validation_strata": f"WITH {METRICS} SELECT * FROM strata",
    "q_validation_metrics": f"""WITH {METRICS}, a AS (SELECT coalesce(sum(true_positives), 0)::DOUBLE AS tp, coalesce(sum(false_positives), 0)::DOUBLE AS fp, coalesce(sum(false_negatives), 0)::DOUBLE AS fn, coalesce(sum(true_positives * (pool_size / n_scored::DOUBLE)), 0) AS wtp, coalesce(sum(false_negatives * (pool_size / n_scored::DOUBLE)), 0) AS wfn, sum(pool_size / {sum(p for _, p in fixed.STRATA.values())}.0::DOUBLE * reported_accuracy) AS acc FROM strata)
SELECT tp, fp, fn, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(wtp / (wtp + wfn), 9) AS weighted_recall, round(acc, 9) AS weighted_accuracy FROM a""",
}
