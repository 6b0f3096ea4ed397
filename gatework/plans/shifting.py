"""Queries on persistence and premiums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatework.functions import fixed
from gatework.operators import gates, persistence, premium
from gatework.plans import sqltext as q
from gatework.plans.derived import derived, with_sources
from gatework.plans.gating import codes
from gatework.plans.reporting import rounded
from gatework.sources.io import durable


def combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = derived(spark, sf_dir, "records")
    return persistence.combined(records, gates.code_gates(records, codes(spark, sf_dir)))


def yearly_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of each year: those of the table, a tenth higher a year."""
    years = derived(spark, sf_dir, "records").select("year").distinct()
    return derived(spark, sf_dir, "rates").crossJoin(years).select("year", "prefix", (F.col("value") + (F.col("year").cast("int") - 1995) / F.lit(10.0)).alias("value"))  # seven years


def shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return persistence.shifts(persistence.records_of_years(derived(spark, sf_dir, "records")), yearly_rates(spark, sf_dir))


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return persistence.persistence_summary(combined(spark, sf_dir), shifts(spark, sf_dir), keep=durable)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = derived(spark, sf_dir, "records").withColumn("state", F.when(F.col("state") != "", F.col("state")))
    suggestions = derived(spark, sf_dir, "results").select("id", "suggested_naics", F.lit("CA").alias("state"))
    return premium.scored(records, suggestions, premium.rate_table(spark))


COLUMNS = ["establishment_id", "ein", "company_name", "state", "year_from", "year_to", "naics_from", "naics_to", "sector_from", "sector_to", "shift_type", "dart_rate_from", "dart_rate_to", "dart_delta", "direction", "risk_tier", "employees"]
RATES = " ".join
FJ, FV, _ = q.cascade("f", "CASE WHEN regexp_full_match(naics_from, '[0-9]+') THEN naics_from END", (6, 4, 3, 2), "yr", " AND {t}.year = year_from")
TJ, TV, _ = q.cascade("t", "CASE WHEN regexp_full_match(naics_to, '[0-9]+') THEN naics_to END", (6, 4, 3, 2), "yr", " AND {t}.year = year_to")
COMBINED = """combined AS (SELECT *, CASE WHEN naics_code = '999999' THEN 'PLACEHOLDER_999999' WHEN naics_code = '000000' THEN 'PLACEHOLDER_000000' WHEN flag_invalid_naics_code = 1 THEN 'INVALID_CODE' WHEN regexp_full_match(naics_code, '[0-9]{1,5}') THEN 'INCOMPLETE_CODE' ELSE 'VALID' END AS error_type FROM flagged)"""
SHIFTS = f"""yr AS (SELECT y.year, prefix, value + (CAST(y.year AS INT) - 1995) / 10.0::DOUBLE AS value FROM rates, (SELECT DISTINCT year FROM records) AS y),
ey AS (SELECT * FROM records QUALIFY row_number() OVER (PARTITION BY establishment_id, year ORDER BY ord) = 1),
pr AS (SELECT establishment_id, lead(ein) OVER w AS ein, lead(CASE WHEN trim(company_name) <> '' THEN trim(company_name) ELSE establishment_name END) OVER w AS company_name, lead(state) OVER w AS state, year AS year_from, lead(year) OVER w AS year_to, naics_code AS naics_from, lead(naics_code) OVER w AS naics_to, lead(try_cast(annual_average_employees AS DOUBLE)) OVER w AS employees FROM ey WINDOW w AS (PARTITION BY establishment_id ORDER BY year)),
sh AS (SELECT pr.*, CASE WHEN length(naics_from) >= 2 THEN substring(naics_from, 1, 2) ELSE '' END AS sector_from, CASE WHEN length(naics_to) >= 2 THEN substring(naics_to, 1, 2) ELSE '' END AS sector_to, {FV} AS dart_rate_from, {TV} AS dart_rate_to FROM pr {FJ} {TJ} WHERE year_to IS NOT NULL),
shifts AS (SELECT *, CASE WHEN naics_from = naics_to THEN 'STABLE' WHEN sector_from <> sector_to THEN 'CROSS_SECTOR_SHIFT' ELSE 'WITHIN_SECTOR_SHIFT' END AS shift_type, round(dart_rate_to - dart_rate_from, 2) AS dart_delta, CASE WHEN dart_rate_from > dart_rate_to THEN 'DOWNWARD_SHIFT' WHEN dart_rate_to > dart_rate_from THEN 'UPWARD_SHIFT' WHEN dart_rate_from = dart_rate_to THEN 'LATERAL' ELSE 'UNKNOWN' END AS direction,
 CASE WHEN sector_to = '' THEN 'UNKNOWN' WHEN sector_to IN {q.listed(fixed.HIGH_RISK)} THEN 'HIGH' WHEN sector_to IN {q.listed(fixed.MEDIUM_RISK)} THEN 'MEDIUM' WHEN sector_to IN {q.listed(fixed.LOW_RISK)} THEN 'LOW' ELSE 'OTHER' END AS risk_tier FROM sh)"""
DOWN = "down AS (SELECT * FROM shifts WHERE shift_type <> 'STABLE' AND direction = 'DOWNWARD_SHIFT' AND ein IS NOT NULL)"
CHRONIC = """chronic AS (SELECT ein, substring(array_to_string(list_sort(list(DISTINCT trim(company_name)) FILTER (trim(company_name) <> '')), '; '), 1, 200) AS company_name, count(*) AS n_downshifts, count(DISTINCT establishment_id) AS n_establishments_affected, coalesce(sum(employees), 0) AS total_employees_affected, round(avg(dart_delta), 2) AS avg_dart_delta, round(min(dart_delta), 2) AS worst_dart_delta,
 array_to_string(list_sort(list_distinct(list_concat(list(year_from), list(year_to)))), ', ') AS years_active, coalesce(array_to_string(list_sort(list(DISTINCT state) FILTER (state <> '')), ', '), '') AS states FROM down GROUP BY ein HAVING count(*) >= 2)"""
REPORTERS = """reporters AS (SELECT ein, count(DISTINCT year) AS years_with_999999, count(*) AS total_establishments FROM combined WHERE error_type = 'PLACEHOLDER_999999' GROUP BY ein HAVING count(DISTINCT year) >= 2)"""
PREMIUM = f"""prem(sector, rate, dsc) AS (VALUES {', '.join(f"('{s}', {r}::DOUBLE, '{d}')" for s, _, r, d in fixed.PREMIUM_RATES)}),
joined AS (SELECT r.*, CASE WHEN r.state <> '' THEN r.state ELSE 'CA' END AS st, s.suggested_naics AS sug FROM records AS r JOIN results AS s ON r.id = s.id),
scored AS (SELECT j.*, substring(naics_code, 1, 2) AS reported_sector, substring(sug, 1, 2) AS suggested_sector, a.rate AS reported_rate, b.rate AS suggested_rate, coalesce(a.dsc, 'Unknown') AS reported_desc, coalesce(b.dsc, 'Unknown') AS suggested_desc, b.rate - a.rate AS rate_delta, least(coalesce(try_cast(annual_average_employees AS DOUBLE), 1), 50000) AS employees,
 abs(b.rate - a.rate) * least(coalesce(try_cast(annual_average_employees AS DOUBLE), 1), 50000) * 74580.0::DOUBLE / 100 AS estimated_annual_loss, CASE WHEN b.rate - a.rate > 0 THEN 'UNDERPAYING' WHEN b.rate - a.rate < 0 THEN 'OVERPAYING' ELSE 'SAME' END AS direction FROM joined AS j LEFT JOIN prem AS a ON substring(naics_code, 1, 2) = a.sector LEFT JOIN prem AS b ON substring(sug, 1, 2) = b.sector WHERE regexp_full_match(sug, '[0-9]{{5,6}}') AND sug <> naics_code)"""

QUERIES = {
    "q_error_types": lambda s, d: combined(s, d).groupBy("year", "error_type").agg(F.count("*").alias("n")),
    "q_yoy_shift": lambda s, d: rounded(shifts(s, d).select(*COLUMNS)),
    "q_chronic_down": lambda s, d: persistence.chronic_downshifters(shifts(s, d)),
    "q_persistent_placeholder": lambda s, d: persistence.placeholder_reporters(combined(s, d)),
    "q_persistence_summary": summary,
    "q_premium_mapping": lambda s, d: premium.mapped(derived(s, d, "records"), premium.rate_table(s)),
    "q_premium_delta": lambda s, d: premium.deltas(scored(s, d)).withColumn("rate_delta", F.round("rate_delta", 4)),
    "q_premium_top50": lambda s, d: rounded(premium.top_losses(scored(s, d)).select("id", "reported_sector", "suggested_sector", "employees", "estimated_annual_loss"), 4),
    "q_premium_summary": lambda s, d: rounded(premium.premium_summary(scored(s, d), derived(s, d, "records").count()), 4),
}
SUMS = ", ".join
ORACLES = {
    "q_error_types": with_sources(f"WITH {q.FLAGGED}, {COMBINED} SELECT year, error_type, count(*) AS n FROM combined GROUP BY 1, 2", "records", "codes", "rates"),
    "q_yoy_shift": with_sources(f"WITH {SHIFTS} SELECT {', '.join(f'round({c}, 9) AS {c}' if c.startswith('dart') or c == 'employees' else c for c in COLUMNS)} FROM shifts", "records", "rates"),
    "q_chronic_down": with_sources(f"WITH {SHIFTS}, {DOWN}, {CHRONIC} SELECT * FROM chronic", "records", "rates"),
    "q_persistent_placeholder": with_sources(
        f"""WITH {q.FLAGGED}, {COMBINED}, {REPORTERS}, n AS (SELECT * FROM combined WHERE error_type = 'PLACEHOLDER_999999'), y AS (SELECT ein, year, count(*) AS n FROM n GROUP BY 1, 2)
SELECT r.ein, (SELECT substring(CASE WHEN count(*) FILTER (trim(company_name) <> '') > 0 THEN array_to_string(list_sort(list(DISTINCT trim(company_name)) FILTER (trim(company_name) <> '')), '; ') ELSE array_to_string(list_sort(list(DISTINCT trim(establishment_name)) FILTER (trim(establishment_name) <> '')), '; ') END, 1, 200) FROM n WHERE n.ein = r.ein) AS company_name, years_with_999999,
 (SELECT count(DISTINCT year) FROM combined c WHERE c.ein = r.ein) AS years_present_total, (SELECT string_agg(year, ', ' ORDER BY year) FROM y WHERE y.ein = r.ein) AS years_list, total_establishments, (SELECT string_agg(year || ':' || n, '; ' ORDER BY year) FROM y WHERE y.ein = r.ein) AS establishments_per_year, (SELECT coalesce(array_to_string(list_sort(list(DISTINCT state) FILTER (state <> '')), ', '), '') FROM n WHERE n.ein = r.ein) AS states FROM reporters r""",
        "records", "codes", "rates",
    ),
    "q_persistence_summary": with_sources(
        f"""WITH {q.FLAGGED}, {COMBINED}, {REPORTERS}, {SHIFTS}, {DOWN}, {CHRONIC}, e AS (SELECT establishment_id, count(DISTINCT year) AS y FROM combined GROUP BY 1)
SELECT 'total_records' AS metric, count(*)::DOUBLE AS value FROM combined UNION ALL SELECT 'total_999999_all_years', count(*) FROM combined WHERE error_type = 'PLACEHOLDER_999999' UNION ALL SELECT 'eins_999999_multi_year', count(*) FROM reporters
UNION ALL SELECT 'establishments_999999_multi_year', count(DISTINCT establishment_id) FROM combined WHERE error_type = 'PLACEHOLDER_999999' AND ein IN (SELECT ein FROM reporters) UNION ALL SELECT 'total_cross_sector_shifts', count(*) FROM shifts WHERE shift_type = 'CROSS_SECTOR_SHIFT'
UNION ALL SELECT 'total_downward_shifts', count(*) FROM shifts WHERE shift_type <> 'STABLE' AND direction = 'DOWNWARD_SHIFT' UNION ALL SELECT 'chronic_downshifter_eins', count(*) FROM chronic UNION ALL SELECT 'establishments_in_all_years', count(*) FROM e WHERE y = 4 UNION ALL SELECT 'establishments_in_2plus_years', count(*) FROM e WHERE y >= 2""",
        "records", "codes", "rates",
    ),
    "q_premium_mapping": with_sources(
        f"""WITH t AS (SELECT * FROM (VALUES {', '.join(f'({q.quoted(s)}, {q.quoted(c)}, {r}::DOUBLE, {q.quoted(d)})' for s, c, r, d in fixed.PREMIUM_RATES)}) AS t(sector, class_code, rate, "desc"))
SELECT t.*, (SELECT count(*) FROM records WHERE substring(trim(naics_code), 1, 2) = t.sector) AS n_records FROM t""",
        "records",
    ),
    "q_premium_delta": with_sources(
        f"WITH {PREMIUM} SELECT reported_sector, suggested_sector, min(reported_desc) AS reported_desc, min(suggested_desc) AS suggested_desc, min(reported_rate) AS reported_rate, min(suggested_rate) AS suggested_rate, round(min(rate_delta), 4) AS rate_delta, min(direction) AS direction, count(*) AS n_establishments, sum(employees) AS total_employees, coalesce(sum(estimated_annual_loss::DECIMAL(20, 4))::DOUBLE, 0) AS total_annual_loss, coalesce(sum(estimated_annual_loss::DECIMAL(20, 4))::DOUBLE, 0) / count(*) AS avg_loss_per_establishment FROM scored GROUP BY 1, 2",
        "records", "results",
    ),
    "q_premium_top50": with_sources(f"WITH {PREMIUM} SELECT id, reported_sector, suggested_sector, employees, round(estimated_annual_loss, 4) AS estimated_annual_loss FROM scored ORDER BY scored.estimated_annual_loss DESC NULLS LAST, id LIMIT 50", "records", "results"),
    "q_premium_summary": with_sources(
        f"""WITH {PREMIUM}, a AS (SELECT count(*)::DOUBLE AS n, (count(*) FILTER (reported_sector <> suggested_sector))::DOUBLE AS x, (count(*) FILTER (upper(st) IN ('CA', 'CALIFORNIA')))::DOUBLE AS c, sum(estimated_annual_loss::DECIMAL(20, 4))::DOUBLE AS t, coalesce((sum(estimated_annual_loss::DECIMAL(20, 4)) FILTER (upper(st) IN ('CA', 'CALIFORNIA')))::DOUBLE, 0) AS tc, sum(estimated_annual_loss::DECIMAL(20, 4))::DOUBLE / count(estimated_annual_loss) AS av, max(estimated_annual_loss) AS mx, (count(*) FILTER (reported_sector <> suggested_sector AND rate_delta > 0))::DOUBLE AS up, (SELECT count(*) FROM records) AS total FROM scored)
SELECT unnest(['total_misclassifications_with_suggestion', 'cross_sector_misclassifications', 'within_sector_misclassifications', 'state_establishments_affected', 'total_annual_premium_gap_all_states', 'total_annual_premium_gap_state', 'avg_premium_gap_per_establishment', 'max_individual_premium_gap', 'pct_underpaying', 'aggressive_state_loss']) AS metric, round(unnest([n, x, n - x, c, t, tc, av, mx, up / x * 100, tc * total / n]), 4) AS value FROM a""",
        "records", "results",
    ),
}
