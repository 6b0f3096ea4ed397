"""Establishment-like tables derived from the driver's star schema, in SQL that Spark and DuckDB both run.

The engine's operators take records, code lists, rates and results. These stand-ins have every kind of value that matters:
placeholders, padded, short, blank and non-numeric codes, blank entities, names with and without keywords, all statuses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SECTORS = "11,21,22,23,31,32,33,42,44,45,48,49,51,52,53,54,55,56,61,62,71,72,81,92"
NAMES = (
    "Acme Plumbing,Valley Animal Hospital,Store on Railroad Ave,Crushed Concrete Co,Harbor Freight,Hill_Bakery,Grand Hotel,City Clinic,Old Quarry,Iron Foundry Park,Bolt Works,Smith Group,"
    "River Mining Blvd,Urgent Care Now,Sun Trucking,Machine Shop Nine,Quick Courier Inc.,Dental Supply LLC,Concrete Products,Power Plant One,Blue Greenhouse,Stone Masonry,Home Health Plus"
)
COMPANIES = "Acme_Corp,Bolt Group,Cedar LLC,,Delta Inc.,Eagle Holdings,Fir Company,,Gale Partners,Hull & Sons"
WORDS = (
    "plumbing,trucking,freight,mining,quarrying,hospital,clinical,nursing,hotel,lodging,restaurant,dining,concrete,cement,roofing,wiring,electric,lumber,timber,brewery,beer,winery,storage,"
    "warehousing,services,contractors,manufacturing,transportation,equipment,carriers,gas,supply,retail,wholesale,medical,dental"
)
STATUSES = "CONFIRMED,SUGGESTED,UNCERTAIN,SCRAPE_FAILED,NO_WEBSITE,EDGAR_SUGGESTED,SAM_SUGGESTED,SAM_CONFIRMED,EDGAR_CONFIRMED,KC_CONFIRMED,UNCERTAIN"
URLS = "https://www.yelp.com/biz/a,http://acme.com/about,https://facebook.com/x,HTTPS://Hill.example.org:8080/p,https://sub.dnb.com/q,,http://www.city.gov/"


def nth(words: str, index: str) -> str:
    """SQL for one of some comma-separated words, counted from 0 around."""
    return f"split_part('{words}', ',', CAST(({index}) % {words.count(',') + 1} AS INT) + 1)"


def full_code(key: str) -> str:
    """SQL for a six-digit code of a key."""
    return f"({nth(SECTORS, key)} || lpad(CAST((({key}) * 37) % 10000 AS STRING), 4, '0'))"


#: Records: one an order, a customer being an establishment; three customers share an entity.
RECORDS = f"""
SELECT CAST(o_orderkey AS STRING) AS id, CAST(o_orderkey AS BIGINT) AS ord, CAST(year(o_orderdate) AS STRING) AS year,
  'E' || CAST(o_custkey AS STRING) AS establishment_id,
  CASE WHEN o_custkey % 50 = 0 THEN ' ' ELSE CAST(CAST((o_custkey - o_custkey % 3) / 3 AS BIGINT) AS STRING) END AS ein,
  {nth(NAMES, "o_custkey")} AS establishment_name, CASE WHEN o_custkey % 10 = 3 AND o_orderkey % 23 > 9 THEN 'Solo ' || CAST(o_custkey AS STRING) ELSE {nth(COMPANIES, "o_custkey % 200")} END AS company_name,
  CAST(o_custkey % 900 AS STRING) || ' Main St' AS street_address, {nth("Norton,Denver,Salem,,Austin", "o_custkey")} AS city, {nth("CA,TX,ny,WA,,OR,FL", "o_custkey")} AS state,
  CASE WHEN o_custkey % 4 = 0 THEN '' ELSE lpad(CAST(o_custkey % 99999 AS STRING), 5, '0') END AS zip_code,
  CASE o_orderkey % 23 WHEN 0 THEN '999999' WHEN 1 THEN '000000' WHEN 2 THEN {nth(SECTORS, "o_custkey")} || '0000' WHEN 3 THEN {nth(SECTORS, "o_custkey")} WHEN 4 THEN substring({full_code("o_custkey")}, 1, 4) || '00'
    WHEN 5 THEN {full_code("o_custkey + o_orderkey % 7")} WHEN 6 THEN '' WHEN 7 THEN '12A' WHEN 8 THEN substring({full_code("o_custkey")}, 1, 5) WHEN 9 THEN {full_code("o_custkey")} || '1' ELSE {full_code("o_custkey")} END AS naics_code,
  CASE WHEN o_custkey % 6 = 0 THEN '' ELSE {nth(WORDS, "o_custkey")} || ' and ' || {nth(WORDS, "o_custkey * 7 + 3")} || ', ' || {nth(WORDS, "o_orderkey")} END AS industry_description,
  CASE WHEN o_orderkey % 41 = 0 THEN 'n/a' WHEN o_orderkey % 97 = 0 THEN '60000' ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) % 120 AS STRING) END AS annual_average_employees,
  CASE WHEN o_orderkey % 43 = 0 THEN '' ELSE CAST((CAST(floor(o_totalprice) AS BIGINT) % 120) * 1800 AS STRING) END AS total_hours_worked, CAST(o_orderkey % 6 AS STRING) AS total_injuries
FROM {{orders}}
"""

#: Code lists of two vintages with titles; codes of every fifth customer are missing.
CODES = f"""
SELECT code, title, vintage, ord FROM (
  SELECT code, {nth(WORDS, "CAST(code AS BIGINT)")} || ' ' || {nth(WORDS, "CAST(code AS BIGINT) * 3 + 1")} || CASE WHEN vintage = 1 THEN ' other' ELSE '' END AS title, vintage, CAST(code AS BIGINT) AS ord
  FROM (SELECT DISTINCT substring({full_code("c_custkey")}, 1, n) AS code, v AS vintage
        FROM {{customer}} CROSS JOIN (SELECT 2 AS n UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6) AS lengths CROSS JOIN (SELECT 0 AS v UNION ALL SELECT 1) AS vintages
        WHERE c_custkey % 5 <> 0 AND (n < 6 OR c_custkey % 2 = v OR c_custkey % 7 = 0)) AS x) AS y
"""

#: Rates of about a third of the prefixes of two to six digits.
RATES = f"""
SELECT DISTINCT substring({full_code("c_custkey")}, 1, n) AS prefix, CAST((CAST(substring({full_code("c_custkey")}, 1, n) AS BIGINT) * 7) % 71 AS DOUBLE) / 10.0 AS value
FROM {{customer}} CROSS JOIN (SELECT 2 AS n UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6) AS lengths WHERE CAST(substring({full_code("c_custkey")}, 1, n) AS BIGINT) % 3 = 0
"""

#: Results: records with evidence.
RESULTS = f"""
SELECT r.*, {nth(STATUSES, "ord")} AS scrape_match_status,
  CASE ord % 5 WHEN 0 THEN '' WHEN 1 THEN naics_code WHEN 2 THEN CASE WHEN length(naics_code) = 6 THEN substring(naics_code, 1, 4) || '99' ELSE '238220' END ELSE {full_code("ord % 1500 + 1")} END AS suggested_naics,
  {nth(URLS, "ord")} AS website_url, {nth("guess,search,", "ord")} AS url_source, {nth("low,medium,high,", "ord * 3 + 1")} AS scrape_confidence,
  CASE WHEN ord % 4 = 0 THEN '' ELSE 'pipes, tools' END AS scraped_keywords, '' AS suggested_description, 'because' AS scrape_reasoning, 'current' AS naics_code_status, '' AS naics_code_note
FROM ({RECORDS}) AS r
"""

SOURCES = {"records": RECORDS, "codes": CODES, "rates": RATES, "results": RESULTS}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the derived tables as a DataFrame."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer") if f"{{{t}}}" in SOURCES[name]}
    return spark.sql(SOURCES[name], **tables)


def with_sources(sql: str, *names: str) -> str:
    """DuckDB SQL with the derived tables it names as common table expressions."""
    ctes = ", ".join(f"{n} AS ({SOURCES[n].replace('{orders}', 'orders').replace('{customer}', 'customer')})" for n in names)
    return f"WITH {ctes}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH {ctes} {sql}"
