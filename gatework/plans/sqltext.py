"""Pieces of DuckDB SQL for the queries' twins, written apart from the operators: joins, CASE ladders and list functions."""

from __future__ import annotations

from gatework.functions import fixed, rules


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def array(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


NAME = "CASE WHEN coalesce(establishment_name, '') <> '' THEN establishment_name ELSE coalesce(company_name, '') END"
FIRM = "CASE WHEN coalesce(company_name, '') <> '' THEN company_name ELSE coalesce(establishment_name, '') END"

BROKEN_RULE = " OR ".join(rf"(regexp_matches(lower({NAME}), '{r.pattern}') AND substring(naics_code, 1, 2) NOT IN {listed(r.sectors)})" for r in rules.name_rules())


def rule_met(pattern: str) -> str:
    """Whether the lower-case name has a rule's pattern. RE2 has no look-around, so what a neighbour forbids is blanked."""
    name = f"lower({NAME})"
    if "crushed" in pattern:
        return rf"regexp_matches(regexp_replace({name}, '(crushed|recycled)\sconcrete\b|\bconcrete\s+product', ' ', 'g'), '\bconcrete\b')"
    if pattern.endswith(fixed.STREET):
        pattern = pattern.removesuffix(fixed.STREET)
        name = rf"regexp_replace({name}, '{pattern}\s+({fixed.STREET[9:-4]})\b', ' ', 'g')"
    return f"regexp_matches({name}, '{pattern}')"


FIRST_RULE = "CASE " + " ".join(f"WHEN {rule_met(r.pattern)} THEN {i}" for i, r in enumerate(rules.corrections(), 1)) + " END"
RULE_TABLE = "(VALUES " + ", ".join(f"({i}, '{r.code}', '{r.title}', {array(r.sectors)})" for i, r in enumerate(rules.corrections(), 1)) + ") AS rule(n, right_code, title, allowed)"

VALID = "valid AS (SELECT DISTINCT code FROM codes WHERE regexp_full_match(code, '[0-9]{2,6}'))"
PADDED = " OR ".join(f"(substring(naics_code, {n + 1}) = '{'0' * (6 - n)}' AND substring(naics_code, 1, {n}) IN (SELECT code FROM valid))" for n in (5, 4, 3, 2))


def cascade(alias: str, code: str, lengths: tuple[int, ...], table: str = "rates", more: str = "") -> tuple[str, str, str]:
    """Left joins, value and matched prefix of a lookup by prefixes."""
    joins = " ".join(f"LEFT JOIN {table} AS {alias}{n} ON substring({code}, 1, {n}) = {alias}{n}.prefix{more.format(t=f'{alias}{n}')}" for n in lengths)
    return joins, "coalesce(" + ", ".join(f"{alias}{n}.value" for n in lengths) + ")", "coalesce(" + ", ".join(f"{alias}{n}.prefix" for n in lengths) + ")"


J7, B7, P7 = cascade("g", "r.naics_code", (6, 5, 4, 3))

#: records, codes and rates to `flagged`: all gates and the tier.
FLAGGED = f"""{VALID},
multi AS (SELECT trim(ein) AS e FROM records WHERE trim(ein) <> '' GROUP BY 1 HAVING count(DISTINCT naics_code) > 1),
rare AS (SELECT naics_code AS c FROM records GROUP BY 1 HAVING count(*) < 3),
quart AS (SELECT naics_code AS c, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM (SELECT naics_code, try_cast(annual_average_employees AS BIGINT) AS v FROM records WHERE regexp_full_match(annual_average_employees, '[0-9]+')) WHERE v >= 5 GROUP BY 1 HAVING count(*) >= 10),
gated AS (SELECT r.*, {B7} AS bls_benchmark, {P7} AS bls_matched_naics, try_cast(total_injuries AS BIGINT) AS inj, try_cast(total_hours_worked AS BIGINT) AS hrs, try_cast(annual_average_employees AS BIGINT) AS emp, q1, q3 FROM records AS r {J7} LEFT JOIN quart ON r.naics_code = quart.c),
marked AS (SELECT *,
  (CASE WHEN NOT regexp_full_match(naics_code, '[0-9]+') THEN 1 WHEN length(naics_code) < 6 THEN (naics_code NOT IN (SELECT code FROM valid))::INT WHEN length(naics_code) > 6 THEN 1 WHEN naics_code IN (SELECT code FROM valid) THEN 0 WHEN {PADDED} THEN 0 ELSE 1 END) AS flag_invalid_naics_code,
  (CASE WHEN NOT regexp_full_match(naics_code, '[0-9]+') OR length(naics_code) > 6 THEN 0 WHEN length(naics_code) < 6 THEN (naics_code IN (SELECT code FROM valid))::INT WHEN naics_code IN (SELECT code FROM valid) THEN 0 WHEN {PADDED} THEN 1 ELSE 0 END) AS flag_incomplete_naics_code,
  (CASE WHEN {NAME} <> '' AND length(naics_code) >= 2 AND ({BROKEN_RULE}) THEN 1 ELSE 0 END) AS flag_name_naics_mismatch,
  (trim(ein) IN (SELECT e FROM multi))::INT AS flag_ein_multi_naics,
  (naics_code IN (SELECT c FROM rare))::INT AS flag_naics_count_anomaly,
  (CASE WHEN emp >= 5 AND (emp < greatest(5.0, q1 - 3 * (q3 - q1)) OR emp > q3 + 3 * (q3 - q1)) THEN 1 ELSE 0 END) AS flag_emp_size_anomaly,
  CASE WHEN hrs > 0 THEN inj::DOUBLE / hrs * 200000 END AS trir,
  (CASE WHEN bls_benchmark > 0 AND hrs > 0 AND inj::DOUBLE / hrs * 200000 > 2.0 * bls_benchmark THEN 1 ELSE 0 END) AS flag_injury_rate_outlier,
  (CASE WHEN emp >= 50 AND inj <= 0 AND bls_benchmark >= 2.0 THEN 1 ELSE 0 END) AS flag_high_emp_zero_injury
  FROM gated),
flagged AS (SELECT *, {" + ".join(fixed.FLAGS)} AS n_flags,
  CASE WHEN flag_invalid_naics_code + flag_name_naics_mismatch + flag_ein_multi_naics + flag_naics_count_anomaly >= 2 THEN 1 WHEN flag_invalid_naics_code + flag_name_naics_mismatch + flag_ein_multi_naics + flag_naics_count_anomaly = 1 OR flag_emp_size_anomaly = 1 THEN 2
    WHEN flag_injury_rate_outlier = 1 OR flag_high_emp_zero_injury = 1 THEN 3 ELSE 4 END AS priority_tier FROM marked)"""

CLASSIFIED = f"""ruled AS (SELECT *, CASE WHEN {NAME} <> '' AND length(naics_code) >= 2 THEN {FIRST_RULE} END AS rule_n FROM flagged),
classified AS (SELECT ruled.*, CASE WHEN rule_n IS NULL THEN 'UNCONTESTED' WHEN list_contains(allowed, substring(naics_code, 1, 2)) THEN 'CONFIRMED' ELSE 'CORRECTED' END AS match_status,
  CASE WHEN rule_n IS NULL OR list_contains(allowed, substring(naics_code, 1, 2)) THEN naics_code ELSE right_code END AS naics_verified,
  CASE WHEN rule_n IS NULL OR list_contains(allowed, substring(naics_code, 1, 2)) THEN '' ELSE title END AS naics_description, CASE WHEN rule_n IS NULL THEN 'low' ELSE 'high' END AS confidence
  FROM ruled LEFT JOIN {RULE_TABLE} ON rule_n = rule.n)"""


def canonical(code: str) -> str:
    s = f"substring({code}, 1, 2)"
    return f"CASE {s} WHEN '32' THEN '31' WHEN '33' THEN '31' WHEN '45' THEN '44' WHEN '49' THEN '48' ELSE {s} END"


def report_sector(code: str, unknown: str = "") -> str:
    whens = " ".join(f"WHEN '{s}' THEN '{fixed.REPORT_RANGES.get(n, n)}'" for s, n in fixed.REPORT_NAMES.items())
    return f"CASE substring(trim({code}), 1, 2) {whens} ELSE '{unknown}' END"


STEM = "CASE " + " ".join(f"WHEN suffix(w, '{s}') AND length(w) >= {len(s) + 3} THEN substring(w, 1, length(w) - {len(s)})" for s in fixed.SUFFIXES) + " WHEN suffix(w, 's') AND length(w) > 4 THEN substring(w, 1, length(w) - 1) ELSE w END"
MEANS = "CASE w " + " ".join(f"WHEN '{w}' THEN {array(o)}" for w, o in fixed.SYNONYMS.items()) + " ELSE [] END"


def tokens(text: str) -> str:
    words = f"list_filter(list_distinct(regexp_extract_all(lower({text}), '[a-z]{{3,}}')), lambda w: NOT list_contains({array(fixed.DESCRIPTION_STOPWORDS)}, w))"
    return f"list_sort(list_distinct(list_concat({words}, list_concat(list_transform({words}, lambda w: {STEM}), flatten(list_transform({words}, lambda w: {MEANS}))))))"


TITLES = "titles AS (SELECT code, arg_min(title, vintage) AS title FROM codes GROUP BY code)"
TREE = "concat_ws(' ', " + ", ".join(f"t{n}.title" for n in (6, 5, 4, 3, 2)) + ")"
TREE_JOINS = " ".join(f"LEFT JOIN titles AS t{n} ON substring(c.code, 1, {n}) = t{n}.code" for n in (6, 5, 4, 3, 2))
R_JOIN, R_RATE, _ = cascade("x", "trim(s.naics_code)", (6, 5, 4, 3, 2))
S_JOIN, S_RATE, _ = cascade("y", "trim(s.suggested_naics)", (6, 5, 4, 3, 2))

#: results, codes to `scored`: scores of descriptions against both codes' titles, of all results.
SCORED = f"""{TITLES},
trees AS (SELECT c.code, {TREE} AS tree FROM (SELECT naics_code AS code FROM results UNION SELECT suggested_naics FROM results) AS c {TREE_JOINS}),
tree_tokens AS (SELECT code, tree, {tokens("tree")} AS tk FROM trees),
texts AS (SELECT d, {tokens("d")} AS tk FROM (SELECT DISTINCT industry_description AS d FROM results)),
scored AS (SELECT r.*, texts.tk AS desc_tk, a.tk AS r_tk, b.tk AS s_tk, a.tree AS r_tree, b.tree AS s_tree,
  CASE WHEN len(texts.tk) > 0 THEN len(list_intersect(texts.tk, a.tk)) / len(texts.tk)::DOUBLE ELSE 0.0 END AS r_score, CASE WHEN len(texts.tk) > 0 THEN len(list_intersect(texts.tk, b.tk)) / len(texts.tk)::DOUBLE ELSE 0.0 END AS s_score
  FROM results AS r JOIN texts ON r.industry_description = texts.d JOIN tree_tokens AS a ON r.naics_code = a.code JOIN tree_tokens AS b ON r.suggested_naics = b.code)"""

ANALYSED = "scrape_match_status IN ('SUGGESTED', 'UNCERTAIN', 'EDGAR_SUGGESTED', 'SAM_SUGGESTED') AND naics_code <> '' AND suggested_naics <> '' AND naics_code <> suggested_naics"

CONTRADICTED = f"""contradicted AS (SELECT *, CASE WHEN len(desc_tk) = 0 THEN 'empty_tokens' WHEN len(r_tk) = 0 AND len(s_tk) = 0 THEN 'no_naics_tokens' WHEN r_score = 0 AND s_score = 0 THEN 'both_zero' WHEN s_score > r_score AND (r_score = 0 OR s_score >= r_score * 1.5::DOUBLE) THEN 'contradiction'
  WHEN s_score > r_score THEN 'gap_too_small' WHEN r_score > s_score THEN 'reported_better' ELSE 'tied' END AS outcome, s_score - r_score AS score_gap, ({canonical("naics_code")}) <> ({canonical("suggested_naics")}) AS crosses_sector
  FROM scored WHERE {ANALYSED} AND industry_description <> '')"""

TARGETS = "targets AS (SELECT DISTINCT substring(code, 1, 4) AS t FROM codes WHERE length(code) = 6 AND CAST(code AS BIGINT) % 9 = 0)"


def on_target(code: str) -> str:
    return " OR ".join(f"substring({code}, 1, {n}) IN (SELECT t FROM targets)" for n in (6, 5, 4, 3, 2))


MATERIAL = f"""{TARGETS},
rated AS (SELECT s.*, {R_RATE} AS reported_dart_rate, {S_RATE} AS suggested_dart_rate, ({on_target("s.naics_code")}) AS on_a, ({on_target("s.suggested_naics")}) AS on_b FROM (SELECT * FROM results WHERE {ANALYSED}) AS s {R_JOIN} {S_JOIN}),
material AS (SELECT *, substring(naics_code, 1, 2) <> substring(suggested_naics, 1, 2) AS crosses_sector, CASE WHEN greatest(reported_dart_rate, suggested_dart_rate) > 0 AND reported_dart_rate IS NOT NULL AND suggested_dart_rate IS NOT NULL THEN abs(reported_dart_rate - suggested_dart_rate) / greatest(reported_dart_rate, suggested_dart_rate) END AS dart_ratio,
  CASE WHEN on_a <> on_b THEN 'MATERIAL' WHEN reported_dart_rate IS NULL OR suggested_dart_rate IS NULL THEN 'INDETERMINATE' WHEN greatest(reported_dart_rate, suggested_dart_rate) = 0 THEN 'IMMATERIAL'
    WHEN abs(reported_dart_rate - suggested_dart_rate) / greatest(reported_dart_rate, suggested_dart_rate) > 0.5 THEN 'MATERIAL'
    WHEN abs(reported_dart_rate - suggested_dart_rate) / greatest(reported_dart_rate, suggested_dart_rate) <= 0.25 AND substring(naics_code, 1, 2) = substring(suggested_naics, 1, 2) THEN 'IMMATERIAL' ELSE 'MODERATE' END AS materiality_class FROM rated)"""

DOMAIN = r"regexp_extract(lower(trim(website_url)), '^(?:[^/]*?://)?([^/:]*)', 1)"
NONCREDIBLE = " OR ".join(f"{DOMAIN} = '{d}' OR suffix({DOMAIN}, '.{d}')" for d in fixed.NONCREDIBLE_DOMAINS)
KNOWN = " OR ".join(f"substring(naics_code, 1, {n}) IN (SELECT code FROM titles)" for n in (6, 5, 4, 3, 2))
SAME = f"({canonical('naics_code')}) = ({canonical('suggested_naics')})"
SIGNAL = "(industry_description <> '' AND (r_score > 0 OR s_score > 0))"
NOTHING = "(scrape_match_status IN ('SCRAPE_FAILED', 'NO_WEBSITE') OR suggested_naics = '')"

CONSISTENT = f"consistent AS (SELECT lower(trim({FIRM})) AS company, count(*) AS sites FROM results WHERE trim({FIRM}) <> '' GROUP BY 1 HAVING count(DISTINCT naics_code) = 1 AND count(*) >= 5)"

TRIAGED = f"""{CONSISTENT},
triaged AS (SELECT *, CASE WHEN scrape_match_status IN ('CONFIRMED', 'SAM_CONFIRMED', 'EDGAR_CONFIRMED') THEN 'T0_RESOLVED'
  WHEN naics_code <> '' AND suggested_naics <> '' AND naics_code = suggested_naics THEN 'T1_SAME_CODE'
  WHEN length(naics_code) >= 4 AND length(suggested_naics) >= 4 AND substring(naics_code, 1, 4) = substring(suggested_naics, 1, 4) THEN 'T2_TRIVIAL_CORRECTION'
  WHEN naics_code <> '' AND suggested_naics <> '' AND lower(trim({FIRM})) IN (SELECT company FROM consistent) THEN 'T2b_MULTI_ESTABLISHMENT_CONSISTENT'
  WHEN {NOTHING} AND scrape_match_status = 'UNCERTAIN' THEN 'T5f_NO_NAICS_SIGNAL'
  WHEN {NOTHING} AND scrape_match_status = 'SCRAPE_FAILED' AND website_url <> '' THEN 'T5e_WEBSITE_UNSCRAPEABLE'
  WHEN {NOTHING} THEN 'T5_NO_ALTERNATIVE'
  WHEN {SIGNAL} AND r_score >= s_score AND ({KNOWN}) THEN 'T3_DESC_SUPPORTS_REPORTED'
  WHEN {SAME} AND ({KNOWN}) THEN 'T4_SAME_SECTOR'
  WHEN NOT ({KNOWN}) THEN 'T7a_INVALID_CODE'
  WHEN website_url <> '' AND ({NONCREDIBLE}) AND NOT ({SAME}) THEN 'T5c_NONCREDIBLE_URL'
  WHEN url_source = 'guess' AND scrape_confidence = 'low' AND NOT ({SAME}) THEN 'T5d_LOW_CONFIDENCE_GUESS'
  WHEN NOT ({SAME}) AND s_score > r_score THEN 'T6_CROSS_SECTOR_CONTRADICTION'
  WHEN NOT {SIGNAL} AND NOT ({SAME}) THEN 'T5b_NO_DESC_SIGNAL' ELSE 'T8_OTHER' END AS triage_tier FROM scored)"""

GROUP = f"CASE WHEN triage_tier IN {listed(fixed.AUTO_TIERS)} THEN 'AUTO-RESOLVE' WHEN triage_tier = 'T5_NO_ALTERNATIVE' THEN 'NO DATA' WHEN triage_tier = 'T8_OTHER' THEN 'UNCATEGORIZED' ELSE 'HUMAN REVIEW' END"

MOVE = "substring(naics_code, 1, 2) || '->' || substring(suggested_naics, 1, 2)"
GAP = "CASE WHEN greatest(r_rate, s_rate) > 0 AND r_rate IS NOT NULL AND s_rate IS NOT NULL THEN abs(r_rate - s_rate) / greatest(r_rate, s_rate) END"
#: results, codes, rates to `reasoned`: the reason of each tier.
REASONED = f"""gaps AS (SELECT s.*, {R_RATE} AS r_rate, {S_RATE} AS s_rate FROM triaged AS s {R_JOIN} {S_JOIN}),
reasoned AS (SELECT g.*, CASE triage_tier WHEN 'T0_RESOLVED' THEN 'Status: ' || scrape_match_status WHEN 'T1_SAME_CODE' THEN 'Suggested == reported (scraper confirmed)'
 WHEN 'T2_TRIVIAL_CORRECTION' THEN 'Same 4-digit parent: ' || substring(naics_code, 1, 4) WHEN 'T2b_MULTI_ESTABLISHMENT_CONSISTENT' THEN sites || ' locations all report ' || naics_code || ', consistent self-reporting'
 WHEN 'T5f_NO_NAICS_SIGNAL' THEN 'Website scraped but no NAICS-identifying keywords found' WHEN 'T5e_WEBSITE_UNSCRAPEABLE' THEN 'Website found (' || substring(website_url, 1, 50) || ') but content extraction failed'
 WHEN 'T5_NO_ALTERNATIVE' THEN 'Status: ' || scrape_match_status || ', no suggestion to compare' WHEN 'T3_DESC_SUPPORTS_REPORTED' THEN printf('Desc supports reported (r=%.2f >= s=%.2f)', r_score, s_score)
 WHEN 'T4_SAME_SECTOR' THEN 'Same sector ' || substring(naics_code, 1, 2) || printf(' (r=%.2f, s=%.2f)', r_score, s_score) WHEN 'T7a_INVALID_CODE' THEN 'Reported ' || naics_code || ' not in NAICS tree'
 WHEN 'T5c_NONCREDIBLE_URL' THEN 'URL ' || {DOMAIN} || ' is not a company website, suggestion unreliable' WHEN 'T5d_LOW_CONFIDENCE_GUESS' THEN 'URL from guess with low confidence, cross-sector ' || {MOVE}
 WHEN 'T6_CROSS_SECTOR_CONTRADICTION' THEN printf('Desc contradicts reported (r=%.2f < s=%.2f), crosses ', r_score, s_score) || {MOVE} || coalesce(printf(', DART ratio=%.0f%%', ({GAP}) * 100), '')
 WHEN 'T5b_NO_DESC_SIGNAL' THEN 'No desc evidence, cross-sector ' || {MOVE} || ', conf=' || scrape_confidence ELSE 'Unclassified' END AS triage_reason
 FROM gaps AS g LEFT JOIN consistent AS c ON lower(trim({FIRM.replace("company_name", "g.company_name").replace("establishment_name", "g.establishment_name")})) = c.company)"""
