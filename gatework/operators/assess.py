"""Assessment: materiality, contradiction by description, triage, resolution, batch quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatework.config import DEFAULT, Config
from gatework.functions import fixed
from gatework.functions.codes import code_form, overlap_score, prefix, relative_gap, same_sector, sector
from gatework.functions.text import blank, description_tokens, filled, first_filled
from gatework.operators.lookup import by_values, cascade, has_prefix, joined_filled, member, title_tree
from gatework.operators.pages import listed, raw_domain

ANALYSED = ("SUGGESTED", "UNCERTAIN", "EDGAR_SUGGESTED", "SAM_SUGGESTED")
RESOLVED = ("CONFIRMED", "SAM_CONFIRMED", "EDGAR_CONFIRMED")


def rounded_text(c: Column, form: str) -> Column:
    """A number in a form such as 0.00, halves to even."""
    return F.call_function("format_number", c, F.lit(form))


def to_analyse(results: DataFrame, described: bool = False) -> DataFrame:
    """Results whose suggestion differs from what was reported."""
    a, b = blank(F.col("naics_code")), blank(F.col("suggested_naics"))
    keep = F.col("scrape_match_status").isin(*ANALYSED) & (a != "") & (b != "") & (a != b)
    return results.where(keep & (blank(F.col("industry_description")) != "") if described else keep)


def materiality_class(a: Column, b: Column, crosses: Column, on_a: Column, on_b: Column, cfg: Config = DEFAULT) -> Column:
    """Of the reported and suggested rates, whether the sectors differ, and whether each code is on the target list."""
    top, gap = F.greatest(a, b), relative_gap(a, b)
    return (
        F.when(on_a != on_b, "MATERIAL")
        .when(a.isNull() | b.isNull(), "INDETERMINATE")
        .when(top == 0, F.when(a == b, "IMMATERIAL").otherwise("INDETERMINATE"))
        .when(gap > cfg.material_ratio, "MATERIAL")
        .when((gap <= cfg.immaterial_ratio) & ~crosses, "IMMATERIAL")
        .otherwise("MODERATE")
    )


def materiality(results: DataFrame, rates: DataFrame, targets: DataFrame | None = None, equivalent: bool = False, cfg: Config = DEFAULT) -> DataFrame:
    """The analysed results with rates (tried from six to two digits), dart_ratio, crosses_sector, materiality_class and
    materiality_reason. Sectors differ if their digits do; `equivalent` counts combined sectors as one."""
    df = to_analyse(results)
    facts = code_facts(df, ("naics_code", "suggested_naics"), rates=rates, targets=targets)
    for side, code in {"reported": "naics_code", "suggested": "suggested_naics"}.items():
        names = {"rate": f"{side}_dart_rate", "match": f"{side}_dart_match"} | ({"on_target": f"on_sst_{side}"} if targets is not None else {})
        df = with_facts(df, facts, code, names)
        on = F.coalesce(f"on_sst_{side}", F.lit(False)) if targets is not None else F.lit(False)
        df = df.withColumns({f"on_sst_{side}": on, f"{side}_sector": sector(blank(F.col(code)))})
    a, b = F.col("reported_sector"), F.col("suggested_sector")
    x, y = F.col("reported_dart_rate"), F.col("suggested_dart_rate")
    crosses = ~same_sector(a, b) if equivalent else a != b
    df = df.withColumns({"crosses_sector": crosses, "dart_ratio": relative_gap(x, y)})
    df = df.withColumn("materiality_class", materiality_class(x, y, F.col("crosses_sector"), F.col("on_sst_reported"), F.col("on_sst_suggested"), cfg))
    ratio = F.concat(F.lit("DART ratio "), rounded_text(F.col("dart_ratio") * 100, "0"), F.lit("%"))
    change = F.concat(F.lit(" ("), rounded_text(x, "0.0"), F.lit(" -> "), rounded_text(y, "0.0"), F.lit(")"))
    reason = (
        F.when(F.col("on_sst_reported") != F.col("on_sst_suggested"), F.concat(F.lit("SST list crossing ("), F.when(F.col("on_sst_suggested"), "onto").otherwise("off of"), F.lit(" targeting list)")))
        .when(x.isNull() | y.isNull(), "DART rate not available for one or both codes")
        .when(F.greatest(x, y) == 0, "Both DART rates are zero")
        .when(F.col("materiality_class") == "MATERIAL", F.concat(ratio, F.lit(" - suggested rate is "), F.when(y > x, "higher").otherwise("lower"), change))
        .when(F.col("materiality_class") == "IMMATERIAL", F.concat(ratio, F.lit(", same sector"), change))
        .otherwise(F.concat(ratio, F.when(F.col("crosses_sector"), ", crosses sector").otherwise(""), change))
    )
    return df.withColumn("materiality_reason", reason)


def gap_summary(df: DataFrame, value: str = "dart_ratio") -> DataFrame:
    """n, mean, median, p25, p75, p90 of a column; the percentiles are values at the place n * p of the sorted column, found
    by rank over distinct values, so no task holds the whole column."""
    from pyspark.sql.window import Window

    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.sum(F.col("v") * F.col("n")).alias("s"))
    ranked = counts.withColumn("upto", F.sum("n").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))  # a row for each distinct ratio
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("v")))
    n = F.col("total")
    half, upper = F.floor((n - 1) / 2), F.floor(n / 2)
    return ranked.crossJoin(F.broadcast(total)).groupBy("total", "s").agg(  # one row
        ((at(half) + at(upper)) / 2).alias("median"), at(F.floor(n / 4)).alias("p25"), at(F.floor(n * 3 / 4)).alias("p75"), at(F.floor(n * 9 / 10)).alias("p90")
    ).select(n.alias("n"), (F.col("s") / n).alias("mean"), "median", "p25", "p75", "p90")


def code_facts(df: DataFrame, columns: tuple[str, ...], titles: DataFrame | None = None, rates: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """Of each distinct code in the columns: fact_code, and by what is given tree, tokens and known of its titles; rate and
    match of the rates, tried from six to two digits; on_target. Codes come again and again, so the lookups are made once a
    code, and results take one join a side."""
    facts = None
    for c in columns:
        side = df.select(filled(blank(F.col(c))).alias("fact_code"))
        facts = side if facts is None else facts.unionByName(side)
    facts = facts.where("fact_code is not null").distinct()
    if titles is not None:
        facts = title_tree(facts, F.col("fact_code"), titles, "tree", "known").withColumn("tokens", description_tokens(F.col("tree")))
    if rates is not None:
        facts = cascade(facts, F.col("fact_code"), rates, (6, 5, 4, 3, 2), "rate", "match")
    return has_prefix(facts, F.col("fact_code"), targets, "on_target") if targets is not None else facts


def with_facts(df: DataFrame, facts: DataFrame, code: str, names: dict[str, str]) -> DataFrame:
    """df with the facts of its column `code`, under the names given. A blank code has none."""
    side = facts.select("fact_code", *[F.col(k).alias(v) for k, v in names.items()])
    return joined_filled(df.withColumn("fact_code", filled(blank(F.col(code)))), side, ["fact_code"]).drop("fact_code")


def description_scores(df: DataFrame, titles: DataFrame, rates: DataFrame | None = None) -> DataFrame:
    """df with r_score and s_score: the share of the description's tokens that the titles of the reported and of the
    suggested code have; the token sets, whether the reported code is known, and the codes' rates. Distinct descriptions
    are tokenised once."""
    none = F.array().cast("array<string>")
    facts = code_facts(df, ("naics_code", "suggested_naics"), titles, rates)
    df = by_values(df, {"text": filled(blank(F.col("industry_description")))}, "desc_tokens", description_tokens).withColumn("desc_tokens", F.coalesce("desc_tokens", none))
    for side, code in (("r", "naics_code"), ("s", "suggested_naics")):
        names = {"tree": f"{side}_tree", "tokens": f"{side}_tokens", "known": f"{side}_known"} | ({"rate": f"{side}_rate"} if rates is not None else {})
        df = with_facts(df, facts, code, names).withColumns({f"{side}_tree": F.coalesce(f"{side}_tree", F.lit("")), f"{side}_tokens": F.coalesce(f"{side}_tokens", none), f"{side}_known": F.coalesce(f"{side}_known", F.lit(False))})
        df = df.withColumn(f"{side}_score", overlap_score(F.col("desc_tokens"), F.col(f"{side}_tokens")))
    return df


def contradiction_outcome(r: Column, s: Column, cfg: Config = DEFAULT) -> Column:
    return (
        F.when((r == 0) & (s == 0), "both_zero")
        .when((s > r) & ((r == 0) | (s >= r * F.lit(cfg.contradiction_ratio))), "contradiction")
        .when(s > r, "gap_too_small")
        .when(r > s, "reported_better")
        .otherwise("tied")
    )


def contradictions(results: DataFrame, titles: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The described results with scores, overlaps, outcome and crosses_sector (combined sectors count as one)."""
    df = description_scores(to_analyse(results, described=True), titles)
    empty = F.when(F.size("desc_tokens") == 0, "empty_tokens").when((F.size("r_tokens") == 0) & (F.size("s_tokens") == 0), "no_naics_tokens")
    both = lambda side: F.array_join(F.array_sort(F.array_intersect("desc_tokens", f"{side}_tokens")), ", ")
    return df.withColumns(
        {
            "outcome": F.coalesce(empty, contradiction_outcome(F.col("r_score"), F.col("s_score"), cfg)),
            "reported_overlap": both("r"),
            "suggested_overlap": both("s"),
            "reported_naics_tree": F.substring("r_tree", 1, 120),
            "suggested_naics_tree": F.substring("s_tree", 1, 120),
            "score_gap": F.col("s_score") - F.col("r_score"),
            "crosses_sector": ~same_sector(sector(F.col("naics_code")), sector(F.col("suggested_naics"))),
        }
    )


def nuggets(contradicted: DataFrame, gap: float = 0.10, most: int = 40) -> DataFrame:
    """The contradictions with the largest gaps."""
    return contradicted.where((F.col("outcome") == "contradiction") & (F.col("score_gap") >= gap)).orderBy(F.col("score_gap").desc(), "id").limit(most)


def consistent_companies(results: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(company, sites): five or more records that all report one code."""
    key = F.lower(blank(first_filled(F.col("company_name"), F.col("establishment_name"))))
    code = blank(F.col("naics_code"))
    groups = results.where(key != "").groupBy(key.alias("company")).agg(F.min(code).alias("low"), F.max(code).alias("high"), F.count("*").alias("sites"))
    return groups.where((F.col("low") == F.col("high")) & (F.col("sites") >= cfg.consistent_sites)).select("company", "sites")


def triage(results: DataFrame, titles: DataFrame, rates: DataFrame | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """results with triage_tier and triage_reason: the first tier of the ladder that applies."""
    company = filled(F.lower(blank(first_filled(F.col("company_name"), F.col("establishment_name")))))
    df = description_scores(results, titles, rates)
    df = joined_filled(df.withColumn("company_", company), consistent_companies(results, cfg).withColumnRenamed("company", "company_"), ["company_"])
    a, b, url = blank(F.col("naics_code")), blank(F.col("suggested_naics")), blank(F.col("website_url"))
    status, r, s = F.coalesce("scrape_match_status", F.lit("")), F.col("r_score"), F.col("s_score")
    low = F.lower(blank(F.col("scrape_confidence")))
    same = same_sector(sector(a), sector(b))
    signal = (blank(F.col("industry_description")) != "") & ((r > 0) | (s > 0))
    known = F.col("r_known")
    nothing = status.isin("SCRAPE_FAILED", "NO_WEBSITE") | (b == "")
    move = F.concat(sector(a), F.lit("->"), sector(b))
    two = lambda text, *cols: F.concat(*[x for part, c in zip(text.split("%"), [*cols, None], strict=True) for x in ([F.lit(part)] if c is None else [F.lit(part), c])])
    r2, s2 = rounded_text(r, "0.00"), rounded_text(s, "0.00")
    ladder = [
        (status.isin(*RESOLVED), "T0_RESOLVED", F.concat(F.lit("Status: "), status)),
        ((a != "") & (b != "") & (a == b), "T1_SAME_CODE", F.lit("Suggested == reported (scraper confirmed)")),
        ((F.length(a) >= 4) & (F.length(b) >= 4) & (prefix(a, 4) == prefix(b, 4)), "T2_TRIVIAL_CORRECTION", F.concat(F.lit("Same 4-digit parent: "), prefix(a, 4))),
        ((a != "") & (b != "") & F.col("sites").isNotNull(), "T2b_MULTI_ESTABLISHMENT_CONSISTENT", F.concat(F.col("sites").cast("string"), F.lit(" locations all report "), a, F.lit(", consistent self-reporting"))),
        (nothing & (status == "UNCERTAIN"), "T5f_NO_NAICS_SIGNAL", F.lit("Website scraped but no NAICS-identifying keywords found")),
        (nothing & (status == "SCRAPE_FAILED") & (url != ""), "T5e_WEBSITE_UNSCRAPEABLE", F.concat(F.lit("Website found ("), F.substring(url, 1, 50), F.lit(") but content extraction failed"))),
        (nothing, "T5_NO_ALTERNATIVE", F.concat(F.lit("Status: "), status, F.lit(", no suggestion to compare"))),
        (signal & (r >= s) & known, "T3_DESC_SUPPORTS_REPORTED", two("Desc supports reported (r=% >= s=%)", r2, s2)),
        (same & known, "T4_SAME_SECTOR", two("Same sector % (r=%, s=%)", sector(a), r2, s2)),
        (~known, "T7a_INVALID_CODE", F.concat(F.lit("Reported "), a, F.lit(" not in NAICS tree"))),
        ((url != "") & listed(raw_domain(url), fixed.NONCREDIBLE_DOMAINS) & ~same, "T5c_NONCREDIBLE_URL", F.concat(F.lit("URL "), raw_domain(url), F.lit(" is not a company website, suggestion unreliable"))),
        ((F.lower(blank(F.col("url_source"))) == "guess") & (low == "low") & ~same, "T5d_LOW_CONFIDENCE_GUESS", F.concat(F.lit("URL from guess with low confidence, cross-sector "), move)),
        (~same & (s > r), "T6_CROSS_SECTOR_CONTRADICTION", two("Desc contradicts reported (r=% < s=%), crosses %", r2, s2, move)),
        (~signal & ~same, "T5b_NO_DESC_SIGNAL", F.concat(F.lit("No desc evidence, cross-sector "), move, F.lit(", conf="), low)),
    ]
    number = F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), i) for i, (c, _, _) in enumerate(ladder, 1)], F.lit(len(ladder) + 1))
    df = df.withColumn("tier_", number)
    tier = F.element_at(F.array(*[F.lit(t) for _, t, _ in ladder], F.lit("T8_OTHER")), F.col("tier_"))
    why = F.coalesce(*[F.when(F.col("tier_") == i, w) for i, (_, _, w) in enumerate(ladder, 1)], F.lit("Unclassified"))
    if rates is not None:  # the rates' gap is part of a contradiction's reason
        gap = relative_gap(F.col("r_rate"), F.col("s_rate"))
        why = F.when((tier == "T6_CROSS_SECTOR_CONTRADICTION") & gap.isNotNull(), F.concat(why, F.lit(", DART ratio="), rounded_text(gap * 100, "0"), F.lit("%"))).otherwise(why)
    return df.withColumns({"triage_tier": tier, "triage_reason": why}).select(*results.columns, "triage_tier", "triage_reason")


def tier_group(tier: Column) -> Column:
    return F.when(tier.isin(*fixed.AUTO_TIERS), "AUTO-RESOLVE").when(tier.isin(*fixed.NO_DATA_TIERS), "NO DATA").when(tier.isin(*fixed.OTHER_TIERS), "UNCATEGORIZED").otherwise("HUMAN REVIEW")


def resolution(classified: DataFrame, results: DataFrame) -> DataFrame:
    """(resolution, n): where each classified record (id, match_status, n_flags) stands; results (id, scrape_match_status),
    one row an id."""
    web = results.where("coalesce(id, '') <> ''").groupBy("id").agg(F.max_by("scrape_match_status", "ord").alias("web_"))
    df = classified.join(web, "id", "left")
    w = F.coalesce("web_", F.lit(""))
    bucket = (
        F.when(F.col("match_status") == "CORRECTED", "CORRECTED (keyword rule)")
        .when(F.col("n_flags") == 0, "CLEAN (0 flags)")
        .when((F.col("n_flags") == 1) & (F.col("match_status") == "CONFIRMED"), "CONFIRMED (1 flag, classifier OK)")
        .when(w.isin(*RESOLVED), "CONFIRMED (web/EDGAR/SAM)")
        .when(w.isin("SUGGESTED", "EDGAR_SUGGESTED", "SAM_SUGGESTED"), "SUGGESTED (needs review)")
        .when(w == "UNCERTAIN", "UNCERTAIN (inconclusive)")
        .when(w.isin("SCRAPE_FAILED", "NO_WEBSITE"), "UNRESOLVED (no data)")
        .when(w != "", F.concat(F.lit("OTHER ("), w, F.lit(")")))
        .otherwise("UNCERTAIN (not in scrape results)")
    )
    return df.groupBy(bucket.alias("resolution")).agg(F.count("*").alias("n"))


def batch_quality(results: DataFrame, codes: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """One row: counts and rates of a batch of results, and whether it passes."""
    df = member(results, blank(F.col("suggested_naics")), codes, "known_")
    form = code_form(F.col("suggested_naics"), F.col("known_"))
    url = F.coalesce("website_url", F.lit("")) != ""
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    s = F.coalesce("scrape_match_status", F.lit(""))
    a = df.agg(
        F.count("*").alias("n"), count(s.isin("CONFIRMED", "SUGGESTED")).alias("actionable"), count(s == "SCRAPE_FAILED").alias("failed"), count(url).alias("with_url"),
        count(url & (form == "empty")).alias("empty_suggestions"), count(~form.isin("valid", "empty")).alias("bad_suggestions"),
    )
    share = lambda x, y: F.when(F.col(y) > 0, F.col(x) / F.col(y)).otherwise(0.0)
    a = a.withColumns({"actionable_rate": share("actionable", "n"), "failure_rate": share("failed", "n"), "empty_rate": share("empty_suggestions", "with_url")})
    ok = (F.col("failure_rate") <= cfg.most_failures) & (F.col("actionable_rate") >= cfg.least_actionable) & (F.col("bad_suggestions") == 0)
    return a.withColumn("passed", (F.col("n") == 0) | ok)


def latest(results: DataFrame, n: int, order: str = "ord") -> DataFrame:
    """The last n results, newest first."""
    return results.orderBy(F.col(order).desc()).limit(n)
