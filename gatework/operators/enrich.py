"""From flagged records to records with evidence: classify, seed, decide, match, merge, override, fan out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatework.config import DEFAULT, Config
from gatework.functions import fixed, rules
from gatework.functions.codes import keyword_score, prefix
from gatework.functions.literals import required_literals
from gatework.functions.text import blank, company_key, filled, first_filled, listed_codes, page_tokens, plain_key
from gatework.operators.candidates import best_codes
from gatework.operators.lookup import by_values, code_status, first_by, joined_filled, keyword_index, last_titles

HARD_FLAGS = ("flag_invalid_naics_code", "flag_name_naics_mismatch", "flag_naics_count_anomaly")
NOT_USEFUL = ("SCRAPE_FAILED", "NO_WEBSITE", "")


def classify(records: DataFrame, corrections: list[rules.Rule] | None = None) -> DataFrame:
    """match_status, naics_verified, naics_description, confidence, reasoning by the first rule whose pattern the name has:
    CONFIRMED if the reported sector is one of the rule's, else CORRECTED to the rule's code; UNCONTESTED without any."""
    table = corrections or rules.corrections()
    name = first_filled(F.col("establishment_name"), F.col("company_name"))
    code = F.coalesce(F.col("naics_code"), F.lit(""))
    df = by_values(records, {"name": F.when((name != "") & (F.length(code) >= 2), name)}, "rule_", lambda name: rules.first_match(name, table))
    n, own = F.col("rule_"), prefix(code, 2)
    allowed = rules.pick([F.array(*map(F.lit, r.sectors)) for r in table], n)
    right, title = rules.pick([F.lit(r.code) for r in table], n), rules.pick([F.lit(r.title) for r in table], n)
    good = F.array_contains(allowed, own)
    enough = (name != "") & (F.length(code) >= 2)
    wrong = F.concat(F.lit("Name keyword matches "), title, F.lit(" (sector "), prefix(right, 2), F.lit("), but reported NAICS "), code, F.lit(" is sector "), own)
    return df.withColumns(
        {
            "match_status": F.when(n.isNull(), "UNCONTESTED").when(good, "CONFIRMED").otherwise("CORRECTED"),
            "naics_verified": F.when(n.isNull() | good, code).otherwise(right),
            "naics_description": F.when(n.isNull() | good, "").otherwise(title),
            "confidence": F.when(n.isNull(), "low").otherwise("high"),
            "reasoning": F.when(~enough, "Insufficient data for classification")
            .when(n.isNull(), "No keyword-sector conflict detected")
            .when(good, F.concat(F.lit("Keyword matched but sector "), own, F.lit(" is valid")))
            .otherwise(wrong),
        }
    ).drop("rule_")


def truthy(c: Column) -> Column:
    return c.cast("string").isin("1", "True", "true")


def routed(classified: DataFrame) -> DataFrame:
    """The records that go on to the web search, as UNCERTAIN: CONFIRMED or UNCONTESTED with two flags or more, or with one
    that doubts the code itself. CORRECTED records never go on."""
    hard = F.lit(False)
    for f in HARD_FLAGS:
        hard = hard | truthy(F.col(f))
    n = F.col("n_flags")
    goes = F.col("match_status").isin("CONFIRMED", "UNCONTESTED") & ((n >= 2) | ((n == 1) & F.coalesce(hard, F.lit(False))))
    why = F.when(n == 1, "Hard quality flag: needs web verification").otherwise("Multiple flags but no keyword mismatch: needs web verification")
    return classified.where(goes).withColumns({"match_status": F.lit("UNCERTAIN"), "confidence": F.lit("low"), "reasoning": why})


def diverse(records: DataFrame, order: str = "ord") -> DataFrame:
    """One record of each company: that with most flags, the first among equals."""
    key = F.lower(blank(first_filled(F.col("company_name"), F.col("establishment_name"))))
    df = records.withColumn("diverse_key_", key).where("diverse_key_ <> ''")
    return first_by(df, ["diverse_key_"], [F.col("n_flags").desc(), F.col(order)]).drop("diverse_key_")


def seeds(prior: DataFrame) -> DataFrame:
    """The best earlier result of each (company, city): the first useful one, or else the first. prior has seed_ord (of its
    year in the order of preference) and ord."""
    df = prior.withColumns({"seed_company_": plain_key(F.col("company_name")), "seed_city_": plain_key(F.col("city"))}).where("seed_company_ <> '' and seed_city_ <> ''")
    useless = F.coalesce(F.col("scrape_match_status"), F.lit("")).isin(*NOT_USEFUL)
    return first_by(df, ["seed_company_", "seed_city_"], [useless.cast("int"), F.col("seed_ord"), F.col("ord")])


def seeded_status(status: Column, suggested: Column, seed_code: Column, keywords: Column, target: Column) -> Column:
    """A seed's status for another reported code."""
    s, sug, own, kw, t = (F.coalesce(c, F.lit("")) for c in (status, blank(suggested), blank(seed_code), blank(keywords), target))
    agrees = (sug != "") & (sug == t)
    outside = s.startswith("KC_") | s.startswith("EDGAR_") | s.startswith("SAM_")
    from_outside = F.when(kw == "", "SCRAPE_FAILED").when(agrees, "CONFIRMED").when(sug != "", "SUGGESTED").otherwise("UNCERTAIN")
    return F.when(s.isin(*NOT_USEFUL), s).when(outside, from_outside).when(t == own, s).when(agrees, "CONFIRMED").when(s == "CONFIRMED", "SUGGESTED").otherwise(s)


def seed_from_prior(targets: DataFrame, prior: DataFrame) -> DataFrame:
    """targets with `seeded` and, where an earlier result of the same company and city is found, its enrichment columns and
    the status for the target's own code."""
    s = seeds(prior).select("seed_company_", "seed_city_", F.struct(F.col("naics_code"), *fixed.ENRICHMENT).alias("seed_"))
    df = targets.withColumns({"key_company_": plain_key(F.col("company_name")), "key_city_": plain_key(F.col("city"))})
    df = df.join(s, (F.col("key_company_") == F.col("seed_company_")) & (F.col("key_city_") == F.col("seed_city_")), "left")
    out = {f: F.col(f"seed_.{f}") for f in fixed.ENRICHMENT}
    out["scrape_match_status"] = F.when(
        F.col("seed_").isNotNull(),
        seeded_status(F.col("seed_.scrape_match_status"), F.col("seed_.suggested_naics"), F.col("seed_.naics_code"), F.col("seed_.scraped_keywords"), blank(F.col("naics_code"))),
    )
    return df.withColumns(out | {"seeded": F.col("seed_").isNotNull()}).drop("key_company_", "key_city_", "seed_company_", "seed_city_", "seed_")


def page_scores(pages: DataFrame, index: DataFrame) -> DataFrame:
    """(key, code, title, matched, score) of every page (key, text) and code (code, title, keywords) that share a keyword: an
    inverted index on the word, not all pairs. A page's words are counted before they meet the index."""
    tokens = pages.select("key", page_tokens(F.col("text")).alias("t"))
    sizes = tokens.select("key", F.size("t").alias("tokens"))
    words = tokens.select("key", F.explode("t").alias("word")).groupBy("key", "word").agg(F.count("*").alias("n"))
    posted = index.select("code", "title", F.size("keywords").alias("keywords"), F.explode("keywords").alias("word"))
    pairs = words.join(posted, "word").groupBy("key", "code", "title", "keywords").agg(F.count("*").alias("matched"), F.sum("n").alias("hits"))
    return pairs.join(sizes, "key").select("key", "code", "title", "matched", keyword_score(F.col("matched"), F.col("keywords"), F.col("hits"), F.col("tokens")).alias("score"))


def own_scores(pages: DataFrame, lists: DataFrame) -> DataFrame:
    """(key, own_score): the page's score for its own reported code (key, text, naics_code), by the title of the code or
    of its nearest parent."""
    titles = last_titles(lists)
    index = keyword_index(lists)
    codes = pages.select("naics_code").distinct()
    codes = code_status(codes, F.col("naics_code"), titles, "s", "parent", "note").join(titles, F.col("parent") == titles["code"], "left").select("naics_code", "s", F.col("title").alias("parent_title"))
    from gatework.functions.text import title_keywords

    own = codes.join(index.select(F.col("code").alias("c"), F.col("keywords").alias("k")), F.col("naics_code") == F.col("c"), "left").select(
        "naics_code", F.coalesce("k", title_keywords(F.col("parent_title"))).alias("keywords")
    )
    tokens = pages.select("key", "naics_code", page_tokens(F.col("text")).alias("t")).join(own, "naics_code", "left")
    hits = F.filter("t", lambda w: F.array_contains("keywords", w))
    matched = F.size(F.array_distinct(hits))
    score = keyword_score(matched, F.size("keywords"), F.size(hits), F.size("t"))
    return tokens.select("key", F.when(F.col("keywords").isNull() | (matched == 0), 0.0).otherwise(score).alias("own_score"))


def decided(reported: Column, status: Column, text: Column, own: Column, top_code: Column, top: Column, cfg: Config = DEFAULT) -> Column:
    """struct(scrape_match_status, suggested_naics, scrape_confidence) of a page's evidence."""
    level = lambda s: F.when(s >= 0.5, "high").otherwise("medium")
    out = lambda s, code, conf: F.struct(F.lit(s).alias("scrape_match_status"), code.alias("suggested_naics"), conf.alias("scrape_confidence"))
    none, low = F.lit(""), F.lit("low")
    o = F.coalesce(own, F.lit(0.0))
    return (
        F.when(F.coalesce(text, none) == "", out("SCRAPE_FAILED", none, none))
        .when(top_code.isNull(), out("UNCERTAIN", none, low))
        .when(status == "invalid", out("UNCERTAIN", top_code, low))
        .when((o >= cfg.confirm_score) & (top > 0) & (o >= cfg.confirm_ratio * top), out("CONFIRMED", reported, level(o)))
        .when((top >= cfg.suggest_score) & (o > 0) & (top > cfg.suggest_ratio * o), out("SUGGESTED", top_code, level(top)))
        .when((o == 0) & (top >= cfg.suggest_score), out("SUGGESTED", top_code, F.lit("medium")))
        .otherwise(out("UNCERTAIN", top_code, low))
    )


def page_summary_words(pages: DataFrame, most: int = 50, kept: int = 10) -> DataFrame:
    """(key, scraped_keywords): of a page's 50 most frequent words (the first to occur among equals) the first ten of four
    letters or more."""
    from pyspark.sql.window import Window

    words = pages.select("key", F.posexplode(page_tokens(F.col("text"))).alias("pos", "word")).groupBy("key", "word").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    order = Window.partitionBy("key").orderBy(F.col("n").desc(), "first")
    top = words.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).where(F.length("word") >= 4)
    listed = F.array_sort(F.collect_list(F.struct("r", "word")))  # at most `most` words of a page
    return top.groupBy("key").agg(listed.alias("w")).select("key", F.array_join(F.slice(F.col("w.word"), 1, kept), ", ").alias("scraped_keywords"))


def decide(pages: DataFrame, lists: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """pages (key, naics_code, text) with the standing of the code, own_score, top_code, top_score and the decision."""
    best = best_codes(pages, keyword_index(lists), 1).select("key", F.col("code").alias("top_code"), F.col("score").alias("top_score"))
    df = code_status(pages, F.col("naics_code"), last_titles(lists), "naics_code_status", "naics_code_parent", "naics_code_note")
    df = df.join(own_scores(pages, lists), "key", "left").join(best, "key", "left")
    d = decided(F.col("naics_code"), F.col("naics_code_status"), F.col("text"), F.col("own_score"), F.col("top_code"), F.col("top_score"), cfg)
    return df.withColumn("d_", d).select(*df.columns, "d_.scrape_match_status", "d_.suggested_naics", "d_.scrape_confidence")


def unresolved(results: DataFrame) -> DataFrame:
    """Results that later evidence may still settle: the targets of the registrant and contractor matches."""
    return results.where(F.col("scrape_match_status").isin("UNCERTAIN", "SCRAPE_FAILED"))


def pilot(df: DataFrame, most: int, order: str = "ord") -> DataFrame:
    """The first rows by an order, for a trial run."""
    return df.orderBy(order, "id").limit(most)


def of_registrants(results: DataFrame, registrants: DataFrame, table: DataFrame, threshold: float = 80.0) -> DataFrame:
    """Verdicts on the unresolved results by registrants (name, sic) of nearly the same name, anywhere: the best ratio of
    matching names, the first name among equals. table: sic, mapped_code, mapped_title, ord."""
    from gatework.functions.text import registrant_name
    from gatework.operators.fuzzy import best_matches

    df = unresolved(results).withColumn("name_", filled(registrant_name(first_filled(F.col("company_name"), F.col("establishment_name")))))
    names = df.where("name_ is not null").select(F.col("name_").alias("key"), F.col("name_").alias("name")).distinct()
    pool = registrants.select(registrant_name(F.col("name")).alias("name"), F.struct("name", "sic").alias("match"))
    found = best_matches(names, pool, None, threshold, 1).select(F.col("key").alias("name_"), "match.sic", F.col("score").alias("match_score"))
    return registrant_verdict(joined_filled(df.drop("sic"), found, ["name_"]).drop("name_"), table, "sic")


def of_contractors(results: DataFrame, contractors: DataFrame, threshold: float = 85.0) -> DataFrame:
    """Verdicts on the unresolved results by contractors (name, name_norm, state, primary_code, listed_codes) of nearly the
    same name in the same state."""
    from gatework.functions.text import contractor_name
    from gatework.operators.fuzzy import best_matches

    name = contractor_name(first_filled(F.col("establishment_name"), F.col("company_name")))
    df = unresolved(results).withColumns({"name_": filled(name), "state_": filled(F.upper(F.trim("state")))})
    names = df.where("name_ is not null and state_ is not null").select(F.struct("state_", "name_").alias("key"), F.col("state_").alias("state"), F.col("name_").alias("name")).distinct()
    pool = contractors.select(F.col("state"), F.col("name_norm").alias("name"), F.struct("name", "primary_code", "listed_codes").alias("match"))
    found = best_matches(names, pool, "state", threshold).select("key.state_", "key.name_", "match.primary_code", "match.listed_codes", F.col("score").alias("match_score"))
    df = joined_filled(df, found, ["state_", "name_"]).drop("state_", "name_")
    v = contractor_verdict(F.col("primary_code"), F.col("listed_codes"), F.col("naics_code"))
    none = F.col("match_score").isNull()
    df = df.withColumn("v_", v)
    new = {"scrape_match_status": F.when(none, "SAM_NOT_FOUND").otherwise(F.col("v_.match_status")), "suggested_naics": F.when(none, "").otherwise(F.col("v_.suggested_naics")), "scrape_confidence": F.when(none, "low").otherwise(F.col("v_.confidence"))}
    return df.withColumns(new).drop("v_")


def registrant_verdict(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Registrants' own industry mapped to codes (table: key, mapped_code, mapped_title, ord): edgar status and suggestion."""
    from gatework.operators.lookup import crosswalk

    out = crosswalk(df, table, key, F.col("naics_code"))
    by = F.col("mapped_by")
    return out.withColumns(
        {
            "scrape_match_status": F.when(F.col(key).isNull(), "EDGAR_NOT_FOUND").when(by.isNull(), "EDGAR_SIC_NO_CROSSWALK").when(by == "exact", "EDGAR_CONFIRMED").otherwise("EDGAR_SUGGESTED"),
            "suggested_naics": F.coalesce("mapped_code", F.lit("")),
            "suggested_description": F.coalesce("mapped_title", F.lit("")),
        }
    ).drop("mapped_code", "mapped_title", "mapped_by")


def contractor_verdict(primary: Column, listed: Column, reported: Column) -> Column:
    """struct(match_status, suggested_naics, confidence) of a contractor's primary code and list of codes."""
    p, codes, r = F.coalesce(primary, F.lit("")), listed_codes(listed), F.coalesce(reported, F.lit(""))
    first = F.coalesce(F.try_element_at(codes, F.lit(1)), F.lit(""))
    out = lambda s, c, f: F.struct(F.lit(s).alias("match_status"), c.alias("suggested_naics"), F.lit(f).alias("confidence"))
    return (
        F.when((p == "") & (F.size(codes) == 0), out("SAM_NO_NAICS", F.lit(""), "low"))
        .when(p == r, out("SAM_CONFIRMED", p, "high"))
        .when(F.array_contains(codes, r), out("SAM_CONFIRMED", r, "high"))
        .otherwise(out("SAM_SUGGESTED", F.when(p != "", p).otherwise(first), "medium"))
    )


def priority_of(status: Column, table: dict[str, int]) -> Column:
    from gatework.functions.codes import literal_map

    return F.coalesce(F.try_element_at(literal_map({k: str(v) for k, v in table.items()}), status).cast("int"), F.lit(0))


def merged(base: DataFrame, found: DataFrame, fields: list[str] | None = None, source: str = "source") -> DataFrame:
    """base with the fields of `found` (id, fields, ord; the last of an id counts) where its status ranks higher: only what
    is filled there overwrites. Adds the columns changed_<source>."""
    fields = fields or fixed.ENRICHMENT
    last = found.groupBy("id").agg(F.max_by(F.struct(*fields), "ord").alias("new_"))
    df = base.join(last, "id", "left")
    wins = priority_of(F.col("new_.scrape_match_status"), fixed.MERGE_PRIORITY) > priority_of(F.col("scrape_match_status"), fixed.MERGE_PRIORITY)
    df = df.withColumn("wins_", F.coalesce(F.col("new_").isNotNull() & wins, F.lit(False)))
    return df.withColumns({f: F.when(F.col("wins_"), F.coalesce(filled(F.col(f"new_.{f}")), F.col(f))).otherwise(F.col(f)) for f in fields} | {f"changed_{source}": F.col("wins_")}).drop("new_", "wins_")


def status_changes(before: DataFrame, after: DataFrame, status: str = "scrape_match_status") -> DataFrame:
    """(status, before, after, diff) over both histograms."""
    count = lambda df, name: df.groupBy(F.col(status).alias("status")).agg(F.count("*").alias(name))
    b, a = count(before, "before"), count(after, "after").withColumnRenamed("status", "status_")
    both = b.join(a, b["status"].eqNullSafe(a["status_"]), "full")
    z = lambda c: F.coalesce(c, F.lit(0))
    return both.select(F.coalesce("status", "status_").alias("status"), z(F.col("before")).alias("before"), z(F.col("after")).alias("after"), (z(F.col("after")) - z(F.col("before"))).alias("diff"))


def without_junk(results: DataFrame, domains: DataFrame) -> DataFrame:
    """results whose unresolved rows with a junk site (domains: domain) are reset to SCRAPE_FAILED."""
    from gatework.operators.pages import on_domains

    df = on_domains(results, F.col("website_url"), domains, "junk_")
    junk = F.col("junk_") & F.col("scrape_match_status").isin("UNCERTAIN", "SCRAPE_FAILED", "SUGGESTED")
    why = F.concat(F.lit("Junk URL filtered: "), F.col("website_url"), F.lit(" is not a company website"))
    new = {f: F.lit("") for f in ("url_source", "scraped_keywords", "suggested_naics", "suggested_description", "scrape_confidence")}
    new |= {"scrape_reasoning": why, "scrape_match_status": F.lit("SCRAPE_FAILED"), "website_url": F.lit("")}
    return df.withColumns({f: F.when(junk, v).otherwise(F.col(f)) for f, v in new.items()}).drop("junk_")


def letter_grams(text: Column) -> Column:
    """The distinct pairs and triples of neighbouring letters."""
    grams = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(grams(2), grams(3)))


def meetings(names: DataFrame, table: DataFrame, shares: int = 16) -> DataFrame:
    """(name, entry) of the names (name, lower-cased and distinct) in which an entry's pattern (pattern, entry) is found.

    Whatever a pattern's alternatives and options are, a match has one of its required literals. A literal's rarest letters
    among the names, three or two, are what it meets names by; a pattern without any meets all, dealt to some tasks."""
    grams = names.select("name", F.explode(letter_grams(F.col("name"))).alias("gram"))
    rarity = grams.groupBy("gram").agg(F.count("*").alias("n"))
    wanted = table.select("pattern", "entry", required_literals("pattern").alias("literals"))
    open_ = (F.size("literals") == 0) | F.exists("literals", lambda w: F.length(w) < 2)
    by_literal = wanted.where(~open_).select("pattern", "entry", F.explode("literals").alias("literal"))
    each = by_literal.withColumn("gram", F.explode(F.filter(letter_grams(F.col("literal")), lambda g: F.length(g) == F.least(F.length("literal"), F.lit(3)))))
    rarest = each.join(rarity, "gram", "left").groupBy("pattern", "entry", "literal").agg(F.min_by("gram", F.coalesce("n", F.lit(0))).alias("gram"))
    met = grams.join(rarest, "gram").where(F.col("name").contains(F.col("literal"))).select("name", "pattern", "entry")
    dealt = wanted.where(open_).select("pattern", "entry", F.explode(F.array(*map(F.lit, range(shares)))).alias("share"))
    others = names.withColumn("share", F.pmod(F.xxhash64("name"), F.lit(shares)).cast("int")).join(dealt, "share").select("name", "pattern", "entry")
    return met.unionByName(others).where("name rlike pattern").select("name", "entry").distinct()


def known_companies(results: DataFrame, table: DataFrame) -> DataFrame:
    """Unresolved results of companies in a curated table (company_id, pattern, unit_pattern, codes, code, title, ord): the
    reported code is confirmed if it is one of the company's, else the company's code is suggested. The first entry whose
    patterns the company and the establishment have counts. A null company is one without a name."""
    names = results.select("company_name", "establishment_name").distinct().withColumn("name", F.lower(F.coalesce("company_name", F.lit(""))))
    entry = F.struct("ord", "company_id", "unit_pattern", "codes", "code", "title")
    found = names.join(meetings(names.select("name").distinct(), table.select("pattern", entry.alias("entry"))), "name").select("company_name", "establishment_name", "entry.*")
    pairs = found.where("unit_pattern is null or lower(coalesce(establishment_name, '')) rlike unit_pattern")
    best = pairs.groupBy("company_name", "establishment_name").agg(F.min(F.struct("ord", "company_id", "codes", "code", "title")).alias("kc_"))
    left, right = results.alias("l"), best.alias("r")
    same = F.col("l.company_name").eqNullSafe(F.col("r.company_name")) & F.col("l.establishment_name").eqNullSafe(F.col("r.establishment_name"))
    df = left.join(right, same, "left").select("l.*", "r.kc_")
    takes = F.col("kc_").isNotNull() & F.col("scrape_match_status").isin("SCRAPE_FAILED", "UNCERTAIN", "NO_WEBSITE")
    ok = F.array_contains(F.col("kc_.codes"), blank(F.col("naics_code")))
    code = F.when(ok, blank(F.col("naics_code"))).otherwise(F.col("kc_.code"))
    new = {
        "scrape_match_status": F.when(ok, "KC_CONFIRMED").otherwise("KC_SUGGESTED"), "suggested_naics": code, "suggested_description": F.col("kc_.title"), "scrape_confidence": F.lit("high"),
    }
    return df.withColumns({f: F.when(takes, v).otherwise(F.col(f)) for f, v in new.items()} | {"company_id": F.when(takes, F.col("kc_.company_id"))}).drop("kc_")


def best_of_company(results: DataFrame) -> DataFrame:
    """(name_key, enrichment): each company's result of the highest status, the first among equals."""
    df = results.withColumn("name_key", company_key(F.col("company_name"), F.col("establishment_name"))).where("name_key <> ''")
    rank = F.struct(priority_of(F.col("scrape_match_status"), fixed.CHOICE_PRIORITY), (-F.col("ord")).alias("o"))
    return df.groupBy("name_key").agg(F.max_by(F.struct(*fixed.ENRICHMENT), rank).alias("enrichment"))


def fanned_out(results: DataFrame, records: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """results and, for every record of the same company that they lack, a row of its own with the company's result; the
    code's standing is that of the record's own code. One row an id."""
    fresh = records.join(results.select("id").distinct(), "id", "left_anti").withColumn("name_key", company_key(F.col("company_name"), F.col("establishment_name")))
    rows = fresh.join(best_of_company(results), "name_key")
    rows = rows.withColumns({f: F.col(f"enrichment.{f}") for f in fixed.ENRICHMENT}).drop("name_key", "enrichment")
    if titles is not None:
        code = filled(blank(F.col("naics_code")))
        rows = code_status(rows, code, titles, "own_status_", "own_parent_", "own_note_")
        rows = rows.withColumns({"naics_code_status": F.when(code.isNull(), F.col("naics_code_status")).otherwise(F.col("own_status_")), "naics_code_note": F.when(code.isNull(), F.col("naics_code_note")).otherwise(F.col("own_note_"))})
    common = [c for c in results.columns if c in rows.columns]
    both = results.select(*common, F.lit(0).alias("source_")).unionByName(rows.select(*common, F.lit(1).alias("source_")))
    return first_by(both, ["id"], [F.col("source_"), F.col("ord")]).drop("source_")
