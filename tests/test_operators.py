"""Hand-derived cases of the operators."""

import pytest
from pyspark.sql import functions as F

from gatework.functions import fixed
from gatework.operators import assess, enrich, fuzzy, gates, lookup, persistence, reports, validation


def test_code_gates(spark):
    valid = spark.createDataFrame([(c,) for c in ("238220", "23", "238", "2382", "23822")], "code string")
    cases = {"238220": (0, 0), "238000": (0, 1), "179100": (1, 0), "23": (0, 1), "99": (1, 0), "2382201": (1, 0), "": (1, 0), "23A": (1, 0), None: (1, 0)}
    df = spark.createDataFrame([(c,) for c in cases], "naics_code string")
    got = {r.naics_code: (r.flag_invalid_naics_code, r.flag_incomplete_naics_code) for r in gates.code_gates(df, valid).collect()}
    assert got == cases


def test_name_gate(spark):
    rows = [("Joe's Plumbing", "311000", 1), ("Joe's Plumbing", "238220", 0), ("Acme Concrete Hospital", "621111", 1), ("", "311000", 0), (None, "3", 0)]
    df = spark.createDataFrame(rows, "establishment_name string, naics_code string, want int").withColumn("company_name", F.lit(None).cast("string"))
    assert all(r.flag_name_naics_mismatch == r.want for r in gates.name_gate(df).collect())


def test_entity_and_rarity_gates(spark):
    df = spark.createDataFrame([("X", "A"), ("X", "A"), ("Y", "A"), ("Y", "B"), (" ", "A"), (" ", "B"), (None, "C"), ("Z", "C"), ("Z", None)], "ein string, naics_code string")
    got = sorted((str(r.ein), str(r.naics_code), r.flag_ein_multi_naics) for r in gates.entity_gate(df).collect())
    assert {(e, f) for e, _, f in got} == {("X", 0), ("Y", 1), (" ", 0), ("None", 0), ("Z", 1)}
    rare = {r.naics_code: r.flag_naics_count_anomaly for r in gates.rarity_gate(df).collect()}
    assert rare == {"A": 0, "B": 1, "C": 1, None: 1}


def test_size_gate(spark):
    rows = [("c", str(e)) for e in [*range(10, 19), 100]] + [("d", str(e)) for e in [*range(10, 18), 100]] + [("c", "4"), ("c", "x"), ("c", None)]
    got = gates.size_gate(spark.createDataFrame(rows, "naics_code string, annual_average_employees string")).where("flag_emp_size_anomaly = 1").collect()
    assert [(r.naics_code, r.annual_average_employees) for r in got] == [("c", "100")]


def test_rate_gates_and_tiers(spark):
    b = spark.createDataFrame([("238", 4.0), ("722", 5.0), ("11", 9.0), ("621", 2.0), ("622", 1.9)], "prefix string, value double")
    rows = [("238220", "5", "100000", "1", 1, 0), ("722511", "5", "100000", "1", 0, 0), ("113310", "5", "100000", "1", 0, 0), ("238220", "5", "0", "1", 0, 0), ("621111", "0", "1", "50", 0, 1), ("622110", "0", "1", "50", 0, 0), ("621111", "-1", "1", "49", 0, 0), ("621111", "x", "", "60", 0, 0)]
    df = spark.createDataFrame(rows, "naics_code string, total_injuries string, total_hours_worked string, annual_average_employees string, want7 int, want8 int")
    assert all((r.flag_injury_rate_outlier, r.flag_high_emp_zero_injury) == (r.want7, r.want8) for r in gates.rate_gates(df, b).collect())
    flags = list(fixed.FLAGS)
    cases = [({0, 2}, 1, 2), ({5}, 2, 1), ({6}, 3, 1), ({1}, 4, 1), ({0}, 2, 1), (set(), 4, 0)]
    df = spark.createDataFrame([(*[int(i in s) for i in range(8)], t, n) for s, t, n in cases], ", ".join(f"{f} int" for f in [*flags, "t", "n"]))
    assert all((r.priority_tier, r.n_flags) == (r.t, r.n) for r in gates.priority(df).collect())


def test_gates_never_both(spark):
    from gatework.plans.gating import flagged

    assert flagged(spark, "/root/testdata/sf0.001").where("flag_invalid_naics_code + flag_incomplete_naics_code > 1").count() == 0


@pytest.mark.parametrize("lengths, table, code, want", [((6, 5, 4, 3), {"238": 3.0, "23": 2.9}, "238220", (3.0, "238")), ((6, 5, 4, 3), {"238": 3.0, "23": 2.9}, "236115", (None, None)), ((6, 5, 4, 3, 2), {"238": 3.0, "23": 2.9}, "236115", (2.9, "23")), ((6, 4, 3, 2), {"23822": 5.0, "2382": 4.0}, "238220", (4.0, "2382"))])
def test_cascade(spark, lengths, table, code, want):
    df = spark.createDataFrame([(code,)], "c string")
    rates = spark.createDataFrame(list(table.items()), "prefix string, value double")
    r = lookup.cascade(df, F.col("c"), rates, lengths, "v", "m").first()
    assert (r.v, r.m) == want


def test_code_status(spark):
    titles = spark.createDataFrame([("2382", "Building"), ("238", "Trade"), ("238220", "Plumbing")], "code string, title string")
    df = spark.createDataFrame([("238220",), ("238200",), ("238000",), ("99",)], "c string")
    got = {r.c: r for r in lookup.code_status(df, F.col("c"), titles, "s", "p", "n").collect()}
    assert [got[c].s for c in ("238220", "238200", "238000", "99")] == ["current", "retired", "retired", "invalid"]
    assert "zero-padded 4-digit" in got["238200"].n and "was retired" in got["238000"].n


def test_lists(spark):
    lists = spark.createDataFrame([("31-33", "Making", 0, 1), ("311", "Food old", 0, 2), ("311", "Food new", 1, 3), ("311111", "dog cat food", 0, 4), ("311111", "dog food", 1, 5), (None, "x", 0, 6)], "code string, title string, vintage int, ord int")
    assert {r.code: r.title for r in lookup.first_titles(lists).collect()} == {"31": "Making", "32": "Making", "33": "Making", "311": "Food old", "311111": "dog cat food"}
    assert {r.code for r in lookup.valid_codes(lists).collect()} == {"311", "311111"}
    assert lookup.keyword_index(lists).first().keywords == ["dog", "cat", "food"]
    rates = spark.createDataFrame([("31-33", "2.5", 1), ("44", "-", 2), ("11 ", "1", 3), ("11", "3", 4), ("x", "1", 5), ("22", "n/a", 6)], "code string, rate string, ord int")
    assert {r.prefix: r.value for r in lookup.rates(rates.withColumn("code", F.translate("code", " ", ""))).collect()} == {"31": 2.5, "32": 2.5, "33": 2.5, "11": 3.0}


def test_classify_and_route(spark):
    rows = [("Valley Animal Hospital", "541940", "CONFIRMED"), ("Valley Animal Hospital", "311000", "CORRECTED"), ("Store on Railroad Ave", "311000", "UNCONTESTED"), ("Crushed Concrete Co", "311000", "UNCONTESTED"), ("", "311000", "UNCONTESTED")]
    df = spark.createDataFrame(rows, "establishment_name string, naics_code string, want string").withColumn("company_name", F.lit(""))
    got = enrich.classify(df).collect()
    assert all(r.match_status == r.want for r in got)
    assert {r.naics_verified for r in got if r.match_status == "CORRECTED"} == {"541940"}
    routes = [("CONFIRMED", 1, 0, 0, False), ("CONFIRMED", 1, 0, 1, True), ("CORRECTED", 3, 1, 1, False), ("UNCONTESTED", 2, 0, 0, True)]
    df = spark.createDataFrame([(s, n, i, 0, 0, c, w) for s, n, i, c, w in routes], "match_status string, n_flags int, flag_invalid_naics_code int, flag_incomplete_naics_code int, flag_name_naics_mismatch int, flag_naics_count_anomaly int, want boolean")
    assert {r.want for r in enrich.routed(df).collect()} == {True} and enrich.routed(df).count() == 2


@pytest.mark.parametrize("own, top, want", [(0.5, 0.5, ("CONFIRMED", "high")), (0.42, 0.5, ("CONFIRMED", "medium")), (0.3, 0.5, ("SUGGESTED", "high")), (0.35, 0.5, ("UNCERTAIN", "low")), (0.0, 0.45, ("SUGGESTED", "medium")), (0.0, 0.3, ("UNCERTAIN", "low"))])
def test_decided(spark, own, top, want):
    r = spark.range(1).select(enrich.decided(F.lit("A"), F.lit("current"), F.lit("text"), F.lit(own), F.lit("B"), F.lit(top)).alias("d")).first().d
    assert (r.scrape_match_status, r.scrape_confidence) == want


@pytest.mark.parametrize("status, suggested, own, keywords, target, want", [("CONFIRMED", "A", "A", "k", "A", "CONFIRMED"), ("CONFIRMED", "A", "A", "k", "B", "SUGGESTED"), ("SUGGESTED", "B", "A", "k", "B", "CONFIRMED"), ("SAM_CONFIRMED", "B", "A", "", "B", "SCRAPE_FAILED"), ("SAM_CONFIRMED", "B", "A", "k", "B", "CONFIRMED"), ("NO_WEBSITE", "", "A", "", "B", "NO_WEBSITE")])
def test_seeded_status(spark, status, suggested, own, keywords, target, want):
    assert spark.range(1).select(enrich.seeded_status(*map(F.lit, (status, suggested, own, keywords, target))).alias("s")).first().s == want


@pytest.mark.parametrize("reported, want", [("423120", ("SAM_CONFIRMED", "423120")), ("811121", ("SAM_CONFIRMED", "811121")), ("423199", ("SAM_SUGGESTED", "423120")), ("111110", ("SAM_SUGGESTED", "423120"))])
def test_contractor_verdict(spark, reported, want):
    r = spark.range(1).select(enrich.contractor_verdict(F.lit("423120"), F.lit("423120Y;811121Y"), F.lit(reported)).alias("v")).first().v
    assert (r.match_status, r.suggested_naics) == want


def results(spark, rows):
    df = spark.createDataFrame(rows, "id string, company_name string, naics_code string, scrape_match_status string, suggested_naics string, suggested_description string, ord int")
    return df.withColumns({"establishment_name": F.lit("")} | {f: F.lit("") for f in fixed.ENRICHMENT if f not in df.columns})


def test_merge_keeps_the_higher_and_stale_descriptions(spark):
    base = results(spark, [("1", "A", "1", "UNCERTAIN", "", "x", 1)])
    edgar, sam = results(spark, [("1", "A", "1", "EDGAR_SUGGESTED", "E", "", 1)]), results(spark, [("1", "A", "1", "SAM_NOT_FOUND", "S", "y", 1)])
    r = enrich.merged(enrich.merged(base, edgar, source="a"), sam, source="b").first()
    assert (r.scrape_match_status, r.suggested_naics, r.suggested_description, r.changed_a, r.changed_b) == ("EDGAR_SUGGESTED", "E", "x", True, False)


def test_fan_out(spark):
    seen = results(spark, [("1", "Acme_Co", "1", "SUGGESTED", "S", "", 1), ("2", "acme co", "1", "CONFIRMED", "C1", "", 2), ("3", "acme co", "1", "CONFIRMED", "C2", "", 3)])
    records = spark.createDataFrame([("2", "x", "1", "", 1), ("9", "ACME CO ", "1", "", 2), ("8", "other", "1", "", 3)], "id string, company_name string, naics_code string, establishment_name string, ord int")
    got = {r.id: r.suggested_naics for r in enrich.fanned_out(seen, records).collect()}
    assert got == {"1": "S", "2": "C1", "3": "C2", "9": "C1"}


@pytest.mark.parametrize("a, b, crosses, on_a, on_b, want", [(3.0, 1.0, False, False, False, "MATERIAL"), (4.0, 3.0, False, False, False, "IMMATERIAL"), (4.0, 3.0, True, False, False, "MODERATE"), (4.0, 2.0, False, False, False, "MODERATE"), (0.0, 0.0, True, False, False, "IMMATERIAL"), (None, 2.0, False, False, False, "INDETERMINATE"), (None, None, False, True, False, "MATERIAL")])
def test_materiality(spark, a, b, crosses, on_a, on_b, want):
    lit = lambda v: F.lit(v).cast("double")
    assert spark.range(1).select(assess.materiality_class(lit(a), lit(b), F.lit(crosses), F.lit(on_a), F.lit(on_b)).alias("x")).first().x == want


@pytest.mark.parametrize("r, s, want", [(0.0, 0.1, "contradiction"), (0.2, 0.4, "contradiction"), (0.4, 0.5, "gap_too_small"), (0.3, 0.3, "tied"), (0.5, 0.2, "reported_better"), (0.0, 0.0, "both_zero"), (0.2, 0.3, "gap_too_small")])
def test_contradiction(spark, r, s, want):
    assert spark.range(1).select(assess.contradiction_outcome(F.lit(r), F.lit(s)).alias("x")).first().x == want


def test_triage(spark):
    titles = spark.createDataFrame([("23", "Construction"), ("238220", "Plumbing"), ("72", "Food"), ("31", "Making"), ("33", "Making")], "code string, title string")
    base = dict(status="UNCERTAIN", rep="238220", sug="", url="", src="", conf="", desc="", name="")
    cases = [
        (dict(status="CONFIRMED"), "T0_RESOLVED"), (dict(sug="238220"), "T1_SAME_CODE"), (dict(sug="238290"), "T2_TRIVIAL_CORRECTION"), (dict(status="SUGGESTED", sug="722511", name="Same"), "T2b_MULTI_ESTABLISHMENT_CONSISTENT"),
        (dict(status="KC_CONFIRMED", sug="238220"), "T1_SAME_CODE"), (dict(), "T5f_NO_NAICS_SIGNAL"), (dict(status="SCRAPE_FAILED", url="http://a.com"), "T5e_WEBSITE_UNSCRAPEABLE"), (dict(status="NO_WEBSITE"), "T5_NO_ALTERNATIVE"),
        (dict(sug="722511", url="https://www.yelp.com/x"), "T5c_NONCREDIBLE_URL"), (dict(sug="722511", src="guess", conf="low"), "T5d_LOW_CONFIDENCE_GUESS"), (dict(sug="722511"), "T5b_NO_DESC_SIGNAL"),
        (dict(rep="311000", sug="332000"), "T4_SAME_SECTOR"), (dict(rep="999999", sug="722511"), "T7a_INVALID_CODE"), (dict(sug="722511", desc="plumbing"), "T3_DESC_SUPPORTS_REPORTED"), (dict(sug="722511", desc="food"), "T6_CROSS_SECTOR_CONTRADICTION"),
    ]
    rows = [(str(i), *{**base, **c}.values(), t) for i, (c, t) in enumerate(cases)] + [(f"s{i}", "CONFIRMED", "238220", "", "", "", "", "", "Same", "T0_RESOLVED") for i in range(4)]
    df = spark.createDataFrame(rows, "id string, scrape_match_status string, naics_code string, suggested_naics string, website_url string, url_source string, scrape_confidence string, industry_description string, company_name string, want string").withColumn("establishment_name", F.lit(""))
    assert [(r.id, r.triage_tier) for r in assess.triage(df, titles).collect() if r.triage_tier != r.want] == []


def test_percentiles(spark):
    r = assess.gap_summary(spark.createDataFrame([(x,) for x in (0.1, 0.2, 0.3, 0.4)], "dart_ratio double")).first()
    assert (r.n, r.p25, r.p75, r.p90) == (4, 0.2, 0.4, 0.4) and r.median == pytest.approx(0.25) and r.mean == pytest.approx(0.25)


def test_fuzzy_join_equals_brute_force(spark):
    import random

    r = random.Random(2)
    words = ["ACME", "BOLT", "CEDAR", "DELTA", "TOOLS", "WORKS"]
    name = lambda: " ".join(r.sample(words, r.randrange(1, 4)))
    typo = lambda s: s[: (k := r.randrange(len(s)))] + r.choice("XYZ") + s[k + 1 :]
    left, right = [(i, "CA", typo(name())) for i in range(60)], [(i, "CA", name()) for i in range(60)]
    got = {x.key: (x.match, round(x.score, 6)) for x in fuzzy.best_matches(spark.createDataFrame(left, "key int, state string, name string"), spark.createDataFrame(right, "match int, state string, name string"), "state", 85.0).collect()}
    key = lambda s: " ".join(sorted(s.lower().split()))
    want = {}
    for i, _, a in left:
        x = key(a)
        found = [(-200 * fuzzy.common_length(x, key(b)) / (len(x) + len(key(b))), m) for m, _, b in right]
        if found and -min(found)[0] >= 85 and len(a) >= 3:
            want[i] = (min(found)[1], round(-min(found)[0], 6))
    assert got == want


def test_global_fuzzy_join_loses_no_pair(spark):
    """Typos in every word, very short names, and names of one letter: pairs that share no whole word."""
    import random

    r = random.Random(8)
    letters = "abcdefgh"
    word = lambda: "".join(r.choice(letters) for _ in range(r.randrange(1, 7)))
    right = [(i, " ".join(word() for _ in range(r.randrange(1, 4)))) for i in range(80)]
    left = []
    for i in range(80):
        s = list(right[i][1])
        for _ in range(r.randrange(4)):
            k = r.randrange(len(s) + 1)
            s[k : k + r.randrange(2)] = r.choice(["", r.choice(letters)])
        left.append((i, "".join(s)))
    key = lambda s: " ".join(sorted(s.lower().split()))
    for threshold in (70.0, 80.0):
        got = fuzzy.best_matches(spark.createDataFrame(left, "key int, name string"), spark.createDataFrame(right, "match int, name string"), None, threshold, 1).collect()
        want = {}
        for i, a in left:
            found = [(-200 * fuzzy.common_length(key(a), key(b)) / (len(key(a)) + len(key(b))), m) for m, b in right if key(a)]
            if found and -min(found)[0] >= threshold:
                want[i] = (min(found)[1], round(-min(found)[0], 6))
        assert {x.key: (x.match, round(x.score, 6)) for x in got} == want and len(want) > 50


def test_registrants_and_contractors_settle_what_is_open(spark):
    columns = "id string, ord int, company_name string, establishment_name string, state string, naics_code string, scrape_match_status string, suggested_naics string, suggested_description string, scrape_confidence string"
    rows = [("1", 1, "Acme Tolls Inc.", "", "CA", "332216", "UNCERTAIN", "", "", ""), ("2", 2, "Nobody Here", "", "CA", "111111", "SCRAPE_FAILED", "", "", ""), ("3", 3, "Acme Tools", "", "CA", "332216", "CONFIRMED", "", "", ""), ("4", 4, "", None, None, "1", "UNCERTAIN", "", "", "")]
    results = spark.createDataFrame(rows, columns)
    registrants = spark.createDataFrame([("ACME TOOLS CORP", "3420")], "name string, sic string")
    table = spark.createDataFrame([("3420", "332216", "Tools", 1)], "sic string, mapped_code string, mapped_title string, ord int")
    got = {r.id: r for r in enrich.of_registrants(results, registrants, table).collect()}
    assert {i: r.scrape_match_status for i, r in got.items()} == {"1": "EDGAR_CONFIRMED", "2": "EDGAR_NOT_FOUND", "4": "EDGAR_NOT_FOUND"}
    contractors = spark.createDataFrame([("Acme Tools", "ACME TOOLS", "CA", "332216", "332216Y"), ("Acme Tools", "ACME TOOLS", "TX", "999999", "")], "name string, name_norm string, state string, primary_code string, listed_codes string")
    got = {r.id: r for r in enrich.of_contractors(results.replace("Acme Tolls Inc.", "Acme Tolls"), contractors).collect()}
    assert {i: r.scrape_match_status for i, r in got.items()} == {"1": "SAM_CONFIRMED", "2": "SAM_NOT_FOUND", "4": "SAM_NOT_FOUND"}
    assert enrich.unresolved(results).count() == 3 and [r.id for r in enrich.pilot(results, 2).collect()] == ["1", "2"]


def test_rows_with_null_keys_meet_nothing(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), (None, 2), ("b", 3)], "k string, v int")
    table = spark.createDataFrame([("a", "x"), (None, "y")], "k string, w string")
    assert sorted((r.v, r.w) for r in lookup.joined_filled(df, table, ["k"]).collect()) == [(1, "x"), (2, None), (2, None), (3, None)]
    got = lookup.by_values(df, {"k": F.col("k")}, "u", lambda k: F.upper(k)).collect()
    assert sorted((r.v, r.u) for r in got) == [(1, "A"), (2, None), (2, None), (3, "B")]


def test_shifts_skip_missing_years(spark):
    rows = [("E", "2021", "238220", "1"), ("E", "2023", "722511", "2"), ("F", "2021", "238220", "1"), ("F", "2022", "236115", "x")]
    df = spark.createDataFrame([(e, y, c, n, i) for i, (e, y, c, n) in enumerate(rows)], "establishment_id string, year string, naics_code string, annual_average_employees string, ord int")
    df = df.withColumns({c: F.lit("v") for c in ("ein", "company_name", "establishment_name", "state")})
    rates = spark.createDataFrame([("2021", "238", 5.0), ("2023", "72", 2.0)], "year string, prefix string, value double")
    got = {r.establishment_id: r for r in persistence.shifts(df, rates).collect()}
    assert (got["E"].year_from, got["E"].year_to, got["E"].shift_type, got["E"].direction, got["E"].employees) == ("2021", "2023", "CROSS_SECTOR_SHIFT", "DOWNWARD_SHIFT", 2.0)
    assert (got["F"].shift_type, got["F"].direction, got["F"].employees) == ("WITHIN_SECTOR_SHIFT", "UNKNOWN", None)


def test_allocation(spark):
    counts = spark.createDataFrame([("a", 90), ("b", 9), ("c", 1)], "tier string, n int")
    assert {r.tier: r.allotted for r in validation.allocation(counts, 20).collect()} == {"a": 15, "b": 3, "c": 2}


def test_metrics(spark):
    rows = [("CLEAN", 96, 4), ("FLAGGED_NOT_PROMOTED", 83, 17), ("AUTO_RESOLVED", 115, 35), ("MANUAL_REVIEW", 78, 22)]
    df = spark.createDataFrame([(s, "1", "1", "2") for s, a, _ in rows for _ in range(a)] + [(s, "2", "1", "2") for s, _, b in rows for _ in range(b)] + [("CLEAN", "UNK", "1", ""), ("CLEAN", "", "1", "")], "stratum string, reviewer_naics string, reported_naics string, suggested_naics string")
    r = validation.overall_metrics(validation.stratum_metrics(df)).first()
    assert r.precision == pytest.approx(74 / 350) and r.recall == pytest.approx(74 / 78)


def test_rank_correlation_on_raw_ranks(spark):
    """Ranks 2, 1, 1, 1 over four years."""
    rows = [(y, "11", n) for y, n in zip("abcd", (1, 5, 5, 5), strict=True)] + [(y, "21", n) for y, n in zip("abcd", (3, 1, 1, 1), strict=True)]
    df = spark.createDataFrame(rows, "year string, naics_code string, n_flags int")
    got = {r.sector: r for r in reports.sector_stability(df, list("abcd")).collect()}
    assert got["Agriculture"].rho_raw == pytest.approx(-0.5) and got["Agriculture"].mean_rank == 1.25


def test_rank_correlation_of_constant_and_few_ranks(spark):
    """A sector that keeps its rank in all years has no correlation, nor one of fewer than three years."""
    rates = {"11": {"a": 9, "b": 9, "c": 9, "d": 9}, "21": {"a": 5, "b": 1, "c": 5, "d": 1}, "22": {"a": 3, "b": 3, "c": 3, "d": 3}, "23": {"b": 2}, "61": {"c": 1, "d": 2}}
    df = spark.createDataFrame([(y, c, n) for c, by in rates.items() for y, n in by.items()], "year string, naics_code string, n_flags int")
    got = {r.sector: r for r in reports.sector_stability(df, list("abcd")).collect()}
    same = got["Agriculture"]
    assert (same.rank_a, same.rank_b, same.rank_c, same.rank_d, same.rho) == (1, 1, 1, 1, None) and same.rho_raw == pytest.approx(1 - 6 * 14 / 60)
    few = [r for r in got.values() if r.rank_a is None]
    assert len(got) == 5 and len(few) == 2 and all(r.rho is None and r.rho_raw is None for r in few)
    # ranks 2, 4, 2, 4 are 1, 3, 1, 3 among themselves
    assert got["Mining"].rank_b == got["Mining"].rank_d == 4 and got["Mining"].rho == pytest.approx(2 / 20**0.5)
