"""Required literals of patterns, and curated companies found by them, against trying every pattern on every name."""

import re

import pytest

from gatework.functions.literals import required
from gatework.operators.enrich import known_companies, meetings

PATTERNS = {
    "acme": ["acme"],
    r"\bhome\s+depot\b": ["depot"],
    r"^(wal-?mart|sam'?s club)": ["mart", "s club"],
    r"(fed\s?ex|united parcel|ups)\b": ["fed", "united parcel", "ups"],
    r"3m": ["3m"],
    r"(a|bc)?deli(very)?": ["deli"],
    r"x*y+z": ["y"],
    r"[ab]corp|[^q]inc": ["corp", "inc"],
    r"(?i)Target": ["target"],
    r"(?=foo)bar": ["bar"],
    r".*": [],
    r"a?": [],
    r"[a-z&&[^b]]c": [],
    r"\p{L}+co": [],
    r"(?<n>co)": [],
    r"\Qa.b\E": [],
    "": [],
}


@pytest.mark.parametrize(("pattern", "want"), PATTERNS.items())
def test_required(pattern, want):
    assert required(pattern) == want and required(None) == []


NAMES = "acme tools,the home  depot,walmart stores,wal-mart,sam's club,sams club,fedex ground,united parcel,grups,3m,3 m,delivery,bcdeli,yz,xxyyz,acorp,zinc,qinc,target,foobar,bar,,a.b,co,grumman northrop,éclair co,a".split(",")


def test_meetings_are_all_matches(spark):
    table = spark.createDataFrame([(p, i) for i, p in enumerate(PATTERNS) if p != "(?=foo)bar"], "pattern string, entry int")
    names = spark.createDataFrame([(n,) for n in NAMES], "name string")
    got = {(r.name, r.entry) for r in meetings(names, table).collect()}
    for name in NAMES:
        for entry, p in enumerate(PATTERNS):
            if p not in ("(?=foo)bar", r"[a-z&&[^b]]c", r"\p{L}+co", "(?<n>co)", r"\Qa.b\E"):
                assert ((name, entry) in got) == bool(re.search(p, name)), (name, p)
    java = {p: i for i, p in enumerate(PATTERNS)}
    assert ("éclair co", java["(?<n>co)"]) in got and ("a.b", java[r"\Qa.b\E"]) in got and ("acorp", java[r"[a-z&&[^b]]c"]) in got
    assert len(got) == meetings(names, table).count()


def test_first_entry_counts_and_nothing_is_compared_with_all(spark):
    table = [("walmart-dc", r"wal-?mart", r"distribution|\bdc\b", ["493110"], "493110", "Storage", 1), ("walmart", r"wal-?mart", None, ["455211"], "455211", "Stores", 2), ("any", ".", "nowhere", ["1"], "1", "x", 3)]
    table = spark.createDataFrame(table, "company_id string, pattern string, unit_pattern string, codes array<string>, code string, title string, ord int")
    rows = [("1", "WalMart Inc", "DC 6010", "493110"), ("2", "Wal-Mart", "Store 5", "493110"), ("3", "Other", "Store", "1"), ("4", None, None, None), ("5", "Other", "Nowhere", "2")]
    results = spark.createDataFrame([(*r, "UNCERTAIN", "", "", "") for r in rows], "id string, company_name string, establishment_name string, naics_code string, scrape_match_status string, suggested_naics string, suggested_description string, scrape_confidence string")
    out = known_companies(results, table)
    got = {r.id: (r.scrape_match_status, r.suggested_naics, r.company_id) for r in out.collect()}
    assert got == {"1": ("KC_CONFIRMED", "493110", "walmart-dc"), "2": ("KC_SUGGESTED", "455211", "walmart"), "3": ("UNCERTAIN", "", None), "4": ("UNCERTAIN", "", None), "5": ("KC_SUGGESTED", "1", "any")}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
