"""Hand-derived cases of the scalar functions."""

import random

import pytest
from pyspark.sql import functions as F

from gatework.functions import codes, rules, text
from gatework.operators import fuzzy, pages


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "word, stem",
    [("manufacturing", "manufac"), ("transportation", "transport"), ("equipment", "equip"), ("mining", "min"), ("wiring", "wir"), ("carriers", "carr"), ("services", "servic"), ("contractors", "contractor"), ("gas", "gas")],
)
def test_stem(spark, word, stem):
    assert one(spark, text.stem(F.lit(word))) == stem


def test_description_tokens(spark):
    got = set(one(spark, text.description_tokens(F.lit("The Mining, and wiring of the hotel"))))
    assert got == {"mining", "min", "mine", "mineral", "extraction", "wiring", "wir", "hotel", "motel", "lodging", "hospitality", "accommodation"}
    assert one(spark, text.description_tokens(F.lit(None).cast("string"))) == []


def test_names(spark):
    assert one(spark, text.registrant_name(F.lit("Acme Widgets, Inc."))) == "ACME WIDGETS"
    assert one(spark, text.contractor_name(F.lit("Hill d/b/a The Shop LLC"))) == "HILL THE SHOP"
    assert one(spark, text.company_key(F.lit(" Acme_Corp "), F.lit("x"))) == "acme corp"
    assert one(spark, text.without_legal_suffix(F.lit("Acme_Tools, Inc."))) == "Acme Tools"
    assert one(spark, text.search_name(F.lit("202175 - BIRMINGHAM FP AL10"), F.lit(""), F.lit(""))) == "BIRMINGHAM FP"
    assert one(spark, text.search_name(F.lit("The Timken Company Norton Shores"), F.lit("norton shores"), F.lit("MI"))) == "The Timken Company"
    assert one(spark, text.search_name(F.lit("A.B (x) Co (y"), F.lit("(y"), F.lit(""))) == "A.B (x) Co (y"
    assert one(spark, text.query_name(F.lit("Headquarters"), F.lit("Acme_Plant #12"), F.lit(""), F.lit(""))) == "Acme Plant"


def test_code_texts(spark):
    assert one(spark, text.listed_codes(F.lit("423120Y;811121Y; 12Y"))) == ["423120", "811121"]
    assert [one(spark, text.normal_code(F.lit(c))) for c in ("541940.0", " unk ", "", "12A")] == ["541940", "UNK", None, "12A"]
    assert one(spark, text.address(F.lit("1 A St"), F.lit("Town"), F.lit("CA"), F.lit("00001"))) == "1 A St, Town, CA 00001"
    assert one(spark, text.address(F.lit("1 A St"), F.lit(None).cast("string"), F.lit("CA"), F.lit(""))) == "1 A St, CA"
    assert [one(spark, text.number(F.lit(c))) for c in (" 7 ", "x", "1_000", "")] == [7, None, None, None]


def test_arithmetic(spark):
    score = lambda *a: one(spark, codes.keyword_score(*map(F.lit, a)))
    assert score(2, 5, 4, 100) == pytest.approx(0.288) and score(5, 5, 10, 100) == pytest.approx(0.82)
    gap = codes.premium_gap(F.lit(0.36) - F.lit(11.61), F.lit(50_000.0), 50_000.0, 74_580.0)
    assert one(spark, gap) == pytest.approx(419_512_500.0)
    assert one(spark, codes.premium_gap(F.lit(0.36) - F.lit(11.61), F.lit(None).cast("double"), 50_000.0, 74_580.0)) == pytest.approx(8_390.25)
    assert one(spark, codes.relative_gap(F.lit(4.0), F.lit(3.0))) == 0.25 and one(spark, codes.relative_gap(F.lit(0.0), F.lit(0.0))) is None
    assert one(spark, codes.incident_rate(F.lit(5), F.lit(100_000))) == 10.0 and one(spark, codes.incident_rate(F.lit(5), F.lit(0))) is None
    assert [one(spark, codes.size_bucket(F.lit(x))) for x in (9.0, 10.0, 250.0, 500.0)] == ["<10", "10-49", "250-499", "500+"]


def test_sectors(spark):
    assert one(spark, codes.same_sector(F.lit("31"), F.lit("33"))) and not one(spark, codes.same_sector(F.lit("31"), F.lit("42")))
    assert one(spark, codes.sector_name(F.lit("99"))) == "Sector 99" and one(spark, codes.report_sector(F.lit("334413"))) == "Manufacturing (31-33)"
    assert [one(spark, codes.risk_tier(F.lit(s))) for s in ("23", "42", "62", "11", "")] == ["HIGH", "MEDIUM", "LOW", "OTHER", "UNKNOWN"]


def test_rules(spark):
    assert len(rules.name_rules()) == 61 and len(rules.corrections()) == 54
    number = lambda name: one(spark, rules.first_match(F.lit(name), rules.corrections()))
    assert rules.corrections()[number("Valley Animal Hospital") - 1].code == "541940"
    assert number("Store on Railroad Ave") is None and number("Crushed Concrete Co") is None and number("Concrete Products") is None
    assert number("Railroad Avenues") is not None


def test_fuzzy(spark):
    assert fuzzy.common_length("abcde", "xbydz") == 2 and fuzzy.common_length("", "a") == 0
    brute = lambda a, b: max((len(s) for s in subsequences(a) if s in subsequences(b)), default=0)
    for a, b in (("kitten", "sitting"), ("abcabc", "acbacb"), ("zz", "y")):
        assert fuzzy.common_length(a, b) == brute(a, b)
    assert one(spark, fuzzy.ratio(fuzzy.sorted_words(F.lit("Acme Tools")), fuzzy.sorted_words(F.lit("tools acme")))) == 100.0


def subsequences(s):
    out = {""}
    for c in s:
        out |= {x + c for x in out}
    return out


def plain_common(a, b):
    """Length of the longest common subsequence, by the table."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


def test_common_lengths_of_a_batch():
    rnd = random.Random(4)
    word = lambda n, letters: "".join(rnd.choices(letters, k=n))
    sizes = [0, 1, 2, 5, 30, 63, 64, 65, 100, 127, 128, 129, 200]
    pairs = [(word(rnd.choice(sizes), x), word(rnd.choice(sizes), x)) for x in ("ab", "abcdefgh ", "aé日😀", "abcdefghijklmnopqrstuvwxyz") for _ in range(120)] + [("", ""), ("a" * 300, "a" * 299)]
    assert fuzzy.common_lengths([a for a, _ in pairs], [b for _, b in pairs]).tolist() == [plain_common(a, b) for a, b in pairs]
    assert fuzzy.common_lengths([], []).tolist() == []


def test_urls(spark):
    assert one(spark, pages.host(F.lit("HTTPS://www.Acme.com:80/x?y"))) == "acme.com" and one(spark, pages.host(F.lit("no url"))) == ""
    assert one(spark, pages.raw_domain(F.lit("https://www.yelp.com:8080/x"))) == "www.yelp.com"
    assert one(spark, pages.listed(F.lit("sub.yelp.com"), ["yelp.com"])) and not one(spark, pages.listed(F.lit("notyelp.com"), ["yelp.com"]))
    got = one(spark, pages.guessed_urls(F.lit("City of Salem"), F.lit("Salem")))
    assert got[:3] == ["https://www.salem.gov", "https://www.cityofsalem.com", "https://www.cityofsalem.org"]
    assert one(spark, pages.guessed_urls(F.lit("Acme Tools, Inc."), F.lit("")))[:2] == ["https://www.acmetools.com", "https://www.acme-tools.com"]
    assert one(spark, pages.guessed_urls(F.lit("!"), F.lit(""))) == []
    html = '<a href="/about">a</a><a href="team/services">b</a><a href="http://x.com/about">c</a><a href="/about">d</a>'
    assert one(spark, pages.subpages(F.lit(html), F.lit("http://acme.com/p/q.html"))) == ["http://acme.com/about", "http://acme.com/p/team/services"]
    assert one(spark, pages.right_site(F.lit("Acme Fine Tools"), F.lit("fine acme things"))) and not one(spark, pages.right_site(F.lit("Acme Tools"), F.lit("acme")))
    page = '<html><head><title>T &amp; t</title><meta name="description" content="D"></head><body><nav>n</nav><p>Hello\n world</p><script>x</script></body></html>'
    assert one(spark, pages.html_text(F.lit(page))) == "D T & t Hello world"
