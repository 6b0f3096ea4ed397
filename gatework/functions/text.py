"""Expressions over names, descriptions and page texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatework.functions import fixed


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def filled(c: Column) -> Column:
    """null where a text is empty."""
    return F.when(c != "", c)


def blank(c: Column) -> Column:
    """Stripped text; empty where null."""
    return F.coalesce(strip(c), F.lit(""))


def first_filled(*columns: Column) -> Column:
    """The first text that is neither null nor empty, or else empty."""
    return F.coalesce(*[filled(c) for c in columns], F.lit(""))


def number(c: Column) -> Column:
    """A whole number of ASCII digits, or null."""
    s = strip(c)
    return F.when(s.rlike("^[0-9]+$"), s.try_cast("bigint"))


def alternatives(words: list[str]) -> str:
    return "|".join(words)


def matching_name(c: Column, also: str = "") -> Column:
    """A company name for fuzzy matching: no suffixes, no marks, single spaces, upper case."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), "(?iu)" + fixed.COMPANY_SUFFIX.replace("{more}", also), "")
    c = F.regexp_replace(c, r"(?U)[^\w\s]", " ")
    return F.upper(strip(F.regexp_replace(c, r"\s+", " ")))


def registrant_name(c: Column) -> Column:
    return matching_name(c)


def contractor_name(c: Column) -> Column:
    return matching_name(c, "|d/?b/?a")


def company_key(company: Column, establishment: Column) -> Column:
    """The key by which a company's records share a result."""
    return F.lower(strip(F.translate(first_filled(company, establishment), "_", " ")))


def plain_key(c: Column) -> Column:
    return F.lower(blank(c))


def without_legal_suffix(c: Column) -> Column:
    c = strip(F.translate(c, "_", " "))
    c = strip(F.regexp_replace(c, "(?iu)" + fixed.LEGAL_SUFFIX, ""))
    return strip(F.regexp_replace(c, r"[.,;:!?]+$", ""))


def search_name(c: Column, city: Column, state: Column) -> Column:
    """A name without leading numbers and trailing places; the city pattern is the row's own, quoted."""
    c = strip(F.regexp_replace(c, r"^[0-9]{4,}\s*[-–]\s*", ""))
    c = strip(F.regexp_replace(c, r"\s*[-–]\s+[A-Z][A-Za-z\s]{2,}$", ""))
    c = strip(F.regexp_replace(c, r"\s+[A-Z]{2}\s*[0-9]{2,5}\s*$", ""))
    town, region = blank(F.translate(city, "_", " ")), F.upper(blank(F.translate(state, "_", " ")))
    ending = lambda s, flags: F.concat(F.lit(flags + r"\s+\Q"), F.regexp_replace(s, r"\\E", ""), F.lit(r"\E\s*$"))
    c = F.when(F.length(town) >= 3, strip(F.regexp_replace(c, ending(town, "(?iu)"), F.lit("")))).otherwise(c)
    return F.when(F.length(region) == 2, strip(F.regexp_replace(c, ending(region, ""), F.lit("")))).otherwise(c)


def query_name(company: Column, establishment: Column, city: Column, state: Column) -> Column:
    """What to search the web for: the company unless its name is generic, then the establishment."""
    spaced = lambda c: blank(F.translate(c, "_", " "))
    site = F.regexp_replace(spaced(establishment), r"(?iu)\s+(ST[0-9]+|HQ[0-9]+|#[0-9]+|[0-9]{3,})\s*$", "")
    site = F.regexp_replace(site, r"\s*-\s*[0-9]+\s*$", "")
    firm = search_name(spaced(first_filled(company, establishment)), city, state)
    site = search_name(site, city, state)
    usable = lambda c: (strip(F.lower(c)) != "") & ~strip(F.lower(c)).isin(*fixed.GENERIC_NAMES)
    return F.when(usable(firm), firm).when(usable(site), site).otherwise(first_filled(firm, site))


def name_words(c: Column) -> Column:
    """Words of a company name that may stand in its domain."""
    c = F.regexp_replace(F.lower(F.translate(c, "_", " ")), r"[^a-z0-9\s]", "")
    return F.filter(F.split(c, r"\s+"), lambda w: (F.length(w) >= 3) & ~w.isin(*fixed.PAGE_STOPWORDS))


def page_tokens(c: Column) -> Column:
    """Words of a page, repeats included."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("([a-z]{3,})")), lambda w: ~w.isin(*fixed.PAGE_STOPWORDS))


def title_keywords(c: Column) -> Column:
    return F.array_distinct(page_tokens(c))


def stem(w: Column) -> Column:
    """The word without the first suffix that leaves three letters, or else without a final s."""
    out = None
    for s in fixed.SUFFIXES:
        fits = w.endswith(s) & (F.length(w) - len(s) >= 3)
        cut = F.substring(w, F.lit(1), F.length(w) - len(s))
        out = F.when(fits, cut) if out is None else out.when(fits, cut)
    return out.when(w.endswith("s") & (F.length(w) > 4), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)


def description_tokens(c: Column) -> Column:
    """The set of a description's words, their stems and what they stand for, sorted. Each distinct word is stemmed once."""
    words = F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z]{3,})"))), F.array(*[F.lit(w) for w in fixed.DESCRIPTION_STOPWORDS]))
    also = F.create_map(*[x for w, others in fixed.SYNONYMS.items() for x in (F.lit(w), F.array(*map(F.lit, others)))])
    others = F.flatten(F.transform(words, lambda w: F.coalesce(F.try_element_at(also, w), F.array().cast("array<string>"))))
    return F.array_sort(F.array_distinct(F.concat(words, F.transform(words, stem), others)))


def listed_codes(c: Column) -> Column:
    """Six-digit codes of a list such as 423120Y;811121Y."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda t: F.regexp_extract(strip(t), r"^([0-9]{6})", 1)), lambda t: t != "")


def normal_code(c: Column) -> Column:
    """A reviewer's code as text: 541940.0 is 541940, blank is null, UNK and other words stay in upper case."""
    s = F.upper(strip(c))
    whole = s.try_cast("double").try_cast("bigint").cast("string")
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit(None)).when(s == "UNK", s).otherwise(F.coalesce(whole, s))


def address(street: Column, city: Column, state: Column, postcode: Column) -> Column:
    """street, city, state postcode; whatever is there if not all four are."""
    parts = F.filter(F.array(*map(strip, (street, city, state, postcode))), lambda p: p.isNotNull() & (p != ""))
    return F.when(F.size(parts) == 4, F.concat(parts[0], F.lit(", "), parts[1], F.lit(", "), parts[2], F.lit(" "), parts[3])).otherwise(F.array_join(parts, ", "))
