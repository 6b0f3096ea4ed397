"""Expressions over hierarchical codes, rates and sectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatework.functions import fixed
from gatework.functions.text import strip


def prefix(code: Column, n: int) -> Column:
    return F.substring(code, 1, n)


def sector(code: Column) -> Column:
    return prefix(strip(code), 2)


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def canonical(sector_code: Column) -> Column:
    """One code for sectors that count as one."""
    return F.coalesce(F.try_element_at(literal_map(fixed.SAME_SECTOR), sector_code), sector_code)


def same_sector(a: Column, b: Column) -> Column:
    return canonical(a) == canonical(b)


def sector_name(sector_code: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(fixed.SECTOR_NAMES), sector_code), F.concat(F.lit("Sector "), sector_code))


def report_sector(code: Column, unknown: str = "") -> Column:
    """The label of a code's sector in reports."""
    labels = {s: fixed.REPORT_RANGES.get(n, n) for s, n in fixed.REPORT_NAMES.items()}
    return F.coalesce(F.try_element_at(literal_map(labels), sector(code)), F.lit(unknown))


def risk_tier(sector_code: Column) -> Column:
    s = sector_code
    return F.when(F.coalesce(s, F.lit("")) == "", "UNKNOWN").when(s.isin(*fixed.HIGH_RISK), "HIGH").when(s.isin(*fixed.MEDIUM_RISK), "MEDIUM").when(s.isin(*fixed.LOW_RISK), "LOW").otherwise("OTHER")


def relative_gap(a: Column, b: Column) -> Column:
    """|a - b| over the larger; null where that is 0."""
    return F.when(F.greatest(a, b) > 0, F.abs(a - b) / F.greatest(a, b))


def incident_rate(incidents: Column, hours: Column) -> Column:
    """Incidents per 200,000 hours; null without hours."""
    return F.when(hours > 0, incidents.cast("double") / hours * 200_000)


def keyword_score(matched: Column, keywords: Column, hits: Column, tokens: Column) -> Column:
    """Coverage 0.4, matches up to five 0.3, density 0.2, and 0.1 if over half of the keywords are there."""
    coverage = F.when(keywords > 0, matched / keywords).otherwise(0.0)
    density = F.when(tokens > 0, hits / tokens).otherwise(0.0)
    return F.lit(0.4) * coverage + F.lit(0.3) * F.least(matched / F.lit(5.0), F.lit(1.0)) + F.lit(0.2) * density + F.lit(0.1) * F.when(coverage > 0.5, 1.0).otherwise(0.0)


def overlap_score(words: Column, others: Column) -> Column:
    """The share of words that are among the others."""
    return F.when(F.size(words) > 0, F.size(F.array_intersect(words, others)) / F.size(words)).otherwise(0.0)


def trend(first: Column, second: Column, names: tuple[str, str, str] = ("increasing", "decreasing", "stable")) -> Column:
    """Of two half means, by a tenth."""
    return F.when(second > first * 1.1, names[0]).when(second < first * 0.9, names[1]).otherwise(names[2])


def size_bucket(employees: Column) -> Column:
    out = None
    for top, label in zip((10, 50, 250, 500), fixed.SIZE_BUCKETS, strict=False):
        out = F.when(employees < top, label) if out is None else out.when(employees < top, label)
    return out.when(employees.isNotNull(), fixed.SIZE_BUCKETS[-1])


def rank_consistency(spread: Column) -> Column:
    return F.when(spread.isNull(), "N/A").when(spread <= 2, "Very Stable").when(spread <= 5, "Stable").when(spread <= 10, "Moderate").otherwise("Volatile")


def premium_gap(delta: Column, employees: Column, cap: float, salary: float) -> Column:
    return F.abs(delta) * F.least(F.coalesce(employees, F.lit(1.0)), F.lit(cap)) * F.lit(salary) / 100


def payment_direction(delta: Column) -> Column:
    return F.when(delta > 0, "UNDERPAYING").when(delta < 0, "OVERPAYING").otherwise("SAME")


def code_form(code: Column, known: Column) -> Column:
    """What is wrong with a suggested code; `known` says whether the reference has it."""
    s = F.coalesce(strip(code), F.lit(""))
    return (
        F.when(s == "", "empty").when(~s.rlike("^[0-9]+$"), "non_numeric").when(F.length(s) != 6, F.concat(F.lit("wrong_length_"), F.length(s).cast("string"))).when(known, "valid").otherwise("not_in_reference")
    )
