"""Keyword rules as expressions: any rule that is broken, or the first that applies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatework.functions import fixed


@dataclass(frozen=True)
class Rule:
    pattern: str  # a Java pattern; case is folded
    sectors: tuple[str, ...]
    code: str = ""
    title: str = ""

    def regex(self) -> str:
        return f"(?iu){self.pattern}"


def name_rules() -> list[Rule]:
    return [Rule(*r) for r in fixed.NAME_RULES]


def corrections() -> list[Rule]:
    return [Rule(pattern, sectors, code, title) for pattern, code, title, sectors in fixed.CORRECTIONS]


def apart(columns: dict[str, Column], f) -> Column:
    """f of the columns, in a lambda. Dozens of patterns make more code than one generated method may have; a lambda is
    interpreted, which costs little beside the patterns, and leaves the rest of the stage compiled."""
    return F.transform(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])), f)[0]


def breaks_any(name: Column, sector: Column, rules: list[Rule]) -> Column:
    """Whether the name has some rule's pattern while the sector is none of that rule's."""

    def some(x: Column) -> Column:
        out = F.lit(False)
        for r in rules:
            out = out | (x["name"].rlike(r.regex()) & ~x["sector"].isin(*r.sectors))
        return F.coalesce(out, F.lit(False))

    return apart({"name": name, "sector": sector}, some)


def first_match(name: Column, rules: list[Rule]) -> Column:
    """The number, from 1, of the first rule whose pattern the name has; null if none. Later patterns are not tried."""
    return apart({"name": name}, lambda x: F.coalesce(*[F.when(x["name"].rlike(r.regex()), i) for i, r in enumerate(rules, 1)]))


def pick(values: list[Column], number: Column) -> Column:
    """The value of that number; null for null."""
    return F.try_element_at(F.array(*values), number)
