"""Literals that every match of a regular expression has one of, so that texts without any need not be tried."""

from __future__ import annotations

import warnings
from re import _constants as op
from re import _parser

from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Constructs that Java reads in another way than the parser used here, or that it alone knows.
UNSURE = ("&&", "\\0", "\\Q")


def better(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
    """Of two sets the one whose shortest literal is longer; of equal ones the smaller."""
    if not a or not b:
        return a or b
    worth = lambda s: (min(map(len, s)), -len(s))
    return a if worth(a) >= worth(b) else b


def of_sequence(nodes) -> frozenset[str] | None:
    best, run = None, ""
    for kind, value in [*nodes, (None, None)]:
        if kind is op.LITERAL:
            run += chr(value)
            continue
        best, run = better(best, frozenset([run.lower()]) if run else None), ""
        if kind is op.SUBPATTERN:
            best = better(best, of_sequence(value[3]))
        elif kind is op.ATOMIC_GROUP:
            best = better(best, of_sequence(value))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and value[0] > 0:
            best = better(best, of_sequence(value[2]))
        elif kind is op.BRANCH:
            parts = [of_sequence(b) for b in value[1]]
            best = better(best, frozenset().union(*parts) if all(parts) else None)
        elif kind is op.IN and all(k is op.LITERAL for k, _ in value):
            best = better(best, frozenset(chr(c).lower() for _, c in value))
    return best


def required(pattern: str | None) -> list[str]:
    """Lower-case literals of which a text, lower-cased, has one at least if the pattern is found in it. None known: empty."""
    if pattern is None or any(u in pattern for u in UNSURE):
        return []
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")  # such as of sets within sets, which Java reads otherwise
            return sorted(of_sequence(_parser.parse(pattern)) or [])
    except Exception:  # not of this dialect, so nothing is known of it; Spark itself will say if it isn't of Java's
        return []


required_literals = F.udf(lambda pattern: required(pattern), ArrayType(StringType()))
