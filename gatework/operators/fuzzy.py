"""Fuzzy matching of names, exact for its threshold.

Scores are token-sort ratios: 200 times the longest common subsequence of the names, their words sorted, over the sum of
their lengths. No pair that reaches the threshold is lost, and not all pairs are made. A common subsequence of s letters in
names of m and n keeps at least 3 s - 1 - m - n pairs of neighbouring letters, as each letter outside of it parts two of
its neighbours at most. So names that reach the threshold share so many letter pairs, and share one of the rarest of
each (prefix filter); names too short for that meet by single letters. Candidates meet on a block and such a token, and
pass bounds on lengths and on the edit distance, before the ratio itself is computed, for all pairs of an Arrow batch at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from gatework.operators.lookup import first_by


#: Pairs, less for names over 64 letters, that are compared at once.
PAIRS_AT_ONCE = 4096


def sorted_words(name: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(F.lower(name), r"\s+"), lambda w: w != "")), " ")


def common_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs, all pairs at once: a row of the table of a pair is bits, a word
    of 64 columns at a time, and each step takes the next letter of all names. Pairs of like size go together."""
    both = [*a, *b]
    size = np.fromiter(map(len, both), np.int64, len(both))
    at, text = np.cumsum(size) - size, np.frombuffer("".join(both).encode("utf-32-le"), np.uint32)
    (at_a, at_b), (n, m) = at.reshape(2, -1), size.reshape(2, -1)
    swap = n > m
    short, long, n, m = np.where(swap, at_b, at_a), np.where(swap, at_a, at_b), np.minimum(n, m), np.maximum(n, m)
    words, out = (n + 63) // 64, np.zeros(len(a), np.int64)
    order = np.lexsort((m, words))
    starts = np.searchsorted(words[order], np.arange(1, words.max(initial=0) + 2))  # empty names have nothing in common
    for w, (start, stop) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True), 1):
        step = max(1, PAIRS_AT_ONCE // w)
        for i in range(start, stop, step):
            some = order[i : min(i + step, stop)]
            out[some] = common_of(*(letters(text, at[some], size[some]) for at, size in ((short, n), (long, m))), w)
    return out


def letters(text: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The letters of names that begin at `at`, a column each, and where a name has one."""
    row = np.arange(int(sizes.max()))[:, None]
    return text.take(np.minimum(at + row, len(text) - 1)), row < sizes


def common_of(short: tuple[np.ndarray, np.ndarray], long: tuple[np.ndarray, np.ndarray], words: int) -> np.ndarray:
    (x, in_x), (y, in_y) = short, long
    used = np.zeros(max(x.max(), y.max()) + 1, bool)
    used[x] = used[y] = True
    number = np.cumsum(used)  # from 1; 0 stands for no letter
    size, pairs = int(number[-1]) + 1, x.shape[1]
    base = np.arange(pairs) * size
    x, y = (np.where(there, number[z], 0) + base for z, there in ((x, in_x), (y, in_y)))
    places = np.zeros((words, pairs * size), np.uint64)  # where in the short name each letter is
    for i, at in enumerate(x):
        places[i // 64, at] |= np.uint64(1 << (i % 64))
    places[:, base] = 0
    rows = np.full((words, pairs), ~np.uint64(0))
    for at in y:
        carry = None
        for w in range(words):
            row = rows[w]
            match = row & places[w].take(at)
            total = row + match
            if words > 1:
                over = total < row
                total += carry if w else np.uint64(0)
                carry = (over | (total < carry if w else False)).astype(np.uint64)
            rows[w] = total | (row - match)
    # a zero is a letter in common; bits past the short name's end stay ones, for no letter is there
    return 64 * words - np.bitwise_count(rows).sum(0, dtype=np.int64)


def common_length(a: str, b: str) -> int:
    return int(common_lengths([a], [b])[0])


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    x, y = a.tolist(), b.tolist()
    total = np.array([len(p) + len(q) for p, q in zip(x, y, strict=True)], np.float64)
    return pd.Series(np.where(total > 0, 200.0 * common_lengths(x, y) / np.maximum(total, 1), 100.0), dtype="float64")


def may_reach(a: Column, b: Column, threshold: float) -> Column:
    """Necessary for a ratio of the threshold: the lengths allow it, and so does the edit distance, which is no more than
    the number of letters outside the common subsequence."""
    la, lb = F.length(a), F.length(b)
    share = threshold / (200.0 - threshold)
    room = F.floor((1 - threshold / 100.0) * (la + lb) + 1e-9).cast("int")  # 1 - 0.8 is a little less than 0.2
    # beyond `room` the distance isn't computed to its end: it is -1
    return (F.least(la, lb) >= share * F.greatest(la, lb) - 1e-9) & (F.call_function("levenshtein", a, b, room) >= 0)


def least_shared(length: Column, threshold: float) -> Column:
    """How many letter pairs a name of that length shares at least with any name at the threshold. s is threshold / 200 of
    m + n at least, so 3 s - 1 - m - n is least for the shortest name it may reach. Not positive: none need be shared."""
    both = length * (200.0 / (200.0 - threshold))
    return F.ceil(both * (3 * threshold / 200.0 - 1) - 1 - 1e-9)


def letter_pairs(name: Column) -> Column:
    """The pairs of neighbouring letters, each with its number among equal ones: `an1`, `an2`."""
    pairs = F.when(F.length(name) > 1, F.transform(F.sequence(F.lit(1), F.length(name) - 1), lambda i: F.substring(name, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return F.transform(pairs, lambda p, i: F.concat(p, (F.size(F.filter(F.slice(pairs, F.lit(1), i), lambda q: q == p)) + 1).cast("string")))


def tokens(names: DataFrame, rarity: DataFrame, threshold: float) -> DataFrame:
    """(block, name, sorted, token): the rarest letter pairs of each name, as many as the prefix filter needs, and single
    letters of a name that may share no pair."""
    weak = least_shared(F.length("sorted"), threshold) <= 0
    each = names.select("block", "name", "sorted", F.explode(letter_pairs(F.col("sorted"))).alias("token")).join(rarity, "token")
    ordered = each.groupBy("block", "name", "sorted").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("t"))
    need = F.when(weak, F.size("t")).otherwise(F.size("t") - least_shared(F.length("sorted"), threshold) + 1)
    pairs = ordered.select("block", "name", "sorted", F.explode(F.slice("t", F.lit(1), F.greatest(need, F.lit(1)).cast("int"))).alias("t")).select("block", "name", "sorted", F.col("t.token").alias("token"))
    letters = names.where(weak).select("block", "name", "sorted", F.explode(F.array_distinct(F.split("sorted", ""))).alias("token"))
    return pairs.unionByName(letters.where("token <> ''"))


def best_matches(left: DataFrame, right: DataFrame, block: str | None, threshold: float, least_length: int = 3) -> DataFrame:
    """(key, match, score) of each left row (key, block, name) and the best right row (match, block, name) of its block, or
    of all where block is None, with at least the threshold; the smallest match among equals. Distinct names are compared
    once. Rows without a name match nothing."""
    if not 200 / 3 < threshold <= 100:
        raise ValueError("the threshold must be over 66.7")
    of = (lambda df: df.withColumn("block", F.col(block))) if block else (lambda df: df.withColumn("block", F.lit("")))
    rows = of(left).select("key", "block", "name").where(F.length("name") >= least_length)
    a = rows.select("block", "name").distinct().withColumn("sorted", sorted_words(F.col("name"))).where("sorted <> ''")
    b = of(right).where("name <> ''").groupBy("block", "name").agg(F.min("match").alias("match")).withColumn("sorted", sorted_words(F.col("name"))).where("sorted <> ''")
    b = b.groupBy("block", "sorted").agg(F.min("match").alias("match")).withColumn("name", F.col("sorted"))
    a_sorted = a.select("block", "sorted").distinct().withColumn("name", F.col("sorted"))
    rarity = a_sorted.select("sorted").unionByName(b.select("sorted")).select(F.explode(letter_pairs(F.col("sorted"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    ta, tb = (tokens(x, rarity, threshold).select("block", "token", F.col("sorted").alias(n)) for x, n in ((a_sorted, "a"), (b, "b")))
    share = threshold / (200.0 - threshold)
    la, lb = F.length("a"), F.length("b")
    met = ta.join(tb, ["block", "token"]).where(F.least(la, lb) >= share * F.greatest(la, lb) - 1e-9).select("block", "a", "b").distinct()
    scored = met.where(may_reach(F.col("a"), F.col("b"), threshold)).withColumn("score", ratio("a", "b")).where(F.col("score") >= threshold)
    found = scored.join(b.select("block", F.col("sorted").alias("b"), "match"), ["block", "b"])
    best = first_by(found, ["block", "a"], [F.col("score").desc(), F.col("match")]).select("block", F.col("a").alias("sorted"), "match", "score")
    return rows.join(a, ["block", "name"]).join(best, ["block", "sorted"]).select("key", "match", "score")


def review(matches: DataFrame, most: int = 20) -> DataFrame:
    """The best and the worst matches (key, match, score), for a look before they are used."""
    best = matches.orderBy(F.col("score").desc(), "key").limit(most).withColumn("end", F.lit("best"))
    worst = matches.orderBy("score", "key").limit(most).withColumn("end", F.lit("worst"))
    return best.unionByName(worst)
