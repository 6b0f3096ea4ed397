"""The k best codes of each page by keyword score, without making the pairs that can't be among them.

A score is bounded by the number of matched keywords alone: each was hit at least once, and the hits are at most those of
the page's most frequent words. So matches are counted first, for many codes in one row: LANES codes share a long, whose
bit fields are counters that one sum adds up, and a block of codes has LONGS of them. The k-th largest lower bound is what
a page's code must reach by its upper bound; only such pairs are made, get their hits and are scored.

Page words that no code has are dropped before the first shuffle. What shuffles next are rows of a page and a block, each
word's codes already added up by the task. Words of many pages go to SALTS tasks where the index isn't broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gatework.functions.codes import keyword_score
from gatework.functions.text import page_tokens

#: Counters of a long, bits of each (so up to 32,767 keywords a code), longs of a block, and tasks that share a word.
LANES, BITS, LONGS, SALTS = 4, 15, 8, 4
BLOCK = LANES * LONGS
#: What bounds may be off by rounding, and what scores may be rounded by before they are compared.
SLACK = 1e-8


def numbered(index: DataFrame) -> DataFrame:
    """index (code, title, keywords) with block and slot. A code list is small: one task numbers it."""
    rows = index.where(F.size("keywords") > 0).select("code", "title", "keywords", (F.row_number().over(Window.orderBy("code")) - 1).alias("nth"))
    return rows.select("code", "title", "keywords", F.floor(F.col("nth") / BLOCK).cast("int").alias("block"), (F.col("nth") % BLOCK).alias("slot"))


def postings(codes: DataFrame) -> DataFrame:
    """(word, block, s0, s1, ...): in each long, a one in the bit fields of the codes that have the word."""
    one = lambda j: F.when(F.floor(F.col("slot") / LANES) == j, F.expr(f"shiftleft(1L, {BITS} * (slot % {LANES}))")).otherwise(F.lit(0).cast("long"))
    words = codes.select("block", "slot", F.explode(F.array_distinct("keywords")).alias("word"))
    return words.groupBy("word", "block").agg(*[F.sum(one(j)).alias(f"s{j}") for j in range(LONGS)])


def page_words(pages: DataFrame, words: DataFrame) -> DataFrame:
    """(key, tokens, word, n): the words of each page that the index has, and how often; tokens counts all of its words."""
    tokens = pages.select("key", page_tokens(F.col("text")).alias("t")).select("key", F.size("t").alias("tokens"), F.explode("t").alias("word"))
    return tokens.join(words, "word", "left_semi").groupBy("key", "tokens", "word").agg(F.count("*").alias("n"))


def matches(found: DataFrame, codes: DataFrame, k: int) -> DataFrame:
    """(key, code, title, keywords, words, tokens, matched) of the pairs whose upper bound reaches the page's k-th largest
    lower bound. found: what page_words gives; words: the page's own words and counts."""
    salted = postings(codes).withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    rows = found.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(salted, ["word", "salt"])
    # hits also has both uses of `found` read the same columns, so that Spark shuffles its rows once
    sums = rows.groupBy("key", "tokens", "block").agg(F.sum("n").alias("hits"), *[F.sum(f"s{j}").alias(f"s{j}") for j in range(LONGS)]).repartition("key")

    sizes = codes.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("slot", F.size("keywords").alias("size")))).alias("codes"))  # BLOCK of them
    fields = ", ".join(f"int(shiftright(s{j}, {BITS * i}) & {(1 << BITS) - 1})" for j in range(LONGS) for i in range(LANES))
    counted = sums.join(sizes, "block").select(
        "key", "tokens", "block", "hits", F.expr(f"filter(transform(codes, c -> struct(c.slot as slot, c.size as size, element_at(array({fields}), c.slot + 1) as matched)), c -> c.matched > 0)").alias("codes")
    )
    low = F.transform("codes", lambda c: keyword_score(c["matched"], c["size"], c["matched"], F.col("tokens")))
    counted = counted.withColumn("lows", F.slice(F.sort_array(low, asc=False), 1, k))
    # k numbers of each block that the page meets; a page without k codes keeps all
    lows = F.flatten(F.collect_list("lows").over(Window.partitionBy("key")))
    counted = counted.withColumn("floor", F.try_element_at(F.sort_array(lows, asc=False), F.lit(k))).drop("lows")

    facts = found.groupBy("key").agg(F.collect_list(F.struct("word", "n")).alias("words"))
    pairs = counted.join(facts.withColumn("counts", F.sort_array(F.transform("words", lambda w: w["n"]), asc=False)), "key")
    most = lambda c: F.least(F.col("hits"), F.aggregate(F.slice("counts", F.lit(1), c["matched"]), F.lit(0).cast("long"), lambda a, n: a + n))
    reaches = lambda c: F.col("floor").isNull() | (keyword_score(c["matched"], c["size"], most(c), F.col("tokens")) >= F.col("floor") - SLACK)
    pairs = pairs.select("key", "tokens", "block", "words", F.explode(F.filter("codes", reaches)).alias("c")).select("key", "tokens", "block", "words", "c.slot", "c.matched")
    return pairs.join(codes, ["block", "slot"]).select("key", "code", "title", "keywords", "words", "tokens", "matched")


def best_codes(pages: DataFrame, index: DataFrame, k: int = 5, decimals: int | None = None) -> DataFrame:
    """(key, code, title, matched, score, rank): the k best codes of each page (key, text) that share a keyword with it;
    equal scores by code. With decimals, scores are rounded first. index: code, title, keywords."""
    codes = numbered(index)
    words = codes.select(F.explode("keywords").alias("word")).distinct()
    pairs = matches(page_words(pages, words), codes, k)
    hits = F.aggregate(F.filter("words", lambda w: F.array_contains("keywords", w["word"])), F.lit(0).cast("long"), lambda a, w: a + w["n"])
    score = keyword_score(F.col("matched"), F.size("keywords"), hits, F.col("tokens"))
    scores = pairs.select("key", "code", "title", F.col("matched").cast("long").alias("matched"), (score if decimals is None else F.round(score, decimals)).alias("score"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.col("score").desc(), "code"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)
