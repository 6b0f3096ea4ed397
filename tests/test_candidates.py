"""Best codes by bounds: the same rows as from all pairs, and few pairs made."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gatework.operators import candidates as c
from gatework.operators.enrich import page_scores
from gatework.plans.documents import items, texts

WORDS = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]


def everything(pages, index, k):
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.col("score").desc(), "code"))
    scores = page_scores(pages, index).withColumn("score", F.round("score", 9))
    return {tuple(r) for r in scores.withColumn("rank", rank).where(F.col("rank") <= k).select("key", "code", "title", "matched", "score", "rank").collect()}


@pytest.mark.parametrize(("k", "seed"), [(1, 0), (5, 1), (50, 2)])
def test_same_as_all_pairs(spark, k, seed):
    rnd = random.Random(seed)
    pages = spark.createDataFrame([(i, " ".join(rnd.choices(WORDS, k=rnd.randint(0, 80)))) for i in range(120)] + [(500, None), (501, ""), (502, "of the and")], "key long, text string")
    codes = [(f"{i:03d}", f"t{i}", rnd.sample(WORDS, rnd.randint(1, 12))) for i in range(90)] + [("900", "twin", WORDS[:4]), ("901", "twin", WORDS[:4]), ("902", "none", [])]
    index = spark.createDataFrame(codes, "code string, title string, keywords array<string>")
    got = {tuple(r) for r in c.best_codes(pages.repartition(3), index, k, decimals=9).select("key", "code", "title", "matched", "score", "rank").collect()}
    assert got == everything(pages, index, k)


def test_most_pairs_are_never_made(spark):
    pages, index = texts(spark, "/root/testdata/sf0.01"), items(spark, "/root/testdata/sf0.01")
    codes = c.numbered(index)
    made = c.matches(c.page_words(pages, codes.select(F.explode("keywords").alias("word")).distinct()), codes, 5).count()
    best, pairs = c.best_codes(pages, index).count(), page_scores(pages, index).count()
    assert best <= made < 1.5 * best and made < pairs / 2
    plan = c.best_codes(pages, index)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_empty(spark):
    pages = spark.createDataFrame([], "key long, text string")
    index = spark.createDataFrame([("1", "t", ["abc"])], "code string, title string, keywords array<string>")
    assert c.best_codes(pages, index).count() == 0 and c.best_codes(spark.createDataFrame([(1, "abc")], "key long, text string"), index.limit(0)).count() == 0
