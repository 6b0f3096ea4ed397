"""Samples and lists of large groups: as from sorting whole groups, without doing so."""

import hashlib
import random

from pyspark.sql import functions as F

from gatework.operators import persistence, validation


def test_sample_is_of_the_smallest_draws(spark):
    rows = [(i, "ABC"[i % 3] if i % 5 else "A") for i in range(6000)] + [(7, "A"), (None, "B")]
    pool = spark.createDataFrame(rows, "id int, tier string").repartition(5)
    sizes = spark.createDataFrame([("A", 40), ("B", 1), ("C", 5000), ("D", 3)], "tier string, allotted long")
    got = sorted((r.tier, str(r.id)) for r in validation.stratified(pool, sizes, "tier", 11, digits=2).collect())
    want = []
    for tier, n in (("A", 40), ("B", 1), ("C", 5000)):
        own = sorted((hashlib.md5(f"11:{'' if i is None else i}".encode()).hexdigest(), str(i)) for i, t in rows if t == tier)
        want += [(tier, i) for _, i in own[:n]]
    assert got == sorted(want)


def test_few_rows_are_ranked(spark):
    pool = spark.range(20_000).select("id", F.lit("A").alias("tier"))
    sizes = spark.createDataFrame([("A", 10)], "tier string, allotted long")
    df = validation.stratified(pool, sizes, "tier", 3)
    assert df.count() == 10 and df.columns == ["tier", "id"]
    assert 10 <= validation.near_draws(pool, sizes, "tier", 3, "id", 4).count() <= 12


def test_lists_are_cut_like_joined_sets(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choices("abé ", k=rnd.choice([1, 1, 2, 5, 30, 250])))
    rows = [(rnd.choice(["1", "2", "3", None]), rnd.choice([word(), word(), "", None, " x "])) for _ in range(3000)] + [("4", " "), ("5", "z" * 300), ("5", "z" * 300 + "y")]
    df = spark.createDataFrame(rows, "ein string, name string").repartition(4)
    got = {r.ein: r.names for r in persistence.name_list(df, "ein", "name", "names").collect()}
    want = {}
    for key in "1235":
        values = sorted({v.strip() for k, v in rows if k == key and v and v.strip()})
        want[key] = "; ".join(values)[:200]
    assert got == want
    whole = {r.ein: r.names for r in persistence.name_list(df, "ein", "name", "names", ", ", None).collect()}
    assert whole["5"] == "z" * 300 + ", " + "z" * 300 + "y"
