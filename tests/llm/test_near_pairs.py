import os
import random

from gatework.llm.near_pairs import near_deduplicated
from tests.llm.helpers import LOW, ODD, SCHEMA, frame


def plain_shingles(text):
    words = (text or "").translate(LOW).encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def survivors(rows):
    """Smallest id of each group of five-word Jaccard 0.8 and more, by comparing all pairs."""
    sets, label = [plain_shingles(t) for _, t, *_ in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and (sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    groups = {}
    for (i, *_), x in zip(rows, label, strict=True):
        groups.setdefault(x, []).append(i)
    return sorted(str(min((i for i in g if i is not None), default=None)) for g in groups.values())


def test_a_changed_word_of_sixty_goes(spark):
    words = [f"w{i}" for i in range(60)]
    other = [*words[:30], "changed", *words[31:]]
    kept = near_deduplicated(spark.createDataFrame([(1, " ".join(words), "en", "a", 1), (2, " ".join(other), "en", "a", 1)], SCHEMA))
    assert [r.doc_id for r in kept.collect()] == [1]


def test_callers_columns_stay_and_tables_go(spark, tmp_path):
    docs = frame(spark).selectExpr("*", "'mine' as dedup_key", "'mine' as DEDUP_ID", "'mine' as dedup_nth")
    folder = spark.conf.get("spark.checkpoint.dir", None)
    kept = near_deduplicated(docs)
    rows = kept.collect()
    assert kept.columns == docs.columns and rows and all(r.dedup_key == r.DEDUP_ID == r.dedup_nth == "mine" for r in rows)
    left = {n.rsplit("-", 1)[0] for n in os.listdir((folder or spark.conf.get("spark.checkpoint.dir")).removeprefix("file:"))}
    assert "kept" in left and not left & {"prefixes", "texts", "near-links", "candidates", "shared-shingles"}


def test_against_all_pairs(spark):
    r = random.Random(9)
    words = ["w%d" % i for i in range(200)]
    base = [[r.choice(words) for _ in range(n)] for n in (4, 5, 7, 8, 9, 12, 30, 60, 60, 150, 400)]
    line = [r.choice(words) for _ in range(15)]
    rows = list(ODD)
    for i in range(260):
        t = list(base[-1] if i % 4 == 0 else r.choice(base))
        for _ in range(r.randrange(5)):
            t[r.randrange(len(t))] = r.choice(words)
        rows.append((1000 + i, " ".join(t + line * (i % 3 == 0)), "en", "a", 1))
    docs = frame(spark, rows)
    for shard_rows in (4096, 16):
        kept = near_deduplicated(docs, shard_rows)
        assert kept.columns == docs.columns
        assert sorted(str(x.doc_id) for x in kept.collect()) == survivors(rows)
    assert near_deduplicated(spark.createDataFrame([], SCHEMA)).count() == 0
