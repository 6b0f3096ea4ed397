import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatework.llm.language import held_out
from gatework.llm.language_model import ASKED, MU, answered, collected, passed_back, passed_on, questions, score_texts, table_of
from tests.llm.helpers import LOW, ODD, frame, remainder


def tokens(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)), None]


@pytest.mark.parametrize(("blocks", "bits"), [(3, 7), (21, 2)])
def test_against_brute_force(spark, blocks, bits):
    """One level of merging, and three."""
    rows = ODD + [(None, "no id, the same text", "en", "a", 1)] * 9 + [(50 + i, "the cat %d sat on the mat, the dog %d too" % (i % 5, i % 3), "en", "a", 1) for i in range(60)]
    got = score_texts(frame(spark, rows), held_out(F.col("doc_id"), 5, 1), blocks=blocks, bits=bits).collect()
    held = lambda i: i is not None and remainder(i, 5) == 1
    one, two = Counter(), Counter()
    for i, t, *_ in rows:
        if not held(i):
            w = tokens(t)
            one.update(w)
            two.update(zip([None, *w[:-1]], w, strict=True))
    n, v = sum(one.values()), len(one)
    z = n + 0.5 * (v + 1)
    want = []
    for i, t, *_ in rows:
        w = tokens(t)
        base = sum(math.log10((one[x] + 0.5) / z) for x in w)
        score = sum(math.log10((two[h, x] + MU * (one[x] + 0.5) / z) / (one[h] + MU)) for h, x in zip([None, *w[:-1]], w, strict=True))
        want.append((-1 if i is None else i, held(i), len(w), sum(one[x] > 0 for x in w), n, round(base, 6), round(score, 6)))
    found = [(-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got]
    assert sorted(found) == sorted(want)


def test_probabilities_after_a_word_sum_to_one(spark):
    """All known words and one unknown word, after a word that is known."""
    rows = [(i, "a b c a b d", "en", "a", 1) for i in range(5)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    asks = spark.createDataFrame([(100 + k, f"a {w}") for k, w in enumerate(["a", "b", "c", "d", "zzz", ""])], "doc_id long, text string")
    both = train.select("doc_id", "text").unionByName(asks)
    got = {r.doc_id: r.score for r in score_texts(both, F.col("doc_id") >= 100, blocks=2).collect()}
    first = got[105]  # log P(a | start) + log P(end | a)
    end = 10 ** (first - math.log10(p_first(rows)))
    total = end + sum(10 ** (got[100 + k] - math.log10(p_first(rows)) - after(rows, w)) for k, w in enumerate(["a", "b", "c", "d", "zzz"]))
    assert abs(total - 1) < 1e-9


def counts(rows):
    one, two = Counter(), Counter()
    for _, t, *_ in rows:
        w = tokens(t)
        one.update(w)
        two.update(zip([None, *w[:-1]], w, strict=True))
    z = sum(one.values()) + 0.5 * (len(one) + 1)
    return one, two, z


def p_first(rows):
    one, two, z = counts(rows)
    return (two[None, "a"] + MU * (one["a"] + 0.5) / z) / (one[None] + MU)


def after(rows, w):
    """log P(end | w)."""
    one, two, z = counts(rows)
    return math.log10((two[w, None] + MU * (one[None] + 0.5) / z) / (one[w] + MU))


def test_no_training_rows_and_no_rows(spark):
    got = score_texts(frame(spark), F.lit(True)).collect()
    assert len(got) == len(ODD) and all(r.train_tokens == 0 and r.n_known == 0 for r in got)
    assert score_texts(frame(spark, []), F.lit(False)).count() == 0


def test_counts_beyond_32_bits_and_messages_of_a_block():
    """Two groups of blocks ask for the same words; the range above merges both."""
    bits, hashes = 1, np.array([5, 9, 1 << 63, (1 << 63) + 1], np.uint64)
    level_1 = {}
    for block, n in enumerate([2**33, 7, 2**40]):
        asked = list(questions(block, 0, 1, 0, hashes, np.full(4, n), bits)) + list(questions(block, 0, 1, 1, hashes[:0], np.zeros(0), bits))
        assert len(asked) == 2 * 2**bits
        for q in asked:
            level_1.setdefault(q[:2], []).append(q)
    level_2 = {}
    for rows in level_1.values():
        for q in passed_on(table_of(rows, ASKED), 1, bits).to_pylist():
            level_2.setdefault((q["range"], q["parent"]), []).append(tuple(q.values()))
    back = [a for rows in level_2.values() for a in answered(table_of(rows, ASKED), bits).to_pylist()]
    for (of, parent), rows in level_1.items():
        mine = [a for a in back if (a["upper"], a["child"]) == (of, parent)]
        answers = passed_back(table_of(rows, ASKED), type(table_of([], ASKED)).from_pylist(mine), bits)
        assert collected(answers, 0).tolist() == [2**33 + 7 + 2**40] * 2 * len({q[2] for q in rows})
        assert {(a["tokens"], a["seen"]) for a in answers.to_pylist() if a["kind"] == 0} == {(2 * (2**33 + 7 + 2**40), 2)}


def test_partitions_are_bounded():
    from gatework.llm.language_model import PARTITIONS, partitions

    assert partitions(5) == 15 and partitions(100_000) == partitions(10_000_000) == PARTITIONS
