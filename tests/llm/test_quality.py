import math

import numpy as np
import pyarrow as pa

from gatework.llm.quality import BETA, BUCKETS, L1, L2, PASSES, RATE, features, learn_batches, quality_report, trained, within
from tests.llm.helpers import ODD, frame, remainder


def test_held_out_accuracy(spark):
    r = np.random.default_rng(0)
    words = ["word%d" % i for i in range(300)]
    rows = [(i, " ".join(r.choice(words, 40)) if i % 3 else " ".join(w.upper() + "!!" for w in r.choice(words, 40)), "en", "a", 1) for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(240)] + [(None, 1, 0), (500, None, 0), (1, 7, 0)], "doc_id long, quality int, toxic int")
    got = quality_report(frame(spark, rows), labels).collect()
    held = [g for g in got if g.held_out]
    assert held and sum(g.predicted == int(g.doc_id % 3 > 0) for g in held) >= 0.97 * len(held)
    assert all(g.held_out == (remainder(g.doc_id, 3) == 1) and g.predicted == int(g.score >= 0.5) and 0 <= g.score <= 1 for g in got)


def test_odd_rows_and_no_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_report(frame(spark), none).collect()
    assert len(got) == len(ODD) and {g.score for g in got} == {0.5}
    assert quality_report(frame(spark, []), none).count() == 0


def plain_ftrl(rows):
    """FTRL-proximal a coordinate at a time, as published."""
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= L1:
            return 0.0
        return (math.copysign(L1, z[i]) - z[i]) / ((BETA + math.sqrt(n[i])) / RATE + L2)

    for _ in range(PASSES):
        for label, x in rows:
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - label) * v
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / RATE
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z if weight(i)}


def test_updates_against_plain_ftrl():
    r = np.random.default_rng(6)
    rows = []
    for _ in range(120):
        buckets = np.sort(r.choice(40, r.integers(1, 9), replace=False))
        values = r.random(len(buckets)).astype(np.float32)
        rows.append((float(buckets.sum() % 3 == 0), dict(zip(buckets.tolist(), values.tolist(), strict=True))))
    batch = pa.RecordBatch.from_arrays(
        [pa.array([y for y, _ in rows]), pa.array([list(x) for _, x in rows], pa.list_(pa.int32())), pa.array([list(x.values()) for _, x in rows], pa.list_(pa.float32()))], ["label", "bucket", "value"]
    )
    got = next(learn_batches(iter([batch])))
    found = dict(zip(got.column("bucket").to_pylist(), got.column("weight").to_pylist(), strict=True))
    want = plain_ftrl([(y, x | {BUCKETS: 1.0}) for y, x in rows])
    assert want and set(found) == set(want) and all(abs(found[i] - want[i]) < 1e-5 for i in want)


def test_features_have_unit_length():
    text, _, value = features(pa.array(["A small TEXT, a small text.", None, "", "x"]))
    assert np.allclose(np.bincount(text, value * value, 4), [1, 0, 0, 1])


def test_the_sample_is_bounded_in_bytes(spark):
    rows = [(10, 1, 1.0, "a" * 40), (20, 2, 0.0, None), (30, 3, 1.0, "é" * 30), (40, 4, 1.0, "x" * 500), (50, 5, 0.0, "b" * 10), (60, 6, 0.0, "c")]
    df = spark.createDataFrame(rows, "draw long, doc_id long, label double, text string")
    ids = lambda most: sorted(r.doc_id for r in within(df, most).collect())
    assert ids(1000) == [1, 2, 3, 4, 5, 6] and ids(111) == [1, 2, 3, 5, 6] and ids(105) == [1, 2, 3] and ids(99) == [1, 2] and ids(1) == [2, 6] and ids(0) == [2]


def test_long_texts_are_learned_from_within_the_bound(spark):
    """Many long texts: the fit takes what the bound allows, and knows the two kinds apart."""
    rows = [(i, ("good fine " if i % 2 else "BAD worse!! ") * 2000, "en", "a", 1) for i in range(400)]
    from pyspark.sql import functions as F

    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    weights = trained(frame(spark, rows), labels, F.lit(True), most=1 << 20)
    assert np.count_nonzero(weights) > 2
