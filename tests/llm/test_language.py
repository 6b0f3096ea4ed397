import numpy as np
from pyspark.sql import functions as F

from gatework.llm.language import SWITCH, Model, identify, language_report, lattice, trained, with_language
from tests.llm.helpers import ODD, frame, remainder

EN = "the house is big and the dog sleeps with the children in the garden of the old town"
FR = "la maison est grande et le chien dort avec les enfants dans le jardin de la vieille ville"
RU = "дом большой и собака спит с детьми в саду старого города"


def corpus(spark):
    rows = [(i, " ".join(np.random.default_rng(i).permutation(t.split())), lang, "a", 1) for i in range(120) for lang, t in [[("en", EN), ("fr", FR), ("ru", RU)][i % 3]]]
    return rows, frame(spark, rows, extra=False)


def test_held_out_accuracy_and_undetermined_texts(spark):
    rows, docs = corpus(spark)
    got = {r.doc_id: r for r in language_report(docs.unionByName(frame(spark, [(1000, None, None, "a", 0), (1001, "123 !!", "en", "a", 1), (1002, "", "fr", "a", 1)], extra=False))).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang, *_ in rows)
    assert all(got[i].held_out == (remainder(i, 4) == 2) for i in got)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002))
    assert all(0 <= r.score <= 1 for r in got.values())


def test_spans_of_mixed_text(spark):
    _, docs = corpus(spark)
    model = trained(docs, F.lit(True))
    mixed = spark.createDataFrame([(1, f"{EN} {FR} {RU}")], "doc_id long, text string")
    spans = identify(mixed, model).first().spans
    assert [s.lang for s in spans] == ["en", "fr", "ru"]
    assert abs(spans[0].words - len(EN.split())) <= 2 and spans[2].words == len(RU.split())


def test_scripts_narrow_candidates(spark):
    _, docs = corpus(spark)
    model = trained(docs, F.lit(True))
    got = identify(spark.createDataFrame([(1, "город"), (2, "xyzzy")], "doc_id long, text string"), model).collect()
    assert {r.doc_id: r.lang_pred for r in got}[1] == "ru" and {r.doc_id: r.lang_pred for r in got}[2] != "ru"


def plain_viterbi(scores):
    value, back = scores[0].copy(), []
    for s in scores[1:]:
        best = int(value.argmax())
        stay = value >= value[best] - SWITCH
        back.append(np.where(stay, np.arange(len(s)), best))
        value = s + np.where(stay, value, value[best] - SWITCH)
    path = [int(value.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def worth(scores, path):
    return scores[np.arange(len(path)), path].sum() - SWITCH * (np.diff(path) != 0).sum()


def test_paths_are_best():
    r = np.random.default_rng(4)
    sizes = np.array([1, 30, 7, 0, 90])
    scores = r.normal(0, 6, (sizes.sum(), 3))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    model = Model.__new__(Model)
    model.languages = ["a", "b", "c"]
    got, full = model.paths(scores, ends), lattice(scores[: sizes.sum()], sizes[sizes > 0])
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        if b > a:
            want = worth(scores[a:b], np.array(plain_viterbi(scores[a:b])))
            assert abs(worth(scores[a:b], got[a:b]) - want) < 1e-9 and abs(worth(scores[a:b], full[a:b]) - want) < 1e-9


def test_odd_rows(spark):
    assert language_report(frame(spark)).count() == len(ODD)
    kept = with_language(frame(spark))
    assert kept.columns == frame(spark).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in ODD if any(c.isalpha() for c in r[1] or ""))
    assert language_report(frame(spark, [])).count() == 0 and with_language(frame(spark, [])).count() == 0
    unlabelled = [(i, "some text here", None, "a", 1) for i in range(4)]
    assert {r.lang_pred for r in language_report(frame(spark, unlabelled)).collect()} == {"und"}
