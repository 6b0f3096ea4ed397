"""Nearest neighbours against brute force: recall, exact scores, ties, odd rows, blocks of queries."""

import numpy as np
import pytest

from gatework.llm import nearest as nn
from gatework.llm.registry import QUERIES

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, k=5, every=50, dim=64):
    good = [(i, np.array(v, float)) for i, v in rows if v and len(v) == dim and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for n, (q, a) in enumerate(good):
        if q is not None and q % every == 0:
            scored = [(float(nn.cosines(a[None], b[None])[0]), i) for m, (i, b) in enumerate(good) if m != n]
            out.setdefault(q, []).append(sorted(scored, key=lambda t: (-t[0], t[1] is None, t[1]))[:k])
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.score, r.vec_id, r["rank"]))
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_and_scores(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    want, got = brute(rows), answers(QUERIES["op11_nearest_neighbours"](spark, path))
    assert set(got) == set(want) and all([r for _, _, r in g] == [1, 2, 3, 4, 5] for g in got.values())
    hits = sum(len({v for _, v in want[q][0]} & {v for _, v, _ in got[q]}) for q in want)
    assert hits >= 0.98 * 5 * len(want)
    by_id = dict(rows)
    for q, found in got.items():
        for score, v, _ in found:
            a, b = np.array(by_id[q], float), np.array(by_id[v], float)
            assert score == pytest.approx(a @ b / np.sqrt((a @ a) * (b @ b)), abs=1e-14)
        assert found == sorted(found, key=lambda t: (-t[0], t[1]))


def odd_rows():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 64))
    rows = [(i, (centres[i % 6] + 0.3 * rng.normal(size=64)).tolist()) for i in range(400)]
    rows += [(1000 + i, centres[0].tolist()) for i in range(30)]  # copies of one vector, of which 1000 is a query
    rows += [(50, rows[50][1]), (None, rows[100][1]), (None, centres[1].tolist())]
    rows += [(2000, None), (2050, []), (2100, [0.0] * 64), (2150, [None] + [1.0] * 63), (2200, [float("nan")] * 64), (2250, [float("inf")] * 64), (2300, [1.0] * 63)]
    return [*rows, (2350, (1e300 * centres[2]).tolist()), (2351, (1e-300 * centres[2]).tolist())]


@pytest.mark.parametrize("block", [3, 1 << 16])
def test_odd_rows(spark, block, monkeypatch):
    monkeypatch.setattr(nn, "QUERY_BLOCK", block)
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", "1 as row", "'x' as score", "2 as v", "3 as code")
    got, want = answers(nn.nearest(df)), brute(rows)
    assert set(got) == set(want) and len(want[50]) == 2 and len(got[50]) == 10
    hits = total = 0
    for q, lists in want.items():
        if len(lists) == 1:
            total, hits = total + 5, hits + sum(a[1] == b[1] for a, b in zip(lists[0], got[q], strict=True))
    assert hits >= 0.98 * total
    assert [v for _, v, _ in got[1000]] == [1001, 1002, 1003, 1004, 1005] and got[2350][0][:2] == (pytest.approx(1), 2351)


def test_few_and_none(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, -2.0])]
    got = answers(nn.nearest(spark.createDataFrame(rows, SCHEMA)))
    assert {q: [(v, r) for _, v, r in f] for q, f in got.items()} == {0: [(1, 1), (2, 2)]}
    for some in ([], [(0, [1.0, 2.0, 3.0])], [(7, [1.0]), (8, [2.0])]):
        df = nn.nearest(spark.createDataFrame(some, SCHEMA))
        assert df.columns == ["query_id", "rank", "vec_id", "score"] and df.count() == 0


def test_anisotropic_codes_shrink_the_parallel_residual():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 64))
    book = nn.Codebook(x)
    parts = book.parts(nn.unit(x))
    flat = parts.reshape(len(x), -1)

    def residuals(codes):
        r = flat - book.words[np.arange(len(book.words)), codes].reshape(len(x), -1)
        along = (r * flat).sum(1)
        return (r * r).sum(1), along**2

    nearest = ((parts[:, :, None, :] - book.words) ** 2).sum(3).argmin(2)
    (all_a, along_a), (all_n, along_n) = residuals(book.encoded(parts)), residuals(nearest)
    assert book.eta > 2 and along_a.mean() < 0.5 * along_n.mean() and (all_a + (book.eta - 1) * along_a).mean() < (all_n + (book.eta - 1) * along_n).mean()


def test_table_scores_are_the_codes_inner_products():
    rng = np.random.default_rng(4)
    x, q = rng.normal(size=(500, 7)), nn.unit(rng.normal(size=(9, 7)))
    book = nn.Codebook(x)
    codes, tables = book.packed(x), book.tables(q)
    both = np.stack([codes & 15, codes >> 4], 2).reshape(len(x), -1)
    decoded = book.words[np.arange(both.shape[1]), both].reshape(len(x), -1)
    assert np.allclose(sum(tables[j][codes[:, j]] for j in range(codes.shape[1])), decoded @ book.parts(q).reshape(9, -1).T, atol=1e-5)
