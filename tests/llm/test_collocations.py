"""Collocations against plain counting, the sketch's one-sided error, long texts, the SQL twin."""

import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from gatework.llm import collocations as c
from gatework.llm import sql
from gatework.llm.registry import QUERIES
from tests.llm.helpers import LOW, ODD, frame


def plain(rows, longest=5, least=100, top=2000):
    counts, total = Counter(), Counter()
    for _, text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                counts.update((lang or "und", *words[i : i + k]) for i in range(len(words) - k + 1))
    kept = {g: f for g, f in counts.items() if len(g) > 2 and f >= least}
    out = []
    for (lang, *words), a in kept.items():
        n = total[lang]
        cuts = [(1000 * a * n // (counts[(lang, *words[:k])] * counts[(lang, *words[k:])]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        inside = lambda g: g[0] == lang and len(g) > len(words) + 1 and any(list(g[i : i + len(words)]) == words for i in range(1, len(g)))  # noqa: B023, E731
        if not any(inside(g) and 100 * f >= 100 * a for g, f in kept.items()):
            out.append((lang, " ".join(words), a, counts[(lang, *words[:k])], counts[(lang, *words[k:])], n, score))
    ranked = []
    for lang in {r[0] for r in out}:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(lang, i + 1, *r[1:]) for i, r in enumerate(own[:top])]
    return sorted(ranked)


def text_rows():
    rng = np.random.default_rng(3)
    words = ["New", "york", "city", "hall", "the", "of", "größe", "日本", "x1", "it's"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 40))) + rng.choice([".", ", ", "\n", "", "\r\x0b"]) + "a b c d e f " * int(rng.integers(0, 3)) for _ in range(300)]
    return [(i, t, ["en", "de", None, "und"][i % 4], "s", len(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("least", "top"), [(5, 2000), (12, 7), (300, 50)])
def test_plain(spark, least, top):
    rows = text_rows() + ODD
    df = c.collocations(frame(spark, rows).repartition(3), least=least, top=top)
    assert sorted(map(tuple, df.collect())) == plain(rows, least=least, top=top)


def test_twin(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    df = QUERIES["op12_collocations"](spark, "/root/testdata/sf0.01")
    assert sorted(map(tuple, df.collect())) == sorted(con.sql(f"SELECT {', '.join(df.columns)} FROM ({sql.OP12})").fetchall())


def test_empty(spark):
    df = c.collocations(frame(spark, []))
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and df.count() == 0


def test_small_parts_and_a_full_sketch_lose_nothing(spark, monkeypatch):
    """Few counters, small slices and messages: more survives the sketch, the answer stays."""
    monkeypatch.setattr(c, "SHARD_BITS", 6)
    monkeypatch.setattr(c, "LEAST_SHARDS", 2)
    monkeypatch.setattr(c, "SHARDS", 4)
    monkeypatch.setattr(c, "HELD_BYTES", 500)
    monkeypatch.setattr(c, "SENT_BYTES", 300)
    rows = text_rows()
    assert sorted(map(tuple, c.collocations(frame(spark, rows).repartition(3), least=8).collect())) == plain(rows, least=8)


def test_sketch_overestimates_only():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 5000).astype(np.uint64)[rng.integers(0, 5000, 200_000)]
    bits, least = c.SHARD_BITS + 1, 60
    total = {}
    for part in np.array_split(h, 7):
        for shard, cells in c.sent([part], bits, least, np.uint8):
            total.setdefault(shard, []).append(pa.scalar(cells))
    reached = {s: c.added(cells, least, np.uint8) >= least for s, cells in total.items()}
    values, counts = np.unique(h, return_counts=True)
    rows = []
    for r, cells in enumerate(c.counters(values, bits)):
        shard, at = cells >> c.SHARD_BITS, (cells & ((1 << c.SHARD_BITS) - 1)) + (r << c.SHARD_BITS)
        rows.append(np.array([reached[s][a] for s, a in zip(shard.tolist(), at.tolist(), strict=True)]))
    survivors = np.all(rows, axis=0)
    assert survivors[counts >= least].all() and (survivors & (counts < least)).sum() < 50 < (counts < least).sum()


@pytest.mark.parametrize("most", [3, 10, 50, 10_000])
def test_long_texts_are_cut_where_nothing_crosses(most):
    text = "one two three. four five six seven eight nine ten, é è; " * 4 + "no end here at all"
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "de"], "text": [text, "short"]})
    parts = [p for b in c.cut_long(batch, most) for p in b.column("text").to_pylist()]
    assert "".join(parts) == text + "short" and (most > len(text) or all(p[-1] in ".,; " or p == parts[-2] or p == "short" for p in parts))
    whole = Counter(w for _, g in c.grams([batch], 1 << 20) for k, at, h in g.hashes(5) for w in h.tolist())
    assert whole == Counter(w for _, g in c.grams([batch], most) for k, at, h in g.hashes(5) for w in h.tolist())
