import duckdb
import pytest

import corpus_pipeline
from gatework.llm import registry, sql
from tests.llm.helpers import ODD, SCHEMA
from tests.llm.test_decontamination import brute
from tests.llm.test_near_pairs import survivors

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_twins(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, SF).toPandas(), con.sql(registry.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert got[columns].sort_values(columns).round(6).astype(str).values.tolist() == want[columns].sort_values(columns).round(6).astype(str).values.tolist()


def test_stages_against_plain_versions(spark, tmp_path):
    rows = ODD + [(40 + i, f"document number {i} says something of its own about subject {i * 7} and theme {i * 13}", "en", f"s{i % 3}", 1) for i in range(30)]
    rows += [(90, rows[-1][1], "en", "s1", 1), (91, "x cat sat on the mat y", "en", "s2", 1)]
    items = [(1, "cat sat on the mat")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, columns = spark.read.parquet(str(tmp_path / "documents.parquet")), SCHEMA
    kept = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_dedup", "decontaminate", "mix_sources", "tokenise"]

    def run(name, docs):
        stages[name](spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    def ids(df):
        return sorted(str(r.doc_id) for r in df.collect())

    docs = run("language_id", docs)
    assert ids(docs) == sorted(str(r[0]) for r in kept) and docs.columns == [c.split()[0] for c in columns.split(", ")]
    docs = run("near_dedup", docs)
    first = set(survivors(kept))
    assert ids(docs) == sorted(first)
    docs = run("decontaminate", docs)
    once = {str(r[0]): r for r in kept if str(r[0]) in first}
    clean = [str(k) if k != -1 else "None" for k, *_, bad in brute(list(once.values()), items) if not bad]
    assert ids(docs) == sorted(clean)
    n = sum(len(r.text.split()) for r in docs.collect())
    docs = run("mix_sources", docs)
    assert abs(sum(len(r.text.split()) for r in docs.collect()) - n) <= 5
    out = run("tokenise", docs)
    assert out.count() == docs.count() and out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0 and sql.OP4
