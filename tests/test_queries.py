"""Every query of the engine against its SQL twin."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as driver
from gatework.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df, columns):
    def text(v):
        if pd.isna(v):
            return "null"
        return f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind in "if" else str(v)

    return sorted(tuple(map(text, r)) for r in df[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_twin(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.sql(registry.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).columns


def test_entry(spark):
    assert driver.entry(spark).count() > 0 and set(driver.oracle_sql()) <= set(driver.queries())


def test_html_text_of_cut_references(spark, tmp_path):
    """Titles and headings cut inside a character reference, as the larger tables have them, by the query and its SQL."""
    ends = ["A &amp; b&amp", "A&am", "A&a", "A&", "A&quot", "A &quot;b&quo", "A &lt", "A&amp;amp", "A &amp;lt; b", "A &amp;amp; b", "A&#39;s &#3", "&copy; A&cop", "A&ampb; c", "A &copy2020", "A &notit; b", "A; &; &#; b"]
    html = [f"<html><head><title>{e}</title></head><body><h1>{e}</h1><p>{e} and {e}</p></body></html>" for e in ends for _ in range(4)]
    spark.createDataFrame([(i, f"http://a.example/{i}", h) for i, h in enumerate([*html, "", None])], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got, want = registry.QUERIES["q_html_text"](spark, str(tmp_path)).toPandas(), con.sql(registry.ORACLES["q_html_text"]).df()
    columns = sorted(want.columns)
    assert len(got) == 4 * len(ends) + 2 and rows(got, columns) == rows(want, columns)
    assert got.set_index("key").text[3] == "A & b&amp A & b&amp A & b&amp and A & b&amp"
