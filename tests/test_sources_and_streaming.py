import os

from gatework.sources import io
from gatework.streaming.incremental import Progress, pending, run_incremental


def test_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes('﻿id,name,x\n1,"He said ""hi""\nthere",007\n2,,\n'.encode())
    rows = io.read_csv(spark, str(path), ["id", "name", "x"]).collect()
    assert [tuple(r) for r in rows] == [("1", 'He said "hi"\nthere', "007"), ("2", None, None)]
    assert io.read_csv_or_empty(spark, str(tmp_path / "none.csv"), ["a", "b"]).columns == ["a", "b"]
    assert io.line_count(spark, str(path)) == 3
    df = spark.createDataFrame([("1", 'a "b",\nc')], "id string, name string")
    io.write_csv(df, str(tmp_path / "out"), ["name", "id", "missing"])
    back = io.read_csv(spark, str(tmp_path / "out"))
    assert back.columns == ["name", "id", "missing"] and back.first().name == 'a "b",\nc'


def test_json_rows(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"0": {"cik_str": 1, "ticker": "A", "title": "Acme"}, "1": {"cik_str": 2, "ticker": "B", "title": "Bolt"}}')
    assert sorted(r.title for r in io.read_registrants(spark, str(tmp_path / "r.json")).collect()) == ["Acme", "Bolt"]
    (tmp_path / "d.json").write_text('{"name": "Acme", "sic": "123", "addresses": {"business": {"stateOrCountry": "CA"}}}\n{"name": "B", "sic": "4567", "stateOfIncorporation": "DE"}\n')
    assert [(r.sic, r.state) for r in io.read_registrant_details(spark, str(tmp_path / "d.json")).collect()] == [("0123", "CA"), ("4567", "DE")]
    c = spark.createDataFrame([("Acme LLC", "ca"), ("Inc.", "ca"), (None, "ca")], "name string, phys_state string")
    assert [(r.name_norm, r.state) for r in io.contractors(c).collect()] == [("ACME", "CA")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", "a", 0.5), ("2", "b", 1.0)], "id string, stratum string, v double")
    io.write_split(df, str(tmp_path / "full"), str(tmp_path / "part"), "stratum = 'a'")
    assert spark.read.parquet(str(tmp_path / "full")).count() == 2 and spark.read.parquet(str(tmp_path / "part")).count() == 1
    io.write_tabs(df, str(tmp_path / "tabs"))
    assert sorted(x for x in os.listdir(tmp_path / "tabs") if "=" in x) == ["stratum=a", "stratum=b"]
    assert io.write_version(df, str(tmp_path / "v"), "1").endswith("version=1")
    io.append(df, str(tmp_path / "v2"))
    io.append(df, str(tmp_path / "v2"))
    assert spark.read.parquet(str(tmp_path / "v2")).count() == 4
    assert [r.v for r in io.formatted(df).orderBy("id").collect()] == ["0.50", "1.00"]


def test_incremental_runs_resume_without_doubles(spark, tmp_path):
    source, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    schema = "id long, v string"
    progress = Progress()
    spark.streams.addListener(progress)
    for start in (0, 5):  # the second run sees five ids again
        spark.createDataFrame([(i, "x") for i in range(start, start + 10)], schema).write.mode("append").parquet(source)
        run_incremental(spark, source, schema, lambda b: b.where("id <> 3"), out, checkpoint).awaitTermination()
    got = sorted(r.id for r in spark.read.schema("id long, v string").parquet(f"{out}/batch=*").collect())
    assert got == [i for i in range(15) if i != 3]
    spark.streams.removeListener(progress)


def test_of_equal_keys_the_first_that_passes_stays(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "bad", 1), (1, "good", 3), (1, "good", 2), (2, "bad", 1)], "id long, v string, ord int").coalesce(1).write.parquet(source)
    run_incremental(spark, source, "id long, v string, ord int", lambda b: b.where("v = 'good'"), str(tmp_path / "out"), str(tmp_path / "cp"), order=("ord",)).awaitTermination()
    got = spark.read.schema("id long, v string, ord int").parquet(f"{tmp_path}/out/batch=*").collect()
    assert [(r.id, r.v, r.ord) for r in got] == [(1, "good", 2)]


def test_workbook_rows(spark):
    df = spark.createDataFrame([(1, "Title", None), (2, "Code", "Rate"), (3, "0005", "5.91"), (4, None, "1"), (5, "1124", "4.72")], "n int, a string, b string")
    got = io.workbook_rows(df, 2, {"a": "code", "b": "rate"}, ["code"], "n")
    assert sorted((r.code, r.rate) for r in got.collect()) == [("0005", "5.91"), ("1124", "4.72")]


def test_pending(spark):
    targets = spark.createDataFrame([("1",), ("2",), ("3",)], "id string")
    done = spark.createDataFrame([("1", "CONFIRMED"), ("2", "SCRAPE_FAILED")], "id string, scrape_match_status string")
    assert sorted(r.id for r in pending(targets, done).collect()) == ["3"]
    assert sorted(r.id for r in pending(targets, done, ("SCRAPE_FAILED",)).collect()) == ["2", "3"]
