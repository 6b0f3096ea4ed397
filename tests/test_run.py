from gatework import run
from gatework.operators import fuzzy
from gatework.plans.derived import derived

SF = "/root/testdata/sf0.001"


def test_stages_from_the_command_line(spark, tmp_path, capsys):
    path = {n: str(tmp_path / n) for n in ("records", "codes", "rates", "results")}
    for n, p in path.items():
        derived(spark, SF, n).write.parquet(p)
    ins = lambda *names: [x for n in names for x in ("--in", f"{n}={path[n]}")]
    path["flagged"] = str(tmp_path / "flagged")
    assert run.main(["gates", *ins("records", "codes", "rates"), "--out", path["flagged"]], spark) == 0
    assert "priority_tier: 1" in capsys.readouterr().out and spark.read.parquet(path["flagged"]).count() == spark.read.parquet(path["records"]).count()
    assert run.main(["classify", *ins("flagged"), "--out", str(tmp_path / "no"), "--dry-run"], spark) == 0 and not (tmp_path / "no").exists()
    assert run.main(["quality", *ins("results", "codes"), "--last", "50"], spark) == 1
    assert run.main(["retry-failed", *ins("records", "results")], spark) == 0


def test_review(spark):
    m = spark.createDataFrame([(i, i, float(i)) for i in range(10)], "key int, match int, score double")
    assert sorted((r.key, r.end) for r in fuzzy.review(m, 2).collect()) == [(0, "worst"), (1, "worst"), (8, "best"), (9, "best")]
