"""Budgets dealt run after run, against a plain loop; reruns; resumed runs read no earlier output."""

import random

import pytest
from pyspark.sql import functions as F

from gatework.streaming.budget import dealt, ledger, next_run, summed_before
from gatework.streaming.incremental import Progress, run_incremental

SCHEMA = "id string, priority int, calls_ int"


def plain(rows, budget, carried):
    """Each run has the budget and what is left, and serves targets in order until one doesn't fit."""
    todo, left, run, out = sorted(rows, key=lambda r: (r[1], int(r[0]))), carried, 0, {}
    while todo:
        run, left = run + 1, left + budget
        while todo and (todo[0][2] or 0) <= left:
            i, _, calls = todo.pop(0)
            left -= calls or 0
            out[i] = run
    return out


@pytest.mark.parametrize(("budget", "carried"), [(1, 0), (7, 3), (50, 0), (100_000, 5)])
def test_runs(spark, budget, carried):
    rnd = random.Random(budget)
    rows = [(str(i), rnd.randint(0, 3), rnd.choice([0, 1, 1, 3, 20, None])) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n", F.col("id").cast("int")).repartition(7)
    got = dealt(df, F.col("calls_"), ["priority", "n"], budget, carried)
    want = plain(rows, budget, carried)
    assert {r.id: r.run for r in got.collect()} == want
    spent = carried
    for r in ledger(got, budget, carried).orderBy("run").collect():
        own = sum(c or 0 for i, _, c in rows if want[i] == r.run)
        spent += own
        assert r.calls == own and r.left == 2 * carried + budget * r.run - spent and 0 <= r.left


def test_a_rerun_serves_the_same_and_the_next_run_goes_on(spark):
    targets = spark.createDataFrame([(str(i), 0, 2) for i in range(20)], SCHEMA).withColumn("n", F.col("id").cast("int"))
    done = spark.createDataFrame([], "id string, scrape_match_status string")
    served, carried = [], 0
    for _ in range(3):
        batch = [sorted(r.id for r in next_run(targets, done, F.col("calls_"), ["n"], 7, carried).collect()) for _ in range(2)]
        assert batch[0] == batch[1]
        served.append(len(batch[0]))
        carried += 7 - 2 * len(batch[0])
        done = done.union(spark.createDataFrame([(i, "CONFIRMED") for i in batch[0]], "id string, scrape_match_status string"))
    assert served == [3, 4, 3] and carried == 1


def test_no_task_sees_all_rows(spark):
    df = summed_before(spark.range(1000).withColumn("v", F.lit(2)), "v", ["id"], "before")
    assert [r.before for r in df.orderBy("id").collect()] == [2 * i for i in range(1000)]
    assert df.select(F.spark_partition_id()).distinct().count() >= 1 and "range_" in df._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        dealt(df, F.lit(1), ["id"], 0)


def test_batches_read_no_earlier_output(spark, tmp_path):
    """Twenty batches: each reads its own rows only, and the state has all keys."""
    source, progress = str(tmp_path / "in"), Progress()
    spark.streams.addListener(progress)
    for n in range(20):
        spark.createDataFrame([(i, n) for i in range(n * 5, n * 5 + 10)], "id long, v int").coalesce(1).write.mode("append").parquet(source)
    query = run_incremental(spark, source, "id long, v int", lambda b: b.where("id <> 3"), str(tmp_path / "out"), str(tmp_path / "cp"), files=1)
    query.awaitTermination()
    got = {r.id: r.v for r in spark.read.schema("id long, v int").parquet(f"{tmp_path}/out/batch=*").collect()}
    assert got == {i: max(0, i // 5 - 1) for i in range(105) if i != 3}
    spark.streams.removeListener(progress)
    read = [n for batches in progress.batches.values() for n in batches]
    assert sum(read) <= 20 * 10 * 2 and max(read) == 10


def test_a_batch_that_failed_between_work_and_output_is_finished(spark, tmp_path):
    source, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    spark.createDataFrame([(i, i % 2) for i in range(6)], "id long, v int").write.parquet(source)
    made = []

    def work(batch):
        made.append(1)
        return batch

    (tmp_path / "out").write_text("in the way")  # the results can't be put where they belong
    with pytest.raises(Exception, match="batch=0|out"):
        run_incremental(spark, source, "id long, v int", work, out, cp).awaitTermination()
    (tmp_path / "out").unlink()
    run_incremental(spark, source, "id long, v int", work, out, cp).awaitTermination()
    assert sorted(r.id for r in spark.read.schema("id long, v int").parquet(f"{out}/batch=*").collect()) == list(range(6))
