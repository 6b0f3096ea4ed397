"""A budget of calls, dealt to targets in an order of priority, run after run.

A run may make `budget` calls, and what a run leaves goes to the next. So after n runs `carried + n * budget` calls were to be
had, and a target's turn comes in the first run by which that covers the calls of all targets up to it: one prefix sum says
everything. It is made in two levels, ranges of the order and rows within a range, so no task sees all targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gatework.sources.io import durable
from gatework.streaming.incremental import pending


def summed_before(df: DataFrame, value: str, order: list[str], out: str) -> DataFrame:
    """df with `out`, the sum of `value` over all rows before it by the order (and then by all columns, so that a rerun
    agrees). df is written once, in ranges of the order; the sums of ranges are a row a partition."""
    ties = [c for c in df.columns if c not in order]
    keys = [*map(F.col, order), F.xxhash64(*ties) if ties else F.lit(0)]
    ranged = durable(df.repartitionByRange(*keys).withColumn("range_", F.spark_partition_id()), "ranges")
    starts = ranged.groupBy("range_").agg(F.sum(value).alias("sum_"))
    starts = starts.select("range_", F.coalesce(F.sum("sum_").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start_"))
    within = Window.partitionBy("range_").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.withColumn("inner_", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return rows.join(starts, "range_").withColumn(out, F.col("start_") + F.col("inner_")).drop("range_", "start_", "inner_")


def dealt(targets: DataFrame, calls: Column, order: list[str], budget: int, carried: int = 0) -> DataFrame:
    """targets with calls, calls_before (of all targets before it) and run, counted from 1: when its turn comes. A target is
    served whole or not at all; one that needs no call is served with those before it. A null number of calls is none."""
    if budget <= 0:
        raise ValueError("a run needs a budget of at least one call")
    df = summed_before(targets.withColumn("calls", F.coalesce(calls.cast("long"), F.lit(0).cast("long"))), "calls", order, "calls_before")
    end = F.col("calls_before") + F.col("calls") - carried
    return df.withColumn("run", F.greatest(F.lit(1).cast("long"), F.ceil(end.cast("decimal(20,0)") / F.lit(budget)).cast("long")))


def next_run(targets: DataFrame, done: DataFrame, calls: Column, order: list[str], budget: int, carried: int = 0, retry: tuple[str, ...] = ()) -> DataFrame:
    """The pending targets that the next run serves. Repeated before its results are in `done`, it serves the same."""
    return dealt(pending(targets, done, retry), calls, order, budget, carried).where("run = 1").drop("run")


def ledger(rows: DataFrame, budget: int, carried: int = 0) -> DataFrame:
    """(run, targets, calls, left) of what dealt() gives: the calls of each run that serves any, and what is left after it."""
    runs = rows.groupBy("run").agg(F.count("*").alias("targets"), F.sum("calls").alias("calls"), F.max(F.col("calls_before") + F.col("calls")).alias("spent"))
    return runs.select("run", "targets", "calls", (F.lit(carried) + F.lit(budget) * F.col("run") - F.col("spent")).alias("left"))


def search_calls(source: Column, status: Column, pages: int) -> Column:
    """Calls that a company takes: a search unless its site is found by a guess, and its pages, or one that fails."""
    return F.when(source == "guess", 0).otherwise(1) + F.when(status == "SCRAPE_FAILED", 1).when(status == "NO_WEBSITE", 0).otherwise(pages)
