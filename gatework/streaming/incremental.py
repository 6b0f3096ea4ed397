"""Resumable incremental work: what is done is skipped, failures may be tried again, results have one row an id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from gatework.operators.lookup import first_by
from gatework.sources.io import exists


def pending(targets: DataFrame, done: DataFrame, retry: tuple[str, ...] = (), status: str = "scrape_match_status") -> DataFrame:
    """targets that are not done; results of the statuses in retry count as not done."""
    kept = done.where(~F.coalesce(F.col(status), F.lit("")).isin(*retry)) if retry else done
    return targets.join(kept.select("id").distinct(), "id", "left_anti")


def run_incremental(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: str = "id", files: int = 100, names: str = "*.parquet", order: tuple[str, ...] = ()) -> StreamingQuery:
    """Works off all new Parquet files under `source` and ends. Of a key that comes again among a batch's results the first
    by `order`, and then by all columns, stays; of one that an earlier batch has, the earlier result.

    work may be anything that a batch allows, so it runs on batches; its results go to a folder of the batch's number in
    `checkpoint`. A second stream takes them from there and drops keys that it has in its state: a batch meets the state of
    its own keys only, and earlier output is never read again. Its batches go to folders of `out`, replaced if repeated.
    A restart after a failure neither loses nor doubles any: a batch's results, once whole, are not made anew."""
    found = f"{checkpoint}/found"

    def each(batch: DataFrame, number: int) -> None:
        path = f"{found}/batch={number}"
        fresh = work(batch)
        if not exists(spark, f"{path}/_SUCCESS"):
            fresh = first_by(fresh, [key], [F.col(c) for c in (*order, *(c for c in fresh.columns if c not in order))])
            fresh.write.mode("overwrite").parquet(path)
        results = spark.readStream.schema(fresh.schema).parquet(f"{found}/batch=*").dropDuplicates([key])
        keep = lambda rows, n: rows.select(*fresh.columns).write.mode("overwrite").parquet(f"{out}/batch={n}")
        results.writeStream.foreachBatch(keep).option("checkpointLocation", f"{checkpoint}/keys").trigger(availableNow=True).start().awaitTermination()

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", names).parquet(source)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{checkpoint}/work").trigger(availableNow=True).start()


class Progress(StreamingQueryListener):
    """Rows worked off so far, by query, and the rows that each of its batches read."""

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.batches: dict[str, list[int]] = {}

    def onQueryStarted(self, event):
        self.rows[str(event.id)] = 0

    def onQueryProgress(self, event):
        query, n = str(event.progress.id), event.progress.numInputRows
        self.rows[query] = self.rows.get(query, 0) + n
        if n:
            self.batches.setdefault(query, []).append(n)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass
