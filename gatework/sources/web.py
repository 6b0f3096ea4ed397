"""Pages, search results and details fetched over HTTP, at a polite rate, a task a host.

Calls to one host are spaced by `delay` seconds whatever the cluster's size: a host's targets go to one task, or, for hosts
with very many, to `lanes` tasks that wait `lanes` times as long. Answers that may change on a second try (no connection,
429, 5xx) are tried again after growing waits; others are answers. A row comes out for every target, also if all tries
failed, so that a run can be resumed by what is missing or failed.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gatework.operators.pages import host
from gatework.sources.io import exists
from gatework.streaming.incremental import pending

FETCHED = "id string, url string, status int, body string, error string, tries int"


@dataclass(frozen=True)
class Manners:
    """delay: seconds between two calls of a lane of a host; tries and wait: how often, and after how long at first (twice as
    long each time); timeout of a call; most: bytes of an answer, beyond which it is an error and not a cut text."""

    delay: float = 1.0
    tries: int = 3
    wait: float = 0.5
    timeout: float = 10.0
    most: int = 32 << 20
    lanes: int = 1
    agent: str = "Mozilla/5.0 (compatible; gatework)"


def get(url: str, m: Manners) -> tuple[int, str]:
    """Status and text of one call."""
    request = urllib.request.Request(url, headers={"User-Agent": m.agent, "Accept": "*/*"})
    try:
        with urllib.request.urlopen(request, timeout=m.timeout) as answer:
            body = answer.read(m.most + 1)
            if len(body) > m.most:
                raise ValueError(f"over {m.most} bytes")
            return answer.status, body.decode(answer.headers.get_content_charset() or "utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, ""


def tried(url: str, m: Manners, call: Callable[[str, Manners], tuple[int, str]], pause: Callable[[], None]) -> tuple[int | None, str, str, int]:
    """status, body, error, tries. pause is called before every call and keeps the rate."""
    error, status = "", None
    for n in range(1, m.tries + 1):
        pause()
        try:
            status, body = call(url, m)
            if status != 429 and status < 500:
                return status, body, "", n
            error = f"status {status}"
        except ValueError as e:  # an address that is none, an answer that is too long: the same next time
            return None, "", str(e), n
        except Exception as e:
            status, error = None, f"{type(e).__name__}: {e}"
        if n < m.tries:
            time.sleep(m.wait * 2 ** (n - 1))
    return status, "", error, m.tries


def answers(targets: Iterator[tuple[str, str]], m: Manners, call=get) -> Iterator[tuple]:
    """(id, url, status, body, error, tries) of each (id, url), in order; calls to a host are spaced by the lanes' delay."""
    last: dict[str, float] = {}
    for key, url in targets:
        name = urllib.parse.urlsplit(url or "").netloc

        def pause(name=name):
            ready = last.get(name, 0.0) + m.delay * m.lanes
            time.sleep(max(0.0, ready - time.monotonic()))
            last[name] = time.monotonic()

        yield key, url, *(tried(url, m, call, pause) if url else (None, "", "no url", 0))


def fetched(targets: DataFrame, manners: Manners | None = None, call=get) -> DataFrame:
    """A row for each target (id, url): status, body, error (empty if there was an answer), tries. Null urls are errors."""
    m = manners or Manners()

    def run(batches):
        for batch in batches:
            for row in answers(zip(batch.column("id").to_pylist(), batch.column("url").to_pylist(), strict=True), m, call):
                yield pa.RecordBatch.from_pydict({n: pa.array([v], kind) for n, v, kind in zip(FIELDS, row, KINDS, strict=True)})

    lane = F.pmod(F.xxhash64("id", "url"), F.lit(m.lanes))
    rows = targets.select(F.col("id").cast("string").alias("id"), "url").repartition(host(F.coalesce("url", F.lit(""))), lane)
    return rows.mapInArrow(run, FETCHED)


FIELDS = [f.split()[0] for f in FETCHED.split(", ")]
KINDS = [{"string": pa.string(), "int": pa.int32()}[f.split()[1]] for f in FETCHED.split(", ")]


def run_fetch(spark: SparkSession, targets: DataFrame, out: str, wave: int = 10_000, manners: Manners | None = None, call=get) -> DataFrame:
    """Fetches the targets that `out` has no answer to, in waves of about `wave` calls, each written when it is whole; returns
    the answers so far, the last of each id. A run that ends early loses its last wave only: the next one goes on from there."""
    m = manners or Manners()
    done = spark.read.schema(FETCHED).parquet(out).where("error = ''") if exists(spark, out) else spark.createDataFrame([], FETCHED)
    todo = pending(targets.select(F.col("id").cast("string").alias("id"), "url"), done)
    waves = -(-todo.count() // wave)
    first = 1 + max((int(f.getPath().getName().split("=")[1]) for f in folders(spark, out)), default=-1)
    for n in range(waves):
        # the targets of a wave are fixed by their ids, so what other waves have written meanwhile changes none
        part = todo.where(F.pmod(F.xxhash64("id", F.lit("wave")), F.lit(waves)) == n)
        fetched(part, m, call).write.mode("overwrite").parquet(f"{out}/wave={first + n}")
    rows = spark.read.schema(f"{FETCHED}, wave int").parquet(out) if exists(spark, out) else spark.createDataFrame([], f"{FETCHED}, wave int")
    return rows.groupBy("id").agg(F.max_by(F.struct(*FIELDS[1:]), F.struct((F.col("error") == "").alias("ok"), "wave")).alias("r")).select("id", "r.*")


def folders(spark: SparkSession, path: str) -> list:
    if not exists(spark, path):
        return []
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return [f for f in there.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(there) if f.getPath().getName().startswith("wave=")]


def search_urls(endpoint: str, company: Column, city: Column, state: Column) -> Column:
    """The address of a search: the company's name in quotes, then its place."""
    words = F.concat(F.lit('"'), F.coalesce(company, F.lit("")), F.lit('" '), F.coalesce(city, F.lit("")), F.lit(" "), F.coalesce(state, F.lit("")))
    return F.concat(F.lit(f"{endpoint}?format=json&q="), F.url_encode(words))


def search_results(answers: DataFrame, most: int = 5) -> DataFrame:
    """(id, rank, url, title, description) of search answers in either of two forms: {results: [...]} with `content`, or {web:
    {results: [...]}} with `description`. The first `most` count."""
    hit = "array<struct<url:string,title:string,description:string,content:string>>"
    parsed = F.from_json("body", f"results {hit}, web struct<results:{hit}>")
    rows = answers.where("error = '' and status = 200").select("id", F.posexplode(F.slice(F.coalesce(parsed["web"]["results"], parsed["results"]), 1, most)).alias("rank", "h"))
    text = lambda c: F.coalesce(c, F.lit(""))
    return rows.select("id", "rank", text(F.col("h.url")).alias("url"), text(F.col("h.title")).alias("title"), text(F.coalesce("h.description", "h.content")).alias("description"))


class Addresses(InputPartition):
    def __init__(self, targets: list[tuple[str, str]]):
        super().__init__(targets)


class WebReader(DataSourceReader):
    def __init__(self, options: dict):
        known = {"delay": float, "tries": int, "wait": float, "timeout": float, "most": int, "agent": str}
        self.manners = Manners(**{k: kind(options[k]) for k, kind in known.items() if k in options})
        template, ids = options.get("template", "{id}"), json.loads(options["ids"])
        self.targets = [(str(i), template.replace("{id}", urllib.parse.quote(str(i), safe=":/?&=%"))) for i in ids]

    def partitions(self):
        hosts: dict[str, list[tuple[str, str]]] = {}
        for key, url in self.targets:
            hosts.setdefault(urllib.parse.urlsplit(url).netloc, []).append((key, url))
        return [Addresses(t) for t in hosts.values()] or [Addresses([])]

    def read(self, partition):
        yield from answers(iter(partition.value), self.manners)


class WebSource(DataSource):
    """spark.read.format("web") with the options ids (a JSON list) and template ({id} in an address): a row each, a partition a
    host. For short lists, as of registrants' details; tables of targets go through fetched() and run_fetch()."""

    @classmethod
    def name(cls):
        return "web"

    def schema(self):
        return FETCHED

    def reader(self, schema):
        return WebReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WebSource)
