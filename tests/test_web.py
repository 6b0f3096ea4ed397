"""Fetching from a stand-in on this machine: retries, rates, resuming, searches, details."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from gatework.sources import io, web

QUICK = web.Manners(delay=0.0, wait=0.01, timeout=5)


@pytest.fixture
def site():
    """Paths: /ok..., /flaky/x (503 once), /down (500 while state["down"]), /missing, /slow; counts the calls of each."""
    calls: dict[str, int] = {}
    times: list[float] = []
    state = {"down": True}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            calls[self.path] = calls.get(self.path, 0) + 1
            times.append(time.monotonic())
            kind = self.path.split("/")[1].split("?")[0]
            code = {"missing": 404, "down": 500 if state["down"] else 200, "flaky": 503 if calls[self.path] == 1 else 200}.get(kind, 200)
            body = {"search": json.dumps({"results": [{"url": f"http://r{i}", "title": f"t{i}", "content": "c"} for i in range(8)]}), "brave": json.dumps({"web": {"results": [{"url": "http://b", "title": None, "description": "d"}]}}), "cik": json.dumps({"name": "Acme", "sic": "17", "stateOfIncorporation": "DE"})}.get(kind, f"page {self.path} é")
            self.send_response(code)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.end_headers()
            if code == 200:
                self.wfile.write(body.encode())

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", calls, times, state
    server.shutdown()


def targets(spark, base, paths):
    return spark.createDataFrame([(str(i), f"{base}{p}" if p else p) for i, p in enumerate(paths)], "id string, url string")


def test_answers_retries_and_errors(spark, site):
    base, calls, _, _ = site
    paths = ["/ok", "/flaky/1", "/down", "/missing", None, ""]
    got = {r.id: r for r in web.fetched(targets(spark, base, paths).union(spark.createDataFrame([("6", "http://127.0.0.1:9/x"), ("7", "not an address")], "id string, url string")), QUICK).collect()}
    assert (got["0"].status, got["0"].body, got["0"].tries) == (200, "page /ok é", 1)
    assert (got["1"].status, got["1"].error, got["1"].tries) == (200, "", 2)
    assert (got["2"].status, got["2"].error, got["2"].tries, calls["/down"]) == (500, "status 500", 3, 3)
    assert (got["3"].status, got["3"].error, calls["/missing"]) == (404, "", 1)
    assert got["4"].error == got["5"].error == "no url" and got["6"].tries == 3 and got["6"].error and got["7"].tries == 1 and got["7"].error


@pytest.mark.parametrize("lanes", [1, 3])
def test_calls_to_a_host_are_spaced(spark, site, lanes):
    base, _, times, _ = site
    web.fetched(targets(spark, base, [f"/ok/{i}" for i in range(9)]).repartition(4), web.Manners(delay=0.15, lanes=lanes)).collect()
    assert len(times) == 9 and (lanes > 1 or min(b - a for a, b in zip(sorted(times), sorted(times)[1:])) > 0.12)


def test_resume_asks_only_for_what_is_missing(spark, site, tmp_path):
    base, calls, _, state = site
    t, out = targets(spark, base, ["/ok/1", "/down", "/ok/2", "/ok/3", "/missing"]), str(tmp_path / "out")
    first = {r.id: r.error for r in web.run_fetch(spark, t, out, wave=2, manners=QUICK).collect()}
    assert first == {"0": "", "1": "status 500", "2": "", "3": "", "4": ""}
    state["down"] = False
    before = dict(calls)
    again = {r.id: (r.status, r.error) for r in web.run_fetch(spark, t.union(targets(spark, base, ["/ok/9"]).withColumn("id", F.lit("9"))), out, wave=2, manners=QUICK).collect()}
    assert again == {"0": (200, ""), "1": (200, ""), "2": (200, ""), "3": (200, ""), "4": (404, ""), "9": (200, "")}
    assert {p: n - before.get(p, 0) for p, n in calls.items() if n != before.get(p, 0)} == {"/down": 1, "/ok/9": 1}


def test_a_failed_partition_loses_its_wave_only(spark, site, tmp_path):
    base, calls, _, _ = site
    t, out = targets(spark, base, [f"/ok/{i}" for i in range(12)]), str(tmp_path / "out")
    broken = tmp_path / "broken"
    broken.write_text("")

    def call(url, m, get=web.get, broken=str(broken)):
        import os

        if url.endswith("/7") and os.path.exists(broken):
            os._exit(1)  # the worker is gone in the middle of its work
        return get(url, m)

    with pytest.raises(Exception, match=r"."):
        web.run_fetch(spark, t, out, wave=3, manners=QUICK, call=call)
    broken.unlink()
    kept = {r.id for r in spark.read.schema(web.FETCHED).parquet(out).collect()} if list((tmp_path / "out").glob("wave=*/part*")) else set()
    before = dict(calls)
    got = web.run_fetch(spark, t, out, wave=3, manners=QUICK, call=call)
    assert got.count() == 12 and all(calls[f"/ok/{i}"] == before[f"/ok/{i}"] for i in kept)


def test_searches(spark, site):
    base, calls, _, _ = site
    firms = spark.createDataFrame([("1", 'A "B" & Sons', "Salem", None)], "id string, c string, city string, state string")
    got = web.search_results(web.fetched(firms.select("id", web.search_urls(f"{base}/search", F.col("c"), F.col("city"), F.col("state")).alias("url")), QUICK)).orderBy("rank").collect()
    assert [(r["rank"], r.url, r.description) for r in got] == [(i, f"http://r{i}", "c") for i in range(5)]
    assert list(calls) == ["/search?format=json&q=%22A+%22B%22+%26+Sons%22+Salem+"]
    assert [tuple(r) for r in web.search_results(web.fetched(targets(spark, base, ["/brave"]), QUICK)).collect()] == [("0", 0, "http://b", "", "d")]


def test_registered_format_reads_details(spark, site, tmp_path):
    base, calls, _, _ = site
    web.register(spark)
    df = spark.read.format("web").options(ids=json.dumps([5, 7]), template=base + "/cik/{id}.json", delay="0").load()
    assert sorted((r.id, r.status) for r in df.collect()) == [("5", 200), ("7", 200)] and set(calls) == {"/cik/5.json", "/cik/7.json"}
    df.where("status = 200").select("body").write.text(str(tmp_path / "details"))
    assert [(r.name, r.sic, r.state) for r in io.read_registrant_details(spark, str(tmp_path / "details")).distinct().collect()] == [("Acme", "0017", "DE")]
