"""Stages from the command line: python -m gatework.run STAGE --in name=path ... --out path [--dry-run]

Inputs are Parquet folders, CSV files, or workbooks (code lists of several vintages by commas, rates, reviews). Without --out, or with --dry-run, a stage only reports what it would write. The
stage `quality` ends with status 1 if the batch doesn't pass.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatework.config import DEFAULT
from gatework.operators import assess, enrich, gates, lookup, persistence, premium, reports, validation
from gatework.sources import io, workbook
from gatework.streaming import budget
from gatework.streaming.incremental import pending

Tables = dict[str, DataFrame]

#: Stage: the tables it takes, what it does, and the column whose histogram it reports.
STAGES: dict[str, tuple[tuple[str, ...], Callable[[Tables], DataFrame], str | None]] = {
    "gates": (("records", "codes", "rates"), lambda t: gates.all_gates(t["records"], lookup.valid_codes(t["codes"]), t["rates"]), "priority_tier"),
    "gate-codes": (("records", "codes"), lambda t: gates.code_gates(t["records"], lookup.valid_codes(t["codes"])), "flag_invalid_naics_code"),
    "gate-names": (("records",), lambda t: gates.name_gate(t["records"]), "flag_name_naics_mismatch"),
    "gate-entities": (("records",), lambda t: gates.entity_gate(t["records"]), "flag_ein_multi_naics"),
    "gate-rarity": (("records",), lambda t: gates.rarity_gate(t["records"]), "flag_naics_count_anomaly"),
    "gate-sizes": (("records",), lambda t: gates.size_gate(t["records"]), "flag_emp_size_anomaly"),
    "gate-rates": (("records", "rates"), lambda t: gates.rate_gates(t["records"], t["rates"]), "flag_injury_rate_outlier"),
    "gate-zeros": (("records", "rates"), lambda t: gates.rate_gates(t["records"], t["rates"]), "flag_high_emp_zero_injury"),
    "classify": (("flagged",), lambda t: enrich.classify(t["flagged"]), "match_status"),
    "route": (("classified",), lambda t: enrich.routed(t["classified"]), "match_status"),
    "sample": (("classified",), lambda t: enrich.diverse(t["classified"]), None),
    "seed": (("records", "prior"), lambda t: enrich.seed_from_prior(t["records"], t["prior"]), "scrape_match_status"),
    "pending": (("records", "results"), lambda t: pending(t["records"], t["results"]), None),
    "retry-failed": (("records", "results"), lambda t: pending(t["records"], t["results"], ("SCRAPE_FAILED",)), None),
    "retry-no-website": (("records", "results"), lambda t: pending(t["records"], t["results"], ("NO_WEBSITE",)), None),
    "decide": (("pages", "codes"), lambda t: enrich.decide(t["pages"], t["codes"]), "scrape_match_status"),
    "targets": (("results",), lambda t: enrich.unresolved(t["results"]), "scrape_match_status"),
    "registrants": (("results", "registrants", "crosswalk"), lambda t: enrich.of_registrants(t["results"], t["registrants"], t["crosswalk"]), "scrape_match_status"),
    "contractors": (("results", "contractors"), lambda t: enrich.of_contractors(t["results"], io.contractors(t["contractors"])), "scrape_match_status"),
    "merge": (("results", "found"), lambda t: enrich.merged(t["results"], t["found"]), "scrape_match_status"),
    "known": (("results", "companies"), lambda t: enrich.known_companies(t["results"], t["companies"]), "scrape_match_status"),
    "fan-out": (("results", "records", "codes"), lambda t: enrich.fanned_out(t["results"], t["records"], lookup.last_titles(t["codes"])), "scrape_match_status"),
    "materiality": (("results", "rates"), lambda t: assess.materiality(t["results"], t["rates"]), "materiality_class"),
    "contradictions": (("results", "codes"), lambda t: assess.contradictions(t["results"], lookup.first_titles(t["codes"])), "outcome"),
    "triage": (("results", "codes", "rates"), lambda t: assess.triage(t["results"], lookup.first_titles(t["codes"]), t["rates"]), "triage_tier"),
    "resolution": (("classified", "results"), lambda t: assess.resolution(t["classified"], t["results"]), None),
    "quality": (("results", "codes"), lambda t: assess.batch_quality(t["results"], lookup.valid_codes(t["codes"])), None),
    "shifts": (("combined", "rates"), lambda t: persistence.shifts(t["combined"], t["rates"]), "shift_type"),
    "premiums": (("records", "results"), lambda t: premium.deltas(premium.scored(t["records"], t["results"], premium.rate_table(t["records"].sparkSession))), "direction"),
    "error-types": (("records", "flagged"), lambda t: persistence.combined(t["records"], t["flagged"]), "error_type"),
    "persistence": (("combined", "shifts"), lambda t: persistence.persistence_summary(t["combined"], t["shifts"]), None),
    "premium-summary": (("records", "results"), lambda t: premium.premium_summary(premium.scored(t["records"], t["results"], premium.rate_table(t["records"].sparkSession)), t["records"].count()), None),
    "review-sample": (("triaged", "allotted"), lambda t: validation.stratified(t["triaged"].withColumn("tier", F.col("triage_tier")), t["allotted"], "tier", 202606), "tier"),
    "metrics": (("reviewed",), lambda t: validation.stratum_metrics(t["reviewed"]), None),
}


#: Stages that print what they find and write nothing.
REPORTS = {"report": ("flagged", "triaged", "material", "contradicted")}


def next_run(tables: Tables, calls: int, carried: int) -> DataFrame:
    """The pending records that the next run may search for, a search and its pages each."""
    each = budget.search_calls(F.lit(""), F.lit(""), DEFAULT.pages_per_site)
    return budget.next_run(tables["records"], tables["results"], each, ["priority_tier", "ord"] if "priority_tier" in tables["records"].columns else ["ord"], calls, carried)


#: What a workbook is read as, by the name of the input.
WORKBOOKS = {
    "codes": lambda spark, path: workbook.code_lists(spark, path.split(",")),
    "rates": lambda spark, path: lookup.rates(workbook.rate_list(spark, path)),
    "reviewed": workbook.reviewed,
}


def read(spark: SparkSession, name: str, path: str) -> DataFrame:
    if path.endswith(".xlsx"):
        return WORKBOOKS[name](spark, path)
    return io.read_csv(spark, path) if path.endswith(".csv") else spark.read.parquet(path)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="gatework.run", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("stage", choices=[*STAGES, *REPORTS])
    p.add_argument("--in", dest="inputs", action="append", default=[], metavar="name=path")
    p.add_argument("--out")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--last", type=int, help="only the last N results (stage quality)")
    p.add_argument("--limit", type=int, help="a pilot: only the first N rows of the stage's first input")
    p.add_argument("--budget", type=int, help="stage pending: only what a run of so many calls can serve, in order of priority")
    p.add_argument("--carried", type=int, default=0, help="calls that the run before left")
    p.add_argument("--year", action="append", help="only these years of the inputs that have one")
    p.add_argument("--url-source", choices=("guess", "search"), help="only results whose site was found so")
    a = p.parse_args(args)
    names, work, column = STAGES.get(a.stage) or (REPORTS[a.stage], None, None)
    paths = dict(x.split("=", 1) for x in a.inputs)
    if missing := [n for n in names if n not in paths]:
        p.error(f"{a.stage} needs --in {' '.join(f'{n}=path' for n in missing)}")
    spark = spark or SparkSession.builder.appName("gatework").getOrCreate()
    tables = {n: read(spark, n, paths[n]) for n in names}
    for n, t in tables.items():
        if a.year and "year" in t.columns:
            t = t.where(F.col("year").isin(*a.year))
        if a.url_source and "url_source" in t.columns:
            t = t.where(F.col("url_source") == a.url_source)
        tables[n] = enrich.pilot(t, a.limit) if a.limit and n == names[0] and {"ord", "id"} <= set(t.columns) else t
    if a.stage == "report":
        print(reports.report(*(tables[n] for n in names), sorted(r.year for r in tables["flagged"].select("year").distinct().collect())))
        return 0
    if a.last and "results" in tables:
        tables["results"] = assess.latest(tables["results"], a.last)
    out = next_run(tables, a.budget, a.carried) if a.budget and a.stage == "pending" else work(tables)
    if a.out and not a.dry_run:
        out.write.mode("errorifexists").parquet(a.out)
        out = spark.read.parquet(a.out)
    print(reports.narrative(reports.histogram(out, column).orderBy(column), a.stage) if column else f"{a.stage}: {out.count()} rows")
    return int(a.stage == "quality" and not out.first().passed)


if __name__ == "__main__":
    sys.exit(main())
