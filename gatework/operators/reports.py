"""Report tables over years. Numbers stay numbers; text formats belong to sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gatework.functions import fixed
from gatework.functions.codes import literal_map, rank_consistency, report_sector, size_bucket, trend
from gatework.functions.text import blank, filled, first_filled
from gatework.operators.assess import tier_group


def count_if(c: Column) -> Column:
    return F.coalesce(F.sum(c.cast("long")), F.lit(0))


def share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def overview(flagged: DataFrame, triaged: DataFrame, material: DataFrame) -> DataFrame:
    """A row for each year: records, flagged, triage outcomes, material share. Inputs have year and n_flags, triage_tier,
    materiality_class."""
    f = flagged.groupBy("year").agg(F.count("*").alias("total_records"), count_if(F.col("n_flags") > 0).alias("total_flagged"))
    g = tier_group(F.col("triage_tier"))
    t = triaged.groupBy("year").agg(F.count("*").alias("triage_rows"), count_if(g == "AUTO-RESOLVE").alias("auto_resolved"), count_if(g == "HUMAN REVIEW").alias("human_review"), count_if(g == "NO DATA").alias("no_data"))
    m = material.groupBy("year").agg(F.count("*").alias("assessed"), count_if(F.col("materiality_class") == "MATERIAL").alias("material_count"))
    df = f.join(t, "year", "left").join(m, "year", "left").na.fill(0)
    return df.withColumns({"flag_rate": share(F.col("total_flagged"), F.col("total_records")), "auto_resolve_pct": share(F.col("auto_resolved"), F.col("triage_rows")), "material_pct": share(F.col("material_count"), F.col("assessed"))})


def flag_prevalence(flagged: DataFrame, years: list[str]) -> DataFrame:
    """A row for each flag: its count in each year, and the trend of the halves' means."""
    pairs = ", ".join(f"'{label}', {column}" for column, label in fixed.FLAGS.items())
    one = flagged.groupBy("year").agg(*[F.sum(c).alias(c) for c in fixed.FLAGS])  # one row a year before it is turned
    long = one.selectExpr("year", f"stack({len(fixed.FLAGS)}, {pairs}) as (flag_name, n)")
    wide = long.groupBy("flag_name").pivot("year", years).agg(F.sum("n")).na.fill(0)
    half = len(years) // 2
    mean = lambda ys: sum((F.col(y) for y in ys[1:]), F.col(ys[0])) / len(ys)
    out = wide.withColumn("trend_direction", trend(mean(years[:half]), mean(years[half:])))
    return out.select("flag_name", *[F.col(y).alias(f"count_{y}") for y in years], "trend_direction")


def tier_distribution(triaged: DataFrame, years: list[str]) -> DataFrame:
    wide = triaged.groupBy(F.col("triage_tier").alias("tier")).pivot("year", years).count().na.fill(0)
    return wide.select("tier", F.coalesce(F.try_element_at(literal_map(fixed.TIER_NOTES), F.col("tier")), F.lit("")).alias("description"), *[F.col(y).alias(f"count_{y}") for y in years])


def persistent_entities(flagged: DataFrame, most: int = 20) -> DataFrame:
    """Entities flagged in most years, then with most flags: aggregated by year, then over years. The name is that of the
    latest year that has one; of a year, the first by ord."""
    name = first_filled(blank(F.col("company_name")), blank(F.col("establishment_name")))
    rows = flagged.where(F.col("n_flags") > 0).select(blank(F.col("ein")).alias("ein"), "year", "n_flags", filled(name).alias("name"), filled(blank(F.col("naics_code"))).alias("code"), "ord").where("ein <> ''")
    by_year = rows.groupBy("ein", "year").agg(F.sum("n_flags").alias("flags"), F.min_by("name", F.when(F.col("name").isNotNull(), F.col("ord"))).alias("name"), F.collect_set("code").alias("codes"))
    e = by_year.groupBy("ein").agg(
        F.count("*").alias("years_flagged"), F.sum("flags").alias("total_flags"), F.coalesce(F.max_by("name", F.when(F.col("name").isNotNull(), F.col("year"))), F.lit("")).alias("company_name"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("codes")))).alias("codes"),
    )
    sectors = F.array_sort(F.array_distinct(F.array_compact(F.transform("codes", lambda c: F.try_element_at(literal_map(fixed.REPORT_NAMES), F.substring(c, 1, 2))))))
    out = e.select("ein", "company_name", F.array_join("codes", "; ").alias("naics_codes"), "years_flagged", "total_flags", (F.col("total_flags") / F.col("years_flagged")).alias("flags_per_year"), F.array_join(sectors, "; ").alias("sectors_seen"))
    return out.orderBy(F.col("years_flagged").desc(), F.col("total_flags").desc(), "ein").limit(most)


def sector_years(flagged: DataFrame) -> DataFrame:
    """(sector, year, flagged, total, rate, rank): flags summed (so a rate may pass 1), ranked by rate within a year."""
    df = flagged.withColumn("sector", report_sector(blank(F.col("naics_code")))).where("sector <> ''")
    s = df.groupBy("sector", "year").agg(F.sum("n_flags").alias("flagged"), F.count("*").alias("total")).withColumn("rate", F.col("flagged") / F.col("total"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("year").orderBy(F.col("rate").desc(), "sector")))


def sector_stability(flagged: DataFrame, years: list[str]) -> DataFrame:
    """A row for each sector: mean rank (of years with data) and rate (of all years), consistency, rates and ranks by year,
    and rho of the ranks against time as 1 - 6 sum d^2 / (n (n^2 - 1)) on the ranks as they are (rho_raw), and rho, the
    correlation with ranks among the sector's own years (null if all are equal)."""
    s = sector_years(flagged).where(F.col("year").isin(*years))
    time = F.row_number().over(Window.partitionBy("sector").orderBy("year"))
    s = s.withColumn("t", time).withColumn("own", F.rank().over(Window.partitionBy("sector").orderBy("rank")).cast("double"))
    # corr itself divides by the deviations before any condition on it: where all ranks are equal it gets nulls only
    s = s.withColumn("own", F.when(F.max("own").over(Window.partitionBy("sector")) > 1, F.col("own")))
    n, d2 = F.count("*"), F.sum((F.col("rank") - F.col("t")) * (F.col("rank") - F.col("t")))
    at = lambda c, y: F.max(F.when(F.col("year") == y, F.col(c)))
    out = s.groupBy("sector").agg(
        F.avg("rank").alias("mean_rank"), (F.sum("rate") / len(years)).alias("mean_rate"), rank_consistency(F.max("rank") - F.min("rank")).alias("consistency"),
        F.when(n >= 3, 1.0 - 6.0 * d2 / (n * (n * n - 1))).alias("rho_raw"), F.when(n >= 3, F.corr("own", "t")).alias("rho"),
        *[F.coalesce(at("rate", y), F.lit(0.0)).alias(f"rate_{y}") for y in years], *[at("rank", y).alias(f"rank_{y}") for y in years],
    )
    return out.orderBy("mean_rank", "sector")


def sector_flows(contradicted: DataFrame, flagged: DataFrame) -> DataFrame:
    """A row for each sector: contradictions that would leave and enter it, the net flow, and that against its flags."""
    a, b = report_sector(blank(F.col("naics_code")), "Unknown"), report_sector(blank(F.col("suggested_naics")), "Unknown")
    pairs = contradicted.where("crosses_sector").select(a.alias("a"), b.alias("b")).where("a <> b").groupBy("a", "b").count()
    flows = pairs.select(F.col("a").alias("sector"), F.col("count").alias("o"), F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("f"))
    flows = flows.unionByName(pairs.select(F.col("b").alias("sector"), F.lit(0).cast("long").alias("o"), F.col("count").alias("i"), F.lit(0).cast("long").alias("f")))
    own = flagged.where("n_flags > 0").select(report_sector(blank(F.col("naics_code"))).alias("sector"), "n_flags").where("sector <> ''").groupBy("sector").agg(F.sum("n_flags").alias("f"))
    flows = flows.unionByName(own.select("sector", F.lit(0).cast("long").alias("o"), F.lit(0).cast("long").alias("i"), F.col("f").cast("long").alias("f")))
    s = flows.groupBy("sector").agg(F.sum("o").alias("cross_sector_outflows"), F.sum("i").alias("cross_sector_inflows"), F.sum("f").alias("total_flagged"))
    net = F.col("cross_sector_inflows") - F.col("cross_sector_outflows")
    return s.withColumns({"net_flow": net, "net_direction": F.when(net > 0, "net importer").when(net < 0, "net exporter").otherwise("balanced"), "distortion": F.when(F.col("total_flagged") > 0, F.abs(net) / F.col("total_flagged"))})


def state_patterns(flagged: DataFrame, years: list[str]) -> DataFrame:
    """A row for each state: records, flagged and rate by year, mean and deviation of the rates, and rank."""
    df = flagged.select(F.upper(blank(F.col("state"))).alias("state"), "year", "n_flags").where("state <> ''")
    at = lambda c, y: count_if((F.col("year") == y) & c)
    s = df.groupBy("state").agg(*[at(F.lit(True), y).alias(f"total_{y}") for y in years], *[at(F.col("n_flags") > 0, y).alias(f"flagged_{y}") for y in years])
    rate = {f"rate_{y}": share(F.col(f"flagged_{y}"), F.col(f"total_{y}")) for y in years}
    s = s.withColumns(rate)
    mean = sum((F.col(f"rate_{y}") for y in years[1:]), F.col(f"rate_{years[0]}")) / len(years)
    s = s.withColumn("avg_rate", mean)
    square = lambda y: (F.col(f"rate_{y}") - F.col("avg_rate")) * (F.col(f"rate_{y}") - F.col("avg_rate"))
    s = s.withColumn("std_dev", F.sqrt(sum((square(y) for y in years[1:]), square(years[0])) / len(years)))
    return s.withColumn("rank", F.row_number().over(Window.orderBy(F.round("avg_rate", 12).desc(), "state")))  # a row for each state


def materiality_grid(material: DataFrame, years: list[str]) -> DataFrame:
    """(year, materiality_class, count, pct) of every year and class, zeros included."""
    spark = material.sparkSession
    grid = spark.createDataFrame([(y, c) for y in years for c in fixed.MATERIALITY], "year string, materiality_class string")
    n = material.groupBy("year", "materiality_class").agg(F.count("*").alias("count"))
    df = grid.join(n, ["year", "materiality_class"], "left").na.fill(0)
    total = F.sum("count").over(Window.partitionBy("year"))
    return df.withColumn("pct", share(F.col("count"), total))


def sector_pairs(contradicted: DataFrame) -> DataFrame:
    """(reported_sector, suggested_sector, count) of contradictions between different labels, most frequent first."""
    a, b = report_sector(blank(F.col("naics_code")), "Unknown"), report_sector(blank(F.col("suggested_naics")), "Unknown")
    n = contradicted.select(a.alias("reported_sector"), b.alias("suggested_sector")).where("reported_sector <> suggested_sector").groupBy("reported_sector", "suggested_sector").agg(F.count("*").alias("count"))
    return n.orderBy(F.col("count").desc(), "reported_sector", "suggested_sector")


def flag_trend(flagged: DataFrame, triaged: DataFrame, material: DataFrame, contradicted: DataFrame) -> DataFrame:
    o = overview(flagged, triaged, material)
    c = contradicted.groupBy("year").agg(count_if(F.col("crosses_sector")).alias("cross_sector_count"))
    df = o.join(c, "year", "left").na.fill(0)
    return df.select("year", "total_records", F.col("total_flagged").alias("flagged"), "flag_rate", F.col("material_pct").alias("material_rate"), "cross_sector_count", share(F.col("cross_sector_count"), F.col("total_flagged")).alias("cross_sector_rate"))


def size_patterns(flagged: DataFrame, years: list[str]) -> DataFrame:
    """(size_bucket, total, flagged and rate by year) of the five buckets."""
    b = size_bucket(blank(F.col("annual_average_employees")).try_cast("double"))
    df = flagged.select(b.alias("size_bucket"), "year", "n_flags").where("size_bucket is not null")
    at = lambda c, y: count_if((F.col("year") == y) & c)
    s = df.groupBy("size_bucket").agg(*[at(F.lit(True), y).alias(f"total_{y}") for y in years], *[at(F.col("n_flags") > 0, y).alias(f"flagged_{y}") for y in years])
    grid = flagged.sparkSession.createDataFrame(list(enumerate(fixed.SIZE_BUCKETS)), "place int, size_bucket string")
    s = grid.join(s, "size_bucket", "left").na.fill(0)
    return s.withColumns({f"rate_{y}": share(F.col(f"flagged_{y}"), F.col(f"total_{y}")) for y in years}).orderBy("place")


def sector_trends(flagged: DataFrame, years: list[str]) -> DataFrame:
    """A row for each sector: rate by year, their mean, and the direction of the halves."""
    s = sector_years(flagged)
    at = lambda y: F.coalesce(F.max(F.when(F.col("year") == y, F.col("rate"))), F.lit(0.0))
    w = s.groupBy("sector").agg(*[at(y).alias(f"rate_{y}") for y in years])
    mean = lambda ys: sum((F.col(f"rate_{y}") for y in ys[1:]), F.col(f"rate_{ys[0]}")) / len(ys)
    half = len(years) // 2
    return w.withColumns({"mean_rate": mean(years), "direction": trend(mean(years[:half]), mean(years[half:]))})


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def top_changes(classified: DataFrame, most: int = 20) -> DataFrame:
    """The most frequent corrections."""
    n = classified.where("match_status = 'CORRECTED'").groupBy("naics_code", "naics_verified").agg(F.count("*").alias("n"))
    return n.orderBy(F.col("n").desc(), "naics_code", "naics_verified").limit(most)


def report(flagged: DataFrame, triaged: DataFrame, material: DataFrame, contradicted: DataFrame, years: list[str]) -> str:
    """The multi-year findings as text, a section a report. Each table has a row a year, flag, tier, sector, state or less."""
    real = contradicted.where("outcome = 'contradiction'")
    sections = {
        "Pipeline overview": overview(flagged, triaged, material).orderBy("year"),
        "Flag prevalence": flag_prevalence(flagged, years),
        "Triage tiers": tier_distribution(triaged, years).orderBy("tier"),
        "Entities flagged most persistently": persistent_entities(flagged),
        "Sectors by stability": sector_stability(flagged, years),
        "Flows between sectors": sector_flows(real, flagged).orderBy("sector"),
        "States": state_patterns(flagged, years).orderBy("rank"),
        "Materiality": materiality_grid(material, years).orderBy("year", "materiality_class"),
        "Most frequent sector pairs": sector_pairs(real).limit(20),
        "Flags over years": flag_trend(flagged, triaged, material, real).orderBy("year"),
        "Sizes": size_patterns(flagged, years).drop("place"),
        "Sector trends": sector_trends(flagged, years).orderBy("sector"),
    }
    return "\n\n".join(narrative(table, title) for title, table in sections.items())


def narrative(table: DataFrame, title: str) -> str:
    """A small table as lines of text."""
    rows = table.collect()
    return "\n".join([title, *["  " + ", ".join(f"{k}: {v}" for k, v in r.asDict().items()) for r in rows]])
