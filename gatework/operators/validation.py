"""Review samples and their metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gatework.functions import fixed
from gatework.functions.text import address, normal_code


def allocation(counts: DataFrame, total: int, floor: int = 2) -> DataFrame:
    """(tier, n, allotted) of counts (tier, n): a floor for each tier, the rest by share, the largest remainders first."""
    every = Window.partitionBy()  # one row a tier
    rest = total - floor * F.count("*").over(every)
    raw = F.col("n") / F.sum("n").over(every) * rest
    df = counts.withColumn("raw", raw).withColumn("whole", F.floor("raw"))
    left = rest - F.sum("whole").over(every)
    df = df.withColumn("left", left).withColumn("r", F.row_number().over(Window.orderBy((F.col("raw") - F.col("whole")).desc(), "tier")))
    return df.select("tier", "n", (F.lit(floor) + F.col("whole") + (F.col("r") <= F.col("left")).cast("long")).alias("allotted"))


def draw(id_col: Column, seed: int) -> Column:
    """A number by which rows are drawn: the same in every engine that has md5. A null id is drawn as an empty one."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))))


def near_draws(pool: DataFrame, sizes: DataFrame, stratum: str, seed: int, key: str, digits: int) -> DataFrame:
    """pool with allotted and draw_, the rows that may be drawn: draws are counted by their first hexadecimal digits, which
    partial sums settle, and of each stratum the rows stay up to the digits at which its number is reached."""
    drawn = pool.join(sizes, stratum).withColumns({"draw_": draw(F.col(key), seed), "first_": F.substring(draw(F.col(key), seed), 1, digits)})
    counts = drawn.groupBy(stratum, "allotted", "first_").agg(F.count("*").alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.partitionBy(stratum).orderBy("first_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = counts.withColumn("before_", before).where("before_ < allotted").groupBy(stratum).agg(F.max("first_").alias("last_"))
    return drawn.join(last, stratum).where("first_ <= last_").drop("first_", "last_")


def stratified(pool: DataFrame, sizes: DataFrame, stratum: str, seed: int, key: str = "id", digits: int = 4) -> DataFrame:
    """For each stratum as many rows as sizes (stratum, allotted) says, those of the smallest draws. Repeated rows count each.
    Only rows that may be drawn are ranked, so no task orders a stratum."""
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy("draw_", key))
    return near_draws(pool, sizes, stratum, seed, key, digits).withColumn("rank_", rank).where("rank_ <= allotted").drop("draw_", "rank_", "allotted")


def review_sheet(sample: DataFrame, records: DataFrame) -> DataFrame:
    """What a reviewer gets: a row a sampled id, with the address and a suggestion or the reason why there is none."""
    df = sample.select("id", "stratum", "suggested_naics", "triage_tier").join(records, "id", "left")
    code = normal_code(F.col("suggested_naics"))
    why = (
        F.when(F.col("stratum") == "CLEAN", "No flags raised").when(F.col("stratum") == "FLAGGED_NOT_PROMOTED", "Flagged but not promoted to triage").when(F.col("triage_tier") == "T5_NO_ALTERNATIVE", "No web presence found")
        .when(F.col("triage_tier") == "T5e_WEBSITE_UNSCRAPEABLE", "Website found but unscrapeable").when(F.col("triage_tier") == "T5f_NO_NAICS_SIGNAL", "Website scraped, no NAICS signal").otherwise("No suggestion available")
    )
    return df.select(
        "id", "stratum", "establishment_name", "company_name", address(F.col("street_address"), F.col("city"), F.col("state"), F.col("zip_code")).alias("full_address"), "industry_description",
        F.col("naics_code").alias("reported_naics"), F.coalesce(code, why).alias("suggested_naics"), F.lit("").alias("reviewer_naics"), F.lit("").alias("reviewer_notes"),
    )


def stratum_metrics(reviewed: DataFrame, strata: dict[str, tuple[int, int]] = fixed.STRATA) -> DataFrame:
    """A row for each stratum of reviewed rows (stratum, reviewer_naics, reported_naics, suggested_naics): accuracy and
    confusion counts. Rows without a review or marked UNK don't count."""
    r, a, s = normal_code(F.col("reviewer_naics")), normal_code(F.col("reported_naics")), normal_code(F.col("suggested_naics"))
    df = reviewed.where(r.isNotNull() & (r != "UNK"))
    right = r.eqNullSafe(a)
    n = lambda c: F.sum(c.cast("long"))
    flagged = F.col("stratum").isin("FLAGGED_NOT_PROMOTED", "AUTO_RESOLVED", "MANUAL_REVIEW")
    suggested = F.col("stratum").isin("AUTO_RESOLVED", "MANUAL_REVIEW")
    g = df.groupBy("stratum").agg(F.count("*").alias("n_scored"), n(right).alias("n_reported_correct"), n(~right).alias("n_reported_wrong"), n(r.eqNullSafe(s)).alias("n_sug"))
    pool = F.create_map(*[F.lit(x) for k, (_, p) in strata.items() for x in (k, p)])
    return g.select(
        "stratum", "n_scored", F.try_element_at(pool, F.col("stratum")).alias("pool_size"), F.round(F.col("n_reported_correct") / F.col("n_scored"), 4).alias("reported_accuracy"), "n_reported_correct",
        "n_reported_wrong", F.when(suggested, F.round(F.col("n_sug") / F.col("n_scored"), 4)).alias("suggestion_accuracy"), F.when(suggested, F.col("n_sug")).alias("n_suggestion_correct"),
        F.when(F.col("stratum") == "CLEAN", F.col("n_reported_wrong")).alias("false_negatives"), F.when(flagged, F.col("n_reported_correct")).alias("false_positives"),
        F.when(flagged, F.col("n_reported_wrong")).alias("true_positives"),
    )


def overall_metrics(strata: DataFrame, total_pool: int | None = None) -> DataFrame:
    """One row: precision and recall with strata pooled as they are, recall with strata weighted by their pools, and
    accuracy weighted by pools."""
    total = float(total_pool or sum(p for _, p in fixed.STRATA.values()))
    z = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    scale = F.col("pool_size") / F.col("n_scored")
    a = strata.agg(
        z(F.col("true_positives").cast("double")).alias("tp"), z(F.col("false_positives").cast("double")).alias("fp"), z(F.col("false_negatives").cast("double")).alias("fn"),
        z(F.col("true_positives") * scale).alias("wtp"), z(F.col("false_negatives") * scale).alias("wfn"), z(F.col("pool_size") / F.lit(total) * F.col("reported_accuracy")).alias("weighted_accuracy"),
    )
    ratio = lambda x, y: F.when(F.col(x) + F.col(y) > 0, F.col(x) / (F.col(x) + F.col(y)))
    return a.select("tp", "fp", "fn", ratio("tp", "fp").alias("precision"), ratio("tp", "fn").alias("recall"), ratio("wtp", "wfn").alias("weighted_recall"), "weighted_accuracy")
