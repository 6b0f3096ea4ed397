"""Premium gaps of misclassified establishments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatework.config import DEFAULT, Config
from gatework.functions import fixed
from gatework.functions.codes import payment_direction, prefix, premium_gap
from gatework.functions.text import blank, strip


def rate_table(spark: SparkSession) -> DataFrame:
    """(sector, class_code, rate, desc) of the 24 sectors."""
    return spark.createDataFrame(fixed.PREMIUM_RATES, "sector string, class_code string, rate double, desc string")


def mapped(records: DataFrame, rates: DataFrame) -> DataFrame:
    """Each sector's class and rate, and how many records report a code of it."""
    n = records.groupBy(prefix(strip(F.col("naics_code")), 2).alias("sector")).agg(F.count("*").alias("n_records"))
    return rates.join(n, "sector", "left").withColumn("n_records", F.coalesce("n_records", F.lit(0).cast("long")))


def scored(records: DataFrame, suggestions: DataFrame, rates: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Records (id, naics_code, annual_average_employees, state, ein) whose suggestion (id, suggested_naics, state) is a
    code of five or six digits that differs: sectors, rates, rate_delta, direction, employees, estimated_annual_loss. The
    state comes from the suggestion where the record has none."""
    s = suggestions.select("id", "suggested_naics", F.col("state").alias("other_state_"))
    df = records.join(s, "id", "left").withColumn("state", F.coalesce("state", "other_state_")).drop("other_state_")
    sug = strip(F.col("suggested_naics"))
    df = df.where(sug.rlike("^[0-9]{5,6}$") & (sug != F.coalesce(strip(F.col("naics_code")), F.lit("nan"))))
    for side, code in (("reported", "naics_code"), ("suggested", "suggested_naics")):
        r = rates.select(F.col("sector").alias(f"{side}_s_"), F.col("rate").alias(f"{side}_rate"), F.col("desc").alias(f"{side}_desc"))
        df = df.withColumn(f"{side}_sector", prefix(F.col(code), 2)).join(r, F.col(f"{side}_sector") == F.col(f"{side}_s_"), "left").drop(f"{side}_s_")
        df = df.withColumn(f"{side}_desc", F.coalesce(f"{side}_desc", F.lit("Unknown")))
    delta = F.col("suggested_rate") - F.col("reported_rate")
    people = blank(F.col("annual_average_employees")).try_cast("double")
    return df.withColumns(
        {
            "cross_sector": ~F.col("reported_sector").eqNullSafe(F.col("suggested_sector")),
            "rate_delta": delta,
            "direction": payment_direction(delta),
            "employees": F.least(F.coalesce(people, F.lit(1.0)), F.lit(cfg.employee_cap)),
            "estimated_annual_loss": premium_gap(delta, people, cfg.employee_cap, cfg.salary),
        }
    )


def money(c: Column) -> Column:
    """An exact sum to four decimals, so that reruns agree."""
    return F.coalesce(F.sum(c.cast("decimal(20,4)")).cast("double"), F.lit(0.0))


def deltas(df: DataFrame) -> DataFrame:
    """A row for each pair of sectors, largest loss first."""
    first = [F.min(c).alias(c) for c in ("reported_desc", "suggested_desc", "reported_rate", "suggested_rate", "rate_delta", "direction")]  # one value a pair
    g = df.groupBy("reported_sector", "suggested_sector").agg(*first, F.count("id").alias("n_establishments"), F.sum("employees").alias("total_employees"), money(F.col("estimated_annual_loss")).alias("total_annual_loss"))
    return g.withColumn("avg_loss_per_establishment", F.col("total_annual_loss") / F.col("n_establishments")).orderBy(F.col("total_annual_loss").desc(), "reported_sector", "suggested_sector")


def top_losses(df: DataFrame, most: int = 50) -> DataFrame:
    return df.orderBy(F.col("estimated_annual_loss").desc_nulls_last(), "id").limit(most)


def premium_summary(df: DataFrame, total_records: int, state: tuple[str, ...] = ("CA", "CALIFORNIA")) -> DataFrame:
    """(metric, value) over all scored establishments."""
    mine = F.upper("state").isin(*state)
    loss = F.col("estimated_annual_loss")
    z = lambda c: F.coalesce(c, F.lit(0.0))
    a = df.agg(
        F.count("*").cast("double").alias("total_misclassifications_with_suggestion"), z(F.sum(F.col("cross_sector").cast("double"))).alias("cross_sector_misclassifications"),
        z(F.sum((~F.col("cross_sector")).cast("double"))).alias("within_sector_misclassifications"), z(F.sum(mine.cast("double"))).alias("state_establishments_affected"),
        money(loss).alias("total_annual_premium_gap_all_states"), money(F.when(mine, loss)).alias("total_annual_premium_gap_state"),
        (money(loss) / F.greatest(F.count(loss), F.lit(1))).alias("avg_premium_gap_per_establishment"), z(F.max(loss)).alias("max_individual_premium_gap"),
        z(F.avg(F.when(F.col("cross_sector"), (F.coalesce(F.col("rate_delta"), F.lit(0.0)) > 0).cast("double"))) * 100).alias("pct_underpaying"),
    )
    n = F.col("total_misclassifications_with_suggestion")
    a = a.withColumn("aggressive_state_loss", F.col("total_annual_premium_gap_state") * F.when(n > 0, F.lit(float(total_records)) / n).otherwise(1.0))
    pairs = ", ".join(f"'{c}', {c}" for c in a.columns)
    return a.selectExpr(f"stack({len(a.columns)}, {pairs}) as (metric, value)")
