"""How codes persist and shift over years."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gatework.functions.codes import prefix, risk_tier
from gatework.functions.text import blank, filled, first_filled
from gatework.operators.lookup import cascade, first_by

CHANGES = ("CROSS_SECTOR_SHIFT", "WITHIN_SECTOR_SHIFT")


def error_type(code: Column, invalid: Column) -> Column:
    return (
        F.when(code == "999999", "PLACEHOLDER_999999").when(code == "000000", "PLACEHOLDER_000000").when(invalid, "INVALID_CODE").when(blank(code).rlike("^[0-9]{1,5}$"), "INCOMPLETE_CODE").otherwise("VALID")
    )


def records_of_years(records: DataFrame) -> DataFrame:
    """Records of all years, one an id and year: the first by ord."""
    return first_by(records, ["year", "id"], [F.col("ord")])


def combined(records: DataFrame, flagged: DataFrame, triaged: DataFrame | None = None) -> DataFrame:
    """Records of all years, one an id and year, with the invalid flag, the tier if triaged ones are given, and error_type."""
    df = records_of_years(records).join(flagged.select("year", "id", "flag_invalid_naics_code"), ["year", "id"], "left")
    if triaged is not None:
        df = df.join(triaged.select("year", "id", "triage_tier"), ["year", "id"], "left")
    return df.withColumn("error_type", error_type(F.col("naics_code"), F.coalesce(F.col("flag_invalid_naics_code") == 1, F.lit(False))))


#: Letters of a list of names that are kept.
LIST_LETTERS = 200


def name_list(df: DataFrame, key: str, value: str, out: str, sep: str = "; ", most: int | None = LIST_LETTERS) -> DataFrame:
    """(key, out): the distinct filled values of a key, sorted, joined and cut at `most` letters, if any (states need no cut).

    Values are made distinct before they meet. As every value takes a letter and a separator at least, only the first
    most / (1 + separator) by order can show, and Spark keeps no more of a key, in each task and after the shuffle: a value
    longer than the cut is cut first, which keeps the order of what shows."""
    v = filled(blank(F.col(value)))
    values = df.select(key, (F.substring(v, 1, most + 1) if most else v).alias("v_")).where(F.col(key).isNotNull() & F.col("v_").isNotNull()).distinct()
    listed = F.array_join(F.array_sort(F.collect_list("v_")), sep)
    if not most:
        return values.groupBy(key).agg(listed.alias(out))
    shown = most // (1 + len(sep)) + 1
    first = values.withColumn("r_", F.row_number().over(Window.partitionBy(key).orderBy("v_"))).where(F.col("r_") <= shown)
    return first.groupBy(key).agg(F.substring(listed, 1, most).alias(out))


def placeholder_reporters(df: DataFrame, kind: str = "PLACEHOLDER_999999") -> DataFrame:
    """Entities that report the placeholder in two years or more. Aggregated by year first."""
    rows = df.where((F.col("error_type") == kind) & F.col("ein").isNotNull())
    year = rows.groupBy("ein", "year").agg(F.count("*").alias("n"))
    years = year.groupBy("ein").agg(
        F.count("*").alias("years_with_999999"), F.sum("n").alias("total_establishments"), F.array_sort(F.collect_list(F.struct("year", "n"))).alias("y"),
    )
    lists = [name_list(rows, "ein", value, out, *more) for value, out, *more in (("company_name", "c"), ("establishment_name", "e"), ("state", "states", ", ", None))]
    present = df.where("ein is not null").groupBy("ein").agg(F.count_distinct("year").alias("years_present_total"))
    out = years.where("years_with_999999 >= 2").join(present, "ein")
    for names in lists:
        out = out.join(names, "ein", "left")
    return out.select(
        "ein", F.coalesce("c", "e", F.lit("")).alias("company_name"), "years_with_999999", "years_present_total",
        F.array_join("y.year", ", ").alias("years_list"), "total_establishments",
        F.array_join(F.transform("y", lambda s: F.concat(s["year"], F.lit(":"), s["n"].cast("string"))), "; ").alias("establishments_per_year"), F.coalesce("states", F.lit("")).alias("states"),
    )


def yearly(df: DataFrame) -> DataFrame:
    """One row an establishment and year: of each column, the first value by ord that is not null."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(c)
    columns = ("naics_code", "ein", "company_name", "establishment_name", "state", "annual_average_employees")
    return df.where("establishment_id is not null").groupBy("establishment_id", "year").agg(*map(first, columns))


def shifts(df: DataFrame, rates: DataFrame) -> DataFrame:
    """A row for each two consecutive years that an establishment is in: codes, sectors, rates (year, prefix, value; tried
    with six, four, three and two digits), shift_type, direction, risk_tier. Rates are the year's own."""
    w = Window.partitionBy("establishment_id").orderBy("year")
    after = F.lead(F.struct("year", "naics_code", "ein", "company_name", "establishment_name", "state", "annual_average_employees")).over(w)
    p = yearly(df).withColumn("to", after).where("to is not null")
    p = p.select(
        "establishment_id", F.col("to.ein").alias("ein"), first_filled(filled(blank(F.col("to.company_name"))), F.col("to.establishment_name")).alias("company_name"), F.col("to.state").alias("state"),
        F.col("year").alias("year_from"), F.col("to.year").alias("year_to"), blank(F.col("naics_code")).alias("naics_from"), blank(F.col("to.naics_code")).alias("naics_to"),
        blank(F.col("to.annual_average_employees")).try_cast("double").alias("employees"),
    )
    for side in ("from", "to"):
        code = F.when(F.col(f"naics_{side}").rlike("^[0-9]+$"), F.col(f"naics_{side}"))
        p = p.withColumn("year", F.col(f"year_{side}"))
        p = cascade(p, code, rates, (6, 4, 3, 2), f"dart_rate_{side}", on=("year",)).drop("year")
        p = p.withColumn(f"sector_{side}", F.when(F.length(f"naics_{side}") >= 2, prefix(F.col(f"naics_{side}"), 2)).otherwise(""))
    a, b = F.col("dart_rate_from"), F.col("dart_rate_to")
    same = F.col("naics_from") == F.col("naics_to")
    return p.withColumns(
        {
            "shift_type": F.when(same, "STABLE").when(F.col("sector_from") != F.col("sector_to"), "CROSS_SECTOR_SHIFT").otherwise("WITHIN_SECTOR_SHIFT"),
            "dart_delta": F.round(b - a, 2),
            "direction": F.when(a > b, "DOWNWARD_SHIFT").when(b > a, "UPWARD_SHIFT").when(a == b, "LATERAL").otherwise("UNKNOWN"),
            "risk_tier": risk_tier(F.col("sector_to")),
        }
    )


def downward(s: DataFrame) -> DataFrame:
    return s.where(F.col("shift_type").isin(*CHANGES) & (F.col("direction") == "DOWNWARD_SHIFT"))


def chronic_downshifters(s: DataFrame) -> DataFrame:
    """Entities with two real downward changes or more."""
    down = downward(s).where("ein is not null")
    a = down.groupBy("ein").agg(
        F.count("*").alias("n_downshifts"), F.count_distinct("establishment_id").alias("n_establishments_affected"),
        F.coalesce(F.sum("employees"), F.lit(0.0)).alias("total_employees_affected"), F.round(F.avg("dart_delta"), 2).alias("avg_dart_delta"), F.round(F.min("dart_delta"), 2).alias("worst_dart_delta"),
        F.array_union(F.collect_set("year_from"), F.collect_set("year_to")).alias("y"),
    )
    a = a.where("n_downshifts >= 2")
    for names in (name_list(down, "ein", "company_name", "company_name"), name_list(down, "ein", "state", "states", ", ", None)):
        a = a.join(names, "ein", "left")
    filled_lists = {c: F.coalesce(c, F.lit("")) for c in ("company_name", "states")}
    return a.withColumns({"years_active": F.array_join(F.array_sort("y"), ", "), **filled_lists}).drop("y")


def persistence_summary(df: DataFrame, s: DataFrame, years: int = 4, keep: Callable[[DataFrame, str], DataFrame] = lambda df, what: df) -> DataFrame:
    """(metric, value) over records, shifts, repeat reporters and establishments. Both inputs are read several times: `keep`
    may write what it is given as a table and return that."""
    nine = F.col("error_type") == "PLACEHOLDER_999999"
    df = df.groupBy("ein", "establishment_id", "year").agg(F.count("*").alias("n"), F.sum(nine.cast("long")).alias("nines"))
    df = keep(df, "years")
    s = keep(s.select("ein", "shift_type", "direction", "establishment_id", "company_name", "state", "year_from", "year_to", "employees", "dart_delta"), "shifts")
    nines = df.where("nines > 0")
    reporters = nines.where("ein is not null").groupBy("ein").agg(F.count_distinct("year").alias("y")).where("y >= 2").select("ein")
    est = df.where("establishment_id is not null").groupBy("establishment_id").agg(F.count_distinct("year").alias("y"))
    one = lambda d, *aggs: d.agg(*aggs)
    parts = [
        one(df, F.sum("n").alias("total_records"), F.sum("nines").alias("total_999999_all_years")),
        one(reporters, F.count("*").alias("eins_999999_multi_year")),
        one(nines.join(reporters, "ein", "left_semi"), F.count_distinct("establishment_id").alias("establishments_999999_multi_year")),
        one(s, F.sum((F.col("shift_type") == "CROSS_SECTOR_SHIFT").cast("long")).alias("total_cross_sector_shifts"), F.sum((F.col("shift_type").isin(*CHANGES) & (F.col("direction") == "DOWNWARD_SHIFT")).cast("long")).alias("total_downward_shifts")),
        one(chronic_downshifters(s), F.count("*").alias("chronic_downshifter_eins")),
        one(est, F.sum((F.col("y") == years).cast("long")).alias("establishments_in_all_years"), F.sum((F.col("y") >= 2).cast("long")).alias("establishments_in_2plus_years")),
    ]
    out = None
    for p in parts:  # one row each, turned to (metric, value)
        pairs = ", ".join(f"'{c}', cast(coalesce({c}, 0) as double)" for c in p.columns)
        long = p.selectExpr(f"stack({len(p.columns)}, {pairs}) as (metric, value)")
        out = long if out is None else out.unionByName(long)
    return out
