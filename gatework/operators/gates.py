"""The eight checks of a record, and its priority.

Each gate takes records and adds one 0/1 column; group facts are aggregated once (partial sums before the shuffle) and
joined back, so a key with very many records costs one row a task. All gates together ask six of the eight of one table of
the distinct codes, which the records meet once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gatework.config import DEFAULT, Config
from gatework.functions import fixed, rules
from gatework.functions.codes import incident_rate, prefix
from gatework.functions.text import filled, first_filled, number, strip
from gatework.operators.lookup import by_values, cascade, member


def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def code_gates(records: DataFrame, codes: DataFrame) -> DataFrame:
    """Gates 1 and 2: a code is incomplete if it is a shorter valid code, as it is or padded by zeros to six digits, and
    invalid if it is neither that nor a valid six-digit code. Never both. `codes` has all valid codes (code)."""
    c = F.coalesce(F.col("naics_code"), F.lit(""))
    df = member(records, F.when(c.rlike("^[0-9]{2,6}$"), c), codes, "gate_valid_")
    padded = []
    for n in (5, 4, 3, 2):
        df = member(df, F.when(c.rlike(f"^[0-9]{{{n}}}0{{{6 - n}}}$"), prefix(c, n)), codes, f"gate_padded{n}_")
        padded.append(F.col(f"gate_padded{n}_"))
    valid, zero_padded = F.col("gate_valid_"), padded[0] | padded[1] | padded[2] | padded[3]
    short = F.length(c) < 6
    return df.withColumns(
        {
            "flag_invalid_naics_code": flag(~valid & (short | ~zero_padded)),
            "flag_incomplete_naics_code": flag((short & valid) | (~short & ~valid & zero_padded)),
        }
    ).drop("gate_valid_", *[f"gate_padded{n}_" for n in (5, 4, 3, 2)])


def name_gate(records: DataFrame, name_rules: list[rules.Rule] | None = None) -> DataFrame:
    """Gate 3: the name has a rule's pattern, and the sector is none of that rule's. Any rule counts."""
    name = first_filled(F.col("establishment_name"), F.col("company_name"))
    c = F.coalesce(F.col("naics_code"), F.lit(""))
    table, enough = name_rules or rules.name_rules(), (name != "") & (F.length(c) >= 2)
    df = by_values(records, {"name": F.when(enough, name), "sector": prefix(c, 2)}, "broken_", lambda name, sector: rules.breaks_any(name, sector, table))
    return df.withColumn("flag_name_naics_mismatch", flag(F.col("broken_"))).drop("broken_")


def entity_gate(records: DataFrame, key: str = "ein", value: str = "naics_code", out: str = "flag_ein_multi_naics") -> DataFrame:
    """Gate 4: the entity has records of more than one code; an empty code counts, a blank entity doesn't. Two codes differ
    if the smallest and the largest do, which partial aggregates settle."""
    k = filled(strip(F.col(key)))
    v = F.coalesce(F.col(value), F.lit(""))
    many = records.where(k.isNotNull()).groupBy(k.alias("entity_")).agg(F.min(v).alias("low_"), F.max(v).alias("high_")).where("low_ <> high_").select("entity_")
    return member(records, k, many, out).withColumn(out, flag(F.col(out)))


def rarity_gate(records: DataFrame, keys: tuple[str, ...] = ("naics_code",), below: int = DEFAULT.rare_below, out: str = "flag_naics_count_anomaly") -> DataFrame:
    """Gate 5: fewer than `below` records have the code."""
    rare = records.groupBy(*keys).agg(F.count("*").alias("rare_n_")).where(F.col("rare_n_") < below)
    same = None
    for k in keys:
        rare = rare.withColumnRenamed(k, f"rare_{k}_")
        c = records[k].eqNullSafe(F.col(f"rare_{k}_"))
        same = c if same is None else same & c
    return records.join(rare, same, "left").withColumn(out, flag(F.col("rare_n_").isNotNull())).drop("rare_n_", *[f"rare_{k}_" for k in keys])


#: Quartiles.
SHARES = (0.25, 0.5, 0.75)


def ranked_quartiles(last: Column) -> tuple[list[Column], Column]:
    """Aggregates of a group's distinct values `size_v_`, each with `size_upto_` of the values up to it, and the exact
    quartiles from them; `last` is the group's number of values less one."""
    at = lambda place: F.min(F.when(F.col("size_upto_") > place, F.col("size_v_")))
    low = [at(F.floor(last * p)).alias(f"size_low{i}_") for i, p in enumerate(SHARES)]
    high = [at(F.ceil(last * p)).alias(f"size_high{i}_") for i, p in enumerate(SHARES)]
    ends = lambda i: (F.col(f"size_low{i}_"), F.col(f"size_high{i}_"))
    between = lambda a, b, p: (F.ceil(last * p) - last * p) * a + (last * p - F.floor(last * p)) * b
    return [*low, *high], F.array(*[F.when(ends(i)[0] == ends(i)[1], ends(i)[0]).otherwise(between(*ends(i), p)) for i, p in enumerate(SHARES)])


def fences(quartiles: Column, least: float, cfg: Config) -> dict[str, Column]:
    q1, q3 = quartiles[0], quartiles[2]
    return {"size_low_": F.greatest(F.lit(float(least)), q1 - cfg.size_iqrs * (q3 - q1)), "size_high_": q3 + cfg.size_iqrs * (q3 - q1), "size_median_": quartiles[1]}


def size_bounds(records: DataFrame, key: str, value: Column, cfg: Config = DEFAULT, floor: float | None = None) -> DataFrame:
    """(key, size_low_, size_high_, size_median_): exact quartiles of values from the floor on, three interquartile ranges
    away; only of groups of ten or more. Values are counted, then found by their ranks, so that no buffer holds a group."""
    least = cfg.size_floor if floor is None else floor
    kept = records.select(F.col(key).alias("size_key_"), value.cast("double").alias("size_v_")).where((F.col("size_v_") >= least) & F.col("size_key_").isNotNull())
    counts = kept.groupBy("size_key_", "size_v_").agg(F.count("*").alias("n"))
    large = counts.groupBy("size_key_").agg(F.sum("n").alias("size_n_")).where(F.col("size_n_") >= cfg.size_group)
    upto = F.sum("n").over(Window.partitionBy("size_key_").orderBy("size_v_").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.join(large, "size_key_").withColumn("size_upto_", upto)
    values, quartiles = ranked_quartiles(F.col("size_n_") - 1)
    q = ranked.groupBy("size_key_", "size_n_").agg(*values).withColumn("q", quartiles)
    return q.select("size_key_", *[c.alias(name) for name, c in fences(F.col("q"), least, cfg).items()])


def size_gate(records: DataFrame, cfg: Config = DEFAULT, key: str = "naics_code", value: Column | None = None, out: str = "flag_emp_size_anomaly", floor: float | None = None) -> DataFrame:
    """Gate 6: the number of employees is out of its code's bounds."""
    v = number(F.col("annual_average_employees")) if value is None else value
    bounds = size_bounds(records, key, v, cfg, floor)
    df = records.join(bounds, records[key] == F.col("size_key_"), "left")
    least = cfg.size_floor if floor is None else floor
    return df.withColumn(out, flag((v >= least) & ((v < F.col("size_low_")) | (v > F.col("size_high_"))))).drop("size_key_", "size_low_", "size_high_", "size_median_")


def rate_gates(records: DataFrame, benchmarks: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Gates 7 and 8, and trir, bls_benchmark, bls_matched_naics. benchmarks: (prefix, value), tried from six to three
    digits. 7: the incident rate is over twice a positive benchmark. 8: 50 or more employees without incidents where the
    benchmark is 2 or more (negative counts are without)."""
    df = cascade(records, F.col("naics_code"), benchmarks, (6, 5, 4, 3), "bls_benchmark", "bls_matched_naics")
    return outlier_flags(df, cfg)


def outlier_flags(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Gates 7 and 8, and trir, of records with their bls_benchmark."""
    whole = lambda c: strip(F.col(c)).try_cast("bigint")
    injuries, hours, employees = whole("total_injuries"), whole("total_hours_worked"), whole("annual_average_employees")
    df = df.withColumn("trir", incident_rate(injuries, hours))
    b = F.col("bls_benchmark")
    return df.withColumns(
        {
            "flag_injury_rate_outlier": flag((b > 0) & (F.col("trir") > cfg.rate_multiple * b)),
            "flag_high_emp_zero_injury": flag((employees >= cfg.large_employees) & (injuries <= 0) & (b >= cfg.large_benchmark)),
        }
    )


def priority(records: DataFrame) -> DataFrame:
    """n_flags over all eight, and priority_tier: 1 for two or more doubts on the code, 2 for one or an odd size, 3 for odd
    incidents, else 4. An incomplete code is no doubt."""
    f = [F.col(name) for name in fixed.FLAGS]
    doubts = f[0] + f[2] + f[3] + f[4]
    tier = F.when(doubts >= 2, 1).when((doubts == 1) | (f[5] == 1), 2).when((f[6] == 1) | (f[7] == 1), 3).otherwise(4)
    return records.withColumns({"n_flags": sum(f[1:], f[0]), "priority_tier": tier})


def code_facts(records: DataFrame, codes: DataFrame, benchmarks: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """A row for each distinct code, null too: fact_n_ (its records), size_low_ and size_high_ (gate 6), fact_valid_ and
    fact_padded_ (gates 1 and 2), fact_rate_ and fact_matched_ (gates 7 and 8).

    Records are counted once, by code and size: rarity and quartiles come from the counts. A code's prefixes, five at most,
    meet the valid codes and the benchmarks in one join each."""
    code = F.col("naics_code")
    counts = records.groupBy("naics_code", number(F.col("annual_average_employees")).cast("double").alias("size_v_")).agg(F.count("*").alias("n"))
    counted = F.when((F.col("size_v_") >= cfg.size_floor) & code.isNotNull(), F.col("n")).otherwise(F.lit(0))
    all_ = Window.partitionBy("naics_code")
    upto = F.sum(counted).over(all_.orderBy("size_v_").rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.withColumns({"fact_n_": F.sum("n").over(all_), "size_n_": F.sum(counted).over(all_), "size_upto_": upto})
    values, quartiles = ranked_quartiles(F.col("size_n_") - 1)
    facts = counts.groupBy("naics_code", "fact_n_", "size_n_").agg(*values).withColumn("q", F.when(F.col("size_n_") >= cfg.size_group, quartiles))
    facts = facts.select("naics_code", "fact_n_", *[c.alias(name) for name, c in fences(F.col("q"), cfg.size_floor, cfg).items() if name != "size_median_"])

    c = F.coalesce(code, F.lit(""))
    form = lambda n, p, whole, padded: F.struct(F.lit(n).alias("digits"), p.alias("form"), whole.alias("whole"), padded.alias("padded"))
    forms = [form(n, prefix(c, n), F.lit(False), c.rlike(f"^[0-9]{{{n}}}0{{{6 - n}}}$") if n < 6 else F.lit(False)) for n in (6, 5, 4, 3, 2)]
    each = facts.withColumn("form_", F.explode(F.array(form(0, c, c.rlike("^[0-9]{2,6}$"), F.lit(False)), *forms))).select(*facts.columns, "form_.*")
    known = codes.select(F.col("code").alias("form")).distinct().withColumn("known", F.lit(True))
    each = each.join(known, "form", "left").join(benchmarks.select(F.col("prefix").alias("form"), F.struct("value").alias("rate")), "form", "left")
    known, digits = F.coalesce("known", F.lit(False)), F.col("digits")
    best = F.max(F.when(code.isNotNull() & F.col("rate").isNotNull() & (digits >= 3), F.struct("digits", "rate.value", "form")))
    kept = [F.first(n).alias(n) for n in facts.columns[1:]]
    out = each.groupBy("naics_code").agg(*kept, F.max(known & F.col("whole")).alias("fact_valid_"), F.max(known & F.col("padded")).alias("fact_padded_"), best.alias("best_"))
    return out.select("*", F.col("best_.value").alias("fact_rate_"), F.col("best_.form").alias("fact_matched_")).drop("best_")


def all_gates(records: DataFrame, codes: DataFrame, benchmarks: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """records with all eight flags, trir, bls_benchmark, bls_matched_naics, n_flags and priority_tier, as the gates one by
    one would give them. benchmarks: (prefix, value), a row a prefix."""
    facts = code_facts(records, codes, benchmarks, cfg).withColumnRenamed("naics_code", "fact_code_")
    df = records.join(facts, records["naics_code"].eqNullSafe(facts["fact_code_"]), "left")
    short, valid, padded = F.length(F.coalesce("naics_code", F.lit(""))) < 6, F.col("fact_valid_"), F.col("fact_padded_")
    size = number(F.col("annual_average_employees"))
    df = df.withColumns(
        {
            "flag_invalid_naics_code": flag(~valid & (short | ~padded)),
            "flag_incomplete_naics_code": flag((short & valid) | (~short & ~valid & padded)),
            "flag_naics_count_anomaly": flag(F.col("fact_n_") < cfg.rare_below),
            "flag_emp_size_anomaly": flag((size >= cfg.size_floor) & ((size < F.col("size_low_")) | (size > F.col("size_high_")))),
            "bls_benchmark": F.col("fact_rate_"),
            "bls_matched_naics": F.col("fact_matched_"),
        }
    ).drop("fact_code_", "fact_n_", "fact_valid_", "fact_padded_", "fact_rate_", "fact_matched_", "size_low_", "size_high_")
    return priority(entity_gate(name_gate(outlier_flags(df, cfg))))
