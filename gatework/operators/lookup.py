"""Lookups by code prefix and by key. No side is forced to be broadcast: Spark does so itself where a side is small."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType
from pyspark.sql.window import Window

from gatework.functions.codes import prefix
from gatework.functions.text import strip


def joined_filled(df: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """df left-joined with the table on keys that both have. A row with a null key meets nothing; such rows may be many, so
    where they are shuffled, each goes by all of its values and not to the one task of the nulls."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    plain = [f.name for f in df.schema if not isinstance(f.dataType, MapType)]
    left = df.withColumn("join_salt_", F.when(null, F.xxhash64(*plain)).otherwise(F.lit(0).cast("long")))
    return left.join(table.withColumn("join_salt_", F.lit(0).cast("long")), [*keys, "join_salt_"], "left").drop("join_salt_")


def by_values(df: DataFrame, columns: dict[str, Column], out: str, of: Callable[..., Column]) -> DataFrame:
    """df with `out`, of(*columns) of each distinct combination of the columns, for what costs more than a join and comes
    again and again. A combination with a null has null."""
    names = [f"by_{n}_" for n in columns]
    whole = F.lit(True)
    for c in columns.values():
        whole = whole & c.isNotNull()
    keyed = df.withColumns({n: F.when(whole, c) for n, c in zip(names, columns.values(), strict=True)})
    found = keyed.select(*names).where(F.col(names[0]).isNotNull()).distinct()
    return joined_filled(keyed, found.withColumn(out, of(*map(F.col, names))), names).drop(*names)


def member(df: DataFrame, key: Column, keys: DataFrame, flag: str) -> DataFrame:
    """df with `flag`: whether key is in the one column of keys. A null key is in none."""
    found = keys.select(F.col(keys.columns[0]).alias("lookup_key_")).where("lookup_key_ is not null").distinct().withColumn(flag, F.lit(True))
    return joined_filled(df.withColumn("lookup_key_", key), found, ["lookup_key_"]).withColumn(flag, F.coalesce(flag, F.lit(False))).drop("lookup_key_")


def cascade(df: DataFrame, code: Column, table: DataFrame, lengths: tuple[int, ...], value: str, matched: str | None = None, on: tuple[str, ...] = ()) -> DataFrame:
    """df with `value` of the first of code's prefixes, by `lengths`, that the table (prefix, value, and the columns `on`
    shared with df) has, and with that prefix as `matched`. One equi-join for each length, so nothing compares all pairs."""
    found = []
    df = df.withColumn("cascade_code_", code)
    for n in lengths:
        p, v = f"cascade_p{n}_", f"cascade_v{n}_"
        side = table.select(F.col("prefix").alias(p), F.col("value").alias(v), *[F.col(c).alias(f"{p}{c}") for c in on])
        same = prefix(F.col("cascade_code_"), n) == F.col(p)
        for c in on:
            same = same & (df[c] == F.col(f"{p}{c}"))
        df = df.join(side, same, "left")
        found.append((p, v))
    first = lambda i: F.coalesce(*[F.when(F.col(p).isNotNull(), F.col((p, v)[i])) for p, v in found])
    df = df.withColumn(value, first(1))
    if matched:
        df = df.withColumn(matched, first(0))
    return df.drop("cascade_code_", *[x for p, v in found for x in (p, v, *[f"{p}{c}" for c in on])])


def has_prefix(df: DataFrame, code: Column, keys: DataFrame, flag: str, lengths: tuple[int, ...] = (6, 5, 4, 3, 2)) -> DataFrame:
    """df with `flag`: whether the keys have any of code's prefixes."""
    table = keys.select(F.col(keys.columns[0]).alias("prefix")).distinct().withColumn("value", F.lit(True))
    return cascade(df, code, table, lengths, flag).withColumn(flag, F.coalesce(flag, F.lit(False)))


def title_tree(df: DataFrame, code: Column, titles: DataFrame, tree: str, known: str | None = None) -> DataFrame:
    """df with `tree`: the titles (code, title) of code and its prefixes, from six to two digits, joined by spaces; and with
    `known`: whether there is any."""
    parts = []
    df = df.withColumn("tree_code_", strip(code))
    for n in (6, 5, 4, 3, 2):
        side = titles.select(F.col("code").alias(f"tree_c{n}_"), F.col("title").alias(f"tree_t{n}_"))
        df = df.join(side, prefix(F.col("tree_code_"), n) == F.col(f"tree_c{n}_"), "left")
        parts.append(n)
    df = df.withColumn(tree, F.concat_ws(" ", *[f"tree_t{n}_" for n in parts]))
    if known:
        df = df.withColumn(known, F.coalesce(*[F.col(f"tree_c{n}_") for n in parts]).isNotNull())
    return df.drop("tree_code_", *[f"tree_{x}{n}_" for n in parts for x in "ct"])


def valid_codes(lists: DataFrame) -> DataFrame:
    """(code) of all vintages: digits only, two to six of them; ranges such as 31-33 are left out."""
    return lists.select(strip(F.col("code")).alias("code")).where(F.col("code").rlike("^[0-9]{2,6}$")).distinct()


def expanded(lists: DataFrame, key: str, digits_only: bool = False) -> DataFrame:
    """lists with a row for each code of a range such as 31-33 in the column `key`; other words stay unless digits_only."""
    c = F.regexp_replace(strip(F.col(key)), " ", "")
    low, high = F.regexp_extract(c, "^([0-9]+)-([0-9]+)$", 1), F.regexp_extract(c, "^([0-9]+)-([0-9]+)$", 2)
    each = F.when(low != "", F.transform(F.sequence(low.try_cast("int"), high.try_cast("int")), lambda n: n.cast("string"))).when(c.contains("-"), F.array().cast("array<string>")).otherwise(F.array(c))
    out = lists.withColumn(key, F.explode(each))
    return out.where(F.col(key).rlike("^[0-9]+$")) if digits_only else out


def first_titles(lists: DataFrame) -> DataFrame:
    """(code, title) of lists (code, title, vintage, ord): ranges expanded, the earliest vintage's title stays."""
    rows = expanded(lists.where("coalesce(code, '') <> '' and coalesce(title, '') <> ''"), "code")
    return rows.groupBy("code").agg(F.min_by("title", F.struct("vintage", "ord")).alias("title"))


def last_titles(lists: DataFrame) -> DataFrame:
    """(code, title) of digit codes, the latest vintage's title."""
    rows = lists.where(F.col("code").rlike("^[0-9]{2,6}$") & F.col("title").isNotNull())
    return rows.groupBy("code").agg(F.max_by(strip(F.col("title")), F.struct("vintage", "ord")).alias("title"))


def keyword_index(lists: DataFrame) -> DataFrame:
    """(code, title, keywords) of six-digit codes: the title with most keywords, the earliest among equals."""
    from gatework.functions.text import title_keywords

    rows = lists.where(F.col("code").rlike("^[0-9]{6}$") & F.col("title").isNotNull()).withColumn("keywords", title_keywords(F.col("title")))
    best = F.max_by(F.struct(strip(F.col("title")).alias("title"), "keywords"), F.struct(F.size("keywords").alias("n"), (-F.col("vintage")).alias("v"), (-F.col("ord")).alias("o")))
    return rows.groupBy("code").agg(best.alias("best")).select("code", "best.title", "best.keywords")


def rates(table: DataFrame) -> DataFrame:
    """(prefix, value) of a rate table (code, rate, ord): numbers only, ranges expanded, the last of a code counts."""
    clean = table.withColumn("code", F.regexp_replace(strip(F.col("code")), " ", "")).withColumn("rate", F.regexp_replace(strip(F.col("rate")), "^-$", "").try_cast("double"))
    rows = expanded(clean.where("rate is not null and coalesce(code, '') <> ''"), "code", digits_only=True)
    return rows.groupBy(F.col("code").alias("prefix")).agg(F.max_by("rate", "ord").alias("value"))


def code_status(df: DataFrame, code: Column, titles: DataFrame, status: str, parent: str, note: str) -> DataFrame:
    """df with a code's standing: current if the titles have it with six digits, retired if they have a prefix of five to
    two digits (the parent), else invalid; and the note on what to do."""
    df = df.withColumn("status_code_", code)
    current = titles.where(F.length("code") == 6).select("code")
    df = member(df, F.col("status_code_"), current, "status_current_")
    table = titles.select(F.col("code").alias("prefix"), F.struct("code", "title").alias("value"))
    df = cascade(df, F.col("status_code_"), table, (5, 4, 3, 2), "status_parent_", "status_prefix_")
    c, p, t = F.col("status_code_"), F.col("status_prefix_"), F.col("status_parent_.title")
    codes = titles.select("code")
    df = member(df, prefix(c, 4), codes, "status_has4_")
    df = member(df, prefix(c, 5), codes, "status_has5_")
    padded = (c.endswith("00") & F.col("status_has4_")) | (c.endswith("0") & F.col("status_has5_"))
    zero = F.concat(F.lit("Code "), c, F.lit(" appears to be a zero-padded "), F.length(p).cast("string"), F.lit("-digit code ("), p, F.lit(": "), t, F.lit("). Should be filed as a specific 6-digit code under "), p, F.lit("."))
    gone = F.concat(F.lit("Code "), c, F.lit(" was retired from NAICS. Nearest current parent: "), p, F.lit(" ("), t, F.lit("). Update to a current 6-digit code under "), p, F.lit("."))
    none = F.concat(F.lit("Code "), c, F.lit(" does not exist in any NAICS edition. May be a legacy SIC code or data entry error. Requires manual review to assign a valid 6-digit NAICS."))
    now = F.col("status_current_")
    return df.withColumns(
        {
            status: F.when(now, "current").when(p.isNotNull(), "retired").otherwise("invalid"),
            parent: F.when(~now, p),
            note: F.when(now, "").when(p.isNotNull(), F.when(padded, zero).otherwise(gone)).otherwise(F.coalesce(none, F.lit(""))),
        }
    ).drop("status_code_", "status_current_", "status_parent_", "status_prefix_", "status_has4_", "status_has5_")


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order. Spark limits each key's rows before they are shuffled."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("first_by_", rank).where("first_by_ = 1").drop("first_by_")


def crosswalk(df: DataFrame, table: DataFrame, key: str, code: Column) -> DataFrame:
    """df with `mapped_code`, `mapped_title` and `mapped_by` (exact, parent or best) from a 1:n table (key, mapped_code,
    mapped_title, ord): the same code, or else the first with the same four digits, or else the first. df needs `id`."""
    pairs = df.select("id", key, code.alias("own_code_")).join(table, key)
    how = F.when(F.col("mapped_code") == F.col("own_code_"), 1).when(prefix(F.col("mapped_code"), 4) == prefix(F.col("own_code_"), 4), 2).otherwise(3)
    best = pairs.groupBy("id").agg(F.min(F.struct(how.alias("how"), "ord", "mapped_code", "mapped_title")).alias("b"))
    named = F.element_at(F.array(*map(F.lit, ("exact", "parent", "best"))), F.col("b.how"))
    return df.join(best.select("id", F.col("b.mapped_code"), F.col("b.mapped_title"), named.alias("mapped_by")), "id", "left")
