"""Mixing sources to target weights along a time-varying curriculum.

Each source has a piecewise-linear weight schedule over training time t in [0, 1]. Its integral is the source's
cumulative token demand; scaled to the source's target it says how many of its tokens have been used by time t.
Inverting it turns the cumulative token offset of every document copy into a training position, and documents are
range-sorted by position. Prefix sums run in two levels (hash buckets within a source, then rows within a bucket), so a
source with a third of all rows is spread over `BUCKETS` tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gatework.llm.common import WORD, written

#: Fixed values of the contract: weights repeat over the sources in code point order, and a source is used 3 times at most.
WEIGHTS = (5, 2, 1)
MOST = 3
#: Hash buckets of one source. Their number bounds a task to 1/4096 of the largest source.
BUCKETS = 4096
#: Each source's schedule, repeating as the weights do: relative weight at t = 0 and at t = 1, linear between.
SCHEDULES = ((1.0, 1.0), (1.5, 0.5), (0.5, 1.5))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, size) to (source, source_size, target, w0, w1): one row per source.

    Targets share the total size by weight and stop at MOST times the source's size; the excess is reshared by weight
    until none is above. In closed form: with sources ordered by cap / weight, those before the first source that a
    common level satisfies are capped and the others get level * weight. The window has one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(order) - 1) % len(WEIGHTS)
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), nth + 1)
    s = sizes.select(
        "source",
        F.col("size").alias("source_size"),
        (F.lit(MOST) * F.col("size")).alias("cap"),
        pick(WEIGHTS).cast("long").alias("w"),
        pick([a for a, _ in SCHEDULES]).alias("w0"),
        pick([b for _, b in SCHEDULES]).alias("w1"),
    )
    by_ratio = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = s.withColumns(
        {
            "room": F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "weights": F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)),
        }
    ).withColumn("level", F.col("room").cast("double") / F.col("weights"))
    fits = F.col("level") * F.col("w") <= F.col("cap")
    level = F.min(F.when(fits, F.struct((F.col("cap") / F.col("w")).alias("r"), F.col("source").isNull().alias("n"), "source", "level"))).over(everything)["level"]
    s = s.withColumn("common", level)
    return s.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("common") * F.col("w")).alias("target"), "w0", "w1")


def position(share: Column, w0: Column, w1: Column) -> Column:
    """The time t at which the schedule w0 + (w1 - w0) t has used `share` of its integral (0 to 1)."""
    need = share * (w0 + w1) / 2
    root = F.sqrt(F.greatest(w0 * w0 + 2 * (w1 - w0) * need, F.lit(0.0)))
    return F.least(F.lit(1.0), 2 * need / (w0 + root))


def placed(docs: DataFrame, keys: dict[str, Column], size: Column) -> DataFrame:
    """The columns `keys` (doc_id and source among them), size, the row's place h in its source's order, and by (source_key,
    bucket) the hash buckets of a source."""
    df = docs.select(*[c.alias(k) for k, c in keys.items()], F.coalesce(size, F.lit(0)).cast("long").alias("size"))
    df = df.withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    # never null, so that joins and windows share one partitioning
    return df.withColumns({"source_key": F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source")), "bucket": F.conv(F.substring("h", 1, 3), 16, 10).cast("int") % BUCKETS})


def planned(rows: DataFrame, slim: DataFrame) -> DataFrame:
    """rows, as from placed(), with source_size, target, w0, w1 and `offset`, the source's words before the row. slim has
    all rows' source, source_key, bucket and size. Equal rows tie and are ordered at random, which changes no result."""
    buckets = slim.groupBy("source_key", "bucket").agg(F.sum("size").alias("bucket_size"))
    of_source = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("start", F.coalesce(F.sum("bucket_size").over(of_source), F.lit(0)))
    plan = targets(slim.groupBy("source").agg(F.sum("size").alias("size"))).withColumn("plan_key", F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source"))).drop("source")
    starts = buckets.join(plan, F.col("source_key") == F.col("plan_key")).select("source_key", "bucket", "start", "source_size", "target", "w0", "w1")
    in_bucket = Window.partitionBy("source_key", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(in_bucket), F.lit(0)))
    return rows.join(starts, ["source_key", "bucket"]).withColumn("offset", F.col("start") + F.col("inner")).drop("start", "inner", "source_key", "bucket")


def copies_taken(k: Column) -> Column:
    """Words that copy k of a row gives: the source's rows, laid end to end MOST times, are read up to the target."""
    whole = F.round("target").cast("long")
    return F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), whole - (k * F.col("source_size") + F.col("offset"))))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def mix_report(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, and first_position, the training time of the
    first copy (null if none is taken).

    Size is the number of words, 0 for null or empty texts. The null source is a source of its own, last in order. All
    sources empty: targets are 0. An empty table gives an empty result. Extra columns are ignored. Repeated rows count
    each; the order within a source is that of md5(doc_id), so reruns agree.
    """
    slim = written(placed(docs, {"doc_id": F.col(id_col), "source": F.col(source_col)}, word_count(F.col(text_col))), "mixing")
    p = planned(slim, slim)
    taken = sum((copies_taken(F.lit(k)) for k in range(1, MOST)), copies_taken(F.lit(0)))
    first = F.when(copies_taken(F.lit(0)) > 0, position(F.col("offset") / F.col("target"), F.col("w0"), F.col("w1")))
    return p.select("doc_id", "size", "source_size", "target", taken.alias("taken"), first.alias("first_position"))


def mix(docs: DataFrame) -> DataFrame:
    """The mixed training set: docs' own columns, a row for each copy taken, range-sorted by training position.

    A source's last copy gives its first words only, joined by single spaces; n_chars, if there, is then counted anew.
    Rows without words are never demanded, so they go. Null, tie and repeat rules are those of mix_report.
    """
    columns = docs.columns
    keys = {"doc_id": F.col("doc_id"), "source": F.col("source"), "row": F.struct(*[F.col(f"`{c}`") for c in columns])}
    size = word_count(F.col("text"))
    slim = written(placed(docs, {k: keys[k] for k in ("doc_id", "source")}, size).select("source", "source_key", "bucket", "size"), "mixing")
    p = planned(placed(docs, keys, size), slim)
    p = p.withColumn("copy", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), copies_taken(F.lit(k)).alias("words")) for k in range(MOST)]))).where("copy.words > 0")
    share = (F.col("copy.k") * F.col("source_size") + F.col("offset")) / F.col("target")
    p = p.withColumn("position", position(share, F.col("w0"), F.col("w1")))
    p = p.repartitionByRange("position", "h", "copy.k").sortWithinPartitions("position", "h", "copy.k")
    cut = F.array_join(F.slice(F.filter(F.split(F.col("row.text"), r"[\x20\x09-\x0D]+"), lambda w: w != ""), 1, F.col("copy.words").cast("int")), " ")
    text = F.when(F.col("copy.words") == F.col("size"), F.col("row.text")).otherwise(cut)
    out = p.select(*[(text if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in columns])
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
