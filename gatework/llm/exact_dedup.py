"""Exact dedup by a heavy-hitter split.

A Misra-Gries summary (Spark's frequent-items sketch, a few thousand counters in all) names the digests that may be
frequent. Their exact counts and winners are then aggregated, which verifies them, and the verified rows, bounded by
the number of counters, are broadcast: rows of frequent digests are resolved map-side and never shuffled. The remaining
digests have small groups only and go through an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gatework.llm.common import ascii_lower, written

#: Counters of the summary, and twice the digests that it names. One that it leaves out, though frequent, is shuffled with
#: the rest: the summary changes the speed only.
COUNTERS = 1024


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only; null counts as empty. The row with the largest id of a
    group stays. Repeated rows of one id and text count in group_size, and one of them stays. A null id is smaller than
    any other: it stays (keep_id null) only if its whole group has null ids. An empty table gives an empty result.
    Extra columns are ignored, whatever their names.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.sha2(normalised(F.col(text_col)), 256).alias("text_sha256"))
    slim = written(slim.withColumn("rid", F.monotonically_increasing_id()), "exact-dedup")

    named = slim.agg(F.expr(f"approx_top_k(text_sha256, {counters // 2}, {counters})").alias("top")).select(F.explode("top.item").alias("text_sha256"))
    verified = (
        slim.join(F.broadcast(named), "text_sha256", "left_semi")
        .groupBy("text_sha256")
        .agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "rid")).alias("winner"))
        .where("group_size > 1")
        .select("text_sha256", "group_size", "winner")
    )
    # at most `counters` rows of some 100 bytes, however large the input is
    verified = written(verified, "heavy")
    heavy = slim.join(F.broadcast(verified), "text_sha256")
    light = slim.join(F.broadcast(verified.select("text_sha256")), "text_sha256", "left_anti")

    group = Window.partitionBy("text_sha256")
    light = light.withColumn("group_size", F.count("*").over(group)).withColumn("winner", F.max(F.struct("doc_id", "rid")).over(group))
    both = heavy.select(*light.columns).unionByName(light)
    return both.select(
        "doc_id",
        F.col("winner.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("winner.rid")).alias("kept"),
        "text_sha256",
    )
