"""Quality classifier: hashed word n-gram logistic regression with follow-the-regularised-leader updates.

A text's pieces are its runs of letters, digits and like marks, lower-cased, with a sign before words in capitals; its
features are hashed pieces and pairs of pieces, counted and scaled to unit length. FTRL-proximal learns sparse weights
in one pass after another over a bounded sample of labelled rows, in hash order; a score is the sigmoid of a sparse dot
product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gatework.llm.common import over_texts, slices
from gatework.llm.language import held_out

#: Labelled rows that are learned from (in expectation), the bytes of text that they have together at most, passes over them,
#: hash buckets, and FTRL's parameters.
SAMPLE, SAMPLE_BYTES, PASSES, BUCKETS = 8000, 64 << 20, 3, 1 << 18
RATE, BETA, L1, L2 = 0.2, 1.0, 0.3, 0.5
CAPITALS = "↑"


def features(texts: pa.Array):
    """(text, bucket, value) arrays of all texts, sorted by text and bucket; values of a text have unit length."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words = split.flatten().dictionary_encode()
    word_counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    which = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    marked = pc.replace_substring_regex(words.dictionary, r"(\p{Lu}{2,})", CAPITALS + r" \1")
    marked = pc.replace_substring_regex(pc.utf8_lower(marked), r"([\p{L}\p{M}]+|\p{N}+)", r" \1 ")
    pieces = pc.ascii_split_whitespace(marked)
    flat = pieces.flatten()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(full)])
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(pieces).to_numpy(zero_copy_only=False))])
    ends = before[ends]  # pieces of distinct words
    coded = flat.filter(pa.array(full)).dictionary_encode()
    hashes = np.fromiter((xxhash.xxh64_intdigest(p.encode(), 1) for p in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    piece = hashes[coded.indices.to_numpy(zero_copy_only=False)] if len(coded.dictionary) else np.zeros(0, np.uint64)

    per_word = np.diff(ends)[which]
    starts = ends[:-1][which]
    totals = np.cumsum(per_word)
    at = np.repeat(starts - (totals - per_word), per_word) + np.arange(int(totals[-1]) if len(totals) else 0)
    stream = piece[at]
    text = np.repeat(np.repeat(np.arange(len(word_counts)), word_counts), per_word)
    pairs = text[1:] == text[:-1]
    joined = (stream[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ (stream[1:] + np.uint64(0x7F4A7C15)))[pairs]
    mixed = lambda h: (h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BUCKETS.bit_length() + 1)
    key = np.concatenate([text, text[:-1][pairs]]) * BUCKETS + np.concatenate([mixed(stream), mixed(joined)]).astype(np.int64)
    key.sort()
    head = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    place = np.flatnonzero(head)
    count = np.diff(np.append(place, len(key))).astype(np.float64)
    text, bucket = np.divmod(key[place], BUCKETS)
    norm = np.sqrt(np.bincount(text, count * count, len(word_counts)))
    return text, bucket, count / norm[text]


def feature_batches(batches):
    for batch in slices(batches, "text", 2 << 20):
        text, bucket, value = features(batch.column("text"))
        ends = pa.array(np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("draw"), batch.column("doc_id"), batch.column("label"), pa.ListArray.from_arrays(ends, pa.array(bucket.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(value.astype(np.float32)))],
            ["draw", "doc_id", "label", "bucket", "value"],
        )


def learn_batches(batches):
    """FTRL-proximal over rows in their order; weights of nonzero buckets, the bias as bucket BUCKETS."""
    rows = []
    for batch in batches:
        for i in range(batch.num_rows):
            rows.append((batch.column("label")[i].as_py(), np.append(batch.column("bucket")[i].values.to_numpy(), BUCKETS), np.append(batch.column("value")[i].values.to_numpy(), np.float32(1))))
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(i):
        return np.where(np.abs(z[i]) <= L1, 0.0, (np.sign(z[i]) * L1 - z[i]) / ((BETA + np.sqrt(n[i])) / RATE + L2))

    for _ in range(PASSES):
        for label, i, x in rows:
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / RATE * w
            n[i] += g * g
    w = weights(np.arange(BUCKETS + 1))
    found = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(w[found])], ["bucket", "weight"])


def within(rows: DataFrame, most: int) -> DataFrame:
    """The rows (draw, doc_id, label, text) whose texts, in the order they are drawn, have `most` bytes together at most. What
    bounds the fit's memory is decided on sizes, before any text is moved; longer texts than that aren't learned from."""
    sizes = rows.select("draw", "doc_id", "label", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size")).where(F.col("size") <= most)
    upto = sizes.withColumn("upto", F.sum("size").over(Window.orderBy("draw", "doc_id", "label", "size")))  # of the sample, as many rows at any size
    over = upto.where(F.col("upto") > most).agg(F.min("draw")).first()[0]
    kept = rows.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= most)
    return kept if over is None else kept.where(F.col("draw") < over)


def trained(docs: DataFrame, labels: DataFrame, train: Column, sample: int = SAMPLE, most: int = SAMPLE_BYTES) -> np.ndarray:
    """Weights by bucket, the bias last, from at most some `sample` labelled rows where `train` (over doc_id) holds, which have
    `most` bytes of text at most."""
    labelled = labels.select("doc_id", F.col("quality").cast("double").alias("label")).where("doc_id is not null and label in (0, 1)").where(train)
    size = labelled.count()
    draw = F.crc32(F.concat(F.lit("draw"), F.col("doc_id").cast("string")).cast("binary"))
    drawn = labelled.withColumn("draw", draw).where(F.col("draw") < sample / max(size, 1) * (1 << 32))
    rows = docs.select("doc_id", "text").join(drawn, "doc_id").select(F.col("draw"), F.col("doc_id").cast("long").alias("doc_id"), "label", "text")
    sparse = over_texts(within(rows, most), feature_batches, "draw long, doc_id long, label double, bucket array<int>, value array<float>")
    one = sparse.repartition(1).sortWithinPartitions("draw", "doc_id", "label")  # `sample` rows, whatever the input's size
    found = one.mapInArrow(learn_batches, "bucket long, weight double").toArrow()
    out = np.zeros(BUCKETS + 1)
    out[found.column("bucket").to_numpy()] = found.column("weight").to_numpy()
    return out


def score_batches(batches, weights: np.ndarray):
    for batch in slices(batches, "text", 2 << 20):
        text, bucket, value = features(batch.column("text"))
        dot = np.bincount(text, weights[bucket] * value, batch.num_rows) + weights[BUCKETS]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(dot, -35, 35))))], ["doc_id", "score"])


def scored(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, score (0 to 1) of every row. Null and empty texts have the bias alone."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # of fixed size
    return over_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), lambda it: score_batches(it, sent.value), "doc_id long, score double")


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; learned from labels whose crc32 remainder by 3 is not 1.

    Labels that are null or neither 0 nor 1 are not learned from; without any, every score is 0.5. Rows with a null id
    are scored, not learned from. Repeated rows count each. Very long texts are scored whole; they are learned from while the
    sample's texts stay within SAMPLE_BYTES. An empty table gives an empty result. Extra columns are ignored.
    """
    out = held_out(F.col("doc_id"), 3, 1)
    return scored(docs, trained(docs, labels, ~out)).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
