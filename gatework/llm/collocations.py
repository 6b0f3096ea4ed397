"""Phrase collocations, with count-min sketches in front of exact counts.

Almost all n-grams of a corpus are rare, and counting them all would move many times the text. So a first pass hashes every
n-gram into a count-min sketch: rows of counters that never fall short of the true count. The sketch is cut into shards by
the hash; a task sends the shards' counters for its own n-grams, which Spark merges in two levels, whatever the number of
tasks. Counters stop at the threshold, as only reaching it matters; a merged shard is then a bit a counter. A second pass
reads the texts again and keeps the n-grams whose counters all reached the threshold, as phrases with exact counts. A task
adds up its own and sends them packed, by buckets of the hash, which are merged in two levels as well. A sketch only
overestimates, so nothing frequent is lost; what survives by chance falls to the exact count.

Every part of a frequent phrase is frequent too, so the same counts give a candidate's parts. Scores are exact decimals.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gatework.llm.common import LOWER, UPPER, over_texts, slices, written

#: Fixed values of the contract: longest phrase, least count, rows a language; what ends a piece, what ends a word.
LONGEST, LEAST, TOP = 5, 100, 2000
BREAKS, SPACES = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
#: Bytes of text whose n-grams are made at once, and bytes of text whose counters are sent together.
SLICE_BYTES, SENT_BYTES = 2 << 20, 8 << 20
#: Rows of the sketch, and bits of a shard's number of counters in each.
ROWS, SHARD_BITS = 2, 19
#: Bytes of text for each counter of a row (an n-gram ends every 1.7 bytes or so), the least and the most shards. Past the
#: most, at some 8 GB of text, counters fill up: more rare n-grams reach the exact count, and none is lost.
TEXT_PER_COUNTER, LEAST_SHARDS, SHARDS = 16, 128, 1024
#: Bytes of phrases that a task holds before it adds them up, bytes of text for each bucket of phrases, and the most buckets.
HELD_BYTES, TEXT_PER_BUCKET, BUCKETS = 24 << 20, 16 << 20, 1 << 14

FOLD = np.arange(256, dtype=np.uint8)
FOLD[list(UPPER.encode())] = list(LOWER.encode())
KIND = np.zeros(256, np.uint8)  # 0 part of a word, 1 between words, 2 between pieces
KIND[list(SPACES)] = 1
KIND[list(BREAKS)] = 2


COUNTED = ["lang", "phrase", "h", "f"]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Grams:
    """The words of some texts: `words` are their distinct strings, `ids` each occurrence's number, `piece` its piece,
    `lang` its text's language (a number in `langs`)."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        large = texts.cast(pa.large_string())
        bounds = np.frombuffer(large.buffers()[1], np.int64)[large.offset : large.offset + len(large) + 1]
        data = FOLD[np.frombuffer(large.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]]
        bounds = bounds - bounds[0]
        kind = KIND[data]
        inside = kind == 0
        cut = np.zeros(len(data) + 1, bool)  # where a text begins
        cut[bounds] = True
        follows = np.zeros(len(data), bool)
        follows[1:] = inside[:-1]
        starts = np.flatnonzero(inside & ~(follows & ~cut[:-1]))
        in_word = data[inside]
        ends = np.append(np.cumsum(inside)[starts] - 1, len(in_word)).astype(np.int64)
        coded = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(in_word)).dictionary_encode()
        self.words, self.ids = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        text = np.searchsorted(bounds, starts, "right") - 1
        self.piece = np.cumsum(kind == 2)[starts] + text
        named = langs.dictionary_encode()
        self.langs, self.lang = named.dictionary, named.indices.to_numpy(zero_copy_only=False)[text].astype(np.int64)

    def hashes(self, longest: int):
        """For 1 to `longest` words: where phrases of so many words begin, and their hashes within their language."""
        digest = lambda values: np.fromiter((xxhash.xxh64_intdigest(v.encode()) for v in values.to_pylist()), np.uint64, len(values))
        word = digest(self.words)[self.ids]
        at, h = np.arange(len(word)), mixed(word + digest(self.langs)[self.lang] * np.uint64(0x9E3779B97F4A7C15))
        yield 1, at, h
        for k in range(2, longest + 1):
            fits = at + k <= len(word)
            fits[fits] = self.piece[at[fits]] == self.piece[at[fits] + k - 1]
            at = at[fits]
            h = mixed(h[fits] * np.uint64(0x9E3779B97F4A7C15) + word[at + k - 1])
            yield k, at, h

    def phrases(self, at: np.ndarray, h: np.ndarray, k: int) -> pa.RecordBatch:
        """Language, phrase, hash and count of the distinct phrases of k words that begin at `at`."""
        key = self.lang[at]
        for j in range(k):
            _, key = np.unique(key, return_inverse=True)
            key = key * len(self.words) + self.ids[at + j]
        _, first, counts = np.unique(key, return_index=True, return_counts=True)
        at, h = at[first], h[first]
        columns = [self.words.take(pa.array(self.ids[at + j])) for j in range(k)]
        phrase = columns[0] if k == 1 else pc.binary_join_element_wise(*columns, pa.scalar(" ", pa.large_string()))
        return pa.RecordBatch.from_arrays([self.langs.take(pa.array(self.lang[at])), phrase.cast(pa.string()), pa.array(h), pa.array(counts, pa.int64())], COUNTED)

    def totals(self) -> pa.RecordBatch:
        """The words of each language, as the count of no phrase."""
        counts = np.bincount(self.lang, minlength=len(self.langs))
        return pa.RecordBatch.from_arrays([self.langs, pa.nulls(len(counts), pa.string()), pa.array(np.zeros(len(counts), np.uint64)), pa.array(counts, pa.int64())], COUNTED)


def cut_long(batch: pa.RecordBatch, most: int):
    """The batch, texts over `most` bytes in several rows: cut at the ends of pieces, which no phrase crosses."""
    sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
    if not len(sizes) or sizes.max() <= most:
        yield batch
        return
    for i in range(batch.num_rows):
        row = batch.slice(i, 1)
        if sizes[i] <= most:
            yield row
            continue
        text, start = row.column("text")[0].as_py().encode(), 0
        while start < len(text):
            stop = len(text)
            if stop - start > most:
                stop = max(text.rfind(bytes([b]), start, start + most) for b in BREAKS) + 1
                if not stop:
                    later = [x for b in BREAKS if (x := text.find(bytes([b]), start + most)) >= 0]
                    stop = min(later) + 1 if later else len(text)
            yield pa.RecordBatch.from_arrays([row.column("lang"), pa.array([text[start:stop].decode()])], ["lang", "text"])
            start = stop


def grams(batches, most: int = SLICE_BYTES):
    for batch in slices((b for batch in batches for b in cut_long(batch, most)), "text", most):
        yield batch, Grams(batch.column("text"), batch.column("lang"))


def counters(h: np.ndarray, bits: int):
    """The counters of hashes h: for each row of the sketch, their numbers in 2 ** bits. Both are in one shard."""
    top = h >> np.uint64(64 - bits)
    yield top.astype(np.int64)
    low = np.uint64((1 << SHARD_BITS) - 1)
    yield ((top & ~low) | (h & low)).astype(np.int64)


def sent(h: list[np.ndarray], bits: int, least: int, kind):
    """Shard and packed counters of all rows, for each shard that h touches."""
    h = np.concatenate(h)
    h.sort()
    shard = (h >> np.uint64(64 - bits + SHARD_BITS)).astype(np.int64) if bits > SHARD_BITS else np.zeros(len(h), np.int64)
    edges = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        cells = [np.minimum(np.bincount(c & ((1 << SHARD_BITS) - 1), minlength=1 << SHARD_BITS), least).astype(kind) for c in counters(h[a:b], bits)]
        yield int(shard[a]), pa.compress(np.concatenate(cells), "zstd", asbytes=True)


def added(parts: list, least: int, kind) -> np.ndarray:
    size = ROWS << SHARD_BITS
    total = np.zeros(size, np.int64)
    for p in parts:
        total += np.frombuffer(pa.decompress(p.as_py(), size * np.dtype(kind).itemsize, "zstd"), kind)
        np.minimum(total, least, out=total)
    return total.astype(kind)


def sketch(texts: DataFrame, size: int, longest: int, least: int) -> tuple[np.ndarray, int]:
    """The bits of all counters, row by row, which say whether a counter reached `least`; and the bits of a row's size."""
    shards = LEAST_SHARDS
    while shards < SHARDS and shards * TEXT_PER_COUNTER << SHARD_BITS < size:
        shards *= 2
    bits = SHARD_BITS + shards.bit_length() - 1
    groups = isqrt(size // SENT_BYTES) + 1
    kind = np.min_scalar_type(least)

    def run(batches):
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId(), 0
        held, read = [], 0

        def out():
            rows = list(sent(held, bits, least, kind))
            return pa.RecordBatch.from_pydict({"shard": pa.array([s for s, _ in rows], pa.int32()), "part": pa.array([(31 * task + n) % groups] * len(rows), pa.int32()), "cells": pa.array([c for _, c in rows], pa.binary())})

        for batch, found in grams(batches):
            held += [h for _, _, h in found.hashes(longest)]
            read += batch.column("text").nbytes
            if read >= SENT_BYTES:
                yield out()
                held, read, n = [], 0, n + 1
        if held:
            yield out()

    def merge(rows: pa.Table) -> pa.Table:
        cells = added(rows.column("cells").combine_chunks(), least, kind)
        return pa.table({"shard": rows.column("shard")[:1], "cells": [pa.compress(cells, "zstd", asbytes=True)]})

    def full(rows: pa.Table) -> pa.Table:
        cells = added(rows.column("cells").combine_chunks(), least, kind)
        return pa.table({"shard": rows.column("shard")[:1], "bits": [np.packbits(cells >= least, bitorder="little").tobytes()]})

    parts = over_texts(texts, run, "shard int, part int, cells binary")
    merged = parts.groupBy("shard", "part").applyInArrow(merge, "shard int, cells binary").groupBy("shard").applyInArrow(full, "shard int, bits binary")
    of_row = (1 << SHARD_BITS) // 8
    reached = np.zeros((ROWS, shards * of_row), np.uint8)
    for r in written(merged, "sketch").collect():  # 128 MB at most, whatever the input
        reached[:, r.shard * of_row : (r.shard + 1) * of_row] = np.frombuffer(r.bits, np.uint8).reshape(ROWS, of_row)
    return reached, bits


def summed(tables: list) -> pa.Table:
    return pa.concat_tables(tables).group_by(["lang", "phrase", "h"], use_threads=False).aggregate([("f", "sum")]).rename_columns(COUNTED)


def packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows.combine_chunks())
    return sink.getvalue().to_pybytes()


def merged(rows: pa.Table) -> pa.Table:
    return summed([pa.ipc.open_stream(r.as_py()).read_all() for r in rows.column("rows")])


def frequent(docs: DataFrame, text_col: str, lang_col: str, longest: int, least: int) -> DataFrame:
    """lang, phrase, f of all phrases of 1 to `longest` words with f >= least; phrase null: the language's words."""
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    reached, bits = sketch(texts, size, longest, least)
    bitmap = docs.sparkSession.sparkContext.broadcast(reached)
    buckets, groups = min(BUCKETS, max(64, size // TEXT_PER_BUCKET)), isqrt(size // SENT_BYTES) + 1

    def run(batches):
        from pyspark import TaskContext

        rows, held, bytes_ = bitmap.value, [], 0
        for _, found in grams(batches):
            new = [found.totals()]
            for k, at, h in found.hashes(longest):
                there = np.all([(row[c >> 3] >> (c & 7).astype(np.uint8)) & 1 for row, c in zip(rows, counters(h, bits), strict=True)], axis=0)
                new.append(found.phrases(at[there], h[there], k))
            held.append(summed([pa.Table.from_batches(new)]))
            bytes_ += held[-1].nbytes
            if bytes_ > HELD_BYTES:
                held = [summed(held)]
                bytes_ = held[0].nbytes
                if bytes_ > HELD_BYTES // 2:
                    yield from sends(held[0], TaskContext.get().partitionId())
                    held, bytes_ = [], 0
        if held:
            yield from sends(summed(held), TaskContext.get().partitionId())

    def sends(table, task):
        bucket = pa.array((table.column("h").to_numpy() % np.uint64(buckets)).astype(np.int32))
        table = table.append_column("bucket", bucket).sort_by([("bucket", "ascending"), ("phrase", "ascending")])
        bucket = table.column("bucket").to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        parts = [packed(table.slice(a, b - a).drop_columns("bucket")) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]]), pa.array([task % groups] * len(parts), pa.int32()), pa.array(parts, pa.binary())], ["bucket", "part", "rows"])

    def merge(rows: pa.Table) -> pa.Table:
        return pa.table({"bucket": rows.column("bucket")[:1], "rows": pa.array([packed(merged(rows))], pa.binary())})

    def full(rows: pa.Table) -> pa.Table:
        total = merged(rows)
        return total.filter(pc.or_(pc.greater_equal(total.column("f"), least), pc.is_null(total.column("phrase")))).select(["lang", "phrase", "f"])

    parts = over_texts(texts, run, "bucket int, part int, rows binary")
    counted = parts.groupBy("bucket", "part").applyInArrow(merge, "bucket int, rows binary").groupBy("bucket").applyInArrow(full, "lang string, phrase string, f long")
    return written(counted, "phrases")


def joined(first: Column, size: Column) -> Column:
    return F.array_join(F.slice("words", first, size), " ")


def scored(counts: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, n, score of all candidates, from what frequent() gives: by the cut of the lowest score."""
    phrases = counts.where(F.col("phrase").isNotNull())
    candidates = phrases.select("lang", "phrase", F.split("phrase", " ").alias("words"), F.col("f").alias("a")).where(F.size("words") > 1)
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "words", "a", "k", joined(F.lit(1), F.col("k")).alias("head"), joined(F.col("k") + 1, F.size("words") - F.col("k")).alias("rest"))
    part = lambda name, f: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("head", "l"), ["lang", "head"]).join(part("rest", "r"), ["lang", "rest"])
    cuts = cuts.join(F.broadcast(counts.where(F.col("phrase").isNull()).select("lang", F.col("f").alias("n"))), "lang")  # a row a language
    cuts = cuts.withColumn("score", F.expr("(cast(1000 as decimal(20,0)) * a * n) div (cast(l as decimal(20,0)) * r)"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "words", "a", "l", "r", "n")).alias("best"))
    return best.select("lang", "phrase", *[F.col(f"best.{c}").alias(c) for c in ("words", "a", "l", "r", "n", "score")])


def subsumed(candidates: DataFrame) -> DataFrame:
    """lang, phrase of the candidates whose words lie within a longer candidate that is as frequent (it can't be more so)."""
    inner = F.expr("flatten(transform(sequence(2, size(words) - 1), m -> transform(sequence(1, size(words) - m + 1), i -> array_join(slice(words, i, m), ' '))))")
    within = candidates.where(F.size("words") > 2).select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer"))
    within = within.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return within.join(candidates, ["lang", "phrase"]).where("100 * longer >= 100 * a").select("lang", "phrase")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language, best first.

    Null and empty texts have no words; a null language is `und`, one with it. Repeated rows count each. Very long texts are
    read whole, in parts cut where no phrase can cross. Ties of score go by a, then by the phrase's bytes. An empty table
    gives an empty result. Extra columns are ignored, whatever their names.
    """
    candidates = written(scored(frequent(docs, text_col, lang_col, longest, least)), "collocations")
    kept = candidates.join(subsumed(candidates), ["lang", "phrase"], "left_anti")
    order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc())
    # the best of each of 256 parts first, so that a language's window has 256 * top rows at most
    part = Window.partitionBy("lang", "part").orderBy(*order)
    best = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(256))).withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
