"""Benchmark decontamination by a prefix-filtered set join.

Items are cut into windows of `WINDOW` consecutive words. A document contains a window only if it contains all its
words, so of the window's words in order of rarity over all documents, a prefix of one is necessary: windows are
indexed by their rarest word. A document's words are looked up in that index; the place of the rare word in the window
gives the one place where the window can start (positional bound), which must leave room for all its words in the
document (length bound); the words at that place are then compared one by one. The benchmark is the stated query set:
it is sent to all executors in blocks of at most `BLOCK_BYTES`, one pass over the documents for each.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatework.llm.common import over_texts, ragged, slices, written

WINDOW = 10
BLOCK_BYTES = 8 << 20
#: After lower-casing A-Z, a word is made of digits, a-z and anything that isn't ASCII.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
SPANS = "row long, doc_id long, n_words long, starts array<int>, ends array<int>, items array<string>"


def folded_words(texts: pa.Array) -> pa.ListArray:
    """The words of each text; null has none."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset) if len(texts) else np.zeros(1, np.int32)
    data = texts.buffers()[2]
    low, high = int(offsets[0]), int(offsets[-1])
    folded = pa.py_buffer(data[low:high].to_pybytes().translate(FOLD) if data is not None else b"")
    whole = pa.StringArray.from_buffers(len(texts), pa.py_buffer((offsets - low).astype(np.int32)), folded)
    split = pc.ascii_split_whitespace(whole)
    # white space at either end leaves empty strings
    flat, lengths = split.flatten(), pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if texts.null_count:
        full &= np.repeat(texts.is_valid().to_numpy(zero_copy_only=False), lengths)
    before = np.concatenate([[0], np.cumsum(full)])
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return pa.ListArray.from_arrays(pa.array(before[ends].astype(np.int32)), flat.filter(pa.array(full)))


class Index:
    """Windows of a block of items: distinct windows, their items, and where each one's rarest word stands."""

    def __init__(self, item_ids: list[str], words: list[list[str]], window: int):
        self.vocabulary = pa.array(sorted({w for ws in words for w in ws}), pa.string())
        number = {w: i for i, w in enumerate(self.vocabulary.to_pylist())}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, ws in zip(item_ids, words, strict=True):
            ids = [number[w] for w in ws]
            for i in range(max(len(ids) - window, 0) + 1 if ids else 0):
                found.setdefault(tuple(ids[i : i + window]), set()).add(item)
        windows = sorted(found)
        self.lengths = np.array([len(w) for w in windows], np.int64)
        self.grid = np.full((len(windows), window), -2, np.int64)
        for i, w in enumerate(windows):
            self.grid[i, : len(w)] = w
        self.items = [sorted(found[w]) for w in windows]

    def order(self, counts: np.ndarray) -> None:
        """Indexes each window by its rarest word under the corpus counts of the vocabulary."""
        rank = np.empty(len(counts), np.int64)
        rank[np.lexsort((np.arange(len(counts)), counts))] = np.arange(len(counts))
        ranks = np.where(self.grid >= 0, rank[np.maximum(self.grid, 0)], np.iinfo(np.int64).max) if len(counts) else self.grid
        place = ranks.argmin(axis=1) if len(ranks) else np.zeros(0, np.int64)
        key = self.grid[np.arange(len(place)), place]
        by_key = np.argsort(key, kind="stable")
        self.posted, self.place = by_key, place
        self.post_start = np.searchsorted(key[by_key], np.arange(len(counts)))
        self.post_count = np.searchsorted(key[by_key], np.arange(len(counts)), "right") - self.post_start

    def matches(self, ids: np.ndarray, doc_of: np.ndarray, doc_start: np.ndarray, doc_end: np.ndarray):
        """(first word, window) of all occurrences; ids are the words' numbers, -1 for words that no item has."""
        known = np.flatnonzero(ids >= 0)
        known = known[self.post_count[ids[known]] > 0]
        out = []
        for i in range(0, len(known), 1 << 16):
            at = known[i : i + (1 << 16)]
            count = self.post_count[ids[at]]
            window = self.posted[ragged(self.post_start[ids[at]], count)]
            at = np.repeat(at, count)
            first = at - self.place[window]
            doc = doc_of[at]
            ok = (first >= doc_start[doc]) & (first + self.lengths[window] <= doc_end[doc])
            first, window = first[ok], window[ok]
            for k in range(self.grid.shape[1]):
                want = self.grid[window, k]
                same = (want < 0) | (ids[np.minimum(first + k, len(ids) - 1)] == want)
                first, window = first[same], window[same]
            out.append((first, window))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def numbered(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words = folded_words(texts)
    ids = pc.fill_null(pc.index_in(words.values, value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    return ids, words.offsets.to_numpy().astype(np.int64)


def count_batches(batches, vocabulary: pa.Array):
    total = np.zeros(len(vocabulary), np.int64)
    for batch in slices(batches, "text", 2 << 20):
        ids, _ = numbered(batch.column("text"), vocabulary)
        total += np.bincount(ids[ids >= 0], minlength=len(total))
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["word", "n"])


def span_batches(batches, index: Index):
    for batch in slices(batches, "text", 2 << 20):
        ids, offsets = numbered(batch.column("text"), index.vocabulary)
        n_words = np.diff(offsets)
        doc_of = np.repeat(np.arange(len(n_words)), n_words)
        first, window = index.matches(ids, doc_of, offsets[:-1], offsets[1:])
        order = np.argsort(first, kind="stable")
        first, window = first[order], window[order]
        doc = doc_of[first] if len(first) else first
        bounds = np.searchsorted(doc, np.arange(len(n_words) + 1))
        start = first - offsets[doc]
        items: list[list[str]] = [[] for _ in n_words]
        for d in distinct_sorted(doc):
            items[d] = sorted({i for w in set(window[bounds[d] : bounds[d + 1]].tolist()) for i in index.items[w]})
        lists = lambda values: pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.astype(np.int32)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("doc_id"), pa.array(n_words), lists(start), lists(start + index.lengths[window]), pa.array(items, pa.list_(pa.string()))],
            ["row", "doc_id", "n_words", "starts", "ends", "items"],
        )


def distinct_sorted(values: np.ndarray) -> list[int]:
    return values[np.concatenate([[True], values[1:] != values[:-1]])].tolist() if len(values) else []


def report_batches(batches):
    """n_hit is the size of the union of the spans."""
    for batch in batches:
        columns = {n: batch.column(n) for n in ("starts", "ends", "items")}
        hit, digests, n_items = [], [], []
        spans = pc.list_value_length(columns["starts"]).to_numpy(zero_copy_only=False)
        for i in range(batch.num_rows):
            covered = 0
            if spans[i]:
                s, e = (np.array(columns[n][i].as_py()) for n in ("starts", "ends"))
                order = np.argsort(s, kind="stable")
                s, e = s[order], np.maximum.accumulate(e[order])
                covered = int((e - np.maximum(s, np.concatenate([[0], e[:-1]]))).clip(0).sum())
            items = sorted(set(columns["items"][i].as_py())) if spans[i] else []
            hit.append(covered)
            n_items.append(len(items))
            digests.append(hashlib.sha256(",".join(items).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("doc_id"), batch.column("n_words"), pa.array(hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digests), pa.array([h > 0 for h in hit])],
            ["row", "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


def indexes(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int):
    """An index, sent to the executors, of each block of the benchmark, with rarity counted over all docs (text)."""
    context = docs.sparkSession.sparkContext
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text") + F.lit(64))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).distinct().toArrow()  # block_bytes or so
        words = folded_words(block.column("text").combine_chunks().cast(pa.string())).to_pylist() if block.num_rows else []
        index = Index(block.column("item_id").to_pylist(), words, window)
        vocabulary = context.broadcast(index.vocabulary)
        counted = over_texts(docs.select("text"), lambda it, v=vocabulary: count_batches(it, v.value), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros(len(index.vocabulary), np.int64)
        counts[counted.column("word").to_numpy()] = counted.column("n").to_numpy()
        index.order(counts)
        yield context.broadcast(index)


def spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of docs (row, doc_id, text): SPANS, the word spans of all window occurrences and the items they are of."""
    passes = [over_texts(docs, lambda it, s=sent: span_batches(it, s.value), SPANS) for sent in indexes(docs, benchmark, window, block_bytes)]
    if len(passes) == 1:
        return passes[0]
    together = passes[0]
    for p in passes[1:]:
        together = together.unionByName(p)
    lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "items")]  # a row a block and document
    return together.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *lists).select("row", "doc_id", "n_words", "starts", "ends", "items")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: row, doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null or empty texts have no words and no hits; null or empty items have no windows. Item rows of one id are one
    item; a null item_id is the empty string. Repeated documents are each reported; an empty benchmark hits nothing; no
    documents give an empty result. Extra columns are ignored.
    """
    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    if (benchmark.agg(F.sum(F.octet_length("text") + F.lit(64))).first()[0] or 0) > block_bytes:
        slim = written(slim, "numbered")  # several passes are put together by row number
    return spans(slim, benchmark, window, block_bytes).mapInArrow(report_batches, "row long, doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def clean_batches(batches, index: Index):
    for batch in slices(batches, "text", 2 << 20):
        ids, offsets = numbered(batch.column("text"), index.vocabulary)
        n_words = np.diff(offsets)
        doc_of = np.repeat(np.arange(len(n_words)), n_words)
        first, _ = index.matches(ids, doc_of, offsets[:-1], offsets[1:])
        clean = np.ones(len(n_words), bool)
        clean[doc_of[first]] = False
        yield batch.filter(pa.array(clean))


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the contaminated rows: one pass for each block of the benchmark, and no shuffle.

    Null and empty texts have no words and stay; very long texts are read whole; repeated rows each stay or go. An empty
    benchmark lets all stay, an empty table gives an empty one, and the columns stay those of docs, whatever their names.
    """
    out = docs
    for sent in indexes(docs, benchmark, window, block_bytes):
        out = over_texts(out, lambda it, s=sent: clean_batches(it, s.value), docs.schema)
    return out
