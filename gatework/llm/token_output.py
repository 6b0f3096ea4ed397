"""Token ids in Simple-8b files.

Documents are range-partitioned and sorted by id; each partition is a shard and writes segments of whole documents.
A segment row holds its shard, its place in the shard, the document ids and lengths, and one Simple-8b stream. Spark's
writer commits the rows as Parquet, so a lost executor repeats its task and no half-written file is ever read.
"""

from __future__ import annotations

import hashlib
import json as jsons
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gatework.llm.common import fresh_path, over_texts, pieces_of, ragged, slices, worker_cache
from gatework.llm.simple8b import decode, encode

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Bytes of text in a shard.
SHARD_BYTES = 24 << 20
#: Pieces whose ids a worker keeps from task to task; it holds up to twice as many meanwhile.
CACHED = 250_000
SEGMENTS = "shard int, segment int, start_in_shard long, doc_ids array<bigint>, lengths array<bigint>, data binary"
#: The special tokens, normaliser, pre-tokenizer and end-of-word mark by which a text's ids are those of its
#: pieces. A tokenizer with others encodes whole texts.
SPECIAL = r"<\|(startoftext|endoftext)\|>"
SPECIALS = ["<|startoftext|>", "<|endoftext|>"]
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
WORD_END = "</w>"


def tokenizer_json(path: str | None = None) -> str:
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path or public_tokenizers.path(TOKENIZER)).to_str()


def cuts_texts(json: str) -> bool:
    """Whether the tokenizer's rules are those that Encoder's pieces rest on."""
    rules = jsons.loads(json)
    added = [t["content"] for t in rules["added_tokens"] if t["special"] and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"])]
    pre = {"type": "Sequence", "pretokenizers": [SPLIT, BYTES]}
    model = rules["model"]
    return (
        added == SPECIALS and len(rules["added_tokens"]) == len(added) and rules["normalizer"] == NORMALIZER and rules["pre_tokenizer"] == pre and not rules["truncation"] and not rules["padding"]
        and model["type"] == "BPE" and model["end_of_word_suffix"] == WORD_END and not model["continuing_subword_prefix"] and not model["dropout"]
    )


class Encoder:
    """Encodes whole texts, each distinct piece once.

    The known tokenizer drops white space and never joins across it, nor across a change between an ASCII letter and an ASCII
    mark (an apostrophe may start a contraction and is left alone), and it folds case. So a text's ids are those of its
    pieces in order. Words that contain a special token are kept as they are. A tokenizer of any other rules encodes each
    text as a whole.
    """

    def __init__(self, json: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(json)
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for piece, i in self.tokenizer.get_vocab().items():
            self.ends_word[i] = piece.endswith(WORD_END)
        self.cuts = cuts_texts(json)
        self.cache = worker_cache(f"tokens-{hashlib.sha256(json.encode()).hexdigest()}")
        if not self.cache:
            none = np.zeros(0, np.int64)
            self.cache.update(pieces=pa.array([], pa.string()), starts=none, lengths=none, used=none, ids=np.zeros(0, np.uint32), time=0)

    def one_word_each(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids, end to end, and lengths of pieces that are one run of letters: encoded many at once, as a word's last id
        is marked. Should a word not end where a piece does, all are encoded one by one."""
        joined = [" ".join(pieces[k : k + 100]) for k in range(0, len(pieces), 100)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for i in range(0, len(joined), 200) for e in self.tokenizer.encode_batch_fast(joined[i : i + 200], add_special_tokens=False)])
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(pieces):
            return self.one_by_one(pieces)
        return ids, np.diff(ends, prepend=0)

    def one_by_one(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        coded = [np.array(e.ids, np.uint32) for i in range(0, len(pieces), 10_000) for e in self.tokenizer.encode_batch_fast(pieces[i : i + 10_000], add_special_tokens=False)]
        return np.concatenate(coded), np.fromiter(map(len, coded), np.int64, len(coded))

    def piece_ids(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All known ids, and each piece's start and length in them. The latest CACHED pieces are kept for later calls."""
        c = self.cache
        c["time"] += 1
        if len(c["pieces"]) > 2 * CACHED:
            keep = np.sort(np.argsort(c["used"], kind="stable")[-CACHED:])
            c["ids"] = c["ids"][ragged(c["starts"][keep], c["lengths"][keep])]
            c["pieces"], c["lengths"], c["used"] = c["pieces"].take(pa.array(keep)), c["lengths"][keep], c["used"][keep]
            c["starts"] = np.cumsum(c["lengths"]) - c["lengths"]
        place = pc.index_in(pieces, value_set=c["pieces"])
        new = pieces.filter(pc.is_null(place))
        # the tokenizer takes NFC first, which splits some letters into letter and mark; U+0130 is the one letter that
        # lower-casing takes apart
        whole = pc.and_(pc.equal(new, pc.utf8_normalize(new, "NFC")), pc.invert(pc.match_substring(new, "\u0130")))
        letters = pc.and_(pc.match_substring_regex(new, r"^\p{L}+$"), whole)
        place = pc.fill_null(place, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        missing = np.flatnonzero(place < 0)
        kinds = letters.to_numpy(zero_copy_only=False)
        for mask, coder in ((kinds, self.one_word_each), (~kinds, self.one_by_one)):
            if mask.any():
                some = new.filter(pa.array(mask))
                place[missing[mask]] = len(c["pieces"]) + np.arange(len(some))
                ids, lengths = coder(some.to_pylist())
                c["pieces"] = pa.concat_arrays([c["pieces"], some])
                c["starts"] = np.concatenate([c["starts"], len(c["ids"]) + np.cumsum(lengths) - lengths])
                c["ids"], c["lengths"] = np.concatenate([c["ids"], ids]), np.concatenate([c["lengths"], lengths])
                c["used"] = np.concatenate([c["used"], np.zeros(len(some), np.int64)])
        c["used"][place] = c["time"]
        return c["ids"], c["starts"][place], c["lengths"][place]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the number of each text."""
        if not self.cuts:
            return self.one_by_one([t or "" for t in texts.to_pylist()]) if len(texts) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        per_text = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        words = split.flatten().dictionary_encode()
        which = words.indices.to_numpy(zero_copy_only=False)
        special = pc.match_substring_regex(words.dictionary, SPECIAL)
        cut = pc.ascii_lower(words.dictionary)
        cut = pc.replace_substring_regex(cut, r"([a-z])([!-&(-/:-@\[-`{-~])", r"\1 \2")
        cut = pc.replace_substring_regex(cut, r"([!-&(-/:-@\[-`{-~])([a-z])", r"\1 \2")
        cut = pc.ascii_split_whitespace(pc.if_else(special, words.dictionary, cut))
        piece_counts = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
        pieces = cut.flatten().dictionary_encode()
        ids, starts, lengths = self.piece_ids(pieces.dictionary)
        in_words = pieces.indices.to_numpy(zero_copy_only=False).astype(np.int64)  # pieces of distinct words, end to end
        of_piece = lengths[in_words]
        word_ids = ids[ragged(starts[in_words], of_piece)]  # ids of distinct words, end to end
        ends = np.concatenate([[0], np.cumsum(of_piece)])
        piece_ends = np.concatenate([[0], np.cumsum(piece_counts)])
        word_starts = ends[piece_ends[:-1]]
        word_lengths = ends[piece_ends[1:]] - word_starts
        of_word = word_lengths[which]
        out = word_ids[ragged(word_starts[which], of_word)]
        word_ends = np.concatenate([[0], np.cumsum(of_word)])
        text_ends = np.concatenate([[0], np.cumsum(per_text)])
        return out, word_ends[text_ends[1:]] - word_ends[text_ends[:-1]]


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    out = np.full(len(ids) + len(counts), end_id, np.uint32)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(counts + 1) - 1] = False
    out[keep] = ids
    return out, counts + 1


def write_segments(batches, json: str, end_id: int):
    encoder, start, segment = Encoder(json), 0, 0
    for batch in slices(batches, "text", 4 << 20):
        ids, lengths = with_end(*encoder.ids(batch.column("text")), end_id)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([batch.column("shard")[0].as_py()], pa.int32()),
                pa.array([segment], pa.int32()),
                pa.array([start], pa.int64()),
                pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                pa.array([lengths.tolist()], pa.list_(pa.int64())),
                pa.array([encode(ids)], pa.binary()),
            ],
            ["shard", "segment", "start_in_shard", "doc_ids", "lengths", "data"],
        )
        start, segment = start + len(ids), segment + 1


def read_segments(batches):
    for batch in batches:
        for row in range(batch.num_rows):
            lengths = np.array(batch.column("lengths")[row].as_py(), np.int64)
            ids = decode(batch.column("data")[row].as_py()).astype("<u4")
            view, ends = memoryview(ids.tobytes()), np.cumsum(lengths)
            starts = ends - lengths
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(lengths), batch.column("shard")[row].as_py(), np.int32)),
                    pa.array(starts + batch.column("start_in_shard")[row].as_py()),
                    pa.array(batch.column("doc_ids")[row].as_py(), pa.int64()),
                    pa.array(lengths),
                    pa.array(crc, pa.int64()),
                ],
                ["shard", "start", "doc_id", "n_tokens", "ids_crc32"],
            )


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, shards: int | None = None) -> None:
    """Writes all texts' ids (null is empty) in ascending doc_id order, null ids first. `tokenizer` is a path."""
    spark = docs.sparkSession
    shards = shards or pieces_of(docs, "text", SHARD_BYTES)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    dealt = slim.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id").select("doc_id", "text", F.spark_partition_id().alias("shard"))
    json = spark.sparkContext.broadcast(tokenizer_json(tokenizer))  # a file of fixed size
    over_texts(dealt, lambda batches: write_segments(batches, json.value, end_id), SEGMENTS).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    segments = spark.read.schema(SEGMENTS).parquet(path)
    shards = segments.groupBy("shard").agg(F.max(F.col("start_in_shard") + F.expr("aggregate(lengths, 0L, (a, x) -> a + x)")).alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("before"))
    docs = over_texts(segments, read_segments, "shard int, start long, doc_id long, n_tokens long, ids_crc32 long")
    return docs.join(shards, "shard").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes docs' tokens in the shared folder and reads them back.

    Null and empty texts have the end id only; a very long text is a segment of its own. Repeated rows are each written;
    rows of one id follow one another in any order. A null id sorts first. An empty table gives an empty result. Extra
    columns are ignored.
    """
    path = fresh_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer)
    return read_tokens(docs.sparkSession, path)
