"""Language-model scoring by a weighted backoff automaton.

The model is a bigram model with Dirichlet smoothing,
    P(w | h) = (c(h w) + MU P(w)) / (c(h) + MU),    P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)),
which in backoff form is an automaton: a state for each word seen in training, an arc for each bigram seen, and a
failure arc of weight MU / (c(h) + MU) to the root, which has an arc for every word and one for all unknown words. A
text is scored in one traversal from left to right that carries the state.

Counts of the whole corpus fit no single machine, so documents are dealt into blocks of bounded size. A block asks for
the counts of its own distinct n-grams (64-bit hashes, packed in sorted order), cut into FAN ranges of the hash. For each
range the questions of FAN blocks are merged; where there are more blocks, the merged n-grams are cut into FAN finer
ranges and merged with those of FAN - 1 other such groups, and so on until a range has the questions of all blocks. Answers
go back the same way, in the order of the questions. So a block sends FAN messages a kind whatever the number of blocks,
every merge has FAN of them, and the number of levels is the logarithm of the number of blocks. A block's automaton then
holds exactly the states and arcs that its documents can reach. The answers also carry the sums over their ranges, from
which every block has the corpus' totals. Two of n distinct n-grams share a hash with a chance of about n^2 / 2^65.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatework.llm.common import pieces_of
from gatework.llm.language import held_out

MU = 100.0
#: Bytes of text in a block.
BLOCK_BYTES = 14 << 20
#: Partitions for each block, so that few blocks share one, and the most partitions: past these a task has several blocks,
#: one after another.
SPREAD, PARTITIONS = 3, 30_000
#: Bits of FAN, the number of ranges that n-grams are cut into and of questions that are merged at each level.
FAN_BITS = 7
END_HASH = np.uint64(0x656E64206F662074)
#: The range of the hash, what merges the question, who asks it, words or bigrams, how many; hashes and training counts.
ASKED = "range long, parent long, child long, kind int, n int, hashes binary, counts binary"
#: Who asked, the range, the counts in the corpus; of words also the sum and the number of those seen in the range.
ANSWERED = "upper long, child long, range long, kind int, counts binary, tokens long, seen long"


def partitions(blocks: int) -> int:
    return min(SPREAD * blocks, PARTITIONS)


def planes(values: np.ndarray) -> bytes:
    """Little-endian bytes, all first bytes before all second ones, which compress well where values are small."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def unplanes(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


class Tokens:
    """The tokens of some texts: words of the folded texts and one end each. `stream` has word numbers, 0 being the end,
    `ends` bounds each text's tokens, `hashes` has a word's hash."""

    def __init__(self, texts: pa.Array):
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        flat = split.flatten()
        counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)  # white space at either end leaves empty strings
        before = np.concatenate([[0], np.cumsum(full)])
        words = before[np.concatenate([[0], np.cumsum(counts)])]
        coded = flat.filter(pa.array(full)).dictionary_encode()
        n = len(texts)
        self.ends = words + np.arange(n + 1)
        self.stream = np.zeros(int(self.ends[-1]), np.int32)
        keep = np.ones(len(self.stream), bool)
        keep[self.ends[1:] - 1] = False
        self.stream[keep] = coded.indices.to_numpy(zero_copy_only=False) + 1
        del split, flat, keep, full, before
        digest = xxhash.xxh64_intdigest
        self.hashes = np.concatenate([[END_HASH], np.fromiter((digest(w.encode()) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))])


class Block:
    """The distinct words and bigrams of a block, by hash, and their counts in its training documents."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        texts = rows.column("text").combine_chunks() if rows.num_rows else pa.array([], pa.string())
        self.tokens = t = Tokens(texts)
        n = len(t.hashes)
        train = np.repeat(~rows.column("held_out").to_numpy(zero_copy_only=False), np.diff(t.ends))
        key = np.zeros(len(t.stream), np.int64)
        key[1:] = t.stream[:-1]  # a text begins after an end
        key *= n
        key += t.stream
        key <<= 1
        key |= train
        key.sort()
        train_only, pair = (key & 1).astype(np.uint32), np.right_shift(key, 1, out=key)
        head = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        counts = np.add.reduceat(train_only, head)
        pair = pair[head]
        del key, train_only, head
        mixed = t.hashes[pair // n] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + t.hashes[pair % n]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        order = np.argsort(mixed, kind="stable")
        self.pairs, self.pair_hashes, self.pair_counts = pair[order], mixed[order], counts[order]
        order = np.argsort(t.hashes, kind="stable")
        self.words, self.word_hashes = order, t.hashes[order]
        self.word_counts = np.bincount(t.stream[train], minlength=n)[order]

    def kinds(self):
        yield 0, self.word_hashes, self.word_counts
        yield 1, self.pair_hashes, self.pair_counts


def table_of(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [field.split() for field in schema.split(", ")]
    return pa.table({name: pa.array([r[i] for r in rows], kinds[kind]) for i, (name, kind) in enumerate(fields)})


def questions(child: int, above: int, level: int, kind: int, hashes: np.ndarray, counts: np.ndarray, bits: int):
    """The questions of one child of level `level` for its sorted n-grams, all in range `above`: one a finer range, also
    where it has no n-gram."""
    first = above << bits
    ranges = (hashes >> np.uint64(64 - level * bits)).astype(np.int64)
    cuts = np.searchsorted(ranges, np.arange(first, first + (1 << bits) + 1))
    for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        yield first + k, child >> bits, child, kind, b - a, planes(np.diff(hashes[a:b], prepend=np.uint64(0))), planes(counts[a:b].astype(np.uint64))


def asked(rows: pa.Table, bits: int) -> pa.Table:
    """A block's questions: its n-grams and what it adds to their counts."""
    out = []
    if rows.num_rows:
        for kind, hashes, counts in Block(rows).kinds():
            out += questions(rows.column("block")[0].as_py(), 0, 1, kind, hashes, counts, bits)
    return table_of(out, ASKED)


class Merged:
    """The questions of a range from all children of one parent, for one kind of n-gram: the distinct n-grams, sorted, and
    the sums of their counts."""

    def __init__(self, rows: pa.Table, kind: int):
        self.kind, self.rows = kind, rows.filter(pc.equal(rows.column("kind"), kind))
        self.sizes = self.rows.column("n").to_pylist()
        hashes = [np.cumsum(unplanes(h, np.uint64), dtype=np.uint64) for h in self.rows.column("hashes").to_pylist()]
        hashes = np.concatenate([np.zeros(0, np.uint64), *hashes])
        counts = np.concatenate([np.zeros(0, np.uint64), *(unplanes(c, np.uint64) for c in self.rows.column("counts").to_pylist())])
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        head = np.ones(len(hashes), bool)
        head[1:] = hashes[1:] != hashes[:-1]
        self.hashes = hashes[head]
        self.sums = np.add.reduceat(counts[order], np.flatnonzero(head)) if len(hashes) else counts
        self.place = np.empty(len(hashes), np.int64)
        self.place[order] = np.cumsum(head) - 1

    def answers(self, sums: np.ndarray, tokens: int, seen: int, bits: int):
        at = 0
        for child, of, n in zip(self.rows.column("child").to_pylist(), self.rows.column("range").to_pylist(), self.sizes, strict=True):
            yield of >> bits, child, of, self.kind, planes(sums[self.place[at : at + n]]), tokens, seen
            at += n


def passed_on(rows: pa.Table, level: int, bits: int) -> pa.Table:
    """The questions of level `level` + 1 for what a range's questions of level `level` make together."""
    parent, above, out = rows.column("parent")[0].as_py(), rows.column("range")[0].as_py(), []
    for kind in (0, 1):
        m = Merged(rows, kind)
        out += questions(parent, above, level + 1, kind, m.hashes, m.sums, bits)
    return table_of(out, ASKED)


def answered(rows: pa.Table, bits: int) -> pa.Table:
    """The answers of a range that has the questions of all blocks."""
    words, pairs = Merged(rows, 0), Merged(rows, 1)
    tokens, seen = int(words.sums.sum()), int((words.sums > 0).sum())
    return table_of([*words.answers(words.sums, tokens, seen, bits), *pairs.answers(pairs.sums, 0, 0, bits)], ANSWERED)


def collected(answers: pa.Table, kind: int) -> np.ndarray:
    """The counts in answers, in the order of the n-grams asked for."""
    mine = answers.filter(pc.equal(answers.column("kind"), kind)).sort_by("range")
    return np.concatenate([np.zeros(0, np.uint64), *(unplanes(c, np.uint64) for c in mine.column("counts").to_pylist())])


def passed_back(rows: pa.Table, answers: pa.Table, bits: int) -> pa.Table:
    """The answers to a range's questions, from the answers to what they made together."""
    out = []
    tokens, seen = (sum(answers.column(c).to_pylist()) for c in ("tokens", "seen"))
    for kind in (0, 1):
        m, sums = Merged(rows, kind), collected(answers, kind)
        if len(sums) != len(m.hashes):
            raise ValueError("answers don't fit the questions")
        out += m.answers(sums, tokens * (kind == 0), seen * (kind == 0), bits)
    return table_of(out, ANSWERED)


class Automaton:
    """States are word numbers (0, the end, is where a text begins). `arcs` are the sorted keys state * words + word of
    the bigrams seen, `weights` theirs; `failure` is a state's backoff weight, `root` the weight of each word at the
    root, where unknown words, whose count is 0, share one weight. Every arc by a word leads to that word's state."""

    def __init__(self, block: Block, word_counts: np.ndarray, pair_counts: np.ndarray, n_train: int, n_distinct: int, mu: float):
        n = len(word_counts)
        self.n = n
        z = n_train + 0.5 * (n_distinct + 1)
        counts = np.empty(n)
        counts[block.words] = word_counts
        self.counts = counts
        self.root = np.log10((counts + 0.5) / z)
        self.failure = np.log10(mu / (counts + mu))
        seen = pair_counts > 0
        pairs, seen_counts = block.pairs[seen], pair_counts[seen].astype(np.float64)
        order = np.argsort(pairs, kind="stable")
        self.arcs = pairs[order]
        state, word = np.divmod(self.arcs, n)
        self.weights = np.log10((seen_counts[order] + mu * (counts[word] + 0.5) / z) / (counts[state] + mu))

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-probabilities of the words at the states, and the states after them."""
        if not len(self.arcs):
            return self.failure[state] + self.root[word], word
        key = state.astype(np.int64) * self.n + word
        at = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
        return np.where(self.arcs[at] == key, self.weights[at], self.failure[state] + self.root[word]), word

    def scores(self, stream: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Each text's log-probability: all texts go from left to right together, the longest first."""
        sizes = np.diff(ends)
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = ends[:-1][order], sizes[order]
        state, total = np.zeros(len(sizes), np.int64), np.zeros(len(sizes))
        live = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), "right")
        for t, m in enumerate(live.tolist()):
            gained, state[:m] = self.step(state[:m], stream[starts[:m] + t])
            total[:m] += gained
        out = np.empty(len(total))
        out[order] = total
        return out


def scored(rows: pa.Table, answers: pa.Table, mu: float) -> pa.Table:
    block = Block(rows)
    found = [collected(answers, kind) for kind in (0, 1)]
    if any(len(f) != len(hashes) for f, (_, hashes, _) in zip(found, block.kinds(), strict=True)):
        raise ValueError("a block's answers don't fit its questions")
    n_train, n_distinct = (sum(answers.column(c).to_pylist()) for c in ("tokens", "seen"))
    model = Automaton(block, found[0], found[1], n_train, n_distinct, mu)
    t = block.tokens
    del block, found
    text = np.repeat(np.arange(rows.num_rows), np.diff(t.ends))
    return pa.table(
        {
            "doc_id": rows.column("doc_id"),
            "held_out": rows.column("held_out"),
            "n_tokens": pa.array(np.diff(t.ends)),
            "n_known": pa.array(np.bincount(text, model.counts[t.stream] > 0, rows.num_rows).astype(np.int64)),
            "train_tokens": pa.array(np.full(rows.num_rows, n_train)),
            "base_score": pa.array(np.bincount(text, model.root[t.stream], rows.num_rows)),
            "score": pa.array(model.scores(t.stream, t.ends)),
        }
    )


def score_texts(docs: DataFrame, held: Column, mu: float = MU, blocks: int | None = None, bits: int = FAN_BITS) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score; the model learns from
    rows where `held` (over doc_id) is false.

    Null and empty texts have the end only. Without training rows all counts are 0. Repeated rows count and are scored
    each; a very long text makes a larger block. An empty table gives an empty result, and extra columns are ignored.
    """
    blocks = blocks or pieces_of(docs, "text", BLOCK_BYTES)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), held.alias("held_out"))
    salt = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())  # rows without an id may be many and equal
    dealt = slim.withColumn("block", F.pmod(F.xxhash64("doc_id", "text", salt), F.lit(blocks))).repartition(partitions(blocks), "block")
    levels = [dealt.groupBy("block").applyInArrow(lambda rows: asked(rows, bits), ASKED)]
    merge = lambda level: lambda rows: passed_on(rows, level, bits)
    while blocks > 1 << bits * len(levels):
        levels.append(levels[-1].groupBy("range", "parent").applyInArrow(merge(len(levels)), ASKED))
    answers = levels.pop().groupBy("range", "parent").applyInArrow(lambda rows: answered(rows, bits), ANSWERED)
    while levels:
        merged = levels.pop().groupBy("range", "parent")
        answers = merged.cogroup(answers.groupBy("upper", "child")).applyInArrow(lambda rows, found: passed_back(rows, found, bits), ANSWERED)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("block").cogroup(answers.groupBy("child")).applyInArrow(lambda rows, found: scored(rows, found, mu), schema)


def score_report(docs: DataFrame) -> DataFrame:
    """score_texts, with its rules, and the rows held out whose crc32 remainder by 5 is 1; a null id is not held out."""
    return score_texts(docs, held_out(F.col("doc_id"), 5, 1))
