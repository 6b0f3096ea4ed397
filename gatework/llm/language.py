"""Language identification of mixed-language text.

Words are scored under every learned language by hashed letter n-grams (a naive Bayes model in log space). The script of
a word's letters narrows the candidates to languages that use the script. A Viterbi pass over the words with a penalty
for each switch labels spans; the document's language is that of most letters. Documents whose best single label no
switch can improve are settled without the lattice, by the largest gain of any run of words under other labels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatework.llm.common import over_texts, ragged, slices

#: Training documents of a language at most (in expectation), table size, n-gram lengths in bytes, smoothing.
PER_LANGUAGE, BUCKETS, ORDERS, ALPHA = 2000, 1 << 15, (2, 3, 4), 0.5
#: Log-probability a switch must gain; the share of a language's letters that makes a script its own.
SWITCH, OWN_SCRIPT = 12.0, 0.01
#: First code points of script ranges; each lasts to the next. The names matter only for being distinct.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"),
    (0x07C0, "Nko"), (0x0800, "Samaritan"), (0x0860, "Syriac"), (0x0870, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"),
    (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Cherokee"), (0x1400, "Canadian"), (0x1680, "Ogham"), (0x16A0, "Runic"), (0x1700, "Philippine"), (0x1780, "Khmer"),
    (0x1800, "Mongolian"), (0x18B0, "Canadian"), (0x1900, "Other"), (0x1C80, "Cyrillic"), (0x1C90, "Georgian"), (0x1CC0, "Other"), (0x1D00, "Latin"), (0x1F00, "Greek"), (0x2000, "Latin"),
    (0x2C00, "Glagolitic"), (0x2C60, "Latin"), (0x2C80, "Coptic"), (0x2D00, "Georgian"), (0x2D30, "Tifinagh"), (0x2D80, "Ethiopic"), (0x2DE0, "Cyrillic"), (0x2E80, "Han"), (0x3040, "Kana"),
    (0x3100, "Bopomofo"), (0x3130, "Hangul"), (0x3190, "Han"), (0x31A0, "Bopomofo"), (0x31F0, "Kana"), (0x3200, "Han"), (0xA000, "Yi"), (0xA4D0, "Other"), (0xA640, "Cyrillic"), (0xA6A0, "Other"),
    (0xA720, "Latin"), (0xA800, "Other"), (0xAB30, "Latin"), (0xAB70, "Cherokee"), (0xABC0, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Hangul"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Armenian"),
    (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE20, "Other"), (0xFE70, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, "Other"), (0x20000, "Han"),
)
NAMES = sorted({name for _, name in SCRIPTS})


def held_out(doc_id: Column, parts: int, which: int) -> Column:
    """Whether crc32 of the id's text has this remainder; a null id never has."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == which, F.lit(False))


class Words:
    """The words of some texts: `which` numbers each word among the distinct ones, `ends` bounds each text's words."""

    def __init__(self, texts: pa.Array):
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = split.flatten().dictionary_encode()
        self.which = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.ends = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))]).astype(np.int64)
        letters = pc.utf8_lower(pc.replace_substring_regex(words.dictionary, r"[^\p{L}\p{M}]+", " "))
        self.distinct = pc.utf8_trim_whitespace(letters)
        self.n = len(self.distinct)
        self.lengths = pc.utf8_length(self.distinct).to_numpy(zero_copy_only=False).astype(np.int64)
        points = np.frombuffer("".join(self.distinct.to_pylist()).encode("utf-32-le"), np.uint32)
        kinds = np.sort(points)
        kinds = kinds[np.concatenate([[True], kinds[1:] != kinds[:-1]])] if len(kinds) else kinds
        is_letter = np.array([chr(p).isalpha() for p in kinds.tolist()], bool)
        script = np.array([NAMES.index(name) for _, name in SCRIPTS])[np.searchsorted([a for a, _ in SCRIPTS], kinds, "right") - 1]
        place = np.searchsorted(kinds, points)
        of_word = np.repeat(np.arange(self.n), self.lengths)
        lettered = is_letter[place] if len(kinds) else np.zeros(0, bool)
        #: letters of each distinct word in each script
        cells = of_word[lettered] * len(NAMES) + script[place][lettered] if len(kinds) else np.zeros(0, np.int64)
        self.scripts = np.bincount(cells, minlength=self.n * len(NAMES)).reshape(self.n, len(NAMES))
        self.letters = self.scripts.sum(axis=1)

    def grams(self):
        """(word, bucket) of all n-grams of the distinct words that have letters, padded by a space."""
        padded = pc.binary_join_element_wise("", self.distinct, "", " ").filter(pa.array(self.letters > 0))
        words = np.flatnonzero(self.letters > 0)
        offsets = np.frombuffer(padded.buffers()[1], np.int32, len(padded) + 1, 4 * padded.offset).astype(np.int64) if len(padded) else np.zeros(1, np.int64)
        data = np.frombuffer(padded.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64) if len(padded) else np.zeros(0, np.uint64)
        sizes = np.diff(offsets)
        offsets = offsets[:-1] - offsets[0]
        for order in ORDERS:
            count = np.maximum(sizes - order + 1, 0)
            at = ragged(offsets, count)
            code = np.full(len(at), order, np.uint64)
            for k in range(order):
                code = code * np.uint64(257) + data[at + k]
            bucket = (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKETS.bit_length() + 1)
            yield np.repeat(words, count), bucket.astype(np.int64)


def count_batches(batches, languages: list[str]):
    """Sparse sums (language, cell, n): n-gram buckets, then letters by script."""
    width = BUCKETS + len(NAMES)
    total = np.zeros(len(languages) * width, np.int64)
    number = {name: i for i, name in enumerate(languages)}
    for batch in slices(batches, "text", 2 << 20):
        words = Words(batch.column("text"))
        language = np.array([number[x] for x in batch.column("lang").to_pylist()])
        of_word = np.repeat(language, np.diff(words.ends))
        seen = np.bincount(of_word * words.n + words.which, minlength=len(languages) * words.n).reshape(len(languages), words.n)
        grams = [*words.grams()]
        for i in range(len(languages)):
            for word, bucket in grams:
                total[i * width : i * width + BUCKETS] += np.bincount(bucket, seen[i][word], BUCKETS).astype(np.int64)
            total[i * width + BUCKETS : (i + 1) * width] += seen[i] @ words.scripts
    cells = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], ["cell", "n"])


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray):
        grams, scripts = counts[:, :BUCKETS], counts[:, BUCKETS:]
        self.languages = languages
        total = grams.sum(axis=1, keepdims=True)
        self.logs = np.ascontiguousarray((np.log(grams + ALPHA) - np.log(total + ALPHA * BUCKETS)).T / len(ORDERS)) if languages else np.zeros((BUCKETS, 0))
        self.uses = scripts >= OWN_SCRIPT * np.maximum(scripts.sum(axis=1, keepdims=True), 1)

    def scores(self, words: Words) -> np.ndarray:
        """Log-probability of each distinct word under each language; zero for words without letters."""
        out = np.zeros((words.n, len(self.languages)))
        for word, bucket in words.grams():
            for i in range(len(self.languages)):
                out[:, i] += np.bincount(word, self.logs[bucket, i], words.n)
        allowed = self.uses[:, words.scripts.argmax(axis=1)].T
        narrowed = (words.letters > 0) & allowed.any(axis=1)
        floor = out.min(axis=1, keepdims=True) - 2 * SWITCH if len(self.languages) else out
        return np.where(narrowed[:, None] & ~allowed, floor, out)

    def paths(self, scores: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The best label of each word; scores has a row for each word, ends bounds the texts."""
        sizes = np.diff(ends)
        n = len(sizes)
        sums = np.concatenate([np.zeros((1, scores.shape[1])), np.cumsum(scores, axis=0)])
        best = (sums[ends[1:]] - sums[ends[:-1]]).argmax(axis=1)
        path = np.repeat(best, sizes)
        # largest gain of any run of words under other labels: running sums against their minima so far, text by text
        gain = scores.max(axis=1) - scores[np.arange(len(scores)), path]
        mixed = np.zeros(n, bool)
        gained = np.add.reduceat(gain, np.minimum(ends[:-1], max(len(gain) - 1, 0))) if len(gain) else np.zeros(n)
        for d in np.flatnonzero((sizes > 0) & (gained > SWITCH)):
            relative = scores[ends[d] : ends[d + 1]] - scores[ends[d] : ends[d + 1], best[d], None]
            relative[:, best[d]] = -np.inf
            run = np.concatenate([[0], np.cumsum(relative.max(axis=1))])
            mixed[d] = (run - np.minimum.accumulate(run)).max() > SWITCH
        texts = np.flatnonzero(mixed)
        if len(texts):
            chosen = ragged(ends[:-1][texts], sizes[texts])
            path[chosen] = lattice(scores[chosen], sizes[texts])
        return path


def lattice(scores: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Viterbi over texts laid end to end; all texts step together, the longest first."""
    order = np.argsort(-sizes, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[order]
    live = np.searchsorted(-sizes[order], -np.arange(1, sizes.max() + 1), "right")  # texts of at least t + 1 words
    back = np.zeros(scores.shape, np.int16)
    value = scores[starts]
    own = np.arange(scores.shape[1], dtype=np.int16)
    for t in range(1, sizes.max()):
        m = live[t]
        top = value[:m].argmax(axis=1)
        switched = value[np.arange(m), top] - SWITCH
        stay = value[:m] >= switched[:, None]
        at = starts[:m] + t
        back[at] = np.where(stay, own, top[:, None].astype(np.int16))
        value[:m] = scores[at] + np.where(stay, value[:m], switched[:, None])
    path = np.zeros(len(scores), np.int64)
    label = value.argmax(axis=1)
    for t in range(sizes.max() - 1, -1, -1):
        m = live[t]
        at = starts[:m] + t
        path[at] = label[:m]
        label[:m] = back[at, label[:m]]
    return path


def predict_batches(batches, model: Model, with_spans: bool):
    for batch in slices(batches, "text", 2 << 20):
        words = Words(batch.column("text"))
        n = batch.num_rows
        letters = words.letters[words.which]
        text = np.repeat(np.arange(n), np.diff(words.ends))
        has = np.bincount(text, letters, n) > 0
        predicted, score, spans = np.full(n, -1), np.zeros(n), [[] for _ in range(n)]
        if model.languages and len(words.which):
            path = model.paths(model.scores(words)[words.which], words.ends)
            share = np.bincount(text * len(model.languages) + path, letters, n * len(model.languages)).reshape(n, -1)
            predicted = np.where(has, share.argmax(axis=1), -1)
            score = np.where(has, share.max(axis=1) / np.maximum(share.sum(axis=1), 1), 0.0)
            if with_spans:
                for d in np.flatnonzero(has):
                    p = path[words.ends[d] : words.ends[d + 1]]
                    cuts = np.flatnonzero(np.diff(p)) + 1
                    spans[d] = [{"first_word": a, "words": b - a, "lang": model.languages[p[a]]} for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(p)], strict=True)]
        names = [*model.languages, "und"]
        out = [*map(batch.column, [c for c in batch.schema.names if c != "text"]), pa.array([names[i] for i in predicted.tolist()], pa.string()), pa.array(score)]
        labels = [*[c for c in batch.schema.names if c != "text"], "lang_pred", "score"]
        if with_spans:
            out.append(pa.array(spans, pa.list_(pa.struct([("first_word", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))))
            labels.append("spans")
        yield pa.RecordBatch.from_arrays(out, labels)


def trained(docs: DataFrame, train: Column, per_language: int = PER_LANGUAGE) -> Model:
    """A model of the rows where `train` holds, text and lang are not null. Of a language with more than per_language of
    them a sample by hash of the id is learned from; the rest of the work is counts of fixed size."""
    known = docs.select("doc_id", "text", "lang").where(train & F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, BUCKETS + len(NAMES))))
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, per_language / sizes[lang]))])
    draw = F.crc32(F.concat(F.lit("sample"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")) / F.lit(float(1 << 32))
    sample = known.where(draw < F.element_at(share, F.col("lang"))).select("text", "lang")
    counted = over_texts(sample, lambda it: count_batches(it, languages), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(languages) * (BUCKETS + len(NAMES)), np.int64)
    counts[counted.column("cell").to_numpy()] = counted.column("n").to_numpy()
    return Model(languages, counts.reshape(len(languages), -1))


def identify(docs: DataFrame, model: Model, keys: tuple[str, ...] = ("doc_id",), with_spans: bool = True) -> DataFrame:
    """The columns `keys` (any type), lang_pred, score (the label's share of the text's letters) and, if asked for, spans:
    runs of words of one label.

    Null texts and texts without a letter are `und` with score 0, as is everything if no language was learned. Words
    without letters take the label around them. Ties go to the first language in code point order.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size for each language
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "lang_pred string, score double"] + ["spans array<struct<first_word:int,words:int,lang:string>>"] * with_spans)
    return over_texts(docs.select(*keys, "text"), lambda it: predict_batches(it, sent.value, with_spans), schema)


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learned from rows whose crc32 remainder by 4 is not 2.

    Null texts and texts without a letter are `und`; rows of null lang are labelled, not learned from, and so are rows
    without an id. Very long texts are read whole. Repeated rows each appear, an empty table gives an empty result, and
    extra columns are ignored.
    """
    out = held_out(F.col("doc_id"), 4, 2)
    model = trained(docs, ~out)
    return identify(docs.select("doc_id", "text"), model, with_spans=False).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def keep_batches(batches, model: Model):
    for batch in slices(batches, "text", 2 << 20):
        found = next(predict_batches([pa.RecordBatch.from_arrays([batch.column("text")], ["text"])], model, False))
        yield batch.filter(pc.not_equal(found.column("lang_pred"), "und"))


def with_language(docs: DataFrame) -> DataFrame:
    """docs without the rows that have no language (`und`): null texts and texts without letters.

    The columns stay those of docs, whatever their names; repeated rows each stay, an empty table gives an empty one. If no
    row has a label to learn from, every row is `und` and goes.
    """
    model = trained(docs, ~held_out(F.col("doc_id"), 4, 2))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return over_texts(docs, lambda it: keep_batches(it, sent.value), docs.schema)
