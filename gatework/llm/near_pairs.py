"""Near-dedup by SimHash with BK-trees, made whole for five-word shingles and a similarity of 4/5.

Documents whose sets of five-word shingles have a Jaccard similarity of at least 4/5 are linked, and a group is what
links reach. SimHash fingerprints, linked through BK-trees, give first candidates, whose sets are compared. But sets of
that similarity may differ in far more bits than any sharded search of 64 bits can reach, so a prefix filter completes
the links: two such sets of n shingles share at least 4/5 of either, so under any one order of all shingles they share one
of the first n - ceil(4n/5) + 1. The order puts shingles that a sample found in many documents last, so prefixes rarely
hold common ones; the sample changes the speed only. Of the rows of each shared shingle the one whose own shingles are
shared most is a first candidate too: in a group of near copies that is the text that the others were made from, or close
to it, which joins the group without all its pairs. Then all pairs that share a shingle of their
prefixes and are not yet joined must pass bounds that no linked pair fails before their texts are compared: of sizes; of a
parity sketch, whose differing bits are at most the sets' differing shingles; and of the number of shingles that the
prefixes share. (Where the prefix of a ends before that of b, all that both share up to its end is in both prefixes, so
they share no more than that and what a has behind it.) Equal sets are one node. No pair is missed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gatework.llm.common import free_names, over_texts, ragged, scratch, slices, written
from gatework.llm.simhash import attached, components, fingerprint, links

WORDS = 5
#: Documents that show which shingles are common, and how many of those are kept.
SAMPLE, COMMON = 5000, 1 << 16
#: Bits of a parity sketch.
SKETCH = 1024
#: Places of the filter that tells which texts a comparison may need; more texts only let more through.
FILTER = 1 << 20
#: Rows of one shingle that one task compares.
SHARD_ROWS = 4096
#: Bytes of text whose shingles are made at once.
SLICE = 4 << 20
SIGN = np.uint64(1 << 63)
#: Odd multipliers of the words of a shingle.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' distinct shingles, ascending within a text and end to end, and the number of each text. A
    text of fewer words has one of all of them; without words it has none."""
    low = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    split = pc.ascii_split_whitespace(low)
    counts = np.where(pc.equal(low, "").to_numpy(zero_copy_only=False), 0, pc.list_value_length(split).to_numpy(zero_copy_only=False)).astype(np.int64)
    words = split.flatten()
    coded = words.filter(pc.not_equal(words, "")).dictionary_encode()
    known = np.fromiter((xxhash.xxh64_intdigest(w.encode()) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    w = known[coded.indices.to_numpy(zero_copy_only=False)]
    numbers = np.where(counts > 0, np.maximum(counts - WORDS + 1, 1), 0)
    of = np.repeat(np.arange(len(counts)), numbers)
    at = ragged(np.cumsum(counts) - counts, numbers)
    length = np.minimum(counts, WORDS)[of]
    h = length.astype(np.uint64)
    for k in range(WORDS):
        inside = length > k
        h[inside] += w[at[inside] + k] * PLACES[k]
    h = mixed(h)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    once = np.ones(len(h), bool)
    once[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return h[once], np.bincount(of[once], minlength=len(counts))


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums modulo 2^64 of consecutive runs."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values.view(np.int64)))


def shingle_batches(batches):
    for batch in slices(batches, "text", SLICE):
        yield pa.RecordBatch.from_arrays([pa.array(shingles(batch.column("text"))[0].view(np.int64))], ["shingle"])


def prefix_batches(batches, common: np.ndarray, often: np.ndarray):
    """fp (a hash of the set; zero without words), its size and sketch, the SimHash, and the prefix, which sets of under
    four do not need, with the place of its last shingle in the order of all. common: ascending. A set that comes again in
    the task has its prefix once, so that copies make no hot shingles."""
    seen: set[int] = set()
    for batch in slices(batches, "text", SLICE):
        texts = batch.column("text")
        h, counts = shingles(texts)
        fp = np.where(counts > 0, mixed(sums(mixed(h ^ PLACES[0]), counts) + counts.astype(np.uint64)), np.uint64(0))
        of, bits = np.repeat(np.arange(len(counts)), counts), (h >> np.uint64(40)).astype(np.int64) % SKETCH
        odd = [np.bincount(x, minlength=SKETCH) & 1 for x in np.split(bits, np.cumsum(counts)[:-1])]
        sketch = pa.array([np.packbits(x.astype(bool)).tobytes() for x in odd], pa.binary())
        simhash = np.array([fingerprint((t or "").encode(), WORDS) for t in texts.to_pylist()], np.uint64)
        place = np.minimum(np.searchsorted(common, h), len(common) - 1)
        rank = np.where(common[place] == h, often[place], 0)
        order = np.lexsort((rank, of))  # stable: equal ranks stay in the hashes' order
        h, rank = h[order], rank[order]
        first = np.where(counts >= 4, counts - (4 * counts + 4) // 5 + 1, 0)
        fresh = np.array([not (f in seen or seen.add(f)) for f in fp.tolist()], bool)
        prefix = lists(h[ragged(np.cumsum(counts) - counts, first * fresh)], first * fresh)
        last = np.maximum(np.cumsum(counts) - counts + first - 1, 0)[: len(counts) if len(h) else 0]
        ends = [np.where(first > 0, x[last], 0) if len(h) else np.zeros(len(counts), np.int64) for x in (rank, (h ^ SIGN).view(np.int64))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), batch.column("doc_id"), pa.array(fp.view(np.int64)), pa.array(counts, pa.int32()), sketch, pa.array(simhash.view(np.int64)), prefix, *map(pa.array, ends)],
            ["key", "doc_id", "fp", "size", "sketch", "simhash", "prefix", "end_rank", "end_hash"],
        )


def needed_batches(batches, needed: np.ndarray):
    """The rows of which needed may tell."""
    for batch in batches:
        batch = batch.filter(pa.array(needed[batch.column("key").to_numpy() % FILTER]))
        if batch.num_rows:
            yield batch


def compared_batches(batches):
    """The pairs (a, b) of a similarity of 4/5 and more, by their texts."""
    for batch in slices(batches, "text_a", SLICE // 2):
        sides = [np.split(h, np.cumsum(n)[:-1]) for h, n in (shingles(batch.column(c)) for c in ("text_a", "text_b"))]
        near = [9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y)) for x, y in zip(*sides, strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))


def within(size_a: np.ndarray, size_b: np.ndarray, sketch_a: np.ndarray, sketch_b: np.ndarray) -> np.ndarray:
    """Whether sizes and sketches allow a similarity of 4/5."""
    return 9 * np.bitwise_count(sketch_a ^ sketch_b).sum(axis=1, dtype=np.int64) <= size_a.astype(np.int64) + size_b


def sketches_of(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, SKETCH // 64)


def sketched_batches(batches):
    """The pairs (a, b) that sketches allow."""
    for batch in batches:
        ok = within(batch.column("size_a").to_numpy(), batch.column("size_b").to_numpy(), sketches_of(batch.column("sketch_a")), sketches_of(batch.column("sketch_b")))
        yield batch.select(["a", "b"]).filter(pa.array(ok))


def candidates(rows: dict[str, np.ndarray], sketches: np.ndarray):
    """Yields (a, b, n) arrays, a > b, of the pairs of different roots within the shards of rows (sorted by shard) that may
    be linked, and in how many of the shards they meet."""
    n = len(rows["shard"])
    head = np.concatenate([[True], rows["shard"][1:] != rows["shard"][:-1]])
    starts = np.flatnonzero(head)
    end = np.concatenate([starts[1:], [n]])[np.cumsum(head) - 1]

    def passed(i, j):
        sides = rows["side"][i] + rows["side"][j]
        ok = (rows["root"][i] != rows["root"][j]) & ((sides == 1) | (sides == 4))
        i, j = i[ok], j[ok]
        x, y = rows["size"][i].astype(np.int64), rows["size"][j].astype(np.int64)
        ok = 4 * np.maximum(x, y) <= 5 * np.minimum(x, y)
        i, j = i[ok], j[ok]
        ok = within(x[ok], y[ok], sketches[i], sketches[j])
        a, b = rows["fp"][i[ok]], rows["fp"][j[ok]]
        return np.maximum(a, b), np.minimum(a, b)

    def once(found):
        pairs, n = np.unique(np.stack([np.concatenate(x) for x in zip(*found, strict=True)], axis=1), axis=0, return_counts=True)
        return pairs[:, 0], pairs[:, 1], n

    i, step, found, held = np.arange(n), 1, [], 0
    while len(i := i[i + step < end[i]]):
        for at in range(0, len(i), 1 << 16):
            found.append(passed(i[at : at + (1 << 16)], i[at : at + (1 << 16)] + step))
            held += len(found[-1][0])
            if held > 1 << 19:
                yield once(found)
                found, held = [], 0
        step += 1
    if found:
        yield once(found)


def candidate_batches(batches):
    """Takes rows sorted by shard; whole shards are compared, as many at once as make some 32k rows."""
    names, held, size = ("shard", "fp", "root", "size", "side", "sketch"), [], 0

    def out(table):
        rows = {c: table.column(c).to_numpy() for c in names[:-1]}
        for found in candidates(rows, sketches_of(table.column("sketch"))):
            yield pa.RecordBatch.from_arrays(list(map(pa.array, found)), ["a", "b", "n"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch.select(list(names)))
        size += batch.num_rows
        if size < 32_768:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        shard = table.column("shard").to_numpy()
        cut = int(np.searchsorted(shard, shard[-1]))
        if cut:
            yield from out(table.slice(0, cut))
        held, size = table.slice(cut).to_batches(), size - cut
    if held:
        yield from out(pa.Table.from_batches(held).combine_chunks())


def by_simhash(nodes: DataFrame) -> DataFrame:
    """Candidates (a, b): a node and the first of its fingerprint, and the first nodes of fingerprints that BK-trees link."""
    first = written(nodes.groupBy("simhash").agg(F.min("fp").alias("first")), "simhashes")
    same = nodes.select("fp", "simhash").join(first, "simhash").select(F.col("fp").alias("a"), F.col("first").alias("b"))
    of = lambda c: first.select(F.col("simhash").alias(c), F.col("first").alias(f"first_{c}"))
    near = links(first.select(F.col("simhash").alias("fp")), first.count()).join(of("a"), "a").join(of("b"), "b")
    return same.where("a <> b").unionByName(near.select(F.greatest("first_a", "first_b").alias("a"), F.least("first_a", "first_b").alias("b")))


def by_centre(shared: DataFrame, nodes: DataFrame) -> DataFrame:
    """Candidates (a, b): a and, of the centres of its shared shingles, the one that most of them have. A shingle's centre is
    the node whose shingles have most rows, for its size."""
    weight = (F.sum("rows") / F.max("size")).alias("weight")
    weights = shared.join(nodes.select("fp", "size"), "fp").groupBy("fp").agg(weight)
    centre = F.max(F.struct("weight", "fp")).over(Window.partitionBy("key"))["fp"]
    counted = shared.join(weights, "fp").withColumn("centre", centre).where("fp <> centre").groupBy("fp", "centre").count()
    best = counted.groupBy("fp").agg(F.max_by("centre", F.struct("count", "centre")).alias("centre"))
    return best.select(F.greatest("fp", "centre").alias("a"), F.least("fp", "centre").alias("b"))


def of_pairs(pairs: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """pairs with those columns of the nodes a and b, as column_a and column_b; only pairs whose sizes are within 4/5."""
    for c in "ab":
        pairs = pairs.join(nodes.select(F.col("fp").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("size", *columns)]), c)
    return pairs.where(4 * F.greatest("size_a", "size_b") <= 5 * F.least("size_a", "size_b"))


def by_shingle(shared: DataFrame, nodes: DataFrame, roots: DataFrame, shard_rows: int) -> DataFrame:
    """Candidates (a, b) of different roots among the rows of each shared shingle."""
    known = nodes.select("fp", "size", "sketch").join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    of = shared.join(known.select("fp", "root"), "fp")  # shingles whose rows are all joined have no candidates
    rows = shared.select("fp", "key").join(of.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key"), "key", "left_semi")
    rows = written(rows, "near-rows")
    large = rows.groupBy("key").count().where(F.col("count") > shard_rows).select("key", F.ceil(F.col("count") / shard_rows).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64(F.lit("part"), F.col("fp")), F.col("parts")).cast("int")
    cross = F.transform(  # as in simhash.links
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda j: F.struct(F.xxhash64("key", F.least(F.col("part"), j), F.greatest(F.col("part"), j)).alias("shard"), F.when(j == F.col("part"), 2).when(j > F.col("part"), 0).otherwise(1).alias("side")),
    )
    whole = F.array(F.struct(F.col("key").alias("shard"), F.lit(2).alias("side")))
    rows = rows.join(large, "key", "left").withColumn("part", part).select("fp", F.explode(F.when(F.col("parts").isNull(), whole).otherwise(cross)).alias("s")).select("fp", "s.shard", "s.side")
    dealt = rows.join(known, "fp").repartition("shard").sortWithinPartitions("shard", "fp").select("shard", "fp", "root", "size", "side", "sketch")
    met = over_texts(dealt, candidate_batches, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    behind = lambda c: F.ceil(4 * F.col(f"size_{c}") / 5) - 1
    ends_first = F.struct("end_rank_a", "end_hash_a") <= F.struct("end_rank_b", "end_hash_b")
    shared_at_most = F.col("n") + F.when(ends_first, behind("a")).otherwise(behind("b"))
    return of_pairs(met, nodes, "end_rank", "end_hash").where(9 * shared_at_most >= 4 * (F.col("size_a") + F.col("size_b"))).select("a", "b")


def linked(pairs: DataFrame, nodes: DataFrame, slim: DataFrame) -> DataFrame:
    """The candidates (a, b) of a similarity of 4/5 and more. Only their texts, and few others, are shuffled."""
    pairs = written(pairs, "candidates")
    wanted = written(nodes.select("fp", "key").join(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "fp", "left_semi"), "compared")
    needed = np.zeros(FILTER, bool)
    needed[[r[0] for r in wanted.select(F.pmod("key", F.lit(FILTER))).distinct().collect()]] = True  # at most FILTER rows
    sent = slim.sparkSession.sparkContext.broadcast(needed)
    found = over_texts(slim.select("key", F.coalesce("text", F.lit("")).alias("text")), lambda batches: needed_batches(batches, sent.value), "key long, text string")
    texts = written(found.groupBy("key").agg(F.first("text").alias("text")).join(wanted, "key").select("fp", "text"), "texts")
    left, right = (texts.select(F.col("fp").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    return written(over_texts(pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b"), compared_batches, "a long, b long"), "near-links")


def near_deduplicated(docs: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """docs with one row of each group: that of the smallest id, a null id only where there is no other.

    Of repeated rows one stays. Null texts and texts without words are one group; a text of under five words has one
    shingle of all of them. Very long texts are read whole. An empty table gives an empty result. Columns stay those of
    docs, whatever their names.
    """
    key, id_text, nth = free_names(docs, "dedup_key", "dedup_id", "dedup_nth")
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    keyed = docs.withColumns({key: F.xxhash64("doc_id", "text"), id_text: as_text("doc_id")})  # never null, so that the join and the window share one partitioning
    slim = keyed.select(F.col(key).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    with scratch(docs.sparkSession):
        sample = slim.where(F.pmod("key", F.lit(max(1, docs.count() // SAMPLE))) == 0).select("text")
        counted = over_texts(sample, shingle_batches, "shingle long").groupBy("shingle").count().where("count > 2")
        top = sorted((r.shingle & (2**64 - 1), r["count"]) for r in counted.orderBy(F.desc("count"), "shingle").limit(COMMON).collect()) or [(0, 0)]
        common, often = np.array([x for x, _ in top], np.uint64), np.array([n for _, n in top], np.int64)
        sent = docs.sparkSession.sparkContext.broadcast((common, often))  # of fixed size
        prints = written(over_texts(slim, lambda batches: prefix_batches(batches, *sent.value), "key long, doc_id long, fp long, size int, sketch binary, simhash long, prefix array<long>, end_rank long, end_hash long"), "prefixes")
        of_set = [F.max(c).alias(c) for c in ("size", "sketch", "simhash", "end_rank", "end_hash")]
        nodes = written(prints.groupBy("fp").agg(F.count("*").alias("n"), F.min("key").alias("key"), *of_set), "nodes")
        of_key = Window.partitionBy("key")
        rows = prints.select("fp", F.explode("prefix").alias("key"))
        rows = rows.withColumns({"first": F.min("fp").over(of_key), "last": F.max("fp").over(of_key), "rows": F.count("*").over(of_key)})
        shared = written(rows.where("first <> last").select("fp", "key", "rows").distinct(), "shared-shingles")
        likely = of_pairs(by_simhash(nodes).unionByName(by_centre(shared, nodes)).distinct(), nodes, "sketch")
        first = linked(over_texts(likely, sketched_batches, "a long, b long"), nodes, slim)
        rest = linked(by_shingle(shared, nodes, components(first), shard_rows), nodes, slim)
        found = components(first.unionByName(rest))
        of_node = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("root"))
        least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key"))
        kept = attached(prints.select("key", "doc_id", "fp"), of_node).groupBy("root").agg(least.alias("first"))
        kept = written(kept.select(F.col("first.key").alias(key), as_text("first.doc_id").alias(id_text)), "kept", keep=True)
    once = F.row_number().over(Window.partitionBy(key, id_text).orderBy(F.lit(1)))
    out = keyed.join(kept, [key, id_text]).withColumn(nth, once).where(F.col(nth) == 1)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
