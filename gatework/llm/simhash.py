"""SimHash near-dedup with BK-trees.

Fingerprints within `RADIUS` bits are linked, and a document's component is what links reach. By the pigeonhole
principle, when 64 bits are cut into b > 4 blocks, two fingerprints that differ in at most 4 bits agree on some choice
of b - 4 blocks; each choice with its bits is a shard key, and every link shows in at least one shard. A shard's
fingerprints form a BK-tree (children keyed by their integer Hamming distance to the parent), and its members follow
only the edges within the radius. Trees of all documents would not be small enough to broadcast everywhere, so a shard's
tree goes to that shard's probes only; a shard over `SHARD_ROWS` is cut into sub-trees, each sent to every slice of that
shard's probes. Equal fingerprints are one node, shards emit spanning links only (never all pairs of a group), and
components come from alternating large-star and small-star steps over the links.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatework.llm.common import distinct, over_texts, ragged, scratch, slices, written

WORDS, SEED, RADIUS = 4, 42, 4
#: Fingerprints of one tree.
SHARD_ROWS = 4096
#: Mean fingerprints of a shard by which the number of blocks is chosen.
MEAN_ROWS = 64
#: A fingerprint with more than one in so many rows is joined by broadcast.
HEAVY = 1024
#: Pairs of probe and tree node that are compared at once.
FRONTIER = 1 << 18


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Unsigned 64-bit SimHash of the text's word shingles; zero without words."""
    found = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(found)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: len(found) - k].tolist(), ends[k:].tolist(), strict=True)]
    set_bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        part = np.array(hashes[i : i + 65_536], "<u8")
        set_bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_batches(batches, words: int):
    for batch in slices(batches, "text"):
        prints = [fingerprint((t or "").encode(), words) for t in batch.column("text").to_pylist()]
        keys = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, keys), pa.array(np.array(prints, np.uint64).view(np.int64))], [*keys, "fp"])


def fingerprints(docs: DataFrame, words: int = WORDS, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The long columns `keys` and fp, the fingerprint as a signed long: one row per row of docs."""
    slim = docs.select(*[F.col(k).cast("long").alias(k) for k in keys], F.col("text"))
    return over_texts(slim, lambda batches: fingerprint_batches(batches, words), ", ".join(f"{k} long" for k in [*keys, "fp"]))


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class BKForest:
    """BK-trees of many groups, built and searched level by level with array operations.

    `groups` are sorted; each group's rows are one tree. Node numbers are row numbers. Children of a node are distinct
    in `edge`, their distance to it, and lie together, sorted by edge.
    """

    def __init__(self, prints: np.ndarray, groups: np.ndarray):
        n = len(prints)
        self.prints = prints
        parent, edge = np.full(n, -1), np.zeros(n, np.int64)
        waiting = np.arange(n)
        key = groups.astype(np.int64)  # waiting rows of equal key compete for one place in the tree
        under = np.full(n, -1)
        at = np.zeros(n, np.int64)
        self.root_groups, self.root_nodes = key[:0], waiting[:0]
        first_level = True
        while len(waiting):
            head = np.concatenate([[True], key[1:] != key[:-1]])
            nodes = waiting[head]
            parent[nodes], edge[nodes] = under[head], at[head]
            if first_level:
                self.root_groups, self.root_nodes = key[head], nodes
                first_level = False
            node = nodes[np.cumsum(head) - 1][~head]
            waiting = waiting[~head]
            d = distance(prints[waiting], prints[node]).astype(np.int64)
            key = node * 65 + d
            order = np.argsort(key, kind="stable")
            waiting, key, under, at = waiting[order], key[order], node[order], d[order]
        child_keys = np.where(parent >= 0, parent * 65 + edge, -1)
        self.children = np.argsort(child_keys, kind="stable")
        self.child_keys = child_keys[self.children]

    def links(self, probes: np.ndarray, groups: np.ndarray, radius: int):
        """Yields (probe row, node) arrays of all pairs within the radius, the probes starting at their group's root."""
        root = np.searchsorted(self.root_groups, groups)
        found = root < len(self.root_groups)
        found[found] = self.root_groups[root[found]] == groups[found]
        stack = [(np.flatnonzero(found), self.root_nodes[root[found]])]
        while stack:
            probe, node = stack.pop()
            if len(probe) > FRONTIER:
                stack.append((probe[FRONTIER:], node[FRONTIER:]))
                probe, node = probe[:FRONTIER], node[:FRONTIER]
            d = distance(probes[probe], self.prints[node]).astype(np.int64)
            hit = d <= radius
            if hit.any():
                yield probe[hit], node[hit]
            low = np.searchsorted(self.child_keys, node * 65 + np.maximum(d - radius, 0))
            high = np.searchsorted(self.child_keys, node * 65 + np.minimum(d + radius, 64), "right")
            count = high - low
            if count.any():
                stack.append((np.repeat(probe, count), self.children[ragged(low, count)]))


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (value, smallest value of its component) that connect what the links (a, b) connect."""
    values = distinct(np.concatenate([a, b]))
    x, y = np.searchsorted(values, a), np.searchsorted(values, b)
    label = np.arange(len(values))
    while True:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while (label[label] != label).any():
            label = label[label]
        if (before == label).all():
            break
    moved = label != np.arange(len(values))
    return values[moved], values[label[moved]]


def link_rows(rows: dict[str, np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the shards in rows, which are sorted by shard. side 0 rows are the tree, side 1 rows probe it,
    side 2 rows do both."""
    shard, prints = rows["shard"], rows["fp"].view(np.uint64)
    tree, probe = rows["side"] != 1, rows["side"] != 0
    forest, probes = BKForest(prints[tree], shard[tree]), prints[probe]
    a, b = [], []
    held = 0
    for p, node in forest.links(probes, shard[probe], radius):
        x, y = probes[p].view(np.int64), forest.prints[node].view(np.int64)
        other = x != y
        a.append(x[other])
        b.append(y[other])
        held += int(other.sum())
        if held > 4 * FRONTIER:  # bounded by the number of rows again
            x, y = spanning(np.concatenate(a), np.concatenate(b))
            a, b, held = [x], [y], 0
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return spanning(np.concatenate(a), np.concatenate(b))


def link_batches(batches, radius: int):
    """Takes rows sorted by shard; whole shards are joined, as many at once as make some 64k rows."""
    names, held, size = ("shard", "fp", "side"), [], 0

    def out(rows):
        x, y = link_rows(rows, radius)
        return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append({n: batch.column(n).to_numpy(zero_copy_only=False) for n in names})
        size += batch.num_rows
        if size < 65_536:
            continue
        rows = {n: np.concatenate([h[n] for h in held]) for n in names}
        cut = int(np.searchsorted(rows["shard"], rows["shard"][-1]))
        if cut:
            yield out({n: rows[n][:cut] for n in names})
        held, size = [{n: rows[n][cut:] for n in names}], size - cut
    if held:
        yield out({n: np.concatenate([h[n] for h in held]) for n in names})


def block_masks(blocks: int, radius: int) -> list[int]:
    """Bit masks of all choices of blocks - radius among `blocks` near-equal parts of 64 bits."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(parts, blocks - radius)]


def blocks_for(n: int, radius: int) -> int:
    """The fewest blocks by which shards of random fingerprints hold MEAN_ROWS on average."""
    for blocks in range(radius + 1, radius + 6):
        if n <= MEAN_ROWS << (64 * (blocks - radius) // blocks):
            break
    return blocks


def links(nodes: DataFrame, n: int, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Spanning links (a, b) between the distinct fingerprints of nodes (fp); b is smaller than a."""
    masks = block_masks(blocks_for(n, radius), radius)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long"))) for i, m in enumerate(masks)])
    banded = nodes.select("fp", F.explode(keys).alias("key"))
    large = banded.groupBy("key").count().where(F.col("count") > shard_rows).select("key", F.ceil(F.col("count") / shard_rows).cast("int").alias("parts"))
    rows = banded.join(large, "key", "left")
    # sub-shard (i, j): rows of part i build the tree, rows of part j probe it; i = j does both
    part = F.pmod(F.xxhash64(F.lit("part"), F.col("fp")), F.col("parts")).cast("int")
    cross = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda j: F.struct(F.xxhash64("key", F.least(F.col("part"), j), F.greatest(F.col("part"), j)).alias("shard"), F.when(j == F.col("part"), 2).when(j > F.col("part"), 0).otherwise(1).alias("side")),
    )
    whole = F.array(F.struct(F.col("key").alias("shard"), F.lit(2).alias("side")))
    rows = rows.withColumn("part", part).select("fp", F.explode(F.when(F.col("parts").isNull(), whole).otherwise(cross)).alias("s")).select("fp", "s.shard", "s.side")
    dealt = rows.repartition("shard").sortWithinPartitions("shard").select("shard", "fp", "side")
    return dealt.mapInArrow(lambda batches: link_batches(batches, radius), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has links; root is the smallest node that it reaches.

    Alternates large-star and small-star until nothing changes. Every step is joins and pre-aggregated minima over the
    links, written to the shared folder; the driver sees only their number and checksum.
    """
    with scratch(edges.sparkSession):
        edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
        mark = None
        while True:
            both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
            low = large.groupBy("a").agg(F.min("b").alias("m"))
            small = large.join(low, "a")
            small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
            edges = written(small, "links")
            now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
            if now == mark:
                break
            mark = now
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")))
        roots = written(both.distinct(), "roots", keep=True)
    return roots


def node_components(prints: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(fp, n, root, component_id) of every fingerprint of prints (doc_id, fp); n is its number of rows, root the
    component's smallest fingerprint."""
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")), "nodes")
    found = components(links(nodes.select("fp"), nodes.count(), radius, shard_rows))
    linked = found.join(nodes, F.col("node") == F.col("fp")).select("fp", "root", "least_id")
    smallest = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_linked = linked.select("fp", "root").join(smallest, "root")
    alone = F.col("root").isNull()
    return nodes.join(of_linked, "fp", "left").select(
        "fp", "n", F.coalesce("root", "fp").alias("root"), F.when(alone, F.col("least_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def attached(prints: DataFrame, of_node: DataFrame) -> DataFrame:
    """prints joined with its nodes. Those with over 1/HEAVY of all rows, fewer than HEAVY, are broadcast, so that no task
    gets all rows of a large group of copies."""
    of_node = written(of_node, "node-components")
    total = of_node.agg(F.sum("n")).first()[0] or 0
    heavy = F.col("n") > total / HEAVY
    joined = prints.join(F.broadcast(of_node.where(heavy)), "fp")
    light = prints.join(F.broadcast(of_node.where(heavy).select("fp")), "fp", "left_anti").join(of_node.where(~heavy), "fp")
    return joined.unionByName(light)


def near_dedup(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Null texts and texts without words have fingerprint zero, which links like any other. Rows with a null id are
    linked and may connect others; a component of null ids only has a null component_id. Repeated rows each appear.
    An empty table gives an empty result. Extra columns are ignored.
    """
    prints = written(fingerprints(docs, words), "fingerprints")
    of_node = node_components(prints, radius, shard_rows)
    return attached(prints, of_node).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
