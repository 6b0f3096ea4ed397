import random

import numpy as np
import xxhash

from gatework.llm import simhash
from tests.llm.helpers import LOW, ODD, SCHEMA, frame


def plain_fingerprint(text):
    words = (text or "").translate(LOW).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, ids):
    """Smallest id reachable, by repeated minima over all pairs."""
    a = np.array(prints, np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= 4
    label = np.array([i if i is not None else 10**9 for i in ids])
    while True:
        new = np.array([label[near[i]].min() for i in range(len(a))])
        if (new == label).all():
            return [int(x) if x < 10**9 else None for x in label]
        label = new


def test_near_dedup_against_brute_force(spark):
    r = random.Random(5)
    words = ["w%d" % i for i in range(50)]
    base = [[r.choice(words) for _ in range(60)] for _ in range(20)]
    rows = list(ODD)
    for i in range(200):
        t = list(r.choice(base))
        for _ in range(r.randrange(3)):
            t[r.randrange(len(t))] = r.choice(words)
        rows.append((1000 + i, " ".join(t), "en", "a", 1))
    got = simhash.near_dedup(frame(spark, rows), shard_rows=16).collect()
    prints = [plain_fingerprint(t) for _, t, *_ in rows]
    want = sorted(zip([i if i is not None else -1 for i, *_ in rows], [f"{p:016x}" for p in prints], [c if c is not None else -1 for c in components(prints, [i for i, *_ in rows])], strict=True))
    assert sorted((g.doc_id if g.doc_id is not None else -1, g.fingerprint, g.component_id if g.component_id is not None else -1) for g in got) == want


def test_every_link_shares_a_block():
    r = random.Random(1)
    for blocks in range(5, 10):
        masks = simhash.block_masks(blocks, 4)
        for _ in range(200):
            a = r.getrandbits(64)
            b = a
            for bit in r.sample(range(64), 4):
                b ^= 1 << bit
            assert any(a & m == b & m for m in masks)


def test_tree_finds_all_pairs_in_radius():
    r = np.random.default_rng(2)
    base = r.integers(0, 2**63, 40, dtype=np.uint64)
    prints = np.unique(np.concatenate([base ^ (np.uint64(1) << np.uint64(k)) for k in range(0, 64, 7)]))
    groups = np.sort(r.integers(0, 3, len(prints)))
    forest = simhash.BKForest(prints, groups)
    got = {(int(p), int(n)) for ps, ns in forest.links(prints, groups, 4) for p, n in zip(ps, ns, strict=True)}
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    assert got == {(i, j) for i in range(len(prints)) for j in range(len(prints)) if near[i, j] and groups[i] == groups[j]}


def test_long_chains_are_one_component(spark):
    chain = [((1 << (4 * k)) - 1) & (2**64 - 1) for k in range(17)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(100 - i, signed(x)) for i, x in enumerate(chain)], "doc_id long, fp long")
    assert {r.component_id for r in simhash.node_components(df).collect()} == {84}
