import hashlib
from collections import Counter

from gatework.llm.exact_dedup import exact_dedup
from gatework.llm.mixing import MOST, WEIGHTS, mix, mix_report
from tests.llm.helpers import LOW, ODD, SCHEMA, frame


def test_exact_dedup_against_brute_force(spark):
    rows = ODD + [(100 + i, "Copy %d" % (i % 3), "en", "a", 1) for i in range(300)]
    got = exact_dedup(frame(spark, rows), counters=16).collect()
    digest = lambda t: hashlib.sha256((t or "").translate(LOW).encode()).hexdigest()
    groups = {}
    for r in rows:
        groups.setdefault(digest(r[1]), []).append(r[0])
    assert len(got) == len(rows)
    for r in got:
        ids = groups[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def brute_targets(sizes):
    """Water filling by repeated sharing."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weights = {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(names)}
    total, fixed = float(sum(sizes.values())), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        level = (total - sum(fixed.values())) / sum(weights[s] for s in open_) if open_ else 0
        over = [s for s in open_ if level * weights[s] > MOST * sizes[s]]
        if not over:
            return fixed | {s: level * weights[s] for s in open_}
        fixed |= {s: MOST * sizes[s] for s in over}


def test_mixing_targets_and_takes(spark):
    rows = ODD + [(200 + i, "w " * (i % 17), "en", "src%d" % (i % 7), 0) for i in range(400)]
    got = mix_report(frame(spark, rows)).collect()
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").split())
    want = brute_targets(sizes)
    assert len(got) == len(rows)
    source = {r[0]: r[3] for r in rows if r[0] is not None}
    taken = {}
    for r in got:
        assert 0 <= r.taken <= MOST * r.size
        if r.doc_id is not None:
            assert r.source_size == sizes[source[r.doc_id]] and abs(r.target - want[source[r.doc_id]]) < 1e-6
    for r in got:
        taken[(r.source_size, round(r.target, 6))] = taken.get((r.source_size, round(r.target, 6)), 0) + r.taken
    for (_, target), n in taken.items():
        assert abs(n - target) <= 0.5 + 1e-6 or sum(abs(round(w, 6) - target) < 1e-6 for w in want.values()) > 1
    assert sorted(map(str, got)) == sorted(map(str, mix_report(frame(spark, rows)).collect()))


def test_mix_gives_what_the_report_says(spark):
    rows = [(i, " ".join("w%d" % k for k in range(i % 9)), "en", "src%d" % (i % 4), 0) for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    words = {}
    for r in mix(docs).collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
        assert r.n_chars == len(r.text)
    assert words == {r.doc_id: r.taken for r in mix_report(docs).collect() if r.taken}
    assert mix(docs).columns == docs.columns


def test_curriculum_follows_the_schedules(spark):
    """With equal sizes, a source of falling weight comes earlier on average than one of rising weight."""
    rows = [(i, "w " * 10, "en", "src%d" % (i % 3), 0) for i in range(900)]
    got = mix_report(spark.createDataFrame(rows, SCHEMA)).where("taken > 0").collect()
    mean = lambda k: sum(r.first_position for r in got if r.doc_id % 3 == k) / max(1, sum(r.doc_id % 3 == k for r in got))
    assert mean(1) < mean(2) and all(0 <= r.first_position <= 1 for r in got)


def test_empty_tables(spark):
    none = frame(spark, [])
    assert exact_dedup(none).count() == 0 and mix_report(none).count() == 0 and mix(none).count() == 0
