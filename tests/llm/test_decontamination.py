import hashlib
import re

from gatework.llm.decontamination import contamination, decontaminated
from tests.llm.helpers import LOW, ODD, frame

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").translate(LOW))


def brute(rows, items, window=10):
    out = []
    for i, t, *_ in rows:
        w = words(t)
        hit, found = set(), set()
        for item, text in items:
            b = words(text)
            for s in range(max(len(b) - window, 0) + 1 if b else 0):
                part = b[s : s + window]
                for at in range(len(w) - len(part) + 1):
                    if w[at] == part[0] and w[at : at + len(part)] == part:
                        hit |= set(range(at, at + len(part)))
                        found.add(str(item) if item is not None else "")
        out.append((-1 if i is None else i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_against_brute_force(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    items = [(1, passage), (1, passage), (2, "Short item"), (3, None), (4, ""), (None, "seven eight NINE"), (5, "the the the the the the the the the the the"), (30, "cat sat on the mat")]
    rows = ODD + [
        (20, f"x {passage.upper()}! y", "en", "a", 1), (21, "two three, four-five six seven eight nine ten", "en", "a", 1), (22, "one two three four five six seven eight nine ten one two", "en", "a", 1),
        (23, "the " * 15, "en", "a", 1), (24, "short... ITEM short item", "en", "a", 1),
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = brute(rows, items)  # row 7 is a very long text
    for block_bytes in (8 << 20, 100):  # in one block, and in several
        got = contamination(frame(spark, rows), benchmark, block_bytes=block_bytes).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
    docs = frame(spark, rows)
    kept = decontaminated(docs, benchmark, block_bytes=100)
    assert kept.columns == docs.columns
    clean = [r[0] for r in want if not r[5]]
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == clean


def test_empty_tables(spark):
    benchmark = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert contamination(frame(spark, []), benchmark).count() == 0
    none = contamination(frame(spark), benchmark.where("false"))
    assert none.count() == len(ODD) and none.where("contaminated").count() == 0
