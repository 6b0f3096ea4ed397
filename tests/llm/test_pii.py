import hashlib
import random
import re

from gatework.llm.pii import CARD, PHONE, Field, base_spans, candidates, digits_of, example, features, islands, joined, luhn, made_up, pii_report
from tests.llm.helpers import ODD, frame

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def plain(t):
    out = [(0, *m.span()) for m in EMAIL.finditer(t)]
    out += [(1, *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(t) if 13 <= len(digits_of(m[0])) <= 19 and luhn(digits_of(m[0]))]
    return out + [(3, *m.span()) for m in PHONE.finditer(t) if 9 <= len(digits_of(m[0])) <= 15]


def test_base_spans_are_those_of_the_patterns():
    r = random.Random(1)
    for _ in range(20_000):
        t = "".join(r.choice("a1@.+- (2)9é_%") for _ in range(r.randrange(40)))
        assert base_spans(t)[0] == plain(t), t
    assert base_spans("1" * 200_000 + "a" * 100_000 + "@!")[0] == []  # linear on hard texts


def test_field_on_new_examples():
    field = Field()
    field.learn([e for text, spans in made_up() for a, b in islands(text) if (e := example(text, a, b, set(spans)))])
    fresh = made_up(99, 40)
    assert sum(sorted(field.added_spans(t, [])) == sorted(s) for t, s in fresh) >= 0.97 * len(fresh)
    text = "call +1 (389) 555-5010 4785380592391139 now"  # one greedy match, which fails
    assert base_spans(text)[0] == [] and joined(field.added_spans(text, [])) == "card:23:39,phone:5:22"
    text = f"call +1 (389) 555-5010 {' '.join('4785380592391139')} now"
    assert base_spans(text)[0] == [] and joined(field.added_spans(text, [])) == "card:23:54,phone:5:22"


def every_segment(text, a, b):
    """All candidates of an island by trying every start and end."""
    places, out = [m.start() for m in re.compile(r"[0-9]+|[A-Za-z]+|.", re.DOTALL).finditer(text, a, b)] + [b], set()
    for i in range(len(places) - 1):
        for j in range(i + 1, len(places)):
            s = text[places[i] : places[j]]
            n = len(digits_of(s))
            if re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", s):
                out.add((1, i, j))
            if 13 <= n <= 19 and CARD.fullmatch(s):
                out.add((2, i, j))
            if 7 <= n <= 15 and re.fullmatch(r"(\+\(?|\(\(?)?[0-9]([ .()-]*[0-9])*", s):
                out.add((3, i, j))
    return places, out


def test_candidates_and_the_best_of_all_segmentations():
    r = random.Random(5)
    field = Field()
    for _ in range(400):
        text = "".join(r.choice(["12", "345", "4", "7", " ", "-", ".", "(", ") ", "+1 "]) for _ in range(r.randrange(4, 15)))
        for a, b in islands(text):
            places, found = candidates(text, a, b)
            assert set(found) == every_segment(text, a, b)[1] and len(found) == len(set(found)), text
            for k, i, j in found:
                for name in features(text, k, places[i], places[j]):
                    field.weights.setdefault(name, r.gauss(0, 1))

            def worth(at):
                """The best sum of scores of segmentations of the tokens from `at` on, by trying all."""
                if at == len(places) - 1:
                    return 0.0
                return max([worth(at + 1)] + [field.score(features(text, k, places[i], places[j])) + worth(j) for k, i, j in found if i == at])

            spans = field.best(text, a, b, [])
            assert abs(sum(field.score(features(text, *s)) for s in spans) - worth(0)) < 1e-9
            assert all(x[2] <= y[1] for x, y in zip(sorted(spans, key=lambda s: s[1]), sorted(spans, key=lambda s: s[1])[1:]))


def test_long_islands_in_linear_time():
    field = Field()
    field.learn([e for text, spans in made_up(rounds=3) for a, b in islands(text) if (e := example(text, a, b, set(spans)))])
    for text in ("1 " * 20_000, "(" * 100_000 + "1234567", "+" * 50_000 + "(1" * 5_000, "12 - 3 " * 5_000):
        base = base_spans(text)[0]
        field.added_spans(text, base)


def test_report(spark):
    rows = ODD + [(30, "mail bob@example.com or 10.0.0.1, card 4785380592391139, tel +1 (389) 555-5010 ok", "en", "a", 1), (31, "plain words only", "en", "a", 1)]
    got = {r.doc_id: r for r in pii_report(frame(spark, rows)).collect() if r.doc_id is not None}
    r = got[30]
    base = joined(plain(rows[-2][1]))
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1) and r.spans == base and r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert got[31].spans == "" and got[3].spans == "" and got[4].spans == ""
    assert pii_report(frame(spark, rows)).count() == len(rows) and pii_report(frame(spark, [])).count() == 0
