"""Personal data by fixed patterns and a semi-Markov conditional random field.

The patterns give the base spans. The field looks at what they leave: islands of digits and separators, and of marks
that spell an address, are cut into tokens; whole segments of up to 19 digits are candidates, scored by features
of the whole span (digit count, checksum, group lengths, separators, neighbours); dynamic programming over the island
chooses boundaries and types together. So it finds what a greedy pattern swallows or drops, such as a card number
behind a phone number. Base spans always stay, and the field adds none that overlaps them.

It is trained here on islands of a bounded sample of documents whose base spans are certain, and on made-up islands of
the same entities side by side, without a country code, spelled out, or spoilt.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatework.llm.common import over_texts, slices

KINDS = ("email", "ip", "card", "phone")
#: Islands that are learned from at most and how long they may be, the documents that they come from, passes.
ISLANDS, ISLAND_CHARS, TRAIN_DOCS, PASSES = 600, 400, 4000, 12
#: The base patterns, written so that no start is tried twice in one run of digits.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What the field looks at.
NUMERIC = re.compile(r"[+(]*[0-9](?:[0-9]|[ .()+-](?=[ .()+-]{0,2}[0-9]))*")
SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[(](?:at|AT|@)[\])] ?[A-Za-z0-9-]{1,63}(?:(?: ?[\[(](?:dot|DOT|\.)[\])] ?|\.)[A-Za-z0-9-]{1,63}){1,8}")
OPENING = re.compile(r"[+(]{0,2}[0-9]")
TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|.", re.DOTALL)
ADDRESS = re.compile(r"[0-9]{1,3}(\.[0-9]{1,3}){3}")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(kind, start, end) of the base patterns, by kind and start; and the matches that failed their check."""
    found, dropped, last = [], [], 0
    at = text.find("@")
    while at >= 0:
        start = last + len(text[last:at].rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((0, start, domain.end()))
        last = domain.end() if domain else at + 1
        at = text.find("@", last)
    for m in IP.finditer(text):
        ok = all(int(p) <= 255 for p in m[0].split(".")) if len(m[0]) < 100 else all(int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in m[0].split("."))
        (found if ok else dropped).append((1, *m.span()) if ok else m.span())
    for m in CARD.finditer(text):
        d = digits_of(m[0]) if len(m[0]) <= 40 else ""
        if 13 <= len(d) <= 19 and luhn(d):
            found.append((2, *m.span()))
        elif len(m[0]) > 12:
            dropped.append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            ok = 9 <= len(digits_of(m[0])) <= 15
            (found if ok else dropped).append((3, *m.span()) if ok else m.span())
    return found, dropped


def side(text: str, at: int) -> str:
    if not 0 <= at < len(text):
        return "edge"
    c = text[at]
    return "digit" if c.isdigit() else "letter" if c.isalpha() else "space" if c.isspace() else c if c in "+-.()@#$/:,=_" else "mark"


def features(text: str, kind: int, start: int, end: int) -> list[str]:
    """Features of the whole span and its neighbours."""
    span, name = text[start:end], KINDS[kind]
    out = [name, f"{name} left {side(text, start - 1)}", f"{name} right {side(text, end)}"]
    groups = re.findall("[0-9]+", span)
    n = sum(map(len, groups))
    if kind == 0:
        return [*out, f"email spelled {bool(SPELLED.fullmatch(span))}", f"email dots {min(span.count('.') + span.lower().count('dot'), 3)}"]
    if kind == 1:
        return [*out, f"ip bytes {all(int(g) <= 255 for g in groups)}", f"ip zeros {any(len(g) > 1 and g[0] == '0' for g in groups)}"]
    out += [f"{name} digits {n}", f"{name} groups {'-'.join(str(len(g)) for g in groups[:6])}", f"{name} marks {''.join(sorted(set(span) & set(' .()+-')))}", f"{name} starts {side(span, 0)}"]
    if kind == 2:
        return [*out, f"card luhn {luhn(''.join(groups))}", f"card even {len({len(g) for g in groups}) == 1}"]
    return [*out, f"phone closed {span.count('(') == span.count(')')}", f"phone plus {span[0] == '+'}", f"phone long {max(map(len, groups)) > 7}"]


def islands(text: str) -> list[tuple[int, int]]:
    """Stretches that may hold entities: numbers with separators of 7 digits or more, and spelled-out addresses."""
    found = [m.span() for m in NUMERIC.finditer(text) if m.end() - m.start() >= 7] if any(c in text for c in "0123456789") else []
    if "[" in text or "(" in text:
        found += [m.span() for m in SPELLED.finditer(text)]
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def candidates(text: str, a: int, b: int) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Token starts of an island (with its end), and (kind, first token, token after the last) of what a segment may be.

    A segment has up to 19 digits, and up to 3 separators stand between two of an island's digits; at most 2 marks open
    one. So the candidates grow with the island's length only, however its digits are spaced."""
    places = [m.start() for m in TOKEN.finditer(text, a, b)] + [b]
    out = []
    for i in range(len(places) - 1):
        if not OPENING.match(text, places[i]):
            continue
        n = 0
        for j in range(i, len(places) - 1):
            c = text[places[j]]
            if not "0" <= c <= "9":
                if c not in " .()+-" or c == "+" and j > i:
                    break
                continue
            n += places[j + 1] - places[j]
            if n > 19:
                break
            span = text[places[i] : places[j + 1]]
            if 4 <= n <= 12 and ADDRESS.fullmatch(span):
                out.append((1, i, j + 1))
            if 13 <= n <= 19 and CARD.fullmatch(span):
                out.append((2, i, j + 1))
            if 7 <= n <= 15:
                out.append((3, i, j + 1))
    for m in SPELLED.finditer(text, a, b):
        out.append((0, bisect_left(places, m.start()), bisect_left(places, m.end())))
    return places, out


def added(x: float, y: float) -> float:
    return max(x, y) + math.log1p(math.exp(-abs(x - y))) if min(x, y) > -1e9 else max(x, y)


class Field:
    """Weights of features; a token outside of all segments scores 0."""

    def __init__(self):
        self.weights: dict[str, float] = {}

    def score(self, names: list[str]) -> float:
        return sum(self.weights.get(n, 0.0) for n in names)

    def learn(self, examples: list[tuple[int, list[tuple[int, int, list[str]]], set[int]]]) -> None:
        """Examples: number of tokens, segments (first, after, features), the true ones. Gradient steps (Adagrad) on the
        log-likelihood, by forward and backward sums over all segmentations."""
        squares: dict[str, float] = {}
        for _ in range(PASSES):
            for n, segments, gold in examples:
                scores = [self.score(f) for _, _, f in segments]
                ending: list[list[int]] = [[] for _ in range(n + 1)]
                starting: list[list[int]] = [[] for _ in range(n + 1)]
                for k, (i, j, _) in enumerate(segments):
                    ending[j].append(k)
                    starting[i].append(k)
                forward, backward = [0.0] * (n + 1), [0.0] * (n + 1)
                for t in range(1, n + 1):
                    forward[t] = forward[t - 1]
                    for k in ending[t]:
                        forward[t] = added(forward[t], forward[segments[k][0]] + scores[k])
                for t in range(n - 1, -1, -1):
                    backward[t] = backward[t + 1]
                    for k in starting[t]:
                        backward[t] = added(backward[t], backward[segments[k][1]] + scores[k])
                for k, (i, j, names) in enumerate(segments):
                    p = math.exp(min(0.0, forward[i] + scores[k] + backward[j] - forward[n]))
                    g = (k in gold) - p
                    if abs(g) < 1e-4:
                        continue
                    for name in names:
                        squares[name] = squares.get(name, 1e-2) + g * g
                        w = self.weights.get(name, 0.0)
                        self.weights[name] = w + 0.3 * (g - 1e-3 * w) / math.sqrt(squares[name])

    def best(self, text: str, a: int, b: int, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """The best segmentation of an island by segments that overlap none of `taken`."""
        places, segments = candidates(text, a, b)
        covered = [0] * (len(places) + 1)  # tokens of taken spans up to each place
        for _, s, e in taken:
            covered[max(bisect_right(places, s) - 1, 0)] += 1
            covered[min(bisect_left(places, e), len(places) - 1)] -= 1
        covered = [0, *accumulate(min(1, c) for c in accumulate(covered))]
        free = [s for s in segments if covered[s[1]] == covered[s[2]]]
        if not free:
            return []
        ending: dict[int, list] = {}
        for kind, i, j in free:
            ending.setdefault(j, []).append((i, kind, self.score(features(text, kind, places[i], places[j]))))
        value, back = [0.0] * len(places), [None] * len(places)
        for t in range(1, len(places)):
            value[t] = value[t - 1]
            for i, kind, s in ending.get(t, ()):
                if value[i] + s > value[t]:
                    value[t], back[t] = value[i] + s, (i, kind)
        out, t = [], len(places) - 1
        while t > 0:
            if back[t]:
                i, kind = back[t]
                out.append((kind, places[i], places[t]))
                t = i
            else:
                t -= 1
        return out

    def added_spans(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        out, near = [], sorted(base, key=lambda s: s[1])
        starts = [s for _, s, _ in near]
        reach = max((e - s for _, s, e in near), default=0)
        for a, b in islands(text):
            taken = near[bisect_left(starts, a - reach) : bisect_left(starts, b)]
            out += self.best(text, a, b, taken)
        return out


def example(text: str, a: int, b: int, gold: set[tuple[int, int, int]]):
    """A training example of an island with its true (kind, start, end); None if one of them is no candidate."""
    places, segments = candidates(text, a, b)
    at = {(k, places[i], places[j]): n for n, (k, i, j) in enumerate(segments)}
    wanted = {g for g in gold if a <= g[1] and g[2] <= b}
    if not segments or any(g not in at for g in wanted):
        return None
    return len(places) - 1, [(i, j, features(text, k, places[i], places[j])) for k, i, j in segments], {at[g] for g in wanted}


def made_up(seed: int = 7, rounds: int = 60) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Texts with true spans: entities alone, side by side, without a country code, spelled out, and spoilt ones."""
    r = random.Random(seed)
    number = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card(good: bool) -> str:
        while True:
            d = r.choice("3456") + number(r.choice([12, 14, 15, 15, 15, 18]))
            if luhn(d) == good:
                break
        sep, each = r.choice([("", 4), ("", 4), (" ", 4), ("-", 4), (" ", 1)])
        return sep.join(d[i : i + each] for i in range(0, len(d), each))

    def phone(plus: bool) -> str:
        a, b, c = number(3), number(3), number(4)
        return (f"+{r.choice([number(1), number(2)])} " if plus else "") + r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"({a}) {b} {c}"] + [f"{a} {b} {c}", f"{a}{b}{c}"] * plus)

    def good() -> tuple[int, str]:
        kind = r.choice([1, 2, 3, 3])
        return kind, card(True) if kind == 2 else phone(r.random() < 0.5) if kind == 3 else ".".join(str(r.randrange(256)) for _ in range(4))

    def bad() -> str:
        return r.choice(
            [
                card(False), number(7), number(8), number(10), number(12), number(30), f"{number(4)}-{number(2)}-{number(2)}", f"{number(3)}.{number(4)}.{number(2)}.{number(1)}",
                f"{number(2)}:{number(2)}", f"{number(1)}.{number(2)}.{number(1)}", f"{number(3)} {number(3)} {number(3)}", f"{number(4)}-{number(4)}", f"{number(2)}.{number(2)}.{number(4)}",
                f"{number(1)},{number(3)},{number(3)}", " ".join(number(r.randrange(1, 5)) for _ in range(6)),
            ]
        )

    out = []
    for _ in range(rounds):
        for parts in ([good()], [good(), good()], [(-1, bad())], [(-1, bad())], [good(), (-1, "x")], [(0, f"user{number(2)} [at] mail{number(1)} [dot] {r.choice(['com', 'org', 'net'])}")]):
            text, spans = r.choice(["to ", "", "no. ", "id="]), []
            for kind, s in parts:
                if spans or text and text[-1] not in " =":
                    text += r.choice([" ", ", "])
                if kind >= 0:
                    spans.append((kind, len(text), len(text) + len(s)))
                text += s
            out.append((text + r.choice(["", " and", ".", ", so"]), spans))
    return out


def island_batches(batches):
    """Islands of documents where no base match failed, with 20 characters around and the base spans inside."""
    for batch in slices(batches, "text"):
        rows = []
        for draw, text in zip(batch.column("draw").to_pylist(), batch.column("text").to_pylist(), strict=True):
            base, dropped = base_spans(text)
            for a, b in islands(text):
                if any(s < b and a < e for s, e in dropped):
                    continue
                start = max(0, a - 20)
                rows.append((draw, a, text[start : b + 20], a - start, b - start, [x for k, s, e in base if a <= s and e <= b for x in (k, s - start, e - start)]))
        names = ("draw", "place", "text", "a", "b", "gold")
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], list(names))


def trained(docs: DataFrame) -> Field:
    """A field learned from made-up islands and from at most ISLANDS islands (of at most ISLAND_CHARS characters) of some
    TRAIN_DOCS documents, a sample by hash of the id."""
    n = docs.count()
    draw = F.crc32(F.concat(F.lit("pii"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    sample = docs.select(draw.alias("draw"), "text").where(F.col("text").isNotNull() & (F.col("draw") < TRAIN_DOCS / max(n, 1) * (1 << 32)))
    found = over_texts(sample, island_batches, "draw long, place int, text string, a int, b int, gold array<int>")
    rows = found.where(F.col("b") - F.col("a") <= ISLAND_CHARS).orderBy("draw", "place", "text").limit(ISLANDS).collect()
    examples = []
    for text, spans in made_up():
        examples += [example(text, a, b, set(spans)) for a, b in islands(text)]
    for r in rows:
        examples.append(example(r.text, r.a, r.b, {tuple(r.gold[i : i + 3]) for i in range(0, len(r.gold), 3)}))
    field = Field()
    field.learn([e for e in examples if e])
    return field


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def report_batches(batches, field: Field):
    for batch in slices(batches, "text"):
        counts, digests, everything = [[] for _ in KINDS], [], []
        for text in batch.column("text").to_pylist():
            base, _ = base_spans(text or "")
            for k in range(len(KINDS)):
                counts[k].append(sum(s[0] == k for s in base))
            digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            everything.append(joined(base + field.added_spans(text, base)) if text else "")
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(everything, pa.string())],
            ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"],
        )


def pii_report(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans (base and added) of every row.

    Null and empty texts have no spans; very long texts are read whole. Spans of different kinds may overlap where the
    base patterns do. Repeated rows each appear, an empty table gives an empty result, and extra columns are ignored.
    """
    field = field or trained(docs)
    sent = docs.sparkSession.sparkContext.broadcast(field)  # a few hundred weights
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return over_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), lambda it: report_batches(it, sent.value), schema)
