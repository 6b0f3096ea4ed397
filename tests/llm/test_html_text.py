import random
import subprocess
import sys
from html.parser import HTMLParser
from statistics import pstdev

import pyarrow.parquet as pq

from gatework.llm import html_text
from gatework.llm.html_text import BLOCKS, extract, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var x = "<p>no</p>";</script></head><body class="home">
<header><a href="/">Home</a></header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
<article><h1>A&nbsp;title &amp; more</h1><p><b>First  para,
with a break<br>and more.<p>Second &#233; &eacute; para.</p><aside>See also</aside><form><label>Mail</label><input></form><ul><li>one</li><li>two</li></ul>
<section class="comments"><h2>Comments</h2><p>Nice, really nice. Thanks!</p></section></article>
<div class="sidebar">Side</div><footer>&copy; us</footer></body></html>"""


def test_main_text():
    assert main_text(PAGE) == "A title & more\nFirst para, with a break and more.\nSecond é é para.\none\ntwo"


def test_pages_without_an_article():
    body = "".join(f"<p>This is paragraph {i}, with many words, and some marks; it goes on.</p>" for i in range(5))
    page = f'<body><div class="menu"><a>x</a></div><div id="main-text"><h2>Head</h2>{body}<p>Short.</p></div><div class="sidebar"><p>Ads, ads, ads.</p></div></body>'
    got = main_text(page).split("\n")
    assert got[0] == "Head" and got[-1] == "Short." and len(got) == 7


def test_broken_pages(spark):
    assert main_text("") == "" and main_text("just < text") == "just < text" and main_text("<p>a<!-- x") == "a" and main_text("<script>x") == "" and main_text("<p>a<script>b") == "a"
    main_text("<a href='" * 50_000)  # in linear time
    main_text("<!--" * 50_000 + "<div>" * 2000)
    rows = [(1, "u", PAGE, 1), (1, "u", PAGE, 1), (2, None, None, 2), (None, "v", "", 3)]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert len(got) == 4 and all(g.n_chars == len(g.text) for g in got)
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_lowered_text_only_gives_nothing():
    assert main_text('<body><nav><a>Home</a></nav><div class="cookie-notice">We use cookies, all of them.</div><footer>c</footer></body>') == ""


def test_a_title_that_is_a_link_stays_and_unnamed_links_go():
    body = "".join(f"<p>This is paragraph {i}, with many words, and some marks; it goes on.</p>" for i in range(5))
    links = "".join(f'<li><a href="/{i}">Another page {i}</a></li>' for i in range(6))
    page = f'<body><article><h1><a href="/">The title</a></h1><ul>{links}</ul>{body}<ul><li>one</li><li><a>two</a> and more</li></ul></article></body>'
    got = main_text(page.replace("<ul><li>one", '<ul class="x"><li>one')).split("\n")
    assert got[0] == "The title" and len(got) == 8 and got[-1] == "two and more"


def test_ratios_decide(monkeypatch):
    pages = pq.read_table("/root/testdata/sf0.001/pages.parquet").column("html").to_pylist()
    found = [main_text(p) for p in pages]
    monkeypatch.setattr(html_text, "path_scores", lambda nodes: {path: 1.0 for path, _ in nodes})
    assert sum(main_text(p) != t for p, t in zip(pages, found, strict=True)) > 0.9 * len(pages)


def test_deep_pages_take_little_memory():
    code = (
        "import resource; from gatework.llm.html_text import main_text; before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss;"
        "assert main_text('<div>' * 100_000 + 'text, one. ' * 5) and main_text('<i>' * 50_000 + '<div>x</div>' * 50_000) and main_text('<div>' * 50_000 + '<p>x</b></section>' * 50_000);"
        "print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)"
    )
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and float(out.stdout) < 200, out.stderr


class Plain(HTMLParser):
    """A tree of well-formed pages: [name, class, path, children and texts]."""

    def __init__(self):
        super().__init__()
        self.root = self.at = {"name": "html", "class": "", "path": "html", "up": None, "kids": []}

    def handle_starttag(self, name, attrs):
        c = dict(attrs).get("class", "")
        e = {"name": name, "class": c, "path": f"{self.at['path']}/{name}.{c}", "up": self.at, "kids": []}
        self.at["kids"].append(e)
        self.at = e

    def handle_endtag(self, name):
        self.at = self.at["up"]

    def handle_data(self, data):
        self.at["kids"].append(data)


def chain(e):
    return ([e] + chain(e["up"])) if e else []


def texts(e):
    return [x for k in e["kids"] for x in ([(e, k)] * (not k.isspace()) if isinstance(k, str) else texts(k))]


def plain_text(page):
    """The rules of the module's docstring, by strings and walks over the whole tree."""
    parser = Plain()
    parser.feed(page)
    nodes = texts(parser.root)
    if not nodes:
        return ""

    def holds(e):
        inner = [k for k in e["kids"] if not isinstance(k, str)]
        return any(k["name"] in ("h1", "article") and not any(x["name"] in ("nav", "aside") for x in chain(k)) or holds(k) for k in inner)

    def count(e):
        return sum(x["name"] in ("nav", "aside") or x["class"] in ("ad", "comments") and not holds(x) for x in chain(e))

    def home(e):
        return next((x for x in chain(e) if x["name"] in BLOCKS), parser.root)

    by_home = {}
    for e, t in nodes:
        by_home.setdefault(home(e)["path"], []).append((len(t), any(x["name"] == "a" for x in chain(e))))
    links = {p: sum(n for n, a in v if a) >= 0.95 * sum(n for n, _ in v) for p, v in by_home.items()}
    is_links = lambda e: home(e)["name"] not in ("h1", "h2") and links[home(e)["path"]]
    groups = {}
    for e, t in nodes:
        groups.setdefault(e["path"], []).append((len(t), sum(t.count(c) for c in ".,")))
    mean = {p: [sum(x) / len(v) for x in zip(*v, strict=True)] for p, v in groups.items()}
    flow = [mean[e["path"]] for e, _ in nodes]
    flow = [flow[0], *flow, flow[-1]]
    fused = {}
    for i, (e, _) in enumerate(nodes):
        length, marks = (0.25 * flow[i][k] + 0.5 * flow[i + 1][k] + 0.25 * flow[i + 2][k] for k in (0, 1))
        fused.setdefault(e["path"], []).append(length * (1 + marks))
    score = {p: sum(v) / len(v) for p, v in fused.items()}

    def content(outside):
        final = {id(e): score[e["path"]] * 0.01 ** (count(e) + outside(e) + is_links(e)) for e, _ in nodes}
        limit = 0.25 * min(pstdev({score[e["path"]] for e, _ in nodes}), pstdev(set(final.values())))
        return {k for k, s in final.items() if s >= limit}

    def mass(top, found):
        return sum(score[e["path"]] for e, _ in texts(top) if id(e) in found)

    def elements(e):
        return [e] + [x for k in e["kids"] if not isinstance(k, str) for x in elements(k)]

    outside = lambda e: False
    found = content(outside)
    if all(count(e) for e, _ in nodes if id(e) in found):
        return ""
    articles = [e for e in elements(parser.root) if e["name"] == "article" and mass(e, found) > 0.5 * mass(parser.root, found)]
    best = None
    for e in articles:
        if best is None or mass(e, found) >= mass(best, found) or best in chain(e) and mass(e, found) >= 0.9 * mass(best, found):
            best = e
    if best:
        outside = lambda e: not any(x is best for x in chain(e))
        found = content(outside)
    low = lambda e: count(e) + outside(e)
    boxes = ("html", "body", "div", "article")
    at = parser.root
    while True:
        heads = [e for e, _ in texts(at) if not low(e) and any(x["name"] == "h2" for x in chain(e)) and next(x for x in chain(e) if x["name"] in boxes) is at]
        kids = [k for k in at["kids"] if not isinstance(k, str) and k["name"] in boxes and mass(k, found) >= 0.9 * mass(parser.root, found)]
        if heads or not kids:
            break
        at = kids[0]
    out, kept = [], [id(e) for e, _ in texts(at) if id(e) in found or low(e) <= low(at) and not is_links(e)]

    def walk(e):
        """Texts between the borders of blocks."""
        if e["name"] in BLOCKS:
            out.append("")
        for k in e["kids"]:
            if isinstance(k, str):
                if id(e) in kept or k.isspace():
                    out[-1] += k
            else:
                walk(k)
        if e["name"] in BLOCKS:
            out.append("")

    walk(at)
    return "\n".join(" ".join(t.split()) for t in out if t.strip())


def test_against_a_plain_version():
    r = random.Random(3)
    sentence = lambda: " ".join(r.choice(["one", "word", "other,", "longer", "text.", "and"]) for _ in range(r.choice([1, 2, 5, 30])))

    def element(depth):
        name = r.choice(["div", "div", "p", "p", "h2", "ul", "nav", "aside", "article"] if depth < 3 else ["p", "p", "h2"])
        c = r.choice(["", "", "", ' class="ad"', ' class="comments"', ' class="x"']) if name not in ("article", "h2") else ""
        if name in ("p", "h2"):
            parts = [sentence(), f" <a>{sentence()}</a> ", f"<b>{sentence()}</b>"]
            inner = "".join(r.sample(parts, r.randrange(1, 4)))
        elif name == "ul":
            inner = "".join(f"<li>{r.choice([sentence(), f'<a>{sentence()}</a>'])}</li>" for _ in range(r.randrange(1, 5)))
        else:
            inner = "".join(element(depth + 1) for _ in range(r.randrange(1, 5)))
        return f"<{name}{c}>{inner}</{name}>"

    for _ in range(400):
        page = "<body>" + "".join(element(0) for _ in range(r.randrange(1, 6))) + "</body>"
        assert main_text(page) == plain_text(page), page
