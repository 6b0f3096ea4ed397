"""Main text of web pages by tag-path ratios.

Every text node has a root-to-leaf tag path (names with first class or id). Per path, text length and punctuation are
averaged over its nodes; both ratios are smoothed along the page and fused into one score. Paths of links, and paths
through elements or names of boilerplate (menus, headers, footers, sidebars, notices, adverts, forms, comments), have
their score lowered. Paths whose score reaches a threshold, a share of the spread of all scores, are content.

The content nodes choose the article's element: the deepest container with nearly all of their scores, going below no
heading. Where an article or main element has most of the content, what is outside is lowered too. In the article's
element content stays, and so does a short block (a heading, an item, a cell) whose path nothing lowered. Elements and
names only lower scores; they never raise one.
"""

from __future__ import annotations

import html
import re
from statistics import pstdev

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatework.llm.common import over_texts, slices

#: Share of the spread of scores that a path must reach; shares of the content that make an element the article's.
THRESHOLD, MOST, NEARLY_ALL = 0.25, 0.5, 0.9
#: What a boilerplate element or name leaves of a score, and the share of link text from which a path counts as links.
LOWERED, LINKS = 0.01, 0.95
#: Smoothing weights along the page.
KERNEL = (0.25, 0.5, 0.25)
#: Elements by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object canvas noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li "
    "main menu nav ol optgroup option p pre section select summary table tbody tfoot thead tr ul".split()
)
BOILERPLATE = frozenset("nav footer aside form button select menu dialog head input label fieldset datalist".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("html body div section article main table tbody tr td center form".split())
#: An open element of the first kind ends where one of the second begins.
ENDS = {
    "p": BLOCKS - frozenset(("html", "head", "body", "option", "optgroup", "tr", "tbody", "thead", "tfoot", "caption")),
    "li": frozenset(("li",)),
    "dt": frozenset(("dt", "dd")),
    "dd": frozenset(("dt", "dd")),
    "tr": frozenset(("tr", "tbody", "thead", "tfoot")),
    "td": frozenset(("td", "th", "tr", "tbody", "tfoot")),
    "th": frozenset(("td", "th", "tr", "tbody", "tfoot")),
    "option": frozenset(("option", "optgroup")),
    "head": frozenset(("body",)),
}
SCOPES = frozenset("ul ol dl table td article section div main body html".split())
#: Words in a class, id or role that name boilerplate.
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|adsense|banner|sponsor(?:ed|s)?|promos?|promotions?|comments?|commentlist|disqus|repl(?:y|ies)|responses?|sidebars?|widgets?|"
    r"nav|navbar|navigation|menus?|breadcrumbs?|footer|footers?|site-?header|masthead|topbar|header|headers?|cookies?|consent|gdpr|notices?|notifications?|alerts?|popups?|modals?|overlays?|newsletters?|subscribe|"
    r"subscription|signup|sign-up|login|shar(?:e|ing)|socials?|related|recommend(?:ed|ations?)|pagination|pager|toolbar|tags?|metadata|byline-share|search|skip-?link|copyright|legal|disclaimer|complementary|contentinfo)(?:$|[\s_-])",
    re.IGNORECASE,
)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>")
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？；：]")
#: Whole words that make an article element boilerplate.
NOT_ARTICLES = frozenset("comment comments reply response ad ads advert advertisement sponsored promo related".split())
#: Names of headers, which an article may have of its own.
HEADERS = re.compile(r"(?:^|[\s_-])(?:header|headers)(?:$|[\s_-])", re.IGNORECASE)
#: Elements that stop the search for one that ends where another begins, and those that may end at each name.
BARRIERS = SCOPES - frozenset(ENDS)
ENDED_BY = {name: [x for x, at in ENDS.items() if name in at] for name in frozenset().union(*ENDS.values())}


class Tree:
    """Elements by number, in the order they begin, so parents come before their children and an element's descendants
    lie together. Paths are numbers too: one for each distinct (path of the parent, label)."""

    def __init__(self):
        self.names, self.parents, self.paths = ["html"], [-1], [0]
        self.by_tag, self.by_name, self.holds, self.link = [False], [False], [False], [False]
        self.in_tag = [False]  # in or of an element that is boilerplate by tag
        self.known: dict[tuple[int, str], int] = {}

    def add(self, name: str, parent: int, label: str, by_tag: bool, by_name: bool) -> int:
        e = len(self.names)
        self.names.append(name)
        self.parents.append(parent)
        self.paths.append(self.known.setdefault((self.paths[parent], label), len(self.known) + 1))
        self.by_tag.append(by_tag)
        self.by_name.append(by_name)
        self.holds.append(False)
        self.link.append(name == "a" or self.link[parent])
        self.in_tag.append(by_tag and name != "form" or self.in_tag[parent])
        return e

    def hold(self, e: int) -> None:
        """An article is likely in e and in what e is in."""
        while e >= 0 and not self.holds[e]:
            self.holds[e] = True
            e = self.parents[e]

    def lowered(self) -> list[int]:
        """How many elements of boilerplate each element is in or is. A name, or a form, that an article is in says
        nothing."""
        out = [0] * len(self.names)
        for e in range(1, len(out)):
            holds = self.holds[e]
            out[e] = out[self.parents[e]] + (self.by_tag[e] and not (holds and self.names[e] == "form") or self.by_name[e] and not holds)
        return out

    def ends(self) -> list[int]:
        """The number after each element's last descendant."""
        out = list(range(1, len(self.names) + 1))
        for e in range(len(out) - 1, 0, -1):
            out[self.parents[e]] = max(out[self.parents[e]], out[e])
        return out


class Open:
    """The stack of open elements. Where the last one of a name lies is known, so no tag makes it walk the stack."""

    def __init__(self, tree: Tree):
        self.tree, self.stack, self.places, self.articles = tree, [0], {"html": [0]}, 0

    def push(self, e: int) -> None:
        name = self.tree.names[e]
        self.places.setdefault(name, []).append(len(self.stack))
        self.stack.append(e)
        self.articles += name in ("article", "main")

    def cut(self, k: int) -> None:
        while len(self.stack) > k:
            name = self.tree.names[self.stack.pop()]
            self.places[name].pop()
            self.articles -= name in ("article", "main")

    def last(self, names) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def close(self, name: str) -> None:
        k = self.last((name,))
        if k > 0 and (name in BLOCKS or self.last(SCOPES) <= k):  # an inline end tag stays within its container
            self.cut(k)

    def begin(self, name: str) -> None:
        """Ends what ends where an element of this name begins."""
        k = self.last(ENDED_BY.get(name, ()))
        if k > 0 and self.last(BARRIERS) < k:
            self.cut(k)


def attributes(name: str, text: str, in_article: bool) -> tuple[str, bool]:
    """The label of an element in paths, and whether it is boilerplate by name."""
    if not text:
        return name, False
    label, bad = name, False
    for key, a, b, c in ATTRIBUTE.findall(text):
        value, key = a or b or c, key.lower()
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and "display:none" in value.lower().replace(" ", ""):
            bad = True
        elif key in ("class", "id", "role") and value:
            label = f"{label}.{value.split()[0] if value.split() else ''}"
            if name in ("article", "main"):
                bad = bad or not NOT_ARTICLES.isdisjoint(value.lower().split())
            else:
                bad = bad or bool(NAMES.search(HEADERS.sub(" ", value) if in_article else value)) and not (in_article and name in HEADINGS)
    return label, bad and name not in ("html", "body")


def text_nodes(page: str) -> tuple[Tree, list[tuple[int, int, str]]]:
    """The elements, and (element, block number, text) of every text node, in page order."""
    tree = Tree()
    opened, out, block, pos, n = Open(tree), [], 0, 0, len(page)
    stack = opened.stack
    while pos < n:
        at = page.find("<", pos)
        text = page[pos:] if at < 0 else page[pos:at]
        if text:
            out.append((stack[-1], block, text))
        if at < 0:
            break
        follow = page[at + 1 : at + 2]
        if follow in ("!", "?"):
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                pos = n if end < 0 else end + 3
            else:
                end = page.find(">", at)
                pos = n if end < 0 else end + 1
            continue
        m = TAG.match(page, at)
        if not m:
            if follow.isalpha() or follow == "/":  # a tag that is cut off or has an open quote
                end = page.find(">", at)
                pos = n if end < 0 else end + 1
            else:
                out.append((stack[-1], block, "<"))
                pos = at + 1
            continue
        pos, closing, name = m.end(), m[1], m[2].lower()
        if closing:
            if name in BLOCKS or name == "br":
                block += 1
            opened.close(name)
            continue
        if name == "html":
            continue
        if name in BLOCKS or name in ("td", "th"):
            opened.begin(name)
        if name in BLOCKS:
            block += 1
        elif name in ("br", "td", "th", "img"):
            out.append((stack[-1], block, " "))
        if name in VOID or m[3].endswith("/") and name in RAW:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, pos)
            pos = n if not end else end.end()
            continue
        parent, in_article = stack[-1], opened.articles > 0
        label, bad = attributes(name, m[3], in_article)
        e = tree.add(name, parent, label, name in BOILERPLATE or name == "header" and not in_article, bad)
        if name in ("h1", "article", "main") and not bad and not tree.in_tag[parent]:
            tree.hold(parent)
        opened.push(e)
    return tree, out


def path_scores(nodes: list[tuple[int, str]]) -> dict[int, float]:
    """The fused score of every path from (path, text) of the nodes in page order: smoothed mean text length times
    smoothed mean punctuation (plus one)."""
    sums: dict[int, list[float]] = {}
    for path, text in nodes:
        s = sums.setdefault(path, [0, 0, 0])
        s[0] += 1
        s[1] += len(text)
        s[2] += len(PUNCTUATION.findall(text))
    ratios = [(s[1] / s[0], s[2] / s[0]) for s in (sums[path] for path, _ in nodes)]
    padded = [ratios[0], *ratios, ratios[-1]]
    smooth = [tuple(sum(w * padded[i + k][part] for k, w in enumerate(KERNEL)) for part in (0, 1)) for i in range(len(ratios))]
    fused: dict[int, list[float]] = {}
    for (path, _), (length, marks) in zip(nodes, smooth, strict=True):
        fused.setdefault(path, []).append(length * (1 + marks))
    return {p: sum(v) / len(v) for p, v in fused.items()}


def main_text(page: str) -> str:
    """The article's blocks joined by line breaks; empty if the page has none."""
    tree, nodes = text_nodes(page)
    nodes = [(e, b, html.unescape(t) if "&" in t else t) for e, b, t in nodes]
    full = [(e, t) for e, _, t in nodes if not t.isspace()]
    if not full:
        return ""
    low, links, ends = tree.lowered(), link_paths(tree, full), tree.ends()
    by_path = path_scores([(tree.paths[e], t) for e, t in full])
    scores = [by_path.get(p, 0.0) for p in tree.paths]
    content = chosen(full, scores, low, links)
    if all(low[e] for e in content):
        return ""
    best = focus(tree, mass(tree, full, scores, content), ends)
    if best:  # what is outside is lowered once more
        low = [n + (not best <= e < ends[best]) for e, n in enumerate(low)]
        content = chosen(full, scores, low, links)
    best = article(tree, full, mass(tree, full, scores, content), low)
    blocks: dict[int, list[str]] = {}
    for e, b, t in nodes:
        if best <= e < ends[best] and (e in content or t.isspace() or low[e] <= low[best] and not links[e]):
            blocks.setdefault(b, []).append(t)
    joined = (" ".join("".join(parts).split()) for _, parts in sorted(blocks.items()))
    return "\n".join(t for t in joined if t)


def chosen(full: list[tuple[int, str]], scores: list[float], low: list[int], links: list[bool]) -> set[int]:
    """The elements whose text is content: their lowered score reaches the limit. The limit is a share of the spread of
    scores by path, with or without lowering, whichever is less: lowering alone makes no spread."""
    plain = {e: scores[e] for e, _ in full}
    final = {e: s * LOWERED ** (low[e] + links[e]) for e, s in plain.items()}
    limit = THRESHOLD * min(pstdev(set(x.values())) for x in (plain, final))
    return {e for e, s in final.items() if s >= limit}


def link_paths(tree: Tree, full: list[tuple[int, str]]) -> list[bool]:
    """Whether the path of each element's block is one of links: nearly all of its text on the page is link text. A
    heading may be a link."""
    home = [0] * len(tree.names)
    for e in range(1, len(home)):
        home[e] = e if tree.names[e] in BLOCKS or tree.names[e] in ("td", "th") else home[tree.parents[e]]
    sizes: dict[int, list[int]] = {}
    for e, t in full:
        s = sizes.setdefault(tree.paths[home[e]], [0, 0])
        s[tree.link[e]] += len(t)
    shares = {p: s[1] / sum(s) for p, s in sizes.items()}
    return [tree.names[h] not in HEADINGS and shares.get(tree.paths[h], 0) >= LINKS for h in home]


def mass(tree: Tree, full: list[tuple[int, str]], scores: list[float], content: set[int]) -> list[float]:
    """The scores of the content nodes in each element, summed."""
    out = [0.0] * len(tree.names)
    for e, _ in full:
        if e in content:
            out[e] += scores[e]
    for e in range(len(out) - 1, 0, -1):
        out[tree.parents[e]] += out[e]
    return out


def focus(tree: Tree, masses: list[float], ends: list[int]) -> int:
    """The article or main element with over MOST of the content, the innermost of equal ones; an article that has
    nearly all of a main element's. 0 if there is none."""
    best = 0
    for e in range(1, len(masses)):
        if tree.names[e] in ("article", "main") and masses[e] > MOST * masses[0] and (not best or masses[e] >= masses[best] or e < ends[best] and masses[e] >= NEARLY_ALL * masses[best]):
            best = e
    return best


def article(tree: Tree, full: list[tuple[int, str]], masses: list[float], low: list[int]) -> int:
    """The deepest container with NEARLY_ALL of the content, going below no heading."""
    holder = [0] * len(masses)  # the nearest heading or container that an element is in or is
    for e in range(1, len(holder)):
        holder[e] = e if tree.names[e] in HEADINGS or container(tree.names[e]) else holder[tree.parents[e]]
    stops = [False] * len(masses)
    for e, _ in full:
        if tree.names[holder[e]] in HEADINGS and not low[e]:
            stops[holder[tree.parents[holder[e]]]] = True
    at = 0
    for e in range(1, len(masses)):  # children come after their parents
        if tree.parents[e] == at and not stops[at] and container(tree.names[e]) and masses[e] >= NEARLY_ALL * masses[0]:
            at = e
    return at


def container(name: str) -> bool:
    return name in CONTAINERS or "-" in name


def page_batches(batches):
    for batch in slices(batches, "html"):
        texts = [main_text(h or "") for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row.

    Null, empty and text-free pages, and pages of boilerplate only, give an empty text. Broken markup is read as browsers
    do: an unclosed script or comment takes the rest of the page, unclosed paragraphs end where the next block begins.
    Very long and deeply nested pages are read whole, in time and memory in proportion to their length. Repeated rows
    each appear, an empty table gives an empty result, and extra columns are ignored.
    """
    return over_texts(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html"), page_batches, "page_id long, url string, text string, n_chars long")
