"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element and every run of text is a binary variable (main content or not). Parent-child potentials connect them, unary
potentials come from an element's tag, the hints in its class, id and role, its share of linked text and its length; all are
estimated from labelled pages. Sum-product messages pass from the leaves up and from the root down, which gives each
node's exact marginal. Text whose block is content with probability one half or more is kept.
"""

from __future__ import annotations

import functools
import html
import random
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.DOTALL)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
SPACE = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup and no text of the page.
RAW = frozenset("script style textarea title iframe noembed select".split())
#: Elements whose own markup is not the page's: their text stays in the block around them.
FOREIGN = frozenset(("math", "svg"))
INLINE = frozenset("math noscript svg template a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Open elements that an opening tag ends, and the elements beyond which it ends none.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "body": ({"head"}, set())}
#: Elements that their parent implies: their own tag says nothing.
PARTS = frozenset("li dt dd tr td th tbody thead tfoot caption".split())
SCOPES = frozenset("article section div main body table td li aside nav header footer form blockquote".split())


@dataclass
class Node:
    tag: str
    parent: int
    attributes: str = ""
    text: str = ""  # of a run of text, which has tag "#"
    block: int = -1  # of a run of text
    children: list[int] = field(default_factory=list)


class _Open:
    """The open elements, with the places of each tag, so that looking for one never walks the stack."""

    def __init__(self):
        self.nodes, self.tags = [0], ["#root"]
        self.where: dict[str, list[int]] = defaultdict(list)
        self.blocks, self.scopes = [0], [0]  # places of elements that are not inline, and of those that end the search for a paragraph

    def push(self, node: int, tag: str) -> None:
        place = len(self.nodes)
        self.nodes.append(node)
        self.tags.append(tag)
        self.where[tag].append(place)
        if tag not in INLINE:
            self.blocks.append(place)
        if tag in SCOPES:
            self.scopes.append(place)

    def cut(self, place: int) -> None:
        """Close the element at ``place`` and all within it."""
        while len(self.nodes) > place:
            self.nodes.pop()
            tag = self.tags.pop()
            self.where[tag].pop()
            for places in (self.blocks, self.scopes):
                if places[-1] >= len(self.nodes):
                    places.pop()

    def last(self, tag: str) -> int:
        return self.where[tag][-1] if self.where[tag] else 0

    def first_after(self, tag: str, place: int) -> int:
        places = self.where[tag]
        k = bisect_right(places, place)
        return places[k] if k < len(places) else 0


def parse(page: str) -> list[Node]:
    """The page's elements and runs of text in page order; node 0 is the root. Never fails: what is no markup is text.

    The work grows with the page alone, however deep or ill-nested its elements are.
    """
    nodes = [Node("#root", -1)]
    stack, block, foreign = _Open(), 0, ""

    def add(node: Node) -> int:
        nodes.append(node)
        nodes[node.parent].children.append(len(nodes) - 1)
        return len(nodes) - 1

    def text(run: str) -> None:
        if run and (run.strip() or len(nodes) > 1 and nodes[-1].tag == "#" and nodes[-1].block == block):
            add(Node("#", stack.nodes[-1], text=html.unescape(run), block=block))
        elif run:
            add(Node("#", stack.nodes[-1], text=" ", block=block))

    at = 0
    while (m := MARKUP.search(page, at)) is not None:
        text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        closing = m[1] or m[4]
        if foreign and not (closing and tag == foreign):
            if tag in RAW and tag != "title" and not closing:
                at = _end_of(tag, page, at)
                continue
            if tag not in CLOSES_P:  # such tags lead out of drawings and formulas
                continue
        if closing:
            place = stack.last(tag)
            if tag in INLINE and stack.blocks[-1] > place:
                place = 0
            if tag not in INLINE:
                block += 1
            if place:
                stack.cut(place)
            foreign = foreign if foreign and stack.last(foreign) else ""
            continue
        if tag in CLOSES_P:
            foreign = ""
            if stack.last("p") > stack.scopes[-1]:
                stack.cut(stack.last("p"))
        if tag in ENDS:
            ended, beyond = ENDS[tag]
            border = max((stack.last(t) for t in beyond), default=0)
            cut = min((k for k in (stack.first_after(t, border) for t in ended) if k), default=0)
            if cut:
                stack.cut(cut)
        attributes = m[3] or m[6] or ""
        if tag not in INLINE:
            block += 1
        elif tag == "br":
            text(" ")
            continue
        node = add(Node(tag, stack.nodes[-1], attributes))
        if tag in RAW:
            at = _end_of(tag, page, at)
        elif tag not in VOID and not attributes.rstrip().endswith("/"):
            stack.push(node, tag)
            foreign = tag if tag in FOREIGN else foreign
    text(page[at:])
    return nodes


def _end_of(tag: str, page: str, at: int) -> int:
    end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, at)
    return end.end() if end else len(page)


#: Parts of class, id and role values that hint at a part of a page, by part.
HINTS = {
    "chrome": ("nav", "menu", "breadcrumb", "header", "footer", "masthead", "topbar", "toolbar", "pagination", "pager", "skip", "logo", "copyright", "legal", "contentinfo", "banner"),
    "side": ("sidebar", "aside", "side", "widget", "related", "recommend", "popular", "trending", "complementary", "rail", "teaser", "tags", "toc"),
    "advert": ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "adsense", "adbox", "outbrain"),
    "notice": ("cookie", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "paywall", "newsletter", "subscribe", "signup", "subscription", "login"),
    "talk": ("comment", "comments", "reply", "replies", "discussion", "disqus", "respond", "review", "reviews"),
    "share": ("share", "sharing", "social", "follow", "byline", "meta", "author", "date", "rating"),
    "form": ("form", "search", "contact", "input"),
    "main": ("article", "content", "main", "post", "entry", "story", "body", "text", "page", "blog", "document"),
}
_HINT_OF = {w: k for k, words in HINTS.items() for w in words}
#: Of several hints the first of these counts.
_FIRST = ("talk", "advert", "notice", "side", "share", "form", "chrome", "main")
WORDS_IN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def hint(attributes: str) -> str:
    """What class, id and role say of an element's part of the page."""
    if not attributes:
        return "none"
    found = set()
    for name, *values in ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id", "role", "itemprop", "aria-label"):
            for w in WORDS_IN.findall("".join(values)):
                w = w.lower()
                got = _HINT_OF.get(w) or _HINT_OF.get(w.removesuffix("s"))
                if got:
                    found.add(got)
    return next((k for k in _FIRST if k in found), "other")


def _grade(x: float, *bounds: float) -> int:
    return sum(x >= b for b in bounds)


def observed(nodes: list[Node]) -> list[tuple]:
    """The discrete observations of each node."""
    n = len(nodes)
    length, linked, in_link = [0] * n, [0] * n, [False] * n
    for i in range(1, n):
        p = nodes[i].parent
        in_link[i] = in_link[p] or nodes[i].tag == "a"
    for i in range(n - 1, 0, -1):
        if nodes[i].tag == "#":
            length[i] = len(nodes[i].text.strip())
            linked[i] = length[i] if in_link[i] else 0
        p = nodes[i].parent
        length[p] += length[i]
        linked[p] += linked[i]
    out = []
    for i, node in enumerate(nodes):
        share = _grade(linked[i] / length[i], 0.2, 0.6) if length[i] else 3
        if node.tag == "#":
            words = node.text.split()
            out.append(("#", _grade(len(words), 1, 4, 12, 40), bool(words) and words[-1][-1] in ".!?:;…\"”", 0))
        else:
            inline = node.tag in INLINE and node.tag != "a"
            tag = "inline" if inline else f"list{share}" if node.tag in ("ul", "ol") else f"part{share}" if node.tag in PARTS else node.tag
            out.append((tag, hint(node.attributes), 0 if inline or tag[-1] in "0123" else share, _grade(length[i], 1000) if tag in SCOPES else 0))
    return out


class Model:
    """Counts of a directed tree model: root prior, child given parent by child's kind, observations given label and kind."""

    KINDS = frozenset("# inline p div section article aside nav header footer main form h1 h2 h3 h4 table a body head blockquote pre figure".split())

    def __init__(self, pages: list[tuple[list[Node], list[int]]]):
        edge, seen, size = Counter(), Counter(), Counter()
        values: list[set] = [set(), set(), set(), set()]
        for nodes, labels in pages:
            for i, got in enumerate(observed(nodes)):
                kind = self.kind(got[0])
                if i:
                    edge[kind, labels[nodes[i].parent], labels[i]] += 1
                    edge["", labels[nodes[i].parent], labels[i]] += 1
                group = "#" if kind == "#" else "e"
                for k, v in enumerate(got):
                    seen[group, k, labels[i], v] += 1
                    values[k].add(v)
                size[group, labels[i]] += 1
        self.log_edge = {}
        for kind in {k for k, *_ in edge}:
            for y in (0, 1):
                back = [edge["", y, z] + 1.0 for z in (0, 1)]
                n = [edge[kind, y, z] + 2.0 * back[z] / sum(back) for z in (0, 1)]
                for z in (0, 1):
                    self.log_edge[kind, y, z] = log(n[z] / sum(n))
        self.log_seen = {key: log((n + 0.5) / (size[key[0], key[2]] + 0.5 * len(values[key[1]]))) for key, n in seen.items()}
        self.log_new = {(g, k, y): log(0.5 / (size[g, y] + 0.5 * len(values[k]))) for g, y in size for k in range(4)}

    def kind(self, tag: str) -> str:
        return "part" if tag[:4] in ("part", "list") else tag if tag in self.KINDS else "*"

    @functools.lru_cache(maxsize=20_000)  # noqa: B019
    def unary(self, got: tuple) -> tuple[float, float]:
        group = "#" if got[0] == "#" else "e"
        scores = []
        for y in (0, 1):
            both = [(group, k, z, v) in self.log_seen for z in (0, 1) for k, v in enumerate(got)]
            scores.append(sum(self.log_seen.get((group, k, y, v), self.log_new[group, k, y]) for k, v in enumerate(got) if both[k] or both[k + 4]))
        return scores[0], scores[1]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Each node's probability of being content: one pass of messages upward, one downward."""
        got = observed(nodes)
        up = [list(self.unary(g)) for g in got]
        message: list[tuple[float, float]] = [(0.0, 0.0)] * len(nodes)
        edges = [self._edge(g[0]) for g in got]
        for i in range(len(nodes) - 1, 0, -1):
            (e00, e01), (e10, e11) = edges[i]
            a, b = up[i]
            message[i] = (_add(e00 + a, e01 + b), _add(e10 + a, e11 + b))
            p = up[nodes[i].parent]
            p[0] += message[i][0]
            p[1] += message[i][1]
        belief = up  # of the root; others get their parent's message
        out = [0.0] * len(nodes)
        for i in range(len(nodes)):
            if i:
                parent = belief[nodes[i].parent]
                a, b = parent[0] - message[i][0], parent[1] - message[i][1]
                (e00, e01), (e10, e11) = edges[i]
                belief[i] = [belief[i][0] + _add(a + e00, b + e10), belief[i][1] + _add(a + e01, b + e11)]
            else:
                belief[i] = [belief[i][0], belief[i][1] - 20.0]  # the root is no content
            d = belief[i][0] - belief[i][1]
            out[i] = 1 / (1 + exp(d)) if d < 700 else 0.0
            m = max(belief[i])
            belief[i] = [belief[i][0] - m, belief[i][1] - m]
        return out

    @functools.lru_cache(maxsize=1000)  # noqa: B019
    def _edge(self, tag: str):
        kind = self.kind(tag)
        kind = kind if (kind, 0, 0) in self.log_edge else ""
        return tuple((self.log_edge[kind, y, 0], self.log_edge[kind, y, 1]) for y in (0, 1))


def _add(a: float, b: float) -> float:
    m = a if a > b else b
    return m + log(exp(a - m) + exp(b - m))


def main_text(page: str, model: Model) -> str:
    """The content blocks of a page, white space in each made one space, joined by a line feed."""
    nodes = parse(page)
    p = model.marginals(nodes)
    blocks: dict[int, list] = defaultdict(list)
    for i, node in enumerate(nodes):
        if node.tag == "#":
            blocks[node.block].append((node.text, p[i]))
    out = []
    for runs in blocks.values():
        weight = sum(len(t.strip()) for t, _ in runs)
        if weight and sum(len(t.strip()) * q for t, q in runs) >= 0.5 * weight:
            line = SPACE.sub(" ", "".join(t for t, _ in runs)).strip()
            if line:
                out.append(line)
    return "\n".join(out)


# Labelled pages: written from rules with a fixed seed, content marked by an attribute that observations do not read.


def labelled_page(rng: random.Random) -> str:
    """A page of a random layout; elements that hold main text only carry ``data-main``."""
    syllables = ["an", "re", "ti", "on", "the", "in", "st", "or", "le", "de", "ch", "mo", "pa", "lu", "ver", "son"]
    flip = lambda p: rng.random() < p
    one = lambda items: items[rng.randrange(len(items))]
    word = lambda: "".join(one(syllables) for _ in range(rng.randrange(1, 4)))

    def prose(low, high, end=True):
        return " ".join(word() for _ in range(rng.randrange(low, high))).capitalize() + ("." if end else "")

    def links(n):
        return "".join(f'<li><a href="/{word()}">{prose(1, 4, False)}</a></li>' for _ in range(n))

    def attr(*names):
        return f' {one(("class", "class", "id"))}="{one(names)}"' if names and flip(0.85) else ""

    def nav():
        tag = one(("nav", "nav", "div", "ul"))
        inner = links(rng.randrange(2, 9))
        return f"<{tag}{attr('nav', 'menu', 'main-nav', 'navbar', 'breadcrumb')}>{inner if tag == 'ul' else f'<ul>{inner}</ul>'}</{tag}>"

    def header():
        tag = one(("header", "header", "div"))
        return f"<{tag}{attr('header', 'site-header', 'masthead', 'top')}>{one(('', f'<a href=/>{word()}</a>'))}<div>{prose(1, 8, flip(0.3))}</div>{nav() if flip(0.5) else ''}</{tag}>"

    def footer():
        tag = one(("footer", "footer", "div"))
        name = attr("footer", "site-footer", "copyright", "legal") if tag == "footer" else ' class="footer"'
        return f"<{tag}{name}>{one(('&copy; ', '', 'Copyright '))}{prose(2, 14, flip(0.5))}{'<ul>' + links(3) + '</ul>' if flip(0.3) else ''}</{tag}>"

    def side():
        tag = one(("aside", "aside", "div", "section"))
        name = attr("sidebar", "widget", "related", "side") if tag == "aside" else f' class="{one(("sidebar", "widget", "related-posts", "popular", "side-bar"))}"'
        return f"<{tag}{name}><h3>{prose(1, 3, False)}</h3>{one((f'<ul>{links(4)}</ul>', f'<p>{prose(6, 40)}</p>'))}</{tag}>"

    def advert():
        return f'<{(t := one(("div", "div", "aside", "section", "p")))} {one(("class", "id"))}="{one(("ad", "ads", "advert", "ad-banner", "sponsored", "promo", "advertisement"))}">{one((prose(3, 20), f"<p>{prose(3, 30)}</p>", f"<a href=x>{prose(3, 12)}</a>"))}</{t}>'

    def notice():
        return f'<{(t := one(("div", "div", "section", "aside", "p")))} {one(("class", "id", "role"))}="{one(("cookie-notice", "cookie", "notice", "consent", "newsletter", "alert", "popup", "subscribe", "gdpr-banner"))}">{one((prose(5, 30), f"<p>{prose(5, 30)}</p><button>{word()}</button>"))}</{t}>'

    def form():
        return f"<form{attr('search', 'contact-form', 'subscribe', 'login')}><label>{prose(1, 4, False)}</label><input name=q><button>{prose(1, 2, False)}</button>{f'<p>{prose(4, 15)}</p>' if flip(0.4) else ''}</form>"

    def talk():
        tag = one(("section", "div", "div", "ul", "ol"))
        each = "li" if tag in ("ul", "ol") else one(("div", "div", "article"))
        items = "".join(f"<{each}{attr('comment', 'reply', 'comment-body')}>{one((f'<b>{word()}</b> ', f'<span>{word()}</span>', f'<h4>{word()}</h4>', ''))}<p>{prose(4, 50)}</p></{each}>" for _ in range(rng.randrange(1, 6)))
        return f'<{tag} {one(("class", "id"))}="{one(("comments", "comment-list", "discussion", "responses comments", "replies", "user-comments"))}">{f"<h3>{prose(1, 3, False)}</h3>" if flip(0.5) and tag in ("section", "div") else ""}{items}</{tag}>'

    def share():
        return f'<div class="{one(("share", "social", "share-buttons", "social-links"))}">{"".join(f"<a href=x>{word()}</a> " for _ in range(rng.randrange(2, 5)))}</div>'

    def junk():
        return one((nav, side, advert, advert, notice, notice, form, share))()

    def inline(text):
        words = text.split(" ")
        if len(words) > 6 and flip(0.25):
            k, tag = int(rng.randrange(1, len(words) - 3)), one(("b", "i", "em", "strong", "a href=x", "span", "code"))
            words[k] = f"<{tag}>{words[k]}"
            words[k + 1] += f"</{tag.split()[0]}>"
        return " ".join(words)

    main = " data-main"

    def piece():
        r = rng.random()
        if r < 0.05:
            return f"<p{main}><b>{prose(2, 60, flip(0.7))}<br>"
        if r < 0.72:
            return f"<p{main}>{inline(prose(*one(((1, 4), (4, 30), (20, 120)))))}" + ("</p>" if flip(0.9) else "")
        if r < 0.82:
            return f"<{(t := one(('h2', 'h3')))}{main}>{prose(1, 8, False)}</{t}>"
        if r < 0.9:
            return f"<{(t := one(('ul', 'ol')))}{main}>" + "".join(f"<li{main}>{inline(prose(2, 20, flip(0.5)))}</li>" for _ in range(rng.randrange(2, 6))) + f"</{t}>"
        if r < 0.94:
            return f"<blockquote{main}>{inline(prose(5, 40))}</blockquote>"
        if r < 0.97:
            return f"<table{main}>" + "".join(f"<tr{main}><td{main}>{word()}</td><td{main}>{prose(1, 6, False)}</td></tr>" for _ in range(3)) + "</table>"
        return f"<pre{main}>{prose(3, 30)}</pre>"

    body = [f"<h1{main}>{prose(2, 10, False)}</h1>"] if flip(0.85) else []
    for _ in range(rng.randrange(1, 14)):
        body.append(piece())
        if flip(0.05):
            body.append(junk())
    root = one(("article", "article", "article", "main", "div", "section"))
    names = attr("post", "article", "entry-content", "story", "content", "post-body") if root in ("article", "main") else f' {one(("class", "id"))}="{one(("content", "article", "post", "main-content", "entry", "article-body", "story"))}"'
    article = f"<{root}{names}{main}>" + "".join(body) + (talk() if flip(0.1) else "") + f"</{root}>"
    if flip(0.3):
        article = f"<{(t := one(('main', 'div', 'section')))}{attr('main', 'wrapper', 'container', 'page', 'content')}>{junk() if flip(0.3) else ''}{article}{side() if flip(0.3) else ''}</{t}>"
    before = [f() for f, p in ((header, 0.5), (nav, 0.6), (notice, 0.3), (advert, 0.4), (form, 0.2), (side, 0.15)) if flip(p)]
    after = [f() for f, p in ((talk, 0.4), (share, 0.2), (side, 0.3), (advert, 0.2), (form, 0.15), (notice, 0.15), (footer, 0.8)) if flip(p)]
    rng.shuffle(before)
    tail = "" if flip(0.5) else f"<script>{word()}()</script>"
    return f"<!DOCTYPE html><html><head><title>{prose(2, 8, False)}</title><style>p{{margin:0}}</style></head><body>{''.join(before)}{article}{''.join(after)}{tail}</body></html>"


def labels_of(nodes: list[Node]) -> list[int]:
    """1 for marked elements and for runs of text whose nearest element that is not inline is marked."""
    out = []
    for node in nodes:
        if node.tag == "#" or node.tag in INLINE:
            out.append(out[node.parent] if node.parent >= 0 else 0)
        else:
            out.append(int("data-main" in node.attributes))
    return out


@functools.cache
def trained(n: int = 1500, seed: int = 5) -> Model:
    """The model estimated from ``n`` labelled pages."""
    rng = random.Random(seed)
    pages = [parse(labelled_page(rng)) for _ in range(n)]
    return Model([(nodes, labels_of(nodes)) for nodes in pages])


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html).

    Null or empty html gives an empty text; html without markup is one block; pages of any length are read whole. Repeated
    rows give a row each, a null page_id or url stays null, other columns are ignored, an empty table gives no rows. n_chars
    counts code points.
    """

    shared = pages.sparkSession.sparkContext.broadcast(trained())

    def make():
        model = shared.value

        def run(rows):
            for page_id, url, page in rows:
                text = main_text(page, model)
                yield page_id, url, text, len(text)

        return run

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return map_rows(rows, make, schema, "page_id long, url string, text string, n_chars long", 512)
