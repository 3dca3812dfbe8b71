"""Main-text extraction with gradient-boosted trees over DOM nodes.

Each page is parsed into a tree of elements (forgiving of unclosed, misnested and cut-off
markup). Boosted trees give every element the probability that its content is main text, from
its tag, attribute tokens, depth, sibling statistics, subtree text, link and punctuation
density, and what it lies in. Decoding chooses states for the whole tree at once: above the
main text, inside it, or cut. Inside may follow above, cut may follow both, and below a cut
element everything is cut, so no choice contradicts an ancestor's.

The trees are trained at first use on generated pages whose main text is known by construction.
"""

from __future__ import annotations

import functools
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm._shared import col, small_batches

# Quotes count after an equals sign only, and only where they close.
MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!(?!--)[^>]*+(?:>|\Z)|<\?[^>]*+(?:>|\Z)|</[^A-Za-z>][^>]*+(?:>|\Z)|</>"""
    r"""|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)(>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""(?:^|[\s/"'])(class|id|role|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
TOKEN = re.compile(r"[a-z]+")

# Kinds of elements in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body dd dt head html legend li option td th tr tbody thead tfoot title select".split())
P_SCOPE = ("td", "th", "table", "button", "caption")
ENDS = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table")}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}
GROUPS = (
    "article main", "section div", "p blockquote pre", "h1 h2 h3 h4 h5 h6", "ul ol dl menu", "li dt dd", "a", "nav", "header", "footer", "aside",
    "form input button select option label textarea fieldset legend", "script style head meta link title noscript iframe template svg math base",
    "b i em strong span u s small sub sup code mark q cite br abbr time", "table tbody thead tfoot tr td th", "img figure figcaption picture video audio source hr", "html body",
)
GROUP_OF = {t: i for i, g in enumerate(GROUPS) for t in g.split()}
# Attribute tokens by what they point to.
TOKEN_SETS = (
    frozenset("article content main post entry story body text".split()),
    frozenset("nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc".split()),
    frozenset("footer header masthead copyright banner topbar".split()),
    frozenset("ad ads advert adverts advertisement sponsor sponsored promo promotion".split()),
    frozenset("sidebar aside related recommended widget rail more".split()),
    frozenset("comment comments discussion replies reply respond disqus".split()),
    frozenset("cookie cookies notice consent alert popup modal gdpr overlay".split()),
    frozenset("share social follow subscribe newsletter signup login search form".split()),
    frozenset("hidden none".split()),
)
N_GROUPS, N_TOKENS = len(GROUPS) + 1, len(TOKEN_SETS)


class Page:
    """Elements in page order and the pieces of text they own."""

    def __init__(self, html: str):
        self.tag: list[str] = ["#root"]
        self.parent: list[int] = [-1]
        self.attrs: list[str] = [""]
        self.pieces: list[tuple[int, int, str]] = []  # element, block, text
        self._build(html)

    def _build(self, html: str) -> None:
        """One pass over the markup. What is open is held by name too, so that a tag costs no more than
        what it closes. Raw elements are skipped to their end tags, whatever they hold."""
        stack, block, at = [0], 0, 0
        tag, parent, attrs, pieces = self.tag, self.parent, self.attrs, self.pieces
        places: dict[str, list[int]] = {}  # depths of the open elements of a name
        blocks = [0]  # depths of the open block elements

        def last(names) -> int:
            return max((places[n][-1] for n in names if places.get(n)), default=0)

        def pop_to(depth: int) -> None:
            while len(stack) > depth:
                places[tag[stack.pop()]].pop()
            while blocks[-1] >= depth:
                blocks.pop()

        while m := MARKUP.search(html, at):
            if m.start() > at:
                pieces.append((stack[-1], block, unescape(html[at : m.start()])))
            at = m.end()
            name = m[2]
            if name is None or not m[4]:
                continue
            name = name.lower()
            if m[1]:
                inline = name not in BLOCK
                depth = last((name,))
                if depth and not (inline and depth < blocks[-1]):
                    pop_to(depth)
                block += not inline
                continue
            if name in CLOSES_P and (depth := last(("p",))) > last(P_SCOPE):
                pop_to(depth)
            if name in ENDS:
                same, scope = ENDS[name]
                depth = last(same)
                if depth > last(scope):
                    pop_to(depth)
                    while len(stack) > 1 and tag[stack[-1]] in same:
                        pop_to(len(stack) - 1)
            block += name in BLOCK
            here = len(tag)
            tag.append(name)
            parent.append(stack[-1])
            attrs.append(m[3])
            if name == "br":
                pieces.append((here, block, " "))
            if name in VOID or (m[3].endswith("/") and name in ("svg", "math")):
                continue
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(html, at)
                stop = end.start() if end else len(html)
                if name in ("title", "textarea"):
                    pieces.append((here, block, unescape(html[at:stop])))
                if end:
                    close = html.find(">", stop)
                    stop = close + 1 if close >= 0 else len(html)
                at = stop
                block += name in BLOCK
                continue
            places.setdefault(name, []).append(len(stack))
            if name in BLOCK:
                blocks.append(len(stack))
            stack.append(here)
        if at < len(html):
            pieces.append((stack[-1], block, unescape(html[at:])))

    def features(self) -> np.ndarray:
        n = len(self.tag)
        own = np.zeros(n)
        dots = np.zeros(n)
        for i, _, t in self.pieces:
            k = len(t) if not t.isspace() else 0
            own[i] += k
            if k:
                dots[i] += t.count(".") + t.count(",")
        text, points, tags, links, paragraphs = own.copy(), dots.copy(), np.ones(n), np.zeros(n), np.zeros(n)
        parent, tag = self.parent, self.tag
        for i in range(n - 1, 0, -1):
            p = parent[i]
            if tag[i] == "a":
                links[i] = text[i]
            text[p] += text[i]
            points[p] += points[i]
            tags[p] += tags[i]
            links[p] += links[i]
            paragraphs[p] += paragraphs[i] + (tag[i] == "p" and text[i] > 40)
        kids = np.bincount(np.array(parent[1:], np.int64), minlength=n) if n > 1 else np.zeros(n)
        out = np.zeros((n, 2 * (N_GROUPS + N_TOKENS) + 16), np.float32)
        groups = out[:, :N_GROUPS]
        tokens = out[:, N_GROUPS : N_GROUPS + N_TOKENS]
        over_groups = out[:, N_GROUPS + N_TOKENS : 2 * N_GROUPS + N_TOKENS]
        over_tokens = out[:, 2 * N_GROUPS + N_TOKENS : 2 * (N_GROUPS + N_TOKENS)]
        depth = np.zeros(n)
        nth = np.zeros(n)
        seen = [0] * n
        for i in range(n):
            groups[i, GROUP_OF.get(tag[i], N_GROUPS - 1)] = 1
            if self.attrs[i]:
                for name, a, b, c in ATTRIBUTE.findall(self.attrs[i]):
                    value = (a or b or c or ("hidden" if name.lower() == "hidden" else "")).lower()
                    if value:
                        words = frozenset(TOKEN.findall(value))
                        for k, s in enumerate(TOKEN_SETS):
                            if words & s:
                                tokens[i, k] = 1
            if i:
                p = parent[i]
                over_groups[i] = np.maximum(over_groups[p], groups[p])
                over_tokens[i] = np.maximum(over_tokens[p], tokens[p])
                depth[i] = depth[p] + 1
                nth[i] = seen[p]
                seen[p] += 1
        up = np.maximum(np.array(parent), 0)
        root = max(1.0, text[0])
        out[:, 2 * (N_GROUPS + N_TOKENS) :] = np.column_stack(
            [
                depth, nth, kids[up], nth / np.maximum(1, kids[up]), kids, np.log1p(own), np.log1p(text), np.log1p(tags), text / tags,
                links / np.maximum(1, text), 100 * points / np.maximum(1, text), np.log1p(paragraphs), text / root, text / np.maximum(1, text[up]),
                np.log1p(text[up]), links[up] / np.maximum(1, text[up]),
            ]
        )
        return out

    def main_text(self, chance: np.ndarray) -> str:
        """The text that decoding puts inside, by blocks."""
        inside = decode(self.parent, chance)
        out: list[str] = []
        last, parts = None, []
        for i, block, t in self.pieces:
            if block != last:
                out.append(" ".join("".join(parts).split()))
                last, parts = block, []
            if inside[i]:
                parts.append(t)
        out.append(" ".join("".join(parts).split()))
        return "\n\n".join(x for x in out if x)


def decode(parent: list[int], chance: np.ndarray) -> list[bool]:
    """The likeliest states of all elements: above, inside, cut; whether each is inside."""
    n = len(parent)
    gain = np.log(np.clip(chance, 1e-4, 1 - 1e-4)) - np.log1p(-np.clip(chance, 1e-4, 1 - 1e-4))
    gain = gain.tolist()
    # Gains over all cut: below an element that is inside, and below one that is above.
    inside = list(gain)
    above = [0.0] * n
    for i in range(n - 1, 0, -1):
        p = parent[i]
        inside[p] += max(inside[i], 0.0)
        above[p] += max(inside[i], above[i], 0.0)
    state = [0] * n  # 0 above, 1 inside, 2 cut
    for i in range(1, n):
        p = state[parent[i]]
        if p == 2:
            state[i] = 2
        elif p == 1:
            state[i] = 1 if inside[i] > 0 else 2
        else:
            state[i] = 1 if inside[i] > 0 and inside[i] >= above[i] else (0 if above[i] > 0 else 2)
    return [s == 1 for s in state]


@dataclass
class Trees:
    """Boosted trees of one depth: split features and thresholds level by level, leaf values."""

    depth: int
    start: float
    features: np.ndarray
    thresholds: np.ndarray
    leaves: np.ndarray

    def chance(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, t, v in zip(self.features, self.thresholds, self.leaves):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            total += v[at - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, ridge: float = 2.0) -> Trees:
    """Newton boosting of the logistic loss with histogram splits."""
    n, k = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(k)]
    binned = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])
    cells = np.arange(k) * bins + binned
    share = y.mean()
    start = math.log(share / (1 - share))
    score = np.full(n, start)
    all_f, all_t, all_v = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        f, t = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            index = ((at - first)[:, None] * (k * bins) + cells).ravel()
            size = width * k * bins
            gs = np.bincount(index, np.repeat(g, k), size).reshape(width, k, bins).cumsum(2)
            hs = np.bincount(index, np.repeat(h, k), size).reshape(width, k, bins).cumsum(2)
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
            gain[:, :, -1] = 0
            best = gain.reshape(width, -1).argmax(1)
            for node in range(width):
                j, b = divmod(int(best[node]), bins)
                if gain[node, j, b] > 1e-6 and b < len(cuts[j]):
                    f[first + node], t[first + node] = j, cuts[j][b]
            at = 2 * at + 1 + (x[np.arange(n), f[at]] > t[at])
        leaf = at - (2**depth - 1)
        v = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
        score += v[leaf]
        all_f.append(f), all_t.append(t), all_v.append(v)
    return Trees(depth, start, np.array(all_f), np.array(all_t), np.array(all_v))


def training_page(rng: random.Random) -> str:
    """A made-up page; data-y says whether an element is main text."""
    word = lambda: "".join(rng.choice(("ka", "lo", "mi", "ten", "sur", "e", "pal", "ing", "on")) for _ in range(rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    prose = lambda a, b: ". ".join(words(4, 14).capitalize() for _ in range(rng.randint(a, b))) + "."
    links = lambda y, a, b: "".join(f'<li data-y="{y}"><a data-y="{y}" href="/x">{words(1, 3)}</a></li>' for _ in range(rng.randint(a, b)))
    pick = rng.choice

    def bulk(tags: str, body: str, names: str = "") -> str:
        tag = pick(tags.split())
        name = f' {pick(("class", "id"))}="{pick(names.split())}"' if names and (tag in ("div", "section") or rng.random() < 0.3) else ""
        return f'<{tag} data-y="0"{name}>{body}</{tag}>'

    plain = lambda a, b: f'<p data-y="0">{prose(a, b)}</p>' if rng.random() < 0.6 else prose(a, b)
    nav = lambda: bulk("nav nav div", f'<ul data-y="0">{links(0, 3, 9)}</ul>', "menu nav navbar breadcrumbs navigation")
    advert = lambda: bulk("div div aside", plain(1, 2), "ad ads advert sponsored promo banner-ad")
    notice = lambda: bulk("div section", plain(1, 3) + '<button data-y="0">OK</button>', "cookie-notice consent notice popup alert")
    side = lambda: bulk("aside div", f'<h3 data-y="0">{words(1, 3)}</h3>' + (f'<ul data-y="0">{links(0, 2, 6)}</ul>' if rng.random() < 0.6 else plain(1, 3)), "sidebar related widget recommended")
    form = lambda: f'<form data-y="0"><label data-y="0">{words(1, 3)}</label><input data-y="0" name="q"><button data-y="0">{words(1, 2)}</button>{plain(1, 1) if rng.random() < 0.4 else ""}</form>'
    talk = lambda: bulk("section div", f'<h2 data-y="0">{words(1, 2)}</h2>' + "".join(f'<div data-y="0" class="comment"><b data-y="0">{word()}</b><p data-y="0">{prose(1, 5)}</p></div>' for _ in range(rng.randint(1, 6))), "comments discussion replies comment-list")
    share = lambda: bulk("div", f'<a data-y="0" href="#">{word()}</a> <a data-y="0" href="#">{word()}</a>', "share social follow")
    extra = lambda: pick((advert, notice, side, form, share))()

    def paragraph() -> str:
        kind = rng.random()
        if kind < 0.7:
            text = prose(1, 9)
            if rng.random() < 0.3:
                text = f'<b data-y="1">{words(1, 8)}.</b> ' + text
            if rng.random() < 0.2:
                text += f' <a data-y="1" href="/y">{words(1, 3)}</a> {words(2, 6)}.'
            return f'<p data-y="1">{text}' + pick(("</p>", "</p>", "<br data-y='1'>"))
        if kind < 0.8:
            return f'<h2 data-y="1">{words(1, 6)}</h2>'
        if kind < 0.86:
            return '<ul data-y="1">' + "".join(f'<li data-y="1">{prose(1, 2)}</li>' for _ in range(rng.randint(2, 5))) + "</ul>"
        if kind < 0.9:
            return f'<blockquote data-y="1"><p data-y="1">{prose(1, 3)}</p></blockquote>'
        if kind < 0.92:
            return f'<pre data-y="1">{words(5, 20)}</pre>'
        if kind < 0.96:
            cell = lambda tag: f'<{tag} data-y="1">{pick((words(1, 3), str(rng.randint(1, 9999)), prose(1, 1)))}</{tag}>'
            row = lambda tag, n: '<tr data-y="1">' + "".join(cell(tag) for _ in range(n)) + "</tr>"
            wide = rng.randint(2, 5)
            rows = (row("th", wide) if rng.random() < 0.5 else "") + "".join(row("td", wide) for _ in range(rng.randint(1, 6)))
            return '<table data-y="1">' + (f'<tbody data-y="1">{rows}</tbody>' if rng.random() < 0.5 else rows) + "</table>"
        if kind < 0.98:
            return '<dl data-y="1">' + "".join(f'<dt data-y="1">{words(1, 3)}</dt><dd data-y="1">{prose(1, 2)}</dd>' for _ in range(rng.randint(1, 4))) + "</dl>"
        return f'<p data-y="1">{words(1, 4)}.</p>'

    title = f'<h1 data-y="1">{words(1, 9)}</h1>'
    body = [title, *[paragraph() for _ in range(rng.choice((1, 1, 2, 4, 8, 16, 30)) if rng.random() < 0.9 else 60)]]
    if rng.random() < 0.45:
        # A short article and little or nothing else; such pages have few nodes, so many are made.
        bare = "".join(body[: rng.randint(2, 6)])
        frame = pick((f'<article data-y="1">{bare}</article>', f'<main data-y="1">{bare}</main>', f'<main data-y="1"><article data-y="1">{bare}</article></main>', f'<div data-y="1" class="{pick(("content", "post-body", "entry", "article"))}">{bare}</div>'))
        rest = bulk("footer div", f"&copy; {words(1, 3)}", "footer copyright") if rng.random() < 0.3 else ""
        inside = f'<body data-y="0">{frame}{rest}</body>'
        return pick((frame + rest, inside, f'<html data-y="0"><head data-y="0"><title data-y="0">{words(1, 4)}</title></head>{inside}</html>'))
    for _ in range(rng.choice((0, 0, 0, 1, 2))):
        body.insert(rng.randint(1, len(body)), extra())
    if rng.random() < 0.15:
        body.insert(0, f'<header data-y="1">{body.pop(0)}</header>')
    if rng.random() < 0.3:
        body.append(talk())
    text = "".join(body)
    frame = rng.random()
    if frame < 0.55:
        main = f'<article data-y="1">{text}</article>'
    elif frame < 0.7:
        main = f'<main data-y="1">{text}</main>'
    else:
        main = f'<div data-y="1" {pick(("class", "id"))}="{pick(("content", "post-body", "entry", "story", "article", "main-text"))}">{text}</div>'
    before = [f() for f in rng.sample((nav, advert, notice, side, form, share), rng.randint(1, 4))]
    if rng.random() < 0.4:
        before.insert(0, bulk("header header div", plain(1, 1) + (nav() if rng.random() < 0.5 else ""), "header masthead topbar banner"))
    after = [f() for f in rng.sample((side, advert, share, talk, form), rng.randint(0, 3))]
    after.append(bulk("footer footer div", f"&copy; {words(1, 3)} &middot; {prose(1, 3)}" + (nav() if rng.random() < 0.3 else ""), "footer copyright site-footer"))
    if rng.random() < 0.3:
        main = f'<div data-y="0" class="{pick(("wrapper", "page", "container", "row"))}">{main}{side() if rng.random() < 0.6 else ""}</div>'
    html = f'<html data-y="0"><head data-y="0"><title data-y="0">{words(2, 6)}</title><style data-y="0">p</style></head><body data-y="0">{"".join(before)}{main}{"".join(after)}</body></html>'
    return html[: rng.randint(len(html) // 3, len(html))] if rng.random() < 0.1 else html


def training_nodes(pages: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        page = Page(training_page(rng))
        y = []
        for a in page.attrs:
            m = re.search(r"""data-y=["']([01])""", a)
            y.append(int(m[1]) if m else 0)
        xs.append(page.features())
        ys.append(y)
    return np.concatenate(xs), np.concatenate(ys).astype(float)


@functools.lru_cache(maxsize=1)
def trained_trees(pages: int = 800, seed: int = 11) -> Trees:
    return fit_trees(*training_nodes(pages, seed))


def extract_all(htmls: list[str], trees: Trees) -> list[str]:
    pages = [Page(h) for h in htmls]
    rows = [p.features() for p in pages]
    if not rows:
        return []
    chance = trees.chance(np.concatenate(rows))
    out, at = [], 0
    for p, r in zip(pages, rows):
        out.append(p.main_text(chance[at : at + len(r)]))
        at += len(r)
    return out


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", trees: Trees | None = None) -> DataFrame:
    """For each row: id, url, text.

    Character references are decoded, white space within a block (nothing but characters that
    Unicode counts as such) becomes one space, blocks are joined by two line feeds in page
    order. A null or empty page, or one without main text, gives empty text. Pages of any
    length are taken whole; repeated rows are extracted each. An empty table gives an empty
    result. Other columns are ignored, whatever their names.
    """
    small_batches(pages.sparkSession)
    trees = trees or trained_trees()
    source = pages.select(col(id_col).alias("id"), col(url_col).alias("url"), F.coalesce(col(html_col).cast("string"), F.lit("")).alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in source.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = extract_all(batch.column("html").to_pylist(), trees)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(text, pa.string())], names=["id", "url", "text"])

    return source.mapInArrow(run, f"id {kinds['id']}, url {kinds['url']}, text string").withColumnsRenamed({"id": id_col, "url": url_col})
