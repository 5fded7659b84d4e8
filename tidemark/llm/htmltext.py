"""Main text of web pages: boosted trees judge DOM nodes, and a decoding over the tree makes the choices agree."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .boosting import Trees, fit

#: Elements whose content is not markup and runs to their end tag, or else to the end of the page but for the last three.
RAW = frozenset("script style textarea iframe title noembed noframes".split())
#: Elements whose content is not text of the page: that hold other content in place of theirs, that hold words and no blocks, and drawings.
CONTAINERS, CONTROLS, DRAWINGS = frozenset("noscript template object canvas audio video head".split()), frozenset("select option button datalist".split()), frozenset("svg math".split())
#: Elements that end with their start tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin a block of text.
BLOCKS = frozenset(
    "html body article aside section main nav header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th "
    "form fieldset legend pre blockquote figure figcaption address details summary dialog menu hgroup search center".split()
)
#: Elements whose start closes an open paragraph.
_CLOSES_P = BLOCKS - frozenset("html body li dt dd caption thead tbody tfoot tr td th".split())
#: Elements whose start closes an open one of these, inside the nearest of the third.
_SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_TAGS = [["article"], ["main"], ["p"], ["h1"], ["h2", "h3", "h4", "h5", "h6"], ["div"], ["section"], ["nav", "menu"], ["aside"], ["header"], ["footer"], ["ul", "ol", "dl"], ["li", "dt", "dd"], ["form", "fieldset", "legend"], ["table", "tr", "td", "th", "tbody", "thead"], ["pre", "blockquote"], ["figure", "figcaption"], ["dialog", "details", "summary"], ["body", "html"]]
#: Words of class, id and role attributes, by what they speak for.
_ATTRIBUTES = {
    "content": "content article post entry main body story text prose page hentry markdown",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager tabs toolbar topbar skip",
    "header": "header head masthead branding logo banner hero top",
    "footer": "footer foot bottom copyright legal colophon",
    "side": "sidebar side aside rail widget widgets related recommend recommended more popular trending archive tags complementary secondary",
    "notice": "cookie cookies consent gdpr notice alert warning popup modal overlay toast dialog banner announcement paywall disclaimer",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted dfp adsense adslot outbrain taboola affiliate commercial",
    "form": "form login signin signup subscribe subscription newsletter search contact register",
    "comment": "comment comments commentlist reply replies disqus discussion respond reader readers thread feedback responses",
    "social": "share sharing social follow twitter facebook author meta byline",
}
_GROUP_OF: dict[str, list[int]] = {}
for _i, _words in enumerate(_ATTRIBUTES.values()):
    for _w in _words.split():
        _GROUP_OF.setdefault(_w, []).append(_i)
_TAG_OF = {t: i for i, ts in enumerate(_TAGS) for t in ts}
#: A quote opens a value only after an equals sign; a value whose end quote is missing, or is followed by what can't follow it, or that reaches into the next tag's, ends like one without quotes.
_TOKEN = re.compile(
    r"""<!--|<[!?][^>]*+(?:>|\Z)|"""
    r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]++|=\s*+(?>"[^">]*+"|'[^'>]*+'|"[^"]*+(?<!=)"(?=[\s/>])|'[^']*+(?<!=)'(?=[\s/>])|[^\s>]*+)|["'])*+)(?:>|\Z)"""
)
_ATTR = re.compile(r"""(?<![\w-])(class|id|role|aria-label|style|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


#: (begin, end, whether it is an end tag, tag or None, attributes) of a comment, raw element or tag.
Token = tuple[int, int, bool, str | None, str]


def tokens(source: str) -> list[Token]:
    """The tags of a page in order. Raw elements are one token with their content; a comment without an end is one as far as its next ``>``."""
    out: list[Token] = []
    at, lower = 0, ""
    closed: dict[str, bool] = {}  # what has no end any more need not be looked for again
    while m := _TOKEN.search(source, at):
        at, tag = m.end(), m[2]
        if tag is None:
            if m[0] == "<!--":
                stop = source.find("-->", at) if closed.setdefault("--", True) else -1
                closed["--"] = stop >= 0
                at = stop + 3 if stop >= 0 else (source.find(">", at) + 1 or len(source))
            out.append((m.start(), at, False, None, ""))
            continue
        tag = tag.lower()
        if tag in RAW and not m[1] and not m[3].endswith("/"):
            lower = lower or source.lower()
            if len(lower) != len(source):  # a letter whose lower case is longer
                lower = source
            stop = lower.find(f"</{tag}", at) if closed.setdefault(tag, True) else -1
            closed[tag] = stop >= 0
            if stop >= 0:
                at = source.find(">", stop) + 1 or len(source)
            elif tag not in ("title", "noembed", "noframes"):
                at = len(source)
            out.append((m.start(), at, False, None, ""))
        else:
            out.append((m.start(), at, bool(m[1]), tag, m[3]))
    return out


def _past(found: list[Token], i: int, pairs: dict[int, int]) -> tuple[int, int]:
    """(token, place) from which a page goes on after the skipped element that begins at token i.

    That is after its end tag, if the blocks in between are whole. Without that a control or drawing ends at the next
    block's tag, or where another of its kind begins, and of a container only the tag is skipped.
    """
    tag = found[i][3]
    if tag in CONTAINERS and i not in pairs:
        return i + 1, found[i][1]
    stop = pairs.get(i, len(found))
    depth, inner = 0, 0
    for k in range(i + 1, stop):
        begin, _, end_tag, t, _ = found[k]
        if t == "foreignobject":
            inner += -1 if end_tag else 1
        if t in BLOCKS and t not in VOID:
            depth += -1 if end_tag else 1
            if depth < 0 or tag in DRAWINGS and not inner or stop == len(found) and tag not in CONTAINERS:
                return k, begin
        if t == tag and not end_tag and tag in CONTROLS:
            return k, begin
    if i in pairs:
        return stop + 1, found[stop][1]
    return stop, found[-1][1]


def _pairs(found: list[Token]) -> dict[int, int]:
    """For each start tag of a skipped element, its end tag: the next one of a control, the one at its level of others."""
    open_at: dict[str, list[int]] = {}
    out = {}
    for k, (_, _, end_tag, t, attributes) in enumerate(found):
        if t in CONTAINERS or t in CONTROLS or t in DRAWINGS:
            stack = open_at.setdefault(t, [])
            if end_tag:
                if stack:
                    out[stack.pop()] = k
            elif not attributes.endswith("/"):
                if t in CONTROLS:
                    stack.clear()  # they don't nest: the one before has no end tag
                stack.append(k)
    return out


class Page:
    """Block elements of a page in order: parent, tag, attribute groups, and texts as (node, text, characters in links)."""

    def __init__(self, source: str):
        self.parent, self.tag, self.groups, self.depth, self.hidden = [-1], ["html"], [frozenset()], [0], [False]
        self.texts: list[tuple[int, str, int]] = []
        stack: list[tuple[str, int]] = [("", 0)]  # open elements and the block node they are in
        run: list[str] = []
        linked = 0
        in_link = 0

        def flush() -> None:
            nonlocal linked
            if run:
                text = " ".join("".join(run).split())
                if text:
                    self.texts.append((stack[-1][1], text, min(linked, len(text))))
                run.clear()
            linked = 0

        def pop_to(depth: int) -> None:
            nonlocal in_link
            if any(t in BLOCKS for t, _ in stack[depth:]):
                flush()
            in_link -= sum(t == "a" for t, _ in stack[depth:])
            del stack[depth:]

        found = tokens(source)
        pairs = _pairs(found)
        at, number = 0, 0
        while True:
            stop = found[number][0] if number < len(found) else len(source)
            if stop > at:
                piece = html.unescape(source[at:stop])
                run.append(piece)
                if in_link:
                    linked += len(piece)
            if number == len(found):
                break
            _, at, end_tag, tag, attributes = found[number]
            number += 1
            if tag is None:
                continue
            if end_tag:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        pop_to(i)
                        break
                    if stack[i][0] in BLOCKS and tag not in BLOCKS:
                        break
                continue
            if tag in VOID:
                if tag in ("br", "hr"):
                    run.append(" ")
                continue
            if tag in CONTAINERS or tag in CONTROLS or tag in DRAWINGS:
                if not attributes.endswith("/"):
                    number, at = _past(found, number - 1, pairs)
                continue
            if tag in _CLOSES_P:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == "p":
                        pop_to(i)
                        break
                    if stack[i][0] in BLOCKS:
                        break
            if tag in _SIBLINGS:
                closed, within = _SIBLINGS[tag]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in within:
                        break
                    if stack[i][0] in closed:
                        pop_to(i)
                        break
            if tag in ("html", "body"):
                continue
            if tag in BLOCKS or "-" in tag:
                flush()
                up = stack[-1][1]
                groups, hidden = set(), False
                if attributes.strip():
                    for name, value in _ATTR.findall(attributes):
                        name, value = name.lower(), value.strip("\"'")
                        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                            hidden = True
                        elif name != "style":
                            for w in _WORD.findall(value):
                                groups.update(_GROUP_OF.get(w.lower(), ()))
                self.parent.append(up)
                self.tag.append(tag if tag in BLOCKS else "div")
                self.groups.append(frozenset(groups))
                self.depth.append(self.depth[up] + 1)
                self.hidden.append(hidden or self.hidden[up])
                stack.append((tag if tag in BLOCKS else "div", len(self.parent) - 1))
                if tag not in BLOCKS:
                    stack[-1] = (tag, len(self.parent) - 1)
            else:
                stack.append((tag, stack[-1][1]))
                in_link += tag == "a"
        flush()


N_GROUPS = len(_ATTRIBUTES)
#: Pages whose nodes are judged together.
PAGES_AT_ONCE = 128
#: Numbers of a node: own tag, attribute tokens of itself and its ancestors, subtree, sibling, parent and page statistics.
N_FEATURES = len(_TAGS) + 2 * N_GROUPS + len(_TAGS) + 19


def node_features(page: Page) -> np.ndarray:
    """A row of features for each node of a page."""
    n = len(page.parent)
    parent = page.parent
    own_chars, own_links, own_words, own_stops, own_texts = (np.zeros(n) for _ in range(5))
    for node, text, link in page.texts:
        own_chars[node] += len(text)
        own_links[node] += link
        own_words[node] += text.count(" ") + 1
        own_stops[node] += text.count(". ") + text.count(", ") + text.endswith((".", "!", "?"))
        own_texts[node] += 1
    total = np.stack([own_chars, own_links, own_words, own_stops, own_texts, np.ones(n)], 1)
    for i in range(n - 1, 0, -1):  # children come after their parents
        total[parent[i]] += total[i]
    chars, links, words, stops, texts, nodes = total.T
    page_chars = max(chars[0], 1.0)
    before = np.zeros(n)
    seen = 0.0
    order = np.zeros(n)
    for i in range(n):
        order[i] = i / max(n - 1, 1)
        before[i] = seen / page_chars
        seen += own_chars[i]
    index, same, count, prev = (np.zeros(n) for _ in range(4))
    children: list[list[int]] = [[] for _ in range(n)]
    for i in range(1, n):
        children[parent[i]].append(i)
    for kids in children:
        tags = Counter(page.tag[k] for k in kids)
        for j, k in enumerate(kids):
            index[k] = j / max(len(kids) - 1, 1)
            count[k] = len(kids)
            same[k] = tags[page.tag[k]] / len(kids)
            prev[k] = chars[kids[j - 1]] if j else -1
    above = np.array(parent)
    above[0] = 0
    tag = np.array([_TAG_OF.get(t, 5) for t in page.tag])
    x = np.zeros((n, N_FEATURES), np.float32)
    x[np.arange(n), tag] = 1
    a = len(_TAGS)
    for i, g in enumerate(page.groups):
        for j in g:
            x[i, a + j] = 1
    b = a + N_GROUPS
    c = b + N_GROUPS
    for i in range(1, n):
        p = parent[i]
        x[i, b:c] = np.maximum(x[p, a:b], x[p, b:c])
        x[i, c : c + len(_TAGS)] = np.maximum(x[p, : len(_TAGS)], x[p, c : c + len(_TAGS)])
    k = c + len(_TAGS)
    one = np.maximum(chars, 1.0)
    columns = (
        np.array(page.depth),
        np.log1p(chars),
        np.log1p(words),
        links / one,
        chars / np.maximum(nodes, 1),
        np.log1p(own_chars),
        own_links / np.maximum(own_chars, 1),
        stops / np.maximum(words, 1),
        words / np.maximum(texts, 1),
        np.log1p(nodes),
        chars / page_chars,
        chars / np.maximum(chars[above], 1),
        before,
        order,
        index,
        np.log1p(count),
        same,
        np.log1p(np.maximum(prev, 0)),
        links[above] / np.maximum(chars[above], 1),
    )
    for j, column in enumerate(columns):
        x[:, k + j] = column
    return x


def decode(page: Page, odds: np.ndarray, split: float = 1.0) -> np.ndarray:
    """Which nodes' own texts are kept: the best choice in which a subtree is kept whole, dropped whole, or split.

    A node gains its log odds if it is kept. A split of a subtree, whose parts then choose on their own, costs
    ``split``; so a doubtful node follows its ancestors, and a clear one doesn't.
    """
    n = len(page.parent)
    has_text = np.zeros(n, bool)
    for node, _, _ in page.texts:
        has_text[node] = True
    gain = np.clip(odds, -4, 4) * np.where(has_text, 1.0, 0.5)
    gain[np.array(page.hidden)] = -50
    whole, parts = gain.copy(), np.where(has_text, np.maximum(gain, 0), 0.0)
    best = np.zeros(n)
    choice = np.zeros(n, np.int64)  # 0 dropped, 1 kept, 2 split
    for i in range(n - 1, -1, -1):
        options = (0.0, whole[i], parts[i] - split)
        choice[i] = max(range(3), key=options.__getitem__)
        best[i] = options[choice[i]]
        if i:
            whole[page.parent[i]] += whole[i]
            parts[page.parent[i]] += best[i]
    kept = np.zeros(n, bool)
    state = np.zeros(n, np.int64)
    for i in range(n):
        above = state[page.parent[i]] if i else 2
        state[i] = above if above != 2 else choice[i]
        kept[i] = state[i] == 1 or state[i] == 2 and has_text[i] and gain[i] > 0
    return kept


def extract(sources: list[str | None], model: Trees) -> list[str]:
    """The main text of each page; the trees judge the nodes of all pages at once."""
    pages = [Page(s) if s else None for s in sources]
    rows = [node_features(p) for p in pages if p]
    odds = model.margins(np.concatenate(rows)) if rows else np.zeros(0)
    out, at = [], 0
    for page in pages:
        if page is None:
            out.append("")
            continue
        n = len(page.parent)
        kept = decode(page, odds[at : at + n])
        out.append(" ".join(text for node, text, _ in page.texts if kept[node]))
        at += n
    return out


# Training pages


class _Writer:
    """Invented pages in many layouts, with the label of every text."""

    def __init__(self, seed: int):
        self.rng = np.random.Generator(np.random.PCG64(seed))
        self.parts = ["ba", "ren", "tio", "lu", "ke", "stra", "mo", "di", "ven", "pa", "qui", "or", "shi", "na", "tel", "gra", "è", "ü", "ño", "im"]

    def pick(self, *options):
        return options[int(self.rng.integers(len(options)))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def word(self) -> str:
        return "".join(self.pick(*self.parts) for _ in range(int(self.rng.integers(1, 5))))

    def words(self, lo: int, hi: int) -> str:
        return " ".join(self.word() for _ in range(int(self.rng.integers(lo, hi + 1))))

    def sentence(self) -> str:
        out = self.words(3, 16)
        return out[0].upper() + out[1:] + self.pick(".", ".", ".", "?", ", " + self.words(2, 8) + ".")

    def prose(self, lo: int, hi: int) -> str:
        out = " ".join(self.sentence() for _ in range(int(self.rng.integers(lo, hi + 1))))
        if self.chance(0.2):
            w = self.word()
            out += f" <{self.pick('b', 'em', 'i', 'strong', 'span')}>{w}</b> " if self.chance(0.3) else f' <a href="/{w}">{self.words(1, 3)}</a> {self.sentence()}'
        return out

    def mark(self, good: int, tag: str, body: str, names: str = "", close: bool = True) -> str:
        """An element whose texts are labelled; the label travels in an attribute that features don't read."""
        attr = f' {self.pick("class", "class", "id")}="{names}"' if names else ""
        return f'<{tag}{attr} data-y="{good}">{body}' + (f"</{tag}>" if close else "")

    def links(self, n: int) -> str:
        tag = self.pick("li", "li", "li", "div", "span")
        return "".join(f'<{tag}><a href="/{self.word()}">{self.words(1, 3)}</a></{tag}>' for _ in range(n))

    def named(self, tag: str, *names: str) -> tuple[str, str]:
        """An element by its own name, or a div that is named after it."""
        return (tag, self.pick("", "", *names)) if self.chance(0.5) else ("div", self.pick(*names))

    def menu(self) -> str:
        tag, names = self.named("nav", "menu", "navbar", "main-nav", "top-menu", "breadcrumbs", "site-navigation")
        items = self.links(int(self.rng.integers(2, 12)))
        return self.mark(0, tag, f"<ul>{items}</ul>" if self.chance(0.7) else items, names)

    def header(self) -> str:
        tag, names = self.named("header", "header", "masthead", "site-header", "page-head", "banner")
        body = self.pick(f"<h1>{self.words(1, 4)}</h1>", f"<div>{self.words(1, 4)}</div>", f"<p>{self.sentence()}</p>", f'<a href="/">{self.words(1, 3)}</a>')
        return self.mark(0, tag, body + (self.menu() if self.chance(0.3) else ""), names)

    def footer(self) -> str:
        tag, names = self.named("footer", "footer", "site-footer", "foot", "bottom legal", "colophon")
        body = self.pick("&copy; ", "") + f"{self.word()}.example &middot; {self.prose(1, 3)}" if self.chance(0.6) else f"<p>{self.prose(1, 2)}</p><ul>{self.links(4)}</ul>"
        return self.mark(0, tag, body, names)

    def side(self) -> str:
        tag, names = self.named("aside", "sidebar", "side rail", "widget-area", "related-posts", "recommended", "most-popular")
        body = "".join(self.pick(f"<h3>{self.words(1, 4)}</h3>", f"<p>{self.prose(1, 3)}</p>", f"<ul>{self.links(5)}</ul>") for _ in range(int(self.rng.integers(1, 5))))
        return self.mark(0, tag, body, names)

    def advert(self) -> str:
        return self.mark(0, self.pick("div", "div", "aside", "section", "p"), self.pick(self.prose(1, 3), f"<p>{self.prose(1, 3)}</p>", f'<a href="/x">{self.sentence()}</a>'), self.pick("ad", "ads", "advert", "ad-slot", "sponsored", "promo", "advertisement", "adBox"))

    def notice(self) -> str:
        tag = self.pick("div", "div", "section", "dialog", "p")
        body = f"<p>{self.prose(1, 4)}</p><button>{self.word()}</button>" if tag != "p" else self.prose(1, 3)
        return self.mark(0, tag, body, self.pick("cookie-banner", "consent", "notice", "alert", "gdpr-popup", "modal", "paywall-notice", "cookies"))

    def form(self) -> str:
        tag, names = self.named("form", "newsletter", "subscribe-form", "login", "search-form", "signup")
        body = f"<label>{self.words(1, 4)}</label><input name=q><p>{self.sentence()}</p>" if self.chance(0.5) else f"{self.sentence()}<input type=text>"
        return self.mark(0, tag, body, names)

    def comments(self) -> str:
        n = int(self.rng.integers(1, 6))
        one = self.pick("li", "div", "article", "div")
        names = self.pick("comment", "comment", "reply", "reader-comment", "comment-body", "")
        attr = f' class="{names}"' if names else ""
        items = "".join(f"<{one}{attr}>" + self.pick("", f"<b>{self.word()}</b> ", f"<h4>{self.word()}</h4>") + self.pick(self.prose(1, 4), f"<p>{self.prose(1, 4)}</p>") + f"</{one}>" for _ in range(n))
        return self.mark(0, self.pick("div", "section", "ol" if one == "li" else "div"), self.pick("", f"<h3>{self.words(1, 2)}</h3>") * (one != "li") + items, self.pick("comments", "commentlist", "discussion", "disqus_thread", "reader-comments", "responses"))

    def share(self) -> str:
        return self.mark(0, self.pick("div", "ul"), self.links(4), self.pick("share", "social-links", "sharing", "tags", "pagination"))

    def boilerplate(self) -> str:
        return self.pick(self.menu, self.advert, self.advert, self.notice, self.form, self.side, self.share, self.comments)()

    def block(self, i: int) -> str:
        k = self.rng.random()
        if k < 0.72:
            return self.mark(1, "p", self.pick("", "<b>" if self.chance(0.3) else "") + self.prose(1, 8) + self.pick("", "", "<br>"), close=self.chance(0.85))
        if k < 0.8:
            return self.mark(1, self.pick("h2", "h3"), self.words(1, 8))
        if k < 0.86:
            return self.mark(1, self.pick("ul", "ol"), "".join(f"<li>{self.pick(self.sentence(), self.words(1, 8), self.prose(1, 3))}" + self.pick("</li>", "") for _ in range(int(self.rng.integers(1, 6)))))
        if k < 0.9:
            return self.mark(1, "blockquote", self.pick(f"<p>{self.prose(1, 3)}</p>", self.prose(1, 3)))
        if k < 0.93:
            return self.mark(1, "pre", self.words(3, 20))
        if k < 0.96:
            return self.mark(1, "table", "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 6)}</td></tr>" for _ in range(int(self.rng.integers(1, 5)))))
        if k < 0.98:
            return self.mark(1, "figure", f"<img src=x><figcaption>{self.sentence()}</figcaption>")
        return self.mark(1, "div", self.prose(1, 5))

    def article(self, page: bool = True) -> str:
        if self.chance(0.15):  # a page of next to nothing
            text = self.pick(self.words(1, 4) + ".", self.sentence())
            return f"<article>{self.mark(1, 'h1', self.pick(text, self.words(1, 3)))}{self.mark(1, 'p', text)}</article>"
        n = int(self.rng.integers(1, 14)) if self.chance(0.9) else int(self.rng.integers(14, 40))
        title = self.mark(1, self.pick("h1", "h1", "h2"), self.pick(self.words(2, 12), self.sentence())) if self.chance(0.85) else ""
        if title and self.chance(0.15):
            title = f"<header>{title}</header>"
        blocks = []
        for i in range(n):
            blocks.append(self.block(i))
            if self.chance(0.06):
                blocks.append(self.pick(self.advert, self.advert, self.side, self.form, self.share)())
        if self.chance(0.08):
            blocks.append(self.comments())
        body = "".join(blocks)
        for _ in range(int(self.rng.integers(0, 3))):
            body = f'<{self.pick("div", "section")}{self.pick("", "", " class=" + self.pick("content", "entry", "text", "wrap", "col", "x1"))}>{body}</div>' if self.chance(0.4) else body
        tag = self.pick("article", "article", "article", "main", "div", "div", "section", "")
        names = self.pick("", "", "content", "post", "entry-content", "article-body", "story", "main", "c12", "wrap")
        if tag == "div" and not names and self.chance(0.5):
            names = "content"
        return f'<{tag}{f" class={chr(34)}{names}{chr(34)}" if names else ""}>{title}{body}</{tag}>' if tag else title + body

    def page(self) -> str:
        top = "".join(f() for f in (self.header, self.menu, self.advert, self.notice, self.form) if self.chance(0.4))
        low = "".join(f() for f in (self.share, self.comments, self.side, self.form, self.advert, self.notice, self.footer) if self.chance(0.4))
        left = self.side() if self.chance(0.25) else ""
        body = left + self.article()
        if self.chance(0.3):
            body = f'<{self.pick("div", "main", "section")} {self.pick("", "class=container", "id=page", "id=main", "class=row")}>{body}{self.side() if self.chance(0.3) else ""}</div>'
        head = f"<head><title>{self.words(2, 8)}</title><style>p{{margin:0}}</style></head>" if self.chance(0.8) else ""
        return f'<!DOCTYPE html><html lang="{self.pick("en", "de")}">{head}<body>{top}{body}{low}</body></html>'


_LABEL = re.compile(r'data-y="([01])"')


def training_set(pages: int = 500, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the nodes of invented pages; nodes that hold both kinds of text have none."""
    writer = _Writer(seed)
    xs, ys = [], []
    for _ in range(pages):
        source = writer.page()
        page = _Labelled(source)
        n = len(page.parent)
        own = np.full(n, -1)
        for i in range(n):
            own[i] = page.label[i] if page.label[i] >= 0 else own[page.parent[i]] if i else -1
        good, bad = np.zeros(n), np.zeros(n)
        for node, text, _ in page.texts:
            (good if own[node] == 1 else bad)[node] += 1
        for i in range(n - 1, 0, -1):
            good[page.parent[i]] += good[i]
            bad[page.parent[i]] += bad[i]
        pure = ((good > 0) != (bad > 0)) & (np.arange(n) > 0)
        xs.append(node_features(page)[pure])
        ys.append((good > 0)[pure])
    return np.concatenate(xs), np.concatenate(ys).astype(float)


class _Labelled(Page):
    """A training page: each block's label is read from its ``data-y``."""

    def __init__(self, source: str):
        super().__init__(source)
        labels = [_LABEL.search(a) for _, _, end_tag, tag, a in tokens(source) if tag in BLOCKS and not end_tag and tag not in ("html", "body")]
        self.label = [-1, *[int(m[1]) if m else -1 for m in labels]]
        assert len(self.label) == len(self.parent)


@lru_cache(maxsize=4)
def trained(pages: int = 500, seed: int = 3) -> Trees:
    """The model, fitted on invented pages; the same on every machine."""
    return fit(*training_set(pages, seed), trees=40)


def extract_pages(pages: DataFrame, model: Trees | None = None, html_col: str = "html", text_col: str = "main_text") -> DataFrame:
    """``pages`` without ``html_col`` and with ``text_col``: the main text of each whole page, empty if there is none.

    Null and empty pages have an empty text; pages without a closing tag, or without any tag, are read as
    far as they go. All rows and other columns stay; a column named ``text_col`` is replaced. Nothing is
    shuffled. A batch holds few pages at a time, so its memory follows the longest page.
    """
    handle = pages.sparkSession.sparkContext.broadcast(model or trained())
    rest = [c for c in pages.columns if c not in (html_col, text_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str] = []
            for lo in range(0, batch.num_rows, PAGES_AT_ONCE):
                texts += extract(batch.column(len(rest)).slice(lo, PAGES_AT_ONCE).to_pylist(), handle.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(texts, pa.string())], names=[*rest, text_col])

    schema = T.StructType([*[pages.schema[c] for c in rest], T.StructField(text_col, T.StringType())])
    return pages.select(*rest, html_col).mapInArrow(run, schema)
