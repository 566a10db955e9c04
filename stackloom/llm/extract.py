"""Main text of web pages by a linear-chain CRF over DOM leaf blocks (operator 1).

A page is cut into leaf blocks: the text between the edges of block-level elements, in page order.
Each block has features of its ancestors (tags, and hints in class, id and role) and of its text
(length, share of link text, sentence end, signs, place on the page).  A conditional random field
with two labels, main and other, scores the blocks and the steps between neighbours; Viterbi picks
the best labelling.  The field is trained with numpy on ``labelled_pages``: pages of many layouts
whose labels are known as they are made, so no labelled data are needed at run time.

Pages are independent: no shuffle, no group.  Null and empty html, and pages without main blocks,
give an empty text; broken markup is read leniently; repeated rows repeat; other columns pass
through (existing ``text`` and ``n_chars``, in any case of letters, are replaced); an empty table gives an empty table.
Caches are bounded, and so is the work of an element, however deep and varied the nesting.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache
from html.parser import HTMLParser
from math import log2
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr label input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style title template noscript textarea select svg math iframe object canvas audio video".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("table td th ul ol dl div section article main aside nav header footer form body".split())
#: Other tags count as one and the same, as no feature of theirs is ever learnt.
KNOWN = INLINE | VOID | HIDDEN | SCOPE | frozenset("html head p h1 h2 h3 h4 h5 h6 li dt dd tr thead tbody tfoot caption blockquote pre figure figcaption address details summary fieldset legend hgroup center button option optgroup menu search dialog".split())
KINDS = frozenset("article main nav header footer aside form".split())
#: Entries of a path beyond which its older part is merged, and entries at its end that stay as they are.
LONG_PATH, PATH_END = 24, 8
#: Words in class, id and role, by what they say of an element.
HINTS = {
    "menu": "nav navigation navbar menu breadcrumb breadcrumbs crumbs toc pagination pager tabs skip toolbar",
    "top": "header masthead banner topbar logo branding site-title hero",
    "foot": "footer foot copyright colophon legal contentinfo bottom",
    "side": "sidebar side aside complementary widget widgets rail secondary",
    "more": "related recommend recommended recommendations more popular trending teaser promo readmore tags tag categories",
    "ad": "ad ads advert advertisement advertising sponsor sponsored adsense dfp adbox adslot",
    "notice": "cookie cookies consent gdpr notice alert warning popup modal overlay banner-message privacy dialog announcement",
    "form": "form search login signup subscribe newsletter subscription contact register",
    "talk": "comment comments reply replies respond disqus discussion feedback responses",
    "share": "share social sharing follow print byline meta author bio",
    "body": "article content post entry story main body text article-body post-content entry-content articlebody maincontent prose copy",
}
_HINT = {w: k for k, words in HINTS.items() for w in words.split()}
_TOKENS = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def hints(value: str) -> frozenset[str]:
    return _hints(value) if len(value) > 128 else _known_hints(value)


def _hints(value: str) -> frozenset[str]:
    whole = value.lower().split()
    parts = [x.lower() for x in _TOKENS.findall(_CAMEL.sub(" ", value))]
    return frozenset(_HINT[w] for w in [*whole, *parts] if w in _HINT)


_known_hints = lru_cache(4096)(_hints)


class _Open:
    """An open element; ``path`` holds its block-level ancestors and itself, ``depth`` and ``scope`` count such elements."""

    __slots__ = ("tag", "path", "depth", "scope")

    def __init__(self, tag: str, path: tuple, depth: int, scope: int):
        self.tag, self.path, self.depth, self.scope = tag, path, depth, scope


_ROOT = _Open("", (), 0, 0)


def extended(path: tuple, entry: tuple[str, frozenset[str]]) -> tuple:
    """``path`` and ``entry``; of equal entries the last two stay, and the older part of a long path is merged by tag.

    No feature looks further: they are sets, the nearest entry with a hint, and the last two of some tags.  So a path's
    length is bounded by the number of known tags, however deep and varied the nesting.
    """
    same = [k for k, x in enumerate(path) if x == entry]
    path = (*path, entry) if len(same) < 2 else (*path[: same[0]], *path[same[0] + 1 :], entry)
    return path if len(path) <= LONG_PATH else merged(path)


def merged(path: tuple) -> tuple:
    """A path of the same features: one entry for each tag of its older part, then the older entries that are looked for, then its end."""
    old, end = path[:-PATH_END], path[-PATH_END:]
    kinds = [k for k, (tag, _) in enumerate(old) if tag in KINDS]
    tags: dict[str, frozenset[str]] = {}
    for k, (tag, said) in enumerate(old):
        if k not in kinds or len(kinds) > 2:
            tags[tag] = tags.get(tag, frozenset()) | said
    kept = {*[k for k, (_, said) in enumerate(old) if said][-1:], *kinds[-2:]}
    return (*tags.items(), *(old[k] for k in sorted(kept)), *end)


class _Blocks(HTMLParser):
    """Leaf blocks as (text, path, link characters); a path is a tuple of (tag, hints)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, tuple, int]] = []
        self.open: list[_Open] = []
        #: How many elements are open by tag, by scope and tag, and inline ones by depth and tag: searches that would fail are not begun.
        self.count: Counter = Counter()
        self.text: list[str] = []
        self.links = self.hidden = self.anchors = 0

    def top(self) -> _Open:
        return self.open[-1] if self.open else _ROOT

    def flush(self) -> None:
        if self.text:
            words = "".join(self.text).split()
            if words:
                self.blocks.append((" ".join(words), self.top().path, self.links))
            self.text, self.links = [], 0

    def counted(self, x: _Open, by: int) -> None:
        for key in (x.tag, ("scope", x.scope, x.tag), ("inline", x.depth, x.tag)):
            self.count[key] += by
        self.hidden += by * (x.tag in HIDDEN)
        self.anchors += by * (x.tag == "a")

    def cut(self, k: int) -> None:
        while len(self.open) > k:
            self.counted(self.open.pop(), -1)

    def find(self, tags: set[str] | frozenset[str]) -> int:
        """The place of the innermost open element with one of the ``tags``, which there must be."""
        return next(k for k in range(len(self.open) - 1, -1, -1) if self.open[k].tag in tags)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in INLINE:
            self.flush()
            if tag == "body":
                self.cut(0)
            ends = {"p", *CLOSES.get(tag, ())}
            while any(self.count["scope", self.top().scope, t] for t in ends):
                k = self.find(ends)
                found = self.open[k].tag
                self.cut(k)
                if found != "p":
                    break
        elif tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        said = frozenset()
        for name, value in attrs:
            if value and name in ("class", "id", "role"):
                said |= hints(value)
            elif name == "hidden" or name == "style" and value and "display:none" in value.replace(" ", ""):
                said |= {"notice"}
        above = self.top()
        block = tag not in INLINE
        made = _Open(tag, extended(above.path, (tag if tag in KNOWN else "", said)) if block else above.path, above.depth + block, above.scope + (tag in SCOPE))
        self.open.append(made)
        self.counted(made, 1)

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        if self.count["inline", self.top().depth, tag] if tag in INLINE else self.count[tag]:
            self.cut(self.find({tag}))

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.text.append(data)
            if self.anchors:
                self.links += len(data)


def leaf_blocks(html: str) -> list[tuple[str, tuple, int]]:
    parser = _Blocks()
    try:
        parser.feed(html)
        parser.close()
    except AssertionError:  # the parser gives up on some marked sections; they are text then
        parser = _Blocks()
        parser.feed(html.replace("<![", "&lt;!["))
        parser.close()
    parser.flush()
    return parser.blocks


@lru_cache(4096)
def path_features(path: tuple) -> tuple[str, ...]:
    out = {f"in {tag}" for tag, _ in path} | {f"hint {h}" for _, said in path for h in said}
    if path:
        out.add(f"tag {path[-1][0]}")
    near = [h for _, said in reversed(path) for h in sorted(said)]
    out.add(f"near {near[0] if near else '-'}")
    kinds = [t for t, _ in path if t in KINDS]
    out.add(f"kinds {' '.join(kinds[-2:])}")
    return tuple(sorted(out))


def block_features(k: int, n: int, text: str, links: int) -> tuple[str, ...]:
    words = text.count(" ") + 1
    share = min(3, 4 * links // max(len(text), 1))
    end = "." if text[-1] in ".!?…。\"'”»:;" else "-"
    return (
        f"words {min(8, int(log2(words)))}",
        f"links {share}",
        f"end {end}",
        f"size and links {min(4, int(log2(words)) // 2)} {share} {end}",
        f"place {min(3, k)} {min(3, n - 1 - k)}",
        f"sign {'©' in text}",
    )


@dataclass
class Field:
    """Weights of label 1 (main) over label 0 by feature, and of the steps between labels."""

    weight: dict[str, float]
    step: list[list[float]]
    start: list[float]

    def __post_init__(self):
        self._paths: dict[tuple, float] = {}

    def unary(self, blocks: list) -> list[float]:
        out, get = [], self.weight.get
        for k, (text, path, links) in enumerate(blocks):
            if (score := self._paths.get(path)) is None:
                if len(self._paths) > 20_000:
                    self._paths.clear()
                score = self._paths[path] = sum(get(f, 0.0) for f in path_features(path))
            out.append(score + sum([get(f, 0.0) for f in block_features(k, len(blocks), text, links)]))
        return out

    def viterbi(self, unary: list[float]) -> list[int]:
        if not unary:
            return []
        a, b = self.start[0], self.start[1] + unary[0]
        back = []
        (aa, ab), (ba, bb) = self.step
        for u in unary[1:]:
            x, y = a + aa, b + ba
            p, q = a + ab, b + bb
            back.append((x < y, p < q))
            a, b = max(x, y), max(p, q) + u
        out = [int(a < b)]
        for pair in reversed(back):
            out.append(int(pair[out[-1]]))
        return out[::-1]

    def main_text(self, html: str | None) -> str:
        if not html:
            return ""
        blocks = leaf_blocks(html)
        return " ".join(x[0] for x, main in zip(blocks, self.viterbi(self.unary(blocks))) if main)


def train(pages: list[tuple[list, list[int]]], steps: int = 120, rate: float = 0.15, decay: float = 2e-3) -> Field:
    """Maximum likelihood of the labelled ``pages``: (blocks, labels) each, by Adam on exact marginals."""
    index: dict[str, int] = {}
    n, longest = len(pages), max(len(b) for b, _ in pages)
    where, feats = [], []
    gold, real = np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for p, (blocks, labels) in enumerate(pages):
        gold[p, : len(labels)], real[p, : len(labels)] = labels, True
        for k, (text, path, links) in enumerate(blocks):
            for f in (*path_features(path), *block_features(k, len(blocks), text, links)):
                where.append(p * longest + k)
                feats.append(index.setdefault(f, len(index)))
    where, feats = np.array(where), np.array(feats)
    size = len(index)
    theta = np.zeros(size + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    want = np.zeros_like(theta)
    want[:size] = np.bincount(feats, gold.ravel()[where], size)
    both = real[:, 1:]
    for a in (0, 1):
        for b in (0, 1):
            want[size + 2 * a + b] = ((gold[:, :-1] == a) & (gold[:, 1:] == b) & both).sum()
    for a in (0, 1):
        want[size + 4 + a] = (gold[:, 0] == a).sum()
    for it in range(1, steps + 1):
        u = np.bincount(where, theta[:size][feats], n * longest).reshape(n, longest)
        u = np.stack([np.zeros_like(u), u], 2)
        step = theta[size : size + 4].reshape(2, 2)
        fore = np.zeros((n, longest, 2))
        fore[:, 0] = theta[size + 4 :] + u[:, 0]
        for t in range(1, longest):
            nxt = np.logaddexp(fore[:, t - 1, 0, None] + step[0], fore[:, t - 1, 1, None] + step[1]) + u[:, t]
            fore[:, t] = np.where(real[:, t, None], nxt, fore[:, t - 1])
        back = np.zeros((n, longest, 2))
        for t in range(longest - 2, -1, -1):
            x = back[:, t + 1] + u[:, t + 1]
            prev = np.logaddexp(x[:, 0, None] + step[:, 0], x[:, 1, None] + step[:, 1])
            back[:, t] = np.where(real[:, t + 1, None], prev, 0)
        total = np.logaddexp(*fore[:, -1].T)[:, None]
        p1 = np.exp(fore[:, :, 1] + back[:, :, 1] - total) * real
        have = np.zeros_like(theta)
        have[:size] = np.bincount(feats, p1.ravel()[where], size)
        for a in (0, 1):
            for b in (0, 1):
                pair = fore[:, :-1, a] + step[a, b] + u[:, 1:, b] + back[:, 1:, b] - total
                have[size + 2 * a + b] = np.exp(pair[both]).sum()
            have[size + 4 + a] = np.exp(fore[:, 0, a] + back[:, 0, a] - total[:, 0]).sum()
        g = (have - want) / n + decay * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9**it)) / (np.sqrt(v / (1 - 0.999**it)) + 1e-8)
    return Field({f: float(theta[k]) for f, k in index.items()}, theta[size : size + 4].reshape(2, 2).tolist(), theta[size + 4 :].tolist())


MARK = "\x01"


def labelled_pages(n: int = 600, seed: int = 5) -> list[tuple[list, list[int]]]:
    """Pages of varied layouts with the label of every leaf block, known as the pages are made."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[int(rng.integers(len(x)))]
    chance = lambda p: rng.random() < p
    parts = "ka lo mi ten sur ve dra pol in as ne ri to bel gu sha on er ti mon".split()

    def word() -> str:
        return "".join(pick(*parts) for _ in range(int(rng.integers(1, 4))))

    def words(a: int, b: int) -> str:
        return " ".join(word() for _ in range(int(rng.integers(a, b + 1)))).capitalize()

    def sentence(a: int = 4, b: int = 18) -> str:
        return words(a, b) + pick(".", ".", ".", "!", "?")

    def prose(a: int = 1, b: int = 6) -> str:
        return " ".join(sentence() for _ in range(int(rng.integers(a, b + 1))))

    def code() -> str:
        return pick("css", "c", "sc", "x", word()) + "-" + "".join(pick(*"abcdefghkmnpqrstuvwxyz0123456789") for _ in range(int(rng.integers(2, 7))))

    def attr(*names: str) -> str:
        if opaque:
            return f' class="{code()}"' if names and chance(0.8) else ""
        return f' {pick("class", "id", "class")}="{pick(*names)}"' if names and chance(0.85) else ""

    def links(a: int, b: int, tag: str = "li") -> str:
        rows = [f'<a href="/{word()}">{words(1, 5)}</a>' for _ in range(int(rng.integers(a, b + 1)))]
        if tag == "li":
            return "<ul>" + "".join(f"<li>{x}</li>" for x in rows) + "</ul>"
        return pick(" | ", " ", " › ").join(rows)

    def boxed(names: tuple, tags: tuple, inner: str) -> str:
        tag = pick("div", "div", "div", "section") if opaque else pick(*tags)
        return f"<{tag}{attr(*names) if tag in ('div', 'section', 'td', 'p', 'ul') or chance(0.4) else ''}>{inner}</{tag}>"

    def junk(kind: str) -> str:
        if kind == "nav":
            return boxed(("nav", "menu", "main-nav", "breadcrumbs"), ("nav", "nav", "div"), links(3, 9, pick("li", "li", "a")))
        if kind == "top":
            return boxed(("header", "masthead", "site-header", "topbar"), ("header", "div"), pick(f"<h1>{words(1, 4)}</h1>", f"<div>{words(1, 4)}</div>", f"<p>{words(2, 8)}</p>") + (links(2, 6) if chance(0.5) else ""))
        if kind == "ad":
            return boxed(("ad", "ads", "advert", "ad-slot", "sponsored"), ("div", "div", "aside", "section"), pick(sentence(), f"<p>{prose(1, 3)}</p>", links(1, 2, "a")))
        if kind == "notice":
            return boxed(("cookie-notice", "consent", "notice", "alert", "gdpr popup"), ("div", "section", "aside"), f"<p>{prose(1, 3)}</p>" + (f"<button>{words(1, 2)}</button>" if chance(0.6) else ""))
        if kind == "form":
            return f"<form{attr('search', 'newsletter', 'login', 'subscribe')}><p>{pick(words(1, 4), sentence())}</p><label>{words(1, 3)}</label><input><button>{words(1, 2)}</button></form>"
        if kind == "side":
            return boxed(("sidebar", "side", "widget", "related"), ("aside", "aside", "div"), (f"<h3>{words(1, 4)}</h3>" if chance(0.7) else "") + pick(links(2, 7), f"<p>{prose(1, 3)}</p>", f"<p>{prose(1, 2)}</p>" + links(1, 3)))
        if kind == "talk":
            one = lambda: boxed(("comment", "reply", "comment-body"), ("div", "li", "article", "section"), pick(f"<b>{words(1, 2)}</b> <p>{prose(1, 4)}</p>", f"<p>{prose(1, 4)}</p>"))
            return boxed(("comments", "responses", "discussion", "comment-list"), ("section", "div", "div"), (f"<h{pick(2, 3)}>{words(1, 3)}</h3>" if chance(0.6) else "") + "".join(one() for _ in range(int(rng.integers(1, 6)))))
        if kind == "share":
            return boxed(("share", "social", "byline meta", "tags"), ("div", "ul", "p"), links(2, 5, "a") if chance(0.6) else words(2, 6))
        if kind == "more":
            return boxed(("related", "recommended", "more", "popular"), ("div", "section", "aside"), f"<h{pick(2, 3, 4)}>{words(1, 4)}</h3>" + links(2, 6))
        inner = pick(f"&copy; {words(1, 3)} &middot; {sentence()}", f"<p>&copy; 2020 {words(1, 4)}</p>" + links(2, 6), links(2, 8), f"<p>{prose(1, 2)}</p>", sentence())
        return boxed(("footer", "site-footer", "copyright", "legal"), ("footer", "footer", "div"), inner)

    def good(text: str) -> str:
        """Marked main text; some pages are written in odd ways."""
        if style == "bars":
            text = text.replace(" ", " | ")
        elif style == "signs":
            text = " ".join(w + pick("###", "%%%", "&amp;&amp;", "***") for w in text.split())
        elif style == "shout":
            text = " ".join(w.upper() + "!!" for w in text.split())
        elif style == "bare":
            text = text.rstrip(".!?")
        return MARK + text

    def content() -> str:
        out = []
        if chance(0.85):
            out.append(f"<h1>{good(pick(words(2, 10), sentence(3, 12)))}</h1>")
        for k in range(int(rng.integers(1, 12))):
            what = pick(*["p"] * 8, "b", "h", "list", "quote", "table", "div", "pre")
            if what == "p":
                out.append(f"<p>{good(prose(1, 7))}" + pick("</p>", "</p>", ""))
            elif what == "b":
                out.append(f"<p><b>{good(sentence(1, 9))}<br>" + pick("", "</b></p>"))
            elif what == "h":
                out.append(f"<h{pick(2, 3)}>{good(words(1, 6))}</h2>")
            elif what == "list":
                rows = int(rng.integers(2, 6))
                out.append("<ul>" + "".join(f"<li>{good(pick(words(1, 8), sentence()))}</li>" for _ in range(rows)) + "</ul>")
            elif what == "quote":
                out.append(f"<blockquote>{good(prose(1, 3))}</blockquote>")
            elif what == "pre":
                out.append(f"<pre>{good(words(1, 4))} = {word()}({word()})</pre>")
            elif what == "table":
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{good(words(1, 3))}</td>" for _ in range(3)) + "</tr>" for _ in range(int(rng.integers(1, 4)))) + "</table>")
            else:
                out.append(f"<div>{good(prose(1, 4))} <a href='/x'>{words(1, 3)}</a> {sentence()}</div>")
            if chance(0.08):
                out.append(junk(pick("ad", "share", "more", "form", "notice", "side")))
        return "".join(out)

    def shell() -> str:
        """Classes of wrappers; some hold a word that says nothing of what is inside."""
        names = pick("wrapper", "container", "row", "col-8", "page", "layout", "grid", "inner", code(), code(), "nav-content", "menu-open", "with-sidebar", "no-sidebar", "footer-fixed", "has-comments")
        return pick("", f' class="{names}"', f' class="{names}"', f' id="{names}"', ' role="main"' if chance(0.3) else "")

    pages = []
    while len(pages) < n:
        style = pick(*["plain"] * 6, "bars", "signs", "shout", "bare")
        opaque = chance(0.2)  # classes say nothing, and few elements do
        tag = pick("div", "div", "div", "section", "main") if opaque else pick("article", "article", "article", "main", "div", "div", "td")
        names = ("article", "content", "post", "entry-content", "story", "main")
        head = "".join(junk(k) for k in ("notice", "top", "nav", "ad", "form") if chance({"nav": 0.8, "top": 0.5, "ad": 0.5}.get(k, 0.25)))
        tail = "".join(junk(k) for k in ("share", "talk", "more", "side", "ad", "form", "notice", "foot") if not (opaque and k in ("talk", "side", "notice")) and chance({"foot": 0.85, "talk": 0.4, "side": 0.4}.get(k, 0.2)))
        side = junk("side") if chance(0.25) else ""
        if chance(0.12):  # fragments that begin, or end, with the main text
            head = side = ""
        if chance(0.12):
            tail = ""
        inner = content()
        if chance(0.15) and not opaque:
            inner += junk("talk")
        if chance(0.1):
            inner = junk("share") + inner
        main = f"<{tag}{attr(*names) if tag in ('div', 'td') else ''}>{inner}</{tag}>"
        if chance(0.2):
            main = f"<main>{main}</main>"
        if tag == "td":
            main = f"<table><tr>{boxed(('sidebar', 'menu'), ('td',), links(2, 6))}{main}</tr></table>"
        page = ""
        around = int(rng.integers(0, 4)) if chance(0.5) else 0
        whole = int(rng.integers(0, around + 1))  # so many wrappers hold the whole page, the others the main part
        for k in range(around + 1):
            if k == around - whole:
                page = f"{head}{side}{page or main}{tail}"
            if k < around:
                outer = pick("div", "div", "section")
                page = f"<{outer}{shell()}>{page or main}</{outer}>"
        blocks = leaf_blocks(f"<html><head><title>{words(2, 8)}</title></head><body>{page}</body></html>")
        labels = [int(MARK in x[0]) for x in blocks]
        if any(labels):
            pages.append(([(x[0].replace(MARK, ""), x[1], x[2]) for x in blocks], labels))
    return pages


WEIGHTS = Path(__file__).with_name("extract_weights.json")


def fitted() -> Field:
    return train(labelled_pages())


def save(field: Field) -> None:
    """Writes the weights that ``default_field`` reads: ``python -m stackloom.llm.extract`` does it for ``fitted()``."""
    rounded = {f: round(w, 5) for f, w in sorted(field.weight.items())}
    WEIGHTS.write_text(json.dumps({"weight": rounded, "step": field.step, "start": field.start}, indent=0, ensure_ascii=False) + "\n", encoding="utf-8")


@cache
def default_field() -> Field:
    """The field fitted on ``labelled_pages()``, as stored; fitted anew where the file is missing."""
    return Field(**json.loads(WEIGHTS.read_text(encoding="utf-8"))) if WEIGHTS.exists() else fitted()


def extract(df: DataFrame, html: str = "html", field: Field | None = None) -> DataFrame:
    """Adds ``text``, the main text of the whole page, and ``n_chars``, its code points."""
    field = field or default_field()
    names = [c for c in df.columns if c.lower() not in ("text", "n_chars")]
    schema = T.StructType([df.schema[c] for c in names] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [field.main_text(x) for x in part.column(html).to_pylist()]
                made = [pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *made], names=schema.names)

    return df.mapInArrow(run, schema)


if __name__ == "__main__":
    save(fitted())
