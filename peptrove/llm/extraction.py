"""Main-text extraction: a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks: runs of text between block-level tags, each
with its ancestors' names and class words.  Features of a block are its
ancestors, what their class and id words hint at, and its own text (length,
share of link text, punctuation, place in the page).  A two-label chain
(main text or not), trained by maximum likelihood with forward-backward on
labelled pages, is decoded by Viterbi; the blocks labelled main are the text.

Labelled pages are a parameter.  The default ones are written by
``labelled_pages``: articles inside menus, adverts, sidebars, notices, forms,
footers and reader comments, in semantic and in class-named mark-up, with
unclosed tags, in made-up words so that no vocabulary is learnt.

A page is read in one pass whose time is in proportion to its length, whatever
its mark-up.

Defined cases: null or empty html, and pages without text, give the empty
text; unclosed and unmatched tags are closed where HTML closes them; an
unclosed script or comment reaches to the end; a tag without its end is text,
and one with a quote that never closes ends at the next ``>``; repeated rows
each get a row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import extended, lean, slices, table, texts_of

#: elements that don't break a block
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: their content is no text of the page
RAW = frozenset("script style noscript template textarea svg math iframe object select".split())
#: a start tag that ends an open element of these names
ENDS = {
    "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}, "body": {"head", "title"},
} | {t: {"p"} for t in "p div h1 h2 h3 h4 h5 h6 ul ol dl table section article aside nav header footer main form blockquote pre figure address fieldset hr details".split()}
#: elements that an implied end may close; head and title end with body
IMPLIED = frozenset().union(*ENDS.values()) - {"head", "title"}
#: an implied end goes no further up than these
SCOPE = frozenset("table ul ol dl div section article aside nav header footer main form body html td th blockquote".split())
TAGS = "head title nav header footer aside article main section form ul ol dl li table td p h1 h2 h3 h4 h5 h6 div blockquote pre figure figcaption button address details body dialog".split()
#: groups of words in class and id attributes
HINTS = {
    "ad": "ad ads adv advert advertisement adverts adbox adslot banner sponsor sponsored promo promotion outbrain taboola",
    "nav": "nav navigation menu menubar breadcrumb breadcrumbs navbar pagination pager toc topbar tabs",
    "comment": "comment comments reply replies disqus respond discussion commentlist",
    "side": "sidebar side aside widget widgets related recommended recommendations trending popular more rail",
    "foot": "footer foot copyright legal colophon bottom imprint",
    "head": "header masthead logo branding hero top",
    "notice": "cookie cookies notice consent alert popup modal overlay newsletter subscribe subscription signup banner gdpr paywall login",
    "share": "share sharing social follow tags meta byline author date",
    "main": "content article post entry main body story text maincontent articlebody postcontent entrycontent",
}
HINT_OF = {w: k for k, ws in HINTS.items() for w in ws.split()}
TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
SPECIAL = re.compile("[>\"']")
MARKS = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
SIZES = (1, 3, 6, 12, 25, 50, 100)
NAMES = (
    [f"in:{t}" for t in TAGS] + [f"leaf:{t}" for t in TAGS] + [f"hint:{h}" for h in HINTS] + [f"words<{n}" for n in SIZES] + ["words+"]
    + ["links0", "links<.3", "links<.8", "links+", "stop", "commas", "sign", "digits", "first", "early", "late", "last", "bias"]
)
PLACE = {n: i for i, n in enumerate(NAMES)}


def marks(attributes: str) -> frozenset[str]:
    """The hint groups of an element's class, id and role words."""
    if "class" not in attributes and "id" not in attributes and "role" not in attributes and "=" not in attributes:
        return frozenset()
    found = set()
    for m in MARKS.findall(attributes):
        for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", "".join(m)).lower()):
            if w in HINT_OF:
                found.add(HINT_OF[w])
    return frozenset(found)


class Block(NamedTuple):
    """A leaf block: its text, the names in TAGS and the hints of its ancestors, the innermost name, characters of link text."""

    text: str
    names: frozenset[str]
    leaf: str
    hints: frozenset[str]
    link: int


def tag_end(page: str, at: int, failed: set[int]) -> int:
    """Where the ``>`` is that ends the attributes from ``at``, quoted ones passed over; the next ``>`` if
    a quote never closes. ``failed`` holds the quotes from which that was found, so none is followed twice."""
    p, passed = at, []
    while (m := SPECIAL.search(page, p)) is not None and m.start() not in failed:
        q = m.start()
        if page[q] == ">":
            return q
        passed.append(q)
        p = page.find(page[q], q + 1) + 1
        if not p:
            break
    failed.update(passed)
    return page.find(">", at)


def tokens(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text before, name, closing, attributes) of each tag in one pass; comments have an empty name, as has the end."""
    last, at, failed, begin = page.rfind(">"), 0, set(), 0
    while (i := page.find("<", at)) >= 0:
        name, closing, attributes = "", False, ""
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            end = end + 3 if end >= 0 else len(page)
        elif page.startswith("<![CDATA[", i):
            end = page.find("]]>", i + 9)
            end = end + 3 if end >= 0 else len(page)
        elif i > last:  # no tag ends any more, but a comment that doesn't may begin
            at = i + 1
            continue
        elif page.startswith(("<!", "<?"), i):
            end = page.find(">", i + 2) + 1
        elif m := TAG.match(page, i + 1):
            end = tag_end(page, m.end(), failed) + 1
            name, closing, attributes = m[2].lower(), bool(m[1]), page[m.end() : end - 1]
        else:
            at = i + 1
            continue
        end = end if end > i else len(page)
        if name in RAW and not closing and not attributes.endswith("/"):
            m = re.compile(rf"</{name}\b", re.I).search(page, end)
            end = page.find(">", m.end()) + 1 if m else 0
            end = end or len(page)
        yield page[begin:i], name, closing, attributes
        begin = at = end
    yield page[begin:], "", False, ""


class Ancestors:
    """The open elements. Counts of their names and hints are kept, so that a block costs the same at any depth."""

    def __init__(self):
        self.stack: list[tuple[str, frozenset[str]]] = []
        self.names: Counter[str] = Counter()
        self.hints: Counter[str] = Counter()
        self.bounds: list[int] = []  # places of elements that an implied end looks at

    def push(self, name: str, hints: frozenset[str]) -> None:
        if name in SCOPE or name in IMPLIED:
            self.bounds.append(len(self.stack))
        self.stack.append((name, hints))
        self.names[name] += 1
        self.hints.update(hints)

    def cut(self, k: int) -> None:
        """Ends all elements from the k-th on."""
        while len(self.stack) > k:
            name, hints = self.stack.pop()
            self.names[name] -= 1
            if not self.names[name]:
                del self.names[name]
            self.hints.subtract(hints)
        while self.bounds and self.bounds[-1] >= k:
            self.bounds.pop()

    def close(self, names: set[str]) -> None:
        """Ends the innermost element of these names, if one is open."""
        if any(n in self.names for n in names):
            k = len(self.stack) - 1
            while self.stack[k][0] not in names:
                k -= 1
            self.cut(k)

    def imply(self, name: str) -> None:
        """Ends what a start tag of this name ends."""
        if name == "body":
            self.close(ENDS[name])
            return
        for k in reversed(self.bounds):
            if self.stack[k][0] in ENDS[name]:
                self.cut(k)
                return
            if self.stack[k][0] in SCOPE:
                return


def blocks(page: str) -> list[Block]:
    """Leaf blocks in order."""
    out: list[Block] = []
    open_ = Ancestors()
    parts: list[str] = []
    in_link, chars = False, 0

    def flush() -> None:
        nonlocal chars
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                names, hints = frozenset(t for t in TAGS if t in open_.names), frozenset(h for h, n in open_.hints.items() if n)
                out.append(Block(text, names, open_.stack[-1][0] if open_.stack else "", hints, min(chars, len(text))))
            parts.clear()
            chars = 0

    for text, name, closing, attributes in tokens(page):
        if text:
            parts.append(text)
            chars += len(text) * in_link
        if not name:
            continue
        if name in RAW:
            if name not in ("svg", "math"):
                parts.append(" ")
        elif name in INLINE:
            if name == "a":
                in_link = not closing
        elif name == "br":
            parts.append(" ")
        elif closing:
            flush()
            in_link = False
            open_.close({name})
        else:
            flush()
            if name in ENDS:
                open_.imply(name)
            if name not in VOID:
                open_.push(name, marks(attributes))
    flush()
    return out


def features(page_blocks: list) -> np.ndarray:
    """A row of 0 and 1 for each block."""
    x = np.zeros((len(page_blocks), len(NAMES)), np.float32)
    n = len(page_blocks)
    for i, (text, names, leaf, hints, link) in enumerate(page_blocks):
        on = [f"in:{t}" for t in names] + [f"hint:{h}" for h in hints] + [f"leaf:{leaf}"]
        words = text.count(" ") + 1
        size = next((f"words<{k}" for k in SIZES if words < k), "words+")
        share = link / max(1, len(text))
        on += [size, "links0" if not link else "links<.3" if share < 0.3 else "links<.8" if share < 0.8 else "links+", "bias"]
        if text[-1] in ".!?:\"”»…。":
            on.append("stop")
        if "," in text:
            on.append("commas")
        if "©" in text or "(c)" in text:
            on.append("sign")
        if sum(c.isdigit() for c in text[:200]) * 4 > len(text[:200]):
            on.append("digits")
        if i == 0:
            on.append("first")
        if i == n - 1:
            on.append("last")
        on.append("early" if i * 2 < n else "late")
        for f in on:
            if f in PLACE:
                x[i, PLACE[f]] = 1
    return x


def batches_of(order: list[int], sizes: list[int], most: int = 1 << 14) -> Iterator[list[int]]:
    """Pages of rising sizes together, as many as ``most`` blocks hold when all are as long as the last; one at least."""
    own: list[int] = []
    for i in order:
        if own and (len(own) + 1) * sizes[i] > most:
            yield own
            own = []
        own.append(i)
    if own:
        yield own


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max([1, *map(len, pages)])
    x = np.zeros((len(pages), longest, len(NAMES)), np.float32)
    there = np.zeros((len(pages), longest), bool)
    for i, p in enumerate(pages):
        x[i, : len(p)], there[i, : len(p)] = p, True
    return x, there


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


class Chain:
    """Weights of the label main, transitions and start; label 0 has emission 0."""

    def __init__(self, weights: np.ndarray, move: np.ndarray, start: np.ndarray):
        self.weights, self.move, self.start = weights, move, start

    def emissions(self, x: np.ndarray) -> np.ndarray:
        y = x @ self.weights
        return np.stack([np.zeros_like(y), y], -1)

    def decode(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi: the most probable labels of each page."""
        out: list = [np.zeros(0, np.int64)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if len(p)), key=lambda i: len(pages[i]))
        for own in batches_of(order, [len(p) for p in pages]):
            x, there = padded([pages[i] for i in own])
            e = self.emissions(x)
            best, back = self.start + e[:, 0], []
            for t in range(1, x.shape[1]):
                step = best[:, :, None] + self.move
                from_ = step.argmax(1)
                new = step.max(1) + e[:, t]
                back.append(np.where(there[:, t, None], from_, np.arange(2)))
                best = np.where(there[:, t, None], new, best)
            label = best.argmax(1)
            labels = [label]
            for from_ in reversed(back):
                label = from_[np.arange(len(own)), label]
                labels.append(label)
            path = np.stack(labels[::-1], 1)
            for k, i in enumerate(own):
                out[i] = path[k, : len(pages[i])]
        return out


def train(pages: list[tuple[np.ndarray, np.ndarray]], steps: int = 250, rate: float = 0.1, ridge: float = 1e-3) -> Chain:
    """Maximum likelihood by forward-backward; pages are (features, labels)."""
    pages = [p for p in pages if len(p[0])]
    chain = Chain(np.zeros(len(NAMES)), np.zeros((2, 2)), np.zeros(2))
    if not pages:
        return chain
    x, there = padded([p for p, _ in pages])
    x = x.astype(np.float64)
    y = np.zeros(there.shape, np.int64)
    for i, (_, labels) in enumerate(pages):
        y[i, : len(labels)] = labels
    n, longest = there.shape
    moved = there[:, 1:]
    seen_move = np.zeros((2, 2))
    np.add.at(seen_move, (y[:, :-1][moved], y[:, 1:][moved]), 1)
    seen_start = np.bincount(y[:, 0], minlength=2).astype(float)
    seen = np.einsum("nt,ntf->f", y * there, x)
    theta = np.zeros(len(NAMES) + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        chain = Chain(theta[: len(NAMES)], theta[len(NAMES) : -2].reshape(2, 2), theta[-2:])
        e = chain.emissions(x)
        a, b = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        a[:, 0] = chain.start + e[:, 0]
        for t in range(1, longest):
            a[:, t] = np.where(there[:, t, None], log_sum(a[:, t - 1, :, None] + chain.move, 1) + e[:, t], a[:, t - 1])
        for t in range(longest - 2, -1, -1):
            b[:, t] = np.where(there[:, t + 1, None], log_sum(chain.move + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2), 0)
        z = log_sum(a[:, -1], 1)
        p = np.exp(a + b - z[:, None, None])
        pair = np.exp(a[:, :-1, :, None] + chain.move + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]) * moved[:, :, None, None]
        expected = np.einsum("nt,ntf->f", p[:, :, 1] * there, x)
        g = np.concatenate([expected - seen, (pair.sum((0, 1)) - seen_move).ravel(), p[:, 0].sum(0) - seen_start]) / n + ridge * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Chain(theta[: len(NAMES)], theta[len(NAMES) : -2].reshape(2, 2), theta[-2:])


SYLLABLES = "ba re ti on la mu ske dor vi en sa lo pri tem un ko ga fe ris to ne mi".split()


def labelled_pages(n: int, seed: int = 11) -> list[tuple[str, list[str]]]:
    """Pages and the texts of their main blocks, in order."""
    rng = random.Random(seed)

    def word() -> str:
        return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))

    def words(lo: int, hi: int) -> str:
        return " ".join(word() for _ in range(rng.randint(lo, hi)))

    def sentence(lo: int = 4, hi: int = 18) -> str:
        s = words(lo, hi).capitalize()
        return s.replace(" ", ", ", 1) + "." if rng.random() < 0.4 else s + rng.choice([".", ".", ".", "?", "!", ""])

    def paragraph() -> str:
        return " ".join(sentence() for _ in range(rng.choice([1, 1, 2, 3, 5, 8])))

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(k))

    def pick(*options: str) -> str:
        return rng.choice(options)

    def junk(kind: str) -> str:
        text = paragraph()
        return {
            "nav": pick(f"<nav><ul>{links(rng.randint(3, 9))}</ul></nav>", f'<div class="{pick("menu", "navbar", "main-navigation", "breadcrumbs")}"><ul>{links(5)}</ul></div>', f'<ul id="menu">{links(6)}</ul>', f'<div role="navigation"><a href="/">{word()}</a> | <a href="/x">{word()}</a></div>'),
            "header": pick(f"<header><h1>{words(1, 3)}</h1><p>{sentence()}</p></header>", f'<div id="header"><div class="logo">{words(1, 3)}</div></div>', f'<header class="site-header"><a href="/">{words(1, 2)}</a></header>'),
            "ad": f'<div class="{pick("ad", "ads", "advert", "ad-banner", "sponsored", "promo-box")}">{pick(text, f"<p>{text}</p>", f"<a href=x>{sentence()}</a>")}</div>',
            "side": pick(f'<aside>{pick("", f"<h3>{words(1, 3)}</h3>")}<p>{text}</p></aside>', f'<div class="{pick("sidebar", "widget", "related-posts", "right-sidebar")}"><h3>{words(1, 3)}</h3><ul>{links(4)}</ul><p>{sentence()}</p></div>', f"<aside><ul>{links(4)}</ul></aside>"),
            "notice": pick(f'<div class="{pick("cookie-notice", "alert", "newsletter-popup", "consent-banner", "notice", "paywall")}"><p>{text}</p><button>{word()}</button></div>', f'<section id="newsletter"><h2>{words(1, 3)}</h2><p>{sentence()}</p></section>', f'<dialog class="modal"><p>{text}</p></dialog>', f'<p class="notice">{text}</p>'),
            "form": pick(f'<form action="/s"><p>{sentence()}</p><label>{word()}</label><input name="q"><button>{word()}</button></form>', f'<form class="search"><input><button>{words(1, 2)}</button></form>'),
            "foot": pick(f"<footer>&copy; {word()} &middot; {text}</footer>", f"<footer><p>{sentence()}</p><ul>{links(3)}</ul></footer>", f'<div id="footer"><p>&copy; 2020 {words(2, 6)}.</p></div>', f'<div class="copyright">{sentence()}</div>'),
            "comments": pick(
                f'<div class="{pick("comments", "comment-list", "reader-comments")}"><h3>{words(1, 2)}</h3>' + "".join(f'<div class="comment"><b>{word()}</b><p>{paragraph()}</p></div>' for _ in range(rng.randint(1, 4))) + "</div>",
                '<section id="comments"><h2>' + words(1, 2) + "</h2><ol>" + "".join(f"<li><article><p>{paragraph()}</p></article></li>" for _ in range(rng.randint(1, 3))) + "</ol></section>",
                f'<ul class="comments">{"".join(f"<li>{paragraph()}</li>" for _ in range(3))}</ul>',
            ),
            "share": f'<div class="{pick("share", "social", "post-meta")}"><a href="#">{word()}</a> <a href="#">{word()}</a></div>',
        }[kind]

    out = []
    for _ in range(n):
        main: list[str] = []

        def block(tag: str, text: str, main=main) -> str:
            main.append(" ".join(text.split()))
            if rng.random() < 0.15:
                head, _, tail = text.partition(" ")
                text = f"<{pick('b', 'em', 'span')}>{head}</{pick('b', 'em', 'span')}> {tail}" if rng.random() < 0.6 else f'<a href="/x">{head}</a> {tail}'
            if tag == "p" and rng.random() < 0.1:
                return f"<p><b>{text}<br>"
            return f"<{tag}>{text}" if tag in ("p", "li") and rng.random() < 0.1 else f"<{tag}>{text}</{tag}>"

        body = [block("h1", pick(words(2, 8), sentence()))] if rng.random() < 0.9 else []
        for _ in range(rng.choice([1, 2, 4, 7, 12, 20])):
            kind = rng.random()
            if kind < 0.7:
                body.append(block("p", paragraph()))
            elif kind < 0.78:
                body.append(block(pick("h2", "h3"), words(1, 6)))
            elif kind < 0.84:
                body.append(f"<{(t := pick('ul', 'ol'))}>" + "".join(block("li", pick(words(1, 4), sentence())) for _ in range(rng.randint(2, 4))) + f"</{t}>")
            elif kind < 0.88:
                body.append("<blockquote>" + block("p", paragraph()) + "</blockquote>")
            elif kind < 0.91:
                body.append("<table><tr>" + block("td", words(1, 3)) + block("td", words(1, 3)) + "</tr></table>")
            elif kind < 0.93:
                body.append(block("pre", words(3, 9)))
            else:
                body.append(junk(pick("ad", "ad", "share", "notice", "form")))
        shell = rng.random()
        inner = "".join(body)
        if shell < 0.45:
            inner = f"<article>{inner}</article>"
        elif shell < 0.6:
            inner = f"<main>{inner}</main>"
        elif shell < 0.7:
            inner = f"<main><article>{inner}</article></main>"
        elif shell < 0.95:
            inner = f'<div {pick("class", "id")}="{pick("content", "post-content", "article-body", "entry-content", "main", "story")}">{inner}</div>'
        bare = rng.random() < 0.15
        before = [junk(k) for k in ("nav", "header", "notice", "ad", "form", "nav") if rng.random() < 0.45]
        after = [junk(k) for k in ("share", "ad", "comments", "side", "form", "notice", "foot") if rng.random() < 0.45]
        if rng.random() < 0.5:
            before.append(junk("side")) if rng.random() < 0.4 else after.insert(0, junk("side"))
        if bare:  # an article on its own
            before, after = [], []
        title = "" if rng.random() < 0.2 else f"<title>{main[0] if main and rng.random() < 0.7 else words(2, 6)}</title>"
        script = pick("", '<script>var t="</p>";go(0);</script>', "<style>p{margin:0}</style>")
        end = pick("</body></html>", "")
        page = f'<!DOCTYPE html><html lang="{pick("en", "de", "fr")}"><head><meta charset="utf-8">{title}{script}</head><body>{"".join(before)}<!-- {word()} -->{inner}{"".join(after)}{end}'
        out.append((page, main))
    return out


def labels_of(page_blocks: list, main: list[str]) -> np.ndarray:
    """1 for the blocks that are the main texts, matched in order."""
    out, k = np.zeros(len(page_blocks), np.int64), 0
    for i, block in enumerate(page_blocks):
        if k < len(main) and block.text == main[k] and "title" not in block.names:
            out[i], k = 1, k + 1
    return out


_MODEL: dict[tuple, Chain] = {}


def default_model(pages: int = 400, seed: int = 11) -> Chain:
    if (pages, seed) not in _MODEL:
        rows = []
        for page, main in labelled_pages(pages, seed):
            own = blocks(page)
            rows.append((features(own), labels_of(own, main)))
        _MODEL[pages, seed] = train(rows)
    return _MODEL[pages, seed]


def main_texts(pages: list[str], model: Chain) -> list[str]:
    read = [blocks(p) for p in pages]
    labels = model.decode([features(b) for b in read])
    return ["\n\n".join(b.text for b, y in zip(own, path, strict=True) if y) for own, path in zip(read, labels, strict=True)]


def extract(pages: DataFrame, keep: list[str], html_col: str = "html", model: Chain | None = None) -> DataFrame:
    """Columns ``keep`` and the main text of every page."""
    sent = pages.sparkSession.sparkContext.broadcast(model or default_model())
    kept = pages.select(*keep).schema
    name = "__html"

    def run(batches):
        for batch in slices(batches, name):
            texts = main_texts([p.decode("utf-8", "replace") for p in texts_of(batch, name)], sent.value)
            out = {f.name: batch.column(i) for i, f in enumerate(batch.schema) if f.name in kept.names}
            yield pa.RecordBatch.from_pydict(out | {"text": pa.array(texts, pa.string())})

    return pages.select(*keep, F.col(html_col).alias(name)).mapInArrow(lean(run), extended(kept, "text string"))


def op8_linear_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), ["page_id", "url"]).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
