"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: stretches of text between block-level tags. Each block is described by its ancestor
tags, the words of their class and id attributes and role, and its text. A two-label chain (main text or not) scores
blocks and neighbouring labels; Viterbi gives the best labelling. Weights are trained here on labelled pages, either
the caller's or a bounded set of generated ones (TRAINING_PAGES), by gradient ascent on the likelihood.

A page is one row and is read in one pass, so pages of any length and depth cost time in proportion to it: no tag is
scanned twice, closing an element costs what opening it did, and an element's features come from its parent's.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Container, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import chunks

# Tag names as HTML defines them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their contents are not text of the page.
SILENT = frozenset("script style noscript template svg iframe object head title textarea select option canvas audio video".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math annotation menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split()
)
#: A start tag of the first kind ends an open element of the second.
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",)}
#: An open element ends no further up than at one of these.
SCOPES = frozenset("table ul ol dl article section aside nav main div body td th blockquote form header footer".split())

#: Where the list above ends a search for an open element of SAME.
ANCHORS = SCOPES.union(*SAME.values())

#: A tag up to its end, which is not tried again another way.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)")
_CLASS = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class _Element:
    __slots__ = ("anchor", "marks", "tag", "up")

    def __init__(self, tag: str, marks: tuple[str, ...], up: _Element | None) -> None:
        self.tag, self.marks, self.up = tag, marks, up
        #: The nearest of the element and those above it that is one of ANCHORS, or the top.
        self.anchor: _Element = self if up is None or tag in ANCHORS else up.anchor


def _marks(attributes: str) -> tuple[str, ...]:
    """The words of class, id and role."""
    found = []
    for name, a, b, c in _CLASS.findall(attributes):
        name = name.lower()
        if name in ("hidden", "aria-hidden"):
            if (a or b or c).lower() != "false":
                found.append("hidden")
        else:
            found += _WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", a or b or c).lower())
    return tuple(found)


class Block:
    """A leaf block: its element, its text, and how much of that is in links."""

    __slots__ = ("element", "linked", "text")

    def __init__(self, element: _Element, text: str, linked: int) -> None:
        self.element, self.text, self.linked = element, text, linked


def _tokens(page: str) -> Iterator[tuple[str, bool, str, str]]:
    """(text, closing, tag, attributes): each stretch of text with the tag that follows it; the last has none ("")."""
    end, parts = 0, []
    while (at := page.find("<", end)) >= 0:
        parts.append(page[end:at])
        m = _TAG.match(page, at)
        if m:
            close = m.end() if page[m.end() : m.end() + 1] == ">" else page.find(">", at)  # a quote that never ends is none
        else:
            sign = page[at + 1 : at + 2]
            if page.startswith("<!--", at):
                close = page.find("-->", at + 4)
                end = close + 3 if close >= 0 else len(page)
                continue
            if page.startswith("<![CDATA[", at):
                close = page.find("]]>", at)
                close = close if close >= 0 else len(page)
                parts.append(html.escape(page[at + 9 : close]))
                end = min(len(page), close + 3)
                continue
            if sign not in ("!", "?") or not sign:
                parts.append("<")
                end = at + 1
                continue
            close = page.find(">", at)
        if close < 0:  # no tag ends any more
            end = at
            break
        end = close + 1
        if m:
            tag = m[2].lower()
            attributes = m[3] if m.end() == close else page[m.end(2) : close]
            yield "".join(parts), bool(m[1]), tag, attributes
            parts = []
            if tag in SILENT and not m[1] and not attributes.rstrip().endswith("/"):
                end = _skip(page, end, tag)
    yield "".join([*parts, page[end:]]), False, "", ""


def blocks_of(page: str) -> list[Block]:
    """The leaf blocks with text, in page order."""
    top = _Element("", (), None)
    at, links = top, 0
    out: list[Block] = []
    parts: list[str] = []
    opened: Counter[str] = Counter()
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append(Block(at, text, linked))
            parts.clear()
        linked = 0

    def leave(element: _Element) -> None:
        """Closes the element and all that is open in it."""
        nonlocal at
        while at is not element:
            opened[at.tag] -= 1
            at = at.up
        opened[at.tag] -= 1
        at = at.up

    for text, closing, tag, attributes in _tokens(page):
        if text:
            parts.append(text)
            if links:
                linked += len(text.strip())
        if tag in INLINE:
            if tag == "a":
                links = max(0, links - 1) if closing else links + 1
            elif tag in ("br", "img"):
                parts.append(" ")
            continue
        if tag in SILENT:
            continue
        flush()
        links = 0
        if not tag or tag in VOID:
            continue
        if closing:
            if opened[tag]:  # else nothing of that name is open
                e = at
                while e.tag != tag:
                    e = e.up
                leave(e)
            continue
        if tag in ENDS_P and at.tag == "p":
            leave(at)
        if tag in SAME and any(opened[t] for t in SAME[tag]):
            e = at.anchor
            while e.up and e.tag not in SAME[tag] and e.tag not in SCOPES:
                e = e.up.anchor
            if e.tag in SAME[tag]:
                leave(e)
                if tag == "tr" and at.tag == "tr":
                    leave(at)
        at = _Element(tag, _marks(attributes) if attributes else (), at)
        opened[tag] += 1
    return out


def _skip(page: str, at: int, tag: str) -> int:
    """Where a silent element ends; an unclosed head ends where the body begins, another with the page."""
    if tag not in _ENDS:
        _ENDS[tag] = re.compile(rf"</{tag}\b" + ("|<body\\b" if tag == "head" else ""), re.I)
    m = _ENDS[tag].search(page, at)
    if not m:
        return len(page)
    if m[0][1] != "/":
        return m.start()
    end = page.find(">", m.end())
    return end + 1 if end >= 0 else len(page)


_ENDS: dict[str, re.Pattern] = {}


def _bucket(n: float, edges: tuple) -> int:
    return sum(n >= e for e in edges)


class Paths:
    """Features of elements and all above them; only those in wanted, if that is given, so that depth adds no more than wanted has."""

    NEAR = frozenset("nav aside footer header article main section form ul ol table".split())

    def __init__(self, wanted: Container[str] | None = None) -> None:
        self.wanted = wanted
        #: By element: the features of ancestors, those of the nearest that says something, and all with the element's own.
        self.known: dict[_Element, tuple[frozenset, tuple[str, ...]]] = {}
        self.whole: dict[_Element, tuple[str, ...]] = {}

    def _keep(self, features: Iterable[str]) -> Iterator[str]:
        return (f for f in features if self.wanted is None or f in self.wanted)

    def of(self, element: _Element) -> tuple[str, ...]:
        if element not in self.whole:
            above, near = self._above(element)
            self.whole[element] = tuple(sorted({*above, *near, *self._keep([f"own {element.tag}"])}))
        return self.whole[element]

    def _above(self, element: _Element) -> tuple[frozenset, tuple[str, ...]]:
        chain, e = [], element
        while e.up and e not in self.known:
            chain.append(e)
            e = e.up
        above, near = self.known.get(e, (frozenset(), ()))
        for e in reversed(chain):
            marks = [f"mark {w}" for w in e.marks]
            own = set(self._keep(marks if e.tag in ("html", "body") else [f"in {e.tag}", *marks]))
            if not own <= above:
                above = above | own
            if e.marks or e.tag in self.NEAR:
                near = tuple(self._keep([f"near {e.tag}", *(f"near {m}" for m in marks)]))
            self.known[e] = above, near
        return above, near


def _own(block: Block, titled: bool) -> list[str]:
    """The features of a block's text, all of it."""
    text = block.text
    f = [
        f"words {_bucket(text.count(' ') + 1, (2, 4, 8, 16, 40))}",
        f"links {_bucket(block.linked / max(1, len(text)), (0.01, 0.3, 0.7))}",
        f"stop {text[-1] in '.!?:;'}",
        f"titled {titled}",
    ]
    if "©" in text:
        f.append("copyright")
    if "|" in text or "»" in text or "·" in text:
        f.append("bars")
    return f


def _described(blocks: list[Block], paths: Paths) -> Iterator[tuple[tuple[str, ...], list[str]]]:
    titled = False
    for b in blocks:
        titled = titled or b.element.tag == "h1"
        yield paths.of(b.element), _own(b, titled)


def features_of(blocks: list[Block]) -> list[list[str]]:
    """The features of each block."""
    return [[*path, *own] for path, own in _described(blocks, Paths())]


class ChainCrf:
    """A linear chain of labels 0 and 1 with binary features."""

    def __init__(self, weights: dict[str, float], steps: np.ndarray, first: np.ndarray) -> None:
        #: A feature's weight counts for label 1; steps[a][b] for b after a; first for the first label.
        self.weights, self.steps, self.first = weights, steps, first

    @classmethod
    def trained(cls, pages: list[tuple[list[list[str]], list[int]]], rounds: int = 150, rate: float = 1.0, decay: float = 1e-4) -> ChainCrf:
        """From (features, labels) of pages, by gradient ascent with momentum on all pages at once; deterministic."""
        pages = [p for p in pages if p[1]]
        names = {f: i for i, f in enumerate(sorted({f for fs, _ in pages for row in fs for f in row}))}
        longest = max((len(y) for _, y in pages), default=0)
        n = len(pages)
        label = np.full((n, longest), -1)
        rows, cols = [], []
        for i, (fs, y) in enumerate(pages):
            label[i, : len(y)] = y
            for t, row in enumerate(fs):
                for f in set(row):
                    rows.append(i * longest + t)
                    cols.append(names[f])
        rows, cols = np.array(rows, np.int64), np.array(cols, np.int64)
        real = label >= 0
        both = real[:, 1:]
        w, steps, first = np.zeros(len(names)), np.zeros((2, 2)), np.zeros(2)
        seen_steps = np.array([[(both & (label[:, :-1] == a) & (label[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)
        seen_first = np.array([(label[:, 0] == a).sum() for a in (0, 1)], float)
        seen_w = np.bincount(cols, (label.ravel()[rows] == 1).astype(float), minlength=len(names))
        count = np.bincount(cols, minlength=len(names)) + 1.0
        speed = [np.zeros_like(w), np.zeros_like(steps), np.zeros_like(first)]
        total = max(1, int(real.sum()))
        for _ in range(rounds if n else 0):
            score = np.bincount(rows, w[cols], minlength=n * longest).reshape(n, longest)
            emit = np.stack([np.zeros_like(score), score], axis=2)
            forward, backward = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
            forward[:, 0] = first + emit[:, 0]
            for t in range(1, longest):
                forward[:, t] = np.logaddexp.reduce(forward[:, t - 1, :, None] + steps, axis=1) + emit[:, t]
                forward[:, t] = np.where(real[:, t, None], forward[:, t], forward[:, t - 1])
            whole = np.logaddexp.reduce(forward[:, -1], axis=1)
            for t in range(longest - 2, -1, -1):
                back = np.logaddexp.reduce(steps + (emit[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
                backward[:, t] = np.where(real[:, t + 1, None], back, 0)
            one = np.where(real, np.exp(forward[:, :, 1] + backward[:, :, 1] - whole[:, None]), 0)
            pair = forward[:, :-1, :, None] + steps + (emit + backward)[:, 1:, None, :] - whole[:, None, None, None]
            pair = np.where(both[:, :, None, None], np.exp(pair), 0).sum(axis=(0, 1))
            begin = np.exp(forward[:, 0] + backward[:, 0] - whole[:, None]).sum(axis=0)
            slopes = [(seen_w - np.bincount(cols, one.ravel()[rows], minlength=len(names))) / np.sqrt(count * total) - decay * w, (seen_steps - pair) / total - decay * steps, (seen_first - begin) / n - decay * first]
            for x, v, g in zip((w, steps, first), speed, slopes, strict=True):
                v *= 0.9
                v += rate * g
                x += v
        return cls({f: float(np.round(w[i], 6)) for f, i in names.items()}, np.round(steps, 6), np.round(first, 6))

    def decode(self, features: list[list[str]]) -> list[int]:
        """The likeliest labels, by Viterbi; of two equal ways the one through label 1."""
        return self.viterbi([sum(self.weights.get(f, 0.0) for f in row) for row in features])

    def label(self, blocks: list[Block]) -> list[int]:
        """decode() of features_of(), each element's features being weighed once."""
        get, path_of = self.weights.get, {}
        scores = []
        for path, own in _described(blocks, Paths(self.weights)):
            if path not in path_of:
                path_of[path] = sum(get(f, 0.0) for f in path)
            scores.append(path_of[path] + sum(get(f, 0.0) for f in own))
        return self.viterbi(scores)

    def viterbi(self, scores: list[float]) -> list[int]:
        """The likeliest labels for scores of label 1."""
        if not scores:
            return []
        (s00, s01), (s10, s11) = self.steps.tolist()
        p, q = self.first.tolist()
        back = []
        for t, e in enumerate(scores):
            if t:
                from0, from1 = p + s00 > q + s10, p + s01 > q + s11
                back.append((from0, from1))
                p, q = (p + s00 if from0 else q + s10), (p + s01 if from1 else q + s11)
            q += e
        out = [int(q >= p)]
        for from0, from1 in reversed(back):
            out.append(0 if (from1 if out[-1] else from0) else 1)
        return out[::-1]


#: Pages that the built-in model is trained on.
TRAINING_PAGES = 600
_SYLLABLES = "an en er in on re th st le de la que ou ier ment ung ich ein ver los as ado ción al or ti ha wh".split()
# Names that sites give to what is not the article, and to what holds it.
ASIDE_MARKS = {
    "nav": "nav navbar navigation menu mainmenu topnav breadcrumb breadcrumbs toc pager pagination skip links sitemap".split(),
    "header": "header masthead topbar site logo brand head".split(),
    "footer": "footer bottom copyright colophon legal foot".split(),
    "aside": "sidebar side rail widget related popular trending recommended more aside teaser".split(),
    "notice": "notice cookie consent gdpr banner alert popup modal overlay disclaimer newsletter subscribe signup paywall privacy".split(),
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promoted dfp adsense adbox commercial".split(),
    "form": "form search login contact signin register".split(),
    "share": "share social follow tags buttons toolbar".split(),
    "comments": "comments comment reply replies discussion respond disqus commentlist thread feedback responses".split(),
}
MAIN_MARKS = "content main article post entry story text body page single prose blog".split()


def _generated(rng: random.Random) -> tuple[str, list[str]]:
    """A page and its main blocks in order."""
    word = lambda: "".join(rng.choices(_SYLLABLES, k=rng.randint(1, 4)))
    phrase = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    serial = iter(range(10**6))

    def sentence(a: int = 1, b: int = 40) -> str:
        # A serial number keeps blocks apart when they are compared with what was generated.
        noise = rng.choice(["", "", "", "!!", "***", "$$$", " |"])
        return f"{phrase(a, b).capitalize()}{noise} x{next(serial)}{rng.choice(['.', '.', '.', '.', '', '!', '?'])}"

    def attribute(kind: str) -> str:
        names = ASIDE_MARKS.get(kind, MAIN_MARKS)
        picked = rng.choice(names) + rng.choice(["", "", "-" + rng.choice(["box", "wrap", "list", "left", "item", "area", "container", rng.choice(names)])])
        return f' {rng.choice(["class", "class", "id"])}="{picked}"'

    def menu() -> str:
        items = "".join(f'<li><a href="/{word()}">{phrase(1, 3)}</a></li>' for _ in range(rng.randint(2, 8)))
        return f"<ul>{items}</ul>"

    def off(kind: str) -> str:
        natural = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind)
        tag = natural if natural and rng.random() < 0.6 else rng.choice(["div", "div", "section", "aside", "ul" if kind == "comments" else "div"])
        mark = attribute(kind) if tag != natural or rng.random() < 0.5 else ""
        if kind == "nav":
            inner = menu() if rng.random() < 0.8 else "".join(f'<a href="/{word()}">{phrase(1, 3)}</a> ' for _ in range(rng.randint(2, 8)))
        elif kind == "header":
            inner = rng.choice([f"<h1>{phrase(1, 4)}</h1>", f"<div>{phrase(1, 4)}</div>", f'<a href="/">{phrase(1, 3)}</a>']) + rng.choice(["", f"<p>{sentence(3, 12)}</p>", menu()])
        elif kind == "footer":
            inner = rng.choice(["&copy; ", "© 2020 ", ""]) + word() + ".example.com" + rng.choice([" &middot; ", " | ", " "]) + sentence(3, 25) + rng.choice(["", menu(), f"<p>{sentence()}</p>"])
        elif kind == "form":
            inner = f"<label>{phrase(1, 4)}</label><input name=q><p>{sentence(3, 15)}</p><button>{phrase(1, 2)}</button>"
        elif kind == "comments":
            one = rng.choice(["div", "li", "article"])
            inner = rng.choice(["", f"<h3>{phrase(1, 3)}</h3>"]) + "".join(
                f'<{one} class="{rng.choice(["comment", "reply", "comment-body"])}">{rng.choice(["", f"<b>{word()}</b>", f"<span>{word()}</span> "])}<p>{sentence(2, 40)}</p></{one}>' for _ in range(rng.randint(1, 6))
            )
        elif kind == "aside":
            inner = rng.choice(["", f"<h3>{phrase(1, 3)}</h3>"]) + rng.choice([menu(), f"<p>{sentence()}</p>", f"<div>{sentence()}</div>"])
        elif kind == "share":
            inner = "".join(f'<a href="#">{word()}</a> ' for _ in range(rng.randint(2, 5)))
        else:
            inner = rng.choice([sentence(3, 40), f"<p>{sentence(3, 40)}</p>", f'<a href="#">{sentence(2, 12)}</a>'])
        return f"<{tag}{mark}>{inner}</{tag}>"

    main: list[str] = []

    def keep(text: str) -> str:
        main.append(text)
        return html.escape(text, quote=False)

    def paragraph() -> str:
        kind = rng.random()
        if kind < 0.7:
            return rng.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p><b>{}<br>", "<p>{}", "<p class=x>{}</p>", "<div>{}</div>", "<p><a href='/x'>{}</a></p>"]).format(keep(sentence(1, 80)))
        if kind < 0.78:
            h = rng.choice(["h2", "h3", "h4"])
            return f"<{h}>{keep(sentence(1, 6))}</{h}>"
        if kind < 0.86:
            tag = rng.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{keep(sentence(1, 15))}</li>" for _ in range(rng.randint(1, 5))) + f"</{tag}>"
        if kind < 0.9:
            return f"<blockquote><p>{keep(sentence(5, 40))}</p></blockquote>"
        if kind < 0.93:
            return f"<pre>{keep(sentence(3, 20))}</pre>"
        if kind < 0.96:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{keep(sentence(1, 4))}</td>" for _ in range(2)) + "</tr>" for _ in range(2)) + "</table>"
        return f"<figure><img src=a.png><figcaption>{keep(sentence(3, 15))}</figcaption></figure>"

    def sprinkle(kinds: list[str], chance: float) -> str:
        return "".join(off(k) for k in kinds if rng.random() < chance)

    heading = f"<h1>{keep(sentence(2, 10))}</h1>"
    if rng.random() < 0.2:
        heading = f"<header>{heading}</header>"
    body = [paragraph() for _ in range(rng.randint(1, 12))]
    for k in ("ad", "aside", "form", "share", "notice", "ad"):
        if rng.random() < 0.15:
            body.insert(rng.randint(0, len(body)), "</b>" + off(k))
    inner = heading + "".join(body) + (off("comments") if rng.random() < 0.15 else "")
    holder = rng.choice(["article", "article", "article", "main", "div", "section"])
    inner = f"<{holder}{attribute('main') if holder in ('div', 'section') or rng.random() < 0.3 else ''}>{inner}</{holder}>"
    if rng.random() < 0.3:
        inner = f"<main>{inner}{sprinkle(['comments'], 0.2)}</main>"
    if rng.random() < 0.3:
        inner = f"<div{attribute('main') if rng.random() < 0.5 else ''}>{sprinkle(['aside'], 0.3)}{inner}{sprinkle(['aside', 'share'], 0.3)}</div>"
    before = sprinkle(["notice"], 0.3) + sprinkle(["header"], 0.4) + sprinkle(["nav"], 0.8) + sprinkle(["ad", "form", "aside", "notice"], 0.3)
    after = sprinkle(["share", "ad", "comments", "aside", "form", "notice"], 0.3) + sprinkle(["nav"], 0.1) + sprinkle(["footer"], 0.8)
    return f"<!DOCTYPE html><html><head><title>{phrase(1, 5)}</title><script>var a='</p>';</script></head><body>{before}{inner}{after}" + rng.choice(["</body></html>", ""]), main


def labelled_pages(n: int = TRAINING_PAGES, seed: int = 4) -> list[tuple[str, list[str]]]:
    """Generated pages with their main blocks."""
    rng = random.Random(seed)
    return [_generated(rng) for _ in range(n)]


def fit(pages: list[tuple[str, list[str]]]) -> ChainCrf:
    """A model from (html, main blocks) pairs: a leaf block is main text if the page's list has it."""
    examples = []
    for page, main in pages:
        found, held = blocks_of(page), {_SPACE.sub(" ", t).strip() for t in main}
        examples.append((features_of(found), [int(b.text in held) for b in found]))
    return ChainCrf.trained(examples)


def main_blocks(page: str, model: ChainCrf) -> list[str]:
    found = blocks_of(page)
    return [b.text for b, y in zip(found, model.label(found), strict=True) if y]


_model: list[ChainCrf] = []


def default_model() -> ChainCrf:
    if not _model:
        _model.append(fit(labelled_pages()))
    return _model[0]


def extract(pages: DataFrame, model: ChainCrf | None = None) -> DataFrame:
    """(page_id, url, text, n_chars), a row for each row of pages: the main blocks of the whole html, joined by two line feeds.

    Character references are decoded, white space in a block becomes one space and is trimmed. Null or empty html,
    and a page without main text, give an empty text. Ids and urls pass unchanged, null or not; repeated rows give
    repeated results; an empty table gives an empty one. Columns other than page_id, url and html are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())  # some hundred weights

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        for part in chunks(batches, "html", 1 << 20):
            texts = ["\n\n".join(main_blocks(h or "", crf)) for h in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kept = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return kept.mapInArrow(rows, "page_id long, url string, text string, n_chars long")
