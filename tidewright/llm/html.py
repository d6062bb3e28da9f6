"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of the DOM.

A page is cut into leaf blocks: runs of text between block-level tags. A block's features are the tags and class or id words
of its ancestors, its nearest tag, and its text's shape (length, links, sentence marks, digits). The field has two labels,
main and other; it is trained on labelled pages by gradient ascent of the conditional likelihood, and a page's labels are the
best path (Viterbi). The model is a few thousand weights, trained once on the driver and sent to the tasks.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
OPAQUE = frozenset("script style noscript template textarea title svg math iframe object canvas audio video select datalist".split())
#: Of these, what HTML reads as raw text up to the end of file if they aren't closed; of the others only the tag is skipped then.
RAW = frozenset("script style noscript textarea title iframe".split())
#: A start tag closes open elements of these names up to the nearest element that holds them.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDS = frozenset("ul ol dl table body html article section main div nav aside header footer form blockquote td th".split())
#: Block tags that close an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
#: A quote opens a value only behind '='; values may have any length and hold '>'.
_TAG = re.compile(r"""<(?:!--(?:.*?--!?>|.*\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=>)))?+)*+)>)""", re.S)
#: A tag whose quoted value never ends, which HTML reads to the end of file: it ends at the first '>' here.
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+|[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Block:
    text: str
    above: frozenset[str]
    tag: str
    linked: int


def names_of(attributes: str) -> list[str]:
    """Words of class, id and role."""
    out = []
    for m in _NAMES.finditer(attributes):
        out += _WORD.findall(_CAMEL.sub(" ", m[1] or m[2] or m[3] or "").lower())
    return out


def blocks(page: str, known: frozenset[str] | None = None) -> Iterator[Block]:
    """Leaf blocks in page order. known: the only ancestor features to keep."""
    stack: list[tuple[str, frozenset[str]]] = [("#", frozenset())]
    parts: list[str] = []
    linked, link, pos, n = 0, 0, 0, len(page)
    unclosed: set[str] = set()

    def flush() -> Block | None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        parts.clear()
        found, linked = (Block(text, stack[-1][1], stack[-1][0], linked) if text else None), 0
        return found

    def put(raw: str) -> None:
        nonlocal linked
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if link:
                linked += len(text)

    while pos < n:
        at = page.find("<", pos)
        if at < 0:
            put(page[pos:])
            break
        put(page[pos:at])
        m = _TAG.match(page, at) or _PLAIN.match(page, at)
        if not m:
            put("<")
            pos = at + 1
            continue
        pos = m.end()
        if not m[2]:
            continue
        name, closing = m[2].lower(), m[1] == "/"
        if name in INLINE:
            if name == "br":
                parts.append(" ")
            elif name == "a":
                link = 0 if closing else 1
            continue
        if name in OPAQUE and not closing:
            if (not m[3].endswith("/") or name in ("script", "style")) and name not in unclosed:
                end = re.compile(rf"</{name}\s*[^>]*>", re.I).search(page, pos)
                if end or name in RAW:
                    pos = end.end() if end else n
                else:
                    unclosed.add(name)
            continue
        if b := flush():
            yield b
        link = 0
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            continue
        gone = CLOSES.get(name, ("p",) if name in ENDS_P else ())
        if gone:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in gone:
                    del stack[i:]
                    break
                if stack[i][0] in HOLDS:
                    break
        if name not in VOID and not m[3].endswith("/"):
            own = {f"t={name}", *(f"c={w}" for w in names_of(m[3]))}
            own = own & known if known is not None else own
            up = stack[-1][1]
            stack.append((name, up if own <= up else up | own))
    if b := flush():
        yield b


def shape(b: Block) -> list[str]:
    """Text features."""
    t = b.text
    n = t.count(" ") + 1
    stops = sum(t.count(c) for c in ".!?;:,")
    size = 0 if n < 3 else 1 if n < 6 else 2 if n < 12 else 3 if n < 25 else 4 if n < 60 else 5
    links = b.linked / max(1, len(t))
    low = t.lower()
    return ["bias", f"n={b.tag}", f"w={size}", f"l={0 if links == 0 else 1 if links < 0.3 else 2 if links < 0.8 else 3}", f"s={0 if not stops else 1 if stops < n / 8 else 2}", f"e={t[-1] in '.!?'}", *(["copy"] if "©" in low or "copyright" in low else []), *(["bar"] if "|" in low or "»" in low or "·" in low else []), *(["num"] if sum(c.isdigit() for c in low) > len(low) / 4 else [])]


def features(b: Block) -> list[str]:
    return [*b.above, *shape(b)]


class ChainCrf:
    """Two labels. weights: score of 'main' against 'other' for each feature; move[i][j]: from label i to j; start."""

    def __init__(self, weights: dict[str, float], move: list[list[float]], start: float):
        self.weights, self.move, self.start = weights, move, start
        self.known = frozenset(f for f in weights if f[:2] in ("t=", "c="))

    def labels(self, page: list[Block]) -> list[bool]:
        """Viterbi."""
        w, (s00, s01), (s10, s11) = self.weights, *self.move
        if not page:
            return []
        back: list[tuple[int, int]] = []
        a = b = 0.0
        for i, x in enumerate(page):
            u = sum(w.get(f, 0.0) for f in features(x))
            if i == 0:
                a, b = 0.0, u + self.start
                continue
            p0, p1 = (0, a + s00) if a + s00 >= b + s10 else (1, b + s10), (0, a + s01) if a + s01 > b + s11 else (1, b + s11)
            back.append((p0[0], p1[0]))
            a, b = p0[1], p1[1] + u
        y = 1 if b > a else 0
        out = [y]
        for p in reversed(back):
            y = p[y]
            out.append(y)
        return [v == 1 for v in reversed(out)]

    def text(self, page: str) -> str:
        found = list(blocks(page, self.known))
        return " ".join(b.text for b, main in zip(found, self.labels(found), strict=True) if main)


def train(pages: list[tuple[list[Block], list[bool]]], rounds: int = 150, rate: float = 0.2, ridge: float = 0.002) -> ChainCrf:
    """Maximum conditional likelihood with a ridge, all pages at once (Adam)."""
    names: dict[str, int] = {}
    rows = [[[names.setdefault(f, len(names)) for f in features(b)] for b in bs] for bs, _ in pages]
    pad, width, long = len(names), max(len(r) for p in rows for r in p), max(len(p) for p in rows)
    x = np.full((len(rows), long, width), pad)
    y = np.zeros((len(rows), long), np.int64)
    real = np.zeros((len(rows), long), bool)
    for i, (p, (_, lab)) in enumerate(zip(rows, pages, strict=True)):
        for j, r in enumerate(p):
            x[i, j, : len(r)] = r
            y[i, j], real[i, j] = lab[j], True
    theta = np.zeros(pad + 1 + 5)  # weights, the padding's, four moves, the start
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        u, move, start = theta[: pad + 1][x].sum(2), theta[pad + 1 : pad + 5].reshape(2, 2), theta[-1]
        score = np.stack([np.zeros_like(u), u], 2)
        fwd, bwd = np.zeros((len(rows), long, 2)), np.zeros((len(rows), long, 2))
        fwd[:, 0] = score[:, 0] + [0, start]
        for j in range(1, long):
            step = np.logaddexp.reduce(fwd[:, j - 1, :, None] + move, axis=1) + score[:, j]
            fwd[:, j] = np.where(real[:, j, None], step, fwd[:, j - 1])
        for j in range(long - 2, -1, -1):
            step = np.logaddexp.reduce(move + (score[:, j + 1] + bwd[:, j + 1])[:, None, :], axis=2)
            bwd[:, j] = np.where(real[:, j + 1, None], step, 0)
        z = np.logaddexp.reduce(fwd[:, -1], axis=1)
        one = np.exp(fwd[:, :, 1] + bwd[:, :, 1] - z[:, None]) * real
        err = (y - one) * real
        g = np.zeros_like(theta)
        np.add.at(g, x.reshape(-1), np.repeat(err.reshape(-1), width))
        pair = np.exp(fwd[:, :-1, :, None] + move + (score[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None]) * real[:, 1:, None, None]
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:, :-1][real[:, 1:]], y[:, 1:][real[:, 1:]]), 1)
        g[pad + 1 : pad + 5] = (seen - pair.sum((0, 1))).reshape(-1)
        g[-1] = (y[:, 0] - one[:, 0]).sum()
        g[pad] = 0
        g = g / len(rows) - ridge * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return ChainCrf({f: float(theta[i]) for f, i in names.items()}, theta[pad + 1 : pad + 5].reshape(2, 2).tolist(), float(theta[-1]))


# --- labelled pages
_MAIN = ["article", "article", "article", "main", 'div class="content"', 'div id="main-content"', 'div class="post"', 'div class="entry-content"', 'div class="article-body"', 'section class="story"', 'div class="text"', 'div role="main"', "section"]
_OTHER = {
    "menu": ["nav", 'div class="menu"', 'div class="nav"', 'ul class="navbar"', 'div id="navigation"', 'div class="breadcrumb"', 'div class="pagination"', 'div class="tags"'],
    "head": ["header", 'div class="header"', 'div id="masthead"', 'div class="topbar"', 'div class="site-header"'],
    "foot": ["footer", 'div class="footer"', 'div id="footer"', 'div class="copyright"', 'div class="site-footer"'],
    "side": ["aside", 'div class="sidebar"', 'div id="sidebar"', 'aside class="widget"', 'div class="related"', 'div class="recommended"', 'section class="related-posts"', 'div class="trending"'],
    "ad": ['div class="ad"', 'div class="ads"', 'div class="advert"', 'div class="advertisement"', 'div class="sponsored"', 'div class="promo"', 'div class="banner"', 'section class="ad-slot"', 'p class="ad"'],
    "notice": ['div class="cookie-notice"', 'div class="notice"', 'div id="cookies"', 'div class="consent"', 'div class="alert"', 'div class="popup"', 'div class="newsletter"', 'div class="disclaimer"', 'div class="gdpr-banner"', 'div role="alert"'],
    "form": ["form", 'form class="search"', 'form class="login"', 'form class="subscribe"', 'div class="contact-form"', 'form class="signup"'],
    "comments": ['section class="comments"', 'div id="comments"', 'div class="comment-list"', 'ol class="comments"', 'section id="reader-comments"', 'div class="responses"', 'div class="discussion"'],
    "share": ['div class="share"', 'div class="social"', 'div class="author-bio"', 'div class="meta"', 'div class="byline"'],
}


def labelled_pages(count: int = 320, seed: int = 11) -> list[tuple[list[Block], list[bool]]]:
    """Pages of many layouts with invented words; a text that begins with a mark is main."""
    rnd = random.Random(seed)
    parts = ["an en in re th sh he ti on er".split(), "der die ung lich keit ver be sch ei au".split(), "que les eau tion pa oi ment re ai un".split(), "cion os ar la do mi es que ado ta".split()]

    def words(n: int, pool: list[str]) -> str:
        out = []
        for i in range(n):
            w = "".join(rnd.choice(pool) for _ in range(rnd.randint(1, 4)))
            out.append((w.capitalize() if i == 0 or out[-1][-1] == "." else w) + ("." if rnd.random() < 0.08 else "," if rnd.random() < 0.06 else ""))
        return " ".join(out)

    pages = []
    for _ in range(count):
        pool = rnd.choice(parts)
        sent = lambda a, b: words(rnd.randint(a, b), pool) + rnd.choice(["", ".", "."])  # noqa: B023, E731
        para = lambda m="": f"<p>{rnd.choice(['', '', '<b>', '<a href=x>' + m + 'x</a> ', '<em>'])}{m}{sent(4, 90)}{rnd.choice(['</p>', '</p>', '', '<br>'])}"  # noqa: B023, E731
        link = lambda: f'<a href="/x">{sent(1, 5)}</a>'

        def other(kind: str) -> str:
            tag = rnd.choice(_OTHER[kind])
            name = tag.split()[0]
            item = lambda: f"<li>{link()}</li>"
            if kind == "menu":
                inner = "".join(item() for _ in range(rnd.randint(2, 7)))
                inner = inner if name == "ul" else f"<ul>{inner}</ul>" if rnd.random() < 0.8 else " | ".join(link() for _ in range(4))
            elif kind == "head":
                inner = rnd.choice([f"<h1>{sent(1, 4)}</h1>", f"<a href=/>{sent(1, 3)}</a>", f"<div>{sent(2, 8)}</div><p>{sent(3, 14)}</p>"])
            elif kind == "foot":
                inner = rnd.choice([f"&copy; {sent(2, 14)}", f"<p>&copy; 2024 {sent(2, 20)}</p>", f"{sent(3, 25)} &middot; {sent(2, 9)}", "".join(f"<a href=x>{sent(1, 3)}</a> | " for _ in range(3))])
            elif kind == "form":
                inner = f"<label>{sent(1, 4)}</label><input name=q><button>{sent(1, 2)}</button>" + rnd.choice(["", f"<p>{sent(3, 30)}</p>", f"<div>{sent(2, 9)}</div>"])
            elif kind == "comments":
                inner = f"<h3>{sent(1, 3)}</h3>" * rnd.randint(0, 1) + "".join(rnd.choice(["<li>%s</li>", "<p>%s</p>", '<div class="comment"><p>%s</p></div>', "<div>%s</div>"]) % sent(4, 60) for _ in range(rnd.randint(1, 5)))
            elif kind == "side":
                inner = f"<h3>{sent(1, 3)}</h3>" * rnd.randint(0, 1) + rnd.choice([f"<p>{sent(4, 50)}</p>" * rnd.randint(1, 2), "<ul>" + "".join(item() for _ in range(4)) + "</ul>", sent(4, 40)])
            else:
                inner = rnd.choice([sent(3, 30), f"<p>{sent(3, 40)}</p>", f"<span>{sent(2, 12)}</span> {link()}", sent(2, 10) + f"<button>{sent(1, 2)}</button>"])
            return f"<{tag}>{inner}</{name}>"

        mark = "␂"
        body = []
        if rnd.random() < 0.85:
            body.append(f"<h{rnd.choice('1112')}>{mark}{sent(3, 14)}</h1>".replace("</h1>", "</h1>"))
        for _ in range(rnd.randint(1, 9)):
            k = rnd.random()
            if k < 0.74:
                body.append(para(mark))
            elif k < 0.8:
                body.append(f"<h2>{mark}{sent(1, 8)}</h2>")
            elif k < 0.86:
                body.append("<ul>" + "".join(f"<li>{mark}{sent(2, 20)}</li>" for _ in range(3)) + "</ul>")
            elif k < 0.9:
                body.append(rnd.choice([f"<blockquote><p>{mark}{sent(5, 40)}</p></blockquote>", f"<figure><figcaption>{mark}{sent(3, 12)}</figcaption></figure>", f"<pre>{mark}{sent(3, 20)}</pre>", f"<table><tr><td>{mark}{sent(1, 4)}<td>{mark}{sent(1, 4)}</table>"]))
            else:
                body.append("</p>" + other(rnd.choice(["ad", "side", "share", "notice"])))
        tag = rnd.choice(_MAIN)
        wrap = f"<{tag}>{''.join(body)}</{tag.split()[0]}>"
        if rnd.random() < 0.3:
            wrap = f'<div class="{rnd.choice(["container", "wrapper", "page", "row", "col"])}">{wrap}'
        top = [other(k) for k in rnd.sample(["menu", "head", "ad", "notice", "form", "menu", "share"], rnd.randint(1, 4))]
        end = [other(k) for k in rnd.sample(["side", "comments", "ad", "foot", "form", "share", "notice", "comments"], rnd.randint(0, 4))]
        if rnd.random() < 0.8:
            end.append(other("foot"))
        page = f"<html><head><title>x</title></head><body>{''.join(top)}<!-- x -->{wrap}{''.join(end)}" + rnd.choice(["</body></html>", ""])
        found = list(blocks(page))
        labels = [mark in b.text for b in found]
        for b in found:
            b.text = b.text.replace(mark, "")
        pages.append((found, labels))
    return [p for p in pages if p[0]]


def model() -> ChainCrf:
    """The field trained on the labelled pages; the same every time."""
    return train(labelled_pages())


def extract(pages: DataFrame, crf: ChainCrf | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every row; one pass, no shuffle.

    Null or empty html, and pages without main blocks, give an empty text; repeated rows are read each; a null url stays null.
    """
    crf = crf or model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [crf.text(h.as_py() or "") for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
