"""Operator 3: main text of web pages by a linear-chain conditional random field over leaf blocks, decoded by Viterbi."""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .common import prepared, table
from .toxicity import marginals

#: Weights; a hashed feature has one of so many. Places of a chain in training.
SPACE, PLACES = 1 << 15, 64

# Fixed values of HTML: elements that begin a block, that have no end, whose content isn't text of the page, and that a new element of some kinds ends.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html iframe label legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template noscript head title svg math canvas audio video object iframe".split())
RAW = frozenset("script style title textarea iframe noscript".split())
ENDS_P = BLOCKS - frozenset("button label option optgroup body html caption tbody td tfoot th thead tr".split())
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set())}

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|aria-label|style|hidden|aria-hidden|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


@lru_cache(maxsize=1 << 16)
def _feature(name: str) -> int:
    return zlib.crc32(name.encode()) % (SPACE - 1) + 1


_FORM_END = re.compile(r"</form[\s/>]", re.I)
_WHOLE = re.compile(r"<(?:main|article|h1)[\s/>]|role\s*=\s*[\"']?main", re.I)


@lru_cache(maxsize=1 << 14)
def _marks(tag: str, attributes: str) -> tuple[str, ...]:
    """What an element gives its blocks: its tag, and the words in its names."""
    out = [f"tag={tag}"]
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "")
        name = name.lower()
        if name in ("hidden", "aria-hidden") and value.lower() != "false" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            out.append("hidden")
        elif name != "style":
            words = [w.lower() for w in _PART.findall(html.unescape(value))]
            out += [f"name={w}" for w in words]
    return tuple(dict.fromkeys(out))


class Element:
    __slots__ = ("block", "form", "hidden", "linked", "marks", "tag")

    def __init__(self, tag: str, own: tuple[str, ...], above: Element | None) -> None:
        self.tag = tag
        self.marks = tuple(dict.fromkeys((above.marks if above else ()) + own))
        self.hidden = tag in HIDDEN or bool(above and above.hidden)
        self.linked = tag == "a" or bool(above and above.linked)
        self.form = tag == "form" or bool(above and above.form)
        self.block = tag if tag in BLOCKS or above is None else above.block


def leaf_blocks(page: str) -> list[tuple[str, tuple[str, ...], str, float]]:
    """(text, marks of its ancestors, the block's own tag, share of its signs in links) of each block with text, in page order.

    Text of forms is left out, but for a form about a whole page: one with a main part, an article or a first heading in it. Linear in the page:
    where open tags of a name lie is kept, so no end tag looks through the stack.
    """
    stack: list[Element] = [Element("html", (), None)]
    places: dict[str, list[int]] = {}
    out: list[tuple[str, tuple[str, ...], str, float]] = []
    texts: list[str] = []
    holder: Element | None = None
    linked = total = 0

    def flush() -> None:
        nonlocal texts, holder, linked, total
        if holder is not None:
            text = " ".join("".join(texts).split())
            if text:
                out.append((text, holder.marks, stack[-1].block, linked / max(total, 1)))
        texts, holder, linked, total = [], None, 0, 0

    def add(raw: str) -> None:
        nonlocal holder, linked, total
        top = stack[-1]
        if not raw or top.hidden:
            return
        text = html.unescape(raw) if "&" in raw else raw
        n = len(text) - text.count(" ")
        if holder is None:
            if text.isspace():
                return
            holder = top
        texts.append(text)
        total += n
        if top.linked:
            linked += n

    def close(tags: set[str] | frozenset[str], stop: set[str]) -> None:
        """Closes the innermost of these tags and all within it, unless one to stop at is nearer."""
        last = lambda names: max((places[x][-1] for x in names if places.get(x)), default=0)
        i = last(tags)
        if i and i > last(stop - tags):
            while len(stack) > i:
                places[stack.pop().tag].pop()

    at = 0
    for m in _MARKUP.finditer(page):
        if m.start() < at:
            continue  # inside a script or the like
        add(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        tag, ending = tag.lower(), bool(m[1] or m[4])
        if tag == "br":
            if texts:
                texts.append(" ")
            continue
        if tag in BLOCKS:
            flush()
        if ending:
            close({tag}, set())
            continue
        if tag in ENDS_P:
            close({"p"}, {"button", "td", "th", "table", "div", "section", "article", "aside", "li", "body"} if tag != "p" else {"td", "th", "table"})
        if tag in ENDS:
            close(*ENDS[tag])
        if tag in BLOCKS and stack[-1].tag == "head":
            close({"head"}, set())
        if tag in VOID:
            continue
        stack.append(Element(tag, _marks(tag, m[3] or m[6] or ""), stack[-1]))
        places.setdefault(tag, []).append(len(stack) - 1)
        if tag == "form" and not stack[-2].form:
            end = _FORM_END.search(page, at)
            stack[-1].hidden = stack[-1].hidden or not _WHOLE.search(page, at, end.start() if end else len(page))
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            if tag == "textarea":
                add(page[at : end.start() if end else len(page)])
            at = end.start() if end else len(page)
    add(page[at:])
    flush()
    return out


_KEYWORDS = frozenset("cookie cookies privacy subscribe newsletter copyright rights reserved login register comment comments reply share advertisement sponsored terms menu search contact".split())


def block_features(blocks: list[tuple[str, tuple[str, ...], str, float]]) -> list[list[int]]:
    """Hashed features of each block: its ancestors' marks, its tag, and its text's shape and place."""
    out, heading = [], False
    for i, (text, marks, tag, links) in enumerate(blocks):
        n = text.count(" ") + 1
        names = [f"own={tag}", f"long={min(n.bit_length(), 8)}", f"links={int(links * 3.99)}", f"place={min(i, 3)}", f"heading={heading}", "sentence" if text[-1] in ".!?…" else "open"]
        if "©" in text or "·" in text or "|" in text:
            names.append("signs")
        names += [f"word={w}" for w in {w.strip(".,:;!?()").lower() for w in text.split()} & _KEYWORDS]
        heading = heading or tag == "h1"
        inside = [m for m in marks if m.startswith("tag=") and m[4:] in BLOCKS]
        out.append([_feature(x) for x in (*names, *marks, *(f"in={a[4:]}>{tag}" for a in inside[-3:]))])
    return out


# ---- labelled pages -----------------------------------------------------------------------------------------------

# How pages name their parts. Each line is one way to write the part, with {} for what is in it.
MAIN = ["<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>', '<div id="content">{}</div>', '<div class="post"><div class="entry-content">{}</div></div>', '<section class="article-body">{}</section>', '<div class="story">{}</div>', '<div role="main">{}</div>', "<main><article>{}</article></main>", '<article class="post">{}</article>', "<table><tr><td>{}</td></tr></table>", "<div>{}</div>", '<div class="text">{}</div>', "{}"]
MENUS = ["<nav>{}</nav>", '<div class="menu">{}</div>', '<ul class="nav navbar">{}</ul>', '<div id="navigation">{}</div>', '<div class="breadcrumb">{}</div>', '<div class="breadcrumbs">{}</div>', '<div role="navigation">{}</div>', '<div class="pagination">{}</div>', '<div class="share social">{}</div>', '<div class="tags">{}</div>', '<menu class="toolbar">{}</menu>', '<div class="topbar">{}</div>']
HEADERS = ["<header>{}</header>", '<div id="header">{}</div>', '<div class="masthead">{}</div>', '<div class="site-header">{}</div>', '<div class="logo">{}</div>', '<div role="banner">{}</div>']
FOOTERS = ["<footer>{}</footer>", '<div id="footer">{}</div>', '<div class="footer">{}</div>', '<div class="copyright">{}</div>', '<div class="site-footer">{}</div>', '<div class="legal disclaimer">{}</div>', '<div role="contentinfo">{}</div>']
SIDES = ["<aside>{}</aside>", '<div class="sidebar">{}</div>', '<div id="sidebar">{}</div>', '<div class="widget">{}</div>', '<div class="related">{}</div>', '<div class="right-column">{}</div>', '<section class="recommended">{}</section>', '<aside class="sidebar">{}</aside>', '<div class="teaser">{}</div>', '<div class="author-bio">{}</div>']
ADS = ['<div class="ad">{}</div>', '<div class="ads">{}</div>', '<div class="advert">{}</div>', '<div class="advertisement">{}</div>', '<div class="sponsored">{}</div>', '<div class="promo">{}</div>', '<div class="banner">{}</div>', '<div id="ad-top">{}</div>', '<section class="promotion">{}</section>', '<aside class="ad">{}</aside>', '<ins class="adsbygoogle"><div>{}</div></ins>']
NOTICES = ['<div class="notice">{}</div>', '<div class="cookie">{}</div>', '<div id="cookie-notice">{}</div>', '<div class="cookie-banner">{}</div>', '<div class="alert">{}</div>', '<div class="consent gdpr">{}</div>', '<div class="popup modal">{}</div>', '<div class="newsletter">{}</div>', '<div class="subscribe">{}</div>', '<div role="alert">{}</div>', '<div role="dialog">{}</div>', "<dialog>{}</dialog>", '<div class="warning message">{}</div>', '<div class="paywall">{}</div>', '<p class="notice">{}</p>', '<div style="display:none">{}</div>']
COMMENTS = ['<section class="comments">{}</section>', '<div id="comments">{}</div>', '<div class="comments">{}</div>', '<ol class="commentlist">{}</ol>', '<div class="comment">{}</div>', '<div class="discussion replies">{}</div>', '<div id="disqus_thread">{}</div>', '<ul class="reader-comments">{}</ul>', '<div class="responses"><div class="reply">{}</div></div>', '<section id="comments"><article class="comment">{}</article></section>']
FORMS = ["<form>{}</form>", '<form class="search">{}</form>', '<form action="/login" id="login">{}</form>', '<div class="contact-form"><form>{}</form></div>', "<form><fieldset>{}</fieldset></form>"]


def labelled_page(draw: np.random.Generator) -> tuple[str, set[str]]:
    """A page and the texts of its main blocks, which no other block of it has."""
    word = lambda: "".join(draw.choice(list("aeioulnrstmdkpgbv"), draw.integers(2, 9)))
    pick = lambda ways: ways[draw.integers(len(ways))]
    prose = lambda lo, hi: " ".join(word() for _ in range(draw.integers(lo, hi))).capitalize() + pick([".", ".", ".", "!", "?", ""])
    main: set[str] = set()

    def own(text: str) -> str:
        main.add(text)
        return text

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{word()}">{prose(1, 4)}</a></li>' for _ in range(n)) + "</ul>"

    def paragraphs(n: int) -> str:
        return "".join(f"<p>{prose(3, 40)}{pick(['</p>', ''])}" for _ in range(n))

    def other(ways: list[str]) -> str:
        body = pick([lambda: prose(2, 30), lambda: paragraphs(draw.integers(1, 4)), lambda: links(draw.integers(2, 7)), lambda: f"<h3>{prose(1, 5)}</h3>{paragraphs(1)}", lambda: f"<div>{prose(2, 25)}</div>", lambda: f"<span>{prose(1, 6)}</span> <a href='#'>{prose(1, 3)}</a>"])()
        return pick(ways).format(body)

    def form() -> str:
        return pick(FORMS).format(f"<label>{prose(1, 4)}</label><input name=q><select><option>{word()}<option>{word()}</select><textarea>{prose(1, 5)}</textarea><p>{prose(2, 12)}</p><button>{word()}</button>")

    def piece() -> str:
        kind = draw.integers(12)
        if kind == 0:
            return f"<h2>{own(prose(1, 8))}</h2>"
        if kind == 1:
            tag = pick(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{own(prose(2, 18))}</li>" for _ in range(draw.integers(2, 5))) + f"</{tag}>"
        if kind == 2:
            return f"<blockquote><p>{own(prose(4, 30))}</p></blockquote>"
        if kind == 3:
            return "<table>" + "".join(f"<tr><td>{own(prose(1, 6))}</td><td>{own(prose(1, 6))}</td></tr>" for _ in range(draw.integers(1, 4))) + "</table>"
        if kind == 4:
            return f"<div>{own(prose(3, 40))}</div>"
        if kind == 5:
            return f"<pre>{own(prose(3, 20))}</pre>"
        if kind == 6:
            return f"<figure><img src=x><figcaption>{own(prose(2, 10))}</figcaption></figure>"
        a, b, c = prose(1, 25), word(), prose(1, 25)
        return pick(["<p>{}</p>", "<p>{}", "<p class='lead'>{}</p>"]).format(own(f"{a} {b} {c}").replace(f" {b} ", pick([f" {b} ", f" <a href='/x'>{b}</a> ", f" <b>{b}</b> ", f"<br>{b}<br>"])))

    inner = pick(["<h1>{}</h1>", "<h1>{}</h1>", "<header><h1>{}</h1></header>"]).format(own(prose(1, 12))) * (draw.random() < 0.8) + "".join(piece() for _ in range(draw.integers(1, 9)))
    if draw.random() < 0.2:
        # A page of little else than a short article, or of text alone.
        main.clear()
        inner = pick(["<h1>{}</h1>", ""]).format(own(prose(1, 12))) + "".join(f"<p>{own(prose(1, 25))}</p>" for _ in range(draw.integers(1, 3)))
        if draw.random() < 0.4:
            main.clear()
            inner = pick(["{}", "{}", "<p>{}</p>"]).format(own(prose(1, 30)))
        part = pick(MAIN).format(inner)
        return pick(["{}", "<html><body>{}</body></html>", f"<!DOCTYPE html><html><head><title>{prose(1, 6)}</title></head><body>{{}}</body></html>"]).format(part), main
    for ways in (ADS, MENUS, NOTICES, SIDES):
        if draw.random() < 0.15:
            cut = [m.start() for m in re.finditer(r"<(?:h2|p|blockquote|pre|figure)[ >]", inner)]
            k = pick(cut) if cut and "<p>" in inner else len(inner)
            inner = inner[:k] + other(ways) + inner[k:]
    if draw.random() < 0.15:
        inner += other(COMMENTS)
    if draw.random() < 0.1:
        inner += form()
    before = [other(MENUS) for _ in range(draw.integers(0, 3))] + [other(HEADERS) for _ in range(draw.integers(0, 2))] + [other(ADS) for _ in range(draw.integers(0, 2))] + [other(NOTICES) for _ in range(draw.integers(0, 2))] + [form() for _ in range(draw.integers(0, 2))] + [other(SIDES) for _ in range(draw.integers(0, 2))]
    after = [other(COMMENTS) for _ in range(draw.integers(0, 2))] + [other(SIDES) for _ in range(draw.integers(0, 2))] + [other(ADS) for _ in range(draw.integers(0, 2))] + [form() for _ in range(draw.integers(0, 2))] + [other(FOOTERS) for _ in range(draw.integers(0, 2))] + [other(NOTICES) for _ in range(draw.integers(0, 2))]
    draw.shuffle(before)
    draw.shuffle(after)
    body = "".join(before) + pick(MAIN).format(inner) + "".join(after)
    return f"<!DOCTYPE html><html><head><title>{prose(1, 6)}</title></head><body>{body}</body></html>", main


@lru_cache(maxsize=1)
def field(pages: int = 1200, epochs: int = 6, rate: float = 0.2) -> tuple[np.ndarray, np.ndarray]:
    """(weights of the features, transition scores), learned from so many labelled pages by the gradient of their likelihood."""
    draw = np.random.default_rng(41)
    rows = []
    for _ in range(pages):
        page, main = labelled_page(draw)
        blocks = leaf_blocks(page)[:PLACES]
        rows.append((block_features(blocks), [float(b[0] in main) for b in blocks]))
    rows = [r for r in rows if r[0]]
    most = max(len(f) for fs, _ in rows for f in fs)
    x, y, on = np.zeros((len(rows), PLACES, most), np.int32), np.zeros((len(rows), PLACES)), np.zeros((len(rows), PLACES), bool)
    for i, (features, labels) in enumerate(rows):
        on[i, : len(labels)] = True
        y[i, : len(labels)] = labels
        for t, f in enumerate(features):
            x[i, t, : len(f)] = f
    w, gw, link, gl = np.zeros(SPACE), np.full(SPACE, 1e-4), np.zeros((2, 2)), np.full((2, 2), 1e-4)
    for _ in range(epochs):
        for k in np.array_split(draw.permutation(len(rows)), max(1, len(rows) // 32)):
            m, t = on[k], y[k]
            p, joint = marginals(np.where(m, w[x[k]].sum(2), 0.0), m, link)
            error = np.where(m, p - t, 0.0)
            g = np.bincount(x[k].ravel(), np.repeat(error.ravel(), most), SPACE) / len(k) + 1e-4 * w
            g[0] = 0
            gw += g * g
            w -= rate * g / np.sqrt(gw)
            both = m[:, 1:]
            a, b = t[:, :-1][both], t[:, 1:][both]
            real = np.array([[((1 - a) * (1 - b)).sum(), ((1 - a) * b).sum()], [(a * (1 - b)).sum(), (a * b).sum()]])
            gk = (joint - real) / len(k)
            gl += gk * gk
            link -= rate * gk / np.sqrt(gl)
    return w, link


def viterbi(emit: list[float], link: np.ndarray) -> list[bool]:
    """The most likely labels: main or not for each block."""
    (l00, l01), (l10, l11) = link.tolist()
    a, b, ways = 0.0, emit[0], []
    for e in emit[1:]:
        to_a, to_b = (a + l00, b + l10), (a + l01, b + l11)
        ways.append((to_a[1] > to_a[0], to_b[1] > to_b[0]))
        a, b = max(to_a), max(to_b) + e
    out = [b > a]
    for way in reversed(ways):
        out.append(way[out[-1]])
    return out[::-1]


def main_text(page: str | None, weights: np.ndarray, link: np.ndarray) -> str:
    """The main blocks of a page, joined by empty lines."""
    blocks = leaf_blocks(page) if page else []
    if not blocks:
        return ""
    emit = [float(weights[f].sum()) for f in block_features(blocks)]
    return "\n\n".join(b[0] for b, keep in zip(blocks, viterbi(emit, link), strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages (page_id, url, html).

    A block is what lies between the beginnings and ends of block elements; a line break is white space in it. The field
    reads each block's ancestors (tags and the words of their names) and its text's shape, and Viterbi picks the main ones.
    Null and empty pages have an empty text; pages cut off anywhere are read as far as they go; repeated rows give the
    same; an empty table gives no rows; other columns aren't kept. Whole pages are read and nothing is capped.
    """
    spark = prepared(pages.sparkSession)
    model = spark.sparkContext.broadcast(field())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, link = model.value
        for frame in frames:
            text = [main_text(page, weights, link) for page in frame["html"]]
            yield pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": text, "n_chars": [len(t) for t in text]})

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op3_html": op3_html}
ORACLES: dict[str, str] = {}
