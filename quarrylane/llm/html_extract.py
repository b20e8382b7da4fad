"""Main text of web pages: flat text blocks, classified by a decision tree.

A page becomes a flat list of text blocks. A block is described by its words and link density, those of its neighbours,
and by what surrounds it (kinds of containers, hints in class, id and role). A small table of labelled blocks, written
from page patterns, trains one decision tree; blocks that it calls main are joined in page order.

Defined cases: null or empty html gives an empty text; text with no markup is one block; unclosed tags, quotes and
comments never fail, and the time for a page is in proportion to its length; repeated rows give equal results; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
QUOTE_OR_END = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|style|hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
#: Tags inside a line of text; all others end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose content is no text of the page.
SKIPPED = frozenset("script style noscript template title textarea select svg math iframe object canvas audio video head".split())
#: Containers whose opening and closing is tracked.
CONTAINERS = frozenset("html body div section article main nav header footer aside form menu dialog ul ol dl table figure details fieldset button".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BAD_TAGS = frozenset("nav header footer aside form menu dialog button fieldset".split())
#: Words in class, id or role that name what is not main text.
BAD_WORDS = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside
nav navbar navigation menu header masthead footer comment comments commentlist respond discussion disqus cookie cookies consent gdpr notice
notices notification alert popup modal overlay dialog newsletter subscribe subscription signup login share sharing social related recommended
breadcrumb breadcrumbs pagination pager widget toolbar topbar dropdown search form copyright disclaimer skip contentinfo complementary replies reply feedback""".split())
#: The same inside longer words.
BAD_PARTS = re.compile(r"sidebar|comments?|cookies?|advert|adsby|footer|navbar|navigation|menu|newsletter|sponsor")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
GOOD_WORDS = frozenset("content article post entry story text main body".split())
WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
#: Zeros before a number in a character reference, and numbers of no character.
ZEROS, TOO_LARGE = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[1-9][0-9]{7,};?")
FEATURES = ("bad_tag", "bad_hint", "in_main", "page_has_main", "good_hint", "heading", "words", "link_density", "words_before", "links_before", "words_after", "links_after")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    bad_tag: bool
    bad_hint: bool
    in_main: bool
    good_hint: bool
    heading: bool


def decoded(text: str) -> str:
    """text without character references; numbers of any length are read."""
    return html.unescape(TOO_LARGE.sub("\ufffd", ZEROS.sub("&#", text))) if "&" in text else text


@dataclass
class Mark:
    """A tag, comment, declaration or CDATA section from start to stop."""

    start: int
    stop: int
    name: str = ""
    closing: bool = False
    attributes: str = ""
    text: str = ""


class Marks:
    """The marks of a page in order, in time proportional to its length.

    A tag ends at the first ``>`` outside quotes, or at the first one where its quotes do not close. Quotes from which no end
    can be reached are noted, so no stretch is searched in vain again; a ``<`` behind the last ``>`` is text.
    """

    def __init__(self, page: str) -> None:
        self.page, self.last, self.last_section, self.open_quotes = page, page.rfind(">"), page.rfind("]]>"), set()

    def end(self, at: int) -> int:
        """Where the ``>`` is that ends a tag whose attributes begin at ``at``; -1 if its quotes do not close."""
        quotes: list[int] = []
        while (m := QUOTE_OR_END.search(self.page, at)) and m[0] != ">":
            quotes.append(m.start())
            close = -1 if m.start() in self.open_quotes else self.page.find(m[0], m.end())
            if close < 0:
                m = None
                break
            at = close + 1
        if m:
            return m.start()
        self.open_quotes.update(quotes)
        return -1

    def next(self, at: int) -> Mark | None:
        page = self.page
        while (at := page.find("<", at)) >= 0:
            if page.startswith("<!--", at):
                stop = page.find("-->", at + 4)
                return Mark(at, len(page) if stop < 0 else stop + 3)
            if at > self.last:
                at = page.find("<!--", at)  # only a comment may end with the page
                return Mark(at, len(page)) if at >= 0 else None
            if page.startswith("<![CDATA[", at) and at + 9 <= self.last_section:
                stop = page.find("]]>", at + 9)
                return Mark(at, stop + 3, text=page[at + 9 : stop])
            if page[at + 1 : at + 2] in ("!", "?"):
                return Mark(at, page.find(">", at) + 1)
            if m := NAME.match(page, at + 1):
                stop = self.end(m.end())
                stop = page.find(">", m.end()) if stop < 0 else stop
                return Mark(at, stop + 1, m[2].lower(), bool(m[1]), page[m.end() : stop])
            at += 1
        return None

    def skipped(self, name: str, at: int) -> int:
        """Where the page goes on behind the content of ``name``; a head without an end ends at the body."""
        found = re.compile(rf"</{re.escape(name)}\b" + (r"|<body\b" if name == "head" else ""), re.I)
        while m := found.search(self.page, at):
            if not m[0].startswith("</"):
                return m.start()
            if m.end() <= self.last:
                return self.page.find(">", m.end()) + 1
            at = m.end()
        return len(self.page)


def blocks_of(page: str) -> list[Block]:
    """The page's text blocks in order."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool, bool]] = [("", False, False, False, False)]
    parts: list[str] = []
    linked: list[str] = []
    state = {"link": 0, "heading": False}
    names: Counter[str] = Counter()  # how often each name is on the stack

    def end() -> None:
        if parts and (text := " ".join(decoded("".join(parts)).split())):
            n = len(decoded("".join(linked)).split())
            _, bad_tag, bad_hint, in_main, good = stack[-1]
            out.append(Block(text, len(text.split()), n, bad_tag, bad_hint, in_main, good, state["heading"]))
        parts.clear(), linked.clear()

    def add(text: str) -> None:
        if not text:
            return
        parts.append(text)
        if state["link"]:
            linked.append(text + " ")

    def leave(k: int) -> None:
        for x in stack[k:]:
            names[x[0]] -= 1
        del stack[k:]

    at, size, marks = 0, len(page), Marks(page)
    while at < size:
        m = marks.next(at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start])
        at, name, closing, attributes = m.stop, m.name, m.closing, m.attributes
        if not name:
            add(m.text)
            continue
        if name in SKIPPED:
            if name not in INLINE:
                end()
            if not closing and not attributes.rstrip().endswith("/"):
                at = marks.skipped(name, at)
            continue
        words: set[str] = set()
        hidden = False
        for key, value in ATTRIBUTE.findall(attributes) if attributes and not closing else []:
            hidden |= key.lower() == "hidden" or key.lower() == "style" and bool(re.search(r"(?i)display\s*:\s*none", value))
            if key.lower() != "style":
                words |= {w.lower() for w in WORDS.findall(value)}
        bad = hidden or bool(words & BAD_WORDS) or any(BAD_PARTS.search(w) for w in words)
        # an element that names itself as something else is a container too, whatever its tag
        marked = bad and name not in VOID and name not in ("html", "body", "article", "main")
        open_marked = closing and name not in CONTAINERS and names[name] > 0
        if name == "a":
            state["link"] = 0 if closing else 1
        if name in INLINE and not marked and not open_marked:
            continue
        end()
        if name not in INLINE:
            state["link"] = state["link"] if name in ("br", "li", "p") else 0
            state["heading"] = not closing and name in HEADINGS
            if stack[-1][0] == "p" and name != "br":  # a paragraph ends where the next block begins
                leave(-1)
            if not closing and name in ("li", "td", "tr", "dt", "dd", "option") and stack[-1][0] == name:
                leave(-1)
        if closing:
            if names[name]:
                leave(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name))
        elif (name in CONTAINERS or marked) and not attributes.endswith("/"):
            _, bad_tag, bad_hint, in_main, good = stack[-1]
            if name in ("article", "main"):
                in_main = True
            elif name not in ("html", "body"):
                bad_hint |= bad
                good |= bool(words & GOOD_WORDS) and not bad_hint
            names[name] += 1
            stack.append((name, bad_tag or name in BAD_TAGS, bad_hint, in_main, good))
    end()
    return out


def matrix(blocks: list[Block]) -> np.ndarray:
    if not blocks:
        return np.zeros((0, len(FEATURES)))
    words = np.array([b.words for b in blocks], float)
    links = np.array([b.linked for b in blocks]) / words
    has_main = any(b.in_main for b in blocks)
    shift = lambda x, k: np.concatenate(([0.0], x[:-1])) if k < 0 else np.concatenate((x[1:], [0.0]))
    flags = np.array([(b.bad_tag, b.bad_hint, b.in_main, has_main, b.good_hint, b.heading) for b in blocks], float)
    return np.column_stack([flags, words, links, shift(words, -1), shift(links, -1), shift(words, 1), shift(links, 1)])


class DecisionTree:
    """Gini splits on thresholds between the values seen."""

    def __init__(self, depth: int = 7, least: int = 3):
        self.depth, self.least = depth, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> DecisionTree:
        self.root = self._grow(x, y, self.depth)
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int):
        if not depth or len(np.unique(y)) < 2:
            return float(y.mean())
        best = (y.mean() * (1 - y.mean()) - 1e-9, None, None)
        for j in range(x.shape[1]):
            order = np.argsort(x[:, j], kind="stable")
            v, left = x[order, j], np.cumsum(y[order])[:-1]
            n = np.arange(1, len(y))
            a, b = left / n, (y.sum() - left) / (len(y) - n)
            impurity = (n * a * (1 - a) + (len(y) - n) * b * (1 - b)) / len(y)
            impurity[(v[1:] == v[:-1]) | (n < self.least) | (len(y) - n < self.least)] = 1
            k = int(np.argmin(impurity))
            if impurity[k] < best[0] - 1e-12:
                best = (impurity[k], j, (v[k] + v[k + 1]) / 2)
        if best[1] is None:
            return float(y.mean())
        _, j, cut = best
        low = x[:, j] <= cut
        return (j, cut, self._grow(x[low], y[low], depth - 1), self._grow(x[~low], y[~low], depth - 1))

    def predict(self, x: np.ndarray) -> np.ndarray:
        def walk(node, rows: np.ndarray) -> None:
            if not isinstance(node, tuple):
                out[rows] = node
                return
            j, cut, a, b = node
            low = x[rows, j] <= cut
            walk(a, rows[low]), walk(b, rows[~low])

        out = np.zeros(len(x))
        walk(self.root, np.arange(len(x)))
        return out


def labelled_pages(n: int = 120, seed: int = 4) -> list[str]:
    """Pages whose main blocks begin with the word M and whose other blocks begin with B, from common page patterns."""
    rnd = random.Random(seed)
    words = lambda a, b: " ".join("lorem" for _ in range(rnd.randint(a, b)))
    link = lambda a, b: f'<a href="/x">B {words(a, b)}</a>'

    def main_blocks() -> str:
        kinds = [lambda: f"<p>M {words(0, 3)}</p>", lambda: f"<p>M {words(5, 80)}", lambda: f"<h2>M {words(0, 6)}</h2>", lambda: f"<p>M {words(3, 20)} <a href='/y'>{words(1, 15)}</a></p>", lambda: f"<ul><li>M {words(1, 9)}</li><li>M {words(0, 30)}</li></ul>", lambda: f"<p><b>M {words(0, 20)}</b><br>", lambda: f"<p><a href='/z'>M {words(0, 6)}</a></p>"]
        return f"<h1>M {words(1, 8)}</h1>" + "".join(rnd.choice(kinds)() for _ in range(rnd.randint(1, 9)))

    def other() -> str:
        text = rnd.choice([lambda: f"B {words(0, 4)}", lambda: f"B {words(5, 60)}", lambda: link(0, 4)])
        return rnd.choice([
            lambda: f"<nav><ul>{''.join(f'<li>{link(0, 2)}</li>' for _ in range(rnd.randint(1, 8)))}</ul></nav>",
            lambda: f"<header><p>{text()}</p></header>", lambda: f"<footer>{text()}</footer>", lambda: f"<aside><p>{text()}</p></aside>",
            lambda: f"<form><p>{text()}</p><button>B send</button></form>",
            lambda: f'<div class="{rnd.choice(["ad", "sidebar-left", "cookie-notice", "comments", "related-posts", "share", "newsletter", "banner"])}"><p>{text()}</p></div>',
            lambda: f'<section id="{rnd.choice(["comments", "sidebar", "footer", "menu"])}"><p>{text()}</p><p>{text()}</p></section>',
        ])()

    def bare() -> str:
        return rnd.choice([lambda: f"<ul>{''.join(f'<li>{link(0, 2)}</li>' for _ in range(rnd.randint(2, 8)))}</ul>", lambda: f"<p>{link(0, 3)}</p>"])()

    pages = []
    for k in range(n):
        around = lambda: "".join(other() for _ in range(rnd.randint(0, 3)))
        body = main_blocks()
        kind = k % 6
        if kind < 4:
            inner = body + (around() if rnd.random() < 0.4 else "") + (main_blocks() if rnd.random() < 0.4 else "")
            tag = ("article", "main", "article", "div class='content'")[kind]
            loose = f"<div><p>B {words(0, 40)}</p></div>" if kind < 3 and rnd.random() < 0.5 else ""
            pages.append(around() + loose + f"<{tag}>{inner}</{tag.split()[0]}>" + loose + around())
        elif kind == 4:
            pages.append(around() + f"<div>{main_blocks()}</div>" + around())
        else:
            paragraphs = "".join(f"<p>M {words(15, 80)}</p>" for _ in range(rnd.randint(2, 6)))
            pages.append(bare() + paragraphs + bare())
    return [f"<html><body>{p}</body></html>" for p in pages]


def train() -> DecisionTree:
    x, y = [], []
    for page in labelled_pages():
        found = blocks_of(page)
        x.append(matrix(found))
        y += [float(b.text.split()[0] == "M") for b in found]
    return DecisionTree().fit(np.concatenate(x), np.array(y))


def main_text(page: str, tree: DecisionTree) -> str:
    found = blocks_of(page)
    keep = tree.predict(matrix(found)) >= 0.5
    return " ".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame, tree: DecisionTree | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    tree = tree or train()

    @F.pandas_udf("string")
    def text_of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([main_text(p or "", tree) for p in part], dtype="object")

    out = pages.select("page_id", "url", text_of(F.col("html")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
