"""HTML extraction by the maximum-scoring subsequence.

A page becomes blocks of words with the tags between them.  A logistic
regression, fitted to pages labelled by hand (``labelled.py``), gives each
block the log-odds that it is content, from where it stands (article, main,
content-like containers; menus, adverts, comments and the like, told by element,
role, class and id), its link density, length, punctuation, tag and neighbours.
Every word scores the log-odds of its block, so words of content score
positive; every tag has a negative weight, by how much rarer it is among the
labelled content.  One linear scan finds the contiguous region with the largest
sum; the text is that region's blocks of positive score.

Words of recognised boilerplate score 0 in the scan: an advert between two
halves of an article is left out of the text but does not end the region.
All words of a block have one weight, so the scan goes block by block.

Parsing takes time in proportion to the page, whatever is left open in it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
MARK = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true)|display\s*:\s*none""", re.I)
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
CUE = re.compile(r"©|\(c\)\s|copyright|rights reserved|cookies?\b|subscribe|sign (?:up|in)|log ?in\b|privacy policy|terms of (?:use|service)", re.I)

#: HTML's element kinds.
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "svg", "math", "canvas", "object"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK_TAGS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "select", "summary",
    "table", "tbody", "tfoot", "thead", "title", "tr", "ul",
}
SPACING = {"br", "td", "th", "img"}
#: An open one of these ends where the next one begins.
CLOSED_BY_SAME = {"p", "li", "option", "tr", "dt", "dd"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ROLES = ("menu", "header", "footer", "sidebar", "form", "notice", "advert", "comments", "hidden")
LEVELS = ("article", "main", "content")
ROLE_OF_TAG = {
    "nav": "menu", "menu": "menu", "header": "header", "footer": "footer", "aside": "sidebar", "form": "form", "button": "form", "select": "form", "label": "form", "fieldset": "form",
    "dialog": "notice", "head": "hidden", "title": "hidden",
}
ROLE_OF_WORD = {
    **dict.fromkeys("ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion banner".split(), "advert"),
    **dict.fromkeys("nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar".split(), "menu"),
    **dict.fromkeys("sidebar aside complementary related recommended recommendations widget widgets share sharing social".split(), "sidebar"),
    **dict.fromkeys("comment comments commentlist disqus reply replies respond discussion".split(), "comments"),
    **dict.fromkeys("cookie cookies consent gdpr notice notices alert newsletter subscribe subscription popup modal overlay paywall dialog disclaimer".split(), "notice"),
    **dict.fromkeys("footer copyright contentinfo".split(), "footer"),
    **dict.fromkeys("header masthead topbar".split(), "header"),
    **dict.fromkeys("form search login signup signin".split(), "form"),
}
CONTENT_WORDS = frozenset("content article post entry story main".split())
#: Words of class names that tell of layout only: the word before them counts.
LAYOUT_WORDS = frozenset("area bar block body bottom box button buttons column container inner item items left link links list panel posts articles stories right row section slot text title top unit wrap wrapper zone".split())
NEGATIONS = frozenset("has no non not with without is hide".split())


class Role(NamedTuple):
    """What an element says of what it holds: boilerplate, boilerplate perhaps, a level of content."""

    strong: str | None
    weak: bool
    level: str | None


def class_role(token: str) -> tuple[str | None, bool, bool]:
    """(boilerplate role, boilerplate perhaps, content) of one class or id.

    The last word but for words of layout counts, as in comment-list and
    post-footer; share-price and related-work only hold such a word, and
    has-sidebar tells of the page.
    """
    words = [w.lower() for w in PART.findall(token)]
    roles = [w for w in words if w in ROLE_OF_WORD]
    if not roles:
        core = [w for w in words if w not in LAYOUT_WORDS]
        return None, False, bool(core) and core[-1] in CONTENT_WORDS and words[0] not in NEGATIONS
    head = next((w for w in reversed(words) if w not in LAYOUT_WORDS), "")
    if head in ROLE_OF_WORD and words[0] not in NEGATIONS:
        return ROLE_OF_WORD[head], True, False
    return None, True, False


@cache
def role_of(name: str, attributes: str) -> Role:
    """Role of an element by its name, role, class and id.

    An article or main element, or one that a class of its own calls content,
    is boilerplate only by a class that is one boilerplate word.
    """
    if HIDDEN.search(attributes):
        return Role("hidden", True, None)
    strong, weak, level, found = ROLE_OF_TAG.get(name), False, name if name in ("article", "main") else None, []
    if name not in ("body", "html"):
        for m in MARK.finditer(attributes):
            value = m[2] or m[3] or m[4] or ""
            if m[1].lower() == "role" and value.strip().lower() in ("article", "main"):
                level = value.strip().lower()
                continue
            for token in value.split():
                role, perhaps, content = class_role(token)
                weak |= perhaps
                if role and not (role in ("header", "form") and name in HEADINGS):
                    found.append((role, token.isalpha() and len(PART.findall(token)) == 1))
                if content and level is None:
                    level = "content"
    if level is not None:
        found = [x for x in found if x[1]]
    return Role(found[0][0] if found else strong, weak, level)


class State(NamedTuple):
    """What holds at a place: boilerplate roles and levels around it, the innermost level, and the innermost element with a role."""

    roles: frozenset[str] = frozenset()
    weak: bool = False
    levels: frozenset[str] = frozenset()
    level: str | None = None
    owner: int = -1


@dataclass
class Block:
    """A run of text without block tags in it."""

    state: State
    tag: str
    at: int  # where its text begins in the page
    parts: list[str] = field(default_factory=list)
    words: int = 0
    linked: int = 0
    text: str = ""


class Page(NamedTuple):
    blocks: list[Block]
    tags: list[list[str]]  # before each block, and after the last one
    owners: list[tuple[str, int]]  # role and parent of each element that has a role


def end_of_tag(page: str, at: int, gone: set[str]) -> int:
    """Place of the ``>`` that ends a tag, outside of quoted values; -1 if there is none.

    ``gone`` holds the quotes that do not come any more.  Every search goes on
    where the last one for the same character ended, so none is done twice.
    """
    end, next_of = page.find(">", at), dict.fromkeys("\"'", -1)
    while end >= 0:
        for q in next_of:
            if next_of[q] < at and q not in gone:
                found = page.find(q, at)
                if found < 0:
                    gone.add(q)
                next_of[q] = found
        first = min((x for q, x in next_of.items() if q not in gone), default=end)
        if first >= end:
            return end
        at = first + 1
        if page[max(0, first - 8) : first].rstrip()[-1:] == "=":  # a value begins
            close = page.find(page[first], at)
            if close < 0:
                gone.add(page[first])
                continue
            at = close + 1
        if at > end:
            end = page.find(">", at)
    return -1


def parse(page: str) -> Page:
    """Blocks of a page with the tags between them; character references are decoded."""
    blocks: list[Block] = []
    tags: list[list[str]] = [[]]
    owners: list[tuple[str, int]] = []
    stack: list[tuple[str, State]] = []
    open_names: list[dict[str, int]] = [{}]  # of the elements since each article or main that is open
    state, linked, current, gone, at, end = State(), False, None, set(), 0, len(page)

    def say(text: str, place: int) -> None:
        nonlocal current
        if not text:
            return
        if current is None:
            current = Block(state, stack[-1][0] if stack else "body", place)
        current.parts.append(text)
        n = len(text.split())
        current.words += n
        current.linked += n if linked else 0

    def finish() -> None:
        nonlocal current
        if current is not None and current.words:
            current.text = " ".join("".join(current.parts).split())
            blocks.append(current)
            tags.append([])
        current = None

    def pop() -> None:
        name, _ = stack.pop()
        if len(open_names) > 1 and name in ("article", "main"):
            open_names.pop()
        open_names[-1][name] -= 1

    while at < end:
        start = page.find("<", at)
        if start < 0:
            say(html.unescape(page[at:]), at)
            break
        if start > at:
            say(html.unescape(page[at:start]), at)
        if page.startswith("<!--", start):
            close = page.find("-->", start + 4)
            at = end if close < 0 else close + 3
            continue
        m = NAME.match(page, start + 1)
        if m is None:
            if page[start + 1 : start + 2] in ("!", "?", "/"):
                close = page.find(">", start)
                at = end if close < 0 else close + 1
            else:
                say("<", start)
                at = start + 1
            continue
        close = end_of_tag(page, m.end(), gone)
        if close < 0:
            close = page.find(">", m.end())  # a quote that never ends
            if close < 0:
                break
        name, closing, attributes = m[1].lower(), page[start + 1] == "/", page[m.end() : close]
        at = close + 1
        if name in RAW:
            if not closing and not attributes.endswith("/"):
                stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
                close = page.find(">", stop.end()) if stop else -1
                at = end if close < 0 else close + 1
            continue
        if name in BLOCK_TAGS:
            finish()
        elif name in SPACING:
            say(" ", start)
        tags[-1].append(name)
        if name == "a":
            linked = not closing
        if closing:
            wide = name in ("body", "html", "article", "main")
            if any(x.get(name) for x in (open_names if wide else open_names[-1:])):
                while stack[-1][0] != name:
                    pop()
                pop()
                state = stack[-1][1] if stack else State()
        elif name not in VOID:
            own = role_of(name, attributes) if len(attributes) < 1000 else role_of.__wrapped__(name, attributes)
            if name in BLOCK_TAGS or own.strong or own.level:
                if name in CLOSED_BY_SAME and stack and stack[-1][0] == name:
                    pop()
                    state = stack[-1][1] if stack else State()
                strong = own.strong if not (own.strong == "header" and state.levels) else None  # a header of the article's own
                if strong or own.weak or own.level:
                    if strong:
                        owners.append((strong, state.owner))
                    state = State(
                        state.roles | {strong} if strong else state.roles, state.weak or (own.weak and not strong),
                        state.levels | {own.level} if own.level and not strong else state.levels, own.level if own.level and not strong else state.level, len(owners) - 1 if strong else state.owner,
                    )
                stack.append((name, state))
                open_names[-1][name] = open_names[-1].get(name, 0) + 1
                if name in ("article", "main"):
                    open_names.append({})
    finish()
    return Page(blocks, tags, owners)


def whole_page_roles(page: Page) -> set[int]:
    """Elements with a form's, header's or notice's role that hold nearly all of a page's text: they only wrap it."""
    held = [0] * len(page.owners)
    for b in page.blocks:
        if b.state.owner >= 0 and b.state.roles <= {page.owners[b.state.owner][0]}:
            held[b.state.owner] += b.words - b.linked
    every = sum(b.words - b.linked for b in page.blocks)
    return {k for k, (role, _) in enumerate(page.owners) if role in ("form", "header", "notice") and held[k] >= 20 and held[k] > 0.7 * every}


FEATURES = (
    "always", *ROLES, "weak", "in core element", "in core class", "beside core", "link density", "mostly links", "log words", "three words", "ten words", "sentence", "ends a sentence",
    "p", "li", "heading", "cell", "link density before", "log words before", "link density after", "log words after", "cue",
)
SENTENCE, ENDS = re.compile("[.!?。！？]"), ".!?:…\"”»。！？"
CELLS = {"td", "th", "tr", "table", "tbody", "dt", "dd"}


def features(page: Page) -> np.ndarray:
    """(blocks, FEATURES).

    The core is the kind of container, article, main or content-like, that holds
    most words outside of boilerplate, those in an inner kind not counted; of
    equal ones the first.
    """
    blocks, wraps = page.blocks, whole_page_roles(page)
    roles = [frozenset() if b.state.owner in wraps else b.state.roles for b in blocks]
    held = {x: sum(b.words for b, r in zip(blocks, roles) if x == b.state.level and not r) for x in LEVELS}
    core = max(LEVELS, key=held.get) if any(held.values()) else None
    density = [0.0, *(b.linked / b.words for b in blocks), 0.0]
    size = [0.0, *np.log1p([b.words for b in blocks]).tolist(), 0.0]
    rows = []
    for k, b in enumerate(blocks, 1):
        own, levels, text, tag = roles[k - 1], b.state.levels, b.text, b.tag
        rows.append((
            *marks(own, b.state.weak), core in levels and core != "content" and not own, core in levels and core == "content" and not own, core is not None and core not in levels, density[k], density[k] > 0.5, size[k], b.words <= 3, b.words < 10,
            SENTENCE.search(text) is not None, text[-1] in ENDS, tag == "p", tag == "li", tag in HEADINGS, tag in CELLS, density[k - 1], size[k - 1], density[k + 1], size[k + 1], CUE.search(text) is not None,
        ))
    return np.array(rows, float).reshape(-1, len(FEATURES))


@cache
def marks(roles: frozenset[str], weak: bool) -> tuple[float, ...]:
    return (1.0, *(float(r in roles) for r in ROLES), float(weak))


class Weights(NamedTuple):
    """Weights of ``FEATURES`` and of tags."""

    block: np.ndarray
    tag: dict[str, float]


MOST = 2.0  # log-odds that a word scores at most, either way
MOST_TAG = 0.3
RIDGE = 0.1


def fit(pages: list[str]) -> Weights:
    """Weights from labelled pages, whose content stands between ``<!--+-->`` and ``<!--/-->``.

    Blocks: a logistic regression with a small ridge penalty, by Newton's
    method.  Tags: log-odds of standing within rather than outside of content,
    a word's being those of all words; between -MOST_TAG and -0.05.
    """
    rows, marks, inside, outside, words = [], [], {}, {}, [0, 0]
    for text in pages:
        page = parse(text)
        spans = [(m.start(), e if (e := text.find("<!--/-->", m.start())) >= 0 else len(text)) for m in re.finditer(re.escape("<!--+-->"), text)]
        labels = [any(a < b.at < e for a, e in spans) for b in page.blocks]
        rows.append(features(page))
        marks += labels
        for b, yes, names in zip(page.blocks, labels, page.tags):
            words[yes] += b.words
            for name in names:
                (inside if yes else outside)[name] = (inside if yes else outside).get(name, 0) + 1
    x, y = np.concatenate(rows), np.array(marks, float)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w)), x.T @ (y - p) - RIDGE * w)
    odds = np.log((words[1] + 1) / (words[0] + 1))
    tag = {name: float(min(-0.05, max(-MOST_TAG, np.log((inside.get(name, 0) + 0.5) / (outside.get(name, 0) + 0.5)) - odds))) for name in {*inside, *outside}}
    return Weights(w, tag)


def best_region(scores: np.ndarray) -> tuple[int, int]:
    """(first, end) of the contiguous run with the largest sum, of equal sums the shortest that ends first; empty if none is positive."""
    best, found, run, start = 0.0, (0, 0), 0.0, 0
    for k, x in enumerate(scores.tolist()):
        run += x
        if run <= 0:
            run, start = 0.0, k + 1
        elif run > best:
            best, found = run, (start, k + 1)
    return found


def extract_one(page: str | None, weights: Weights) -> str:
    """Main text of a page: the content blocks of the best region, joined by an empty line."""
    if not page:
        return ""
    found = parse(page)
    if not found.blocks:
        return ""
    x = features(found)
    odds = np.clip(x @ weights.block, -MOST, MOST)
    known = x[:, 1 : 1 + len(ROLES)].any(axis=1)
    words = np.array([b.words for b in found.blocks]) * np.where(known & (odds < 0), 0.0, odds)
    scores = np.zeros(2 * len(words))
    scores[0::2] = [sum(weights.tag.get(name, -0.05) for name in names) for names in found.tags[:-1]]
    scores[1::2] = words
    first, end = best_region(scores)
    return "\n\n".join(b.text for k, b in enumerate(found.blocks) if first <= 2 * k + 1 < end and odds[k] > 0)


@cache
def learn() -> Weights:
    """Weights from the pages labelled by hand."""
    from flowlens.llm.labelled import pages

    return fit(pages())


def extract(pages: DataFrame, weights: Weights, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """``keep``, ``text`` and ``n_chars`` of every row; null, empty and text-free pages give an empty text.

    Rows may repeat, other columns may be null and are not read.  Of regions
    with equal scores the first to end is taken.  Pages of any length are read
    whole, in time and memory in proportion to them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([extract_one(v.as_py(), weights) for v in b.column(len(keep))], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keep))), texts], schema.names)

    schema = pages.select(*keep).schema.add("text", "string")
    return pages.select(*keep, F.col(html_col).alias("_html")).mapInArrow(run, schema).withColumn("n_chars", F.length("text").cast("long"))
