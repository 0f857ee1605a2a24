"""Operator 4: main text of web pages from flat text blocks.

A page is read once into flat blocks: a block ends at every block-level tag, and holds its words, the share of them
inside links (link density), and what the open tags say about its place: inside an article or main element; beside the
text by its element or role (menu, header, footer, aside, form, dialog); among comments by a class; beside the text by
a class; a heading; a list item.  A decision tree over a block's own and its two neighbours' word counts and link
densities and these marks says which blocks are main text.  A class never decides for all it holds: where no block of
the page lies in an article free of such classes, blocks in one count by their words and links.  Classes are read as
whole tokens; those that name a state or a topic (``has-sidebar``, ``tag-legal``) say nothing.
The tree (Gini, grown until pure) is trained on ``LABELLED_BLOCKS``, a small table made by hand of blocks of pages with
and without an article element.

Pages are independent, so the work is one Arrow map over the pages, without a shuffle.

Defined cases: a null or empty html has the empty text; a tag or comment cut off at the page's end is dropped;
character references are decoded as HTML5 does; repeated rows are separate pages; an empty table gives an empty
result; other columns are not read.  Scripts, styles, templates and other elements that show no text have no blocks;
without its end tag a script or style hides the rest of the page, any other such element only its own tag, and
self-closed ``svg`` and ``math`` are empty.  A head ends at its end tag, at the body or at the first element that is
none of a head's.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator, Sequence
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from caremart.llm.common import read_table


class Block(NamedTuple):
    text: str
    words: int
    links: float
    article: int
    aside: int
    heading: int
    item: int
    comment: int
    marked: int


UNSEEN = "script|style|template|noscript|title|svg|math|iframe|object|canvas|textarea|select"
RAW = re.compile(rf"(?:{UNSEEN})\b", re.I)
RAW_END = {raw: re.compile(rf"</{raw}\s*>", re.I) for raw in UNSEEN.split("|")}
HEAD_TAGS = frozenset("html head meta link base basefont bgsound script style template noscript title".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>"
                   r"|<[!?/][^>]*(?:>|\Z)|<[a-z][^>]*(?:>|\Z)|[^<]+|<", re.S | re.I)
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary "
    "table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ARTICLE_TAGS = frozenset(["article", "main"])
ASIDE_TAGS = frozenset(["nav", "footer", "aside", "form", "header", "menu", "button", "dialog", "fieldset"])
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form "
                        "toolbar".split())
ARTICLE_WORDS = frozenset("article content post entry story articlebody".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation "
    "menu menubar breadcrumb breadcrumbs header masthead topbar footer sidebar side aside widget widgets related "
    "recommended share sharing social cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe signup login search form toc pagination pager "
    "copyright legal disclaimer tags skip teaser outbrain taboola werbung anzeige anzeigen publicite publicidad anuncio".split())
COMMENT_WORDS = frozenset(
    "comment comments respond reply replies disqus kommentar kommentare leserkommentare commentaire commentaires comentario "
    "comentarios".split())
#: A class that starts so names a state, a topic or a number of the page, not a place in it.
STATE_WORDS = frozenset("has no not with without is category tag topic type status format postid author lang".split())
SPACES = re.compile(r"\s+")
ATTRIBUTE = re.compile(r"([a-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none", re.I)


def _class_place(value: str) -> tuple[bool, bool, bool]:
    """Whether a class or id names an article, something beside it, or comments."""
    article = marked = comment = False
    for token in value.split():
        words = [w for w in re.split(r"[^a-z]+", re.sub("([a-z])([A-Z])", r"\1-\2", token).lower()) if w]
        if len(words) > 1 and words[0] in STATE_WORDS:
            continue
        if not COMMENT_WORDS.isdisjoint(words):
            comment = True
        elif not ASIDE_WORDS.isdisjoint(words):
            marked = True
        elif not ARTICLE_WORDS.isdisjoint(words):
            article = True
    return article and not marked and not comment, marked, comment


def _place(tag: str, attrs: str, in_article: bool) -> tuple[bool, bool, bool, bool, bool]:
    """Whether an opened element starts an article, something beside it, is hidden, holds comments, has such a class."""
    article, aside = tag in ARTICLE_TAGS, tag in ASIDE_TAGS
    if tag == "header" and in_article:
        aside = False  # an article's own header holds its title
    hidden = comment = marked = False
    if attrs:
        for name, a, b, c in ATTRIBUTE.findall(attrs):
            name, value = name.lower(), a or b or c
            if name in ("class", "id") and tag not in ("body", "html", "a", "p", "span"):
                is_article, is_marked, is_comment = _class_place(value)
                article, marked, comment = article or is_article, marked or is_marked, comment or is_comment
            elif name == "role":
                aside = aside or value.lower() in ASIDE_ROLES
                article = article or value.lower() in ("main", "article")
            elif name == "itemprop":
                article = article or value.lower() == "articlebody"
                comment = comment or value.lower() == "comment"
            elif name == "style" and HIDDEN.search(value):
                hidden = True
        hidden = hidden or re.search(r"(?:^|\s)hidden(?:\s|$|=)", attrs, re.I) is not None
    return article, aside, hidden, comment, marked


def blocks(html: str | None) -> list[Block]:
    """The flat text blocks of a page in order; blocks without words are left out."""
    out: list[Block] = []
    # tag, and how many open elements are article, beside, hidden, comments, marked by a class, headings, list items
    stack: list[tuple] = []
    ground = ("", 0, 0, 0, 0, 0, 0, 0)
    opened: Counter = Counter()  # the open elements of each tag
    pieces: list[tuple[str, bool]] = []
    links = 0
    html, pos = html or "", 0
    head: list[tuple[str, bool]] | None = None  # the text of an open head element
    endless: set[str] = set()  # unseen elements whose end tag does not follow any more

    def end_block() -> None:
        if not pieces:
            return
        text = SPACES.sub(" ", unescape("".join(p for p, _ in pieces))).strip()
        _, article, aside, hidden, comment, marked, heading, item = stack[-1] if stack else ground
        if text and not hidden:
            n = len(text.split(" "))
            linked = sum(len(unescape(p).split()) for p, in_link in pieces if in_link)
            out.append(Block(text, n, min(1.0, linked / n), int(article > 0), int(aside > 0), int(heading > 0), int(item > 0),
                             int(comment > 0), int(marked > 0)))
        pieces.clear()

    while pos < len(html):
        m = TOKEN.match(html, pos)
        pos = m.end()
        token, tag = m[0], m["tag"]
        if tag is None:
            if token[0] != "<" or token == "<":
                (pieces if head is None else head).append((token, links > 0))
            continue
        tag = tag.lower()
        raw = None if m["close"] else RAW.match(tag)
        if tag == "head" and not m["close"]:
            head = [] if head is None else head
            pieces.append((" ", False))
        elif head is not None and (tag in ("head", "body", "html") if m["close"] else
                                   (raw[0] if raw else tag) not in HEAD_TAGS):
            head = None
        if raw:
            pieces.append((" ", False))
            raw = raw[0]
            if raw in endless or raw in ("svg", "math") and m["attrs"].endswith("/"):
                continue
            end = RAW_END[raw].search(html, pos)
            if end:
                pos = end.end()
            elif raw in ("script", "style"):
                pos = len(html)
            else:
                endless.add(raw)
            continue
        if tag in BLOCK_TAGS:
            end_block()
        if tag == "a":
            links = 0 if m["close"] else 1
        if tag in VOID_TAGS:
            continue
        if m["close"]:
            while opened[tag]:  # the nearest open element of the tag ends, and all that is open in it
                closed = stack.pop()[0]
                opened[closed] -= 1
                if closed == tag:
                    break
        elif tag in BLOCK_TAGS and not m["attrs"].endswith("/"):
            if tag in ("p", "li") and stack and stack[-1][0] == tag:
                stack.pop()  # an open paragraph or item ends where the next begins
                opened[tag] -= 1
            above = stack[-1] if stack else ground
            new = (*_place(tag, m["attrs"], above[1] > 0), tag in HEADINGS, tag == "li")
            stack.append((tag, *[n + x for n, x in zip(above[1:], new)]))
            opened[tag] += 1
    pieces += head or []  # neither an end tag nor an element ended the head: its text is the page's
    end_block()
    return out


FEATURES = ("words", "links", "words before", "links before", "words after", "links after", "article on page",
            "in article", "beside", "heading", "list item", "comments", "class beside")


def features(page: Sequence[Block]) -> np.ndarray:
    """One row of ``FEATURES`` for each block; beyond the page's ends stand blocks of no words and no links."""
    own = np.array([[b.words, b.links] for b in page], float).reshape(-1, 2)
    edge = np.zeros((1, 2))
    marks = np.array([[b.article, b.aside, b.heading, b.item, b.comment, b.marked] for b in page], float).reshape(-1, 6)
    there = np.full((len(page), 1), float(any(b.article and not b.aside and not b.comment and not b.marked for b in page)))
    return np.hstack([own, np.vstack([edge, own[:-1]])[:len(page)], np.vstack([own[1:], edge])[:len(page)], there, marks])


# words, links, words before, links before, words after, links after, article (free of classes beside it) on page, in
# article, beside, heading, list item -> main text
PLAIN_BLOCKS = (
    # an article element marks its text, however short or linked a block of it is
    ((8, 0, 0, 0, 40, 0, 1, 1, 0, 1, 0), 1), ((3, 0, 0, 0, 90, 0, 1, 1, 0, 1, 0), 1),
    ((120, 0, 8, 0, 60, 0, 1, 1, 0, 0, 0), 1), ((45, 0.05, 120, 0, 30, 0, 1, 1, 0, 0, 0), 1),
    ((1, 0, 60, 0, 45, 0, 1, 1, 0, 0, 0), 1), ((2, 0, 1, 0, 2, 0, 1, 1, 0, 0, 0), 1),
    ((12, 0, 45, 0, 10, 0.2, 1, 1, 0, 0, 0), 1), ((30, 0.4, 20, 0, 25, 0, 1, 1, 0, 0, 0), 1),
    ((6, 1, 50, 0, 50, 0, 1, 1, 0, 0, 0), 1), ((9, 0, 30, 0, 8, 0, 1, 1, 0, 0, 1), 1),
    ((4, 0, 5, 0, 6, 0, 1, 1, 0, 0, 1), 1), ((5, 0.5, 5, 0, 6, 0, 1, 1, 0, 0, 1), 1),
    ((70, 0, 0, 0, 0, 0, 1, 1, 0, 0, 0), 1), ((10, 0, 2, 1, 0, 0, 1, 1, 0, 0, 0), 1),
    ((25, 0, 12, 0, 14, 0.1, 1, 1, 0, 0, 0), 1), ((15, 0, 70, 0, 12, 0, 1, 1, 0, 0, 0), 1),
    ((20, 0, 10, 0, 3, 1, 1, 1, 0, 0, 0), 1), ((40, 0, 3, 1, 2, 1, 1, 1, 0, 0, 0), 1),
    ((3, 1, 20, 0, 4, 1, 1, 1, 0, 0, 1), 1), ((4, 1, 3, 1, 4, 1, 1, 1, 0, 0, 1), 1),
    ((4, 1, 4, 1, 0, 0, 1, 1, 0, 0, 0), 1), ((65, 0.7, 3, 1, 12, 0.5, 1, 1, 0, 0, 0), 1),
    ((2, 0, 2, 1, 3, 0.8, 1, 1, 0, 1, 0), 1), ((1, 1, 0, 0, 1, 1, 1, 1, 0, 0, 0), 1),
    # menus, headers, footers, sidebars, notices, adverts, forms and comments, also inside an article
    ((1, 1, 0, 0, 1, 1, 1, 0, 1, 0, 1), 0), ((2, 1, 1, 1, 2, 1, 1, 0, 1, 0, 1), 0),
    ((3, 1, 2, 1, 14, 0, 1, 0, 1, 0, 1), 0), ((12, 0, 1, 1, 9, 0, 1, 0, 1, 0, 0), 0),
    ((20, 0, 0, 0, 60, 0, 1, 0, 1, 0, 0), 0), ((16, 0.1, 40, 0, 0, 0, 1, 0, 1, 0, 0), 0),
    ((5, 0, 30, 0, 0, 0, 1, 0, 1, 1, 0), 0), ((35, 0, 8, 0, 40, 0, 1, 1, 1, 0, 0), 0),
    ((60, 0, 50, 0, 70, 0, 1, 1, 1, 0, 0), 0), ((2, 0, 35, 0, 22, 0, 1, 1, 1, 1, 0), 0),
    ((90, 0, 4, 0, 30, 0, 1, 0, 1, 0, 0), 0), ((8, 0.6, 20, 0, 30, 0, 1, 1, 1, 0, 1), 0),
    ((14, 0, 0, 0, 0, 0, 0, 0, 1, 0, 0), 0), ((50, 0, 60, 0, 20, 0, 0, 0, 1, 0, 0), 0),
    ((1, 1, 1, 1, 1, 1, 0, 0, 1, 0, 1), 0), ((100, 0, 80, 0, 90, 0, 0, 0, 1, 0, 0), 0),
    # blocks outside the article of a page that has one
    ((10, 0, 12, 0, 8, 0, 1, 0, 0, 0, 0), 0), ((40, 0, 0, 0, 8, 0, 1, 0, 0, 0, 0), 0),
    ((3, 1, 30, 0, 4, 1, 1, 0, 0, 0, 0), 0), ((6, 0, 50, 0, 0, 0, 1, 0, 0, 1, 0), 0),
    ((75, 0, 60, 0, 50, 0, 1, 0, 0, 0, 0), 0), ((20, 0, 30, 0, 25, 0, 1, 0, 0, 0, 0), 0),
    ((14, 0, 45, 0, 10, 1, 1, 0, 0, 0, 0), 0), ((7, 0, 2, 1, 40, 0, 1, 0, 0, 1, 0), 0),
    ((90, 0, 0, 0, 3, 1, 1, 0, 0, 0, 0), 0), ((4, 0, 20, 0, 6, 0, 1, 0, 0, 0, 1), 0),
    ((80, 0.1, 20, 0, 5, 0, 1, 0, 0, 0, 0), 0), ((5, 1, 5, 1, 5, 1, 1, 0, 0, 0, 1), 0),
    # pages without an article element: long blocks with few links, headings before and short blocks between them
    ((60, 0, 5, 0, 80, 0, 0, 0, 0, 0, 0), 1), ((25, 0.1, 60, 0, 40, 0, 0, 0, 0, 0, 0), 1),
    ((110, 0.05, 3, 1, 2, 1, 0, 0, 0, 0, 0), 1), ((14, 0, 50, 0, 60, 0, 0, 0, 0, 0, 0), 1),
    ((18, 0, 30, 0, 0, 0, 0, 0, 0, 0, 0), 1), ((12, 0, 25, 0, 22, 0, 0, 0, 0, 0, 0), 1),
    ((7, 0, 2, 1, 60, 0, 0, 0, 0, 1, 0), 1), ((5, 0, 0, 0, 35, 0, 0, 0, 0, 1, 0), 1),
    ((4, 0, 70, 0, 45, 0, 0, 0, 0, 0, 0), 1), ((6, 0, 30, 0, 26, 0, 0, 0, 0, 0, 1), 1),
    ((2, 0, 40, 0, 38, 0, 0, 0, 0, 0, 0), 1), ((20, 0.2, 24, 0, 30, 0, 0, 0, 0, 0, 0), 1),
    ((2, 1, 2, 1, 3, 1, 0, 0, 0, 0, 1), 0), ((1, 1, 0, 0, 1, 1, 0, 0, 0, 0, 0), 0),
    ((12, 0.9, 10, 0.8, 14, 1, 0, 0, 0, 0, 0), 0), ((30, 0.8, 20, 0.9, 25, 0.7, 0, 0, 0, 0, 0), 0),
    ((4, 0, 1, 1, 3, 1, 0, 0, 0, 0, 0), 0), ((5, 0, 2, 1, 0, 0, 0, 0, 0, 0, 0), 0),
    ((3, 0, 0, 0, 2, 1, 0, 0, 0, 1, 0), 0), ((6, 0.5, 3, 1, 4, 1, 0, 0, 0, 0, 1), 0),
    ((1, 1, 1, 1, 50, 0, 0, 0, 0, 0, 1), 0), ((2, 1, 2, 1, 80, 0, 0, 0, 0, 0, 1), 0),
    ((3, 1, 0, 0, 60, 0, 0, 0, 0, 0, 0), 0), ((13, 0.9, 4, 1, 40, 0, 0, 0, 0, 0, 0), 0),
    ((2, 1, 45, 0, 50, 0, 0, 0, 0, 0, 0), 0), ((1, 1, 40, 0, 1, 1, 0, 0, 0, 0, 1), 0),
    ((3, 1, 60, 0, 3, 1, 0, 0, 0, 0, 0), 0), ((4, 0, 30, 0, 0, 0, 0, 0, 0, 0, 0), 0),
    ((5, 0, 3, 0, 4, 0, 0, 0, 0, 0, 0), 0), ((2, 0, 4, 0, 3, 0, 0, 0, 0, 0, 1), 0),
)

# the same columns, then: among comments, beside by a class -> main text
MARKED_BLOCKS = (
    # comments are none, wherever they stand and however long they are
    ((30, 0, 8, 0, 40, 0, 1, 1, 0, 0, 0, 1, 0), 0), ((90, 0, 30, 0, 70, 0, 1, 0, 0, 0, 0, 1, 0), 0),
    ((150, 0, 60, 0, 80, 0, 0, 0, 0, 0, 0, 1, 0), 0), ((25, 0, 90, 0, 30, 0, 0, 1, 0, 0, 1, 1, 0), 0),
    ((2, 0, 40, 0, 30, 0, 1, 1, 0, 1, 0, 1, 0), 0), ((60, 0, 3, 0, 50, 0, 0, 1, 0, 0, 0, 1, 1), 0),
    ((45, 0, 20, 0, 45, 0, 1, 0, 0, 0, 1, 1, 0), 0), ((70, 0.1, 40, 0, 90, 0, 0, 0, 0, 0, 0, 1, 0), 0),
    # beside by a class on a page with an article free of such classes: adverts, teasers and lists, in the article too
    ((19, 0, 40, 0, 35, 0, 1, 1, 0, 0, 0, 0, 1), 0), ((8, 0, 60, 0, 70, 0, 1, 0, 0, 0, 0, 0, 1), 0),
    ((45, 0, 90, 0, 60, 0, 1, 1, 0, 0, 0, 0, 1), 0), ((120, 0, 40, 0, 30, 0, 1, 0, 0, 0, 0, 0, 1), 0),
    ((4, 1, 3, 1, 5, 1, 1, 1, 0, 0, 1, 0, 1), 0), ((6, 0, 20, 0, 40, 0, 1, 0, 0, 1, 0, 0, 1), 0),
    ((75, 0, 70, 0, 80, 0, 1, 1, 0, 0, 0, 0, 1), 0),
    # an article inside an element whose class misleads, on a page without another: its text is the main text
    ((8, 0, 3, 1, 50, 0, 0, 1, 0, 1, 0, 0, 1), 1), ((60, 0, 8, 0, 45, 0, 0, 1, 0, 0, 0, 0, 1), 1),
    ((19, 0, 2, 0, 15, 0, 0, 1, 0, 0, 0, 0, 1), 1), ((110, 0.1, 50, 0, 70, 0, 0, 1, 0, 0, 0, 0, 1), 1),
    ((4, 0, 40, 0, 60, 0, 0, 1, 0, 0, 0, 0, 1), 1), ((25, 0, 60, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1), 1),
    ((30, 0, 0, 0, 6, 0, 0, 1, 0, 0, 1, 0, 1), 1), ((12, 0, 18, 0, 20, 0, 0, 1, 0, 0, 0, 0, 1), 1),
    ((3, 1, 2, 1, 4, 1, 0, 1, 0, 0, 1, 0, 1), 0), ((2, 1, 5, 1, 3, 1, 0, 1, 0, 0, 0, 0, 1), 0),
    ((6, 0.9, 8, 1, 7, 0.8, 0, 1, 0, 0, 1, 0, 1), 0), ((14, 0.8, 4, 1, 9, 1, 0, 1, 0, 0, 0, 0, 1), 0),
    # no article at all: long text among long text stands against its class, notices and lists do not
    ((80, 0, 60, 0, 90, 0, 0, 0, 0, 0, 0, 0, 1), 1), ((120, 0.05, 45, 0, 70, 0, 0, 0, 0, 0, 0, 0, 1), 1),
    ((65, 0, 50, 0, 110, 0, 0, 0, 0, 0, 0, 0, 1), 1), ((150, 0, 90, 0, 60, 0, 0, 0, 0, 0, 0, 0, 1), 1),
    ((19, 0, 40, 0, 60, 0, 0, 0, 0, 0, 0, 0, 1), 0), ((35, 0, 60, 0, 80, 0, 0, 0, 0, 0, 0, 0, 1), 0),
    ((8, 0, 2, 1, 5, 0, 0, 0, 0, 0, 0, 0, 1), 0), ((70, 0, 3, 1, 4, 1, 0, 0, 0, 0, 0, 0, 1), 0),
    ((12, 0, 9, 0, 10, 0, 0, 0, 0, 1, 0, 0, 1), 0), ((25, 0.6, 30, 0.5, 20, 0.4, 0, 0, 0, 0, 0, 0, 1), 0),
    ((5, 1, 4, 1, 6, 1, 0, 0, 0, 0, 1, 0, 1), 0), ((90, 0, 12, 0, 8, 0, 0, 0, 0, 0, 0, 0, 1), 0),
)


def _more_blocks() -> Iterator[tuple[tuple, int]]:
    """The same places with other lengths, labelled by the same rules, so that the tree's cuts lie between them."""
    neighbours = ((0, 0), (2, 1), (4, 1), (4, 0), (12, 0), (25, 0), (60, 0))  # words and links
    # article on page, in article, beside, heading, list item, comments, class beside
    outside, inside, loose, head, misled, classed = (
        (1, 0, 0, 0, 0, 0, 0), (1, 1, 0, 0, 0, 0, 0), (0, 0, 0, 0, 0, 0, 0), (0, 0, 0, 1, 0, 0, 0), (0, 1, 0, 0, 0, 0, 1),
        (0, 0, 0, 0, 0, 0, 1))
    never = ((0, 0, 1, 0, 0, 0, 0), (1, 1, 1, 0, 0, 0, 0), (0, 0, 0, 0, 0, 1, 0), (1, 1, 0, 0, 0, 1, 0), (1, 1, 0, 0, 0, 0, 1),
             (1, 0, 0, 0, 0, 0, 1))
    for words in (1, 3, 5, 8, 11, 16, 24, 40, 70, 130):
        for before in neighbours:
            for after in neighbours:
                # neighbours without many links, and the longer of them
                left, right = (w if links < 0.5 else 0 for w, links in (before, after))
                longer = max(left, right)
                for links in (0, 0.7):
                    text = links < 0.5
                    row = (words, links, *before, *after)
                    yield (*row, *inside), 1
                    yield (*row, *outside), 0
                    yield (*row, *loose), int(text and (words >= 12 or min(left, right) >= 4 and longer >= 12 or longer >= 60))
                    yield (*row, *head), int(text and right >= 4)
                    yield (*row, *misled), int(text)
                    yield (*row, *classed), int(text and words >= 60 and longer >= 25)
                    for place in never:
                        yield (*row, *place), 0


LABELLED_BLOCKS = tuple(((*row, 0, 0), label) for row, label in PLAIN_BLOCKS) + MARKED_BLOCKS + tuple(_more_blocks())


def train_tree(table: Sequence = LABELLED_BLOCKS) -> tuple:
    """A decision tree by Gini impurity: ``(label,)`` or ``(feature, threshold, tree up to it, tree above it)``."""
    x, y = np.array([r for r, _ in table], float), np.array([label for _, label in table])

    def grow(rows: np.ndarray) -> tuple:
        labels = y[rows]
        if labels.min() == labels.max():
            return (int(labels[0]),)
        best = None
        for f in range(x.shape[1]):
            values = np.unique(x[rows, f])
            for cut in (values[:-1] + values[1:]) / 2:
                low = x[rows, f] <= cut
                cost = sum(part.size * part.mean() * (1 - part.mean()) for part in (labels[low], labels[~low]))
                if best is None or cost < best[0] - 1e-12:
                    best = (cost, f, float(cut), low)
        if best is None:  # equal rows with different labels
            return (int(labels.mean() >= 0.5),)
        _, f, cut, low = best
        return (f, cut, grow(rows[low]), grow(rows[~low]))

    return grow(np.arange(len(y)))


def classify(tree: tuple, rows: np.ndarray) -> list[bool]:
    out = []
    for r in rows.tolist():
        node = tree
        while len(node) > 1:
            node = node[2] if r[node[0]] <= node[1] else node[3]
        out.append(node[0] == 1)
    return out


def main_text(html: str | None, tree: tuple) -> str:
    page = blocks(html)
    return " ".join(b.text for b, keep in zip(page, classify(tree, features(page))) if keep) if page else ""


def extract(pages: DataFrame, labelled: Sequence = LABELLED_BLOCKS) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    tree = train_tree(labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), tree) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
