"""Main text of web pages from flat text blocks.

A page is cut into flat blocks at block-level tags. Each block gets its word
count and link density, those of the blocks before and after it, whether it is a
heading, whether it lies in an element that the page marks as its article, and
whether its own tag (1) or an element around it (2) is named like a page part such as
a menu or an advert (the article's own tag never is). What an element holds can overrule
its name: a form around the article, or one of prose with few fields, is none; nor is an
element that is only partly named so, a quotation or a section, if it is prose; nor one
around the page's only article. Comments, menus, footers and adverts stay what they are
called. Within a block, the text of an inline element that is named so is left out, unless
the block has no other. A decision tree, grown here from the small labelled table below,
keeps or drops each block: a link between prose is part of the text, one beside other
links is not; a paragraph named like a page part is prose if it is long among prose; pages
that mark no article are decided by words and links alone. Where the tree keeps nothing,
the longest run of blocks that aren't page parts and not mostly links is the text.

Pages are independent, so Spark maps over them with no shuffle; the work in a task
is linear in its pages.

Edge cases: null or empty html gives the empty text; a page cut off in the middle
is read as far as it goes, an unfinished tag at its end is dropped, an unfinished
script or comment reaches to the end; a head ends where its content can't belong to
it, as at text, <body> or a block; tags that are never closed end with the element
around them; repeated rows are each extracted; only page_id, url and html
are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "page_id long, url string, text string, n_chars long"

#: Text in these is never shown as text.
HIDDEN = ("script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "textarea", "select", "title")
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What a head may hold; anything else ends it, closed or not.
METADATA = frozenset("base basefont bgsound link meta noframes".split())
#: Page parts by their tag.
PARTS = frozenset("nav footer aside form dialog menu button".split())
#: Page parts by a word of class, id or role.
PART_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies consent disqus"
    " footer form header masthead menu menubar modal nav navbar navigation newsletter notice notices pagination popup privacy promo promoted"
    " related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
ARTICLE = frozenset(("article", "main"))
CONTAINERS = PARTS | ARTICLE | frozenset("header section div table ul ol dl details figure blockquote body html".split())
#: Those of them by which readers' comments go, however long.
COMMENT_WORDS = frozenset("comment comments disqus replies reply respond".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = CONTAINERS | HEADINGS | frozenset("p li dt dd tr td th caption figcaption pre address hr fieldset legend option summary center thead tbody tfoot".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<hidden>" + "|".join(HIDDEN) + r")\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?:/>|>.*?(?:</(?P=hidden)\s*>|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<tag2>[a-z][a-z0-9:-]*)(?P<rest2>[^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.I | re.S,
)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

#: Readers' comments by names that articles use for their own sections too: not of a <section>.
COMMENT_LISTS = frozenset("discussion discussions responses thread talkback guestbook".split())
#: With these in a class or id, its words tell of the page's build: has-sidebar, ad-hoc.
BUILD_WORDS = frozenset("has with no without layout hoc".split())
#: What no amount of prose makes text, if it is the whole name.
ADVERT_WORDS = frozenset(
    "ad ads advert advertisement adverts banner complementary cookie cookies consent newsletter pagination popup privacy promo promoted related"
    " signup sponsor sponsored subscribe subscription".split()
)
FIELDS = frozenset("input select textarea button".split())
PROSE_WORDS, PROSE_LINKS = 12, 0.3


class Part:
    """An element that is named like a page part, and what it holds."""

    def __init__(self, kind: str, quotes: bool, inside: bool):
        self.kind, self.quotes, self.inside = kind, quotes, inside  # kind: fixed, form, whole or partial name
        self.around = self.main = False  # it holds an article, a main element
        self.fields = self.words = self.prose = 0
        self.linked = 0.0

    def holds(self, words: int, links: float) -> None:
        self.words += words
        self.linked += words * links
        if words >= PROSE_WORDS and links <= PROSE_LINKS:
            self.prose += words

    def lifted(self, other_article: bool, marked: bool) -> bool:
        """Whether its content overrules its name. other_article: the page has one outside page parts."""
        if self.kind == "fixed":
            return False
        if self.around and (self.main or self.kind == "form" or not other_article):
            return True
        if self.linked > PROSE_LINKS * self.words:
            return False
        if self.kind == "form":
            return self.prose >= max(50, 10 * self.fields)
        if self.kind == "advert":
            return False
        if self.inside:
            return self.prose >= 40 and (self.kind == "partial" or self.quotes)
        return not marked and self.kind == "partial" and self.prose >= 80


def part_name(named: list[str], tag: str) -> str:
    """'' or what a class, id or role tells: comment, advert (by its whole name), whole or partial."""
    found = ""
    for name in named:
        words = set(re.split(r"[_-]+", name))
        if not words.isdisjoint(BUILD_WORDS) or ("content" in words and not words.isdisjoint(("wrap", "wrapper", "container"))):
            continue
        if not words.isdisjoint(COMMENT_WORDS) or (tag != "section" and not words.isdisjoint(COMMENT_LISTS)):
            return "comment"
        if name in ADVERT_WORDS:
            found = "advert"
        elif name in PART_WORDS:
            found = found if found == "advert" else "whole"
        elif not words.isdisjoint(PART_WORDS):
            found = found or "partial"
    return found


FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "heading", "article", "part")

#: Labelled blocks: the features above (article: 1 in it, 0 the page marks none, -1 outside the one it marks;
#: part: 1 own tag named like a page part, 2 in one), then 1 for main text.
LABELLED = """
1 1.0 0 0 1 1.0 0 -1 2 0
2 1.0 1 1.0 3 1.0 0 -1 2 0
1 1.0 2 1.0 8 0.0 0 -1 2 0
9 0.0 1 1.0 12 0.0 0 -1 2 0
4 0.0 9 0.0 60 0.0 0 -1 2 0
12 0.0 40 0.0 0 0 0 -1 2 0
25 0.1 80 0.0 0 0 0 -1 2 0
60 0.0 30 0.0 5 0.0 0 -1 2 0
3 0.0 50 0.0 70 0.0 1 -1 2 0
14 0.0 6 0.0 0 0 0 -1 0 0
6 0.3 0 0 10 0.0 0 -1 0 0
45 0.0 3 0.0 8 0.0 0 -1 0 0
5 0.0 2 1.0 50 0.0 1 -1 0 0
90 0.1 20 0.0 20 0.0 0 -1 0 0
10 0.0 8 0.0 60 0.0 1 1 0 1
3 0.0 1 1.0 9 0.0 1 1 0 1
12 0.0 4 0.0 0 0 1 1 0 1
60 0.0 10 0.0 80 0.0 0 1 0 1
150 0.0 60 0.0 3 0.0 0 1 0 1
3 0.0 90 0.0 7 0.0 0 1 0 1
1 0.0 30 0.0 1 0.0 0 1 0 1
7 0.0 2 0.0 14 0.0 0 1 0 1
18 0.2 25 0.0 9 0.0 0 1 0 1
40 0.1 1 0.0 30 0.0 0 1 0 1
9 0.0 120 0.0 12 0.0 0 1 0 1
1 0.0 0 0 0 0 0 1 0 1
2 0.0 3 0.0 1 0.0 0 1 0 1
4 0.0 1 0.0 8 0.0 0 1 0 1
5 0.0 8 0.0 2 0.0 0 1 0 1
6 0.0 2 0.0 40 0.0 0 1 0 1
7 0.0 3 0.0 0 0 0 1 0 1
8 0.0 1 0.0 1 0.0 1 1 0 1
9 0.0 4 1.0 2 0.0 0 1 0 1
3 0.0 5 0.0 3 1.0 0 1 0 1
10 0.0 1 1.0 12 0.0 0 1 0 1
14 0.0 6 0.0 1 0.0 0 1 0 1
2 0.0 9 0.0 5 0.0 0 1 0 1
1 0.0 1 0.0 90 0.0 0 1 0 1
5 0.0 60 0.0 4 0.5 0 1 0 1
20 0.0 3 0.0 2 0.0 0 1 0 1
35 0.3 4 0.0 1 1.0 0 1 0 1
50 0.4 2 0.0 9 0.0 0 1 0 1
6 0.0 2 1.0 2 1.0 1 1 0 1
6 0.0 60 0.0 20 0.1 0 1 2 0
40 0.0 9 0.0 30 0.0 0 1 2 0
2 0.0 70 0.0 90 0.0 0 1 2 0
15 0.3 5 0.0 8 0.0 0 1 2 0
4 0.0 100 0.0 6 0.0 1 1 2 0
1 1.0 0 0 1 1.0 0 0 2 0
11 0.0 3 1.0 60 0.0 0 0 2 0
30 0.0 60 0.0 12 0.0 0 0 2 0
5 0.0 80 0.0 50 0.0 1 0 2 0
70 0.1 12 0.0 3 0.0 0 0 2 0
1 1.0 1 1.0 2 1.0 0 0 0 0
3 0.8 2 1.0 40 0.0 0 0 0 0
6 0.7 50 0.0 2 1.0 0 0 0 0
20 0.6 9 1.0 7 0.9 0 0 0 0
35 0.7 40 0.0 20 0.8 0 0 0 0
4 0.0 2 1.0 1 1.0 0 0 0 0
7 0.1 1 1.0 3 1.0 0 0 0 0
5 0.0 3 0.0 0 0 0 0 0 0
8 0.2 6 0.0 0 0 0 0 0 0
3 0.0 4 1.0 4 0.0 0 0 0 0
50 0.0 8 0.0 60 0.0 0 0 0 1
80 0.1 50 0.0 4 0.5 0 0 0 1
22 0.0 70 0.0 45 0.0 0 0 0 1
30 0.2 25 0.0 35 0.0 0 0 0 1
120 0.0 2 1.0 12 0.1 0 0 0 1
6 0.0 60 0.0 75 0.0 0 0 0 1
9 0.0 40 0.0 25 0.0 0 0 0 1
7 0.0 2 1.0 55 0.0 1 0 0 1
4 0.0 70 0.0 65 0.0 1 0 0 1
11 0.0 6 0.2 30 0.0 1 0 0 1
18 0.0 12 0.0 40 0.0 0 0 0 1
16 0.0 90 0.0 3 1.0 0 0 0 1
1 1.0 3 1.0 2 1.0 0 1 0 0
2 1.0 2 1.0 3 1.0 0 1 0 0
3 1.0 2 1.0 40 0.0 0 1 0 0
4 1.0 50 0.0 3 1.0 0 1 0 0
5 1.0 60 0.0 4 1.0 0 1 0 0
12 1.0 9 1.0 11 1.0 0 1 0 0
9 0.9 70 0.0 10 1.0 0 1 0 0
10 1.0 8 1.0 50 0.0 0 1 0 0
2 1.0 3 1.0 0 0 0 1 0 0
7 1.0 6 1.0 0 0 0 1 0 0
3 1.0 60 0.0 50 0.0 0 1 0 1
6 1.0 40 0.1 30 0.0 0 1 0 1
15 1.0 20 0.0 90 0.1 0 1 0 1
9 0.9 30 0.0 12 0.2 0 1 0 1
25 0.8 12 0.0 60 0.0 0 1 0 1
4 1.0 9 0.0 8 0.0 0 1 0 1
5 1.0 10 0.0 0 0 0 1 0 1
8 1.0 70 0.1 0 0 0 1 0 1
5 1.0 80 0.0 60 0.0 1 1 0 1
3 1.0 0 0 40 0.0 1 1 0 1
8 1.0 30 0.1 25 0.2 1 1 0 1
6 1.0 3 1.0 70 0.0 1 1 0 1
2 1.0 5 1.0 30 0.1 1 1 0 1
60 0.0 40 0.0 50 0.0 0 1 1 1
45 0.1 30 0.0 20 0.1 0 1 1 1
80 0.0 10 0.0 90 0.0 0 1 1 1
35 0.0 60 0.0 0 0 0 1 1 1
120 0.1 8 0.0 15 0.0 0 1 1 1
6 0.0 40 0.0 60 0.0 0 1 1 0
3 0.9 50 0.0 20 0.0 0 1 1 0
12 0.2 70 0.0 30 0.0 0 1 1 0
18 0.0 25 0.0 9 0.0 0 1 1 0
22 0.8 30 0.0 40 0.0 0 1 1 0
40 0.9 60 0.0 50 0.0 0 1 1 0
2 1.0 3 1.0 3 1.0 0 1 1 0
4 0.0 60 0.0 50 0.0 1 1 2 0
80 0.0 60 0.0 70 0.0 0 1 2 0
50 0.1 80 0.0 40 0.0 0 1 2 0
9 0.0 30 0.0 30 0.0 0 0 1 0
50 0.0 30 0.0 60 0.0 0 0 1 1
70 0.1 50 0.0 40 0.0 0 0 1 1
60 0.0 50 0.0 45 0.0 0 -1 1 0
3 1.0 60 0.0 50 0.0 0 0 0 1
5 1.0 45 0.0 80 0.1 0 0 0 1
4 1.0 70 0.0 55 0.0 1 0 0 1
4 1.0 2 1.0 60 0.0 0 0 0 0
3 1.0 60 0.0 3 1.0 0 0 0 0
12 0.9 10 1.0 9 1.0 0 0 0 0
2 0.0 60 0.0 70 0.0 0 0 0 1
5 0.0 30 0.0 25 0.0 0 0 0 1
8 0.0 40 0.0 4 1.0 0 0 0 0
9 0.0 5 0.5 6 0.0 0 0 0 0
12 0.0 3 1.0 0 0 0 0 0 0
7 0.0 0 0 3 1.0 0 0 0 0
6 0.0 3 1.0 30 0.0 0 0 0 0
13 0.0 2 1.0 55 0.0 0 0 0 0
3 0.0 7 1.0 0 0 0 1 0 1
3 0.0 5 1.0 2 0.0 0 1 0 1
1 0.0 2 1.0 1 0.0 0 1 0 1
6 0.0 1 1.0 4 0.0 0 1 0 1
8 0.0 12 1.0 15 0.0 0 1 0 1
14 0.0 4 1.0 40 0.0 0 1 0 1
20 0.1 6 0.8 0 0 0 1 0 1
30 0.0 3 1.0 2 0.0 0 1 0 1
40 0.1 2 1.0 6 0.0 0 1 0 1
64 0.0 9 1.0 3 0.0 0 1 0 1
5 0.2 8 0.7 9 0.1 0 1 0 1
2 0.0 20 0.6 1 0.0 0 1 0 1
10 0.0 15 1.0 80 0.0 0 1 0 1
4 0.3 30 0.5 7 0.2 0 1 0 1
6 1.0 4 1.0 5 0.0 0 1 0 0
4 0.0 2 1.0 3 0.0 0 0 0 0
5 0.0 3 1.0 5 0.0 0 0 0 0
2 0.0 1 1.0 2 0.0 0 0 0 0
3 0.0 4 0.0 60 0.0 0 0 0 1
2 0.0 5 0.0 40 0.0 0 0 0 1
6 0.0 3 0.0 25 0.0 0 0 0 1
3 0.0 44 0.0 22 0.0 0 0 0 1
3 0.0 66 0.0 44 0.1 0 0 0 1
2 1.0 28 0.0 0 0 0 0 0 0
3 1.0 60 0.0 0 0 0 0 0 0
7 1.0 90 0.1 0 0 0 0 0 0
2 1.0 40 0.0 2 1.0 0 0 0 0
4 1.0 70 0.0 5 1.0 0 0 0 0
5 1.0 44 0.0 4 1.0 0 0 0 0
3 1.0 22 0.0 60 0.0 0 0 0 1
4 0.0 90 0.0 3 1.0 0 1 1 0
6 0.1 40 0.0 5 1.0 0 1 1 0
3 0.0 5 1.0 4 1.0 0 1 1 0
9 0.0 12 0.0 7 1.0 0 1 1 0
60 0.0 30 0.0 4 1.0 0 1 1 1
45 0.0 60 0.0 6 1.0 0 1 1 1
60 0.0 80 0.0 0 0 0 0 0 1
35 0.0 50 0.0 0 0 0 0 0 1
90 0.1 30 0.0 0 0 0 0 0 1
50 0.0 0 0 0 0 0 0 0 1
40 0.0 2 1.0 50 0.0 0 0 0 1
30 0.0 3 1.0 70 0.0 0 0 0 1
45 0.0 4 1.0 0 0 0 0 0 1
5 0.0 30 0.0 3 1.0 0 1 0 1
8 0.0 50 0.0 6 1.0 0 1 0 1
12 0.0 20 0.1 9 1.0 0 1 0 1
14 0.1 5 0.0 4 1.0 0 1 0 1
7 0.0 4 1.0 4 1.0 0 1 0 1
2 0.0 6 0.9 8 1.0 0 1 0 1
10 0.2 9 0.0 2 0.8 0 1 0 1
"""


def grow(rows: np.ndarray, labels: np.ndarray, least: int = 1) -> tuple:
    """A decision tree by Gini impurity: (feature, bound, if at most, if more), or a label."""
    share = labels.mean()
    if share in (0.0, 1.0) or len(labels) < 2 * least:
        return (int(share >= 0.5),)
    best = None
    for k in range(rows.shape[1]):
        values = np.unique(rows[:, k])
        for bound in (values[1:] + values[:-1]) / 2:
            low = rows[:, k] <= bound
            if low.sum() < least or (~low).sum() < least:
                continue
            impurity = sum(s.sum() * p * (1 - p) for s in (low, ~low) for p in (labels[s].mean(),))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, k, float(bound), low)
    if best is None:
        return (int(share >= 0.5),)
    _, k, bound, low = best
    return (k, bound, grow(rows[low], labels[low], least), grow(rows[~low], labels[~low], least))


def labelled_tree() -> tuple:
    rows = np.array([[float(x) for x in line.split()] for line in LABELLED.split("\n") if line])
    return grow(rows[:, :-1], rows[:, -1])


def judge(tree: tuple, features: tuple) -> bool:
    while len(tree) > 1:
        tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
    return bool(tree[0])


def flat_blocks(html: str) -> list[tuple[str, int, float, int, int, int]]:
    """(text, words, link density, heading, in the article, page part) of each block with text."""
    out, parts, shown, linked = [], [], 0, 0
    stack: list[tuple[str, tuple[Part, ...], int]] = []  # tag, page parts and articles around, itself included
    around: tuple[Part, ...] = ()
    article = heading = link = own = head = 0
    aside, depth, hid, hid_shown, hid_linked = "", 0, [], 0, 0  # an open inline page part: tag, open ones of its name; its texts

    def close():
        nonlocal shown, linked, own, aside, depth, hid_shown, hid_linked
        text = " ".join(unescape("".join(parts)).split())
        if not text and hid:  # nothing but page parts
            text, shown, linked, own = " ".join(unescape("".join(hid)).split()), hid_shown, hid_linked, 2
        if text:
            words, links = text.count(" ") + 1, linked / max(shown, 1)
            for p in around:
                p.holds(words, links)
            out.append((text, words, links, int(heading > 0), int(article > 0), own, around))
        parts.clear()
        hid.clear()
        aside, depth = "", 0
        shown = linked = own = hid_shown = hid_linked = 0

    for m in _TOKEN.finditer(html):
        text = m["text"]
        if text is not None:
            if head and not text.strip():
                continue
            head = 0
            n = len(text) - text.count(" ")
            if depth:
                hid.append(text)
                hid_shown += n
                hid_linked += n * (link > 0)
                continue
            parts.append(text)
            shown += n
            if link:
                linked += n
            continue
        tag = m["tag"] or m["tag2"]
        if tag is None or not m[0].endswith(">"):
            if m["hidden"] and m["hidden"].lower() in FIELDS:
                for p in around:
                    p.fields += 1
            if m["hidden"] and m["hidden"].lower() in BLOCKS:
                close()
            continue
        tag, rest = tag.lower(), m["rest"] or m["rest2"] or ""
        if tag == "head":
            head = int(not (m["end"] or m["end2"]))
            continue
        if tag not in METADATA and not (m["end"] or m["end2"]):
            head = 0
        if m["end"] or m["end2"]:
            if tag == aside:
                depth -= 1
                aside = aside if depth else ""
            if tag == "a":
                link = 0
            elif tag in BLOCKS:
                close()
                if tag in HEADINGS:
                    heading = 0
                elif tag in CONTAINERS:
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] == tag:
                            del stack[k:]
                            around, article = stack[-1][1:] if stack else ((), 0)
                            link = heading = 0
                            break
            continue
        if tag in FIELDS:
            for p in around:
                p.fields += 1
        name = part_name([w for found in _NAMED.findall(rest) for w in "".join(found).lower().split()], tag) if rest else ""
        if tag == "a":
            link = 1
        elif tag in BLOCKS:
            close()
            link = 0
            heading = int(tag in HEADINGS)
            if tag in CONTAINERS:
                if tag in ARTICLE:
                    for p in around:
                        p.around, p.main = True, p.main or tag == "main"
                    article += 1
                    if name == "comment" and tag == "article":
                        around = (*around, Part("fixed", False, True))
                elif tag not in ("body", "html"):
                    if tag in PARTS and tag != "form" or name == "comment":
                        around = (*around, Part("fixed", False, article > 0))
                    elif tag == "form" or name or (tag == "header" and not article):
                        around = (*around, Part("form" if tag == "form" else name or "whole", tag in ("blockquote", "section", "figure", "details"), article > 0))
                if not rest.endswith("/"):
                    stack.append((tag, around, article))
                elif tag not in ("body", "html"):
                    around, article = stack[-1][1:] if stack else ((), 0)
            else:
                own = 0 if not name or tag in VOID else 1 + (name == "comment")
        elif tag == "br":
            (hid if depth else parts).append(" ")
        elif tag == aside:
            depth += 1
        elif name and not depth and tag not in VOID and not rest.endswith("/"):
            aside, depth = tag, 1
    close()
    marked = any(b[4] for b in out)
    other = any(b[4] and not b[6] for b in out)
    lifted = {p for b in out for p in b[6] if p.lifted(other, marked)}
    return [(*b[:5], b[5] if lifted.issuperset(b[6]) else 2) for b in out]


def densest_run(blocks: list[tuple]) -> list[str]:
    """The run of blocks with the most words that aren't page parts and not mostly links; of the article, where there is one."""
    marked = any(b[4] and b[5] < 2 for b in blocks)
    runs, words = [[]], [0]
    for text, n, links, _, article, part in blocks:
        if part == 2 or links > 0.5 or (marked and not article):
            runs.append([])
            words.append(0)
        else:
            runs[-1].append(text)
            words[-1] += n
    return runs[words.index(max(words))]


def main_text(html: str | None, tree: tuple) -> str:
    blocks = flat_blocks(html or "")
    marked = any(b[4] for b in blocks)
    none = ("", 0, 0.0, 0, 0, 0)
    kept = []
    for before, at, after in zip([none, *blocks], blocks, [*blocks[1:], none], strict=False):
        article = (1 if at[4] else -1) if marked else 0
        if judge(tree, (at[1], at[2], before[1], before[2], after[1], after[2], at[3], article, at[5])):
            kept.append(at[0])
    return "\n".join(kept or densest_run(blocks))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    tree = labelled_tree()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["text"] = [main_text(h, tree) for h in batch["html"]]
            batch["n_chars"] = batch["text"].str.len().astype("int64") if len(batch) else pd.Series([], dtype="int64")
            batch["page_id"] = batch["page_id"].astype("Int64")
            yield batch[["page_id", "url", "text", "n_chars"]]

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInPandas(run, RESULT)
