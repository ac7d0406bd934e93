"""Main text of web pages by a linear-chain conditional random field (operator 8).

A page is read into leaf blocks, each with the tags and class words above it. Class words count only where they tell
parts of a page apart: not those of html and body, of an element that holds the page's first heading, its main element or
nearly all of its text, nor those of a class that names a state ("no-comments", "has-sidebar"). A block's features are its
ancestors, what its text looks like, and whether its neighbours are links; the field's weights, and those of transitions between neighbouring blocks, are fitted by
maximum likelihood on labelled pages, and Viterbi's best path marks the blocks of the article. The labelled pages come
from a rule (TRAIN_PAGES, whose parts, containers, class names and layouts are drawn at random), since the tables hold
no labels for pages; tests measure other layouts, and the tables' pages against a plain extractor.

Defined cases: null, empty or tag-only html gives an empty text; unclosed and stray tags, comments and quotes do no
harm (a head, list of options or drawing without its end ends where other content begins, and an object is passed over
if no end of one follows); reading takes time in proportion to the page, however deep or broken it is; null page_id or url is carried; repeated rows are each extracted; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import random
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TRAIN_PAGES = 800
TRAIN_SEED = 11
STEPS = 120
#: Elements that hold no text for readers, that have no end tag, and that run on within a line.
SILENT = frozenset("script style noscript template head title textarea select option svg iframe object".split())
RAW = frozenset("script style noscript template title textarea iframe".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: What a head, a list of options or a drawing may hold; other elements (block elements) end it.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
IN_SELECT = frozenset("option optgroup hr script template".split())
OUT_OF_SVG = frozenset("article aside blockquote body center dd div dl dt footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table ul".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strong sub sup time tt u var wbr".split())
#: Ancestors and class words that are features.
TAGS = "article main nav aside header footer form section ul ol table td dl h1 h2 h3 p li blockquote pre figure div button".split()
TAG_SET = frozenset(TAGS)
CLASSES = {
    "advert": ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner"), "menu": ("nav", "menu", "breadcrumb", "breadcrumbs", "navbar", "toc"),
    "side": ("sidebar", "side", "widget", "related", "recommended", "more"), "comment": ("comment", "comments", "reply", "replies", "discussion", "disqus"),
    "notice": ("cookie", "cookies", "notice", "consent", "newsletter", "subscribe", "popup", "alert", "modal"), "foot": ("footer", "foot", "copyright", "legal"),
    "head": ("header", "masthead", "topbar", "logo"), "share": ("share", "social", "tags", "meta", "byline"),
    "content": ("content", "article", "post", "entry", "story", "body", "text", "main"), "form": ("form", "login", "signup", "search"),
}
CLASS_OF = {word: k for k, words in CLASSES.items() for word in words}
#: Words of a class that names a state of the page or of an element, not a part.
STATES = frozenset("no not non has have with without is are enabled disabled open opened closed free on off active inactive hide hidden show shown ready loaded".split())
#: Share of a page's text from which an element is taken for a wrapper.
WRAPPER = 0.9
#: What headings over readers' comments, and over lists of links, say.
OVER_COMMENTS = re.compile(r"(?:\d+|no|one|two) (?:comments?|repl(?:y|ies)|responses?|thoughts?)\b|(?:leave|post|add|write) (?:a|your) (?:comment|reply)|(?:comments?|replies|responses|discussion)\W*(?:\(?\d+\)?)?$", re.I)
OVER_LINKS = re.compile(r"(?:related|recent|popular|latest|trending|most read|more (?:from|on|in|stories)|see also|read (?:next|more)|you (?:may|might)|tags|topics|categories|archives|navigation|menu|pages|links|follow us|share)\b", re.I)

#: The parts of a tag are counted, so that a quote that is never closed is not followed to the page's end from each tag anew.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'){0,400}+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)>", re.S)
NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPACES = re.compile(r"[\x20\x09-\x0D]+")


class Block:
    __slots__ = ("text", "tags", "classes", "linked")

    def __init__(self, text: str, tags: frozenset, linked: float):
        self.text, self.tags, self.classes, self.linked = text, tags, frozenset(), linked


def class_words(attributes: str) -> frozenset:
    found = [a or b or c for a, b, c in NAMES.findall(attributes)] if "=" in attributes else []
    parts = [re.split(r"[^a-z]+", name.lower()) for x in found for name in x.split()]
    return frozenset(CLASS_OF[w] for words in parts if not STATES.intersection(words) for w in words if w in CLASS_OF)


def letters(text: str) -> int:
    return sum(map(str.isalnum, text))


class Reader:
    """Leaf blocks of a page in one pass. What an open element changes is kept with it, or counted, so that no step looks
    through all open elements."""

    def __init__(self, page: str):
        self.page, self.out = page, []
        self.parts: list[str] = []
        self.linked = 0
        #: name, known tags above and with it, class words, blocks before it, order of opening
        self.stack: list[tuple[str, frozenset, frozenset, int, int]] = []
        self.open: Counter = Counter()
        self.silent, self.order = 0, 0
        self.places: dict[str, list[int]] = {"head": [], "choice": [], "svg": [], "foreignobject": []}
        #: class words, first and last block, order of opening and closing of elements; orders of main elements and first headings
        self.named: list[tuple[frozenset, int, int, int, int]] = []
        self.marks: list[int] = []

    def kind(self, name: str) -> str:
        return "choice" if name in ("select", "option") else name

    def push(self, name: str, attributes: str) -> None:
        self.order += 1
        above = self.stack[-1][1] if self.stack else frozenset()
        classes = class_words(attributes) if name not in INLINE and name not in ("html", "body") else frozenset()
        if name == "main" or name == "h1" and not self.open["h1"] and not any(b.tags and "<h1>" in b.tags for b in self.out[-1:]):
            self.marks.append(self.order)
        tags = above if f"<{name}>" in above or name not in TAG_SET else above | {f"<{name}>"}
        if name == "article" and "<article>" in above:
            tags = tags | {"article in article"}
        self.stack.append((name, tags, classes, len(self.out), self.order))
        self.open[name] += 1
        self.silent += name in SILENT
        if self.kind(name) in self.places:
            self.places[self.kind(name)].append(len(self.stack) - 1)

    def pop(self) -> str:
        name, _, classes, first, began = self.stack.pop()
        self.open[name] -= 1
        self.silent -= name in SILENT
        if self.kind(name) in self.places:
            self.places[self.kind(name)].pop()
        if classes:
            self.named.append((classes, first, len(self.out), began, self.order))
        return name

    def close_block(self) -> None:
        if self.parts:
            text = SPACES.sub(" ", entities.unescape("".join(self.parts))).strip(" ")
            self.parts.clear()
            if text:
                self.out.append(Block(text, self.stack[-1][1] if self.stack else frozenset(), min(1.0, self.linked / max(1, letters(text)))))
        self.linked = 0

    def end_open(self, name: str) -> None:
        """Ends what was left open and cannot hold this element."""
        at = []
        if self.places["head"] and name not in IN_HEAD:
            at.append(self.places["head"][0])
        if self.places["choice"] and name not in INLINE and name not in IN_SELECT:
            at.append(self.places["choice"][0])
        if self.places["svg"] and name in OUT_OF_SVG:
            inside = bisect(self.places["svg"], self.places["foreignobject"][-1]) if self.places["foreignobject"] else 0
            at += self.places["svg"][inside : inside + 1]
        if at:
            while len(self.stack) > min(at):
                self.pop()

    def say(self, text: str) -> None:
        if self.stack and self.stack[-1][0] == "head" and SPACES.sub("", text):
            self.pop()
        if text and not self.silent:
            self.parts.append(text)
            if self.open["a"]:
                self.linked += letters(entities.unescape(text))

    def tag(self, name: str, closing: bool, attributes: str) -> None:
        if closing:
            if self.open[name]:
                if name not in INLINE:
                    self.close_block()
                while self.pop() != name:
                    pass
            return
        if self.silent:
            self.end_open(name)
        if name == "br":
            self.say(" ")
            return
        if name not in INLINE:
            self.close_block()
            # An open paragraph, and inline elements in it, end where another block begins.
            while self.stack and (self.stack[-1][0] in INLINE or self.stack[-1][0] == "p" or self.stack[-1][0] == name and name in ("li", "dt", "dd", "tr", "td", "th", "option")):
                self.pop()
        closed = attributes.endswith("/") and (len(attributes) == 1 or attributes[-2] in " \t\n\r\f\"'")  # else the stroke is a value's
        if name in VOID or closed or name == "object" and self.at > self.last_object:
            return
        self.push(name, attributes)
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(self.page, self.at)
            self.at = end.end() if end else len(self.page)
            self.pop()

    def read(self) -> list[Block]:
        page = self.page
        self.last_object = max((m.start() for m in re.finditer("</object", page, re.I)), default=-1)
        # What comes after the last ">" holds no tag; an open comment there has no text.
        upto, self.at = page.rfind(">") + 1, 0
        while m := TOKEN.search(page, self.at, upto):
            self.say(page[self.at : m.start()])
            self.at = m.end()
            if m[0].startswith("<!--") and not m[0].endswith("-->"):  # never closed
                self.at = len(page)
                break
            name = (m[2] or m[5] or "").lower()
            if name:
                self.tag(name, bool(m[1] or m[4]), m[3] if m[2] else m[6])
        rest = page[self.at :]
        self.say(rest[: rest.find("<!--")] if "<!--" in rest else rest)
        self.close_block()
        while self.stack:
            self.pop()
        self.give_classes()
        return self.out

    def give_classes(self) -> None:
        """Class words of elements to the blocks in them, by sums of what begins and ends at each block."""
        sizes = np.concatenate([[0], np.cumsum([len(b.text) for b in self.out])]) if self.out else np.zeros(1)
        change: dict[str, np.ndarray] = {}
        for classes, first, last, began, ended in self.named:
            holds = bisect(self.marks, ended) > bisect(self.marks, began)
            if first == last or holds or sizes[last] - sizes[first] >= WRAPPER * sizes[-1] and last - first > 1:
                continue
            for k in classes:
                own = change.setdefault(k, np.zeros(len(self.out) + 1, int))
                own[first] += 1
                own[last] -= 1
        for k, own in change.items():
            for i in np.flatnonzero(np.cumsum(own)):
                self.out[i].classes |= {k}


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks in page order: runs of text and inline elements between other tags."""
    return Reader(page or "").read()


FEATURES = [
    *(f"<{t}>" for t in TAGS), "article in article", *CLASSES, "words<4", "words<10", "words<25", "words>24", "linked", "all linked", "sentence", "commas", "(c)", "first", "last", "only",
    "no container", "links before", "links after", "heading over links", "over links", "over comments", "after over comments", "one",
]
INDEX = {name: k for k, name in enumerate(FEATURES)}
HEADINGS = {"<h1>", "<h2>", "<h3>"}


def features(found: list[Block]) -> np.ndarray:
    x = np.zeros((len(found), len(FEATURES)))
    links = [b.linked >= 0.8 for b in found]
    after = False
    for k, b in enumerate(found):
        n = b.text.count(" ") + 1
        on = [*b.tags, *b.classes]
        on.append("words<4" if n < 4 else "words<10" if n < 10 else "words<25" if n < 25 else "words>24")
        if b.linked:
            on.append("all linked" if links[k] else "linked")
        if b.text[-1] in ".!?\"'”":
            on.append("sentence")
        if b.text.count(",") > 1:
            on.append("commas")
        if "©" in b.text or "(c)" in b.text.lower():
            on.append("(c)")
        if not b.tags & {"<article>", "<main>", "<nav>", "<aside>", "<header>", "<footer>", "<form>"} and not b.classes:
            on.append("no container")
        on += ["links before"] * (k > 0 and links[k - 1])
        if k + 1 < len(found) and links[k + 1]:
            on += ["links after"] + ["heading over links"] * bool(b.tags & HEADINGS or n < 6)
        if n < 12 and OVER_LINKS.match(b.text):
            on.append("over links")
        if n < 12 and OVER_COMMENTS.match(b.text):
            on.append("over comments")
            after = True
        elif after:
            on.append("after over comments")
        on += ["first"] * (k == 0) + ["last"] * (k == len(found) - 1) + ["only"] * (len(found) == 1) + ["one"]
        x[k, [INDEX[f] for f in on]] = 1
    return x


class Maker:
    """Writes labelled pages: parts of many forms, each in one of several containers, in layouts drawn at random."""

    SYLLABLES = "an be ci do er fu ga hi in jo ka lu mo ne or pa qui re sa ti un ve zu ß é ñ".split()

    def __init__(self, r: random.Random):
        self.r, self.parts, self.labels = r, [], []

    def add(self, fragment: str, *labels: int) -> None:
        self.parts.append(fragment)
        self.labels.extend(labels)

    def often(self, share: float) -> bool:
        return self.r.random() < share

    def phrase(self, low: int, high: int) -> str:
        return " ".join("".join(self.r.choices(self.SYLLABLES, k=self.r.randint(1, 4))) for _ in range(self.r.randint(low, high)))

    def sentences(self, n: int) -> str:
        return " ".join(self.phrase(2, 18).capitalize() + self.r.choice(". . . ! ? ,".split()) for _ in range(n))

    def named(self, kind: str) -> str:
        """A class or id that has a word of the kind in it, as sites write them."""
        word = self.r.choice(CLASSES[kind])
        name = self.r.choice((word, word, f"site-{word}", f"{word}-{self.r.randint(1, 9)}", f"block {word}", f"js_{word} wide", word.title()))
        return f' {self.r.choice(("class", "class", "id"))}="{name}"'

    def links(self, n: int) -> str:
        one = lambda: f'<a href="/{self.phrase(1, 1)}">{self.phrase(1, 4)}</a>'
        if self.often(0.7):
            return "<ul>" + "".join(f"<li>{one()}</li>" if self.often(0.8) else f"<li>{one()}" for _ in range(n)) + "</ul>"
        return "".join(f"<div>{one()}</div>" if self.often(0.5) else f"<p>{one()}</p>" for _ in range(n))

    def within(self, kind: str, tags: str, inner: str, *labels: int) -> None:
        """inner in an element that its tag, its class or both give away."""
        tag = self.r.choice([*tags.split(), "div"])
        self.add(f"<{tag}{self.named(kind) if tag == 'div' or self.often(0.4) else ''}>{inner}</{tag}>", *labels)

    def linked(self, kind: str, tags: str) -> None:
        n = self.r.randint(2, 7)
        self.within(kind, tags, self.links(n), *[0] * n)

    def plain_menu(self) -> None:
        """Links that neither a tag nor a class gives away: in one line, in a table, in a bare list, or under a heading."""
        one = lambda: f'<a href="/{self.phrase(1, 1)}">{self.phrase(1, 3)}</a>'
        n, draw = self.r.randint(2, 7), self.r.randrange(5)
        if draw < 2:
            tag, between = self.r.choice(("div", "p", "td", "center")), self.r.choice((" | ", " ", " &middot; ", " - ", " / "))
            inner = f"<{tag}>{between.join(one() for _ in range(n))}</{tag}>"
            self.add(f"<table><tr>{inner}</tr></table>" if tag == "td" else inner, 0)
        elif draw == 2:
            self.add("<table><tr>" + "".join(f"<td>{one()}</td>" for _ in range(n)) + "</tr></table>", *[0] * n)
        else:
            self.links_below(n)

    def links_below(self, n: int) -> None:
        """A heading, of known words or not, over a list of links."""
        says = self.r.choice(("Related", "Recent posts", "See also", "More from us", "Popular now", "Categories", "Archives", "You may also like")) if self.often(0.7) else self.phrase(1, 3)
        tag = self.r.choice(("h2", "h3", "h4", "p", "div"))
        outer = self.r.choice(("section", "div", "div", "aside"))
        self.add(f"<{outer}><{tag}>{says}</{tag}>{self.links(n)}</{outer}>", *[0] * (n + 1))

    def wrapped(self) -> tuple[str, str]:
        """What opens and closes an element around nearly all of the page, of any name."""
        if self.often(0.5):
            return "", ""
        word = self.r.choice(CLASSES[self.r.choice(list(CLASSES))])
        name = self.r.choice((f"has-{word}", f"no-{word}", f"{word}-enabled", f"page {word}-right", f"with-{word} site", "site", "wrapper", f"layout-{word}"))
        return f'<div class="{name}">', "</div>"

    def aside(self) -> None:
        """An advert or a notice, of one block or two."""
        n = self.r.choice((1, 1, 2))
        inner = self.sentences(1) if n == 1 else f"<h3>{self.phrase(1, 4)}</h3><p>{self.sentences(1)}</p>"
        self.add(f"<div{self.named(self.r.choice(('advert', 'notice')))}>{inner}</div>", *[0] * n)

    def paragraph(self) -> None:
        """One part of an article."""
        text, draw = self.sentences(self.r.choice((1, 1, 2, 4, 8))), self.r.randrange(14)
        if self.often(0.3):
            text += f" <a href='#'>{self.phrase(1, 2)}</a>, <em>{self.phrase(1, 3)}</em> &amp; {self.phrase(1, 3)}."
        if draw < 6:
            self.add(f"<p>{text}" + ("</p>" if self.often(0.8) else ""), 1)
        elif draw == 6:
            self.add(f"<h{self.r.randint(2, 4)}>{self.phrase(1, 6)}", 1)
            self.parts[-1] += f"</h{self.parts[-1][2]}>"
        elif draw == 7:
            self.add(f"<ul><li>{text}</li><li>{self.phrase(2, 8)}</li></ul>", 1, 1)
        elif draw == 8:
            self.add(f"<blockquote>{text}</blockquote>" if self.often(0.5) else f"<pre>{text}</pre>", 1)
        elif draw == 9:
            self.add(f"<figure><img src=x><figcaption>{self.phrase(3, 9)}</figcaption></figure>", 1)
        elif draw == 10:
            self.add(f"<table><tr><td>{self.phrase(1, 3)}</td><td>{self.phrase(1, 5)}</td></tr></table>", 1, 1)
        elif draw == 11:
            self.add(f"<dl><dt>{self.phrase(1, 3)}</dt><dd>{text}</dd></dl>", 1, 1)
        elif draw == 12:
            self.add(f"<div>{text}<br><br>{self.sentences(1)}</div>", 1)
        else:
            self.add(f"<section><p>{text}</p></section>", 1)

    def article(self) -> None:
        tag = self.r.choice("article article main main+article section+article div div div table none".split())
        name = self.named("content")
        opened = {"div": f"<div{name}>", "table": f"<table><tr><td{name}>", "none": ""}.get(tag, "".join(f"<{t}>" for t in tag.split("+")))
        closed = {"div": "</div>", "table": "</td></tr></table>", "none": ""}.get(tag, "".join(f"</{t}>" for t in reversed(tag.split("+"))))
        self.add(opened)
        if self.often(0.85):
            self.add(f"<h1>{self.phrase(2, 12)}</h1>", 1)
        for _ in range(self.r.randint(1, 10)):
            self.paragraph()
            if self.often(0.08):
                self.aside()
            if self.often(0.04):
                self.linked("share", "div")
        self.add(closed)

    def comments(self) -> None:
        """Readers' comments: a section of a known name or under a known heading, comments in elements of many forms."""
        n = self.r.randint(1, 4)
        named = self.often(0.75)
        inner, labels = "", []
        if not named or self.often(0.6):
            says = self.r.choice((f"{self.r.randint(1, 99)} comments", f"{self.r.randint(2, 40)} replies", "Comments", "1 response", f"{self.r.randint(2, 9)} thoughts on {self.phrase(1, 6)}", "Discussion"))
            tag = self.r.choice(("h2", "h3", "h4", "div"))
            inner += f"<{tag}>{says}</{tag}>"
            labels.append(0)
        form = self.r.choice(("p", "div", "article", "li", "by"))
        for _ in range(n):
            text = self.sentences(self.r.choice((1, 2, 3)))
            if form in ("p", "div"):
                inner += f"<{form}>{text}</{form}>"
                labels.append(0)
            elif form == "article":
                inner += f"<article{self.named('comment') if self.often(0.6) else ''}><p>{text}</p></article>"
                labels.append(0)
            else:
                tag = "li" if form == "li" else "div"
                inner += f"<{tag}><b>{self.phrase(1, 2)}</b> {self.r.choice(('says:', 'wrote', '', '2 days ago'))}<p>{text}</p></{tag}>"
                labels += [0, 0]
        if form == "li":
            inner = inner.replace("<li>", "<ol><li>", 1) + "</ol>"
        if self.often(0.3):
            inner += f"<h3>{self.r.choice(('Leave a reply', 'Post a comment', 'Add your comment'))}</h3>"
            labels.append(0)
        tag = self.r.choice(("section", "div", "div"))
        self.add(f"<{tag}{self.named('comment') if named else ''}>{inner}</{tag}>", *labels)

    def page(self) -> tuple[str, list[int]]:
        if self.often(0.12):  # nothing but an article
            self.article()
            return self.head() + "".join(self.parts), self.labels
        opened, closed = self.wrapped()
        self.add(opened)
        if self.often(0.4):
            self.within("head", "header", f"<div>{self.phrase(1, 4)}</div>", 0)
        first = [lambda: self.linked("menu", "nav nav"), self.aside, lambda: self.linked("side", "aside"), self.plain_menu]
        for make, share in zip(first, (0.7, 0.5, 0.2, 0.3), strict=True):
            if self.often(share):
                make()
        inside = self.often(0.3)
        if inside:  # what comes after the article shares an element with it
            outer = self.r.choice(("main", "div", "article", "section"))
            inner, done = self.wrapped()
            self.add(f"<{outer}>{inner}")
        self.article()
        last = [
            lambda: self.linked("side", "aside"), self.comments, self.aside, lambda: self.linked("share", "div"), lambda: self.links_below(self.r.randint(2, 6)),
            lambda: self.within("form", "form form", f"<p>{self.phrase(2, 6)}</p><input type=text><button>{self.phrase(1, 2)}</button>", 0, 0),
        ]
        for make in last:
            if self.often(0.27):
                make()
        if inside:
            self.add(f"{done}</{outer}>")
            if self.often(0.2):
                self.comments()
        if self.often(0.2):
            self.plain_menu()
        if self.often(0.85):
            self.within("foot", "footer footer", ("&copy; " if self.often(0.5) else "") + self.sentences(1), 0)
        self.add(closed)
        return self.head() + self.r.choice(("", "\n")).join(self.parts), self.labels

    def head(self) -> str:
        return self.r.choice((f"<html><head><title>{self.phrase(2, 5)}</title><body>", f"<!DOCTYPE html><head><meta charset=utf-8><title>{self.phrase(3, 6)}</title></head><body>", "<body>", ""))


def labelled_page(r: random.Random) -> tuple[str, list[int]]:
    """A page, and for each of its blocks whether it belongs to the article."""
    return Maker(r).page()


def fitted(xs: list[np.ndarray], ys: list[list[int]], steps: int = STEPS, penalty: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Weights of features (one column a label) and of transitions, by Adam on the penalised likelihood of all pages."""
    longest = max(map(len, xs))
    x = np.zeros((len(xs), longest, len(FEATURES)))
    y = np.zeros((len(xs), longest), int)
    mask = np.zeros((len(xs), longest))
    for k, (a, b) in enumerate(zip(xs, ys, strict=True)):
        x[k, : len(a)], y[k, : len(b)], mask[k, : len(b)] = a, b, 1
    weights, moves = np.zeros((len(FEATURES), 2)), np.zeros((2, 2))
    state = [np.zeros_like(p) for p in (weights, moves, weights, moves)]
    hot = np.eye(2)[y] * mask[..., None]
    seen = np.einsum("nti,ntj,nt->ij", hot[:, :-1], hot[:, 1:], mask[:, 1:])
    for step in range(1, steps + 1):
        local = x @ weights
        up, down = np.zeros_like(local), np.zeros_like(local)
        up[:, 0] = local[:, 0]
        for t in range(1, longest):
            new = local[:, t] + np.logaddexp(up[:, t - 1, 0, None] + moves[0], up[:, t - 1, 1, None] + moves[1])
            up[:, t] = np.where(mask[:, t, None] > 0, new, up[:, t - 1])
        norm = np.logaddexp(up[:, -1, 0], up[:, -1, 1])
        for t in range(longest - 2, -1, -1):
            nxt = local[:, t + 1] + down[:, t + 1]
            new = np.logaddexp(nxt[:, 0, None] + moves[:, 0], nxt[:, 1, None] + moves[:, 1])
            down[:, t] = np.where(mask[:, t + 1, None] > 0, new, 0)
        p = np.exp(up + down - norm[:, None, None]) * mask[..., None]
        pair = up[:, :-1, :, None] + moves + (local + down)[:, 1:, None, :] - norm[:, None, None, None]
        pairs = (np.exp(np.where(mask[:, 1:, None, None] > 0, pair, -np.inf))).sum(axis=(0, 1))
        grads = (np.einsum("ntf,ntk->fk", x, hot - p) / len(xs) - penalty * weights, (seen - pairs) / len(xs) - penalty * moves)
        for k, (value, g) in enumerate(zip((weights, moves), grads, strict=True)):
            state[k] = 0.9 * state[k] + 0.1 * g
            state[k + 2] = 0.99 * state[k + 2] + 0.01 * g * g
            value += 0.1 * (state[k] / (1 - 0.9**step)) / (np.sqrt(state[k + 2] / (1 - 0.99**step)) + 1e-8)
    return weights, moves


def best_path(local: np.ndarray, moves: np.ndarray) -> list[int]:
    """Viterbi over two labels."""
    if not len(local):
        return []
    (m00, m01), (m10, m11) = moves.tolist()
    (a, b), *rest = local.tolist()
    back = []
    for u, v in rest:
        back.append((int(b + m10 > a + m00), int(b + m11 > a + m01)))
        a, b = u + max(a + m00, b + m10), v + max(a + m01, b + m11)
    path = [int(b > a)]
    for step in reversed(back):
        path.append(step[path[-1]])
    return path[::-1]


@lru_cache(maxsize=4)
def trained(pages: int = TRAIN_PAGES, seed: int = TRAIN_SEED) -> tuple[np.ndarray, np.ndarray]:
    r = random.Random(seed)
    made = [labelled_page(r) for _ in range(pages)]
    return fitted([features(blocks(page)) for page, _ in made], [labels for _, labels in made])


def main_text(page: str | None, weights: np.ndarray, moves: np.ndarray) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, y in zip(found, best_path(features(found) @ weights, moves), strict=True) if y)


def extract_pages(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    weights, moves = trained(train_pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), weights, moves) for page in batch.column(2)]
            arrays = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
