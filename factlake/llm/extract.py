"""Main text of web pages by consensus paths of each host.

First pass: each page's containers are scored by the text of the blocks they hold, less what is linked, and vote with
that score for their generalised path (tags with classes, digits as #). Spark sums the votes of each host, and the path
with most votes wins. Second pass: pages are read again with their host's path; a page that has nothing (or nearly
nothing) there uses its own best container.

A page is read from front to back once, in time linear in its length, however it is malformed: marks are searched from
where reading has come to, a search that fails is not made again, and open elements are found by their tag and not by going
up. A path is a hash of its parent's path and its own tag and classes, so deep pages cost no more, and different paths stay
apart.

What an element says of itself (that it is a menu, an advert, ...) leaves it out. By its tag it is out for good, as are
comments; by a name, it is back in where it holds the article and most of the page's text, or where the page has no
other text: wrappers often have such names.
"""

from __future__ import annotations

import re
from collections import defaultdict
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.llm import common as c

#: Hosts whose paths are broadcast (16 bytes and the host's name each); beyond, hosts are joined, salted by rows of a host.
BROADCAST_HOSTS, SALT_ROWS = 50_000, 100_000
#: Least share of its own best score that a page must have under its host's path.
ENOUGH = 0.25

_TAG = re.compile(r"</?([a-z][a-z0-9:-]*)", re.I)
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]++)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]++)))?""")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PARTS = re.compile(r"[^a-z0-9]+")
_DIGITS = re.compile(r"\d+")
# Elements whose content is no markup.
_RAW = frozenset("script style noscript iframe textarea title xmp".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_CONTAINERS = frozenset("article body div main section td html".split())
# Elements that are no main text whatever their names, and names (in class, id or role) that say so.
_NOT_TEXT = frozenset("nav header footer aside button select option dialog menu head audio video canvas template svg math object".split())
_NOT_MAIN = frozenset(
    "ad ads adv advert advertisement advertising adverts sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs sidebar aside"
    " footer header masthead cookie cookies consent gdpr notice notification alert popup modal overlay newsletter"
    " subscribe subscription share sharing social related recommended recommendations widget toolbar topbar pagination pager login signup search complementary contentinfo".split()
)
_COMMENTS = frozenset("comment comments disqus discussion respond reply replies".split())
# Parts with which a name speaks of a side part and is none.
_BEFORE, _AFTER = frozenset("with without no has is not show hide single page type layout".split()), frozenset("enabled disabled open closed on off active visible hidden layout page template".split())
_MAIN = frozenset("html body main article".split())
# What an opening tag ends, as the end tags of these may be left out; elements that such an end and end tags don't leave.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPES, _CELLS = frozenset("ul ol dl table td th article section div main body blockquote".split()), frozenset("td th table".split())
_OUT = -2


class _Node:
    """An open element: its path, the box its text stands in, and its aside (an index, -1 for none, _OUT for text that never counts)."""

    __slots__ = ("aside", "box", "path", "tag")

    def __init__(self, tag: str, path: bytes, box: int, aside: int):
        self.tag, self.path, self.box, self.aside = tag, path, box, aside


class Page:
    """Blocks of text of a page (box they stand in, text, linked characters), and its boxes (path, parent, tag)."""

    def __init__(self, html: str):
        self.boxes: list[tuple[bytes, int, str]] = [(b"", -1, "html")]
        self.blocks: list[tuple[int, str, int]] = []
        self._html, self._next = html, {}
        self._stack = [_Node("", b"", 0, -1)]
        self._open: dict[str, list[int]] = defaultdict(list)  # places on the stack of each tag that is open
        self._blocks, self._scopes, self._cells = [0], [0], [0]  # places of elements that are no inline ones, of _SCOPES, of _CELLS
        self._asides: list[tuple[int, bool]] = []  # aside around, whether an article stands in it
        self._run: list[tuple[str, bool, int]] = []
        self._parts: list[tuple[int, list[tuple[str, bool, int]]]] = []
        self._read()
        self._close()
        self._settle()

    def _find(self, what: str, at: int) -> int:
        """Next place of what from at on, or -1; what failed once or lies further on is not searched again."""
        known = self._next.get(what, 0)
        if known >= 0 and known <= at:
            known = self._next[what] = self._html.find(what, at)
        return known

    def _tag_end(self, at: int) -> int:
        """Place of the > that ends a tag, or -1. Quotes count where they begin a value and are closed."""
        html = self._html
        while m := _STOP.search(html, at):
            at = m.start()
            if m[0] == ">":
                return at
            k = at - 1
            while html[k].isspace():
                k -= 1
            end = self._find(m[0], at + 1) if html[k] == "=" else -1
            at = end + 1 if end >= 0 else at + 1
        return -1

    def _read(self) -> None:
        html, at, text_from = self._html, 0, 0
        while (at := html.find("<", at)) >= 0:
            after = html[at + 1 : at + 2]
            m = _TAG.match(html, at)
            if not m and after not in ("!", "?", "/"):
                at += 1
                continue
            self._text(html[text_from:at])
            if html.startswith("<!--", at):
                ends = [k for k in (self._find("-->", at + 2), self._find("--!>", at + 4)) if k >= 0]
                at = min(ends) if ends else -1
                at = -1 if at < 0 else self._find(">", at) + 1
            elif html.startswith("<![CDATA[", at):
                end = self._find("]]>", at + 9)
                self._text(html[at + 9 : end if end >= 0 else len(html)], False)
                at = end + 3 if end >= 0 else -1
            elif not m or after == "/":
                end = self._find(">", at)
                if m and end >= 0:
                    self._end(m[1].lower())
                at = end + 1 if end >= 0 else -1
            else:
                end = self._tag_end(m.end())
                if end >= 0:
                    tag = m[1].lower()
                    self._begin(tag, html[m.end() : end])
                    at = end + 1
                    if tag in _RAW:
                        raw = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
                        at = raw.start() if raw else -1
                else:
                    at = -1
            if at < 0:  # what is open to the page's end goes with it
                return
            text_from = at
        self._text(html[text_from:])

    def _pop(self, size: int) -> None:
        while len(self._stack) > size:
            place, node = len(self._stack) - 1, self._stack.pop()
            if node.tag:
                self._open[node.tag].pop()
            for places in (self._blocks, self._scopes, self._cells):
                if places[-1] == place:
                    places.pop()

    def _end(self, tag: str) -> None:
        if tag in _VOID:
            if tag == "br":
                self._text(" ")
            return
        if not self._open[tag]:
            return
        place = self._open[tag][-1]
        if tag in _INLINE and place < self._blocks[-1]:  # closed, but blocks in it go on
            self._stack[place].tag = ""
            self._open[tag].pop()
        elif tag in _INLINE:
            self._pop(place)
        elif place >= self._cells[-1] or tag in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
            self._close()
            self._pop(place)

    def _begin(self, tag: str, attributes: str) -> None:
        if tag in _VOID:
            if tag in ("br", "hr"):
                self._text(" ")
            if tag == "hr":
                self._close()
            return
        if tag not in _INLINE:
            self._close()
            ends = ("p", *_ENDS.get(tag, ()))
            while (place := max(self._open[x][-1] if self._open[x] else 0 for x in ends)) > 0 and place >= self._scopes[-1]:
                self._pop(place)
        if tag in _RAW or attributes.endswith("/") and tag in ("div", "span", "p", "a"):
            if tag in _RAW:
                self._push(tag, self._stack[-1].path, self._stack[-1].box, _OUT)
            return
        top = self._stack[-1]
        classes, aside = "", _OUT if tag in _NOT_TEXT or top.aside == _OUT else top.aside
        main = tag in _MAIN or tag == "h1"
        if attributes.strip(" /"):
            side = False
            for m in _ATTRIBUTE.finditer(attributes):
                name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
                if name in ("class", "id", "role"):
                    for x in value.split():
                        own = _PARTS.split(x.strip("-_"))
                        if own[0] in _BEFORE or own[-1] in _AFTER:
                            continue
                        if not _COMMENTS.isdisjoint(own) and tag not in ("html", "body", "main"):
                            aside = _OUT
                        side = side or not _NOT_MAIN.isdisjoint(own)
                    if name == "class":
                        classes = "".join(f".{x}" for x in sorted(set(_DIGITS.sub("#", value).split())))
                    main = main or name == "role" and value == "main"
                elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDING.search(value):
                    aside = _OUT
            if side and aside != _OUT and not main:
                self._asides.append((aside, False))
                aside = len(self._asides) - 1
        if tag == "form" and aside != _OUT:
            self._asides.append((aside, False))
            aside = len(self._asides) - 1
        if main and tag not in ("html", "body"):
            k = aside
            while k >= 0 and not self._asides[k][1]:
                self._asides[k] = (self._asides[k][0], True)
                k = self._asides[k][0]
        if tag in _INLINE:
            self._push(tag, top.path, top.box, aside)
            return
        path = blake2b(top.path + f"/{tag}{classes}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
        if tag in _CONTAINERS and aside != _OUT:
            self.boxes.append((path, top.box, tag))
            self._push(tag, path, len(self.boxes) - 1, aside)
        else:
            self._push(tag, path, top.box, aside)

    def _push(self, tag: str, path: bytes, box: int, aside: int) -> None:
        place = len(self._stack)
        self._stack.append(_Node(tag, path, box, aside))
        self._open[tag].append(place)
        if tag not in _INLINE:
            self._blocks.append(place)
        if tag in _SCOPES:
            self._scopes.append(place)
        if tag in _CELLS:
            self._cells.append(place)

    def _text(self, text: str, references: bool = True) -> None:
        top = self._stack[-1]
        if text and top.aside != _OUT:
            self._run.append((unescape(text) if references else text, bool(self._open["a"]), top.aside))
            self._box = top.box

    def _close(self) -> None:
        if self._run:
            self._parts.append((self._box, self._run))
            self._run = []

    def _settle(self) -> None:
        """Blocks, from what was read and what its asides turned out to be."""
        size = [0] * (len(self._asides) + 1)  # unlinked characters in each aside, with those in it; the last: in none
        for _, run in self._parts:
            for text, linked, aside in run:
                size[aside] += 0 if linked else len(text.strip())
        plain, total = size[-1], sum(size)
        for k in range(len(self._asides) - 1, -1, -1):
            if self._asides[k][0] >= 0:
                size[self._asides[k][0]] += size[k]
        out = [not (article and 2 * n > total) for (_, article), n in zip(self._asides, size, strict=False)]
        inner = [0] * len(out)
        for k, (around, _) in enumerate(self._asides):  # those around come first
            out[k] = out[k] or around >= 0 and out[around]
            inner[k] = around
        if not plain and all(out):
            tops = [k for k in range(len(out)) if inner[k] < 0 and size[k]]
            if tops:
                chosen = max(tops, key=lambda k: (size[k], -k))
                while True:  # down to an aside with text of its own
                    out[chosen] = False
                    within = [k for k in range(chosen + 1, len(out)) if inner[k] == chosen and size[k]]
                    if size[chosen] > sum(size[k] for k in within) or not within:
                        break
                    chosen = max(within, key=lambda k: (size[k], -k))
        for box, run in self._parts:
            kept = [(text, linked) for text, linked, aside in run if aside < 0 or not out[aside]]
            text = " ".join("".join(x for x, _ in kept).split())
            if text:
                self.blocks.append((box, text, sum(len(x) for x, linked in kept if linked)))

    def scores(self) -> list[float]:
        """Score of each box: unlinked text of its own blocks, half of that of boxes in it; article and main count double."""
        own = [0.0] * len(self.boxes)
        for box, text, linked in self.blocks:
            own[box] += max(0, len(text) - 2 * linked)
        for k in range(len(own) - 1, 0, -1):
            own[self.boxes[k][1]] += own[k] / 2
        return [x * (2 if b[2] in ("article", "main") else 1) for x, b in zip(own, self.boxes, strict=True)]

    def best(self) -> tuple[bytes, float]:
        scores = self.scores()
        k = max(range(len(scores)), key=lambda k: (scores[k], -k))
        return self.boxes[k][0], scores[k]

    def text(self, path: bytes) -> str:
        """Text of the boxes with that path and of all in them, in page order."""
        inside = [False] * len(self.boxes)
        for k, (own, parent, _) in enumerate(self.boxes):
            inside[k] = own == path or parent >= 0 and inside[parent]
        return " ".join(text for box, text, _ in self.blocks if inside[box])

    def main_text(self, path: bytes | None) -> str:
        own, most = self.best()
        if path is not None and path != own:
            scores = self.scores()
            if sum(s for s, b in zip(scores, self.boxes, strict=True) if b[0] == path) >= ENOUGH * most > 0:
                return self.text(path)
        return self.text(own)


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the container path (hashed) with most votes of each host; of equals the greatest path."""

    def vote(b: pa.RecordBatch) -> pa.RecordBatch:
        votes: dict[tuple[str, bytes], float] = defaultdict(float)
        for host, html in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
            page = Page(html)
            for (path, _, _), score in zip(page.boxes, page.scores(), strict=True):
                if score > 0:
                    votes[host, path] += score
        columns = list(zip(*((h, p, s) for (h, p), s in votes.items()), strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.float64())], ["host", "path", "score"])

    votes = c.map_rows(pages.where("html IS NOT NULL").select(host_of("url").alias("host"), "html"), vote, "host string, path binary, score double")
    votes = votes.groupBy("host", "path").agg(F.sum("score").alias("score"))
    return votes.groupBy("host").agg(F.max_by("path", F.struct("score", "path")).alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html, ...), from the whole html.

    Null and empty html gives ""; pages without a url form one host; equal rows give equal rows; other columns are
    ignored. Very long and malformed pages are read in time linear in their length.
    """
    paths, hosts = c.counted(host_paths(pages), "paths")
    rows = pages.select("page_id", "url", "html", host_of("url").alias("host"))
    if hosts <= BROADCAST_HOSTS:
        rows = rows.join(F.broadcast(paths), "host", "left")
    else:
        # as many salts as a host has rows for; the salt is by row, as equal pages may be many
        salts = F.ceil(F.col("n") / SALT_ROWS).cast("int")
        sized = c.scratch(paths.join(rows.groupBy("host").agg(F.count("*").alias("n")), "host").select("host", "path", salts.alias("_salts")), "hosts")
        many = F.broadcast(sized.where("_salts > 1").select("host", "_salts"))  # at most a SALT_ROWS-th of the rows
        rows = rows.join(many, "host", "left").withColumn("_salt", (F.rand(7) * F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
        rows = rows.join(sized.select("host", "path", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt")).hint("merge"), ["host", "_salt"], "left")

    def read(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [Page(html).main_text(path) if html else "" for html, path in zip(b.column("html").to_pylist(), b.column("path").to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return c.map_rows(rows.select("page_id", "url", "html", "path"), read, f"page_id {kind}, url string, text string, n_chars long")
