"""HTML extraction by consensus: containers are scored on each page, hosts vote on their paths, winners extract."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, stored, table
from .url_filter import host_path

#: A start or end tag: attributes are names, or names with a value that is quoted, or bare up to white space or ``>``.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?>[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)?+)*+)>")
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+))?+)?+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text up to their end tag, and none of it is shown as running text.
RAW = frozenset("script style title textarea xmp noembed noframes iframe".split())
#: Elements whose content is never main text.
DROPPED = RAW | frozenset("head nav footer aside select template noscript svg math canvas object audio video map dialog menu datalist".split())
#: Controls that may stand in running text: a block that has no other text is dropped.
CONTROLS = frozenset(["label", "button"])
#: Elements that hold either a control or a whole page.
FORMS = frozenset(["form", "fieldset"])
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
IN_HEAD = frozenset("head title meta link base script style noscript template".split())
CONTAINERS = frozenset("article main section div td form fieldset body".split())
CELLS, TABLE_PARTS = frozenset(["td", "th", "caption"]), frozenset("table caption thead tbody tfoot tr td th".split())
#: Words in a class, id or role that mark what is not main text, and words that say nothing beside them.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner banners breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus footer footers gdpr header "
    "headers masthead menu menus modal nav navbar navigation newsletter newsletters notice notices popup popups promo promos promotion promotions recommended related replies reply respond share sharing "
    "sidebar sidebars sidenav skip social sponsored sponsor sponsors subscribe subscription tags toolbar toolbars topbar widget widgets complementary contentinfo search alert alerts".split()
)
PLAIN = frozenset(
    "a all area articles bar block body bottom box btn button buttons card center col column container content count false feed fixed form global group icon icons inner item items "
    "left link links list main module no outer overlay page panel posts primary region right row secondary section signup site slot sticky stories strip the thread top unit user wrap wrapper".split()
)
_TITLED = frozenset("post entry article content title story".split())
#: Of these marks, words of readers, which may be longer than the article, and adverts.
READERS = frozenset("comment comments commentlist disqus respond reply replies".split())
ADVERTS = frozenset("ad ads advert adverts advertisement advertisements advertising banner banners promo promos promotion promotions sponsored sponsor sponsors".split())
#: Blocks longer than this are running text, unless over LINKED of it lies in links.
RUNNING, LINKED = 60, 0.3
#: An open element is closed by a start tag of these.
_CLOSES = {
    "p": BLOCK - {"br"}, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "option": frozenset(["option", "optgroup"]),
}


class Element:
    """An open or closed element; ``first`` to ``last`` are the blocks it holds, ``order`` to ``end`` the elements."""

    __slots__ = ("name", "marks", "parent", "path", "depth", "block", "cell", "inside", "hidden", "level", "readers", "control", "first", "last", "order", "end")

    def __init__(self, name: str, marks: str, parent: Element | None):
        self.name, self.marks, self.parent = name, marks, parent
        self.depth = parent.depth + 1 if parent else 0
        self.block = self.depth if name in BLOCK or not parent else parent.block  # depth of the innermost block element
        self.cell = self.depth if name in CELLS else parent.cell if parent else 0
        words = set(marks.split())
        self.inside = name in ("article", "main") or "article" in words or "main" in words or bool(parent and parent.inside)
        self.hidden = bool(parent and parent.hidden) or name in DROPPED or (name == "header" and not (parent and parent.inside))
        self.level = marked(words, bool(parent and parent.inside))
        self.readers = self.level == 2 and any(READERS & set(re.split(r"[-_:]+", w)) for w in words if mark_level(w) == 2)
        if name in ("body", "html", "main") or (name == "article" and not self.readers):
            self.level = 0
        self.control = name not in BLOCK and (name in CONTROLS or self.level == 2 or bool(parent and parent.control))

    @property
    def kind(self) -> str:
        """The element without what tells one page's from another's: its name and sorted marks, digits alike."""
        return self.name + "".join("." + m for m in sorted(set(re.sub(r"\d+", "#", self.marks).split())))


@functools.lru_cache(1 << 16)
def mark_level(word: str) -> int:
    """2 for a class made of MARKS and PLAIN words, 1 for one that has other words beside them, 0 for any other."""
    parts = [x for x in re.split(r"[-_:]+", word) if x and not x.isdigit()]
    if not any(x in MARKS for x in parts) or ("header" in parts and _TITLED & set(parts)):
        return 0
    return 2 if all(x in MARKS or x in PLAIN for x in parts) else 1


def marked(words: set[str], inside: bool) -> int:
    """The highest level of some words.  Inside of an article its header is its own, and a class that also speaks of
    content (``related-content``) marks no more than other words would, but for adverts and readers' words."""

    def level(word: str) -> int:
        if inside and word in ("header", "headers"):
            return 0
        parts = set(re.split(r"[-_:]+", word))
        return min(1, mark_level(word)) if inside and _TITLED & parts and not (READERS | ADVERTS) & parts else mark_level(word)

    return max(map(level, words), default=0)


def marks_of(attributes: str) -> str:
    """Class, id and role, in lower case; camel case apart."""
    if "=" not in attributes:
        return ""
    found = [a or b or c for name, a, b, c in _ATTRIBUTE.findall(attributes) if name.lower() in ("class", "id", "role")]
    return re.sub(r"(?<=[a-z])(?=[A-Z])", "-", unescape(" ".join(found))).lower().replace(">", " ")


class Page:
    """The containers of a page, the body first, and its blocks of text outside of what is dropped.

    A block is the text between two block tags, references decoded, white space as one space.  Each is kept once, in
    page order, and a container is an interval of them, so that time and memory follow the length of the page however
    deep it nests.  End tags without a start are left aside, open elements end with the page.  What is marked is
    judged by its content once the page has been read; words alone hide nothing.
    """

    def __init__(self, html: str):
        self.blocks: list[str] = []
        self.links: list[int] = []
        self.elements: list[Element] = []
        self.paths: dict[tuple[int, str], int] = {}
        self.stack: list[Element] = []
        self.open: dict[str, list[int]] = {}  # depths of open elements by name
        self.pieces: list[str] = []
        self.linked, self.in_link = 0, False
        self.some, self.plain = False, False  # whether the open block has text, and text outside of controls
        self.push("body", "")
        self.read(html)
        self.pop_to(0)
        self.judge()

    def push(self, name: str, marks: str) -> None:
        parent = self.stack[-1] if self.stack else None
        new = Element(name, marks, parent)
        pending = name not in BLOCK and self.some  # text before it, which is no part of it
        new.first, new.last, new.order = len(self.blocks) + pending, -1, len(self.elements)
        new.path = self.paths.setdefault((parent.path if parent else -1, new.kind), len(self.paths))
        self.elements.append(new)
        self.stack.append(new)
        self.open.setdefault(name, []).append(new.depth)

    def pop_to(self, depth: int) -> None:
        """Close elements from ``depth`` on; text is cut off where one of them is a block."""
        if any(e.name in BLOCK for e in self.stack[depth:]):
            self.flush()
        for e in self.stack[depth:]:
            self.open[e.name].pop()
            e.last, e.end = max(e.first, len(self.blocks)), len(self.elements)
        del self.stack[depth:]

    def flush(self) -> None:
        if self.pieces:
            text = " ".join(unescape("".join(self.pieces)).split())
            self.pieces = []
            if text and self.plain:
                self.blocks.append(text)
                self.links.append(min(len(text), self.linked))
        self.linked, self.some, self.plain = 0, False, False

    def text(self, text: str) -> None:
        if self.stack[-1].name == "head" and text.strip():
            self.pop_to(self.stack[-1].depth)
        top = self.stack[-1]
        if text and not top.hidden:
            self.pieces.append(text)
            self.linked += len(text) * self.in_link
            if not self.plain and not text.isspace():
                self.some, self.plain = True, not top.control

    def read(self, html: str) -> None:
        at, seen, last = 0, 0, html.rfind(">")
        while (at := html.find("<", at)) >= 0 and at < last:
            if html.startswith("<!--", at):
                self.text(html[seen:at])
                stop = at + 4 if html.startswith((">", "->"), at + 4) else html.find("-->", at + 4)
                seen = at = len(html) if stop < 0 else html.find(">", stop) + 1
            elif m := _TAG.match(html, at):
                self.text(html[seen:at])
                seen = at = self.end_tag(m[2].lower(), m.end()) if m[1] else self.start_tag(html, m[2].lower(), m[3], m.end())
            elif html.startswith(("<!", "<?", "</"), at):
                self.text(html[seen:at])
                seen = at = html.find(">", at) + 1
            else:
                at += 1
        if html.startswith("<!--", at if at >= 0 else len(html)):  # a comment that never ends
            self.text(html[seen:at])
            return
        self.text(html[seen:])

    def end_tag(self, name: str, at: int) -> int:
        depths, top = self.open.get(name), self.stack[-1]
        if name == "a":
            self.in_link = False
        if name in BLOCK:
            self.flush()
        if depths and depths[-1]:
            depth = depths[-1]
            if name in TABLE_PARTS or (depth >= top.cell if name in BLOCK or name in DROPPED else depth > top.block):
                self.pop_to(depth)
        return at

    def start_tag(self, html: str, name: str, attributes: str, at: int) -> int:
        if self.stack[-1].name == "head" and name not in IN_HEAD:
            self.pop_to(self.stack[-1].depth)
        if name in RAW:
            end = _END[name].search(html, at)
            if end is None:
                return at if attributes.endswith("/") else len(html)
            close = html.find(">", end.end())
            if name not in ("script", "style"):
                self.flush()
            return len(html) if close < 0 else close + 1
        if name in BLOCK:
            self.flush()
            while (box := self.stack[self.stack[-1].block]).depth and name in _CLOSES.get(box.name, ()):
                self.pop_to(box.depth)
        if name in ("html", "body") or name in VOID:
            return at
        if name == "a":
            self.in_link = True
        if name in ("svg", "math") and attributes.endswith("/"):
            return at
        marks = marks_of(attributes)
        if name in BLOCK or name in DROPPED or name in CONTROLS or (marks and marked(set(marks.split()), True)):
            self.push(name, marks)
        return at

    def judge(self) -> None:
        """Which blocks stay, and sums of characters, characters in links and running blocks before each block."""
        size = np.array([len(b) for b in self.blocks], np.int64)
        links = np.array(self.links, np.int64)
        running = (size > RUNNING) & (links <= LINKED * size)
        before = lambda x: np.concatenate([[0], np.cumsum(x)])
        chars, linked, runs = before(size), before(links), before(running * size)
        weight = running * size if runs[-1] else size - links  # a page of short lines alone has its text in them
        marked_ = [e for e in self.elements if (e.level or e.name in FORMS) and e.last > e.first]
        gone = np.zeros(len(size) + 1, np.int64)
        # Readers' words first: what they say does not count as text of the page when other parts are judged.
        for readers in (True, False):
            sums = before(weight * (np.cumsum(gone)[:-1] == 0))
            own = lambda e: int(sums[e.last] - sums[e.first])  # noqa: E731, B023
            body = max((e for e in self.elements if e.name in ("article", "main") and e.level == 0 and not e.hidden and own(e)), key=own, default=None)
            for e in marked_:
                if e.readers != readers:
                    continue
                if e.level == 2 or e.name in FORMS:  # stays where it wraps the page: its largest article, or most of its text
                    stays = (body and e.order < body.order < e.end) or (own(e) == sums[-1] > 0 if readers else 2 * own(e) > sums[-1])
                else:
                    stays = runs[e.last] > runs[e.first] and linked[e.last] - linked[e.first] <= LINKED * (chars[e.last] - chars[e.first])
                if not stays:
                    gone[e.first] += 1
                    gone[e.last] -= 1
        self.stays = np.cumsum(gone)[:-1] == 0
        self.chars, self.linked_chars, self.runs = before(size * self.stays), before(links * self.stays), before(running & self.stays)

    def size(self, e: Element) -> int:
        return int(self.chars[e.last] - self.chars[e.first])

    def score(self, e: Element) -> float:
        """Text that is not in links, with a little more for what calls itself the article."""
        text = self.size(e) - 2 * int(self.linked_chars[e.last] - self.linked_chars[e.first])
        named = 1.5 if e.name in ("article", "main") or _NAMED.search(e.marks) else 1.0
        return max(0.0, text) * named * (1 + min(10, int(self.runs[e.last] - self.runs[e.first])) / 20)

    def best(self) -> Element:
        """The container of the highest score; a part that holds nearly all of a larger one's text is taken before it."""
        boxes = [e for e in self.elements if e.name in CONTAINERS and not e.hidden]
        scores = [self.score(e) for e in boxes]
        at = max(range(len(boxes)), key=scores.__getitem__)
        top, least = boxes[at], self.size(boxes[at])
        for box, value in zip(reversed(boxes), reversed(scores)):
            if top.order < box.order < top.end and self.size(box) >= 0.9 * least and value >= scores[at] * 0.6:
                return box
        return top

    def path_of(self, e: Element | None) -> str:
        kinds = []
        while e:
            kinds.append(e.kind)
            e = e.parent
        return ">".join(reversed(kinds))

    def text_of(self, boxes: list[Element]) -> str:
        return "\n".join(self.blocks[i] for e in boxes for i in range(e.first, e.last) if self.stays[i])

    def text_at(self, path: str | None) -> str:
        """The blocks of the elements at ``path``, in page order; of the page's own best container where none holds text."""
        at = -1
        for kind in (path or "").split(">"):
            at = self.paths.get((at, kind), -2)
        found = self.text_of([e for e in self.elements if e.path == at and not e.hidden])
        return found or self.text_of([self.best()])


_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I | re.A) for name in RAW}
_NAMED = re.compile(r"article|content|entry|post|story")


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        paths, weights = [], []
        for html in batch.column(1):
            page = Page(html.as_py() or "")
            box = page.best()
            size = page.size(box)
            paths.append(page.path_of(box) if size else None)
            weights.append(1.0 - int(page.linked_chars[box.last] - page.linked_chars[box.first]) / size if size else 0.0)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string()), pa.array(weights, pa.float64())], names=["host", "path", "weight"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        texts = [Page(html.as_py() or "").text_at(path.as_py()) for html, path in zip(batch.column(2), batch.column(3))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def host_paths(pages: DataFrame) -> DataFrame:
    """``host, winner``: for each host the path that its pages' best containers vote for, each with its share of text
    outside of links; ties go to the shorter path, then by name.  Votes are summed before the shuffle."""
    votes = pages.select("host", "html").mapInArrow(_votes, "host string, path string, weight double").filter(F.col("path").isNotNull())
    sums = votes.groupBy("host", "path").agg(F.sum(F.round("weight", 3).cast("decimal(20,3)")).alias("votes"))
    return sums.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), F.length("path"), "path")).alias("winner"))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text`` for each row of ``pages`` (``page_id, url, html``), from its whole html.

    Each page's containers are scored by their text outside of links; the generalised path (tags with classes, digits
    alike) of the best one is the page's vote, and every page is extracted again by the path its host has chosen.  A
    page without text there keeps its own best container.  A null html is empty and gives an empty text; a null URL,
    or one without ``://``, is of the host ``''``.  Repeated rows each give a row; an empty table gives an empty one;
    other columns are left aside.  A very long or deeply nested page takes time by its length.  Equal scores go to the
    container that starts first, equal votes to the shorter path, then by name.

    Winners are one row a host, written to the shared folder, so that Spark knows their size when it plans their join.
    """
    hosted = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.coalesce(host_path(F.col("url"))[0], F.lit("")).alias("host"))
    winners = stored(host_paths(hosted), "winners")
    rows = hosted.join(winners, "host", "left").select("page_id", "url", "html", "winner")
    return rows.mapInArrow(_extract, "page_id long, url string, text string")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
