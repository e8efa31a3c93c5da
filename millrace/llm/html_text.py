"""Operator 9, main text of web pages by consensus of a host's container paths.

1. Each page's containers are scored by the text of the blocks right inside them (half of it counts for
   the container above), less what stands in links. The page votes for the path of the best one, a path
   being tags with their classes from the root, digits generalised (carried as a hash).
2. Votes are summed per (host, path) in Spark, combined before the shuffle, and each host's winner is
   the path with most votes.
3. Pages are extracted again: all elements on the winning path, or, where they hold less than a fair
   share of a page's text (or there are none), its own container; and what stands beside these without being
   left out, but for lines that are mostly links in elements that are, too: no path costs a page its own text.

Left out at both steps: menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
comments, by tag, role and class. Tags decide by themselves (form and header as classes do). A class, id or
role that speaks against an element needs more: headings stay, words as in `with-sidebar` don't count, an
element with nearly all of a page's text (or most of it, with a heading) stays, a strong word among others (as
in `related-work`) leaves out inside an article only what is mostly links, and of words that say little (WEAK)
only those outside articles on elements with little text or with more in links than outside.

Blocks are lines; white space (line breaks included) in a block becomes one blank; character references are
decoded. What is left out inside a block (a button, a script, a hidden span) doesn't end it. Rows: page_id, url, text, n_chars.

Defined cases: a null or empty page has an empty text; a null url or one without `://` belongs to the empty
host; broken markup is read as it comes (unclosed elements end with their parent, a cut tag is dropped);
very long pages are read whole, in time and memory that grow with their length at any depth; of paths with
equal votes the least hash wins, of containers with equal scores the first; repeated rows and null ids each
keep their row; an empty table gives no row; columns other than page_id, url and html aren't read.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import broadcast_if_small, ship, stored
from .memory import enter
from .words import slices

# HTML elements by what they do here.
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
BLOCKS = HEADINGS | set("p li dt dd pre blockquote figcaption td th caption address summary".split())
CONTAINERS = set("html body div article main section center table tbody thead tfoot tr ul ol dl figure details fieldset".split())
LEFT_OUT = set("nav footer aside dialog head menu".split())
WRAPPERS = {"form", "header"}
INLINE_OUT = set("button select textarea iframe svg canvas object template noscript video audio datalist".split())
RAW = set("script style title xmp".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
IN_HEAD = RAW | INLINE_OUT | {"meta", "link", "base"}
OPENS = BLOCKS | CONTAINERS | LEFT_OUT | WRAPPERS
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "tbody", "thead"}, "tfoot": {"tr", "tbody", "thead"}}
ROWS = {"tr", "tbody", "thead", "tfoot"}
# Class, id and role words of what isn't main text, and words before them that say the contrary.
STRONG = set(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar cookie cookies consent gdpr popup newsletter subscribe subscription share sharing related recommended recommendations comment comments disqus respond replies reply pagination pager complementary contentinfo".split()
)
WEAK = set("header notice notices alert modal overlay signup social widget toolbar login search skip copyright legal disclaimer dialog alertdialog hidden".split())
CONTRARY = set("with has no without hide in over before after".split())
#: Words of arrangement: beside them a strong word still is all that a class says.
ARRANGED = set("list item items box block wrap wrapper container inner outer area section slot unit panel bar row col column group holder content body title heading label link links button buttons icon icons post posts story stories article articles form tools top bottom left right main site page global header footer side mobile desktop sticky fixed float inline a the".split())
GOOD = {"article": 2.0, "main": 1.5}
#: Shares of a page's text outside links: what a host's path has to hold of what the page's own container does, an element that stays although its class speaks against it (alone, or with a heading), and one that a weak word lets go.
FAIR, NEARLY_ALL, MOST, LITTLE = 1 / 3, 0.9, 0.5, 0.2
HEADS = {"article", "main", "h1"}

_NAME = r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)"
_OTHER = r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)"
#: Quotes count after an equals sign only. Should no tag end be found so up to the end of the page, quotes don't count from there on.
_TAG = re.compile(rf"{_OTHER}|{_NAME}((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*')?)*+)>", re.S)
_PLAIN = re.compile(rf"{_OTHER}|{_NAME}([^>]*)(?:>|\Z)", re.S)
_OPEN = re.compile(r"<[!?/a-zA-Z]")
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
STAYS, MAYBE, MIXED, GOES, GONE = range(5)


@dataclass(slots=True)
class Node:
    """An open element. verdict: STAYS, MAYBE (a weak word speaks against it), MIXED (a strong one among others), GOES (a strong one alone) or GONE; quiet: left out without ending the block around it."""

    tag: str
    path: bytes
    parent: int
    verdict: int = STAYS
    quiet: bool = False
    depth: int = 0


def _speaks(value: str) -> int:
    """STAYS, MAYBE, MIXED or GOES by the words of a class, id or role."""
    found = STAYS
    for token in value.lower().split():
        words = [x for x in re.split(r"[^a-z]+", token) if x]
        for i, x in enumerate(words):
            if i and words[i - 1] in CONTRARY:
                continue
            alone = all(w in STRONG or w in WEAK or w in ARRANGED for w in words)
            found = max(found, (GOES if alone else MIXED) if x in STRONG else MAYBE if x in WEAK else STAYS)
    return found


def _attributes(tag: str, raw: str) -> tuple[str, int]:
    """The classes with digits generalised, and the verdict of an element's tag and attributes."""
    classes, verdict = "", GONE if tag in LEFT_OUT or tag in INLINE_OUT else GOES if tag in WRAPPERS else STAYS
    if raw and not raw.isspace():
        for name, *values in _ATTR.findall(raw):
            name, value = name.lower(), "".join(values)
            if name == "class" and value.strip():
                classes = "." + ".".join(sorted(re.sub(r"\d+", "0", value).split()))
            if tag in ("html", "body"):
                continue
            if name in ("class", "id", "role") and tag not in HEADINGS:
                verdict = max(verdict, _speaks(value))
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDDEN_STYLE.search(value)):
                verdict = GONE
    return classes, verdict


def _clean(pieces: list[str]) -> str:
    text = "".join(pieces)
    return " ".join((html.unescape(text) if "&" in text else text).split())


class Page:
    """One pass over a page: its elements in the order they open, and its lines with their elements; then which elements stay, and what they hold."""

    def __init__(self, page: str):
        self.nodes = [Node("", b"", 0)]
        self.found: list[tuple[int, str, int, int]] = []  # element, line, characters outside links and in links
        self.stack = [0]
        self.open: dict[str, list[int]] = defaultdict(list)  # by tag: places in the stack
        self.barriers = [0]  # places in the stack of elements that a block's end tag doesn't reach beyond
        self.pieces: list[str] = []
        self.linked = 0
        self.in_link = False
        at, pattern = 0, _TAG
        while m := _OPEN.search(page, at):
            self.text(page[at : m.start()])
            at = m.start()
            if page[at + 1] == "/" and not ("a" <= page[at + 2 : at + 3].lower() <= "z"):  # an end tag without a name
                at = page.find(">", at) + 1 or len(page)
                continue
            m = pattern.match(page, at)
            if m is None:
                pattern = _PLAIN
                m = pattern.match(page, at)
            at = m.end()
            tag = m[2]
            if not tag or not page.endswith(">", 0, at):
                continue
            tag = tag.lower()
            if m[1]:
                self.end(tag)
            elif tag in RAW:
                stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = stop.end() if stop else len(page)
            else:
                self.start(tag, m[3])
        self.text(page[at:])
        self.pop(1)
        self.flush()
        self.judge()

    def text(self, piece: str) -> None:
        if piece and self.nodes[self.stack[-1]].verdict != GONE:
            self.pieces.append(piece)
            if self.in_link:
                self.linked += len(piece)

    def flush(self) -> None:
        """End the current line; it belongs to the innermost element."""
        if self.pieces:
            line = _clean(self.pieces)
            if line:
                self.found.append((self.stack[-1], line, max(0, len(line) - self.linked), self.linked))
        self.pieces, self.linked = [], 0

    def innermost(self, tags: set[str]) -> int:
        return max((places[-1] for t in tags if (places := self.open.get(t))), default=0)

    def start(self, tag: str, raw: str) -> None:
        top = self.nodes[self.stack[-1]]
        if top.tag == "head" and tag not in IN_HEAD:  # an unclosed head
            self.pop(len(self.stack) - 1)
        if tag in VOID:
            if tag == "hr" and not top.quiet:
                self.flush()
            elif tag == "br" and top.verdict != GONE:
                self.pieces.append(" ")
            return
        if tag == "a":
            self.in_link = True
            return
        if tag not in OPENS:
            last = self.open.get(tag)
            if last and self.nodes[self.stack[last[-1]]].quiet:
                self.nodes[self.stack[last[-1]]].depth += 1
            elif (tag in INLINE_OUT or raw.strip()) and _attributes(tag, raw)[1] >= GOES:
                self.push(Node(tag, top.path, self.stack[-1], GONE, True))
            return
        p = self.open.get("p")
        if p and p[-1] > self.barriers[-1]:
            self.pop(p[-1])
        if tag in SIBLINGS:
            at, scope = self.innermost(SIBLINGS[tag]), self.innermost({"table"} if tag in ROWS or tag in ("td", "th") else {"ul", "ol", "dl"})
            if at > scope and (tag in ROWS or tag in ("td", "th") or at >= self.barriers[-1]):
                self.pop(at)
        top = self.nodes[self.stack[-1]]
        classes, verdict = _attributes(tag, raw)
        if top.verdict == GONE:
            verdict = GONE
        if not top.quiet:
            self.flush()
        path = hashlib.blake2b(top.path + f">{tag}{classes}".encode("utf-8", "replace"), digest_size=8).digest()
        self.push(Node(tag, path, self.stack[-1], verdict, top.quiet))

    def push(self, node: Node) -> None:
        self.open[node.tag].append(len(self.stack))
        if node.tag not in BLOCKS and not (node.quiet and node.tag not in OPENS):
            self.barriers.append(len(self.stack))
        self.stack.append(len(self.nodes))
        self.nodes.append(node)

    def end(self, tag: str) -> None:
        if tag == "a":
            self.in_link = False
        places = self.open.get(tag)
        if not places or (tag in BLOCKS and self.barriers[-1] > places[-1]):
            return
        node = self.nodes[self.stack[places[-1]]]
        if node.depth:
            node.depth -= 1
        else:
            self.pop(places[-1])

    def pop(self, i: int) -> None:
        """End the elements from place i of the stack on."""
        while len(self.stack) > i and self.nodes[self.stack[-1]].quiet:
            self.drop()
        if len(self.stack) > i:
            self.flush()
            self.in_link = False
            while len(self.stack) > i:
                self.drop()

    def drop(self) -> None:
        node = self.nodes[self.stack.pop()]
        self.open[node.tag].pop()
        if self.barriers[-1] == len(self.stack):
            self.barriers.pop()

    def judge(self) -> None:
        """Settle the elements that classes speak against; sum up scores and masses (text outside links) of those that stay."""
        n = len(self.nodes)
        plain, linked, headed, inside = [0] * n, [0] * n, [False] * n, [False] * n
        for at, _, out, link in self.found:
            plain[at] += out
            linked[at] += link
        for i in range(n - 1, 0, -1):  # children come after their parents
            node = self.nodes[i]
            plain[node.parent] += plain[i]
            linked[node.parent] += linked[i]
            headed[i] = headed[i] or node.tag in HEADS
            headed[node.parent] = headed[node.parent] or headed[i]
        whole = plain[0]
        self.gone = [False] * n
        for i in range(1, n):
            node = self.nodes[i]
            inside[i] = inside[node.parent] or node.tag in ("article", "main")
            out = node.verdict >= MIXED
            if node.verdict == MAYBE:
                out = not inside[i] and (plain[i] < LITTLE * whole or linked[i] > plain[i])
            elif node.verdict == MIXED and inside[i]:
                out = linked[i] > plain[i]
            if out and node.verdict != GONE:
                out = not (plain[i] > NEARLY_ALL * whole or (headed[i] and plain[i] > MOST * whole))
            self.gone[i] = self.gone[node.parent] or out
        if all(self.gone[at] for at, *_ in self.found):  # nothing is left: what tags alone leave
            self.gone = [False] * n
            for i in range(1, n):
                self.gone[i] = self.gone[self.nodes[i].parent] or self.nodes[i].verdict == GONE
        self.lines = [(at, line) for at, line, _, _ in self.found if not self.gone[at]]
        self.score, self.mass, self.links = [0.0] * n, [0] * n, [0] * n  # of what stays: scores, text outside links, text in links
        for at, _, out, link in self.found:
            if self.gone[at]:
                continue
            self.mass[at] += out
            self.links[at] += link
            weight = max(0, out - link)
            above = self.nodes[at].parent if self.nodes[at].tag in BLOCKS else at
            self.score[above] += weight
            if above:
                self.score[self.nodes[above].parent] += weight / 2
        for i in range(n - 1, 0, -1):
            self.mass[self.nodes[i].parent] += self.mass[i]
            self.links[self.nodes[i].parent] += self.links[i]
        self.boxes = [i for i in range(n) if not self.gone[i] and self.nodes[i].tag in CONTAINERS]

    def best(self) -> int:
        """The container with the highest score, of equal ones the first."""
        return max(self.boxes, key=lambda i: self.score[i] * GOOD.get(self.nodes[i].tag, 1.0), default=0)

    def vote(self) -> int | None:
        """The hashed path of the page's container; none for a page without text outside links."""
        found = self.best()
        return int.from_bytes(self.nodes[found].path, "big", signed=True) if self.mass[found] else None

    def within(self, chosen: list[int]) -> list[bool]:
        """For each element whether it is a chosen one or inside one."""
        inside = [False] * len(self.nodes)
        for i in chosen:
            inside[i] = True
        for i in range(1, len(self.nodes)):
            inside[i] = inside[i] or inside[self.nodes[i].parent]
        return inside

    def main_text(self, path: int | None = None) -> str:
        """The lines inside the elements on the path, or inside the page's own container where they hold less than a fair share of its text, and lines beside them unless they are mostly links, in an element that is mostly links."""
        own, wanted = self.best(), []
        if path is not None:
            key = path.to_bytes(8, "big", signed=True)
            wanted = [i for i in self.boxes if self.nodes[i].path == key]
            inside = self.within(wanted)
            if sum(self.mass[i] for i in wanted if not i or not inside[self.nodes[i].parent]) < FAIR * self.mass[own]:
                wanted = []
        chosen = wanted or [own]
        inside, n = self.within(chosen), len(self.nodes)
        around = [False] * n  # elements that hold a chosen one
        for i in chosen:
            while i and not around[self.nodes[i].parent]:
                i = self.nodes[i].parent
                around[i] = True
        beside = list(range(n))  # the largest element around each that holds no chosen one
        for i in range(1, n):
            if not around[i] and not around[self.nodes[i].parent]:
                beside[i] = beside[self.nodes[i].parent]
        stays = lambda at, out, link: inside[at] or out >= link or self.mass[beside[at]] >= self.links[beside[at]]
        return "\n".join(line for at, line, out, link in self.found if not self.gone[at] and stays(at, out, link))


def read(page: str) -> Page:
    return Page(page)


def host_of(url):
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; empty without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, "^.*?://([^/?#]*)", 1)).otherwise("")
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path, votes): the hash of each host's winning path; of equal ones the least."""
    ship(pages.sparkSession)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("html")
        for batch in batches:
            for piece in slices(batch, "html"):
                paths = [read(x).vote() for x in piece.column("html").to_pylist()]
                rows = [i for i, x in enumerate(paths) if x is not None]
                if rows:
                    yield pa.RecordBatch.from_arrays([piece.column("host").take(pa.array(rows)), pa.array([paths[i] for i in rows], type=pa.int64())], ["host", "path"])

    votes = pages.select(host_of("url").alias("host"), "html").filter("html is not null").mapInArrow(vote, "host string, path long").groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"))
    first = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), "path"))
    return votes.withColumn("n", first).filter("n = 1").select("host", "path", "votes")


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    winners = stored(host_paths(pages), "host-paths").select("host", "path")
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.coalesce("url", F.lit(""))).alias("host"))
    met = rows.join(broadcast_if_small(winners, "host"), "host", "left").select("page_id", "url", "html", "path")
    kind = pages.schema["page_id"].dataType.simpleString()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("html")
        for batch in batches:
            for piece in slices(batch, "html"):
                texts = [read(x).main_text(p) for x, p in zip(piece.column("html").to_pylist(), piece.column("path").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column("page_id"), piece.column("url"), pa.array(texts, type=pa.string()), pa.array([len(x) for x in texts], type=pa.int64())], ["page_id", "url", "text", "n_chars"])

    return met.mapInArrow(extract, f"page_id {kind}, url string, text string, n_chars long")
