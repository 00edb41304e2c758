"""Main text of web pages by consensus of each host's pages.

Each page weighs its containers and votes for the path (tags and classes from the root, digits generalised) of its best
one. Spark counts the votes per host. Pages are then read again with the paths that their host elected; a page without such a
path takes its own best container. Inside it, containers whose text is the same on every page of a host go as
furniture, and so do all elements that their tag, role, class or id marks as menu, header, footer, sidebar, notice, advert,
form or comments.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .tokens import in_parts

# Fixed values of HTML: elements without content; whose content is no markup; that break the line; that end an open p; whose end tags may be left out, and the elements that hold them.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
_ENDS_P = _BLOCK - frozenset("body html td th tr tbody thead tfoot caption title legend".split())
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "p": ("p",)}
_WITHIN = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "p": ("td", "th", "table", "button", "object")}

#: Elements that hold no running text of a page, and landmark roles of such.
_DROPPED = frozenset("head script style noscript template nav footer aside form button select textarea input iframe svg canvas object audio video map dialog menu title xmp noembed noframes".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Words of classes and ids that mark furniture, unless a word of _NOT stands before them.
_MARKS = frozenset(
    "nav navs navbar navigation menu menus submenu breadcrumb breadcrumbs pager pagination toolbar topbar header masthead footer foot colophon copyright sidebar sidebars sidenav aside widget widgets notice notices notification alert banner banners "
    "cookie cookies consent gdpr popup modal overlay toast ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promos promotion promoted form login signup signin subscribe subscription newsletter search "
    "comment comments commentlist disqus respond response responses reply replies discussion discussions feedback share sharing social related recommended recommendations trending popular skip hidden".split()
)
_NOT = frozenset("no not non has with without".split())
_CONTENT = frozenset("article content entry main post story text".split())
#: Elements that may hold an article, and those that may also be furniture as a whole.
_CONTAINERS = frozenset("body article main section div td center blockquote details fieldset".split())
_GROUPS = _CONTAINERS | {"ul", "ol", "table", "dl"}

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_TELLING = re.compile(r"class|id|role|hidden|style", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: A container is left for one inside it that holds this share of its text, unless it holds more than DIRECT of it directly.
SHARE, DIRECT = 0.7, 0.1
#: Least share of a host's pages that elects a path, so at most 1 / ELECTED paths a host.
ELECTED = 0.01
#: A page takes a path of its host if that holds this share of the text of its own best container.
HELD = 0.25
#: Pages of a host on which a container's text must be the same to count as furniture.
FURNITURE = 5
#: The largest hosts, whose paths are broadcast; the pages of all others meet theirs in a join.
HOSTS = 10_000


@lru_cache(1 << 16)
def _path(parent: int, label: str) -> int:
    from xxhash import xxh64_intdigest

    h = xxh64_intdigest(label.encode("utf-8", "replace"), parent & 0xFFFFFFFFFFFFFFFF)
    return h - (1 << 64) if h >> 63 else h


def _marked(name: str, inside: bool) -> bool:
    words = [w.lower() for w in _WORD.findall(name)]
    found = {w for before, w in zip(["", *words], words) if w in _MARKS and before not in _NOT}
    if found == {"header"} and (inside or _CONTENT & set(words)):
        return False
    return bool(found)


@lru_cache(1 << 14)
def _element(tag: str, attributes: str, inside: bool) -> tuple[int, str, bool]:
    """(2: furniture by tag, role or hiding, 1: by class or id, 0: none; label of the path; has class or id)."""
    attrs = {a[1].lower(): unescape(a[2] or a[3] or a[4] or "") for a in _ATTR.finditer(attributes)}
    names = [*attrs.get("class", "").split(), *([attrs["id"].strip()] if attrs.get("id", "").strip() else [])]
    label = ".".join([tag, *sorted({re.sub(r"\d+", "#", n) for n in names})])
    hidden = "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none", attrs.get("style", ""), re.I))
    if tag in _DROPPED or hidden or attrs.get("role", "").lower() in _ROLES or tag == "header" and not inside:
        return 2, label, bool(names)
    by_name = tag not in ("body", "html", "article", "main") and any(_marked(n, inside) for n in names)
    return int(by_name), label, bool(names)


@lru_cache(64)
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I)


class Node:
    """An open or closed element. box: the nearest element that may hold an article, itself included; first to last: its blocks of text."""

    __slots__ = ("tag", "path", "level", "box", "first", "last", "inner", "named", "direct", "heads")

    def __init__(self, tag: str, path: int, level: int, first: int, named: bool):
        self.tag, self.path, self.level, self.first, self.named = tag, path, level, first, named
        self.last, self.inner, self.direct, self.heads, self.box = first, [], 0, 0, self


class Page:
    """Blocks of text and elements of one page: one pass over the markup, whatever its length or depth."""

    def __init__(self, html: str):
        self.blocks: list[str] = []
        self.levels: list[int] = []
        self.weights: list[int] = []
        self.titles: list[int] = []
        self.root = Node("html", 0, 0, 0, False)
        self.groups = [self.root]
        self.stack, self.open = [self.root], {"html": 1}
        self.text: list[str] = []
        self.linked = self.all = 0
        self._read(html)
        while self.stack:
            self._pop()
        self.sums = [0]
        for w in self.weights:
            self.sums.append(self.sums[-1] + w)

    def _flush(self) -> None:
        """The text since the last break of the line is a block. Its weight is its length, but none if links make up half of it."""
        if self.text:
            if block := " ".join(unescape("".join(self.text)).split()):
                top = self.stack[-1]
                weight = 0 if top.level or 2 * self.linked > self.all else len(block)
                if self.open.get("h1") and not top.level:
                    self.titles.append(len(self.blocks))
                top.box.direct += weight
                self.blocks.append(block)
                self.levels.append(top.level)
                self.weights.append(weight)
            self.text, self.linked, self.all = [], 0, 0

    def _pop(self) -> None:
        node = self.stack[-1]
        if node.tag in _BLOCK:
            self._flush()
        self.stack.pop()
        self.open[node.tag] -= 1
        node.last = len(self.blocks)
        if node.tag == "header" and not node.level and not node.heads:  # an article's header without its title
            self.levels[node.first : node.last] = [2] * (node.last - node.first)
            self.weights[node.first : node.last] = [0] * (node.last - node.first)
        if self.stack:
            self.stack[-1].heads += node.heads + (node.tag in ("h1", "h2"))

    def _end(self, tags: tuple[str, ...], within: tuple[str, ...]) -> None:
        """Ends the innermost open element of these tags, unless an element of within is open inside it."""
        if any(self.open.get(t) for t in tags):
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].tag in tags:
                    while len(self.stack) > i:
                        self._pop()
                    return
                if self.stack[i].tag in within:
                    return

    def _add(self, piece: str) -> None:
        if piece:
            self.text.append(piece)
            if n := len(piece.strip()):
                self.all += n
                self.linked += n if self.open.get("a") else 0

    def _read(self, html: str) -> None:
        at, end = 0, html.rfind(">") + 1
        while at < end and (m := _TOKEN.search(html, at, end)):
            self._add(html[at : m.start()])
            at = m.end()
            if not m[2]:
                if at == end and m[0].startswith("<!--") and not re.search(r"--!?>\Z", m[0]):
                    at = len(html)
                continue
            tag = m[2].lower()
            if m[1]:
                self._close(tag)
                continue
            if tag in _BLOCK:
                if tag in _ENDS_P:
                    self._end(("p",), _WITHIN["p"])
                if tag in _ENDS:
                    self._end(_ENDS[tag], _WITHIN[tag])
                self._flush()
            if tag in _VOID or tag == "html":
                if tag == "br":
                    self.text.append(" ")
                continue
            if tag in _RAW:
                stop = _end_of(tag).search(html, at)
                at = html.find(">", stop.end()) + 1 or len(html) if stop else len(html)
                self.text.append(" ")
                continue
            attributes = m[3] if _TELLING.search(m[3]) else ""
            level, label, named = _element(tag, attributes, bool(self.open.get("article") or self.open.get("main")))
            above = self.stack[-1]
            node = Node(tag, _path(above.path, label), max(level, above.level), len(self.blocks), named)
            if tag in _CONTAINERS:
                above.box.inner.append(node)
            else:
                node.box = above.box
            if tag in _GROUPS:
                self.groups.append(node)
            self.stack.append(node)
            self.open[tag] = self.open.get(tag, 0) + 1
        self._add(html[at:].partition("<!--")[0])

    def _close(self, tag: str) -> None:
        if tag in ("br", "p") and not self.open.get(tag):
            if tag == "p":
                self._flush()
            else:
                self.text.append(" ")
        elif tag in ("html", "body") or not self.open.get(tag):
            return  # what follows the end of the body is still the body's
        elif tag in _BLOCK:
            while self.stack[-1].tag != tag:
                self._pop()
            self._pop()
        else:
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].tag == tag:
                    while len(self.stack) > i:
                        self._pop()
                    return
                if self.stack[i].tag in _BLOCK:
                    return  # an inline element ends no block

    def weight(self, node: Node) -> int:
        return self.sums[node.last] - self.sums[node.first]

    def best(self) -> Node:
        """From the root down to the container that holds most of the text, down to an article, the title or running text held directly."""
        node = self.root
        while node.tag != "article":
            whole = self.weight(node)
            down = next((n for n in node.inner if not n.level and whole and self.weight(n) >= SHARE * whole), None)
            if down is None or node.direct > DIRECT * whole:
                break
            if any(node.first <= t < node.last for t in self.titles) and not any(down.first <= t < down.last for t in self.titles):
                break
            node = down
        return node

    def repeated(self, node: Node) -> dict[int, tuple[int, int]]:
        """Named groups inside node with less than half of its text: path to the least and greatest hash of their texts."""
        from xxhash import xxh64_intdigest

        out: dict[int, tuple[int, int]] = {}
        for g in self.groups:
            if g.named and g is not node and node.first <= g.first < g.last <= node.last and not g.level and 2 * self.weight(g) < self.weight(node):
                h = xxh64_intdigest("\n".join(self.blocks[g.first : g.last]).encode("utf-8", "replace")) >> 1
                lo, hi = out.get(g.path, (h, h))
                out[g.path] = min(lo, h), max(hi, h)
        return out

    def text_of(self, nodes: list[Node], furniture: set[int]) -> str:
        """The blocks of these elements in page order, but for furniture: marked elements, those of the given paths, and lists of links outside articles."""
        lenient = 1 if not any(not v for v in self.levels) else 0  # all is marked by names: then names don't tell
        keep = bytearray(len(self.blocks))
        for n in nodes:
            for i in range(n.first, n.last):
                keep[i] = self.levels[i] <= lenient
        ends = 0
        for g in self.groups:
            if g.first < ends or g.first >= g.last:
                continue
            links = g.last - g.first > 1 and not self.weight(g) and not any(n.tag in ("article", "main") and n.first <= g.first < n.last for n in nodes)
            if not lenient and (g.path in furniture or links and self.weight(self.root)):
                keep[g.first : g.last] = bytes(g.last - g.first)
                ends = g.last
        return "\n\n".join(b for b, k in zip(self.blocks, keep) if k)


def surveyed(pages: DataFrame) -> DataFrame:
    """(host, path, votes, weight, lo, hi): each page's vote for its best container with the hash of its text (votes 1), and its repeated groups (votes 0)."""
    from xxhash import xxh64_intdigest

    def survey(batches):
        for pdf in batches:
            hosts, htmls = pdf["host"].tolist(), pdf["html"].tolist()
            for lo, hi in in_parts(htmls):
                rows = []
                for host, html in zip(hosts[lo:hi], htmls[lo:hi]):
                    page = Page(html)
                    if page.blocks:
                        node = page.best()
                        h = xxh64_intdigest("\n".join(page.blocks[node.first : node.last]).encode("utf-8", "replace")) >> 1
                        rows.append((host, node.path, 1, page.weight(node), h, h))
                        rows += [(host, path, 0, 0, *hashes) for path, hashes in page.repeated(node).items()]
                yield pd.DataFrame(rows, columns=["host", "path", "votes", "weight", "lo", "hi"])

    return pages.select("host", "html").mapInPandas(survey, "host string, path long, votes int, weight long, lo long, hi long")


def elected(survey: DataFrame) -> DataFrame:
    """(host, pages, paths, furniture): the paths that enough pages of a host vote for, most votes first, and the paths whose text never differs."""
    by_path = written(survey.groupBy("host", "path", F.col("votes").alias("kind")).agg(F.count("*").alias("n"), F.sum("weight").alias("weight"), F.min("lo").alias("lo"), F.max("hi").alias("hi")), few=True)
    vote = F.col("kind") == 1
    hosts = by_path.groupBy("host").agg(
        F.sum(F.when(vote, F.col("n"))).alias("pages"), F.min(F.when(vote, F.col("lo"))).alias("lo"), F.max(F.when(vote, F.col("hi"))).alias("hi"),
    )
    joined = by_path.join(hosts.select("host", "pages", (F.col("lo") < F.col("hi")).alias("varied")), "host")
    wins = vote & (F.col("n") >= F.lit(ELECTED) * F.col("pages"))
    same = ~vote & (F.col("lo") == F.col("hi")) & (F.col("n") >= F.greatest(F.lit(FURNITURE), F.lit(ELECTED) * F.col("pages"))) & F.col("varied")
    ranked = F.sort_array(F.collect_list(F.when(wins, F.struct((-F.col("n")).alias("n"), (-F.col("weight")).alias("w"), F.col("path").alias("path")))))
    return joined.where(wins | same).groupBy("host").agg(F.first("pages").alias("pages"), ranked["path"].alias("paths"), F.collect_set(F.when(same, F.col("path"))).alias("furniture"))


def extract(pages: DataFrame) -> DataFrame:
    """The columns of pages (url, html and any others) but html, and ``main_text``: the blocks of the main text, white space inside them one space each, joined by two newlines.

    Null html counts as empty; a page without text gives an empty text. Hosts are lower-cased; pages without a url or host
    are one host of their own. Repeated pages are kept and each votes. Text after an unclosed comment or script belongs to it. A page of any length or depth is one
    pass; its longest text is held once.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns if c != "html"]).alias("page"), host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    hosts = written(elected(surveyed(rows)), few=True)
    large = hosts
    if hosts.count() > HOSTS:
        large = written(hosts.orderBy(F.desc("pages"), "host").limit(HOSTS), few=True)
    with_paths = rows.join(F.broadcast(large), "host", "left")
    if large is not hosts:
        rest = rows.join(F.broadcast(large.select("host")), "host", "left_anti").join(hosts.join(large.select("host"), "host", "left_anti"), "host", "left")
        with_paths = rows.join(F.broadcast(large), "host").unionByName(rest)

    def read(batches):
        for batch in batches:
            found = []
            for row in zip(*(batch.column(k) for k in (1, 2, 3))):
                html, paths, furniture = (v.as_py() for v in row)
                page = Page(html)
                nodes = [own := page.best()]
                by: dict[int, list[Node]] = {}
                for g in page.groups:
                    if not g.level:
                        by.setdefault(g.path, []).append(g)
                for path in paths or ():
                    if path in by and sum(map(page.weight, by[path])) >= HELD * page.weight(own):
                        nodes = by[path]
                        break
                found.append(page.text_of(nodes, set(furniture or ())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["page", "main_text"])

    out = with_paths.select("page", "html", "paths", "furniture").mapInArrow(read, T.StructType([rows.schema["page"], T.StructField("main_text", T.StringType())]))
    return out.select("page.*", "main_text")
