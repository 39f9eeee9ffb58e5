"""Main text of pages by site style trees.

All pages of a host are merged into one tree whose nodes are paths of tags and classes (digits as 0). Each node is a
presentation node by the sequences of blocks that it shows, and a content node by the text that its block holds with the
inline elements in it. Shuffles count both over the host's distinct pages: pages of equal texts, whatever their menus and
adverts, count once, so copies look like no template. Content is important by the entropy of its texts (1 where every page has its
own, 0 where all have the same), presentation by the entropy of its sequences; a branch with several blocks is as
important as the best of these and its presentation together.

A branch, or a block's text, stays if its importance and its prior sum to 1 at least. Tags and the share of links
give the priors (``PRIORS``): paragraphs need little importance, link lists and loose text next to paragraphs much. A page's article
or main element is where the text is sought, unless the tree tells that it holds a template; bare paragraphs in
it go only where their very text is on nearly all distinct pages of the host, and isn't all that the page says. Menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and reader comments that tag, role or class name as such always go.

Nodes on too few pages of their host are important. As a node counts only if it is on a ``RARE``-th of them, the table of a
host is bounded whatever its number of pages. All tables are sent to all tasks up to ``BROADCAST_NODES`` nodes; beyond,
pages meet their host's table in chunks of a bounded number of pages, the table once a chunk.

Defined results: null and empty html, and pages without main text, give an empty text; urls without a host
share one; every page is read to its end, with unknown declarations as comments; repeated rows, and pages that tie in
their main content, count as one page and each get their text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import lru_cache
from html.parser import HTMLParser
from urllib.parse import urlsplit

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import common

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that never hold main text.
NEVER = frozenset("head script style noscript template nav footer aside form button select textarea input iframe object svg canvas audio video dialog menu title".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption br hr".split()) | INLINE
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Starting one of these ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dd dt".split())
#: Starting one of the keys ends an open element of the values, up to a container.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDERS = frozenset("ul ol dl table thead tbody tfoot tr article main section div body html nav aside footer form blockquote select".split())
NOISE = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar sidebars footer header masthead banner ad ads advert adverts advertisement advertising adsense "
    "sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "comment comments commentlist replies reply disqus respond related recommended recommendations widget widgets pagination pager toolbar skip copyright disclaimer".split()
)
#: A class that begins so tells of a page's state: a wrapper with "no-sidebar" is no sidebar.
STATES = frozenset("no has with without is".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: References of so many digits that Python refuses them as numbers.
LONG_REFERENCE = re.compile(r"&#[0-9]{1000,}")
#: A node counts once so many distinct pages of its host, and a ``RARE``-th of them, have it.
LEAST_PAGES, RARE = 5, 2000
#: Text of an article goes where this share of at least ``TEMPLATE_PAGES`` distinct pages of the host have it at the same node.
TEMPLATE, TEMPLATE_PAGES = 0.9, 10
#: What a branch or text needs no importance for, by where it stands; see ``_prior``.
PRIORS = {"article": 0.9, "block": 0.6, "links": 0.1, "loose": 0.1}
#: The share of a branch's presentation in its importance; the share of linked characters from which a block is a link list.
OWN, LINKED = 0.1, 0.67
#: Nodes of all hosts up to which their tables are sent to all tasks; pages of a chunk beyond.
BROADCAST_NODES, CHUNK = 200_000, 2_000
PRESENT, SHAPE, CONTENT = 0, 1, 2
FLUSH = 100_000
NODES = "nodes array<struct<path: long, shown: float, text: float>>, template array<long>"


class Node:
    __slots__ = ("children", "name", "noise", "tag")

    def __init__(self, tag: str, name: str, noise: bool):
        self.tag, self.name, self.noise = tag, name, noise
        self.children: list[Node | str] = []


@lru_cache(maxsize=65536)
def _noise(tag: str, classes: str, id_: str, role: str) -> bool:
    if tag in NEVER or role in NOISE_ROLES:
        return True
    if tag in ("html", "body", "main", "article") and classes.lower() not in ("comment", "comments", "reply"):
        return False
    names = [[m.lower() for m in NAME.findall(mark)] for mark in f"{classes} {id_}".split()]
    return any(m in NOISE for own in names if own and own[0] not in STATES for m in own)


@lru_cache(maxsize=65536)
def _name(tag: str, classes: str) -> str:
    return tag + "".join("." + re.sub(r"\d+", "0", c) for c in sorted(classes.split()))


class Builder(HTMLParser):
    """The tree of a page, with the ends that authors leave out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", "", False)
        self.open = [self.root]
        self.counts: Counter = Counter()  # of open elements by tag: what isn't open needs no search, however deep the page

    def _cut(self, i: int) -> None:
        for node in self.open[i:]:
            self.counts[node.tag] -= 1
        del self.open[i:]

    def updatepos(self, i, j):
        return j  # nobody asks for lines

    def _close(self, tags, holders) -> None:
        if not any(self.counts[t] for t in tags):
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                self._cut(i)
                return
            if self.open[i].tag in holders:
                return

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:
            self._close({"p"}, HOLDERS)
        if tag in HEADINGS:
            self._close(HEADINGS, HOLDERS)
        if tag in SIBLINGS:
            self._close(SIBLINGS[tag], HOLDERS - SIBLINGS[tag] - ({"tr"} if tag == "tr" else set()))
        if attrs:
            of = dict(attrs)
            classes = of.get("class") or ""
            hidden = "hidden" in of or of.get("aria-hidden") == "true"
            node = Node(tag, _name(tag, classes), hidden or _noise(tag, classes, of.get("id") or "", (of.get("role") or "").lower()))
        else:
            node = Node(tag, tag, tag in NEVER)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.counts[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "script", "style") and self.open[-1].tag == tag:
            self._cut(len(self.open) - 1)

    def handle_endtag(self, tag):
        if not self.counts[tag]:
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self._cut(i)
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)

    def parse_marked_section(self, i, report=1):
        """A CDATA section, or else a comment up to the next ``>`` as in browsers: the parser itself raises an error, or looks for an end far behind."""
        if self.rawdata[i : i + 9].lower() == "<![cdata[":
            return super().parse_marked_section(i, report)
        return self.parse_bogus_comment(i, report)


def tree(html: str | None) -> Node:
    builder = Builder()
    builder.feed(LONG_REFERENCE.sub(lambda m: "&#" + (m[0][2:].lstrip("0")[:9] or "0"), html or ""))
    builder.close()
    return builder.root


def host(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _path(above: int, name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass"), above)


class Block:
    """A block element of a page: the text of its strings and inline elements in order, and the blocks in it."""

    __slots__ = ("blocks", "linked", "node", "parts", "path")

    def __init__(self, node: Node, path: int):
        self.node, self.path, self.linked = node, path, 0
        self.parts: list[str | Block] = []
        self.blocks: list[Block] = []

    def text(self) -> str:
        return " ".join("".join([x if isinstance(x, str) else " " for x in self.parts]).split())


def blocks_of(root: Node) -> list[Block]:
    """The blocks of a page outside scripts and styles, each after the one that holds it; inline elements dissolve in their block."""
    top = Block(root, 0)
    out = [top]
    stack: list = [(root, top, False)]
    while stack:
        node, block, linked = stack.pop()
        if isinstance(node, str):
            block.parts.append(node)
            if linked:
                block.linked += len(node)
            continue
        if node is not root and node.tag not in INLINE:
            if node.tag in ("script", "style"):
                continue
            inner = Block(node, _path(block.path, node.name))
            block.parts.append(inner)
            block.blocks.append(inner)
            block = inner
            out.append(inner)
        elif node.noise:  # inline, but hidden or marked: a block of its own, which goes
            inner = Block(node, _path(block.path, node.name))
            block.parts.append(inner)
            block.blocks.append(inner)
            out.append(inner)
            continue
        linked = linked or node.tag == "a"
        for child in reversed(node.children):
            stack.append((child, block, linked))
    return out


def _text_key(text: str) -> int:
    raw = text.encode("utf-8", "surrogatepass")
    return zlib.crc32(raw) << 31 ^ zlib.adler32(raw)


def features(root: Node) -> tuple[int, list[tuple[int, int, int]]]:
    """A page's key (of its texts outside noise), and (path, kind, feature) of its nodes."""
    blocks = blocks_of(root)
    found = [(path, PRESENT, 0) for path in {b.path for b in blocks}]
    quiet: set[int] = set()
    plain = []
    for b in blocks:
        if b.node.noise or id(b) in quiet:
            quiet.update(map(id, [b, *b.blocks]))
        if b.blocks:
            shape = " ".join(dict.fromkeys(x.node.name for x in b.blocks))
            found.append((b.path, SHAPE, zlib.crc32(shape.encode("utf-8", "surrogatepass"))))
        if text := b.text():
            key = _text_key(text)
            found.append((b.path, CONTENT, key))
            if id(b) not in quiet:
                plain.append(key)
    return xxhash.xxh3_64_intdigest(np.array(plain, np.int64).tobytes()) - (1 << 63), found


def style_tree(pages: DataFrame) -> DataFrame:
    """host, its nodes (path, importance shown by its sequences, importance of its texts) and its template texts."""

    def make():
        seen: set[tuple[str, int]] = set()  # spares the shuffle the copies that a task meets

        def run(c):
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for url, html in zip(*c, strict=True):
                at = host(url)
                page, found = features(tree(html))
                if (at, page) in seen:
                    continue
                if len(seen) > FLUSH:
                    seen.clear()
                seen.add((at, page))
                counts = Counter(found)
                for column, value in zip(out, (at, page, *map(list, zip(*sorted(counts), strict=True)), [counts[x] for x in sorted(counts)]), strict=True):
                    column.append(value)
            return list(out)

        return run

    kinds = "host string, page long, paths array<long>, kinds array<int>, features array<long>, ns array<long>"
    counted = common.map_rows(pages.select("url", "html"), make, kinds)
    # Of pages with one key one counts, the greatest. Partial sums come before the second shuffle, so a text of millions of
    # pages is one row a task there.
    once = counted.groupBy("host", "page").agg(F.max(F.struct("paths", "kinds", "features", "ns")).alias("p"))
    apart = once.select("host", F.explode(F.arrays_zip(*[F.col(f"p.{c}").alias(c) for c in ("paths", "kinds", "features", "ns")])).alias("x"))
    apart = apart.select("host", F.col("x.paths").alias("path"), F.col("x.kinds").alias("kind"), F.col("x.features").alias("feature"), F.col("x.ns").alias("n"))
    each = apart.groupBy("host", "path", "kind", "feature").agg(F.sum("n").alias("n"), F.count("*").alias("pages"))
    each = common.staged(each, "features")
    kind = F.col("kind")
    log = lambda k: F.sum(F.when(kind == k, F.col("n") * F.log("n")).otherwise(0.0))
    count = lambda k: F.sum(F.when(kind == k, F.col("n")).otherwise(0)).cast("double")
    nodes = each.groupBy("host", "path").agg(
        F.max(F.when(kind == PRESENT, F.col("pages"))).alias("on"), count(SHAPE).alias("sn"), log(SHAPE).alias("sl"), count(CONTENT).alias("tn"), log(CONTENT).alias("tl")
    )
    total = each.where((F.col("path") == 0) & (kind == PRESENT)).select(F.col("host").alias("_h"), F.col("pages").alias("m"))
    often = F.col("on") >= F.greatest(F.lit(float(LEAST_PAGES)), F.col("m") / RARE)
    of = lambda n, logs: F.coalesce(F.when(often & (F.col(n) > 1), 1 - F.col(logs) / F.col(n) / F.log(n)), F.lit(1.0)).cast("float")
    rated = nodes.join(total, nodes["host"] == total["_h"]).select("host", "path", of("sn", "sl").alias("shown"), of("tn", "tl").alias("text"))
    rated = rated.where("shown < 1 or text < 1").groupBy("host").agg(F.collect_list(F.struct("path", "shown", "text")).alias("nodes"))
    wide = each.where((kind == CONTENT) & (F.col("pages") >= TEMPLATE * TEMPLATE_PAGES)).join(total.where(F.col("m") >= TEMPLATE_PAGES), F.col("host") == F.col("_h"))
    wide = wide.where(F.col("pages") >= TEMPLATE * F.col("m")).groupBy(F.col("host").alias("_w")).agg(F.collect_set("feature").alias("template"))
    # A template text is on nearly all pages, so there are at most as many as a page has blocks.
    tables = rated.join(wide, rated["host"] == wide["_w"], "full").select(F.coalesce("host", "_w").alias("host"), "nodes", "template")
    return common.staged(tables, "styles")


class Site:
    """What a task knows of a host: importances by path, and template texts."""

    def __init__(self, nodes=(), template=()):
        self.known = {n["path"]: (n["shown"], n["text"]) for n in nodes or ()}
        self.template = frozenset(template or ())


NOTHING = Site()


def importance(blocks: list[Block], site: Site) -> dict[int, float]:
    """Importance of every branch by id of its block: that of its best text or block and, where it has several, its presentation."""
    out: dict[int, float] = {}
    for b in reversed(blocks):
        shown, text = site.known.get(b.path, (1.0, 1.0))
        parts = [out[id(x)] for x in b.blocks if x.node.tag not in VOID]
        if any(isinstance(x, str) and not x.isspace() for x in b.parts):
            parts.append(text)
        best = max(parts, default=shown)
        out[id(b)] = (1 - OWN) * best + OWN * shown if len(parts) > 1 else best
    return out


def _articles(root: Node, within_noise: bool = False) -> list[Node]:
    """The topmost article elements outside noise, or else the main element; where noise wraps all of them, those in it."""
    found, mains, stack = [], [], [(root, False)]
    while stack:
        node, inside = stack.pop()
        if node.noise and (not within_noise or node.tag in NEVER or node.tag == "article"):
            continue
        if node.tag == "article" and not inside:
            found.append(node)
            inside = True
        elif node.tag == "main":
            mains.append(node)
        stack += [(c, inside) for c in reversed(node.children) if not isinstance(c, str)]
    return found or mains[:1] or ([] if within_noise else _articles(root, True))


def _prior(block: Block, marked: bool, paragraphs: bool, text: str | None) -> float:
    """Prior of a branch (``text`` None) or of a block's own text."""
    bare = block.node.tag in TEXTUAL and "." not in block.node.name
    if marked:
        return 1.0 if bare else PRIORS["article"]
    if text is not None and block.linked >= LINKED * len(text):
        return PRIORS["links"]
    if text is not None and paragraphs and block.node.tag not in TEXTUAL:
        return PRIORS["loose"]
    return PRIORS["block"]


def main_text(html: str | None, site: Site = NOTHING) -> str:
    """The main text of a whole page; ``site``: what is known of its host."""
    root = tree(html)
    return _main_text(root, site, site.template) or (_main_text(root, site, frozenset()) if site.template else "")


def _main_text(root: Node, site: Site, template: frozenset) -> str:
    blocks = blocks_of(root)
    scores = importance(blocks, site) if site.known else {}
    by_node = {id(b.node): b for b in blocks}
    tops = [by_node[id(n)] for n in _articles(root) if id(n) in by_node]
    tops = [b for b in tops if scores.get(id(b), 1.0) + PRIORS["article"] >= 1]
    marked = bool(tops)
    paragraphs = any(b.node.tag == "p" for b in blocks)
    out: list[str] = []
    for top in tops or blocks[:1]:
        # (block, whether inside a header of the article)
        stack: list = [(top, False)]
        while stack:
            item, header = stack.pop()
            if isinstance(item, str):
                out.append(item)
                continue
            block, node = item, item.node
            if block is not top:
                header = header or node.tag == "header"
                if (node.noise and not (marked and node.tag in HEADINGS)) or (node.tag == "header" and not marked):
                    continue
                if scores and scores[id(block)] + _prior(block, marked, paragraphs, None) < 1:
                    continue
            heading = node.tag in HEADINGS
            said = not header or heading
            if said and (scores or template) and (text := block.text()):
                known = site.known.get(block.path, (1.0, 1.0))[1]
                said = known + _prior(block, marked, paragraphs, text) >= 1 and (not template or _text_key(text) not in template)
            stack.append((" ", header))
            out.append(" ")
            for part in reversed(block.parts):
                if not isinstance(part, str):
                    stack.append((part, header and not heading))
                elif said:
                    stack.append((part, header))
    return " ".join("".join(out).split())


PAGES = "page_id long, url string, text string, n_chars long"


def _by_broadcast(pages: DataFrame, styles: DataFrame) -> DataFrame:
    """The tables of all hosts, of at most ``BROADCAST_NODES`` nodes in all, are sent to all tasks."""
    tables = {r["host"]: Site(r["nodes"], r["template"]) for r in styles.collect()}
    shared = pages.sparkSession.sparkContext.broadcast({h: (s.known, s.template) for h, s in tables.items()})

    def make():
        sites: dict[str, Site] = {}
        for h, (known, template) in shared.value.items():
            sites[h] = Site()
            sites[h].known, sites[h].template = known, template

        def run(c):
            texts = [main_text(html, sites.get(host(url), NOTHING)) for url, html in zip(c[1], c[2], strict=True)]
            return [c[0], c[1], texts, list(map(len, texts))]

        return run

    return common.map_rows(pages, make, PAGES)


def _by_chunks(pages: DataFrame, styles: DataFrame, chunk: int) -> DataFrame:
    """Pages are dealt by host and, within a host, to chunks of about ``chunk`` pages; the host's table comes first in each."""

    def add_host():
        return lambda c: [*c, list(map(host, c[1]))]

    hosted = common.map_rows(pages, add_host, "page_id long, url string, html string, host string")
    counts = common.staged(hosted.groupBy("host").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks")), "chunks")
    dealt = hosted.join(counts, "host").withColumn("part", F.pmod(F.xxhash64("page_id", "url", F.monotonically_increasing_id()), F.col("chunks")).cast("int"))
    nothing = lambda *names: [F.lit(None).cast(kind).alias(n) for n, kind in names]
    kinds = [x.split(" ", 1) for x in NODES.split(", template ")[:1]] + [["template", "array<long>"]]
    table = styles.join(counts, "host").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    table = table.select("host", "part", F.lit(0).alias("what"), *nothing(("page_id", "long"), ("url", "string"), ("html", "string")), "nodes", "template")
    rows = dealt.select("host", "part", F.lit(1).alias("what"), "page_id", "url", "html", *nothing(*kinds))
    laid = table.unionByName(rows).repartition("host", "part").sortWithinPartitions("host", "part", "what")

    def make():
        now: dict = {"host": None, "site": NOTHING}

        def run(c):
            out: tuple[list, list, list] = ([], [], [])
            for at, what, page_id, url, html, nodes, template in zip(c[0], *c[2:], strict=True):
                if what == 0:
                    now["host"], now["site"] = at, Site(nodes, template)
                    continue
                if at != now["host"]:
                    now["host"], now["site"] = at, NOTHING
                for column, value in zip(out, (page_id, url, main_text(html, now["site"])), strict=True):
                    column.append(value)
            return [*out, list(map(len, out[2]))]

        return run

    return common.map_rows(laid, make, PAGES)


def extract(pages: DataFrame, broadcast_nodes: int = BROADCAST_NODES, chunk: int = CHUNK) -> DataFrame:
    """page_id, url, text and n_chars of every page; both ways to send the tables give the same texts."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    styles = style_tree(pages)
    size = styles.agg(F.sum(F.size(F.coalesce("nodes", F.array())) + F.size(F.coalesce("template", F.array())) + 1)).first()[0] or 0
    return _by_broadcast(pages, styles) if size <= broadcast_nodes else _by_chunks(pages, styles, chunk)


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.read(spark, sf_dir, "pages"))
