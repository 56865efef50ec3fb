"""Main text of web pages by site style trees.

Pages of a host share a template.  Each page is parsed into a tree of elements;
trees of the same host are merged by path (tags with the first class or id), and
for each path two things are counted over the host's pages: which sequences of
children it has (presentation) and which texts it holds (content).  As in style
trees, with m pages that have the path,

* presentation importance is the entropy, to base m, of its child sequences;
* content importance is 1 minus the mean entropy, to base m, of its texts over
  the pages: 0 when all pages repeat them, 1 when each text is one page's own;
* an inner node's importance mixes its own presentation with its children's
  importance, weighted by how many pages have them.

A page loses the branches whose importance, and that of all below them, is below
a threshold, next to those that markup itself declares to be no article: menus,
headers, footers, sidebars, forms, scripts, notices, adverts and comments.  A
class, an id or a form tag declares less than the other marks: an element that
only these name stays, for the tree to judge, if it holds the page's largest
``article`` or ``main``, or most of its text or of a page's without one (of
comments, nearly all), or, comments aside, nearly all text of the page.  Paths
that fewer than ``min_pages`` of a host's pages have aren't judged by importance.
What an ``article`` or ``main`` element holds is judged like all else; of what is
left, only its text counts where that is at least half.  If nothing would be left,
branches are kept that importance alone had removed.

Elements of any depth are kept.  Paths of over 300 characters are replaced by
digests of all their names, which are linked to their parents' paths.

Character references are decoded, white space in a block becomes one blank,
blocks are joined by one blank.  Null and empty pages give an empty text; a null
url counts as a host of its own name; truncated and unclosed markup is closed at
the end; null ids pass through; repeated pages give equal texts.
"""

from __future__ import annotations

import hashlib
import html as references
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import fields, map_batches, persist

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?>[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.DOTALL)
NAMES = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)
#: Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object canvas xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
AWAY = frozenset("nav header footer aside button select fieldset dialog menu head".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
#: Words of a class or id that name parts which are no article.
PARTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer colophon sidebar sidenav aside widget widgets "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search searchbox form comment comments disqus reply replies respond discussion share sharing social related recommended recommendations pagination pager toolbar copyright legal disclaimer hidden skip".split()
)
COMMENTARY = frozenset("comment comments disqus reply replies respond discussion".split())
#: Fixed value: nearly all of a page's text.
NEARLY = 0.9
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())
WORDS = re.compile(r"[a-z]+")


@dataclass(frozen=True)
class Settings:
    """threshold: least importance that stays.  weight: how much of an inner node's importance its children make.
    min_pages: pages of a host that must have a path.  broadcast_bytes: the most that is sent to all executors."""

    threshold: float = 0.2
    weight: float = 0.9
    min_pages: int = 5
    broadcast_bytes: int = 8 << 20


@dataclass(slots=True)
class Node:
    tag: str
    path: str
    away: bool
    main: bool
    order: list  # tags of children and "#" for text, runs as one
    doubt: float = 0.0  # share of the text that keeps an element that words or a form tag name; 0: not named
    parent: int = -1  # place among the elements, as in blocks
    size: int = 0
    mains: int = 0


@dataclass(slots=True)
class Block:
    text: str
    path: str
    node: int
    away: bool = False
    main: bool = False


def parse(page: str | None) -> tuple[list[Block], list[Node]]:
    """Blocks of text in page order and all elements."""
    root = Node("", "", False, False, [])
    # Of each open element: its place among the nodes, and its depth by tag; of each depth: the depth of the block around.
    stack, places, tops, nodes, blocks, text = [root], [0], [0], [root], [], []
    depths: dict[str, list[int]] = {}
    page = page or ""

    def shut_last() -> None:
        depths[stack.pop().tag].pop()
        places.pop(), tops.pop()

    def flush() -> None:
        if text:
            words = references.unescape("".join(text)).split()
            text.clear()
            if words:
                top = stack[tops[-1]]
                if not top.order or top.order[-1] != "#":
                    top.order.append("#")
                blocks.append(Block(" ".join(words), top.path, places[-1]))

    at, size = 0, len(page)
    while at < size:
        m = MARKUP.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, names = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if closing:
            if tag not in INLINE:
                flush()
            k = depths[tag][-1] if depths.get(tag) else 0
            # A stray end tag of inline markup must not close the blocks around it.
            if k and not (tag in INLINE and tops[-1] > k):
                while len(stack) > k:
                    shut_last()
            continue
        if tag in RAW and not names.endswith("/"):
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = end.end() if end else size
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                flush() if tag == "hr" else text.append("\n")
            continue
        if tag not in INLINE:
            flush()
            if tag == "p" or stack[-1].tag == "p" or tag in CLOSED_BY:
                shut = CLOSED_BY.get(tag, {"p"})
                while len(stack) > 1 and (stack[-1].tag in shut or stack[-1].tag == "p" or stack[-1].tag in INLINE and any(depths.get(t) for t in (*shut, "p"))):
                    shut_last()
        elif names.endswith("/"):
            continue
        node = element(tag, names, stack[-1])
        node.parent = places[-1]
        above = stack[tops[-1]]
        if tag not in INLINE and (not above.order or above.order[-1] != tag):
            above.order.append(tag)
        depths.setdefault(tag, []).append(len(stack))
        tops.append(tops[-1] if tag in INLINE else len(stack))
        stack.append(node)
        places.append(len(nodes))
        nodes.append(node)
    flush()
    settle(blocks, nodes)
    return blocks, nodes


def settle(blocks: list[Block], nodes: list[Node]) -> None:
    """Tells which elements and blocks are away or main, from what the whole page holds."""
    below = nodes[1:]  # parents come before their children
    for n in below:
        n.away |= nodes[n.parent].away
    for b in blocks:
        nodes[b.node].size += 0 if nodes[b.node].away else len(b.text)
    for n in reversed(below):
        n.mains += n.main and n.size > 0
        nodes[n.parent].size += n.size
        nodes[n.parent].mains += n.mains
    core = max((k for k, n in enumerate(nodes) if n.main), key=lambda k: nodes[k].size, default=0)
    if not nodes[core].size:
        core = 0
    around, k = set(), core
    while k >= 0:
        around.add(k)
        k = nodes[k].parent
    size, mains = nodes[core].size, nodes[core].mains - nodes[core].main
    inside = {core}
    for k, n in enumerate(below, 1):
        if n.parent in inside:
            inside.add(k)
        if n.doubt and k not in around:
            # Where the core has articles, text without one isn't its body, unless there is hardly any other.
            body = k in inside and n.size > n.doubt * size and (n.mains > 0 or mains == 0)
            n.away |= not (body or n.doubt < NEARLY and n.size > NEARLY * nodes[0].size)
        n.away |= nodes[n.parent].away
        n.main |= nodes[n.parent].main
    for b in blocks:
        b.away, b.main = nodes[b.node].away, nodes[b.node].main


def element(tag: str, names: str, parent: Node) -> Node:
    label, away, doubt = "", tag in AWAY, 0.5 if tag == "form" else 0.0
    main = tag in ("article", "main")
    if names:
        for key, *values in NAMES.findall(names):
            key, value = key.lower(), "".join(values).lower()
            if key in ("class", "id"):
                words = WORDS.findall(value)
                if not PARTS.isdisjoint(words) and tag not in ("html", "body", "article", "main"):
                    doubt = max(doubt, 0.5 if COMMENTARY.isdisjoint(words) else NEARLY)
                label = label or (words[0] if words else "")
            elif key == "role":
                away |= value in ROLES
                main |= value == "main"
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
                away |= tag not in ("html", "body")
    if tag in ("article", "main") and names and not PARTS.isdisjoint({"comment", "comments", "reply"} & set(WORDS.findall(names.lower()))):
        main, away = False, True
    path = parent.path if tag in INLINE else step(parent.path, f"{tag}{'.' + label if label else ''}")
    return Node(tag, path, away, main, [], doubt)


def depth_of(path: str) -> int:
    return int(path[1:].split("/")[0]) if path.startswith("#") else path.count("/")


def step(path: str, name: str) -> str:
    """The path of a child: all names from the root, or its depth and a digest of them where they are long."""
    longer = f"{path}/{name}"
    if len(longer) <= 300 and not path.startswith("#"):
        return longer
    return f"#{depth_of(path) + 1}/{hashlib.blake2b(longer.encode('utf-8', 'replace'), digest_size=16).hexdigest()}"


def key_of(path: str) -> int:
    return int.from_bytes(hashlib.blake2b(path.encode("utf-8", "replace"), digest_size=8).digest(), "big") >> 1


def host_of(url: F.Column) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def evidence(page: str | None) -> Iterator[tuple[str, int, int]]:
    """What a page adds to its host's tree: (path, 0, child sequence), (path, 1, text) and, of digests, (path, 2, parent), each once."""
    blocks, nodes = parse(page)
    seen = {(n.path, 0, zlib.crc32(" ".join(n.order).encode())) for n in nodes if n.tag not in INLINE}
    # Content counts by words of a block, hashed with its path by the groups that follow.
    seen |= {(b.path, 1, zlib.crc32(b.text.encode())) for b in blocks if not b.away}
    above = lambda n: nodes[n.parent].path
    seen |= {(n.path, 2, key_of(above(n))) for n in nodes if n.path.startswith("#") and n.tag not in INLINE}
    yield from seen


def style_trees(pages: DataFrame, url_col: str, html_col: str, settings: Settings) -> DataFrame:
    """(host, low): paths of low importance, for hosts that have any."""

    def make():
        def work(batch: pa.RecordBatch):
            counts = Counter((host, *e) for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for e in evidence(page))
            columns = zip(*counts, strict=True)
            types = (pa.string(), pa.string(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(columns, types, strict=True)], pa.array(list(counts.values()), pa.int64())], ["host", "path", "kind", "item", "pages"])

        return work

    found = map_batches(pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")), "host string, path string, kind int, item long, pages long", make)
    items = found.groupBy("host", "path", "kind", "item").agg(F.sum("pages").alias("c"))
    shown, text = F.col("kind") == 0, F.col("kind") == 1
    # A path's pages are the sum over its child sequences, at most one of each a page but for repeated siblings.
    nodes = items.groupBy("host", "path").agg(
        F.sum(F.when(shown, F.col("c"))).alias("m"),
        F.sum(F.when(shown, F.col("c") * F.log("c"))).alias("shown_log"),
        F.count(F.when(text, 1)).alias("texts"),
        F.sum(F.when(text, F.log("c"))).alias("text_log"),
        F.max(F.when(F.col("kind") == 2, F.col("item")).otherwise(0)).alias("up"),
    )
    nodes = nodes.where(F.col("m") >= settings.min_pages)

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        low = low_paths(pdf, settings)
        return pd.DataFrame([(pdf["host"].iloc[0], low)] if low else [], columns=["host", "low"])

    # One row for each path of a template: what a host's pages have grows its counts, not its paths.
    return nodes.groupBy("host").applyInPandas(judge, "host string, low array<string>")


def low_paths(tree: pd.DataFrame, settings: Settings) -> list[str]:
    """Paths whose composite importance and that of all paths below them is below the threshold."""
    m = tree["m"].to_numpy(float)
    base = np.log(np.maximum(m, 2))
    shown = np.clip((np.log(m) - tree["shown_log"].to_numpy(float) / m) / base, 0, 1)
    texts = tree["texts"].to_numpy(float)
    content = 1 - np.clip(np.nan_to_num(tree["text_log"].to_numpy(float)) / np.maximum(texts, 1) / base, 0, 1)
    paths = tree["path"].tolist()
    index = {p: i for i, p in enumerate(paths)}
    digests = any(p.startswith("#") for p in paths)
    keys = {key_of(p): i for i, p in enumerate(paths)} if digests else {}
    ups = tree["up"].tolist() if digests else ()
    children: dict[int, list[int]] = {}
    for i, p in enumerate(paths):
        if p and (up := keys.get(ups[i]) if p.startswith("#") else index.get(p.rsplit("/", 1)[0])) is not None:
            children.setdefault(up, []).append(i)
    importance, peak = np.ones(len(paths)), np.ones(len(paths))
    for i in sorted(range(len(paths)), key=lambda i: -depth_of(paths[i])):
        below = children.get(i, [])
        own = content[i] if texts[i] else shown[i]
        if below:
            weights = m[below] / m[below].sum()
            mixed = (1 - settings.weight) * shown[i] + settings.weight * float(weights @ importance[below])
            importance[i] = max(mixed, content[i]) if texts[i] else mixed
        else:
            importance[i] = own if texts[i] else 1.0
        # Importance fades with each level, so a chain of wrappers is worth as much as the best in it.
        peak[i] = max(importance[i], peak[below].max(initial=0))
    return [p for i, p in enumerate(paths) if p and peak[i] < settings.threshold]


def main_text(page: str | None, low: list[str] | None) -> str:
    """The text of a page without declared parts and low branches."""
    blocks, nodes = parse(page)
    blocks, gone, dull = [b for b in blocks if not b.away], set(low or ()), set()
    for k, n in enumerate(nodes if gone else ()):
        if n.path in gone or n.parent in dull:
            dull.add(k)
    kept = [b for b in blocks if b.node not in dull] or blocks
    inside = [b for b in kept if b.main]
    # An article speaks for its own text, not against a longer body next to it.
    if 2 * sum(len(b.text) for b in inside) >= sum(len(b.text) for b in kept):
        kept = inside
    return " ".join(b.text for b in kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", settings: Settings = Settings()) -> DataFrame:
    """(id, url, text) of every page."""
    trees = persist(style_trees(pages, url_col, html_col, settings), "style-trees")
    size = trees.agg(F.sum(F.length("host") + F.length(F.array_join("low", "")) + 64)).first()[0] or 0
    # Small trees go to all executors; larger ones meet the pages by host, where AQE splits the hosts with most pages.
    trees = trees.select(F.col("host").alias("_host"), "low")
    side = F.broadcast(trees) if size <= settings.broadcast_bytes else trees
    own = pages.select(id_col, url_col, F.col(html_col).alias("_html"), host_of(F.col(url_col)).alias("_host"))
    joined = own.join(side, "_host", "left").select(id_col, url_col, "_html", "low")

    def make():
        def work(batch: pa.RecordBatch):
            texts = [main_text(h, low) for h, low in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], [id_col, url_col, "text"])

        return work

    return map_batches(joined, fields(joined, id_col, f"`{url_col}` string, text string"), make)
