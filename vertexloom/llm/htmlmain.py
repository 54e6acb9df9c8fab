"""Main text of web pages by consensus paths of hosts.

Each page's containers are scored by the text in them, decaying with depth and lowered by the share of links.
Spark adds the scores by host and generalised tag-and-class path; pages are then extracted from the elements on
their host's winning path. A page without that path, or with far better text elsewhere, uses its own best path.

A path is known by its hash, made from its parent's, so that a deeply nested page takes memory in proportion to its length.
Markup that never ends its script, style or other raw element: scripts and styles go to the end of the page, of others only
the tag goes. Elements that close themselves are empty.

Null html is empty, and so is its text; a null url is the host of the empty name. Rows are kept one for one.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_names, python_rows, small, stored, table

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^<>\"'])*)>|<[!?][^>]*>|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Elements whose content is no markup, with what ends them.
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "template", "textarea", "title", "svg", "annotation", "annotation-xml", "iframe")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OUT = frozenset("nav header footer aside form menu dialog button select option fieldset object audio video canvas head".split())
_CONTAINER = frozenset("body article main section div td blockquote center".split())
_BLOCK = _CONTAINER | _OUT | frozenset("html p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr th caption pre figure figcaption address details summary hr".split())
#: An element that begins ends an open one of these.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Words of classes and ids that mark what is no main text; first those that do so inside an article too.
_NOTES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion comment comments disqus replies respond cookie cookies consent gdpr "
    "notice notices notification alert share sharing newsletter subscribe subscription signup login popup modal overlay form".split()
)
_NOT_MAIN = _NOTES | frozenset(
    "banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead social related recommended widget pagination pager toolbar "
    "search skip".split()
)
#: Words that may stand beside them in a name; any other word gives the name another meaning, as in related-work.
_BESIDE = frozenset(
    "site page main global top bottom left right inner outer wrap wrapper container box block bar area list item items link links button buttons slot unit panel "
    "section content reader user primary secondary mobile desktop posts post articles article js to google".split()
)
_MAIN = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "aside footer header masthead comment comments disqus replies respond cookie cookies consent gdpr notice notices notification alert share sharing social "
    "related recommended newsletter subscribe subscription signup login popup modal overlay widget pagination pager toolbar search form skip".split()
)
_MAIN = frozenset("article content entry main post story body text page".split())
_STEP = 2**63
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
_WORDS = re.compile(r"[a-z]+")
_SPLIT_CASE = re.compile(r"(?<=[a-z])(?=[A-Z])")
DECAY, LINKED, BETTER = 0.9, 0.5, 3.0


class Node:
    __slots__ = ("tag", "path", "out", "chars", "fresh", "score", "links", "weight", "begin", "container", "main")

    def __init__(self, tag, path, out, weight, begin, container, main):
        self.tag, self.path, self.out, self.weight, self.begin, self.container, self.main = tag, path, out, weight, begin, container, main
        self.chars = self.fresh = self.links = 0
        self.score = 0.0


def path_of(parent: int, step: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{parent}/{step}") - _STEP


def marks(name: str, words: frozenset) -> bool:
    """Whether a name of a class or id says that this is none of the main text: one of the words, with others beside it at most."""
    parts = _WORDS.findall(_SPLIT_CASE.sub(" ", name).lower())
    return not words.isdisjoint(parts) and all(p in words or p in _BESIDE for p in parts)


def _start(tag: str, attributes: str, parent: Node, begin: int) -> Node:
    out, main, step = parent.out or tag in _OUT, parent.main or tag in ("article", "main"), tag
    weight = 3.0 if tag in ("article", "main") else 1.0
    if attributes and ("=" in attributes):
        first, names = "", []
        for key, a, b, c in _ATTRIBUTE.findall(attributes):
            value = a or b or c
            if key.lower() == "role":
                role = value.strip().lower()
                out = out or role in _ROLES
                if role in ("main", "article"):
                    weight, main = 3.0, True
                continue
            names += value.split()
            if key.lower() == "class" and not first:
                first = "-".join(_WORDS.findall(_SPLIT_CASE.sub(" ", value).lower()))
        if tag not in ("html", "body", "article", "main"):
            out = out or any(marks(n, _NOTES if main else _NOT_MAIN) for n in names)
        if weight == 1.0 and any(not _MAIN.isdisjoint(_WORDS.findall(n.lower())) for n in names):
            weight = 1.3
        step = f"{tag}.{first}" if first else tag
    return Node(tag, path_of(parent.path, step), out, weight, begin, tag in _CONTAINER, main)


def parse(page: str) -> tuple[list[tuple[str, int]], list[Node], list[tuple[int, int]]]:
    """Blocks of text (with their length in links), containers in the order they end, and the blocks they span."""
    root = Node("", 0, False, 0.0, 0, False, False)
    stack, blocks, done, spans = [root], [], [], []
    parts: list[str] = []
    links = 0
    in_link = 0
    open_tags: dict[str, int] = {}

    def flush():
        nonlocal links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                blocks.append((text, links))
                node = stack[-1]
                node.chars += len(text)
                node.links += min(links, len(text))
                node.fresh += len(text) - 2 * min(links, len(text))
        links = 0

    def close():
        node = stack.pop()
        open_tags[node.tag] -= 1
        above = stack[-1]
        above.chars += node.chars
        above.links += node.links
        if node.container:
            # Its own text counts whole; that of containers in it is in score already, decayed.
            node.score += max(0, node.fresh)
            done.append(node)
            spans.append((node.begin, len(blocks)))
            above.score += node.score * DECAY
        else:
            above.fresh += node.fresh
            above.score += node.score

    at, n = 0, len(page)
    unended: set[str] = set()
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            token = m[0]
            if token[0] != "<" or len(token) == 1:
                if not stack[-1].out:
                    parts.append(token)
                    if in_link:
                        links += len(token)
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                in_link = max(0, in_link - 1)
                continue
            if tag in _BLOCK:
                flush()
                if open_tags.get(tag):
                    while stack[-1].tag != tag:
                        close()
                    close()
            continue
        if tag in _RAW:
            if not m[3].rstrip().endswith("/") and tag not in unended:
                end = _RAW[tag].search(page, at)
                if end:
                    at = end.end()
                elif tag in ("script", "style"):
                    at = n
                else:
                    unended.add(tag)
            continue
        if tag == "a":
            in_link = 1
        elif tag == "br":
            parts.append(" ")
        if tag in _BLOCK and tag not in _VOID:
            flush()
            in_link = 0 if tag != "a" else in_link
            if stack[-1].tag == "p":
                close()
            for ends in _ENDS.get(tag, ()):
                if stack[-1].tag == ends:
                    close()
            stack.append(_start(tag, m[3], stack[-1], len(blocks)))
            open_tags[tag] = open_tags.get(tag, 0) + 1
        elif tag == "hr":
            flush()
    flush()
    while len(stack) > 1:
        close()
    for node in done:
        node.score = 0.0 if node.out else node.score * node.weight * (1 - (node.links / node.chars if node.chars else 0))
    return blocks, done, spans


def best_paths(page: str) -> list[tuple[int, float]]:
    """Paths of the page's containers with their best scores, as parts of the page's best."""
    _, nodes, _ = parse(page)
    found: dict[int, float] = {}
    for node in nodes:
        if node.score > 0:
            found[node.path] = max(found.get(node.path, 0.0), node.score)
    top = max(found.values(), default=0.0)
    return [(p, s / top) for p, s in found.items()]


def extract(page: str, winner: int | None) -> str:
    blocks, nodes, spans = parse(page)
    scores: dict[int, float] = {}
    for node in nodes:
        scores[node.path] = max(scores.get(node.path, 0.0), node.score)
    own = max(scores, key=scores.get, default=None)
    if own is None or scores[own] <= 0:
        return "\n".join(t for t, k in blocks if k <= LINKED * len(t))
    path = winner if winner in scores and scores[winner] * BETTER >= scores[own] else own
    keep: set[int] = set()
    for node, (lo, hi) in zip(nodes, spans, strict=True):
        if node.path == path and not node.out:
            keep.update(range(lo, hi))
    return "\n".join(blocks[i][0] for i in sorted(keep))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        votes: dict[tuple[str, int], float] = {}
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for path, score in best_paths(page.as_py() or ""):
                votes[host, path] = votes.get((host, path), 0.0) + score
        yield pa.RecordBatch.from_arrays(
            [pa.array([h for h, _ in votes], pa.string()), pa.array([p for _, p in votes], pa.int64()), pa.array(list(votes.values()), pa.float64())], ["host", "path", "vote"]
        )


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(p.as_py() or "", w.as_py()) for p, w in zip(batch.column(2), batch.column(3), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
        )


def extract_main(pages: DataFrame) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, url, text and n_chars."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    pages = own_names(pages, ["page_id", "url", "html"]).withColumn("host", host)
    votes = python_rows(pages.select("host", "html"), _votes, "host string, path long, vote double")
    # Rounded, so that the order of adding can't change a winner; of equal paths that of the greatest hash.
    votes = votes.groupBy("host", "path").agg(F.round(F.sum("vote"), 6).alias("vote"))
    winners = votes.groupBy("host").agg(F.max_by("path", F.struct("vote", "path")).alias("winner"))
    winners = stored(winners, "page-paths")
    joined = pages.join(small(winners.withColumnRenamed("host", "of"), winners.count()), F.col("host") == F.col("of"), "left")
    return python_rows(joined.select("page_id", "url", "html", "winner"), _texts, "page_id long, url string, text string, n_chars long")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main(table(spark, sf_dir, "pages"))
