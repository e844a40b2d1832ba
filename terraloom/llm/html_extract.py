"""Operator 10: the main text of pages, by paths on which the pages of a host agree.

Each page's containers are scored (text in paragraphs against text in links), each page votes
for its best container's generalised tag-class path, votes are summed by host in Spark, and the
winning path of its host is what each page is extracted by. A page in which that path isn't
found is extracted by its own best container. Votes are pre-aggregated before their shuffle,
and winners are one short row per host.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache as cache
from functools import reduce
from itertools import pairwise

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.llm.common import bounded_broadcast, durable
from terraloom.llm.url_filter import host_of

# Names of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
SKIPPED = frozenset("head script style noscript template iframe object svg nav footer aside form button select textarea input menu dialog canvas".split())
CONTAINER = frozenset("article main section div td body blockquote".split())
RAW = frozenset("script style textarea title noscript iframe".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
LISTED = frozenset("li dt dd td th tr option ul ol dl table select".split())
FENCES = frozenset("ul ol dl table select".split())
PARAGRAPHS, HEADS = frozenset("p pre h1 h2 h3 blockquote".split()), frozenset("h1 main".split())
# Parts of a class or id that mark what isn't the main text, and those that only say how a page is laid out.
NOISE = re.compile(r"(?:ad|ads|advert\w*|sponsor\w*|promo\w*|banner\w*|comment\w*|repl(?:y|ies)|disqus\w*|respond|discussion|sidebar|side|widget\w*|share|sharing|social\w*|related|recommend\w*|nav\w*|menu\w*|breadcrumb\w*|footer\w*|masthead|cookie\w*|consent|gdpr|notice\w*|popup|modal|overlay|newsletter|subscri\w*|signup|login|pagination|pager|toolbar|skip|tags)")
NOISE_PAIRS = frozenset(("site header", "byline links"))
LAYOUT = frozenset("has with without no not layout open opened closed collapsed expanded visible hidden active enabled disabled template theme grid columns col".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I | re.A)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: Text, or a tag without a < inside: most of a page. It gives up at the next <, so it can't be slow.
PLAIN = re.compile(r"([^<]+)|<(/?)([a-zA-Z][^\s/><\"']*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+)>")
STOP = re.compile(r"[>\"']")
END_OF = {tag: re.compile(rf"</{tag}", re.I | re.A) for tag in RAW}
CONTENT = re.compile(r"article|content|post|entry|story|main")


@cache(maxsize=65536)
def is_noise(name: str) -> bool:
    """Whether a class or id, in lower case, marks what isn't the main text; `has-sidebar` and the like only say how a page is laid out."""
    for token in name.split():
        parts = [x for x in re.split(r"[_-]+", token) if x]
        if not LAYOUT.intersection(parts) and (any(NOISE.fullmatch(x) for x in parts) or any(f"{x} {y}" in NOISE_PAIRS for x, y in pairwise(parts))):
            return True
    return False


class Node:
    """An element: tag, class, children (nodes and strings), where it stands, and what it weighs.

    block and listed are the nearest elements, itself included, that are blocks and that list
    items close up to. noise can be lifted, skip can't.
    """

    __slots__ = ("tag", "name", "kids", "parent", "skip", "noise", "depth", "block", "listed", "chars", "links", "paras", "heads")

    def __init__(self, tag: str, name: str, parent: Node | None, skip: bool, noise: bool = False) -> None:
        self.tag, self.name, self.parent, self.skip, self.noise = tag, name, parent, skip, noise
        self.kids: list[Node | str] = []
        self.chars = self.links = self.paras = self.heads = 0
        self.depth = parent.depth + 1 if parent is not None else 0
        self.block = self if tag in BLOCK or parent is None else parent.block
        self.listed = self if tag in LISTED or parent is None else parent.listed


@cache(maxsize=65536)
def _step(tag: str, name: str) -> str:
    first = re.sub(r"\d+", "#", name.split()[0]).replace("/", "|") if name else ""
    return f"{tag}.{first}" if first else tag


def step(node: Node) -> str:
    """A node's part of a path: its tag and the first word of its class, digits left out; empty for what all pages have."""
    return "" if node.tag in ("html", "body", "#root") else _step(node.tag, node.name)


def marked(above: int, part: str) -> int:
    return xxhash.xxh64_intdigest(part, above) if part else above


class Tags:
    """Where tags end, in time that grows with the page alone, however broken its quotes are."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.last = page.rfind(">")
        #: Opening quotes from which the rest of the page has no end of a tag.
        self.dead: set[int] = set()

    def end(self, at: int) -> int:
        """The > that ends a tag, quotes observed, or else the first one; -1 if there is none."""
        if at > self.last:
            return -1
        i, seen = at, []
        while m := STOP.search(self.page, i):
            if m[0] == ">":
                return m.start()
            if m.start() in self.dead:
                break
            seen.append(m.start())
            i = self.page.find(m[0], m.end()) + 1
            if not i:
                break
        self.dead.update(seen)
        return self.page.find(">", at)


def parse(page: str) -> Node:
    """The tree of a page, however broken: unclosed elements end with their parent."""
    root = at = Node("#root", "", None, False)
    pos, n, tags = 0, len(page), Tags(page)
    open_tags: Counter[str] = Counter()
    last_cdata = page.rfind("]]>")

    def close(to: Node) -> Node:
        """Back to a node that is open, from where the page is."""
        here = at
        while here is not to:
            open_tags[here.tag] -= 1
            here = here.parent
        return to

    while pos < n:
        if m := PLAIN.match(page, pos):
            pos = m.end()
            if m[1] is not None:
                at.kids.append(m[1])
                continue
            closing, tag, rest = m[2], m[3].lower(), m[4]
        else:
            if page.startswith("<!--", pos):
                end = page.find("-->", pos + 4)
                pos = n if end < 0 else end + 3
                continue
            if page.startswith("<![CDATA[", pos) and pos < last_cdata:
                end = page.find("]]>", pos)
                at.kids.append(page[pos + 9 : end])
                pos = end + 3
                continue
            m = TAG.match(page, pos)
            other = m is None and page[pos + 1 : pos + 2] in ("!", "?")
            end = (page.find(">", pos) if other else tags.end(m.end())) if pos < tags.last and (m or other) else -1
            if end < 0:  # a < that begins no tag, or one that never ends
                at.kids.append("<")
                pos += 1
                continue
            pos = end + 1
            if other:
                continue
            closing, tag, rest = m[1], m[2].lower(), page[m.end() : end]
        if closing:
            if open_tags[tag] > 0:
                up = at
                while up.tag != tag:
                    up = up.parent
                at = close(up.parent)
            elif tag == "p" or tag == "br":
                at.kids.append(Node(tag, "", at, at.skip))
            continue
        name, role, hidden = "", "", False
        if "=" in rest or "hidden" in rest:
            for a in ATTRIBUTE.finditer(rest):
                key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                    hidden = True
                elif key == "role":
                    role = value.lower()
                elif key in ("class", "id"):
                    name += f" {value.lower()}"
        if tag in BLOCK and tag != "br" and at.block.tag == "p":
            at = close(at.block.parent)
        if closes := CLOSED_BY.get(tag):
            p = at.listed
            while p.parent is not None and p.tag not in closes and p.tag not in FENCES:
                p = p.parent.listed
            if p.tag in closes:
                at = close(p.parent)
        skip = at.skip or tag in SKIPPED or hidden or role in ROLES or tag == "header" and at.tag in ("body", "#root", "html")
        name = name.strip()
        node = Node(tag, name, at, skip, bool(name) and tag not in ("html", "body", "article", "main") and is_noise(name))
        at.kids.append(node)
        if tag in RAW:
            found = END_OF[tag].search(page, pos)
            end = found.start() if found else n
            node.kids.append(page[pos:end])
            pos = end
            at = node
            open_tags[tag] += 1
        elif tag not in VOID and not rest.endswith("/"):
            at = node
            open_tags[tag] += 1
    _settle_noise(root)
    return root


def _inside(root: Node) -> list[Node]:
    """All nodes that aren't skipped, in page order."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(k for k in reversed(node.kids) if isinstance(k, Node) and not k.skip)
    return order


def _weigh(order: list[Node]) -> None:
    for node in reversed(order):
        chars = links = paras = heads = 0
        for k in node.kids:
            if isinstance(k, str):
                chars += len(k.strip())
            elif not k.skip:
                chars, links, paras, heads = chars + k.chars, links + k.links, paras + k.paras, heads + k.heads
        node.chars, node.links = chars, chars if node.tag == "a" else links
        node.paras = (node.chars - node.links if node.tag in PARAGRAPHS else 0) or paras
        node.heads = (node.tag in HEADS) + heads


def _settle_noise(root: Node) -> None:
    """Noise is skipped, unless it holds most of the page's paragraphs and its headline: then its name says something else.

    If nothing is left but for noise, the noise that holds most of the paragraphs is what there is.
    """
    order = _inside(root)
    noisy = [x for x in order if x.noise]
    if not noisy:
        return
    _weigh(order)
    total = root.paras
    most = {id(x) for x in noisy if total and 2 * x.paras > total}
    lifted = {i for x in noisy if (i := id(x)) in most and x.heads == root.heads > 0}
    # Paragraphs outside of all noise that stays.
    within, outside, stack = [], 0, [root]
    while stack:
        node = stack.pop()
        if node.noise and id(node) not in lifted:
            within.append(node)
            continue
        kids = [k for k in node.kids if isinstance(k, Node) and not k.skip]
        outside += node.paras if not any(k.paras for k in kids) else 0
        stack.extend(kids)
    for node in noisy:
        node.skip = id(node) not in lifted and not (total and not outside and id(node) in most)


def generalised(node: Node) -> str:
    """The path from the root: the steps of all elements on the way, digits left out."""
    parts = []
    while node is not None and node.parent is not None:
        if part := step(node):
            parts.append(part)
        node = node.parent
    return "/".join(reversed(parts))


def containers(root: Node) -> list[tuple[float, int, Node]]:
    """(score, order, node) for every container with text outside of what is skipped."""
    out: list[tuple[float, int, Node]] = []
    order = _inside(root)
    _weigh(order)
    for i, node in enumerate(order):
        if node.tag in CONTAINER and node.chars:
            density = 1 - node.links / node.chars
            bonus = 2.0 if node.tag == "article" else 1.5 if node.tag == "main" or CONTENT.search(node.name) else 1.0
            loose = node.chars - node.links - node.paras
            # What an inner container holds counts for the outer too, but less the farther out.
            out.append(((node.paras + 0.5 * max(0, loose)) * density * density * bonus * (1 + 0.01 * min(node.depth, 20)), i, node))
    return out


def best(root: Node) -> Node | None:
    found = containers(root)
    return max(found, key=lambda x: (x[0], x[1]))[2] if found else None


def text_of(node: Node) -> str:
    """Blocks in page order, white space inside each made one space, joined by one space."""
    parts: list[str] = []
    stack: list[Node | str] = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            parts.append(x)
        elif not (x.skip and x is not node):
            edge = x.tag in BLOCK
            if edge:
                parts.append("\n")
                stack.append("\n")
            stack.extend(reversed(x.kids))
    return " ".join(html.unescape("".join(parts)).split())


def extract(page: str | None, path: str | None) -> str:
    """The text of every outermost container on the path; else of the page's own best one."""
    if not page:
        return ""
    root = parse(page)
    if path is not None:
        # Paths are compared by hashes that are carried down, so that deep pages cost no more than long ones.
        goal = reduce(marked, path.split("/") if path else (), 0)
        found: list[Node] = []
        stack = [(root, 0)]
        while stack:
            node, mark = stack.pop()
            if node.tag in CONTAINER and mark == goal and generalised(node) == path:
                found.append(node)
                continue
            stack.extend((k, marked(mark, step(k))) for k in reversed(node.kids) if isinstance(k, Node) and not k.skip)
        texts = [t for t in map(text_of, found) if t]
        if texts:
            return " ".join(texts)
    node = best(root)
    return text_of(node) if node is not None else text_of(root)


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        paths: list[str | None] = []
        for page in b.column(1):
            node = best(parse(page.as_py() or ""))
            paths.append(None if node is None else generalised(node))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(paths, pa.string())], names=["host", "path"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [extract(page.as_py(), path.as_py()) for page, path in zip(b.column(2), b.column(3), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, path): for each host the path with the most votes, ties to the first by name."""
    votes = pages.select(host_of(F.col("url")).alias("host"), F.col("html")).mapInArrow(_votes, "host string, path string")
    tally = votes.where("path IS NOT NULL").groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    return tally.groupBy("host").agg(F.min_by("path", F.struct(-F.col("n"), F.col("path"))).alias("path"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages.

    Null and empty html give an empty text. Pages without a host vote together, as one host. Pages
    may be as long, as deep and as broken as they like: time grows with their length. Repeated rows
    each have their result; other columns don't matter.
    """
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    winners = bounded_broadcast(durable(winning_paths(slim)))
    joined = slim.join(winners, host_of(F.col("url")) == F.col("host"), "left").select("page_id", "url", "html", "path")
    return joined.mapInArrow(_texts, "page_id long, url string, text string, n_chars long")
