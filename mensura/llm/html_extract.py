"""Main text of HTML pages by removal of the templates of their sites.

Pass 1 hashes the element subtrees of each page and counts them per host in Spark, pages with the same text counting once. A
subtree is counted by its tags, classes and text (an exact copy: a menu, a footer line); a named one with at most half of the
page's text also by tags, classes and three least hashes of its words (a block with mostly the same words) and, if it is
short and all in links, by tags and classes alone (an advert). Pass 2 deletes the subtrees that recur on at least `share` of
the pages of their host (and on `least` pages), then takes the text of the content region: the page's article or main
elements, or, on a page without one, what is left of the body. Inside a content region exact copies are deleted: named boxes
under the same bounds, text blocks and unnamed elements only if they recur on `most` of the host's pages and on `many`, as
quoted passages do not, and not if more than half of the region's text would go. Words inside a running text are never cut out.

As a second step, elements that are never text of an article (scripts, styles, forms, navigation, header, footer, aside
elements, and elements whose class, id or role names them as advert, notice, comment and so on) go in all cases.

Hashes are counted with a partial aggregation, host, hash and content being the key, so a host with a third of all pages is
spread over all tasks. What recurs is joined to the pages' own hashes by host and hash, and collected per page.

Text: character references are decoded; white space inside a block becomes one blank; blocks are joined by one line feed in
page order. Defined results: null and empty pages, and pages without text, give an empty text; unclosed elements end with
their parent; a page without a host counts under the empty host; rows without page_id and rows that share one are pages of their own,
told apart by file and place. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import with_rows, written
from .url_filter import parts_of

#: Fixed values of HTML: elements without content, with raw content, that form blocks, and that a new block ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math select xmp noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCKS - {"body", "html"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = frozenset("article aside blockquote body div dl footer form header html main nav ol section table ul".split())
#: Elements that are never an article's text, and words of a class, id or role that name such elements.
DROPPED = frozenset("aside button dialog footer form head header iframe input menu nav noscript object script select style svg template textarea".split())
_NAME = (
    "ads? advert[a-z]* banner breadcrumbs? comments? commentlist consent cookies? disqus footer gdpr header login masthead menu modal nav navbar navigation "
    "newsletter notices? pagination popup promo promoted related replies respond share sharing sidebar sponsor[a-z]* subscribe toolbar widget"
).split()
#: Words that stand before such a word in a name (site-footer), others (entry-header, with-sidebar) not.
PLACES = "bottom global left main mobile page primary right secondary side site sub top".split()
NAMES = re.compile(rf"(?:^|\s)(?:(?:{'|'.join(PLACES)})[_-])*(?:{'|'.join(_NAME)})(?:$|[\s_-])", re.I)
CONTENT = frozenset(["article", "main"])
CONTENT_NAMES = re.compile(r"(?:^|\s)(?:ads?|advert\w*|comments?|promo|promoted|related|replies|sponsor\w*|teaser)(?:$|[\s_-])", re.I)
TEXT = frozenset("a b blockquote code em figcaption figure h1 h2 h3 h4 h5 h6 i li p pre q span strong table tbody td th tr".split())
PHRASES = frozenset("a abbr b big cite code dd del dfn dt em font h1 h2 h3 h4 h5 h6 i ins kbd label li mark p pre q s samp small span strong sub sup td th tt u var".split())
CELLS = frozenset("td th".split())
#: Fixed value: odd factors that order word hashes in six ways.
MIXES = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D)
_WORD = re.compile(r"\w+")
_START = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)", re.S)
#: An attribute and its value; a quote opens a value only behind =, so an unclosed one or one in a name or an unquoted value ends nothing.
_ATTRIBUTE = re.compile(r"[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?")
#: Fixed value: as deep as browsers nest elements; deeper ones stand beside each other.
DEPTH = 512


def _attributes(page: str, at: int) -> tuple[dict[str, str], bool, int]:
    """The attributes that begin at a place, the first of each name, whether a slash ends the tag, and the place behind it."""
    found: dict[str, str] = {}
    while (m := _ATTRIBUTE.match(page, at)) is not None:
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        at = m.end()
    end = page.find(">", at)
    return found, page[at:end].rstrip().endswith("/"), len(page) if end < 0 else end + 1


@dataclass
class Node:
    tag: str
    names: str = ""
    hidden: bool = False
    children: list = field(default_factory=list)  # nodes and strings, in page order

    @property
    def dropped(self) -> bool:
        if self.tag in DROPPED or self.hidden:
            return True
        if not self.names or self.tag in ("html", "body"):
            return False
        return bool((CONTENT_NAMES if self.tag in CONTENT else NAMES).search(self.names))


def parse(page: str) -> Node:
    """The page's elements. Each sign is looked at a bounded number of times, so a page of any length takes linear time."""
    root = Node("html")
    stack, at, lead = [root], 0, 0
    opened: Counter[str] = Counter()

    def close(k: int) -> None:
        opened.subtract(n.tag for n in stack[k:])
        del stack[k:]

    while (m := _START.search(page, lead)) is not None:
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = lead = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag == "p" and not opened[tag]:
                stack[-1].children.append(Node("p"))
            for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[k].tag == tag:
                    close(k)
                    break
                if tag not in BLOCKS and stack[k].tag in BLOCKS:
                    break  # an inline end tag doesn't close a block
        elif m[2]:
            tag = m[2].lower()
            found, single, at = _attributes(page, at)
            lead = at
            if tag == "html":
                continue
            node = Node(tag, " ".join(found[k] for k in ("class", "id", "role") if found.get(k)))
            node.hidden = "hidden" in found or found.get("aria-hidden") == "true"
            ends = SIBLINGS.get(tag, ())
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ends or (tag in ENDS_P and stack[k].tag == "p"):
                    close(k)
                    if tag not in SIBLINGS or stack[-1].tag not in ends:
                        break
                elif stack[k].tag in SCOPES:
                    break
            stack[-1].children.append(node)
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
                stop = end.start() if end else len(page)
                node.children.append(page[at:stop])
                behind = page.find(">", stop) if end else -1
                at = lead = len(page) if behind < 0 else behind + 1
            elif tag not in VOID and not single and len(stack) <= DEPTH:
                stack.append(node)
                opened[tag] += 1
    if at < len(page):
        stack[-1].children.append(page[at:])
    return root


def regions(root: Node) -> list[Node]:
    """The outermost article and main elements that aren't inside what is dropped."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag in CONTENT and not node.dropped:
            found.append(node)
        elif not node.dropped:
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    return found


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


@dataclass
class Subtree:
    """An element with the digest of its tags, classes and text, its text's length and how much of that is in links; alone:
    it stands as a block of its own in a container. shape: the digest of its tags and classes (of named elements), or 0."""

    node: Node
    full: int
    shape: int
    size: int
    linked: int
    alone: bool


def subtrees(root: Node, skip: set[int]) -> list[Subtree]:
    """Every element below root that isn't dropped, has text and holds no region (by id(), in skip); children before parents."""
    out: list[Subtree] = []
    done: dict[int, tuple[str, str, int, int]] = {}
    todo: list[tuple[Node, bool, bool]] = [(root, False, False)]
    while todo:
        node, seen, alone = todo.pop()
        if not seen:
            if node.dropped or node.tag in ("title", "iframe"):
                done[id(node)] = "-", "-", 0, 0
                continue
            bare = node.tag not in PHRASES and not any(isinstance(c, str) and c.strip() for c in node.children)
            todo.append((node, True, alone))
            inline = sum(c.tag not in BLOCKS for c in node.children if isinstance(c, Node))
            todo += [(c, False, c.tag in BLOCKS or (bare and inline == 1)) for c in node.children if isinstance(c, Node) and id(c) not in skip]
            continue
        full, shape, holds, size, linked = [node.tag, node.names], [node.tag, node.names], False, 0, 0
        for c in node.children:
            if isinstance(c, str):
                full.append(" ".join(c.split()))
                size += len(full[-1])
            elif id(c) in skip:
                holds = True
            else:
                a, b, n, k = done[id(c)]
                full.append(a)
                shape.append(b)
                size, linked, holds = size + n, linked + k, holds or a == ""
        if node.tag == "a":
            linked = size
        if holds:  # what holds a content region is no template
            done[id(node)] = "", "", size, linked
            continue
        a, b = _digest("\x1f".join(full)), _digest("\x1f".join(dict.fromkeys(shape)))
        done[id(node)] = str(a), str(b), size, linked
        if size and node.tag not in ("html", "body"):
            out.append(Subtree(node, a, b if node.names else 0, size, linked, alone))
    return out


def alike(shape: int, node: Node) -> list[int]:
    """Two digests of the shape and of words of the node, each by three least hashes: equal for nodes with mostly the same
    words. Digits count as one word."""
    words = {zlib.crc32(w.encode("utf-8", "replace")) for w in _WORD.findall(re.sub(r"[0-9]+", "0", text_of([node], set()).lower()))}
    least = [str(min((w * m & 0xFFFFFFFF for w in words), default=0)) for m in MIXES]
    return [_digest(f"words\x1f{k}\x1f{shape}\x1f" + "\x1f".join(least[k : k + 3])) for k in (0, 3)]


def text_of(nodes: list[Node], delete: set[int]) -> str:
    """The blocks of nodes, without dropped elements and those in delete (by id())."""
    blocks: list[str] = []
    line: list[str] = []

    def end() -> None:
        found = " ".join(html.unescape("".join(line)).split())
        if found:
            blocks.append(found)
        line.clear()

    todo: list = list(reversed(nodes))
    while todo:
        node = todo.pop()
        if node is None:
            end()
        elif isinstance(node, str):
            line.append(node)
        elif node.dropped or id(node) in delete or node.tag in ("title", "iframe"):
            if node.tag in BLOCKS:
                end()
        elif node.tag == "br":
            line.append(" ")
        else:
            if node.tag in BLOCKS:
                end()
                todo.append(None)
            todo += reversed(node.children)
    end()
    return "\n".join(blocks)


def outside(root: Node, found: list[Node], small: float = 0.1) -> dict[int, list[tuple[Node, bool | None]]]:
    """Elements outside the content regions by the digests under which they are counted: of the exact copy; of shape and
    words, for named elements with at most half of the text; of the shape alone, where all such elements of the page together
    have at most `small` of its text, all of it in links. With each, False, or None where mostly the same words are enough."""
    out: dict[int, list[tuple[Node, bool | None]]] = {}
    kept = subtrees(root, {id(r) for r in found})
    total = len(text_of([root], set()))
    shapes: dict[int, list[int]] = {}
    for s in kept:
        if s.alone:
            out.setdefault(s.full, []).append((s.node, False))
        if s.shape:
            of = shapes.setdefault(s.shape, [0, 0])
            of[0], of[1] = of[0] + s.size, of[1] + s.linked
    for s in kept:
        if s.alone and s.shape and s.size * 2 <= total:
            for h in alike(s.shape, s.node):
                out.setdefault(h, []).append((s.node, None))
            size, linked = shapes[s.shape]
            if s.node.tag not in TEXT and linked == size <= total * small:
                out.setdefault(s.shape, []).append((s.node, False))
    return out


def deletable(root: Node, found: list[Node]) -> dict[int, list[tuple[Node, bool]]]:
    """Elements whose deletion changes the page's text, by digest: without a content region those outside; else, inside the
    regions, exact copies. Each with whether it is a text block or unnamed element of a region, for which the stricter
    bounds hold."""
    if not found:
        return outside(root, found)
    out: dict[int, list[tuple[Node, bool]]] = {}
    for region in found:
        for s in subtrees(region, set()):
            box = bool(s.node.names) and s.node.tag not in TEXT
            if s.alone and s.node is not region and (box or s.node.tag not in CELLS):
                out.setdefault(s.full, []).append((s.node, not box))
    return out


def main_text(root: Node, hits: set[int]) -> str:
    """The page's text without the template subtrees in hits. What recurs inside a region stays if it is more than half of the
    region's text, as in copies of an article that differ in some words. On a page without a region, what only has mostly the same words as
    on other pages stays if it is more than half of the text without exact copies, as the values of a page of data are."""
    found = regions(root)
    scope = found or [root]
    if not hits:
        return text_of(scope, set())
    nodes = [x for h, those in deletable(root, found).items() if h in hits for x in those]
    sure = {id(n) for n, strict in nodes if (not strict if found else strict is not None)}
    text, whole = text_of(scope, {id(n) for n, _ in nodes}), text_of(scope, sure)
    return text if len(text) * 2 >= len(whole) else whole


def candidates(pages: DataFrame, key: list[str] | None = None) -> DataFrame:
    """key (page_id), host, content (a digest of the page's text) and hash of the distinct template candidates of each page; deletes:
    0 if the page's text doesn't change if it is deleted, 1 if it does, 2 if it does under the stricter bounds. Hash 0 stands
    for the page itself. key: the long columns that name a page."""
    key = key or ["page_id"]
    names = [*key, "host", "content", "hash", "deletes"]

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for *page, url, source in zip(*(batch.column(c).to_pylist() for c in (*key, "url", "html"))):
                host = parts_of(url)[0]
                root = parse(source or "")
                found = regions(root)
                content = _digest(text_of(found or [root], set()))
                inner = deletable(root, found)
                outer = outside(root, found) if found else inner
                rows += [(*page, host, content, 0, 0)]
                rows += [(*page, host, content, h, 1 + any(strict for _, strict in inner[h]) if h in inner else 0) for h in {*inner, *outer}]
            columns = zip(*rows) if rows else [()] * len(names)
            kinds = (*[pa.int64()] * len(key), pa.string(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    schema = ", ".join(f"{c} long" for c in key)
    return pages.select(*(F.col(c).cast("long") for c in key), "url", "html").mapInArrow(run, f"{schema}, host string, content long, hash long, deletes int")


def templates(found: DataFrame, share: float, least: int, most: float, many: int) -> DataFrame:
    """host and hash of the subtrees that recur on at least `share` of the host's pages, and on `least` pages; strict: whether
    on `most` of them and on `many`. Pages with the same content count once. found: from candidates()."""
    once = found.select("host", "hash", "content").distinct()
    counts = written(once.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).where(f"n >= {least} or hash = 0"), "subtrees")
    sites = counts.where("hash = 0").select("host", F.col("n").alias("pages"))
    strict = (F.col("n") >= F.col("pages") * most) & (F.col("n") >= many)
    return counts.where("hash <> 0").join(sites, "host").where(F.col("n") >= F.col("pages") * share).select("host", "hash", strict.alias("strict"))


def extract(pages: DataFrame, share: float = 0.5, least: int = 5, most: float = 0.9, many: int = 20) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html). Of the template subtrees, only the hashes
    that a page has itself are joined to it, by the row's file and place."""
    pages, row = with_rows(pages.select("page_id", "url", "html"))
    found = written(candidates(pages, row), "candidates")
    hits = found.where("deletes > 0").join(templates(found, share, least, most, many), ["host", "hash"]).where("deletes = 1 or strict")
    hits = written(hits.groupBy(*row).agg(F.collect_set("hash").alias("hits")), "hits")

    def run(batches):
        for batch in batches:
            texts = [main_text(parse(source or ""), set(hashes or ())) for source, hashes in zip(batch.column("html").to_pylist(), batch.column("hits").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    rows = pages.join(hits, row, "left").select(F.col("page_id").cast("long"), "url", "html", "hits")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
