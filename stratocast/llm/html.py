"""HTML extraction: the main text of pages, less site templates found by counting element subtrees per host."""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratocast.llm.common import bounded, materialize

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>", re.S)
HINT = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
PART = re.compile(r"[a-z0-9]+")

# HTML element names and the usual names of page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body caption dd dt head html legend li option tbody td tfoot th thead title tr".split())
FURNITURE = frozenset("head nav header footer aside form script style noscript template iframe svg button select textarea input menu dialog object canvas audio video math".split())
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager header masthead footer copyright comment comments commentlist disqus replies "
    "respond share sharing social related recommended newsletter subscribe subscription signup login search widget toolbar skip".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre article main body html li dd dt td th figcaption".split())
WHOLE = frozenset("article main body html".split())
LINES = PROSE - WHOLE
PAGE = 0  # stands among a page's subtree hashes for the page itself
PEERS = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}


class Node:
    """An element: its name, whether it is page furniture by element or named like it, its children (nodes and text) and its subtree's hash."""

    __slots__ = ("tag", "furniture", "named", "role", "children", "hash")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.furniture, self.named, self.role, self.children, self.hash = tag, tag in FURNITURE, False, "", [], 0
        for hint in HINT.finditer(attributes):
            words = PART.findall(hint[1].lower())
            self.named |= tag not in ("html", "body", "main", "article") and not FURNITURE_WORDS.isdisjoint(words)
            self.furniture |= tag == "article" and not {"comment", "comments"}.isdisjoint(words)
            self.role = self.role or ("main" if hint[0].lower().startswith("role") and "main" in words else "")


def parse(page: str) -> Node:
    """The tree of a page, with missing end tags implied; anything parses."""
    root = Node("#page")
    stack, at, end = [root], 0, len(page)
    while at < end:
        found = TOKEN.search(page, at)
        stop = found.start() if found else end
        if stop > at:
            stack[-1].children.append(page[at:stop])
        if not found:
            break
        at = found.end()
        if found[2] is None:
            continue
        tag = found[2].lower()
        if found[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
            continue
        if tag in CLOSES_P:
            _close(stack, ("p",), ("button", "td", "th", "caption", "object", "#page", "article", "div", "li", "section", "table"))
        if tag in PEERS:
            _close(stack, ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,), PEERS[tag])
        node = Node(tag, found[3])
        stack[-1].children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            node.children.append(page[at : close.start() if close else end])
            at = close.end() if close else end
        elif tag not in VOID and not found[3].endswith("/"):
            stack.append(node)
    return root


def _close(stack: list[Node], names: tuple[str, ...], fence: tuple[str, ...]) -> None:
    for depth in range(len(stack) - 1, 0, -1):
        if stack[depth].tag in names:
            del stack[depth:]
            return
        if stack[depth].tag in fence:
            return


def hash_subtrees(root: Node) -> list[Node]:
    """Sets every block element's hash (name, text, children) bottom up; returns those nodes."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if type(c) is Node]
    for node in reversed(order):
        h = xxhash.xxh64(node.tag)
        for child in node.children:
            h.update(" ".join(child.split()) if type(child) is str else child.hash.to_bytes(8, "little"))
        node.hash = h.intdigest()
    return [n for n in order if n.tag in BLOCK]


def main_roots(root: Node) -> list[Node]:
    """The outermost articles; else the main elements; else those below furniture elements; else the page."""
    for below in (("form", "header"), FURNITURE):
        for wanted in (lambda n: n.tag == "article", lambda n: n.tag == "main" or n.role == "main"):
            found, todo = [], [root]
            while todo:
                node = todo.pop()
                if wanted(node) and not node.furniture:
                    found.append(node)
                elif not node.furniture or node.tag in below:
                    todo += [c for c in reversed(node.children) if type(c) is Node]
            if found:
                return found
    return [root]


def prose_places(root: Node) -> set[tuple[int, int]]:
    """(hash, place) of the prose elements inside a page's articles: 2i for the i-th child, 2j + 1 for the j-th last."""
    roots = main_roots(root)
    out, todo = set(), roots if roots[0] is not root else []
    while todo:
        inner = [c for c in todo.pop().children if type(c) is Node]
        for i, node in enumerate(inner):
            if node.tag in LINES and not node.named:
                out |= {(node.hash, 2 * i), (node.hash, 2 * (len(inner) - 1 - i) + 1)}
        todo = todo + inner
    return out


def main_text(root: Node, template: frozenset[int] = frozenset(), placed: frozenset[int] = frozenset()) -> str:
    """Blocks of the main text in page order. Inside an article prose elements are template only if placed.

    Placed prose that makes up over half of the text stays: so recur the paragraphs of an article's near copies. Names like furniture's count outside articles only, and not where nothing else would be left.
    """
    roots = main_roots(root)
    marked = roots[0] is not root
    text = _blocks(roots, template, frozenset(), marked, not marked and _blocks(roots, frozenset(), frozenset(), marked, True) != "")
    if marked and placed:
        less = _blocks(roots, template, placed, marked, False)
        return less if 2 * len(less) >= len(text) else text
    return text


def _blocks(roots: list[Node], template: frozenset[int], placed: frozenset[int], marked: bool, by_name: bool) -> str:
    blocks: list[str] = []
    run: list[str] = []

    def flush():
        text = " ".join(unescape("".join(run)).split())
        run.clear()
        if text:
            blocks.append(text)

    todo: list = list(reversed(roots))
    while todo:
        node = todo.pop()
        if node is None:
            flush()
        elif type(node) is str:
            run.append(node)
        elif node.tag == "br":
            run.append(" ")
        elif node.furniture and not (marked and node.tag == "header") or (by_name and node.named) or (template and node.hash in template and node.tag in BLOCK and not (marked and node.tag in PROSE and not node.named)) or (node.hash in placed and node.tag in LINES):
            run.append(" ")
        elif node.tag in BLOCK:
            flush()
            todo.append(None)
            todo += reversed(node.children)
        else:
            todo += reversed(node.children)
    flush()
    return "\n".join(blocks)


def extract(pages: DataFrame, least_pages: int = 4, least_share: float = 0.2, pages_a_task: int = 20_000, many_pages: int = 100, many_share: float = 0.001) -> DataFrame:
    """page_id, url, text, n_chars for every row.

    The main text is that of the article elements (else main, else the whole page) without page furniture, known by
    element and, on pages without article and main, by class, id or role, and without template subtrees: block elements whose hash stands on at least least_pages
    different pages of a host and on least_share of them, or on many_pages and many_share. Pages with the same main text
    count as one on both sides, so copies of an article are no template and hide none; prose elements inside an article go only if half of their pages have them in one
    place (the i-th child or the j-th last) and they are at most half of the text, so a sentence that articles share, or
    an article in many near copies, is kept.

    Null and empty pages give an empty text. Null or odd URLs have no host and no template. Null ids stay null and
    repeated rows are each returned. An empty table gives no rows. Other columns are not read.

    Hashes are counted per host by map-side aggregation. The template hashes of a host (at most its blocks per page over
    many_share) meet its pages by (host, salt), a salt for each pages_a_task pages, so a host with a third of all pages is
    spread over as many tasks as its size asks for. The hosts with several salts, at most 65536, are broadcast.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), F.col("html").cast("string").alias("html"))

    def subtrees(batches):
        for batch in bounded(batches, "html"):
            rows, hashes, places, texts = [], [], [], []
            for i, page in enumerate(batch.column(1).to_pylist()):
                root = parse(page or "")
                found = [(h, None) for h in {n.hash for n in hash_subtrees(root)} | {PAGE}]
                found += prose_places(root)
                rows += [i] * len(found)
                hashes += [h for h, _ in found]
                places += [p for _, p in found]
                texts += [xxhash.xxh64_intdigest(main_text(root))] * len(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int32())), pa.array(np.array(hashes, np.uint64).view(np.int64)), pa.array(places, pa.int32()), pa.array(np.array(texts, np.uint64).view(np.int64))],
                names=["host", "subtree", "place", "page"],
            )

    seen = source.where("host <> ''").select("host", "html").mapInArrow(subtrees, "host string, subtree long, place int, page long")
    per_subtree = seen.groupBy("host", "subtree", "place", "page").agg(F.lit(1).alias("one")).groupBy("host", "subtree", "place").agg(F.count("*").alias("n"))
    per_subtree = per_subtree.where((F.col("n") >= least_pages) | (F.col("subtree") == PAGE)).groupBy("host", "subtree")
    per_subtree = per_subtree.agg(F.max(F.when(F.col("place").isNull(), F.col("n"))).alias("on_pages"), F.max(F.when(F.col("place").isNotNull(), F.col("n"))).alias("in_place"))
    per_subtree = materialize(per_subtree, "subtrees")
    host_pages = per_subtree.where(F.col("subtree") == PAGE).select("host", F.col("on_pages").alias("pages"))
    often = (F.col("on_pages") >= least_share * F.col("pages")) | (F.col("on_pages") >= F.greatest(F.lit(many_pages), many_share * F.col("pages")))
    template = per_subtree.where((F.col("subtree") != PAGE) & (F.col("on_pages") >= least_pages)).join(host_pages, "host").where(often)
    by_host = template.groupBy("host").agg(F.collect_set("subtree").alias("template"), F.collect_set(F.when(2 * F.col("in_place") >= F.col("on_pages"), F.col("subtree"))).alias("placed"))
    sizes = materialize(source.groupBy("host").agg(F.count("*").alias("n")), "hosts")
    most = max(pages_a_task, (sizes.agg(F.sum("n")).first()[0] or 0) // 65_536)
    large = F.broadcast(sizes.where(F.col("n") > most).select("host", F.ceil(F.col("n") / most).cast("int").alias("salts")))
    salts = F.coalesce("salts", F.lit(1))
    spread = by_host.join(large, "host", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    spread = materialize(spread, "templates")  # a table of known size: Spark broadcasts it where it is small, and shuffles pages only where it is not
    salted = source.join(large, "host", "left").withColumn("salt", F.pmod(F.xxhash64("page_id", "html"), salts).cast("int")).drop("salts")
    joined = salted.join(spread, ["host", "salt"], "left").select("page_id", "url", "html", "template", "placed")

    def texts(batches):
        for batch in bounded(batches, "html"):
            out = []
            for page, *hashes in zip(*[batch.column(c).to_pylist() for c in (2, 3, 4)], strict=True):
                root = parse(page or "")
                if hashes[0]:
                    hash_subtrees(root)
                out.append(main_text(root, *[frozenset(h & (2**64 - 1) for h in some or ()) for some in hashes]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(texts, "page_id long, url string, text string, n_chars long")
