"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut at its block tags into flat blocks of text. A block has a word
count and a link density, those of the block before and of the one after, and
what its open elements say about it (inside an article, inside a menu, footer
or form, named like an advert, a comment ...). A decision tree, trained by
Spark on the small labelled table of ``html_layouts``, says which blocks are
the article. Every page is one row of one task; the tree is a few arrays.

Pages are read as browsers read them: an unclosed comment, script or tag runs
to the end of the page, an end tag closes all it encloses, a stray "<" is
text. Reading is linear in the page, whatever it holds.

Defined results: a null or empty page, or one without article, gives an empty
text and 0 characters; white space (as Unicode has it, non-breaking spaces
included) inside a block becomes one space; character references are decoded
after the markup is read; nothing is capped. Repeated pages and null ids or
urls are rows as all others; an empty table gives an empty table.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

from .common import free_name
from .html_layouts import pages as labelled_pages

FIELDS = ("words", "links", "words_before", "links_before", "words_after", "links_after", "article", "beside", "chrome",
          "hint", "content", "form", "heading", "item", "sentence")

# what a tag means
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())  # their content is no markup
HIDDEN = frozenset("noscript template svg select object video audio canvas".split())  # their content is no text of the page
BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot
    th thead tr ul""".split())
VOID = frozenset("hr".split())
FLAT = frozenset("p h1 h2 h3 h4 h5 h6".split())  # text only: closed by the next block
CHROME = frozenset("nav aside footer dialog menu".split())
FORM = frozenset("form button fieldset legend search".split())
ITEM = frozenset("li td th dt dd".split())
# words in class, id and role
NAMED = frozenset("""ad ads advert adverts advertisement advertisements advertising adsense alert banner breadcrumb breadcrumbs comment commentlist comments
    complementary consent contentinfo cookie cookies copyright dialog disclaimer discussion disqus feedback foot footer gdpr header login masthead menu modal
    nav navbar navigation newsletter notice notification pager pagination paywall popup promo promoted promotion recommended related
    replies respond reviews search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar
    trending widget""".split())
CONTENT = frozenset("article content entry main post story".split())
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"=\s*([\"'])|>")
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
CLOSING = {name: re.compile(rf"</{name}", re.IGNORECASE) for name in RAW}


@dataclass
class Block:
    """A flat block: its text, its words, how many of them are links, and what its open elements say."""
    text: str
    words: int
    linked: int
    article: bool
    chrome: bool
    hint: bool
    content: bool
    form: int  # number of the form, 0 outside
    heading: bool
    item: bool


@dataclass
class Open:
    """An open element, with the state of all elements around it."""
    name: str
    article: bool = False
    main: bool = False
    chrome: bool = False
    hint: bool = False
    content: bool = False
    form: int = 0
    hidden: bool = False
    item: bool = False


def names(tag: str) -> set[str]:
    """The words in an element's class, id and role."""
    found = " ".join(a or b or c for _, a, b, c in ATTRIBUTE.findall(tag))
    return {w.lower() for w in PART.findall(found)}


class Reader:
    """Reads one page into blocks."""

    def __init__(self, page: str):
        self.page, self.blocks = page, []
        self.stack, self.count, self.forms = [Open("")], Counter(), 0
        self.flat = ""  # the paragraph or heading that is open
        self.pieces: list[str] = []
        self.linked: list[str] = []
        self.link = 0  # size of the stack where a link is open
        self.last = {q: page.rfind(q) for q in "\"'"}
        self.read()

    def flush(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            o = self.stack[-1]
            self.blocks.append(Block(text, text.count(" ") + 1, len("".join(self.linked).split()), o.article or o.main, o.chrome, o.hint,
                                     o.content, o.form, self.flat[:1] == "h", o.item))
        self.pieces.clear()
        self.linked.clear()

    def text(self, raw: str) -> None:
        if raw and not self.stack[-1].hidden:
            raw = entities.unescape(raw) if "&" in raw else raw
            self.pieces.append(raw)
            if self.link:
                self.linked.append(raw)

    def read(self) -> None:
        page, at = self.page, 0
        while at < len(page):
            lt = page.find("<", at)
            if lt < 0:
                break
            self.text(page[at:lt])
            at = self.markup(lt)
        if at < len(page):
            self.text(page[at:])
        self.flush()

    def markup(self, lt: int) -> int:
        """What starts with "<"; where it ends."""
        page = self.page
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 2)
            return len(page) if end < 0 else end + 3
        name = NAME.match(page, lt)
        if name is None:
            if page.startswith(("<!", "<?", "</"), lt):
                end = page.find(">", lt)
                return len(page) if end < 0 else end + 1
            self.text("<")
            return lt + 1
        end = name.end()
        while True:
            stop = STOP.search(page, end)
            if stop is None:
                return len(page)
            end = stop.end()
            if not stop[1]:
                break
            if self.last[stop[1]] >= end:  # a quote that is never closed is no quote
                end = page.find(stop[1], end) + 1
        tag = name[1].lower()
        if page[lt + 1] == "/":
            self.close(tag)
        elif tag in RAW:
            shut = CLOSING[tag].search(page, end)
            return len(page) if shut is None else shut.start()
        else:
            self.open(tag, page[name.end():end])
        return end

    def open(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.text(" ")
        elif tag == "a":
            self.link = len(self.stack)
        elif tag in BLOCK or tag in HIDDEN:
            if tag in BLOCK:
                self.flush()
                self.flat = tag if tag in FLAT else ""
                if tag == "li" and self.stack[-1].name == "li":
                    self.close("li")
            if tag not in VOID and tag not in FLAT:
                self.push(tag, names(attributes) if "=" in attributes else set())
            elif "=" in attributes and names(attributes) & NAMED:
                self.push(tag, names(attributes))

    def push(self, tag: str, words: set[str]) -> None:
        o = Open(tag, **{k: v for k, v in vars(self.stack[-1]).items() if k != "name"})
        main = tag == "main" or "main" in words and tag != "body"
        article = tag == "article" and not o.chrome
        if (main or article) and not (o.main or o.article):
            o.hint, o.form = False, 0  # what encloses the article is the page
            o.chrome = o.chrome and not main
        o.main, o.article = o.main or main, o.article or article
        if tag in CHROME or tag == "header" and not (o.main or o.article):
            o.chrome = True
        if tag in FORM and not o.form:
            self.forms += 1
            o.form = self.forms
        if tag not in ("html", "body", "main"):
            o.content = o.content or bool(words & CONTENT)
            named = words & NAMED - ({"header"} if o.main or o.article else set())
            o.hint = o.hint or bool(named) and (not words & CONTENT or bool(words & {"comment", "comments"}))
        o.hidden = o.hidden or tag in HIDDEN
        o.item = tag in ITEM or o.item and tag in ("div", "section")
        self.stack.append(o)
        self.count[tag] += 1

    def close(self, tag: str) -> None:
        if tag == "a":
            self.link = 0
        if tag in BLOCK:
            self.flush()
            self.flat = ""
        if self.count[tag]:
            while True:
                name = self.stack.pop().name
                self.count[name] -= 1
                if name == tag:
                    break
            if self.link > len(self.stack):
                self.link = 0


def blocks_of(page: str | None) -> list[Block]:
    return Reader(page or "").blocks


def features(blocks: list[Block]) -> np.ndarray:
    """A row of FIELDS per block."""
    out = np.zeros((len(blocks), len(FIELDS)))
    if not blocks:
        return out
    words = np.array([b.words for b in blocks], float)
    links = np.array([b.linked for b in blocks]) / words
    plain = words * (1 - links)
    inside = np.array([b.article and not (b.chrome or b.hint) for b in blocks])
    around = np.array([not (b.chrome or b.hint) for b in blocks])
    forms = np.array([b.form for b in blocks])
    sizes = np.bincount(forms, plain)
    # a form around most of the page is the page; so is all, unless an article holds a fair part of it
    forms = (forms > 0) & (sizes[forms] < 0.7 * max(plain.sum(), 1))
    has_article = plain[inside].sum() >= 0.2 * plain[around].sum() and inside.any()
    for i, column in enumerate((words, links)):
        out[:, i] = column
        out[1:, 2 + i] = column[:-1]
        out[:-1, 4 + i] = column[1:]
    for i, b in enumerate(blocks):
        out[i, 6:] = (b.article, has_article and not b.article, b.chrome, b.hint, b.content, forms[i], b.heading, b.item,
                      b.text[-1] in ".!?:;…\"”»")
    return out


def labelled(seed: int = 13, copies: int = 24, layouts: list[str] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The labelled table: features of blocks, and 1 for those of the article."""
    pages = [blocks_of(p) for p in labelled_pages(seed, copies, layouts)]
    return (np.concatenate([features(p) for p in pages]),
            np.array([b.text.startswith("m") for p in pages for b in p], int))


@dataclass
class Tree:
    """A binary tree in arrays: rows with feature <= threshold go left; a leaf is its own child."""
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    main: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), int)
        while True:
            below = np.where(x[np.arange(len(x)), self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            if (below == node).all():
                return self.main[node]
            node = below


def train(spark: SparkSession, x: np.ndarray, y: np.ndarray, depth: int = 10) -> Tree:
    """Fit the decision tree on the labelled table."""
    table = spark.createDataFrame(pd.DataFrame(x, columns=FIELDS).assign(label=y.astype(float)))
    rows = VectorAssembler(inputCols=list(FIELDS), outputCol="features").transform(table)
    model = DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=4, maxBins=64, seed=1).fit(rows)
    nodes: list[list] = []

    def add(node) -> int:  # noqa: ANN001 - a node of the JVM's tree
        i = len(nodes)
        nodes.append([0, 0.0, i, i, node.prediction() > 0.5])
        if node.subtreeDepth() > 0:
            nodes[i][:2] = node.split().featureIndex(), node.split().threshold()
            nodes[i][2], nodes[i][3] = add(node.leftChild()), add(node.rightChild())
        return i

    add(model._java_obj.rootNode())
    return Tree(*(np.array(c) for c in zip(*nodes, strict=True)))


def classified(tree: Tree, pages: list[str | None]) -> Iterator[tuple[list[Block], np.ndarray, np.ndarray]]:
    """Per page: its blocks, their features, and which are of the article."""
    read = [blocks_of(p) for p in pages]
    x = [features(b) for b in read]
    hit = tree.predict(np.concatenate(x)) if x else np.zeros(0, bool)
    ends = np.cumsum([len(b) for b in read])
    for b, f, end in zip(read, x, ends, strict=True):
        yield b, f, hit[end - len(b):end]


def with_main_text(pages: DataFrame, html: str = "html", out: str = "text", tree: Tree | None = None) -> DataFrame:
    """``pages`` with the main text of its column ``html`` in the new column ``out`` (empty if there is none).

    A column that is named like ``out`` already gives the new one a name with underscores before it."""
    tree = train(pages.sparkSession, *labelled()) if tree is None else tree
    parts = [tree.feature, tree.threshold, tree.left, tree.right, tree.main]
    out = free_name(pages.columns, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Tree(*parts)
        for b in batches:
            html_at = b.schema.get_field_index(html)
            for i in range(0, b.num_rows, 64):  # some pages at a time: they can be long
                part = b.slice(i, 64)
                texts = ["\n\n".join(x.text for x, m in zip(blocks, main, strict=True) if m)
                         for blocks, _, main in classified(known, part.column(html_at).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, out])

    return pages.mapInArrow(run, StructType([*pages.schema.fields, StructField(out, StringType())]))


def text_blocks(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """Every block of every page in page order: page_id, block, text, words, links (density), main."""
    tree = train(pages.sparkSession, *labelled()) if tree is None else tree
    parts = [tree.feature, tree.threshold, tree.left, tree.right, tree.main]
    schema = pa.schema([("page_id", pa.int64()), ("block", pa.int32()), ("text", pa.string()), ("words", pa.int64()),
                        ("links", pa.float64()), ("main", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Tree(*parts)
        for b in batches:
            for i in range(0, b.num_rows, 64):
                ids, pages_ = (c.to_pylist() for c in b.slice(i, 64).columns)
                rows = [(page_id, j, x.text, x.words, x.linked / x.words, bool(m))
                        for page_id, (blocks, _, main) in zip(ids, classified(known, pages_), strict=True)
                        for j, (x, m) in enumerate(zip(blocks, main, strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, block int, text string, words long, links double, main boolean")


def report(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    return with_main_text(pages.select("page_id", "url", "html")).selectExpr(
        "page_id", "url", "text", "CAST(char_length(text) AS BIGINT) AS n_chars")
