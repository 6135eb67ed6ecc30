"""Main text of web pages by wrapper induction.

Pages of a host meet in runs, in which each DOM tree is aligned by simple tree matching with the
first tree of the same layout. Every aligned node votes for its place (the labels from the root
on) and for its place with its words, and Spark counts the votes of all pages of the host. Words
that stand at a place on most of the pages which have that place are the host's template;
nodes whose words vary are its slots. Applied to a page, template nodes fall away wherever they
stand, inside the article too, and the slots that are left choose the content: elements that call
themselves an article, if they hold a fair part of the slots' text, or else the deepest container
that holds nearly all of it. Menus, forms, adverts and comments that are marked as such by
element, role or class go as well; class words weigh less inside an article.

Nothing recurses, so the depth of a page does not matter.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.dom import BLOCKS, RAW, Node, parse
from cohortspark.llm.textops import arrow_limits
from cohortspark.sources.stored import settle

RUN = 512  # pages of a host that are aligned in one run, about
SEGMENT = 32  # children aligned at a time between anchors
VOICES = 3  # different pages that must agree before words are template
SHARE = 0.75  # of the pages that have a place hold the same words there
_SPACE = re.compile(r"\s+")

#: elements and marks that are no part of an article
_OUT_TAGS = RAW | frozenset("nav footer aside form head button select input object svg canvas audio video dialog menu fieldset map math".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
_OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner menu menus nav navbar navigation breadcrumb "
    "breadcrumbs header masthead topbar footer sidebar aside widget widgets cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments disqus reply replies respond "
    "pagination pager toolbar search searchbox copyright disclaimer skip".split())
#: of these, one is enough inside an article
_OUT_ANYWHERE = frozenset("ad ads advert adverts advertisement advertising adsense sponsored promo comment comments disqus cookie newsletter".split())
#: words that say nothing about what a box holds
_PLAIN_WORDS = frozenset(
    "box block bar button buttons icon icons link links list item items container wrapper wrap inner outer top bottom left right area unit section group row col "
    "posts articles stories user reader site page form slot".split())
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt".split())
_MAIN_WORDS = frozenset("article content story post entry body main text".split())
_CONTAINERS = frozenset("html body div section main article td tr tbody table center".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def _marks(node: Node) -> set[str]:
    text = f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}"
    return set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", text).lower())) if len(text) > 1 else set()


def _unwanted(node: Node, inside: bool, headline: bool) -> bool:
    """No part of an article. ``inside`` a known article its own header may stay, prose goes only by
    the plainest marks, and a box only if nothing in its name speaks for it."""
    if node.tag in _OUT_TAGS or node.attrs.get("role", "").lower() in _OUT_ROLES or "hidden" in node.attrs:
        return True
    if node.attrs.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", node.attrs.get("style", "")):
        return True
    marks = _marks(node)
    if node.tag in ("html", "body", "main", "article") and not {"comment", "comments", "reply", "ad", "ads", "advert", "sponsored", "promo"} & marks:
        return False
    if node.tag == "header" or "header" in marks:
        return not (inside and headline)
    if not inside or not marks & _OUT_WORDS:
        return bool(marks & _OUT_WORDS)
    if node.tag in _PROSE:
        return marks <= _OUT_ANYWHERE | _PLAIN_WORDS
    return bool(marks & _OUT_ANYWHERE) or marks <= _OUT_WORDS | _PLAIN_WORDS


def _digest(*parts) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


class Tree:
    """A page's elements top down, as columns; inline elements belong to the words of their block."""

    def __init__(self, page: str):
        self.nodes, self.parent = [], []
        stack = [(parse(page), -1)]
        while stack:
            node, parent = stack.pop()
            i = len(self.nodes)
            self.nodes.append(node)
            self.parent.append(parent)
            stack += [(c, i) for c in reversed(node.children) if isinstance(c, Node) and c.tag not in RAW]
        n = len(self.nodes)
        self.block = [node.tag in BLOCKS or i == 0 for i, node in enumerate(self.nodes)]
        self.headline, self.chars, self.size = [False] * n, [0] * n, [1] * n
        self.digest, self.children = [0] * n, [[] for _ in range(n)]
        own = {id(node): i for i, node in enumerate(self.nodes)}
        for i in range(n - 1, -1, -1):  # children come after their parents
            words, some = [], False
            for c in self.nodes[i].children:
                if isinstance(c, str):
                    if text := " ".join(c.split()):
                        words.append(text)
                        some = True
                        self.chars[i] += len(text)
                elif (j := own.get(id(c))) is not None:
                    some |= self.digest[j] != 0
                    if self.block[j]:
                        words.append((c.label(), self.size[j], self.digest[j]))
                    elif self.digest[j]:
                        words.append(self.digest[j])
                        self.chars[i] += self.chars[j]
            if some:
                self.digest[i] = _digest(*words)
            if (p := self.parent[i]) >= 0:
                self.headline[p] |= self.headline[i] or self.nodes[i].tag in _HEADINGS
                self.block[p] |= self.block[i]
                if self.block[i]:
                    self.size[p] += self.size[i]
                    self.children[p].append(i)
        self.label = [node.label() if b else "" for node, b in zip(self.nodes, self.block)]
        self.path, self.key = [0] * n, [0] * n
        for i in range(n):
            self.children[i].reverse()
            if self.block[i]:
                self.path[i] = _digest(self.path[self.parent[i]] if i else "", self.label[i])
                if self.digest[i] and self.nodes[i].tag not in ("#root", "html", "body"):
                    self.key[i] = _digest(self.path[i], self.digest[i])

    def shape(self) -> bytes:
        """What :class:`Shape` needs of the blocks: 32 bytes each, however long their words."""
        blocks = [i for i in range(len(self.nodes)) if self.block[i]]
        number = {i: k for k, i in enumerate(blocks)} | {-1: -1}
        columns = ([self.path[i] for i in blocks], [self.digest[i] for i in blocks], [self.key[i] for i in blocks], [number[self.parent[i]] for i in blocks])
        return np.array(columns, np.int64).tobytes()

    def layout(self) -> int:
        """Pages of one layout have the same kinds of elements near the root."""
        depth, kinds = [0] * len(self.nodes), set()
        for i in range(1, len(self.nodes)):
            depth[i] = depth[self.parent[i]] + 1
            if self.block[i] and depth[i] <= 3:
                kinds.add(self.path[i])
        return _digest(*sorted(kinds))

    def voice(self) -> int:
        """The three longest blocks of words: pages that agree in them are copies and vote once."""
        blocks = {self.digest[i]: self.chars[i] for i in range(len(self.nodes)) if self.block[i] and self.chars[i]}
        return _digest(*sorted(blocks, key=lambda d: (-blocks[d], d))[:3])


class Shape:
    """The blocks of a page without their words, top down."""

    def __init__(self, shape: bytes):
        self.path, self.digest, self.key, parent = np.frombuffer(shape, np.int64).reshape(4, -1).tolist()
        self.size, self.children = [1] * len(parent), [[] for _ in parent]
        for i in range(len(parent) - 1, 0, -1):
            self.size[parent[i]] += self.size[i]
        for i in range(1, len(parent)):
            self.children[parent[i]].append(i)


def _segments(a: Shape, x: list[int], b: Shape, y: list[int]):
    """Pieces of two lists of children that may be aligned: cut where both hold the same words
    once, longest ascending run of such anchors, and long pieces in proportion."""
    def cut(x, y):
        parts = max(-(-len(x) // SEGMENT), -(-len(y) // SEGMENT))
        for k in range(parts):
            yield x[k * len(x) // parts : (k + 1) * len(x) // parts], y[k * len(y) // parts : (k + 1) * len(y) // parts]

    if len(x) <= SEGMENT and len(y) <= SEGMENT:
        yield x, y
        return
    places: list[dict] = []
    for tree, z in ((a, x), (b, y)):
        once: dict = {}
        for at, i in enumerate(z):
            name = tree.path[i], tree.digest[i]
            once[name] = -1 if name in once else at
        places.append({k: v for k, v in once.items() if v >= 0})
    pairs = [(at, places[1][k]) for k, at in places[0].items() if k in places[1]]
    ends, tails, before = [], [], [-1] * len(pairs)
    for i, (_, at) in enumerate(pairs):
        k = bisect_left(ends, at)
        ends[k : k + 1], tails[k : k + 1] = [at], [i]
        before[i] = tails[k - 1] if k else -1
    chain, i = [], tails[-1] if tails else -1
    while i >= 0:
        chain.append(pairs[i])
        i = before[i]
    p = q = 0
    for i, j in [*reversed(chain), (len(x), len(y))]:
        yield from cut(x[p:i], y[q:j])
        if i < len(x):
            yield [x[i]], [y[j]]
        p, q = i + 1, j + 1


def aligned(a: Shape | Tree, b: Shape | Tree) -> list[tuple[int, int]]:
    """Simple tree matching: the largest common top-down, ordered alignment of two trees' blocks.

    Pairs of equally labelled children of pairs are listed level by level, weighed from the
    deepest level up, and the best ones followed from the root down. Below a pair, equal paths
    are equal labels.
    """
    levels = [[(0, 0)]]
    pieces: dict = {}
    while levels[-1]:
        below = []
        for i, j in levels[-1]:
            if a.digest[i] and a.digest[i] == b.digest[j] and a.size[i] == b.size[j]:
                continue  # equal: aligned node by node below
            pieces[i, j] = list(_segments(a, a.children[i], b, b.children[j]))
            below += [(u, v) for x, y in pieces[i, j] for u in x for v in y if a.path[u] == b.path[v]]
        levels.append(below)
    weight: dict = {}
    grids: dict = {}
    for level in reversed(levels):
        for pair in level:
            if pair not in pieces:
                weight[pair] = a.size[pair[0]]
                continue
            total, grids[pair] = 1, []
            for x, y in pieces[pair]:
                grid = [[0] * (len(y) + 1)]
                for u in x:
                    last, row = grid[-1], [0]
                    for k, v in enumerate(y):
                        row.append(max(row[k], last[k + 1], last[k] + weight.get((u, v), 0)))
                    grid.append(row)
                total += grid[-1][-1]
                grids[pair].append(grid)
            weight[pair] = total
    out, todo = [], [(0, 0)]
    while todo:
        pair = todo.pop()
        out.append(pair)
        if pair not in pieces:
            x, y = a.children[pair[0]], b.children[pair[1]]
            todo += [(u, v) for u, v in zip(x, y) if a.path[u] == b.path[v]]
            continue
        for (x, y), grid in zip(pieces[pair], grids[pair]):
            i, j = len(x), len(y)
            while i and j:
                gain = weight.get((x[i - 1], y[j - 1]), 0)
                if gain and grid[i][j] == grid[i - 1][j - 1] + gain:
                    i, j = i - 1, j - 1
                    todo.append((x[i], y[j]))
                elif grid[i][j] == grid[i - 1][j]:
                    i -= 1
                else:
                    j -= 1
    return out


def votes(reference: Shape | Tree, page: Shape | Tree) -> set[tuple[int, int | None]]:
    """(place, None) and (place with its words, place) of the page's nodes aligned with the reference."""
    found = [j for _, j in aligned(reference, page) if page.key[j]]
    return {(page.path[j], None) for j in found} | {(page.key[j], page.path[j]) for j in found}


def _roots(tree: Tree, template: frozenset[int]) -> list[int] | None:
    """Where the content is; ``[]`` for the whole page, ``None`` if no text is left."""
    n = len(tree.nodes)
    gone, slots = [False] * n, [0] * n
    for i, node in enumerate(tree.nodes):
        gone[i] = i > 0 and (gone[tree.parent[i]] or (tree.block[i] and tree.key[i] in template) or _unwanted(node, False, tree.headline[i]))
    for i in range(n - 1, -1, -1):
        if not gone[i]:
            slots[i] += tree.chars[i] if tree.block[i] else 0
            if i:
                slots[tree.parent[i]] += slots[i]
    whole = slots[0]
    if not whole:
        return None
    kinds = [
        lambda node: node.tag == "article" or node.attrs.get("itemprop", "").lower() == "articlebody",
        lambda node: node.tag == "main" or node.attrs.get("role", "").lower() == "main",
    ]
    for kind in kinds:
        held, roots = [False] * n, []
        for i, node in enumerate(tree.nodes):
            held[i] = i > 0 and held[tree.parent[i]]
            if not held[i] and not gone[i] and kind(node):
                held[i] = True
                roots.append(i)
        if 4 * sum(slots[i] for i in roots) >= whole:
            return roots
    named = [i for i, node in enumerate(tree.nodes) if not gone[i] and node.tag in ("div", "section", "td") and _MAIN_WORDS & _marks(node)]
    best = max(named, key=lambda i: slots[i], default=0)
    if best and 2 * slots[best] >= whole:
        return [best]
    if template:
        return [max(i for i, node in enumerate(tree.nodes) if i == 0 or (node.tag in _CONTAINERS and 10 * slots[i] >= 9 * whole))]
    return []


def _blocks(tree: Tree, root: int, template: frozenset[int], inside: bool, lines: list[str]) -> None:
    run: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(run)).strip()
        run.clear()
        if text:
            lines.append(text)

    number = {id(node): i for i, node in enumerate(tree.nodes)}
    stack: list = [(tree.nodes[root], 0)]
    while stack:
        node, at = stack.pop()
        if at == len(node.children):
            if node.tag in BLOCKS:
                flush()
            continue
        stack.append((node, at + 1))
        c = node.children[at]
        if isinstance(c, str):
            run.append(c)
        elif c.tag == "br":
            run.append(" ")
        else:
            if c.tag in BLOCKS:
                flush()
            i = number.get(id(c))
            if i is not None and not _unwanted(c, inside, tree.headline[i]) and not (tree.block[i] and tree.key[i] in template):
                stack.append((c, 0))
    flush()


def extract(page: str, template: frozenset[int] = frozenset()) -> str:
    """The main text of one page under its host's wrapper; a page that is all template has none."""
    tree = Tree(page)
    roots = _roots(tree, template)
    if roots is None and template:
        template = frozenset()
        roots = _roots(tree, template)
    lines: list[str] = []
    for root in roots or [0]:
        _blocks(tree, root, template, bool(roots), lines)
    return "\n".join(lines)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, template) of pages (host, html), from the votes of all pages with a host.

    A big host is cut into runs of about ``RUN`` pages by a hash of the page, and each run has
    references of its own, so no host fills a task and no single odd page decides. Only shapes
    are shuffled.
    """
    pages = pages.filter("html is not null and html <> '' and host <> ''").select("host", "html", F.xxhash64("html").alias("h"))
    sizes = settle(pages.groupBy("host").agg(F.ceil(F.count("*") / RUN).alias("runs")).filter("runs > 1"), "hosts")

    def outline(batches):
        for batch in batches:
            trees = [Tree(page.as_py()) for page in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([t.layout() for t in trees], pa.int64()), pa.array([t.voice() for t in trees], pa.int64()),
                 pa.array([t.shape() for t in trees], pa.binary())], ["host", "h", "layout", "voice", "shape"])

    def vote(batches):
        run, references = None, {}
        for batch in batches:
            out = []
            for host, number, layout, voice, shape in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4)):
                if (host, number) != run:
                    run, references = (host, number), {}
                page = Shape(shape.as_py())
                out += [(host, key, place, voice) for key, place in votes(references.setdefault(layout, page), page)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["host", "key", "place", "voice"])

    shapes = pages.mapInArrow(outline, "host string, h long, layout long, voice long, shape binary")
    placed = shapes.join(sizes, "host", "left").withColumn("run", F.pmod("h", F.coalesce("runs", F.lit(1))))
    cast = placed.repartition("host", "run").sortWithinPartitions("host", "run", "h").select("host", "run", "layout", "voice", "shape").mapInArrow(
        vote, "host string, key long, place long, voice long")
    counts = settle(cast.distinct().groupBy("host", "key", "place").agg(F.count("*").alias("n")).filter(F.col("n") >= VOICES), "votes")
    places = counts.filter("place is null").select("host", F.col("key").alias("place"), F.col("n").alias("pages"))
    template = counts.filter("place is not null").join(places, ["host", "place"]).filter(F.col("n") >= SHARE * F.col("pages"))
    return settle(template.groupBy("host").agg(F.sort_array(F.collect_list("key")).alias("template")), "wrappers")


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id_col, url_col, text)``, one row per page.

    The text has one line per block of the article, white space inside a block made one
    space, character references decoded. A null page, and one without text outside menus and
    the like, has an empty text. Pages without a host in their url, and hosts with fewer than
    ``VOICES`` different pages, have no wrapper. Repeated rows and copies of a page vote once
    and are extracted alike; other columns are ignored; an empty table gives an empty result.
    """
    arrow_limits(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"), host_of(F.col(url_col).cast("string")).alias("host"))

    def apply(batches):
        known: dict = {}
        for batch in batches:
            out = []
            hosts = batch.column(0).to_pylist()
            for i, page in enumerate(batch.column(2)):
                if hosts[i] not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[hosts[i]] = frozenset(batch.column(1)[i].as_py() or ())
                out.append(extract(text, known[hosts[i]]) if (text := page.as_py()) else "")
            yield pa.RecordBatch.from_arrays([batch.column(3), batch.column(4), pa.array(out, pa.string())], ["page", "url", "text"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    joined = rows.join(wrappers(rows), "host", "left").select("host", "template", "html", "page", "url")
    return joined.mapInArrow(apply, f"page {kinds['page']}, url {kinds['url']}, text string").toDF(id_col, url_col, "text")
