"""Main text of web pages by wrapper induction.

Pages of one host are compared. For each host a few pages of its commonest
skeletons are seeds; every page is aligned by simple tree matching with the seed
that fits best. Blocks whose text is the same on most pages are template, blocks
whose text differs are slots. The main region is where most of the slots' text
lies: from the root, the element that holds most of it is entered as long as it
holds nearly all and is not itself a list of blocks. Article and main elements
and the names of classes only weigh that text up or down. A page's main text is
what it has in the region, template left out, and never what lies in menus,
headers, footers, sidebars, notices, adverts, forms, comments or code by its
tag, role, class or id, unless the region itself lies there.

All pages of a host are aligned and counted; copies of a page (equal longest
blocks) count once. A page of which nothing falls into the region, and a host of
too few pages, are read by their article or main element, or else whole.

Defined cases: a null or empty page has the empty text. A null or hostless URL
has no wrapper. Markup that is cut off, not closed or nested at any depth is
read as far as it goes, and tags that end others by rule do. Constant blocks of
a region whose constant text outweighs its slots are content: that host's pages
are near copies. Equal weights go to the first in page order. Repeated rows are
read one by one; columns beside id, url and html are not read. White space
inside a block, also at a line break element, is one space; blocks are joined by
one line feed.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import behind_leaders, materialise, spread_join, text_of

#: Fewer different pages make no wrapper.
LEAST_PAGES = 3
#: Share of the pages on which a block must be the same to be template.
SAME_SHARE = 0.6
#: Pages of a host, each of another skeleton, that its pages are aligned with.
SEEDS = 3
#: Share of an element's slot text that one child must hold to be entered.
DOMINANT = 0.6
#: Weights of slot text in article or main elements, and in elements whose names mark what surrounds an article.
MAIN_WEIGHT, NAMED_WEIGHT = 4.0, 0.25
#: Seeds of all hosts together up to this size are broadcast, and so are wrappers;
#: beyond it seeds are sent ahead of their host's pages and wrappers are joined by shuffle.
SEED_BYTES = 16 << 20
#: Pages of one host that share a join key.
PAGES_PER_KEY = 2000
#: Alignments of child lists with more cells than this are split in two, which needs memory of one row.
TABLE_CELLS = 4_000_000
#: Seeds held back in a task while it looks for the commonest skeletons.
HELD_BYTES = 32 << 20

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output "
    "picture progress q rp rt ruby s samp small span strike strong sub sup td th time tt u var wbr".split()
)
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre section summary table ul".split()
)
#: An opening tag ends the open tags named here, up to the nearest of the scope.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
        "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPE = frozenset("ul ol dl table html body article section div main aside td th select menu nav".split())
#: Elements that never hold main text.
DROPPED_TAGS = frozenset(
    "script style noscript template iframe object embed svg canvas form button select option input textarea nav footer aside "
    "dialog menu head title audio video map applet noembed noframes xmp".split()
)
DROPPED_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split()
)
#: Parts of class and id names that mark what surrounds an article.
DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent "
    "gdpr notice notices alert popup modal overlay sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs "
    "masthead topbar footer comment comments disqus replies reply respond related recommended recommendations share sharing "
    "social subscribe newsletter signup login search widget widgets pagination pager skip hidden toolbar teaser teasers".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Node:
    __slots__ = ("tag", "name", "dropped", "named", "is_main", "has_heading", "children")

    def __init__(self, tag: str, name: str = "", dropped: bool = False, named: bool = False, is_main: bool = False):
        self.tag, self.name, self.dropped, self.named, self.is_main = tag, name, dropped, named, is_main
        self.has_heading = False
        self.children: list[Node | str] = []


def _element(tag: str, raw: str) -> Node:
    dropped = tag in DROPPED_TAGS
    if not raw.strip():
        return Node(tag, "", dropped, False, tag in ("article", "main") and not dropped)
    given = {}
    for key, value in _ATTRIBUTE.findall(raw):
        given.setdefault(key.lower(), entities.unescape(value.strip("\"'")))
    name = given.get("class", "")
    role = given.get("role", "").lower()
    parts = {p.lower() for p in _NAME_PART.findall(f"{name} {given.get('id', '')}")}
    style = given.get("style", "").replace(" ", "").lower()
    dropped = (
        dropped or role in DROPPED_ROLES or "hidden" in given or given.get("aria-hidden", "").lower() == "true"
        or "display:none" in style or "visibility:hidden" in style
    )
    named = tag not in ("html", "body", "article", "main") and bool(parts & DROPPED_NAMES)
    is_main = tag in ("article", "main") or role in ("main", "article") or "articlebody" in given.get("itemprop", "").lower()
    return Node(tag, ".".join(sorted(name.split())), dropped, named, is_main and not dropped and not named)


def parse(page: str) -> Node:
    """The DOM of a page; text is kept with character references decoded."""
    root = Node("#root")
    stack = [root]
    opened: Counter = Counter()

    def cut(i: int) -> None:
        opened.subtract(n.tag for n in stack[i:])
        del stack[i:]

    def close(tags: tuple[str, ...], scope, all_of_them: bool) -> None:
        i = len(stack) - 1
        while i > 0 and any(opened[t] for t in tags):
            if stack[i].tag in tags:
                cut(i)
                if not all_of_them:
                    return
            elif stack[i].tag in scope:
                return
            i -= 1

    at, size = 0, len(page)
    while at < size:
        token = _TOKEN.search(page, at)
        text = page[at : token.start()] if token else page[at:]
        if text:
            stack[-1].children.append(entities.unescape(text) if "&" in text else text)
        if not token:
            break
        at = token.end()
        if token[2] is None:
            continue
        tag = token[2].lower()
        if token[1]:
            if opened[tag]:
                i = len(stack) - 1
                while stack[i].tag != tag:
                    i -= 1
                cut(i)
            continue
        if tag in ENDS_P:
            close(("p",), SCOPE, False)
        if tag in ENDS:
            close(ENDS[tag], SCOPE - {*ENDS[tag]}, True)
        node = _element(tag, token[3])
        if tag in ("h1", "h2"):
            for above in reversed(stack):
                if above.has_heading:
                    break
                above.has_heading = True
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
            inside = page[at : end.start()] if end else page[at:]
            if tag in ("title", "textarea"):
                node.children.append(entities.unescape(inside))
            at = end.start() if end else size
            if end:
                closing = page.find(">", at)
                at = closing + 1 if closing >= 0 else size
        elif tag not in VOID and not token[3].endswith("/"):
            opened[tag] += 1
            stack.append(node)
    return root


# ---------------------------------------------------------------- outlines


class Page:
    """A DOM reduced to its block elements in page order, and the text blocks with their elements.

    `named` is the innermost element around each (or itself) that its names
    mark as no content, -1 where there is none. `shape` stands for the tags
    below an element, `full` for tags and text.
    """

    def __init__(self, root: Node):
        self.label, self.parent, self.kids = ["#root"], [-1], [[]]
        self.named, self.is_main, self.heading = [-1], [False], [False]
        self.blocks: list[tuple[int, str]] = []
        pending: list[str] = []

        def flush(element: int) -> None:
            text = " ".join("".join(pending).split())
            pending.clear()
            if text:
                self.blocks.append((element, text))

        # An explicit stack: pages nest deeper than Python calls may.
        work: list[list] = [[root, 0, 0, True]]
        while work:
            node, i, element, is_block = top = work[-1]
            if i == len(node.children):
                work.pop()
                if is_block:
                    flush(element)
                elif node.tag in ("td", "th"):
                    pending.append(" ")
                continue
            top[1] += 1
            child = node.children[i]
            if isinstance(child, str):
                pending.append(child)
            elif child.tag == "br":
                pending.append(" ")
            # A header inside an article is the article's own if it holds its heading.
            elif child.dropped or (child.tag == "header" and not child.has_heading):
                if child.tag not in INLINE:
                    flush(element)
            elif child.tag in INLINE:
                if not child.named:
                    work.append([child, 0, element, False])
            else:
                flush(element)
                new = len(self.label)
                self.label.append(f"{child.tag}.{child.name}")
                self.parent.append(element)
                self.kids.append([])
                self.kids[element].append(new)
                self.named.append(new if child.named else self.named[element])
                self.is_main.append(child.is_main)
                self.heading.append(child.tag in ("h1", "h2"))
                work.append([child, 0, new, True])
        own: list[list[str]] = [[] for _ in self.label]
        for element, text in self.blocks:
            own[element].append(text)
        n = len(self.label)
        self.size, self.shape, self.full = [1] * n, [0] * n, [0] * n
        for e in range(n - 1, -1, -1):
            kids = self.kids[e]
            self.size[e] += sum(self.size[k] for k in kids)
            self.shape[e] = hash((self.label[e], *(self.shape[k] for k in kids)))
            self.full[e] = hash((self.shape[e], *own[e], *(self.full[k] for k in kids)))

    def sums(self, own: list[float]) -> list[float]:
        """Totals over the subtree of each element."""
        out = list(own)
        for e in range(len(out) - 1, 0, -1):
            out[self.parent[e]] += out[e]
        return out

    def main_element(self) -> int:
        """The article element that holds most text, or else the main element; 0, the whole page, without either."""
        chars = [0] * len(self.label)
        for element, text in self.blocks:
            chars[element] += len(text) if self.named[element] < 0 else 0
        total = self.sums(chars)
        found = [e for e, yes in enumerate(self.is_main) if yes and self.named[e] < 0]
        found = [e for e in found if not self.label[e].startswith("main.")] or found
        return max(found, key=total.__getitem__, default=0)


def outline(page: str | None) -> Page:
    return Page(parse(page or ""))


# ---------------------------------------------------------------- simple tree matching


def _in_order(row: Callable[[int], np.ndarray], m: int, n: int) -> list[tuple[int, int]]:
    """Pairs (i, j), rising in both, of the greatest total weight; `row(i)` are the weights of i with all j."""

    def step(before: np.ndarray, weights: np.ndarray) -> np.ndarray:
        now = before.copy()
        np.maximum(before[1:], before[:-1] + weights, out=now[1:])
        return np.maximum.accumulate(now, out=now)

    out: list[tuple[int, int]] = []
    work = [(0, m, 0, n)]
    while work:
        a, b, c, d = work.pop()
        if a == b or c == d:
            continue
        if (b - a) * (d - c) > TABLE_CELLS and b - a > 1:
            middle = (a + b) // 2
            first = last = np.zeros(d - c + 1, np.int64)
            for i in range(a, middle):
                first = step(first, row(i)[c:d])
            for i in range(b - 1, middle - 1, -1):
                last = step(last, row(i)[c:d][::-1])
            cut = c + int((first + last[::-1]).argmax())
            work += [(middle, b, cut, d), (a, middle, c, cut)]
            continue
        best = [np.zeros(d - c + 1, np.int64)]
        for i in range(a, b):
            best.append(step(best[-1], row(i)[c:d]))
        table = [x.tolist() for x in best]
        i, j = b - a, d - c
        while i and j:
            if table[i][j] == table[i][j - 1]:
                j -= 1
            elif table[i][j] == table[i - 1][j]:
                i -= 1
            else:
                i, j = i - 1, j - 1
                out.append((a + i, c + j))
    return out


class Matcher:
    """Simple tree matching of pages with one seed; weights are kept by pairs of shapes."""

    def __init__(self, seed: Page):
        self.seed = seed
        self.own = Counter(element for element, _ in seed.blocks)
        self.known: dict[tuple[int, int], int] = {}

    def _children(self, page: Page, x: int, y: int, missing: list | None = None) -> list[tuple[int, int]] | None:
        """Matched children of x and y; None if weights are missing, which are then appended to `missing`."""
        seed = self.seed
        left, right = page.kids[x], seed.kids[y]
        lo, up = 0, 0
        trim = [(page.full, seed.full)]
        if len(left) * len(right) > 10_000:
            # Children of equal shape at either end match in some best matching; which texts meet does not matter then.
            trim.append((page.shape, seed.shape))
        for mine, its in trim:
            while lo < min(len(left), len(right)) - up and mine[left[lo]] == its[right[lo]]:
                lo += 1
            while up < min(len(left), len(right)) - lo and mine[left[-1 - up]] == its[right[-1 - up]]:
                up += 1
        pairs = list(zip(left[:lo], right[:lo]))
        if up:
            pairs += zip(left[-up:], right[-up:])
        left, right = left[lo : len(left) - up], right[lo : len(right) - up]
        if not left or not right:
            return pairs
        shapes_l = {page.shape[k]: k for k in left}
        shapes_r = {seed.shape[k]: k for k in right}
        weights = np.zeros((len(shapes_l), len(shapes_r)), np.int64)
        lacks = False
        for i, (sl, kl) in enumerate(shapes_l.items()):
            for j, (sr, kr) in enumerate(shapes_r.items()):
                if page.label[kl] != seed.label[kr]:
                    continue
                w = page.size[kl] if sl == sr else self.known.get((sl, sr))
                if w is None:
                    lacks = True
                    if missing is not None:
                        missing.append((kl, kr))
                else:
                    weights[i, j] = 2 * w
        if lacks:
            return None
        places_l = {s: i for i, s in enumerate(shapes_l)}
        places_r = {s: i for i, s in enumerate(shapes_r)}
        column = np.array([places_r[seed.shape[k]] for k in right])
        full = np.array([seed.full[k] for k in right])
        # Equal texts decide between matchings of equal size.
        row = lambda i: weights[places_l[page.shape[left[i]]]][column] + (full == page.full[left[i]])
        return pairs + [(left[i], right[j]) for i, j in _in_order(row, len(left), len(right))]

    def weight(self, page: Page, x: int, y: int) -> int:
        """The most pairs of equal tags below and with x and y, in order."""
        seed = self.seed
        if page.label[x] != seed.label[y]:
            return 0
        work = [(x, y)]
        while work:
            a, b = work[-1]
            key = (page.shape[a], seed.shape[b])
            if key[0] == key[1] or key in self.known:
                work.pop()
                continue
            missing: list[tuple[int, int]] = []
            pairs = self._children(page, a, b, missing)
            if pairs is None:
                work += missing
                continue
            at = lambda p, q: page.size[p] if page.shape[p] == seed.shape[q] else self.known.get((page.shape[p], seed.shape[q]), 0)
            self.known[key] = 1 + sum(at(p, q) for p, q in pairs)
            work.pop()
        return page.size[x] if page.shape[x] == seed.shape[y] else self.known[page.shape[x], seed.shape[y]]

    def align(self, page: Page) -> list[int]:
        """For each element of the page the seed's element that it matches, or -1."""
        if len(self.known) > 200_000:
            self.known.clear()
        to = [-1] * len(page.label)
        self.weight(page, 0, 0)
        work = [(0, 0)]
        while work:
            x, y = work.pop()
            if page.shape[x] == self.seed.shape[y] and page.full[x] == self.seed.full[y]:
                to[x : x + page.size[x]] = range(y, y + page.size[x])
                continue
            to[x] = y
            for p, q in self._children(page, x, y) or ():
                if page.label[p] == self.seed.label[q]:
                    self.weight(page, p, q)
                    work.append((p, q))
        return to


# ---------------------------------------------------------------- pages beside their seeds


def placed_blocks(page: Page, matchers: list[Matcher]) -> tuple[int, list[tuple[int, int, bool, int, bool, bool, str]]]:
    """The seed that fits best (-1: none) and each text block as (v, j, extra, d, plain, heading, text).

    v is the seed's element that holds the block or, if `extra`, the nearest one
    around it; j counts the blocks of that element, and is -1, `extra` as well,
    beyond as many as the seed's has; d is the element that names
    mark around it (-1: none, -2: one that the seed lacks); `plain` tells that
    the block is in the page's own main element.
    """
    best, to = -1, []
    fit = -1.0
    for i, matcher in enumerate(matchers):
        found = matcher.align(page)
        share = sum(v >= 0 for v in found) / (len(found) + len(matcher.seed.label))
        if share > fit:
            best, to, fit = i, found, share
    main = page.main_element()
    end = main + page.size[main]
    out, seen = [], Counter()
    for element, text in page.blocks:
        named = page.named[element]
        v = element
        if to:
            while to[v] < 0:
                v = page.parent[v]
        j = seen[element]
        seen[element] += 1
        extra = v != element
        if extra:
            j = 0
        elif best >= 0 and j >= matchers[best].own[to[v]]:
            extra, j = True, -1
        d = -1 if named < 0 else (to[named] if to and to[named] >= 0 else -2)
        out.append((to[v] if to else 0, j, extra, d, named < 0 and main <= element < end, page.heading[element], text))
    return best, out


def main_text(page: str | None) -> str:
    """The main text of one page by itself, without a wrapper."""
    return "\n".join(text for *_, plain, _, text in placed_blocks(outline(page), [])[1] if plain)


# ---------------------------------------------------------------- wrappers


def wrapper_of(seed: Page, pages: int, nodes: list[tuple[int, int, bool, int, int, int, int]]) -> tuple | None:
    """(lo, hi, around, template, head) from the counts over `pages` different pages.

    A node is (v, j, extra, mass, most, key, length): characters over all pages,
    and on how many pages the commonest text stands, its key and its length.
    [lo, hi) are the region's elements, `around` those that hold it, `template`
    the (v, j, key) of constant blocks, and `head` tells that headings before the
    region belong to it.
    """
    if pages < LEAST_PAGES:
        return None
    need = max(LEAST_PAGES, SAME_SHARE * pages)
    slots, same, extras = ([0.0] * len(seed.label) for _ in range(3))
    template = []
    for v, j, extra, mass, most, key, length in nodes:
        if not extra and most >= need:
            template.append((v, j, key))
            same[v] += most * length
            mass -= most * length
        slots[v] += mass
        extras[v] += mass if extra and not j else 0
    inside = [False] * len(seed.label)
    for e in range(len(seed.label)):
        inside[e] = seed.is_main[e] or (e > 0 and inside[seed.parent[e]])
    weights = [(MAIN_WEIGHT if m else 1.0) * (NAMED_WEIGHT if d >= 0 else 1.0) for m, d in zip(inside, seed.named)]
    total = seed.sums([s * w for s, w in zip(slots, weights)])
    if not total[0]:
        return None
    v, around = 0, [0]
    while not seed.is_main[v]:
        wide = [k for k in seed.kids[v] if seed.kids[k] or extras[k]]
        top = max(wide, key=total.__getitem__, default=None)
        if top is None or total[top] < DOMINANT * total[v]:
            break
        v = top
        around.append(v)
    end = v + seed.size[v]
    own = [0.0 if seed.named[e] >= 0 and seed.named[e] not in around else 1.0 for e in range(v, end)]
    constant = sum(s * w for s, w in zip(same[v:end], own))
    varied = sum(s * w for s, w in zip(slots[v:end], own))
    if constant > varied:
        template = [t for t in template if not v <= t[0] < end]
    return v, end, around, template, not (inside[v] or any(seed.heading[v:end]))


# ---------------------------------------------------------------- stages


def host_of(url: str):
    """The host of a URL column in lower case, empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


_SKELETON = re.compile(r"<((?:article|main|div|section|aside|header|form|table)\b[^>]*)>", re.I)


def skeleton(page: str) -> int:
    """Stands for the different opening tags of a page's containers, digits left out."""
    tags = sorted({re.sub(r"\d+", "", t) for t in _SKELETON.findall(page)})
    return xxhash.xxh3_64_intdigest("\n".join(tags)) - (1 << 63)


def _seeds(source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(`host`, `n`) of all hosts, and for hosts of enough pages `host` and `seeds`, pages of its commonest skeletons."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list] = {}
        held = 0

        def flush() -> pa.RecordBatch:
            rows = [(host, kind, n, order, page) for (host, kind), (n, order, page) in found.items()]
            found.clear()
            types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, types)], ["host", "kind", "n", "order", "html"]
            )

        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                order = xxhash.xxh3_64_intdigest(page) - (1 << 63)
                kept = found.setdefault((host, skeleton(page)), [0, 1 << 62, ""])
                kept[0] += 1
                if order < kept[1] or not kept[2]:
                    held += len(page) - len(kept[2])
                    kept[1:] = order, page
                if held > HELD_BYTES:
                    yield flush()
                    held = 0
        yield flush()

    some = source.where("host <> ''").select("host", "html").mapInArrow(count, "host string, kind long, n long, order long, html string")
    kinds = some.groupBy("host", "kind").agg(F.sum("n").alias("n"), F.min_by("html", "order").alias("html"))
    kinds = materialise(kinds, "skeletons")
    hosts = materialise(kinds.groupBy("host").agg(F.sum("n").alias("n")), "hosts")
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), "kind"))
    top = kinds.withColumn("rank", rank).where(F.col("rank") <= SEEDS)
    seeds = top.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("rank", "html"))).alias("s"))
    seeds = seeds.join(hosts.where(F.col("n") >= LEAST_PAGES).select("host").hint("merge"), "host", "left_semi")
    return hosts, materialise(seeds.select("host", F.col("s.html").alias("seeds")), "seeds")


_BLOCKS = "array<struct<v: int, j: int, extra: boolean, d: int, plain: boolean, heading: boolean, t: string>>"
_BLOCK_TYPES = (pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.bool_(), pa.bool_(), pa.string())
_BLOCK_NAMES = ("v", "j", "extra", "d", "plain", "heading", "t")


def _aligned(source: DataFrame, hosts: DataFrame, seeds: DataFrame) -> DataFrame:
    """`id`, `url`, `host`, the seed's number, a key of the page's longest block, and its placed blocks."""
    spark = source.sparkSession
    kind = source.schema["id"].dataType.simpleString()
    size = seeds.agg(F.sum(F.expr("aggregate(seeds, 0L, (a, x) -> a + octet_length(x))"))).first()[0] or 0
    if size <= SEED_BYTES:
        shared = spark.sparkContext.broadcast({r["host"]: r["seeds"] for r in seeds.collect()})
        rows = source.withColumn("seeds", F.lit(None).cast("array<string>"))
    else:
        shared = spark.sparkContext.broadcast({})
        rows = behind_leaders(source, seeds, hosts, "host", PAGES_PER_KEY, F.monotonically_increasing_id())

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[Matcher]] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                id_type = batch.schema.field(0).type
                out: list[list] = [[] for _ in range(5)]
                blocks: list[list] = [[] for _ in _BLOCK_NAMES]
                offsets = [0]
                for page_id, url, host, page, given in zip(*(batch.column(i).to_pylist() for i in range(5))):
                    if given is not None:
                        known = {host: [Matcher(outline(x)) for x in given]}
                        continue
                    if host not in known and host in shared.value:
                        if len(known) >= 100:
                            known.clear()
                        known[host] = [Matcher(outline(x)) for x in shared.value[host]]
                    seed, found = placed_blocks(outline(page), known.get(host, []))
                    longest = max((b[-1] for b in found), key=len, default="")
                    for column, value in zip(out, (page_id, url, host, seed, xxhash.xxh3_64_intdigest(longest) - (1 << 63))):
                        column.append(value)
                    for block in found:
                        for column, value in zip(blocks, block):
                            column.append(value)
                    offsets.append(len(blocks[0]))
                items = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(blocks, _BLOCK_TYPES)], _BLOCK_NAMES)
                types = (id_type, pa.string(), pa.string(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, t) for c, t in zip(out, types)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)],
                    ["id", "url", "host", "seed", "longest", "blocks"],
                )

    placed = rows.select("id", "url", "host", "html", "seeds").mapInArrow(
        align, f"id {kind}, url string, host string, seed int, longest long, blocks {_BLOCKS}"
    )
    return materialise(placed, "placed")


def _wrappers(placed: DataFrame, seeds: DataFrame) -> DataFrame:
    """`key` (host and seed), `n` pages, and the wrapper's region, surroundings, template and head."""
    key = F.concat_ws(" ", "seed", "host").alias("key")
    pages = placed.where("seed >= 0")
    counted = pages.groupBy(key, "longest").agg(F.count(F.lit(1)).alias("n")).groupBy("key")
    counted = materialise(counted.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("different")), "counted")
    rows = pages.select(key, "longest", F.explode("blocks").alias("b"))
    seen = rows.groupBy("key", "b.v", "b.j", "b.extra", F.xxhash64("b.t").alias("k"), "longest").agg(F.max(F.length("b.t")).alias("length"))
    texts = seen.groupBy("key", "v", "j", "extra", "k").agg(F.count(F.lit(1)).alias("c"), F.max("length").alias("length"))
    nodes = texts.groupBy("key", "v", "j", "extra").agg(
        F.sum(F.col("c") * F.col("length")).alias("mass"), F.max(F.struct("c", "k", "length")).alias("top")
    )
    # As many nodes as the seed has blocks, at most.
    node = F.struct("v", "j", "extra", "mass", F.col("top.c").alias("c"), F.col("top.k").alias("k"), F.col("top.length").alias("length"))
    listed = nodes.groupBy("key").agg(F.collect_list(node).alias("nodes"))
    each = seeds.select("host", F.posexplode("seeds").alias("seed", "html")).select(key, "html")
    ready = each.join(listed, "key").join(counted, "key").select("key", "n", "different", "html", "nodes")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, n, different, page, found in zip(*(batch.column(i).to_pylist() for i in range(5))):
                wrapper = wrapper_of(outline(page), different, [tuple(x.values()) for x in found])
                if wrapper:
                    lo, hi, around, template, head = wrapper
                    rows.append((name, n, lo, hi, around, [{"v": v, "j": j, "k": k} for v, j, k in template], head))
            types = (
                pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()),
                pa.list_(pa.struct([("v", pa.int32()), ("j", pa.int32()), ("k", pa.int64())])), pa.bool_(),
            )
            names = ["key", "n", "lo", "hi", "around", "template", "head"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 7, types)], names)

    schema = "key string, n long, lo int, hi int, around array<int>, template array<struct<v: int, j: int, k: long>>, head boolean"
    return materialise(ready.mapInArrow(learn, schema), "wrappers")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: its main text and the length of it in code points."""
    source = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(url_col).alias("host"), text_of(html_col).alias("html")
    )
    hosts, seeds = _seeds(source)
    placed = _aligned(source, hosts, seeds)
    wrapped = placed.withColumn("key", F.concat_ws(" ", "seed", "host"))
    learned = _wrappers(placed, seeds)
    size = learned.agg(F.sum(100 + 2 * F.length("key") + 16 * F.size("template") + 4 * F.size("around"))).first()[0] or 0
    if size <= SEED_BYTES:
        joined = wrapped.join(F.broadcast(learned.drop("n")), "key", "left")
    else:
        joined = spread_join(wrapped, learned, "key", PAGES_PER_KEY)
    constant = lambda b: F.exists(
        "template", lambda t: ~b["extra"] & (t["v"] == b["v"]) & (t["j"] == b["j"]) & (t["k"] == F.xxhash64(b["t"]))
    )
    open_ = lambda b: ((b["d"] == -1) | F.array_contains("around", b["d"])) & ~constant(b)
    inside = F.filter("blocks", lambda b: (b["v"] >= F.col("lo")) & (b["v"] < F.col("hi")) & open_(b))
    before = F.filter("blocks", lambda b: F.col("head") & b["heading"] & (b["v"] < F.col("lo")) & open_(b))
    chosen = joined.select("id", "url", "blocks", inside.alias("inside"), before.alias("before"))
    kept = F.when(F.size("inside") > 0, F.concat("before", "inside")).otherwise(F.filter("blocks", lambda b: b["plain"]))
    texts = chosen.select("id", "url", F.array_join(F.transform(kept, lambda b: b["t"]), "\n").alias("text"))
    return texts.select(F.col("id").alias(id_col), "url", "text", F.length("text").cast("long").alias("n_chars"))
