"""HTML extraction by wrapper induction: same-host pages aligned by simple tree matching.

Pages of a host meet in cells of bounded size. Pages of a cell are aligned with the reference page that
they resemble; the aligned trees are the wrapper. A slot whose texts recur from page to page is
template, a slot whose texts vary is content, and the content region is the deepest aligned element
that holds the varying text. Landmarks and the usual names of page furniture are the tie-break: they
decide for pages without partners, and which varying slots of the region are furniture.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm._spark import attach, materialize

#: Bounds of a cell of same-host pages.
CELL_PAGES, CELL_BYTES = 128, 8_000_000
#: A table of split hosts with more rows than this is joined by a shuffle instead of being sent to all tasks.
SENT_HOSTS = 500_000
#: References of a cell, and the share of the smaller tree that must align with one of them.
REFERENCES, ALIKE = 4, 0.6
#: Cells of alignment tables per page; beyond them child lists are aligned in linear time.
TABLE_CELLS = 40_000
#: Pages that decide a slot, the share of them on which a template's text recurs, and what a region may leave behind.
LEAST_PAGES, RECURS, LEFT_BEHIND = 3, 0.8, 0.05

#: Element names by their part in a page, as in the HTML standard.
BLOCKS = frozenset(
    "html body div section article main nav header footer aside p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr"
    " td th blockquote pre figure figcaption form fieldset address hr details summary center menu dialog hgroup search".split()
)
RAW = frozenset("script style noscript template textarea iframe svg title select object canvas video audio button".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = HEADINGS | frozenset("p li blockquote pre dt dd td th figcaption caption".split())
FURNITURE = frozenset("nav footer aside form menu dialog search fieldset".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())
FURNITURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices"
    " alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead topbar share sharing social"
    " related recommended recommendations comment comments reply replies respond disqus subscribe subscription newsletter signup login search"
    " searchbox pagination pager toolbar widget skip copyright".split()
)
#: Furniture words that articles use for parts of their own.
EITHER_WAY = frozenset("header footer masthead banner notice notices alert menu widget copyright".split())
#: Elements whose own text is prose.
PROSE = PARAGRAPHS | frozenset("section article main header".split())
#: Words of layout that say nothing by themselves; a name of these and furniture words is furniture.
LAYOUT_NAMES = frozenset(
    "site page main global top bottom left right upper lower inner outer box block list item items bar area section container wrapper wrap"
    " group panel row col column link links button buttons btn icons icon form message text content body head primary secondary post posts"
    " article articles user reader the and of to us a js 1 2 3".split()
)
CLOSES_P = BLOCKS - {"html", "body"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = frozenset("ul ol dl table body article section main".split())
_ENDING = SCOPES | frozenset(CLOSED_BY)

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*(?:"[^"]*"|'[^']*')|=)*+)>""", re.S)
_BROKEN = re.compile(r"<!--.*\Z|<[/a-zA-Z!?][^<>]*\Z", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")


class Node:
    """A block element; children are nodes and text slots.

    `furniture`: not article text; `maybe`: named so inside a landmark by words that articles use too.
    `kind` tells elements and slots apart, `leaf` is the text of an element with one slot and nothing
    else, `weight` what it adds when all of it matches, `ref` the number of the reference element that it aligns with.
    """

    __slots__ = ("tag", "kind", "children", "furniture", "maybe", "size", "weight", "print", "leaf", "ref")

    def __init__(self, tag: str, furniture: bool = False, maybe: bool = False) -> None:
        self.tag, self.kind, self.children, self.furniture, self.maybe, self.size = tag, tag, [], furniture, maybe, 1
        self.weight, self.print, self.leaf, self.ref = 1, 0, None, -1


class Slot:
    """A run of text between block boundaries; linked: how much of it stands in links. `ref` as in Node."""

    __slots__ = ("parts", "linked", "text", "ref")
    kind, size, weight = "#", 1, 2

    def __init__(self) -> None:
        self.parts, self.linked, self.text, self.ref = [], 0, "", -1

    @property
    def print(self) -> str:
        return self.text


def _named(value: str, names: frozenset) -> bool:
    """Whether a class or id is made of furniture and layout words alone, `names` among them."""
    for word in value.split():
        parts = [p for p in re.split(r"[-_]+", word) if p]
        if any(p in names for p in parts) and all(p in FURNITURE_NAMES or p in LAYOUT_NAMES for p in parts):
            return True
    return False


def _is_furniture(tag: str, attributes: str, inside: bool) -> bool | None:
    """None: inside a landmark, named so by words of EITHER_WAY alone."""
    if tag in FURNITURE or (tag == "header" and not inside):
        return True
    if not attributes:
        return False
    maybe = False
    for name, *values in _ATTR.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "role" and value in FURNITURE_ROLES:
            return True
        if name == "class" or (name == "id" and tag not in HEADINGS):
            if _named(value, FURNITURE_NAMES - EITHER_WAY if inside else FURNITURE_NAMES):
                return True
            maybe |= inside and _named(value, EITHER_WAY)
        if (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            return True
    return True if re.search(r"(?:^|\s)hidden(?:\s|$)", attributes) else None if maybe else False


def parse(page: str) -> tuple[Node, bool]:
    """Block tree of the whole page, and whether it has an article or main landmark.

    A script, style, textarea or title that is never closed takes the rest of the page, as in
    browsers; any other unclosed element without text of its own loses its tag only.
    """
    root = Node("html")
    stack, slot, links, landmark, at = [root], None, 0, False, 0
    in_head, inside, open_tags, unclosed = False, 0, Counter(), set()
    ending: list[int] = []  # places in the stack of elements that a new li, td, ... may close or stop at

    def text(raw: str) -> None:
        nonlocal slot
        if in_head or (slot is None and not raw.strip()):
            return
        if slot is None:
            slot = Slot()
            stack[-1].children.append(slot)
        slot.parts.append(raw)
        if links:
            slot.linked += len(raw)

    def leave(upto: int) -> None:
        nonlocal inside
        for node in stack[upto:]:
            open_tags[node.tag] -= 1
            inside -= node.tag in ("article", "main")
        del stack[upto:]
        while ending and ending[-1] >= upto:
            ending.pop()

    closed = page.rfind(">") + 1  # no tag ends beyond this
    while at < len(page):
        m = _TAG.search(page, at, closed) if at < closed else None
        text(page[at : m.start()] if m else _BROKEN.sub("", page[at:]))
        if not m:
            break
        at = m.end() if not m[0].startswith("<!--") or m[0].endswith("-->") else len(page)
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag == "head":
            in_head = not m[1]
        elif m[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCKS:
                slot = None
                if open_tags[tag]:
                    leave(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
        elif tag in RAW:
            if not m[3].endswith("/") and tag not in unclosed:
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                if close:
                    at = close.end()
                elif tag in ("script", "style", "textarea", "title"):
                    at = len(page)
                else:
                    unclosed.add(tag)
        elif tag == "a":
            links += 1
        elif tag == "br":
            text(" ")
        elif tag in ("html", "body"):
            in_head = False
        elif tag in BLOCKS:
            in_head, slot = False, None
            if tag in CLOSES_P and stack[-1].tag == "p":
                leave(len(stack) - 1)
            while tag in CLOSED_BY and ending and stack[ending[-1]].tag in CLOSED_BY[tag]:
                leave(ending[-1])
            if tag == "hr":
                continue
            kind = _is_furniture(tag, m[3], inside > 0)
            node = Node(tag, bool(kind), kind is None)
            landmark |= tag in ("article", "main") and not node.furniture
            stack[-1].children.append(node)
            if tag in _ENDING:
                ending.append(len(stack))
            stack.append(node)
            open_tags[tag] += 1
            inside += tag in ("article", "main")
    _finish(root)
    return root, landmark


def _finish(root: Node) -> None:
    """Clean the slots' texts, drop empty slots and nodes, and give each subtree its size and a hash."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if isinstance(c, Node)]
    for node in reversed(order):
        kept = []
        for c in node.children:
            if isinstance(c, Slot):
                raw = "".join(c.parts)
                c.text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
                c.linked, c.parts = c.linked / max(1, len(raw)), ()
                if c.text:
                    kept.append(c)
            elif c.children:
                kept.append(c)
        node.children = kept
        node.size, node.weight = 1 + sum(c.size for c in kept), 1 + sum(c.weight for c in kept)
        node.print = hash((node.tag, *[c.print for c in kept]))
        node.leaf = kept[0].text if len(kept) == 1 and isinstance(kept[0], Slot) else None


def _same(a: Node | Slot, b: Node | Slot) -> bool:
    """Equal subtrees, by hash."""
    return a.kind == b.kind and a.print == b.print


def _in_step(x: list, y: list) -> list[tuple]:
    """A linear alignment of two long child lists: each child with the next one of its kind, equal ones first."""
    where = defaultdict(list)
    for j, c in enumerate(y):
        where[c.kind, c.print].append(j)
    once, pairs, last, at = {}, [], -1, 0
    for i, c in enumerate(x):
        spots = where.get((c.kind, c.print), ())
        if len(spots) == 1 and spots[0] > last:
            once[i] = last = spots[0]
    stops = sorted(once.items()) + [(len(x), len(y))]
    i = j = 0
    for stop_i, stop_j in stops:
        spots = defaultdict(list)
        for k in range(stop_j - 1, j - 1, -1):
            spots[y[k].kind].append(k)
        at = j
        while i < stop_i:
            queue = spots.get(x[i].kind, [])
            while queue and queue[-1] < at:
                queue.pop()
            if queue:
                at = queue.pop()
                pairs.append((x[i], y[at]))
                at += 1
            i += 1
        if stop_i < len(x):
            pairs.append((x[stop_i], y[stop_j]))
        i, j = stop_i + 1, stop_j + 1
    return pairs


def _worth(c: Node | Slot, d: Node | Slot, score: dict[tuple[int, int], int]) -> int:
    """Matched nodes of two children of one kind."""
    if c.kind == "#":
        return 1 + (c.text == d.text)
    if c.leaf is not None and d.leaf is not None:
        return 2 + (c.leaf == d.leaf)
    return score[id(c), id(d)]


def tree_match(a: Node, b: Node, cells: int = TABLE_CELLS) -> tuple[int, list[tuple]]:
    """Simple tree matching: the most nodes aligned in order under equal parents; (matched nodes, aligned pairs).

    An alignment table over the children of every pair of elements of one kind and depth, filled from
    the leaves up without recursion; equal texts count twice. Equal children at both ends of two lists
    are aligned beforehand, which loses nothing. Lists whose tables would exceed `cells` in all are
    aligned in linear time instead.
    """
    if a.tag != b.tag:
        return 0, []
    order: list[tuple] = []  # (a, b, head pairs, x, y, tail pairs, table?) with parents before children
    todo, left = [(a, b)], cells
    while todo:
        p, q = todo.pop()
        x, y = p.children, q.children
        lo, hi = 0, 0
        while lo < min(len(x), len(y)) and _same(x[lo], y[lo]):
            lo += 1
        while hi < min(len(x), len(y)) - lo and _same(x[-1 - hi], y[-1 - hi]):
            hi += 1
        ends = list(zip(x[:lo], y[:lo])) + (list(zip(x[-hi:], y[-hi:])) if hi else [])
        x, y = x[lo : len(x) - hi], y[lo : len(y) - hi]
        table = len(x) * len(y) <= left
        if table:
            left -= len(x) * len(y)
            inner = [(c, d) for c in x if c.kind != "#" for d in y if c.kind == d.kind]
        else:
            inner = _in_step(x, y)
        order.append((p, q, ends, x, y, table))
        todo += [(c, d) for c, d in inner if c.kind != "#" and (c.leaf is None or d.leaf is None)]
    score: dict[tuple[int, int], int] = {}
    chosen: dict[tuple[int, int], list[tuple]] = {}
    for p, q, ends, x, y, table in reversed(order):
        total = 1 + sum(c.weight for c, _ in ends)
        if not table:
            pairs = _in_step(x, y)
            total += sum(_worth(c, d, score) for c, d in pairs)
        else:
            n, m, pairs = len(x), len(y), []
            best = [[0] * (m + 1)]
            for c in x:
                above, row, kind, left_of = best[-1], [0], c.kind, 0
                for j, d in enumerate(y):
                    top = above[j + 1]
                    if top < left_of:
                        top = left_of
                    if kind == d.kind:
                        w = above[j] + _worth(c, d, score)
                        if w > top:
                            top = w
                    row.append(top)
                    left_of = top
                best.append(row)
            total += best[n][m]
            i, j = n, m
            while i and j:
                if best[i][j] == best[i - 1][j]:
                    i -= 1
                elif best[i][j] == best[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    pairs.append((x[i], y[j]))
        score[id(p), id(q)] = total
        chosen[id(p), id(q)] = ends + pairs
    matched, todo = [(a, b)], [(a, b)]
    while todo:
        p, q = todo.pop()
        pairs = chosen.get((id(p), id(q)))
        if pairs is None:  # equal subtrees
            pairs = list(zip(p.children, q.children))
        matched += pairs
        todo += [(c, d) for c, d in pairs if isinstance(c, Node)]
    return score[id(a), id(b)], matched


def _walk(root: Node, region: int = -2):
    """(slot, tag of its element, in furniture, in a landmark, in the region, nearest aligned element) of every slot in page order."""
    todo: list[tuple] = [(root, "", False, False, False, False, -1)]
    while todo:
        node, block, furniture, maybe, marked, inside, home = todo.pop()
        if node.kind == "#":
            yield node, block, furniture or maybe and (block not in PROSE or node.linked >= 0.8), marked, inside, home
            continue
        below = (node.tag, furniture or node.furniture, maybe or node.maybe, marked or node.tag in ("article", "main"), inside or node.ref == region, node.ref if node.ref >= 0 else home)
        todo += [(c, *below) for c in reversed(node.children)]


def _article(root: Node) -> str:
    """The text of a page's landmarks: equal ones make two pages copies of one article."""
    return "\n".join(slot.text for slot, _, furniture, marked, *_ in _walk(root) if marked and not furniture)


class Wrapper:
    """Pages aligned with a reference page: which slots are template, and which element is the content region."""

    def __init__(self, reference: Node) -> None:
        self.reference, self.pages = reference, [reference]
        self.elements: list[Node] = []
        todo, n_slots = [reference], 0
        while todo:
            node = todo.pop()
            node.ref = len(self.elements)
            self.elements.append(node)
            for c in node.children:
                if isinstance(c, Slot):
                    c.ref = n_slots
                    n_slots += 1
                else:
                    todo.append(c)
        self.template: set[int] = set()
        self.region = -1

    def add(self, page: Node, pairs: list[tuple]) -> None:
        for mine, theirs in pairs:
            mine.ref = theirs.ref
        self.pages.append(page)

    def induce(self) -> None:
        """Needs LEAST_PAGES pages with different articles; copies of an article count as one page."""
        first = {}
        for page in self.pages:
            first.setdefault(_article(page) or id(page), page)
        pages = list(first.values())
        if len(pages) < LEAST_PAGES:
            return
        texts: dict[int, Counter] = defaultdict(Counter)
        for page in pages:
            for slot, *_ in _walk(page):
                if slot.ref >= 0:
                    texts[slot.ref][slot.text] += 1
        for ref, found in texts.items():
            n = sum(found.values())
            if n >= LEAST_PAGES and sum(k for k in found.values() if k > 1) >= RECURS * n:
                self.template.add(ref)
        self.region = self._find_region(pages)

    def _find_region(self, pages: list[Node]) -> int:
        """The deepest element that leaves behind only template, furniture, links and a little stray text.

        An element is not left for a child if a varying heading or paragraph would stay behind, and
        never left below a landmark.
        """
        own, kept = Counter(), set()  # varying text by its nearest aligned element; elements that hold a paragraph of it
        for page in pages:
            for slot, block, furniture, _, _, home in _walk(page):
                if furniture or slot.ref in self.template or slot.linked >= 0.8:
                    continue
                own[home] += len(slot.text)
                if block in PARAGRAPHS:
                    kept.add(home)
        mass, holds = Counter(own), Counter({e: 1 for e in kept})
        for node in reversed(self.elements):
            for c in node.children:
                if isinstance(c, Node):
                    mass[node.ref] += mass[c.ref]
                    holds[node.ref] += holds[c.ref]
        node = self.reference
        while node.tag not in ("article", "main"):
            children = [c for c in node.children if isinstance(c, Node)]
            best = max(children, key=lambda c: mass[c.ref], default=None)
            if best is None or not mass[best.ref] or mass[best.ref] < (1 - LEFT_BEHIND) * mass[self.reference.ref] or holds[best.ref] < holds[node.ref]:
                break
            node = best
        return node.ref if mass[node.ref] else -1


def induce(trees: list[Node]) -> list[Wrapper]:
    """Align every page with the first reference that it resembles; the first pages unlike all others become references."""
    wrappers: list[Wrapper] = []
    for tree in trees:
        best = (0.0, [], None)
        for w in wrappers:
            score, pairs = tree_match(tree, w.reference)
            share = score / min(tree.size, w.reference.size)
            best = (share, pairs, w) if share > best[0] else best
            if share >= ALIKE:
                break
        if best[2] and (len(wrappers) == REFERENCES or best[0] >= ALIKE):
            best[2].add(tree, best[1])
        else:
            wrappers.append(Wrapper(tree))
    for w in wrappers:
        w.induce()
    return wrappers


def main_text(root: Node, landmark: bool, wrapper: Wrapper | None = None) -> str:
    """Blocks of the article in page order.

    With a wrapper of enough pages: the varying slots of its content region, less furniture. A heading
    that recurs stays if its section varies. Without one: what stands in an article or main element,
    on pages without either every block that is not mostly links, in both cases less furniture.
    """
    induced = wrapper is not None and wrapper.region >= 0
    if induced:
        induced = any(node.ref == wrapper.region for node in _elements(root))
    blocks, headings = [], []
    for slot, block, furniture, marked, inside, _ in _walk(root, wrapper.region if induced else -2):
        if induced:
            open_ = inside and (marked or slot.linked < 0.8)
        else:
            open_ = marked if landmark else slot.linked < 0.8
        if not open_ or furniture:
            continue
        if induced and slot.ref in wrapper.template:
            headings = [*headings, slot.text] if block in HEADINGS else []
            continue
        blocks += headings if block not in HEADINGS else []
        headings = []
        blocks.append(slot.text)
    return "\n\n".join(blocks)


def _elements(root: Node):
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo += [c for c in node.children if isinstance(c, Node)]


def extract_cell(pdf: pd.DataFrame) -> pd.DataFrame:
    """page_id, url, text and n_chars of same-host pages (page_id, url, html); equal pages are one page to the induction."""
    pdf = pdf.sort_values("page_id", kind="stable", na_position="last").reset_index(drop=True)
    pages = [page if isinstance(page, str) else "" for page in pdf["html"]]
    parsed = {page: parse(page) for page in dict.fromkeys(pages)}
    some = [tree for tree, _ in parsed.values() if tree.children]
    wrappers = {id(tree): w for w in induce(some) for tree in w.pages} if len(some) >= LEAST_PAGES else {}
    done = {page: main_text(tree, landmark, wrappers.get(id(tree))) for page, (tree, landmark) in parsed.items()}
    texts = [done[p] for p in pages]
    return pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row.

    Null and empty pages have an empty text; very long pages are parsed whole, with long lists aligned in
    linear time; repeated rows and ids keep their rows; an empty table gives an empty result; other columns are not read, whatever their names. The html is shuffled
    once, by host and cell. Every host is cut into cells of about CELL_PAGES pages and CELL_BYTES
    bytes by a hash of the page, at any size of the table. Pages without a host share one.
    """
    attach(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1))
    hosted = pages.select("page_id", "url", "html", host.alias("_host"))
    sizes = hosted.groupBy("_host").agg(F.count("*").alias("n"), F.sum(F.octet_length("html")).alias("bytes"))
    cells = F.greatest(F.ceil(F.col("n") / CELL_PAGES), F.ceil(F.coalesce("bytes", F.lit(0)) / CELL_BYTES))
    split = materialize(sizes.select("_host", cells.cast("long").alias("_cells")).where("_cells > 1"), "split-hosts")
    split = F.broadcast(split) if split.count() <= SENT_HOSTS else split
    cell = F.pmod(F.xxhash64("page_id", "url", F.octet_length("html")), F.coalesce("_cells", F.lit(1)))
    parts = hosted.join(split, "_host", "left").select("_host", cell.alias("_cell"), "page_id", "url", "html")
    return parts.groupBy("_host", "_cell").applyInPandas(lambda pdf: extract_cell(pdf[["page_id", "url", "html"]]), "page_id long, url string, text string, n_chars long")
