"""HTML extraction by composite text density.

A tolerant parser builds the page's tree. For each node, C is its characters, T its tags, LC and LT the characters and tags of
its links, and NLC = C - LC; lc and c are those of the body. Its density is C/T * log_b(C/LC * T/LT) with the base
b = ln(C/NLC * LC + lc/c * C + e); zero denominators count as 1. A node's density sum adds its children's densities (its own
text counts as a child). The subtree of the largest sum is the core; the threshold is the least density on the path to it
from the body. An article element around the core (else a main) is taken whole. Without one, what stands beside the path is
taken if its density holds the threshold, if it is a heading, or if it is a paragraph, list or table beside the core. Lists of
links stay within the article or core, and go beside it.

What never counts: elements that are no article by tag or role, and hidden ones. Names of classes and ids say less: a name
that speaks of something else within a longer one (has-sidebar, share-enabled) halves a density and drops nothing. An element
that is something else by name (sidebar, reader-comments), a form, or hidden from readers' aids goes only where free text (not in
links) elsewhere outweighs it: the largest such element counts as any other if it has more free text than all that stands outside
such elements (SIGNED times as much where that has a top heading, an article or a main, or where the element holds comments, which
outgrow articles), and so do all elements of its names; then those within it are judged in turn. What counts, density decides.

Time is linear in the page: open tags are found by their own stacks, whatever their nesting.

Defined results: null, empty and text-free pages give ''. Repeated rows give the same rows; rows are independent. Unclosed and
mis-nested tags close as browsers close them, about. Extra columns aren't carried.
"""

from __future__ import annotations

import heapq
import html
import itertools
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Fixed values of HTML: elements without content, with raw text, that break lines, and that end an open paragraph.
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCK - frozenset("body caption html legend optgroup option tbody td tfoot th thead tr".split())
#: An opening tag closes open ones of the first kind, up to one of the second.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = frozenset("p blockquote pre ul ol dl table figure hgroup".split()) | HEADINGS

# No article by tag or by role.
NO_TAG = frozenset("nav aside noscript template object svg canvas button select input dialog menu audio video applet footer".split())
NO_ROLE = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog menu menubar toolbar".split())
#: Words of names that speak of something else: as the last word of a name, and only as the whole name.
OTHER_LAST = frozenset(
    "ad ads advert adverts advertisement advertisements adsense banner sponsor sponsors sidebar navbar nav navigation menu breadcrumb breadcrumbs "
    "pagination footer masthead comment comments commentlist disqus replies cookie cookies consent popup modal newsletter subscribe signup related "
    "recommended recommendations widget widgets share sharing social promo toolbar".split()
)
OTHER_WHOLE = OTHER_LAST | frozenset("header notice notices alert legal disclaimer copyright login respond discussion overlay sponsored promotion subscription topbar pager toc gdpr advertising".split())
#: Words that say nothing about what an element is, and words before a name that turn its sense.
FILLER = frozenset("box block area section container wrapper wrap inner outer list item items left right top bottom primary secondary site page the bar links buttons form col column row panel posts articles stories".split())
TURNS = frozenset("has no not with without is show hide hidden enable enabled disable disabled".split())
#: A name of an article's own parts.
OWN = frozenset("article content story post entry main text body".split())
#: Words of names of what readers wrote, and by how many times such an element, or any beside a sign of an article, must outweigh the rest.
REPLIES = frozenset("comment comments commentlist disqus replies respond discussion".split())
SIGNED = 20

_TAG = re.compile(r"<(?:!--(?:.*?)(?:-->|\Z)|[!?][^>]*+>?|(?P<close>/)?(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z))", re.S)
_LOOSE = re.compile(r"<(?P<close>/)?(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>[^>]*+)>?")
_ATTR = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: What an element is by its attributes: nothing odd, a name that halves its density, a name that says it is something else, never an article.
FINE, WEIGHED, OTHER, NEVER = range(4)


class Node:
    __slots__ = ("tag", "kids", "parent", "block", "open_inline", "kind", "chars", "tags", "link_chars", "link_tags", "density", "total", "names")

    def __init__(self, tag: str, parent: "Node | None", kind: int = FINE, names: frozenset[str] = frozenset()):
        self.tag, self.parent, self.kind = tag, parent, kind
        #: The names that say it is something else.
        self.names = names
        #: The nearest node that breaks lines, itself included, and how many inline nodes of each tag are open right under it.
        self.block: Node = self if parent is None or tag in BLOCK else parent.block
        self.open_inline: dict[str, int] = {}
        self.kids: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def name_kind(value: str) -> tuple[int, set[str]]:
    """What a class or id attribute says, and its names that say so where that is something else."""
    kind, others = FINE, set()
    for name in value.split():
        words = [w.lower() for w in _WORDS.findall(name)]
        if not words:
            continue
        if name.lower() in OWN or len(words) > 1 and words[-1] in OWN and not OTHER_WHOLE & set(words):
            return FINE, set()
        if not OTHER_WHOLE & set(words):
            continue
        told = [w for w in words if w not in FILLER]
        if words[0] not in TURNS and (words[-1] in OTHER_LAST or told and all(w in OTHER_WHOLE for w in told)):
            kind = OTHER
            others.add(name.lower())
        kind = max(kind, WEIGHED)
    return kind, others


def _kind(tag: str, attrs: str, inside_article: bool) -> tuple[int, frozenset[str]]:
    if tag in NO_TAG or tag == "header" and not inside_article:
        return NEVER, frozenset()
    kind, names = (OTHER, {"form"}) if tag == "form" else (FINE, set())
    if not attrs or tag in ("html", "body"):
        return kind, frozenset(names)
    for m in _ATTR.finditer(attrs):
        name = m[1].lower()
        value = html.unescape(m[2] or m[3] or m[4] or "")
        if name == "hidden" or name == "role" and value.strip().lower() in NO_ROLE or name == "style" and _UNSEEN.search(value):
            return NEVER, frozenset()
        if name == "aria-hidden" and value == "true":
            kind = max(kind, OTHER)
            names.add(name)
        if name in ("class", "id") and tag not in ("main", "h1"):
            said, more = name_kind(value)
            kind = max(kind, said)
            names |= more
    return kind, frozenset(names)


class Parser:
    """Builds the tree; texts are decoded."""

    def __init__(self) -> None:
        self.root = self.node = Node("html", None)
        self.open_blocks: dict[str, list[Node]] = {}
        #: For each tag that implies ends: the open nodes of its two kinds, in order.
        self.scopes: dict[str, list[Node]] = {}
        self.articles = 0

    def _push(self, tag: str, kind: int, names: frozenset[str]) -> None:
        node = Node(tag, self.node, kind, names)
        self.node.kids.append(node)
        self.node = node
        if tag in BLOCK:
            self.open_blocks.setdefault(tag, []).append(node)
        else:
            mine = node.block.open_inline
            mine[tag] = mine.get(tag, 0) + 1
        for s in _SCOPES_OF.get(tag, ()):
            self.scopes.setdefault(s, []).append(node)
        self.articles += tag in ("article", "main")

    def _pop(self, last: Node) -> None:
        """Closes open nodes, up to and with last."""
        done = False
        while not done and self.node.parent is not None:
            node = self.node
            done = node is last
            if node.tag in BLOCK:
                self.open_blocks[node.tag].pop()
            else:
                node.block.open_inline[node.tag] -= 1
            for s in _SCOPES_OF.get(node.tag, ()):
                self.scopes[s].pop()
            self.articles -= node.tag in ("article", "main")
            self.node = node.parent

    def end(self, tag: str) -> None:
        if tag in BLOCK:
            if found := self.open_blocks.get(tag):
                self._pop(found[-1])
            elif tag == "p":
                self.node.kids.append(Node("p", self.node))
        elif self.node.block.open_inline.get(tag):  # an inline end tag doesn't close blocks
            up = self.node
            while up.tag != tag:
                up = up.parent
            self._pop(up)

    def start(self, tag: str, attrs: str) -> None:
        if tag in ("html", "body", "head"):
            return
        if tag in ENDS_P and self.node.block.tag == "p":
            self._pop(self.node.block)
        if tag in IMPLIED:
            held, last = self.scopes.get(_GROUP[tag], []), None
            for up in reversed(held):
                if up.tag not in IMPLIED[tag][0]:
                    break
                last = up
            if last is not None:
                self._pop(last)
        empty = tag in VOID or tag not in BLOCK and attrs.rstrip().endswith("/")
        if empty:
            self.node.kids.append(Node(tag, self.node, *_kind(tag, "", True)))
        else:
            self._push(tag, *_kind(tag, attrs, self.articles > 0))

    def feed(self, page: str) -> Node:
        at, n = 0, len(page)
        while at < n:
            lt = page.find("<", at)
            lt = n if lt < 0 else lt
            if lt > at:
                self.node.kids.append(html.unescape(page[at:lt]))
            if lt >= n:
                break
            m = _TAG.match(page, lt) or _LOOSE.match(page, lt)
            if m is None:  # a bare <
                self.node.kids.append("<")
                at = lt + 1
                continue
            at = m.end()
            if m["name"] is None:
                continue
            tag = m["name"].lower()
            if m["close"]:
                self.end(tag)
            elif tag in RAW:
                end = _RAW_END[tag].search(page, at)
                gt = page.find(">", end.start()) if end else -1
                at = gt + 1 if gt >= 0 else n
            else:
                self.start(tag, m["attrs"] or "")
        return self.root


_RAW_END = {tag: re.compile(f"</{tag}(?=[\\s/>]|\\Z)", re.I) for tag in RAW}
#: Tags that share the stack of open nodes which ends are implied on.
_GROUP = {"li": "li", "dd": "dl", "dt": "dl", "option": "option", "tr": "table", "td": "table", "th": "table"}
_SCOPES_OF: dict[str, set[str]] = {}
for _tag, _kinds in IMPLIED.items():
    for _name in _kinds[0] | _kinds[1]:
        _SCOPES_OF.setdefault(_name, set()).add(_GROUP[_tag])


def parse(page: str) -> Node:
    return Parser().feed(page)


def _postorder(root: Node) -> list[Node]:
    """Nodes that may count, children before parents; the reverse is document order, but for the order of siblings."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(k for k in node.kids if isinstance(k, Node) and k.kind != NEVER)
    return out[::-1]


def _count(order: list[Node]) -> None:
    """Sets characters and tags; nodes that never count are left out."""
    for node in order:
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        for k in node.kids:
            if isinstance(k, str):
                node.chars += len(k.strip())
            elif k.kind != NEVER:
                node.chars += k.chars
                node.tags += k.tags + 1
                node.link_chars += k.link_chars
                node.link_tags += k.link_tags + (k.tag == "a")
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags


def settle(root: Node) -> None:
    """Marks the elements that are something else as never counting where text elsewhere outweighs them; the others count."""
    _count(_postorder(root))
    free = lambda node: node.chars - node.link_chars
    named: dict[frozenset[str], list[Node]] = {}
    queue: list[tuple[int, int, Node]] = []
    order = itertools.count()
    outside, signs = free(root), 0

    def enter(node: Node) -> None:
        """Adds the outermost other elements under a node that counts, and takes them off what stands outside such elements."""
        nonlocal outside, signs
        stack = [node]
        while stack:
            k = stack.pop()
            if k is not node and k.kind == OTHER:
                named.setdefault(k.names, []).append(k)
                heapq.heappush(queue, (-free(k), next(order), k))
                outside -= free(k)
            elif k.kind != NEVER:
                signs += k.tag in ("h1", "main", "article") and k.chars > 0
                stack.extend(x for x in k.kids if isinstance(x, Node))

    def release(node: Node) -> None:
        nonlocal outside
        node.kind = WEIGHED
        outside += free(node)
        enter(node)

    enter(root)
    while queue:
        _, _, largest = queue[0]
        if largest.kind != OTHER:  # counts by now
            heapq.heappop(queue)
            continue
        times = SIGNED if signs or any(REPLIES & {w.lower() for w in _WORDS.findall(n)} for n in largest.names) else 1
        if not free(largest) or free(largest) <= times * outside:
            break
        names = largest.names
        while some := named.pop(names, None):
            for x in some:
                release(x)
    for some in named.values():
        for x in some:
            x.kind = NEVER


def measure(root: Node) -> None:
    """Sets the counts, densities and density sums of all nodes that count."""
    order = _postorder(root)
    _count(order)
    ratio = root.link_chars / root.chars if root.chars else 0.0
    for node in order:
        node.density = density(node.chars, node.tags, node.link_chars, node.link_tags, ratio) / (2 if node.kind == WEIGHED else 1)
    for node in order:
        node.total = sum(len(k.strip()) if isinstance(k, str) else k.density for k in node.kids if isinstance(k, str) or k.kind != NEVER)


def density(chars: int, tags: int, link_chars: int, link_tags: int, body_ratio: float) -> float:
    """Composite text density; body_ratio: the share of the body's characters that are in links."""
    if not chars:
        return 0.0
    tags = max(tags, 1)
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + body_ratio * chars + math.e)
    return chars / tags * math.log(max(chars / max(link_chars, 1) * tags / max(link_tags, 1), 1.0 + 1e-9)) / max(math.log(base), 1e-9) if base > 1 else chars / tags


def select(root: Node) -> tuple[Node, list[Node], float]:
    """(core, path, threshold): the node of the largest density sum, the nodes from it up to the root, and the least density on them."""
    best, stack = root, [root]
    while stack:  # document order: the first of ties wins
        node = stack.pop()
        if node.total > best.total:
            best = node
        stack.extend(k for k in reversed(node.kids) if isinstance(k, Node) and k.kind != NEVER)
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    return best, path, min(x.density for x in path)


def _is_heading(node: Node) -> bool:
    """Whether all text of an element is in headings."""
    chars, stack = 0, [node]
    while stack:
        x = stack.pop()
        if x.tag in HEADINGS:
            chars += x.chars
        elif x.kind != NEVER:
            stack.extend(k for k in x.kids if isinstance(k, Node))
    return 0 < node.chars == chars


def _wanted(core: Node, path: list[Node], threshold: float) -> tuple[Node, Node | None, set[int]]:
    """(frame, whole, dropped): the subtree to write, the part of it in which lists of links stay, and nodes (by id) that are left out."""
    for tag in ("article", "main"):
        if around := [x for x in path if x.tag == tag]:
            return around[-1], around[-1], set()
    k = 0
    while k + 1 < len(path) - 1 and path[k + 1].chars == path[k].chars:  # wrappers of the same text
        k += 1
    dropped: set[int] = set()
    own = {x.names for x in path}  # parts of one make, as the core's wrapper is one
    for at in range(k, len(path) - 1):
        for x in path[at + 1].kids:
            if isinstance(x, Node) and x is not path[at] and x.tag in BLOCK:
                alike = x.names and x.names in own and (2 * x.density >= threshold or _is_heading(x))
                if not (x.density >= threshold or x.tag in HEADINGS or at == k and x.tag in PROSE or alike):
                    dropped.add(id(x))
    return path[-1], path[k] if k < len(path) - 1 else None, dropped


def blocks(frame: Node, whole: Node | None, dropped: set[int], threshold: float) -> list[str]:
    """The text blocks of a subtree in page order; outside whole, blocks under the threshold of which nine tenths or more are links go."""
    out: list[list[str]] = [[]]
    stack: list[tuple[Node | str, bool, bool]] = [(frame, False, frame is whole)]
    while stack:
        item, closing, kept = stack.pop()
        if isinstance(item, str):
            out[-1].append(item)
            continue
        if item.tag in BLOCK and out[-1]:
            out.append([])
        if closing:
            continue
        if item.kind == NEVER or id(item) in dropped:
            if item.tag not in BLOCK:
                out[-1].append(" ")
            continue
        if item.tag in VOID:
            out[-1].append(" " if item.tag == "br" else "")
            continue
        kept = kept or item is whole
        if not kept and item is not frame and item.tag in BLOCK and item.link_chars * 10 >= item.chars * 9 and item.density < threshold and item.link_tags > 1:
            continue
        stack.append((item, True, kept))
        stack.extend((k, False, kept) for k in reversed(item.kids))
    texts = (" ".join("".join(b).split()) for b in out)
    return [t for t in texts if t]


def extract(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    settle(root)
    measure(root)
    if not root.chars:
        return ""
    core, path, threshold = select(root)
    return "\n".join(blocks(*_wanted(core, path, threshold), threshold))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                batch = whole.slice(first, 512)
                texts = [extract(p) for p in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema.names)

    return pages.select("page_id", "url", "html").mapInArrow(run, schema)
