"""Main text of web pages by wrapper induction.

The DOM trees of a host's sample pages are aligned with a reference page of the host by simple
tree matching. Nodes whose aligned text is the same on all sample pages become template; nodes
whose text varies are slots. The content root is found by descending from the body to the child
that holds most slot text, as long as no heading or paragraph beside it holds slot text, too.
Every page of the host is then aligned with the reference: the node that matches the content
root gives its text, without the nodes that match the template. A page that has no such node,
or whose host has no other page, finds its root by the same descent over its own text.

Words of class, id and role and the kinds of elements are hints: text under a hint counts less
in the descent, and what a hint marks below the root is left out, however long it is. A class,
id or role is a hint only if all words of one of its names are words of boilerplate or say
nothing, so that `share-price` is none. No hint hides the root or what it lies in. A sample is at most SAMPLES pages, one
for each class of the page hash, so that it is found by aggregation and stays small however
many pages a host has.

Nothing here recurs: pages may be nested as deeply as they like. Trees are compared by shape,
an interned number for a tag and its children's shapes, so that equal subtrees match at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

SAMPLES = 6
#: Sample keys (about 40 bytes each) and characters of wrappers up to which they are broadcast.
BROADCAST_ROWS, BROADCAST_CHARS = 100_000, 8_000_000
#: Sample pages that must agree before a text counts as template.
AGREE = 3

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
_NAMES = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_RAW = {n: re.compile(rf"</{n}\b[^>]*>", re.I) for n in ("script", "style", "textarea", "title", "noscript", "template", "iframe")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that a start tag of the given kind closes.
CLOSES = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
_HOLDS = {"li": frozenset(["ul", "ol"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["tr", "table"]), "th": frozenset(["tr", "table"]), "option": frozenset(["select"])}
SKIPPED = frozenset("script style textarea title noscript template iframe head nav header footer aside form button select input svg object audio video canvas dialog".split())
#: Elements that no hint ever marks, and those that look like the content.
NEVER, LIKELY = frozenset("html body main article".split()), frozenset("main article".split())
#: What text under a hint and text in a likely element count beside other text in the descent, and the share that a child needs.
HINTED, LIKED, SHARE = 0.2, 4.0, 0.5
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 p".split())
#: Words of class, id or role that hint at boilerplate.
MARKS = frozenset("ad ads adbox advert advertisement adverts sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs header masthead footer sidebar aside notice notices cookie cookies consent gdpr popup modal alert subscribe newsletter signup login comment comments disqus reply replies discussion share sharing social related recommended widget toolbar search complementary contentinfo".split())
#: Words that say nothing about what a name marks.
NEUTRAL = frozenset("area article bar block body bottom box button buttons column container content entry footer global group holder inner item items left line link links list main outer page panel post primary reader region right row secondary section site slot story text thread title top unit user wrap wrapper zone".split())
_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")


def marked(name: str) -> bool:
    """Whether one name of a class, id or role is made of words of boilerplate and words that say nothing."""
    parts = [w for w in _SPLIT.split(name) if w and not w.isdigit()]
    parts = [w.lower() for w in parts]
    return not MARKS.isdisjoint(parts) and all(w in MARKS or w in NEUTRAL for w in parts)


class Node:
    __slots__ = ("tag", "kids", "hint", "shape")

    def __init__(self, tag: str, hint: bool = False):
        self.tag, self.kids, self.hint, self.shape = tag, [], hint, -1


def parse(html: str) -> Node:
    """The page's tree: Node for elements, str for text. Unclosed and misnested tags are mended."""
    root = Node("#")
    stack = [root]
    pos, n = 0, len(html)
    while pos < n:
        m = _TOKEN.search(html, pos)
        text = html[pos : m.start() if m else n]
        if text.strip():
            stack[-1].kids.append(text)
        elif text:
            stack[-1].kids.append(" ")
        if not m:
            break
        pos = m.end()
        close, name = m[1], m[2]
        if close:
            close = close.lower()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == close:
                    del stack[i:]
                    break
                if close not in BLOCK and stack[i].tag in BLOCK:  # an inline end tag does not close a block
                    break
        elif name:
            name = name.lower()
            attrs = m[3] or ""
            marks = ()
            if attrs:
                marks = [w for a in _NAMES.finditer(attrs) for w in (a[2] or a[3] or a[4] or "").split()]
            node = Node(name, name not in NEVER and (name in SKIPPED or any(map(marked, marks))))
            if name in _RAW:
                end = _RAW[name].search(html, pos)
                pos = end.end() if end else n
                stack[-1].kids.append(node)
                continue
            if name in BLOCK:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == "p":
                        del stack[i:]
                        break
                    if stack[i].tag in BLOCK:
                        break
            if name in CLOSES:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in CLOSES[name]:
                        del stack[i:]
                        break
                    if stack[i].tag in _HOLDS[name]:
                        break
            stack[-1].kids.append(node)
            if name not in VOID:  # a slash at the end of another start tag means nothing
                stack.append(node)
    return root


def own_text(x: Node) -> str:
    return "".join(k for k in x.kids if type(k) is str).strip()


def elements(x: Node) -> list[Node]:
    return [k for k in x.kids if type(k) is not str]


def preorder(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        out.append(x)
        stack += reversed(elements(x))
    return out


def blocks(node: Node, skip=frozenset(), hints: bool = True) -> list[str]:
    """Texts of a subtree's blocks in page order: references decoded, white space one space. Without nodes in skip and, with hints, hinted ones."""
    out: list[str] = []
    run: list[str] = []

    def end():
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            out.append(text)

    stack: list = list(reversed(node.kids))
    while stack:
        k = stack.pop()
        if type(k) is str:
            run.append(unescape(k))
        elif k is None:
            end()
        elif k.tag == "br":
            run.append(" ")
        elif k in skip or (hints and k.hint):
            if k.tag in BLOCK:
                end()
        else:
            if k.tag in BLOCK:
                end()
                stack.append(None)
            stack += reversed(k.kids)
    end()
    return out


class Shapes:
    """Numbers for tree shapes: a tag and the children's shapes. Leaves of a tag share one."""

    def __init__(self):
        self.number: dict[tuple, int] = {}
        self.tag: list[str] = []
        self.kids: list[tuple[int, ...]] = []
        self.size: list[int] = []
        self.memo: dict[tuple[int, int], int] = {}

    def mark(self, root: Node) -> None:
        for x in reversed(preorder(root)):
            key = (x.tag, *(k.shape for k in x.kids if type(k) is not str))
            n = self.number.get(key)
            if n is None:
                n = self.number[key] = len(self.tag)
                self.tag.append(x.tag)
                self.kids.append(key[1:])
                self.size.append(1 + sum(self.size[k] for k in key[1:]))
            x.shape = n

    def known(self, a: int, b: int) -> int | None:
        """The matching of two shapes, if it needs no search or has been searched."""
        if self.tag[a] != self.tag[b]:
            return 0
        if a == b:
            return self.size[a]
        if not self.kids[a] or not self.kids[b]:
            return 1
        return self.memo.get((a, b))

    def match(self, a: int, b: int) -> int:
        """Simple tree matching: the most node pairs of an order-keeping, root-to-root matching."""
        got = self.known(a, b)
        if got is not None:
            return got
        stack = [(a, b)]
        while stack:
            p, q = stack[-1]
            if (p, q) in self.memo:
                stack.pop()
                continue
            x, y, i, j = self.trimmed(p, q)
            open_ = [(u, v) for u in set(x) for v in set(y) if self.known(u, v) is None]
            if open_:
                stack += open_
                continue
            stack.pop()
            same = self.kids[p][:i] + self.kids[p][len(self.kids[p]) - j :]
            last = self.last_row(x, y)
            self.memo[p, q] = 1 + sum(self.size[k] for k in same) + int(last[-1])
        return self.memo[a, b]

    def trimmed(self, p: int, q: int) -> tuple[tuple[int, ...], tuple[int, ...], int, int]:
        """The children between those in front and those at the end that are alike, and the numbers of these: two equal shapes that meet there always match in a best matching."""
        x, y = self.kids[p], self.kids[q]
        n = min(len(x), len(y))
        i = 0
        while i < n and x[i] == y[i]:
            i += 1
        j = 0
        while j < n - i and x[len(x) - 1 - j] == y[len(y) - 1 - j]:
            j += 1
        return x[i : len(x) - j], y[i : len(y) - j], i, j

    def weights(self, u: int, values: list[int], place: np.ndarray) -> np.ndarray:
        return np.array([self.match(u, v) for v in values], np.int32)[place]

    def last_row(self, x, y) -> np.ndarray:
        """Best matchings of all of x with each prefix of y."""
        row = np.zeros(len(y) + 1, np.int32)
        if not x or not y:
            return row
        values, place = np.unique(np.array(y), return_inverse=True)
        values, rows = values.tolist(), {}
        for u in x:
            if u not in rows:
                rows[u] = self.weights(u, values, place)
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + rows[u]))
        return row

    #: Cells of a table that is kept whole; of larger ones only rows are kept, and the lists are halved.
    CELLS = 1 << 20

    def path(self, x: tuple[int, ...], y: tuple[int, ...]) -> list[tuple[int, int]]:
        """Places of the matched children of a best matching, in order."""
        out, stack = [], [(0, len(x), 0, len(y))]
        while stack:
            a, b, c, d = stack.pop()
            if a == b or c == d:
                continue
            if b - a > 1 and (b - a) * (d - c) > self.CELLS:
                mid = (a + b) // 2
                ahead = self.last_row(x[a:mid], y[c:d])
                behind = self.last_row(x[mid:b][::-1], y[c:d][::-1])[::-1]
                cut = c + int(np.argmax(ahead + behind))
                stack += [(mid, b, cut, d), (a, mid, c, cut)]  # the first part is taken next
                continue
            values, place = np.unique(np.array(y[c:d]), return_inverse=True)
            table = np.zeros((b - a + 1, d - c + 1), np.int32)
            rows: dict[int, np.ndarray] = {}
            for i in range(b - a):
                u = x[a + i]
                if u not in rows:
                    rows[u] = self.weights(u, values.tolist(), place)
                table[i + 1, 1:] = np.maximum.accumulate(np.maximum(table[i, 1:], table[i, :-1] + rows[u]))
            i, j, found = b - a, d - c, []
            while i and j:
                if table[i, j] == table[i - 1, j]:
                    i -= 1
                elif table[i, j] == table[i, j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    found.append((a + i, c + j))
            out += reversed(found)
        return out


def pairs(a: Node, b: Node, shapes: Shapes) -> Iterator[tuple[Node, Node]]:
    """The matched nodes of a best matching of two marked trees."""
    stack = [(a, b)] if a.tag == b.tag else []
    while stack:
        p, q = stack.pop()
        yield p, q
        x, y = elements(p), elements(q)
        if not x or not y:
            continue
        if p.shape == q.shape:
            stack += reversed(list(zip(x, y)))
            continue
        shapes.match(p.shape, q.shape)
        mid_x, mid_y, i, j = shapes.trimmed(p.shape, q.shape)
        both = [*zip(x[:i], y[:i]), *((x[i + u], y[i + v]) for u, v in shapes.path(mid_x, mid_y)), *zip(x[len(x) - j :], y[len(y) - j :])]
        stack += reversed(both)


def content_root(tree: Node, slot: dict[Node, float]) -> Node:
    """The descent: slot gives each node's own slot text; a tree without any keeps its top."""
    nodes = preorder(tree)
    weight: dict[Node, float] = {}
    for x in reversed(nodes):
        weight[x] = slot.get(x, 0) + sum(weight[k] * (HINTED if k.hint else LIKED if k.tag in LIKELY else 1.0) for k in x.kids if type(k) is not str)
    at = tree
    while True:
        own = [k for k in elements(at) if k.tag in BLOCK or k.tag in ("html", "body", "center", "font", "span", "a", "b")]
        told = lambda k: weight[k] * (HINTED if k.hint else LIKED if k.tag in LIKELY else 1.0)
        best = max(own, default=None, key=told)
        # a paragraph is a slot of the content, not its root
        if best is None or not weight[best] or told(best) < SHARE * weight[at] or not any(k.tag in BLOCK for k in elements(best)) and best.tag not in LIKELY:
            return at
        if any(k is not best and k.tag in HEADINGS and not k.hint and weight[k] for k in elements(at)):
            return at
        at = best


def induce(pages: list[str]) -> tuple[int, list[int]]:
    """The content root in the first page's tree and its template nodes, by their places in preorder."""
    trees = [parse(p) for p in dict.fromkeys(pages)]  # copies of a page would make all its text template
    shapes, ref = Shapes(), trees[0]
    for t in trees:
        shapes.mark(t)
    same: dict[Node, int] = {}
    met: dict[Node, int] = {}
    slot: dict[Node, float] = {x: len(own_text(x)) for x in preorder(ref)}
    for other in trees[1:]:
        to: dict[Node, Node] = {}
        for p, q in pairs(ref, other, shapes):
            to[q] = p
            met[p] = met.get(p, 0) + 1
            same[p] = same.get(p, 0) + (own_text(p) == own_text(q))
        stack = [(other, ref)]  # text of what has no match counts for the nearest node above that has one
        while stack:
            x, near = stack.pop()
            near = to.get(x, near)
            slot[near] = slot.get(near, 0) + len(own_text(x))
            stack += [(k, near) for k in elements(x)]
    alike = {p for p, n in met.items() if n + 1 >= AGREE and same[p] == n and own_text(p)}
    for p in alike:
        slot[p] = 0.0
    nodes = preorder(ref)
    held: dict[Node, float] = {}
    for x in reversed(nodes):
        held[x] = slot.get(x, 0) + sum(held[k] for k in elements(x))
    root = content_root(ref, slot)
    # a node that holds a slot stays
    return nodes.index(root), [i for i, x in enumerate(nodes) if x in alike and not held[x]]


class Wrapper:
    #: Shapes that pages may add before the numbering starts anew.
    MOST_SHAPES = 20_000

    def __init__(self, reference: str, root: int, template: list[int]):
        self.tree = parse(reference)
        nodes = preorder(self.tree)
        self.root = nodes[root] if root else None
        self.template = {nodes[i] for i in template}
        self.shapes = None

    def extract(self, html: str) -> str:
        tree = parse(html)
        if self.shapes is None or len(self.shapes.tag) > self.MOST_SHAPES:
            self.shapes = Shapes()
            self.shapes.mark(self.tree)
        self.shapes.mark(tree)
        found, skip = None, set()
        for p, q in pairs(self.tree, tree, self.shapes):
            if p is self.root:
                found = q
            if p in self.template and own_text(p) == own_text(q):
                skip.add(q)
        if found is None:
            found = content_root(tree, {x: 0 if x in skip else len(own_text(x)) for x in preorder(tree)})
        # where all of the content is alike on the samples, it is content all the same
        return "\n".join(blocks(found, skip) or blocks(found) or blocks(found, hints=False))


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^.*?://([^/?#]*)", 1))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) of every row.

    Null html counts as empty and gives an empty text; null urls and urls without a host share
    the empty host; repeated rows give equal texts; an empty table gives no rows; other columns
    are ignored.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    # Each host gives its least page of each hash class, by (hash, url): one aggregation of hashes, then one join for the html.
    seal = F.xxhash64("url", "html")
    keyed = rows.select(host_of(F.col("url")).alias("host"), seal.alias("seal"), "html")
    least = keyed.groupBy("host", F.pmod("seal", F.lit(SAMPLES)).alias("class")).agg(F.min("seal").alias("seal")).select("host", "seal")
    least = stored(least, "samples")
    sample = keyed.join(F.broadcast(least) if least.count() <= BROADCAST_ROWS else least, ["host", "seal"]).groupBy("host", "seal").agg(F.first("html").alias("html"))
    lists = sample.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("seal", "html"))).alias("x"))

    def wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            refs, roots, templates = [], [], []
            for x in b.column(1).to_pylist():
                root, template = induce([p["html"] for p in x])
                refs.append(x[0]["html"])
                roots.append(root)
                templates.append(template)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(refs, pa.string()), pa.array(roots, pa.int32()), pa.array(templates, pa.list_(pa.int32()))], ["host", "ref", "root", "template"])

    wrappers = stored(lists.mapInArrow(wrap, "host string, ref string, root int, template array<int>"), "wrappers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Wrapper] = {}
        for b in batches:
            texts = []
            host, html = b.column(2).to_pylist(), b.column(3).to_pylist()
            for i, (h, page) in enumerate(zip(host, html)):
                if h not in known:
                    if len(known) > 5_000:
                        known.clear()
                    known[h] = Wrapper(*(b.column(k)[i].as_py() for k in (4, 5, 6)))
                texts.append(known[h].extract(page) if page else "")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    # a host's wrapper goes to the pages: broadcast while all wrappers are small, else by a shuffle of the pages
    size = wrappers.agg(F.sum(F.length("ref"))).first()[0] or 0
    joined = rows.withColumn("host", host_of(F.col("url"))).join(F.broadcast(wrappers) if size <= BROADCAST_CHARS else wrappers, "host").select("page_id", "url", "host", "html", "ref", "root", "template")
    return joined.mapInArrow(run, "page_id long, url string, text string")
