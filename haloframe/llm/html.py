"""Main-text extraction by wrapper induction over the pages of a host.

Pages become trees of elements.  Each page is aligned once with its host's reference pages (up to three with
a text) by simple tree matching, which maximises matched pairs of nodes under order and
ancestry.  Over all pages of a host, a block that is matched and says the same in nearly all of them is
template; varying blocks are content, wherever they stand.

Elements and roles that are boilerplate by HTML's own meaning (menus, footers, asides, forms, scripts and so
on) are never content, nor are reader comments, in elements marked as such (``COMMENTS``); of articles so marked, nested and later ones
go.  If a page has an article or main element, its text lies in there; headers inside one belong to it.  In there a constant block is
template only if it was so on ``TEMPLATE_PAGES`` pages, and only before the first or behind the last varying block (a heading: only
behind it), so that headings and quotations amid a text stay whatever the host repeats.  A class or id with a word for boilerplate
(``HINTS``) is a hint: it counts where the aligned pages of the host have the element, of the same name, at the same place
(``HINT_SHARE``; within an article again on ``TEMPLATE_PAGES`` pages).  Only on a page that marks no content such a word alone
decides, as a part of a name if the host has no other page.

Only counts per host and reference node are shuffled, pre-aggregated in each task; reference pages are
joined by host.  A page that nearly equals a reference, or has no text, has no say in it.  Nulls: null html
has an empty text; pages without a host (null urls too) share one; a null id is kept.  Rows sharing a page id,
and repeated rows, are each extracted; of pages that tie for the smallest id the one of the least digest is a
reference.  Broken markup closes where it ends.  Texts of any length are used whole.  Extra columns are not
carried along.  An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haloframe.llm.common import cut, ensure_small_batches, join_side
from haloframe.llm.urls import host_of

TEMPLATE_PAGES = 5
TEMPLATE_SHARE = 0.9
HINT_SHARE = 0.5
ALIGN_CELLS = 250_000
#: Characters of parsed references, and numbered shapes and pairs of them, that a task holds.
PARSED_CHARS = 4_000_000
HELD_SHAPES = 200_000
#: The code of a hint on a host whose pages have none to be compared with, and the number under which voters count.
_ALONE = _VOTERS = -1
#: The code of a whole word for boilerplate on a page that marks no content; it always counts.
_NAMED = -2

# HTML's elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
SKIP = frozenset(
    "head script style noscript template iframe object svg canvas nav footer aside form button select option textarea dialog menu "
    "audio video map title".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup header".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words that name boilerplate in class and id attributes.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus "
    "footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification popup promo promoted promotion "
    "related replies reply respond share sharing sidebar sidebars skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
#: Words that mark reader comments in class and id attributes.
COMMENTS = frozenset("comment comments disqus".split())
# An open element of a key is closed by a start tag of its set.
_PARAGRAPH_ENDS = BLOCK - {"html", "body", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "title", "dd", "dt", "li"} | {"li", "dd", "dt", "td", "th", "tr"}
_CLOSES = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "td": {"td", "th", "tr", "tbody", "tfoot", "thead"},
    "th": {"td", "th", "tr", "tbody", "tfoot", "thead"},
    "tr": {"tr", "tbody", "tfoot", "thead"},
    "option": {"option"},
    "head": {"body"},
}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|noscript)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</\1\s*>|\Z)"
    r"|<[/!?]?[a-zA-Z](?:\"[^\"]*\"|'[^']*'|[^'\">])*>|<[/!?]?[a-zA-Z][^<>]*>|<!\[CDATA\[.*?(?:\]\]>|\Z)",
    re.S | re.I,
)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>]+)))?""")
_WORDS = re.compile(r"[^a-z]+")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("children", "content", "hint", "named", "noise", "own", "tag", "text")

    def __init__(self, tag: str, noise: bool, content: bool, hint: str | None = None, named: bool = False):
        self.tag, self.noise, self.content, self.hint, self.named, self.children, self.text, self.own = tag, noise, content, hint, named, [], [], None


def _evidence(tag: str, source: str, inside: bool, later: bool) -> tuple[bool, str | None, bool]:
    """Whether an element is boilerplate by kind, role or as a comment, the name that hints at it, and whether that is a word for it as a whole.

    ``inside``: it stands in marked content; ``later``: some came before it.
    """
    if tag in SKIP or tag == "header" and not inside:
        return True, None, False
    hint, named = None, False
    if len(source) > len(tag) + 3:
        for name, *values in _ATTRIBUTE.findall(source, len(tag) + 1):
            name, value = name.lower(), "".join(values).lower()
            if name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
                return True, None, False
            tokens = value.split() if name in ("class", "id") else ()
            if not COMMENTS.isdisjoint(tokens) or name == "itemprop" and value == "comment" or name == "itemtype" and value.endswith("schema.org/comment"):
                if inside or later or tag not in ("body", "html", "article", "main"):
                    return True, None, False
            if tag not in ("body", "html", "article", "main"):
                for token in tokens:
                    if token in HINTS and not named:
                        hint, named = token, True
                    elif hint is None and not HINTS.isdisjoint(_WORDS.split(token)):
                        hint = token
    return False, hint, named


def parse(html: str) -> Node:
    """The tree of block elements; inline elements lend their text to the block around them.

    Boilerplate elements stand in the text of their parents, but are no children: they take part in no match.
    """
    root = Node("#root", False, False)
    stack, at, later = [root], 0, False

    def said(text: str) -> None:
        if not stack[-1].noise:
            stack[-1].text.append(unescape(text) if "&" in text else text)

    for m in _TOKEN.finditer(html):
        if m.start() > at:
            said(html[at : m.start()])
        at = m.end()
        source = m[0]
        if m[1] or source[1] in "!?":
            continue
        tag = _NAME.match(source)[1].lower()
        if source[1] == "/":
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag not in BLOCK and stack[k].tag in BLOCK:
                    break
            continue
        if tag == "br":
            said(" ")
            continue
        while len(stack) > 1 and (tag in _CLOSES.get(stack[-1].tag, ()) or stack[-1].tag == "p" and tag in _PARAGRAPH_ENDS):
            stack.pop()
        if tag in VOID and tag != "hr":
            continue
        above = stack[-1]
        noise, hint, named = (True, None, False) if above.noise else _evidence(tag, source, above.content, later)
        if tag not in BLOCK and (not noise or above.noise):
            continue  # inline: its text is its block's
        node = Node(tag, noise, above.content or tag in ("article", "main"), hint, named)
        later = later or node.content and not noise
        if not above.noise:
            above.text.append(node)
            if not noise:
                above.children.append(node)
        if tag != "hr" and not source.endswith("/>"):
            stack.append(node)
    if at < len(html):
        said(html[at:])
    return root


def _own_text(node: Node) -> str:
    if node.own is None:
        node.own = _SPACE.sub(" ", "".join(x if isinstance(x, str) else "\0" for x in node.text)).strip("\0 \t\n\r\f\v")
    return node.own


def flat(root: Node) -> list[Node]:
    """All nodes but those of boilerplate, parents first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += reversed(node.children)
    return out


def _trimmed(xs: tuple[int, ...], ys: tuple[int, ...]) -> tuple[int, int]:
    """How many children at the end, then at the start, have equal shapes; a largest match pairs those."""
    most, tail, head = min(len(xs), len(ys)), 0, 0
    while tail < most and xs[-1 - tail] == ys[-1 - tail]:
        tail += 1
    while head < most - tail and xs[head] == ys[head]:
        head += 1
    return head, tail


def _last_row(xs: tuple[int, ...], ys: tuple[int, ...], gain: dict[tuple[int, int], int], rows: dict[int, np.ndarray]) -> np.ndarray:
    """The largest gains of all of ``xs`` with each start of ``ys``, in memory for one row a shape."""
    row = np.zeros(len(ys) + 1, np.int64)
    for x in xs:
        if x not in rows:
            rows[x] = np.array([gain.get((x, y), 0) for y in ys], np.int64)
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + rows[x]))
    return row


def _ordered(xs: tuple[int, ...], ys: tuple[int, ...], gain: dict[tuple[int, int], int]) -> list[tuple[int, int]]:
    """The pairs of places of a largest match in order; halved (Hirschberg) until a table has ``ALIGN_CELLS`` at most."""
    out, stack = [], [(0, len(xs), 0, len(ys))]
    while stack:
        a, b, c, d = stack.pop()
        head, tail = _trimmed(xs[a:b], ys[c:d])
        out += [(a + k, c + k) for k in range(head)] + [(b - 1 - k, d - 1 - k) for k in range(tail)]
        a, b, c, d = a + head, b - tail, c + head, d - tail
        n, m = b - a, d - c
        if not n or not m:
            continue
        if n > 1 and n * m > ALIGN_CELLS:
            half = a + n // 2
            left = _last_row(xs[a:half], ys[c:d], gain, {})
            right = _last_row(xs[half:b][::-1], ys[c:d][::-1], gain, {})[::-1]
            at = c + int(np.argmax(left + right))
            stack += [(a, half, c, at), (half, b, at, d)]
            continue
        table = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n):
            row, above, x = table[i + 1], table[i], xs[a + i]
            for j in range(m):
                row[j + 1] = max(row[j], above[j + 1], above[j] + gain.get((x, ys[c + j]), 0))
        i, j = n, m
        while i and j:
            won = gain.get((xs[a + i - 1], ys[c + j - 1]), 0)
            if won and table[i][j] == table[i - 1][j - 1] + won:
                out.append((a + i - 1, c + j - 1))
                i, j = i - 1, j - 1
            elif table[i][j] == table[i - 1][j]:
                i -= 1
            else:
                j -= 1
    return sorted(out)


class Shapes:
    """Numbers the shapes of trees, and remembers what each two of them gain by a largest match.

    A shape is a tag and the shapes of the children; what two nodes can gain depends on their shapes alone.
    """

    def __init__(self) -> None:
        self.known: dict[tuple[str, tuple[int, ...]], int] = {}
        self.parts: list[tuple[str, tuple[int, ...]]] = []
        self.sizes: list[int] = []
        self.gain: dict[tuple[int, int], int] = {}
        self.places: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def held(self) -> int:
        return len(self.parts) + len(self.gain)

    def of(self, nodes: list[Node]) -> dict[int, int]:
        """The shape of each node of a tree, by its identity."""
        own: dict[int, int] = {}
        for node in reversed(nodes):
            part = (node.tag, tuple([own[id(c)] for c in node.children]))
            shape = self.known.setdefault(part, len(self.parts))
            if shape == len(self.parts):
                self.parts.append(part)
                self.sizes.append(1 + sum(self.sizes[c] for c in part[1]))
            own[id(node)] = shape
        return own

    def _compare(self, x: int, y: int) -> None:
        """Gains of two shapes and of all below them, children before parents, on a list of its own: trees may be deep."""
        todo = [(x, y, False)]
        while todo:
            x, y, ready = todo.pop()
            if (x, y) in self.gain:
                continue
            if x == y:
                self.gain[x, y] = self.sizes[x]
                continue
            xs, ys = self.parts[x][1], self.parts[y][1]
            if not ready:
                head, tail = _trimmed(xs, ys)
                todo.append((x, y, True))
                todo += [(c, c, False) for c in {*xs[:head], *xs[len(xs) - tail :]}]
                inner = product(set(xs[head : len(xs) - tail]), set(ys[head : len(ys) - tail]))
                todo += [(c, d, False) for c, d in inner if self.parts[c][0] == self.parts[d][0]]
                continue
            found = self.places[x, y] = _ordered(xs, ys, self.gain)
            self.gain[x, y] = 1 + sum(self.gain[xs[i], ys[j]] for i, j in found)

    def pairs(self, a: Node, left: dict[int, int], b: Node, right: dict[int, int]) -> list[tuple[Node, Node]]:
        """Pairs of a largest top-down, order-preserving match of two trees of equal tag."""
        self._compare(left[id(a)], right[id(b)])
        out, stack = [], [(a, b)]
        while stack:
            p, q = stack.pop()
            out.append((p, q))
            x, y = left[id(p)], right[id(q)]
            if x == y:
                stack += zip(p.children, q.children, strict=True)
            else:
                stack += [(p.children[i], q.children[j]) for i, j in self.places[x, y]]
        return out


def match(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Simple tree matching of two trees; none if their tags differ."""
    shapes = Shapes()
    return shapes.pairs(a, shapes.of(flat(a)), b, shapes.of(flat(b))) if a.tag == b.tag else []


def content_root(nodes: list[Node]) -> bool:
    """Whether the page says where its content is."""
    return any(n.content for n in nodes)


def pieces(root: Node, nodes: list[Node]) -> list[tuple[str, Node, list[Node]]]:
    """The blocks that may be content, in page order: text, node, and the hinting nodes it stands in."""
    marked, out, held, hints = content_root(nodes), [], [], []

    def flush(node: Node) -> None:
        text = _SPACE.sub(" ", "".join(held)).strip()
        if text:
            out.append((text, node, list(hints)))
        held.clear()

    stack: list = [(root, iter(root.text))]
    while stack:
        node, parts = stack[-1]
        part = next(parts, None)
        if part is None:
            stack.pop()
            flush(node)
            if node.hint:
                hints.pop()
        elif isinstance(part, str):
            if node.content or not marked:
                held.append(part)
        elif part.tag in BLOCK:
            flush(node)
            if not part.noise:
                stack.append((part, iter(part.text)))
                if part.hint:
                    hints.append(part)
    return out


def blocks(root: Node, nodes: list[Node], template: set[int]) -> list[str]:
    """The texts of content blocks in page order; ``template`` holds ids of nodes that are none."""
    return [text for text, node, hints in pieces(root, nodes) if template.isdisjoint(map(id, [node, *hints]))]


class _Page:
    """A parsed page, its nodes and their shapes."""

    def __init__(self, html: str, shapes: Shapes):
        self.root = parse(html)
        self.nodes = flat(self.root)
        self.shapes = shapes.of(self.nodes)
        self.number = {id(n): k for k, n in enumerate(self.nodes)}
        self.chars = sum(len(_own_text(n)) for n in self.nodes)


class _References:
    """The references seen last, parsed once, and the shapes of all pages of late; bounded, forgotten when full."""

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.pages: dict[str, _Page] = {}
        self.shapes, self.chars = Shapes(), 0

    def room(self) -> Shapes:
        """The shapes for another page; called while no page is in use."""
        if self.chars > PARSED_CHARS or self.shapes.held() > HELD_SHAPES:
            self.forget()
        return self.shapes

    def __call__(self, html: str) -> _Page:
        if html not in self.pages:
            self.pages[html] = _Page(html, self.shapes)
            self.chars += len(html)
        return self.pages[html]


def _code(reference: int, number: int, hint: bool, strict: bool) -> int:
    """Of a reference's node, as a constant block or as a hint; ``strict``: if seen on ``TEMPLATE_PAGES`` pages."""
    return reference << 40 | number << 2 | strict << 1 | hint


def _compare(html: str, references: list[str], held: _References, share: float, seen: dict) -> list[tuple[str, list[int], list[int], bool, bool]]:
    """A page's blocks, each with the codes of the reference nodes that would make it template as a constant and by its name,
    whether it stands in marked content, and whether it is a heading.

    Votes go to ``seen``: by reference and node how often it was matched, said the same, had the same hint.
    """
    page = _Page(html, held.room())
    codes: dict[int, list[int]] = defaultdict(list)
    for k, reference in enumerate(references):
        other = held(reference)
        pairs = held.shapes.pairs(page.root, page.shapes, other.root, other.shapes)
        found, alike = [], 0
        for x, y in pairs:
            text, hint = _own_text(x), x.hint is not None and x.hint == y.hint
            same = bool(text) and text == _own_text(y)
            if same:
                alike += len(text)
            if text or hint:
                number = other.number[id(y)]
                found.append((number, bool(text), same, hint))
                if same:
                    codes[id(x)].append(_code(k, number, False, x.content))
                if hint:
                    codes[~id(x)].append(_code(k, number, True, x.content))
        if page.chars and html != reference and alike <= share * page.chars:
            seen[k, _VOTERS][0] += 1
            for number, text, same, hint in found:
                entry = seen[k, number]
                entry[0] += text
                entry[1] += same
                entry[2] += hint
    marked, out = content_root(page.nodes), []
    for text, node, hints in pieces(page.root, page.nodes):
        named = [code for h in hints for code in (*codes[~id(h)], *(() if marked else (_NAMED if h.named else _ALONE,)))]
        out.append((text, codes[id(node)], named, node.content, node.tag in HEADINGS))
    return out


_ALIGNED = "page_id bigint, url string, host string, texts array<string>, codes array<array<bigint>>, named array<array<bigint>>, inside array<boolean>, heading array<boolean>, reference int, number int, matched bigint, equal bigint, hinted bigint"


def _aligned(share: float):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _References()
        types = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), *[pa.list_(pa.list_(pa.int64()))] * 2, *[pa.list_(pa.bool_())] * 2, pa.int32(), pa.int32(), *[pa.int64()] * 3]
        names = [c.split()[0] for c in _ALIGNED.split(", ")]

        def rows(columns: dict[int, list]) -> pa.RecordBatch:
            count = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([pa.array(columns[i], t) if i in columns else pa.nulls(count, t) for i, t in enumerate(types)], names=names)

        for batch in batches:
            votes: dict[str, dict] = defaultdict(lambda: defaultdict(lambda: [0, 0, 0]))
            hosts = batch.column(2).to_pylist()
            both = [_compare(html, references or [], held, share, votes[host]) for host, html, references in zip(hosts, *(batch.column(i).to_pylist() for i in (3, 4)), strict=True)]
            yield rows({0: batch.column(0).to_pylist(), 1: batch.column(1).to_pylist(), 2: hosts, **{3 + k: [[block[k] for block in page] for page in both] for k in range(5)}})
            cast = [(host, *key, *counts) for host, seen in votes.items() for key, counts in seen.items()]
            if cast:
                yield rows(dict(zip((2, 8, 9, 10, 11, 12), map(list, zip(*cast, strict=True)), strict=True)))

    return align


def with_reference(pages: DataFrame) -> DataFrame:
    """``page_id, url, host, html, references``: each page beside its host's reference pages.

    Of the pages with a text these are the one of the smallest id and those of the smallest and the largest hash.
    """
    rows = pages.select(F.col("page_id").cast("bigint"), "url", host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    digest = F.md5("html")
    read = rows.where(F.col("html").rlike(r">\s*[^<\s]"))
    ends = read.select("host", F.col("page_id").isNull().alias("none"), "page_id", digest.alias("digest")).groupBy("host").agg(
        F.min(F.struct("none", "page_id", "digest"))["digest"].alias("first"), F.min("digest").alias("low"), F.max("digest").alias("high")
    )
    wanted = cut(ends.select("host", F.explode(F.array_distinct(F.array("first", "low", "high"))).alias("digest")))
    # A semi-join that keeps pages in place: up to three digests a host, broadcast if they are few bytes.
    chosen = join_side(read.select("host", "html", digest.alias("digest")), wanted, ["host", "digest"], 128, how="left_semi")
    chosen = cut(chosen.groupBy("host", "digest").agg(F.first("html").alias("html")).groupBy("host").agg(F.sort_array(F.collect_list("html")).alias("references")))
    return join_side(rows, chosen, ["host"], F.aggregate("references", F.lit(0), lambda n, x: n + F.octet_length(x)), spread="html")


def template(counts: DataFrame, pages: int = TEMPLATE_PAGES, share: float = TEMPLATE_SHARE) -> DataFrame:
    """``host, template``: the codes of reference nodes that make a block template.

    Nodes must be matched on ``pages`` pages, or on all pages there are beside the reference if those are fewer; a strict code wants the former.
    """
    found = counts.groupBy("host", "reference", "number").agg(*[F.sum(c).alias(c) for c in ("matched", "equal", "hinted")])
    found = cut(found)
    voters = found.where("number = -1").select("host", "reference", F.col("matched").alias("voters"))
    code = F.shiftleft(F.col("reference").cast("bigint"), 40).bitwiseOR(F.shiftleft(F.col("number").cast("bigint"), 2))
    made = []
    for strict, enough in ((0, F.least(F.lit(pages), "voters")), (2, F.lit(pages))):
        made.append(F.when((F.col("matched") >= enough) & (F.col("equal") >= share * F.col("matched")), code + strict))
        made.append(F.when((F.col("hinted") >= enough) & (F.col("hinted") >= HINT_SHARE * F.col("voters")), code + strict + 1))
    return (
        found.where("number >= 0")
        .join(voters, ["host", "reference"])
        .select("host", F.array_compact(F.array(*made)).alias("codes"))
        .groupBy("host")
        .agg(F.flatten(F.collect_set("codes")).alias("template"))
    )


def kept_texts(template: Column) -> Column:
    """The texts of the blocks that ``template`` (a page's array of codes) leaves, of columns ``texts, codes, named, inside, heading``."""
    blocks = F.arrays_zip("texts", "codes", "named", "inside", "heading")
    judged = F.transform(
        blocks,
        lambda p: F.struct(p["texts"].alias("text"), F.arrays_overlap(p["codes"], template).alias("constant"), F.arrays_overlap(p["named"], template).alias("named"), p["inside"].alias("inside"), p["heading"].alias("heading")),
    )

    def chosen(all_: Column) -> Column:
        varying = F.transform(all_, lambda p, i: F.when(~p["constant"] & ~p["named"], i))

        def of(ends: Column) -> Column:
            first, last = ends["first"], ends["last"]
            stays = lambda p, i: p["inside"] & (first.isNull() | (i < last) & ((i > first) | p["heading"]))
            return F.transform(F.filter(all_, lambda p, i: ~p["named"] & (~p["constant"] | stays(p, i))), lambda p: p["text"])

        return F.transform(F.array(F.struct(F.array_min(varying).alias("first"), F.array_max(varying).alias("last"))), of)[0]

    return F.transform(F.array(judged), chosen)[0]


def extract(pages: DataFrame, share: float = TEMPLATE_SHARE) -> DataFrame:
    """Per page ``page_id, url, text``: blocks joined by an empty line.  Pages are parsed and aligned once."""
    ensure_small_batches(pages.sparkSession)
    paired = with_reference(pages).select("page_id", "url", "host", "html", "references")
    aligned = cut(paired.mapInArrow(_aligned(share), _ALIGNED))
    constant = cut(template(aligned.where("reference IS NOT NULL").select("host", "reference", "number", "matched", "equal", "hinted"), share=share))
    rows = aligned.where("reference IS NULL").select("page_id", "url", "host", "texts", "codes", "named", "inside", "heading")
    joined = join_side(rows, constant, ["host"], 8 * F.size("template"), spread="page_id")
    held = F.concat(F.coalesce("template", F.array(F.lit(_ALONE).cast("bigint"))), F.array(F.lit(_NAMED).cast("bigint")))
    return joined.withColumn("held", held).select("page_id", "url", F.array_join(kept_texts(F.col("held")), "\n\n").alias("text"))


def op8_html_extraction(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).withColumn("n_chars", F.char_length("text").cast("bigint"))
