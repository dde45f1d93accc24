"""The node table: captured pages as rows, one per element.

nodes: page_id, node_id (pre-order, 0 is the document), last_desc, parent_id, depth, sib_ord and sib_n
(place among and number of element siblings), like_ord and like_n (the same among siblings of its tag), tag, attrs MAP, anc ARRAY (ids of all ancestors),
own_text (own text nodes with NUL between), page_text (document row only: all text nodes of the page
with NUL between), and spans: text_start..text_end in page_text, inner_start..inner_end and
outer_start..outer_end in the page source.

With spans a subtree's text or markup is a substring, so reading values needs no join below the
page. Parsing is the one Python stage; selecting and reading values are joins and windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import short_batches

# --- fixed values: which tags stand alone, and which an opening tag closes ----------------------
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD_ONLY = frozenset("base link meta noscript script style template title".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
SCOPE = frozenset("html table td th caption button object template".split())
CELL = frozenset("td th".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
# opening tag -> (open tags it ends, tags the search stops at)
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": (CELL, {"tr", "table"}), "th": (CELL, {"tr", "table"}), "tr": ({"tr"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}), "a": ({"a"}, CLOSES_P | SCOPE),
}
BATCH_NODES = 4_000  # of one batch that leaves a worker, give or take a page
MAX_DEPTH = 512  # deeper elements become siblings, as browsers do it
# ------------------------------------------------------------------------------------------------

NODE_SCHEMA = (
    "node_id int, last_desc int, parent_id int, depth int, sib_ord int, sib_n int, like_ord int, like_n int, tag string, attrs map<string,string>, "
    "anc array<int>, own_text string, page_text string, text_start int, text_end int, "
    "inner_start int, inner_end int, outer_start int, outer_end int"
)
SPANS = ("text_start", "text_end", "inner_start", "inner_end", "outer_start", "outer_end")
NUL = "\0"


class _Node:
    """An element while its page is being read."""

    __slots__ = ("id", "last", "parent", "depth", "sib", "like", "tags", "tag", "attrs", "anc", "own", "count", "text", "text_end", "inner", "inner_end", "outer", "outer_end")

    def __init__(self, id_, parent, depth, sib, tag, attrs, anc, text, outer, inner):
        self.id, self.last, self.parent, self.depth, self.sib, self.tag = id_, id_, parent, depth, sib, tag
        self.attrs, self.anc, self.own, self.count = attrs, anc, [], 0
        self.like, self.tags = 0, {}
        self.text = self.text_end = text
        self.outer, self.inner, self.inner_end, self.outer_end = outer, inner, inner, inner


class _Builder(HTMLParser):
    """Turns parser events of one page into node rows, closing what the markup leaves open."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.lines = [0]
        at = html.find("\n")
        while at >= 0:
            self.lines.append(at + 1)
            at = html.find("\n", at + 1)
        self.html, self.size = html, len(html)
        self.nodes = [_Node(0, None, 0, 0, "#document", [], [], 0, 0, 0)]
        self.stack = [self.nodes[0]]
        self.texts: list[str] = []
        self.length = 0  # of page_text so far
        self.text_owner: tuple | None = None
        self.body = False
        self.feed(html)
        self.close()
        self._body(self.size)
        while self.stack:
            self._pop(self.size)

    def rows(self) -> list[tuple]:
        siblings = [(1, 1) if n.parent is None else (self.nodes[n.parent].count, self.nodes[n.parent].tags[n.tag]) for n in self.nodes]
        text = NUL.join(self.texts)
        return [
            (n.id, n.last, n.parent, n.depth, n.sib, count, n.like, alike, n.tag, n.attrs, n.anc, NUL.join(n.own), text if n.id == 0 else None,
             n.text, n.text_end, n.inner, n.inner_end, n.outer, n.outer_end)
            for n, (count, alike) in zip(self.nodes, siblings)
        ]

    def _at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _push(self, tag: str, attrs: list, start: int, inner: int) -> None:
        if len(self.stack) > MAX_DEPTH:
            self._pop(start)
        parent = self.stack[-1]
        node = _Node(
            len(self.nodes), parent.id, len(self.stack), parent.count, tag, attrs, [n.id for n in self.stack], self.length, start, inner
        )
        parent.count += 1
        node.like = parent.tags.get(tag, 0)
        parent.tags[tag] = node.like + 1
        self.nodes.append(node)
        self.stack.append(node)

    def _pop(self, inner_end: int, outer_end: int | None = None) -> None:
        node = self.stack.pop()
        node.last = len(self.nodes) - 1
        node.text_end = max(node.text, self.length)
        node.inner_end, node.outer_end = inner_end, inner_end if outer_end is None else outer_end

    def _head(self, at: int) -> None:
        if len(self.nodes) == 1:
            self._push("html", [], at, at)
        if not self.body and self.stack[-1].tag == "html" and self.stack[-1].count == 0:
            self._push("head", [], at, at)

    def _body(self, at: int) -> None:
        if self.body:
            return
        self._head(at)
        while self.stack[-1].tag != "html":
            self._pop(at)
        self._push("body", [], at, at)
        self.body = True

    def _end_open(self, ends: frozenset | set, stops: frozenset | set, at: int) -> None:
        """Close the innermost open tag of ``ends`` unless one of ``stops`` is met first."""
        for depth in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[depth].tag
            if tag in ends:
                while len(self.stack) > depth:
                    self._pop(at)
                return
            if tag in stops:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        start = self._at()
        inner = start + len(self.get_starttag_text() or "")
        first: dict[str, str] = {}
        for name, value in attrs:
            first.setdefault(name, value or "")
        pairs = list(first.items())
        if tag == "html":
            if len(self.nodes) == 1:
                self._push("html", pairs, start, inner)
            return
        if tag == "head":
            if len(self.nodes) == 1:
                self._push("html", [], start, start)
            if not self.body and self.stack[-1].tag == "html" and self.stack[-1].count == 0:
                self._push("head", pairs, start, inner)
            return
        if tag == "body":
            if not self.body:
                self._body(start)
                self.stack[-1].attrs, self.stack[-1].inner = pairs, inner
            return
        if not self.body:
            if tag in HEAD_ONLY:
                self._head(start)
            else:
                self._body(start)
        if tag in CLOSES_P:
            self._end_open({"p"}, SCOPE, start)
        if tag in ENDS:
            self._end_open(*ENDS[tag], start)
        self._push(tag, pairs, start, inner)
        if tag in VOID:
            self._pop(inner)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        # A slash ends void elements only; elsewhere it means nothing in HTML.
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body") or tag in VOID:
            return
        at = self._at()
        tags = [n.tag for n in self.stack]
        for depth in range(len(tags) - 1, 0, -1):
            if tags[depth] == tag:
                while len(self.stack) > depth + 1:
                    self._pop(at)
                close = self.html.find(">", at)
                self._pop(at, close + 1 if close >= 0 else self.size)
                return
            if tag in FORMATTING and tags[depth] in CLOSES_P:
                return
            if tags[depth] in CELL and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                return

    def handle_data(self, data: str) -> None:
        if not self.body and self.stack[-1].tag in ("#document", "html", "head"):
            if not data.strip():
                return
            self._body(self._at())
        data, owner = data.replace(NUL, ""), self.stack[-1]
        # Pieces of one text node arrive in a row when no element came between.
        if self.text_owner == (owner.id, len(self.nodes)):
            self.texts[-1] += data
            owner.own[-1] += data
            self.length += len(data)
            return
        self.text_owner = (owner.id, len(self.nodes))
        if self.texts:
            self.length += 1
        self.texts.append(data)
        owner.own.append(data)
        self.length += len(data)


def html_nodes(pages: DataFrame) -> DataFrame:
    """``pages``: page_id, html → node table."""
    short_batches(pages.sparkSession)
    key_type = pages.schema["page_id"].dataType.simpleString()
    text, whole = pa.string(), pa.int32()
    types = [whole] * 8 + [text, pa.map_(text, text), pa.list_(whole), text, text] + [whole] * 6
    names = [field.split()[0] for field in NODE_SCHEMA.replace("map<string,string>", "map").split(", ")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for key, html in zip(batch.column("page_id"), batch.column("html")):
                found = _Builder(html.as_py() or "").rows()
                keys.extend([key.as_py()] * len(found))
                rows.extend(found)
                if len(rows) > BATCH_NODES:
                    yield _batch(keys, rows, batch.schema.field("page_id").type)
                    keys, rows = [], []
            if rows:
                yield _batch(keys, rows, batch.schema.field("page_id").type)

    def _batch(keys: list, rows: list, key_arrow: pa.DataType) -> pa.RecordBatch:
        columns = [pa.array(keys, key_arrow)] + [pa.array(c, t) for c, t in zip(zip(*rows), types)]
        return pa.RecordBatch.from_arrays(columns, ["page_id", *names])

    return pages.select("page_id", "html").mapInArrow(parse, f"page_id {key_type}, {NODE_SCHEMA}")


def html_tokens(pages: DataFrame) -> DataFrame:
    """page_id, pos, kind, token: comments, script and style blocks, tags and text, in order (native)."""
    pattern = r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>|<[^>]+>|[^<]+"
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(pattern), F.lit(0))).alias("pos", "token"))
    kind = (
        F.when(F.col("token").startswith("<!--"), "comment")
        .when(F.col("token").rlike(r"(?i)^<(?:script|style)\b"), "block")
        .when(F.col("token").startswith("<"), "tag")
        .otherwise("text")
    )
    return rows.select("page_id", F.col("pos").cast("bigint").alias("pos"), kind.alias("kind"), "token")


def root_context(pages: DataFrame) -> DataFrame:
    """Selection start of each page: the document node."""
    zero = F.lit(0)
    return pages.select("page_id", zero.cast("bigint").alias("ctx_id"), zero.alias("node_id"), zero.cast("bigint").alias("ord"))
