"""Elements and text nodes of HTML pages.

The parser is the one Python stage here. It gives one row for each page: the page's text once, and its elements with their places in
it. Whole texts and selectors are taken from these by Column expressions, only where a plan reads them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.functions.text import JS_SPACE_CHARS, js_trim

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Open tags that a new tag of a kind closes.
IMPLIED_END = {"li": {"li"}, "p": {"p"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Tags that end an open paragraph.
BLOCKS = {"div", "ul", "ol", "table", "article", "footer", "nav", "section", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "main", "pre", "blockquote", "p"}
UNREAD = {"script", "style", "noscript", "template", "title"}
#: The mark of an element whose shadow root cannot be read, and the name under which an open shadow root is held.
CLOSED_HOST, SHADOW = "data-closed-shadow-host", "#shadow"

#: Bytes of HTML whose rows go out together; a larger page goes alone.
SLICE_BYTES = 1 << 20

_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
#: An element: its parent's number, its places in the page's bytes, what an input or placeholder shows, and a select's chosen option.
ELEMENT = (
    "node_idx int, parent_idx int, tag string, attrs map<string,string>, visible boolean, over int, steps int, start int, stop int, shown array<string>, chosen_start int, chosen_stop int"
)
PAGE = f"page_id long, body binary, elements array<struct<{ELEMENT}>>, pieces array<string>, overs array<int>, texts array<struct<parent_idx int, start int, stop int>>, error string"


class _Root:
    """A tree of its own: the document or the shadow root of a host. Its text lies end to end in pieces."""

    def __init__(self, host: _Node | None = None, hidden: bool = False):
        self.host, self.hidden = host, hidden
        self.nodes: list[_Node] = []
        self.pieces: list[bytes] = []
        self.size = 0
        self.texts: list[tuple[_Node, int, int]] = []
        self.counts: dict[str, int] = {}


class _Node:
    """An element. start and stop are places in its root's bytes of text; nth counts siblings of its tag from 1.

    Its selector is that of the element over it, if any, and its own piece after that; steps elements are over it.
    """

    __slots__ = ("attrs", "children", "counts", "idx", "nth", "over", "parent", "piece", "root", "shadow", "start", "steps", "stop", "tag", "visible")

    def __init__(self, tag: str, attrs: dict[str, str], parent: _Node | None, root: _Root):
        self.tag, self.attrs, self.parent, self.root = tag, attrs, parent, root
        self.children: list[_Node] = []
        self.counts: dict[str, int] = {}
        self.shadow: _Root | None = None
        self.idx, self.piece, self.start, self.stop = -1, "", root.size, -1
        self.over: _Node | None = None
        self.steps = 0
        owner = root.counts if parent is None or parent is root.host else parent.counts
        self.nth = owner[tag] = owner.get(tag, 0) + 1
        hidden = "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or tag == "input" and attrs.get("type", "").lower() == "hidden"
        self.visible = not (hidden or _HIDDEN.search(attrs.get("style", ""))) and (parent is None or parent.visible)


class _Tree(HTMLParser):
    """Open elements, each with the root that what it holds goes to."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.roots = [_Root()]
        self.open: list[tuple[str, _Node | None, _Root]] = []
        self.named: dict[str, int] = {}  # how many open elements have a name

    def _push(self, tag: str, node: _Node | None, root: _Root) -> None:
        self.open.append((tag, node, root))
        self.named[tag] = self.named.get(tag, 0) + 1

    def _pop(self) -> str:
        tag, node, _ = self.open.pop()
        self.named[tag] -= 1
        if node is not None and node.stop < 0 and tag == node.tag:
            node.stop = node.root.size
        return tag

    def handle_starttag(self, tag: str, attrs: list) -> None:
        closes = IMPLIED_END.get(tag, set()) | ({"p"} if tag in BLOCKS else set())
        while self.open and self.open[-1][0] in closes:
            self._pop()
        parent, root = (self.open[-1][1], self.open[-1][2]) if self.open else (None, self.roots[0])
        values: dict[str, str] = {}
        for k, v in attrs:
            values.setdefault(k, v or "")
        mode = values.get("shadowrootmode", "").lower()
        if tag == "template" and parent is not None and mode in ("open", "closed") and parent.shadow is None and not root.hidden:
            parent.shadow = _Root(parent, hidden=mode == "closed")
            if mode == "closed":
                parent.attrs = {**parent.attrs, CLOSED_HOST: "1"}
            else:
                self.roots.append(parent.shadow)
            self._push(SHADOW, parent, parent.shadow)
            return
        node = _Node(tag, values, parent, root)
        if not root.hidden:
            root.nodes.append(node)
            if parent is not None and parent.root is root:
                parent.children.append(node)
        if tag in VOID:
            node.stop = node.start
        else:
            self._push(tag, node, _Root(node, hidden=True) if tag == "template" else root)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if self.open and self.open[-1][0] == tag and tag not in VOID:
            self._pop()

    def handle_endtag(self, tag: str) -> None:
        names = {tag, SHADOW} if tag == "template" else {tag}
        if any(self.named.get(t) for t in names):
            while self._pop() not in names:
                pass

    def handle_data(self, data: str) -> None:
        if self.open and not self.open[-1][2].hidden:
            _, node, root = self.open[-1]
            raw = data.encode("utf-8", "replace")
            root.pieces.append(raw)
            root.size += len(raw)
            if data.strip(JS_SPACE_CHARS):
                root.texts.append((node, root.size - len(raw), root.size))

    def finish(self) -> None:
        """Close what is open; number the elements, the document's before those of shadow roots, and name them by selectors."""
        self.close()
        while self.open:
            self._pop()
        n, k = 0, 0
        order = [self.roots[0]]
        while k < len(order):
            root = order[k]
            k += 1
            for node in root.nodes:
                node.idx, n = n, n + 1
                _name(node)
                if node.shadow is not None and not node.shadow.hidden:
                    order.append(node.shadow)
        self.roots = order


def _identifier(name: str) -> str:
    """The name as an identifier of a selector."""
    out = [c if c.isalnum() or c in "-_" or ord(c) > 127 else f"\\{ord(c):x} " if ord(c) < 32 or ord(c) == 127 else f"\\{c}" for c in name]
    digit = 1 if name[:1] == "-" else 0
    if name[digit : digit + 1].isdigit() and name[digit].isascii():
        out[digit] = f"\\{ord(name[digit]):x} "
    return "\\-" if name == "-" else "".join(out)


def _name(node: _Node) -> None:
    """The node's piece of a selector and the element over it: its path begins at the nearest element with an id."""
    root, parent = node.root, node.parent
    top = parent is None or parent is root.host
    host = root.host
    if node.attrs.get("id"):
        node.piece, node.over = f"#{_identifier(node.attrs['id'])}", host
    elif node.tag == "html":
        node.piece, node.over = "html", host
    else:
        same = (root.counts if top else parent.counts)[node.tag]
        node.piece = node.tag if same == 1 or parent is None else f"{node.tag}:nth-of-type({node.nth})"
        node.over = host if top or parent.tag == "html" and not parent.attrs.get("id") else parent
    if node.over is not None:
        node.piece = (" ::shadow " if node.over is host else " > ") + node.piece
        node.steps = node.over.steps + 1


def _chosen(node: _Node) -> _Node | None:
    """A select's chosen option, the first one if none is."""
    options = [n for n in node.children if n.tag == "option"] + [o for g in node.children if g.tag == "optgroup" for o in g.children if o.tag == "option"]
    return next((o for o in options if "selected" in o.attrs), options[0] if options else None)


class _Rows:
    """Columns of PAGE, filled page by page."""

    def __init__(self) -> None:
        self.pages: list[tuple[int | None, bytes | None, str | None]] = []
        self.elements: list[tuple] = []
        self.texts: list[tuple[int, int, int]] = []
        self.ends: list[tuple[int, int]] = []

    def add(self, page_id: int | None, html: str | None) -> None:
        elements, texts, body, error = [], [], b"", None
        try:
            tree = _Tree()
            tree.feed(html or "")
            tree.finish()
            pieces, at = [], 0
            for root in tree.roots:
                for n in root.nodes:
                    shown = [v for v in ((n.attrs.get("value", "") if n.tag == "input" else ""), n.attrs.get("placeholder", "")) if v] if n.tag in ("input", "textarea") else []
                    chosen = _chosen(n) if n.tag == "select" else None
                    elements.append((n.idx, n.parent.idx if n.parent else None, n.tag, n.attrs, n.visible, n.piece, n.over.idx if n.over else None, n.steps, at + n.start, at + n.stop, shown, *((at + chosen.start, at + chosen.stop) if chosen else (None, None))))
                texts += [(n.idx, at + start, at + stop) for n, start, stop in root.texts if n.tag not in UNREAD]
                pieces += root.pieces
                at += root.size
            body = b"".join(pieces)
        except Exception as e:  # a page that the parser fails on is reported as such
            elements, texts, body, error = [], [], None, type(e).__name__
        self.elements += elements
        self.texts += texts
        self.pages.append((page_id, body, error))
        self.ends.append((len(self.elements), len(self.texts)))

    def batch(self) -> pa.RecordBatch:
        ends = np.array([(0, 0), *self.ends], np.int32)
        columns = list(zip(*self.elements, strict=True)) if self.elements else [()] * 13
        idx, parent, tag, attrs, visible, piece, over, steps, start, stop, shown, chosen_start, chosen_stop = columns
        keys = [k for a in attrs for k in a]
        maps = pa.MapArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(a) for a in attrs])]).astype(np.int32)), pa.array(keys, pa.string()), pa.array([v for a in attrs for v in a.values()], pa.string()))
        ints = {n: pa.array(c, pa.int32()) for n, c in (("node_idx", idx), ("parent_idx", parent), ("over", over), ("steps", steps), ("start", start), ("stop", stop), ("chosen_start", chosen_start), ("chosen_stop", chosen_stop))}
        fields = {"tag": pa.array(tag, pa.string()), "attrs": maps, "visible": pa.array(visible, pa.bool_()), "shown": pa.array(shown, pa.list_(pa.string())), **ints}
        names = [c.split()[0] for c in ELEMENT.split(", ")]
        structs = pa.StructArray.from_arrays([fields[n] for n in names], names=names)
        of_page, of_text = pa.array(ends[:, 0]), pa.array(ends[:, 1])
        texts = np.array(self.texts, np.int32).reshape(-1, 3)
        texts = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(texts[:, k])) for k in range(3)], names=["parent_idx", "start", "stop"])
        page_ids, bodies, errors = zip(*self.pages, strict=True)
        return pa.RecordBatch.from_arrays([
            pa.array(page_ids, pa.int64()), pa.array(bodies, pa.binary()), pa.ListArray.from_arrays(of_page, structs), pa.ListArray.from_arrays(of_page, pa.array(piece, pa.string())),
            pa.ListArray.from_arrays(of_page, fields["over"]), pa.ListArray.from_arrays(of_text, texts), pa.array(errors, pa.string()),
        ], names=["page_id", "body", "elements", "pieces", "overs", "texts", "error"])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, size = _Rows(), 0
        for page_id, html in zip(batch.column("page_id"), batch.column("html"), strict=True):
            html = html.as_py()
            rows.add(page_id.as_py(), html)
            size += len(html or "")
            if size >= SLICE_BYTES:
                yield rows.batch()
                rows, size = _Rows(), 0
        if rows.pages:
            yield rows.batch()


def parse_pages(pages: DataFrame) -> DataFrame:
    """A row of PAGE for each page (page_id, html); error names what the parser failed with, null if it did not.

    elements come in document order, those of open declarative shadow roots after all others; a closed one is not read and
    marks its host CLOSED_HOST. What a plain template holds is not part of the page. body is the page's text, texts the
    non-blank runs of it whose parent shows text. A browser moves any text before or after body into it, so that none is
    outside. A null page is an empty one; pages without id are parsed alike. No text is cut.
    """
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(_parse, PAGE)


def body_text(body: Column, start: Column, stop: Column) -> Column:
    """The text between two places of a page's bytes."""
    return F.substring(body, start + 1, stop - start).cast("string")


def selector_of(pieces: Column, overs: Column, node_idx: Column, steps: Column) -> Column:
    """The selector of an element: the pieces from the topmost of those over it down to its own."""
    start = F.struct(F.get(overs, node_idx).alias("at"), F.get(pieces, node_idx).alias("path"))

    def up(a: Column, _: Column) -> Column:
        return F.struct(F.get(overs, a["at"]).alias("at"), F.concat(F.get(pieces, a["at"]), a["path"]).alias("path"))

    path = F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), start, up)["path"]
    return F.when(steps == 0, F.get(pieces, node_idx)).otherwise(path)


def chosen_text(body: Column, e: Column) -> Column:
    """The trimmed text of a select's chosen option; null for other elements and selects without options."""
    return F.when(e["chosen_start"].isNotNull(), js_trim(body_text(body, e["chosen_start"], e["chosen_stop"])))


def field_values(body: Column, e: Column) -> Column:
    """What a field shows: its value and placeholder, a textarea's text, or a select's chosen option."""
    own = F.when(e["tag"] == "textarea", body_text(body, e["start"], e["stop"])).when(e["tag"] == "select", chosen_text(body, e))
    return F.filter(F.concat(F.array(own), e["shown"]), lambda v: F.coalesce(v, F.lit("")) != "")


def extract_elements(parsed: DataFrame) -> DataFrame:
    e = F.col("e")
    rows = parsed.select("page_id", "body", "pieces", "overs", F.explode("elements").alias("e"))
    return rows.select(
        "page_id", "e.node_idx", "e.parent_idx", "e.tag", "e.attrs", "e.visible", selector_of(F.col("pieces"), F.col("overs"), e["node_idx"], e["steps"]).alias("selector"),
        field_values(F.col("body"), e).alias("field_values"), chosen_text(F.col("body"), e).alias("selected"), js_trim(body_text(F.col("body"), e["start"], e["stop"])).alias("text"),
    )


def extract_text_nodes(parsed: DataFrame) -> DataFrame:
    rows = parsed.select("page_id", "body", "elements", "pieces", "overs", F.posexplode("texts").alias("text_idx", "t"))
    rows = rows.withColumn("e", F.get("elements", F.col("t.parent_idx"))).drop("elements")
    selector = selector_of(F.col("pieces"), F.col("overs"), F.col("e.node_idx"), F.col("e.steps"))
    return rows.select("page_id", "text_idx", F.col("t.parent_idx").alias("parent_idx"), selector.alias("selector"), F.col("e.visible").alias("visible"), js_trim(body_text(F.col("body"), F.col("t.start"), F.col("t.stop"))).alias("text"), F.col("e.attrs")["data-agent-id"].alias("agent_id"))


def tag_attribute(raw: Column, name: str) -> Column:
    """A quoted attribute of a raw tag body, null if it has none."""
    found = F.regexp_extract(raw, rf'(?i)\s{name}\s*=\s*"([^"]*)"', 1)
    return F.when(raw.rlike(rf'(?i)\s{name}\s*=\s*"'), found)


def extract_tags(pages: DataFrame) -> DataFrame:
    """(page_id, tag_idx, tag, raw): opening tags with their raw attributes, without ancestry; no Python."""
    tags = F.regexp_extract_all("html", F.lit(r"<([a-zA-Z][a-zA-Z0-9]*)([^>]*)>"), F.lit(0))
    df = pages.select("page_id", F.posexplode(tags).alias("tag_idx", "whole"))
    part = r"^<([a-zA-Z][a-zA-Z0-9]*)([^>]*)>$"
    return df.select("page_id", "tag_idx", F.lower(F.regexp_extract("whole", part, 1)).alias("tag"), F.regexp_extract("whole", part, 2).alias("raw"))
