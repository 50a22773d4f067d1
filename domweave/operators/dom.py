"""Pages to element rows.

``parse_pages`` adds one struct column per page (text and element array) with an
Arrow UDF, the only engine-side Python in this package.  Everything that looks at
elements afterwards is column work on that array: ``elements`` unnests it, and
``above_sql`` finds containing elements by array lookups inside the row, so neither
selectors nor item scoping need a join or a shuffle.
"""

from __future__ import annotations

import gc
import html as _entities
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html.entities import html5
from itertools import accumulate, chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from domweave.functions.selectors import some_ancestor_sql
from domweave.functions.text import BLANK

ELEMENT_FIELDS = {
    "node_id": "int",  # pre-order number
    "last_id": "int",  # node_id of the last descendant
    "parent_id": "int",
    "depth": "int",
    "tag": "string",
    "parent_tag": "string",
    "id": "string",
    "class": "string",
    "classes": "array<string>",
    "attrs": "map<string,string>",
    "child_index": "int",
    "type_index": "int",  # 1-based among siblings of the same tag
    "type_count": "int",
    "n_children": "int",
    "own_text": "string",
    "text_length": "int",  # characters of the subtree's text
    "text_start": "int",  # byte range of the subtree in doc_text
    "text_end": "int",
    "trim_start": "int",  # the same without outer blanks
    "trim_end": "int",
    "html_start": "int",  # byte range between the tags in the source
    "html_end": "int",
}
ELEMENT_TYPE = "struct<" + ",".join(f"{n}:{t}" for n, t in ELEMENT_FIELDS.items()) + ">"
DOM_TYPE = f"struct<parse_error:string,doc_text:string,nodes:array<{ELEMENT_TYPE}>>"

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("script style iframe xmp noembed noframes".split())
ESCAPABLE_TEXT = frozenset("title textarea".split())
HEAD_ONLY = frozenset("base link meta title script style noscript template".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section "
    "summary table ul li dd dt".split()
)
# new tag -> (tags it ends, tags that stop the search)
IMPLIED_END = {
    "li": ("li", "ul ol menu"),
    "dd": ("dd dt", "dl"),
    "dt": ("dd dt", "dl"),
    "option": ("option", "select datalist optgroup"),
    "optgroup": ("option optgroup", "select"),
    "td": ("td th", "table tr"),
    "th": ("td th", "table tr"),
    "tr": ("tr", "table"),
    "thead": ("thead tbody tfoot caption colgroup", "table"),
    "tbody": ("thead tbody tfoot caption colgroup", "table"),
    "tfoot": ("thead tbody tfoot caption colgroup", "table"),
}
IMPLIED_END = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in IMPLIED_END.items()}
SCOPE = frozenset("table td th caption template html button object".split())
TABLE_PARTS = frozenset("table thead tbody tfoot tr td th caption".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
SPECIAL = CLOSES_P | SCOPE | frozenset("tr thead tbody tfoot body head select".split())

#: What separates classes in HTML; other blanks, such as the no-break space, belong to a class.
_BLANKS = re.compile(r"[ \t\n\f\r]+")
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*>"
    r"|<(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>"
    r"|<(?P<unclosed>[!?]|/?[a-zA-Z])",
    re.S,
)
_ATTR = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)
_REFERENCE = re.compile(r"&(?:#\w+;?|[A-Za-z0-9]+;|([A-Za-z0-9]+)(?!=))")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW_TEXT | ESCAPABLE_TEXT}
_BLANK_SET = frozenset(BLANK)
_NON_BLANK = re.compile(f"[^{BLANK}]")


def _attribute_value(raw: str) -> str:
    """Decoded attribute value; a name without its semicolon must be a whole, unassigned one."""
    if "&" not in raw:
        return raw
    return _REFERENCE.sub(
        lambda m: html5.get(m[1], m[0]) if m[1] else _entities.unescape(m[0]), raw
    )


@lru_cache(20_000)
def _known_attributes(raw: str) -> dict[str, str]:
    attrs = {}
    for name, *values in _ATTR.findall(raw):
        attrs.setdefault(name.lower(), _attribute_value("".join(values)))
    return attrs


def _attributes(raw: str) -> dict[str, str]:
    """Attributes of a tag by name; elements written alike share them, so they are never changed."""
    return _known_attributes(raw) if len(raw) <= 200 else _known_attributes.__wrapped__(raw)


class _Node:
    __slots__ = tuple("class_" if f == "class" else f for f in ELEMENT_FIELDS) + ("kinds",)


class _Builder:
    """Tree state while one page is read."""

    def __init__(self, source: str, script_text: bool):
        self.source, self.script_text = source, script_text
        self.nodes, self.stack, self.text, self.size = [], [], [], 0
        self.depths = defaultdict(list)  # of the open elements by tag, so that no search walks the stack

    def open(self, tag, attrs, at):
        nodes, stack = self.nodes, self.stack
        node = _Node()
        node.node_id, node.depth, node.tag, node.attrs = len(nodes), len(stack), tag, attrs
        node.id, node.class_, node.classes = None, None, ()
        if attrs:
            node.id, classes = attrs.get("id"), attrs.get("class")
            if classes:
                node.classes = [c for c in _BLANKS.split(classes) if c]
            node.class_ = classes
        node.kinds, node.own_text, node.n_children = None, "", 0
        if stack:
            parent = stack[-1]
            kinds = parent.kinds
            if kinds is None:
                kinds = parent.kinds = {}
            node.parent_id, node.parent_tag, node.child_index = parent.node_id, parent.tag, parent.n_children
            node.type_index = kinds[tag] = kinds.get(tag, 0) + 1
            parent.n_children += 1
        else:
            node.parent_id, node.parent_tag, node.child_index, node.type_index = None, None, 0, 1
        node.text_start, node.html_start = self.size, at
        nodes.append(node)
        self.depths[tag].append(len(stack))
        stack.append(node)

    def close(self, at, depth=None):
        """Close open elements until ``depth`` of them are left (default: the innermost)."""
        stack, last = self.stack, len(self.nodes) - 1
        for _ in range(1 if depth is None else len(stack) - depth):
            node = stack.pop()
            self.depths[node.tag].pop()
            node.last_id, node.text_end = last, self.size
            node.html_end = at if at > node.html_start else node.html_start

    def close_to(self, tags, stops, at):
        """End the innermost open element in ``tags``, unless one in ``stops`` is nearer."""
        inner = self.stack[-1].tag if self.stack else None
        if len(self.stack) > 2 and inner in tags:
            self.close(at)
            return True
        if inner in stops:
            return False
        depths = self.depths
        hit = max((depths[t][-1] for t in tags if depths.get(t)), default=0)
        if hit < 2 or any(depths[t][-1] > hit for t in stops if depths.get(t)):
            return False
        self.close(at, hit)
        return True

    @property
    def in_body(self):
        return len(self.stack) > 1 and self.stack[1].tag == "body"

    def ensure(self, part, at, attrs=None):
        """html, head and body exist once in every page, written or not."""
        if not self.nodes:
            self.open("html", attrs if part == "html" and attrs else {}, at)
        if part != "html" and len(self.nodes) == 1:
            self.open("head", attrs if part == "head" and attrs else {}, at)
        if part == "body" and not self.in_body:
            self.close(at, 1)
            self.open("body", attrs or {}, at)

    def add_text(self, piece, at):
        if "\r" in piece:
            piece = piece.replace("\r\n", "\n").replace("\r", "\n")
        if not self.in_body and len(self.stack) < 3:
            if not _NON_BLANK.search(piece):
                return
            self.ensure("body", at)
        node = self.stack[-1]
        if not node.own_text:
            node.own_text = piece
        elif isinstance(node.own_text, list):
            node.own_text.append(piece)
        else:
            node.own_text = [node.own_text, piece]
        self.text.append(piece)
        self.size += len(piece)

    def start_tag(self, tag, raw_attrs, begin, at):
        """Open an element; true if its contents are raw text."""
        attrs = _attributes(raw_attrs) if raw_attrs else {}
        if tag in ("html", "head", "body"):
            self.ensure(tag, at, attrs)
            return False
        self.ensure("head" if tag in HEAD_ONLY and not self.in_body else "body", begin)
        if tag in CLOSES_P and self.depths.get("p"):
            self.close_to(("p",), SCOPE, begin)
        if tag in IMPLIED_END:
            self.close_to(*IMPLIED_END[tag], begin)
        if tag == "tr" and self.stack[-1].tag == "table":
            self.open("tbody", {}, begin)
        self.open(tag, attrs, at)
        if tag in VOID:
            self.close(at)
        return tag in _RAW_END

    def end_tag(self, tag, at):
        if tag in ("head", "html", "body"):
            return
        if tag in TABLE_PARTS:
            stops = ("table", "template")
        elif tag in SPECIAL or tag in FORMATTING or tag == "p":
            stops = SCOPE
        else:
            stops = SPECIAL
        if not self.close_to((tag,), stops, at) and tag == "p":
            self.start_tag("p", "", at, at)
            self.close(at)

    def run(self):
        source, at, unescape = self.source, 0, _entities.unescape
        tokens = _TOKEN.finditer(source)
        while (m := next(tokens, None)) and (kind := m.lastgroup) != "unclosed":
            # an unclosed tag has no end up to the end of the page: the rest is text, and is read once
            begin, end = m.span()
            if begin > at:
                self.add_text(unescape(source[at:begin]), at)
            at = end
            if kind == "attrs":
                tag, raw_attrs = m.group("tag", "attrs")
                tag = tag.lower()
                if self.start_tag(tag, raw_attrs, begin, at):
                    end = _RAW_END[tag].search(source, at)
                    stop = end.start() if end else len(source)
                    if tag in ESCAPABLE_TEXT:
                        self.add_text(unescape(source[at:stop]), at)
                    elif self.script_text and stop > at:
                        self.add_text(source[at:stop], at)
                    self.close(stop)
                    at = (source.find(">", stop) + 1 or len(source)) if end else stop
                    tokens = _TOKEN.finditer(source, at)
            elif kind:
                self.end_tag(m["end"].lower(), begin)
        if at < len(source):
            self.add_text(_entities.unescape(source[at:]), at)
        self.ensure("body", len(source))
        self.close(len(source), 0)
        return self.finish()

    def finish(self):
        doc, blank = "".join(self.text), _BLANK_SET
        for node in self.nodes:
            text = node.own_text
            if isinstance(text, list):
                text = node.own_text = "".join(text)
            if text and (text[0] in blank or text[-1] in blank):
                node.own_text = text.strip(BLANK)
            node.type_count = 1 if node.parent_id is None else self.nodes[node.parent_id].kinds[node.tag]
            start, end = node.text_start, node.text_end
            node.text_length = end - start
            if start < end and (doc[start] in blank or doc[end - 1] in blank):
                if first := _NON_BLANK.search(doc, start, end):
                    start = first.start()
                    while not (tail := doc[max(start, end - 64) : end].rstrip(BLANK)):
                        end -= 64
                    end = max(start, end - 64) + len(tail)
                else:
                    end = start
            node.trim_start, node.trim_end = start, end
        return doc, self.nodes


def _byte_offsets(text):
    """Byte offset in UTF-8 of every character place; None where the two are the same."""
    if text.isascii():
        return None
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    widths = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    return [0, *np.cumsum(widths).tolist()]


def _to_bytes(nodes, source, doc):
    """Turn the character ranges of a page's elements into byte ranges: slices of binary cost their own length only."""
    if at := _byte_offsets(doc):
        for node in nodes:
            node.text_start, node.text_end = at[node.text_start], at[node.text_end]
            node.trim_start, node.trim_end = at[node.trim_start], at[node.trim_end]
    if at := _byte_offsets(source):
        for node in nodes:
            node.html_start, node.html_end = at[node.html_start], at[node.html_end]


def _nested(rows, inner):
    """Arrow list array from Python lists and the function that packs their flat contents."""
    offsets, flat = [0, *accumulate(map(len, rows))], list(chain.from_iterable(rows))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), inner(flat))


def _attr_maps(rows):
    offsets = [0, *accumulate(map(len, rows))]
    keys, values = list(chain.from_iterable(rows)), list(chain.from_iterable(map(dict.values, rows)))
    return pa.MapArray.from_arrays(
        pa.array(offsets, pa.int32()), pa.array(keys, pa.string()), pa.array(values, pa.string())
    )


_PACK = {
    "int": lambda c: pa.array(c, pa.int32()),
    "string": lambda c: pa.array(c, pa.string()),
    "array<int>": lambda c: _nested(c, _PACK["int"]),
    "array<string>": lambda c: _nested(c, _PACK["string"]),
    "map<string,string>": _attr_maps,
}


_row = attrgetter(*("class_" if f == "class" else f for f in ELEMENT_FIELDS))


def _element_array(nodes):
    columns = zip(*map(_row, nodes)) if nodes else ([] for _ in ELEMENT_FIELDS)
    return pa.StructArray.from_arrays(
        [_PACK[kind](column) for kind, column in zip(ELEMENT_FIELDS.values(), columns)], names=list(ELEMENT_FIELDS)
    )


#: Elements that a task holds as objects before it packs them: an object takes some ten times the packed form.
HELD_ELEMENTS = 10_000


def _packed_pages(pages: pa.Array, script_text: bool) -> Iterator[pa.Array]:
    """The parsed pages, packed whenever ``HELD_ELEMENTS`` elements have come together."""
    errors, docs, trees, held = [], [], [], 0

    def pack():
        out = pa.StructArray.from_arrays(
            [pa.array(errors, pa.string()), pa.array(docs, pa.string()), _nested(trees, _element_array)],
            names=["parse_error", "doc_text", "nodes"],
        )
        for done in (errors, docs, trees):
            done.clear()
        return out

    collecting = gc.isenabled()
    gc.disable()  # many small, acyclic objects: collection passes would only cost time
    try:
        for page in pages:
            source = page.as_py() or ""
            try:
                doc, nodes = _Builder(source, script_text).run()
                _to_bytes(nodes, source, doc)
                error = None
            except Exception as failure:  # one bad page must not fail the job
                doc, nodes, error = "", [], f"{type(failure).__name__}: {failure}"
            errors.append(error)
            docs.append(doc)
            trees.append(nodes)
            held += len(nodes)
            if held >= HELD_ELEMENTS:
                held, nodes = 0, None
                yield pack()
        if trees or not len(pages):
            yield pack()
    finally:
        if collecting:
            gc.enable()


def _parser(script_text: bool):
    """Batch by batch, for SQL."""
    def parse(pages: pa.Array) -> pa.Array:
        return pa.concat_arrays(list(_packed_pages(pages, script_text)))

    # Non-deterministic only so that the optimizer never copies the call into a pushed filter.
    return F.arrow_udf(parse, DOM_TYPE).asNondeterministic()


def _stream_parser(script_text: bool):
    """Pages are handed on as soon as they are packed: a task never holds the elements of a whole batch."""
    def parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            yield from _packed_pages(pages, script_text)

    return F.arrow_udf(parse, DOM_TYPE).asNondeterministic()


def parse_pages(pages: DataFrame, html: str = "html", script_text: bool = True) -> DataFrame:
    """Add ``parse_error``, ``doc_text`` and ``nodes`` to a page table.

    Filter and prune ``pages`` before the call: the UDF is a barrier for both.
    ``script_text=False`` leaves the contents of script and style out of the text.
    """
    return pages.withColumn("dom", _stream_parser(script_text)(F.col(html))).select(*pages.columns, "dom.*")


class _ElementRows:
    """Elements of one page as rows of a table function."""

    def eval(self, html: str | None):
        source = html or ""
        doc, nodes = _Builder(source, True).run()
        for n in nodes:
            yield n.node_id, n.parent_id, n.depth, n.tag, n.id, n.attrs, n.own_text, doc[n.trim_start : n.trim_end]


ELEMENT_ROW = "node_id int, parent_id int, depth int, tag string, id string, attrs map<string,string>, own_text string, text string"


def register_sql(spark: SparkSession, name: str = "parse_html", table_function: str = "page_elements") -> None:
    """Make the parser callable from SQL.

    As a function, ``inline(parse_html(html).nodes)``, and as a table function for lateral joins, ``FROM pages, LATERAL page_elements(html)``,
    whose rows carry their texts.  The function is faster; the table function reads better.
    """
    spark.udf.register(name, _parser(True))
    spark.udtf.register(table_function, F.udtf(_ElementRows, returnType=ELEMENT_ROW, useArrow=True))


def unnest(dom: DataFrame, rows: Column, *keep: str) -> DataFrame:
    """One row per struct in ``rows``.

    The outer form plus a filter is used because for the inner form the optimizer
    infers ``size(rows) > 0`` below the generator and so computes ``rows`` twice.
    Page texts among ``keep`` become binary, once per page, so that the cuts of their
    elements are byte slices.
    """
    binary = {c: F.col(c).cast("binary") for c in ("doc_text", "html") if c in keep}
    out = dom.withColumns(binary).select(*keep, F.inline_outer(rows))
    first = [c for c in out.columns if c not in keep][0]
    return out.where(F.col(first).isNotNull())


def elements(dom: DataFrame, *keep: str) -> DataFrame:
    """The element table: one row per element, in document order within a page."""
    return unnest(dom, F.col("nodes"), *(keep or ("page_id",)))


def _slice_sql(text: str, start: str, end: str, most: int | None = None) -> str:
    size = f"{end} - {start}" if most is None else f"least({end} - {start}, {most})"
    return f"cast(substring(cast({text} AS BINARY), {start} + 1, {size}) AS STRING)"


def text_sql(node: str = "", raw: bool = False) -> str:
    """SQL for the text of a whole subtree (trimmed unless ``raw``), cut from the page's text."""
    at, kind = f"{node}." if node else "", "text" if raw else "trim"
    return _slice_sql("doc_text", f"{at}{kind}_start", f"{at}{kind}_end")


def text_head_sql(length: int, node: str = "") -> str:
    """SQL for the first ``length`` characters of a trimmed text; a character has four bytes at most."""
    at = f"{node}." if node else ""
    return f"substring({_slice_sql('doc_text', f'{at}trim_start', f'{at}trim_end', 4 * length)}, 1, {length})"


def text_of(raw: bool = False) -> Column:
    return F.expr(text_sql("", raw))


def inner_html() -> Column:
    """Source between the start and the end tag."""
    return F.expr(_slice_sql("html", "html_start", "html_end"))


def above_sql(container, node: str = "n", within=None) -> str:
    """SQL for the ids of the proper ancestors of ``node`` that match ``container``, outermost first.

    With ``within``, only those with an element between them and ``node`` that matches it.
    """
    hit = container.sql("get(nodes, up.at)")
    if within:
        hit += f" AND {some_ancestor_sql(f'{node}.', 'mid', lambda mid: f'{mid}.node_id > up.at AND {within.sql(mid)}')}"
    return (
        f"aggregate(array_repeat(0, {node}.depth), named_struct('at', {node}.parent_id, 'hits', cast(array() AS array<int>)), "
        f"(up, k) -> named_struct('at', get(nodes, up.at).parent_id, 'hits', if({hit}, concat(array(up.at), up.hits), up.hits)), "
        "up -> up.hits)"
    )
