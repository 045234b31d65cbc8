"""One tokenising pass per page; everything else is a rule over its nodes.

:func:`nodes` turns a page into an array of nodes in document order::

    pos, last      place of the node, and of the last node inside it
    parent, ptag   place and tag of the parent element (-1, "" at the top)
    tag            lower-case tag, "#text" or "#comment"
    id, classes, attrs, text
    chars          length of its textContent
    inside, outer  sets (:mod:`.marks`) it stands in, and those whose outermost member it is

so a subtree is a slice, and "inside" a test of places or bits. Character references are decoded,
comments and script/style bodies are nodes of their own, attributes may be
quoted in any way, and tags that authors leave open are closed where HTML
closes them. The pass is a loop over tags: no depth breaks it.

The rules below are native columns. :func:`let` binds an intermediate array to
a lambda variable, so it is computed once per row however often a rule uses it.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.cascade import let
from ..functions.text import col
from . import marks

NODE_TYPE = ("array<struct<pos:int,last:int,parent:int,ptag:string,tag:string,id:string,"
             "classes:array<string>,attrs:map<string,string>,text:string,chars:int,inside:int,outer:int>>")
#: Characters of HTML whose nodes one task holds at a time, as Python objects and in Arrow form (one longer page stands alone).
PARSE_CHARS = 1 << 19

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
RCDATA = frozenset("title textarea".split())
#: A start tag closes an open element of these kinds, unless a barrier is between.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"),
          "option": ("option",)}
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
BARRIER = frozenset("ul ol dl table div section article main aside nav header footer form body html".split())
INLINE = frozenset("a abbr b bdi code em font i label mark q s small span strong sub sup u".split())

_MARKUP = re.compile(r"<!--(?P<comment>.*?)(?:-->|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_NO_ATTRS: dict = {}
_ATTR = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


def parse(page: str) -> list[list]:
    """Nodes as [last, parent, tag, attributes, text], in document order."""
    out: list[list] = []
    stack: list[int] = []

    def add(tag, attrs, text):
        out.append([len(out), stack[-1] if stack else -1, tag, attrs, text])
        return len(out) - 1

    def pop_to(depth):
        while len(stack) > depth:
            out[stack.pop()][0] = len(out) - 1

    def close(tags, barrier):
        for depth in range(len(stack) - 1, -1, -1):
            tag = out[stack[depth]][2]
            if tag in tags:
                pop_to(depth)
                return
            if tag in barrier:
                return

    at = 0
    while at < len(page):
        m = _MARKUP.search(page, at)
        text = page[at:m.start()] if m else page[at:]
        if text:
            add("#text", _NO_ATTRS, html_lib.unescape(text) if "&" in text else text)
        if m is None:
            break
        at = m.end()
        comment, closing, tag, written = m.groups()
        if comment is not None:
            add("#comment", _NO_ATTRS, comment)
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            if stack and out[stack[-1]][2] == tag:
                out[stack.pop()][0] = len(out) - 1
            else:
                close((tag,), BARRIER - {tag} if tag in INLINE else frozenset())
            continue
        if tag in CLOSES_P:
            close(("p",), BARRIER)
        if tag in CLOSES:
            close(CLOSES[tag], BARRIER)
        attrs = {} if written else _NO_ATTRS
        for name, a, b, c in _ATTR.findall(written):
            value = a or b or c
            attrs.setdefault(name.lower(), html_lib.unescape(value) if "&" in value else value)
        n = add(tag, attrs, None)
        if tag in RAW or tag in RCDATA:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            body = page[at:end.start() if end else len(page)]
            stack.append(n)
            if body:
                add("#text", _NO_ATTRS, html_lib.unescape(body) if tag in RCDATA else body)
            pop_to(len(stack) - 1)
            at = end.end() if end else len(page)
        elif tag not in VOID and not written.endswith("/"):
            stack.append(n)
    pop_to(0)
    return out


def _list_array(sizes, values):
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def _parts(pages: pa.Array) -> Iterator[pa.Array]:
    """Nodes of a batch of pages, some at a time."""
    start, size = 0, 0
    for i, chars in enumerate(pc.utf8_length(pages)):
        n = chars.as_py() or 0
        if i > start and size + n > PARSE_CHARS:
            yield _nodes_of(pages[start:i])
            start, size = i, 0
        size += n
    yield _nodes_of(pages[start:])


def _arrow_nodes(pages: pa.Array) -> pa.Array:
    """Nodes of a batch of pages."""
    return pa.concat_arrays(_parts(pages))


def _streamed_nodes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Each part leaves for Spark before the next one is parsed, so that a worker
    never holds the nodes of a whole batch of pages, in whatever form."""
    for pages in batches:
        yield from _parts(pages)


def _nodes_of(pages: pa.Array) -> pa.Array:
    found = [parse(p.as_py() or "") for p in pages]
    chars = [marks.lengths(page) for page in found]
    marked = [marks.mark(page, sizes) for page, sizes in zip(found, chars, strict=True)]
    rows = [(i, n, page) for page in found for i, n in enumerate(page)]
    strings = lambda v: pa.array(v, pa.string())
    ints = lambda v: pa.array(v, pa.int32())
    classes = [n[3].get("class", "").split() if n[3] else () for _, n, _ in rows]
    keys = [k for _, n, _ in rows for k in n[3]]
    attrs = pa.MapArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(n[3]) for _, n, _ in rows])]).astype(np.int32)),
                                    strings(keys), strings([v for _, n, _ in rows for v in n[3].values()]))
    struct = pa.StructArray.from_arrays(
        [ints([i for i, _, _ in rows]), ints([n[0] for _, n, _ in rows]), ints([n[1] for _, n, _ in rows]),
         strings([page[n[1]][2] if n[1] >= 0 else "" for _, n, page in rows]), strings([n[2] for _, n, _ in rows]),
         strings([n[3].get("id", "") if n[3] else "" for _, n, _ in rows]),
         _list_array([len(c) for c in classes], strings([x for c in classes for x in c])), attrs, strings([n[4] for _, n, _ in rows]),
         ints([c for sizes in chars for c in sizes]), ints([b for inside, _ in marked for b in inside]), ints([b for _, outer in marked for b in outer])],
        names=["pos", "last", "parent", "ptag", "tag", "id", "classes", "attrs", "text", "chars", "inside", "outer"])
    return _list_array([len(p) for p in found], struct)


_NODES_UDF = None


def nodes(html, parsed=None) -> Column:
    """The nodes of a page (NULL html: none); ``parsed``, if a page's row has them already."""
    if parsed is not None:
        return col(parsed)
    global _NODES_UDF
    from ..session import ensure_shipped
    ensure_shipped()
    if _NODES_UDF is None:
        _NODES_UDF = F.arrow_udf(_streamed_nodes, NODE_TYPE)
    return _NODES_UDF(col(html))


# ---- rules ----
_SELECTOR = re.compile(r'([a-z][a-z0-9-]*)?(?:\.([\w-]+)|#([\w-]+)|\[([\w-]+)(?:(\*?=)"([^"]*)")?\])?')


def matches(x: Column, selector: str) -> Column:
    """One simple CSS selector: tag, .class, #id, [attr], [attr="v"], [attr*="v"], or a tag with one of these."""
    tag, cls, ident, attr, op, value = _SELECTOR.fullmatch(selector).groups()
    found = []
    if tag:
        found.append(x["tag"] == tag)
    if cls:
        found.append(F.array_contains(x["classes"], cls))
    if ident:
        found.append(x["id"] == ident)
    if attr:
        v = F.element_at(x["attrs"], attr)
        test = v.isNotNull() if op is None else v == value if op == "=" else v.contains(value)
        found.append(F.coalesce(test, F.lit(False)))
    return reduce(lambda a, b: a & b, found)


def is_a(selector: str):
    """:func:`matches` as a rule of one node."""
    return lambda x: matches(x, selector)


def candidates(n: Column, selectors) -> Column:
    """The nodes that can match one of the selectors, in order: those with attributes, and those
    with the tag of a selector that asks for no attribute. Most nodes are neither."""
    tags = [s for s in selectors if re.fullmatch("[a-z][a-z0-9-]*", s)]
    return F.filter(n, lambda x: (F.size(x["attrs"]) > 0) | x["tag"].isin(tags) if tags else F.size(x["attrs"]) > 0)


def any_match(x: Column, selectors) -> Column:
    return reduce(lambda a, b: a | b, [matches(x, s) for s in selectors])


def inside(x: Column, mark: int) -> Column:
    """``x`` is a member of a set of :mod:`.marks`, or stands in one."""
    return x["inside"].bitwiseAND(F.lit(mark)) != 0


def outermost(x: Column, mark: int) -> Column:
    """``x`` is a member of a set and stands in no other member."""
    return x["outer"].bitwiseAND(F.lit(mark)) != 0


def part(n: Column, x: Column) -> Column:
    """Node ``x`` and all nodes inside it, taken by place: a slice would read the whole page for each part."""
    return F.transform(F.sequence(x["pos"], x["last"]), lambda i: F.get(n, i))


def texts_of(some: Column) -> Column:
    return F.transform(F.filter(some, lambda t: t["tag"] == "#text"), lambda t: t["text"])


def content(n: Column, x: Column) -> Column:
    """``textContent`` of node ``x``."""
    return F.array_join(texts_of(part(n, x)), "")


def body_nodes(n: Column) -> Column:
    """The nodes of the body; without a body element, all outside the head."""
    return let(F.filter(n, lambda x: x["tag"] == "body"), lambda b: F.when(F.size(b) > 0, part(n, b[0])).otherwise(
        F.filter(n, lambda x: ~inside(x, marks.HEAD))))


def each_text(n: Column, found: Column, keep) -> Column:
    """Texts of the nodes ``found`` that pass ``keep``, each followed by a space."""
    return F.array_join(F.transform(F.filter(F.transform(found, lambda x: content(n, x)), keep), lambda t: F.concat(t, F.lit(" "))), "")

