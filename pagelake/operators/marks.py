"""Interval marks of a page's nodes: what each node stands in, and its text's length.

The rules of :mod:`.dom` ask again and again whether a node is inside a
navigation bar, a boilerplate part or another block. Searching all ranges for
each node takes time quadratic in the page. Here one walk in document order
answers all of them at once: a node stands in whatever its parent stands in,
and in the sets it belongs to itself. The sets are bits of one integer, so that
a rule is a bit test, and the walk is linear for any depth.

``chars`` is the length of a node's ``textContent``, as a difference of the
running total over text nodes at its start and its end.
"""

from __future__ import annotations

import re
from functools import lru_cache

from ..functions import lexicons as L

BLOCK_TAGS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "pre", "blockquote", "dd", "dt")
BOILER_TAGS = ("nav", "header", "footer", "aside", "script", "style", "noscript", "form", "iframe", "svg", "button", "select")
BOILER_WORDS = r"(?i)(?:^|[\s_-])(?:ads?|advert\w*|menu|nav\w*|sidebar|footer|comments?|share|social|cookie\w*|banner)(?:$|[\s_-])"

HEAD, BOILER, BLOCK, SKIP, TARGET_SKIP, EDU_SKIP = (1 << i for i in range(6))
#: Sets that are asked for within the body only: what stands around the body does not count.
OF_BODY = BOILER | BLOCK | SKIP

_SIMPLE = re.compile(r"([a-z][a-z0-9-]*)|\.([\w-]+)|#([\w-]+)")
_WORDS = re.compile(BOILER_WORDS)
_HIDDEN = re.compile("display:none|visibility:hidden")


def _lookup(sets: dict[int, tuple]) -> tuple[dict, dict, dict]:
    """Bits by tag, class and id, of sets given as lists of a tag, .class or #id each."""
    by = ({}, {}, {})
    for bit, selectors in sets.items():
        for s in selectors:
            for table, name in zip(by, _SIMPLE.fullmatch(s).groups(), strict=True):
                if name:
                    table[name] = table.get(name, 0) | bit
    return by


_TAGS, _CLASSES, _IDS = _lookup({HEAD: ("head",), BOILER: BOILER_TAGS, BLOCK: BLOCK_TAGS, SKIP: tuple(L.READABLE_SKIP),
                                 TARGET_SKIP: tuple(L.TARGET_SKIP), EDU_SKIP: tuple(L.EDU_SKIP)})


@lru_cache(maxsize=20_000)
def _own(tag: str, classes: str, ident: str) -> tuple[int, bool]:
    """Sets of an element by its names; whether a word in them makes it boilerplate if it is small enough."""
    found = _TAGS.get(tag, 0) | _IDS.get(ident, 0)
    names = classes.split()
    for c in names:
        found |= _CLASSES.get(c, 0)
    named = tag not in ("body", "main", "article") and bool(_WORDS.search(" ".join([" ".join(names), ident])))
    return found, named


def lengths(nodes: list[list]) -> list[int]:
    """``textContent`` length of every node (0 for comments)."""
    upto = [0]
    for n in nodes:
        upto.append(upto[-1] + (len(n[4]) if n[2] == "#text" else 0))
    return [upto[n[0] + 1] - upto[i] for i, n in enumerate(nodes)]


def mark(nodes: list[list], chars: list[int]) -> tuple[list[int], list[int]]:
    """For every node ``[last, parent, tag, attributes, text]``: the sets it stands in, itself
    included, and those whose outermost member it is.

    A subtree is boilerplate by its tag, or by a word in class or id if it holds
    at most half of the page's text (a page wrapper is no boilerplate)."""
    body = next((i for i, n in enumerate(nodes) if n[2] == "body"), None)
    if body is None:
        heads, total, skip_to = 0, 0, -1
        for i, n in enumerate(nodes):
            total += len(n[4]) if n[2] == "#text" else 0
            if n[2] == "head" and i > skip_to:
                heads, skip_to = heads + chars[i], n[0]
        size = total - heads
    else:
        size = chars[body]
    inside, outer = [], []
    for i, (_, parent, tag, attrs, _) in enumerate(nodes):
        above = inside[parent] if parent >= 0 else 0
        if i == body:
            above &= ~OF_BODY
        own = 0
        if tag[0] != "#":
            own, named = _own(tag, attrs.get("class", ""), attrs.get("id", "")) if attrs else _own(tag, "", "")
            if named and 2 * chars[i] <= size:
                own |= BOILER
            if attrs and ("hidden" in attrs or ("style" in attrs and _HIDDEN.search(re.sub(r"\s", "", attrs["style"]).lower()))):
                own |= SKIP
        inside.append(above | own)
        outer.append(own & ~above)
    return inside, outer
