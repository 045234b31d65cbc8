"""Main text of web pages by wrapper induction (operator 5).

Pages of one host come from one template. Per host one reference page is
taken; every page's DOM tree is aligned with it by simple tree matching (equal
symbols match, children in order, the most matches by dynamic programming).
Over all pages of the host it is counted how often each reference node is
matched, and how often with the same text: nodes whose text stays the same
are template, the others are slots. Each page is then aligned once more; text
of template nodes is dropped, and what is left in content slots is the main
text: inside the outermost article (else main, else body), without elements
that are boilerplate by tag, role, class or id, and without blocks made of
links. Running text of an article (paragraphs, headings, list items, cells) is
kept even if it repeats on the host.

The DOM work is a per-page helper; Spark picks the references, counts and
joins. References and templates are broadcast only if their measured size is
within ``BROADCAST_BYTES``, else joined by a shuffle on the host.

Defined cases: NULL or empty html gives empty text; a NULL or unreadable url
counts as the host ""; repeated rows and ids keep one row each, and do not
count as more pages for the template; other columns are ignored; any nesting
depth works, since nothing recurses.
"""

from __future__ import annotations

import html as html_entities
import re
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, map_arrow, shared_table

#: The reference is taken among pages of at most so many characters, if there are any.
REFERENCE_CHARS = 20_000
#: A node is template if its text is the same on this share of the pages that have it ...
SAME_SHARE = 0.8
#: ... and on so many pages at least.
SAME_PAGES = 4
#: A block outside an article with more of its text in links is no content.
LINK_SHARE = 0.5
BROADCAST_BYTES = 16 << 20

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
SKIP = frozenset("head script style noscript template nav header footer aside form iframe svg math object button select textarea canvas audio video dialog menu title xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt pre blockquote td th figcaption b i em strong span".split())
#: Words in class, id or role that mark boilerplate.
BOILERPLATE = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies
    disclaimer footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted
    related share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget complementary contentinfo search""".split())
#: An opening tag of these ends an open element of the second kind, up to the barriers.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
BARRIERS = frozenset("table ul ol dl div section article main body html nav footer header aside form select".split())

_TAG = re.compile(r"<(?:!--(?:.*?--\s*>|.*\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[!?][^>]*>)", re.S)
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAMES = re.compile(r"[a-z]+")


@dataclass
class Tree:
    """Nodes in document order; node 0 is the document."""

    tags: list = field(default_factory=lambda: [""])
    symbols: list = field(default_factory=lambda: [""])
    names: list = field(default_factory=lambda: [frozenset()])
    plain: list = field(default_factory=lambda: [False])  # a whole class, id or role of boilerplate words
    parent: list = field(default_factory=lambda: [-1])
    kids: list = field(default_factory=lambda: [[]])
    items: list = field(default_factory=lambda: [[]])  # texts and child numbers in order
    own: list = field(default_factory=list)

    def add(self, tag: str, attributes: str, parent: int) -> int:
        names, plain = frozenset(), False
        if attributes:
            found = " ".join(a or b or c for _, a, b, c in _ATTRIBUTE.findall(attributes)).lower()
            names = frozenset(_NAMES.findall(found))
            plain = bool(names & BOILERPLATE) and any(set(x) <= BOILERPLATE for x in map(_NAMES.findall, found.split()) if x)
        n = len(self.tags)
        self.tags.append(tag)
        self.names.append(names)
        self.plain.append(plain)
        self.symbols.append(f"{tag}.{'.'.join(sorted(names))}" if names else tag)
        self.parent.append(parent)
        self.kids.append([])
        self.items.append([])
        self.kids[parent].append(n)
        self.items[parent].append(n)
        return n


def parse(page: str) -> Tree:
    """A tree of the page's elements; ends what authors leave open."""
    t, stack, at, size = Tree(), [0], 0, len(page)

    def text(s: str) -> None:
        if s and not s.isspace():
            t.items[stack[-1]].append(html_entities.unescape(s) if "&" in s else s)
        elif s:
            t.items[stack[-1]].append(" ")

    def close(kinds, barriers) -> None:
        for k in range(len(stack) - 1, 0, -1):
            tag = t.tags[stack[k]]
            if tag in kinds:
                del stack[k:]
                return
            if tag in barriers:
                return

    while at < size:
        m = _TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            close((tag,), () if tag not in INLINE else BARRIERS)
            continue
        if tag in ENDS_P:
            close(("p",), BARRIERS)
        if tag in ENDS:
            close(ENDS[tag], BARRIERS)
        n = t.add(tag, m[3], stack[-1])
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else size
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(n)
    t.own = [" ".join("".join(x for x in items if isinstance(x, str)).split()) for items in t.items]
    return t


def align(a: Tree, b: Tree) -> dict[int, int]:
    """Simple tree matching: for each matched node of ``a`` its node of ``b``."""
    scores: dict[tuple[int, int], int] = {}
    sa, sb, ka, kb, oa, ob = a.symbols, b.symbols, a.kids, b.kids, a.own, b.own

    def table(i: int, j: int):
        rows = [[0] * (len(kb[j]) + 1)]
        for x in ka[i]:
            above, row, left = rows[-1], [0], 0
            symbol, leaf, text = sa[x], not ka[x], oa[x]
            for k, y in enumerate(kb[j]):
                best = above[k + 1] if above[k + 1] > left else left
                if sb[y] == symbol:
                    s = above[k] + (1 + (text == ob[y]) if leaf and not kb[y] else scores[x, y])
                    if s > best:
                        best = s
                row.append(best)
                left = best
            rows.append(row)
        return rows

    stack = [(0, 0, False)]
    while stack:
        i, j, ready = stack.pop()
        if ready:
            scores[i, j] = 1 + (oa[i] == ob[j]) + table(i, j)[-1][-1]
        elif (i, j) not in scores:
            stack.append((i, j, True))
            stack += [(x, y, False) for x in ka[i] for y in kb[j] if sa[x] == sb[y] and (ka[x] or kb[y]) and (x, y) not in scores]
    found, todo = {}, [(0, 0)]
    while todo:
        i, j = todo.pop()
        found[i] = j
        if not ka[i] or not kb[j]:
            continue
        rows, x, y = table(i, j), len(ka[i]), len(kb[j])
        while x and y:
            if rows[x][y] == rows[x - 1][y]:
                x -= 1
            elif rows[x][y] == rows[x][y - 1]:
                y -= 1
            else:
                x, y = x - 1, y - 1
                todo.append((ka[i][x], kb[j][y]))
    return found


def _content_roots(t: Tree, dropped: list) -> list[int]:
    for kind in ("article", "main"):
        found = [n for n, tag in enumerate(t.tags) if not dropped[n] and (tag == kind or kind == "main" and "main" in t.names[n] and tag != "nav")]
        inside, roots = set(), []
        for n in found:
            p = t.parent[n]
            while p > 0 and p not in inside:
                p = t.parent[p]
            if p <= 0:
                roots.append(n)
            inside.add(n)
        if roots:
            return roots
    return [0]


def _by_name(t: Tree, template: frozenset[int], matched: dict[int, int]) -> list[bool]:
    """Which nodes class, id or role drop. Not a node with most of the text of the page,
    or of its articles and mains; and by a word of a longer name ("related-work") not
    one with the h1, or whose text, outside links, mostly varies on the host."""
    size = len(t.tags)
    weight, articles, varies, linked, heads = ([0] * size for _ in range(5))
    sums = (weight, articles, varies, linked, heads)
    for n in range(size - 1, -1, -1):
        tag, own = t.tags[n], len(t.own[n])
        if tag in SKIP:
            continue
        weight[n] += own
        varies[n] += own if n in matched and matched[n] not in template else 0
        heads[n] += tag == "h1"
        if tag == "a":
            linked[n] = weight[n]
        if tag == "main" or tag == "article" and not t.names[n] & BOILERPLATE:
            articles[n] = weight[n]
        if n:
            for x in sums:
                x[t.parent[n]] += x[n]
    out = [False] * size
    for n in range(1, size):
        if t.names[n] & BOILERPLATE and t.tags[n] not in ("html", "body", "main"):
            most = 2 * weight[n] > weight[0] or 2 * articles[n] > articles[0]
            slot = bool(template) and 2 * varies[n] > weight[n] and 2 * linked[n] <= weight[n]
            out[n] = not most and (t.plain[n] or not heads[n] and not slot)
    return out


def main_text(t: Tree, template: frozenset[int], matched: dict[int, int]) -> str:
    """Text of the content slots; ``template``: reference nodes whose text is constant."""
    dropped = [False] * len(t.tags)
    named = _by_name(t, template, matched)
    for n in range(1, len(t.tags)):
        dropped[n] = dropped[t.parent[n]] or t.tags[n] in SKIP or named[n]
    roots = _content_roots(t, dropped)
    article = roots != [0]
    blocks: list[str] = []
    line: list[str] = []
    in_links = 0

    def flush():
        nonlocal line, in_links
        text = " ".join("".join(line).split())
        if text and (article or in_links <= LINK_SHARE * len(text)):
            blocks.append(text)
        line, in_links = [], 0

    for root in roots:
        stack = [(root, 0, False)]
        while stack:
            n, k, link = stack.pop()
            items = t.items[n]
            if k == 0:
                if dropped[n]:
                    continue
                if t.tags[n] not in INLINE:
                    flush()
                link = link or t.tags[n] == "a"
            silent = bool(t.own[n]) and matched.get(n) in template and not (article and t.tags[n] in RUNNING)
            while k < len(items):
                x = items[k]
                k += 1
                if isinstance(x, str):
                    if not silent:
                        line.append(x)
                        in_links += len(x) if link else 0
                else:
                    stack.append((n, k, link))
                    stack.append((x, 0, link))
                    break
            else:
                if t.tags[n] not in INLINE:
                    flush()
        flush()
    return " ".join(blocks)


@lru_cache(maxsize=512)
def _reference(page: str) -> Tree:
    return parse(page)


def _host(url):
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def induce(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per host: ``host``, ``reference`` (html) and ``template`` (numbers of
    the reference's nodes whose text is constant over all pages of the host)."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    src = pages.select(_host(F.col(url_col)).alias("host"), html.alias("html"))
    order = F.struct(F.greatest(F.length("html") - REFERENCE_CHARS, F.lit(0)), F.xxhash64("html"))
    references = shared_table(src.groupBy("host").agg(F.min_by("html", order).alias("reference")), "references")

    def count(batches):
        seen: dict[tuple, list] = {}

        def out():
            keys = list(seen)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()),
                                               pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())],
                                              ["host", "node", "matched", "same"])

        for b in batches:
            for host, page, reference in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if page == reference:
                    continue
                a, ref = parse(page), _reference(reference)
                for i, j in align(a, ref).items():
                    if ref.own[j]:
                        v = seen.setdefault((host, j), [0, 0])
                        v[0] += 1
                        v[1] += a.own[i] == ref.own[j]
            if len(seen) > 100_000:
                yield out()
                seen.clear()
        yield out()

    joined = src.join(broadcast_if_small(references, BROADCAST_BYTES), "host").select("host", "html", "reference")
    counts = map_arrow(joined, count, "host string, node int, matched bigint, same bigint").groupBy("host", "node") \
        .agg(F.sum("matched").alias("matched"), F.sum("same").alias("same"))
    constant = counts.where((F.col("same") >= SAME_PAGES) & (F.col("same") >= SAME_SHARE * F.col("matched"))) \
                     .groupBy("host").agg(F.sort_array(F.collect_list("node")).alias("template"))  # at most the reference's nodes
    return shared_table(references.join(constant, "host", "left"), "wrappers")


def extract(pages: DataFrame, wrappers: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, ``url_col`` and ``text`` of each page."""
    def run(batches):
        for b in batches:
            out = []
            for page, reference, template in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                t = parse(page or "")
                matched = align(t, _reference(reference)) if template else {}
                out.append(main_text(t, frozenset(template or ()), matched))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], [id_col, url_col, "text"])

    src = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).cast("string").alias("_html"), _host(F.col(url_col)).alias("host"))
    joined = src.join(broadcast_if_small(wrappers, BROADCAST_BYTES), "host", "left").select("_id", "_url", "_html", "reference", "template")
    kinds = [f.dataType.simpleString() for f in joined.schema][:2]
    return map_arrow(joined, run, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string")


def main_texts(pages: DataFrame) -> DataFrame:
    return extract(pages, induce(pages)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
