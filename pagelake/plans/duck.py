"""SQL fragments for the DuckDB oracles.

Each helper writes, in DuckDB's dialect, the same semantics as the Spark
helper of the same name. The oracle is an independent statement of the
expected result (the driver runs it next to the Spark query): it shares the fixed
word lists only. Its patterns read the markup of the seeded pages; the Spark
side reads nodes, and tests/test_marks.py holds those against other markup.
"""

from __future__ import annotations

from ..functions import lexicons as L  # noqa: F401  (used as D.L by the catalog)

# Entity replacements applied in this order, '&amp;' last so
# that '&amp;lt;' decodes to the text '&lt;' and not to '<'.
ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
    ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
)

TAG = r"</?[a-zA-Z!?][^>]*>"
COMMENT = r"(?s)<!--.*?-->"
# Raw-text elements: their content is text in the DOM, not markup.
RAW_OR_TAG = (r"(?is)<script\b[^>]*>(.*?)</script\s*>|<style\b[^>]*>(.*?)</style\s*>|"
              + TAG)


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# Unicode white space, which RE2's \\s does not hold.
WS = "[\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\p{Z}]+"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {lit(f'^{WS}|{WS}$')}, '', 'g')"


def collapse_ws(x: str) -> str:
    return strip(f"regexp_replace({x}, {lit(WS)}, ' ', 'g')")


def decode(x: str) -> str:
    for ent, ch in ENTITIES:
        x = f"replace({x}, {lit(ent)}, {lit(ch)})"
    return x


def drop_comments(x: str) -> str:
    return f"regexp_replace({x}, {lit(COMMENT)}, '', 'g')"


def drop_blocks(x: str, *tags: str) -> str:
    for t in tags:
        x = f"regexp_replace({x}, {lit(rf'(?is)<{t}\b[^>]*>.*?(?:</{t}\s*>|$)')}, '', 'g')"
    return x


def text_content(x: str) -> str:
    return decode(f"regexp_replace({drop_comments(x)}, {lit(RAW_OR_TAG)}, '\\1\\2', 'g')")


def body_html(h: str) -> str:
    inner = (f"regexp_replace(regexp_extract({h}, {lit(r'(?is)<body\b[^>]*>(.*)')}, 1), "
             f"{lit(r'(?is)</body\s*>.*')}, '')")
    headless = f"regexp_replace({h}, {lit(r'(?is)<head\b.*?</head\s*>')}, '')"
    return f"(CASE WHEN regexp_matches({h}, {lit(r'(?i)<body\b')}) THEN {inner} ELSE coalesce({headless}, '') END)"


def element_html(h: str, tag: str) -> str:
    return f"regexp_extract({h}, {lit(rf'(?is)<{tag}\b[^>]*>(.*?)(?:</{tag}\s*>|$)')}, 1)"


def title_text(h: str) -> str:
    return collapse_ws(decode(f"regexp_extract({h}, {lit(r'(?is)<title\b[^>]*>(.*?)</title\s*>')}, 1)"))


def tokens(x: str) -> str:
    return f"regexp_extract_all({x}, {lit(r'[\p{L}\p{N}_]+')}, 0)"


def count_substr(x: str, needle: str) -> str:
    return f"CAST((length({x}) - length(replace({x}, {lit(needle)}, ''))) / {len(needle)} AS BIGINT)"


def in_list(items) -> str:
    return "(" + ", ".join(lit(i) for i in items) + ")"


def any_contains(x: str, needles) -> str:
    return "(" + " OR ".join(f"instr({x}, {lit(n)}) > 0" for n in needles) + ")"


def first_match(x: str, needles, fmt: str = "{}") -> str:
    whens = " ".join(f"WHEN instr({x}, {lit(n)}) > 0 THEN {lit(fmt.format(n))}" for n in needles)
    return f"(CASE {whens} ELSE NULL END)"


def keyword_count(low: str, keywords) -> str:
    words = [k for k in keywords if len(k.split()) == 1]
    phrases = [k for k in keywords if len(k.split()) > 1]
    parts = [f"CAST(len(list_filter({tokens(low)}, lambda x: x IN {in_list(words)})) AS BIGINT)"]
    parts += [count_substr(low, p) for p in phrases]
    return "(" + " + ".join(parts) + ")"


def netloc(u: str) -> str:
    return f"lower(regexp_extract({u}, {lit(r'^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)')}, 1))"


def hostname(u: str) -> str:
    n = netloc(u)
    n = f"regexp_replace({n}, '^.*@', '')"
    n = f"regexp_replace({n}, ':[0-9]*$', '')"
    return f"regexp_replace({n}, {lit(r'^\[|\]$')}, '', 'g')"


def remove_dot_segments(p: str) -> str:
    folded = (f"list_reduce(list_prepend('', string_split({p}, '/')[2:]), lambda path, x: CASE "
              f"WHEN x = '..' THEN CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE chr(1) END "
              f"WHEN x = '.' THEN path WHEN path = chr(1) THEN x ELSE concat(path, '/', x) END)")
    rooted = f"regexp_replace(concat('/', replace({folded}, chr(1), '')), '^//', '/')"
    closed = f"concat({rooted}, CASE WHEN string_split({p}, '/')[-1] IN ('.', '..') AND {rooted} <> '/' THEN '/' ELSE '' END)"
    return f"(CASE WHEN regexp_matches({p}, '/[.][.]?(/|$)') THEN {closed} ELSE {p} END)"


def resolve(b: str, h: str) -> str:
    scheme = f"regexp_extract({b}, {lit(r'^([a-zA-Z][a-zA-Z0-9+.-]*):')}, 1)"
    origin = f"regexp_extract({b}, {lit(r'^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)')}, 1)"
    path = f"regexp_extract({b}, {lit(r'^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)')}, 1)"
    directory = f"(CASE WHEN {path} = '' THEN '/' ELSE regexp_replace({path}, '[^/]*$', '') END)"
    h = f"(CASE WHEN starts_with({h}, '///') THEN substr({h}, 3) ELSE {h} END)"
    rest = f"regexp_extract({h}, '(?s)[?#].*$')"
    joined = f"regexp_replace(concat({directory}, regexp_extract({h}, '^[^?#]*')), '/{{2,}}', '/', 'g')"
    return (f"(CASE WHEN regexp_matches({h}, {lit(r'^[a-zA-Z][a-zA-Z0-9+.-]*:')}) THEN {h} "
            f"WHEN starts_with({h}, '//') AND NOT regexp_matches({h}, '^//([/?#]|$)') THEN concat({scheme}, ':', {h}) "
            f"WHEN starts_with({h}, '/') THEN concat({origin}, {remove_dot_segments(f"regexp_extract({h}, '^[^?#]*')")}, {rest}) "
            f"WHEN starts_with({h}, '?') THEN concat(regexp_extract({b}, '^([^?#]*)', 1), {h}) "
            f"WHEN starts_with({h}, '#') THEN concat(regexp_extract({b}, '^([^#]*)', 1), {h}) "
            f"WHEN {h} = '' THEN {b} "
            f"ELSE concat({origin}, {remove_dot_segments(joined)}, {rest}) END)")


def is_internal(link: str, base: str) -> str:
    ln, bn = netloc(link), netloc(base)
    return f"({ln} = {bn} OR {ln} = '' OR ends_with({ln}, concat('.', {bn})))"


def class_selector(name: str) -> str:
    return rf"<[a-zA-Z][^>]*\sclass\s*=\s*\"(?:[^\"]*\s)?{name}(?:\s[^\"]*)?\""


def id_selector(name: str) -> str:
    return rf"<[a-zA-Z][^>]*\sid\s*=\s*\"{name}\""


def attr_selector(name: str) -> str:
    return rf"<[a-zA-Z][^>]*\s{name}(?:\s*=|[\s/>])"


__all__ = [n for n in dir() if not n.startswith("_")] + ["L"]
