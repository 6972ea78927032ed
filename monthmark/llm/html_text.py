"""HTML extraction: union-free wrappers, inferred by aligning the token streams of a host's pages.

A page becomes a stream of block tags and text slots (inline tags, scripts and comments are no
part of it). Repeats inside a page are folded into one repeated group. Then pages are aligned one
after the other with the wrapper of their host: what both have stays, a mismatch becomes an optional group
or joins a repeated neighbour, and texts that differ become slots. The result is an expression
without alternatives; its groups carry how many characters, how many of them in links, and whether the
text is always the same.

Each task aligns its own pages; the wrappers of tasks are aligned in two rounds, (host, salt) and host,
so a host with a third of all pages is spread over tasks. The wrapper names the group that
holds the article: the most text outside menus, notices and the like, by host instead of by page; a group that is
named like them but holds the article is none of them. Then each
page's blocks inside that group are its text.
"""

from __future__ import annotations

import html as html_lib
import json
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthmark.llm.common import by_bytes, quoted, written

#: Depth and width of what is aligned group by group. They bound work on wrappers; texts are read at any depth and width.
DEEPEST, WIDEST = 100, 64

#: Parts into which the tasks of one host are dealt in the first round of merging.
SALTS = 32

# Elements by what a parser does with them, and words that name a page's furniture.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s "
             "samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe svg math object canvas audio video".split())
CLOSES_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p "
               "pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
            "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}}
FOREIGN = set("svg math".split())
FURNITURE_TAGS = set("nav footer aside form menu dialog button select head".split())
FURNITURE_WORDS = set("ad ads adbox advert adverts advertisement banner breadcrumb breadcrumbs comment comments commentlist "
                      "cookie cookies consent disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation "
                      "newsletter notice notices overlay pagination pager popup promo promotion recommended related respond "
                      "search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget "
                      "widgets".split())
FURNITURE_ROLES = set("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
#: Furniture that may hold more text than the article.
LONG_WORDS = set("comment comments commentlist disqus respond related recommended".split())
ARTICLE_WORDS = set("article body content entry main post story text".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
                  re.DOTALL)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
#: Words of layout grids keep their number: col-md-8 and col-md-4 are different places, post-8 and post-4 are not.
_WORDS = re.compile(r"(?:cols?|column|grid|large|medium|row|size|small|span|unit|width|lg|md|sm|xl|xs)[-_]?[0-9]{1,2}(?![0-9])|[a-z]+")
_BLANK = re.compile(r"\s+")


def label_of(name: str, attributes: str) -> str:
    """Element with the words of its class, id and role; numbers other than those of layout grids are left out."""
    words = [w for m in _ATTRIBUTE.finditer(attributes) for w in
             _WORDS.findall(((m[1].lower() == "role") * "role" + " " + (m[2] or m[3] or m[4] or "")).lower())] if attributes else []
    return ".".join([name, *words])


def is_furniture(label: str, in_article: bool) -> bool:
    name, *words = label.split(".")
    if name in FURNITURE_TAGS or name == "header" and not in_article:
        return True
    if "role" in words and FURNITURE_ROLES.intersection(words):
        return True
    return bool(FURNITURE_WORDS.intersection(words)) and name not in ("body", "html", "article", "main") or \
        name == "article" and bool({"comment", "comments", "related", "promo"}.intersection(words))


class Element:
    """An open element: its parent, label and depth; the root's children have depth 1."""

    __slots__ = ("parent", "label", "depth", "note")

    def __init__(self, parent: Element | None, label: str):
        self.parent, self.label = parent, label
        self.depth = parent.depth + 1 if parent else 1
        self.note: Any = None


def blocks_of(page: str) -> list[tuple[Element | None, str, int]]:
    """(innermost open element, text, characters in links) of each text block.

    Tag soup is mended like a browser would: implied ends, unknown ends and missing ends.
    """
    out: list = []
    stack: list[tuple[str, Element]] = []
    open_names: Counter = Counter()
    parts: list[str] = []
    links = in_link = at = 0

    def flush():
        nonlocal links
        text = _BLANK.sub(" ", html_lib.unescape("".join(parts))).strip()
        if text:
            out.append((stack[-1][1] if stack else None, text, min(links, len(text))))
        parts.clear()
        links = 0

    while at < len(page):
        m = _TAG.search(page, at)
        piece = page[at:m.start()] if m else page[at:]
        if piece:
            parts.append(piece)
            if in_link:
                links += len(piece)
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if name in RAW:
            # HTML knows no empty script or style; foreign content such as svg may end itself.
            if not closing and not (name in FOREIGN and attributes.endswith("/")):
                end = re.compile(f"</{name}\\b[^>]*>", re.IGNORECASE).search(page, at)
                at = end.end() if end else len(page)
            continue
        if name in INLINE:
            if name == "a":
                in_link = 0 if closing else 1
            elif name in ("br", "img"):
                parts.append(" ")
            continue
        flush()
        in_link = 0
        if closing:
            if open_names[name]:
                while True:
                    gone = stack.pop()[0]
                    open_names[gone] -= 1
                    if gone == name:
                        break
            continue
        if name in CLOSES_P and stack and stack[-1][0] == "p":
            open_names[stack.pop()[0]] -= 1
        if name in SIBLINGS:
            while stack and stack[-1][0] in SIBLINGS[name]:
                open_names[stack.pop()[0]] -= 1
        if name not in VOID:
            stack.append((name, Element(stack[-1][1] if stack else None, label_of(name, attributes))))
            open_names[name] += 1
    flush()
    return out


# A group of a wrapper is [label, groups, repeated, optional, chars, link chars, text]; a slot has the label
# "#", and its text is a checksum while it is always the same, else null.

def _slot(text: str, links: int) -> list:
    return ["#", [], False, False, len(text), links, zlib.crc32(text.encode())]


def groups_of(blocks: list) -> list:
    """The folded expression of one page.

    Elements nested deeper than DEEPEST add no groups of their own; their blocks belong to the one at that depth.
    """
    root: list = []
    for element, text, links in blocks:
        while element and element.depth > DEEPEST:
            element = element.parent
        chain = []
        while element and element.note is None:
            chain.append(element)
            element = element.parent
        into = element.note[1] if element else root
        for e in reversed(chain):
            e.note = [e.label, [], False, False, 0, 0, None]
            into.append(e.note)
            into = e.note[1]
        into.append(_slot(text, links))
    for element, _, _ in blocks:  # The notes are of use here alone.
        while element and element.note is not None:
            element.note = None
            element = element.parent
    return _folded(root)


def _same_shape(a: list, b: list) -> bool:
    return len(a) == len(b) and all(x[0] == y[0] for x, y in zip(a, b))


def _folded(groups: list) -> list:
    """Neighbours of one label, and runs of two or three groups that repeat, become one repeated group."""
    for g in groups:
        g[1] = _folded(g[1])
    out: list = []
    for g in groups:
        out.append(g)
        for period in (1, 2, 3):
            tail, before = out[-period:], out[-2 * period:-period]
            if len(before) == period and _same_shape(tail, before) and (period == 1 or len({x[0] for x in tail}) == period):
                del out[-period:]
                for x, y in zip(out[-period:], tail):
                    _join(x, y)
                    x[2] = True
                break
    return out


def _join(x: list, y: list) -> None:
    """Make x stand for both groups of one label."""
    x[1] = aligned(x[1], y[1])
    x[2], x[3] = x[2] or y[2], x[3] or y[3]
    x[4], x[5] = x[4] + y[4], x[5] + y[5]
    x[6] = x[6] if x[6] == y[6] else None


def _drawn(groups: list) -> list:
    """All groups of a label as one repeated group, at its first place."""
    first: dict[str, list] = {}
    for g in groups:
        if g[0] in first:
            _join(first[g[0]], g)
            first[g[0]][2] = True
        else:
            first[g[0]] = g
    return list(first.values())


def _common(a: list, b: list) -> list[tuple[int, int]]:
    """Places of a longest sequence of labels in both."""
    n, m = len(a), len(b)
    if n * m <= WIDEST * WIDEST:
        best = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n - 1, -1, -1):
            for j in range(m - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else max(best[i + 1][j], best[i][j + 1])
        out, i, j = [], 0, 0
        while i < n and j < m:
            if a[i][0] == b[j][0]:
                out.append((i, j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
        return out
    # Labels are unique on both sides: a longest ascending sequence of the places in b.
    place = {g[0]: j for j, g in enumerate(b)}
    ends: list[int] = []
    heads: list[tuple[int, int, Any]] = []
    for i, g in enumerate(a):
        if (j := place.get(g[0])) is not None:
            k = bisect_left(ends, j)
            entry = (i, j, heads[k - 1] if k else None)
            ends[k:k + 1], heads[k:k + 1] = [j], [entry]
    out, entry = [], heads[-1] if heads else None
    while entry:
        out.append(entry[:2])
        entry = entry[2]
    return out[::-1]


def aligned(a: list, b: list) -> list:
    """One expression for both: groups in common, the rest optional, repeats drawn together.

    Where the two have more than WIDEST groups side by side, those of one label are drawn together first; then
    aligning takes little more than linear time.
    """
    if _same_shape(a, b):
        for x, y in zip(a, b):
            _join(x, y)
        return a
    wide = len(a) * len(b) > WIDEST * WIDEST
    if wide:
        a, b = _drawn(a), _drawn(b)
    out: list = []
    i = j = 0
    for x, y in [*_common(a, b), (len(a), len(b))]:
        for g in (*a[i:x], *b[j:y]):
            g[3] = True
            out.append(g)
        if x < len(a):
            _join(a[x], b[y])
            out.append(a[x])
        i, j = x + 1, y + 1
    # Two groups of one label side by side are a repeated one; in wide expressions, wherever they stand.
    kept: list = []
    for g in _drawn(out) if wide else out:
        if kept and kept[-1][0] == g[0]:
            optional = kept[-1][3] and g[3]
            _join(kept[-1], g)
            kept[-1][2], kept[-1][3] = True, optional
        else:
            kept.append(g)
    return kept


def kept_groups(wrapper: list, pages: int) -> list[str]:
    """Paths (labels joined by ">") of groups that are named like furniture but hold the article.

    Such a group holds a main element, articles with at least the text outside furniture, or most of the text that
    varies and is not linked. Comments and the like only count as the latter if nothing else is left.
    """

    def weight(groups: list, in_article: bool, counted=lambda label, inside: True, within: bool = True) -> int:
        """Text inside groups that are counted; if not `within`, only what is in article or main."""
        total = 0
        for g in groups:
            if g[0] == "#":
                fixed = g[6] is not None and pages >= 3 and not in_article
                total += max(0, g[4] - 2 * g[5]) if within and not fixed else 0
            elif counted(g[0], in_article):
                inside = g[0].split(".")[0] in ("article", "main")
                total += weight(g[1], in_article or inside, counted, within or inside)
        return total

    plain = lambda label, inside: not is_furniture(label, inside)
    wraps = lambda label, inside: plain(label, inside) or _by_words(label) and not LONG_WORDS.intersection(label.split("."))
    every, outside, articles = weight(wrapper, False), weight(wrapper, False, plain), weight(wrapper, False, plain, False)
    kept: list[str] = []

    def has_main(groups: list) -> bool:
        return any(g[0].split(".")[0] == "main" and weight([g], False) > 0 or has_main(g[1]) for g in groups)

    def walk(groups: list, path: str, in_article: bool, last: bool) -> None:
        for g in groups:
            label, below = g[0], g[1]
            here = f"{path}>{label}" if path else label
            inside = in_article or label.split(".")[0] in ("article", "main")
            if label == "#":
                continue
            if is_furniture(label, in_article):
                if not _by_words(label):
                    continue
                long = label.split(".")[0] == "article" or bool(LONG_WORDS.intersection(label.split(".")))
                most = 2 * weight(below, inside) > every and (last or not long and (in_article or 4 * articles < every))
                if not (most or has_main(below) or not long and weight(below, inside, wraps, False) >= max(outside, 1)):
                    continue
                kept.append(here)
            walk(below, here, inside, last and here not in kept)

    walk(wrapper, "", False, False)
    if not kept and outside == 0:
        walk(wrapper, "", False, True)
    return kept


def _by_words(label: str) -> bool:
    """Whether only words of its class, id or role can make an element furniture."""
    return label.split(".")[0] not in FURNITURE_TAGS | {"header"}


def article_path(wrapper: list, pages: int, kept: list[str] | None = None) -> list[str]:
    """Labels from the root to the group that holds the article; empty if no group stands out."""
    kept = kept_groups(wrapper, pages) if kept is None else kept
    found: list[tuple[float, int, list[str]]] = []

    def weigh(groups: list, path: list[str], in_article: bool) -> float:
        total = 0.0
        for g in groups:
            label = g[0]
            if label == "#":
                fixed = g[6] is not None and pages >= 3 and not in_article
                total += 0.0 if fixed else max(0, g[4] - 2 * g[5])
                continue
            if is_furniture(label, in_article) and ">".join([*path, label]) not in kept:
                continue
            name, *words = label.split(".")
            inside = in_article or name in ("article", "main")
            here = weigh(g[1], [*path, label], inside)
            bonus = 4.0 if name == "article" else 3.0 if name == "main" or "main" in words else \
                2.0 if ARTICLE_WORDS.intersection(words) and name not in ("body", "html") else 1.0
            found.append((here * bonus, len(path), [*path, label]))
            total += here
        return total

    weigh(wrapper, [], False)
    found = [f for f in found if f[0] > 0]
    if not found:
        return []
    top, _, path = max(found, key=lambda f: (f[0], -f[1]))
    # Inside it, the innermost group that holds nearly as much, is no single kind of text and leaves out no text but furniture
    # and what is the same on all pages.
    near = {tuple(f[2]) for f in found if f[0] >= 0.9 * top and f[2][-1].split(".")[0] not in ("p", "li", "td", "tr", "h1", "h2", "h3")}
    groups, inside, now = wrapper, False, []
    while groups:
        filled = [g for g in groups if _own_text(g, pages, inside, kept, now)]
        if len(now) < len(path):
            filled = [g for g in groups if g[0] == path[len(now)]]
        if len(filled) != 1 or filled[0][0] == "#":
            break
        now, groups = [*now, filled[0][0]], filled[0][1]
        inside = inside or now[-1].split(".")[0] in ("article", "main")
        if len(now) > len(path) and tuple(now) in near:
            path = now
    return path


def _own_text(group: list, pages: int, in_article: bool, kept: list[str], path: list[str], always: bool = True) -> int:
    """Characters outside furniture that are not the same on all pages; linked ones count."""
    label, groups, _, optional, chars, _, text = group
    always = always and not optional
    if label == "#":
        return 0 if text is not None and pages >= 3 and always and not in_article else chars
    path = [*path, label]
    if is_furniture(label, in_article) and ">".join(path) not in kept:
        return 0
    inside = in_article or label.split(".")[0] in ("article", "main")
    return sum(_own_text(g, pages, inside, kept, path, always) for g in groups)


def text_of(blocks: list, path: list[str], kept: Iterable[str] = ()) -> str:
    """Blocks inside the group named by the path (or its last element, or anywhere), without furniture.

    Groups in `kept` are no furniture. A page without text then has groups of its own kept, if their names also
    have words that name no furniture.
    """
    wanted = [p.split(".")[0] for p in path]

    def states(kept) -> dict[int, tuple]:
        """By element: (in furniture, in an article, path of labels, how much of `path` leads here, last label met)."""
        found: dict[int, tuple] = {0: (False, False, "", 0, False)}
        for element, _, _ in blocks:
            chain = []
            while element and id(element) not in found:
                chain.append(element)
                element = element.parent
            for e in reversed(chain):
                cut, in_article, here, led, met = found[id(e.parent) if e.parent else 0]
                # Only names up to the depth of wrappers can be kept ones.
                here = (f"{here}>{e.label}" if here else e.label) if e.depth <= DEEPEST else ""
                cut = cut or is_furniture(e.label, in_article) and not (here and here in kept)
                in_article = in_article or e.label.split(".")[0] in ("article", "main")
                led = led + 1 if led == e.depth - 1 and led < len(path) and e.label == path[led] else led
                met = met or bool(path) and e.label == path[-1]
                found[id(e)] = (cut, in_article, here, led, met)
        return found

    def chosen(state: dict[int, tuple], test) -> list[str]:
        return [text for e, text, _ in blocks if not (s := state[id(e) if e else 0])[0] and test(s)]

    state = states(frozenset(kept))
    lines = chosen(state, lambda s: s[3] == len(path)) if path else []
    if not lines and path and wanted[-1] not in ("body", "html", "div"):
        lines = chosen(state, lambda s: s[4])
    lines = lines or chosen(state, lambda s: True)
    if not lines and blocks:
        kept = [k for k in kept_groups(groups_of(blocks), 1) if not FURNITURE_WORDS.issuperset(k.split(">")[-1].split(".")[1:])]
        lines = chosen(states(frozenset(kept)), lambda s: True) if kept else lines
    return "\n".join(lines)


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; empty where there is none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#\s]*)", 1)
    return F.lower(host)


def _emit(rows: list[tuple]):
    import pyarrow as pa

    return pa.RecordBatch.from_pydict(
        {"host": [r[0] for r in rows], "task": [r[1] for r in rows], "pages": [r[2] for r in rows],
         "wrapper": [json.dumps(r[3]) for r in rows]},
        pa.schema([("host", pa.string()), ("task", pa.int32()), ("pages", pa.int64()), ("wrapper", pa.string())]))


_WRAPPER = "host string, task int, pages long, wrapper string"


def _page_wrappers(batches: Iterable) -> Iterator:
    """Wrappers of the hosts of one task's pages; sent on early if there are many hosts."""
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    held: dict[str, list] = {}
    for whole in batches:
        for batch in by_bytes(whole, 1):
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                groups = groups_of(blocks_of(page or ""))
                if host in held:
                    held[host] = [held[host][0] + 1, aligned(held[host][1], groups)]
                else:
                    held[host] = [1, groups]
            if len(held) > 5_000:
                yield _emit([(h, task, n, w) for h, (n, w) in held.items()])
                held = {}
    if held:
        yield _emit([(h, task, n, w) for h, (n, w) in held.items()])


def _merged(keys: int):
    """Align neighbouring rows that share their first `keys` columns (host, salt)."""

    def run(batches: Iterable) -> Iterator:
        now, pages, wrapper, task = None, 0, [], 0
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for host, salt, t, n, w in zip(*columns):
                if (host, salt)[:keys] != now:
                    if now is not None:
                        yield _emit([(now[0], task, pages, wrapper)])
                    now, pages, wrapper, task = (host, salt)[:keys], n, json.loads(w), t
                else:
                    pages, wrapper = pages + n, aligned(wrapper, json.loads(w))
        if now is not None:
            yield _emit([(now[0], task, pages, wrapper)])

    return run


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, pages, wrapper, path, kept) for each host of (host, html)."""
    import pyarrow as pa

    found = pages.mapInArrow(_page_wrappers, _WRAPPER)
    salt = F.pmod(F.col("task"), F.lit(SALTS)).alias("salt")
    columns = ["host", salt, "task", "pages", "wrapper"]
    found = (found.select(*columns).repartition("host", "salt").sortWithinPartitions("host", "salt", "task", "wrapper")
             .mapInArrow(_merged(2), _WRAPPER))
    found = (found.select(*columns).repartition("host").sortWithinPartitions("host", "task", "wrapper")
             .mapInArrow(_merged(1), _WRAPPER))

    def paths(batches: Iterable) -> Iterator:
        for b in batches:
            host, _, n, w = (b.column(i).to_pylist() for i in range(4))
            read = [json.loads(x) for x in w]
            kept = [kept_groups(x, k) for x, k in zip(read, n)]
            path = [article_path(*x) for x in zip(read, n, kept)]
            yield pa.RecordBatch.from_arrays([pa.array(host), pa.array(n), pa.array(w), *[pa.array(x, pa.list_(pa.string())) for x in (path, kept)]],
                                             ["host", "pages", "wrapper", "path", "kept"])

    return found.mapInArrow(paths, "host string, pages long, wrapper string, path array<string>, kept array<string>")


def extract_text(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) for each row: the article's blocks, one to a line.

    A null page is empty and has an empty text. A page without host shares a wrapper with the others that have none.
    Rows with equal or null keys are kept. Pages are read whole; white space inside a block is one space.
    """
    import pyarrow as pa

    chosen = df.select(F.col(quoted(key)).alias("_key"), F.col(quoted(url)).alias("_url"),
                       F.col(quoted(html)).alias("_html"), host_of(F.col(quoted(url))).alias("_host"))
    rules = wrappers(chosen.select("_host", "_html")).select(F.col("host").alias("_host"), F.col("path").alias("_path"), F.col("kept").alias("_kept"))
    # Stored, its size is known before the join is planned: small rules go to the pages, which then stay where
    # they are, and beyond Spark's limit for that a hot host's pages are split.
    rules = written(rules, "wrappers")

    def run(batches: Iterable) -> Iterator:
        for whole in batches:
            for batch in by_bytes(whole, 2):
                text = [text_of(blocks_of(h), p or [], k or []) if h else ""
                        for h, p, k in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())],
                    ["k", "u", "text", "n_chars"])

    kinds = [df.schema[c].dataType.simpleString() for c in (key, url)]
    return (chosen.join(rules, "_host", "left").select("_key", "_url", "_html", "_path", "_kept")
            .mapInArrow(run, f"k {kinds[0]}, u {kinds[1]}, text string, n_chars long").toDF(key, url, "text", "n_chars"))
