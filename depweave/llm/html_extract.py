"""Main text of web pages by wrappers inferred from same-host pages.

A page becomes a stream of tags and texts, with paragraphs and other optional ends
closed where HTML closes them.  A wrapper is a union-free expression over such streams:
tags in order, each once, optional or repeated, and text places that are fixed or slots.
Per host it starts as one page and is aligned with the next ones in turn: runs of equal
siblings fold into a repeated group, siblings that only one side has become optional,
and texts that differ become slots.

The wrapper is inferred from all pages of a host: each task makes one of its pages of the
host, and these are merged by the same alignment, in two steps.  A text place that all
pages agree on keeps up to ``LEAST`` different contents of the pages that hold it, so a
copy counts once wherever it is met: the content is what can be read of the article (or
main) element that holds the place, else of the page, after scripts, comments and
unwanted parts are gone.  A text is fixed where ``LEAST`` contents agree.  The wrapper is
then joined to every page of the host and matched: texts at fixed places are the site's own.

An article (or main) element is the page's text as it stands, but for parts that are never
article by their tag or by a plain name (``_STRICT``), parts of a doubtful name (``_BAD``)
that the wrapper knows as the site's or that are links, and fixed texts at its end.  On a page without one the wrapper
says where the article lies: it is the deepest element that holds ``MOST`` of the text in
slots.  There all blocks from the first to the last one of the page's own stay, headings that
pages share and paragraphs of links among them; elsewhere fixed texts, link lists and parts of
a doubtful name go.

Edge cases: null or empty html gives an empty text; a host with fewer than ``LEAST``
different contents has no fixed texts; a null url is a host of its own; pages that do not
match their wrapper lose only what matches; malformed pages are read as far as they go,
elements more than ``DEPTH`` deep count as children of the last one above;
repeated rows and extra columns make no difference.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
import sys
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweave.session import cut

#: Different contents that must agree before a text is fixed.
LEAST = 6
#: Hosts whose wrappers a task holds at once, groups of a host's partial wrappers, bytes of all wrappers up to which they are broadcast.
HELD = 512
GROUPS = 16
SENT = 8 << 20
#: Python frames for deeply nested pages, and how deep elements are nested at most.
FRAMES = 50_000
DEPTH = 500
#: Share of a page's slot text that the element with the article holds.
MOST = 0.8

# Fixed values of HTML and of common site markup.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = re.compile(r"<(script|style|noscript|template|svg|textarea|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>", re.S | re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul title head".split()
)
_NEVER = frozenset("nav footer aside form head title button select option label input dialog menu figure".split()) - {"figure"}
_OUTSIDE = frozenset("header".split())  # a page's header, not an article's
_BAD = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed)?|promo(?:tion)?s?|banners?|nav|navbar|navigation|menu|breadcrumbs?|sidebar|aside|footer|comments?|replies|respond|disqus|"
    r"cookies?|consent|notices?|notifications?|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|widget|toolbar|pagination|pager|search)(?:$|[\s_-])",
    re.I,
)
_STRICT = re.compile(r"(?:^|\s)(?:ads?|adverts?|advertisements?|advertising|sponsored|nav|navbar|navigation|menu|breadcrumbs?|sidebar|footer|comments?|comment-list|replies|respond|disqus|disqus_thread|cookies?|newsletter|related)(?:$|\s)", re.I)
_CLOSES = {"p": _BLOCKS - {"body", "html", "head", "title", "option"}, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}


class Node:
    """An element: its key (tag and class names), whether its names are doubtful or plainly no article's, children in order (nodes or texts)."""

    __slots__ = ("bad", "children", "key", "plain", "tag")

    def __init__(self, tag: str, key: str = "", bad: bool = False, plain: bool = False):
        self.tag, self.key, self.bad, self.plain, self.children = tag, key or tag, bad, plain, []


def parse(page: str) -> Node:
    """The page as a tree; unknown ends are ignored, open elements end with the page."""
    root = Node("#root")
    stack = [root]
    deeper: dict[str, int] = {}  # open elements below the deepest level, whose ends close nothing above
    page = _RAW.sub(lambda m: "" if m.group(0)[:2] == "<!" else " ", page)
    at = 0
    for m in _TAG.finditer(page):
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        tag = m.group(2).lower()
        if m.group(1):
            if deeper.get(tag):
                deeper[tag] -= 1
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in _BLOCKS and tag not in _BLOCKS:
                    break  # an inline end does not close blocks
            continue
        if tag in _BLOCKS:
            for k in range(len(stack) - 1, 0, -1):
                ends = _CLOSES.get(stack[k].tag)
                if ends and tag in ends:
                    del stack[k:]
                    break
                if stack[k].tag in _BLOCKS and stack[k].tag != "p":
                    break
        names = " ".join(next(filter(None, x), "") for x in _NAMES.findall(m.group(3))) if m.group(3) else ""
        node = Node(tag, f"{tag}.{names}" if names else tag, bool(names and _BAD.search(names)), bool(names and _STRICT.search(names)))
        stack[-1].children.append(node)
        if tag not in _VOID and not m.group(3).endswith("/"):
            if len(stack) < DEPTH:
                stack.append(node)
            else:
                deeper[tag] = deeper.get(tag, 0) + 1
    if at < len(page):
        rest = page[at:]
        stack[-1].children.append(rest[: rest.index("<")] if "<" in rest else rest)
    return root


# A wrapper node is [key, mode, children]; mode is "1", "?" or "+".  A text place is ["#", mode, text, contents], with text None for a slot; in a finished wrapper contents are a number.


def squeeze(text: str) -> str:
    return " ".join(html.unescape(text).split())


def mark(text: str) -> str:
    """A short text, or the digest of a long one."""
    return text if len(text) <= 32 else "#" + hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=16).hexdigest()


def content(node: Node) -> int:
    """48 bits of the texts of an element that can be article, with their elements."""
    found, ahead = [], [node]
    while ahead:
        n = ahead.pop()
        if isinstance(n, str):
            found.append(squeeze(n))
        elif n is node or not (n.tag in _NEVER or n.bad):
            found.append(f"<{n.tag}>")
            ahead += reversed(n.children)
    return int.from_bytes(hashlib.blake2b("\0".join(x for x in found if x).encode("utf-8", "replace"), digest_size=6).digest())


def template(node: Node, held: int | None = None, scope: str = "") -> list:
    """A wrapper of one page: equal neighbours fold into one repeated node.  ``held``: the content of the element ``scope`` that we are in."""
    if held is None or (node.tag == "article" != scope) or (node.tag == "main" and not scope):
        held, scope = content(node), node.tag if node.tag in ("article", "main") else ""
    out: list[list] = []
    for c in node.children:
        if isinstance(c, str):
            t = squeeze(c)
            if t:
                out.append(["#", "1", mark(t), [held]])
            continue
        new = template(c, held, scope)
        if out and out[-1][0] == new[0]:
            out[-1] = [new[0], "+", align(out[-1][2], new[2])]
        else:
            out.append(new)
    return [node.key, "1", out]


def _within(short: list, long: list) -> list[int] | None:
    """The first places in ``long`` of the keys of ``short`` in order, if it has them all."""
    at, places = 0, []
    for x in short:
        while at < len(long) and long[at][0] != x[0]:
            at += 1
        if at == len(long):
            return None
        places.append(at)
        at += 1
    return places


def align(a: list, b: list) -> list:
    """The wrapper of two child lists: common keys in order, what only one side has is optional."""
    n, m = len(a), len(b)
    if [x[0] for x in a] == [x[0] for x in b]:
        return [_merge(x, y) for x, y in zip(a, b)]
    for short, long in ((b, a), (a, b)):
        places = _within(short, long) if len(short) <= len(long) else None
        if places is not None:  # what the search below would find
            partner = dict(zip(places, short))
            return _folded([_optional(x) if (y := partner.get(k)) is None else _merge(x, y) if long is a else _merge(y, x) for k, x in enumerate(long)])
    # longest common sequence of keys
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i][0] == b[j][0]:
            out.append(_merge(a[i], b[j]))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            out.append(_optional(a[i]))
            i += 1
        else:
            out.append(_optional(b[j]))
            j += 1
    return _folded(out + [_optional(x) for x in a[i:] + b[j:]])


def _folded(out: list) -> list:
    folded: list[list] = []
    for x in out:  # neighbours that became equal are a repeated group
        if folded and x[0] == folded[-1][0] != "#":
            folded[-1] = [x[0], "+", align(folded[-1][2], x[2])]
        else:
            folded.append(x)
    return folded


def _optional(x: list) -> list:
    return [x[0], "?" if x[1] == "1" else x[1], *x[2:]]


def _merge(x: list, y: list) -> list:
    mode = "+" if "+" in (x[1], y[1]) else "?" if "?" in (x[1], y[1]) else "1"
    if x[0] == "#":
        if x[2] is None or x[2] != y[2]:
            return ["#", mode, None, []]
        return ["#", mode, x[2], x[3] if len(x[3]) >= LEAST or x[3] == y[3] else [*x[3], *[h for h in y[3] if h not in x[3]]][:LEAST]]
    return [x[0], mode, align(x[2], y[2])]


def infer(pages: list[str]) -> list:
    """The wrapper of some pages of one host."""
    wrapper = None
    for page in pages:
        new = template(parse(page))
        wrapper = new if wrapper is None else _merge(wrapper, new)
    return _counted(wrapper or ["#root", "1", []])


def _counted(x: list) -> list:
    """A finished wrapper: contents as numbers."""
    return [*x[:3], len(x[3])] if x[0] == "#" else [x[0], x[1], [_counted(c) for c in x[2]]]


def _pruned(x: list) -> list:
    """A finished wrapper without the children of elements that hold no fixed text."""
    if x[0] == "#":
        return [*x[:3], len(x[3])] if len(x[3]) >= LEAST else ["#", x[1], None, 0]
    children = [_pruned(c) for c in x[2]]
    return [x[0], x[1], children if any(c[3] if c[0] == "#" else c[2] for c in children) else []]


def _fixed(node: Node, wrapper: list | None) -> Iterator[tuple[object, bool, list | None]]:
    """(child, whether it is a fixed text, the wrapper node it matches) in order."""
    at, places = 0, wrapper[2] if wrapper else []
    for c in node.children:
        if isinstance(c, str):
            t = squeeze(c)
            if not t:
                yield c, False, None
                continue
            k = next((k for k in range(at, len(places)) if places[k][0] == "#"), None)
            known = k is not None and places[k][2] == mark(t) and places[k][3] >= LEAST
            if known:
                at = k + 1
            yield c, known, None
        else:
            # a repeated node may match again, so the place is left only when a later one matches
            k = next((k for k in range(max(0, at - 1), len(places)) if places[k][0] == c.key), None)
            if k is not None:
                at = k + 1
            yield c, False, places[k] if k is not None else None


def _own(node: Node, wrapper: list | None) -> bool:
    """Whether an element's texts are all fixed, or all in links: a bar of the site's, not a part of an article."""
    ahead, linked, fixed_all = [(node, wrapper, node.tag == "a")], True, True
    while ahead:
        n, w, link = ahead.pop()
        for c, fixed, match in _fixed(n, w):
            if not isinstance(c, str):
                ahead.append((c, match, link or c.tag == "a"))
            elif c.strip():
                linked, fixed_all = linked and link, fixed_all and fixed
    return linked or fixed_all


def _left_out(c: Node, match: list | None, inside: bool) -> bool:
    """Whether an element is no part of an article: by its tag or names, in an article a doubtful name alone is not enough."""
    if c.tag in _NEVER or (c.tag in _OUTSIDE and not inside):
        return True
    return (c.plain or _own(c, match)) if c.bad and inside else c.bad


#: A text of a block: the text, whether it is in a link, whether it is fixed.
Part = tuple[str, bool, bool]


def _blocks(node: Node, wrapper: list | None, inside: bool, out: list[tuple[bool, list[Part]]], link: bool, home: Node | None) -> None:
    """Append texts to the last block of ``out`` (whether it is at home, its texts); block elements and parts left out cut blocks.  ``home`` is the element with the article, ``node`` itself once we are in it."""
    for c, fixed, match in _fixed(node, wrapper):
        if isinstance(c, str):
            out[-1][1].append((c, link, fixed))
            continue
        here = home is node
        if _left_out(c, match, inside):
            out.append((here, []))
            continue
        if c.tag == "br":
            out[-1][1].append((" ", link, False))
            continue
        cut = c.tag in _BLOCKS
        if cut:
            out.append((here or home is c, []))
        _blocks(c, match, inside or c.tag in ("article", "main"), out, link or c.tag == "a", c if here else home)
        if cut:
            out.append((here, []))


def _mains(node: Node, wrapper: list | None, tag: str, found: list) -> None:
    for c, _, match in _fixed(node, wrapper):
        if isinstance(c, str) or c.tag in _NEVER or c.plain or (c.bad and c.tag != tag):
            continue
        if c.tag == tag:
            found.append((c, match))
        else:
            _mains(c, match, tag, found)


def _slot_text(node: Node, wrapper: list | None, sizes: dict[int, int], link: bool = False) -> int:
    """Characters below an element that are in slots and in no link; those of all elements go to ``sizes``."""
    size = 0
    for c, fixed, match in _fixed(node, wrapper):
        if isinstance(c, str):
            size += 0 if fixed or link else len(c.strip())
        elif not _left_out(c, match, False):
            size += _slot_text(c, match, sizes, link or c.tag == "a")
    sizes[id(node)] = size
    return size


def home_of(root: Node, wrapper: list | None) -> Node:
    """The deepest block element that holds most of the page's slot text."""
    sizes: dict[int, int] = {}
    least, at = MOST * _slot_text(root, wrapper, sizes), root
    while least:
        inner = [c for c in at.children if not isinstance(c, str) and c.tag in _BLOCKS and sizes.get(id(c), 0) >= least]
        # a paragraph is no place of an article, its parent is
        if not inner or inner[0].tag in ("p", "pre", "li", "td", "blockquote", "h1"):
            break
        at = inner[0]
    return at


def extract(page: str | None, wrapper: list | None) -> str:
    """The main text of one page: blocks in page order, joined by line ends."""
    if not page:
        return ""
    root = parse(page)
    found: list = []
    for tag in ("article", "main"):
        _mains(root, wrapper, tag, found)
        if found:
            break
    home = None if found else home_of(root, wrapper)
    lines: list[tuple[bool, list[Part]]] = []
    for node, match in found or [(root, wrapper)]:
        lines.append((home is node, []))
        _blocks(node, match, bool(found), lines, False, home)
    blocks = [(at_home, squeeze("".join(t for t, _, _ in line)), line) for at_home, line in lines]
    blocks = [x for x in blocks if x[1]]
    # a block is the site's own only if all of it is fixed
    own = [not all(f or not t.strip() for t, _, f in line) for _, _, line in blocks]
    if found:  # what the site puts behind an article's last own block is no part of it
        end = max((k + 1 for k, mine in enumerate(own) if mine), default=len(blocks))
        return "\n".join(text for _, text, _ in blocks[:end])
    # outside any article a list of links is none of the page's
    own = [mine and sum(len(t) for t, a, _ in line if a) * 2 <= len(text) for mine, (_, text, line) in zip(own, blocks)]
    at = [k for k, x in enumerate(blocks) if x[0] and own[k]]
    first, last = (at[0], at[-1]) if at else (0, -1)
    return "\n".join(text for k, (at_home, text, _) in enumerate(blocks) if own[k] or (at_home and first <= k <= last))


def _packed(wrapper: list) -> bytes:
    return zlib.compress(json.dumps(wrapper, separators=(",", ":")).encode(), 1)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over (host, html): wrappers of the pages of one task."""
    sys.setrecursionlimit(max(FRAMES, sys.getrecursionlimit()))
    held: dict[str, list] = {}
    seen: set[tuple[str, int]] = set()

    def sent() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([_packed(w) for w in held.values()], pa.binary())], names=["host", "wrapper"])
        held.clear()
        seen.clear()
        return out

    for batch in batches:
        for host, page in zip(*[c.to_pylist() for c in batch.columns]):
            if (host, hash(page)) in seen:  # the same page again
                continue
            seen.add((host, hash(page)))
            new = template(parse(page))
            held[host] = _merge(held[host], new) if host in held else new
            if len(held) > HELD:
                yield sent()
    if held:
        yield sent()


def _joined(finish: bool) -> Callable:
    """applyInPandas over partial wrappers of one host (or one group of them)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sys.setrecursionlimit(max(FRAMES, sys.getrecursionlimit()))
        wrapper = None
        for w in pdf.sort_values(["part", "wrapper"])["wrapper"]:
            new = json.loads(zlib.decompress(w))
            wrapper = new if wrapper is None else _merge(wrapper, new)
        if finish:
            wrapper = _pruned(wrapper)
        if finish and not wrapper[2]:
            return pdf[["host", "part", "wrapper"]][:0]
        return pd.DataFrame({"host": pdf["host"].iloc[:1].tolist(), "part": [int(pdf["part"].iloc[0]) % GROUPS], "wrapper": [_packed(wrapper)]})

    return run


def _extract(keep: int) -> Callable:
    """mapInArrow over (kept columns, html, wrapper)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(max(FRAMES, sys.getrecursionlimit()))
        known: dict[bytes, list] = {}
        for batch in batches:
            texts = []
            for page, w in zip(batch.column(keep).to_pylist(), batch.column(keep + 1).to_pylist()):
                if w is not None and w not in known:
                    if len(known) > 256:
                        known.clear()
                    known[w] = json.loads(zlib.decompress(w))
                texts.append(extract(page, known.get(w) if w else None))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:keep], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*batch.schema.names[:keep], "text", "n_chars"],
            )

    return run


def host_of(url):
    """Lower-case host of a url; empty for none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    schema = "host string, part int, wrapper binary"
    partial = rows.filter(F.length("html") > 0).select("host", "html").mapInArrow(_partial, "host string, wrapper binary").select("host", F.spark_partition_id().alias("part"), "wrapper")
    # a host may be in every task, so its partial wrappers are merged in groups first
    groups = partial.groupBy("host", (F.col("part") % GROUPS).alias("group")).applyInPandas(_joined(False), schema)
    wrappers = cut(groups.groupBy("host").applyInPandas(_joined(True), schema)).select("host", "wrapper")
    size = wrappers.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0
    return rows.join(F.broadcast(wrappers) if size <= SENT else wrappers, "host", "left").select("page_id", "url", "html", "wrapper").mapInArrow(
        _extract(2), f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint"
    )
