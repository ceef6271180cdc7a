"""Main text of web pages by equivalence-class template deduction.

Tokens are a page's tags, by their path of elements and classes, and its runs of words, by their path
and words (a block of text is kept or left out whole, so its words make one token).  A token's
occurrence vector names the pages of its host that hold it exactly once; tokens of one vector form an
equivalence class.  Vectors are never gathered: sums of page hashes, added up within each batch of
pages and then partially before the shuffle, are a fingerprint of the vector, so a host with a third
of all pages costs a few rows a task.

A class is valid if it is large and its host's pages nearly all hold it.  Its tokens' order is that of
their mean places.  Valid classes are nested by position: the largest first, and each further one
whose tokens lie in one gap of every class taken before (or hold such a class in a gap of their own);
classes that cut across are no template.  The tokens of the nested classes in order are the host's
template.  What a page has between two of them is a slot.

Main text is what fills the slots, but for menus, headers, footers, sidebars, notices, adverts, forms and
comments, which are told by their elements and the names of their classes, ids and roles.  Words of the template are left out; only a heading of it
that stands between filled slots stays, as the title of the slot after it.  Of pages that hold no token of
a template or have nothing in its slots all stays that is not told to be such furniture.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfin.llm.common import checkpoint

#: Elements without content, whose content is no markup, that stand inside a block, and that are never main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea noscript iframe xmp template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var".split())
NEVER = frozenset("head title script style noscript template textarea nav header footer aside form button select iframe svg dialog menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An element one of whose classes, or whose id or role, is one of these words, or is made of them and of AFFIXES, is not main text either.
NEVER_WORDS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent notice notices popup modal newsletter subscribe subscription signup "
    "comment comments disqus respond reply replies sidebar nav navbar navigation menu breadcrumb breadcrumbs header footer masthead related recommended share sharing social toolbar pagination pager contentinfo complementary search".split()
)
AFFIXES = frozenset("site page post entry main top bottom left right primary secondary global user reader block box bar slot unit list item section area panel widget wrap wrapper container inner outer holder content text title form links icons buttons".split())
MAIN = frozenset(("article", "main"))
#: An open element on the left is closed by an opening one on the right.
CLOSED_BY = {"p": frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()), "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr",)), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")), "option": frozenset(("option",))}

#: Comments, declarations, elements with raw content, and tags; a quote counts only after "=", and what is not closed reaches to the end.
_MARKUP = re.compile(
    r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*+(?:>|\Z)|(script|style|textarea|noscript|iframe|xmp|template)(?=[\s/>])((?:[^>"'=]|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)(?:>.*?(?:</\1(?=[\s/>])[^>]*+(?:>|\Z)|\Z)|\Z)"""
    r"""|(/?)([a-z][^\s/>]*+)((?:[^>"'=]|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)(?:>|\Z)|/[^>]*+(?:>|\Z))""",
    re.I | re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_TOLD = re.compile("class|id|role|hidden", re.I)
_PARTS = re.compile(r"[-_]+")

#: Tokens of a valid class, the share of a host's pages that hold it, and the pages that a host needs for a template.
CLASS_SIZE, SUPPORT, LEAST_PAGES = 2, 0.8, 5
#: Bytes of templates that are broadcast at most; beyond, pages meet them by a join that adaptive execution splits.
BROADCAST_BYTES = 32 << 20
#: Tokens gathered at once in a batch, and remembered elements of a worker.
TOKENS, REMEMBERED = 500_000, 20_000
#: Stands for a page itself among the tokens.
PAGE = 0

_M64 = (1 << 64) - 1
_elements: dict[tuple[str, str], tuple[int, bool, bool]] = {}


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little")


def _is_furniture(value: str) -> bool:
    """True if a name of the attribute's value is a furniture word ("ad", "cookies") or made of such and of affixes ("site-footer", "comment_list"); "ad-hoc-report" is not."""
    for name in value.split():
        if name in NEVER_WORDS:
            return True
        parts = [x for x in _PARTS.split(name) if x]
        if not NEVER_WORDS.isdisjoint(parts) and all(x in NEVER_WORDS or x in AFFIXES for x in parts):
            return True
    return False


def _element(name: str, attributes: str) -> tuple[int, bool, bool]:
    """Hash of the element's step in a path, whether it is never main text, and whether it is marked as main text."""
    known = _elements.get((name, attributes))
    if known is not None:
        return known
    never, step, main = name in NEVER, name, name in MAIN
    if _TOLD.search(attributes):
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key == "hidden" or key == "aria-hidden" and value == "true":
                never = True
            elif key in ("class", "id", "role"):
                if _is_furniture(value) and name not in ("html", "body", *MAIN):
                    never = True
                if key == "class" and value.split():
                    step = f"{name}.{value.split()[0]}"
                elif key == "role" and value == "main":
                    step, main = f"{step}.main-role", True
    if len(_elements) >= REMEMBERED:
        _elements.clear()
    _elements[name, attributes] = made = (_hash(step), never, main)
    return made


def _join(a: int, b: int) -> int:
    h = (a * 0x9E3779B97F4A7C15 + b) & _M64
    return ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9) & _M64 or 1


def parse(page: str) -> tuple[list[int], list[tuple[int, str, bool, bool]]]:
    """Tokens of a page in order, and its blocks of text that may be main text: (place among the tokens, text, is a heading, is in an article or main element).

    Elements are a stack of path hashes, so time and memory are linear in the page however deep it nests.
    """
    tokens: list[int] = []
    found: list[tuple[int, str, bool, bool]] = []
    stack: list[tuple[str, int, bool, bool, bool, bool]] = [("", 1, False, False, False, False)]  # name, path, never, main, heading, is or is in an element inside a block
    opened: dict[str, int] = {}
    parts: list[str] = []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            for top in reversed(stack):  # past elements inside the block, which hold no text of it
                if not top[5]:
                    break
            found.append((len(tokens), text, top[4], top[3]))
            tokens.append(_join(top[1] ^ 0x5BD1E995, _hash(text)))

    def close(down_to: int) -> None:
        for name, *_ in stack[down_to:]:
            opened[name] -= 1
        del stack[down_to:]

    at = 0
    for m in _MARKUP.finditer(page):
        top = stack[-1]
        if m.start() > at and not top[2]:
            parts.append(page[at : m.start()])
        at = m.end()
        name = m[4]
        if name is None:
            name, attributes, ends = m[1], m[2], False
            if name is None or name.lower() not in RAW:
                continue
            if parts and not top[5] and not attributes.endswith("/"):
                flush()
            continue
        name, attributes, ends = name.lower(), m[5], bool(m[3])
        if name in VOID:
            if name == "hr":
                if parts:
                    flush()
            elif not top[2]:
                parts.append(" ")
        elif ends:
            known = opened.get(name)
            if parts and name not in INLINE and not top[5] and (known or name in CLOSED_BY):
                flush()
            if known:
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                close(k)
        elif name in INLINE:
            # only one that is never main text, and what stands in such, counts as an element
            never = top[2] or bool(attributes) and _element(name, attributes)[1]
            if never and not attributes.endswith("/"):
                stack.append((name, top[1], True, top[3], top[4], True))
                opened[name] = opened.get(name, 0) + 1
        else:
            if parts and not top[5]:
                flush()
            while True:
                k = len(stack) - 1
                while stack[k][5]:
                    k -= 1
                if name not in CLOSED_BY.get(stack[k][0], ()):
                    break
                if parts:
                    flush()
                close(k)
            top = stack[-1]
            step, never, main = _element(name, attributes)
            if name == "header" and top[3]:  # an article's own, with its headline
                never = _element("div", attributes)[1]
            path = _join(top[1], step)
            tokens.append(path)
            if not attributes.endswith("/"):
                stack.append((name, path, never or top[2], main or top[3], name in HEADINGS or top[4], top[5]))
                opened[name] = opened.get(name, 0) + 1
    if at < len(page) and not stack[-1][2]:
        parts.append(page[at:])
    if parts:
        flush()
    return tokens, found


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of batches (host, html), for each host and token of a batch: pages that hold the token once, two sums of their hashes, and the sum of its places; PAGE counts the pages."""
    names = ["host", "token", "pages", "a", "b", "place"]

    def close(hosts: list[str], hashes: list[int], counts: list[int], flat: list[int]) -> pa.RecordBatch:
        numbers: dict[str, int] = {}
        host = np.array([numbers.setdefault(h, len(numbers)) for h in hosts], np.int64)
        h = np.array(hashes, np.uint64)
        a, b = (h & np.uint64(0x7FFFFFFF)).astype(np.int64), (h >> np.uint64(33)).astype(np.int64)
        token, page = np.array(flat, np.uint64), np.repeat(np.arange(len(hosts)), counts)
        place = np.arange(len(token)) - np.repeat(np.cumsum(counts) - np.array(counts), counts)
        order = np.lexsort((token, page))
        t, p = token[order], page[order]
        new = np.concatenate([[True], (t[1:] != t[:-1]) | (p[1:] != p[:-1])]) if len(t) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        once = order[at[np.diff(np.append(at, len(t))) == 1]]
        token, page, place = np.append(token[once], np.full(len(hosts), PAGE, np.uint64)), np.append(page[once], np.arange(len(hosts))), np.append(place[once], np.zeros(len(hosts), np.int64))
        order = np.lexsort((token, host[page]))
        t, p, place = token[order], page[order], place[order]
        at = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (host[p][1:] != host[p][:-1])]))
        sums = [np.add.reduceat(x, at) for x in (np.ones(len(t), np.int64), a[p], b[p], place)]
        of = list(numbers)
        return pa.RecordBatch.from_arrays([pa.array([of[i] for i in host[p[at]].tolist()], pa.string()), pa.array(t[at].view(np.int64)), *map(pa.array, sums)], names)

    for batch in batches:
        hosts, hashes, counts, flat = [], [], [], []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = page.as_py() or ""
            tokens, _ = parse(text)
            hosts.append(host)
            hashes.append(_hash(text))
            counts.append(len(tokens))
            flat += tokens
            if len(flat) >= TOKENS:
                yield close(hosts, hashes, counts, flat)
                hosts, hashes, counts, flat = [], [], [], []
        if hosts:
            yield close(hosts, hashes, counts, flat)


def nest(classes: list[tuple[int, list[tuple[float, int]]]]) -> list[int]:
    """Tokens in order of the classes that nest.  classes: (pages, [(mean place, token), ...]); the largest (pages times tokens) are taken first.

    Two classes nest if all of one lies in one gap of the other; tokens of one place are in order of their hash.
    """
    taken: list[list[tuple[float, int]]] = []
    for _, members in sorted(((n, sorted(m)) for n, m in classes), key=lambda c: (-c[0] * len(c[1]), c[1])):
        for other in taken:
            gap = bisect_left(other, members[0])
            own = bisect_left(members, other[0])
            if bisect_left(other, members[-1]) != gap and bisect_left(members, other[-1]) != own:
                break
        else:
            taken.append(members)
    return [token for _, token in sorted(m for members in taken for m in members)]


def templates(pages: DataFrame) -> DataFrame:
    """(host, template): of each host that has one, the tokens of its nested valid classes in order.  pages: (host, html).

    A host's rows here are the tokens that most of its pages hold exactly once, so their number is
    bounded by the tokens of a page.
    """
    tokens = pages.mapInArrow(_tokens, "host string, token long, pages long, a long, b long, place long")
    vectors = tokens.groupBy("host", "token").agg(*(F.sum(c).alias(c) for c in ("pages", "a", "b", "place")))
    vectors = checkpoint(vectors.filter(F.col("pages") >= SUPPORT * LEAST_PAGES))  # fewer are in no template, and most tokens are in one page
    hosts = vectors.filter(F.col("token") == PAGE).select("host", F.col("pages").alias("of")).filter(F.col("of") >= LEAST_PAGES)
    frequent = vectors.filter(F.col("token") != PAGE).join(hosts, "host").filter(F.col("pages") >= SUPPORT * F.col("of"))
    classes = frequent.groupBy("host", "pages", "a", "b").agg(F.collect_list(F.struct((F.col("place") / F.col("pages")).alias("mean"), "token")).alias("members"))
    classes = classes.filter(F.size("members") >= CLASS_SIZE).groupBy("host").agg(F.collect_list(F.struct("pages", "members")).alias("classes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nested = [nest([(c["pages"], [(m["mean"], m["token"]) for m in c["members"]]) for c in found]) for found in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nested, pa.list_(pa.int64()))], ["host", "template"])

    return classes.mapInArrow(run, "host string, template array<long>")


def slots(page: str, template: dict[int, int] | None) -> list[tuple[int, str]]:
    """(slot, text) of each block of main text, in order; template: place by token.  A slot is named by the place of the template's token before it, -1 without a template.

    Tokens of the page that the template has count as the template's where they stand once and in its
    order (the longest run of them that does); others are in a slot.
    """
    tokens, found = parse(page)
    if template:
        place = [(template[t], i) for i, t in enumerate(tokens) if t in template]
        times: dict[int, int] = {}
        for p, _ in place:
            times[p] = times.get(p, 0) + 1
        matched = dict((i, p) for p, i in _increasing([x for x in place if times[x[0]] == 1]))
        if matched:
            filled = [k for k, (i, *_) in enumerate(found) if i not in matched]
            if filled:
                starts = sorted(matched)
                out = []
                for k, (i, text, heading, _) in enumerate(found):
                    if i not in matched or heading and filled[0] < k < filled[-1]:
                        before = bisect_left(starts, i)
                        out.append((matched[starts[before - 1]] if before else -1, text))
                return out
    return [(-1, text) for _, text, *_ in found]


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of (place, index) whose places rise."""
    ends: list[int] = []
    last: list[int] = []
    before: list[int] = []
    for k, (p, _) in enumerate(pairs):
        at = bisect_left(ends, p)
        before.append(last[at - 1] if at else -1)
        if at == len(ends):
            ends.append(p)
            last.append(k)
        else:
            ends[at], last[at] = p, k
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def extract_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, text, n_chars (code points).

    White space inside a block becomes one space, blocks are trimmed and joined by one line feed;
    character references are decoded.  Null and empty pages give an empty text; a null url counts
    as a host of its own kind ("").  Every row is kept, repeated ones too; a row that stands several
    times counts as several pages of its host, with one vector.
    """
    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), host_of(F.col(url_col).cast("string")).alias("host"))
    known = checkpoint(templates(pages.select("host", "html")))
    size = known.agg(F.coalesce(F.sum(8 * F.size("template") + F.octet_length("host")), F.lit(0)).alias("n")).first()["n"]
    if size <= BROADCAST_BYTES:  # pages, and a host with a third of them, need no shuffle
        known = F.broadcast(known)
    joined = pages.join(known, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[str, dict[int, int]] = {}
        for batch in batches:
            texts = []
            for host, page, template in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4)):
                if host not in places:
                    if len(places) >= 1000:
                        places.clear()
                    places[host] = {t & _M64: i for i, t in enumerate(template.as_py() or ())}
                texts.append("\n".join(text for _, text in slots(page.as_py() or "", places[host])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    out = joined.select("page_id", "url", "host", "html", "template").mapInArrow(run, "page_id long, url string, text string")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
