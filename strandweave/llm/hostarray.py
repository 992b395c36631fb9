"""Main text of web pages, with boilerplate found as substrings that a host's pages repeat.

A page is read into blocks of text with their place in the page: inside the article or main element, inside chrome
(navigation, header, footer, aside, form, adverts, notices, comments, by element, role, class or id), or neither.
The blocks outside the article, or all blocks of a page without one, are the page's token stream; the article's blocks
are a second one.

The suffixes of all streams of a host are ordered to a depth of ``RUN`` tokens by a shuffle: suffixes that share that
prefix meet under one key, wherever their pages lie, and a token is covered if it lies in a prefix that two distinct
pages hold.  (A longer common prefix is the union of such prefixes, so a deeper order would cover the same tokens.)
Whole regions of a page (children of its body) are keys too, for menus of fewer tokens.  Pages with equal markup count
as one.  Which task reads a page has no influence.

The suffixes of a host's articles are ordered alike.  There a prefix is boilerplate only where most of the host's
articles hold it: more than half of the rows and of the different pages, and ``LEAST_PAGES`` of these.  Rarer repeats in
articles are copies and stock lines of the stories.  More than half of all holds more than half of some group, however
rows are grouped, so prefixes that have no group's majority are left out before the shuffle and none is lost.

Blocks that are mostly covered go as boilerplate, in an article as outside it; what is left and is chrome by structure
goes too, as does what is outside the article, and of a page without an article what is mostly link text.  A page without
an article that is covered nearly all over (``COPY``) counts as a copy of a page, as an article does, and structure alone
decides on it.

Null html is empty and has the text ''; a null url has the host ''; repeated rows give equal results.
"""

from __future__ import annotations

import html as _html
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stage
from .textkit import mix, shingles, slices, strings, tidy, words

RUN = 8
MOSTLY, COPY = 0.5, 0.9
LEAST_PAGES = 3
GROUP, HELD = 64, 1 << 21  #: rows of a host that are searched for their majority's prefixes at once; prefixes held for that in a task
BITS = 1 << 20  #: of the filter that keeps other prefixes from the shuffle
_ROUND = np.uint64(0x9FB21C651E98DF25)

# Names of HTML elements and of page parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option optgroup p pre section summary table tbody td tfoot th thead title tr ul".split()
)
DROPPED = frozenset("script style noscript template head title nav footer aside form button select textarea option iframe object svg canvas audio video map menu dialog".split())
PARTS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright discussion disqus footer gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination popup promo promoted promotion recommended related replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola tags toolbar widget widgets".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog menu menubar toolbar form".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table article main section div nav aside footer header form body html blockquote".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    article: bool
    chrome: bool
    linked: int  #: code points inside links
    region: int = 0  #: child of the body that holds it


@dataclass
class _Element:
    name: str
    article: bool
    chrome: bool
    link: bool


@dataclass
class _Reader:
    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    region: int = 0

    def end(self, at: _Element) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.blocks.append(Block(text, at.article, at.chrome, self.linked, self.region))
        self.parts, self.linked = [], 0


def _is_chrome(name: str, attributes: str, article: bool) -> bool:
    if name in DROPPED or name == "header" and not article:
        return True
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return False
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key in ("class", "id"):
            tokens = set(_SPLIT.split(_CAMEL.sub("-", value).lower()))
            if tokens & PARTS or "header" in tokens and not article and name != "body":
                return name not in ("body", "html", "main", "article")
        elif key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def blocks(page: str) -> list[Block]:
    """The page's blocks of text in order; scripts, styles and markup are left out."""
    reader, stack, at, size = _Reader(), [_Element("", False, False, False)], 0, len(page)

    def text(raw: str) -> None:
        if raw:
            if "&" in raw:
                raw = _html.unescape(raw)
            reader.parts.append(raw)
            if stack[-1].link:
                reader.linked += len(raw)

    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            if m.group().startswith("<![CDATA["):
                text(m.group()[9:].removesuffix("]]>"))
            continue
        name = name.lower()
        top = stack[-1]
        if closing:
            if name in BLOCK:
                reader.end(top)
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    del stack[k:]
                    break
                if stack[k].name in SCOPES and name not in SCOPES:
                    break
            continue
        if name in ("br", "hr"):
            reader.end(top) if name == "hr" else reader.parts.append(" ")
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\s*[^>]*>?", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if name in BLOCK:
            reader.end(top)
            if name in CLOSES:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name in CLOSES[name]:
                        del stack[k:]
                        break
                    if stack[k].name in SCOPES:
                        break
            elif name in SCOPES or name[0] == "h" and name[1:].isdigit():
                for k in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                    if stack[k].name == "p":
                        del stack[k:]
                        break
                    if stack[k].name in SCOPES:
                        break
            top = stack[-1]
        if name in VOID or attributes.endswith("/") and name not in BLOCK:
            continue
        if top.name in ("", "html", "body") and name in BLOCK:
            reader.region += 1
        article = top.article or name in ("article", "main") or 'role="main"' in attributes or 'itemprop="articleBody"' in attributes
        stack.append(_Element(name, article, top.chrome or _is_chrome(name, attributes, top.article), top.link or name == "a"))
        if len(stack) > 2000:  # deeper elements share this one's place
            del stack[-1]
    reader.end(stack[-1])
    return reader.blocks


@dataclass
class Stream:
    """Blocks of a page whose fate its host's other pages decide on."""

    blocks: list[Block]
    article: list[Block]  #: the article's own blocks, none where the page has no article; they are a stream of their own

    @classmethod
    def of(cls, read: list[Block]) -> Stream:
        return cls([b for b in read if not b.article or b.chrome], [b for b in read if b.article and not b.chrome])


def prefixes(streams: list[list[Block]], host: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stream, key, first token) of every suffix's prefix of ``RUN`` tokens (of all, in a shorter stream); the key holds the host."""
    w = words(strings(pa.array([b.text for s in streams for b in s], pa.string())))
    w.first = w.first[np.concatenate([[0], np.cumsum([len(s) for s in streams])]).astype(np.int64)]
    with np.errstate(over="ignore"):
        key, own, at = shingles(w, RUN)
        return own, mix(key + mix(host.view(np.uint64) + _ROUND)[own]), at - w.first[own]


def majority(rows: list[np.ndarray]) -> np.ndarray:
    """The keys that more than half of the rows hold."""
    key, row = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    order = np.lexsort((row, key))
    key, row = key[order], row[order]
    new = np.append(True, key[1:] != key[:-1])[: len(key)]
    once = new | np.append(True, np.diff(row) != 0)[: len(key)]
    at = np.flatnonzero(new)
    return key[at][2 * np.add.reduceat(once.astype(np.int64), at) > len(rows)] if len(at) else key


def substrings(streams: list[list[Block]], host: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(stream, key, first token, tokens) of every suffix's prefix of ``RUN`` tokens (of all, in a shorter stream) and of
    every region; the key holds the host."""
    w = words(strings(pa.array([b.text for s in streams for b in s], pa.string())))
    ends = np.concatenate([[0], np.cumsum([len(s) for s in streams])]).astype(np.int64)
    size = np.diff(w.first) if len(w.first) > 1 else np.zeros(0, np.int64)
    stop = np.concatenate([[0], np.cumsum(size)])
    first = stop[ends]
    own, key, at = prefixes(streams, host)
    length = np.minimum(RUN, np.diff(first)[own])
    with np.errstate(over="ignore"):
        salt = mix(host.view(np.uint64) + _ROUND)
        # regions: a sum of mixed (token, place), like in the signature of a word sequence
        page = np.repeat(np.arange(len(streams)), np.diff(ends))
        region = np.array([b.region for s in streams for b in s], np.int64)
        new = np.flatnonzero(np.append(True, (np.diff(page) != 0) | (np.diff(region) != 0))) if len(page) else np.zeros(0, np.int64)
        lo, hi = stop[new], stop[np.append(new[1:], len(page)).astype(np.int64)]
        place = np.arange(len(w.hash)) - np.repeat(lo, hi - lo)
        total = np.append(np.uint64(0), np.cumsum(mix(w.hash + place.astype(np.uint64) * _ROUND)))
        whole = mix(mix(total[hi] - total[lo] + (hi - lo).astype(np.uint64)) ^ salt[page[new]])
    some = hi > lo
    start = np.concatenate([at, (lo - first[page[new]])[some]])
    return np.concatenate([own, page[new][some]]), np.concatenate([key, whole[some]]), start, np.concatenate([length, (hi - lo)[some]])


def repeated(stream: list[Block], covered: list[tuple[int, int]], copies: bool) -> tuple[list[Block], int, int]:
    """The mostly covered blocks (none where ``copies`` are looked for and the stream is one), and the numbers of tokens and
    of covered ones."""
    size = [len(b.text.split()) for b in stream]
    marks = np.zeros(sum(size) + 1, np.int64)
    for at, n in covered:
        marks[min(at, len(marks) - 1)] += 1
        marks[min(at + n, len(marks) - 1)] -= 1
    hit = np.concatenate([[0], np.cumsum(np.cumsum(marks[:-1]) > 0)])
    edge = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    own = hit[edge[1:]] - hit[edge[:-1]]
    copy = copies and hit[-1] > COPY * edge[-1]
    return [b for b, n, x in zip(stream, size, own.tolist(), strict=True) if x > MOSTLY * n and not copy], int(edge[-1]), int(hit[-1])


def kept_blocks(read: list[Block], covered: list[tuple[int, int]], common: list[int] = ()) -> tuple[list[Block], int, int]:
    """Blocks of the main text, in order, and the numbers of tokens of the page's stream and of covered ones.

    ``covered``: (first token, tokens) of what other pages of the host hold, in tokens of the stream.  ``common``: first
    tokens of the prefixes that most articles of the host hold, in tokens of the article.
    """
    stream = Stream.of(read)
    outside, n, hit = repeated(stream.blocks, covered, not stream.article)
    inside, _, _ = repeated(stream.article, [(at, RUN) for at in common], True)
    boilerplate = {id(b) for b in outside + inside}
    kept = []
    for b in read:
        if id(b) in boilerplate or b.chrome or stream.article and not b.article:
            continue
        if not stream.article and b.linked > MOSTLY * len(b.text):
            continue
        kept.append(b)
    return kept, n, hit


def _named(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, host, page): ``page`` names the host and the markup, so equal pages of a host are one."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.xxhash64(host).alias("host"))
    return rows.withColumn("page", F.xxhash64("host", "html"))


def stream_parts(pages: DataFrame) -> DataFrame:
    """(page, host, key, at, n, article, common) of every page of :func:`_named`: its stream's substrings, as lists, and if it has
    an article.  More rows, with a null page, have a host's keys that most of some rows' articles hold in ``common``."""

    @tidy
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        size = 0

        def found(hosts: list[int]) -> pa.RecordBatch:
            keys = [majority(held.pop(h)) for h in hosts]
            none = pa.nulls(len(hosts), kinds[0])
            lists = [pa.nulls(len(hosts), pa.list_(k)) for k in kinds]
            return pa.RecordBatch.from_arrays([none, pa.array(hosts, pa.int64()), *lists, pa.nulls(len(hosts), pa.bool_()), pa.array([k.view(np.int64) for k in keys], pa.list_(pa.int64()))], names)

        for batch in batches:
            for at, part in slices(strings(batch.column(1))):
                streams = [Stream.of(blocks(h)) for h in part.to_pylist()]
                host = batch.column(2).slice(at, len(part)).to_numpy(zero_copy_only=False)
                own, *columns = substrings([s.blocks for s in streams], host)
                order = np.argsort(own, kind="stable")
                ends = pa.array(np.searchsorted(own[order], np.arange(len(streams) + 1)), pa.int32())
                key, start, n = (x[order] for x in columns)
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (key.view(np.int64), start.astype(np.int32), n.astype(np.int32))]
                article = pa.array([bool(s.article) for s in streams])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(host), *lists, article, pa.nulls(len(streams), pa.list_(pa.int64()))], names)
                own, key, _ = prefixes([s.article for s in streams], host)
                for h, x, s in zip(host.tolist(), np.split(key, np.searchsorted(own, np.arange(1, len(streams)))), streams, strict=True):
                    if s.article:
                        held.setdefault(h, []).append(x)
                        size += len(x)
                        if len(held[h]) == GROUP:
                            size -= sum(map(len, held[h]))
                            yield found([h])
                if size > HELD:
                    yield found(list(held))
                    size = 0
        if held:
            yield found(list(held))

    kinds = [pa.int64(), pa.int32(), pa.int32()]
    names = ["page", "host", "key", "at", "n", "article", "common"]
    return pages.select("page", "html", "host").mapInArrow(made, "page bigint, host bigint, key array<bigint>, at array<int>, n array<int>, article boolean, common array<bigint>")


def articles(pages: DataFrame, found: DataFrame) -> DataFrame | None:
    """(page, common): first tokens of the prefixes in a page's article that most articles of its host hold (None: there are no such pages).

    ``found``: the stored :func:`stream_parts`.  Its ``common`` keys are counted over all pages; a filter of fixed size
    keeps most other keys of the articles from the shuffle."""
    hosts = found.where("article").groupBy("host").agg(F.count("*").alias("host_rows"), F.countDistinct("page").alias("host_pages")).where(F.col("host_pages") >= LEAST_PAGES)
    some = found.where("common is not null").select("host", F.explode("common").alias("key")).distinct()
    some = stage(some.join(hosts.hint("merge"), "host").drop("host"), "majorities")
    bit = F.col("key").bitwiseAND(BITS - 1)
    word = some.groupBy(F.shiftright(bit, 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(key & 31 as int))")).alias("bits")).collect()
    if not word:
        return None
    filled = np.zeros(BITS // 32, np.uint32)
    for r in word:
        filled[r.word] = r.bits

    @tidy
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in slices(strings(batch.column(1))):
                host = batch.column(2).slice(at, len(part)).to_numpy(zero_copy_only=False)
                own, key, start = prefixes([Stream.of(blocks(h)).article for h in part.to_pylist()], host)
                low = (key & np.uint64(BITS - 1)).astype(np.int64)
                ok = ((filled[low >> 5] >> (low & 31).astype(np.uint32)) & 1) == 1
                own, key, start = own[ok], key[ok], start[ok]
                order = np.lexsort((start, key, own))
                own, key, start = own[order], key[order], start[order]
                fresh = np.append(True, (np.diff(own) != 0) | (key[1:] != key[:-1]))[: len(own)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)).take(pa.array(own)), pa.array(key.view(np.int64)), pa.array(start.astype(np.int32)), pa.array(fresh)], ["page", "key", "at", "fresh"])

    rows = stage(pages.select("page", "html", "host").mapInArrow(made, "page bigint, key bigint, at int, fresh boolean"), "articles")
    held = rows.where("fresh").groupBy("key").agg(F.count("*").alias("rows"), F.countDistinct("page").alias("pages"))
    most = held.join(some.hint("merge"), "key").where(f"pages >= {LEAST_PAGES} and 2 * rows > host_rows and 2 * pages > host_pages").select("key")
    most = stage(most, "most", some)
    return stage(rows.join(most.hint("merge"), "key").groupBy("page").agg(F.collect_set("at").alias("common")), "common", rows, most)


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, url, page, packed) of every page of :func:`_named`: its blocks, compressed to travel."""
    kinds = [pages.schema[c].dataType.simpleString() for c in ("page_id", "url")]

    @tidy
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in slices(strings(batch.column(3))):
                packed = pa.array([pack(blocks(h)) for h in part.to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(at, len(part)) for k in range(3)), packed], ["page_id", "url", "page", "packed"])

    return pages.select("page_id", "url", "page", "html").mapInArrow(made, f"page_id {kinds[0]}, url {kinds[1]}, page bigint, packed binary")


def pack(read: list[Block]) -> bytes:
    return zlib.compress(json.dumps([(b.text, b.article, b.chrome, b.linked) for b in read]).encode())


def unpack(packed: bytes) -> list[Block]:
    return [Block(*b) for b in json.loads(zlib.decompress(packed))]


def repeats(found: DataFrame) -> DataFrame:
    """(page, covered): the parts of a page's stream that another page of its host holds, as a set of (at, n).
    The stored ``found`` is dropped.

    A frequent substring has one row a page in the join, which is dealt anew where one has a large share of the rows;
    neither side is broadcast, at any size."""
    rows = found.where("page is not null").select("page", F.explode(F.arrays_zip("key", "at", "n")).alias("s")).select("page", "s.key", "s.at", "s.n")
    keys = rows.groupBy("key").agg(F.min("page").alias("low"), F.max("page").alias("high")).where("low < high").select("key")
    keys = stage(keys, "repeated")
    return stage(rows.join(keys.hint("merge"), "key").groupBy("page").agg(F.collect_set(F.struct("at", "n")).alias("covered")), "covered", keys, found)


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_tokens, n_repeated) of every row of ``pages``.

    ``n_tokens`` and ``n_repeated``: tokens of the page's stream, and those that other pages of its host repeat."""
    rows = _named(pages)
    kinds = [rows.schema[c].dataType.simpleString() for c in ("page_id", "url")]

    @tidy
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for packed, covered, common in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                kept, n, hit = kept_blocks(unpack(packed), [(c["at"], c["n"]) for c in covered or ()], common or ())
                out.append(("\n".join(b.text for b in kept), n, hit))
            texts, n, hit = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(hit, pa.int64())], ["page_id", "url", "text", "n_tokens", "n_repeated"])

    found = stage(stream_parts(rows), "streams")
    common = articles(rows, found)
    covered = repeats(found)
    if common is None:
        covered = covered.withColumn("common", F.lit(None).cast("array<int>"))
    else:
        covered = covered.join(common.hint("merge"), "page", "full")
    joined = parsed(rows).join(covered.hint("merge"), "page", "left").select("page_id", "url", "packed", "covered", "common")
    out = joined.mapInArrow(made, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_tokens bigint, n_repeated bigint")
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_tokens", "n_repeated")
