"""Columns over Markdown node files: frontmatter, edges, title, body and chunks.

Where a line's meaning depends on the lines before it (quoted lists, fenced code, packing of paragraphs) small
Arrow-batched functions read one file at a time; the rest are expressions.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

_TEXT, _TEXTS = StringType(), ArrayType(StringType())
_FIELDS = StructType([StructField("scalars", MapType(_TEXT, _TEXT)), StructField("lists", MapType(_TEXT, _TEXTS))])
_EDGES = ArrayType(StructType([StructField(k, _TEXT) for k in ("rel", "to", "conf", "since", "until")]))
FRONT = r"(?s)\A---[ \t]*\n(.*?\n|)---[ \t]*(?:\n|\z)"
_BREAK = re.compile(r"^(?:[ \t]*(?P<fence>```|~~~)|(?P<mark>#{1,6})[ \t]+(?P<title>\S.*))", re.M)
_BLANK = re.compile(r"\n[ \t]*\n\s*")
_ITEM = re.compile(r'\s*("(?:[^"\\]|\\.)*"|(?:[^,"]|"(?:[^"\\]|\\.)*")*?)\s*(?:,|\Z)')
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "strandweave:node")


def newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def front(text: Column) -> Column:
    """What stands between the opening fences; null without them."""
    t = newlines(text)
    return F.when(t.rlike(FRONT), F.regexp_extract(t, FRONT, 1))


def body(text: Column) -> Column:
    return F.regexp_replace(newlines(text), FRONT, "")


def content_hash(text: Column) -> Column:
    return F.sha2(F.encode(newlines(text), "UTF-8"), 256)


def plain(value: str) -> str:
    """A scalar without its double quotes and their escapes."""
    if len(value) > 1 and value[0] == value[-1] == '"':
        return re.sub(r'\\(["\\])', r"\1", value[1:-1])
    return value


def items(inner: str) -> list[str]:
    """The parts of an inline list or mapping; commas inside double quotes are text."""
    out, at = [], 0
    while at < len(inner):
        m = _ITEM.match(inner, at)
        if not m or m.end() == at:
            out.append(inner[at:].strip())
            break
        out.append(m[1])
        at = m.end()
    return [x for x in out if x]


def fields_of(inner: str | None) -> tuple[dict[str, str], dict[str, list[str]]]:
    """(scalars, inline lists) by key: keys start a line; comments and nested lines are left out."""
    scalars: dict[str, str] = {}
    lists: dict[str, list[str]] = {}
    for line in (inner or "").split("\n"):
        m = re.match(r"([^\s#:][^:]*?)[ \t]*:[ \t]*(.*?)[ \t]*\Z", line)
        if not m:
            continue
        scalars.pop(m[1], None), lists.pop(m[1], None)
        if m[2].startswith("[") and m[2].endswith("]"):
            lists[m[1]] = [y for x in items(m[2][1:-1]) if (y := plain(x))]
        else:
            scalars[m[1]] = plain(m[2])
    return scalars, lists


@F.pandas_udf(_FIELDS)
def parse_front(inner: pd.Series) -> pd.DataFrame:
    rows = [fields_of(x) for x in inner]
    return pd.DataFrame({"scalars": [s for s, _ in rows], "lists": [x for _, x in rows]})


def edges_of(inner: str | None) -> list[dict[str, str | None]]:
    """Items ``- {rel: .., to: .., ..}`` of the block under ``edges:``; those without both are left out."""
    m = re.search(r"^[ \t]*edges:[^\n]*\n((?:[ \t][^\n]*(?:\n|\Z))*)", inner or "", re.M)
    out = []
    for line in (m[1] if m else "").split("\n"):
        own = re.match(r"\s*-\s*\{(.*)\}\s*\Z", line)
        if own:
            pairs = dict((k.strip(), plain(v.strip())) for k, colon, v in (x.partition(":") for x in items(own[1])) if colon)
            if pairs.get("rel") and pairs.get("to"):
                out.append({k: pairs.get(k) for k in ("rel", "to", "conf", "since", "until")})
    return out


@F.pandas_udf(_EDGES)
def parse_edges(inner: pd.Series) -> pd.Series:
    return inner.map(edges_of)


def _marks(text: str) -> Iterator[re.Match]:
    """Heading lines outside fenced code."""
    fenced = False
    for m in _BREAK.finditer(text):
        if m["fence"]:
            fenced = not fenced
        elif not fenced:
            yield m


@F.pandas_udf(_TEXT)
def first_heading(text: pd.Series) -> pd.Series:
    return text.map(lambda t: next((m["title"].strip() for m in _marks(t or "") if m["mark"] == "#"), None))


def chunks_of(text: str | None, size: int, overlap: int) -> list[str]:
    """Sections at headings; a long one packed by paragraphs, a long paragraph cut into overlapping windows."""
    text = re.sub(r"\r\n?", "\n", text or "")
    cuts = [0, *(m.start() for m in _marks(text) if m.start()), len(text)]
    step = size - overlap if overlap < size else size
    out: list[str] = []
    for section in (text[a:b].strip() for a, b in zip(cuts, cuts[1:], strict=False)):
        if len(section) <= size:
            out += [section] if section else []
            continue
        packed: list[str] = []
        for p in filter(None, (p.strip() for p in _BLANK.split(section))):
            if len(p) > size:
                windows = max(0, -(-(len(p) - size) // step)) + 1
                out += ["\n\n".join(packed)] if packed else []
                out += [p[k * step : k * step + size] for k in range(windows)]
                packed = []
            elif packed and sum(map(len, packed)) + 2 * len(packed) + len(p) > size:
                out.append("\n\n".join(packed))
                packed = [p]
            else:
                packed.append(p)
        out += ["\n\n".join(packed)] if packed else []
    return out


def chunks(text: Column, size: int = 1200, overlap: int = 200) -> Column:
    if size <= 0 or overlap < 0:
        raise ValueError("a chunk's size is positive and its overlap not negative")

    @F.pandas_udf(_TEXTS)
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunks_of(t, size, overlap))

    return cut(text)


@F.pandas_udf(_TEXT)
def fold_marks(text: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks; case stays."""
    return text.map(lambda t: t if t is None or t.isascii() else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


@F.pandas_udf(_TEXT)
def path_id(path: pd.Series) -> pd.Series:
    """The stable id of a file that names none."""
    return path.map(lambda p: str(uuid.uuid5(NAMESPACE, p)))
