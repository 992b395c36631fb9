"""Edits of one node file's text.  Every edit is a few spans with new text; all other bytes stay as they are.

Keys that start a line of the front matter count; an edge is an item ``- {rel: .., to: .., ..}`` of the block under
``edges:``, read by its fields and not by its spelling, so quotes and the order of fields don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from .markdown import plain

_FENCED = re.compile(r"\A---[ \t]*\r?\n(?P<inner>(?:.*?\n)??)---[ \t]*(?:\r?\n|\Z)", re.S)
_LINE = re.compile(r"[^\n]*\n|[^\n]+\Z")
_ITEM = re.compile(r"[ \t]+-[ \t]*\{.*\}[ \t]*\r?\n?\Z")
_FIELD = re.compile(r'(?P<key>\w+)[ \t]*:[ \t]*(?P<value>"(?:[^"\\]|\\.)*"|[^,}"]*?)[ \t]*(?=[,}])')
#: Keys that a new date stands before, and the file version that is written.
AFTER_DATES = ["interiority", "source", "source_ref", "plane", "planes", "tags", "aliases", "disambig", "organizer_version"]
VERSION = "v4"


class NoFront(ValueError):
    """The file has no front matter to edit."""


@dataclass
class Line:
    start: int
    end: int
    text: str

    @property
    def key(self) -> str | None:
        return self.text.partition(":")[0].strip() if self.text[:1] not in (" ", "\t") else None

    @property
    def item(self) -> dict[str, tuple[str, int, int]] | None:
        """{field: (value, start, end)} of an edge's line; null for any other."""
        if not _ITEM.match(self.text):
            return None
        return {m["key"]: (plain(m["value"]), self.start + m.start("value"), self.start + m.end("value")) for m in _FIELD.finditer(self.text)}


class File:
    """A text, its front matter's lines and what is to change."""

    def __init__(self, text: str):
        found = _FENCED.match(text)
        if not found:
            raise NoFront("the file has no front matter")
        self.text, self.changes = text, []
        self.body = found.end()
        self.close = found.end("inner")
        self.lines = [Line(found.start("inner") + m.start(), found.start("inner") + m.end(), m[0]) for m in _LINE.finditer(found["inner"])]
        self.newline = "\r\n" if text.split("\n", 1)[0].endswith("\r") else "\n"

    def change(self, start: int, end: int, new: str) -> None:
        self.changes.append((start, end, new))

    def insert(self, at: int, *lines: str) -> None:
        self.change(at, at, "".join(line + self.newline for line in lines))

    def done(self) -> str:
        out, at = [], 0
        for start, end, new in sorted(self.changes, key=lambda c: c[:2]):
            out += [self.text[at:start], new]
            at = end
        return "".join([*out, self.text[at:]])

    def edges(self) -> tuple[int, list[Line]]:
        """(where a further edge goes, the edge block's lines); -1 without a block."""
        at = next((k for k, line in enumerate(self.lines) if line.text.strip() == "edges:"), None)
        if at is None:
            return -1, []
        block = []
        for line in self.lines[at + 1 :]:
            if line.text[:1] not in (" ", "\t"):
                break
            block.append(line)
        return (block[-1] if block else self.lines[at]).end, block


def scalar(value: str) -> str:
    """A value as it is written: bare where it is letters, digits, - and _, else in quotes."""
    return value if re.fullmatch(r"[A-Za-z0-9_\-]+", value) else '"' + re.sub(r'(["\\])', r"\\\1", value) + '"'


def inline(values: list[str]) -> str:
    return "[" + ", ".join(map(scalar, values)) + "]"


def edge_line(edge: dict) -> str:
    parts = [f"rel: {scalar(edge['rel'])}", f"to: {scalar(edge['to'])}"]
    if edge.get("conf") is not None:
        parts.append(f"conf: {edge['conf']:g}")
    parts += [f"{k}: {scalar(edge[k])}" for k in ("since", "until") if edge.get(k)]
    return "  - {" + ", ".join(parts) + "}"


def _ends(item: dict) -> tuple[str | None, str | None]:
    return tuple(item[k][0] if k in item and item[k][0] else None for k in ("rel", "to"))


def with_edges(text: str, edges: list[dict]) -> tuple[str, int]:
    """Edges appended that the file has not (same relation and target), and how many."""
    file = File(text)
    at, block = file.edges()
    there = {_ends(line.item) for line in block if line.item}
    new = [edge_line(e) for e in edges if (e["rel"], e["to"]) not in there]
    if new:
        file.insert(file.close if at < 0 else at, *(["edges:"] if at < 0 else []), *new)
    return file.done(), len(new)


def _rewritten(text: str, field: str, new: str, matches) -> tuple[str, int]:
    """``field`` of matching edges set to ``new``; of edges that are then equal the first stays.  No match, no change."""
    file, seen, n = File(text), set(), 0
    for line in file.edges()[1]:
        item = line.item
        if item is None:
            continue
        ends = _ends(item)
        if hit := matches(*ends):
            n += 1
            ends = (new, ends[1]) if field == "rel" else (ends[0], new)
        if None not in ends and ends in seen:
            file.change(line.start, line.end, "")
        elif hit:
            file.change(item[field][1], item[field][2], scalar(new))
        seen.add(ends)
    return (file.done(), n) if n else (text, 0)


def retargeted(text: str, old: str, new: str) -> tuple[str, int]:
    """Edges to ``old`` lead to ``new``, as after a merge."""
    try:
        return _rewritten(text, "to", new, lambda rel, to: to == old)
    except NoFront:
        return text, 0


def retyped(text: str, to: str, old: str, new: str) -> tuple[str, int]:
    """Edges ``old`` to ``to`` become ``new``; their dates stay."""
    try:
        return _rewritten(text, "rel", new, lambda rel, dst: rel == old and dst == to)
    except NoFront:
        return text, 0


def _set(file: File, key: str, rendered: str | None, before: list[str]) -> None:
    """The line of ``key`` replaced or removed, or put before the first of ``before`` or the edges."""
    for line in file.lines:
        if line.key == key:
            ending = line.text[len(line.text.rstrip("\r\n")) :]
            file.change(line.start, line.end, "" if rendered is None else rendered + ending)
            return
    if rendered is not None:
        at = next((line.start for line in file.lines if line.text.strip() == "edges:" or line.key in before), file.close)
        file.insert(at, rendered)


def with_list(text: str, key: str, values: list[str]) -> tuple[str, int]:
    """``key: [..]`` set, in place or before the edges."""
    file = File(text)
    _set(file, key, f"{key}: {inline(values)}", [])
    out = file.done()
    return out, int(out != text)


def with_dates(text: str, first: str | None, last: str | None) -> tuple[str, int]:
    """``occurred`` and ``occurred_end`` set, or removed where null."""
    file = File(text)
    for key, value in (("occurred", first), ("occurred_end", last)):
        _set(file, key, None if value is None else f"{key}: {scalar(value)}", AFTER_DATES)
    out = file.done()
    return out, int(out != text)


def with_token(text: str, old: str, new: str) -> tuple[str, int]:
    """The first ``old`` of the body, never of the front matter, replaced."""
    found = _FENCED.match(text)
    at = text.find(old, found.end()) if found and old else -1
    return (text, 0) if at < 0 else (text[:at] + new + text[at + len(old) :], 1)


def tombstone(ident: str, kind: str, survivor: str) -> str:
    """What a merged node's file holds: who it was and where it went."""
    return "\n".join(["---", f"id: {ident}", f"type: {scalar(kind)}", f"merged_into: {scalar(survivor)}", "---", "", "(merged)", ""])


def rendered(node: dict) -> str:
    """A whole file: front matter without what is empty, title, body."""

    def front() -> Iterator[str]:
        yield f"id: {node['id']}"
        yield f"type: {scalar(node['type'])}"
        yield f"created: {node['created']}"
        for key in ("occurred", "occurred_end", "interiority"):
            if node.get(key):
                yield f"{key}: {scalar(node[key])}"
        yield f"source: {scalar(node['source'])}"
        for key in ("source_ref", "plane"):
            if node.get(key):
                yield f"{key}: {scalar(node[key])}"
        for key in ("planes", "tags"):
            yield f"{key}: {inline(node.get(key) or [])}"
        if node.get("aliases"):
            yield f"aliases: {inline(node['aliases'])}"
        if node.get("disambig"):
            yield f"disambig: {scalar(node['disambig'])}"
        yield f"organizer_version: {scalar(node.get('organizer_version') or VERSION)}"
        if node.get("edges"):
            yield "edges:"
            yield from (edge_line(e) for e in node["edges"])

    return "\n".join(["---", *front(), "---", "", f"# {node['title']}", "", node["body"].strip()]).rstrip() + "\n"


def applied(text: str | None, edits: list) -> tuple[str | None, int, str | None]:
    """(text, changes, error) after edits (op, a, b, c, values) in turn; an edit that can't be made leaves the rest to go on."""
    n, errors = 0, []
    for e in edits:
        try:
            if text is None:
                raise NoFront("the file is gone")
            if e["op"] == "append":
                text, k = with_edges(text, [{"rel": e["a"], "to": e["b"], "since": e["c"]}])
            elif e["op"] == "retarget":
                text, k = retargeted(text, e["a"], e["b"])
            elif e["op"] == "retype":
                text, k = retyped(text, e["a"], e["b"], e["c"])
            elif e["op"] == "list":
                text, k = with_list(text, e["a"], [v for v in (e["values"] if e["values"] is not None else [])])
            elif e["op"] == "dates":
                text, k = with_dates(text, e["a"], e["b"])
            elif e["op"] == "token":
                text, k = with_token(text, e["a"], e["b"])
            elif e["op"] == "tombstone":
                new = tombstone(e["a"], e["b"], e["c"])
                text, k = new, int(new != text)
            else:
                raise ValueError(f"no such edit: {e['op']}")
            n += k
        except ValueError as error:
            errors.append(f"{e['op']}: {error}")
    return text, n, "; ".join(errors) or None
