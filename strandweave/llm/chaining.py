"""Repeated passages by collinear chaining, and their removal.

Every document of ``LEAST_WORDS`` words or more is winnowed to seeds: runs of ``SEED`` words whose hash is smallest in
some window of ``WINDOW`` runs.  Each occurrence of a seed is joined with the seed's first holder, so a frequent
passage costs one row an occurrence.  A stock sentence's first holder would hide later holders of a passage that goes
on beyond the sentence; therefore areas of seeds whose first holders don't agree are keys of their own.  An area's later
holders are joined with its first one, which holds all that they have there.  In first holders, sequences of seeds (two
neighbours, and as many as span ``SPAN`` words) are keys too, and each is joined with the sequence's first holder; so
the sequences grow with the different areas and not with their holders.  Where own words are so few that winnowing
takes no seed with them, whole runs of ``LEAST_WORDS`` words are keys: those that reach beyond a stretch of shared seeds.  Beyond a stretch that is long enough
to be a passage itself they are not asked for: up to ``WINDOW`` - 1 words next to it may stay though a third document has them too.

Per pair of documents, seeds on one diagonal merge into segments, and the best collinear chains of segments, with a
gap cost in both documents, are read off a Fenwick tree of prefix maxima.  Each chain is then aligned on the two
texts, ``EDGE_WORDS`` words beyond its ends (whatever goes on for longer has seeds of its own): words on the outer
diagonals and in the gaps are compared, and every maximal stretch (``MATCH`` a word in common, less for others: the
best-scoring one, then the best to its left and right, and so on) is a passage if it has at least ``LEAST_WORDS`` words
in this document and at least ``SIMILARITY`` of them in common.

The document of the smaller doc_id keeps its passage; it is cut from the others.  Texts are read whole.  Null text
counts as empty and null doc_ids are left alone.  Rows equal in doc_id and text are one document.  Rows of a doc_id
with several texts are documents of their own; they, and ids that are no integers, take their turn by a 64-bit hash
of id and text.  Passages repeated inside one document only are not looked for.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import short_batches, stage
from .textkit import mix, shingles, slices, strings, tidy, words

SEED, WINDOW, LEAST_WORDS, SIMILARITY = 5, 8, 50, 0.8
SPAN = LEAST_WORDS - 2 * (WINDOW - 1)  #: every exact passage holds a sequence of seeds that spans so many words
RUNGS = tuple(range(0, LEAST_WORDS - SEED + 1, 3 * SEED))  #: words at which a match of ``LEAST_WORDS`` stands among seeds; they make one segment
EDGE_WORDS = LEAST_WORDS + 2 * WINDOW
LEAST_SPAN = 2 * SEED  #: words that a chain spans at least, in this document; shorter ones are chance phrases
GAP = 0.1  #: cost of a word skipped in either document
MATCH = 1.0
MISS, MISS_LONG, LONG = -2.0, -3.0, 8  #: score of each word not in common, and where more than ``LONG`` of them stand together
STRICT = -SIMILARITY / (1 - SIMILARITY)  #: in place of both inside a stretch that falls short of SIMILARITY
_WORD = re.compile(r"[^\x00-\x20]+")
_ODD = re.compile("[\x00-\x08\x0e-\x1b\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")  #: where str.split finds other words


def winnow(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Indices of the runs that are smallest (the last of equals) in some window of their own document."""
    if len(h) < WINDOW:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(h[::-1], WINDOW)
    at = len(h) - 1 - (np.arange(len(view)) + view.argmin(1))
    first = len(h) - WINDOW - np.arange(len(view))
    return np.unique(at[doc[first] == doc[first + WINDOW - 1]])


def _fresh(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which rows are the first of their key in their document."""
    order = np.lexsort((key, doc))  # stable
    out = np.ones(len(doc), bool)
    out[order[1:]] = (np.diff(doc[order]) != 0) | (key[order[1:]] != key[order[:-1]])
    return out


def seeds(docs: DataFrame) -> DataFrame:
    """(key, doc, word, point, fresh): winnowed seeds of ``docs`` (doc, text) with their first word's number and code
    point; ``fresh`` at the first of a seed's places in a document."""

    @tidy
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in slices(strings(batch.column(1))):
                w = words(part)
                h, doc, first = shingles(w, SEED)
                long = (np.diff(w.first) >= LEAST_WORDS)[doc] if len(doc) else np.zeros(0, bool)
                h, doc, first = h[long], doc[long], first[long]
                pick = winnow(h, doc)
                points = w.points()
                own = doc[pick]
                point = points[w.start[first[pick]]] - points[w.offsets[own]]
                columns = [pa.array(h[pick].view(np.int64)), batch.column(0).slice(at, len(part)).take(pa.array(own)), pa.array((first[pick] - w.first[own]).astype(np.int32)), pa.array(point.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(_fresh(own, h[pick]))], ["key", "doc", "word", "point", "fresh"])

    return docs.select("doc", "text").mapInArrow(made, "key bigint, doc bigint, word int, point int, fresh boolean")


def with_first(rows: DataFrame) -> DataFrame:
    """The stored ``rows`` whose key two documents hold, with the key's first holder ``rep`` and the
    ``rep_word`` and ``rep_point`` of its first row there.  ``rows`` is dropped.

    The keys are stored, so that the join is dealt anew where one key has a large share of the rows.  They grow with
    the input and are never broadcast.
    """
    place = F.expr("min_by(shiftleft(cast(word as bigint), 32) + point, if(fresh, doc, null))")
    keys = rows.groupBy("key").agg(F.min("doc").alias("rep"), F.max("doc").alias("last"), place.alias("place")).where("rep < last")
    keys = stage(keys.selectExpr("key", "rep", "cast(shiftright(place, 32) as int) as rep_word", "cast(place & 2147483647 as int) as rep_point"), "keys")
    return stage(rows.drop("fresh").join(keys.hint("merge"), "key"), "shared", rows, keys)


def areas(rows: DataFrame) -> DataFrame:
    """(key, doc, word, point, seeds, steps, points, reps, lines, fresh): stretches of shared seeds without a window that has no seed
    in between, where their first holders or diagonals differ; ``steps`` and ``points`` are the seeds' distances from the first one.

    Equal seeds at equal distances have one key; what else is in the row (but for doc, word and points) follows from it."""
    rows = rows.select("doc", "word", "point", "key", "rep", "rep_word").repartition("doc").sortWithinPartitions("doc", "word")

    @tidy
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in whole_groups(batches, 1):
            once = np.append(True, (np.diff(c[0]) != 0) | (np.diff(c[1]) != 0))
            doc, word, point, key, rep, rep_word = (x[once] for x in c)
            line = word.astype(np.int64) - rep_word
            hole = np.append(True, (np.diff(doc) != 0) | (np.diff(word) > WINDOW))
            turn = hole | np.append(True, (np.diff(rep) != 0) | (np.diff(line) != 0))
            start = np.flatnonzero(hole)
            size = np.diff(np.append(start, len(doc)))
            several = np.add.reduceat(turn.astype(np.int64), start) > 1
            kept = np.repeat(several, size)
            start, size = start[several], size[several]
            if not len(start):
                continue
            at = np.append(0, np.cumsum(size))
            step = word[kept] - np.repeat(word[start], size)
            with np.errstate(over="ignore"):
                each = mix(key[kept].view(np.uint64)) * (2 * step.astype(np.uint64) + np.uint64(1))
                name = mix(np.add.reduceat(each, at[:-1])).view(np.int64)
            lists = [key[kept], step.astype(np.int32), (point[kept] - np.repeat(point[start], size)).astype(np.int32), rep[kept], line[kept] - np.repeat(line[start], size)]
            columns = [pa.array(x) for x in (name, doc[start], word[start], point[start])]
            columns += [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x)) for x in lists]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(_fresh(doc[start], name))], names)

    names = ["key", "doc", "word", "point", "seeds", "steps", "points", "reps", "lines", "fresh"]
    return rows.mapInArrow(made, "key bigint, doc bigint, word int, point int, seeds array<bigint>, steps array<int>, points array<int>, reps array<bigint>, lines array<bigint>, fresh boolean")


def classes(rows: DataFrame) -> DataFrame:
    """The stored areas ``rows`` with the first document ``rep`` that holds an equal one, and its place there.  ``rows`` is dropped."""
    place = F.expr("min_by(shiftleft(cast(word as bigint), 32) + point, if(fresh, doc, null))")
    keys = stage(rows.groupBy("key").agg(F.min("doc").alias("rep"), place.alias("place")), "area-keys")
    rows_with = rows.drop("fresh").join(keys.hint("merge"), "key")
    rows_with = rows_with.selectExpr("*", "cast(shiftright(place, 32) as int) as rep_word", "cast(place & 2147483647 as int) as rep_point").drop("place", "key")
    return stage(rows_with, "classes", rows, keys)


def stepped(rows: DataFrame) -> DataFrame:
    """Matches of the areas ``rows`` with their first holder: as few seeds as make one segment of each area."""
    few = f"""aggregate(sequence(0, size(steps) - 1), array(0),
        (acc, k) -> if(k + 1 = size(steps) or get(steps, k + 1) - steps[element_at(acc, -1)] > {2 * WINDOW + SEED}, array_append(acc, k), acc), acc -> array_distinct(acc))"""
    rows = rows.select("doc", "rep", "word", "rep_word", "point", "rep_point", "steps", "points", F.explode(F.expr(few)).alias("k"))
    return rows.selectExpr("doc", "rep", "word + steps[k] as word", "rep_word + steps[k] as rep_word", "point + points[k] as point", "rep_point + points[k] as rep_point")


def sequences(rows: DataFrame) -> DataFrame:
    """(key, doc, word, point, words, points, rep_a, rep_b, fresh): sequences of an area's seeds, two or spanning ``SPAN`` words, that
    do not lie on one diagonal of one first holder; with the distances of the last seed from the first, and the first holders of both.
    Which they are depends on the words alone, so all holders of a sequence agree."""
    rows = rows.select("doc", "word", "point", "seeds", "steps", "points", "reps", "lines").repartition("doc").sortWithinPartitions("doc", "word")

    @tidy
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in whole_groups(batches, 1):
            size = np.array([len(x) for x in c[3]])
            area = np.repeat(np.arange(len(size)), size)
            key, step, points, rep, line = (np.concatenate(x) for x in c[3:])
            doc, word, point = c[0][area], c[1][area] + step, c[2][area] + points
            n = len(doc)
            turn = np.cumsum(np.append(False, (np.diff(area) != 0) | (np.diff(rep) != 0) | (np.diff(line) != 0)))
            place = (area.astype(np.int64) << 32) + step
            out = []
            with np.errstate(over="ignore"):
                each = mix(key.view(np.uint64)) * np.uint64(0xD1342543DE82EF95)
                total = np.append(np.uint64(0), np.cumsum(each * (2 * step.astype(np.uint64) + np.uint64(1))))
                plain = np.append(np.uint64(0), np.cumsum(each))
                for kind, last in ((1, np.arange(1, n + 1)), (2, np.searchsorted(place, place + (SPAN - SEED)))):
                    i = np.flatnonzero(last < n)
                    j = last[i]
                    ok = (area[i] == area[j]) & (turn[i] != turn[j]) & (j - i >= kind)
                    i, j = i[ok], j[ok]
                    # seeds and their distances from the first one
                    inside = total[j + 1] - total[i] - (plain[j + 1] - plain[i]) * (2 * step[i].astype(np.uint64))
                    out.append((mix(inside + np.uint64(kind)).view(np.int64), i, j))
            k, i, j = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k, doc[i], word[i], point[i], word[j] - word[i], point[j] - point[i], rep[i], rep[j], _fresh(doc[i], k))], names)

    names = ["key", "doc", "word", "point", "words", "points", "rep_a", "rep_b", "fresh"]
    return rows.mapInArrow(made, "key bigint, doc bigint, word int, point int, words int, points int, rep_a bigint, rep_b bigint, fresh boolean")


def ends(rows: DataFrame) -> DataFrame:
    """(doc, low, high): places of ``LEAST_WORDS`` words that reach beyond a stretch of shared seeds and have seeds in every
    window; such words may be shared where the stretch is a stock sentence with other first holders.

    Where the seeds on one diagonal at that end span ``LEAST_WORDS`` words they are a passage themselves, and there are no such places."""
    rows = rows.select("doc", "word", "rep", "rep_word").repartition("doc").sortWithinPartitions("doc", "word")

    @tidy
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, word, rep, rep_word in whole_groups(batches, 1):
            word = word.astype(np.int64)
            hole = np.append(True, (np.diff(doc) != 0) | (np.diff(word) > WINDOW))
            turn = np.flatnonzero(hole | np.append(True, (np.diff(rep) != 0) | (np.diff(word - rep_word) != 0)))
            span = word[np.append(turn[1:], len(word)) - 1] + SEED - word[turn]
            start = np.flatnonzero(hole)
            stop = np.append(start[1:], len(word))
            head, tail = span[np.searchsorted(turn, start)], span[np.searchsorted(turn, stop) - 1]
            a, z = word[start], word[stop - 1]
            high = z + 1 - (LEAST_WORDS - SEED - WINDOW + 1)  # one after the last place whose windows all have seeds
            within = z + SEED - LEAST_WORDS + 1  # one after the last place inside the stretch
            low = np.concatenate([np.maximum(a - WINDOW + 1, 0), np.maximum(np.maximum(a, within), 0)])
            high = np.concatenate([np.minimum(a, high), high])
            ok = (low < high) & (np.append(head, tail) < LEAST_WORDS)
            yield pa.RecordBatch.from_arrays([pa.array(x[ok]) for x in (np.tile(doc[start], 2), low.astype(np.int32), high.astype(np.int32))], ["doc", "low", "high"])

    return rows.mapInArrow(made, "doc bigint, low int, high int")


def whole(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(key, doc, word, point, points, fresh): keys of all ``LEAST_WORDS`` words at ``places`` (doc, low, high), the last being left out,
    with the distances in code points of the words ``RUNGS`` from the first."""
    asked = places.groupBy("doc").agg(F.collect_set(F.struct("low", "high")).alias("places"))

    @tidy
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in slices(strings(batch.column(1))):
                w = words(part)
                wanted = batch.column(2).slice(at, len(part))
                own = np.repeat(np.arange(len(part)), [len(x) for x in wanted])
                flat = wanted.flatten()
                low, high = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) + w.first[own] for k in (0, 1))
                size = np.maximum(np.minimum(high, w.first[own + 1] - LEAST_WORDS + 1) - low, 0)
                place = np.unique(np.repeat(low - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum()))
                total = np.zeros(len(place), np.uint64)
                with np.errstate(over="ignore"):
                    for k in range(LEAST_WORDS):
                        total = total * np.uint64(0xD1342543DE82EF95) + w.hash[place + k]
                key, doc, points = mix(total).view(np.int64), w.doc[place], w.points()
                point = points[w.start[place]]
                rungs = np.stack([points[w.start[place + k]] - point for k in RUNGS], 1).astype(np.int32)
                rungs = pa.FixedSizeListArray.from_arrays(pa.array(rungs.ravel()), len(RUNGS)).cast(pa.list_(pa.int32()))
                columns = [pa.array(key), batch.column(0).slice(at, len(part)).take(pa.array(doc)), pa.array((place - w.first[doc]).astype(np.int32)), pa.array((point - points[w.offsets[doc]]).astype(np.int32)), rungs]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(_fresh(doc, key))], ["key", "doc", "word", "point", "points", "fresh"])

    rows = docs.join(asked.hint("merge"), "doc").select("doc", "text", "places")
    return rows.mapInArrow(made, "key bigint, doc bigint, word int, point int, points array<int>, fresh boolean")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """The batches' columns with rows that are equal in the first ``keys`` columns kept together (they come sorted)."""
    kept: list[np.ndarray] | None = None
    for batch in batches:
        c = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
        if kept is not None:
            c = [np.concatenate(x) for x in zip(kept, c, strict=True)]
        if not len(c[0]):
            continue
        other = np.logical_or.reduce([x != x[-1] for x in c[:keys]])
        cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
        kept = [x[cut:] for x in c]
        if cut:
            yield [x[:cut] for x in c]
    if kept is not None:
        yield kept


def segments(word: np.ndarray, other: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    """(first, last) match of each run of matches on one diagonal of a group, by group and word; matches are sorted so."""
    group = np.zeros(len(word), np.int64) if group is None else group
    diagonal = other.astype(np.int64) - word
    order = np.lexsort((word, diagonal, group))
    d, w, g = diagonal[order], word[order], group[order]
    cut = np.flatnonzero((np.diff(g) != 0) | (np.diff(d) != 0) | (np.diff(w) > 2 * WINDOW + SEED)) + 1
    first, last = order[np.append(0, cut)], order[np.append(cut, len(order)) - 1]
    by = np.argsort(first, kind="stable")
    return np.stack([first[by], last[by]], 1)


def chains(word: np.ndarray, other: np.ndarray, seg: np.ndarray | None = None) -> list[list[tuple[int, int]]]:
    """Best disjoint collinear chains of a pair's matches, as lists of (first match, last match) segments."""
    seg = segments(word, other) if seg is None else seg
    if len(seg) == 1:
        return [[tuple(seg[0].tolist())]]
    x0, x1, y0, y1 = (x.tolist() for x in (word[seg[:, 0]], word[seg[:, 1]] + SEED, other[seg[:, 0]], other[seg[:, 1]] + SEED))
    weight = [float(b - a) for a, b in zip(x0, x1, strict=True)]
    ranks = sorted(set(y1))
    below = {y: k + 1 for k, y in enumerate(ranks)}
    limit = np.searchsorted(ranks, np.array(y0) + SEED - 1, "right").tolist()
    tree_value, tree_item = [-np.inf] * (len(ranks) + 1), [-1] * (len(ranks) + 1)
    score, back = list(weight), [-1] * len(seg)
    # a segment may follow those that end before it starts in both documents: enter them by their end
    enter = sorted(range(len(seg)), key=x1.__getitem__)
    entered = 0
    for k in sorted(range(len(seg)), key=x0.__getitem__):
        while entered < len(enter) and x1[enter[entered]] <= x0[k] + SEED - 1:
            j = enter[entered]
            if x0[j] >= x0[k]:
                break
            value, at = score[j] + GAP * (x1[j] + y1[j]), below[y1[j]]
            while at < len(tree_value):
                if value > tree_value[at]:
                    tree_value[at], tree_item[at] = value, j
                at += at & -at
            entered += 1
        at, best, item = limit[k], 0.0, -1
        while at > 0:
            if tree_value[at] - GAP * (x0[k] + y0[k]) > best:
                best, item = tree_value[at] - GAP * (x0[k] + y0[k]), tree_item[at]
            at -= at & -at
        if item >= 0 and y0[item] < y0[k]:
            score[k], back[k] = weight[k] + best, item
    used, out = [False] * len(seg), []
    for k in sorted(range(len(seg)), key=lambda k: -score[k]):
        chain = []
        while k >= 0 and not used[k]:
            used[k] = True
            chain.append((int(seg[k, 0]), int(seg[k, 1])))
            k = back[k]
        if chain:
            out.append(chain[::-1])
    return out


CHAIN = "doc bigint, rep bigint, start int, stop int, rep_start int, rep_stop int, links array<int>"
COLUMNS = [c.split()[0] for c in CHAIN.split(", ")]


def chained(matches: DataFrame) -> DataFrame:
    """Chains that span at least ``LEAST_SPAN`` words.  ``links``: word numbers (from the first seed's) where segments start and end,
    in this document and in the other: x0, x1, y0, y1 for each segment."""
    rows = matches.select("doc", "rep", "word", "rep_word", "point", "rep_point").repartition("doc", "rep").sortWithinPartitions("doc", "rep", "word", "rep_word")

    def results(c: list[np.ndarray]) -> pd.DataFrame:
        new = np.append(True, (np.diff(c[0]) != 0) | (np.diff(c[1]) != 0))
        once = new | np.append(True, (np.diff(c[2]) != 0) | (np.diff(c[3]) != 0))
        group = np.cumsum(new)[once] - 1
        c = [x[once] for x in c]
        many = (np.bincount(group, minlength=1) > 1)[group] if len(group) else np.zeros(0, bool)
        doc, rep, word, other, point, rep_point = (x[many] for x in c)
        group = group[many]
        out: list[tuple] = []
        if not len(group):
            return pd.DataFrame(out, columns=COLUMNS)
        seg = segments(word, other, group)
        owner = group[seg[:, 0]]
        at = np.flatnonzero(np.append(True, np.diff(owner) != 0))
        size = np.diff(np.append(at, len(seg)))
        low, high = word[seg[:, 0]], word[seg[:, 1]] + SEED
        long = high - low >= LEAST_SPAN
        # chains of several segments exist only where all the group's matches outweigh a gap between neighbours
        weight = np.add.reduceat((word[seg[:, 1]] - word[seg[:, 0]] + SEED).astype(float), at)
        gap = np.full(len(seg), np.inf)
        gap[1:] = np.where(np.diff(owner) == 0, word[seg[1:, 0]] - np.maximum.accumulate((owner << 33) + word[seg[:, 1]])[:-1] % (1 << 33) - SEED, np.inf)
        near = (size > 1) & (np.minimum.reduceat(gap, at) * GAP < weight) & (np.maximum.reduceat(high, at) - np.minimum.reduceat(low, at) >= LEAST_SPAN)
        for g in np.flatnonzero(near | np.logical_or.reduceat(long, at)).tolist():
            own = seg[at[g] : at[g] + size[g]]
            picked = chains(word, other, own) if near[g] else [[(int(s), int(e))] for s, e in own[long[at[g] : at[g] + size[g]]]]
            for chain in picked:
                a, z = chain[0][0], chain[-1][1]
                if word[z] + SEED - word[a] >= LEAST_SPAN:
                    links = [int(n) for s, e in chain for n in (word[s] - word[a], word[e] + SEED - word[a], other[s] - other[a], other[e] + SEED - other[a])]
                    out.append((doc[a], rep[a], point[a], point[z], rep_point[a], rep_point[z], links))
        return pd.DataFrame(out, columns=COLUMNS)

    @tidy
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in whole_groups(batches, 2):
            yield pa.RecordBatch.from_pandas(results(c), kind, preserve_index=False)

    kind = pa.schema([(c, pa.list_(pa.int32()) if c == "links" else pa.int64() if c in ("doc", "rep") else pa.int32()) for c in COLUMNS])
    return rows.mapInArrow(made, CHAIN)


CELLS = 1 << 28  #: bits of an alignment's rows held at once; larger ones are halved first


def _rows(a: list[str], b: list[str]) -> Iterator[int]:
    """Rows of the longest common subsequence, bit-parallel: bit j is 0 where word j of ``b`` makes it longer."""
    places: dict[str, int] = {}
    for j, w in enumerate(b):
        places[w] = places.get(w, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for w in a:
        use = row & places.get(w, 0)
        row = ((row + use) | (row - use)) & full
        yield row


def _longest(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence of any two lists of words, as (number in ``a``, number in ``b``)."""
    if not set(a) & set(b):
        return []
    if len(a) > 1 and len(a) * len(b) > CELLS:
        half = len(a) // 2

        def lengths(x: list[str], y: list[str]) -> np.ndarray:
            for row in _rows(x, y):
                pass
            bits = np.unpackbits(np.frombuffer(row.to_bytes(len(y) // 8 + 1, "little"), np.uint8), bitorder="little")
            return np.append(0, np.cumsum(bits[: len(y)] == 0))

        at = int((lengths(a[:half], b) + lengths(a[:half - 1 : -1], b[::-1])[::-1]).argmax())
        return _longest(a[:half], b[:at]) + [(half + i, at + j) for i, j in _longest(a[half:], b[at:])]
    rows = list(_rows(a, b))
    i, j, out = len(a) - 1, len(b) - 1, []
    while i >= 0 and j >= 0:
        if rows[i] >> j & 1:
            j -= 1
        elif i and not rows[i - 1] >> j & 1:
            i -= 1
        else:
            out.append((i, j))
            i, j = i - 1, j - 1
    return out[::-1]


def _words(text: str) -> list[str]:
    return _WORD.findall(text) if _ODD.search(text) else text.split()


def _scores(pairs: list[tuple[int, int]], end: tuple[int, int]) -> tuple[float, float]:
    """Best score of an alignment up to a common word (0 at least), and that up to ``end``, where one more is assumed."""
    best = total = 0.0
    x = y = -1
    for i, j in (*pairs, end):
        best = max(best, total)
        skipped = (i - x if i - x > j - y else j - y) - 1
        total += MATCH + (MISS_LONG if skipped > LONG else MISS) * skipped
        x, y = i, j
    return best, total


def _missed(skipped: np.ndarray) -> np.ndarray:
    return np.where(skipped > LONG, MISS_LONG, MISS) * skipped


def _matched(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Words (number in ``a``, number in ``b``) that an alignment of the two has in common, in order."""
    short = min(len(a), len(b))
    head = next((k for k in range(short) if a[k] != b[k]), short)
    tail = next((k for k in range(short - head) if a[-1 - k] != b[-1 - k]), short - head)
    n, m = len(a) - head - tail, len(b) - head - tail
    a_mid, b_mid = a[head : head + n], b[head : head + m]
    mid = _longest(a_mid, b_mid)
    if n == m and mid:
        level = [(k, k) for k in range(n) if a_mid[k] == b_mid[k]]
        mid = max(level, mid, key=lambda x: _scores(x, (n, m))[1])
    return [(k, k) for k in range(head)] + [(head + i, head + j) for i, j in mid] + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]


def _onward(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """The same for what follows a chain, where only the beginnings need be alike: by diagonal or alignment, as scores more."""
    short = min(len(a), len(b))
    if a[:short] == b[:short]:
        return [(k, k) for k in range(short)]
    level = [(k, k) for k, (p, q) in enumerate(zip(a, b, strict=False)) if p == q]
    return max(level, _longest(a, b), key=lambda x: _scores(x, x[-1])[0] if x else 0.0)


def stretches(gain: list[float], loss: list[float]) -> list[tuple[int, int]]:
    """(first, last) run of every maximal stretch: the best-scoring one, then the best to its left and right, and so on.

    ``gain`` is the score of each run, ``loss`` (negative) that of what lies before it.  One pass (Ruzzo and Tompa).
    """
    out: list[tuple[float, float, int, int, int]] = []  # score before, score after, first, last, nearest with less before
    total = 0.0
    for k, (won, lost) in enumerate(zip(gain, loss, strict=True)):
        low, first = total + lost, k
        total = low + won
        at = len(out) - 1
        while True:
            while at >= 0 and out[at][0] >= low:
                at = out[at][4]
            if at < 0 or out[at][1] >= total:
                out.append((low, total, first, k, at))
                break
            low, first, before = out[at][0], out[at][2], out[at][4]
            del out[at:]
            at = before
    return [(first, last) for _, _, first, last, _ in out]


def align(before: str, after: str, rep_before: str, rep_after: str, links: list[int]) -> list[tuple[int, int, int]]:
    """(start, stop, words) of every passage of a chain, in order, in code points from the chain's first seed.

    ``before`` and ``after`` are the text up to and from the first seed, in this document and in the other.
    """
    left, rep_left = _words(before), _words(rep_before)
    a, b = left + _words(after), rep_left + _words(rep_after)
    seeded = sum(links[k + 1] - links[k] for k in range(0, len(links), 4))
    if seeded < SIMILARITY * LEAST_WORDS and (Counter(a) & Counter(b)).total() < SIMILARITY * LEAST_WORDS:
        return []
    at, rep_at = len(left), len(rep_left)
    xs: list[int] = []  #: words in common, by their numbers in either document
    ys: list[int] = []

    def hit(pairs: list[tuple[int, int]]) -> None:
        xs.extend([at + i for i, _ in pairs])
        ys.extend([rep_at + j for _, j in pairs])

    hit([(-1 - i, -1 - j) for i, j in reversed(_onward(a[:at][::-1], b[:rep_at][::-1]))])
    for k in range(0, len(links), 4):
        x0, x1, y0, y1 = len(left) + links[k], len(left) + links[k + 1], len(rep_left) + links[k + 2], len(rep_left) + links[k + 3]
        over = max(0, at - x0, rep_at - y0)
        x0, y0 = x0 + over, y0 + over
        hit(_matched(a[at:x0], b[rep_at:y0]))
        size = max(0, min(x1 - x0, y1 - y0))
        at, rep_at = x0, y0
        own, other = a[x0 : x0 + size], b[y0 : y0 + size]
        if own == other:
            xs.extend(range(x0, x0 + len(own)))
            ys.extend(range(y0, y0 + len(own)))
        else:
            hit([(i, i) for i, (p, q) in enumerate(zip(own, other, strict=False)) if p == q])
        at, rep_at = x0 + size, y0 + size
    hit(_onward(a[at:], b[rep_at:]))
    if len(xs) < SIMILARITY * LEAST_WORDS:
        return []
    x, y = np.array(xs), np.array(ys)
    skipped = np.maximum(np.diff(x), np.diff(y)) - 1
    first = np.append(0, np.flatnonzero(skipped) + 1)
    size = np.diff(np.append(first, len(x)))
    lost = np.append(0, skipped[first[1:] - 1])

    def found(low: int, high: int, strict: bool) -> Iterator[tuple[int, int, int]]:
        """Passages among the runs from ``low`` to before ``high``."""
        miss = STRICT * lost[low:high] if strict else _missed(lost[low:high])
        for s, e in stretches((MATCH * size[low:high]).tolist(), miss.tolist()):
            i, j = int(x[first[low + s]]), int(x[first[low + e] + size[low + e] - 1]) + 1
            if j - i < LEAST_WORDS:
                continue
            if size[low + s : low + e + 1].sum() >= SIMILARITY * (j - i):
                yield i, j, j - i
            elif not strict:
                yield from found(low + s, low + e + 1, True)

    def point(k: int, end: bool) -> int:
        m = next(islice(_WORD.finditer(before), k, None) if k < len(left) else islice(_WORD.finditer(after), k - len(left), None))
        return (m.end() if end else m.start()) - (len(before) if k < len(left) else 0)

    return [(point(i, False), point(j - 1, True), size) for i, j, size in found(0, len(first), False)]


def _keyed(documents: DataFrame) -> tuple[DataFrame, Column]:
    """``documents`` and the 64-bit key of a row's document (null for a null id).

    The key is the doc_id where ids are integers and come with one text; a column ``_odd`` may be added for others.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    hashed = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", text))
    if not isinstance(documents.schema["doc_id"].dataType, T.IntegralType):
        return documents, hashed
    own = F.col("doc_id").cast("long")
    several = documents.where("doc_id is not null").groupBy(own.alias("_odd")).agg(F.min(F.xxhash64(text)).alias("low"), F.max(F.xxhash64(text)).alias("high")).where("low <> high")
    several = stage(several.select("_odd"), "odd")
    if several.isEmpty():
        return documents, own
    return documents.join(several, own == F.col("_odd"), "left"), F.when(F.col("_odd").isNull(), own).otherwise(hashed)


def between(docs: DataFrame, matches: DataFrame, *used: DataFrame) -> DataFrame:
    """(doc, start, stop, words, source): passages along the chains of ``matches``; the stored tables ``used`` are dropped."""
    chain = stage(chained(matches), "chains", *used)
    ids = stage(chain.select("doc").union(chain.select("rep")).distinct(), "ids")
    texts = stage(docs.join(ids.hint("merge"), "doc", "left_semi").dropDuplicates(["doc"]), "passage-texts")
    edge = 4096  # code points that hold the words wanted nearly always; else all text is looked at
    some = f"^[\\x00-\\x20]*(?:[^\\x00-\\x20]+[\\x00-\\x20]*){{0,{EDGE_WORDS}}}"

    def window(start: str, stop: str, name: str) -> list[Column]:
        def words_of(part: Column, whole: Column) -> Column:
            found = F.regexp_extract(part, some, 0)
            return F.when((F.char_length(part) < edge) | (F.char_length(found) < F.char_length(part)), found).otherwise(F.regexp_extract(whole, some, 0))

        low = F.greatest(F.col(start) - edge, F.lit(0))
        before = words_of(F.reverse(F.substring("text", low + 1, F.col(start) - low)), F.reverse(F.substring("text", F.lit(1), F.col(start))))
        after = words_of(F.substring("text", F.col(stop) + 1, F.lit(edge)), F.substring("text", F.col(stop) + 1, F.char_length("text")))
        return [F.reverse(before).alias(f"{name}before"), F.concat(F.substring("text", F.col(start) + 1, F.col(stop) - F.col(start)), after).alias(f"{name}after")]

    rows = chain.join(texts.withColumnRenamed("doc", "rep").hint("merge"), "rep").select(*COLUMNS, *window("rep_start", "rep_stop", "rep_"))
    rows = rows.join(texts.hint("merge"), "doc").select("doc", "rep", "start", "links", "rep_before", "rep_after", *window("start", "stop", ""))

    @tidy
    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                for start, stop, size in align(r["before"], r["after"], r["rep_before"], r["rep_after"], r["links"]):
                    out.append((r["doc"], r["start"] + start, r["start"] + stop, size, r["rep"]))
            yield pa.RecordBatch.from_arrays([pa.array(x, k.type) for x, k in zip(zip(*out, strict=True) if out else [()] * len(kind), kind, strict=True)], schema=kind)

    kind = pa.schema([("doc", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("words", pa.int32()), ("source", pa.int64())])
    return stage(rows.mapInArrow(aligned, "doc bigint, start int, stop int, words int, source bigint"), "passages", chain, ids, texts)


def passages(docs: DataFrame) -> DataFrame:
    """(doc, start, stop, words, source): passages of a document that an earlier one holds, in code points.

    ``docs``: rows (doc, text), equal ones for one document."""
    short_batches(docs.sparkSession)
    single = with_first(stage(seeds(docs), "seeds"))
    alike = classes(stage(areas(single), "areas"))
    longer = with_first(stage(sequences(alike.where("doc = rep")), "sequences"))
    # a sequence stands for its first and last seed, each where the seed itself was not joined with that holder already
    first = longer.where("doc > rep and rep <> rep_a").select("doc", "rep", "word", "rep_word", "point", "rep_point")
    last = longer.where("doc > rep and rep <> rep_b").selectExpr("doc", "rep", "word + words", "rep_word + words", "point + points", "rep_point + points")
    exact = with_first(stage(whole(docs, ends(single)), "whole")).where("doc > rep")
    exact = exact.select("doc", "rep", "word", "rep_word", "point", "rep_point", F.explode(F.arrays_zip(F.array(*map(F.lit, RUNGS)).alias("w"), F.col("points").alias("p"))).alias("at"))
    exact = exact.selectExpr("doc", "rep", "word + at.w", "rep_word + at.w", "point + at.p", "rep_point + at.p")
    matches = single.where("doc > rep").select(*first.columns).union(exact).union(stepped(alike.where("doc > rep")).select(*first.columns)).union(first).union(last)
    return between(docs, matches, single, alike, longer)


def merged(found: DataFrame) -> DataFrame:
    """(doc, spans, sources): a document's passages without overlap, in order."""
    own = found.groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("all"), F.sort_array(F.collect_set("source_id")).alias("source_ids"))
    join = """aggregate(all, cast(array() as array<struct<start: int, stop: int>>), (acc, x) ->
        if(size(acc) > 0 and element_at(acc, -1).stop >= x.start,
           concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'stop', greatest(element_at(acc, -1).stop, x.stop)))),
           concat(acc, array(named_struct('start', x.start, 'stop', x.stop)))))"""
    return own.select("doc", F.expr(join).alias("spans"), "source_ids")


#: the text outside the spans
KEPT = """if(spans is null, text, aggregate(spans, named_struct('at', 1, 'kept', ''),
    (acc, x) -> named_struct('at', x.stop + 1, 'kept', acc.kept || substring(text, acc.at, x.start + 1 - acc.at)),
    acc -> acc.kept || substring(text, acc.at)))"""


def without_passages(documents: DataFrame) -> DataFrame:
    """``documents`` with the passages cut from ``text`` (and ``n_chars``, where it is a column, counted anew), plus
    ``spans`` and ``source_ids`` (null where nothing was cut).  Columns of these two names are replaced."""
    names = [c for c in documents.columns if c not in ("spans", "source_ids")]
    kinds = {f.name: f.dataType for f in documents.schema.fields}
    plain = documents.select(F.col("doc_id"), F.col("text"), F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in names if c not in ("doc_id", "text")]).alias("rest"))
    rows, key = _keyed(plain)
    docs = rows.select(key.alias("doc"), "doc_id", F.coalesce("text", F.lit("")).alias("text")).where("doc is not null")
    found = passages(docs.select("doc", "text"))
    if isinstance(kinds["doc_id"], T.IntegralType) and "_odd" not in rows.columns:
        named = found.withColumn("source_id", F.col("source").cast(kinds["doc_id"]))
    else:  # keys that are hashes are turned back into ids
        ids = docs.select(F.col("doc").alias("source"), F.col("doc_id").alias("source_id")).distinct()
        named = found.join(ids, "source")
    spans = stage(merged(named), "spans")
    joined = rows.withColumn("doc", key).join(spans, "doc", "left")
    kept = F.expr(KEPT)

    def column(c: str) -> Column:
        if c == "doc_id":
            return F.col("doc_id")
        if c == "text":
            return kept.alias("text")
        own = F.col("rest").getField(c)
        return (F.when(F.col("spans").isNull(), own).otherwise(F.char_length(kept).cast(kinds[c])) if c == "n_chars" else own).alias(c)

    return joined.select(*[column(c) for c in names], "spans", "source_ids")
