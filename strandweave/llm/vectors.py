"""Embedding near-duplicates by spherical-cap filters.

A vector's coordinates are split into ``BLOCKS`` blocks; each block has a random code of ``CODE`` directions, and a
filter is one code word from each block (a structured random product code).  List decoding gives a vector all
filters whose cap holds it, and at least its ``LEAST`` best ones, without ever looking at all of them: block words
are taken best first and a partial sum that cannot reach the bound is dropped.  Vectors of one label meet in shared
filters and every meeting pair is verified by its cosine in double precision.

Equal vectors of one label are one point with a count.  A filter's points are dealt into parts of ``PART`` at most
and every two parts meet in a task of their own, so no group outgrows a task; a pair is counted only in the
smallest filter that both points share, and only counts and a spanning forest leave a task, never the pairs.

Rows equal in id, label and vector are one vector.  A null label, or a vector that is null, empty, zero or holds
null or non-finite components links with nothing; such a vector is its own component.  Vectors of different
dimension never link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import stage

COSINE = 0.98
BLOCKS, CODE, CAP, LEAST = 2, 256, 0.46, 12
PART = 512


def code(dimension: int, seed: int = 7) -> list[np.ndarray]:
    """The block codes for vectors of ``dimension``: unit rows, ``CODE`` a block (blocks of no coordinate are left out)."""
    rng = np.random.default_rng(seed + dimension)
    out = []
    for part in np.array_split(np.arange(dimension), BLOCKS):
        if len(part):
            w = rng.standard_normal((CODE, len(part)))
            out.append(w / np.linalg.norm(w, axis=1, keepdims=True))
    return out


def decode(v: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """Filters of one unit vector: all whose inner product is at least ``CAP``, at least the ``LEAST`` best."""
    edges = np.cumsum([0, *(w.shape[1] for w in words)])
    inner = [w @ v[a:b] / np.sqrt(len(words)) for w, a, b in zip(words, edges, edges[1:], strict=False)]
    order = [np.argsort(-x, kind="stable") for x in inner]

    def found(bound: float, keep: int) -> tuple[np.ndarray, np.ndarray]:
        total, ident = np.zeros(1), np.zeros(1, np.int64)
        for k, x in enumerate(inner):
            best = x[order[k][:keep]]
            rest = sum(float(y.max()) for y in inner[k + 1 :])
            best_ids = order[k][:keep]
            total = (total[:, None] + best[None, :]).ravel()
            ident = (ident[:, None] * CODE + best_ids[None, :]).ravel()
            ok = total + rest >= bound
            total, ident = total[ok], ident[ok]
        return total, ident

    total, ident = found(CAP, CODE)
    if len(ident) < LEAST:  # the best LEAST filters use only each block's best LEAST words
        total, ident = found(-np.inf, LEAST)
        ident = ident[np.lexsort((ident, -total))[:LEAST]]
    return np.sort(ident)


def filtered(points: DataFrame) -> DataFrame:
    """``points`` (point, label, vector, n) of linkable vectors, with their ``filters``; others have none."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes: dict[int, list[np.ndarray]] = {}
        for pdf in batches:
            filters = []
            for v in pdf["vector"]:
                x = np.array(v, np.float64)
                norm = np.linalg.norm(x / max(np.abs(x).max(initial=0.0), 1e-300)) if len(x) else 0.0
                if not (norm > 0 and np.isfinite(x).all()):
                    filters.append([])
                    continue
                x = x / np.abs(x).max()
                d = len(x)
                if d not in codes:
                    codes[d] = code(d)
                filters.append((decode(x / np.linalg.norm(x), codes[d]) + (d << 32)).tolist())
            yield pdf.assign(filters=filters)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields) + ", filters array<bigint>"
    return points.mapInPandas(made, schema)


def _units(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def meet(pdf: pd.DataFrame, part_a: int, part_b: int, filter_id: int) -> tuple[pd.DataFrame, pd.DataFrame] | None:
    """(links counted, forest) of two parts of one filter (or of one part with itself)."""
    a, b = pdf[pdf["part"] == part_a], pdf[pdf["part"] == part_b]
    if not len(a) or not len(b):
        return None
    x, y = _units(a["vector"]), _units(b["vector"])
    near = x @ y.T >= COSINE
    if part_a == part_b:
        near &= np.arange(len(a))[:, None] < np.arange(len(b))[None, :]
    i, j = np.nonzero(near)
    if not len(i):
        return None
    # pairs that share a smaller filter are counted there
    lower = sorted({f for fs in (a if part_a == part_b else pd.concat([a, b]))["filters"] for f in fs if f < filter_id})
    if lower:
        place = {f: k for k, f in enumerate(lower)}
        held = []
        for side in (a, b):
            m = np.zeros((len(side), len(lower)), np.float32)
            for r, fs in enumerate(side["filters"]):
                m[r, [place[f] for f in fs if f < filter_id]] = 1
            held.append(m)
        new = near & ~(held[0] @ held[1].T > 0)
        i, j = np.nonzero(new)
        if not len(i):
            return None
    pa_, pb_ = a["point"].to_numpy(), b["point"].to_numpy()
    na, nb = a["n"].to_numpy(), b["n"].to_numpy()
    links = pd.DataFrame({"point": np.concatenate([pa_, pb_]), "n_links": np.concatenate([np.bincount(i, weights=nb[j], minlength=len(a)), np.bincount(j, weights=na[i], minlength=len(b))]).astype(np.int64)})
    parent: dict = {}

    def root(k):
        while parent.setdefault(k, k) != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    forest = []
    for u, v in zip(pa_[i].tolist(), pb_[j].tolist(), strict=True):
        ru, rv = root(u), root(v)
        if ru != rv:
            parent[max(ru, rv)] = min(ru, rv)
            forest.append((u, v))
    return links[links["n_links"] > 0], pd.DataFrame(forest, columns=["a", "b"])


def near_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector."""
    rows = embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector")).distinct()
    fit = F.expr("label is not null and vec_id is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vector, x -> x <> 0)")
    rows = stage(rows.withColumn("fit", F.coalesce(fit, F.lit(False))), "vectors")
    points = rows.where("fit").groupBy("label", "vector").agg(F.min("vec_id").alias("point"), F.count("*").alias("n"))
    # a point is named by its content, since one vec_id may name several vectors
    points = points.select(F.xxhash64("label", "vector").alias("point"), F.col("point").alias("first_id"), "label", "vector", "n")
    points = stage(filtered(points), "points")
    seats = points.select("label", "point", F.explode("filters").alias("filter"))
    sizes = seats.groupBy("label", "filter").agg(F.count("*").alias("size")).where("size > 1")
    parts = F.ceil(F.col("size") / PART).cast("int")
    seats = seats.join(sizes, ["label", "filter"]).select("label", "filter", "point", parts.alias("parts"), F.pmod(F.xxhash64("point", "filter"), parts).cast("int").alias("part"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    seats = seats.select("label", "filter", "point", "part", other).select("label", "filter", "point", "part", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"))
    meetings = seats.join(points.select("point", "vector", "n", "filters"), "point")
    meetings = meetings.repartition("label", "filter", "a", "b").sortWithinPartitions("label", "filter", "a", "b", "point")

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None

        def results(group: pd.DataFrame) -> Iterator[pd.DataFrame]:
            r = group.iloc[0]
            out = meet(group, r["a"], r["b"], r["filter"]) if len(group) > 1 else None
            if out is not None:
                links, forest = out
                yield pd.DataFrame({"point": links["point"], "n_links": links["n_links"], "other": pd.array([None] * len(links), "Int64")})
                yield pd.DataFrame({"point": forest["a"], "n_links": 0, "other": forest["b"].astype("Int64")})

        def met_groups(pdf: pd.DataFrame, at: list[int], ends: list[int]) -> Iterator[pd.DataFrame]:
            """Most groups hold no near pair: one small product over rows that were scaled together tells."""
            if not at:
                return
            same = pdf["vector"].map(len).nunique() == 1
            x = _units(pdf["vector"]) if same else None
            for s, e in zip(at, ends, strict=True):
                if e - s < 2 or same and (x[s:e] @ x[s:e].T >= COSINE).sum() <= e - s:
                    continue
                yield from results(pdf.iloc[s:e])

        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            key = pdf[["label", "filter", "a", "b"]].to_numpy()
            at = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)])).tolist() if len(key) else []
            yield from met_groups(pdf.iloc[: at[-1]] if at else pdf, at[:-1], at[1:])
            held = pdf.iloc[at[-1] :] if at else None
        if held is not None and len(held):
            yield from results(held)

    found = stage(meetings.mapInPandas(met, "point bigint, n_links bigint, other bigint"), "met")
    counts = found.where("other is null").groupBy("point").agg(F.sum("n_links").alias("links"))
    classes = components(found.where("other is not null"), "point", "other")
    named = points.select("point", "first_id", "n").join(classes.withColumnRenamed("node", "point"), "point", "left").withColumn("component", F.coalesce("component", "point"))
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = named.join(smallest, "component").join(counts, "point", "left").select("point", F.col("n") - 1 + F.coalesce("links", F.lit(0)), "component_id").toDF("point", "links", "component_id")
    every = rows.withColumn("point", F.when(F.col("fit"), F.xxhash64("label", "vector"))).select("vec_id", "point").join(named, "point", "left")
    component = F.coalesce("component_id", "vec_id")
    return every.select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
