"""Nearest neighbours by cosine through stored inverted lists.

Distinct vectors are dealt to the cell of their nearest centroid and written once, with each cell's size and radius
(the widest angle of a member).  A search visits a query's nearest cells, keeps a bounded heap a task, and then, unless
it is told to be approximate, every other cell that its bound does not rule out: no member of a cell comes closer than
the angle to the centroid less the radius, and what the first visit found (or the floor) says how close is needed.  So
results are exact at every size, and what is saved follows from how clustered the vectors are.

Equal vectors are one vector with its smallest ids, however many bear it, so a group of copies costs no more than a
row.  Centroids are fitted on at most ``SAMPLE`` vectors and number at most ``MOST_CELLS``; every vector is indexed.
Cells over ``BLOCK`` vectors are split, and what is left is dealt by ``SHARD`` vectors to tasks; a query goes once to each
task that holds one of its cells, so a search of most cells is sent as often as there are tasks, not cells.  Zero vectors and nulls are no one's neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stage import cut

SAMPLE, MOST_CELLS, ROWS_A_CELL, BLOCK, PROBES = 20_000, 4_096, 512, 2_048, 8
#: Queries and vectors that one task takes at a time, rows of a product and the candidates that it keeps before they are cut.
MOST_QUERIES, SHARD, ROWS, KEPT = 16_384, 16_384, 1_024, 500_000
#: Scores have six digits; bounds are loosened by more than that.
_SLACK = 5e-6


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, float) for v in vectors])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def usable(points: DataFrame) -> DataFrame:
    """(id, embedding, k1, k2) of vectors that have a direction; equal vectors have equal keys."""
    e = F.col("embedding").cast("array<double>")
    size = F.aggregate(e, F.lit(0.0), lambda s, x: s + x * x)
    fine = points.where(F.col("embedding").isNotNull()).where((size > 0) & (size < float("inf")))
    return fine.select("id", "embedding", F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(1), "embedding").alias("k2"))


@dataclass
class Index:
    """Centroids and radii of the cells, the distinct vectors by cell and block, and the first ids of each."""

    centroids: np.ndarray
    radii: np.ndarray
    blocks: np.ndarray  #: tasks that a cell is split among
    members: DataFrame  #: (cell, block, k1, k2, first, embedding)
    bearers: DataFrame  #: (k1, k2, id), at most ``ids`` of each
    ids: int
    sizes: np.ndarray  #: members of a cell


def _fit(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; the first centroids are spread over the sample, which comes in hash order."""
    c = sample[np.linspace(0, len(sample) - 1, cells).astype(int)]
    for _ in range(rounds if cells > 1 else 1):
        own = np.concatenate([(sample[k : k + 4096] @ c.T).argmax(1) for k in range(0, len(sample), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, own, sample)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 1e-9, total / np.maximum(size, 1e-9), c)
    return c


def build(points: DataFrame, ids: int, rows_a_cell: int = ROWS_A_CELL, block: int = BLOCK) -> Index:
    """The index of ``points`` (id, embedding); at most ``ids`` bearers of a vector can be found."""
    own = usable(points)
    w = Window.partitionBy("k1", "k2").orderBy("id")
    borne = cut(own.withColumn("n", F.row_number().over(w)).where(F.col("n") <= ids))
    distinct = borne.where("n = 1")
    n = distinct.count()
    cells = max(1, min(MOST_CELLS, -(-n // rows_a_cell)))
    rows = distinct.select("k1", "k2", F.col("id").alias("first"), "embedding")
    if n and cells <= PROBES:  # a search would visit every cell: one cell, split as it must be
        blocks = -(-n // block)
        members = rows.select(F.lit(0).cast("bigint").alias("cell"), F.pmod(F.xxhash64("k2"), F.lit(blocks)).cast("int").alias("block"), "k1", "k2", "first", "embedding")
        return Index(np.zeros((1, 1)), np.full(1, np.pi), np.array([blocks]), members, borne.select("k1", "k2", "id"), ids, np.array([n]))
    sample = distinct.select("embedding", F.xxhash64("k1", F.lit(7)).alias("h")).orderBy("h").limit(SAMPLE).toPandas()
    if not len(sample):
        return Index(np.zeros((0, 1)), np.zeros(0), np.zeros(0, int), borne.limit(0), borne.limit(0), ids, np.zeros(0, int))
    centroids = _fit(_unit(sample["embedding"]), min(cells, len(sample)))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                cos = _unit(pdf["embedding"]) @ centroids.T
                cell = cos.argmax(1)
                yield pdf.assign(cell=cell, angle=_angle(cos[np.arange(len(pdf)), cell]))

    kind = points.schema["embedding"].dataType.simpleString()
    name = points.schema["id"].dataType.simpleString()
    rows = cut(rows.mapInPandas(placed, f"k1 bigint, k2 bigint, first {name}, embedding {kind}, cell bigint, angle double"))
    radii, blocks, sizes = np.full(len(centroids), -1.0), np.ones(len(centroids), int), np.zeros(len(centroids), int)
    for r in rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect():  # a row a cell
        radii[r.cell], blocks[r.cell], sizes[r.cell] = r.radius, -(-r.n // block), r.n
    split = F.create_map(*[F.lit(int(x)) for c in np.flatnonzero(blocks > 1) for x in (c, blocks[c])]) if (blocks > 1).any() else None
    parts = F.lit(1) if split is None else F.coalesce(split[F.col("cell").cast("int")], F.lit(1))
    members = rows.select("cell", F.pmod(F.xxhash64("k2"), parts).cast("int").alias("block"), "k1", "k2", "first", "embedding")
    return Index(centroids, radii, blocks, members, borne.select("k1", "k2", "id"), ids, sizes)


def _asked(centroids: np.ndarray, radii: np.ndarray, x: np.ndarray, least: np.ndarray, probes: int, rest: bool) -> np.ndarray:
    """Which cells queries visit: the nearest ones, or the others that are not ruled out."""
    if len(centroids) == 1:
        return np.ones((len(x), 1), bool)
    angle = _angle(x @ centroids.T)
    near = np.zeros(angle.shape, bool)
    near[np.arange(len(x))[:, None], np.argpartition(angle, min(probes, angle.shape[1]) - 1, axis=1)[:, :probes]] = True
    open_ = (angle - radii[None, :] <= _angle(least - _SLACK)[:, None] + 1e-9) & (radii[None, :] >= 0)
    return open_ & (~near if rest else near)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    x = flat.reshape(len(column), -1).astype(float)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _visit(index: Index, queries: DataFrame, k: int, floor: float, probes: int, rest: bool, many: int) -> DataFrame:
    """(q1, q2, k1, k2, first, score): each query's best ``k`` of every task's visited cells, at or over the floor.

    A query is sent once to each task with one of its cells.  A task holds some ``SHARD`` members and ``MOST_QUERIES`` queries
    as matrices; products are of ``ROWS`` queries and a cell's block, and what they find is cut to ``k`` a query as it grows.
    """
    centroids, radii, blocks = index.centroids, index.radii, index.blocks
    first_slot = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    size = np.repeat(index.sizes / blocks, blocks)
    shard = ((np.cumsum(size) - size) // SHARD).astype(int)  # of each cell's blocks, in order
    touch = np.zeros((len(blocks), shard[-1] + 1), bool)
    touch[np.repeat(np.arange(len(blocks)), blocks), shard] = True
    kind = queries.schema["embedding"].dataType.simpleString()
    rows_a_product, block, most_kept = ROWS, BLOCK, KEPT

    def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), rows_a_product):
                part = pdf.iloc[at : at + rows_a_product]
                asked = _asked(centroids, radii, _unit(part["embedding"]), np.maximum(part["least"].to_numpy(float), floor), probes, rest)
                for s in range(touch.shape[1]):
                    own = asked[:, touch[:, s]].any(1)
                    if own.any():
                        yield part[own].assign(shard=np.int32(s))

    name = index.members.schema["first"].dataType.simpleString()
    schema = f"q1 bigint, q2 bigint, k1 bigint, k2 bigint, first {name}, score double"

    def best(asked: pa.Table, held: pa.Table) -> pa.Table:
        small = held.select(["cell", "first"]).to_pandas()
        out = [asked.select(["q1", "q2"]).slice(0, 0), held.select(["k1", "k2", "first"]).slice(0, 0), pa.array([], pa.float64())]
        if asked.num_rows and held.num_rows:
            by = np.lexsort((small["first"].rank(method="first").to_numpy(), small["cell"].to_numpy()))
            held, small = held.take(pa.array(by)), small.iloc[by]
            place = small["first"].rank(method="first").to_numpy()  # ties go to the smaller id
            y, cells = _matrix(held["embedding"]), small["cell"].to_numpy()
            cuts = np.flatnonzero(np.diff(cells, prepend=-1))
            ranges = [(a, min(a + block, b)) for lo, b in zip(cuts, [*cuts[1:], len(cells)], strict=True) for a in range(lo, b, block)]
            found = []
            for at in range(0, asked.num_rows, rows_a_product):
                part = asked.slice(at, rows_a_product)
                x, least = _matrix(part["embedding"]), np.maximum(part["least"].to_numpy(), floor)
                visit = _asked(centroids, radii, x, least, probes, rest)
                kept, waiting = (np.zeros(0, int), np.zeros(0, int), np.zeros(0)), []
                bound = least - 1e-9  # what a query has k of already need not be beaten by less

                def cut_down(kept, waiting, place=place, bound=bound):
                    row, col, score = (np.concatenate(c) for c in zip(kept, *waiting, strict=True))
                    order = np.lexsort((place[col], -score, row))
                    row, col, score = row[order], col[order], score[order]
                    starts = np.flatnonzero(np.diff(row, prepend=-1))
                    nth = np.arange(len(row)) - np.repeat(starts, np.diff([*starts, len(row)]))
                    last = nth == k - 1
                    bound[row[last]] = np.maximum(bound[row[last]], score[last] - 1e-9)
                    return row[nth < k], col[nth < k], score[nth < k]

                for a, b in ranges:
                    rows = np.flatnonzero(visit[:, cells[a]])
                    if not len(rows):
                        continue
                    cos = np.round(x[rows] @ y[a:b].T, 6)
                    i, j = np.nonzero(cos >= bound[rows][:, None])
                    waiting.append((rows[i], j + a, cos[i, j]))
                    if sum(len(w[0]) for w in waiting) > most_kept:
                        kept, waiting = cut_down(kept, waiting), []
                row, col, score = cut_down(kept, waiting)
                found.append((row + at, col, score))
            row, col, score = (np.concatenate(c) for c in zip(*found, strict=True))
            out = [asked.select(["q1", "q2"]).take(pa.array(row)), held.select(["k1", "k2", "first"]).take(pa.array(col)), pa.array(score)]
        names = ["q1", "q2", "k1", "k2", "first", "score"]
        return pa.table([*out[0].columns, *out[1].columns, out[2]], names=names)

    shares = max(1, -(-many // MOST_QUERIES))
    sent = queries.select("q1", "q2", "embedding", "least").mapInPandas(routed, f"q1 bigint, q2 bigint, embedding {kind}, least double, shard int")
    sent = sent.withColumn("share", F.pmod(F.xxhash64("q2"), F.lit(shares)).cast("int"))
    slots, starts = (F.array(*[F.lit(int(v)) for v in values]) for values in (shard, first_slot))
    members = index.members.withColumn("shard", slots[starts[F.col("cell").cast("int")] + F.col("block")])
    members = members.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    return sent.groupBy("shard", "share").cogroup(members.groupBy("shard", "share")).applyInArrow(best, schema)


def _top(found: DataFrame, keys: list[str], order: list[Column | str], k: int) -> DataFrame:
    return found.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("n") <= k)


def search(index: Index, queries: DataFrame, k: int, floor: float, probes: int = PROBES, exact: bool = True) -> DataFrame:
    """(id, other, score): the ``k`` nearest indexed others of each query (id, embedding) by cosine of at least ``floor``,
    ties to the smaller id.  ``exact=False`` stops after the ``probes`` nearest cells.  ``k`` is below the index's ``ids``."""
    if k >= index.ids:
        raise ValueError("the index holds too few bearers of a vector for so many neighbours")
    asked = usable(queries)
    if not len(index.centroids):
        return asked.select("id", F.col("id").alias("other"), F.lit(0.0).alias("score")).where("1 = 0")
    rows = asked.select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), "embedding").dropDuplicates(["q1", "q2"]).withColumn("least", F.lit(float(floor)))
    best, many = [F.desc("score"), F.col("first")], rows.count()
    found = _top(_visit(index, rows, k + 1, floor, probes, False, many), ["q1", "q2"], best, k + 1)
    if exact and len(index.centroids) > probes:
        found = cut(found)
        enough = found.where(F.col("n") == k + 1).select("q1", "q2", F.col("score").alias("own"))
        left = rows.join(enough, ["q1", "q2"], "left").withColumn("least", F.coalesce("own", "least")).drop("own")
        found = _top(found.drop("n").union(_visit(index, left, k + 1, floor, probes, True, many)), ["q1", "q2"], best, k + 1)
    named = found.select("q1", "q2", "k1", "k2", "score").join(index.bearers, ["k1", "k2"])
    named = _top(named, ["q1", "q2"], [F.desc("score"), F.col("id")], k + 1)
    near = named.groupBy("q1", "q2").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "id"))).alias("near"))
    out = asked.select(F.col("id").alias("own"), F.col("k1").alias("q1"), F.col("k2").alias("q2")).join(near, ["q1", "q2"])
    out = out.select(F.col("own").alias("id"), F.explode(F.slice(F.filter("near", lambda x: x["id"] != F.col("own")), 1, k)).alias("x"))
    return out.select("id", F.col("x.id").alias("other"), (-F.col("x.far")).alias("score"))


def similar(points: DataFrame, k: int, floor: float, exact: bool = True, rows_a_cell: int = ROWS_A_CELL, probes: int = PROBES) -> DataFrame:
    """(id, other, score): each point's ``k`` nearest others, through an index of the points themselves."""
    return search(build(points, k + 2, rows_a_cell), points, k, floor, probes, exact)
