"""Neighbour index, ordered folds, mentions, spellings and run trees against plain loops."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandweave.operators import entities as E
from strandweave.operators import graph as G
from strandweave.operators import mentions as M
from strandweave.operators import nearest as N
from strandweave.operators import replay as R

DATA = "/root/testdata/sf0.001"
rng = random.Random(17)


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(3)
    x = r.normal(size=(12, 8))[r.integers(0, 12, 500)] + r.normal(size=(500, 8)) * 0.4
    x = np.concatenate([x, np.repeat(x[:1], 250, 0), np.repeat(x[5:6] * 2, 3, 0)])  # a third are copies
    return [f"n{k:04d}" for k in r.permutation(len(x))], x


def nearest(ids, x, k, floor, asked):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = np.round(u @ u.T, 6)
    out = []
    for i in asked:
        near = sorted((-cos[i, j], ids[j]) for j in range(len(ids)) if j != i and cos[i, j] >= floor)[:k]
        out += [(ids[i], n, -s) for s, n in near]
    return sorted(out)


def test_index_is_exact_and_approximate_on_request(spark, vectors):
    ids, x = vectors
    rows = [*zip(ids, x.tolist(), strict=True), ("zero", [0.0] * 8), ("none", None)]
    df = spark.createDataFrame(rows, "id string, embedding array<double>").repartition(3)
    plain = nearest(ids, x, 4, 0.5, range(len(ids)))
    assert sorted(map(tuple, N.similar(df, 4, 0.5, rows_a_cell=20, probes=3).collect())) == plain
    some = set(map(tuple, N.similar(df, 4, 0.5, exact=False, rows_a_cell=20, probes=6).collect()))
    assert len(some & set(plain)) >= 0.95 * len(plain)


def test_index_splits_cells_and_takes_other_queries(spark, vectors, monkeypatch):
    ids, x = vectors
    monkeypatch.setattr(N, "BLOCK", 32)
    monkeypatch.setattr(N, "MOST_QUERIES", 20)
    df = spark.createDataFrame(list(zip(ids, x.tolist(), strict=True)), "id string, embedding array<double>").repartition(3)
    index = N.build(df, 6, rows_a_cell=40, block=16)
    assert index.blocks.max() > 1 and len(index.centroids) > N.PROBES
    asked = df.where(F.col("id").endswith("7"))
    found = sorted(map(tuple, N.search(index, asked, 4, 0.3, probes=1).collect()))
    assert found == nearest(ids, x, 4, 0.3, [k for k, i in enumerate(ids) if i.endswith("7")])
    assert N.similar(df.where("1 = 0"), 3, 0.1).count() == 0
    with pytest.raises(ValueError, match="too few"):
        N.search(index, asked, 6, 0.3)


@pytest.mark.parametrize("floor", [-1.0, 0.2])
def test_index_of_vectors_without_clusters_is_cut_as_it_grows(spark, monkeypatch, floor):
    for name, value in {"SHARD": 64, "MOST_QUERIES": 50, "ROWS": 16, "KEPT": 40, "BLOCK": 24}.items():
        assert hasattr(N, name)
        monkeypatch.setattr(N, name, value)
    x = np.random.default_rng(11).normal(size=(400, 16))
    x[300:340] = x[0]
    ids = [f"v{k:03d}" for k in np.random.default_rng(12).permutation(400)]
    df = spark.createDataFrame(list(zip(ids, x.tolist(), strict=True)), "id string, embedding array<double>").repartition(3)
    for block in (2_048, 16):  # cells whole, and split among tasks
        found = N.search(N.build(df, 7, 30, block), df, 5, floor, 2)
        assert sorted(map(tuple, found.collect())) == nearest(ids, x, 5, floor, range(400))


def test_a_query_is_sent_once_to_a_task_and_not_to_each_cell(spark, monkeypatch):
    monkeypatch.setattr(N, "SHARD", 150)
    x = np.random.default_rng(1).normal(size=(300, 16))
    df = spark.createDataFrame([(f"v{k:03d}", v) for k, v in enumerate(x.tolist())], "id string, embedding array<double>")
    index = N.build(df, 4, 10)
    queries = df.selectExpr("xxhash64(id) as q1", "xxhash64(1, id) as q2", "embedding", "-1d as least")
    tasks = []
    cogroup = type(df.groupBy("id")).cogroup
    monkeypatch.setattr(type(df.groupBy("id")), "cogroup", lambda self, other: tasks.append((self._df.count(), other._df.count())) or cogroup(self, other))
    N._visit(index, queries, 3, -1.0, 1, True, 300)
    assert len(index.centroids) == 30 and tasks[0][0] <= 300 * 3 and tasks[0][1] == 300


def test_folds_in_order(spark):
    names = ["ann", "bob", "cy", "di", "eve", "fay", "gus", "hal"]
    for trial in range(3):
        r = random.Random(trial)
        nodes = [(f"e{k:02d}", r.choice("px"), r.choice(names).title(), r.sample(names, r.randrange(3)), "e00" if k == 39 else None) for k in range(40)]
        made = [(f"m{k:02d}", r.randrange(6), r.choice("px"), r.sample(names, r.randrange(1, 3)), r.choice("px"), r.sample(names, r.randrange(1, 3))) for k in range(14)]
        live, plain = {n[0]: [n[1], n[2].lower(), {n[2].lower(), *n[3]}] for n in nodes if not n[4]}, []
        for key, _, st, sf, lt, lf in sorted(made, key=lambda d: (d[1], d[0])):

            def find(forms, kind):
                near = [i for i, (t, _, own) in live.items() if t == kind and own & set(forms)]
                return min(near, key=lambda i: (live[i][1] != forms[0], live[i][1] not in forms, i), default=None)

            s, x = find(sf, st), find(lf, lt)
            ok = bool(s and x and s != x)
            if ok:
                live[s][2] |= live.pop(x)[2]
            plain.append((key, s, x, ok))
        df = spark.createDataFrame(nodes, "id string, type string, title string, aliases array<string>, merged_into string")
        stored = spark.createDataFrame(made, "merge_key string, created_on int, survivor_type string, survivor_forms array<string>, loser_type string, loser_forms array<string>")
        assert sorted(map(tuple, R.folded(stored, df).collect())) == sorted(plain)
        assert sum(p[3] for p in plain) > 2


def test_an_earlier_fold_makes_a_later_one_possible(spark):
    nodes = spark.createDataFrame([("a", "p", "Ann", [], None), ("b", "p", "Bob", ["Bobby"], None), ("c", "p", "Cy", None, None)], "id string, type string, title string, aliases array<string>, merged_into string")
    stored = spark.createDataFrame([("2", 2, "p", ["bobby"], "p", ["cy"]), ("1", 1, "p", ["ann"], "p", ["bob"]), ("3", 3, "p", ["no one"], "p", ["ann"]), ("4", 4, "p", [], "p", ["ann"])], "merge_key string, created_on int, survivor_type string, survivor_forms array<string>, loser_type string, loser_forms array<string>")
    found = sorted(map(tuple, R.folded(stored, nodes).collect()))
    assert found == [("1", "a", "b", True), ("2", "a", "c", True), ("3", None, "a", False), ("4", None, "a", False)]


def test_groups(spark):
    links = [("a", "b"), ("b", "c"), ("x", "y"), *((f"k{i:03d}", f"k{i + 1:03d}") for i in range(70))]
    rng.shuffle(links)
    found = {r.node: r.label for r in R.groups(spark.createDataFrame(links, "a string, b string")).collect()}
    assert found == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"} | {f"k{i:03d}": "k000" for i in range(71)}


TEXTS = [("t1", "We saw Ann Lee, and 100%_sure BOB."), ("t2", "annlee and Öl"), ("t3", None), ("t4", ""), ("t5", "x" * 200_000 + "ann lee"), ("t6", "ann  lee")]
PEOPLE = [("p1", "Ann Lee", ["ann", "Ann  Lee"]), ("p2", "100%_", ["a%e", "Öl"]), ("p3", "Bob", None), ("p4", None, ["annlee", "ANNLEE", "xxxx"])]


@pytest.mark.parametrize("most_bytes", [1 << 25, 30])
def test_mentions_against_contains(spark, most_bytes):
    texts, people = spark.createDataFrame(TEXTS, "node_id string, content string"), spark.createDataFrame(PEOPLE, "id string, title string, aliases array<string>")
    edges = spark.createDataFrame([("t1", "p3"), ("t2", "p1")], "src string, dst string")
    found = {(r.node_id, r.entity_id): r.alias for r in M.unlinked(texts, people, edges, 2, most_bytes).collect()}
    plain = {}
    for node, text in TEXTS:
        for ident, title, aliases in PEOPLE:
            names = sorted({" ".join(a.lower().split()): a for a in reversed([*(aliases or []), *([title] if title else [])]) if len(" ".join(a.lower().split())) >= 2}.values(), key=len, reverse=True)
            hits = [a for a in names if a.lower() in (text or "").lower()]
            if hits and (node, ident) not in {("t1", "p3"), ("t2", "p1")}:
                plain[node, ident] = hits[0].lower()
    assert {k: v.lower() for k, v in found.items()} == plain
    assert M.unlinked(texts, people.where("1 = 0"), edges).count() == 0


def test_no_similar_spelling_is_missed(spark):
    letters = "abcdef 12"
    names = ["".join(rng.choices(letters, k=rng.randrange(4, 16))).strip() or "none" for _ in range(60)]
    names += [n[:k] + rng.choice(letters) + n[k + 1 :] for n in names[:50] for k in [rng.randrange(len(n))]]
    nodes = spark.createDataFrame([(f"e{k:03d}", "person", n, ["qq zz"] if k % 9 == 0 else [], None) for k, n in enumerate(names)], "id string, type string, title string, aliases array<string>, merged_into string")
    found = {(r.a, r.b) for r in E.named_pairs(nodes).where("kind = 'fuzzy'").collect()}
    forms = {r.id: r.forms for r in E.surfaces(nodes).groupBy("id").agg(F.collect_list("form").alias("forms")).collect()}
    plain = set()
    for a in forms:
        for b in forms:
            if a < b:
                sets = [(set(x.split()), set(y.split())) for x in forms[a] for y in forms[b]]
                if any((p <= q or q <= p) and any(len(t) >= 4 for t in p & q) for p, q in sets):
                    continue
                if max((SequenceMatcher(None, x, y).ratio() for x in forms[a] for y in forms[b] if min(len(x), len(y)) >= 4), default=0) >= E.FUZZY:
                    plain.add((a, b))
    assert len(plain) > 30 and found == plain


def test_all_fuzzy_pairs_of_the_tables(spark):
    from strandweave.sources.bind import Model

    m = Model(spark, DATA)
    nodes = m.nodes.where("type in ('person', 'project')").cache()
    links = E.endpoints(m.nodes, m.edges).cache()
    found = {(r.a, r.b) for r in E.duplicate_pairs(nodes, links).where("kind = 'fuzzy'").collect()}
    forms = {r.id: (r.type, r.forms) for r in E.surfaces(nodes).groupBy("id", "type").agg(F.collect_list("form").alias("forms")).collect()}
    near: dict[str, set] = {}
    for r in links.collect():
        near.setdefault(r.id, set()).add(r.other)
    plain = set()
    for a, (ta, fa) in forms.items():
        for b, (tb, fb) in forms.items():
            if a < b and ta == tb and (near.get(a, set()) & near.get(b, set())) - {a, b}:
                sets = [(set(x.split()), set(y.split())) for x in fa for y in fb]
                if not any((p <= q or q <= p) and any(len(t) >= 4 for t in p & q) for p, q in sets) and max(SequenceMatcher(None, x, y).ratio() for x in fa for y in fb) >= E.FUZZY:
                    plain.add((a, b))
    assert plain and found == plain


def test_run_trees_are_deep(spark):
    chain = [(k, k - 1 if k else None, f"2024-01-01 00:00:{k % 60:02d}") for k in range(33)] + [(100, 5, "2024-01-01 00:00:00"), (101, 5, None), (200, 999, "2024-01-01 00:00:00")]
    runs = spark.createDataFrame(chain, "run_id bigint, parent_run_id bigint, started_at string").withColumn("started_at", F.col("started_at").cast("timestamp"))
    by = {r.run_id: (r.root_id, r.depth) for r in G.run_tree(runs).collect()}
    assert by[32] == (0, 32) and by[100] == (0, 6) and by[200] == (200, 0)
    tree = G.nested_runs(runs, spark.createDataFrame([(4,)], "root_id bigint")).orderBy("place").collect()
    assert [r.run_id for r in tree][:5] == [4, 5, 101, 100, 6] and tree[-1].run_id == 32 and tree[-1].depth == 28


def test_pointers_stop_at_rings(spark):
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (7, 8)], "node int, up int")
    assert {r.node: r.top for r in G.chased(ring).collect()}[7] == 8


def test_edge_store_is_made_anew_when_it_is_gone(spark):
    import shutil

    from strandweave.sources import clustered as C
    from strandweave.sources.bind import Model

    first = C.stored(Model(spark, DATA))
    assert C.stored(Model(spark, DATA)) is first
    rows = first.count()
    shutil.rmtree(first.stored_at)
    again = C.stored(Model(spark, DATA))
    assert again is not first and again.count() == rows
    m = Model(spark, DATA)
    both = {(r.center, r.rel, r.origin, r.dir, r.node_id) for r in m.ends.collect()}
    live = {r.id for r in G.live(m.nodes).collect()}
    plain = set()
    for e in m.edges.collect():
        plain |= {(e.src, e.rel, e.origin, "out", e.dst)} if e.dst in live else set()
        plain |= {(e.dst, e.rel, e.origin, "in", e.src)} if e.src in live else set()
    assert both == plain
    assert {r.id for r in m.touched.collect()} == {x for e in m.edges.where("origin = 'canonical'").collect() for x in (e.src, e.dst)}
