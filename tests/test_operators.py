"""Small cases of the engine's operators."""

import pytest
from pyspark.sql import functions as F

from strandweave.functions import columns as C
from strandweave.operators import activity as A
from strandweave.operators import graph as G
from strandweave.operators import search as S


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


def test_hard_split_covers_text_with_overlap(spark):
    parts = one(spark, C.hard_split(F.col("t"), 10, 3), t="abcdefghijklmnopqrstuvwxy")
    assert parts[0] == "abcdefghij" and all(len(p) <= 10 for p in parts)
    assert parts[0] + "".join(p[3:] for p in parts[1:]) == "abcdefghijklmnopqrstuvwxy"
    assert one(spark, C.hard_split(F.col("t"), 10, 10), t="abcdefghijkl") == ["abcdefghij", "kl"]
    assert one(spark, C.hard_split(F.col("t")), t="") == []


def test_snippet_and_fold(spark):
    assert one(spark, C.snippet(F.col("t"), 5), t="abcd efgh") == "abcd…"
    assert one(spark, C.normalize_alias(F.col("t")), t="  Élan   Ștefan ") == "elan stefan"


def test_humanize(spark):
    said = [one(spark, C.humanize_days(F.lit(n))) for n in (0, -1, 1, -27, 28, 340, -900)]
    assert said == ["today", "yesterday", "tomorrow", "27 days ago", "in a month", "in a year", "2 years ago"]


def test_zero_vector_has_no_cosine(spark):
    assert one(spark, C.cosine(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0)))) is None


def test_keyset_pages_walk_all_rows(spark):
    rows = spark.createDataFrame([("canonical", f"r{k % 3}", "in", f"n{k:02d}") for k in range(17)], "origin string, rel string, dir string, node_id string")
    seen, cursor = [], None
    while True:
        got = G.page(rows, 5, cursor).collect()
        seen += [tuple(r) for r in got[:5]]
        if len(got) <= 5:
            break
        cursor = tuple(got[4])
    assert seen == sorted(tuple(r) for r in rows.collect())


def test_run_tree_keeps_orphans_as_roots(spark):
    runs = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 99)], "run_id bigint, parent_run_id bigint")
    assert {tuple(r) for r in G.run_tree(runs).collect()} == {(1, 1, 0), (2, 1, 1), (3, 1, 2), (4, 4, 0)}


def test_search_params_clamp():
    p = S.Params("2024-01-01", top_k=500).clamped()
    assert p.top_k == 50 and p.candidates == 60


def test_weekdays(spark):
    d = F.to_date(F.lit("2026-07-08"))  # a Wednesday
    assert [str(one(spark, A.weekday_of(d, 2, w))) for w in ("last", "this", "next")] == ["2026-07-01", "2026-07-08", "2026-07-15"]


def test_feed_pages_join_up(spark):
    import datetime as dt

    from strandweave.sources.bind import Model

    m = Model(spark, "/root/testdata/sf0.001")
    from strandweave.plans import catalog

    rows = catalog._feed(m).cache()
    whole = [(r.ts, r.id, r.kind) for r in rows.collect()]
    seen, before = [], None
    for _ in range(100):
        page, before = A.read_feed(rows, before=before, limit=500)
        assert len(page) <= A.MOST_PAGE
        seen += [(r.ts, r.id, r.kind) for r in page]
        if before is None:
            break
    assert len(seen) == len(whole) and sorted(seen) == sorted(whole)
    assert [s[:2] for s in seen] == sorted((s[:2] for s in seen), reverse=True)
    page, _ = A.read_feed(rows, "captures", limit=0)
    assert len(page) == 1 and page[0].category == "captures" and len(A.read_feed(rows)[0]) == A.PAGE
    assert A.decoded(A.encoded(dt.datetime(2024, 1, 2, 3, 4, 5, 6), "x:1")) == ("2024-01-02 03:04:05.000006", "x:1")
    for bad in ("", "!!", "e30=", A.encoded(dt.datetime(2024, 1, 1), "a")[:-6]):
        with pytest.raises(A.BadCursor):
            A.decoded(bad)


def test_zone_lists_say_where_to_read_on(spark):
    rows = [("c", "at", "canonical", "in", f"n{k:02d}") for k in range(5)] + [("c", "in", "canonical", "out", "x"), ("d", "at", "derived", "in", "y")]
    found = spark.createDataFrame(rows, "center string, rel string, origin string, dir string, node_id string")
    lists = {(r.center, r.rel): r for r in G.zone_lists(found, 2).collect()}
    first = lists["c", "at"]
    assert first.neighbors == ["n00", "n01"] and first.total == 5 and lists["c", "in"].next_cursor is None and lists["d", "at"].total == 1
    at = one(spark, C.cursor("origin", "rel", "dir", "node_id"), origin="canonical", rel="at", dir="in", node_id="n01")
    assert first.next_cursor == at
    rest = G.page(found.where("center = 'c' and rel = 'at'"), 10, ("canonical", "at", "in", "n01")).collect()
    assert [r.node_id for r in rest] == ["n02", "n03", "n04"]


def test_review_pages_are_clamped(spark):
    from strandweave.operators import records as R

    items = spark.range(300).select(F.col("id").alias("item_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("kind"), F.when(F.col("id") % 3 == 0, "pending").otherwise("maybe").alias("status"), F.col("id").alias("created_at"))
    assert [R.review_page(items, s, k, n).count() for s, k, n in ((None, None, None), ("all", "", 9_999), ("pending", "a", 0), (" Pending", "b", 60))] == [50, 200, 1, 50]
    assert R.review_page(items, "", " ALL ", 1).first().item_id == 299
