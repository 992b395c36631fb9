"""Node files, chunks, dates and small cleaners on hand-made input."""

import pytest
from pyspark.sql import functions as F

from strandweave.functions import dates as D
from strandweave.functions import markdown as M
from strandweave.operators import chat as CH
from strandweave.operators import entities as E
from strandweave.operators import files as FI

NOTE = '''---\r
id: x1
type: person
tags: [a, "b, c", "say \\"hi\\""]
# comment
occurred: 2025-02
edges:
  - {rel: at, to: p1, conf: 0.5, since: 2024}
  - {rel: only}
aliases: [Ana]
---
# Title here

```
# not a heading
```
## Part
text
'''


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def test_scan_and_metadata(spark, tmp_path):
    for path, text in (("person/ana.md", NOTE), ("deep/er/plain.md", "no front"), (".git/skip.md", "x"), ("a/.trash/skip.md", "x"), ("other.txt", "x")):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text, newline="")
    files = FI.scan(spark, f"file://{tmp_path}")
    rows = {r.path: r for r in FI.metadata(files).collect()}
    assert set(rows) == {"person/ana.md", "deep/er/plain.md"}
    ana, plain = rows["person/ana.md"], rows["deep/er/plain.md"]
    assert (ana.id, ana.type, ana.title, ana.tags, ana.aliases) == ("x1", "person", "Title here", ["a", "b, c", 'say "hi"'], ["Ana"])
    assert (str(ana.occurred_start), str(ana.occurred_end)) == ("2025-02-01", "2025-02-28")
    assert [(e.rel, e.to, e.conf, e.since) for e in ana.edges] == [("at", "p1", "0.5", "2024")]
    assert (plain.type, plain.title, plain.edges) == ("deep", "plain", []) and len(plain.id) == 36


def test_chunks():
    assert M.chunks_of("", 10, 2) == [] and M.chunks_of("  \n ", 10, 2) == []
    assert M.chunks_of("intro\n# A\none\n## B\ntwo", 100, 0) == ["intro", "# A\none", "## B\ntwo"]
    assert M.chunks_of("# A\n```\n# no\n```\nend", 100, 0) == ["# A\n```\n# no\n```\nend"]
    assert M.chunks_of("aaaa\n\nbbbb\n \n\ncccc", 10, 0) == ["aaaa\n\nbbbb", "cccc"]
    assert M.chunks_of("abcdefghij", 4, 1) == ["abcd", "defg", "ghij"] and M.chunks_of("abcdefgh", 4, 9) == ["abcd", "efgh"]
    assert M.chunks_of("ab\n\nabcdefghij\n\ncd", 4, 1) == ["ab", "abcd", "defg", "ghij", "cd"]
    assert M.chunks_of("a\r\n\r\nb", 3, 0) == ["a", "b"]
    with pytest.raises(ValueError):
        M.chunks(F.lit("x"), 0)


@pytest.mark.parametrize(("text", "first", "last"), [("2025", "2025-01-01", "2025-12-31"), ("2024-02", "2024-02-01", "2024-02-29"), ("2024-02-30", None, None), ("2024-13", None, None), ("0000", None, None), ("2024-02-29T07:05", "2024-02-29", "2024-02-29"), ("2024-02-29T24:05", None, None), ("soon", None, None)])
def test_partial_dates(spark, text, first, last):
    p = D.partial(F.col("t"))
    got = spark.createDataFrame([(text,)], "t string").select(D.floor_day(p).alias("a"), F.when(p.isNotNull(), D.ceil_day(p)).alias("b")).first()
    assert tuple(None if x is None else str(x) for x in got) == (first, last)


def test_tokens(spark):
    body = "a [[t:2024-07-07T22:00]] b [[t:2024/x|lost]] [[t:bad]] [[t:2024-06/2024-08|summer]] [[t:2024-06/2025]]."
    assert one(spark, D.expand(F.col("b"), D.token_text), b=body) == "a 7 July 2024, 22:00 b lost bad summer June 2024 – 2025."
    assert one(spark, D.expand(F.col("b"), D.token_text), b="no token") == "no token"


def test_names():
    match = lambda a, b: E.name_match.func(*[__import__("pandas").Series([x]) for x in (a, b)]).iloc[0].tolist()
    assert match(["diana vance"], ["diana"]) == ["containment", 0.5]
    assert match(["ana b"], ["b ana"])[0] is None or match(["ana b"], ["b ana"])[0] == "fuzzy"
    assert match(["maria pop"], ["pop maria"]) == ["exact", 1.0]
    assert match(["cust 12"], ["cust 13"])[0] == "fuzzy" and match(["john smith"], ["mary brown"])[0] is None


def test_citations_and_tags(spark):
    assert one(spark, CH.renumbered("t", F.lit(3)), t="x [3] y [1][3] [9] [note]") == "x [1] y [2][1]  [note]"
    assert one(spark, CH.cited(F.col("t"), 3), t="x [3] y [1][3] [9]") == [3, 1]
    assert [one(spark, CH.clean_tag(F.col("t")), t=t) for t in ("# Été  2024!", "2024", "--a//", "")] == ["ete-2024", "", "a", ""]


def test_upsert_and_guard(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert {tuple(r) for r in FI.upsert(table, new, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert {tuple(r) for r in FI.insert_new(table, new, ["k"]).collect()} == {(1, "a"), (2, "b"), (3, "d")}
    assert {tuple(r) for r in FI.update_where(table, F.col("k") == 2, v=F.lit("z")).collect()} == {(1, "a", False), (2, "z", True)}


def test_merge_chains(spark):
    m = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "loser string, survivor string")
    assert {tuple(r) for r in E.final_survivors(m).collect()} == {("a", "d"), ("b", "d"), ("c", "d"), ("x", "y")}
