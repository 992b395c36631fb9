"""Replies to captures, times by kind, and plans to merge tags, case by case and against plain loops."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from strandweave.functions import dates as D
from strandweave.functions import symbolic as SY
from strandweave.operators import chat as CH
from strandweave.operators import organizer as O
from strandweave.operators import tagplans as TP

DAY = dt.date(2024, 5, 15)  # a Wednesday
V = O.Vocabulary(["memory", "idea", "insight", "person"], ["involves", "about"], ["person", "topic"], ["Health", "Ideas"], most_nodes=3, most_tags=2, most_edges=2)


def ref(kind, **more):
    return {"kind": kind, "phrase": "p", **more}


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        (ref("relative", unit="day", offset=-10), "2024-05-05"),
        (ref("relative", unit="week", offset=2), "2024-05-29"),
        (ref("relative", unit="month", offset=-5), "2023-12"),
        (ref("relative", unit="year", offset="-4"), "2020"),
        (ref("relative", unit="year", offset=-3000), None),
        (ref("relative", unit="day", offset=-99_999_9), None),
        (ref("weekday", weekday="Tuesday"), "2024-05-14"),
        (ref("weekday", weekday="wed"), "2024-05-08"),
        (ref("weekday", weekday="wed", direction="next"), "2024-05-22"),
        (ref("weekday", weekday="thurs", direction="this"), "2024-05-16"),
        (ref("weekday", weekday="noday"), None),
        (ref("month", month=3), "2024-03"),
        (ref("month", month=5), "2024-05"),
        (ref("month", month=8), "2023-08"),
        (ref("month", month=5, direction="next"), "2025-05"),
        (ref("month", month=12, direction="this"), "2024-12"),
        (ref("month", month=2, year=1999, direction="next"), "1999-02"),
        (ref("month", month=13), None),
        (ref("season", season="Fall", year_offset=-1), "2023-09/2023-11|autumn 2023"),
        (ref("season", season="winter", year=2021), "2021-12/2022-02|winter 2021"),
        (ref("season", season="winter", year=9999), None),
        (ref("explicit", year=2024, month=2, day=29), "2024-02-29"),
        (ref("explicit", year=2023, month=2, day=29), None),
        (ref("explicit", month=2, day=29), "2024-02-29"),
        (ref("explicit", month=6), "2023-06"),
        (ref("explicit", year=2020, day=3), None),
        (ref("explicit", day=3), None),
        (ref("explicit", year=2020, month=1, day=3, hour=7, minute=5), "2020-01-03T07:05"),
        (ref("explicit", year=2020, month=1, day=3, hour=7), "2020-01-03"),
        (ref("explicit", year=2020, hour=7), None),
        (ref("explicit", year=2020, note=1), None),
        (ref("never"), None),
        ({"kind": "relative", "unit": "day", "offset": 0}, None),
        ({"kind": "relative", "unit": "day", "offset": 0, "phrase": ""}, None),
        (ref("relative", unit="day"), None),
        (ref("relative", unit="day", offset=None), None),
        (ref("relative", unit="day", offset=1.5), None),
        ("text", None),
    ],
)
def test_references(given, expected):
    found = SY.resolved(given, DAY)
    assert (found and SY.token(found)) == (expected and f"[[t:{expected}]]")


def test_phrases_become_tokens():
    refs = [ref("relative", unit="day", offset=-1) | {"phrase": "yesterday"}, ref("month", month=3) | {"phrase": "last March", "event": True}, ref("month", month=3) | {"phrase": "March"}, ref("never") | {"phrase": "once"}, 7, ref("explicit", year=2020) | {"phrase": "absent", "event": True}]
    body = "once yesterday, yesterday in last March"
    assert SY.tokenised(body, refs, DAY) == ("once [[t:2024-05-14]], yesterday in [[t:2024-03]]", "2024-03", None, 1)
    assert SY.tokenised("x", [], DAY) == ("x", None, None, 0)
    season = ref("season", season="summer", year=2023) | {"event": True, "phrase": "then"}
    assert SY.tokenised("then", [season], DAY) == ("[[t:2023-06/2023-08|summer 2023]]", "2023-06", "2023-08", 0)


def test_three_forms_of_a_body(spark):
    body = "A [[t:2024-05-05]] b [[t:2024-03]] c [[t:2020]] d [[t:2023-06/2023-08|summer 2023]] e [[t:soon|x]] f [[t:2024-05-15T07:05]]"
    now = F.to_date(F.lit("2024-05-15"))
    row = spark.createDataFrame([(body,)], "body string").select(D.expand(F.col("body"), lambda t: D.relative_text(t, now)).alias("r"), D.expand(F.col("body"), lambda t: D.dated_text(t, now)).alias("d")).first()
    assert row.r == "A 10 days ago b 2 months ago c 4 years ago d summer 2023 e x f today"
    assert row.d == "A 5 May 2024 (10 days ago) b March 2024 (2 months ago) c 2020 (4 years ago) d summer 2023 e x f 15 May 2024, 07:05 (today)"


def organized(spark, *replies, parts=2):
    rows = [(k, r if r is None or isinstance(r, str) else json.dumps(r), DAY, parts) for k, r in enumerate(replies)]
    return [df.collect() for df in O.validated(spark.createDataFrame(rows, "capture_id int, reply string, anchor date, n_parts int"), V)]


def node(title="T", body="b", **more):
    return {"title": title, "body": body, **more}


def test_types_planes_and_proposals(spark):
    nodes, _, proposals = organized(spark, {"nodes": [node(type=" Idea ", plane="health", planes=["IDEAS", "x", 4, "Health"]), node(type="person", interiority="Internal"), node(type="alien", plane=3)]})
    by = {r.pos: r for r in nodes}
    assert [(by[k].type, by[k].coerced, by[k].plane, by[k].planes, by[k].interiority) for k in range(3)] == [("idea", False, "Health", ["Health", "Ideas"], "external"), ("memory", True, None, [], "internal"), ("memory", False, None, [], "external")]
    assert [tuple(p) for p in proposals] == [(0, "node_type", "alien")]


def test_unusable_replies_have_no_rows(spark):
    nodes, mentions, proposals = organized(spark, None, "", "no json", "[1]", {"nodes": {}}, {"nodes": [4, "x", node(title=" "), node(body=3), {"title": "a"}]})
    assert nodes == mentions == proposals == []


def test_arose_from_follows_the_nodes_that_stay(spark):
    nodes, _, _ = organized(spark, {"nodes": [node(title=""), node(title="A", arose_from=0), node(title="B", arose_from="1"), node(title="C", arose_from=3), node(title="D", arose_from=1)]}, {"nodes": [node(arose_from=True), node(arose_from=9), node(arose_from=-1), node(title="late", type="alien")]})
    assert {(r.capture_id, r.title, r.pos): r.arose_from for r in nodes} == {(0, "A", 0): None, (0, "B", 1): 0, (0, "C", 2): None, (1, "T", 0): None, (1, "T", 1): None, (1, "T", 2): None}


def test_tags_parts_and_mentions(spark):
    people = [{"name": " Ann ", "type": "Person", "rel": "INVOLVES", "disambig": " kin "}, {"name": "M", "type": "planet", "rel": "about"}, {"name": "B", "type": "topic", "rel": "hates"}, {"name": 3, "type": "topic", "rel": "about"}, {"name": "C", "type": "topic", "rel": "about", "disambig": " "}, {"name": "late", "type": "late", "rel": "about"}]
    nodes, mentions, proposals = organized(spark, {"nodes": [node(tags=["# Big Day", "big-day", "9", 4, "été", "c"], parts=[2, "1", 3, 0, True, 2, 1.5], entities=people)]})
    assert nodes[0].tags == ["big-day", "ete"] and nodes[0].parts == [2, 1]
    assert sorted(tuple(r)[2:] for r in mentions) == [(0, "Ann", "person", "involves", "kin"), (1, "C", "topic", "about", None)]
    assert sorted(tuple(p)[1:] for p in proposals) == [("edge_rel", "hates"), ("entity_type", "planet")]
    assert organized(spark, {"nodes": [node(parts=[1], tags="x", entities={}, time_refs=3)]}, parts=0)[0][0].parts == []


def test_disjoint_merges_against_a_loop(spark):
    rng = random.Random(9)
    words = ["a", "b", "c d", "#E", "f/g", "9", "", "h", "i", "j", "k", "Lé"]
    allowed = {"a": 5, "b": 9, "c-d": 1, "e": 9, "f/g": 2, "h": 2, "i": 1, "j": 7}
    for counts in (None, allowed):
        merges = [(p, k, rng.choice(words), rng.choices(words, k=rng.randrange(4))) for p in range(25) for k in range(rng.randrange(1, 9))]
        slug = {r.w: r.s for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", CH.clean_tag(F.col("w")).alias("s")).collect()}
        plain = []
        for plan in range(25):
            seen: set[str] = set()
            for p, k, c, v in merges:
                if p == plan:
                    members = list(dict.fromkeys(s for s in (slug[x] for x in [c, *v]) if s and s not in seen and (counts is None or s in counts)))
                    if len(members) > 1:
                        seen |= set(members)
                        best = slug[c] if slug[c] in members else min(members, key=lambda t: (-(counts or {}).get(t, 0), len(t), t))
                        plain.append((p, k, best, [t for t in members if t != best]))
        df = spark.createDataFrame(merges, "plan_id int, pos int, canonical string, variants array<string>")
        given = None if counts is None else spark.createDataFrame(list(counts.items()), "tag string, n bigint")
        assert sorted(map(tuple, TP.disjoint(df, given).collect())) == sorted(plain)
        assert TP.disjoint(df.where("1 = 0"), given).count() == 0


def test_tags_line_is_rewritten_alone(spark):
    files = [("a.md", '---\nid: a\ntags: [x, "b c", y]\nedges:\n  - {rel: tags, to: x}\n---\ntags: [x]\n'), ("b.md", "---\ntags: x\n---\nx"), ("c.md", "---\ntags: [z]\n---\nx"), ("d.md", "tags: [x]"), ("e.md", "---\nid: e\n---\nx")]
    names = spark.createDataFrame([("x", "y"), ("b c", "d")], "tag string, canonical string")
    found = {r.path: r.content for r in TP.rewritten(spark.createDataFrame(files, "path string, content string"), names).collect()}
    assert found == {"a.md": files[0][1].replace('tags: [x, "b c", y]', "tags: [y, d]", 1), "b.md": "---\ntags: [y]\n---\nx"}
