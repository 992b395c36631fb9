"""Entities with matching token sets, linked or not, against plain loops over all pairs."""

import random

import pytest

from strandweave.operators import entities as E

SCHEMA = "id string, type string, title string, aliases array<string>, merged_into string"


def plain(rows, near=None):
    forms = {i: (t, [set(" ".join(x.lower().split()).split()) for x in [title, *aliases] if x.strip()]) for i, t, title, aliases, gone in rows if gone is None}
    out = {}
    for a, (ta, xs) in forms.items():
        for b, (tb, ys) in forms.items():
            if a < b and ta == tb:
                scores = [min(len(p), len(q)) / max(len(p), len(q)) for p in xs for q in ys if (p <= q or q <= p) and any(len(t) >= 4 for t in p & q)]
                common = None if near is None else len((near.get(a, set()) & near.get(b, set())) - {a, b})
                if scores and common != 0:
                    out[a, b] = (round(max(scores), 6), *([] if near is None else [common]))
    return out


@pytest.fixture(scope="module")
def people(spark):
    r = random.Random(5)
    words = ["anna", "bert", "lee", "of", "carla", "x", "dora"]
    name = lambda: " ".join(r.choices(words, k=r.randrange(1, 4)))
    rows = [(f"e{k:03d}", r.choice(["person", "place"]), name().title(), [name() for _ in range(r.randrange(3))] + (["  "] if k % 7 == 0 else []), "e000" if k % 31 == 5 else None) for k in range(160)]
    links = [(f"e{r.randrange(160):03d}", r.choice([f"o{r.randrange(40):02d}", f"e{r.randrange(160):03d}", "hub"])) for _ in range(700)]
    links += [("e010", "e010"), ("e011", "e010"), ("e010", "e011")]
    return rows, links + links[:200]  # some come twice


def test_named_pairs_are_all_and_each_once(spark, people):
    rows, _ = people
    found = E.named_pairs(spark.createDataFrame(rows, SCHEMA), spelling=False).collect()
    want = plain(rows)
    assert len(found) == len(want) > 1000 and {(r.a, r.b): (round(r.score, 6),) for r in found} == want
    assert all((r.kind == "exact") == (r.score == 1) for r in found)


@pytest.mark.parametrize("alive", [None, {"hub", "e010"} | {f"o{k:02d}" for k in range(20)}])
def test_linked_pairs_count_common_neighbours_once(spark, people, alive):
    rows, links = people
    near = {}
    for a, b in links:
        if alive is None or b in alive:
            near.setdefault(a, set()).add(b)
    forms = E.surfaces(spark.createDataFrame(rows, SCHEMA))
    live = None if alive is None else spark.createDataFrame([(x,) for x in sorted(alive)], "id string")
    found = E.linked_pairs(forms, spark.createDataFrame(links, "id string, other string"), live).collect()
    want = plain(rows, near)
    assert want and len(found) == len(want) and {(r.a, r.b): (round(r.score, 6), r.shared) for r in found} == want


def test_a_frequent_name_is_matched_once_and_not_by_pairs(spark):
    rows = [(f"e{k:05d}", "person", "Anna Lee", ["Lee" if k % 2 else "Anna"], None) for k in range(3000)]
    forms = E.surfaces(spark.createDataFrame(rows, SCHEMA))
    own, pairs = E.name_sets(forms)
    assert pairs.count() == 3 and own.count() == 4500  # two sets in themselves, one in the other; "lee" tells no one apart
    links = spark.createDataFrame([(r[0], f"o{r[0]}") for r in rows], "id string, other string")
    assert E.linked_pairs(forms, links).count() == 0


@pytest.mark.parametrize("most", [3, 100])
def test_candidates_are_counted_as_they_would_be_listed(spark, people, most, monkeypatch):
    rows, _ = people
    nodes = spark.createDataFrame(rows, SCHEMA)
    r = random.Random(8)
    said = [(" ".join(r.choices(["anna", "Bert", "lee", "carla", "dora", "nobody", "x"], k=r.randrange(1, 4))), r.choice(["person", "place"])) for _ in range(80)]
    mentions = spark.createDataFrame([*said, ("", "person"), ("zz", "place")], "mention string, type string")
    exact, token = E.exact_matches(nodes, mentions).collect(), E.token_matches(nodes, mentions, most).collect()
    monkeypatch.setattr(E, "token_matches", None)  # mentions with a frequent word are not listed one by one
    found = {(x.mention, x.type): (x.candidates, x.exact, x.outcome) for x in E.decide(nodes, mentions, most).collect()}
    assert len(found) == len({*said}) + 2
    for (mention, kind), (n, x, outcome) in found.items():
        own = {e.id for e in exact if (e.mention, e.type) == (mention, kind)}
        every = own | {t.id for t in token if (t.mention, t.type) == (mention, kind)}
        assert (n, x) == (len(every), len(own))
        assert outcome == ("mint" if not every else f"link:{min(own)}" if len(own) == 1 else "review")
    assert {o.split(":")[0] for _, _, o in found.values()} == {"mint", "link", "review"} and max(n for n, _, _ in found.values()) >= 3
