"""Stems, ranks and matches of full text against published values and brute force over whole texts."""

import re

import pytest
from pyspark.sql import functions as F

from strandweave.functions.stems import TEXT_STOP_WORDS, stem
from strandweave.operators import fulltext as T

STEMS = """consigned consign consistency consist consolatory consolatori consolingly consol conspicuously conspicu conspiracy conspiraci
constancy constanc knackeries knackeri knavish knavish kneeling kneel knightly knight knitted knit knives knive generous generous
communism communism hoping hope hopping hop ties tie cries cri happily happili national nation running run dying die skies sky
luxuriated luxuri gas gas gaps gap falling fall controll control agreed agre bled bled relational relat hopefulness hope""".split()


def test_published_stems():
    assert {w: stem(w) for w in STEMS[::2]} == dict(zip(STEMS[::2], STEMS[1::2], strict=True))


def frame(spark, texts):
    return spark.createDataFrame([(f"n{i}", 0, t) for i, t in enumerate(texts)], "node_id string, chunk_index int, content string")


def found(spark, texts, asked):
    rows = frame(spark, texts)
    return {r[0]: r[2] for r in T.scores(T.postings(rows), T.question(asked), rows).collect()}


def test_ranks_of_plain_cases(spark):
    assert found(spark, ["a fat cat"], "cat") == {"n0": 0.060793}
    assert found(spark, ["fat cat"], "fat cats") == {"n0": 0.099103}
    assert found(spark, ["cat cat", "cat"], "cat or dog") == {"n0": 0.037995, "n1": 0.030396}  # (1 + 1/4) and 1, over 2 words
    near, far = (found(spark, [t], "fat cat")["n0"] for t in ("fat cat", "fat " + "word " * 30 + "cat"))
    assert near > far > 0


def test_odd_texts_and_searches(spark):
    texts = ["", None, "Café-Besuch!", "the of and", "x " * 20000 + "needle", "needle"]
    assert found(spark, texts, "café").keys() == {"n2"}
    assert found(spark, texts, "café-besuch").keys() == {"n2"}
    assert found(spark, texts, "the of") == {}
    assert found(spark, texts, "") == {}
    assert found(spark, texts, "needles").keys() == {"n4", "n5"}
    assert found(spark, texts, "-needle").keys() == {"n0", "n1", "n2", "n3"}
    assert found(spark, texts[:1], "needle") == {}
    with pytest.raises(ValueError):
        T.scores(T.postings(frame(spark, texts)), T.question("-needle"))


def brute(text, asked):
    """Alternatives and terms over the list of a text's stems, phrase by phrase."""
    row = [None if w in TEXT_STOP_WORDS else stem(w) for w in re.findall(r"[^\W_]+", text.lower())]

    def holds(words):
        want = [None if w in TEXT_STOP_WORDS else stem(w) for w in words]
        while want and want[-1] is None:
            want.pop()
        while want and want[0] is None:
            want.pop(0)
        return any(all(w is None or row[i + k] == w for k, w in enumerate(want)) for i in range(len(row) - len(want) + 1))

    return any(all(holds(words) != out for words, out in group) for group in asked)


CASES = {
    "that": [],
    "thing": [[(["thing"], False)]],
    "thing her -the wher": [[(["thing"], False), (["wher"], False)]],
    '"ther thing"': [[(["ther", "thing"], False)]],
    '"thing and thing" or hably': [[(["thing", "and", "thing"], False)], [(["hably"], False)]],
    "thing -wher or -thing": [[(["thing"], False), (["wher"], True)], [(["thing"], True)]],
}


def test_matches_of_whole_documents_against_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").cast("string").alias("node_id"), F.lit(0).alias("chunk_index"), F.col("text").alias("content")).cache()
    texts = {r[0]: r[2] or "" for r in rows.collect()}
    made = T.postings(rows).cache()
    sizes = []
    for asked, groups in CASES.items():
        got = {r[0] for r in T.scores(made, T.question(asked), rows).collect()}
        assert got == {i for i, t in texts.items() if brute(t, groups)}, asked
        sizes.append(len(got))
    assert sizes[0] == 0 and sizes[1] > 0 and sizes[-1] > 0


def test_stored_postings_give_the_same_and_read_their_buckets_only(spark, tmp_path):
    rows = frame(spark, ["red foxes run", "a red house", "running water", None])
    made = T.postings(rows)
    T.store(made, str(tmp_path / "p"))
    asked = T.question("red -house or running")
    kept = T.stored(spark, str(tmp_path / "p"), asked)
    assert sorted(T.scores(kept, asked).collect()) == sorted(T.scores(made, asked).collect())
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "In(lexeme" in plan
    assert T.stored(spark, str(tmp_path / "p"), T.question("the")).count() == 0


def test_words_begin_as_their_lexemes_say(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("w")).distinct()
    words = {r.w for r in rows.collect()} | set(STEMS[::2]) | set("skis skies dying lying tying idly gently ugly early only singly yes sensibility possibilities y yy".split())
    ends = "s ed ing ied ies ational tional ability ibility biliti iviti ization izer ously fulness ousness alism ement ly li logi ance ence ate icate alize y ee sses eedly ingly".split()
    words |= {a + b for a in ("t", "by", "sens", "relat", "happ", "cab", "trouble", "luxur", "hop", "conflat", "geo", "siz") for b in ends}
    assert len(words) > 300
    assert not [w for w in words if not w.startswith(T.stem_start(stem(w)))]


def test_a_search_takes_only_texts_apart_that_can_hold_its_words(spark):
    texts = ["Order 12 4-NOT SPECIFIED", "things, hable", None, "", "xthing", "THING thing"]
    rows = frame(spark, texts)
    asked = T.question("thing or hable")
    made = T.postings(rows, T.lexemes(asked))
    assert {r[0] for r in made.collect()} == {"n1", "n5"}
    assert sorted(T.scores(made, asked).collect()) == sorted(T.scores(T.postings(rows), asked).collect())
    assert T.postings(rows, []).count() == 0
