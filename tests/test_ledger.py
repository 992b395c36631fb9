"""Small cases of the record transitions: nulls, repeats, unknown keys, empty tables, halts."""

from pyspark.sql import functions as F

from strandweave.operators import ledger as L
from strandweave.operators import replay as R


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_upsert_keeps_the_newest_and_takes_empty_tables(spark):
    table = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("b", 5), ("c", None)], "k string, v int")
    assert rows(L.upserted(table, new, ["k"], [F.desc("v")])) == [("a", 1), ("b", 5), ("c", None)]
    assert rows(L.upserted(table, new.limit(0), ["k"])) == [("a", 1), ("b", 2)]
    assert rows(L.upserted(table.limit(0), new.limit(1), ["k"])) == [("b", 3)]


def test_insert_changes_no_row_and_files_nothing_twice(spark):
    table = spark.createDataFrame([("a", 1, "x")], "k string, v int, w string")
    new = spark.createDataFrame([("a", 9), ("c", 3), ("c", 3)], "k string, v int")
    once = L.inserted(table, new, ["k"])
    assert rows(once) == [("a", 1, "x"), ("c", 3, None)]
    assert rows(L.inserted(once, new, ["k"])) == rows(once)


def test_update_sets_nulls_and_respects_its_guard(spark):
    table = spark.createDataFrame([("a", 1, "open"), ("b", 2, "shut"), ("c", 3, None)], "k string, v int, s string")
    change = spark.createDataFrame([("a", None), ("b", 7), ("c", 8), ("z", 9)], "k string, v int")
    assert rows(L.updated(table, change, "k")) == [("a", None, "open"), ("b", 7, "shut"), ("c", 8, None)]
    assert rows(L.updated(table, change, "k", F.col("s") == "open")) == [("a", None, "open"), ("b", 2, "shut"), ("c", 3, None)]


def test_steps_stop_at_a_failure_that_halts_and_only_there(spark):
    steps = spark.createDataFrame(
        [("p", 0, "a", "continue", True), ("p", 1, "b", "continue", True), ("p", 2, "c", "halt", True), ("p", 3, "d", "continue", True), ("q", 0, "x", "halt", False), ("q", 1, "a", "halt", True)],
        "pipeline string, position int, step string, on_fail string, wired boolean",
    )
    runs = spark.createDataFrame([("p", "a", 1, "failed"), ("p", "capture", 2, "failed"), ("p", "c", 3, "succeeded"), ("p", "c", 4, "running")], "pipeline string, agent string, run_id int, status string")
    found = rows(L.step_outcomes(steps, runs).select("pipeline", "position", "status", "run_id", "halted"))
    assert found == [("p", 0, "failed", 1, False), ("p", 1, "skipped", None, False), ("p", 2, "failed", 4, True), ("q", 0, "missing", None, True)]


def test_a_merge_is_replayed_only_between_two_nodes(spark):
    nodes = spark.createDataFrame([("1", "person", "Ann", ["a."], None), ("2", "person", "Anne", [], None), ("3", "place", "Ann", [], None)], "id string, type string, title string, aliases array<string>, merged_into string")
    stored = [("k1", 1, "person", ["ann"], "person", ["anne"]), ("k2", 2, "person", ["ann"], "person", ["a."]), ("k3", 3, "person", ["ann"], "person", ["gone"])]
    stored = spark.createDataFrame(stored, "merge_key string, created_on int, survivor_type string, survivor_forms array<string>, loser_type string, loser_forms array<string>")
    assert rows(R.folded(stored, nodes)) == [("k1", "1", "2", True), ("k2", "1", "1", False), ("k3", "1", None, False)]


def test_verdicts_refuse_what_they_cannot_use(spark):
    items = spark.createDataFrame([(1, ["a"], "a", None, None, ["person"]), (2, ["a"], None, "Jo", "person", ["person"]), (3, [], "new", " ", "person", ["person"]), (4, [], "new", "Jo", "mood", ["person"])], "item_id int, candidates array<string>, choice string, name string, type string, types array<string>")
    assert rows(L.entity_verdicts(items)) == [(1, "resolved", "a", False, None), (2, "pending", None, False, "unknown choice"), (3, "pending", None, False, "no usable mention"), (4, "pending", None, False, "no usable mention")]
    asked = spark.createDataFrame([(1, "n", "Maybe", None), (2, "n", "no date", None), (3, "gone", "May", None), (4, "n", "May", None), (5, "n", None, None)], "item_id int, node_id string, answer string, resolved date")
    nodes = spark.createDataFrame([("n",)], "id string")
    assert rows(L.date_verdicts(asked, nodes).select("item_id", "status", "error")) == [(1, "maybe", None), (2, "discarded", None), (3, "discarded", None), (4, "pending", "no date in the answer"), (5, "pending", "no answer")]
