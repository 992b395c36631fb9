"""Edits of node files, whole files from rows, and the store that they are written to."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from strandweave.functions import nodefiles as N
from strandweave.operators import files as FI
from strandweave.operators import nodefiles as NF
from strandweave.sources import nodestore

FILE = '---\nid: 01-ab\ntype: person\ncreated: 2024-05-01T08:00:00+02:00\nmood:   odd  # kept\nsource: capture\ntags: [a, "b, c"]\nedges:\n  - {rel: at, to: p1, since: 2024}\n  - {to: "p 2", rel: "at"}\n  - {rel: at_home, to: p1}\n\tnote: indented\nlast: 1\n---\n# Title\n\nedges:\n  - {rel: at, to: p1}\nSeen [[t:2024]] and [[t:2024]].  \n'
rng = random.Random(5)


def test_append_edges():
    text, n = N.with_edges(FILE, [{"rel": "at", "to": "p1"}, {"rel": "at", "to": "p 2"}, {"rel": "in", "to": "q", "conf": 0.5, "until": "2025"}])
    assert n == 1 and text == FILE.replace("\tnote: indented\n", "\tnote: indented\n  - {rel: in, to: q, conf: 0.5, until: 2025}\n")
    assert N.with_edges(text, [{"rel": "in", "to": "q"}]) == (text, 0)
    assert N.with_edges("---\nid: a\n---\nx", [{"rel": "at", "to": 'a"b'}])[0] == '---\nid: a\nedges:\n  - {rel: at, to: "a\\"b"}\n---\nx'
    assert N.with_edges("---\r\nid: a\r\n---\r\nx", [{"rel": "at", "to": "b"}])[0] == "---\r\nid: a\r\nedges:\r\n  - {rel: at, to: b}\r\n---\r\nx"
    assert N.with_edges("---\n---\n", [{"rel": "at", "to": "b"}])[0] == "---\nedges:\n  - {rel: at, to: b}\n---\n"
    with pytest.raises(N.NoFront):
        N.with_edges("no front", [{"rel": "at", "to": "b"}])


def test_retarget_and_retype():
    assert N.retargeted(FILE, "p 2", "p9") == (FILE.replace('to: "p 2", rel', "to: p9, rel"), 1)
    assert N.retargeted(FILE, "p 2", "p1") == (FILE.replace('  - {to: "p 2", rel: "at"}\n', ""), 1)
    assert N.retargeted(FILE, "none", "x") == (FILE, 0) and N.retargeted("bare", "a", "b") == ("bare", 0)
    assert N.retyped(FILE, "p1", "at", "near") == (FILE.replace("{rel: at, to: p1, since", "{rel: near, to: p1, since"), 1)
    assert N.retyped(FILE, "p1", "at_home", "at") == (FILE.replace("  - {rel: at_home, to: p1}\n", ""), 1)


def test_lists_dates_tokens():
    assert N.with_list(FILE, "tags", ["x y", "z"])[0] == FILE.replace('tags: [a, "b, c"]', 'tags: ["x y", z]')
    assert N.with_list(FILE, "aliases", ["q"])[0] == FILE.replace("edges:\n  - {rel: at, to: p1, since", "aliases: [q]\nedges:\n  - {rel: at, to: p1, since")
    dated, n = N.with_dates(FILE, "2024-02", "2024-03")
    assert n == 1 and dated == FILE.replace("source: capture\n", "occurred: 2024-02\noccurred_end: 2024-03\nsource: capture\n")
    assert N.with_dates(dated, None, None) == (FILE, 1) and N.with_dates(dated, "2024-02", "2024-03") == (dated, 0)
    assert N.with_token(FILE, "[[t:2024]]", "[[t:2025|x]]") == (FILE.replace("Seen [[t:2024]]", "Seen [[t:2025|x]]"), 1)
    assert N.with_token(FILE, "created", "x") == (FILE, 0)


def test_edits_leave_every_other_byte():
    ops = [("append", "in", "q", None), ("retarget", "p1", "p7", None), ("retype", "p1", "at", "near"), ("list", "aliases", None, None), ("dates", "2024", None, None), ("token", "[[t:2024]]", "[[t:1]]", None)]
    for _ in range(200):
        text = FILE
        for op, a, b, c in rng.choices(ops, k=4):
            new, _, error = N.applied(text, [{"op": op, "a": a, "b": b, "c": c, "values": ["v"]}])
            assert error is None
            lines, kept = text.split("\n"), new.split("\n")
            assert sum(x not in lines for x in kept) <= 1 + (op == "retarget")  # what is new is the edit's own lines
            text = new
        assert text.endswith(FILE[FILE.index("# Title") :].replace("Seen [[t:2024]] and [[t:2024]]", text[text.index("Seen ") :].split(".")[0]))


def test_edits_in_order_and_errors(spark):
    files = spark.createDataFrame([("a.md", FILE), ("b.md", "bare")], "path string, content string")
    rows = [("a.md", 2, "retarget", "q", "r", None, None), ("a.md", 1, "append", "in", "q", None, None), ("b.md", 1, "append", "in", "q", None, None), ("gone.md", 1, "dates", "2024", None, None, None), ("b.md", 2, "tombstone", "b", "person", "a", None)]
    found = {r.path: r for r in NF.edited(files, spark.createDataFrame(rows, NF.EDIT)).collect()}
    assert "{rel: in, to: r}" in found["a.md"].content and found["a.md"].changes == 2 and found["a.md"].error is None
    assert found["b.md"].content == N.tombstone("b", "person", "a") and "front matter" in found["b.md"].error
    assert found["gone.md"].content is None and "gone" in found["gone.md"].error


@pytest.fixture
def nodes(spark):
    kind = "id string, type string, title string, body string, created string, source string, tags array<string>, aliases array<string>, occurred string, interiority string, edges array<struct<rel:string,to:string,since:string>>"
    rows = [("n1", "person", 'Ann "A" Lee', " Text. ", "2024-05-01T08:00:00", "capture", ["x y", "z"], ["An\\n"], None, None, [("at", "p:1", "2024-02"), ("at", "p2", None)]), ("n2", "memory", "Day", "", "2024-05-02T08:00:00", "chat", [], [], "2024-02", "mixed", None)]
    return spark.createDataFrame(rows, kind)


def test_rendered_files_read_back(spark, nodes):
    made = NF.rendered(nodes).withColumn("path", F.concat("id", F.lit(".md")))
    back = {r.id: r for r in FI.metadata(made).collect()}
    a, b = back["n1"], back["n2"]
    assert (a.type, a.title, a.tags, a.aliases) == ("person", 'Ann "A" Lee', ["x y", "z"], ["An\\n"])
    assert [(e.rel, e.to, e.since) for e in a.edges] == [("at", "p:1", "2024-02"), ("at", "p2", None)]
    assert str(b.occurred_start) == "2024-02-01" and b.interiority == "mixed" and b.edges == []
    assert {r.content.split("\n")[-2] for r in made.collect()} == {"Text.", "# Day"}


def test_store_round_trip(spark, nodes, tmp_path):
    nodestore.register(spark)
    root = str(tmp_path / "store")
    files = NF.rendered(nodes).select(F.concat("id", F.lit("/f.md")).alias("path"), "content")
    save = lambda df: df.write.format("nodestore").option("path", root).mode("append").save()
    save(files)
    assert json.load(open(f"{root}/_committed.json"))["written"] == 2
    save(files)  # again: nothing changes
    assert json.load(open(f"{root}/_committed.json")) == {"written": 0, "unchanged": 2, "bytes": 0}
    scanned = FI.scan(spark, root)
    assert sorted(map(tuple, scanned.collect())) == sorted(map(tuple, files.collect()))
    done = NF.edited(scanned, spark.createDataFrame([("n1/f.md", 1, "retarget", "p2", "p9", None, None)], NF.EDIT))
    save(done.select("path", "content"))
    assert "to: p9" in open(f"{root}/n1/f.md").read() and len(os.listdir(f"{root}/n1")) == 1


def test_a_failed_task_leaves_no_half_file(spark, tmp_path):
    nodestore.register(spark)
    root = str(tmp_path / "store")
    rows = spark.createDataFrame([("a.md", "new a"), ("../out.md", "x")], "path string, content string").coalesce(1)
    os.makedirs(root)
    open(f"{root}/a.md", "w").write("old a")
    with pytest.raises(Exception, match="no file of a store"):
        rows.write.format("nodestore").option("path", root).mode("append").save()
    assert os.listdir(root) == ["a.md"] and open(f"{root}/a.md").read() in ("old a", "new a")
    assert not os.path.exists(tmp_path / "out.md")


def test_a_write_that_breaks_off_keeps_the_old_file(tmp_path, monkeypatch):
    from pyarrow import fs

    root = str(tmp_path)
    open(f"{root}/a.md", "w").write("old")

    class Broken(fs.LocalFileSystem):
        pass

    writer = nodestore.NodeWriter(root)
    local = fs.LocalFileSystem()

    class Moveless:
        def __getattr__(self, name):
            if name == "move":
                raise OSError("lost")
            return getattr(local, name)

    monkeypatch.setattr(writer, "_place", lambda: (Moveless(), root))
    with pytest.raises(OSError, match="lost"):
        writer.write(iter([{"path": "a.md", "content": "new"}]))
    assert os.listdir(root) == ["a.md"] and open(f"{root}/a.md").read() == "old"


def test_paths_stay_below_the_root():
    assert nodestore.relative("a/./b.md") == "a/b.md"
    for bad in (None, "", "/a.md", "../a.md", "a/../../b.md", "..\\a.md", "a.txt"):
        with pytest.raises(ValueError):
            nodestore.relative(bad)
