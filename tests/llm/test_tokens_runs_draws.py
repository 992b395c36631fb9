"""Byte pairs, word tries and periodic runs against the tokenizer library, plain loops and their edge cases."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from strandweave.llm import bytepairs, queries, repetitions, wordtries
from strandweave.llm.textkit import strings

DATA = "/root/testdata/sf0.001"
rng = random.Random(11)
SCHEMA = "doc_id bigint, text string, ids string, rank int, runs string, Offsets string, score double"
PERIOD = " ".join(f"p{k}" for k in range(7))
TEXTS = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "it's they'll we'RE ''s !'d a  b\n\n c\r\n"),
    (5, f"head {PERIOD} {PERIOD} {PERIOD} {PERIOD} p0 p1 tail"),
    (5, f"head {PERIOD} {PERIOD} {PERIOD} {PERIOD} p0 p1 tail"),
    (6, "x " * 40_000),
    (7, " ".join(f"w{rng.randrange(3000)}" for _ in range(60_000))),
    (None, "no id " * 12),
    (8, "é日本😀 a\x00b\x1cc ½٣ ́x \x85"),
    (9, "q" * 150_000),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(d, t, "i", 1, "r", "o", 0.5) for d, t in TEXTS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def encoded(texts):
    m = bytepairs.merger(bytepairs.default_path())
    ids, _, counts = m.encode(strings(pa.array(texts, pa.string())))
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_pieces_are_the_librarys(library):
    atoms = ["'", "s", "t", "re", "ll", "ve", "'s", "'re", "'ll", "'d", " ", "  ", "\n", "\t", " ", "　", "a", "B", "é", "日", "1", "٣", "½", "!", "-", "😀", "́", "‍", "\x85", "\x1c", "\x00"]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randrange(30))) for _ in range(4000)]
    texts += ["a" * 3000, "ab" * 900, "é" * 500, " " * 999, "\n " * 300, "".join(rng.choices("abcdef", k=5000))]
    assert encoded(texts) == [library.encode_ordinary(t) for t in texts]


def test_every_code_point_is_the_librarys(library):
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    rng.shuffle(points)
    texts = ["".join(map(chr, points[k : k + 4000])) for k in range(0, len(points), 4000)]
    assert encoded(texts) == [library.encode_ordinary(t) for t in texts]


def test_scan_is_the_plain_walk():
    code = np.array([rng.randrange(16) for _ in range(5000)], np.uint8)
    state, plain = bytepairs.BETWEEN, []
    for f in code.tolist():
        state = int(bytepairs.STATE[f, state])
        plain.append(state)
    assert bytepairs.scan(code).tolist() == plain


def test_byte_pairs_on_documents(spark, documents, library):
    found = {r.doc_id: r for r in queries.op11_byte_pairs(spark, DATA).collect()}
    rows = documents.collect()
    assert len(found) == len(rows)
    for r in rows:
        ids = library.encode_ordinary(r.text or "")
        x = found[r.doc_id]
        assert (x.n_tokens, x.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert x.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_byte_pairs_edge(spark, edge, library):
    out = bytepairs.encode(edge)
    assert out.columns == ["doc_id", "rank", "runs", "score", "ids", "offsets"]
    assert sorted((r.doc_id or 0, r.ids) for r in out.collect()) == sorted((d or 0, library.encode_ordinary(t or "")) for d, t in TEXTS)
    back = bytepairs.decode(out)
    assert sorted((r.doc_id or 0, bytes(r.decoded)) for r in back.collect()) == sorted((d or 0, (t or "").encode()) for d, t in TEXTS)
    assert bytepairs.decode(bytepairs.encode(edge.where("1 = 0"))).count() == 0
    odd = spark.createDataFrame([(None, None), ([], []), ([40], [0])], "ids array<int>, offsets array<int>")
    assert sorted((b"none" if r.decoded is None else bytes(r.decoded)) for r in bytepairs.decode(odd).collect()) == sorted([b"none", b"", library.decode_bytes([40])])


def test_byte_pairs_refuse_damage():
    m = bytepairs.merger(bytepairs.default_path())
    with pytest.raises(ValueError, match="vocabulary"):
        m.decode(np.array([10**6]), np.array([0]), 1)
    with pytest.raises(ValueError, match="offsets"):
        m.decode(np.array([40, 40]), np.array([0, 2]), 3)


def drawn(rows, target, percent, least, longest, buckets):
    """The draw by plain loops: {place of the row: (features, weight, score, rank)}."""

    def words(t):
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t)

    def features(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    s, t = (collections.Counter(b for x in side for b in features(x)) for side in ([x for _, x in rows], target))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets))))
    out, able = {}, []
    for k, (d, x) in enumerate(rows):
        f = features(x)
        weight = sum(map(gain, f))
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[k] = [len(f), weight, score, None]
        if len(words(x)) >= least:
            able.append((-score, -1 if d is None else d, k))
    for rank, (_, _, k) in enumerate(sorted(able)[: percent * len(able) // 100], 1):
        out[k][3] = rank
    return out


def key(row):
    return tuple((x is None, x or 0) for x in row)


def test_word_tries_on_documents(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    target = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    found = queries.op12_word_tries(spark, DATA).collect()
    plain = drawn(rows, target, 10, 20, 1, 10_000)
    assert {r.doc_id: [r.n_features, r.weight, r.score, r["rank"]] for r in found} == {rows[k][0]: v for k, v in plain.items()}
    assert len(found) == len(rows)


@pytest.mark.parametrize("longest", [2, 3])
def test_longer_features(spark, edge, longest):
    target = spark.createDataFrame([("p0 p1 P2 p3 w7",), (None,)], "text string")
    found = wordtries.resample(edge, target, percent=40, least_words=3, longest=longest, buckets=97)
    plain = drawn(TEXTS, ["p0 p1 P2 p3 w7", None], 40, 3, longest, 97)
    got = sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in found.collect()), key=key)
    assert got == sorted(((TEXTS[k][0], *v) for k, v in plain.items()), key=key)


def test_word_tries_edge(spark, edge, monkeypatch):
    target = spark.createDataFrame([], "text string")
    assert wordtries.resample(edge.where("1 = 0"), target).count() == 0
    whole = sorted(map(key, wordtries.resample(edge, target, percent=50, least_words=1).collect()))
    monkeypatch.setattr(wordtries, "MOST_NODES", 0)  # tries begun anew after every slice
    assert sorted(map(key, wordtries.resample(edge, target, percent=50, least_words=1).collect())) == whole
    taken = wordtries.sample(edge, target, percent=50, least_words=1)
    assert taken.columns == edge.columns
    assert {r.doc_id for r in taken.collect()} == {r[0][1] or None for r in whole if not r[5][0]}


def brute(w, least=6, exponent=4):
    """All runs by comparing every pair of words of every period."""
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i < len(w) - q:
            s = i
            while i < len(w) - q and w[i] == w[i + q]:
                i += 1
            if i > s and i + q - s >= max(least, exponent * q):
                found.setdefault((s, i + q), q)
            i += i == s
    return sorted((s, e - s, q) for (s, e), q in found.items())


@pytest.mark.parametrize(("least", "exponent"), [(6, 4), (2, 2), (5, 3), (9, 5)])
def test_runs_against_every_period(least, exponent):
    texts = []
    for _ in range(400):
        letters = rng.choice([1, 2, 3, 8])
        w = [b"%d" % rng.randrange(letters) for _ in range(rng.randrange(50))]
        own = [b"%d" % rng.randrange(letters) for _ in range(rng.randrange(1, 12))]
        at = rng.randrange(len(w) + 1)
        w[at:at] = (own * 9)[: rng.randrange(9 * len(own))]
        texts.append(w)
    plain = [brute(w, least, exponent) for w in texts]
    assert sum(map(len, plain)) > 100
    assert repetitions.runs_in(texts, least, exponent) == plain


def test_runs_survive_a_clash_of_hashes(monkeypatch):
    texts = [[b"%d" % rng.randrange(3) for _ in range(40)] + [b"a", b"b"] * 6 for _ in range(30)]
    monkeypatch.setattr(repetitions, "_prefixes", lambda v: (np.zeros(len(v) + 1, np.uint64), np.ones(len(v) + 1, np.uint64)))
    assert repetitions.runs_in(texts) == [brute(w) for w in texts]


def expected(d, text):
    """The planted text's row, by plain loops."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(d).encode()) if d is not None else 1
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    drop = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (d, len(runs), *best, milli, digest("".join("%d,%d,%d\n" % r for r in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in drop)))


def test_runs_on_documents(spark, documents):
    found = {r.doc_id: tuple(r) for r in queries.op13_periodic_runs(spark, DATA).collect()}
    assert found == {r.doc_id: expected(r.doc_id, r.text) for r in documents.collect()}
    assert sum(r[1] > 0 for r in found.values()) > 5


def test_runs_edge(edge):
    out = repetitions.collapse_runs(edge)
    assert out.columns == ["doc_id", "ids", "rank", "Offsets", "score", "text", "runs"]
    rows = sorted(out.collect(), key=lambda r: r.doc_id or 0)
    runs = [[tuple(x) for x in r.runs] for r in rows]
    texts = [t for _, t in sorted(TEXTS, key=lambda x: x[0] or 0)]
    short = [k for k, t in enumerate(texts) if t is None or len(t) < 1000]
    assert [runs[k] for k in short] == [brute((texts[k] or "").split()) for k in short]
    by = {r.doc_id: r for r in rows}
    assert by[5].text == f"head {PERIOD} tail" and by[6].text == "x" and [tuple(x) for x in by[6].runs] == [(0, 40_000, 1)]
    assert by[None].text == "no id" and by[1].text == by[2].text == by[3].text == ""
    assert repetitions.collapse_runs(edge.where("1 = 0")).count() == 0
    assert queries.planted(edge).columns == ["doc_id", "text"]


def test_word_tries_sql_twin(spark):
    import duckdb

    duck = duckdb.connect()
    for table in ("documents", "benchmark"):
        duck.execute(f"create view {table} as select * from read_parquet('{DATA}/{table}.parquet')")
    twin = duck.sql(queries.ORACLE_SQL["op12_word_tries"])
    found = queries.op12_word_tries(spark, DATA)
    assert twin.columns == found.columns
    assert sorted(map(tuple, twin.fetchall())) == sorted(map(tuple, found.collect()))
