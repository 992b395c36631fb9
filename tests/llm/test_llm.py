"""The training-data operators against brute force, round trips and held-out rows, and their edge cases."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandweave.llm import bagminhash, bpe, chaining, components, hostarray, packing, pieces, quality, shards, toxicity, transport, vectors
from strandweave.llm.textkit import strings

DATA = "/root/testdata/sf0.001"
rng = random.Random(5)
VOCAB = ["w%03d" % k for k in range(900)]
LONG = " ".join(rng.choices(VOCAB, k=4000))
BASE = rng.choices(VOCAB, k=200)


def changed(words, every):
    return [w if k % every else "zz" for k, w in enumerate(words, 1)]


EDGE = [
    (1, None),
    (2, ""),
    (3, "   \n"),
    (4, "one two"),
    (5, " ".join(BASE)),
    (6, " ".join(BASE)),
    (6, " ".join(BASE)),
    (7, " ".join(changed(BASE, 100))),
    (8, LONG),
    (None, "no id here"),
    (9, "tie  two blanks é 日本 😀\ttab"),
    (10, LONG + " end"),
]


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(d, t, "en", "src", None if t is None else len(t), "x") for d, t in EDGE]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score string").repartition(3)


@pytest.fixture(scope="module")
def empty(edge):
    return edge.where("1 = 0")


def bag(text):
    w = (text or "").lower().split()
    return collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else collections.Counter()


def similarity(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (3, 4), (5, 5), (7, 8)], "a bigint, b bigint")
    assert {tuple(r) for r in components.components(e).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (7, 7), (8, 7), (9, 7)}
    chain = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in components.components(chain).collect()} == {0}


def test_near_duplicates_edge(edge, empty):
    found = {(r.doc_id, r.class_id, r.kept) for r in bagminhash.near_duplicates(edge).collect()}
    assert found == {(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 5, True), (6, 5, False), (7, 5, False), (8, 8, True), (10, 8, False), (9, 9, True), (None, None, True)}
    assert bagminhash.near_duplicates(empty).count() == 0
    kept = bagminhash.keep_one(edge)
    assert kept.columns == edge.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 8, 9]


def test_near_duplicates_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    of = {r.doc_id: r.class_id for r in bagminhash.near_duplicates(docs).collect()}
    bags = {r.doc_id: bag(r.text) for r in rows}
    ids = sorted(bags)
    parent = {d: d for d in ids}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if bags[a] and bags[b] and similarity(bags[a], bags[b]) >= 0.8:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    assert of == {d: root(d) for d in ids}


def test_one_id_with_several_texts(spark):
    a, b = (rng.choices(VOCAB, k=120) for _ in range(2))
    more = lambda t: " ".join([*t, "plus"])
    rows = [(1, " ".join(a)), (5, " ".join(b)), (5, more(a)), (7, more(b)), (9, "c d"), (9, "c  d"), (9, "c d"), (9, "e f"), (9, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("mark", F.lit("own")).withColumn("key", F.lit(3))
    found = sorted((r.doc_id, r.class_id, r.kept) for r in bagminhash.near_duplicates(df).collect() if r.doc_id < 9)
    assert found == [(1, 1, True), (5, 1, False), (5, 5, True), (7, 5, False)]
    left = bagminhash.keep_one(df).collect()
    assert sorted((r.doc_id, " ".join(r.text.split())) for r in left) == [(1, " ".join(a)), (5, " ".join(b)), (9, ""), (9, "c d"), (9, "e f")]
    assert {(r.mark, r.key) for r in left} == {("own", 3)}


def test_brute_force_of_repeated_ids(spark):
    r = random.Random(3)
    texts = []
    for _ in range(12):
        base = r.choices(VOCAB, k=80)
        texts += [" ".join(base), " ".join(base[:-1]), " ".join(changed(base, 70))]
    rows = [(r.randrange(14), t) for t in texts]
    found = collections.Counter((x.doc_id, x.class_id) for x in bagminhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    bags, label = [bag(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if similarity(bags[i], bags[j]) >= 0.8:
                label = [label[j] if x == label[i] else x for x in label]
    low = {x: min(d for (d, _), y in zip(rows, label, strict=True) if x == y) for x in label}
    assert found == collections.Counter((d, low[x]) for (d, _), x in zip(rows, label, strict=True))


def test_signatures_estimate_weighted_similarity():
    texts = [" ".join(["a b c d e"] * 7 + BASE), " ".join(["a b c d e"] * 3 + changed(BASE, 40))]
    which, h, n, _ = bagminhash.bags(strings(pa.array(texts)))
    s = np.concatenate([bagminhash.signatures(which, h ^ np.uint64(k), n, 2) for k in range(30)], axis=1)
    assert abs((s[0] == s[1]).mean() - similarity(*map(bag, texts))) < 0.05


def test_signature_does_not_depend_on_the_batch():
    alone = bagminhash.bags(strings(pa.array([" ".join(BASE)])))
    among = bagminhash.bags(strings(pa.array([LONG] * 40 + [" ".join(BASE)])))
    a, b = bagminhash.signatures(*alone[:3], 1)[0], bagminhash.signatures(*among[:3], 41)[40]
    assert (a == b).all() and alone[3][0] == among[3][40]


PAGE = """<html><head><title>T</title><script>var x = "<p>no</p>";</script></head><body><header>Site</header><nav><a href=1>Home</a></nav>
<article><h1>Head &amp; line</h1><p>First   para<br>goes on<p>Second <b>bold</b>.<div class="share-buttons">Share</div><aside>side</aside></article>
<section id="comments"><p>A reader says</p></section><footer>Foot</footer></body></html>"""


def test_page_text(spark):
    rows = [(1, "http://a.example/x", PAGE), (2, None, None), (3, "http://a.example/y", ""), (1, "http://a.example/x", PAGE), (4, "nonsense", "<p>plain &lt; text")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = sorted((r.page_id, r.text, r.n_chars) for r in hostarray.main_text(df).collect())
    text = "Head & line\nFirst para goes on\nSecond bold."
    assert found == [(1, text, len(text)), (1, text, len(text)), (2, "", 0), (3, "", 0), (4, "plain < text", 12)]
    assert hostarray.main_text(df.where("1 = 0")).count() == 0


def test_boilerplate_without_article(spark):
    """Whole pages of nameless blocks against brute force over all pairs of pages; it needs the repeats on every page."""
    r = random.Random(8)
    junk = [" ".join(r.choices(VOCAB, k=14)) for _ in range(6)]
    story = [" ".join(r.choices(VOCAB, k=40)) for _ in range(40)]
    rows = []
    for k in range(40):
        parts = [junk[k % 3], story[k], junk[3 + k % 3] + f" tail{k}"]
        rows.append((k, f"http://{'a' if k < 34 else 'b'}.example/{k}", "<body>" + "".join(f"<div><p>{p}</p></div>" for p in parts)))
    rows.append((90, "http://a.example/x", rows[0][2]))
    rows.append((91, "http://a.example/y", f"<body><div>{story[1]}</div><div>{junk[1]}</div>"))  # a copy: structure decides

    def streams(html):
        return [b.text.split() for b in hostarray.blocks(html)]

    grams = collections.defaultdict(set)
    for k, url, html in rows:
        t = [w for b in streams(html) for w in b]
        for at in range(len(t) - 7):
            grams[url[:9], tuple(t[at : at + 8])].add(html)
    expected = {}
    for k, url, html in rows:
        t = [w for b in streams(html) for w in b]
        hit = [False] * len(t)
        for at in range(len(t) - 7):
            if len(grams[url[:9], tuple(t[at : at + 8])]) > 1:
                hit[at : at + 8] = [True] * 8
        kept, at = [], 0
        for b in streams(html):
            if sum(hit) > 0.9 * len(t) or sum(hit[at : at + len(b)]) <= len(b) / 2:
                kept.append(" ".join(b))
            at += len(b)
        expected[k] = "\n".join(kept)
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for parts in (1, 7):
        assert {x.page_id: x.text for x in hostarray.main_text(df.repartition(parts)).collect()} == expected
    assert expected[5] == story[5] and expected[90] == story[0] and expected[91] == f"{story[1]}\n{junk[1]}"


def test_boilerplate_inside_articles(spark):
    """Articles against brute force over all pages: what most articles of a host hold goes, rarer repeats stay."""
    r = random.Random(12)

    def some(n):
        return " ".join(r.choices(VOCAB, k=n))

    notice, stock, dated = some(20), some(20), some(16)
    rows = []
    for host, n in (("a", 10), ("b", 90), ("c", 2), ("d", 6)):
        for k in range(n):
            parts = [some(40), notice if k % 9 else some(25), stock if k % 2 else some(9), f"{dated} no {k} of {r.random()}", some(30)]
            rows.append((len(rows), f"http://{host}.example/{k}", "<body><nav>Home</nav><article>" + "".join(f"<p>{p}</p>" for p in parts) + "</article>"))
    rows += [(len(rows) + k, "http://d.example/copy", rows[-1][2]) for k in range(3)]  # equal pages are one, but rows of their own
    rows.append((len(rows), "http://a.example/x", f"<article><p>{notice}</p></article>"))  # nothing else: a copy
    rows.append((len(rows), "http://a.example/y", f"<div>{notice}</div><div>{some(30)}</div>"))

    grams, hosts = collections.defaultdict(lambda: ([], set())), collections.defaultdict(lambda: ([], set()))
    streams = {}
    for k, url, html in rows:
        streams[k] = [b.text.split() for b in hostarray.blocks(html) if b.article]
        t = [w for b in streams[k] for w in b]
        for held in [hosts[url[:9]]] * bool(t) + [grams[url[:9], g] for g in {tuple(t[at : at + 8]) for at in range(len(t) - 7)}]:
            held[0].append(k)
            held[1].add(html)
    expected = {}
    for k, url, _ in rows[:-1]:
        t = [w for b in streams[k] for w in b]
        hit = [False] * len(t)
        for at in range(len(t) - 7):
            (n, pages), (of, of_pages) = grams[url[:9], tuple(t[at : at + 8])], hosts[url[:9]]
            if len(pages) >= 3 and 2 * len(n) > len(of) and 2 * len(pages) > len(of_pages):
                hit[at : at + 8] = [True] * 8
        kept, at = [], 0
        for b in streams[k]:
            if sum(hit) > 0.9 * len(t) or sum(hit[at : at + len(b)]) <= len(b) / 2:
                kept.append(" ".join(b))
            at += len(b)
        expected[k] = "\n".join(kept)
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for parts in (1, 30):
        found = {x.page_id: x.text for x in hostarray.main_text(df.repartition(parts)).collect()}
        found.pop(len(rows) - 1)
        assert found == expected
    assert notice not in expected[1] and dated not in expected[1] and stock in expected[1] and expected[101].count(dated) == 1 and expected[len(rows) - 2] == notice


def test_repeated_menu_of_few_words(spark):
    pages = [(k, "http://a.example/", f"<body><div><a>Home</a> <a>News</a> now</div><div>{' '.join(rng.choices(VOCAB, k=30))}</div>") for k in range(4)]
    found = hostarray.main_text(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()
    assert all("News" not in x.text and len(x.text.split()) == 30 for x in found)


def test_pieces_find_the_best_segmentation():
    v = pieces.vocabulary(pieces.default_path())
    score = {p: s for p, s, k in zip(v.pieces, v.scores, v.kinds, strict=True) if k == 1}

    def best(word):
        at = [0.0] + [-np.inf] * len(word)
        for e in range(1, len(word) + 1):
            for s in range(max(0, e - v.longest), e):
                own = score.get(word[s:e], v.unknown_score if e - s == 1 else -np.inf)
                at[e] = max(at[e], at[s] + own)
        return at[-1]

    texts = ["Hello  world é 😀\nnew\tx", "  a ", "unbelievable ththing of retitioning", "日本語 ́x", "x" * 300]
    ids, sizes = v.encode(texts)
    for text, own in zip(texts, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
        assert v.decode(own) == text
        if all(v.kinds[k] == 1 for k in own):
            assert sum(v.scores[own]) == pytest.approx(sum(best(w) for w in v.split(text)))


def test_pieces_edge(edge, empty):
    for r in pieces.round_trip(edge).collect():
        assert r.same and r.n_ids == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    back = pieces.decode(pieces.encode(edge.select("doc_id", "text")))
    assert sorted((r.doc_id or 0, r.text) for r in back.collect()) == sorted((d or 0, t or "") for d, t in EDGE)
    assert pieces.round_trip(empty).count() == 0


@pytest.mark.parametrize("size", [1, 63, 64, 170, 171, 172, 184, 16384, 16385, 200_000])
def test_transport_round_trip(size):
    payload = bytes(k * 31 % 251 for k in range(size))
    media = transport.mux(payload)
    s = transport.demux(media)
    assert s.payload == payload and s.counter_errors == 0 and s.programs == {1: transport.PID_PMT} and s.streams == {transport.PID_ES: 6}
    assert s.stamps == [k * 3600 for k in range(s.units)] and s.random_access == list(range(0, s.units, 8))
    assert s.damaged == []


def test_transport_notices_damage():
    payload = bytes(k % 251 for k in range(40_000))
    media = transport.mux(payload)
    packets = [media[k : k + 188] for k in range(0, len(media), 188)]
    for k in range(2, len(packets)):
        s = transport.demux(b"".join(packets[:k] + packets[k + 1 :]))
        assert s.payload != payload and (s.counter_errors or s.damaged), k
        assert s.counter_errors or k == len(packets) - 1
        again = transport.demux(b"".join([*packets[: k + 1], packets[k], *packets[k + 1 :]]))
        assert again.payload == payload and not again.counter_errors and not again.damaged
    broken = bytearray(media)
    broken[12] ^= 1
    with pytest.raises(ValueError):
        transport.demux(bytes(broken))


def test_media_columns_and_long_text(spark):
    text = "é long text " * 450_000
    rows = [(2**60 + 1, text, 1, "x", 2.0), (None, None, 2, "y", 3.0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, units int, feature string, other double").withColumn("payload_bytes", F.lit(1))
    found = {r.doc_id: r for r in transport.read_media(transport.encode_media(df)).collect()}
    for d, t, _, _, other in rows:
        payload, n = transport.padded(t)
        r = found[d]
        assert (r.n_bytes, r.payload_bytes, r.other, r.counter_errors) == (n, len(payload), other, 0)
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        media = transport.mux(payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())


def test_media_edge(edge, empty):
    for r in transport.read_media(transport.encode_media(edge.select("doc_id", "text"))).collect():
        texts = [t for d, t in EDGE if d == r.doc_id]
        assert any(r.payload_sha256 == hashlib.sha256(transport.padded(t)[0]).hexdigest() and r.n_bytes == transport.padded(t)[1] for t in texts)
        assert r.payload_bytes % 64 == 0 and r.payload_bytes > 0
    assert transport.read_media(transport.encode_media(empty.select("doc_id", "text"))).count() == 0


def test_bpe_is_the_librarys():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    t.encode_special_tokens = True
    texts = ["", " ", "a  b   c", " lead", "trail ", "it's  <|endoftext|> x\n y\t  z", "Thnd*** iner*** 12,5 éß 日本 😀", LONG[:500], "\n\n a\r\n"]
    ids, sizes = bpe.encoder(bpe.default_path()).encode(texts)
    for text, own in zip(texts, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
        assert own.tolist() == t.encode(text, add_special_tokens=False).ids


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 7, 64, 1000):
        assert sorted(shards.feistel(np.arange(n), n).tolist()) == list(range(n))
    assert (shards.feistel(np.arange(1000), 1000) != shards.feistel(np.arange(1000), 1000, 1)).any()


def test_shards_edge(edge, empty):
    made = shards.materialise(edge, length=16, slots=8).cache()
    rows = sorted(made.collect(), key=lambda r: r.shard_id)
    total = sum(r.n_slots for r in rows)
    assert [r.first_slot for r in rows] == [8 * k for k in range(len(rows))] and all(len(r.payload) == r.n_slots * r.stride and zlib.crc32(r.payload) == r.crc32 for r in rows)
    got = collections.defaultdict(list)
    for r in shards.read_slots(made, 0, total, slots=8).collect():
        got[r.doc_id].append((r.start, r.ids))
    enc = bpe.encoder(bpe.default_path())
    for d, t in EDGE:
        ids = enc.encode([t or ""])[0].tolist() + [0]
        assert sorted(got[d])[-1][0] == (len(ids) - 1) // 16 * 16
        if [x for x, _ in EDGE].count(d) == 1:
            assert [i for _, own in sorted(got[d]) for i in own] == ids
    assert shards.read_slots(made, 3, 9, slots=8).count() == 9
    assert shards.materialise(empty).count() == 0


def test_fillings_use_every_rest_once():
    counts = {n: 1 + n % 5 for n in range(1, 1024, 7)}
    used = collections.Counter()
    slack = windows = 0
    for filling, times in packing.fillings(counts):
        size = sum(n * k for n, k in filling)
        assert size <= 1024
        slack, windows = slack + (1024 - size) * times, windows + times
        for n, k in filling:
            used[n] += k * times
    assert dict(used) == counts and slack < 0.01 * 1024 * windows


def test_fillings_have_the_least_slack():
    """The first filling against enumeration of all multisets with the largest rest, which every filling begins with."""
    for seed in range(60):
        r = random.Random(seed)
        counts = dict(collections.Counter(r.randrange(1, 40) for _ in range(9)))
        items = sorted(n for n, c in counts.items() for _ in range(c))
        top = items.pop()
        best = max(x for m in range(1 << len(items)) if (x := top + sum(n for k, n in enumerate(items) if m >> k & 1)) <= 40)
        filling, _ = next(iter(packing.fillings(counts, 40)))
        assert sum(n * k for n, k in filling) == best


def test_packing_edge(edge, empty):
    rows = packing.pack(edge, capacity=64).collect()
    enc = bpe.encoder(bpe.default_path())
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    for d, t in EDGE:
        ids = enc.encode([t or ""])[0].tolist() + [0]
        own = sorted((r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == d)
        copies = [x for x, _ in EDGE].count(d)
        assert sorted(set(own)) == [(s, len(ids[s : s + 64]), zlib.crc32(np.array(ids[s : s + 64], "<u4").tobytes())) for s in range(0, len(ids), 64)]
        assert len(own) == copies * len(set(own))
    assert packing.pack(empty).count() == 0


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.mark.parametrize(("operator", "label"), [(toxicity.toxicity, "toxic"), (quality.quality, "quality")])
def test_classifiers_on_held_out_rows(documents, labels, operator, label):
    rows = operator(documents, labels).join(labels.withColumnRenamed(label, "truth"), "doc_id").where("held_out").toPandas()
    one, zero = rows[rows.truth == 1].score, rows[rows.truth == 0].score
    auc = np.mean([(a > zero).mean() + (a == zero).mean() / 2 for a in one])
    assert auc > 0.85 and rows.score.between(0, 1).all()


def test_toxicity_brute_force(documents, labels):
    model = toxicity.train(documents, labels)
    texts = [r.text.lower() for r in documents.orderBy("doc_id").limit(12).collect()] + ["", "you idiot"]
    found = model.scores(strings(pa.array(texts)), model.table())
    assert found == pytest.approx(toxicity.brute_scores(texts, model), rel=1e-9)


@pytest.mark.parametrize("operator", [toxicity.toxicity, quality.quality])
def test_classifiers_edge(edge, empty, labels, operator):
    assert operator(edge, labels).count() == len(EDGE)
    assert operator(empty, labels).count() == 0
    assert {r.predicted for r in operator(edge, labels.where("1 = 0")).collect()} <= {0, 1}
    for keep in (toxicity.drop_toxic, quality.keep_good):
        assert keep(edge, labels).columns == edge.columns and keep(edge, labels).count() <= len(EDGE)


def test_vectors_brute_force(spark):
    g = np.random.default_rng(1)
    x = [v for c in g.standard_normal((40, 16)) for v in [c, c, c + 0.05 * g.standard_normal(16), c + 0.08 * g.standard_normal(16)]]
    rows = [(k, v.tolist(), k % 4 // 2 if k % 9 else None) for k, v in enumerate(x)]
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [float("nan")] * 16, 1), (904, [1.0, None] * 8, 1), (905, [1.0, 2.0], 1), (5, x[5].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df).collect()}
    u = {k: (np.array(v) / np.linalg.norm(v), lab) for k, v, lab in rows[:160] if lab is not None}
    links = {k: {j for j in u if j != k and u[j][1] == u[k][1] and u[j][0] @ u[k][0] >= 0.98} for k in u}
    for k in found:
        seen, todo = {k}, [k]
        while todo:
            new = links.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        assert found[k] == (len(links.get(k, ())), min(seen), min(seen) == k)
    assert vectors.near_vectors(df.where("1 = 0")).count() == 0


def test_passages(spark):
    shared = rng.choices(VOCAB, k=90)
    fuzzy = changed(shared, 25)
    fresh = lambda n: [f"{rng.choice(VOCAB)}{rng.randrange(10**6)}" for _ in range(n)]
    a, b, c, d = fresh(70), fresh(60), fresh(80), fresh(200)
    rows = [(1, a + shared), (2, b + shared + b[::-1]), (3, fuzzy + c), (4, d), (5, d[:45] + fresh(40))]
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in rows], "doc_id bigint, text string")
    found = {r.doc_id: r for r in chaining.without_passages(df).collect()}
    assert found[1].spans is None and found[4].spans is None and found[5].spans is None
    assert found[2].text.split() == b + b[::-1] and list(found[2].source_ids) == [1]
    assert found[3].text.split()[-80:] == c and len(found[3].text.split()) <= 80 + 3


def test_every_passage_of_a_chain(spark):
    r = random.Random(11)
    fresh = lambda n: [f"{r.choice(VOCAB)}{r.randrange(10**6)}" for _ in range(n)]
    rows, wanted, k = [], {}, 0
    for gap in (10, 20, 40, 80, 150, 300, 600, 1000):
        for sizes in ((60, 70), (70, 60, 90)):
            shared = [fresh(n) for n in sizes]
            own = [[fresh(30), *[fresh(gap + d) for _ in sizes[1:]], fresh(30)] for d in (0, 7)]
            for d in (0, 1):
                text = own[d][0] + [w for p, o in zip(shared, own[d][1:], strict=True) for w in p + o]
                rows.append((k + d, " ".join(text)))
            wanted[k + 1] = [w for o in own[1] for w in o], gap
            k += 2
    found = {r.doc_id: r for r in chaining.without_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for d, (rest, gap) in wanted.items():
        assert found[d - 1].spans is None
        left = found[d].text.split()
        if gap > 10:  # a gap of 17 words between two passages at SIMILARITY may go with them
            assert left == rest, (d, gap)
        else:
            assert left[:30] == rest[:30] and left[-30:] == rest[-30:] and len(left) <= len(rest)


def test_passages_behind_stock_sentences(spark):
    r = random.Random(12)
    fresh = lambda n: [f"{r.choice(VOCAB)}{r.randrange(10**6)}" for _ in range(n)]
    stock = [fresh(25) for _ in range(60)]
    rows = [(k, fresh(40) + stock[k] + fresh(60)) for k in range(60)]
    own = {}
    for k in range(30):
        p = fresh(3) + stock[2 * k] + fresh(4) + stock[2 * k + 1] + fresh(2)
        own[200 + k] = fresh(30), fresh(40)
        rows += [(100 + k, fresh(50) + p + fresh(50)), (200 + k, own[200 + k][0] + p + own[200 + k][1])]
    found = {x.doc_id: x for x in chaining.without_passages(spark.createDataFrame([(k, " ".join(t)) for k, t in rows], "doc_id bigint, text string")).collect()}
    assert all(found[k].spans is None for k in range(60))
    missed = [k for k, (a, b) in own.items() if found[k].text.split() != a + b]
    assert not missed


def test_passages_that_are_nearly_all_stock(spark):
    r = random.Random(14)
    fresh = lambda n: [f"{r.choice(VOCAB)}{r.randrange(10**6)}" for _ in range(n)]
    shapes = [(1, 49, 1), (4, 46, 4), (3, 44, 8), (1, 48, 1), (0, 49, 1), (7, 36, 7)]
    rows, own = [], {}
    for k in range(20 * len(shapes)):
        a, n, b = shapes[k % len(shapes)]
        stock = fresh(n)
        if k % 2:  # two stock sentences that a third document holds side by side
            half = n // 2
            rows += [(1000 + k, fresh(40) + stock[:half] + fresh(40)), (2000 + k, fresh(40) + stock[half:] + fresh(40))]
        p = fresh(a) + stock + fresh(b)
        own[9000 + k] = fresh(40), fresh(60)
        rows += [(3000 + k, fresh(40) + stock + fresh(60)), (6000 + k, fresh(50) + p + fresh(50)), (9000 + k, own[9000 + k][0] + p + own[9000 + k][1])]
    found = {x.doc_id: x for x in chaining.without_passages(spark.createDataFrame([(k, " ".join(t)) for k, t in rows], "doc_id bigint, text string")).collect()}
    assert all(found[k].spans is None for k in found if k < 9000)
    assert not [k for k, (a, b) in own.items() if found[k].text.split() != a + b]


def test_changed_passages(spark):
    r = random.Random(13)
    fresh = lambda n: [f"{r.choice(VOCAB)}{r.randrange(10**6)}" for _ in range(n)]
    rows, passage = [], {}
    for k in range(0, 80, 2):
        p = fresh(200 if k < 20 else 80)
        q = list(p)
        if k < 20:  # a word put in, in the middle of 80 words with one change in five
            q = q[:100] + fresh(1) + q[100:]
            at = range(65, 136, 5)
        else:
            at = r.sample(range(1, 79), 8)
        for i in at:
            q[i] = fresh(1)[0]
        passage[k + 1] = q
        rows += [(k, fresh(70) + p + fresh(90)), (k + 1, fresh(80) + q + fresh(60))]
    found = {x.doc_id: x for x in chaining.without_passages(spark.createDataFrame([(k, " ".join(t)) for k, t in rows], "doc_id bigint, text string")).collect()}
    left = {k: len(set(q) & set(found[k].text.split())) / len(q) for k, q in passage.items()}
    assert all(left[k] < 0.1 for k in left if k < 20)
    assert sum(v < 0.5 for k, v in left.items() if k > 20) >= 27


def test_longest_common_subsequence(monkeypatch):
    for seed in range(100):
        r = random.Random(seed)
        a, b = ([str(r.randrange(6)) for _ in range(r.randrange(1, 40))] for _ in range(2))
        size = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, p in enumerate(a):
            for j, q in enumerate(b):
                size[i + 1, j + 1] = size[i, j] + 1 if p == q else max(size[i, j + 1], size[i + 1, j])
        for cells in (1 << 28, 30):
            monkeypatch.setattr(chaining, "CELLS", cells)
            pairs = chaining._longest(a, b)
            assert len(pairs) == size[-1, -1] and all(a[i] == b[j] for i, j in pairs)
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


def test_alignment_with_odd_white_space():
    """Words end at bytes up to 0x20 only; what str.split takes for white space besides is part of a word."""
    body = [f"w{k}" for k in range(60)]
    for odd in ("\x00", "\x1b", "\x1c", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u202f", "\u205f", "\u3000", "\u200b", " \n"):
        inside = odd in "\x00\x1b\x1c \n"
        mine, other = f"x{odd}y " + odd.join(body[:2]) + " " + " ".join(body[2:]), "z " + odd.join(body[:2]) + "\t" + " ".join(body[2:])
        at, rep_at = mine.index("w2 "), other.index("w2 ")
        (start, stop, size), = chaining.align(mine[:at], mine[at:], other[:rep_at], other[rep_at:], [0, 58, 0, 58])
        assert mine[at + start : at + stop] == mine[mine.index("w0") :] and size == (60 if inside else 59), repr(odd)
    far = " ".join(body[:20] + [f"v{k}" for k in range(40)])
    assert chaining.align("", " ".join(body), "", far, [0, 20, 0, 20]) == []


def test_chains_against_brute_force():
    for seed in range(20):
        r = random.Random(seed)
        word = np.array(sorted(r.sample(range(0, 400, 9), 12)))
        other = np.array([int(w) + r.choice([0, 0, 0, 3, 40, -200]) for w in word])
        for chain in chaining.chains(word, other):
            at = [(word[s], other[s], word[e], other[e]) for s, e in chain]
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(at, at[1:], strict=False))


def test_passages_edge(edge, empty):
    found = chaining.without_passages(edge.drop("score"))
    by = collections.defaultdict(list)
    for r in found.collect():
        by[r.doc_id].append(r)
    assert len(by[6]) == 2 and all(r.text == "" and r.n_chars == 0 for r in by[6])
    assert by[10][0].text.strip() in ("", "end") and by[8][0].text == LONG and by[5][0].text == EDGE[4][1]
    assert by[1][0].text is None and by[None][0].text == "no id here" and by[9][0].spans is None
    assert chaining.without_passages(empty).count() == 0


def test_pipeline_keeps_columns_and_packs_the_rest(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    at = docs
    for _, step in corpus_pipeline.STAGES[:-1]:
        at = step(spark, at, DATA)
        assert at.columns == docs.columns
    left = {r.doc_id for r in at.select("doc_id").collect()}
    packed = {r.doc_id for r in corpus_pipeline.run(spark, DATA).select("doc_id").collect()}
    assert packed == left and 0 < len(left) <= docs.count()
