"""Each operator against brute force, a library, an exact round trip or held-out labels, and its edge cases."""

import hashlib
import os
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("passagemill.llm")

import public_tokenizers  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from passagemill.llm import bpe, bytewords, chat_format, decontaminate, gif, html_extract, minhash_dedup, quality, queries, token_cache, toxicity, url_reputation  # noqa: E402
from passagemill.llm.common import Workspace, salted_join, scratch, ship, text_crc  # noqa: E402

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
DOC = "doc_id bigint, text string"


@pytest.fixture(autouse=True, scope="module")
def shipped(spark):
    ship(spark)


# --- words and MinHash -----------------------------------------------------------------------------


def brute_set(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(docs, k):
    ids = [i for i, _ in docs]
    sets, parent = [brute_set(t, k) for _, t in docs], list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if ids[i] == ids[j] and ids[i] is not None or ids[i] is not None and ids[j] is not None and both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i in range(len(docs)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return sorted((ids[i] if ids[i] is not None else -1, len(sets[i]), least[find(i)] if ids[i] is not None else -1) for i in range(len(docs)))


def family(rng, n, words, edits):
    base = [f"w{rng.randrange(900)}" for _ in range(words)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        yield " ".join(w)


def test_shingle_sets():
    texts = ["", None, "a", "a b c", "A b\tC d", "a b c d a b c d", "é è  x\ny z", "x" * 5000 + " y z w v"]
    for k in (1, 4, 5):
        assert [len(u) for u in bytewords.shingle_sets(pa.array(texts), k)] == [len(brute_set(t, k)) for t in texts]
    a, b = bytewords.shingle_sets(pa.array(["Q A b c d", "a B C d"]), 4)
    assert len(np.intersect1d(a, b)) == 1


@pytest.mark.parametrize("cfg", [minhash_dedup.Config(shingle=4), minhash_dedup.Config(shingle=4, bands=40, rows=3, small_bucket=2, block=7)])
def test_near_duplicates(spark, cfg):
    """The second settings send nearly all through the comparison of crowded buckets, in blocks."""
    rng = random.Random(4)
    texts = ["", None, " \n", "one", "one", "one two three", "a b c d", "a b c d e", "A B c D"]
    for n, words, edits in ((12, 60, 4), (30, 80, 14), (10, 12, 2), (8, 300, 30)):
        texts += family(rng, n, words, edits)
    shared = " ".join(f"s{i}" for i in range(70))
    texts += [shared + " " + " ".join(f"u{i}_{j}" for j in range(60)) for i in range(40)]
    docs = list(enumerate(texts)) + [(3, "one"), (None, "one"), (None, None), (500, texts[12]), (500, "another text of its own")]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(docs, DOC), cfg=cfg)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    rows = got.collect()
    assert sorted((-1 if r[0] is None else r[0], r[1], -1 if r[2] is None else r[2]) for r in rows) == brute_components(docs, 4)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in rows)


def linked(seed):
    """A long chain, a star, loops, repeated and scattered links, in no order."""
    rng = random.Random(seed)
    name = rng.sample(range(-(10**12), 10**12), 400)
    links = [(name[i], name[i + 1]) for i in range(80)] + [(name[100], name[i]) for i in range(101, 200)] + [(name[7], name[7]), (name[399], name[399])]
    links += [(name[rng.randrange(200, 390)], name[rng.randrange(200, 390)]) for _ in range(90)]
    links += [(b, a) for a, b in links[:30]]
    rng.shuffle(links)
    return links


@pytest.mark.parametrize("local", [0, minhash_dedup.Config.local_edges])
@pytest.mark.parametrize("links", [[], [(5, 5)], linked(1), linked(2)], ids=["none", "loop", "one", "two"])
def test_components(spark, local, links):
    reach = {x: {x} for link in links for x in link}
    for a, b in links:
        for x in (both := reach[a] | reach[b]):
            reach[x] = both
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(group := f"components-{local}-{len(links)}-{links[:1]}", "")
    ws = Workspace(spark, "components")
    edges = ws.write(spark.createDataFrame(links, "a bigint, b bigint"), "edges")
    seen = len(jobs.getJobIdsForGroup(group))
    got = minhash_dedup.components(ws, edges, "some", **({"local": 0} if not local else {}))
    # A few links must not cost the steps of a large graph.
    assert not local or len(jobs.getJobIdsForGroup(group)) - seen <= 4
    assert sorted(map(tuple, got.collect())) == sorted((x, min(r)) for x, r in reach.items() if len(r) > 1)
    spark.sparkContext._jsc.clearJobGroup()


def test_near_duplicates_over_tables(spark):
    """The components of more links than the driver takes."""
    rng = random.Random(4)
    docs = [(i, t) for i, t in enumerate([t for _ in range(6) for t in family(rng, 5, 60, 3)] + [None, "", "one two"])]
    cfg = minhash_dedup.Config(shingle=4, local_edges=0)
    got = minhash_dedup.near_duplicates(spark.createDataFrame(docs, DOC), cfg=cfg).collect()
    want = brute_components(docs, 4)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(want)


def test_prune_bounds():
    tests = minhash_dedup.least_matches(minhash_dedup.Config())
    assert [m for m, _ in tests] == [40, 80, 120, 160, 200, 240] and all(0 < k < 0.8 * m for m, k in tests)


def test_salted_join_is_a_join(spark):
    left = spark.range(5000).select((F.col("id") % 3).alias("k").cast("bigint"), F.col("id").alias("v")).withColumn("k", F.when(F.col("v") < 4000, 0).otherwise(F.col("k")))
    right = spark.createDataFrame([(0, "a"), (1, "b")], "k bigint, w string")
    assert salted_join(left, right, "k", chunk=100).count() == left.join(right, "k").count()


# --- URL reputation --------------------------------------------------------------------------------


def test_url_parts_and_rules(spark):
    urls = [
        (1, "http://A.Example.org/en/123?x"), (2, "https://example.org"), (3, "x://b.example.org/es/#f"), (4, None), (5, "no scheme"), (6, "http://x.com/fr/a/../b"), (7, "http://com/de/1"),
        (8, "http://notexample.org/es/1"), (9, "a://b://c/d"), (10, "http://É.net/P"), (10, "http://É.net/P"), (11, ""),
    ]
    pages = spark.createDataFrame(urls, "page_id int, url string").withColumn("good", F.lit("clash"))
    none = spark.createDataFrame([], "page_id int, good int")
    got = [tuple(r)[:5] for r in url_reputation.judge(pages, none, queries.RULES).orderBy("page_id").collect()]
    assert [(g[0], g[1], g[2], g[3]) for g in got] == [
        (1, "a.example.org", "/en/123", "example.org/en/1"), (2, "example.org", "", None), (3, "b.example.org", "/es/", "example.org/es/"), (4, "", "", None), (5, "", "", None),
        (6, "x.com", "/fr/a/../b", "com/fr/"), (7, "com", "/de/1", "com/de/"), (8, "notexample.org", "/es/1", "org/"), (9, "b:", "//c/d", None), (10, "É.net", "/P", None), (10, "É.net", "/P", None), (11, "", "", None),
    ]
    assert [g[4] for g in got if g[3]] == ["block", "block", "allow", "block", "allow"]


def test_many_rules_and_repeated_pages(spark):
    rng = random.Random(6)
    hosts = ["a.b.com", "b.com", "com", "x.org", "org", "q.x.org", "n.net", ""]
    rules = list({(h, p): url_reputation.Rule(h, p, rng.random() < 0.5) for h in hosts[:6] for p in ["/", "/a", "/a/b", *(f"/{i}" for i in range(300))]}.values())
    urls = [(i, f"http://{rng.choice(hosts)}/{rng.choice(['', 'a', 'a/b/c', 'ab', '12', '7/x'])}?q") for i in range(200)]
    urls += [(5, "http://zzz.net/"), (5, "http://aaa.net/"), (6, None)]
    pages = spark.createDataFrame(urls, "page_id int, url string").withColumn("rules", F.lit(0)).withColumn("host", F.lit(0))
    got = url_reputation.judge(pages, spark.createDataFrame([(5, 1)], "page_id int, good int"), rules).collect()
    assert len(got) == len(urls) and url_reputation.judge(pages.limit(0), spark.createDataFrame([(5, 1)], "page_id int, good int"), rules).count() == 0
    for r in got:
        fits = [x for x in rules if (r["host"] == x.host or r["host"].endswith("." + x.host)) and r["path"].startswith(x.path)]
        best = min(fits, key=lambda x: (-len(x.host + x.path), x.host + x.path, x.allow), default=None)
        assert r["rule"] == (best and best.host + best.path) and (best is None or r["verdict"] == ("allow" if best.allow else "block"))
    assert {r["n_labelled"] for r in got if r["host"] == "aaa.net"} == {1} and {r["n_labelled"] for r in got if r["host"] == "zzz.net"} == {0}


def test_reputation_shrinks(spark):
    pages = [(i, f"http://h{i % 3}.d{i % 3}.net/{i}") for i in range(90)] + [(100, "http://new.d0.net/"), (101, "http://new.d1.net/")]
    good = [(i, int(i % 3 == 0 or i % 3 == 2 and i % 2)) for i in range(90)] + [(500, 1), (1, None)]
    out = url_reputation.judge(spark.createDataFrame(pages, "page_id int, url string"), spark.createDataFrame(good, "page_id int, good int"), [])
    by = {r["host"]: (r["bound"], r["verdict"]) for r in out.collect()}
    assert by["h0.d0.net"][1] == "allow" and by["h1.d1.net"][1] == "block"
    assert by["h0.d0.net"][0] > by["new.d0.net"][0] > by["new.d1.net"][0]  # unseen hosts lean on their domain


# --- classifiers -----------------------------------------------------------------------------------


def labelled_texts(n=240):
    rng, out = random.Random(9), []
    words = [f"{a}{b}{c}" for a in "btkm" for b in ("an", "or", "el") for c in ("o", "is", "ath")]
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(30, 200))]
        if i % 4 == 0:
            w[rng.randrange(len(w))] = "idiot"
            w.insert(rng.randrange(len(w)), "zorgle")
        bad = i % 3 == 0
        out.append((i, " ".join(x + "###" if bad else x for x in w), int(not bad), int(i % 4 == 0)))
    return out


def auc(y, s):
    pos, neg = [b for a, b in zip(y, s) if a], [b for a, b in zip(y, s) if not a]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def edge_rows(spark):
    return spark.createDataFrame([(1, None, "c"), (None, "", "c"), (2, "x " * 200_000, None), (2, "same", "c"), (2, "same", "c")], "doc_id bigint, text string, score string")


def check_scores(spark, module, model):
    got = module.score(edge_rows(spark), model, out="s").collect()
    assert len(got) == 5 and all(0 <= r["s"] <= 1 for r in got) and len({r["s"] for r in got if r["text"] == "same"}) == 1
    assert {r["s"] for r in got if r["text"] is None} == {r["s"] for r in got if r["text"] == ""}
    assert module.score(edge_rows(spark).limit(0), model, out="s").count() == 0


@pytest.mark.parametrize("module,label,column", [(quality, "quality", 2), (toxicity, "toxic", 3)])
def test_classifiers(spark, module, label, column):
    rows = labelled_texts()
    docs = spark.createDataFrame([r[:2] for r in rows], DOC)
    labels = spark.createDataFrame([(r[0], r[column]) for r in rows] + [(9999, 1), (5, None), (6, 7)], f"doc_id bigint, {label} int")
    model = module.fit(docs, labels, text_crc(F.col("doc_id")) % 5 != 0)
    got = {r["doc_id"]: r["score"] for r in module.score(docs, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert auc([r[column] for r in held], [got[r[0]] for r in held]) > 0.9
    check_scores(spark, module, model)
    none = module.fit(docs, labels.limit(0), text_crc(F.col("doc_id")) % 5 != 0)
    check_scores(spark, module, none)


def test_isotonic_and_boost():
    x, y = np.array([1, 2, 3, 4, 4.0]), np.array([0, 1, 0, 1, 0.0])
    at, value = toxicity.isotonic(x, y, np.ones(5))
    assert (np.diff(value) >= 0).all() and abs(np.interp(4, at, value) - 0.5) < 1e-9
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    p = toxicity.boost(x[:600], y[:600], np.ones(600), toxicity.Config()).predict(x[600:])
    assert ((p > 0) == y[600:]).mean() > 0.9


def test_toxic_features():
    seed, second = toxicity.seed_lexicon(), toxicity.seed_lexicon(toxicity.SECOND_PERSON)
    none = toxicity.Lexicon(np.zeros(0, np.uint64), np.zeros(0))
    f = toxicity.features(pa.array(["you IDIOT!!", "an 1d10t here", "plain words", "", None]), seed, second, none)
    assert f.shape == (5, toxicity.N_FEATURES) and f[0, 0] == 0.5 and f[0, 7] == 0.5 and f[1, 0] == 0 and f[1, 9] == 1 and not f[3].any() and not f[4].any()


# --- GIF -------------------------------------------------------------------------------------------


def test_gif_round_trip(spark):
    rng = random.Random(2)
    cases = [b"", b"a", b"\0" * 64, bytes(rng.randrange(256) for _ in range(5000)), b"ab" * 70_000, bytes(rng.randrange(3) for _ in range(200_000)), b"x" * 64 * 1024]
    for data in cases:
        payload = gif.padded(data)
        assert len(payload) % 64 == 0 and payload.startswith(data) and len(payload) > 0
        media = gif.write_gif(payload)
        assert b"".join(f.samples for f in gif.read_gif(media)) == payload
    docs = spark.createDataFrame([(1, "héllo"), (2, None), (None, ""), (1, "héllo")], DOC)
    got = gif.frames(gif.store(docs), keep=("n_bytes",)).collect()
    assert len(got) == 4 and all(r["error"] is None for r in got)
    assert sorted((r["n_bytes"], bytes(r["samples"]).rstrip(b"\0")) for r in got) == [(0, b""), (0, b""), (6, "héllo".encode()), (6, "héllo".encode())]
    broken = spark.createDataFrame([(1, bytearray(b"GIF89a")), (2, None), (3, bytearray(gif.write_gif(b"\1" * 64)[:-30]))], "doc_id bigint, media binary")
    assert [(r["error"] is not None, r["frames"]) for r in gif.frames(broken).collect()] == [(True, [])] * 3


def test_gif_clashing_columns(spark):
    df = gif.store(spark.createDataFrame([(1, "a")], DOC).withColumn("media", F.lit(1))).withColumn("frames", F.lit("own"))
    got = gif.frames(df, keep=("frames",))
    assert got.columns == ["doc_id", "frames", "media", "frames", "samples", "error"] and got.first()[1] == "own"


def test_long_texts_and_empty_tables(spark):
    from tokenizers import Tokenizer

    long = "".join(f"word{i % 977} é" for i in range(150_000))
    df = spark.createDataFrame([(1, long), (2, "x" * 1_500_000), (3, long)], DOC)
    payloads = {r["doc_id"]: bytes(r["samples"]) for r in gif.frames(gif.store(df)).collect()}
    assert payloads[1] == payloads[3] == gif.padded(long.encode()) and payloads[2].rstrip(b"\0") == b"x" * 1_500_000
    coded = {r["doc_id"]: r for r in bpe.encode(df.where("doc_id < 3"), TOKENIZER).collect()}
    assert np.frombuffer(coded[1]["ids"], "<u4").tolist() == Tokenizer.from_file(TOKENIZER).encode(long, add_special_tokens=False).ids and coded[2]["decoded"] == "x" * 1_500_000
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_dedup.near_duplicates(df).collect()}
    assert found[1] == found[3] == (len(brute_set(long, 5)), 1) and found[2] == (1, 2)
    page = "<p>" + "text of a long page " * 60_000 + "</p>"
    html = html_extract.main_text(spark.createDataFrame([(1, page)], "page_id int, html string"))
    assert len(html.first()["text"]) == 20 * 60_000 - 1
    empty = df.limit(0)
    assert gif.frames(gif.store(empty)).count() == bpe.encode(empty, TOKENIZER).count() == minhash_dedup.near_duplicates(empty).count() == 0
    assert html_extract.main_text(spark.createDataFrame([], "page_id int, html string")).count() == 0


def walked(model, text):
    """The toxicity score of one text: plain Python features, trees walked node by node."""
    import re

    data = (text or "").encode()
    h = lambda w, fold=bytewords.LOWER: int(bytewords.hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]), fold)[0])
    seed, second = set(model.seed.tolist()), set(model.second.tolist())
    learnt = dict(zip(model.learnt.words.tolist(), model.learnt.weights.tolist()))
    words = [h(w) for w in re.findall(rb"[A-Za-z0-9\x80-\xff]+", data)]
    n, size = max(1, len(words)), max(1, len(data))
    insult = [w in seed or w in learnt for w in words]
    near = sum(bad and any(w in second for w in words[max(0, i - 3) : i + 4]) for i, bad in enumerate(insult))
    leet = re.findall(rb"[A-Za-z0-9\x80-\xff@$]+", data)
    mixed = [w for w in leet if re.search(rb"[0-9@$]", w) and re.search(rb"[A-Za-z\x80-\xff]", w)]
    hidden = sum((v := h(w, toxicity.LEET)) in seed or v in learnt for w in mixed)
    a, b, weight = sum(w in seed for w in words), sum(w in learnt for w in words), sum(learnt.get(w, 0) for w in words)
    rate = lambda pattern: len(re.findall(pattern, data)) / size
    x = [
        a / n, b / n, np.log1p(a), np.log1p(b), weight / n, np.log1p(weight), sum(w in second for w in words) / n, near / n, np.log1p(near), hidden, len(mixed) / n,
        rate(rb"[A-Z]"), rate(rb"!"), rate(rb"[\x00-\x08\x0e-\x1f!-/:-@\[-`{-\x7f]"), rate(rb"[*#]"), rate(rb"[0-9]"),
    ]
    margin = model.trees.base
    for f, e, leaf in zip(model.trees.feature, model.trees.edge, model.trees.leaf):
        at = 0
        while at < len(f):
            at = 2 * at + (2 if x[f[at]] > e[at] else 1)
        margin += leaf[at - len(f)]
    return 0.999 * float(np.interp(margin, *model.knots)) + 0.001 / (1 + np.exp(-margin))


def compressed(model, text):
    """The quality score of one text, from compressors made for it alone."""
    import zstandard

    data, sizes = (text or "").encode(), []
    for raw in (model.good, model.bad):
        c = lambda: zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw), level=model.level, write_checksum=False, write_content_size=False, write_dict_id=False)  # noqa: B023, E731
        sizes.append(sum(len(c().compress(data[i : i + model.block])) for i in range(0, max(1, len(data)), model.block)))
    good, bad = sizes
    d, r, s = (bad - good) / max(good, bad), (good + bad) / 2 / (len(data) + 20), np.log1p(len(data) + 20) / 10
    return 1 / (1 + np.exp(-float(np.dot([1.0, d, r, d * r, d * d, r * r, s, s * d, s * r], model.weights))))


@needs_data
@pytest.mark.parametrize(
    "name,module,label,folds,fold,least,brute", [("op2_quality_compression", quality, "quality", 5, 0, 0.3, compressed), ("op7_toxicity_trees", toxicity, "toxic", 3, 1, 0.7, walked)]
)
def test_classifier_queries(spark, name, module, label, folds, fold, least, brute):
    """The query's columns against crc32 folds, its scores against brute force on its own model, and held-out labels."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in queries.QUERIES[name](spark, sf).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = module.fit(docs.select("doc_id", "text"), labels, text_crc(F.col("doc_id")) % folds != fold)
    assert got.keys() == texts.keys()
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % folds == fold) and r["predicted"] == int(r["score"] >= least) and 0 <= r["score"] <= 1
    for i in sorted(texts)[::7]:
        assert abs(got[i]["score"] - brute(model, texts[i])) < 1e-9
    held = [r for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert auc([r[label] for r in held], [got[r["doc_id"]]["score"] for r in held]) > 0.9


def test_gif_rules():
    """Local palette, transparency, interlacing, offsets and disposal, on a file made by hand."""

    def image(left, top, w, h, samples, flags=0, palette=b"", control=b""):
        # One clear before each sample keeps every code at three bits.
        codes = np.array([c for s in samples for c in (4, s)] + [5])
        widths = np.full(len(codes), 3)
        stream = gif.pack(codes, widths)
        head = control + b"\x2c" + left.to_bytes(2, "little") + top.to_bytes(2, "little") + w.to_bytes(2, "little") + h.to_bytes(2, "little") + bytes([flags]) + palette
        return head + b"\x02" + bytes([len(stream)]) + stream + b"\0"

    control = lambda disposal, cs, clear=None: b"\x21\xf9\x04" + bytes([disposal << 2 | (clear is not None)]) + cs.to_bytes(2, "little") + bytes([clear or 0]) + b"\0"
    shared = bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 9, 9, 9])
    own = bytes([1, 1, 1, 2, 2, 2, 3, 3, 3, 4, 4, 4])
    data = (
        b"GIF89a" + bytes([2, 0, 4, 0, 0xF1, 0, 0]) + shared + b"\x21\xfe\x02hi\0"
        + image(0, 0, 2, 4, [0, 0, 1, 1, 2, 2, 3, 3], control=control(1, 7))
        + image(1, 1, 1, 2, [0, 1], 0x81, own, control(3, 5, 1))
        + image(0, 0, 1, 1, [3], control=control(2, 0))
        + image(0, 0, 2, 4, [0, 0, 1, 1, 2, 2, 3, 3], 0x40)
        + b"\x3b"
    )
    red, green, blue, grey = [255, 0, 0], [0, 255, 0], [0, 0, 255], [9, 9, 9]
    got = []
    for f in gif.read_gif(data):
        got.append((f.delay_ms, f.disposal, f.canvas.copy()))
    assert [g[:2] for g in got] == [(70, 1), (50, 3), (0, 2), (0, 0)] 
    assert got[0][2][:, 0, :3].tolist() == [red, green, blue, grey]
    assert got[1][2][1, 1, :3].tolist() == [1, 1, 1] and got[1][2][2, 1, :3].tolist() == blue  # the second sample is transparent
    assert got[2][2][1, 1, :3].tolist() == green and got[2][2][0, 0, :3].tolist() == grey  # the second frame was taken back
    assert got[3][2][:, 0, :3].tolist() == [red, blue, green, grey]  # rows of passes 8/0, 4/2, 2/1
    assert gif.histogram(got[0][2])[[48, 12, 3, 0]].tolist() == [2, 2, 2, 2]


# --- tokens ----------------------------------------------------------------------------------------

ODD = "aZ é ñ0 9²Ⅷ_.'s t\n\t\r\x1c\x1f\x85\xa0 　 ’日本😀\u0301"


def odd_texts(n):
    rng = random.Random(1)
    parts = [*ODD, "<|endoftext|>", " the", "'ll", "  "]
    return ["", "<|endoftext|>", "a <|endoftext|>  b"] + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(n)]


def test_bpe_equals_library():
    from tokenizers import Tokenizer

    theirs, ours = Tokenizer.from_file(TOKENIZER), bpe.ByteBPE(TOKENIZER)
    for t in odd_texts(1500) + ["word " * 3000, "x" * 4000]:
        ids = theirs.encode(t, add_special_tokens=False).ids
        coded = ours.encode(t)
        assert np.frombuffer(coded, "<u4").tolist() == ids, repr(t)
        assert ours.decode(coded) == theirs.decode(ids, skip_special_tokens=False) == t


def test_bpe_frame(spark):
    got = bpe.encode(spark.createDataFrame([(1, None), (None, "a b"), (2, ""), (2, "")], DOC), TOKENIZER).collect()
    assert sorted((len(r["ids"]), r["decoded"]) for r in got) == [(0, ""), (0, ""), (0, ""), (8, "a b")]


def test_token_cache(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(TOKENIZER)
    texts = odd_texts(60)
    extra = [(900, None), (901, texts[5]), (901, texts[5]), (None, "no id"), (None, texts[7]), (902, "twice"), (902, "twice"), (None, "no id either"), (None, "no id either"), (3, "no id")]
    docs = spark.createDataFrame(list(enumerate(texts)) + extra, DOC).withColumn("row", F.lit("clash")).withColumn("digest", F.lit(1))
    store = str(tmp_path / "store")
    distinct = {(r["text"] or "") for r in docs.collect()}
    want = sorted(len(theirs.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs.collect())
    half = docs.where("doc_id % 2 = 0 or doc_id is null")
    for batch in (half, docs, docs):
        got = token_cache.token_counts(batch, TOKENIZER, store)
        rows = spark.read.parquet(store)
        # Every distinct content so far is in the store, once, so each was encoded once.
        so_far = {(r["text"] or "") for r in (half if batch is half else docs).collect()}
        assert rows.count() == rows.select("digest").distinct().count() == len(so_far)
    assert sorted(r["n_tokens"] for r in got.collect()) == want
    # The same by the way of many misses, and for an input in another order at each reading.
    monkeypatch.setattr(token_cache, "BROADCAST_KEYS", 3)
    for df, at in ((docs, "many"), (docs.orderBy(F.rand()), "unstable")):
        got = token_cache.token_counts(df, TOKENIZER, str(tmp_path / at))
        assert sorted(r["n_tokens"] for r in got.collect()) == want and spark.read.parquet(str(tmp_path / at)).count() == len(distinct)
        monkeypatch.undo()
    assert token_cache.token_counts(docs.limit(0), TOKENIZER).count() == 0
    spark.range(3).select(F.col("id").alias("digest")).write.format("json").save(str(tmp_path / "broken"))
    with pytest.raises(Exception, match="(?i)parquet"):
        token_cache.token_counts(docs, TOKENIZER, str(tmp_path / "broken")).collect()


def test_long_words_are_not_remembered():
    ours = bpe.ByteBPE(TOKENIZER)
    ours.encode("x" * 5000 + " " + "y" * 5000 + " short")
    assert max(map(len, [*ours.tokens, *ours.words])) <= bpe.LONGEST
    with pytest.raises(ValueError):
        bpe.ByteBPE(public_tokenizers.path("word_bpe_49k.json"))


def test_other_tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    texts = ["Hello  world", "", "ünï cödé 12"]
    for name in ("word_bpe_49k.json", "piece_bpe_32k.model"):
        path = public_tokenizers.path(name)
        got = token_cache.Counter(path).count(texts)
        if name.endswith("json"):
            assert got == [len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids) for t in texts]
        else:
            assert got == [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]


# --- chat, decontamination, HTML -------------------------------------------------------------------


def test_transcripts():
    parse = chat_format.parse_transcript
    assert parse("System: be nice\n\nUser: hi\nhow are you?\nAssistant: fine.\n\nAnd more.\n\nHuman: ok") == [("system", "be nice"), ("user", "hi\nhow are you?"), ("assistant", "fine.\n\nAnd more."), ("user", "ok")]
    assert parse("### Instruction:\nDo it\n\n### Response:\nDone") == [("user", "Do it"), ("assistant", "Done")]
    assert parse("<|user|>\nhello\n<|assistant|>\nyes") == [("user", "hello"), ("assistant", "yes")]
    assert parse(None) == parse(" \n") == []
    assert chat_format.render("user", "Human: hi ") == "<|user|>\nhi\n<|end|>\n"


def plain_viterbi(model, seen):
    """The best score of a conversation's roles, and the roles, over plain lists."""
    e = [[sum(int(t[r, o]) for t, o in zip(model.emit, row)) for r in range(3)] for row in seen]
    best = [(model.start[r] + e[0][r], (r,)) for r in range(3)]
    for row in e[1:]:
        best = [max((s + model.step[p[-1]][r] + row[r], (*p, r)) for s, p in best) for r in range(3)]
    return max(best)


def score_of(model, seen, roles):
    total = model.start[roles[0]] + sum(model.step[a][b] for a, b in zip(roles, roles[1:]))
    return total + sum(int(t[r, o]) for r, row in zip(roles, seen) for t, o in zip(model.emit, row))


def test_viterbi_is_best_path():
    import itertools

    model = chat_format.fit_turns([[(1, chat_format.observe("hi?")), (2, chat_format.observe("long answer " * 40))]] * 5)
    seen = np.array([chat_format.observe(t) for t in ("hello?", "answer " * 60, "and?", "User: x")])
    paths = list(itertools.product(range(3), repeat=4))
    assert score_of(model, seen, tuple(model.decode(seen))) == max(score_of(model, seen, p) for p in paths) == plain_viterbi(model, seen)[0]


def said(rng, role):
    mark = rng.choice(("", "", {0: "System: ", 1: "User: ", 2: "Assistant: "}[role]))
    return mark + ("short " * rng.randrange(1, 9) + "?" * rng.randrange(2) if role == 1 else "a long answer, with much text\n" * rng.randrange(1, 30))


def test_format_turns(spark):
    """Any cut into ranges gives the roles of one Viterbi pass over each whole conversation."""
    rng, rows = random.Random(5), []
    for c in range(30):
        rows += [(c, t, (t + 1) % 2 + 1 if t or c % 3 else 0) for t in range(rng.randrange(1, 9))]
    rows += [(777, t, rng.choice((1, 2))) for t in range(1300)]
    turns = [(c, t, chat_format.ROLES[r], said(rng, r)) for c, t, r in rows]
    extra = [(None, 0, None, "alone"), (None, None, None, None), (None, None, None, "x " * 600_000), (5, None, "user", "x"), (1, 0, "user", "short?"), (1, 0, "user", "short?")]
    df = spark.createDataFrame(turns + extra, "conv_id bigint, turn bigint, role string, text string").withColumn("part", F.lit(1)).withColumn("N", F.lit(1))
    model = chat_format.fit(df, text_crc(F.col("conv_id")) % 5 != 0)
    learnt = chat_format.fit_turns([
        [(chat_format.ROLES.index(r), chat_format.observe(x)) for _, _, r, x in own]
        for c in {r[0] for r in turns + extra if r[0] is not None} if zlib.crc32(str(c).encode()) % 5
        for own in [in_order([r for r in turns + extra if r[0] == c], spark)]
    ])
    assert (model.start, model.step) == (learnt.start, learnt.step) and all((a == b).all() for a, b in zip(model.emit, learnt.emit))
    texts, want = {}, {}
    for c in {r[0] for r in turns + extra}:
        own = in_order([r for r in turns + extra if r[0] == c], spark)
        texts[c] = [chat_format.observe(r[3]) for r in own]
        want[c] = plain_viterbi(model, texts[c])[0] if c is not None else None
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("3", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = chat_format.format_turns(df, model).collect()
        assert len(got) == len(turns) + len(extra) and all(r["rendered"].startswith(f"<|{r['role']}|>") for r in got)
        for c in want:
            own = [(r["conv_id"], r["turn"], r["role"], r["rendered"]) for r in got if r["conv_id"] == c]
            if c in (None, 1):
                continue
            own.sort(key=lambda r: -1 if r[1] is None else r[1])
            assert score_of(model, texts[c], tuple(chat_format.ROLES.index(r[2]) for r in own)) == want[c]
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert chat_format.format_turns(df.limit(0), model).count() == 0
    assert chat_format.fit(df.limit(0), F.lit(True)).start == chat_format.fit_turns([]).start


def in_order(rows, spark):
    """Rows (conv, turn, role, text) of a conversation in the order in which they are decoded."""
    tied = len({r[1] for r in rows}) < len(rows)
    h = {}
    if tied:
        h = {r["t"]: r["h"] for r in spark.createDataFrame([(x,) for x in {r[3] for r in rows}], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    return sorted(rows, key=lambda r: (-1 if r[1] is None else r[1], h.get(r[3], 0)))


@needs_data
def test_chat_query(spark):
    """The query's roles are those of plain Viterbi, and right for held-out turns with and without markers."""
    got = queries.op3_chat_transcripts(spark, SF).collect()
    logged = queries.as_logged(spark.read.parquet(f"{SF}/conversations.parquet"))
    model = chat_format.fit(logged, text_crc(F.col("conv_id")) % 5 != 0)
    rows = {(r["conv_id"], r["turn"]): r for r in logged.collect()}
    assert len(got) == len(rows)
    roles = {(r["conv_id"], r["turn"]): r["role"] for r in got}
    for c in {k[0] for k in rows}:
        own = sorted(k for k in rows if k[0] == c)
        seen = [chat_format.observe(rows[k]["text"]) for k in own]
        assert score_of(model, seen, tuple(chat_format.ROLES.index(roles[k]) for k in own)) == plain_viterbi(model, seen)[0]
    held = [r for r in got if r["held_out"]]
    marked = [chat_format.observe(rows[r["conv_id"], r["turn"]]["text"])[0] > 0 for r in held]
    right = [r["role"] == rows[r["conv_id"], r["turn"]]["role"] for r in held]
    assert 0 < sum(marked) < len(held) and sum(right) >= 0.95 * len(right)
    assert all(not chat_format.MARKER.match(r["rendered"].split("\n", 1)[1]) for r in held)


def test_parse_transcripts(spark):
    df = spark.createDataFrame([(1, "User: hi\nAssistant: yes"), (2, None), (3, " "), (None, "### Instruction:\nDo it\n\n### Response:\nDone"), (1, "User: hi\nAssistant: yes")], "id int, text string").withColumn("role", F.lit(3))
    got = chat_format.parse_transcripts(df).collect()
    want = [(None, 0, "user", "Do it"), (None, 1, "assistant", "Done"), *[(1, 0, "user", "hi"), (1, 1, "assistant", "yes")] * 2]
    assert sorted(map(str, [tuple(r)[:4] for r in got])) == sorted(map(str, want)) and got[0]["rendered"].endswith("<|end|>\n")
    assert chat_format.parse_transcripts(df.limit(0)).count() == 0


ITEM = "A train travels 300 km in 5 hours. How far does Anna Smith think the train will go in 9 hours at the same speed, asked Bob?"


@pytest.mark.parametrize(
    "text,hit,changed",
    [
        (ITEM, True, False), ("Before. " + ITEM.lower().replace("anna smith", "Anna Smith") + " after", True, False), (ITEM.replace("300", "42").replace("Anna Smith", "Mary").replace("km", "miles"), True, True),
        (ITEM.replace("train", "boat"), False, False), ("", False, False), (None, False, False), (ITEM[:60], False, False), ("nothing of the kind " * 500, False, False),
    ],
)
def test_decontamination(spark, text, hit, changed):
    b = spark.createDataFrame([(1, ITEM), (2, None), (3, "a b"), (None, ITEM)], "item_id bigint, text string")
    d = spark.createDataFrame([(7, text), (7, text), (None, text)], DOC).withColumn("item", F.lit("clash"))
    got = decontaminate.contaminated(d, b).collect()
    assert {(r["item_id"], r["reparameterised"]) for r in got} == ({(1, changed)} if hit else set()) and len(got) == (3 if hit else 0)
    assert decontaminate.clean(d, b).count() == (0 if hit else 3)


def test_items_without_templates(spark):
    names = "Anna Bob Carol Dave Eve Frank Grace Heidi Ivan Judy"
    items = ["What is 12 times 7?", "Compute 3 + 4 * 5.", names, "Paris", "Is 3 km 4 kg 5 m 6 g 7 cm 8 mm the speed of a train that goes on and on"]
    b = spark.createDataFrame(list(enumerate(items)) + [(9, "+ - *"), (8, "What is 13 times 7?")], "item_id bigint, text string")
    d = spark.createDataFrame([(i, f"Before, {t} After") for i, t in enumerate(items)] + [(7, "What is 12 of 7? Compute 3 and 4, 5; Anna, Carol + - *")], DOC)
    got = decontaminate.contaminated(d, b).collect()
    assert {(r["doc_id"], r["item_id"], r["reparameterised"]) for r in got} == {(i, i, False) for i in range(len(items))}
    assert [r[0] for r in decontaminate.clean(d, b).select("doc_id").collect()] == [7]
    part = spark.createDataFrame([(1, items[4][:50])], DOC)  # windows of numbers and units, for the most part
    assert decontaminate.contaminated(part, b).count() == 1


def test_slots_must_agree():
    assert decontaminate.consistent([(("3", "5"), ("4", "6")), (("5",), ("6",))]) == (2, True)
    assert decontaminate.consistent([(("3", "5"), ("4", "6")), (("5",), ("7",))]) == (1, True)
    assert decontaminate.consistent([(("3", "5"), ("4", "4"))]) == (0, False)


def test_copy_after_other_values(spark):
    item = "The bakery in our village sold exactly 12 loaves of dark bread before noon and then it closed early today"
    stem = "The bakery in our village sold exactly 48 loaves and nothing else. "
    b = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    d = [(1, stem + item), (2, stem * 3000 + item), (3, stem), (4, "".join(stem.replace("48", str(n)) for n in range(100, 3000)) + item.replace("closed", "later closed"))]
    got = {r["doc_id"]: r for r in decontaminate.contaminated(spark.createDataFrame(d, DOC), b).collect()}
    assert set(got) == {1, 2, 4} and got[1]["matched"] == got[1]["n_windows"] == 13
    assert (got[1]["reparameterised"], got[1]["first_byte"], got[1]["end_byte"]) == (False, len(stem), len(stem + item))
    hit = lambda w, item, text, at: decontaminate.Hit(w, item, text, at, at + 1, at - w)
    assert len(decontaminate.chain([hit(0, ("3",), ("4",), 0), hit(1, ("3",), ("3",), 1), hit(2, ("3",), ("3",), 2)])) == 2


def test_copies_in_other_case(spark):
    german = "Als Frau Müller am Abend über die Straße ging, sah Ärztin Anna Weiß den alten Öhi mit 3 Hunden und 12 Katzen am Ufer"
    b = spark.createDataFrame([(1, ITEM), (2, german)], "item_id bigint, text string")
    copies = [f(t) for t in (ITEM, german) for f in (str.lower, str.upper, str.title)]
    d = spark.createDataFrame([(i, f"Before, {t} After") for i, t in enumerate(copies)] + [(9, ITEM.replace("train", "boat").upper())], DOC)
    assert {(r["doc_id"], r["item_id"], r["reparameterised"]) for r in decontaminate.contaminated(d, b).collect()} == {(i, 1 + i // 3, False) for i in range(6)}


def brute_match(item, text, cfg=decontaminate.Config()):
    """Whether some binding of slots, one to one, lets the share of an item's template windows be found in a text; plain lists, all bindings."""
    import itertools

    def words(t):
        data = t.encode()
        c = decontaminate.canonical(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        out = []
        for i in range(len(c.words)):
            raw = data[c.starts[i] : c.ends[i]].decode().lower()
            out.append((int(c.kinds[i]), raw if c.kinds[i] else raw))
        return out

    def wins(ws, k):
        for i in range(len(ws) - k + 1):
            w = ws[i : i + k]
            if sum(kind == 0 for kind, _ in w) >= cfg.least:
                yield tuple(x if kind == 0 else kind for kind, x in w), tuple(x for kind, x in w if kind)

    a, b = words(item), words(text)
    k = min(cfg.window, len(a))
    own, there = list(wins(a, k)), {}
    for mould, slots in wins(b, k):
        there.setdefault(mould, set()).add(slots)
    names = sorted({x for _, slots in own for x in slots})
    values = sorted({x for vs in there.values() for v in vs for x in v})
    best = None
    for choice in itertools.permutations([*values, *[None] * len(names)], len(names)) if len(names) <= 3 else ():
        bound = dict(zip(names, choice))
        n = sum(tuple(bound[x] for x in slots) in there.get(mould, ()) for mould, slots in own)
        best = max(best or (0, False), (n, all(bound[x] == x for _, slots in own for x in slots if bound[x] is not None)))
    return best is not None and len(own) and best[0] >= max(1, cfg.share * len(own))


def test_templates_are_brute_force(spark):
    """Planted re-parameterised items, mixtures of values and broken copies, judged by trying all bindings."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(4, 9)))
    items = []
    for _ in range(6):
        w = [word() for _ in range(rng.randrange(14, 24))]
        for at in rng.sample(range(3, len(w)), 2):
            w[at] = str(rng.randrange(10, 99))
        items.append(w)
    docs = []
    for _ in range(60):
        w, parts = rng.choice(items), []
        for _ in range(rng.randrange(1, 4)):
            own = [str(rng.randrange(10, 99)) if x.isdigit() and rng.random() < 0.6 else x for x in w]
            lo = rng.randrange(0, len(own) // 2) if rng.random() < 0.5 else 0
            hi = rng.randrange(len(own) // 2, len(own)) if rng.random() < 0.5 else len(own)
            if rng.random() < 0.3:
                own[rng.randrange(len(own))] = word()
            parts += [*own[lo:hi], word()]
        docs.append(" ".join(parts))
    cfg = decontaminate.Config(window=6)
    got = decontaminate.contaminated(
        spark.createDataFrame(list(enumerate(docs)), DOC), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, text string"), cfg=cfg
    )
    want = {(d, i) for d, text in enumerate(docs) for i, w in enumerate(items) if brute_match(" ".join(w), text, cfg)}
    assert 10 < len(want) < 60 and {(r["doc_id"], r["item_id"]) for r in got.collect()} == want


def test_item_with_several_texts(spark):
    other = "Nobody in the whole town could say how the old clock on the tower had come to stop that night"
    b = spark.createDataFrame([(1, ITEM), (1, other), (1, other), (2, other)], "item_id bigint, text string")
    d = spark.createDataFrame([(1, other), (2, ITEM), (3, " ".join(ITEM.split()[:9]) + " x " + " ".join(other.split()[:10]))], DOC)
    got = sorted((r["doc_id"], r["item_id"], r["matched"] == r["n_windows"]) for r in decontaminate.contaminated(d, b).collect())
    assert got == [(1, 1, True), (1, 2, True), (2, 1, True)]


def test_contamination_of_long_and_empty(spark):
    b = spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")
    d = spark.createDataFrame([(1, "plain words of a long text " * 80_000 + ITEM), (2, "x" * 3_000_000)], DOC)
    assert [r["doc_id"] for r in decontaminate.contaminated(d, b).collect()] == [1]
    assert decontaminate.contaminated(d.limit(0), b).count() == decontaminate.contaminated(d, b.limit(0)).count() == 0
    assert decontaminate.clean(d.limit(0), b).count() == 0 and decontaminate.clean(d.withColumnRenamed("doc_id", "Doc").withColumn("_ROW_NUMBER", F.lit(1)), b, "Doc").count() == 1


@needs_data
def test_benchmark_passages(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r["doc_id"], r["item_id"]) for r in queries.op9_template_decontamination(spark, SF).collect()}
    passages = items.collect()
    assert got == {(d["doc_id"], i["item_id"]) for d in docs.collect() for i in passages if i["text"] in d["text"]}
    tight = decontaminate.Config(filter_bits=1 << 10, broadcast_windows=0)  # the filter lets all through, and the join is by shuffle
    assert {tuple(r) for r in decontaminate.contaminated(docs, items, cfg=tight).select("doc_id", "item_id").collect()} == got


PAGE = """<html><body class="has-sidebar"><header><h1>Site</h1></header><div class="cookie-notice">We use cookies</div><div id=content><div class=sidebar>x y z</div>
<article><header><h1>T &amp; x</h1></header><p>One two   three<p>Four <b>five</b><br>six<ul><li>a<li>b</ul><form><input>hello</form><aside>no</aside><script>1</script></article>
<section class="comments"><p>reader says a lot of text here and more and more text than the article itself holds by far and further.</p></section></div><footer>f</footer>"""


def test_html():
    assert html_extract.extract(PAGE) == "T & x\nOne two three\nFour five six\na\nb"
    assert html_extract.extract(None) == html_extract.extract("") == html_extract.extract("<nav><a href=x>only a menu</a></nav>") == ""
    assert html_extract.extract("plain &lt; text") == "plain < text"
    bare = "<div class=menu><a>x</a></div><div><p>Some long text goes here for the page, and it has no article tag.</p><p>Short.</p><p>Another long line of text follows here.</p></div>"
    assert html_extract.extract(bare).split("\n")[1] == "Short."


def test_html_frame(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (None, "u", ""), (1, "u", PAGE)], "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    got = html_extract.main_text(df, keep=("url",)).collect()
    assert len(got) == 4 and [r["text"] for r in got].count("") == 2 and got[0].asDict().keys() == {"page_id", "url", "text"}


def page_of(rng):
    """A page and the lines of its main text, known from how it was made; most pages have no article element."""
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randrange(2, 9)))
    say = lambda least, most: " ".join(word() for _ in range(rng.randrange(least, most)))
    links = lambda: "<div>" + "".join(f"<a href=x>{say(1, 4)}</a> " for _ in range(rng.randrange(3, 12))) + "</div>"
    content, made = [], ""
    for _ in range(rng.choice((1, 1, 2, 3))):
        title, body = say(2, 8), [say(1, 5) if rng.random() < 0.2 else say(12, 90) for _ in range(rng.randrange(2, 9))]
        body[rng.randrange(len(body))] = say(40, 90)
        box = rng.choice(("div", "section", "article"))
        wrap = rng.choice(("<p>{}</p>", "<p>{}", "<div>{}</div>", "<p><b>{}</b></p>"))
        made += f"<h2>{title}</h2><{box}>" + "".join(wrap.format(x.replace("é", "&eacute;")) for x in body) + f"</{box}>" + (links() if rng.random() < 0.5 else "")
        content += [title, *body]
    marked = f'<div class="{rng.choice(("ad", "sidebar-left", "cookieNotice"))}"><p>{say(30, 60)}</p></div>'
    comments = f'<section id=comments><article class="comment"><p>{say(40, 80)}</p></article></section>'
    return f"<html><head><title>{say(3, 5)}</title></head><body><nav>{links()}</nav>{links()}{marked}{made}{comments}{links()}<footer>{say(9, 20)}</footer></body></html>", content


def test_html_pages_without_articles():
    """Pages made of known parts; link lists without any mark are told from text by their ratios alone."""
    rng, needs_clusters = random.Random(8), 0
    for _ in range(300):
        page, content = page_of(rng)
        assert html_extract.extract(page) == "\n".join(content)
        lines = html_extract.lines_of(page)
        needs_clusters += [x.text for x in html_extract.main_lines(lines, choose=lambda rows, _: [True] * len(rows))] != content
    assert needs_clusters == 300


def test_html_selection_is_brute_force():
    """Smoothing by a matrix over each run, and the clusters by trying what 2-means does on plain lists."""
    rng, cfg = random.Random(3), html_extract.Config()
    for _ in range(60):
        lines = html_extract.lines_of(page_of(rng)[0])
        raw = np.array([np.log1p(x.counted / max(1, x.tags)) for x in lines])
        at, run = np.arange(len(lines)), np.cumsum([i > 0 and lines[i].marked != lines[i - 1].marked for i in range(len(lines))])
        near = np.abs(at[:, None] - at)
        kernel = np.exp(-(near**2) / (2 * cfg.sigma**2)) * (near <= cfg.radius) * (run[:, None] == run)
        smooth = kernel @ raw / kernel.sum(axis=1)
        low, high = 0.0, smooth.max()
        for _ in range(50):
            is_high = smooth > (low + high) / 2
            low, high = smooth[~is_high].sum() / (1 + (~is_high).sum()), smooth[is_high].mean()
        assert html_extract.select(lines) == [bool(x > 0 and r >= (low + high) / 2) for x, r in zip(raw, smooth)]


def test_html_feed_and_lead():
    text = "some long text of the page with many words in it and more of them here"
    assert html_extract.extract(f"<main><article>{text}</article><div class=ad>{text}</div><article>{text} two</article></main>") == f"{text}\n{text} two"
    assert html_extract.extract(f"<body><h1>T</h1><div><p>{text}<p>{text * 30}</div></body>") == f"T\n{text}\n{text * 30}"


@pytest.mark.parametrize("tags", ["<div>", "<b>", "<p>", "<li>", "<table><tr><td>", "<article>", "<b><p>", "<form>"])
def test_html_deep_markup(tags):
    start = time.process_time()
    assert html_extract.extract(tags * (1_000_000 // len(tags)) + "x" + "</b>" * 1000).endswith("x" if tags != "<form>" else "")
    assert time.process_time() - start < 10


@needs_data
def test_html_query(spark):
    """The driver's pages less the parts that their markup names, block by block, without a cut at the article."""
    import html
    import re

    rows = queries.op10_html_main_text(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect()
    for r in rows:
        page = re.sub(r"(?s)<head>.*?</head>|<nav>.*?</nav>|<footer>.*?</footer>|<!--.*?-->|<div class=\"ad\">.*?</div>", "\n", r["html"])
        blocks = (" ".join(html.unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split("(?i)</?(?:p|h1|article|body|html)\\b[^>]*>", page.replace("<br>", " ")))
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])
        everything = html_extract.main_lines(html_extract.lines_of(r["html"]), choose=lambda rows, _: [True] * len(rows))
        assert "\n".join(x.text for x in everything) != r["text"]


# --- queries and pipeline --------------------------------------------------------------------------


@needs_data
def test_media_and_token_queries(spark):
    texts = {r["doc_id"]: r["text"].encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op4_gif_media(spark, SF).collect():
        payload = gif.padded(texts[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(texts[r["doc_id"]]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(TOKENIZER)
    ids = {k: theirs.encode(t.decode(), add_special_tokens=False).ids for k, t in texts.items()}
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in queries.op5_token_counts(spark, SF).collect()} == {k: (len(texts[k]), len(v), len(v) > 512) for k, v in ids.items()}
    for r in queries.op8_byte_bpe(spark, SF).collect():
        own = np.array(ids[r["doc_id"]], "<u4").tobytes()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(own) // 4, hashlib.sha256(own).hexdigest(), hashlib.sha256(texts[r["doc_id"]]).hexdigest())


@needs_data
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(queries.ORACLE_SQL[name]).select(", ".join(columns)).fetchall()
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, want))


@needs_data
def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    base = spark.read.parquet(f"{SF}/documents.parquet").limit(120).withColumn("score", F.expr("nullif('x', 'y')"))
    clean = "Here are some plain words of a text that nobody would mind to read on an evening by the fire with a cup of tea"
    odd = spark.createDataFrame([(None, None, None, None, None, None), (None, "", "en", None, 0, "s"), (7777, None, None, None, None, None), (3, clean, "en", "x", 9, "s"), (None, clean, "en", "x", 9, "s")], base.schema)
    docs = base.union(odd).union(base.limit(2))
    labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    told = {"toxicity": (toxicity, 3, 1, walked, lambda x: x < 0.7), "quality": (quality, 5, 0, compressed, lambda x: x >= 0.3)}
    every = lambda df: sorted((str(r["doc_id"]), str(r["text"])) for r in df.collect())
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF).persist()
        assert docs.count() <= before.count()
        if name != "bpe":
            assert docs.columns == before.columns
        if name in told:
            module, folds, fold, brute, keeps = told[name]
            model = module.fit(before.select("doc_id", "text"), labels, text_crc(F.col("doc_id")) % folds != fold)
            assert every(docs) == sorted((str(r["doc_id"]), str(r["text"])) for r in before.collect() if keeps(brute(model, r["text"])))
        if name == "decontamination":
            hit = {r["doc_id"] for r in before.collect() if any(i["text"] in (r["text"] or "") for i in items.collect())}
            assert every(docs) == sorted((str(r["doc_id"]), str(r["text"])) for r in before.collect() if r["doc_id"] not in hit)
        if name == "bpe":
            from tokenizers import Tokenizer

            theirs = Tokenizer.from_file(TOKENIZER)
            want = sorted((str(r["doc_id"]), np.array(theirs.encode(r["text"] or "", add_special_tokens=False).ids, "<u4").tobytes()) for r in before.collect())
            assert sorted((str(r["doc_id"]), bytes(r["ids"])) for r in docs.collect()) == want
        if name == "near_dedup":
            # One row of every group, the one with the least id; equal ids with other texts are other documents.
            rows = [(i, r["text"]) for i, r in enumerate(before.collect())]
            ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in before.collect()]
            of = {}
            for n, _, c in brute_components(rows, 5):
                of.setdefault(c, []).append((ids[n] < 0, ids[n]))
            assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in docs.collect()) == sorted(min(x)[1] for x in of.values())
        if name == "decontamination":
            assert not decontaminate.contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count()
    assert docs.count() > 50 and docs.where("not round_trip").count() == 0


@needs_data
def test_pipeline_run(spark):
    """`run` returns the rows of its stages one after another, and leaves its result alone."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).persist()
    every = lambda df: sorted((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["round_trip"]) for r in df.collect())
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == docs.columns and every(got) == every(docs) and len(every(got)) > 50
    assert {f.split("/")[-2] for f in got.inputFiles()} == {"bpe"}


def test_scratch_spares_workspaces_opened_before(spark):
    ws = Workspace(spark, "outer")
    with scratch(spark):
        kept, inner = ws.write(spark.range(3), "kept"), Workspace(spark, "inner")
        inner.write(spark.range(3), "gone")
    assert kept.count() == 3 and not os.path.exists(inner.root.removeprefix("file:"))
