"""What is kept in the shared folder, and what goes out to files and comes back."""

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagemill.operators import bm25, dense, enrich, packing, validation
from passagemill.operators.sizes import is_small
from passagemill.sources import readers, sinks, storage


def test_kept_once(spark):
    built, key = [], f"test-{time.time()}"

    def build(path):
        built.append(path)
        spark.range(3).write.parquet(path)

    a, b = storage.kept(spark, "t", key, build), storage.kept(spark, "t", key, build)
    assert a == b and len(built) == 1 and spark.read.parquet(a).count() == 3 and storage.kept(spark, "t", key + "x", build) != a
    with pytest.raises(ValueError):
        storage.kept(spark, "t", key + "y", lambda path: (_ for _ in ()).throw(ValueError()))
    assert spark.read.parquet(storage.kept(spark, "t", key + "y", build)).count() == 3


def test_index_follows_its_input(spark, tmp_path):
    def search(word):
        docs = spark.read.parquet(str(tmp_path / "docs"))
        ix = bm25.kept_index(docs, "id", {"t": F.split("text", " ")}, storage.stamp(spark, str(tmp_path / "docs")))
        assert ix.buckets == 1 and ix.doclen.count() == docs.where("text <> ''").count()
        return sorted(r["doc"] for r in bm25.score(spark.createDataFrame([("q", "t", word)], "qid string, field string, token string"), ix).collect())

    spark.createDataFrame([(1, "a b"), (2, "b c")], "id int, text string").write.parquet(str(tmp_path / "docs"))
    assert search("b") == [1, 2] and search("b") == [1, 2]
    time.sleep(1.1)
    spark.createDataFrame([(3, "b d e")], "id int, text string").write.mode("append").parquet(str(tmp_path / "docs"))
    assert search("b") == [1, 2, 3] and search("zzz") == []


def test_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bm25, "BUCKET", 20)
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 17}" for j in range(9))) for i in range(40)], "id int, text string")
    bm25.write_index(docs, "id", {"t": F.split("text", " ")}, str(tmp_path / "ix"))
    ix, plain = bm25.read_index(spark, str(tmp_path / "ix")), bm25.index(docs, "id", {"t": F.split("text", " ")})
    assert ix.buckets > 5
    q = spark.createDataFrame([(f"q{i}", "t", f"w{i}") for i in range(12)], "qid string, field string, token string")
    rows = lambda x: sorted((r["qid"], r["doc"], round(r["score"], 9)) for r in bm25.score(q, x).collect())
    assert rows(ix) == rows(plain) and rows(ix)


def test_scan_blocks_and_top(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = [(i, [float(x) for x in rng.normal(size=4)] if i % 50 else None) for i in range(400)] + [(1000, [1.0, 0.0, 0.0, 0.0])] * 3
    q = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(20)]
    vectors, queries = spark.createDataFrame(v, "doc bigint, v array<float>"), spark.createDataFrame(q, "qid int, q array<float>")
    want = {(a, b, round(float(np.dot(np.float32(x).astype(float), np.float32(y).astype(float))), 6)) for a, x in q for b, y in v if y}
    monkeypatch.setattr(dense, "QUERY_BLOCK", 8 * 4 * 7)
    assert {(r["qid"], r["doc"], round(r["score"], 6)) for r in dense.scan(queries, vectors).collect()} == want
    tops = bm25.top(dense.scan(queries, vectors, 5), 5).collect()
    for i in range(20):
        own = sorted(((-round(float(np.dot(np.float32(q[i][1]).astype(float), np.float32(y).astype(float))), 6), b) for b, y in v if y))[:5]
        assert [(-r["score"], r["doc"]) for r in sorted(tops, key=lambda r: r["rank"]) if r["qid"] == i] == own
    assert dense.scan(queries.limit(0), vectors).count() == 0 and dense.scan(queries, vectors.limit(0)).count() == 0


def test_encoder_hook(spark):
    df = spark.createDataFrame([(1, "abba"), (2, None), (None, "zz")], "id int, text string")
    rows = dense.encode(df, "id", F.col("text"), dense.letter_counts, 26, prefix="").collect()
    by = {r["id"]: r["v"] for r in rows}
    assert abs(by[1][0] - 2**-0.5) < 1e-6 and not any(by[2]) and by[None][25] == 1
    with pytest.raises(Exception, match="the encoder gave"):
        dense.encode(df, "id", F.col("text"), dense.letter_counts, 5).collect()


def test_matrix_files(spark, tmp_path):
    v = spark.createDataFrame([(i, [float(i), i / 2, -1.0]) for i in range(50)], "key int, v array<float>")
    meta = sinks.matrix_files(packing.half_matrix(v, "key", "v"), str(tmp_path), 3, "key")
    assert meta["count"] == 50 and json.loads((tmp_path / "meta.json").read_text()) == meta and np.load(tmp_path / "matrix.npy").shape == (50, 3)
    keys = json.loads((tmp_path / "keys.json").read_text())
    assert keys == sorted(keys) and [r["vector"][0] for r in readers.matrix(spark, str(tmp_path / "matrix.npy")).orderBy("row").collect()] == [float(k) for k in keys]
    np.save(tmp_path / "flat.npy", np.zeros(4))
    with pytest.raises(ValueError):
        readers.matrix(spark, str(tmp_path / "flat.npy"))


def test_key_at(spark):
    s = spark.createDataFrame([(1, 3), (2, 0), (3, 2)], "major int, units int")
    at = spark.createDataFrame([(1,), (3,), (4,), (5,), (6,)], "at bigint")
    assert sorted((r["at"], r["major"], r["minor"]) for r in enrich.key_at(at, "at", s, "major", "units").collect() if r["major"]) == [(1, 1, 1), (3, 1, 3), (4, 3, 1), (5, 3, 2)]


def test_sizes(spark):
    assert is_small(spark.range(10)) and not is_small(spark.range(10), most=9)
    wide = spark.range(1000).select(F.array_repeat(F.lit(0.5), 1000).alias("v"), F.lit("x" * 100).alias("t"), F.struct(F.lit("y")).alias("s"))
    assert is_small(wide) and not is_small(wide, most_bytes=1_000_000)


def test_schema_errors():
    schema = {"type": ["object", "null"], "properties": {"a": {"enum": [1, 2]}, "b": {"const": "x"}, "c": {"type": "number", "maximum": 3}, "d": {"type": "array", "maxItems": 1}}}
    assert validation.schema_errors(None, schema) == [] and validation.schema_errors({"a": 3, "b": "y", "c": True, "d": [1, 2]}, schema) == [("/a", "enum"), ("/b", "const"), ("/c", "type"), ("/d", "maxItems")]
    assert validation.schema_errors({"c": 4}, schema) == [("/c", "maximum")] and validation.schema_errors(1, False) == [("", "false")]


def test_numbered_over_ranges(spark, monkeypatch):
    """Rows of ranges whose bounds come from a sample; a plan that draws or joins its ranges twice gives rows twice or not at all."""
    n, whole = 30_000, "spark.sql.adaptive.coalescePartitions.enabled"
    v = spark.range(n, numPartitions=6).select(F.col("id").alias("key"), F.array_repeat(F.rand(3).cast("float"), 64).alias("v"))
    want = {str(k): i for i, k in enumerate(sorted(map(str, range(n))))}
    spark.conf.set(whole, "false")
    try:
        for ranges in (packing.RANGE, 2_000):
            monkeypatch.setattr(packing, "RANGE", ranges)
            got = packing.half_matrix(v, "key", "v").join(v.select("key"), "key").select("row", "key", F.length("bytes").alias("n")).collect()
            assert len(got) == n and {str(r["key"]): r["row"] for r in got} == want and {r["n"] for r in got} == {128}
    finally:
        spark.conf.unset(whole)
    odd = spark.createDataFrame([(None,), ("b",), (None,), ("a",), ("b",)], "key string")
    monkeypatch.setattr(packing, "RANGE", 1)
    assert sorted(((r["row"], r["key"]) for r in packing.numbered(odd, "key").collect()), key=lambda x: x[0]) == [(0, None), (1, None), (2, "a"), (3, "b"), (4, "b")]


def _random_docs(spark, repeat=False):
    rng = np.random.default_rng(5)
    texts = [(i // 2 if repeat else i, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, int(rng.integers(0, 30))) % 60)) for i in range(300)]
    return spark.createDataFrame([*texts, (None, "w1 w2 w2"), (7000, None), (7001, "")], "id int, text string").repartition(5)


@pytest.mark.parametrize("repeat", [False, True])
def test_counts_stay_with_their_documents(spark, tmp_path, monkeypatch, repeat):
    """The written index has a row a document, and its postings, idf and means are those of grouping all tokens."""
    monkeypatch.setattr(bm25, "COUNTED", 50)
    docs, fields = _random_docs(spark, repeat), {"t": F.filter(F.split("text", " "), lambda t: t != ""), "u": F.slice(F.split("text", " "), 1, 2)}
    bm25.write_index(docs, "id", fields, str(tmp_path / "ix"), cut=False)
    ix, plain = bm25.read_index(spark, str(tmp_path / "ix")), bm25.index(docs, "id", fields)
    rows = lambda df: sorted(tuple(str(round(x, 9) if isinstance(x, float) else x) for x in r) for r in df.collect())
    for name in ("tf", "idf", "stats"):
        columns = getattr(plain, name).columns
        assert rows(getattr(ix, name).select(*columns)) == rows(getattr(plain, name))
    assert rows(ix.doclen) == rows(plain.doclen) and ix.buckets == 1
    if not repeat:
        assert ix.docs.count() == ix.docs.select("field", "doc").distinct().count()


@pytest.mark.parametrize(("queries", "cells"), [(256, 4_000_000), (3, 100)])
def test_best_of_a_batch(spark, tmp_path, monkeypatch, queries, cells):
    """Blocks of documents and of queries give the best rows that scoring all pairs gives, ties at the last place included."""
    monkeypatch.setattr(bm25, "QUERIES", queries)
    monkeypatch.setattr(bm25, "CELLS", cells)
    docs = _random_docs(spark)
    docs = docs.union(docs.withColumn("id", F.col("id") + 10_000))  # every text twice: ties everywhere
    bm25.write_index(docs, "id", {"t": F.filter(F.split("text", " "), lambda t: t != "")}, str(tmp_path / "ix"), cut=False)
    ix = bm25.read_index(spark, str(tmp_path / "ix"))
    rng = np.random.default_rng(6)
    asked = [(q, "t", f"w{int(t)}") for q in range(10) for t in rng.integers(0, 70, 4)] + [(90, "t", "none"), (91, "t", "w59"), (92, "u", "w1")]
    q = spark.createDataFrame(asked, "qid int, field string, token string")
    ranked = lambda df, k, by: sorted((r["qid"], r["rank"], r["doc"], round(r[by], 6)) for r in bm25.top(df, k, by).collect())
    for k in (3, 40, 2000):
        few = bm25.best(q, ix, k, 4)
        every = bm25.score(q, ix)
        assert ranked(few.withColumn("score", F.round("score", 4)), k, "score") == ranked(every.withColumn("score", F.round("score", 4)), k, "score")
        over = lambda df, few: bm25.over_max(df, "score", ["qid"], "base", few).withColumn("base", F.round("base", 6))
        assert ranked(over(bm25.best(q, ix, k, 6, scaled=True), True), k, "base") == ranked(over(every, False), k, "base")
    assert bm25.best(q, ix, 3, 4).count() < every.count() / 4
    assert bm25.best(q.where("qid = 90"), ix, 3, 4).count() == 0 and bm25.best(q.limit(0), ix, 3, 4).count() == 0
