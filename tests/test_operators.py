"""Operators on hand-made cases, next to the oracle comparison of tests/test_oracles.py."""

import math

from pyspark.sql import functions as F

from passagemill.operators import bm25, dense, enrich, evaluation, packing, references, topics, validation
from passagemill.plans import queries as Q


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_bm25_formula(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"]), (3, ["c", "b"])], "id int, toks array<string>")
    ix = bm25.index(docs, "id", {"t": F.col("toks")})
    idf = {"a": math.log(2.5) - math.log(1.5), "b": math.log(0.5) - math.log(3.5), "c": math.log(2.5) - math.log(1.5)}
    idf["b"] = 0.25 * sum(idf.values()) / 3
    q = spark.createDataFrame([("q", "t", "a"), ("q", "t", "a"), ("q", "t", "b"), ("q", "t", "zzz")], "qid string, field string, token string")
    got = {r["doc"]: r["score"] for r in bm25.score(q, ix).collect()}
    part = lambda i, f, dl: i * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / 2))
    want = {1: 2 * part(idf["a"], 2, 3) + part(idf["b"], 1, 3), 2: part(idf["b"], 1, 1), 3: part(idf["b"], 1, 2)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_synonyms_scripts_stopwords(spark):
    t = spark.createDataFrame([(1, "prayer"), (1, "salah")], "qid int, token string")
    assert sorted(r[1] for r in bm25.expand_synonyms(t).collect()) == sorted(["prayer", "salah", "salah", "salat", "صلاة", "نماز", "prayer"])
    q = spark.createDataFrame([(1, ["light"]), (2, ["صبر", "light"]), (3, ["صبر"])], "qid int, tokens array<string>")
    got = {(r["qid"], r["field"], r["script"]) for r in bm25.script_fields(q).collect()}
    assert {f for i, f, _ in got if i == 1} == {"english", "mix"} and {f for i, f, _ in got if i == 3} == {"arabic", "urdu", "mix"} and {f for i, f, s in got if i == 2} == set(bm25.FIELDS)
    assert {s for _, _, s in got} == {"latin", "mixed", "arabic"}


def test_references(spark):
    got = {r["qid"]: tuple(r)[2:] for r in Q.ref_parse_aliases(spark, "").collect()}
    assert got[1] == ("ref_pair", 2, 3, None, 1.0)
    assert got[2] == ("ref_range_same_surah", 3, 1, 4, 1.0)
    assert got[11] == ("ref_range_same_surah", 10, 2, 4, 1.0)
    assert got[12][:4] == ("verse_ref_words", 2, 2, None)  # the range's end is lost
    assert got[8] == ("surah_only_number", 9, 1, None, 0.85)
    assert got[9][0] is None and got[10][0] is None and got[13][0] is None
    assert got[19] == ("nickname", 2, 255, None, 1.0)
    assert got[20] == ("surah_name", 1, 1, None, 0.75)
    assert got[21] == ("surah_name", 2, 3, None, 0.75)  # three words without a structure word: 0.65 + 0.1
    assert got[22] == ("surah_name", 24, 1, None, 0.6)
    assert got[23] == ("surah_name", 24, 1, None, 0.75)
    assert got[24][0] is None  # loose aliases need a structure word


def test_reference_counts_and_flags(spark):
    q = spark.createDataFrame([(1, "1:8"), (2, "1:7"), (3, "verse 1:2-5"), (4, "٢:٣")], "qid int, raw string")
    kind = "alias string, major int"
    none = spark.createDataFrame([], kind)
    counts = spark.createDataFrame([(1, 7), (2, 9)], "major int, units int")
    got = {r["qid"]: r["ref"] for r in references.parse(q, {}, none, none, counts).collect()}
    assert got[1] is None and got[2]["minor"] == 7 and got[3]["minor_end"] is None and (got[4]["major"], got[4]["minor"]) == (2, 3)
    flagged = references.ReferenceConfig(keep_range_after_word=True)
    assert {r["qid"]: r["ref"] for r in references.parse(q, {}, none, none, counts, flagged).collect()}[3]["minor_end"] == 5


def test_phrases(spark):
    cases = [
        (["a", "x", "x", "b"], ["a", "b"], True, True), (["a", "x", "x", "x", "b"], ["a", "b"], False, False), (["a", "b", "a"], ["b", "a"], True, True),
        (["a", "x", "x", "x", "a", "b"], ["a", "b"], False, True), (["a"], [], False, False), ([], ["a"], False, False), (["x", "x", "x", "x", "a"], ["a"], True, True),
    ]
    df = spark.createDataFrame([(i, s, p) for i, (s, p, _, _) in enumerate(cases)], "i int, s array<string>, p array<string>")
    got = df.select("i", topics.phrase_in(F.col("s"), F.col("p")).alias("greedy"), topics.phrase_in(F.col("s"), F.col("p"), backtrack=True).alias("all")).orderBy("i").collect()
    assert [(r["greedy"], r["all"]) for r in got] == [(g, a) for *_, g, a in cases]


def test_islands_and_passages(spark):
    k = spark.createDataFrame([("t", 1, n) for n in (1, 2, 3, 5, 9, 10)] + [("t", 2, 4)], "topic string, major int, minor int")
    blocks = topics.islands(k, ["topic"], "major", "minor")
    assert rows(blocks.select("major", "first", "last", "n")) == [(1, 1, 3, 3), (1, 5, 5, 1), (1, 9, 10, 2), (2, 4, 4, 1)]
    got = topics.passages_mentions(blocks, ["topic"], "major", 2).orderBy("rank").select("major", "first", "kind").collect()
    assert [tuple(r) for r in got] == [(1, 1, "passage"), (1, 9, "passage"), (1, 5, "mention"), (2, 4, "mention")]


def test_topics_keep_anchors(spark):
    found = spark.createDataFrame([("t", 1, n) for n in range(1, 6)], "topic string, major int, minor int")
    anchors = spark.createDataFrame([("t", 9, 9), ("t", 1, 2)], "topic string, major int, minor int")
    bad = spark.createDataFrame([("t", 1, 1), ("t", 1, 2)], "topic string, major int, minor int")
    assert rows(topics.build_topics(found, anchors, bad, 3).select("major", "minor", "is_anchor")) == [(1, 2, True), (1, 3, False), (9, 9, True)]


def test_metrics(spark):
    run = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "qid string, doc string, rank int")
    grades = spark.createDataFrame([("q", "b", 3.0), ("q", "c", 1.0), ("q", "z", 2.0), ("n", "a", 1.0)], "qid string, doc string, grade double")
    got = {r["qid"]: r for r in evaluation.metrics(run, grades, 3, true_recall=True).collect()}
    q = got["q"]
    assert (q["p1"], q["hit"], q["rr"]) == (0, 1, 0.5) and abs(q["ap"] - (1 / 2 + 2 / 3) / 3) < 1e-9 and abs(q["recall"] - 2 / 3) < 1e-9
    dcg, idcg = 7 / math.log2(3) + 1 / 2, 7 + 3 / math.log2(3) + 1 / 2
    assert abs(q["ndcg"] - dcg / idcg) < 1e-9 and got["n"]["rr"] == 0
    judged = spark.createDataFrame([("1", "2:1"), ("2", '["2:1", "2:2"]'), ("3", '{"2:1": 3, "2:2": "x"}')], "qid string, expected string")
    assert rows(evaluation.coerce_grades(judged)) == [("1", "2:1", 1.0), ("2", "2:1", 1.0), ("2", "2:2", 1.0), ("3", "2:1", 3.0), ("3", "2:2", 1.0)]


def test_latency(spark):
    import statistics

    few, many = [5.0, 1.0, 9.0], [float(x * x % 97) for x in range(60)]
    df = spark.createDataFrame([("few", v) for v in few] + [("many", v) for v in many], "k string, v double")
    got = {r["k"]: r for r in evaluation.latency(df, "v", ["k"]).collect()}
    assert got["few"]["p95"] == 9 and abs(got["many"]["p95"] - statistics.quantiles(many, n=20)[18]) < 1e-9


def test_hybrid_missing_sides(spark):
    lex = spark.createDataFrame([("q", 1, 2.0), ("q", 2, 1.0)], "qid string, doc int, score double")
    sem = spark.createDataFrame([("q", 2, 0.9), ("q", 3, 0.8)], "qid string, doc int, score double")
    got = {r["doc"]: r["rrf"] for r in dense.rrf(dense.merge(lex, sem)).collect()}
    assert got == {1: round(0.7 / 61, 6), 2: round(0.7 / 62 + 0.3 / 61, 6), 3: round(0.3 / 62, 6)}


def test_chunks(spark):
    df = spark.createDataFrame([("f", i, s) for i, s in enumerate([4, 4, 50, 3, 3, 3])], "file string, at bigint, size bigint")
    assert [r["chunk"] for r in packing.chunk_ids(df, "file", "at", "size", 14).orderBy("at").collect()] == [0, 0, 1, 2, 2, 2]
    assert [r["chunk"] for r in packing.chunk_ids(df, "file", "at", "size", 10).orderBy("at").collect()] == [0, 1, 2, 3, 3, 4]


def test_ranges_and_maps(spark):
    r = spark.createDataFrame([("a", 0, 9, 0), ("b", 5, 30, 1)], "name string, lo bigint, hi bigint, ord int")
    d = spark.createDataFrame([(1, 5), (2, 30), (3, 31)], "id int, at bigint")
    assert rows(enrich.with_ranges(d, "at", r, 4).select("id", "name")) == [(1, "a"), (2, "b"), (3, None)]
    t = spark.createDataFrame([("1:1", "en", "x", "X"), ("1:1", "en", "a", "A"), ("1:2", "en", "a", None)], "key string, lang string, translator string, text string")
    assert enrich.translations(t).first()["texts"] == {"a": "A", "x": "X"}
    assert rows(enrich.missing_translations(t, t)) == [("x", "1:2")]


def test_validation(spark):
    found = {r["code"] for r in Q.range_validation(spark, "").collect()}
    assert found == {"E_JUZ_DUP", "E_JUZ_NUM_TYPE", "E_JUZ_NUM_RANGE", "E_VERSEKEY_AYAH_RANGE_END", "E_VERSEKEY_START", "E_JUZ_CONTIGUITY"}
    issues = spark.createDataFrame([("warning", "W", "m", "p")], "level string, code string, message string, path string")
    assert validation.exit_status(issues).first()[0] == 0 and validation.exit_status(issues, strict=True).first()[0] == 2
    a = spark.createDataFrame([(1, 7), (2, 3)], "major int, units int")
    b = spark.createDataFrame([(1, 7), (2, 4), (3, 1)], "major int, units int")
    assert rows(validation.compare_counts(a, b).select("path", "message")) == [("2", "3 vs 4"), ("3", "none vs 1")]


def test_alias_targets(spark):
    t = spark.createDataFrame([("x", "1:2-4, 3, 5-6, 2:7,nope")], "alias string, target string")
    assert [(r["ord"], r["major"], r["minor"]) for r in references.expand_targets(t).orderBy("ord", "major", "minor").collect()] == [(0, 1, 2), (0, 1, 3), (0, 1, 4), (1, 3, 1), (2, 5, 1), (2, 6, 1), (3, 2, 7)]


def test_wrapped_and_keyed_chunks(spark):
    df = spark.createDataFrame([("f", i, f'"k{i}"', "[1]") for i in range(4)], "file string, at bigint, key string, j string").withColumn("key", F.regexp_replace("key", '"', ""))
    got = rows(packing.keyed_chunks(df, "file", "at", "key", "j", 20).select("chunk", "value"))
    assert got == [(0, '{"k0":[1],"k1":[1]}'), (1, '{"k2":[1],"k3":[1]}')]
    lines = spark.createDataFrame([("f", 0, "abc"), ("f", 1, " "), ("f", 2, "abc"), ("f", 3, "abc")], "file string, at bigint, line string")
    assert rows(packing.line_chunks(lines, "file", "at", "line", 8).select("at", "chunk")) == [(0, 0), (2, 0), (3, 1)]
    assert packing.translation_seed(0, None) == 1337 and packing.translation_seed(5, "x") == 5


def test_pack_rules(spark):
    t = spark.createDataFrame([("t", "a", "1:1"), ("t", "a", "1:1"), ("t", "b", None)], "template string, section string, key string")
    assert {r["code"] for r in validation.templates(t).collect()} == {"E_TEMPLATE_SECTION_EMPTY", "E_TEMPLATE_DUP"}
    r, i = (spark.createDataFrame([(0, "1:1"), (1, k)], "row bigint, key string") for k in ("1:2", "1:3"))
    assert {x["code"] for x in validation.pack_integrity(r, i, 16, 4, 2).collect()} == {"E_PACK_ALIGNMENT"}
    keys = spark.createDataFrame([("t", 1, 1, 2), ("t", 2, 1, 1), ("t", 3, 9, 9)], "topic string, place int, major int, minor int")
    corpus = spark.createDataFrame([(1, 1), (1, 2)], "major int, minor int")
    assert {x["code"] for x in validation.compiled_topics(keys.select("topic").distinct(), keys, corpus).collect()} == {"E_TOPIC_ORDER", "E_TOPIC_UNKNOWN"}


def test_compile_and_fill(spark):
    post = spark.createDataFrame([("en", 1, "light"), ("ar", 2, "نور"), ("en", 3, "light"), ("en", 3, "dark")], "lang string, doc int, token string")
    trig = spark.createDataFrame([("light", "en", "light"), ("light", "ar", "نور"), ("person", "en", "light"), ("person", "ar", "نور")], "topic string, lang string, token string")
    kinds = spark.createDataFrame([("light", "topic"), ("person", "entity")], "topic string, kind string")
    neg = spark.createDataFrame([("light", "en", "dark")], "topic string, lang string, token string")
    assert rows(topics.compile_topics(post, trig, neg, kinds)) == [("light", 1), ("light", 2), ("person", 2)]
    groups = spark.createDataFrame([("t", "g", 1, 1), ("t", "empty", None, None)], "topic string, group string, major int, minor int")
    anchors = spark.createDataFrame([("t", 7, 7)], "topic string, major int, minor int")
    assert rows(topics.fill_groups(groups, anchors)) == [("t", "empty", 7, 7), ("t", "g", 1, 1)]
    assert ("siraat", "sirat") in rows(topics.rule_variants(spark.createDataFrame([("siraat",)], "canonical string")))


def test_phrase_source_lookup_inside_words(spark, tmp_path):
    import duckdb

    from passagemill import catalog

    passages = ["the red fox ran far", "grey", "two words", "one of three", "A  b c d e f g h i", None]
    texts = ['he said "the red fox ran far" twice', "(the red fox ran farther", "greyish", "atwo wordsmith", "-one of threes", "(a b\nc d e f g h in", "the red fox ran", "", None, "none of  three words"]
    spark.createDataFrame(list(enumerate(passages)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for t in ("benchmark", "documents"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = set(con.sql(catalog.ORACLE_SQL["phrase_source_lookup"]).fetchall())
    assert want == {(0, 0), (1, 0), (2, 1), (3, 2), (4, 3), (5, 4), (9, 3)}
    assert {tuple(r) for r in catalog.QUERIES["phrase_source_lookup"](spark, str(tmp_path)).collect()} == want


def test_phrases_copy_few_sequences(spark, monkeypatch):
    """A sequence is copied for first tokens of phrases alone; hits are those of trying every pair."""
    import random

    rng = random.Random(4)
    seqs = [(i, "ab"[i % 2], [f"t{rng.randrange(40)}" for _ in range(30)]) for i in range(60)] + [(100, "a", []), (101, "a", None)]
    phrases = [(p, "ab"[p % 2], [f"t{rng.randrange(42)}" for _ in range(1 + p % 3)]) for p in range(12)] + [(50, "a", [])]
    s, p = spark.createDataFrame(seqs, "doc int, lang string, seq array<string>"), spark.createDataFrame(phrases, "pid int, lang string, phrase array<string>")
    want = rows(s.crossJoin(p.withColumnRenamed("lang", "l")).where("lang = l").where(topics.phrase_in(F.col("seq"), F.col("phrase"))).select("pid", "doc"))
    assert want and rows(topics.phrase_hits(p, s, ["lang"]).select("pid", "doc")) == want
    plan = topics.phrase_hits(p, s, ["lang"])._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" in plan and rows(topics.phrase_hits(p.limit(0), s, ["lang"])) == []
    monkeypatch.setattr(topics, "MOST_FIRSTS", 2)
    assert rows(topics.phrase_hits(p, s, ["lang"]).select("pid", "doc")) == want


def test_pruning_meets_triggers_first(spark):
    """Only vocabulary that some trigger asks for is made distinct."""
    t = spark.createDataFrame([("x", "en", "a"), ("x", "en", "z"), ("y", "de", "a")], "topic string, lang string, token string")
    v = spark.createDataFrame([("en", "a"), ("en", "a"), ("en", "b"), ("fr", "a")], "lang string, token string")
    got = topics.prune_triggers(t, v)
    assert rows(got.select("topic", "lang", "token")) == [("x", "en", "a")]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") == 2


def test_recall_grid_reads_relevant_once(spark):
    run = spark.createDataFrame([(1, 7, 2), (1, 8, 1), (2, 9, 4), (3, 5, 1), (4, 4, 11)], "qid int, doc int, rank bigint")
    relevant = spark.createDataFrame([(1, 7), (1, 7), (1, 6), (2, 9), (4, 4), (5, 1)], "qid int, doc int")
    got = evaluation.recall_grid(run, relevant)
    assert rows(got) == [(4, 0.0, 0.25, 0.5, 0.5, (1 / 2 + 1 / 4) / 4)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2
