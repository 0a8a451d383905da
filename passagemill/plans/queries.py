"""The registered queries: every operator over whole driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from passagemill.functions import text as T
from passagemill.functions import values as V
from passagemill.functions import vectors
from passagemill.operators import bm25, dense, enrich, evaluation, packing, references, response, topics, validation
from passagemill.operators.sizes import small
from passagemill.plans import inputs as I
from passagemill.sources import storage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs_of(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents")


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- text ------------------------------------------------------------------------------------------


def tokens_latin(spark, sf_dir):
    words = T.tokenize_lat(F.col("text"), compat=False)
    return docs_of(spark, sf_dir).select("doc_id", words.alias("w")).select(
        "doc_id", F.size("w").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("w")).cast("bigint").alias("n_distinct"), F.try_element_at("w", F.lit(1)).alias("first_token")
    )


def tokens_unicode(spark, sf_dir):
    words = docs_of(spark, sf_dir).select("lang", F.explode(T.tokens_unicode(F.lower("text"))).alias("token"))
    return words.groupBy("lang").agg(F.count(F.lit(1)).alias("n_tokens"), F.countDistinct("token").alias("n_distinct"))


def normalize_ws_case(spark, sf_dir):
    norm = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    return docs_of(spark, sf_dir).select("doc_id", F.length(norm).cast("bigint").alias("n"), V.sha256(norm).alias("sha"))


def clamp_text(spark, sf_dir):
    clamped = T.clamp(F.col("text"))
    return docs_of(spark, sf_dir).select("doc_id", F.length(clamped).cast("bigint").alias("n"), V.sha256(clamped).alias("sha"))


def searchable_text(spark, sf_dir):
    text = T.pack_text(F.col("doc_id").cast("string"), F.col("lang"), F.lit(""), F.col("source"), F.col("text"), compat=False)
    return docs_of(spark, sf_dir).select("doc_id", F.length(text).cast("bigint").alias("n"), V.sha256(text).alias("sha"))


def letter_fold(spark, sf_dir):
    rows = spark.createDataFrame(I.LETTER_ROWS, "id int, raw string")
    plain = T.Normalization(nfkc=False, marks=True, casefold=False)
    folded = T.Normalization(nfkc=False, marks=True, casefold=False, teh_marbuta=True, drop_hamza=True)
    return rows.select("id", T.normalize(F.col("raw"), plain).alias("search"), T.normalize(F.col("raw"), folded).alias("aggressive"))


def lang_hint(spark, sf_dir):
    inline = spark.createDataFrame([(i, r) for i, r in I.LETTER_ROWS], "id int, raw string").select(F.col("id").cast("bigint").alias("id"), "raw")
    both = inline.union(docs_of(spark, sf_dir).select((F.col("doc_id") + 1000).alias("id"), "text"))
    return both.select("id", T.lang_hint(F.col("raw")).alias("hint"))


def nfkc_fold(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", V.sha256(T.normalize(F.col("html"))).alias("sha"), F.length(T.nfkc(F.col("html"))).cast("bigint").alias("n"))


def synonym_expand(spark, sf_dir):
    terms = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.explode(T.latin_terms(F.col("text"))).alias("token"))
    return bm25.expand_synonyms(terms, I.SYNONYMS).groupBy("qid", "token").agg(F.count(F.lit(1)).alias("n"))


def stopword_adaptive(spark, sf_dir):
    terms = table(spark, sf_dir, "benchmark").select("item_id", T.latin_terms(F.col("text")).alias("t"))
    kept = bm25.drop_stopwords(F.col("t"), T.QUERY_STOPWORDS)
    return terms.select("item_id", F.size("t").cast("bigint").alias("n_before"), F.size(kept).cast("bigint").alias("n_after"))


# --- lexical ---------------------------------------------------------------------------------------


def _index(spark, sf_dir, fields: dict[str, Column] | None = None, name: str = "text") -> bm25.Index:
    """Built by the first query that needs it, and read by the others until the documents change."""
    key = f"{name}:{storage.stamp(spark, f'{sf_dir}/documents.parquet')}"
    return bm25.kept_index(docs_of(spark, sf_dir), "doc_id", fields or {"text": T.latin_terms(F.col("text"))}, key)


def _terms(spark, field: str = "text") -> DataFrame:
    return spark.createDataFrame([(q, field, t) for q, ts in I.TERMS.items() for t in ts], "qid string, field string, token string")


def corpus_stats(spark, sf_dir):
    words = T.latin_terms(F.col("text"))
    return docs_of(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n_docs"), F.countDistinct("source").alias("n_sections"), F.sum(F.size(words)).alias("n_tokens"), F.round(F.avg(F.size(words)), 4).alias("avgdl")
    )


def doc_freq(spark, sf_dir):
    return _index(spark, sf_dir).tf.groupBy("token").agg(F.countDistinct("doc").alias("n"), F.sum("f").alias("cf"))


def idf_table(spark, sf_dir):
    return rounded(_index(spark, sf_dir).idf.select("token", "n", "idf"), 6, "idf")


def bm25_topk(spark, sf_dir):
    got = bm25.score(_terms(spark), _index(spark, sf_dir))
    return bm25.top(rounded(got, 4, "score"), 20).select("qid", "doc", "score", "rank")


FIELDED = {"body": 0.65, "src": 0.25, "lng": 0.20, "mix": 0.90}


def bm25_fielded(spark, sf_dir):
    fields = {
        "body": T.latin_terms(F.col("text")), "src": T.latin_terms(F.col("source")), "lng": T.latin_terms(F.col("lang")),
        "mix": T.latin_terms(F.concat_ws(" ", "source", "lang", "text")),
    }
    queries = spark.createDataFrame([(q, t) for q, ts in I.FIELD_TERMS.items() for t in ts], "qid string, token string")
    weighed = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.lit(w).alias("weight")) for f, w in FIELDED.items()))).alias("x")
    each = queries.select("qid", "token", weighed).select("qid", "token", "x.*")
    scores = bm25.score(each.select("qid", "field", "token"), _index(spark, sf_dir, fields, "fielded"))
    base = bm25.combine_fields(scores, each.select("qid", "field", "weight").distinct())
    return bm25.top(rounded(base, 4, "base"), 50, "base").select("qid", "doc", "base", "rank")


def _norm(c: str) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def bm25_rerank_boosts(spark, sf_dir):
    docs, items = docs_of(spark, sf_dir), table(spark, sf_dir, "benchmark")
    q = items.select(F.col("item_id").alias("qid"), _norm("text").alias("norm"), T.latin_terms(F.col("text")).alias("tokens"))
    terms = q.select("qid", F.lit("text").alias("field"), F.explode("tokens").alias("token"))
    most = bm25.Bm25Config.top_candidates
    scores = rounded(bm25.over_max(bm25.best(terms, _index(spark, sf_dir), most, 6, scaled=True), "score", ["qid"], "base", few=True), 6, "base")
    candidates = bm25.top(scores, most, "base").select("qid", "doc", "base")
    d = docs.select(F.col("doc_id").alias("doc"), "text")
    got = bm25.rerank(candidates, q, d, norm=_norm("text"), tokens=T.latin_terms(F.col("text")))
    return bm25.top(rounded(got, 6, "score"), 10).select("qid", "doc", "score", "rank")


def phrase_source_lookup(spark, sf_dir):
    """Documents that contain a benchmark passage: an equi-join on each passage's inner words, then the exact test."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    items = table(spark, sf_dir, "benchmark").select("item_id", norm("text").alias("p")).withColumn("k", F.least(F.lit(5), F.size(F.split("p", " ")) - 2))
    # A passage may start and end inside longer words, so the anchor has neither its first word nor its last.
    anchored = items.where("k > 0").withColumn("anchor", F.concat_ws(" ", F.slice(F.split("p", " "), 2, F.col("k"))))
    ks = sorted(r[0] for r in anchored.select("k").distinct().collect())  # five at most
    docs = docs_of(spark, sf_dir).select("doc_id", norm("text").alias("n"))
    grams = lambda k: F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.concat_ws(" ", F.slice("w", i, F.lit(k))))
    starts = F.array_distinct(F.flatten(F.array(*(F.when(F.size("w") >= k, grams(k)).otherwise(F.array()) for k in ks), F.array().cast("array<string>"))))
    # Grams leave the scan with ids alone; texts are fetched for what they hit.
    keys = docs.select("doc_id", F.split("n", " ").alias("w")).select("doc_id", F.explode(starts).alias("anchor"))
    met = keys.join(small(anchored.select("anchor", "item_id", "p")), "anchor").select("doc_id", "item_id", "p").distinct()
    hits = docs.join(met, "doc_id").where(F.contains(F.col("n"), F.col("p")))
    # Passages of one or two words have no inner ones, and are sought in all documents.
    short = docs.join(small(items.where("k <= 0")), F.contains(F.col("n"), F.col("p")))
    return hits.select("doc_id", "item_id").union(short.select("doc_id", "item_id")).distinct()


def occurrence_count(spark, sf_dir):
    post = bm25.postings(docs_of(spark, sf_dir), "doc_id", {"text": T.latin_terms(F.col("text"))})
    return bm25.occurrences(post, I.COUNTED)


def occurrence_list(spark, sf_dir):
    post = bm25.postings(docs_of(spark, sf_dir), "doc_id", {"text": T.latin_terms(F.col("text"))})
    return post.where(F.col("token").isin(I.LISTED)).select("token", "doc", F.col("pos").cast("bigint").alias("pos"))


# --- references ------------------------------------------------------------------------------------

CFG = references.ReferenceConfig(compat=False)


def _parsed(spark, nicknames=None, strict=(), loose=()):
    q = spark.createDataFrame(I.REFERENCES, "qid int, raw string")
    kind = "alias string, major int"
    return references.parse(q, nicknames or {}, spark.createDataFrame(list(strict), kind), spark.createDataFrame(list(loose), kind), cfg=CFG)


def ref_parse_pairs(spark, sf_dir):
    return _parsed(spark).where("ref is not null").select("qid", F.col("ref.type").alias("kind"), F.col("ref.major").alias("major"), F.col("ref.minor").alias("minor"), F.col("ref.minor_end").alias("minor_end"), F.col("ref.confidence").alias("confidence"))


def ref_parse_aliases(spark, sf_dir):
    """Nicknames and aliases too; checked by hand-made cases in the tests."""
    return _parsed(spark, I.NICKNAMES, I.STRICT, I.LOOSE).select("qid", "raw", "ref.*")


def _turns(spark, sf_dir) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    return t.select((F.col("conv_id") + 1).cast("int").alias("major"), (F.col("turn") + 1).cast("int").alias("minor"), "role", F.length("text").cast("bigint").alias("n_chars"))


def ref_range_expand(spark, sf_dir):
    return references.expand(_parsed(spark), _turns(spark, sf_dir)).select("qid", "major", "minor", "role", "n_chars")


def alias_expand(spark, sf_dir):
    targets = spark.createDataFrame(I.TARGETS, "alias string, target string")
    hit = references.expand_targets(targets)
    return hit.join(_turns(spark, sf_dir), ["major", "minor"]).select("alias", F.col("ord").cast("bigint").alias("ord"), "major", "minor", "role")


def intent_route(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select((F.col("item_id") + 1000).cast("int").alias("qid"), F.col("text").alias("raw"))
    q = spark.createDataFrame([*I.REFERENCES, (900, ""), (901, "opening")], "qid int, raw string").union(items)
    kind = "alias string, major int"
    parsed = references.parse(q, {}, spark.createDataFrame([], kind), spark.createDataFrame([], kind), cfg=CFG)
    turns = _turns(spark, sf_dir)
    aliased = references.lookup_aliases(q, spark.createDataFrame(I.TARGETS, "alias string, target string"), compat=False).join(turns.select("major", "minor"), ["major", "minor"], "left_semi")
    return references.route(parsed, references.expand(parsed, turns), aliased)


# --- dense and hybrid ------------------------------------------------------------------------------


def _vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("v"))


def _query_vectors(spark, sf_dir) -> DataFrame:
    q = spark.createDataFrame([(name, i) for i, name in enumerate(I.TERMS)], "qid string, doc bigint")
    return _vectors(spark, sf_dir).join(F.broadcast(q), "doc").select("qid", F.col("v").alias("q"))


def cosine_topk(spark, sf_dir):
    got = dense.scan(_query_vectors(spark, sf_dir), _vectors(spark, sf_dir), 10)
    return bm25.top(got, 10).select("qid", "doc", "score", "rank")


def cosine_candidates(spark, sf_dir):
    lexical = bm25.top(rounded(bm25.score(_terms(spark), _index(spark, sf_dir)), 4, "score"), 80)
    return rounded(dense.scan_candidates(_query_vectors(spark, sf_dir), _vectors(spark, sf_dir), lexical), 6, "score")


def _both(spark, sf_dir) -> DataFrame:
    lexical = bm25.top(rounded(bm25.score(_terms(spark), _index(spark, sf_dir)), 4, "score"), dense.HybridConfig.lexical_top)
    known = docs_of(spark, sf_dir).select(F.col("doc_id").alias("doc"))
    vectors = _vectors(spark, sf_dir).join(known, "doc", "left_semi")
    semantic = bm25.top(dense.scan(_query_vectors(spark, sf_dir), vectors, dense.HybridConfig.semantic_top), dense.HybridConfig.semantic_top)
    return dense.merge(lexical, semantic)


def hybrid_rrf(spark, sf_dir):
    return dense.rrf(_both(spark, sf_dir)).select("qid", "doc", "bm25", "semantic", "rrf", "rank")


def hybrid_minmax(spark, sf_dir):
    return dense.weighted_min_max(_both(spark, sf_dir)).select("qid", "doc", "fused")


def lexical_mode(spark, sf_dir):
    lexical = bm25.top(rounded(bm25.score(_terms(spark), _index(spark, sf_dir)), 4, "score"), dense.HybridConfig.lexical_top)
    return dense.lexical_only(lexical).select("qid", "doc", "bm25", "rank")


def batch_hybrid(spark, sf_dir):
    """Every benchmark item as a query, in one plan; its vector is the one with its number."""
    items = table(spark, sf_dir, "benchmark")
    terms = items.select(F.col("item_id").alias("qid"), F.lit("text").alias("field"), F.explode(T.latin_terms(F.col("text"))).alias("token"))
    lexical = bm25.top(rounded(bm25.best(terms, _index(spark, sf_dir), dense.HybridConfig.lexical_top, 4), 4, "score"), dense.HybridConfig.lexical_top)
    vectors = _vectors(spark, sf_dir)
    q = vectors.join(small(items.select(F.col("item_id").alias("doc"))), "doc", "left_semi").select(F.col("doc").alias("qid"), F.col("v").alias("q"))
    known = vectors.join(docs_of(spark, sf_dir).select(F.col("doc_id").alias("doc")), "doc", "left_semi")
    semantic = bm25.top(dense.scan(q, known, dense.HybridConfig.semantic_top), dense.HybridConfig.semantic_top)
    return dense.rrf(dense.merge(lexical, semantic)).where("rank <= 5").select("qid", "doc", "rrf", "rank")


# --- dataset ---------------------------------------------------------------------------------------


def enrich_left_join(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    return enrich.with_sections(c, nations, "n_nationkey", ["n_name", "r_name"]).select("c_custkey", "n_name", "r_name")


def range_bucket_join(spark, sf_dir):
    ranges = spark.createDataFrame(I.RANGES, "name string, lo bigint, hi bigint, ord int")
    return enrich.with_ranges(docs_of(spark, sf_dir).select("doc_id", "n_chars"), "n_chars", ranges, 500)


def pivot_to_map(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).cast("string").alias("text"))
    maps = enrich.translations(counts.withColumn("lang", F.lit("all")), "user_id", "lang", "event_type", "text")
    listed = F.array_join(F.transform(F.map_entries("texts"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return maps.select("user_id", listed.alias("texts"))


def missing_translations(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("translator"))
    return enrich.missing_translations(e.select("key").distinct(), e).select("key", "translator")


def missing_keys_anti(spark, sf_dir):
    return enrich.missing_keys(docs_of(spark, sf_dir).select("doc_id"), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")


def semi_candidates(spark, sf_dir):
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return docs_of(spark, sf_dir).join(good, "doc_id", "left_semi").select("doc_id", "lang")


def alignment_full_outer(spark, sf_dir):
    d = docs_of(spark, sf_dir).select(F.col("doc_id").alias("key"), F.col("doc_id").alias("place"))
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), (F.col("vec_id") + (F.col("vec_id") % 97 == 0).cast("int")).alias("place"))
    return dense.alignment(d, v)


def null_counts(spark, sf_dir):
    return enrich.null_counts(docs_of(spark, sf_dir), ["text", "lang", "source"])


def duplicate_texts(spark, sf_dir):
    return enrich.duplicates(docs_of(spark, sf_dir).select(V.sha256(F.col("text")).alias("sha")), "sha")


def contiguity_check(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("role <> 'assistant'")
    return enrich.gaps(turns, ["conv_id"], "turn", "turn", "turn").select("conv_id", "turn", "before")


def density_check(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("length(text) > 300")
    return enrich.density(turns, "conv_id", "turn", 0)


def cumulative_offsets(spark, sf_dir):
    n = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("units"))
    return enrich.offsets(n, "c_nationkey", "units").select("c_nationkey", "units", "offset")


# --- topics ----------------------------------------------------------------------------------------


def _postings(spark, sf_dir) -> DataFrame:
    d = docs_of(spark, sf_dir)
    return d.select("lang", F.col("doc_id").alias("doc"), F.explode(F.array_distinct(T.latin_terms(F.col("text")))).alias("token"))


def _triggers(spark) -> DataFrame:
    base = spark.createDataFrame(I.TRIGGERS, "topic string, lang string, token string")
    return topics.expand_variants(base, spark.createDataFrame(I.VARIANTS, "canonical string, variant string"))


def trigger_topics(spark, sf_dir):
    return topics.matches(_postings(spark, sf_dir), _triggers(spark))


def _negatives(spark, sf_dir) -> DataFrame:
    return topics.matches(_postings(spark, sf_dir), spark.createDataFrame(I.NEGATIVES, "topic string, lang string, token string"))


def trigger_topics_negative(spark, sf_dir):
    return topics.without_negatives(trigger_topics(spark, sf_dir), _negatives(spark, sf_dir))


def topic_cap(spark, sf_dir):
    return topics.capped(trigger_topics(spark, sf_dir), 40, ["topic"], [F.col("doc")])


def topic_build(spark, sf_dir):
    key = lambda df: df.select("topic", (F.col("doc") / 50).cast("int").alias("major"), (F.col("doc") % 50).cast("int").alias("minor"))
    anchors = spark.createDataFrame(I.ANCHORS, "topic string, major int, minor int")
    return topics.build_topics(key(trigger_topics(spark, sf_dir)), anchors, key(_negatives(spark, sf_dir)), 60)


def trigger_prune(spark, sf_dir):
    return topics.prune_triggers(_triggers(spark), _postings(spark, sf_dir)).select("topic", "lang", "token")


def variant_mining(spark, sf_dir):
    surfaces = docs_of(spark, sf_dir).select(F.explode(T.surface_tokens(F.col("text"))).alias("surface")).distinct().withColumn("norm", F.lower("surface"))
    seeds = spark.createDataFrame(I.SEEDS, "canonical string, variant string")
    return topics.mine_variants(seeds, surfaces).select("canonical", "variant", F.col("ord").cast("bigint").alias("ord"))


def phrase_gap_match(spark, sf_dir):
    phrases = spark.createDataFrame(I.PHRASES, "pid int, phrase array<string>")
    return topics.phrase_hits(phrases, docs_of(spark, sf_dir).select("doc_id", T.latin_terms(F.col("text")).alias("seq"))).select("pid", "doc_id")


def gap_islands(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("length(text) > 200")
    return topics.islands(turns, [], "conv_id", "turn").select("conv_id", "first", "last", "n")


def passages_mentions(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("length(text) > 200").withColumn("topic", (F.col("conv_id") % 8).cast("int"))
    blocks = topics.islands(turns, ["topic"], "conv_id", "turn")
    return topics.passages_mentions(blocks, ["topic"], "conv_id").select("topic", "conv_id", "first", "n", F.col("rank").cast("bigint").alias("rank"), "kind")


# --- evaluation ------------------------------------------------------------------------------------


def _grades(spark, sf_dir) -> DataFrame:
    judged = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("doc"), (F.col("quality") + 2 * F.col("toxic")).cast("double").alias("grade"))
    return judged.withColumn("qid", F.explode(F.array(*map(F.lit, I.TERMS))))


def _run(spark, sf_dir) -> DataFrame:
    return bm25.top(rounded(bm25.score(_terms(spark), _index(spark, sf_dir)), 4, "score"), 10).select("qid", "doc", "rank")


def eval_metrics(spark, sf_dir):
    got = evaluation.metrics(_run(spark, sf_dir), _grades(spark, sf_dir), 10)
    return rounded(got, 6, "p1", "hit", "rr", "ap", "ndcg", "precision", "recall", "f1")


def eval_by_group(spark, sf_dir):
    got = evaluation.metrics(_run(spark, sf_dir), _grades(spark, sf_dir), 10).withColumn("kind", F.when(F.col("qid").isin("q1", "q2"), "a").otherwise("b"))
    return rounded(evaluation.summary(got, ["kind"]), 6, "accuracy", "mean_p1", "mean_rr", "mean_ap", "mean_ndcg")


def latency_percentiles(spark, sf_dir):
    return rounded(evaluation.latency(table(spark, sf_dir, "events"), "value", ["event_type"]), 6, "mean", "median", "p95", "low", "high")


def best_config(spark, sf_dir):
    """All weights of the grid in one plan: ranks of both sides are taken once, and the weight is part of the query's name."""
    each = lambda df: df.withColumn("w", F.explode(F.array(*map(F.lit, I.GRID)))).withColumn("qid", F.concat_ws("|", "w", "qid"))
    ranked = _both(spark, sf_dir).withColumn("rb", dense.stable_rank("bm25")).withColumn("rs", dense.stable_rank("semantic"))
    runs = dense.fuse(each(ranked), 1 - F.col("w"), F.col("w")).select("qid", "doc", "rank")
    got = evaluation.metrics(runs, each(_grades(spark, sf_dir)).drop("w"), 10).withColumn("run", F.split("qid", "\\|")[0].cast("double"))
    rows = evaluation.summary(got, ["run"]).select("run", F.round("accuracy", 6).alias("accuracy"), F.round("mean_rr", 6).alias("mrr"), F.lit(0.0).alias("latency"))
    return evaluation.best_run(rows)


def judgment_pool(spark, sf_dir):
    runs = _run(spark, sf_dir).unionByName(cosine_topk(spark, sf_dir).select("qid", "doc", "rank"))
    texts = docs_of(spark, sf_dir).select(F.col("doc_id").alias("doc"), "text")
    return evaluation.pool(runs, texts, _grades(spark, sf_dir))


# --- validation and packs --------------------------------------------------------------------------


def validation_report(spark, sf_dir):
    units = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("units"))
    n = table(spark, sf_dir, "nation").join(units, "n_nationkey", "left")
    rows = n.select(
        (F.col("n_nationkey") + 1).cast("string").alias("number"), F.lit("").alias("name_ar"), F.col("n_name").alias("name_en"), F.col("n_name").alias("name_tr"),
        F.col("units").cast("string").alias("units"), F.when(F.col("n_regionkey") == 0, "Meccan").otherwise("other").alias("kind"),
    )
    found = validation.sections(rows, validation.Bounds(sections=30, units=286, total=6236))
    return found.groupBy("level", "code").agg(F.count(F.lit(1)).alias("n"))


def range_validation(spark, sf_dir):
    """Rules of ranges over hand-made rows; the tests hold the expected codes."""
    rows = spark.createDataFrame(I.RANGE_ROWS, "number string, start string, end string")
    counts = spark.createDataFrame([(1, 7), (2, 20), (3, 10)], "major int, units int")
    return validation.ranges(rows, counts, validation.Bounds(sections=3, ranges=4)).select("code", "path")


def manifest_hash(spark, sf_dir):
    rows = docs_of(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return packing.manifest(rows)


def manifest_verify(spark, sf_dir):
    listed = manifest_hash(spark, sf_dir)
    broken = listed.withColumn("bytes", F.when(F.col("name").endswith("7"), F.col("bytes") + 1).otherwise(F.col("bytes"))).where(~F.col("name").endswith("13"))
    return packing.verify_manifest(broken, listed)


CHUNK = 100_000


def _chunks(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select((F.col("page_id") % 4).alias("file"), "page_id", F.octet_length("html").cast("bigint").alias("size"))
    return packing.chunk_ids(pages, "file", "page_id", "size", CHUNK).join(pages, ["file", "page_id"])


def size_chunks(spark, sf_dir):
    return _chunks(spark, sf_dir).select("file", "page_id", F.col("chunk").cast("bigint").alias("chunk"))


def chunk_manifest(spark, sf_dir):
    sizes = _chunks(spark, sf_dir).groupBy("file", "chunk").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    return packing.chunk_manifest(sizes, "file")


def display_pick(spark, sf_dir):
    d = docs_of(spark, sf_dir)
    texts = F.create_map("lang", F.col("text"), F.lit("zz"), F.lit(" "))
    hashed = lambda name, c: [F.length(c).cast("bigint").alias(f"n_{name}"), V.sha256(c).alias(name)]
    return d.select("doc_id", *hashed("display", V.display_pick(texts, ["de", "en"], F.col("source"))), *hashed("preferred", V.preferred(texts, ["de"], F.col("source"))))


def translation_select(spark, sf_dir):
    texts = F.create_map("lang", "text", F.lit("src"), F.col("source"))
    t = docs_of(spark, sf_dir).select("doc_id", packing.choose_translation(texts, F.col("doc_id").cast("string"), seed=1337).alias("t"))
    return t.select("doc_id", "t.translator", F.length("t.text").cast("bigint").alias("n"), V.sha256(F.col("t.text")).alias("sha"))


def row_numbers(spark, sf_dir):
    return packing.numbered(table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id").select("vec_id", "row")


def half_matrix(spark, sf_dir):
    """Half-precision rows: their place, length, and whether they read as the vectors to within half precision."""
    rows = packing.half_matrix(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").join(table(spark, sf_dir, "embeddings"), "vec_id")
    off = F.zip_with(vectors.from_half_bytes("bytes"), "embedding", lambda a, b: F.abs(a - b) <= 0.0005)
    return rows.select("row", "vec_id", F.length("bytes").cast("bigint").alias("n"), F.forall(off, lambda x: x).alias("near"))


def split_texts(spark, sf_dir):
    parts = docs_of(spark, sf_dir).select("doc_id", F.explode(packing.split_text(F.col("text"), 1000)).alias("p"))
    return parts.select("doc_id", F.col("p.part").cast("bigint").alias("part"), F.length("p.text").cast("bigint").alias("n"), V.sha256(F.col("p.text")).alias("sha"))


def response_struct(spark, sf_dir):
    """Results and envelopes, read field by field from the response's JSON."""
    ranked = docs_of(spark, sf_dir).withColumnRenamed("doc_id", "doc").join(F.broadcast(hybrid_rrf(spark, sf_dir).where("rank <= 5")), "doc")  # five a query
    place = F.row_number().over(W.partitionBy("qid").orderBy("rank"))
    one = response.result(
        F.concat_ws(":", F.substring("source", 4, 9), "doc"), F.substring("source", 4, 9), F.col("doc"), F.col("text"), F.col("lang"), F.col("text"),
        F.lit("hybrid"), F.col("rrf"), F.col("bm25"), F.col("semantic"),
    )
    results = ranked.select("qid", place.alias("rank"), one.alias("result"))
    queries = spark.createDataFrame([*((q, " ".join(t), " ".join(t), "hybrid") for q, t in I.TERMS.items()), ("none", "nothing", "nothing", "lexical")], "qid string, raw string, normalized string, intent string")
    got = response.envelope(results, queries)
    kind = got.schema["response"].dataType.simpleString()
    read = got.select("qid", F.from_json(response.to_json(F.col("response")), kind).alias("r")).select("qid", "r", F.posexplode_outer("r.results").alias("place", "x"))
    score = [F.col(f"x.score.{c}").alias(c) for c in ("mode", "rrf", "bm25", "semantic")]
    return read.select(
        "qid", F.col("place").cast("bigint").alias("place"), "r.version", "r.packVersion", "r.query.raw", "r.query.intent", "r.query.langHint", "r.page.offset", "r.page.limit", "r.page.total", "r.page.nextOffset",
        "x.verseKey", "x.surah", "x.ayah", V.sha256(F.col("x.arabic")).alias("arabic"), F.col("x.display.lang").alias("lang"), V.sha256(F.col("x.display.text")).alias("display"), "x.meta.juz", *score,
    )


QUERIES = {
    f.__name__: f
    for f in (
        tokens_latin, tokens_unicode, normalize_ws_case, clamp_text, searchable_text, letter_fold, lang_hint, nfkc_fold, synonym_expand, stopword_adaptive, corpus_stats, doc_freq,
        idf_table, bm25_topk, bm25_fielded, bm25_rerank_boosts, phrase_source_lookup, occurrence_count, occurrence_list, ref_parse_pairs, ref_parse_aliases, ref_range_expand,
        alias_expand, intent_route, cosine_topk, cosine_candidates, hybrid_rrf, hybrid_minmax, lexical_mode, batch_hybrid, enrich_left_join, range_bucket_join, pivot_to_map,
        missing_translations, missing_keys_anti, semi_candidates, alignment_full_outer, null_counts, duplicate_texts, contiguity_check, density_check, cumulative_offsets,
        trigger_topics, trigger_topics_negative, topic_cap, topic_build, trigger_prune, variant_mining, phrase_gap_match, gap_islands, passages_mentions, eval_metrics,
        eval_by_group, latency_percentiles, best_config, judgment_pool, validation_report, range_validation, manifest_hash, manifest_verify, size_chunks, chunk_manifest,
        display_pick, translation_select, row_numbers, half_matrix, split_texts, response_struct,
    )
}
