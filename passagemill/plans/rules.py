"""Registered queries of text forms, script-aware search, topics, metrics and rules; most read small hand-made inputs."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from passagemill.functions import text as T
from passagemill.functions import values as V
from passagemill.operators import bm25, evaluation, references, response, topics, validation
from passagemill.plans import inputs as I
from passagemill.plans.queries import _index, _norm, _parsed, _postings, _run, docs_of, rounded, table
from passagemill.sources import sinks, storage

# --- text ------------------------------------------------------------------------------------------

#: (form, raw text); what each form gives is in the SQL as literals.
TEXT_CASES = [
    ("search", "بِسْمِ ٱللَّهِ"), ("search", "إيمان، أحمد"), ("search", "صلاة"), ("search", "کتاب ہے"), ("search", "١٢٣ ۴"), ("search", "Straße  X"), ("search", "a.b:c-d!e/f"), ("search", None), ("search", "ﷺ"),
    ("aggressive", "صلاة"), ("aggressive", "شيء"), ("norm_ar", "الصَّلاةُ ءأ"), ("norm_lat", "Don't 'stop' O’Neil—X"), ("norm_ur", "ایک، دو۔ تین؟"), ("tokenize_lat", "The don't of a Xy xy I"), ("tokenize_ur", "ایک، x دو۔ ت"),
    ("tokenize_ar", "الصَّلاةُ و صوم"), ("mixed_terms", "Prayer a 7 صلاة ab"), ("tokens", "ab صلاة 12"), ("stems", "والكتاب"), ("surface", "Don't x-y صلاة"), ("match_form", "Surah_Al-Baqarah, ٢:٢٥٥"),
    ("nickname", "Ayat-ul-Kursi!"), ("number", " ٢:٣ Straße "), ("alias", "Ａl‌َ  Straße"), ("embedding", "Ａ  b"), ("pointer", "a/b~c"), ("key_minor", "2:255"), ("key_minor", "2-255"), ("phrase", "two words"), ("phrase", "one"),
    ("passage", "x  y"), ("casefold", "ẞ straße"),
]


def text_forms(spark, sf_dir):
    """Every normal form and tokenizer on hand-made texts; lists are joined by a bar."""
    c = F.col("raw")
    listed = lambda x: F.array_join(x, "|")
    forms = {
        "search": T.normalize(c), "aggressive": T.normalize(c, T.AGGRESSIVE), "norm_ar": T.norm_ar(c), "norm_lat": T.norm_lat(c), "norm_ur": T.norm_ur(c), "tokenize_lat": listed(T.tokenize_lat(c)),
        "tokenize_ur": listed(T.tokenize_ur(c)), "tokenize_ar": listed(T.tokenize_ar(c)), "mixed_terms": listed(T.mixed_terms(c)), "tokens": listed(T.tokens(c)), "stems": listed(T.mixed_terms(c, stem=True)),
        "surface": listed(T.surface_tokens(c)), "match_form": T.match_form(c), "nickname": T.nickname_form(c), "number": T.number_form(c), "alias": T.alias_form(c), "embedding": T.embedding_form(c),
        "pointer": T.pointer_escape(c), "key_minor": T.key_part(c, 2, -1).cast("string"), "phrase": T.is_phrase(c).cast("string"), "passage": T.passage([("Text", c), ("Note", F.lit(None).cast("string"))]), "casefold": T.casefold(c),
    }
    rows = spark.createDataFrame([(i, f, r) for i, (f, r) in enumerate(TEXT_CASES)], "id int, form string, raw string")
    return rows.select("id", "form", F.coalesce(*(F.when(F.col("form") == f, x) for f, x in forms.items())).alias("out"))


def value_forms(spark, sf_dir):
    """Small helpers: case-unique lists, clamped limits, first filled values, rounding, and the clock."""
    rows = spark.createDataFrame([(1, ["b", "A", "a", "B", "c"], 7, " ", 0.1234565), (2, [], -3, "x", None), (3, ["É", "é"], 1000, None, 2.0)], "id int, items array<string>, asked int, a string, x double")
    today = F.substring(V.utc_now(), 1, 4).cast("int") >= 2024
    return rows.select(
        "id", F.array_join(V.case_unique(F.col("items")), "|").alias("items"), V.clamp_limit(F.col("asked"), 300).alias("limit"), V.filled(F.col("a"), F.lit("other")).alias("filled"), V.round6(F.col("x")).alias("rounded"), today.alias("clock")
    )


# --- search by script --------------------------------------------------------------------------------

SCRIPT_QUERIES = [("s1", "the that of"), ("s2", "صبر der und the"), ("s3", "صبر نور"), ("s4", "des les une que")]


def script_search(spark, sf_dir):
    """Fields and weights by each query's scripts, candidates, floor and boosts. Languages of the documents stand for the fields' languages."""
    words = T.latin_terms(F.col("text"))
    of = lambda lang, w: F.when(F.col("lang") == lang, w).otherwise(F.array().cast("array<string>"))
    fields = {"arabic": of("de", words), "english": of("en", F.filter(words, lambda t: ~t.isin(T.QUERY_STOPWORDS))), "urdu": of("fr", words), "mix": words}
    ix = _index(spark, sf_dir, fields, "scripts")
    q = spark.createDataFrame(SCRIPT_QUERIES, "qid string, norm string").withColumn("tokens", T.mixed_terms(F.col("norm")))
    gated = bm25.script_fields(q)
    base = rounded(bm25.combine_fields(bm25.score(gated.select("qid", "field", "token"), ix), bm25.weights_table(gated)), 6, "base")
    candidates = bm25.top(base, bm25.Bm25Config.top_candidates, "base").select("qid", "doc", "base")
    docs = docs_of(spark, sf_dir).select(F.col("doc_id").alias("doc"), "text")
    return bm25.top(rounded(bm25.rerank(candidates, q, docs, norm=_norm("text"), tokens=words), 6, "score"), 20).select("qid", "doc", "score", "rank")


def script_weights(spark, sf_dir):
    q = spark.createDataFrame(SCRIPT_QUERIES, "qid string, norm string").withColumn("tokens", T.mixed_terms(F.col("norm")))
    gated = bm25.script_fields(q)
    return gated.join(bm25.weights_table(gated), ["qid", "field"]).groupBy("qid", "field", "script", "weight").agg(F.count(F.lit(1)).alias("n_tokens"))


def alias_order(spark, sf_dir):
    """Keys of whole-query aliases, each once, in numeric order."""
    q = spark.createDataFrame([(1, "Opening"), (2, " MIXED "), (3, "nothing"), (4, "opening"), (4, "mixed")], "qid int, raw string")
    return references.structural_order(references.lookup_aliases(q, spark.createDataFrame(I.TARGETS, "alias string, target string"), compat=False))


# --- topics ------------------------------------------------------------------------------------------

LOCALIZED = [("insult", "es", "que"), ("bad", "fr", "les"), ("other", "en", "the")]
ENTITIES = [("fool", "en", "idiot"), ("fool", "de", "der"), ("ghost", "en", "zzzzzz"), ("crowd", "fr", "des")]
TOPIC_PHRASES = [("insult", "en", ["of", "the"]), ("bad", "de", ["zzzz", "der"]), ("bad", "fr", ["les", "des"]), ("entity_fool", "en", ["that", "that"]), ("entity_crowd", "fr", ["des", "les"])]
GROUPS = [("insult", "old", "en", "idiot"), ("insult", "new", "es", "que"), ("bad", "none", "en", "zzzz")]
GROUP_ANCHORS = [("insult", "old", 0, 1), ("insult", "old", 900, 3), ("bad", "none", 1, 1)]


def _ontology(spark, sf_dir):
    base = spark.createDataFrame(I.TRIGGERS, "topic string, lang string, token string")
    merged = topics.merge_triggers(base, spark.createDataFrame(LOCALIZED, "topic string, lang string, token string"), strict=False)
    varied = topics.expand_variants(merged, spark.createDataFrame(I.VARIANTS, "canonical string, variant string"))
    return topics.build_ontology(varied, spark.createDataFrame(ENTITIES, "entity string, lang string, token string"), _postings(spark, sf_dir))


def ontology(spark, sf_dir):
    return _ontology(spark, sf_dir)


def _sequences(spark, sf_dir):
    return docs_of(spark, sf_dir).select("lang", F.col("doc_id").alias("doc"), T.latin_terms(F.col("text")).alias("seq"))


def phrase_prune(spark, sf_dir):
    phrases = spark.createDataFrame(TOPIC_PHRASES, "topic string, lang string, phrase array<string>")
    return topics.prune_phrases(phrases, _sequences(spark, sf_dir)).select("topic", "lang", F.array_join("phrase", " ").alias("phrase"))


def topic_compile(spark, sf_dir):
    """Topics, entities and stories over tokens and phrases; entities and stories match in German and Spanish alone here."""
    o, post = _ontology(spark, sf_dir), _postings(spark, sf_dir)
    o = spark.createDataFrame(o.collect(), o.schema)  # a few rows a trigger; each use would read all documents again
    phrases = spark.createDataFrame(TOPIC_PHRASES, "topic string, lang string, phrase array<string>")
    hits = topics.phrase_hits(phrases, _sequences(spark, sf_dir), ["lang"]).select("topic", "lang", "doc")
    kinds = o.select("topic", "kind").distinct()
    return topics.compile_topics(post, o.select("topic", "lang", "token"), spark.createDataFrame(I.NEGATIVES, "topic string, lang string, token string"), kinds, hits, narrow=("de", "es"))


def group_build(spark, sf_dir):
    """Groups' own triggers within the documents of their topic, with anchors, capped; and three keys a group, lent by the topic where a group has none."""
    groups = spark.createDataFrame(GROUPS, "topic string, group string, lang string, token string")
    anchors = spark.createDataFrame(GROUP_ANCHORS, "topic string, group string, major int, minor int")
    key = lambda df, *c: df.select(*c, (F.col("doc") / 50).cast("int").alias("major"), (F.col("doc") % 50).cast("int").alias("minor"))
    of_topic = topics.matches(_postings(spark, sf_dir), spark.createDataFrame(I.TRIGGERS, "topic string, lang string, token string"))
    found = _postings(spark, sf_dir).join(F.broadcast(groups), ["lang", "token"]).select("topic", "group", "doc").join(of_topic, ["topic", "doc"], "left_semi").distinct()
    built = topics.build_groups(key(found, "topic", "group"), anchors, 40)
    own = groups.select("topic", "group").distinct().join(key(found, "topic", "group"), ["topic", "group"], "left")
    lent = topics.fill_groups(own, spark.createDataFrame(I.ANCHORS, "topic string, major int, minor int"))
    return built.select(F.lit("build").alias("what"), "topic", "group", "major", "minor", "is_anchor").union(lent.select(F.lit("fill"), "topic", "group", "major", "minor", F.lit(None).cast("boolean")))


def topic_templates(spark, sf_dir):
    """Sections of topics that have groups; a section's keys in numeric order."""
    rows = group_build(spark, sf_dir).where("what = 'fill'")
    known = spark.createDataFrame([("insult",), ("nowhere",)], "topic string")
    t = topics.templates(known, rows.select("topic", "group", "major", "minor"))
    one = lambda s: F.concat(s["group"], F.lit("="), F.array_join(F.transform(s["keys"], lambda k: F.concat_ws(":", k["major"], k["minor"])), ","))
    return t.select("topic", F.array_join(F.transform("sections", one), ";").alias("sections"))


def variant_forms(spark, sf_dir):
    """Variants by spelling rules beside seeds and surfaces, and those of the corpus alone, one a spelling."""
    surfaces = docs_of(spark, sf_dir).select(F.explode(T.surface_tokens(F.col("text"))).alias("surface")).distinct().withColumn("norm", F.lower("surface"))
    seeds = spark.createDataFrame([*I.SEEDS, ("queen-dhoo", "queen"), ("aa'ee", "x")], "canonical string, variant string")
    a, b = topics.mine_variants(seeds, surfaces, rules=True), topics.corpus_variants(seeds, surfaces)
    return a.select(F.lit("rules").alias("form"), "canonical", "variant", F.col("ord").cast("bigint").alias("ord")).union(b.select(F.lit("corpus"), "canonical", "variant", F.col("ord").cast("bigint")))


# --- evaluation --------------------------------------------------------------------------------------


def grade_coercion(spark, sf_dir):
    rows = [("1", "2:1"), ("2", '["2:1", "2:2"]'), ("3", '{"2:1": 3, "2:2": "x"}'), ("4", "[]"), ("5", '{"9:9": 0}')]
    return evaluation.coerce_grades(spark.createDataFrame(rows, "qid string, expected string"))


def metric_variants(spark, sf_dir):
    """The documented variant of recall and AP, at four depths, over runs that name a document twice."""
    from passagemill.plans.queries import _grades

    twice = _run(spark, sf_dir)
    twice = twice.union(twice.withColumn("rank", F.col("rank") + 10))
    run, grades = evaluation.first_only(twice), _grades(spark, sf_dir)
    out = None
    for k in (1, 3, 5, 10):
        got = rounded(evaluation.metrics(run, grades, k, true_recall=True, full_ap=True), 6, "ap", "precision", "recall", "f1").select(F.lit(k).alias("k"), "qid", "ap", "precision", "recall", "f1")
        out = got if out is None else out.union(got)
    return out


def recall_grid(spark, sf_dir):
    """The source document of each benchmark item among what BM25 finds for the item."""
    items = table(spark, sf_dir, "benchmark")
    terms = items.select(F.col("item_id").alias("qid"), F.lit("text").alias("field"), F.explode(T.latin_terms(F.col("text"))).alias("token"))
    run = bm25.top(rounded(bm25.best(terms, _index(spark, sf_dir), 10, 4), 4, "score"), 10)
    from passagemill.plans.queries import phrase_source_lookup

    relevant = phrase_source_lookup(spark, sf_dir).select(F.col("item_id").alias("qid"), F.col("doc_id").alias("doc"))
    return rounded(evaluation.recall_grid(run, relevant), 6, "recall_1", "recall_3", "recall_5", "recall_10", "mrr")


def metric_getter(spark, sf_dir):
    rows = [(1, '{"mrr": 0.5, "acc": 1}'), (2, '{"mrr": {"mean": 0.25}}'), (3, '{"mrr": "x", "acc": {"mean": 2}}'), (4, "{}"), (5, None)]
    return spark.createDataFrame(rows, "id int, j string").select("id", evaluation.metric_value(F.col("j"), "mrr", "acc").alias("value"))


# --- rules -------------------------------------------------------------------------------------------


def pack_rules(spark, sf_dir):
    """Topic packs, groups, variants, templates, compiled topics and packs with one fault of each kind."""
    k = lambda rows, schema: spark.createDataFrame(rows, schema)
    corpus = k([("1:1",), ("1:2",), ("1:3",)], "key string")
    keys = [("a", "1:1"), ("a", "1:2"), ("a", "1:3"), ("b", "1:1"), ("b", "1:1"), ("c", "9:9")]
    topics_ = k([("a",), ("b",), ("c",), ("d",)], "topic string")
    parts = {
        "topics": validation.topic_pack(k(keys, "topic string, key string"), topics_, corpus, "topic", "key", 2, "TOPIC"),
        "groups": validation.topic_pack(k(keys[:2], "group string, key string"), k([("a",), ("z",)], "group string"), corpus, "group", "key", 40, "GROUP"),
        "variants": validation.variants(k([("x", "y"), ("x", "y"), ("", "z"), ("w", " "), *(("many", f"v{i}") for i in range(13))], "canonical string, variant string")),
        "templates": validation.templates(k([("t", "a", "1:1"), ("t", "a", "1:1"), ("t", "b", None)], "template string, section string, key string")),
        "compiled": validation.compiled_topics(k([("t",), ("t",), ("u",)], "topic string"), k([("t", 1, 1, 2), ("t", 2, 1, 1), ("u", 1, 9, 9)], "topic string, place int, major int, minor int"), k([(1, 1), (1, 2)], "major int, minor int")),
        "pack": validation.pack_integrity(k([(0, "1:1"), (1, "1:2")], "row bigint, key string"), k([(0, "1:1"), (1, "1:3")], "row bigint, key string"), 15, 4, 3),
        "counts": validation.compare_counts(k([(1, 7), (2, 3)], "major int, units int"), k([(1, 7), (2, 4), (3, 1)], "major int, units int")),
        "ranges": validation.compare_ranges(k([(1, "1:1", "1:2"), (2, "1:3", "2:1"), (3, "2:2", "2:9")], "number int, start string, end string"), k([(1, "1:1", "1:2"), (2, "1:3", "2:2")], "number int, start string, end string")),
    }
    out = None
    for name, found in parts.items():
        got = found.select(F.lit(name).alias("what"), "level", "code", "path")
        out = got if out is None else out.union(got)
    return out


def exit_statuses(spark, sf_dir):
    rows = {"clean": [], "warned": ["warning"], "failed": ["warning", "error"]}
    out = None
    for name, levels in rows.items():
        found = spark.createDataFrame([(x, "C", "m", "p") for x in levels], "level string, code string, message string, path string")
        for strict in (False, True):
            got = validation.exit_status(found, strict).select(F.lit(name).alias("what"), F.lit(strict).alias("strict"), "status")
            out = got if out is None else out.union(got)
    return out


def root_rules(spark, sf_dir):
    """Files that are missing, no JSON, no object, or without their lists."""
    at = storage.fresh(spark, "roots")
    files = {"list": "[]", "text": "{nope", "no-ranges": '{"surahs": [1]}', "types": '{"surahs": 1, "juz_mappings": []}', "good": '{"surahs": [], "juz_mappings": []}'}
    for name, content in files.items():
        sinks.file(spark, f"{at}/{name}.json", content.encode())
    out = None
    for name in [*files, "missing"]:
        got = validation.root_keys(spark, f"{at}/{name}.json").select(F.lit(name).alias("file"), "level", "code")
        out = got if out is None else out.union(got)
    return out


SCHEMA = {
    "type": "object", "required": ["schema", "version", "topics"], "additionalProperties": True,
    "properties": {
        "schema": {"type": "string", "minLength": 1}, "version": {"type": "integer", "minimum": 1},
        "topics": {"type": "array", "minItems": 1, "items": {"type": "object", "required": ["id"], "additionalProperties": False, "properties": {"id": {"type": "string", "pattern": "^[a-z]+$"}, "keys": {"type": "array", "uniqueItems": True, "items": {"type": "string"}}}}},
    },
}


def schema_validation(spark, sf_dir):
    docs = [
        {"schema": "s", "version": 1, "topics": [{"id": "a", "keys": ["1:1"]}], "more": 1}, {"schema": "", "version": 0, "topics": []}, {"version": 1.5, "topics": [{"id": "A1", "keys": ["x", "x", 3], "a/b": 1}, 7]}, [],
    ]
    rows = [(i, json.dumps(d)) for i, d in enumerate(docs)] + [(8, "{nope"), (9, None)]
    return validation.json_schema(spark.createDataFrame(rows, "id int, j string"), "id", "j", SCHEMA).select("id", "code", F.col("message").alias("rule"), "path")


def flat_results(spark, sf_dir):
    """Resolved references as flat results with their preferred texts."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") + 1).cast("int").alias("major"), (F.col("turn") + 1).cast("int").alias("minor"), "text", "role")
    hit = references.expand(_parsed(spark), turns)
    rows = hit.select(
        "qid", F.concat_ws(":", "major", "minor").alias("verse_key"), F.col("major").alias("surah"), F.col("minor").alias("ayah"), F.lit("").alias("surah_name_arabic"), F.concat(F.lit("S"), "major").alias("surah_name_english"),
        F.col("text").alias("arabic"), F.lower("text").alias("transliteration"), "score", F.lit("structural").alias("match_type"), F.create_map("role", "text").alias("texts"),
    )
    flat = response.flat(rows, V.preferred(F.col("texts"), ["assistant"], F.lit("own")), V.preferred(F.col("texts"), ["user"]))
    return flat.withColumns({c: V.sha256(F.col(c)) for c in ("arabic", "transliteration", "translation_en", "translation_ur")})


QUERIES = {
    f.__name__: f
    for f in (
        text_forms, value_forms, script_search, script_weights, alias_order, ontology, phrase_prune, topic_compile, group_build, topic_templates, variant_forms, grade_coercion, metric_variants, recall_grid,
        metric_getter, pack_rules, exit_statuses, root_rules, schema_validation, flat_results,
    )
}
