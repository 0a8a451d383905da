"""Registered queries of sources and sinks: driver tables go out through a sink and come back through a reader."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from passagemill.functions import text as T
from passagemill.functions import values as V
from passagemill.functions import vectors
from passagemill.operators import dense, enrich, evaluation, packing
from passagemill.operators.response import to_json
from passagemill.plans import inputs as I
from passagemill.plans.queries import CHUNK, docs_of, rounded, table
from passagemill.sources import readers, sinks, storage


def format_json_array(spark, sf_dir):
    """A pretty and a compact JSON array of the benchmark."""
    at, items = storage.fresh(spark, "json"), table(spark, sf_dir, "benchmark")
    out = None
    for name, pretty in (("pretty", True), ("compact", False)):
        sinks.json_array(items, f"{at}/{name}.json", ["item_id"], pretty)
        got = readers.json_array(spark, f"{at}/{name}.json", "item_id bigint, text string").select(F.lit(name).alias("form"), "item_id", V.sha256(F.col("text")).alias("sha"))
        out = got if out is None else out.union(got)
    return out


def format_ndjson(spark, sf_dir):
    at = storage.fresh(spark, "ndjson")
    sinks.ndjson(docs_of(spark, sf_dir), at)
    return readers.ndjson(spark, at, "doc_id bigint, text string, lang string, source string, n_chars bigint").select("doc_id", V.sha256(F.col("text")).alias("sha"), "lang", "source", "n_chars")


def format_dirty_jsonl(spark, sf_dir):
    """Lines with leading or trailing commas between the brackets of a wrapper."""
    at = storage.fresh(spark, "dirty")
    one = to_json(F.struct("conv_id", "turn", "role"))
    place = F.col("turn") % 3
    lines = table(spark, sf_dir, "conversations").select(F.explode(F.array(F.lit("["), F.when(place == 0, F.concat(F.lit(" ,"), one)).when(place == 1, F.concat(one, F.lit(","))).otherwise(one), F.lit(""), F.lit("]"))).alias("value"))
    lines.write.text(at)
    return readers.dirty_jsonl(spark, at, "conv_id bigint, turn bigint, role string")


def _nations(spark, sf_dir):
    return table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))


def format_translation_files(spark, sf_dir):
    """A file of key -> {t: text} for each region, named after it."""
    at = storage.fresh(spark, "translations")
    entry = F.struct(F.concat(F.lit("1:"), "n_nationkey").alias("k"), F.struct(F.col("n_name").alias("t")).alias("v"))
    files = _nations(spark, sf_dir).groupBy("r_name").agg(to_json(F.map_from_entries(F.sort_array(F.collect_list(entry)))).alias("j"))
    for name, content in files.toLocalIterator():  # a small dimension table: a row a file
        sinks.file(spark, f"{at}/{name}-x-simple.json", content.encode())
    return readers.translation_files(spark, f"{at}/*-x-simple.json", "-x-simple.json", "xx")


def _sections(spark, sf_dir):
    """Nations as sections: their customers are their units."""
    units = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).cast("int").alias("units"))
    kind = F.when(F.col("n_regionkey") % 2 == 0, "Meccan").otherwise("Medinan").alias("kind")
    return _nations(spark, sf_dir).join(F.broadcast(units), F.col("n_nationkey") == F.col("c_nationkey")).select(
        (F.col("n_nationkey") + 1).cast("int").alias("major"), F.lit("").alias("name_ar"), F.col("n_name").alias("name_en"), F.lower("n_name").alias("name_tr"), kind, "units"
    )


def format_metadata(spark, sf_dir):
    """Sections and ranges of one metadata object, and the section sizes from all four layouts that name them."""
    at, rows = storage.fresh(spark, "metadata"), _sections(spark, sf_dir).orderBy("major").collect()  # a small dimension table
    surahs = [{"number": r["major"], "name_arabic": "", "name_english": r["name_en"], "name_transliteration": r["name_tr"], "total_verses": r["units"], "revelation_type": r["kind"]} for r in rows]
    ranges = [{"juz": i + 1, "start": f"{a}:1", "end": f"{a + 4}:1"} for i, a in enumerate(range(1, 26, 5))]
    counts = {str(r["major"]): r["units"] for r in rows}
    files = {"objects": {"schema_version": 1, "surahs": surahs, "juz_mappings": ranges}, "map": {"surah_ayah_counts": counts}, "list": {"surah_ayah_counts": list(counts.values())}, "bare": counts}
    for name, doc in files.items():
        sinks.file(spark, f"{at}/{name}.json", json.dumps(doc).encode())
    s, r = readers.metadata(spark, f"{at}/objects.json")
    out = s.select(F.lit("section").alias("what"), F.col("number").alias("n"), F.col("name_english").alias("a"), F.col("revelation_type").alias("b"), F.col("total_verses").alias("units"))
    out = out.union(r.select(F.lit("range"), "juz", "start", "end", F.lit(None).cast("int")))
    for name in files:
        out = out.union(readers.section_counts(spark, f"{at}/{name}.json").select(F.lit(name), "major", F.lit(None).cast("string"), F.lit(None).cast("string"), "units"))
    return out


def format_first_array(spark, sf_dir):
    """The first list of an object with other keys before it."""
    at = storage.fresh(spark, "first")
    one = table(spark, sf_dir, "region").agg(F.sort_array(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("rows")).select(F.lit(1).alias("version"), F.struct(F.lit("x").alias("y")).alias("meta"), "rows", F.array(F.lit(9)).alias("zlast"))
    sinks.file(spark, f"{at}/x.json", one.select(to_json(F.struct("*"))).first()[0].encode())
    got = readers.first_array(spark, f"{at}/x.json")
    return got.select("key", F.col("pos").cast("bigint").alias("pos"), F.expr("variant_get(value, '$.r_name', 'string')").alias("name"))


def format_key_list(spark, sf_dir):
    at = storage.fresh(spark, "keys")
    keys = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("1:"), "item_id").alias("key"), "item_id")
    one = keys.agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("item_id", "key"))), lambda x: x["key"])).alias("j"))
    sinks.file(spark, f"{at}/keys.json", one.first()[0].encode())
    return readers.key_list(spark, f"{at}/keys.json").select(F.col("place").cast("bigint").alias("place"), "key")


def format_npy(spark, sf_dir):
    """Half-precision rows as matrix.npy with its keys, read again and joined by place; near: within half precision of what went out."""
    at, v = storage.fresh(spark, "npy"), table(spark, sf_dir, "embeddings")
    sinks.matrix_files(packing.half_matrix(v, "vec_id", "embedding"), at, v.select(F.size("embedding")).first()[0], "vec_id")
    keys = readers.key_list(spark, f"{at}/keys.json").select(F.col("place").cast("bigint").alias("row"), F.col("key").cast("bigint").alias("vec_id"))
    both = readers.matrix(spark, f"{at}/matrix.npy").join(keys, "row").join(v, "vec_id")
    off = F.aggregate(F.zip_with("vector", "embedding", lambda a, b: F.abs(a - b)), F.lit(0.0).cast("float"), lambda a, x: F.greatest(a, x))
    return both.select("vec_id", "row", F.size("vector").cast("bigint").alias("dim"), (off <= 0.001).alias("near"))


def format_half_matrix(spark, sf_dir):
    """The bytes of a half-precision matrix end to end in one file, read in records."""
    at, v = storage.fresh(spark, "half"), table(spark, sf_dir, "embeddings")
    out = sinks._create(spark, f"{at}/m.f16")
    try:
        for part in sinks.matrix_bytes(packing.half_matrix(v, "vec_id", "embedding")):
            out.write(bytearray(part))
    finally:
        out.close()
    numbered = packing.numbered(v, "vec_id")
    both = readers.half_matrix(spark, f"{at}/m.f16", 64).join(numbered, "row")
    near = F.aggregate(F.zip_with("vector", "embedding", lambda a, b: F.abs(a - b)), F.lit(0.0).cast("float"), lambda a, x: F.greatest(a, x)) <= 0.001
    return both.select("vec_id", "row", near.alias("near"))


def format_yaml(spark, sf_dir):
    """A dimension table as YAML, in both forms of writing other scripts."""
    at, rows = storage.fresh(spark, "yaml"), [r.asDict() | {"name": "é " + r["r_name"]} for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect()]
    out = None
    for name, unicode in (("ascii", False), ("unicode", True)):
        sinks.file(spark, f"{at}/{name}.yaml", sinks.yaml_text(rows, "regions", unicode).encode())
        got = readers.yaml_rows(spark, f"{at}/{name}.yaml", "r_regionkey int, r_name string, name string", "regions").select(F.lit(name).alias("form"), "r_regionkey", "r_name", "name")
        out = got if out is None else out.union(got)
    return out


def format_localized_triggers(spark, sf_dir):
    at = storage.fresh(spark, "localized")
    topics = {t: {} for t, *_ in I.TRIGGERS}
    for topic, lang, token in I.TRIGGERS:
        topics[topic].setdefault(lang, []).append(token)
    sinks.file(spark, f"{at}/t.json", json.dumps({"topics": topics}).encode())
    return readers.localized_triggers(spark, f"{at}/t.json")


def format_files(spark, sf_dir):
    """A pack folder's listing, checksum lines and manifests, over files of the region names."""
    at, names = storage.fresh(spark, "files"), [r[0] for r in table(spark, sf_dir, "region").select("r_name").collect()]
    for n in names:
        sinks.file(spark, f"{at}/{n}.txt", n.encode() * 3)
    listed = readers.files(spark, f"{at}/*.txt")
    lines = dict(reversed(x.split("  ", 1)) for x in sinks.checksum_lines(listed).splitlines())
    sums = spark.createDataFrame(list(lines.items()), "name string, line string")
    whole = packing.pack_manifest(listed, "v3", "model", 4, 7, "abc", "fixed", 1337)
    v3 = whole.select(F.explode("files").alias("x"), F.col("embedding.rows").alias("rows"), F.col("translation_policy.seed").alias("seed"), F.col("searchable_text.max_chars").alias("most"))
    mapped = packing.manifest_map(listed, "ASIA.txt", rows=7, dim=4).select(F.explode("files").alias("name", "e"))
    got = listed.join(sums, "name").join(v3.select(F.col("x.name").alias("name"), F.col("x.bytes").alias("v3_bytes"), "rows", "seed", "most"), "name")
    got = got.join(mapped.select("name", F.col("e.dtype").alias("dtype"), F.array_join("e.shape", "x").alias("shape"), "e.row_major"), "name")
    return got.select("name", "bytes", "sha256", (F.col("line") == F.col("sha256")).alias("line_ok"), "v3_bytes", "rows", "seed", "most", "dtype", "shape", "row_major")


def format_keyed_object(spark, sf_dir):
    """key -> row objects of the nations, and the same in chunks of a bounded size."""
    at = storage.fresh(spark, "keyed")
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("1:"), "n_nationkey").alias("key"), "n_nationkey", "n_name")
    sinks.keyed_object(rows, f"{at}/whole.json", "key", ["n_nationkey"])
    pairs = rows.select(F.lit("f").alias("file"), "n_nationkey", "key", to_json(F.struct("key", "n_nationkey", "n_name")).alias("j"))
    packing.keyed_chunks(pairs, "file", "n_nationkey", "key", "j", 400).select("value").write.text(f"{at}/chunks")
    read = lambda name: spark.read.text(f"{at}/{name}").select(F.lit(name).alias("form"), F.explode(F.from_json("value", "map<string,struct<key:string,n_nationkey:int,n_name:string>>")).alias("key", "v"))
    return read("whole.json").union(read("chunks")).select("form", "key", "v.n_nationkey", "v.n_name")


def chunk_forms(spark, sf_dir):
    """The packing rules of wrapped arrays and of lines, over the pages."""
    pages = table(spark, sf_dir, "pages").select((F.col("page_id") % 4).alias("file"), "page_id", F.octet_length("html").cast("bigint").alias("size"), "html")
    wrapped = packing.wrapped_chunks(pages, "file", "page_id", "size", 5000, CHUNK).select(F.lit("wrapped").alias("form"), "file", "page_id", F.col("chunk").cast("bigint").alias("chunk"))
    return wrapped.union(packing.line_chunks(pages, "file", "page_id", "html", CHUNK).select(F.lit("lines"), "file", "page_id", F.col("chunk").cast("bigint")))


def evaluation_report(spark, sf_dir):
    """A report's rows by query and its aggregates, written and read again."""
    from passagemill.plans.queries import _grades, _run

    at, per = storage.fresh(spark, "report"), evaluation.metrics(_run(spark, sf_dir), _grades(spark, sf_dir), 10)
    per = rounded(per, 6, "rr", "ndcg")
    sinks.evaluation_reports(per, evaluation.summary(per), at)
    q = readers.ndjson(spark, f"{at}/queries", "qid string, rr double, ndcg double").select(F.lit("query").alias("what"), "qid", "rr", "ndcg")
    s = readers.ndjson(spark, f"{at}/summary", "n bigint, mean_rr double, mean_ndcg double").select(F.lit("all"), F.col("n").cast("string"), F.round("mean_rr", 6), F.round("mean_ndcg", 6))
    return q.union(s)


def stored_index(spark, sf_dir):
    """The kept index's postings, as its tables have them on disk."""
    from passagemill.plans.queries import _index

    return _index(spark, sf_dir).tf.select("field", "token", F.col("doc").alias("doc_id"), F.col("f").cast("bigint").alias("f"), F.col("dl").cast("bigint").alias("dl"))


# --- the dataset ---------------------------------------------------------------------------------


def _dataset(spark, sf_dir):
    """Customers as passages of their nation; order counts by priority of their orders stand for translations."""
    from pyspark.sql import Window as W

    sections = _sections(spark, sf_dir)
    minor = F.row_number().over(W.partitionBy("c_nationkey").orderBy("c_custkey")).cast("int")
    c = table(spark, sf_dir, "customer").select((F.col("c_nationkey") + 1).cast("int").alias("major"), minor.alias("minor"), "c_custkey", F.col("c_name").alias("text"))
    passages = c.select(
        "major", "minor", "text", F.lower("text").alias("transliteration"), F.lit(None).cast("string").alias("transliteration_alt"), F.when(F.col("c_custkey") % 5 > 0, F.concat(F.lit("en "), "c_custkey")).alias("en"),
        F.when(F.col("c_custkey") % 7 > 0, F.concat(F.lit("ur "), "c_custkey")).alias("ur"), F.col("c_custkey").alias("merit"),
    )
    key = F.concat_ws(":", "major", "minor").alias("key")
    long = c.where("c_custkey % 3 > 0").select(key, F.lit("en").alias("lang"), F.concat(F.lit("tr"), F.col("c_custkey") % 2).alias("translator"), F.concat(F.lit("t "), "text").alias("text"))
    long = long.union(c.where("c_custkey % 4 = 0").select(key, F.lit("ur"), F.lit("u1"), F.concat(F.lit("u "), "text")))
    ranges = spark.createDataFrame([("1", 1, 40, 0), ("2", 41, 400, 1), ("3", 401, 1_000_000_000, 2)], "name string, lo bigint, hi bigint, ord int")
    return enrich.build(passages, sections, ranges, long, {"en": ["tr1"], "ur": ["u1"]})


def dataset_build(spark, sf_dir):
    """The unified passages of the build, whole rows; maps as sorted entries."""
    entries = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    d = _dataset(spark, sf_dir)
    return d.withColumns({c: entries(c) for c in ("translations_urdu", "translations_english")})


def dataset_checks(spark, sf_dir):
    """What the build has to hold: unique keys, dense units, filled fields, known sections; and its statistics."""
    d = _dataset(spark, sf_dir)
    rows = [
        d.agg(F.lit("rows").alias("what"), F.count(F.lit(1)).alias("n")), d.agg(F.lit("duplicate keys"), F.count(F.lit(1)) - F.countDistinct("verse_key")),
        enrich.density(d, "surah", "ayah").agg(F.lit("sections with gaps"), F.count(F.lit(1))), d.agg(F.lit("empty texts"), F.count_if(F.col("searchable_text") == "")),
        d.agg(F.lit("without range"), F.count_if(F.col("juz").isNull())), enrich.stats(d, "surah").select(F.lit("sections"), "sections"),
        sinks.statistics(d, "surah", {"en": "translations_english"}).select(F.lit("total"), "total_verses"),
        readers.counted(spark, d, 6236).agg(F.lit("count warnings"), F.count(F.lit(1))),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


def positions(spark, sf_dir):
    """Each customer's place in the corpus, and its key again from that place."""
    d = _dataset(spark, sf_dir).select("verse_key", F.col("surah").alias("major"), F.col("ayah").alias("minor"))
    s = _sections(spark, sf_dir).select("major", "units")
    at = d.join(F.broadcast(enrich.offsets(s, "major", "units")), "major").select("verse_key", enrich.position(F.col("major"), F.col("minor"), F.col("offset")).alias("at"))
    return enrich.key_at(at, "at", s, "major", "units").select("verse_key", F.col("at").alias("place"), "major", F.col("minor").cast("bigint").alias("minor"))


def mobile_pack(spark, sf_dir):
    """Rows of a mobile pack under short names, with one translation a language, by preference for one and by seed for the other."""
    d = _dataset(spark, sf_dir).select(
        F.col("verse_key").alias("key"), F.col("surah").alias("major"), F.col("ayah").alias("minor"), F.col("juz").alias("range"), F.col("surah_name_english").alias("name"), F.col("arabic").alias("text"),
        "transliteration", "translations_english", "translations_urdu", "translation_en_builtin", "translation_ur_builtin",
    )
    builtin = lambda c: F.nullif(F.col(c), F.lit(""))
    en = packing.choose_translation(F.col("translations_english"), F.col("key"), ["tr1", "tr0"], builtin("translation_en_builtin"))
    ur = packing.choose_translation(F.col("translations_urdu"), F.col("key"), builtin=builtin("translation_ur_builtin"), seed=packing.translation_seed(0, None))
    return packing.pack_rows(d, en, ur).withColumn("st", V.sha256(F.col("st")))


# --- vectors -------------------------------------------------------------------------------------


def vector_checks(spark, sf_dir):
    """Unit norms, closeness of half-precision copies by cosine and greatest difference, and a mean of a vector with itself."""
    v = table(spark, sf_dir, "embeddings").withColumn("half", vectors.from_half_bytes(vectors.half_bytes("embedding")))
    close = vectors.closeness(F.col("embedding"), F.col("half"))
    pooled = vectors.mean_pool(F.array("embedding", "half"), F.array(F.lit(1), F.lit(0)))
    same = F.forall(F.zip_with(pooled, "embedding", lambda a, b: F.abs(a - b) < 1e-12), lambda x: x)
    return v.select(
        "vec_id", F.round(vectors.l2_norm(F.col("embedding")), 5).alias("norm"), F.round(vectors.l2_norm(vectors.unit(F.transform("embedding", lambda x: x * 3))), 5).alias("unit"),
        (close["cosine"] >= 0.999).alias("cosine_ok"), (close["most"] <= 1e-3).alias("difference_ok"), same.alias("pooled"),
    )


def encode_texts(spark, sf_dir):
    """The encoder hook with an encoder that counts letters: prefix, clamp and batches as for a model."""
    rows = dense.encode(docs_of(spark, sf_dir), "doc_id", T.clamp(F.col("text")), dense.letter_counts, 26, prefix="query: ", unit=False)
    return rows.select("doc_id", F.aggregate("v", F.lit(0.0), lambda a, x: a + x).cast("bigint").alias("letters"), F.get("v", F.lit(4)).cast("bigint").alias("e"), F.get("v", F.lit(25)).cast("bigint").alias("z"))


QUERIES = {
    f.__name__: f
    for f in (
        format_json_array, format_ndjson, format_dirty_jsonl, format_translation_files, format_metadata, format_first_array, format_key_list, format_npy, format_half_matrix, format_yaml,
        format_localized_triggers, format_files, format_keyed_object, chunk_forms, evaluation_report, stored_index, dataset_build, dataset_checks, positions, mobile_pack, vector_checks, encode_texts,
    )
}
