"""Sources: JSON, NDJSON, YAML, matrices and binary listings, with explicit schemas."""

from __future__ import annotations

import io
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

SECTIONS = "number int, name_arabic string, name_english string, name_transliteration string, total_verses int, revelation_type string"
METADATA = f"schema_version int, surahs array<struct<{SECTIONS.replace(' int', ':int').replace(' string', ':string')}>>, juz_mappings array<struct<juz:int,start:string,end:string>>"
PASSAGE = (
    "id string, verse_key string, surah int, ayah int, surah_name_arabic string, surah_name_english string, surah_name_transliteration string, revelation_type string, "
    "arabic string, transliteration string, transliteration_alt string, translation_en_builtin string, translation_ur_builtin string, translations_urdu map<string,string>, "
    "translations_english map<string,string>, juz int, hasanat int, searchable_text string"
)


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds one JSON array; it is not splittable, so ingest it once and keep parquet."""
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")


def ndjson(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One value a line; blank lines are skipped, a bad line raises."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def dirty_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON with stray wrappers: leading commas are cut, lines that are no object are dropped."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"^\s*,+|,+\s*$", "")).alias("value"))
    return lines.where(F.col("value").startswith("{") & F.col("value").endswith("}")).select(F.from_json("value", schema).alias("x")).where("x is not null").select("x.*")


def translation_files(spark: SparkSession, pattern: str, suffix: str, lang: str) -> DataFrame:
    """(lang, translator, key, text) of files of key -> {t: text}; the translator is the file name less its suffix."""
    files = spark.read.text(pattern, wholetext=True).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    name = F.regexp_replace(F.url_decode("file"), suffix.replace(".", r"\.") + "$", "")
    entries = F.explode(F.from_json("value", "map<string,struct<t:string>>"))
    return files.select(F.lit(lang).alias("lang"), name.alias("translator"), entries.alias("key", "v")).select("lang", "translator", "key", F.col("v.t").alias("text"))


def metadata(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Sections and ranges of one metadata object."""
    raw = spark.read.schema(METADATA).json(path, multiLine=True)
    return raw.select(F.explode("surahs").alias("s")).select("s.*"), raw.select(F.explode("juz_mappings").alias("j")).select("j.*")


def section_counts(spark: SparkSession, path: str) -> DataFrame:
    """(major, units) from any of four layouts: section objects, a named map, a named list, a bare map."""
    v = spark.read.text(path, wholetext=True).select(F.expr("try_parse_json(value)").alias("v"))
    get = lambda p, t: F.expr(f"try_variant_get(v, '{p}', '{t}')")
    objects = F.transform(get("$.surahs", "array<struct<number:int,total_verses:int>>"), lambda s: F.struct(s["number"].alias("major"), s["total_verses"].alias("units")))
    listed = F.transform(get("$.surah_ayah_counts", "array<int>"), lambda u, i: F.struct((i + 1).alias("major"), u.alias("units")))
    mapped = lambda m: F.transform(F.map_entries(m), lambda e: F.struct(e["key"].try_cast("int").alias("major"), e["value"].alias("units")))
    found = F.coalesce(objects, mapped(get("$.surah_ayah_counts", "map<string,int>")), listed, mapped(get("$", "map<string,int>")))
    return v.select(F.explode(found).alias("x")).select("x.major", "x.units").where("major is not null and units is not null")


def first_array(spark: SparkSession, path: str) -> DataFrame:
    """(key, pos, value) of the first top-level key whose value is an array; values are variants."""
    doc = spark.read.text(path, wholetext=True).select(F.expr("parse_json(value)").alias("v"))
    doc.createOrReplaceTempView("_first_array")
    tops = spark.sql("select t.key, t.value, t.pos from _first_array, lateral variant_explode(v) t where schema_of_variant(t.value) like 'ARRAY%' order by t.pos limit 1")
    tops.createOrReplaceTempView("_first_array_top")
    return spark.sql("select a.key, e.pos, e.value from _first_array_top a, lateral variant_explode(a.value) e")


def key_list(spark: SparkSession, path: str) -> DataFrame:
    """(place, key) of a JSON list of keys; an empty list or a key given twice raises."""
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("place", "key"))
    n, distinct = raw.agg(F.count(F.lit(1)), F.countDistinct("key")).first()
    if not n or n != distinct:
        raise ValueError("key list is empty or has duplicates")
    return raw


def records(spark: SparkSession, path: str, length: int) -> DataFrame:
    """(pos, bytes) of a file's records of fixed length, in splits, so a file is read by many tasks and never by Python."""
    sc = spark._jsc.sc()
    raw = sc.binaryRecords(path, length, sc.hadoopConfiguration())
    jdf = spark._jsparkSession.createDataset(raw, spark._jvm.org.apache.spark.sql.Encoders.BINARY()).toDF()
    rows = DataFrame(jdf, spark).toDF("bytes").withColumn("id", F.monotonically_increasing_id())
    part = F.shiftright("id", 33).alias("part")
    counts = rows.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a split
    base = counts.select("part", before.alias("base"))
    return rows.withColumn("part", part).join(F.broadcast(base), "part").select((F.col("base") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))).alias("pos"), "bytes")


def npy_header(spark: SparkSession, path: str) -> tuple[int, np.dtype, tuple[int, int]]:
    """(bytes before the data, dtype, shape) of a .npy file of two dimensions in row order."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        head = bytearray()
        while len(head) < 1 << 16 and (b := stream.read()) >= 0:
            head.append(b)
            if len(head) >= 10 and len(head) >= 10 + int.from_bytes(head[8:10], "little"):
                break
    finally:
        stream.close()
    buf = io.BytesIO(bytes(head))
    if np.lib.format.read_magic(buf) != (1, 0):
        raise ValueError("not a .npy file of version 1.0")
    shape, by_column, dtype = np.lib.format.read_array_header_1_0(buf)
    if len(shape) != 2 or by_column:
        raise ValueError("matrix must have two dimensions, in row order")
    return buf.tell(), dtype, shape


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """(row, vector) of a .npy file of two dimensions, read in splits.

    Records are as long as the greatest common divisor of header and row, and a row's records are put together again.
    """
    header, dtype, (n, dim) = npy_header(spark, path)
    length = dim * dtype.itemsize
    size = math.gcd(header, length)
    parts = records(spark, path, size).where(F.col("pos") >= header // size).withColumn("pos", F.col("pos") - header // size)
    each = length // size
    pieces = F.sort_array(F.collect_list(F.struct("pos", "bytes")))
    rows = parts.groupBy(F.floor(F.col("pos") / each).alias("row")).agg(F.aggregate(pieces, F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["bytes"])).alias("bytes"))

    def decode(batches):
        for batch in batches:
            got = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype).reshape(batch.num_rows, -1).astype(np.float32) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(got), pa.list_(pa.float32()))], ["row", "vector"])

    return rows.where(F.col("row") < n).mapInArrow(decode, "row bigint, vector array<float>")


def half_matrix(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """(row, vector) of a row-major half-precision file, read in fixed records, so it splits over tasks."""
    from passagemill.functions.vectors import from_half_bytes

    return records(spark, path, 2 * dim).select(F.col("pos").alias("row"), from_half_bytes("bytes").alias("vector"))


def yaml_rows(spark: SparkSession, path: str, schema: str, root: str) -> DataFrame:
    """Rows under a root key of a YAML file; the file is small by kind, and read by the driver through Spark."""
    import yaml

    text = spark.read.text(path, wholetext=True).first()[0]
    return spark.createDataFrame(yaml.safe_load(text)[root], schema)


def localized_triggers(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(topic, lang, token) of {topics: {id: {ar: [..], ur: [..]}}}; a broken file raises, or gives no rows."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "topics map<string,map<string,array<string>>>").alias("x"))
    if strict and raw.where("x.topics is null").limit(1).count():
        raise ValueError("no object of topics")
    t = raw.select(F.explode("x.topics").alias("topic", "langs"))
    return t.select("topic", F.explode("langs").alias("lang", "tokens")).select("topic", "lang", F.explode("tokens").alias("token"))


def files(spark: SparkSession, pattern: str) -> DataFrame:
    """(name, bytes, sha256) of files; a large file must fit into one row of an executor."""
    raw = spark.read.format("binaryFile").load(pattern)
    return raw.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def counted(spark: SparkSession, rows: DataFrame, expected: int, code: str = "W_ROW_COUNT") -> DataFrame:
    """An issue row (level, code, message, path) where a base table has another number of rows; a warning, so nothing fails."""
    n = rows.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != expected)
    return n.select(F.lit("warning").alias("level"), F.lit(code).alias("code"), F.concat(F.col("n"), F.lit(f" rows, expected {expected}")).alias("message"), F.lit("rows").alias("path"))
