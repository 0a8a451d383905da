"""Rule queries: each rule is one select of issues, and a report is their union."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from passagemill.functions.text import has_arabic, key_part

ISSUE = ["level", "code", "message", "path"]


@dataclass(frozen=True)
class Bounds:
    sections: int = 114
    units: int = 286
    total: int = 6236
    ranges: int = 30


def issue(rows: DataFrame, level: str, code: str, message: Column, path: Column) -> DataFrame:
    return rows.select(F.lit(level).alias("level"), F.lit(code).alias("code"), message.cast("string").alias("message"), path.cast("string").alias("path"))


def report(*issues: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, issues)


def severity(found: DataFrame) -> DataFrame:
    return found.groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def exit_status(found: DataFrame, strict: bool = False) -> DataFrame:
    """One row `status`: 2 on any error, or on any warning when strict; else 0."""
    bad = F.count_if((F.col("level") == "error") | (F.lit(strict) & (F.col("level") == "warning")))
    return found.agg(F.when(bad > 0, 2).otherwise(0).alias("status"))


def first_issue(rows: DataFrame, rules: list[tuple[str, str, Column]], path: Column) -> DataFrame:
    """The first rule (level, code, condition) that each row breaks, as a short-circuit."""
    hit = F.coalesce(*(F.when(cond, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"))) for level, code, cond in rules))
    got = rows.select(hit.alias("hit"), path.cast("string").alias("path")).where("hit is not null")
    return got.select("hit.level", "hit.code", F.concat(F.lit("rule broken at "), "path").alias("message"), "path")


def sections(rows: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """Issues of (number, name_ar, name_en, name_tr, units, kind) rows; numbers come as text, so types can fail."""
    number, units = F.col("number").cast("string").try_cast("int"), F.col("units").cast("string").try_cast("int")
    path = F.concat(F.lit("sections["), F.coalesce(F.col("number").cast("string"), F.lit("?")), F.lit("]"))
    typed = first_issue(
        rows,
        [
            ("error", "E_SURAH_NUMBER_TYPE", number.isNull()), ("error", "E_SURAH_NUMBER_RANGE", ~number.between(1, bounds.sections)),
            ("error", "E_SURAH_VERSECOUNT_TYPE", units.isNull()), ("error", "E_SURAH_VERSECOUNT_RANGE", ~units.between(1, bounds.units)),
        ],
        path,
    )
    good = rows.withColumn("n", number).withColumn("u", units).where(F.col("n").between(1, bounds.sections))
    twice = good.groupBy("n").count().where("count > 1")
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    wanted = rows.sparkSession.range(1, bounds.sections + 1).select(F.col("id").cast("int").alias("n"))
    total = good.dropDuplicates(["n"]).agg(F.coalesce(F.sum("u"), F.lit(0)).alias("total"))
    order = good.withColumn("before", F.lag("n").over(W.orderBy("n"))).where("n <> before + 1 and n <> before")
    return report(
        typed,
        issue(twice, "error", "E_SURAH_DUP", F.concat(F.lit("listed "), F.col("count"), F.lit(" times")), F.col("n")),
        issue(wanted.join(good, "n", "left_anti"), "error", "E_SURAH_MISSING", F.lit("no such section"), F.col("n")),
        issue(good.where(blank("name_ar")), "warning", "W_SURAH_NAME_AR_EMPTY", F.lit("empty name"), path),
        issue(good.where(~blank("name_ar") & ~has_arabic(F.col("name_ar"))), "warning", "W_SURAH_NAME_AR_NONAR", F.lit("name in another script"), path),
        issue(good.where(blank("name_en")), "warning", "W_SURAH_NAME_EN_EMPTY", F.lit("empty name"), path),
        issue(good.where(blank("name_tr")), "warning", "W_SURAH_NAME_TR_EMPTY", F.lit("empty name"), path),
        issue(good.where(~F.coalesce(F.lower("kind"), F.lit("")).isin("meccan", "medinan")), "warning", "W_SURAH_REVELATION_TYPE", F.lit("unknown kind"), path),
        issue(order, "warning", "W_SURAH_NONSEQUENTIAL", F.concat(F.lit("follows "), "before"), F.col("n")),
        issue(total.where(F.col("total") != bounds.total), "warning", "W_TOTAL_VERSE_COUNT", F.concat(F.lit("total "), "total"), F.lit("sections")),
    )


def ranges(rows: DataFrame, counts: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """Issues of (number, start, end) ranges of keys over sections (major, units)."""
    number = F.col("number").cast("string").try_cast("int")
    path = F.concat(F.lit("ranges["), F.coalesce(F.col("number").cast("string"), F.lit("?")), F.lit("]"))
    r = rows.withColumns({"n": number, "sm": key_part(F.col("start"), 1), "sn": key_part(F.col("start"), 2), "em": key_part(F.col("end"), 1), "en": key_part(F.col("end"), 2)})
    before = F.coalesce(F.sum("units").over(W.orderBy("major").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    at = counts.withColumn("before", before)
    for side in ("s", "e"):
        r = r.join(F.broadcast(at.select(F.col("major").alias(f"{side}m"), F.col("units").alias(f"{side}u"), F.col("before").alias(f"{side}b"))), f"{side}m", "left")
    r = r.withColumns({"lo": F.col("sb") + F.col("sn"), "hi": F.col("eb") + F.col("en")})
    outside = lambda c: ~F.col(c).between(1, bounds.sections)
    typed = first_issue(
        r,
        [
            ("error", "E_JUZ_NUM_TYPE", F.col("n").isNull()), ("error", "E_JUZ_NUM_RANGE", ~F.col("n").between(1, bounds.ranges)),
            ("error", "E_JUZ_STARTEND_TYPE", F.col("start").isNull() | F.col("end").isNull()),
            ("error", "E_VERSEKEY_START", F.col("sm").isNull() | F.col("sn").isNull()), ("error", "E_VERSEKEY_END", F.col("em").isNull() | F.col("en").isNull()),
            ("error", "E_VERSEKEY_SURAH_RANGE", outside("sm") | outside("em")), ("error", "E_VERSEKEY_SURAH_UNKNOWN", F.col("su").isNull() | F.col("eu").isNull()),
            ("error", "E_VERSEKEY_AYAH_RANGE_START", ~F.col("sn").between(1, F.col("su"))), ("error", "E_VERSEKEY_AYAH_RANGE_END", ~F.col("en").between(1, F.col("eu"))),
            ("error", "E_JUZ_ORDER", F.col("lo") > F.col("hi")),
        ],
        path,
    )
    good = r.where(F.col("n").between(1, bounds.ranges))
    twice = good.groupBy("n").count().where("count > 1")
    wanted = rows.sparkSession.range(1, bounds.ranges + 1).select(F.col("id").cast("int").alias("n"))
    once = good.withColumn("copy", F.row_number().over(W.partitionBy("n").orderBy("lo", "hi"))).where("copy = 1")
    ordered = once.withColumn("last_hi", F.lag("hi").over(W.orderBy("n")))
    first, last = ordered.where("n = 1 and lo <> 1"), ordered.where(F.col("n") == bounds.ranges).crossJoin(F.broadcast(counts.agg(F.sum("units").alias("all_units")))).where("hi <> all_units")
    return report(
        typed,
        issue(twice, "error", "E_JUZ_DUP", F.concat(F.lit("listed "), F.col("count"), F.lit(" times")), F.col("n")),
        issue(wanted.join(good, "n", "left_anti"), "error", "E_JUZ_MISSING", F.lit("no such range"), F.col("n")),
        issue(first, "error", "E_JUZ_FIRST_START", F.lit("does not start the corpus"), path),
        issue(last, "error", "E_JUZ_LAST_END", F.lit("does not end the corpus"), path),
        issue(ordered.where("last_hi is not null and lo <> last_hi + 1"), "error", "E_JUZ_CONTIGUITY", F.concat(F.lit("starts at "), "lo", F.lit(" after "), "last_hi"), path),
    )


def compare_counts(local: DataFrame, other: DataFrame) -> DataFrame:
    """Section sizes (major, units) against a second source."""
    both = local.select("major", F.col("units").alias("a")).join(other.select("major", F.col("units").alias("b")), "major", "full_outer")
    return issue(both.where("not (a <=> b)"), "error", "E_ONLINE_SURAH_VERSECOUNT_MISMATCH", F.concat_ws(" vs ", F.coalesce(F.col("a").cast("string"), F.lit("none")), F.coalesce(F.col("b").cast("string"), F.lit("none"))), F.col("major"))


def compare_ranges(local: DataFrame, other: DataFrame) -> DataFrame:
    """Ranges (number, start, end) against a second source; one that the source lacks is a warning."""
    both = local.select("number", F.struct("start", "end").alias("a")).join(other.select("number", F.struct("start", "end").alias("b")), "number", "left")
    return report(
        issue(both.where("b is null"), "warning", "W_ONLINE_JUZ_MISSING", F.lit("not in the other source"), F.col("number")),
        issue(both.where("b is not null and a <> b"), "error", "E_ONLINE_JUZ_BOUNDARY_MISMATCH", F.concat_ws(" ", "a.start", "a.end", F.lit("vs"), "b.start", "b.end"), F.col("number")),
    )


def topic_pack(keys: DataFrame, topics: DataFrame, corpus: DataFrame, topic: str, key: str, most: int, kind: str) -> DataFrame:
    """Key lists of topics or groups: not empty, at most `most`, unique, known."""
    n = keys.groupBy(topic).agg(F.count(F.lit(1)).alias("n"))
    return report(
        issue(topics.join(keys, topic, "left_anti"), "error", f"E_{kind}_EMPTY", F.lit("no keys"), F.col(topic)),
        issue(n.where(F.col("n") > most), "error", f"E_{kind}_TOO_MANY", F.col("n"), F.col(topic)),
        issue(keys.groupBy(topic, key).count().where("count > 1"), "error", f"E_{kind}_DUP", F.col(key), F.col(topic)),
        issue(keys.join(corpus.select(key).distinct(), key, "left_anti"), "error", f"E_{kind}_UNKNOWN", F.col(key), F.col(topic)),
    )


def variants(rows: DataFrame, most: int = 12) -> DataFrame:
    """(canonical, variant) lists: names and variants not empty, at most `most`, unique."""
    n = rows.groupBy("canonical").agg(F.count(F.lit(1)).alias("n"))
    return report(
        issue(n.where("trim(canonical) = ''"), "error", "E_VARIANT_KEY_EMPTY", F.lit("empty name"), F.col("canonical")),
        issue(n.where(F.col("n") > most), "error", "E_VARIANT_TOO_MANY", F.col("n"), F.col("canonical")),
        issue(rows.where("trim(coalesce(variant, '')) = ''"), "error", "E_VARIANT_EMPTY", F.lit("empty variant"), F.col("canonical")),
        issue(rows.groupBy("canonical", "variant").count().where("count > 1"), "error", "E_VARIANT_DUP", F.col("variant"), F.col("canonical")),
    )


def templates(rows: DataFrame) -> DataFrame:
    """(template, section, key) lists: every section has keys, each once; a section without keys has a null key."""
    n = rows.groupBy("template", "section").agg(F.count("key").alias("n"))
    path = F.concat_ws("/", "template", "section")
    return report(
        issue(n.where("n = 0"), "error", "E_TEMPLATE_SECTION_EMPTY", F.lit("no keys"), path),
        issue(rows.where("key is not null").groupBy("template", "section", "key").count().where("count > 1"), "error", "E_TEMPLATE_DUP", F.col("key"), path),
    )


def compiled_topics(ids: DataFrame, keys: DataFrame, corpus: DataFrame) -> DataFrame:
    """Unique topic ids; keys (topic, place, major, minor) in numeric order and known to the corpus."""
    before = F.lag(F.struct("major", "minor")).over(W.partitionBy("topic").orderBy("place"))
    wrong = keys.withColumn("before", before).where(F.col("before") >= F.struct("major", "minor"))
    return report(
        issue(ids.groupBy("topic").count().where("count > 1"), "error", "E_TOPIC_DUP", F.col("count"), F.col("topic")),
        issue(wrong, "error", "E_TOPIC_ORDER", F.concat_ws(":", "major", "minor"), F.col("topic")),
        issue(keys.join(corpus.select("major", "minor").distinct(), ["major", "minor"], "left_anti"), "error", "E_TOPIC_UNKNOWN", F.concat_ws(":", "major", "minor"), F.col("topic")),
    )


def pack_integrity(rows: DataFrame, index: DataFrame, matrix_bytes: Column | int, dim: int, listed: int) -> DataFrame:
    """A pack's line count, matrix size and key alignment: `rows` (row, key), `index` (row, key)."""
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    both = rows.select("row", F.col("key").alias("a")).join(index.select("row", F.col("key").alias("b")), "row", "full_outer")
    size = F.lit(matrix_bytes) if isinstance(matrix_bytes, int) else matrix_bytes
    return report(
        issue(n.where(F.col("n") != listed), "error", "E_PACK_LINES", F.col("n"), F.lit("rows")),
        issue(n.where(size != F.col("n") * dim * 2), "error", "E_PACK_MATRIX_BYTES", size, F.lit("matrix")),
        issue(both.where("not (a <=> b)"), "error", "E_PACK_ALIGNMENT", F.concat_ws(" vs ", F.coalesce("a", F.lit("none")), F.coalesce("b", F.lit("none"))), F.col("row")),
    )


def root_keys(spark, path: str) -> DataFrame:
    """Issues of a metadata file's root: unreadable, not JSON, not an object, or without its two lists."""
    rule = lambda code, why: spark.createDataFrame([("error", code, why, path)], ", ".join(f"{c} string" for c in ISSUE))
    try:
        text = spark.read.text(path, wholetext=True)
        text = text.select(F.expr("try_parse_json(value)").alias("v")).limit(1).select(F.schema_of_variant("v").alias("kind"), F.expr("try_variant_get(v, '$.surahs', 'variant')").alias("s"), F.expr("try_variant_get(v, '$.juz_mappings', 'variant')").alias("j"))
        got = text.select("kind", F.col("s").isNull(), F.col("j").isNull(), F.schema_of_variant("s")).first()
    except Exception as e:  # the reader's own error becomes an issue row
        return rule("E_FILE_NOT_FOUND" if "PATH_NOT_FOUND" in str(e) else "E_JSON_READ", str(e)[:200])
    if got is None or got[0] is None:
        return rule("E_JSON_PARSE", "not JSON")
    if not got[0].startswith("OBJECT"):
        return rule("E_JSON_ROOT", got[0][:100])
    found = [rule("E_MISSING_SURAHS", "no list of sections")] if got[1] else [rule("E_SURAHS_TYPE", got[3][:100])] if not got[3].startswith("ARRAY") else []
    found += [rule("E_MISSING_JUZ", "no list of ranges")] if got[2] else []
    return report(*found) if found else spark.createDataFrame([], ", ".join(f"{c} string" for c in ISSUE))


# --- JSON Schema -----------------------------------------------------------------------------------

_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(value, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, _KINDS[kind])


def schema_errors(value, schema: dict | bool, at: str = "") -> list[tuple[str, str]]:
    """(pointer, keyword) of every rule of a JSON Schema that a value breaks, sorted; rules of types, numbers, texts, lists and objects."""
    if schema is True:
        return []
    if schema is False:
        return [(at, "false")]
    step = lambda k: f"{at}/{str(k).replace('~', '~0').replace('/', '~1')}"
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [(at, "type")]
    out = [(at, k) for k, bad in (("enum", "enum" in schema and value not in schema["enum"]), ("const", "const" in schema and value != schema["const"])) if bad]
    if _is(value, "number"):
        out += [(at, k) for k, bad in (("minimum", value < schema.get("minimum", value)), ("maximum", value > schema.get("maximum", value))) if bad]
    if isinstance(value, str):
        out += [(at, "minLength")] * (len(value) < schema.get("minLength", 0)) + [(at, "pattern")] * ("pattern" in schema and not re.search(schema["pattern"], value))
    if isinstance(value, list):
        out += [(at, "minItems")] * (len(value) < schema.get("minItems", 0)) + [(at, "maxItems")] * (len(value) > schema.get("maxItems", len(value)))
        if schema.get("uniqueItems") and len({json.dumps(x, sort_keys=True) for x in value}) < len(value):
            out.append((at, "uniqueItems"))
        if "items" in schema:
            out += [e for i, x in enumerate(value) for e in schema_errors(x, schema["items"], step(i))]
    if isinstance(value, dict):
        out += [(at, "required") for k in schema.get("required", []) if k not in value]
        known = schema.get("properties", {})
        more = schema.get("additionalProperties", True)
        out += [(at, "additionalProperties")] * (more is False and any(k not in known for k in value))
        out += [e for k, x in value.items() if k in known or more is not False for e in schema_errors(x, known.get(k, more), step(k))]
    return sorted(out)


def json_schema(rows: DataFrame, id_col: str, json_col: str, schema: dict) -> DataFrame:
    """Issues (id, level, code, message, path) of JSON texts: every broken rule by its pointer; a text that is no JSON has one issue, null none."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            out = []
            for i, text in enumerate(b.column(1).to_pylist()):
                if text is None:
                    continue
                try:
                    out += [(i, "E_SCHEMA", rule, at or "/") for at, rule in schema_errors(json.loads(text), schema)]
                except ValueError:
                    out.append((i, "E_JSON_PARSE", "not JSON", "/"))
            at = pa.array([x[0] for x in out], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array(["error"] * len(out), pa.string()), *(pa.array([x[k] for x in out], pa.string()) for k in (1, 2, 3))], ["id", *ISSUE])

    return rows.select(F.col(id_col).alias("id"), F.col(json_col).alias("j")).mapInArrow(run, f"id {kind}, " + ", ".join(f"{c} string" for c in ISSUE)).withColumnRenamed("id", id_col)
