"""Result structs and the versioned response envelope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.functions.text import lang_hint
from passagemill.functions.values import round6


def result(key: Column, major: Column, minor: Column, text: Column, lang: Column, display: Column, mode: Column, rrf: Column, bm25: Column, semantic: Column, meta: dict[str, Column] | None = None) -> Column:
    """One passage of a response; meta numbers default to 0, absent scores are null."""
    meta = meta or {}
    ints = [F.coalesce(meta.get(n, F.lit(None)).cast("int"), F.lit(0)).alias(n) for n in ("juz", "ruku", "page")]
    return F.struct(
        key.alias("verseKey"), major.cast("int").alias("surah"), minor.cast("int").alias("ayah"), F.coalesce(text, F.lit("")).alias("arabic"),
        F.struct(lang.alias("lang"), F.coalesce(display, F.lit("")).alias("text")).alias("display"), F.struct(*ints).alias("meta"),
        F.struct(mode.alias("mode"), round6(rrf).alias("rrf"), round6(bm25).alias("bm25"), round6(semantic).alias("semantic")).alias("score"),
    )


def envelope(results: DataFrame, queries: DataFrame, pack_version: str = "v1", version: int = 1) -> DataFrame:
    """(qid, response): all results of a query in rank order on one page; `results` has (qid, rank, result)."""
    listed = results.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "result"))).alias("x"))
    kind = results.schema["result"].dataType.simpleString()
    found = F.coalesce(F.transform("x", lambda e: e["result"]), F.array().cast(f"array<{kind}>"))
    n = F.size(found)
    page = F.struct(F.lit(0).alias("offset"), n.alias("limit"), n.alias("total"), F.lit(None).cast("int").alias("nextOffset"))
    query = F.struct(F.col("raw").alias("raw"), F.col("normalized").alias("normalized"), F.col("intent").alias("intent"), lang_hint(F.col("raw")).alias("langHint"))
    return queries.join(listed, "qid", "left").select(
        "qid", F.struct(F.lit(version).alias("version"), F.lit(pack_version).alias("packVersion"), query.alias("query"), page.alias("page"), found.alias("results")).alias("response")
    )


def to_json(c: Column) -> Column:
    """Compact JSON with null fields kept."""
    return F.to_json(c, {"ignoreNullFields": "false"})


def flat(results: DataFrame, preferred_en: Column, preferred_ur: Column) -> DataFrame:
    """The older flat result: key parts, names, text, two translations, score and match type."""
    names = ["verse_key", "surah", "ayah", "surah_name_arabic", "surah_name_english", "arabic", "transliteration"]
    return results.select(*names, preferred_en.alias("translation_en"), preferred_ur.alias("translation_ur"), round6(F.col("score")).alias("relevance_score"), "match_type")
