"""Joins and statistics of the dataset build."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from passagemill.functions.text import join_filled
from passagemill.operators.sizes import small


def with_sections(passages: DataFrame, sections: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Section columns by a left join; missing text is ''."""
    got = passages.join(small(sections.select(key, *columns)), key, "left")
    return got.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns})


def position(major: Column, minor: Column, offset: Column) -> Column:
    """Place of a key in the whole corpus; `offset` is the units before its section."""
    return offset + minor


def with_ranges(rows: DataFrame, at: str, ranges: DataFrame, width: int = 1) -> DataFrame:
    """Left range join: the first range (name, lo, hi, ord), by ord, that holds `at`, both ends included.

    Ranges are cut into bins of `width`, so the join is an equi-join whatever the sizes.
    """
    bins = ranges.select("name", "lo", "hi", "ord", F.explode(F.expr(f"sequence(floor(lo / {width}), floor(hi / {width}))")).alias("bin"))
    keyed = rows.withColumn("bin", F.floor(F.col(at) / width))
    # At most one range a row is kept before the join wherever ranges do not overlap; ties go by ord.
    inside = (keyed["bin"] == bins["bin"]) & (keyed[at] >= bins["lo"]) & (keyed[at] <= bins["hi"])
    cols = [keyed[c] for c in rows.columns]
    joined = keyed.join(small(bins), inside, "left").select(*cols, bins["name"], bins["ord"])
    return joined.groupBy(*rows.columns).agg(F.min_by("name", "ord").alias("name"))


def translations(long: DataFrame, key: str = "key", lang: str = "lang", translator: str = "translator", text: str = "text") -> DataFrame:
    """(key, lang, texts): one map translator -> text for each language of each passage, sorted by translator."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(translator).alias("key"), F.col(text).alias("value"))))
    once = long.where(F.col(text).isNotNull()).groupBy(key, lang, translator).agg(F.min(text).alias(text))
    return once.groupBy(key, lang).agg(F.map_from_entries(pairs).alias("texts"))


def missing_translations(keys: DataFrame, long: DataFrame, key: str = "key", translator: str = "translator") -> DataFrame:
    """(translator, key) pairs without a text; the translators are few."""
    wanted = keys.select(key).crossJoin(small(long.select(translator).distinct()))
    return wanted.join(long.select(key, translator).distinct(), [key, translator], "left_anti").select(translator, key)


def searchable(*parts: Column) -> Column:
    return join_filled(*parts)


def stats(passages: DataFrame, section: str) -> DataFrame:
    return passages.agg(F.count(F.lit(1)).alias("total"), F.countDistinct(section).alias("sections"))


def missing_keys(keys: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return keys.join(known.select(key).distinct(), key, "left_anti")


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def density(rows: DataFrame, major: str, minor: str, first: int = 1) -> DataFrame:
    """Sections whose minor numbers are not first..n."""
    g = rows.groupBy(major).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(minor).alias("distinct_n"), F.min(minor).alias("low"), F.max(minor).alias("high"))
    return g.where((F.col("low") != first) | (F.col("high") != F.col("n") + first - 1) | (F.col("distinct_n") != F.col("n")))


def null_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_null): null or empty values."""
    counts = [F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == "")).alias("n_null")) for c in columns]
    return rows.agg(F.array(*counts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def offsets(sections: DataFrame, order: str, size: str) -> DataFrame:
    """Units before each section; the sections fit into one window."""
    w = W.orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return sections.withColumn("offset", F.coalesce(F.sum(size).over(w), F.lit(0)))


def gaps(ranges: DataFrame, partition: list[str], order: str, lo: str, hi: str) -> DataFrame:
    """Ranges that do not start right after the one before."""
    before = F.lag(hi).over(W.partitionBy(*partition).orderBy(order))
    return ranges.withColumn("before", before).where(F.col("before").isNotNull() & (F.col(lo) != F.col("before") + 1))


def key_at(positions: DataFrame, at: str, sections: DataFrame, major: str, size: str) -> DataFrame:
    """The inverse of `position`: (major, minor) of places in the corpus, by a range join on the sections' offsets."""
    spans = offsets(sections.select(major, size), major, size)
    ranges = spans.select(F.col(major).cast("string").alias("name"), (F.col("offset") + 1).alias("lo"), (F.col("offset") + F.col(size)).alias("hi"), F.col(major).alias("ord"))
    got = with_ranges(positions, at, ranges.where("lo <= hi"), 1000).withColumn(major, F.col("name").try_cast("int"))
    return got.join(F.broadcast(spans.select(major, "offset")), major, "left").withColumn("minor", F.col(at) - F.col("offset")).drop("name", "offset")


def build(passages: DataFrame, sections: DataFrame, ranges: DataFrame, long: DataFrame, preferred: dict[str, list[str]]) -> DataFrame:
    """The unified passages with their 18 fields.

    `passages` has (major, minor, text, transliteration, transliteration_alt, en, ur, merit), `sections` (major, name_ar, name_en, name_tr, kind, units),
    `ranges` (name, lo, hi, ord) over places in the corpus, `long` (key, lang, translator, text). Missing texts are '', missing maps empty.
    """
    from passagemill.functions.values import preferred as pick

    key = F.concat_ws(":", "major", "minor")
    places = offsets(sections.select("major", "units"), "major", "units")
    rows = with_sections(passages.withColumn("key", key), sections, "major", ["name_ar", "name_en", "name_tr", "kind"])
    rows = rows.join(small(places.select("major", "offset")), "major", "left").withColumn("at", position(F.col("major"), F.col("minor"), F.col("offset")))
    rows = with_ranges(rows, "at", ranges, 1000).withColumn("range", F.col("name").try_cast("int")).drop("name")
    texts = translations(long)
    empty = F.create_map().cast("map<string,string>")
    for lang in ("en", "ur"):
        own = texts.where(F.col("lang") == lang).select("key", F.col("texts").alias(f"texts_{lang}"))
        rows = rows.join(own, "key", "left").withColumn(f"texts_{lang}", F.coalesce(f"texts_{lang}", empty))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    best = [pick(F.col(f"texts_{lang}"), preferred.get(lang, [])) for lang in ("ur", "en")]
    return rows.select(
        F.col("key").alias("id"), F.col("key").alias("verse_key"), F.col("major").alias("surah"), F.col("minor").alias("ayah"), F.col("name_ar").alias("surah_name_arabic"), F.col("name_en").alias("surah_name_english"),
        F.col("name_tr").alias("surah_name_transliteration"), F.col("kind").alias("revelation_type"), blank("text").alias("arabic"), blank("transliteration").alias("transliteration"),
        blank("transliteration_alt").alias("transliteration_alt"), blank("en").alias("translation_en_builtin"), blank("ur").alias("translation_ur_builtin"), F.col("texts_ur").alias("translations_urdu"),
        F.col("texts_en").alias("translations_english"), F.col("range").alias("juz"), F.col("merit").cast("int").alias("hasanat"),
        searchable(F.col("text"), F.col("transliteration"), F.col("en"), F.col("ur"), F.col("name_ar"), F.col("name_en"), *best).alias("searchable_text"),
    )
