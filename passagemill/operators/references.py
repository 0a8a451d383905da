"""Explicit references, nicknames, aliases and routing, for batches of queries.

Queries are (qid, raw). Alias tables are parameters: (alias, section) rows and (alias, target) rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.functions import text as T
from passagemill.operators.sizes import small

# Words that mark a structural query, separators and connectors of references.
STRUCTURE = (
    "surah sura surat surah: sura: chapter chap ch ayah aya aayah ayat aayat verse verses سورة سورۃ سورت سورہ آية اية آیت آیہ"
).split()
SEPARATOR = r"[:;،,\-–—/\.：]"
CONNECTOR = r"(?:\-|–|—|\bto\b)"
SECTION_WORDS = "(?:surah|sura|surat|chapter|ch)"
UNIT_WORDS = "(?:ayah|aya|aayah|ayat|aayat|verse)"


@dataclass(frozen=True)
class ReferenceConfig:
    sections: int = 114
    units: int = 286
    #: The word patterns are searched anywhere, so "verse 2:255-257" loses its end; True anchors a range instead.
    keep_range_after_word: bool = False
    #: Least confidence; the default takes any.
    least_confidence: float = 0.0
    compat: bool = True  # compatibility normalization of queries (an Arrow UDF)


def _pair(q: Column, pattern: str) -> tuple[Column, Column, Column]:
    pattern = f"(?i){pattern}"
    hit = q.rlike(pattern)
    return hit, F.regexp_extract(q, pattern, 1).try_cast("int"), F.regexp_extract(q, pattern, 2).try_cast("int")


def parse(queries: DataFrame, nicknames: dict[str, str], strict: DataFrame, loose: DataFrame, counts: DataFrame | None = None, cfg: ReferenceConfig = ReferenceConfig()) -> DataFrame:
    """(qid, raw, ref) with ref = struct(type, major, minor, minor_end, confidence) or null.

    Nicknames first, then seven patterns in order, then aliases by leftmost start and longest match.
    `strict` and `loose` have (alias, major); `counts` has (major, units) where section sizes are known.
    """
    q = queries.select("qid", "raw", T.number_form(F.col("raw"), cfg.compat).alias("num"), T.match_form(F.col("raw"), cfg.compat).alias("norm"))
    q = q.withColumn("simple", T.nickname_form(F.col("norm")))
    # Section sizes as one literal-sized map column: at most cfg.sections entries.
    if counts is not None:
        sizes = counts.where(F.col("major").between(1, cfg.sections)).agg(F.map_from_entries(F.collect_list(F.struct(F.col("major").cast("int"), F.col("units").cast("int")))).alias("sizes"))
        q = q.crossJoin(F.broadcast(sizes))
    else:
        q = q.withColumn("sizes", F.lit(None).cast("map<int,int>"))

    def valid(major: Column, minor: Column) -> Column:
        most = F.coalesce(F.try_element_at("sizes", major), F.lit(cfg.units))
        return major.between(1, cfg.sections) & minor.between(1, F.least(most, F.lit(cfg.units)) if counts is None else F.when(most > 0, most).otherwise(cfg.units)) & (minor <= cfg.units)

    def ref(kind: str | Column, major: Column, minor: Column, end: Column, confidence: Column) -> Column:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return F.struct(kind.alias("type"), major.cast("int").alias("major"), minor.cast("int").alias("minor"), end.cast("int").alias("minor_end"), confidence.cast("double").alias("confidence"))

    none, num = F.lit(None).cast("int"), F.col("num")
    named = []
    for nick, key in nicknames.items():
        form = " ".join("".join(c if c.isascii() and (c.isalnum() or c.isspace()) else " " for c in nick.lower()).split())
        major, minor = key.split(":")
        hit = F.contains(F.concat(F.lit(" "), F.col("simple"), F.lit(" ")), F.lit(f" {form} "))
        named.append(F.when(hit, ref("nickname", F.lit(int(major)), F.lit(int(minor)), none, F.lit(1.0))))

    found = []
    sep = SEPARATOR
    range_pattern = rf"^\s*(\d{{1,3}})\s*{sep}\s*(\d{{1,3}})\s*{CONNECTOR}\s*(\d{{1,3}})\s*$"
    anywhere = rf"{UNIT_WORDS}?\s*(\d{{1,3}})\s*{sep}\s*(\d{{1,3}})\s*{CONNECTOR}\s*(\d{{1,3}})\s*$"
    patterns = [
        ("ref_pair", rf"^\s*(\d{{1,3}})\s*{sep}\s*(\d{{1,3}})\s*$"),
        ("ref_range_same_surah", anywhere if cfg.keep_range_after_word else range_pattern),
        ("surah_ayah_words", rf"(?:{SECTION_WORDS}\s*)?(\d{{1,3}})\s+{UNIT_WORDS}\s*(?:[:\-]?\s*)?(\d{{1,3}})"),
        ("verse_ref_words", rf"{UNIT_WORDS}\s+(\d{{1,3}})\s*{sep}\s*(\d{{1,3}})"),
        ("chapter_verse_words", rf"{SECTION_WORDS}\s+(\d{{1,3}})\s+{UNIT_WORDS}\s+(\d{{1,3}})"),
        ("ref_space_pair", r"^\s*(\d{1,3})\s+(\d{1,3})\s*$"),
    ]
    for kind, pattern in patterns:
        hit, major, minor = _pair(num, pattern)
        if kind == "ref_range_same_surah":
            last = F.regexp_extract(num, f"(?i){pattern}", 3).try_cast("int")
            low, high = F.least(minor, last), F.greatest(minor, last)
            found.append(F.when(hit & valid(major, low) & valid(major, high), ref(kind, major, low, high, F.lit(1.0))))
        else:
            found.append(F.when(hit & valid(major, minor), ref(kind, major, minor, none, F.lit(1.0))))
    alone = F.when(num.rlike(r"^[1-9]\d{0,2}$"), num.try_cast("int"))
    found.append(F.when(alone.between(1, cfg.sections), ref("surah_only_number", alone, F.lit(1), none, F.lit(0.85))))
    q = q.withColumn("direct", F.coalesce(*named, *found))

    words = F.filter(F.split("norm", " "), lambda t: t != "")
    left = q.where(F.col("direct").isNull()).select("qid", "norm", words.alias("words"))
    structural, n = F.exists("words", lambda t: t.isin(STRUCTURE)), F.size("words")
    s, loose_hit = _scan_aliases(left, strict, cfg), _scan_aliases(left, loose, cfg)
    by_alias = left.join(s.withColumnRenamed("major", "strict"), "qid", "left").join(loose_hit.withColumnRenamed("major", "loose"), "qid", "left").select(
        "qid",
        F.coalesce("strict", F.when(structural | (n == 1), F.col("loose"))).alias("alias_major"),
        F.when(F.col("strict").isNotNull(), F.when(structural, 0.9).when(n <= 2, 0.8).otherwise(0.65)).when(structural, 0.75).when(n == 1, 0.6).alias("alias_confidence"),
    ).where("alias_major is not null")
    q = q.join(by_alias, "qid", "left")
    worded = F.regexp_extract(num, rf"(?i){UNIT_WORDS}\s*[:\-]?\s*(\d{{1,3}})", 1).try_cast("int")
    tail = F.when((F.size(words) <= 3) & F.element_at(words, -1).rlike(r"^\d{1,9}$"), F.element_at(words, -1).try_cast("int"))
    minor = F.coalesce(worded, F.when(tail.between(1, 286), tail))
    major, confidence = F.col("alias_major"), F.col("alias_confidence")
    aliased = F.when(
        major.isNotNull(),
        F.when(minor.isNull(), ref("surah_name", major, F.lit(1), none, F.least(confidence, F.lit(0.75)))).when(
            valid(major, minor), ref("surah_name", major, minor, none, F.round(F.least(F.lit(0.9), confidence + 0.1), 6))
        ),
    )
    got = F.coalesce("direct", aliased)
    return q.select("qid", "raw", F.when(got["confidence"] >= cfg.least_confidence, got).alias("ref"))


def _scan_aliases(queries: DataFrame, aliases: DataFrame, cfg: ReferenceConfig) -> DataFrame:
    """(qid, major): the alias that starts first, the longest of those."""
    known = aliases.select(T.match_form(F.col("alias"), cfg.compat).alias("gram"), F.col("major").cast("int").alias("major")).where("gram <> ''")
    longest = F.size(F.split("gram", " "))
    known = known.groupBy("gram").agg(F.max("major").alias("major")).withColumn("len", longest)
    lens = known.select("len").distinct()
    grams = queries.crossJoin(F.broadcast(lens)).where(F.size("words") >= F.col("len"))
    starts = grams.select("qid", "words", "len", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("len"))).alias("start"))
    starts = starts.select("qid", "start", "len", F.concat_ws(" ", F.slice("words", F.col("start") + 1, F.col("len"))).alias("gram"))
    return starts.join(small(known.drop("len")), "gram").groupBy("qid").agg(F.min_by("major", F.struct("start", -F.col("len"))).alias("major"))


def expand(refs: DataFrame, corpus: DataFrame) -> DataFrame:
    """Rows of `corpus` (major, minor, ...) that each reference names, ranges included; missing ones are skipped."""
    hit = refs.where("ref is not null").select("qid", F.col("ref.major").alias("major"), F.explode(F.sequence("ref.minor", F.coalesce("ref.minor_end", "ref.minor"))).alias("minor"), F.col("ref.confidence").alias("score"))
    return corpus.join(hit, ["major", "minor"])


def expand_targets(targets: DataFrame) -> DataFrame:
    """(alias, ord, major, minor) of target expressions (alias, target): a comma list of "s:a-b", "s:a", "s1-s2" and "s".

    A range of sections, like a single one, names the first unit of each; other parts are ignored.
    """
    part = F.trim(F.col("part"))
    t = targets.select("alias", F.posexplode(F.split("target", ",")).alias("ord", "part"))
    full, one, many, single = r"^(\d+)\s*:\s*(\d+)\s*-\s*(\d+)$", r"^(\d+)\s*:\s*(\d+)$", r"^(\d+)\s*-\s*(\d+)$", r"^(\d+)$"
    get = lambda p, i: F.regexp_extract(part, p, i).try_cast("int")
    units = lambda major, a, b: F.transform(F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>")), lambda x: F.struct(major.alias("major"), x.alias("minor")))
    firsts = lambda a, b: F.transform(F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>")), lambda x: F.struct(x.alias("major"), F.lit(1).alias("minor")))
    keys = (
        F.when(part.rlike(full), units(get(full, 1), get(full, 2), get(full, 3)))
        .when(part.rlike(one), units(get(one, 1), get(one, 2), get(one, 2)))
        .when(part.rlike(many), firsts(get(many, 1), get(many, 2)))
        .when(part.rlike(single), firsts(get(single, 1), get(single, 1)))
    )
    return t.select("alias", "ord", F.explode(keys).alias("k")).select("alias", "ord", "k.major", "k.minor")


def lookup_aliases(queries: DataFrame, targets: DataFrame, compat: bool = True) -> DataFrame:
    """(qid, major, minor): whole-query alias matches, each key once, in numeric order."""
    q = queries.select("qid", T.alias_form(F.col("raw"), compat).alias("alias"))
    known = targets.select(T.alias_form(F.col("alias"), compat).alias("alias"), "target")
    return q.join(small(expand_targets(known)), "alias").select("qid", "major", "minor").distinct()


def structural_order(keys: DataFrame) -> DataFrame:
    """(qid, major, minor, ord): each key of a query once, in numeric order."""
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("qid").orderBy("major", "minor"))
    return keys.select("qid", "major", "minor").distinct().withColumn("ord", place)


def route(parsed: DataFrame, resolved: DataFrame, aliased: DataFrame, has_vectors: bool = True) -> DataFrame:
    """(qid, intent): structural where a reference or an alias resolves to rows, else hybrid or lexical; empty queries are lexical."""
    hit = resolved.select("qid").union(aliased.select("qid")).distinct().withColumn("hit", F.lit(True))
    rest = F.when(F.trim(F.coalesce("raw", F.lit(""))) == "", "lexical").otherwise("hybrid" if has_vectors else "lexical")
    return parsed.join(hit, "qid", "left").select("qid", F.when(F.col("hit"), "structural").otherwise(rest).alias("intent"))
