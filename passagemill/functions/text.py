"""Text normalization and tokenization as Column expressions.

Everything stays in whole-stage codegen but compatibility normalization (NFKC) and full case folding,
which Spark lacks: those two run as one Arrow UDF, and only on rows with a non-ASCII character.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Characters and word lists that results depend on.
INVISIBLE = "​‌‍‎‏‪‫‬‭‮⁠﻿"
TATWEEL = "ـ"
DIGITS_FROM, DIGITS_TO = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789"
PUNCTUATION = "،؛؟,;?“”\"‘’'()[]{}" + TATWEEL
ALEF_FROM, ALEF_TO = "أإآٱ", "اااا"
YEH_FROM, YEH_TO = "ىئی", "ييي"
WAW_FROM, WAW_TO = "ؤ", "و"
LETTERS_FROM, LETTERS_TO = "کگہھۀۂە", "ككههههه"
TEH_FROM, TEH_TO = "ةۃ", "هه"
HAMZA = "ء"
ARABIC = "؀-ۿݐ-ݿࢠ-ࣿ"
TOPIC_DIACRITICS = "[ً-ٰٟۖ-ۭ]"
URDU_PUNCTUATION = "،؛؟۔٫٬‘’“”"
LATIN_STOPWORDS = (
    "the a an and or of in on at for from by with is are was were be been being to that this these those as it"
).split()
QUERY_STOPWORDS = (
    "the a an and or of to in on for with about what does do did is are was were be been being say says said tell me please show find explain "
    "this that these those it its as at from by quran koran"
).split()
STEM_PREFIXES = "وفبكلس"
STEM_SUFFIXES = ("ه", "ها", "هم", "هن", "كما", "كم", "كن", "نا", "ي", "ية", "ات", "ون", "ين")


@dataclass(frozen=True)
class Normalization:
    """Switches of `normalize`; the two presets are SEARCH and AGGRESSIVE."""

    nfkc: bool = True
    invisibles: bool = True
    tatweel: bool = True
    marks: bool = True
    alef: bool = True
    yeh: bool = True
    waw_hamza: bool = True
    teh_marbuta: bool = False
    letters: bool = True
    drop_hamza: bool = False
    digits: bool = True
    punctuation: bool = True
    whitespace: bool = True
    casefold: bool = True


SEARCH = Normalization()
AGGRESSIVE = Normalization(teh_marbuta=True, drop_hamza=True)


#: Texts changed at once: only so many are held as Python strings, whatever a batch holds.
AT_ONCE = 64


def _by_text(change: Callable[[str], str]):
    most = AT_ONCE

    def run(texts: pa.Array) -> pa.Array:
        parts = (texts.slice(i, most).to_pylist() for i in range(0, len(texts), most))
        return pa.concat_arrays([pa.array([x if x is None else change(x) for x in part], pa.string()) for part in parts] or [pa.array([], pa.string())])

    return F.arrow_udf(run, StringType())


_nfkc = _by_text(lambda x: unicodedata.normalize("NFKC", x))
_casefold = _by_text(lambda x: x.casefold())


def nfkc(c: Column) -> Column:
    return F.when(c.rlike(r"[^\x00-\x7F]"), _nfkc(F.when(c.rlike(r"[^\x00-\x7F]"), c))).otherwise(c)


def casefold(c: Column) -> Column:
    """Full case folding; equal to lower() on ASCII."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), _casefold(F.when(c.rlike(r"[^\x00-\x7F]"), c))).otherwise(F.lower(c))


def squeeze(c: Column) -> Column:
    """Runs of Unicode white space become one space; the ends are trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def ascii_digits(c: Column) -> Column:
    return F.translate(c, DIGITS_FROM, DIGITS_TO)


def normalize(c: Column, cfg: Normalization = SEARCH) -> Column:
    """Search form of a text; null and empty give ''."""
    c = F.coalesce(c, F.lit(""))
    if cfg.nfkc:
        c = nfkc(c)
    if cfg.invisibles:
        c = F.translate(c, INVISIBLE, "")
    if cfg.marks:
        c = F.regexp_replace(c, r"[\p{Mn}\p{Me}]", "")
    if cfg.tatweel:
        c = F.translate(c, TATWEEL, "")
    pairs = [
        (cfg.alef, ALEF_FROM, ALEF_TO), (cfg.yeh, YEH_FROM, YEH_TO), (cfg.waw_hamza, WAW_FROM, WAW_TO), (cfg.teh_marbuta, TEH_FROM, TEH_TO),
        (cfg.letters, LETTERS_FROM, LETTERS_TO), (cfg.punctuation, PUNCTUATION, " " * len(PUNCTUATION)), (cfg.drop_hamza, HAMZA, ""),
    ]
    source, target = "".join(a for on, a, _ in pairs if on), "".join(b for on, _, b in pairs if on)
    if source:
        c = F.translate(c, source, target)
    if cfg.digits:
        c = ascii_digits(c)
    if cfg.whitespace:
        c = squeeze(c)
    return casefold(c) if cfg.casefold else c


def tokens(c: Column) -> Column:
    """ASCII alphanumeric runs and Arabic-script runs, in text order."""
    return F.regexp_extract_all(c, F.lit(f"[0-9A-Za-z]+|[{ARABIC}]+"), F.lit(0))


def tokens_unicode(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def latin_terms(c: Column) -> Column:
    """Lower-case ASCII alphanumeric runs; single letters are dropped, single digits stay."""
    runs = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(runs, lambda t: (F.length(t) > 1) | t.rlike("[0-9]"))


def light_stem(t: Column) -> Column:
    """One prefix letter, the article, then the first fitting suffix that leaves three letters."""
    s = F.when(t.rlike(f"^[{STEM_PREFIXES}]"), F.substring(t, 2, 1_000_000)).otherwise(t)
    s = F.when(s.startswith("ال") & (F.length(s) >= 5), F.substring(s, 3, 1_000_000)).otherwise(s)
    cut = F.coalesce(*(F.when(s.endswith(x) & (F.length(s) - len(x) >= 3), s.substr(F.lit(1), F.length(s) - len(x))) for x in STEM_SUFFIXES), s)
    return F.when(F.length(t) < 4, t).otherwise(cut)


def mixed_terms(c: Column, cfg: Normalization = SEARCH, stem: bool = False) -> Column:
    """Index terms: all Arabic-script runs first, then the Latin ones. A stem comes before its word."""
    n = normalize(c, cfg)
    arabic = F.regexp_extract_all(n, F.lit(f"[{ARABIC}]+"), F.lit(0))
    if stem:
        arabic = F.flatten(F.transform(arabic, lambda t: F.array(light_stem(t), t)))
    return F.concat(arabic, latin_terms(n))


def has_arabic(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(f"[{ARABIC}]")


def lang_hint(c: Column) -> Column:
    arabic, latin = has_arabic(c), F.coalesce(c, F.lit("")).rlike("[A-Za-z]")
    return F.when(arabic & latin, "mixed").when(arabic, "ar").otherwise("en")


# --- topic family ----------------------------------------------------------------------------------


def norm_ar(c: Column, compat: bool = True) -> Column:
    c = F.coalesce(c, F.lit(""))
    c = F.regexp_replace(nfkc(c) if compat else c, TOPIC_DIACRITICS, "")
    c = F.translate(c, "آأإٱ" + YEH_FROM + WAW_FROM + "ة" + HAMZA + TATWEEL, "اااا" + YEH_TO + WAW_TO + "ه")
    return squeeze(c)


def norm_lat(c: Column, compat: bool = True) -> Column:
    """Lower-case ASCII words; an apostrophe stays between letters or digits only."""
    c = F.lower(nfkc(F.coalesce(c, F.lit(""))) if compat else F.coalesce(c, F.lit("")))
    c = F.regexp_replace(F.regexp_replace(c, r"(?<![\p{L}\p{N}])'", " "), r"'(?![\p{L}\p{N}])", " ")
    return F.trim(F.regexp_replace(c, r"[^a-z0-9']+", " "))


def norm_ur(c: Column, compat: bool = True) -> Column:
    c = F.coalesce(c, F.lit(""))
    return squeeze(F.translate(nfkc(c) if compat else c, URDU_PUNCTUATION, " " * len(URDU_PUNCTUATION)))


def _script_tokens(c: Column) -> Column:
    parts = F.transform(F.split(c, " "), lambda t: F.regexp_replace(t, "[^0-9؀-ۿ]+", ""))
    return F.filter(parts, lambda t: F.length(t) >= 2)


def tokenize_ar(c: Column, compat: bool = True) -> Column:
    return _script_tokens(norm_ar(c, compat))


def tokenize_ur(c: Column, compat: bool = True) -> Column:
    return _script_tokens(norm_ur(c, compat))


def tokenize_lat(c: Column, compat: bool = True) -> Column:
    """Words of two letters or more that are no stopwords; duplicates stay."""
    return F.filter(F.split(norm_lat(c, compat), " "), lambda t: (F.length(t) >= 2) & ~t.isin(LATIN_STOPWORDS))


# --- query and display forms -----------------------------------------------------------------------


def number_form(c: Column, compat: bool = True) -> Column:
    """For reference patterns: compatibility form, ASCII digits, trimmed, case-folded."""
    c = F.coalesce(c, F.lit(""))
    c = F.trim(F.regexp_replace(ascii_digits(nfkc(c) if compat else c), r"(?U)^\s+|\s+$", ""))
    return casefold(c) if compat else F.lower(c)


def match_form(c: Column, compat: bool = True) -> Column:
    """For aliases: punctuation, underscores and hyphens become spaces."""
    c = F.regexp_replace(number_form(c, compat), rf"(?U)[^\w\s{ARABIC}]+", " ")
    return squeeze(F.translate(c, "_-", "  "))


def nickname_form(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]+", " "), r"\s+", " "))


def alias_form(c: Column, compat: bool = True) -> Column:
    c = F.coalesce(c, F.lit(""))
    return squeeze(F.translate(casefold(nfkc(c)) if compat else F.lower(c), "\u200c\u200d", ""))


def embedding_form(c: Column) -> Column:
    return squeeze(nfkc(F.coalesce(c, F.lit(""))))


def clamp(c: Column, most: int = 1200) -> Column:
    """Longer texts keep their first three quarters of `most` and their last quarter."""
    head = most * 3 // 4
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(head)), F.lit(" … "), F.right(c, F.lit(most - head)))).otherwise(c)


def join_filled(*parts: Column, sep: str = " ") -> Column:
    """Parts that are neither null nor empty, joined."""
    return F.concat_ws(sep, *(F.nullif(p, F.lit("")) for p in parts))


def pack_text(*parts: Column, most: int = 1600, compat: bool = True) -> Column:
    c = join_filled(*parts)
    n = normalize(c) if compat else squeeze(F.lower(c))
    return F.rtrim(F.left(n, F.lit(most)))


def passage(parts: list[tuple[str, Column]], prefix: str = "passage: ", most: int = 1200) -> Column:
    """Labelled parts with a bar between, clamped, behind the encoder's prefix."""
    labelled = [F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{label}: "), embedding_form(c))) for label, c in parts]
    return F.concat(F.lit(prefix), clamp(F.concat_ws(" | ", *labelled), most))


def surface_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"[A-Za-z0-9]+(?:'[A-Za-z0-9]+)?|[{ARABIC}]+"), F.lit(0))


def is_phrase(c: Column) -> Column:
    return c.rlike(r"(?U)[\s-]")


def pointer_escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def key_part(c: Column, place: int, missing: int | None = None) -> Column:
    """Integer part of a key "major:minor"; a broken one is null, or `missing`."""
    got = F.expr("try_cast(null as int)") if c is None else F.try_element_at(F.split(c, ":"), F.lit(place)).try_cast("int")
    whole = F.size(F.split(c, ":")) == 2
    got = F.when(whole, got)
    return got if missing is None else F.coalesce(got, F.lit(missing))
