"""Scalar helpers: fallbacks, rounding, picks, keys and positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def round6(c: Column) -> Column:
    """Six digits, by the exact binary value, half to even; the product's rounding error is told by splitting the factor."""
    x = c.cast("double")
    p, big = x * 1e6, x * 134217729.0
    high = big - (big - x)
    error = (high * 1e6 - p) + (x - high) * 1e6
    low = F.floor(p).cast("double")
    rest = p - low
    odd = F.pmod(low, F.lit(2.0)) == 1
    up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & odd)))
    return F.when(F.abs(x) < 4e9, (low + F.when(up, 1.0).otherwise(0.0)) / 1e6).otherwise(x)


def filled(*options: Column) -> Column:
    """The first option that is neither null nor blank."""
    return F.coalesce(*(F.when(F.trim(c) != "", c) for c in options))


def preferred(texts: Column, order: list[str], builtin: Column | None = None) -> Column:
    """From a map of texts: the first of `order`, else the built-in text."""
    options = [F.try_element_at(texts, F.lit(k)) for k in order]
    return filled(*options, *([builtin] if builtin is not None else []))


def display_pick(texts: Column, order: list[str], builtin: Column) -> Column:
    """Preferred key, else the first non-empty text by sorted key, else the built-in text."""
    entries = F.filter(F.array_sort(F.map_entries(texts)), lambda e: F.trim(e["value"]) != "")
    return filled(*(F.try_element_at(texts, F.lit(k)) for k in order), F.try_element_at(entries, F.lit(1))["value"], builtin)


def clamp_limit(asked: Column, most: int) -> Column:
    return F.greatest(F.lit(0), F.least(asked, F.lit(most)))


def min_max(c: Column, *keys: str) -> Column:
    low, high = F.min(c).over(W.partitionBy(*keys)), F.max(c).over(W.partitionBy(*keys))
    return (c - low) / F.when(high - low < 1e-9, F.lit(1.0)).otherwise(high - low)


def seeded_choice(options: Column, key: Column, seed: int) -> Column:
    """One option by a hash of key and seed: stable over runs and partitions (not a Mersenne Twister draw)."""
    drawn = F.conv(F.substring(F.md5(F.encode(F.concat_ws(":", F.lit(seed).cast("string"), key), "UTF-8")), 1, 12), 16, 10).cast("bigint")
    return F.when(F.size(options) > 0, F.element_at(options, (F.pmod(drawn, F.size(options)) + 1).cast("int")))


def case_unique(items: Column) -> Column:
    """Distinct by lower case, the first spelling of each, in order of lower case."""
    spots = F.transform(items, lambda x, i: F.struct(F.lower(x).alias("k"), i.alias("i"), x.alias("x")))
    ordered = F.array_sort(spots)
    firsts = F.filter(ordered, lambda e, i: (i == 0) | (F.get(ordered, i - 1)["k"] != e["k"]))
    return F.transform(firsts, lambda e: e["x"])


def sha256(c: Column) -> Column:
    return F.sha2(F.encode(c, "UTF-8"), 256)


def utc_now() -> Column:
    """The time of the query as ISO 8601 in UTC; equal in all rows."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
