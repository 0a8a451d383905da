"""Benchmark decontamination by template canonicalisation.

Texts and benchmark items become sequences of lower-cased words in which numbers, names and units after
numbers are typed placeholders (runs of numbers or of names are one). Windows of such words are matched
by hash against the items' windows, and the slots of each matched window must map one to one from the
item to the text: so copies are caught, and so are questions with other numbers or names put in, while
texts that merely share a mould with clashing values are not. A document is contaminated by an item when
it holds at least `share` of the item's windows.

Items are also matched by the windows of their raw words, case-folded and without slots, as copies in other
case have other names or none. What counts is how many of the item's windows such windows cover; for an item
that has windows with fewer than `least` plain words, or no window, the raw windows count themselves, so items
made of names or numbers, and short ones, are found as they stand.

Places of a text where an item's windows match are judged apart, so a copy counts although the text uses
the item's words elsewhere with other values.

The texts are read once, whatever the size of the benchmark: of their windows only those leave a task that a Bloom
filter of the items' windows lets through, and these are joined with the items' windows by hash, in Spark. The filter
has at most `filter_bits` bits, so it is all of the benchmark that goes to every task; with more windows than some
millions it lets more through, and the join still decides.

Nulls and edge cases: a null or empty text matches nothing; an item with fewer words than a window is one
window of its own length; one without any word (signs only) matches nothing, and neither does one with a null id;
an item id with several texts is found where one of them is; rows with a null id come back with it; repeated rows are
reported once each; of equally covered texts of an item the one found unchanged is reported; empty tables give an empty
result. Only the named columns are read; extra columns may have any name.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm import bytewords
from passagemill.llm.common import Workspace, groups, only_keys, salted_join

NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split()
UNITS = (
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms pound pounds lb lbs ounce ounces ton tons ml l liter liters litre litres "
    "second seconds s minute minutes min hour hours h day days week weeks month months year years cent cents dollar dollars euro euros usd eur percent degree degrees mph kmh"
).split()

_sep = np.zeros(256, bool)
_sep[:128] = True
_sep[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_stop = np.zeros(256, bool)
_stop[[10, 13, 33, 46, 58, 59, 63]] = True
_digit = np.zeros(256, bool)
_digit[48:58] = True
NUM, NAME, UNIT = 1, 2, 3
_MARK = np.array([0, 0x1234567890ABCDEF, 0x2345678901BCDEFA, 0x3456789012CDEFAB], np.uint64)


@dataclass(frozen=True)
class Config:
    window: int = 8
    least: int = 4  # plain words that a window needs
    share: float = 0.5  # of an item's windows
    filter_bits: int = 1 << 25  # most bits of the filter
    broadcast_windows: int = 100_000  # up to so many windows of items are broadcast to the join


def _table(words: list[str]) -> np.ndarray:
    return np.unique(np.array([bytewords.hash_word(w) for w in words], np.uint64))


NUMBERS, UNIT_WORDS = _table(NUMBER_WORDS), _table(UNITS)


def _among(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


@dataclass
class Raw:
    """The case-folded words of a block of texts as they stand."""

    words: np.ndarray
    rows: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


@dataclass
class Canonical:
    """Canonical words of a block of texts; a slot's span covers its whole run."""

    words: np.ndarray
    kinds: np.ndarray
    rows: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    raw: Raw
    first: np.ndarray  # raw word
    last: np.ndarray


def fold(words: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hashes with those of words with other than ASCII characters replaced by their full case folding's."""
    wide = np.concatenate([[0], np.cumsum(buf > 127, dtype=np.int32)])
    other = np.flatnonzero(wide[ends] > wide[starts])
    if not len(other):
        return words
    _, first, place = np.unique(words[other], return_index=True, return_inverse=True)
    folded = [buf[a:b].tobytes().decode("utf-8", "replace").casefold().encode() for a, b in zip(starts[other[first]].tolist(), ends[other[first]].tolist())]
    off = np.cumsum([0, *map(len, folded)])
    words = words.copy()
    words[other] = bytewords.hashes(np.frombuffer(b"".join(folded), np.uint8), off[:-1], off[1:])[place]
    return words


def canonical(buf: np.ndarray, off: np.ndarray) -> Canonical:
    starts, ends, rows = bytewords.spans(buf, off, _sep)
    words = bytewords.hashes(buf, starts, ends)
    raw = Raw(fold(words, buf, starts, ends), rows, starts, ends)
    if not len(words):
        return Canonical(words, np.zeros(0, np.int8), rows, starts, ends, raw, rows, rows)
    head = buf[starts]
    same_row = np.concatenate([[False], rows[1:] == rows[:-1]])
    stops = np.concatenate([[0], np.cumsum(_stop[buf], dtype=np.int32)])
    inside = same_row.copy()
    inside[1:] &= stops[starts[1:]] == stops[ends[:-1]]
    second = buf[np.minimum(starts + 1, len(buf) - 1)]
    capital = ((head >= 65) & (head <= 90)) | ((head == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    kinds = np.zeros(len(words), np.int8)
    kinds[capital & inside & (ends - starts > 1)] = NAME
    kinds[_digit[head] | _among(NUMBERS, words)] = NUM
    unit = np.zeros(len(words), bool)
    unit[1:] = (kinds[:-1] == NUM) & same_row[1:]
    kinds[unit & (kinds == 0) & _among(UNIT_WORDS, words)] = UNIT
    words = np.where(kinds > 0, _MARK[kinds], words)
    # A run of numbers, or of names, is one slot.
    run = np.zeros(len(words), bool)
    run[1:] = same_row[1:] & (kinds[1:] == kinds[:-1]) & (kinds[1:] > 0) & (kinds[1:] != UNIT)
    first = np.flatnonzero(~run)
    last = np.concatenate([first[1:], [len(words)]]) - 1
    return Canonical(words[first], kinds[first], rows[first], starts[first], ends[last], raw, first, last)


def windows(c: Canonical, k: int, least: int):
    """(hashes, rows, first words) of the windows of k words with enough plain ones."""
    hashes, rows, first = bytewords.windows(c.words, c.rows, k)
    plain = np.concatenate([[0], np.cumsum(c.kinds == 0)])
    ok = plain[first + k] - plain[first] >= least if len(first) else np.zeros(0, bool)
    return hashes[ok], rows[ok], first[ok]


def slot_values(c: Canonical, buf: bytes, at: int, k: int) -> tuple[str, ...]:
    return tuple(buf[c.starts[i] : c.ends[i]].decode("utf-8", "replace").lower() for i in range(at, at + k) if c.kinds[i])


TEMPLATE, RAW = 0, 1


def keyed(hashes: np.ndarray, kind: int, k: int) -> np.ndarray:
    """Window hashes that differ by kind and length too, as signed integers."""
    return bytewords.mix(hashes ^ np.uint64(0x9E3779B97F4A7C15 * (kind * 64 + k + 1) % 2**64)).view(np.int64)


ITEM_WINDOWS = "hash bigint, kind int, k int, own bigint, item bigint, at int, size int, slots array<string>, covers array<struct<w:int,need:int>>"


def item_windows(own: int, item: int, text: str, cfg: Config):
    """Rows of ITEM_WINDOWS of one text of an item: its template windows, and its raw windows.

    `size` is how many windows count; a raw window covers some of these, each of which needs so many raw ones.
    """
    data = text.encode()
    buf = np.frombuffer(data, np.uint8)
    c = canonical(buf, np.array([0, len(buf)]))
    k = min(cfg.window, len(c.words))
    if not k:
        return
    hashes, _, first = windows(c, k, cfg.least)
    for h, f in zip(keyed(hashes, TEMPLATE, k).tolist(), first.tolist()):
        yield h, TEMPLATE, k, own, item, f, len(hashes), slot_values(c, data, f, k), ()
    n = min(cfg.window, len(c.raw.words))
    raw_hashes, _, raw_first = bytewords.windows(c.raw.words, c.raw.rows, n)
    if len(hashes) == len(c.words) - k + 1:
        counted = [(int(c.first[f]), int(c.last[f + k - 1]) + 2 - n) for f in first]
    else:
        counted = [(f, f + 1) for f in range(len(raw_hashes))]
    covers: dict[int, list[tuple[int, int]]] = {}
    for w, (a, b) in enumerate(counted):
        for x in range(a, b):
            covers.setdefault(x, []).append((w, b - a))
    for h, f in zip(keyed(raw_hashes, RAW, n).tolist(), raw_first.tolist()):
        yield h, RAW, n, own, item, f, len(counted), (), covers.get(f, ())


def _index(cfg: Config):
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.struct([("w", pa.int32()), ("need", pa.int32())]))]
    names = [x.split()[0] for x in ITEM_WINDOWS.split(", ")]

    def run(batches):
        for batch in batches:
            for own, item, text in zip(*(x.to_pylist() for x in batch.columns)):
                rows = list(item_windows(own, item, text, cfg))
                if rows:
                    rows = [(*r[:7], list(r[7]), [{"w": w, "need": n} for w, n in r[8]]) for r in rows]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)

    return run


def bloom(ix: DataFrame, n: int, cfg: Config) -> np.ndarray:
    """A filter of the hashes with two places each, as bytes of eight bits; its words are gathered in Spark."""
    bits = 1 << 16
    while bits < min(64 * n, cfg.filter_bits):
        bits *= 2
    places = F.explode(F.array(F.col("hash").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("hash", 32).bitwiseAND(F.lit(bits - 1))))
    at = ix.select(places.alias("p")).select(F.shiftright("p", 5).alias("word"), F.expr("shiftleft(1L, cast(p & 31 as int))").alias("bit"))
    got = at.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 32, np.uint32)
    out[got["word"].to_numpy()] = got["bits"].to_numpy().astype(np.uint32)
    return out.view(np.uint8)


def passing(flt: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of the hashes that the filter lets through."""
    mask = np.uint64(8 * len(flt) - 1)
    u, at = hashes.view(np.uint64), np.arange(len(hashes))
    for shift in (0, 32):
        p = ((u[at] >> np.uint64(shift)) & mask).astype(np.int64)
        at = at[(flt[p >> 3] >> (p & 7).astype(np.uint8)) & 1 > 0]
    return at


def _scan(cfg: Config, lengths: list[tuple[int, int]], flt: np.ndarray):
    """(row, id, hash, first, start, end, slots) of the texts' windows that pass the filter, from (row, id, text)."""

    def run(batches):
        for batch in batches:
            for first_row, buf, off in bytewords.blocks(batch.column(2)):
                c, data, out = canonical(buf, off), None, []
                for kind, k in lengths:
                    words = c if kind == TEMPLATE else c.raw
                    hashes, rows, first = windows(c, k, cfg.least) if kind == TEMPLATE else bytewords.windows(c.raw.words, c.raw.rows, k)
                    hashes = keyed(hashes, kind, k)
                    hit = passing(flt, hashes)
                    if not len(hit):
                        continue
                    rows, first = rows[hit], first[hit]
                    slots = [[]] * len(hit)
                    if kind == TEMPLATE:
                        data = data or buf.tobytes()
                        slots = [list(slot_values(c, data, f, k)) for f in first.tolist()]
                    base = off[rows]
                    place = first - np.searchsorted(words.rows, rows)
                    out.append((first_row + rows, hashes[hit], place, words.starts[first] - base, words.ends[first + k - 1] - base, slots))
                if out:
                    at, *numbers = (np.concatenate(x) for x in list(zip(*out))[:5])
                    slots = pa.array([x for o in out for x in o[5]], pa.list_(pa.string()))
                    at = pa.array(at)
                    columns = [batch.column(0).take(at), batch.column(1).take(at), *(pa.array(x.astype(np.int64)) for x in numbers), slots]
                    yield pa.RecordBatch.from_arrays(columns, ["row", "id", "hash", "first", "start", "end", "slots"])

    return run


def bind(there: dict, back: dict, item: tuple[str, ...], text: tuple[str, ...]) -> bool:
    """Binds the slots of a window to their values in the text, unless that is not one to one."""
    new = list(zip(item, text))
    inner = dict(new)
    if len(item) != len(text) or not all(there.get(a, b) == b and back.get(b, a) == a and inner[a] == b for a, b in new) or len(set(inner.values())) != len(inner):
        return False
    there.update(new)
    back.update((b, a) for a, b in new)
    return True


def consistent(pairs: list[tuple[tuple[str, ...], tuple[str, ...]]]) -> tuple[int, bool]:
    """How many windows, in order, keep the slots one to one; whether any of them has another value."""
    there, back = {}, {}
    kept = [item != text for item, text in pairs if bind(there, back, item, text)]
    return len(kept), any(kept)


class Hit(NamedTuple):
    """A window of an item in a text; its diagonal is its first word in the text less that in the item."""

    window: int
    item: tuple[str, ...]
    text: tuple[str, ...]
    start: int
    end: int
    diagonal: int


def _outwards(hits: list[Hit], diagonal: int):
    """Hits of one window, in text order, from the nearest diagonal on."""
    hi = bisect_left(hits, diagonal, key=lambda h: h.diagonal)
    lo = hi - 1
    while lo >= 0 or hi < len(hits):
        if hi == len(hits) or lo >= 0 and diagonal - hits[lo].diagonal <= hits[hi].diagonal - diagonal:
            yield hits[lo]
            lo -= 1
        else:
            yield hits[hi]
            hi += 1


def chain(hits: list[Hit], least: float = 1) -> list[Hit]:
    """The largest found set of hits, one a window, that keep the slots one to one; empty where it cannot reach `least`.

    Each diagonal starts sets: from its first hit, and from each that no set before it has taken. A set then
    takes in what agrees with it elsewhere, nearest first, so a copy with words put in or left out is one.
    """
    hits = sorted(hits, key=lambda h: (h.start, h.window))
    lists, whole, diagonals = {}, {}, {}
    for h in hits:
        if (h.window, h.text) not in whole:
            for key in {(h.window,), *((h.window, i, v) for i, v in enumerate(h.text))}:
                lists.setdefault(key, []).append(h)
        whole.setdefault((h.window, h.text), h)
        diagonals.setdefault(h.diagonal, []).append(h)
    all_windows = sorted({h.window for h in hits})
    if len(all_windows) < least:
        return []
    alike = {tuple((h.window, h.text) for h in d): d for d in reversed(diagonals.values())}.values()
    best = []

    def grow(first: list[Hit], diagonal: int) -> list[Hit]:
        there, back, kept = {}, {}, {}
        for h in first:
            if h.window not in kept and bind(there, back, h.item, h.text):
                kept[h.window] = h
        for w in all_windows:
            if w in kept:
                continue
            item = lists[w,][0].item
            value = tuple(there.get(a) for a in item)
            if None not in value:
                found = [whole[w, value]] if (w, value) in whole else []
            else:
                bound = next(((w, i, v) for i, v in enumerate(value) if v is not None), (w,))
                found = _outwards(lists.get(bound, []), diagonal)
            got = next((h for h in found if bind(there, back, h.item, h.text)), None)
            if got:
                kept[w] = got
        return list(kept.values())

    rank = lambda kept: (len(kept), -sum(h.item != h.text for h in kept))
    for d in sorted(alike, key=rank, reverse=True):
        pending = d
        while pending and len(best) < len(all_windows):
            kept = grow([pending[0], *d], d[0].diagonal)
            best = max(best, kept, key=rank)
            taken = {h.window for h in kept if h.diagonal == d[0].diagonal}
            pending = [h for h in pending[1:] if h.window not in taken]
    if len(best) < len(all_windows):
        best = max(best, grow(hits, hits[0].diagonal), key=rank)
    return best if len(best) >= least else []


def raw_cover(hits: list[dict], cfg: Config) -> tuple[int, int, bool, int, int] | None:
    """(matched, windows, False, first byte, end) where raw windows cover the share of an item's windows."""
    once: dict[int, dict] = {}
    for h in sorted(hits, key=lambda h: h["start"]):
        once.setdefault(h["at"], h)
    met: dict[int, int] = {}
    for h in once.values():
        for x in h["covers"]:
            met[x["w"]] = met.get(x["w"], 0) + 1
    size = hits[0]["size"]
    covered = {x["w"] for h in once.values() for x in h["covers"] if met[x["w"]] == x["need"]}
    if len(covered) < max(1, cfg.share * size):
        return None
    used = [h for h in once.values() if any(x["w"] in covered for x in h["covers"])]
    return len(covered), size, False, min(h["start"] for h in used), max(h["end"] for h in used)


def verdict(hits: list[dict], cfg: Config) -> tuple[int, int, bool, int, int] | None:
    """(matched, windows, reparameterised, first byte, end) of one text of an item in one text, from its joined windows."""
    own = [h for h in hits if h["kind"] == TEMPLATE]
    if own:
        size = own[0]["size"]
        kept = chain([Hit(h["at"], tuple(h["item_slots"]), tuple(h["slots"]), h["start"], h["end"], h["first"] - h["at"]) for h in own], max(1, cfg.share * size))
        if kept:
            return len(kept), size, any(h.item != h.text for h in kept), min(h.start for h in kept), max(h.end for h in kept)
    raw = [h for h in hits if h["kind"] == RAW]
    return raw_cover(raw, cfg) if raw else None


def _judge(cfg: Config):
    names = ["id", "item", "matched", "n_windows", "reparameterised", "first_byte", "end_byte"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]

    def run(batches):
        for g in groups(batches, ["row", "item"]):
            by: dict[int, list[dict]] = {}
            for h in g.drop_columns(["id"]).to_pylist():
                by.setdefault(h["own"], []).append(h)
            found = [x for _, hits in sorted(by.items()) if (x := verdict(hits, cfg))]
            if found:
                best = max(found, key=lambda x: (x[0] / x[1], not x[2], x[1], -x[3]))
                yield pa.RecordBatch.from_arrays([g["id"].slice(0, 1).combine_chunks(), *(pa.array([x], t) for x, t in zip((g["item"][0].as_py(), *best), kinds))], names)

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", cfg: Config = Config()) -> DataFrame:
    """(id, item, matched, n_windows, reparameterised, first_byte, end_byte) of every contaminated (document, item)."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    ws = Workspace(spark, "contamination")
    items = benchmark.select(F.col(item_col).cast("bigint").alias("item"), F.col(item_text).alias("text")).where("item is not null and text is not null").distinct()
    items = ws.write(items.withColumn("own", F.monotonically_increasing_id()), "items")
    ix = ws.write(items.select("own", "item", "text").mapInArrow(_index(cfg), ITEM_WINDOWS), "windows")
    lengths = sorted((r["kind"], r["k"]) for r in ix.select("kind", "k").distinct().collect())  # 2 * cfg.window at most
    schema = f"id {kind}, item bigint, matched bigint, n_windows bigint, reparameterised boolean, first_byte bigint, end_byte bigint"
    if not lengths:
        return spark.createDataFrame([], schema).withColumnsRenamed({"id": id_col, "item": item_col})
    n = ix.count()
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # Row numbers are fixed by writing what passes the filter.
    hits = ws.write(source.mapInArrow(_scan(cfg, lengths, bloom(ix, n, cfg)), f"row bigint, id {kind}, hash bigint, first bigint, start bigint, end bigint, slots array<string>"), "hits")
    right = ix.select("hash", "kind", "own", "item", "at", "size", F.col("slots").alias("item_slots"), "covers")
    met = hits.join(F.broadcast(right), "hash") if n <= cfg.broadcast_windows else salted_join(hits, right, "hash")
    dealt = met.repartition("row", "item").sortWithinPartitions("row", "item")
    columns = ["row", "id", "kind", "own", "item", "at", "size", "item_slots", "covers", "first", "start", "end", "slots"]
    return dealt.select(*columns).mapInArrow(_judge(cfg), schema).withColumnsRenamed({"id": id_col, "item": item_col})


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of `docs` that no item contaminates; those that share an id with a contaminated row go with it.

    Rows with a null id are numbered, and judged each by itself.
    """
    ws = Workspace(docs.sparkSession, "decontaminate")
    named = docs.where(F.col(id_col).isNotNull())
    hits = ws.write(contaminated(named, benchmark, id_col, **options).select(id_col).distinct(), "hits")
    kept = only_keys(named, hits, id_col, "left_anti").select(*docs.columns)
    unnamed = docs.where(F.col(id_col).isNull())
    if not unnamed.limit(1).count():
        return kept
    number, taken = "_row_number", {c.lower() for c in docs.columns}
    while number in taken:
        number += "_"
    unnamed = ws.write(unnamed.withColumn(number, F.monotonically_increasing_id()), "unnamed")
    hits = ws.write(contaminated(unnamed, benchmark, number, **options).select(number).distinct(), "unnamed-hits")
    return kept.unionByName(only_keys(unnamed, hits, number, "left_anti").select(*docs.columns))
