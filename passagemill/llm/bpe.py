"""Byte-level BPE encoding and decoding.

Encoding splits text into pre-tokens and merges the symbols of each with a priority queue of merge
ranks over a doubly linked list; queue entries that a later merge has made stale are skipped when
they are popped. Decoding concatenates the vocabulary strings. Results equal the tokenizers
library's, special strings inside a text included.

Nulls and edge cases: a null or empty text has no ids and decodes to an empty text; ids may be null; texts are
encoded whole; ties: of equal merge ranks the leftmost pair goes first, and of special strings that start at one
place the longest; repeated rows give repeated results; an empty table gives an empty result; a file of another scheme
raises. Only the id and text columns are read; other columns may have any name.
"""

from __future__ import annotations

import json
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the byte-level scheme: the pre-token pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space other than the space itself, as the pattern's \s has it.
OTHER_SPACE = "\t\n\r\x0b\x0c\x85\xa0                　"
#: Entries of each of the two generations of a worker's word memory, and characters of the longest key that it holds.
MEMORY, LONGEST = 150_000, 64


def printable_bytes() -> dict[str, int]:
    """The character that stands for each byte in vocabulary strings."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def words_of(text: str) -> list[str] | None:
    """The text cut before each single space, without those spaces; None where a cut could split a pre-token."""
    pieces = text.split(" ")
    if "" in pieces:
        return None
    for c in OTHER_SPACE if not text.isascii() else OTHER_SPACE[:5]:
        if c in text and (c + " " in text or " " + c in text):
            return None
    return pieces


class Memory(dict):
    """word -> value with two generations, so its size is bounded; `make` fills what is missing."""

    def __init__(self, make, most: int = MEMORY):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        if len(key) > LONGEST:
            return self.make(key)
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = got
        return got


def is_plain_byte_level(spec: dict) -> bool:
    """Whether a tokenizer file's scheme is the one that `ByteBPE` has."""
    pre = spec.get("pre_tokenizer") or {}
    return (
        spec["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        and not spec.get("normalizer") and not spec["model"].get("ignore_merges") and not spec["model"].get("dropout")
        and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens") or [])
    )


class ByteBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if not is_plain_byte_level(spec):
            raise ValueError(f"{path} is no plain byte-level BPE file")
        vocab, byte = spec["model"]["vocab"], printable_bytes()
        self.byte_id = [0] * 256
        self.strings: list[bytes] = [b""] * (max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for word, i in vocab.items():
            self.strings[i] = bytes(byte[c] for c in word) if all(c in byte for c in word) else word.encode()
        for c, b in byte.items():
            self.byte_id[b] = vocab[c]
        #: (left << shift | right) -> rank << shift | merged; ids take `shift` bits.
        self.shift = shift = len(self.strings).bit_length()
        self.pairs = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs.setdefault(vocab[a] << shift | vocab[b], rank << shift | vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for word, i in self.special.items():
            self.strings[i] = word.encode()
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern = regex.compile(PATTERN)
        self.tokens = Memory(self._token)  # pre-token -> ids as bytes
        self.words = Memory(lambda word: self.scan(" " + word))  # space + word -> ids as bytes

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        ids = [self.byte_id[b] for b in data]
        n, get, shift = len(ids), self.pairs.get, self.shift
        mask = (1 << shift) - 1
        if n < 2:
            return ids
        heap = [v << 40 | i for i in range(n - 1) if (v := get(ids[i] << shift | ids[i + 1])) is not None]
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            entry = heappop(heap)
            i, v = entry & 0xFFFFFFFFFF, entry >> 40
            j = after[i]
            if j >= n or ids[i] < 0 or get(ids[i] << shift | ids[j]) != v:
                continue  # stale
            ids[i], ids[j] = v & mask, -1
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                if (v := get(ids[i] << shift | ids[j])) is not None:
                    heappush(heap, v << 40 | i)
            j = before[i]
            if j >= 0 and (v := get(ids[j] << shift | ids[i])) is not None:
                heappush(heap, v << 40 | j)
        return [x for x in ids if x >= 0]

    def _token(self, token: str) -> bytes:
        return np.array(self.merge(token.encode()), "<u4").tobytes()

    def scan(self, text: str) -> bytes:
        """Ids of text whose first and last pre-tokens end at its ends."""
        found = self.tokens.__getitem__
        if self.specials is None or not any(s in text for s in self.special):
            return b"".join(map(found, self.pattern.findall(text)))
        out = []
        for part in self.specials.split(text):
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            elif part:
                out += map(found, self.pattern.findall(part))
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        pieces = words_of(text)
        if pieces is None:
            return self.scan(text)
        return self.scan(pieces[0]) + b"".join(map(self.words.__getitem__, pieces[1:]))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    return ByteBPE(path)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True, keep_text: bool = False) -> DataFrame:
    """(id, ids, decoded[, text]): ids as little-endian unsigned 32-bit integers; decoded from those ids, or null."""

    def run(batches):
        bpe = load(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ids = [bpe.encode(t or "") for t in part.column(1).to_pylist()]
                texts = [bpe.decode(x) for x in ids] if decode else [None] * len(ids)
                out = [part.column(0), pa.array(ids, pa.binary()), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays([*out, part.column(1)] if keep_text else out, ["id", "ids", "decoded", "text"][: 3 + keep_text])

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, ids binary, decoded string" + ", text string" * keep_text
    got = df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)
    return got.withColumnRenamed("id", id_col)
