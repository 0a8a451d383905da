"""GIF media columns: byte payloads as GIF files, and any GIF's timed frames.

Writing: payload bytes are the samples of 8-bit grey frames, compressed by LZW. Reading decodes the
LZW code streams of any GIF87a/89a, applies local or global palettes, interlacing, disposal and
transparency, and gives each frame's samples, timing and the colour histogram of the canvas.

Nulls and edge cases: null or empty content is stored as padding only; content of any length is
stored whole, over as many frames as it takes; null or broken media, and canvases or frames of more than 2^28 pixels,
read as no frames with the reason in `error`; ids may be null; ties: equal contents have equal media, and later frames
are drawn over earlier ones; repeated rows give repeated results; an empty table gives an empty result. Only the named
columns are read; a kept column may have the name of a column of the result, and both are then there.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 64
ROWS = 1024  # of a full frame
DELAY_CS = 10  # hundredths of a second
MOST = 1 << 28  # pixels of a canvas that is read
UNIT = 64  # payloads are padded to a positive multiple of this


def code_widths(count: int, least: int) -> np.ndarray:
    """Bits of each code after a clear: the table has grown by one entry for every code but the first."""
    grown = (1 << least) + 2 + np.maximum(np.arange(count) - 1, 0)
    return np.minimum(np.floor(np.log2(grown)).astype(np.int64) + 1, 12)


_RUN = 4096
_WIDTHS = {least: code_widths(_RUN, least) for least in range(2, 9)}
_EDGES = {least: np.concatenate([[0], np.cumsum(w)]) for least, w in _WIDTHS.items()}


# --- LZW ---------------------------------------------------------------------------------------


def lzw_encode(data: bytes) -> bytes:
    """The code stream of 8-bit samples; the table is cleared whenever it is full."""
    runs, codes, table, free = [], [256], {}, 258
    seen = table.get
    prefix = data[0]
    for b in memoryview(data)[1:]:
        key = prefix << 8 | b
        code = seen(key)
        if code is not None:
            prefix = code
            continue
        codes.append(prefix)
        prefix = b
        if free < 4096:
            table[key] = free
            free += 1
        else:
            codes.append(256)
            runs.append(codes)
            codes = []
            table.clear()
            free = 258
    codes += [prefix, 257]
    runs.append(codes)
    # The first clear is read with the first width; each later one belongs to the run it ends.
    widths = [np.array([9]), _WIDTHS[8][: len(runs[0]) - 1], *(_WIDTHS[8][: len(r)] for r in runs[1:])]
    return pack(np.concatenate([np.array(r, np.int64) for r in runs]), np.concatenate(widths))


def pack(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes of up to 12 bits, least significant bit first."""
    ends = np.cumsum(widths)
    starts = ends - widths
    at, shifted, size = starts >> 3, codes << (starts & 7), int(ends[-1] + 7) >> 3
    out = np.zeros(size + 3, np.float64)
    for i in range(3):
        out[i : i + size] += np.bincount(at, weights=(shifted >> (8 * i)) & 255, minlength=size)[:size]
    return out[:size].astype(np.uint8).tobytes()


def lzw_decode(stream: bytes, least: int, most: int) -> bytes:
    """Samples of a code stream, `most` of them at most (what the frame holds)."""
    raw = np.frombuffer(stream + b"\0\0\0\0", np.uint8).astype(np.uint32)
    joined = raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)
    bits, clear, stop = 8 * len(stream), 1 << least, (1 << least) + 1
    edges, widths = _EDGES[least], _WIDTHS[least]
    out, run, at, got, index = [], [], 0, 0, 0
    while True:
        # Codes up to the next clear, in one go: their widths follow from their places in the run.
        edge = at + (edges[index:] - edges[index]) if index < _RUN else at + 12 * np.arange(_RUN + 1)
        width = widths[index:] if index < _RUN else np.full(_RUN, 12)
        n = int(np.searchsorted(edge[1:], bits, "right"))
        start = edge[:n]
        codes = (joined[start >> 3] >> (start & 7).astype(np.uint32)).astype(np.int64) & ((1 << width[:n]) - 1)
        marks = np.flatnonzero((codes == clear) | (codes == stop))
        k = int(marks[0]) if len(marks) else n
        run.append(codes[:k])
        if not len(marks) and n:
            at, index = int(edge[n]), index + n
            continue
        own = np.concatenate(run)
        if len(own):
            out.append(run_samples(own, clear))
            got += len(out[-1])
        if not n or codes[k] == stop or got >= most:
            return b"".join(x.tobytes() for x in out)[:most]
        at, index, run = int(edge[k + 1]), 0, []


def run_samples(codes: np.ndarray, clear: int) -> np.ndarray:
    """Samples of the codes between two clears.

    Code clear + 2 + i stands for the string of the run's code i and the first sample of code i + 1,
    so codes form a forest whose roots are literals; a string is read from its end up to its root.
    """
    n = len(codes)
    parent = codes - (clear + 2)
    literal = codes < clear
    if (parent >= np.arange(n)).any():
        raise ValueError("LZW code beyond the table")
    root, depth = np.where(literal, np.arange(n), parent), (~literal).astype(np.int64)
    while not literal[root].all():
        depth += depth[root]
        root = root[root]
    first = codes[root].astype(np.uint8)
    ends = np.cumsum(depth + 1)
    out = np.empty(int(ends[-1]), np.uint8)
    out[ends - depth - 1] = first
    node = np.flatnonzero(~literal)
    place = ends[node] - 1
    while len(node):
        node = parent[node]
        out[place] = first[node + 1]
        deeper = ~literal[node]
        node, place = node[deeper], place[deeper] - 1
    return out


# --- files -------------------------------------------------------------------------------------


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % UNIT or (0 if data else UNIT))


def write_gif(payload: bytes) -> bytes:
    """`payload`, a positive multiple of WIDTH bytes, as grey frames of at most ROWS rows."""
    frames = [payload[i : i + WIDTH * ROWS] for i in range(0, len(payload), WIDTH * ROWS)]
    height = len(frames[0]) // WIDTH
    grey = bytes(b for i in range(256) for b in (i, i, i))
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, height, 0xF7, 0, 0), grey]
    for frame in frames:
        out += [b"\x21\xf9\x04", struct.pack("<BHBB", 1 << 2, DELAY_CS, 0, 0), b"\x2c", struct.pack("<HHHHB", 0, 0, WIDTH, len(frame) // WIDTH, 0), b"\x08"]
        stream = lzw_encode(frame)
        for i in range(0, len(stream), 255):
            part = stream[i : i + 255]
            out += [bytes([len(part)]), part]
        out.append(b"\0")
    out.append(b"\x3b")
    return b"".join(out)


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay_ms: int
    disposal: int
    transparent: int | None
    samples: bytes  # palette places, row by row
    canvas: np.ndarray  # rows x columns x RGBA, after this frame is drawn


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := data[at]:
        parts.append(data[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(parts), at + 1


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    if not flags & 0x80:
        return None, at
    n = 2 << (flags & 7)
    table = np.zeros((256, 4), np.uint8)
    table[:n, :3] = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
    table[:, 3] = 255
    return table, at + 3 * n


def read_gif(data: bytes):
    """The frames, in order, drawn one over the other."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    if width * height > MOST:
        raise ValueError("canvas too large")
    shared, at = _palette(data, 13, flags)
    canvas = np.zeros((height, width, 4), np.uint8)
    delay, disposal, transparent = 0, 0, None
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            block, at = _sub_blocks(data, at + 2)
            if label == 0xF9:
                packed, cs, place = struct.unpack_from("<BHB", block)
                delay, disposal, transparent = 10 * cs, packed >> 2 & 7, place if packed & 1 else None
            continue
        if data[at] != 0x2C:
            raise ValueError("unknown block")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
        own, at = _palette(data, at + 10, flags)
        palette = own if own is not None else shared
        if palette is None:
            raise ValueError("no palette")
        least = data[at]
        if not 2 <= least <= 8:
            raise ValueError("bad code size")
        stream, at = _sub_blocks(data, at + 1)
        if w * h > MOST:
            raise ValueError("frame too large")
        samples = lzw_decode(stream, least, w * h)
        if len(samples) < w * h:
            raise ValueError("short frame")
        plane = np.frombuffer(samples, np.uint8).reshape(h, w)
        if flags & 0x40:
            order = [r for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(first, h, step)]
            rows = np.empty_like(plane)
            rows[order] = plane
            plane, samples = rows, rows.tobytes()
        before = canvas.copy() if disposal == 3 else None
        seen = plane[: max(0, height - top), : max(0, width - left)]
        spot = canvas[top : top + seen.shape[0], left : left + seen.shape[1]]
        drawn = palette[seen]
        if transparent is None:
            spot[...] = drawn
        else:
            np.copyto(spot, drawn, where=(seen != transparent)[:, :, None])
        yield Frame(left, top, w, h, delay, disposal, transparent, samples, canvas)
        if disposal == 2:
            spot[...] = 0
        elif disposal == 3:
            canvas = before
        delay, disposal, transparent = 0, 0, None


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Pixels of each of 4 x 4 x 4 colours, then of the transparent ones."""
    c = canvas.reshape(-1, 4)
    place = (c[:, 0] >> 6) * 16 + (c[:, 1] >> 6) * 4 + (c[:, 2] >> 6)
    return np.bincount(np.where(c[:, 3] > 0, place, 64), minlength=65)


# --- columns -----------------------------------------------------------------------------------

FRAME = "frame:int,left:int,top:int,width:int,height:int,delay_ms:int,disposal:int,histogram:array<bigint>"


def store(df: DataFrame, id_col: str = "doc_id", content_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each content's bytes, padded, as one GIF; n_bytes is the content's own size."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                content = [b or b"" for b in part.column(1).to_pylist()]
                sizes, media = [len(b) for b in content], [write_gif(padded(b)) for b in content]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    kind = df.schema[id_col].dataType.simpleString()
    got = df.select(F.col(id_col), F.col(content_col).cast("binary")).mapInArrow(run, f"id {kind}, n_bytes bigint, media binary")
    return got.withColumnRenamed("id", id_col)


def frames(df: DataFrame, id_col: str = "doc_id", media_col: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, media, frames, samples, error): every frame of each GIF and the samples of all, end to end."""
    names = [x.split(":")[0] for x in FRAME.split(",")]
    kind = pa.list_(pa.struct([(n, pa.list_(pa.int64()) if n == "histogram" else pa.int32()) for n in names]))

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                found, samples, errors = [], [], []
                for media in part.column(0).to_pylist():
                    rows, planes, error = [], [], None
                    try:
                        for k, f in enumerate(read_gif(media or b"")):
                            rows.append(dict(zip(names, (k, f.left, f.top, f.width, f.height, f.delay_ms, f.disposal, histogram(f.canvas).tolist()))))
                            planes.append(f.samples)
                    except (ValueError, IndexError, struct.error) as e:
                        rows, planes, error = [], [], str(e)
                    found.append(rows)
                    samples.append(b"".join(planes))
                    errors.append(error)
                new = [part.column(0), pa.array(found, kind), pa.array(samples, pa.binary()), pa.array(errors, pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *new], [f"c{i}" for i in range(len(own) + 4)])

    own = [id_col, *keep]
    kinds = [*(df.schema[c].dataType.simpleString() for c in own), "binary", f"array<struct<{FRAME}>>", "binary", "string"]
    schema = ", ".join(f"c{i} {k}" for i, k in enumerate(kinds))
    sent = df.select(F.col(media_col).alias("s"), *(F.col(f"`{c}`").alias(f"s{i}") for i, c in enumerate(own)))
    return sent.mapInArrow(run, schema).toDF(*own, "media", "frames", "samples", "error")
