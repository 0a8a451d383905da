"""Compression quality classifier.

Two zstandard dictionaries are trained, on blocks of good and of bad labelled text. A text is cut into
blocks, each is compressed under both, and the difference of the compressed sizes over the larger one,
with how well the text compresses at all and its length, becomes a score by logistic calibration.
Calibration sees each training row, whole, under dictionaries built without its fold of the texts; block and
dictionary sizes, the level and the terms were picked by such folds among training rows alone.

Nulls and edge cases: a null text scores as an empty one; ids may be null; texts are fitted on and scored whole,
the dictionaries on blocks drawn from anywhere in them; ties: equal texts get equal scores and fall into one fold;
repeated training rows count once; labels other than 0 and 1 are ignored; extra columns may have any name. Without rows of both classes the
score is the share of label 1 among the training rows, or 0.5 without any. An empty table gives an
empty result. Only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from passagemill.llm import labelled
from passagemill.llm.common import Workspace


@dataclass(frozen=True)
class Config:
    per_class: int = 2500  # labelled rows of each class that are fitted on
    block: int = 1024
    dictionary: int = 110_000
    folds: int = 4
    dictionary_blocks: int = 3_000  # of each class and fold of those rows, that a dictionary is built from
    level: int = 3
    ridge: float = 1e-3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    block: int
    level: int
    prior: float

    def features(self, data: bytes) -> list[float]:
        good, bad = compressors(self.good, self.bad, self.level)
        a = b = 0
        for i in range(0, len(data) or 1, self.block):
            part = data[i : i + self.block]
            a += len(good.compress(part))
            b += len(bad.compress(part))
        n = len(data) + 20
        d, r, s = (b - a) / max(a, b), (a + b) / 2 / n, np.log1p(n) / 10
        return [1.0, d, r, d * r, d * d, r * r, s, s * d, s * r]

    def score(self, data: bytes) -> float:
        if not self.weights:
            return self.prior
        return float(1 / (1 + np.exp(-np.dot(self.features(data), self.weights))))


@lru_cache(maxsize=8)
def compressors(good: bytes, bad: bytes, level: int):
    out = []
    for raw in (good, bad):
        d = zstandard.ZstdCompressionDict(raw)
        d.precompute_compress(level=level)
        out.append(zstandard.ZstdCompressor(dict_data=d, level=level, write_checksum=False, write_content_size=False, write_dict_id=False))
    return out


def dictionary(blocks: list[bytes], cfg: Config) -> bytes:
    """Trained where there is enough text for it, else the text itself."""
    try:
        return zstandard.train_dictionary(cfg.dictionary, blocks, level=cfg.level).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-cfg.dictionary :]


def calibrate(x: np.ndarray, y: np.ndarray, totals: list[int], cfg: Config) -> tuple[float, ...]:
    """Logistic weights of the features, each class weighed to its size in `totals`."""
    share = np.array([totals[c] / max(1, (y == c).sum()) for c in (0, 1)])
    w = share[y.astype(int)]
    w *= len(w) / w.sum()
    beta = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hess = x.T @ (x * (w * p * (1 - p))[:, None]) + cfg.ridge * np.eye(len(beta))
        step = np.linalg.solve(hess, x.T @ (w * (y - p)) - cfg.ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, beta))


def _blocks(cfg: Config):
    """(label, fold, h, block) of every block of (label, fold, text), with a hash to draw by."""

    def run(batches):
        for batch in batches:
            for label, fold, text in zip(*(c.to_pylist() for c in batch.columns)):
                data = text.encode()
                parts = [data[i : i + cfg.block] for i in range(0, len(data), cfg.block)]
                drawn = [xxhash.xxh3_64_intdigest(part, seed=i) >> 1 for i, part in enumerate(parts)]
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(([label] * len(parts), [fold] * len(parts), drawn, parts), kinds)], ["label", "fold", "h", "block"])

    return run


def _features(models: list[Model]):
    def run(batches):
        for batch in batches:
            folds = batch.column(1).to_pylist()
            x = [models[f].features(t.encode()) for f, t in zip(folds, batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["label", "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, train: Column, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", cfg: Config = Config()) -> Model:
    """`train` selects the rows of `labels` that may be learnt from.

    Texts stay on the executors: what comes to the driver are blocks, 2 * cfg.folds * cfg.dictionary_blocks at most, and a
    row of features for each of the 2 * cfg.per_class rows of the sample.
    """
    ws = Workspace(docs.sparkSession, "quality")
    chosen, totals = labelled.sample(ws, labels, label, train, (cfg.per_class, cfg.per_class), id_col)
    prior = totals[1] / sum(totals) if sum(totals) else 0.5
    fold = F.pmod(F.xxhash64("text"), F.lit(cfg.folds)).cast("int").alias("fold")
    rows = ws.write(labelled.texts(chosen, docs, id_col, text_col).select("label", fold, "text").distinct(), "texts")
    if rows.select("label").distinct().count() < 2:
        ws.drop("labelled", "sample", "texts")
        return Model(b"", b"", (), cfg.block, cfg.level, prior)
    blocks = rows.mapInArrow(_blocks(cfg), "label int, fold int, h bigint, block binary")
    rank = F.row_number().over(W.partitionBy("label", "fold").orderBy("h", "block"))
    drawn = blocks.withColumn("rank", rank).where(F.col("rank") <= cfg.dictionary_blocks).drop("rank").toArrow()
    of: dict[tuple[int, int], list] = {}
    for y, f, h, part in sorted(zip(*(drawn[c].to_pylist() for c in ("label", "fold", "h", "block"))), key=lambda r: (r[2], r[3])):
        of.setdefault((y, f), []).append((h, part))

    def build(folds: tuple[int, ...]) -> tuple[bytes, bytes]:
        return tuple(dictionary([part for _, part in sorted(x for f in folds for x in of.get((y, f), []))], cfg) for y in (1, 0))

    # Rows of a fold are seen under dictionaries of the others, where those have both classes.
    every, parts = tuple(range(cfg.folds)), []
    for f in every:
        rest = tuple(g for g in every if g != f)
        rest = rest if all(any(of.get((y, g)) for g in rest) for y in (0, 1)) else every
        parts.append(Model(*build(rest), (0.0,), cfg.block, cfg.level, prior))
    got = rows.select("label", "fold", "text").mapInArrow(_features(parts), "label int, x array<double>").toArrow()
    seen = sorted(zip(got["label"].to_pylist(), got["x"].to_pylist()))
    weights = calibrate(np.array([x for _, x in seen]), np.array([y for y, _ in seen], float), totals, cfg)
    ws.drop("labelled", "sample", "texts")
    return Model(*build(every), weights, cfg.block, cfg.level, prior)


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] | None = None, out: str = "score") -> DataFrame:
    """Every row of `docs`, with the columns `keep` (else all) and a column `out`: 0 to 1, higher for better text."""
    own = list(docs.columns if keep is None else keep)
    # The text comes first, and is not passed twice where it is kept.
    sent = [text_col, *(c for c in own if c != text_col)]
    places, names = [sent.index(c) for c in own], [f"c{i}" for i in range(len(own) + 1)]

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                scores = pa.array([model.score((t or "").encode()) for t in part.column(0).to_pylist()], pa.float64())
                yield pa.RecordBatch.from_arrays([*(part.column(j) for j in places), scores], names)

    kinds = [docs.schema[c].dataType.simpleString() for c in own]
    schema = ", ".join(f"{n} {k}" for n, k in zip(names, [*kinds, "double"]))
    got = docs.select(*(F.col(f"`{c}`").alias(f"s{i}") for i, c in enumerate(sent))).mapInArrow(run, schema)
    return got.toDF(*own, out)
