"""Dense retrieval and fusion with lexical scores."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas import types

from passagemill.functions.values import min_max, round6
from passagemill.functions.vectors import dot
from passagemill.operators.sizes import is_small, small


@dataclass(frozen=True)
class HybridConfig:
    rrf_k: int = 60
    lexical: float = 0.7
    semantic: float = 0.3
    lexical_top: int = 80
    semantic_top: int = 1000
    results: int = 300


def encode(rows: DataFrame, id_col: str, text: Column, encoder: Callable[[list[str]], np.ndarray], dim: int, prefix: str = "passage: ", batch: int = 128, unit: bool = True) -> DataFrame:
    """(id, v): vectors of texts by any encoder of lists of texts, which is made or loaded once a task where it is a factory's result.

    Null texts are encoded as empty ones. Vectors are of unit length unless told otherwise; a zero vector stays one.
    """
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                got = np.asarray(encoder([prefix + (t or "") for t in part.column(1).to_pylist()]), np.float32)
                if got.shape != (part.num_rows, dim):
                    raise ValueError(f"the encoder gave {got.shape}, not {(part.num_rows, dim)}")
                if unit:
                    got /= np.maximum(np.linalg.norm(got, axis=1, keepdims=True), 1e-12)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(got), pa.list_(pa.float32()))], ["id", "v"])

    return rows.select(F.col(id_col).alias("id"), text.alias("text")).mapInArrow(run, f"id {kind}, v array<float>").withColumnRenamed("id", id_col)


def letter_counts(texts: list[str]) -> np.ndarray:
    """An encoder without a model: how often each of a to z occurs, in either case."""
    codes = [np.frombuffer(t.encode(), np.uint8) | 32 for t in texts]
    return np.stack([np.bincount(c[(c >= 97) & (c <= 122)] - 97, minlength=26) for c in codes])


#: Bytes of query vectors that go to a task at once.
QUERY_BLOCK = 16 << 20


def scan(queries: DataFrame, vectors: DataFrame, top: int | None = None, digits: int = 6) -> DataFrame:
    """(qid, doc, score) of every query vector (qid, q) against every vector (doc, v), in blocks of queries.

    Scores are rounded to `digits`. With `top`, a task keeps the best so many of a query and all that tie with the last
    of them, so what leaves the tasks is bounded by them and not by the vectors; ranks are cut by the caller. Null vectors have no score;
    one of another length than the queries raises.
    """
    kinds = queries.schema["qid"].dataType.simpleString(), vectors.schema["doc"].dataType.simpleString()
    schema = f"qid {kinds[0]}, doc {kinds[1]}, score double"

    def block(ids: pa.Array, q: np.ndarray):
        def run(batches):
            for batch in batches:
                ok = batch.filter(batch.column(1).is_valid())
                if not ok.num_rows:
                    continue
                flat = ok.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                scores = np.round(q @ flat.reshape(ok.num_rows, -1).T, digits)
                least = np.full(len(q), -np.inf)
                if top and ok.num_rows > top:
                    least = np.partition(scores, ok.num_rows - top, axis=1)[:, ok.num_rows - top]
                for i in range(0, len(q), 256):
                    x, y = np.nonzero(scores[i : i + 256] >= least[i : i + 256, None])
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(x + i)), ok.column(0).take(pa.array(y)), pa.array(scores[x + i, y])], ["qid", "doc", "score"])

        return run

    found, held, size = None, [], 0
    source = vectors.select("doc", "v")

    def done() -> DataFrame:
        ids = pa.array([r["qid"] for r in held], types.to_arrow_type(queries.schema["qid"].dataType))
        got = source.mapInArrow(block(ids, np.array([r["q"] for r in held], np.float64)), schema)
        return got if found is None else found.union(got)

    asked = queries.where("q is not null").select("qid", "q")
    for r in asked.collect() if is_small(asked, most_bytes=QUERY_BLOCK) else asked.toLocalIterator():
        held.append(r)
        size += 8 * len(r["q"])
        if size >= QUERY_BLOCK:
            found, held, size = done(), [], 0
    if held:
        found = done()
    return found if found is not None else queries.sparkSession.createDataFrame([], schema)


def scan_candidates(queries: DataFrame, vectors: DataFrame, candidates: DataFrame) -> DataFrame:
    """Only (qid, doc) pairs of `candidates` are scored; candidates without a vector have none."""
    return candidates.select("qid", "doc").join(vectors, "doc").join(small(queries), "qid").select("qid", "doc", dot(F.col("q"), F.col("v")).alias("score"))


def merge(lexical: DataFrame, semantic: DataFrame) -> DataFrame:
    """(qid, doc, bm25, semantic): keys of either side, rounded to 6 places, the missing side null."""
    a = lexical.select("qid", "doc", round6(F.col("score")).alias("bm25"))
    b = semantic.select("qid", "doc", round6(F.col("score")).alias("semantic"))
    return a.join(b, ["qid", "doc"], "full_outer")


def stable_rank(value: str, ties: tuple[str, ...] = ("doc",)) -> Column:
    """1-based rank of a query's non-null values, descending; null values have no rank."""
    w = W.partitionBy("qid").orderBy(F.col(value).desc_nulls_last(), *ties)
    return F.when(F.col(value).isNotNull(), F.row_number().over(w).cast("bigint"))


def fuse(ranked: DataFrame, lexical: Column, semantic: Column, cfg: HybridConfig = HybridConfig()) -> DataFrame:
    """Weighted reciprocal ranks of rows that have `rb` and `rs`; a missing side gives 0."""
    part = lambda w, r: F.coalesce(w / (F.lit(float(cfg.rrf_k)) + F.col(r)), F.lit(0.0))
    scored = ranked.withColumn("rrf", round6(part(lexical, "rb") + part(semantic, "rs"))).drop("rb", "rs")
    return scored.withColumn("rank", stable_rank("rrf")).where(F.col("rank") <= cfg.results)


def rrf(merged: DataFrame, cfg: HybridConfig = HybridConfig()) -> DataFrame:
    """(qid, doc, bm25, semantic, rrf, rank): weighted reciprocal ranks of both sides."""
    return fuse(merged.withColumn("rb", stable_rank("bm25")).withColumn("rs", stable_rank("semantic")), F.lit(cfg.lexical), F.lit(cfg.semantic), cfg)


def weighted_min_max(merged: DataFrame, cfg: HybridConfig = HybridConfig()) -> DataFrame:
    """(qid, doc, bm25, semantic, fused, rank): both sides scaled to 0..1 within the query, a missing side is 0."""
    filled = merged.fillna(0.0, ["bm25", "semantic"])
    fused = cfg.lexical * min_max(F.col("bm25"), "qid") + cfg.semantic * min_max(F.col("semantic"), "qid")
    scored = filled.withColumn("fused", round6(fused))
    return scored.withColumn("rank", stable_rank("fused")).where(F.col("rank") <= cfg.results)


def lexical_only(lexical: DataFrame, cfg: HybridConfig = HybridConfig()) -> DataFrame:
    scored = lexical.select("qid", "doc", round6(F.col("score")).alias("bm25"))
    return scored.withColumn("rank", stable_rank("bm25")).where(F.col("rank") <= cfg.results)


def alignment(keys: DataFrame, other: DataFrame) -> DataFrame:
    """Keys of two aligned tables (key, place) that are missing on a side or stand at another place."""
    both = keys.withColumnRenamed("place", "left_place").join(other.withColumnRenamed("place", "right_place"), "key", "full_outer")
    return both.where(~F.col("left_place").eqNullSafe(F.col("right_place")))
