"""Bounded samples of labelled rows, on which classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import Workspace, text_crc


def sample(ws: Workspace, labels: DataFrame, label: str, train: Column, per_class: tuple[int, int], id_col: str = "doc_id") -> tuple[DataFrame, list[int]]:
    """(id, label) of at most per_class[c] training rows of each class c, and the classes' full sizes.

    The rows are those with the least hash of their id, so they do not depend on order or partitions.
    An id that is labelled more than once counts once, with its highest label; null labels count as none.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & train)
    known = ws.write(known.groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.max(label).cast("int").alias("label")), "labelled")
    total = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    parts = [known.where(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(per_class[c]) for c in (0, 1)]
    return ws.write(parts[0].union(parts[1]), "sample"), [total.get(0, 0), total.get(1, 0)]


def texts(chosen: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, label, text) of the sampled rows; `chosen` is bounded by the sample's parameters, so it is broadcast."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return docs.join(F.broadcast(chosen), "id")


def outside_fold(id_col: str, folds: int, fold: int) -> Column:
    """Rows whose id is not in the held-out fold."""
    return (text_crc(F.col(id_col)) % folds) != fold
