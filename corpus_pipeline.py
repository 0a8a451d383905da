"""The corpus pipeline: five stages from `documents` to encoded training data.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each stage's rows and reads
them again as the next one's. All stages but the last return the columns of `documents`. Every stage
keeps extra columns whatever their names, rows with null ids or texts, and empty tables; a null text is
judged as an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.llm import bpe, decontaminate, minhash_dedup, quality, toxicity
from passagemill.llm.common import Workspace, only_keys, scratch, ship, table, text_crc

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def fresh(base: str, columns: list[str]) -> str:
    """A column name that none of `columns` has."""
    taken = {c.lower() for c in columns}
    while base in taken:
        base += "_"
    return base


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the toxicity classifier scores 0.7 or more."""
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), text_crc(F.col("doc_id")) % 3 != 1)
    score = fresh("toxicity_score", docs.columns)
    return toxicity.score(docs, model, out=score).where(F.col(score) < 0.7).select(*docs.columns)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier scores under 0.3."""
    model = quality.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), text_crc(F.col("doc_id")) % 5 != 0)
    score = fresh("quality_score", docs.columns)
    return quality.score(docs, model, out=score).where(F.col(score) >= 0.3).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates (five-word shingles, similarity 0.8): of its rows the one with the least id.

    Rows are told apart by numbers of their own, given in the order of ids, so rows that share an id, or have none, are
    judged each by its text, and the least number of a group is that of its least id.
    """
    ship(spark)
    ws, number = Workspace(spark, "dedup-stage"), fresh("row_number", docs.columns)
    order = [F.col("doc_id").asc_nulls_last(), F.col(number)]
    rows = docs.withColumn(number, F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = ws.write(rows.withColumn(number, F.monotonically_increasing_id()), "rows")
    found = minhash_dedup.near_duplicates(rows.select(number, "text"), id_col=number)
    return only_keys(rows, ws.write(found.where("kept").select(number), "kept"), number).select(*docs.columns)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, as it stands or with other numbers or names."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip): token ids as little-endian 32-bit integers, and whether they decode to the text."""
    ship(spark)
    coded = bpe.encode(docs, TOKENIZER, keep_text=True)
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip")
    )


STAGES = [
    ("toxicity", keep_civil), ("quality", keep_good), ("near_dedup", keep_one_of_each), ("decontamination", keep_uncontaminated), ("bpe", encode),
]
#: The classifiers and the signatures are not SQL; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; tables of the stages before are deleted as soon as the next one is written."""
    docs, ws, before = table(spark, sf_dir, "documents"), Workspace(spark, "pipeline"), []
    for name, stage in STAGES:
        with scratch(spark):
            docs = ws.write(stage(spark, docs, sf_dir), name)
        ws.drop(*before)
        before = [name]
    return docs
