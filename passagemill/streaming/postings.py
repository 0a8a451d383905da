"""New passages as a stream: normalized tokens appended to the postings; nothing stateful."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.functions import text as T


def passage_stream(spark: SparkSession, folder: str, schema: str, files_a_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).json(folder)


def tokenized(passages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return passages.select(F.col(id_col).alias("doc"), F.posexplode(T.mixed_terms(F.col(text_col))).alias("pos", "token"))


def append_postings(passages: DataFrame, id_col: str, text_col: str, out: str, checkpoint: str):
    """Appends (doc, pos, token) rows as parquet, once all files there are read; the query is returned."""
    rows = tokenized(passages, id_col, text_col)
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
