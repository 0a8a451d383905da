"""Token counts through a digest cache.

Content is normalised (null to empty) and digested, and the digest of the tokenizer file is its
version. Stored counts are joined by (version, digest), of the store only the digests of this call's texts are
taken on; the distinct contents without a count are encoded, each once, and their counts are appended to the store.

Nulls and edge cases: a null text counts as an empty one, with 0 tokens; a null id is kept; repeated
rows, with or without an id, come back repeated and are encoded once; texts are encoded whole; ties: of several stored
counts of a digest the largest is taken, and they are equal unless a store was written by other means; an empty table
gives an empty result and appends nothing. Columns other than the id and the text are not read, and may have any name.
"""

from __future__ import annotations

import hashlib
import json
import os
from functools import lru_cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm.bpe import Memory, is_plain_byte_level, load, words_of
from passagemill.llm.common import BROADCAST_KEYS, Workspace, only_keys, salted_join

STORE = "version string, digest string, n_tokens bigint"


def version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


class Counter:
    """Counts a text's tokens as the tokenizers or the sentencepiece library does, as the file's suffix says.

    Plain byte-level files are counted by our own encoder, which gives the library's ids at a third
    of its cost; any other file by its library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.count = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        elif is_plain_byte_level(_spec(path)):
            bpe = load(path)
            words = Memory(lambda word: len(bpe.scan(" " + word)) >> 2).__getitem__

            def count(texts):
                cut = ((words_of(t), t) for t in texts)
                return [len(bpe.scan(t)) >> 2 if w is None else sum(map(words, w[1:]), len(bpe.scan(w[0])) >> 2) for w, t in cut]

            self.count = count
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.count = lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def _stored(spark, store: str, of: str) -> DataFrame | None:
    """(digest, n_tokens) of a version; None where there is no store yet."""
    try:
        return spark.read.schema(STORE).parquet(store).where(F.col("version") == of).select("digest", "n_tokens")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def token_counts(df: DataFrame, path: str, store: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, digest, n_tokens) for every row; `store` is the folder of the cache, else one of this call."""
    spark = df.sparkSession
    ws, of = Workspace(spark, "tokens"), version(path)
    store = store or f"{ws.root}/store"
    docs = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    digest = F.sha2(F.encode("text", "UTF-8"), 256).alias("digest")
    rows = ws.write(docs.select("row", "id", digest, F.octet_length("text").cast("bigint").alias("n_bytes")), "rows")
    # One row for each distinct content, found without moving texts.
    distinct = ws.write(rows.groupBy("digest").agg(F.min("row").alias("row")), "distinct")
    known = _stored(spark, store, of)
    if known is None:
        known = spark.createDataFrame([], "digest string, n_tokens bigint")
    known = only_keys(known, distinct.select("digest"), "digest").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    known = ws.write(known, "known")
    misses = ws.write(only_keys(distinct, known.select("digest"), "digest", "left_anti"), "misses")

    def run(batches):
        count = counter(path).count
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count(part.column(1).to_pylist()), pa.int64())], ["digest", "n_tokens"])

    def encoded(texts: DataFrame, name: str) -> DataFrame:
        return ws.write(texts.mapInArrow(run, "digest string, n_tokens bigint"), name)

    def once(of_these: DataFrame) -> DataFrame:
        """The texts of these digests, each once, by a shuffle of the texts."""
        return only_keys(docs.select(digest, "text"), of_these.select("digest"), "digest").dropDuplicates(["digest"]).select("digest", "text")

    if misses.count() <= BROADCAST_KEYS:
        new = encoded(docs.join(F.broadcast(misses.select("row")), "row", "left_semi").select(digest, "text"), "encoded")
        # Rows of an input that comes in another order each time it is read have other numbers now.
        left = ws.write(only_keys(misses, new.select("digest").distinct(), "digest", "left_anti"), "left")
        if left.limit(1).count():
            new = only_keys(new, misses.select("digest"), "digest").dropDuplicates(["digest"]).union(encoded(once(left), "encoded-left"))
    else:
        new = encoded(once(misses), "encoded")
    new.select(F.lit(of).alias("version"), "digest", "n_tokens").write.mode("append").parquet(store)
    counts = ws.write(known.union(new), "counts")
    ws.drop("distinct", "known", "misses", "encoded", "left", "encoded-left")
    return salted_join(rows, counts, "digest").select(F.col("id").alias(id_col), "n_bytes", "digest", "n_tokens")
