"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.llm import bpe, chat_format, decontaminate, gif, html_extract, minhash_dedup, quality, token_cache, toxicity, url_reputation
from passagemill.llm.common import Workspace, table, text_crc
from passagemill.llm.oracles import ORACLE_SQL  # noqa: F401
from passagemill.llm.url_reputation import Rule

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RULES = [Rule("org", "/", True), Rule("example.org", "/es/", False), Rule("example.org", "/en/1", False), Rule("com", "/fr/", True), Rule("com", "/de/", False)]


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of documents stand for the outcomes of the pages with the same number."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return url_reputation.judge(table(spark, sf_dir, "pages").select("page_id", "url"), outcomes, RULES)


def _classified(docs: DataFrame, scored: DataFrame, folds: int, fold: int, least: float) -> DataFrame:
    return scored.select(
        "doc_id", F.coalesce(text_crc(F.col("doc_id")) % folds == fold, F.lit(False)).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted")
    )


def op2_quality_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), text_crc(F.col("doc_id")) % 5 != 0)
    return _classified(docs, quality.score(docs, model, keep=("doc_id",)), 5, 0, 0.3)


#: Speaker markers of system, user and assistant, in the manners of several kinds of chat logs.
MARKERS = (
    ("System: ", "User: ", "Assistant: "), ("<|system|>\n", "<|user|>\n", "<|assistant|>\n"), ("### System:\n", "### Instruction:\n", "### Response:\n"), ("[system] ", "Human: ", "AI: "),
)


def as_logged(turns: DataFrame) -> DataFrame:
    """The conversations as chat logs print them: three of four turns bear a speaker marker, in the manner of their conversation."""
    kind = F.pmod(text_crc(F.col("conv_id")), F.lit(len(MARKERS)))
    found = F.coalesce(*(F.when((kind == i) & (F.col("role") == r), F.lit(m)) for i, ms in enumerate(MARKERS) for r, m in zip(chat_format.ROLES, ms)))
    marked = F.coalesce(F.pmod(F.crc32(F.encode(F.concat_ws(":", "conv_id", "turn"), "UTF-8")), F.lit(4)) != 0, F.lit(False)) & found.isNotNull()
    return turns.withColumn("text", F.when(marked, F.concat(found, F.coalesce("text", F.lit("")))).otherwise(F.col("text")))


def op3_chat_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles are learnt from four fifths of the conversations and recovered for all, from markers and texts alone."""
    turns = as_logged(table(spark, sf_dir, "conversations"))
    model = chat_format.fit(turns, text_crc(F.col("conv_id")) % 5 != 0)
    held_out = F.coalesce(text_crc(F.col("conv_id")) % 5 == 0, F.lit(False)).alias("held_out")
    return chat_format.format_turns(turns, model).select("conv_id", "turn", held_out, "role", "rendered")


def op4_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = gif.frames(gif.store(table(spark, sf_dir, "documents")), keep=("n_bytes",))
    histogram = F.aggregate(
        "frames", F.array_repeat(F.lit(0).cast("bigint"), 65), lambda acc, f: F.zip_with(acc, f["histogram"], lambda a, b: a + b)
    )
    frames = F.concat_ws(
        "|", F.size("frames").cast("string"), F.aggregate("frames", F.lit(0), lambda acc, f: acc + f["delay_ms"]).cast("string"), F.concat_ws(",", histogram.cast("array<string>"))
    )
    return read.select(
        "doc_id", "n_bytes", F.octet_length("samples").cast("bigint").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(samples, -64, 64)")).alias("tail_crc32"), F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), frames.alias("feature"),
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The English documents fill a store, and all documents then meet it: stored digests are joined, the others encoded."""
    docs, store = table(spark, sf_dir, "documents"), f"{Workspace(spark, 'token-store').root}/counts"
    token_cache.token_counts(docs.where("lang = 'en'"), TOKENIZER, store)
    counts = token_cache.token_counts(docs, TOKENIZER, store)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), cfg=minhash_dedup.Config(shingle=4))


def op7_toxicity_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), text_crc(F.col("doc_id")) % 3 != 1)
    return _classified(docs, toxicity.score(docs, model, keep=("doc_id",)), 3, 1, 0.7)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents"), TOKENIZER)
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256")
    )


def op9_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "matched", "n_windows", (F.col("matched") / F.col("n_windows")).alias("coverage"), "reparameterised")


def op10_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html_extract.main_text(table(spark, sf_dir, "pages"), keep=("url",))
    return text.withColumn("n_chars", F.length("text").cast("bigint"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_reputation, op2_quality_compression, op3_chat_transcripts, op4_gif_media, op5_token_counts, op6_minhash_near_dedup, op7_toxicity_trees, op8_byte_bpe,
        op9_template_decontamination, op10_html_main_text,
    )
}
