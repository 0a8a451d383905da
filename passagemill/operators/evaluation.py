"""Retrieval metrics over (qid, doc, rank) runs and (qid, doc, grade) judgments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def coerce_grades(judged: DataFrame) -> DataFrame:
    """(qid, doc, grade) from (qid, expected) with a JSON string, list, or map of grades; a bad grade is 1."""
    v = F.col("expected")
    kind = F.when(v.startswith("{"), "map").when(v.startswith("["), "list").otherwise("one")
    graded = F.transform(F.map_entries(F.from_json(v, "map<string,string>")), lambda e: F.struct(e["key"].alias("doc"), F.coalesce(e["value"].try_cast("double"), F.lit(1.0)).alias("grade")))
    listed = F.transform(F.from_json(v, "array<string>"), lambda d: F.struct(d.alias("doc"), F.lit(1.0).alias("grade")))
    single = F.array(F.struct(v.alias("doc"), F.lit(1.0).alias("grade")))
    return judged.select("qid", F.explode(F.when(kind == "map", graded).when(kind == "list", listed).otherwise(single)).alias("g")).select("qid", "g.doc", "g.grade")


def first_only(run: DataFrame) -> DataFrame:
    """Each document once a query, at its first place; ranks are dense again."""
    best = run.groupBy("qid", "doc").agg(F.min("rank").alias("rank"))
    return best.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("rank", "doc")))


def metrics(run: DataFrame, grades: DataFrame, k: int = 5, true_recall: bool = False, full_ap: bool = False) -> DataFrame:
    """(qid, p1, hit, rr, ap, ndcg, precision, recall, f1) for every judged query.

    `hit` is 1 when any relevant document is in the top k; `recall` repeats it unless true_recall. AP divides by
    min(relevant, k), or by all relevant with full_ap. Gain is 2^grade - 1, discount log2(rank + 1).
    """
    rel = grades.where("grade > 0")
    joined = run.where(F.col("rank") <= k).join(rel, ["qid", "doc"], "left").withColumn("rel", F.col("grade").isNotNull().cast("int"))
    hits = F.sum("rel").over(W.partitionBy("qid").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    seen = joined.withColumn("hits", hits)
    gain = lambda g: F.pow(F.lit(2.0), g) - 1
    per = seen.groupBy("qid").agg(
        F.max(F.when((F.col("rank") == 1) & (F.col("rel") == 1), 1.0).otherwise(0.0)).alias("p1"),
        F.max(F.col("rel").cast("double")).alias("hit"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first_hit"),
        F.sum(F.when(F.col("rel") == 1, F.col("hits") / F.col("rank")).otherwise(0.0)).alias("ap_sum"),
        F.sum(F.when(F.col("rel") == 1, gain(F.col("grade")) / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"), F.sum("rel").alias("found"),
    )
    order = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("grade"), "doc"))
    ideal = rel.withColumn("i", order).groupBy("qid").agg(
        F.count(F.lit(1)).alias("relevant"), F.sum(F.when(F.col("i") <= k, gain(F.col("grade")) / F.log2(F.col("i") + 1.0)).otherwise(0.0)).alias("idcg")
    )
    both = grades.select("qid").distinct().join(ideal, "qid", "left").join(per, "qid", "left").fillna(0.0, ["p1", "hit", "ap_sum", "dcg", "idcg"]).fillna(0, ["found", "relevant"])
    base = F.col("relevant") if full_ap else F.least("relevant", F.lit(k))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    precision, recall = F.col("found") / F.lit(float(k)), share(F.col("found").cast("double"), F.col("relevant"))
    return both.select(
        "qid", "p1", "hit", F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0)).alias("rr"), share(F.col("ap_sum"), base).alias("ap"), share(F.col("dcg"), F.col("idcg")).alias("ndcg"),
        precision.alias("precision"), (recall if true_recall else F.col("hit")).alias("recall"), share(2 * precision * recall, precision + recall).alias("f1"),
    )


def recall_grid(run: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10), mrr_at: int = 10) -> DataFrame:
    """One row: over all queries of `relevant` (qid, doc), the share with a relevant document in the top k for each k, and the mean reciprocal rank, in one pass."""
    found = run.where(F.col("rank") <= max(*ks, mrr_at)).select("qid", "doc", "rank")
    every = relevant.select("qid", "doc").distinct().join(found, ["qid", "doc"], "left").groupBy("qid").agg(F.min("rank").alias("first"))  # `relevant` is made once
    shares = [F.avg(F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0))).alias(f"recall_{k}") for k in ks]
    return every.agg(F.count(F.lit(1)).alias("n"), *shares, F.avg(F.when(F.col("first") <= mrr_at, 1.0 / F.col("first")).otherwise(0.0)).alias("mrr"))


def summary(per_query: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means, found count and accuracy, over all or by columns."""
    aggs = [
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("hit") > 0).alias("n_found"), F.avg((F.col("hit") > 0).cast("double")).alias("accuracy"),
        *(F.avg(m).alias(f"mean_{m}") for m in ("p1", "rr", "ap", "ndcg")),
    ]
    return per_query.groupBy(*(by or [])).agg(*aggs)


def latency(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, n, mean, median, p95, low, high); p95 is the maximum under 20 values, else the exclusive-method quantile.

    The exclusive quantile interpolates at place 0.95 (n + 1) of the sorted values.
    """
    w = W.partitionBy(*by)
    place = 0.95 * (F.col("n") + 1)
    low = F.floor(place)
    ranked = rows.where(F.col(value).isNotNull()).withColumn("r", F.row_number().over(w.orderBy(value))).withColumn("n", F.count(F.lit(1)).over(w))
    at = lambda i: F.max(F.when(F.col("r") == i, F.col(value)))
    g = ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"), F.min(value).alias("low"), F.max(value).alias("high"),
        at(low).alias("a"), at(low + 1).alias("b"),
    )
    p95 = F.when((F.col("n") < 20) | F.col("b").isNull(), F.col("high")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * (place - low))
    return g.select(*by, "n", "mean", "median", p95.alias("p95"), "low", "high")


def best_run(runs: DataFrame) -> DataFrame:
    """The run with the best (accuracy, mrr, -latency); ties keep the first by `run`."""
    return runs.orderBy(F.desc("accuracy"), F.desc("mrr"), "latency", "run").limit(1)


def pool(runs: DataFrame, texts: DataFrame, known: DataFrame, depth: int = 50, preview: int = 160) -> DataFrame:
    """(qid, doc, preview, grade): the union of all runs' tops, with labels that exist."""
    top = runs.where(F.col("rank") <= depth).select("qid", "doc").distinct()
    return top.join(texts.select("doc", F.left("text", F.lit(preview)).alias("preview")), "doc").join(known, ["qid", "doc"], "left")


def metric_value(row: Column, *names: str) -> Column:
    """The first of the named metrics of a JSON report that is a number, or has a numeric mean; else 0."""
    options = [F.coalesce(F.get_json_object(row, f"$.{n}").try_cast("double"), F.get_json_object(row, f"$.{n}.mean").try_cast("double")) for n in names]
    return F.coalesce(*options, F.lit(0.0))
