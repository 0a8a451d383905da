"""Near-duplicate groups: banded MinHash candidates, sequential Bayesian pruning, exact verification.

1. Every text becomes its set of word shingles (64-bit hashes), a MinHash signature and band keys.
   Rows with equal sets collapse to one representative, the least id, before any pairing.
2. A band bucket is paired as a star: each member against the bucket's least id, so a bucket of m
   members gives m - 1 pairs. Signatures are compared batch by batch, and a pair is pruned once the
   posterior probability that its similarity reaches the threshold is below `miss`. Survivors are
   verified on their whole shingle sets.
3. Pairs a star leaves open are those of one bucket but of different components. Small buckets
   list them. In crowded ones they are compared inside the tasks that hold the bucket, block by
   block, on longer signatures, each pair in the first band that its two texts share; only pairs that
   survive the posterior test leave a task.
4. Components by least-label propagation with pointer jumping: over written tables, or, where there
   are at most `local_edges` links, in the driver's arrays, as each step over tables is a dozen stages.

Nulls and edge cases: a null, empty or blank text has an empty set and links with nothing; fewer
words than a shingle give one shingle; rows with a null id come back unlinked, with a null
component, and are kept; repeated rows come back repeated, and rows that share an id are one node; texts are read
whole; ties: of equal sets the least id stands for all; an empty table gives an empty result. Columns other than the
id and the text are not read, and may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm import bytewords
from passagemill.llm.common import Workspace, groups, hot_keys, only_keys, salted_join


@dataclass(frozen=True)
class Config:
    shingle: int = 5
    percent: int = 80  # linked if 100 * intersection >= percent * union
    bands: int = 40
    rows: int = 6
    batch: int = 40  # hashes compared before each posterior test
    miss: float = 1e-6  # probability of pruning a pair that reaches the threshold, per test
    small_bucket: int = 32
    long: int = 1024  # hashes of the signatures that crowded buckets compare
    long_batch: int = 64
    block: int = 2000  # members of a crowded bucket that are compared with as many in one task
    local_edges: int = 1_000_000  # links, 16 bytes each, whose components the driver finds; beyond it Spark does


def _family(n: int) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(97))
    return rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def signature(u: np.ndarray, family: np.ndarray) -> np.ndarray:
    """Minimum of high + a * low (mod 2^32) over the set, for each a."""
    high, low = (u >> np.uint64(32)).astype(np.uint32), u.astype(np.uint32)
    out = np.full(len(family), 2**32 - 1, np.uint32)
    for i in range(0, len(u), 1024):
        v = np.multiply.outer(family, low[i : i + 1024])
        v += high[i : i + 1024]
        np.minimum(out, v.min(axis=1), out=out)
    return out


def band_keys(sigs: np.ndarray, bands: int, rows: int) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(98))
    mult = rng.integers(1, 2**63, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    parts = sigs.reshape(len(sigs), bands, rows).astype(np.uint64)
    return bytewords.mix((parts * mult).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))


def least_matches(cfg: Config, n: int | None = None, batch: int | None = None) -> list[tuple[int, int]]:
    """(hashes compared, least matches that survive), from Beta(matches + 1, rest + 1) above the threshold.

    P(similarity >= t | k of m match) is the binomial tail P(Bin(m + 1, t) <= k).
    """
    from math import exp, lgamma, log

    n, batch = n or cfg.bands * cfg.rows, batch or cfg.batch
    t, out = cfg.percent / 100, []
    for m in range(batch, n + 1, batch):
        tail, k = 0.0, 0
        while k <= m:
            tail += exp(lgamma(m + 2) - lgamma(k + 1) - lgamma(m + 2 - k) + k * log(t) + (m + 1 - k) * log(1 - t)) if t < 1 else 0.0
            if tail >= cfg.miss:
                break
            k += 1
        out.append((m, k))
    return out


def _sketch(cfg: Config, id_col: str, text_col: str):
    family = _family(cfg.bands * cfg.rows)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, digests, sigs = [], [], []
        for u in bytewords.shingle_sets(batch.column(1), cfg.shingle):
            sizes.append(len(u))
            if len(u):
                digests.append(xxhash.xxh3_128_digest(np.ascontiguousarray(u)))
                sigs.append(signature(u, family))
            else:
                digests.append(None)
        full = np.array(sizes) > 0
        bands, sketch = pa.nulls(len(sizes), pa.list_(pa.int64())), pa.nulls(len(sizes), pa.binary())
        if full.any():
            keys = band_keys(np.stack(sigs), cfg.bands, cfg.rows).view(np.int64)
            low = (np.stack(sigs) >> np.uint32(11)).astype(np.uint8)
            at = np.where(full, np.cumsum(full) - 1, -1)
            bands = pa.array([keys[i] if i >= 0 else None for i in at], pa.list_(pa.int64()))
            sketch = pa.array([low[i].tobytes() if i >= 0 else None for i in at], pa.binary())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), sketch, bands],
            ["id", "n_shingles", "digest", "sketch", "bands"],
        )

    return kernel


def _prune(cfg: Config):
    tests = least_matches(cfg)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in (2, 3))
            alive, found, done = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int32), 0
            for m, least in tests:
                found[alive] += (a[alive, done:m] == b[alive, done:m]).sum(axis=1, dtype=np.int32)
                alive, done = alive[found[alive] >= least], m
            yield batch.select([0, 1]).take(pa.array(alive))

    return run


def _verify(cfg: Config):
    def run(batches):
        last_id, last_set = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, keep = batch.column(0).to_pylist(), []
            right = bytewords.shingle_sets(batch.column(3), cfg.shingle)
            for i, v in enumerate(right):
                if ids[i] != last_id:
                    last_id, last_set = ids[i], next(bytewords.shingle_sets(batch.column(2).slice(i, 1), cfg.shingle))
                both = len(np.intersect1d(last_set, v, assume_unique=True))
                union = len(last_set) + len(v) - both
                if union and 100 * both >= cfg.percent * union:
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    return run


def verified(ws: Workspace, pairs: DataFrame, sketches: DataFrame, texts: DataFrame, cfg: Config, name: str) -> DataFrame:
    """The pairs (a, b) of `pairs` whose sets reach the threshold, written."""
    pairs = ws.write(pairs, f"{name}-pairs")
    with_b = ws.write(pairs.join(sketches.select(F.col("id").alias("b"), F.col("sketch").alias("sb")), "b"), f"{name}-sketched")
    both = salted_join(with_b, sketches.select(F.col("id").alias("a"), F.col("sketch").alias("sa")), "a", chunk=5000)
    alive = ws.write(both.select("a", "b", "sa", "sb").mapInArrow(_prune(cfg), "a bigint, b bigint").distinct(), f"{name}-alive")
    ids = ws.write(alive.select(F.explode(F.array("a", "b")).alias("id")).distinct(), f"{name}-ids")
    own = ws.write(only_keys(texts, ids, "id"), f"{name}-texts")
    with_b = ws.write(alive.join(own.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b"), f"{name}-texted")
    both = salted_join(with_b, own.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    out = ws.write(both.select("a", "b", "ta", "tb").mapInArrow(_verify(cfg), "a bigint, b bigint").distinct(), f"{name}-edges")
    ws.drop(*(f"{name}-{x}" for x in ("pairs", "sketched", "alive", "ids", "texts", "texted")))
    return out


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids on the edges (a, b), ascending, and the least id that each reaches."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, label = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while True:
        x, y = label[a], label[b]
        if not (x != y).any():
            return ids, ids[label]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def components(ws: Workspace, edges: DataFrame, name: str, local: int = Config.local_edges) -> DataFrame:
    """(id, component): the least id reachable, for every id on an edge (a, b); `edges` is written."""
    if edges.count() <= local:
        found = edges.select("a", "b").where("a <> b").toArrow()
        ids, labels = least_labels(found["a"].to_numpy(), found["b"].to_numpy())
        return ws.write(ws.spark.createDataFrame(pa.table({"id": ids, "component": labels}), "id bigint, component bigint"), f"{name}-0")
    both = ws.write(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct().toDF("id", "other"), f"{name}-both")
    labels = ws.write(both.groupBy("id").agg(F.min("other").alias("m")).select("id", F.least("id", "m").alias("component")), f"{name}-0")
    step, hot = 0, hot_keys(both, "other")
    while True:
        step += 1
        near = salted_join(both, labels.select(F.col("id").alias("other"), "component"), "other", chunk=50_000, hot=hot).groupBy("id").agg(F.min("component").alias("m"))
        met = labels.join(near, "id").select("id", F.least("component", "m").alias("up"), F.col("component").alias("was"))
        met = ws.write(met, f"{name}-met-{step}")
        # A label is an id of the same component: jump to that id's own label. Most ids of a large component have one label.
        jump = labels.select(F.col("id").alias("up"), F.col("component").alias("over"))
        new = salted_join(met, jump, "up", "left", chunk=50_000).select("id", F.least("up", F.coalesce("over", "up")).alias("component"), "was")
        new = ws.write(new, f"{name}-{step}")
        changed = new.where("component <> was").limit(1).count()
        ws.drop(f"{name}-{step - 1}", f"{name}-met-{step}")
        labels = new.select("id", "component")
        if not changed:
            ws.drop(f"{name}-both")
            return labels


def _long_sketch(cfg: Config):
    """(id, n, long): set size and longer signature, a byte a hash, of each text."""
    family = _family(cfg.bands * cfg.rows + cfg.long)[cfg.bands * cfg.rows :]

    def run(batches):
        for batch in batches:
            sets = list(bytewords.shingle_sets(batch.column(1), cfg.shingle))
            long = [(signature(u, family) >> np.uint32(11)).astype(np.uint8).tobytes() for u in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(u) for u in sets], pa.int64()), pa.array(long, pa.binary())], ["id", "n", "long"])

    return run


def cross_pairs(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of one bucket and different components; buckets are small, so their lists are."""
    of = members.groupBy("bucket").agg(F.sort_array(F.collect_set(F.struct("id", "component"))).alias("of"))
    pairs = of.select(F.explode("of").alias("x"), "of").select("x", F.explode(F.expr("filter(of, y -> y.id > x.id and y.component <> x.component)")).alias("y"))
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def _compare(cfg: Config):
    """Surviving pairs (a, b) of groups (bucket, i, j): members of block i against those of block j."""
    tests = least_matches(cfg, cfg.long, cfg.long_batch)

    def survivors(g: pa.Table):
        bucket, i, j = (g[c][0].as_py() for c in ("bucket", "i", "j"))
        ids, comp, n, block = (g[c].to_numpy() for c in ("id", "component", "n", "own"))
        long = np.frombuffer(b"".join(g["long"].to_pylist()), np.uint8).reshape(len(ids), cfg.long)
        bands = np.array(g["bands"].to_pylist(), np.int64)
        band = int(np.flatnonzero(bands[0] == bucket)[0])
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        for first in range(0, len(left), 100):
            rows = left[first : first + 100]
            near = np.minimum(n[rows][:, None], n[right]) * 100 >= cfg.percent * np.maximum(n[rows][:, None], n[right])
            open_ = near & (comp[rows][:, None] != comp[right]) & ((ids[rows][:, None] < ids[right]) | (i != j))
            x, y = np.nonzero(open_)
            a, b = rows[x], right[y]
            # A pair that meets in an earlier band is compared there.
            for k in range(band):
                new = bands[a, k] != bands[b, k]
                a, b = a[new], b[new]
            alive, found, done = np.arange(len(a)), np.zeros(len(a), np.int32), 0
            for m, least in tests:
                found[alive] += (long[a[alive], done:m] == long[b[alive], done:m]).sum(axis=1, dtype=np.int32)
                alive, done = alive[found[alive] >= least], m
            a, b = a[alive], b[alive]
            yield np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])

    def run(batches):
        for g in groups(batches, ["bucket", "i", "j"]):
            for a, b in survivors(g):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def crowd_pairs(ws: Workspace, crowded: DataFrame, nodes: DataFrame, texts: DataFrame, cfg: Config) -> DataFrame:
    """Candidate pairs across components of crowded buckets, from their members (bucket, id, component, members)."""
    ids = ws.write(crowded.select("id").distinct(), "crowd-ids")
    long = only_keys(texts, ids, "id").mapInArrow(_long_sketch(cfg), "id bigint, n bigint, long binary")
    long = ws.write(long.join(nodes.select("id", "bands"), "id"), "crowd-long")
    blocks = F.ceil(F.col("members") / cfg.block).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = crowded.select("bucket", "id", "component", own.alias("own"), blocks.alias("blocks")).select("bucket", "id", "component", "own", others)
    dealt = dealt.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "component", "own")
    ready = dealt.join(long, "id").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return ready.select("bucket", "i", "j", "id", "component", "own", "n", "long", "bands").mapInArrow(_compare(cfg), "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cfg: Config = Config()) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of `docs`."""
    spark = docs.sparkSession
    ws = Workspace(spark, "minhash")
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))

    def sketch(batches, kernel=_sketch(cfg, "id", "text")):
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                yield kernel(batch.slice(i, 2000))

    rows = ws.write(docs.mapInArrow(sketch, "id bigint, n_shingles bigint, digest binary, sketch binary, bands array<bigint>"), "rows")
    ids = rows.where("id is not null and n_shingles > 0")
    groups = ws.write(ids.groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "groups")
    reps = groups.select(F.col("rep").alias("id"), "digest")
    nodes = ws.write(ids.join(reps, ["id", "digest"], "left_semi").dropDuplicates(["id", "digest"]).select("id", "sketch", "bands"), "nodes")
    sketches, texts = nodes.select("id", "sketch"), docs.where("id is not null")

    keys = nodes.select("id", F.explode("bands").alias("bucket"))
    buckets = ws.write(keys.groupBy("bucket").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("members")).where("members > 1"), "buckets")
    # The most crowded buckets meet their rows by broadcast, the rest by shuffle; the limit only moves the border.
    crowded = buckets.where("members > 1000").orderBy(F.desc("members")).limit(1000 * cfg.bands)
    crowded = F.broadcast(ws.write(crowded.select("bucket", "pivot", "members"), "crowded"))
    members = ws.write(
        keys.join(crowded, "bucket").select("id", "bucket", "pivot", "members").union(
            keys.join(crowded, "bucket", "left_anti").join(buckets, "bucket").select("id", "bucket", "pivot", "members")
        ),
        "members",
    )
    stars = members.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    edges = verified(ws, stars, sketches, texts, cfg, "star")
    # An id with several texts is one node: it ties the groups of its texts together.
    several = ws.write(ids.groupBy("id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo < hi").select("id"), "several")
    if several.limit(1).count():
        own = ids.join(several.hint("merge"), "id", "left_semi").select("id", "digest").distinct().join(groups, "digest").select("id", F.col("rep").alias("b"))
        least = own.groupBy("id").agg(F.min("b").alias("a"))
        edges = ws.write(edges.union(own.join(least, "id").select("a", "b")), "tied-edges")
    labels = components(ws, edges, "first", cfg.local_edges)

    left = members.where("members > 2").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    left = ws.write(left, "open")
    mixed = left.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
    mixed = ws.write(mixed, "mixed")
    left = ws.write(left.join(mixed.hint("merge"), "bucket", "left_semi"), "open-mixed")
    cross = cross_pairs(left.where((F.col("members") <= cfg.small_bucket) & (F.col("id") != F.col("pivot"))))
    crowd = ws.write(left.where(F.col("members") > cfg.small_bucket).select("bucket", "id", "component", "members").distinct(), "crowd")
    if crowd.limit(1).count():
        cross = cross.union(crowd_pairs(ws, crowd, nodes, texts, cfg)).distinct()
    cross = ws.write(cross, "cross")
    if cross.limit(1).count():
        edges = edges.union(verified(ws, cross, sketches, texts, cfg, "cross"))
        labels = components(ws, edges, "second", cfg.local_edges)

    # Rows of the largest groups of copies find their component by broadcast, so none crowds one task.
    named = groups.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("found"))
    named = ws.write(named.join(groups.select("digest", "copies"), "digest"), "named")
    slim = rows.select("id", "n_shingles", "digest")
    slim = ws.write(slim, "slim")
    top = named.where("copies > 1000").orderBy(F.desc("copies")).limit(1000)
    top = F.broadcast(ws.write(top.select("digest", "found"), "top"))
    out = slim.join(top, "digest").select("id", "n_shingles", "found").union(
        slim.where("digest is not null").join(top, "digest", "left_anti").join(named.select("digest", "found"), "digest", "left").select("id", "n_shingles", "found")
    ).union(slim.where("digest is null").select("id", "n_shingles", F.col("id").alias("found")))
    ws.drop("rows", "groups", "nodes", "buckets", "crowded", "members", "several", "tied-edges", "star-edges", "open", "open-mixed", "mixed", "crowd", "crowd-ids", "crowd-long", "cross", "cross-edges")
    component = F.when(F.col("id").isNotNull(), F.coalesce("found", "id"))
    return out.select(
        F.col("id").alias(id_col), "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
