"""Shared plumbing: shipping the package, table access, shared work tables, crc32 folds and skew-safe joins."""

from __future__ import annotations

import contextlib
import math
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds at least this share of all rows, so at most 1 / HOT_SHARE keys are.
HOT_SHARE = 1 / 1000
#: Largest number of 8-byte keys that is broadcast as a filter; beyond it the join shuffles.
BROADCAST_KEYS = 2_000_000


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once an application, so kernels import it wherever they run."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    at = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
    with zipfile.ZipFile(at, "w") as out:
        for f in sorted(package.rglob("*.py")):
            out.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(at))
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; a folder of our own only in a local session that names none."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there
    got = spark.sparkContext._jsc.sc().getCheckpointDir()
    if got.isDefined():
        return got.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "/tmp/checkpoints/passagemill"
    spark.sparkContext.setCheckpointDir(own)
    return own


_roots: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Deletes every table that calls of this process still hold; results that were not written yet are lost."""
    for root in list(_roots):
        _delete(spark, root)
        _roots.discard(root)


class Workspace:
    """Tables written to the shared folder to cut lineage; lost executors lose none of them."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/work-{label}-{uuid.uuid4().hex}"
        _roots.add(self.root)  # here, so that a scratch opened later leaves this workspace alone

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        _roots.add(self.root)
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, f"{self.root}/{name}")


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes the tables of all workspaces that are opened within."""
    before = set(_roots)
    yield
    for root in _roots - before:
        _delete(spark, root)
        _roots.discard(root)


def groups(batches, keys: list[str]):
    """Tables of the rows of each key, from batches sorted by it; keys are integers without nulls."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.table(batch.columns, batch.schema.names)
        columns = [t[k].to_numpy() for k in keys]
        cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        edges = [0, *cut.tolist(), t.num_rows]
        if held and tuple(c[0] for c in columns) != last:
            yield pa.concat_tables(held)
            held = []
        for lo, hi in zip(edges[:-2], edges[1:-1]):
            held.append(t.slice(lo, hi - lo))
            yield pa.concat_tables(held)
            held = []
        held.append(t.slice(edges[-2]))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.concat_tables(held)


def text_crc(col: Column) -> Column:
    """crc32 of an id as text, as the held-out folds use it."""
    return F.crc32(F.encode(col.cast("string"), "UTF-8"))


def hot_keys(df: DataFrame, key: str, floor: int = 1000) -> list[tuple]:
    """(key, rows) of the keys with at least HOT_SHARE of the rows; never more than 1 / HOT_SHARE of them."""
    total = df.count()
    if total < floor:
        return []
    least = max(floor, math.ceil(total * HOT_SHARE))
    return [(r[0], r[1]) for r in df.groupBy(key).count().where(F.col("count") >= least).collect()]


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", chunk: int = 500, hot: list[tuple] | None = None) -> DataFrame:
    """left ⋈ right where `right` has few rows a key and a key of `left` may hold most rows.

    Hot keys of `left` are dealt over ceil(rows / chunk) salts, and only their `right` rows are
    copied to each salt. `left` should be a written table, as it is read twice unless `hot` has its hot keys.
    """
    if hot is None:
        hot = hot_keys(left.where(F.col(key).isNotNull()), key)
    if not hot:
        return left.join(right, key, how)
    spark = left.sparkSession
    kind = left.schema[key].dataType.simpleString()
    salts = F.broadcast(spark.createDataFrame([(k, -(-n // chunk)) for k, n in hot], f"`{key}` {kind}, _salts int"))
    dealt = left.join(salts, key, "left").withColumn(
        "_salt", F.when(F.col("_salts").isNull(), 0).otherwise((F.rand(7) * F.col("_salts")).cast("int"))
    ).drop("_salts")
    copied = right.join(salts, key, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))
    ).drop("_salts")
    return dealt.join(copied, [key, "_salt"], how).drop("_salt")


def only_keys(df: DataFrame, keys: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Rows of `df` whose key is in `keys` (distinct, written), or with left_anti is not; broadcast below BROADCAST_KEYS, else shuffled."""
    small = keys.count() <= BROADCAST_KEYS
    return df.join(F.broadcast(keys) if small else keys.hint("merge"), key, how)
