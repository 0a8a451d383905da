"""Sinks: NDJSON, JSON arrays, half-precision matrices, YAML, checksums and archives."""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.operators.response import to_json


def ndjson(df: DataFrame, path: str, files: int | None = None) -> None:
    """One compact object a line; `files` bounds the parts where a single file is asked for."""
    lines = df.select(to_json(F.struct("*")).alias("value"))
    (lines.coalesce(files) if files else lines).write.mode("overwrite").text(path)


def _create(spark, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)


def file(spark, path: str, content: bytes) -> None:
    """A small file, by way of Spark's file system."""
    out = _create(spark, path)
    try:
        for i in range(0, len(content), 1 << 20):
            out.write(bytearray(content[i : i + (1 << 20)]))
    finally:
        out.close()


def keyed_object(df: DataFrame, path: str, key: str, order: list[str]) -> int:
    """One JSON object of key -> row, streamed by the driver a row at a time in order."""
    out, n = _create(df.sparkSession, path), 0
    try:
        out.write(bytearray(b"{"))
        for k, row in df.orderBy(*order).select(key, to_json(F.struct(*df.columns))).toLocalIterator():
            out.write(bytearray(("," * bool(n) + json.dumps(k, ensure_ascii=False) + ":" + row).encode()))
            n += 1
        out.write(bytearray(b"}"))
    finally:
        out.close()
    return n


def matrix_files(rows: DataFrame, folder: str, dim: int, key: str, dtype: str = "<f2") -> dict:
    """matrix.npy, keys.json and meta.json of rows (row, key, bytes), streamed in row order; the written matrix is read again and its hash compared."""
    import hashlib

    import numpy as np

    from passagemill.sources import readers

    spark, sha, keys = rows.sparkSession, hashlib.sha256(), []
    n = rows.count()
    header = io.BytesIO()
    np.lib.format.write_array_header_1_0(header, {"descr": dtype, "fortran_order": False, "shape": (n, dim)})
    out = _create(spark, f"{folder}/matrix.npy")
    try:
        out.write(bytearray(header.getvalue()))
        for r in rows.orderBy("row").select(key, "bytes").toLocalIterator():
            sha.update(r["bytes"])
            keys.append(r[key])
            out.write(bytearray(r["bytes"]))
    finally:
        out.close()
    file(spark, f"{folder}/keys.json", json.dumps([str(k) for k in keys]).encode())
    again = hashlib.sha256()
    for r in readers.matrix(spark, f"{folder}/matrix.npy").orderBy("row").toLocalIterator():
        again.update(np.array(r["vector"], dtype).tobytes())
    if again.digest() != sha.digest():
        raise ValueError("the written matrix differs from its rows")
    meta = {"count": n, "dim": dim, "dtype": np.dtype(dtype).name, "sha256": sha.hexdigest()}
    file(spark, f"{folder}/meta.json", json.dumps(meta).encode())
    return meta


def evaluation_reports(per_query: DataFrame, summary: DataFrame, folder: str) -> None:
    """An evaluation's rows by query and its aggregates, as NDJSON under two folders."""
    ndjson(per_query, f"{folder}/queries")
    ndjson(summary, f"{folder}/summary", 1)


def json_array(df: DataFrame, path: str, order: list[str], pretty: bool = False) -> int:
    """One JSON array, streamed by the driver a row at a time in order: an export format for small corpora."""
    out, n = _create(df.sparkSession, path), 0
    try:
        out.write(bytearray(b"["))
        for (row,) in df.orderBy(*order).select(to_json(F.struct(*df.columns)).alias("j")).toLocalIterator():
            text = json.dumps(json.loads(row), ensure_ascii=False, indent=2) if pretty else row
            out.write(bytearray(((",\n" if pretty else ",") * bool(n) + text).encode()))
            n += 1
        out.write(bytearray(b"]"))
    finally:
        out.close()
    return n


def matrix_bytes(rows: DataFrame):
    """The bytes of a matrix, row by row in order, as an iterator: nothing is held whole."""
    for r in rows.orderBy("row").select("bytes").toLocalIterator():
        yield bytes(r[0])


def yaml_text(rows: list[dict], root: str, unicode: bool = True) -> str:
    import yaml

    return yaml.safe_dump({root: rows}, allow_unicode=unicode, sort_keys=False)


def checksum_lines(manifest: DataFrame) -> str:
    """Sorted "sha256  name" lines of a manifest, which has a row a file."""
    return "".join(f"{r['sha256']}  {r['name']}\n" for r in manifest.orderBy("name").collect())


def archive(files: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(files):
            z.writestr(zipfile.ZipInfo(name), files[name])
    return out.getvalue()


def statistics(passages: DataFrame, section: str, maps: dict[str, str]) -> DataFrame:
    """Row count, sections, and how many translators each map column has over all rows."""
    names = [F.size(F.collect_set(F.array_join(F.array_sort(F.map_keys(c)), ","))).alias(f"{label}_layouts") for label, c in maps.items()]
    return passages.agg(F.count(F.lit(1)).alias("total_verses"), F.countDistinct(section).alias("total_surahs"), *names)
