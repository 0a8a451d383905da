"""Exports: size-bounded chunks, manifests, packed rows and integrity checks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from passagemill.functions.values import filled, seeded_choice
from passagemill.functions.vectors import half_bytes

MIB = 1 << 20
LIMIT = 30 * MIB - 128 * 1024


def chunk_ids(rows: DataFrame, file: str, order: str, size: str, limit: int = LIMIT, overhead: int = 2, comma: int = 1) -> DataFrame:
    """(file, order, chunk): greedy packing of a file's items in order.

    A chunk ends when the next item would pass the limit and it is not empty; a single larger item still gets a
    chunk of its own. The reset depends on what was packed, so a file is one ordered pass over its (order, size)
    pairs, streamed from a sorted partition in constant memory; other files run beside it. Texts stay out of it.
    """
    kinds = ", ".join(f"{n} {rows.schema[c].dataType.simpleString()}" for n, c in (("file", file), ("at", order)))

    def run(batches):
        last, chunk, used = object(), 0, 0
        for batch in batches:
            out = []
            for f, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                n = n or 0
                if f != last:
                    last, chunk, used = f, 0, 0
                more = n + comma if used > 0 else n
                if used > 0 and used + more + overhead > limit:
                    chunk, used = chunk + 1, n
                else:
                    used += more
                out.append(chunk)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int32())], ["file", "at", "chunk"])

    pairs = rows.select(F.col(file).alias("file"), F.col(order).alias("at"), F.col(size).cast("bigint").alias("size"))
    dealt = pairs.repartition("file").sortWithinPartitions("file", "at", "size")
    return dealt.mapInArrow(run, f"{kinds}, chunk int").withColumnsRenamed({"file": file, "at": order})


def write_chunks(rows: DataFrame, chunks: DataFrame, file: str, order: str, json: str, path: str) -> DataFrame:
    """One JSON array a (file, chunk), as text files under `path`; returns (file, chunk, n, bytes)."""
    arrays = rows.join(chunks, [file, order]).groupBy(file, "chunk").agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), F.col(json).alias("j")))).alias("x"))
    texts = arrays.select(file, "chunk", F.concat(F.lit("["), F.concat_ws(",", F.transform("x", lambda e: e["j"])), F.lit("]")).alias("value"), F.size("x").alias("n"))
    texts.select(file, "chunk", "value").write.mode("overwrite").partitionBy(file, "chunk").text(path)
    return texts.select(file, "chunk", "n", F.octet_length("value").alias("bytes"))


def chunk_manifest(sizes: DataFrame, file: str) -> DataFrame:
    """(file, chunks, items, mb): names follow from the chunk numbers."""
    return sizes.groupBy(file).agg(F.count(F.lit(1)).alias("chunks"), F.sum("n").alias("items"), F.round(F.sum("bytes") / MIB, 3).alias("mb"))


def split_text(c: Column, most: int) -> Column:
    """Parts of at most `most` characters, as (part, text) structs."""
    n = F.greatest(F.ceil(F.length(c) / most), F.lit(1))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("part"), c.substr((i * most + 1).cast("int"), F.lit(most)).alias("text")))


def manifest(files: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """(name, bytes, sha256) of binary files, for any rows with bytes."""
    return files.select(F.col(name).alias("name"), F.length(content).cast("bigint").alias("bytes"), F.sha2(F.col(content).cast("binary"), 256).alias("sha256"))


def manifest_map(listed: DataFrame, matrix: str | None = None, dtype: str = "float16", rows: int = 0, dim: int = 0) -> DataFrame:
    """One row `files`: name -> (bytes, sha256, dtype, shape, row_major); the last three for the matrix file alone. A row a file is gathered."""
    is_matrix = F.col("name") == F.lit(matrix)
    entry = F.struct(
        "bytes", "sha256", F.when(is_matrix, F.lit(dtype)).alias("dtype"), F.when(is_matrix, F.array(F.lit(rows), F.lit(dim))).alias("shape"), F.when(is_matrix, F.lit(True)).alias("row_major"),
    )
    return listed.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", entry.alias("entry"))))).alias("files"))


def pack_manifest(listed: DataFrame, version: str, model: str, dim: int, rows: int, matrix_sha: str, policy: str, seed: int, most_chars: int = 1600) -> DataFrame:
    """One row: version, counts, and blocks on the matrix, the choice of translations and the search text, with the files sorted by name."""
    files = F.sort_array(F.collect_list(F.struct("name", "bytes", "sha256"))).alias("files")
    return listed.agg(files).select(
        F.lit(version).alias("pack_version"), F.lit(rows).alias("verse_count"),
        F.struct(F.lit(model).alias("model"), F.lit(dim).alias("dim"), F.lit(rows).alias("rows"), F.lit("float16").alias("dtype"), F.lit(matrix_sha).alias("sha256_array")).alias("embedding"),
        F.struct(F.lit(policy).alias("mode"), F.lit(seed).alias("seed")).alias("translation_policy"), F.struct(F.lit(most_chars).alias("max_chars")).alias("searchable_text"), "files",
    )


def verify_manifest(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(name, problem) of files that are missing, unlisted, listed twice, or differ in bytes or hash."""
    twice = expected.groupBy("name").count().where("count > 1").select("name", F.lit("duplicate").alias("problem"))
    e = expected.dropDuplicates(["name"]).select("name", F.col("bytes").alias("eb"), F.col("sha256").alias("es"))
    both = e.join(actual, "name", "full_outer")
    problem = F.when(F.col("bytes").isNull(), "missing").when(F.col("eb").isNull(), "unlisted").when(F.col("eb") != F.col("bytes"), "bytes").when(F.col("es") != F.col("sha256"), "sha256")
    return both.select("name", problem.alias("problem")).where("problem is not null").union(twice)


#: Rows that a task numbers at most, near enough, and most ranges.
RANGE, MOST_RANGES = 100_000, 1000


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """Row numbers from 0 in string order of the key, by ranges of keys, so no task holds all rows.

    The ranges' bounds are values in the plan and not the sample that Spark draws anew wherever a range partitioning is
    evaluated: with those, the rows before a range were counted over other ranges than the rows were numbered in.
    """
    keyed = rows.withColumn("_k", F.col(key).cast("string"))
    n = keyed.count()
    ranges = min(MOST_RANGES, n // RANGE + 1)
    place, before = F.lit(0), F.lit(0)
    if ranges > 1:
        # Bounds only deal the rows; every one is numbered.
        drawn = F.pmod(F.xxhash64("_k"), F.lit(max(1, n // (ranges * 100)))) == 0
        sample = sorted(r[0] for r in keyed.where(drawn & F.col("_k").isNotNull()).select("_k").collect())
        bounds = sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []
        place = F.size(F.filter(F.lit(bounds).cast("array<string>"), lambda b: b <= F.col("_k")))
        counts = dict(keyed.groupBy(place.alias("_p")).count().collect())
        before = F.get(F.lit([sum(counts.get(j, 0) for j in range(i)) for i in range(len(bounds) + 1)]).cast("array<bigint>"), F.col("_p"))
    local = F.row_number().over(W.partitionBy("_p").orderBy("_k"))
    return keyed.withColumn("_p", place).withColumn("row", (before + local - 1).cast("bigint")).drop("_p", "_k")


def choose_translation(texts: Column, key: Column, order: list[str] | None = None, builtin: Column | None = None, seed: int | None = None) -> Column:
    """struct(translator, text): the first preferred text, or one drawn by a seed among those with a text."""
    some = F.filter(F.array_sort(F.map_entries(texts)), lambda e: F.trim(e["value"]) != "")
    if seed is not None:
        pick = seeded_choice(some, key, seed)
        return F.struct(pick["key"].alias("translator"), F.coalesce(pick["value"], builtin if builtin is not None else F.lit(None)).alias("text"))
    first = F.coalesce(*(F.when(F.trim(F.try_element_at(texts, F.lit(k))) != "", F.lit(k)) for k in order or []), F.lit(None).cast("string"))
    return F.struct(first.alias("translator"), filled(F.try_element_at(texts, first), *([builtin] if builtin is not None else [])).alias("text"))


def half_matrix(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(row, key, bytes): half-precision rows in key order; their bytes end to end are the matrix file."""
    return numbered(vectors.select(key, vector), key).select("row", key, half_bytes(vector).alias("bytes"))


def check_matrix(rows: DataFrame, dim: int) -> DataFrame:
    """Rows whose half-precision bytes are not 2 * dim long."""
    return rows.where(F.length("bytes") != 2 * dim)


# --- packed rows and wrapped chunks ------------------------------------------------------------------


def pack_rows(passages: DataFrame, en: Column, ur: Column, transliteration: bool = True) -> DataFrame:
    """Rows of a mobile pack, under short names: key, parts, range, texts, chosen translations with their translators, search text.

    `en` and `ur` are structs (translator, text) as `choose_translation` gives them.
    """
    from passagemill.functions.text import pack_text

    search = pack_text(F.col("key"), F.col("name"), F.col("text"), en["text"], ur["text"], F.coalesce("transliteration", F.lit("")))
    short = [
        F.col("key").alias("k"), F.coalesce(F.col("major").cast("int"), F.lit(0)).alias("s"), F.coalesce(F.col("minor").cast("int"), F.lit(0)).alias("a"),
        F.coalesce(F.col("range").cast("int"), F.lit(0)).alias("j"), F.coalesce("text", F.lit("")).alias("ar"), F.coalesce(en["text"], F.lit("")).alias("en"),
        F.coalesce(ur["text"], F.lit("")).alias("ur"), search.alias("st"), en["translator"].alias("et"), ur["translator"].alias("ut"),
    ]
    return passages.select(*short, *([F.col("transliteration").alias("tr")] if transliteration else []))


def translation_seed(asked: int, matrix_sha: str | None) -> int:
    """The seed asked for; 0 means one from the matrix hash, else 1337."""
    import zlib

    return asked or (zlib.crc32(matrix_sha.encode()) if matrix_sha else 1337)


def wrapped_chunks(rows: DataFrame, file: str, order: str, size: str, wrapper: int, limit: int = LIMIT) -> DataFrame:
    """`chunk_ids` for chunks that repeat `wrapper` bytes of other keys; a wrapper over the limit raises."""
    if wrapper > limit:
        raise ValueError("the wrapper alone exceeds the limit")
    return chunk_ids(rows, file, order, size, limit, overhead=wrapper + 2)


def keyed_chunks(rows: DataFrame, file: str, order: str, key: str, json: str, limit: int = LIMIT) -> DataFrame:
    """(file, chunk, value): objects of key -> value pairs in order, packed by the bytes of their pairs."""
    sized = rows.withColumn("_pair", F.concat(F.to_json(F.array(key)).substr(F.lit(2), F.length(F.to_json(F.array(key))) - 2), F.lit(":"), F.col(json)))
    sized = sized.withColumn("_size", F.octet_length("_pair").cast("bigint"))
    got = sized.join(chunk_ids(sized, file, order, "_size", limit), [file, order])
    pairs = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), F.col("_pair").alias("p")))), lambda e: e["p"])
    return got.groupBy(file, "chunk").agg(F.concat(F.lit("{"), F.concat_ws(",", pairs), F.lit("}")).alias("value"))


def line_chunks(lines: DataFrame, file: str, order: str, line: str, limit: int = LIMIT) -> DataFrame:
    """(file, order, chunk) of NDJSON lines: no array brackets, one newline each, blank lines dropped."""
    kept = lines.where(F.trim(line) != "").withColumn("_size", (F.octet_length(line) + 1).cast("bigint"))
    return chunk_ids(kept, file, order, "_size", limit, overhead=0, comma=0)
