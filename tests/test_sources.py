import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagemill.operators import validation
from passagemill.sources import readers, sinks
from passagemill.streaming import postings


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"k": "1:1", "n": 1}, {"k": "1:2", "n": None}]))
    assert readers.json_array(spark, str(tmp_path / "a.json"), "k string, n int").count() == 2
    (tmp_path / "a.ndjson").write_text('{"k": 1}\n\n{"k": 2}\n')
    assert readers.ndjson(spark, str(tmp_path / "a.ndjson"), "k int").where("k is not null").count() == 2
    (tmp_path / "bad.jsonl").write_text('{\n{"id": "a", "q": "x"}\n,{"id": "b", "q": "y"}\n}\n')
    assert readers.dirty_jsonl(spark, str(tmp_path / "bad.jsonl"), "id string, q string").count() == 2
    (tmp_path / "some one-en-simple.json").write_text(json.dumps({"1:1": {"t": "hi"}, "1:2": {"t": "ho"}}))
    got = readers.translation_files(spark, str(tmp_path / "*-en-simple.json"), "-en-simple.json", "en").orderBy("key").collect()
    assert [tuple(r) for r in got] == [("en", "some one", "1:1", "hi"), ("en", "some one", "1:2", "ho")]


@pytest.mark.parametrize("doc", [{"surahs": [{"number": 1, "total_verses": 7}]}, {"surah_ayah_counts": {"1": 7}}, {"surah_ayah_counts": [7]}, {"1": 7}])
def test_count_layouts(spark, tmp_path, doc):
    (tmp_path / "m.json").write_text(json.dumps(doc))
    assert [tuple(r) for r in readers.section_counts(spark, str(tmp_path / "m.json")).collect()] == [(1, 7)]


def test_arrays_keys_matrices(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"a": 1, "list": [{"v": 1}, {"v": 2}]}))
    assert readers.first_array(spark, str(tmp_path / "x.json")).count() == 2
    (tmp_path / "k.json").write_text('["1:1", "1:1"]')
    with pytest.raises(ValueError):
        readers.key_list(spark, str(tmp_path / "k.json"))
    m, buf = np.arange(6, dtype=np.float16).reshape(3, 2), io.BytesIO()
    np.save(buf, m)
    (tmp_path / "m.npy").write_bytes(buf.getvalue())
    (tmp_path / "m.f16").write_bytes(m.tobytes())
    for got in (readers.matrix(spark, str(tmp_path / "m.npy")), readers.half_matrix(spark, str(tmp_path / "m.f16"), 2)):
        assert [r["vector"] for r in got.orderBy("row").collect()] == m.tolist()
    files = readers.files(spark, str(tmp_path / "m.f16")).first()
    assert files["name"] == "m.f16" and files["bytes"] == 12


def test_localized_and_roots(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"topics": {"a": {"ar": ["x"], "ur": ["y", "z"]}}}))
    assert readers.localized_triggers(spark, str(tmp_path / "t.json")).count() == 3
    (tmp_path / "b.json").write_text("[]")
    codes = lambda name: {r["code"] for r in validation.root_keys(spark, str(tmp_path / name)).collect()}
    assert codes("b.json") == {"E_JSON_ROOT"} and codes("none.json") == {"E_FILE_NOT_FOUND"}
    (tmp_path / "c.json").write_text('{"surahs": 1}')
    assert codes("c.json") == {"E_SURAHS_TYPE", "E_MISSING_JUZ"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", None), (1, "é", 3)], "k int, t string, n int")
    assert sinks.json_array(df, str(tmp_path / "o.json"), ["k"]) == 2
    assert json.loads((tmp_path / "o.json").read_text()) == [{"k": 1, "t": "é", "n": 3}, {"k": 2, "t": "b", "n": None}]
    sinks.ndjson(df, str(tmp_path / "nd"), 1)
    assert spark.read.json(str(tmp_path / "nd")).count() == 2
    m = df.select(F.col("t").alias("name"), F.lit("aa").alias("sha256"))
    assert sinks.checksum_lines(m) == "aa  b\naa  é\n"
    assert sinks.archive({"x": b"1"}) == sinks.archive({"x": b"1"})


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"id": 1, "t": "Light upon light صبر"}\n')
    s = postings.passage_stream(spark, str(tmp_path / "in"), "id int, t string")
    postings.append_postings(s, "id", "t", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
