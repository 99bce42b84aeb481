"""Readers, writers, pixels and the predictor plug."""

import base64
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import images
from gridloom.operators import predict
from gridloom.sources import files
from gridloom.streaming import latency


def test_text_sources(spark, tmp_path):
    d = tmp_path / "found"
    d.mkdir()
    (d / "a.json").write_text(json.dumps([{"id": 0, "bbox": [0, 1, 2, 3], "label": "x", "score": 0.9}, {"id": 1, "bbox": [0, 0, 1, 1], "label": "y", "score": 0.1}]))
    got = files.above(files.detections(spark, str(d))).collect()
    assert [(r["image"], r["label"], r["b"]) for r in got] == [("a", "x", 3.0)]
    (tmp_path / "t.csv").write_text("filename,ms\na,1.5\nb\nc,ms\n")
    assert [tuple(r) for r in files.timings(spark, str(tmp_path / "t.csv")).collect()] == [("a", 1.5)]
    (tmp_path / "n.json").write_text(json.dumps([{"filename": "p", "regions": [{"x": -1, "y": 2, "width": 3, "height": 4, "label": 1}]}]))
    assert files.annotations(spark, str(tmp_path / "n.json")).first()["b"] == 6.0
    (tmp_path / "c.json").write_text('{"model": {"seq_len": 512}}')
    c = files.config(spark, str(tmp_path / "c.json"))
    assert c.select(files.parameter(F.col("config"), "$.model.seq_len", "int", required=True).alias("v")).first()["v"] == 512
    assert c.select(files.parameter(F.col("config"), "$.none", "int", 7).alias("v")).first()["v"] == 7
    with pytest.raises(Exception, match="no value"):
        c.select(files.parameter(F.col("config"), "$.none", "int", required=True)).collect()


def test_codings(spark):
    raw = np.array([1.5, -2.0], "<f4")
    df = spark.createDataFrame([('{"b": 1, "a": "é"}', base64.b64encode(zlib.compress(raw.tobytes())).decode())], "j string, z string")
    r = df.select(files.canonical_json(F.col("j")).alias("j"), files.float_array(F.col("z")).alias("z")).first()
    assert r["j"] == '{"a":"\\u00e9","b":1}' and r["z"] == [1.5, -2.0]
    text = files.markdown(spark.createDataFrame([("b", 1.0), ("a", None)], "k string, v double"), ["k", "v"], ["k"]).first()["text"]
    assert text == "| k | v |\n| --- | --- |\n| a |  |\n| b | 1.00 |"


def test_tensor_files(spark, tmp_path):
    data = struct.pack("<2f", 1.0, 2.0) + struct.pack("<q", 7)
    head = json.dumps({"w": {"dtype": "F32", "shape": [2], "data_offsets": [0, 8]}, "n": {"dtype": "I64", "shape": [1], "data_offsets": [8, 16]}}).encode()
    (tmp_path / "m.bin").write_bytes(struct.pack("<q", len(head)) + head + data)
    spark.dataSource.register(files.TensorFiles)
    got = {r["name"]: r["values"] for r in spark.read.format("tensors").load(str(tmp_path / "m.bin")).collect()}
    assert got == {"w": [1.0, 2.0], "n": [7.0]}


def test_pixels(spark):
    x = np.arange(48, dtype=np.uint8).reshape(4, 4, 3)
    assert np.allclose(images.resize(x, 4, 4), x) and images.resize(x, 8, 2).shape == (2, 8, 3)
    assert images.tensor(x, [0.5] * 3, [0.5] * 3, 8).shape == (3, 8, 8) and images.letterbox(x[:2], 8).shape == (8, 8, 3)
    df = spark.createDataFrame([(1, 4, 4, bytearray(x.tobytes()), 1, 1, 3, 4)], "page_id long, width int, height int, data binary, l int, t int, r int, b int")
    r = images.crop_statistics(df).first()
    assert (r["crop_width"], r["crop_height"], r["n_bytes"]) == (2, 3, 18) and abs(r["mean"] - x[1:4, 1:3].mean()) < 1e-9
    s = spark.createDataFrame([([1.0, 3.0],), ([],)], "v array<double>").select(*images.array_statistics(F.col("v"))).collect()
    assert tuple(s[0]) == (1.0, 3.0, 2.0, 1.0) and tuple(s[1]) == (None,) * 4


def test_predictor(spark):
    pages = spark.createDataFrame([(1, 100, 50), (2, 10, 10)], "page_id long, width int, height int")
    regions = spark.createDataFrame([(1, 0, 1.0, 2.0, 3.0, 4.0)], "page_id long, table_index int, l double, t double, r double, b double")
    full = {r["page_id"]: r["r"] for r in predict.default_regions(pages, regions).collect()}
    assert full == {1: 3.0, 2: 10.0}
    out = predict.StubPredictor().predict(predict.default_regions(pages, regions))
    assert out.count() == 2 and predict.TablePredictor(out).predict(regions).count() == 1


def test_stream(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 00:00:10' ts, 'a' stage, 2.0D ms union all select timestamp'2024-01-01 00:00:20', 'a', 4.0D").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, stage string, ms double").parquet(str(tmp_path / "in"))
    q = latency.windowed(stream).writeStream.format("memory").queryName("told").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r["n"], r["mean_ms"]) for r in spark.table("told").collect()] == [(2, 3.0)]
