"""Readers and writers of predictions, timings, annotations, reports, configuration, images and tensors."""

from __future__ import annotations

import json
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import geometry as G

#: Patterns of the image files that are read.
IMAGES = "*.{png,jpg,jpeg,bmp,tif,tiff,PNG,JPG,JPEG,BMP,TIF,TIFF}"


def stem(path):
    """File name without folders and its last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")


def images(spark: SparkSession, folder: str, pattern: str = IMAGES) -> DataFrame:
    """name, bytes and SHA-256 of each image file, by their paths' bytes; a folder without any is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    if files.select("path").isEmpty():
        raise FileNotFoundError(f"no images in {folder}")
    return files.orderBy("path").select(stem(F.col("path")).alias("name"), "length", F.sha2("content", 256).alias("sha256"), "content")


def stored_images(found: DataFrame) -> DataFrame:
    """filename and bytes of a table whose column ``image`` is the bytes or a struct that holds them."""
    kind = found.schema["image"].dataType.typeName()
    return found.select("filename", (F.col("image.bytes") if kind == "struct" else F.col("image")).alias("content"))


def pixels(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded images: origin, width, height, nChannels, data (BGR)."""
    return spark.read.format("image").option("dropInvalid", True).load(folder).select("image.*")


def texts(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """path and value of each file of a folder, whole."""
    return spark.read.text(folder, wholetext=True, pathGlobFilter=pattern).select(F.col("_metadata.file_path").alias("path"), "value")


def detections(spark: SparkSession, folder: str) -> DataFrame:
    """``detections_of`` a folder of JSON arrays, one file an image."""
    return detections_of(texts(spark, folder))


def detections_of(found: DataFrame) -> DataFrame:
    """One row per detection of JSON arrays (path, value); ord is its place in the array, image the file's stem."""
    schema = "array<struct<id:int,bbox:array<double>,label:string,score:double>>"
    one = found.select(stem(F.col("path")).alias("image"), F.posexplode(F.from_json("value", schema)).alias("ord", "x"))
    box = [F.get("x.bbox", F.lit(i)).alias(k) for i, k in enumerate("ltrb")]
    return one.select("image", F.col("ord").cast("long").alias("ord"), "x.id", "x.label", "x.score", *box)


def above(found: DataFrame, least: float = 0.25) -> DataFrame:
    """Detections above a score."""
    return found.where(F.col("score") > least)


def timings(spark: SparkSession, path: str) -> DataFrame:
    """``timings_of`` the lines of CSV files."""
    return timings_of(spark.read.text(path))


def timings_of(lines: DataFrame) -> DataFrame:
    """filename, ms of CSV lines (value); headers and short or wrong rows are passed over."""
    row = lines.select(F.from_csv("value", "filename string, ms string").alias("x")).select("x.*")
    return row.select("filename", F.col("ms").try_cast("double").alias("ms")).where("ms is not null")


REGIONS = "filename string, regions array<struct<x:double,y:double,width:double,height:double,label:int>>"


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """filename, label and box of every region of an annotation file."""
    return _regions(spark.read.schema(REGIONS).json(path, multiLine=True))


def annotations_of(found: DataFrame) -> DataFrame:
    """The same of JSON texts (value) of a document each."""
    return _regions(found.select(F.from_json("value", REGIONS).alias("x")).select("x.*"))


def _regions(docs: DataFrame) -> DataFrame:
    r = docs.select("filename", F.posexplode("regions").alias("ord", "x"))
    corners = G.from_xywh(*(F.col(f"x.{k}") for k in ("x", "y", "width", "height")))
    return r.select("filename", "ord", "x.label", *(v.alias(k) for k, v in zip("ltrb", corners)))


def config(spark: SparkSession, path: str) -> DataFrame:
    """A JSON configuration as a variant column."""
    return spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("config"))


def parameter(column, path: str, kind: str, default=None, required: bool = False):
    """A value of a variant by its path; an error where it is required and absent."""
    value = F.try_variant_get(column, path, kind)
    return F.coalesce(value, F.raise_error(F.lit(f"no value at {path}")).cast(kind) if required else F.lit(default).cast(kind))


def word_map(found: DataFrame) -> DataFrame:
    """(name, tag, tag_id) of JSON objects of ids (name, value); one id for two tags of an object is an error."""
    one = found.select("name", F.from_json("value", "map<string,int>").alias("ids"))
    twice = F.size(F.array_distinct(F.map_values("ids"))) < F.size("ids")
    told = F.concat(F.lit("one id for two tags in "), F.coalesce("name", F.lit("a word map")))
    good = one.withColumn("ids", F.when(twice, F.raise_error(told).cast("map<string,int>")).otherwise(F.col("ids")))
    return good.select("name", F.explode("ids").alias("tag", "tag_id"))


def checked_length(length, most):
    """A sequence length above 0 and at most two beyond the longest tag sequence; any other is an error."""
    wrong = F.concat(F.lit("a sequence length of "), length.cast("string"), F.lit(" is out of bounds"))
    return F.when((length > 0) & (length <= most + 2), length).otherwise(F.raise_error(wrong).cast("long"))


def prepared_name(template, postfix):
    """A prepared file's name: the template with its place for the postfix filled."""
    return F.replace(template, F.lit("<POSTFIX>"), postfix)


def statm(line):
    """Sizes in kB of a line of seven page counts of a process; -1 each where the line is no such."""
    parts = F.split(line, " ")
    names = ("size_kb", "resident_kb", "shared_kb", "text_kb", "lib_kb", "data_kb", "dirty_kb")
    good = F.size(parts) == 7
    return F.struct(*(F.when(good, F.shiftleft(F.get(parts, F.lit(i)).try_cast("long"), 2)).otherwise(-1).alias(n) for i, n in enumerate(names)))


def status_field(text, name: str):
    """The number of a field of a process's status text; null if it is absent."""
    return F.regexp_extract(text, rf"(?m)^{name}:\s*(\d+)", 1).try_cast("long")


def canonical_json(column):
    """JSON with sorted keys, no white space, numbers as they were written, and non-ASCII characters escaped."""
    import re

    mark = "\ue000"  # stands round numbers; escaped in the output

    @F.pandas_udf("string")
    def run(s):
        keep = lambda x: mark + x + mark

        def one(x):
            if x is None:
                return None
            value = json.loads(x, parse_int=keep, parse_float=keep, parse_constant=keep)
            return re.sub(r'"\\ue000([^"\\]*)\\ue000"', r"\1", json.dumps(value, sort_keys=True, separators=(",", ":")))

        return s.map(one)

    return run(column)


def float_array(column):
    """A zlib-compressed base64 text of little-endian 32-bit floats as an array."""
    import base64
    import zlib

    @F.pandas_udf("array<float>")
    def run(s):
        import numpy as np

        return s.map(lambda x: None if x is None else np.frombuffer(zlib.decompress(base64.b64decode(x)), "<f4"))

    return run(column)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Path, length and SHA-256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def write_json(found: DataFrame, path: str) -> None:
    found.write.mode("overwrite").json(path)


def write_timings(found: DataFrame, path: str) -> None:
    found.select("filename", "ms").write.mode("overwrite").csv(path, header=True)


def markdown(found: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """A Markdown table of a small report as one text; numbers with two decimals."""
    cell = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.format_string("%.2f", c)) if dict(found.dtypes)[c] == "double" else F.col(c).cast("string"), F.lit(""))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(c) for c in columns)), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n|" + " --- |" * len(columns) + "\n"
    lines = found.agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))).alias("x"))
    return lines.select(F.concat(F.lit(head), F.array_join(F.transform("x", lambda r: r["line"]), "\n")).alias("text"))


#: Element types of tensor files with their codes, sizes and common names.
DTYPES = {"F32": ("f", 4, "float32"), "F64": ("d", 8, "float64"), "I64": ("q", 8, "int64"), "I32": ("i", 4, "int32")}


def dtype_name(code):
    """The common name of an element type; an unknown one is an error."""
    known = F.create_map(*(F.lit(x) for k, v in DTYPES.items() for x in (k, v[2])))
    return F.coalesce(F.try_element_at(known, F.upper(code)), F.raise_error(F.concat(F.lit("unknown element type "), code)))


class TensorFiles(DataSource):
    """``spark.read.format("tensors").load(path)``: name, dtype, shape, values (doubles) and SHA-256 of each tensor.

    A file holds a 64-bit little-endian header length, a JSON header of offsets, and the data. The path must be one that
    every executor can open as a file, such as a shared mount; each tensor is one partition.
    """

    @classmethod
    def name(cls) -> str:
        return "tensors"

    def schema(self) -> str:
        return "name string, dtype string, shape array<long>, values array<double>, sha256 string"

    def reader(self, schema):
        return TensorReader(self.options["path"])


class TensorReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def _header(self):
        with open(self.path, "rb") as f:
            size = struct.unpack("<q", f.read(8))[0]

            def unique(pairs):
                if len({k for k, _ in pairs}) < len(pairs):
                    raise ValueError("a tensor name occurs twice")
                return dict(pairs)

            return 8 + size, json.loads(f.read(size), object_pairs_hook=unique)

    def partitions(self):
        _, head = self._header()
        return [InputPartition(k) for k in sorted(head) if k != "__metadata__"]

    def read(self, partition):
        import hashlib

        start, head = self._header()
        told = head[partition.value]
        if told["dtype"] not in DTYPES:
            raise ValueError(f"unknown element type {told['dtype']}")
        code, width, _ = DTYPES[told["dtype"]]
        a, b = told["data_offsets"]
        with open(self.path, "rb") as f:
            f.seek(start + a)
            raw = f.read(b - a)
        yield partition.value, told["dtype"], told["shape"], [float(x) for x in struct.unpack(f"<{(b - a) // width}{code}", raw)], hashlib.sha256(raw).hexdigest()
