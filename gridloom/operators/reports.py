"""Reports: benchmark runs of either layout, recorded results and their comparison, Markdown.

Documents come as rows (name, value) of a JSON text each, as ``spark.read.text(..., wholetext=True)`` gives them, so that
every step runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import canonical_json, stem

CURRENT = """struct<Metadata:struct<Label:string,Iteration:int>,Documents:map<string,struct<TimingMs:double,StageTimingsMs:map<string,double>>>,
  Summary:struct<NumDocuments:int,TotalMs:double,AverageMs:double>,StageSummaryMs:map<string,double>>"""
LEGACY = """struct<predictions:map<string,struct<num_tables:int>>,timings_ms:map<string,double>,summary:struct<total_ms:double,average_ms:double>>"""


def _parsed(texts: DataFrame) -> DataFrame:
    now, old = F.from_json("value", CURRENT), F.from_json("value", LEGACY)
    both = texts.select("name", now.alias("now"), old.alias("old"))
    layout = F.when(F.col("now.Documents").isNotNull(), "current").when(F.col("old.predictions").isNotNull(), "legacy")
    told = F.concat(F.lit("no benchmark report in "), F.col("name"))
    return both.withColumn("layout", F.coalesce(layout, F.raise_error(told)))


def report_documents(texts: DataFrame) -> DataFrame:
    """name, document, timing_ms of every document of reports in the current or the legacy layout; any other text is an error.

    A legacy report holds no time for a document that is not among its timings: 0.
    """
    p = _parsed(texts)
    now = p.where("layout = 'current'").select("name", F.explode("now.Documents").alias("document", "d")).select("name", "document", F.coalesce("d.TimingMs", F.lit(0.0)).alias("timing_ms"))
    old = p.where("layout = 'legacy'").select("name", F.explode(F.map_keys("old.predictions")).alias("document"), "old.timings_ms")
    old = old.select("name", "document", F.coalesce(F.try_element_at("timings_ms", F.col("document")), F.lit(0.0)).alias("timing_ms"))
    return now.unionByName(old)


def report_summaries(texts: DataFrame) -> DataFrame:
    """name, label, n_documents, total_ms, average_ms of each report; legacy reports without a summary are summed up, and named after their file."""
    p = _parsed(texts)
    now = p.where("layout = 'current'").select(
        "name", F.col("now.Metadata.Label").alias("label"), F.col("now.Summary.NumDocuments").cast("long").alias("n_documents"),
        F.col("now.Summary.TotalMs").alias("total_ms"), F.col("now.Summary.AverageMs").alias("average_ms"),
    )
    n = F.size("old.predictions")
    known = F.transform(F.map_keys("old.predictions"), lambda k: F.coalesce(F.try_element_at("old.timings_ms", k), F.lit(0.0)))
    total = F.aggregate(known, F.lit(0.0), lambda a, x: a + x)
    old = p.where("layout = 'legacy'").select(
        "name", stem(F.col("name")).alias("label"), n.cast("long").alias("n_documents"), F.coalesce("old.summary.total_ms", total).alias("total_ms"),
        F.coalesce("old.summary.average_ms", F.when(n > 0, total / n).otherwise(0.0)).alias("average_ms"),
    )
    return now.unionByName(old)


def detection_pairs(texts: DataFrame, key: str) -> DataFrame:
    """name, ms and, per detection, label, confidence, area; ``key`` names the box, which has a width and a height."""
    schema = f"struct<detections:array<struct<label:string,confidence:double,{key}:struct<width:double,height:double>>>,metadata:struct<processingTimeMs:double>>"
    one = texts.select("name", F.from_json("value", schema).alias("x")).select("name", F.col("x.metadata.processingTimeMs").alias("ms"), F.posexplode_outer("x.detections").alias("ord", "d"))
    side = lambda k: F.coalesce(f"d.{key}.{k}", F.lit(0.0))
    return one.select("name", "ms", F.col("ord").cast("long").alias("ord"), "d.label", F.coalesce("d.confidence", F.lit(0.0)).alias("confidence"), (side("width") * side("height")).alias("area"))


def golden_tables(texts: DataFrame) -> DataFrame:
    """name, image, num_tables, table_index, canonical of recorded results: tables given as texts stand as they are, others are made canonical."""
    pages = texts.select("name", F.explode(F.from_json("value", "map<string,struct<num_tables:int,tables:array<variant>>>")).alias("image", "p"))
    each = pages.select("name", "image", F.col("p.num_tables").cast("long").alias("num_tables"), F.posexplode_outer("p.tables").alias("table_index", "t"))
    text = F.when(F.schema_of_variant("t") == "STRING", F.variant_get("t", "$", "string")).otherwise(canonical_json(F.to_json("t")))
    return each.select("name", "image", "num_tables", F.col("table_index").cast("long").alias("table_index"), F.when(F.col("t").isNotNull(), text).alias("canonical"))


def golden_failures(golden: DataFrame, actual: DataFrame) -> DataFrame:
    """(image, table_index, failure) of recorded against actual tables (image, num_tables, table_index, canonical), both ways.

    The joins are by sorted rows: sizes of parsed texts are guessed far too low, and a recorded corpus is not to be broadcast.
    """
    pages = lambda d, n: d.groupBy("image").agg(F.max("num_tables").alias(n))
    p = pages(golden, "expected").join(pages(actual, "found"), "image", "full_outer")
    page = F.when(F.col("expected").isNull(), "unexpected page").when(F.col("found").isNull(), "page not produced").when(F.col("expected") != F.col("found"), "table count")
    of_pages = p.select("image", F.lit(None).cast("long").alias("table_index"), page.alias("failure"))
    known = pages(golden, "n").select("image").hint("merge")
    tables = actual.where("table_index is not null").select("image", "table_index", F.col("canonical").alias("mine")).join(known, "image", "left_semi")
    theirs = golden.where("table_index is not null").select("image", "table_index", F.col("canonical").alias("theirs"))
    tables = tables.join(theirs.hint("merge"), ["image", "table_index"], "left")
    table = F.when(F.col("theirs").isNull(), "missing reference").when(F.col("mine") != F.col("theirs"), "mismatch")
    return of_pages.unionByName(tables.select("image", "table_index", table.alias("failure"))).where("failure is not null")


def joined_samples(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """``left`` with the columns of ``right`` of the same key; a key without one is an error."""
    names = F.concat_ws(", ", *(F.col(k).cast("string") for k in key))
    j = left.join(right.withColumn("there", F.lit(True)), key, "left")
    return j.where(F.coalesce("there", F.raise_error(F.concat(F.lit("no sample for "), names)).cast("boolean"))).drop("there")


def digest_failures(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(file, name, failure) of digests (file, name, dtype, shape, sha256) that are missing, left over or differ in dtype, shape or hash."""
    value = ["dtype", "shape", "sha256"]
    side = lambda d, p: d.select("file", "name", *(F.col(c).alias(p + c) for c in value), F.lit(True).alias(p + "is"))
    j = side(expected, "e_").join(side(found, "f_"), ["file", "name"], "full_outer")
    kind = F.when(F.col("f_is").isNull(), "missing").when(F.col("e_is").isNull(), "extra")
    for c in value:
        kind = kind.when(~F.col(f"e_{c}").eqNullSafe(F.col(f"f_{c}")), "hash" if c == "sha256" else c)
    return j.select("file", "name", kind.alias("failure")).where("failure is not null")


def fixed(value: Column, places: int = 2) -> Column:
    return F.format_string(f"%.{places}f", value)


def signed(value: Column) -> Column:
    """Two decimals with a sign; next to nothing is 0.00."""
    return F.when(F.abs(value) < 1e-6, "0.00").otherwise(F.concat(F.when(value >= 0, "+").otherwise(""), fixed(value)))


def mebibytes(n: Column) -> Column:
    return n / 1048576


def precision(name: Column) -> Column:
    """Precision that a model file's name tells: fp16, int8, else fp32."""
    low = F.lower(name)
    return F.when(low.contains("fp16"), "fp16").when(low.contains("int8"), "int8").otherwise("fp32")


def markdown_lines(rows: DataFrame, cells: list[Column], order: list[str]) -> DataFrame:
    """(order..., line): a Markdown table line of every row."""
    return rows.select(*order, F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def stage_breakdown(base: DataFrame, now: DataFrame) -> DataFrame:
    """Markdown lines of stages (stage, ms) in both: values, difference, percent and shares."""
    part = lambda d, n: d.groupBy("stage").agg(F.sum("ms").alias(n))
    j = part(base, "base").join(part(now, "now"), "stage", "full_outer").select("stage", F.coalesce("base", F.lit(0.0)).alias("base"), F.coalesce("now", F.lit(0.0)).alias("now"))
    whole = j.agg(F.sum("base").alias("all_base"), F.sum("now").alias("all_now"))
    # one row
    j = j.join(F.broadcast(whole))
    share = lambda c: F.col(c) / F.greatest(F.lit(1e-9), F.col(f"all_{c}")) * 100
    b, n = F.col("base"), F.col("now")
    percent = F.when(F.abs(b) < 1e-9, 0.0).otherwise((n - b) / b * 100)
    return markdown_lines(j, [F.col("stage"), fixed(b), fixed(n), signed(n - b), signed(percent), fixed(share("base")), fixed(share("now"))], ["stage"])


def variant_report(metrics: DataFrame) -> DataFrame:
    """Markdown text of each variant (variant, mean_iou, iou_50, iou_75, agreement, d_boxes, d_score, mean_ms, p95_ms, size_mb); absent values have no line."""
    line = lambda name, c, places: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"|{name}|"), fixed(F.col(c), places), F.lit("|")))
    rows = [line(n, c, 3) for n, c in (("mean IoU", "mean_iou"), ("IoU@0.5", "iou_50"), ("IoU@0.75", "iou_75"), ("label agreement", "agreement"), ("Δ boxes", "d_boxes"), ("Δ score", "d_score"))]
    rows += [line("mean time (ms)", "mean_ms", 2), line("p95 time (ms)", "p95_ms", 2), line("model size (MB)", "size_mb", 1)]
    head = F.concat(F.lit("# "), F.col("variant"), F.lit("\n\n|metric|value|\n|---|---:|\n"))
    return metrics.select("variant", F.concat(head, F.concat_ws("\n", *rows)).alias("text"))
