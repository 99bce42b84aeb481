"""Responses: cells with their tokens, spans, offsets and flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .match import T


def flags(label):
    """Header, row-header and section flags of a label."""
    return (label == "ched").alias("column_header"), (label == "rhed").alias("row_header"), (label == "srow").alias("row_section")


def dummy_responses(cells: DataFrame) -> DataFrame:
    """A response per cell for tables without tokens."""
    return cells.select(
        T, "cell_id", F.coalesce("rowspan_val", F.lit(1)).alias("row_span"), F.coalesce("colspan_val", F.lit(1)).alias("col_span"),
        F.col("row_id").alias("start_row"), (F.col("row_id") + F.coalesce("rowspan_val", F.lit(1))).alias("end_row"),
        F.col("column_id").alias("start_col"), (F.col("column_id") + F.coalesce("colspan_val", F.lit(1))).alias("end_col"),
        *flags(F.col("label")), *"ltrb",
    )


def with_fallback_boxes(cells: DataFrame, predicted: DataFrame) -> DataFrame:
    """Boxes from the cell, else from the prediction of the same id, else zeros."""
    p = predicted.select(T, "cell_id", *(F.col(k).alias(f"p{k}") for k in "ltrb"))
    return cells.join(p, [T, "cell_id"], "left").select(T, "cell_id", *(F.coalesce(k, f"p{k}", F.lit(0.0)).alias(k) for k in "ltrb"))


def token_responses(cells: DataFrame, matches: DataFrame) -> DataFrame:
    """One row per matched token: spans and places of its last cell, flags of any, and the sorted rows, columns and labels of all."""
    j = matches.select(T, "pdf_cell_id", "cell_id").join(dummy_responses(cells).join(cells.select(T, "cell_id", "row_id", "column_id", "label"), [T, "cell_id"]), [T, "cell_id"])
    last = ["row_span", "col_span", "start_row", "end_row", "start_col", "end_col"]
    labels = F.array_sort(F.collect_set("label"))
    return j.groupBy(T, "pdf_cell_id").agg(
        *(F.max_by(c, "cell_id").alias(c) for c in last),
        *(F.bool_or(F.coalesce(c, F.lit(False))).alias(c) for c in ("column_header", "row_header", "row_section")),
        F.array_sort(F.collect_set("row_id")).alias("row_ids"), F.array_sort(F.collect_set("column_id")).alias("column_ids"),
        F.coalesce(F.get(labels, F.lit(0)), F.lit("None")).alias("label"),
    )


def keyed(found: DataFrame) -> DataFrame:
    """Responses with their key, column and row joined by ``_``."""
    return found.withColumn("cell_key", F.concat_ws("_", F.col("start_col").cast("string"), F.col("start_row").cast("string")))


def responses(cells: DataFrame, matches: DataFrame, tokens: DataFrame, boxes: bool = False) -> DataFrame:
    """One row per (start_col, start_row): the first cell's attributes and all its tokens in cell order, with ``boxes`` their boxes too."""
    told = matches.join(tokens.select(T, "pdf_cell_id", "text", *(F.col(k).alias(f"t_{k}") for k in "ltrb")), [T, "pdf_cell_id"])
    per_cell = dummy_responses(cells).join(told.select(T, "cell_id", "pdf_cell_id", "text", *(f"t_{k}" for k in "ltrb")), [T, "cell_id"])
    listed = F.array_sort(F.collect_list(F.struct("cell_id", "pdf_cell_id", "text", *((f"t_{k}" for k in "ltrb") if boxes else ()))))
    found = per_cell.groupBy(T, "start_col", "start_row").agg(
        F.min("cell_id").alias("cell_id"),
        F.min_by("col_span", "cell_id").alias("col_span"),
        F.min_by("row_span", "cell_id").alias("row_span"),
        F.min_by("column_header", "cell_id").alias("column_header"),
        F.min_by("row_header", "cell_id").alias("row_header"),
        listed.alias("listed"),
    )
    text = F.array_join(F.transform("listed", lambda x: x["text"]), " ").alias("text")
    each = lambda x: F.struct(*(x[f"t_{k}"].alias(k) for k in "blrt"), x["text"].alias("token"))
    more = [F.transform("listed", each).alias("text_cell_bboxes")] if boxes else []
    return found.select(*(c for c in found.columns if c != "listed"), text, *more)


def reindexed(found: DataFrame) -> DataFrame:
    """Rows and columns numbered without gaps; ends follow from the spans."""
    col = (F.dense_rank().over(Window.partitionBy(T).orderBy("start_col")) - 1).cast("long")
    row = (F.dense_rank().over(Window.partitionBy(T).orderBy("start_row")) - 1).cast("long")
    return (
        found.withColumn("new_col", col).withColumn("new_row", row).drop("start_col", "start_row")
        .withColumnsRenamed({"new_col": "start_col", "new_row": "start_row"})
        .withColumn("end_col", F.col("start_col") + F.col("col_span")).withColumn("end_row", F.col("start_row") + F.col("row_span"))
    )


def sizes(found: DataFrame) -> DataFrame:
    """num_cols and num_rows of each table from the ends."""
    return found.groupBy(T).agg(F.max("end_col").alias("num_cols"), F.max("end_row").alias("num_rows"))


def document(found: DataFrame) -> DataFrame:
    """One JSON document per table, responses in cell order; absent values are left out."""
    cols = [c for c in found.columns if c != T]
    return found.groupBy(T).agg(F.to_json(F.array_sort(F.collect_list(F.struct("cell_id", *(c for c in cols if c != "cell_id"))))).alias("document"))


def in_order(rows: DataFrame, key: str, by: str = T, name: str = "cells") -> DataFrame:
    """Values of ``key`` in order, joined by commas, for each ``by``; texts go by their bytes."""
    return rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x.cast("string")), ",").alias(name))
