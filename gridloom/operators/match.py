"""Matching of predicted cells with text tokens of the same table.

Cells: table_id, cell_id, row_id, column_id, l, t, r, b, cell_class, label, colspan_val, rowspan_val.
Tokens: table_id, pdf_cell_id, l, t, r, b, text. Matches: table_id, pdf_cell_id, cell_id, iopdf.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G

T = "table_id"


def drop_empty_tokens(tokens: DataFrame, blank_too: bool = False) -> DataFrame:
    """Tokens with text; with ``blank_too`` also those of white space alone go."""
    return tokens.where(F.trim("text") != "") if blank_too else tokens.where("text <> ''")


def normalised_tokens(raw: DataFrame, strict: bool = True) -> DataFrame:
    """Tokens of raw rows (table_id, pos, id, text, corners, sides): the box from the list of corners, else from the struct of
    sides; a blank id is the token's place, a null text is empty. Ids are whole numbers: others are an error, or, unless
    ``strict``, their tokens go."""
    name = F.coalesce(F.nullif(F.trim("id"), F.lit("")), F.col("pos").cast("string"))
    number = name.cast("long") if strict else name.try_cast("long")
    box = [F.coalesce(F.get("corners", F.lit(i)), F.col(f"sides.{k}")).alias(k) for i, k in enumerate("ltrb")]
    done = raw.select(T, number.alias("pdf_cell_id"), *box, F.coalesce("text", F.lit("")).alias("text"))
    return done.where("pdf_cell_id is not null")


def _pairs(cells: DataFrame, tokens: DataFrame) -> DataFrame:
    """Overlapping pairs: an equi-join on the table with the overlap as its condition."""
    c, p = cells.alias("c"), tokens.alias("p")
    return c.join(p, (F.col("c.table_id") == F.col("p.table_id")) & G.overlaps(G.box("c."), G.box("p.")))


def intersection_over_token(cells: DataFrame, tokens: DataFrame) -> DataFrame:
    """All overlapping pairs with the share of the token that lies in the cell."""
    return (
        _pairs(cells, tokens)
        .where(G.area(G.box("p.")) > 0)
        .select("c.table_id", "p.pdf_cell_id", "c.cell_id", G.over_second(G.box("c."), G.box("p.")).alias("iopdf"))
        .dropDuplicates()
    )


def iou_matches(cells: DataFrame, tokens: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Pairs whose IoU reaches the threshold, with the token's text."""
    return (
        _pairs(cells, tokens)
        .select("c.table_id", "p.pdf_cell_id", "c.cell_id", G.iou(G.box("c."), G.box("p.")).alias("iou"), "p.text")
        .where(F.col("iou") >= threshold)
    )


def best_match(matches: DataFrame) -> DataFrame:
    """The match of the largest share for each token; of equal ones the first cell."""
    order = Window.partitionBy(T, "pdf_cell_id").orderBy(F.desc("iopdf"), "cell_id")
    return matches.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def ranked_matches(matches: DataFrame) -> DataFrame:
    """Matches with their rank within the token by falling share."""
    order = Window.partitionBy(T, "pdf_cell_id").orderBy(F.desc("iopdf"), "cell_id")
    return matches.withColumn("match_ord", (F.row_number().over(order) - 1).cast("long"))


def orphans(tokens: DataFrame, matches: DataFrame) -> DataFrame:
    """Tokens without any match."""
    return tokens.join(matches, [T, "pdf_cell_id"], "left_anti")


def with_predictions(cells: DataFrame, boxes: DataFrame) -> DataFrame:
    """Cells with the box and class of the same ordinal; zeros and class 2 where there is none."""
    b = boxes.select(T, F.col("pos").alias("cell_id"), *(F.col(k).alias(f"p_{k}") for k in "ltrb"), F.col("cls").alias("p_cls"))
    joined = cells.select(T, "cell_id").join(b, [T, "cell_id"], "left")
    return joined.select(T, "cell_id", *(F.coalesce(f"p_{k}", F.lit(0.0)).alias(k) for k in "ltrb"), F.coalesce("p_cls", F.lit(2)).cast("long").alias("cell_class"))


def no_matches(tokens: DataFrame) -> DataFrame:
    """The matches of tables without tokens: none."""
    return tokens.select(T, "pdf_cell_id", F.lit(0).cast("long").alias("cell_id"), F.lit(0.0).alias("iopdf")).limit(0)
