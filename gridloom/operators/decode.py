"""Decoding of predicted ids, boxes and classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from .match import T

#: Ids of the structure tags.
TAG_IDS = {
    "<pad>": 0, "<unk>": 1, "<start>": 2, "<end>": 3, "ecel": 4, "fcel": 5, "lcel": 6, "ucel": 7, "xcel": 8, "nl": 9, "ched": 10, "rhed": 11, "srow": 12,
}


def argmax(values: Column) -> Column:
    """Index of the greatest value, the lowest on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("long")


def tags(ids: Column) -> Column:
    """Tags of an id sequence without its first and last; an unknown id is an error."""
    known = F.create_map(*(F.lit(x) for k, v in TAG_IDS.items() for x in (v, k)))
    inner = F.when(F.size(ids) > 2, F.slice(ids, F.lit(2), F.size(ids) - 2)).otherwise(F.array().cast("array<int>"))
    return F.transform(inner, lambda i: F.coalesce(F.try_element_at(known, i), F.raise_error(F.concat(F.lit("unknown tag id "), i.cast("string")))))


def until_end(ids: Column, most: int = 1024) -> Column:
    """Ids up to the first end id, at most ``most``."""
    end = F.array_position(ids, F.lit(TAG_IDS["<end>"]))
    return F.slice(ids, F.lit(1), F.least(F.when(end > 0, end).otherwise(F.size(ids)), F.lit(most)).cast("int"))


def padding(ids: Column) -> Column:
    """Number of zeros at the end."""
    return F.size(ids) - F.size(without_padding(ids))


def without_padding(ids: Column) -> Column:
    """Ids without the zeros at the end."""
    last = F.array_position(F.reverse(F.transform(ids, lambda i: (i != 0).cast("int"))), F.lit(1))
    return F.when(last == 0, F.slice(ids, 1, 0)).otherwise(F.slice(ids, F.lit(1), (F.size(ids) - last + 1).cast("int")))


def corrected(tokens: DataFrame, first_only: bool = False) -> DataFrame:
    """xcel becomes lcel (of every token, or the first alone), then lcel after ucel becomes fcel."""
    order = Window.partitionBy(T).orderBy("pos")
    first = F.row_number().over(order) == 1
    one = tokens.withColumn("x", F.when((F.col("tag") == "xcel") & (first if first_only else F.lit(True)), "lcel").otherwise(F.col("tag")))
    after = F.lag("x").over(order) == "ucel"
    return one.select(T, "pos", F.when((F.col("x") == "lcel") & F.coalesce(after, F.lit(False)), "fcel").otherwise(F.col("x")).alias("tag"))


def emitted(tokens: DataFrame) -> DataFrame:
    """Tokens that emit a box, with its ordinal: cells not behind a skipping tag, and the first lcel of a run."""
    order = Window.partitionBy(T).orderBy("pos")
    before = F.coalesce(F.lag("tag").over(order), F.lit("<start>"))
    plain = ~before.isin("nl", "ucel", "xcel", "<start>") & F.col("tag").isin("fcel", "ecel", "ched", "rhed", "srow", "nl", "ucel")
    run = (F.col("tag") == "lcel") & (before != "lcel")
    e = tokens.withColumn("first_lcel", run).withColumn("emits", plain | run).where("emits")
    return e.select(T, "pos", "tag", "first_lcel", (F.row_number().over(order) - 1).cast("long").alias("box_ord"))


def merge_pairs(boxes: DataFrame) -> DataFrame:
    """For each first lcel its box and the next emitted one, which close a span together; -1 where none follows."""
    nxt = F.coalesce(F.lead("box_ord").over(Window.partitionBy(T).orderBy("box_ord")), F.lit(-1)).cast("long")
    return boxes.withColumn("next_ord", nxt).where("first_lcel").select(T, "box_ord", "next_ord")


def without_spanned(boxes: Column, html: Column) -> Column:
    """Boxes less those that follow a spanned cell: the 1-based rank of each ``>`` among ``<td>`` and ``>`` is a 0-based place."""
    opens = F.filter(html, lambda t: t.isin("<td>", ">"))
    gone = F.filter(F.transform(opens, lambda t, i: F.when(t == ">", i + 1)), lambda i: i.isNotNull())
    return F.filter(boxes, lambda b, i: ~F.array_contains(gone, i))


def synced(boxes: Column, html: Column) -> Column:
    """Boxes as they are where their number is that of the cells, else ``without_spanned``."""
    cells = F.size(F.filter(html, lambda t: t.isin("<td>", ">")))
    return F.when(F.size(boxes) == cells, boxes).otherwise(without_spanned(boxes, html))


def tag_names(ids: DataFrame, names: DataFrame) -> DataFrame:
    """Tags of id rows by a table (tag_id, tag) of names, which is small; an unknown id is an error."""
    told = ids.join(F.broadcast(names), "tag_id", "left")
    return told.withColumn("tag", F.coalesce("tag", F.raise_error(F.concat(F.lit("unknown tag id "), F.col("tag_id").cast("string")))))


def merged(boxes: DataFrame, pairs: DataFrame, canonical: bool = True) -> DataFrame:
    """Boxes (table_id, box_ord, cx, cy, w, h) with those of ``merge_pairs`` made one; a pair's second box goes.

    A first box that none follows merges with the table's last box, which stays, in the canonical dialect and with none in
    the other. Where a second box opens a pair of its own, the canonical dialect merges that too; the other leaves the
    second box out with its pair, so that of openers in a row every other one merges.
    """
    last = boxes.groupBy(T).agg(F.max("box_ord").alias("last_ord"))
    p = pairs.join(last, T)
    if canonical:
        p = p.withColumn("closing", F.col("next_ord") >= 0).withColumn("next_ord", F.when(F.col("closing"), F.col("next_ord")).otherwise(F.col("last_ord")))
    else:
        n = F.row_number().over(Window.partitionBy(T).orderBy("box_ord"))
        row = F.row_number().over(Window.partitionBy(T, "run").orderBy("box_ord"))
        p = p.where("next_ord >= 0").withColumn("run", F.col("box_ord") - n).withColumn("row", row).where("row % 2 = 1").withColumn("closing", F.lit(True))
    gone = p.where("closing").select(T, F.col("next_ord").alias("box_ord"), F.lit(True).alias("closes"))
    second = boxes.select(T, F.col("box_ord").alias("next_ord"), *(F.col(k).alias(f"n_{k}") for k in ("cx", "cy", "w", "h")))
    p = p.select(T, "box_ord", "next_ord").join(second, [T, "next_ord"])
    both = boxes.join(p, [T, "box_ord"], "left").join(gone, [T, "box_ord"], "left")
    opens = F.col("next_ord").isNotNull()
    pick = lambda prefix: tuple(F.col(prefix + k) for k in ("cx", "cy", "w", "h"))
    whole = G.merge_span(pick(""), pick("n_"))
    stays = F.col("closes").isNull() | (opens & F.lit(canonical))
    return both.where(stays).select(T, "box_ord", *(F.when(opens, v).otherwise(F.col(k)).alias(k) for k, v in zip(("cx", "cy", "w", "h"), whole)))
