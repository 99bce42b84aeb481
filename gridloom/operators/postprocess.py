"""Cleaning of matched cells: alignment, duplicate columns, orphans, overlap correction."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from .lineage import by_table, dealt
from .match import T, best_match, drop_empty_tokens, intersection_over_token, no_matches, orphans

#: Beyond so many tokens a table's cells keep their boxes.
MANY = 300
#: Scores apart by no more than this share are equal: a sum's last places hang on the order of its addends.
EQUAL = 1e-9


def dimensions(cells: DataFrame) -> DataFrame:
    """table_id, columns, rows, max_cell_id; at least one row and column."""
    return cells.groupBy(T).agg(
        F.greatest(F.max("column_id") + 1, F.lit(1)).cast("long").alias("n_columns"),
        F.greatest(F.max("row_id") + 1, F.lit(1)).cast("long").alias("n_rows"),
        F.greatest(F.max("cell_id"), F.lit(0)).cast("long").alias("max_cell_id"),
    )


def good_cells(cells: DataFrame, matches: DataFrame) -> DataFrame:
    """Every cell with the number of its matches; good are matched cells of class over 1."""
    # names of their own keep the matches' partitioning through the join
    at = matches.select(F.col(T).alias("hit_table"), F.col("cell_id").alias("hit_cell"))
    hits = at.groupBy("hit_table", "hit_cell").agg(F.count(F.lit(1)).alias("hits"))
    both = cells.join(hits, (F.col(T) == F.col("hit_table")) & (F.col("cell_id") == F.col("hit_cell")), "left").drop("hit_table", "hit_cell")
    return both.withColumn("hits", F.coalesce("hits", F.lit(0))).withColumn("is_good", (F.col("cell_class") > 1) & (F.col("hits") > 0))


def column_alignment(good: DataFrame) -> DataFrame:
    """Per column the edge that varies least among good cells: left, middle or right, in that order on ties."""
    g = good.where("is_good").withColumn("m", (F.col("l") + F.col("r")) / 2)
    spread = g.groupBy(T, "column_id").agg(*((F.max(k) - F.min(k)).alias(f"d{k}") for k in "lmr"))
    kind = F.when((F.col("dl") <= F.col("dm")) & (F.col("dl") <= F.col("dr")), "left").when(F.col("dm") <= F.col("dr"), "middle").otherwise("right")
    return spread.select(T, "column_id", kind.alias("alignment"))


def column_medians(good: DataFrame, alignment: DataFrame) -> DataFrame:
    """Median place and size per column over good cells without spans, a cell counting once for each of its matches."""
    ok = good.where("is_good and colspan_val is null and rowspan_val is null").join(alignment, [T, "column_id"])
    x = F.when(F.col("alignment") == "left", F.col("l")).when(F.col("alignment") == "middle", (F.col("l") + F.col("r")) / 2).otherwise(F.col("r"))
    middle = lambda v: F.percentile(v, F.lit(0.5), F.col("hits"))
    return ok.withColumn("x", x).groupBy(T, "column_id").agg(
        middle(F.col("x")).alias("x"), middle(F.col("t")).alias("y"), middle(F.col("r") - F.col("l")).alias("w"), middle(F.col("b") - F.col("t")).alias("h")
    )


def column_medians_simplified(good: DataFrame, alignment: DataFrame) -> DataFrame:
    """As ``column_medians``, over all good cells once, with the centre as y."""
    ok = good.where("is_good").join(alignment, [T, "column_id"])
    x = F.when(F.col("alignment") == "left", F.col("l")).when(F.col("alignment") == "middle", (F.col("l") + F.col("r")) / 2).otherwise(F.col("r"))
    return ok.withColumn("x", x).groupBy(T, "column_id").agg(
        F.median("x").alias("x"), F.median((F.col("t") + F.col("b")) / 2).alias("y"), F.median(F.col("r") - F.col("l")).alias("w"), F.median(F.col("b") - F.col("t")).alias("h")
    )


def move_bad_cells(good: DataFrame, alignment: DataFrame, medians: DataFrame, resize: bool = False) -> DataFrame:
    """Bad cells moved to their column's alignment; with ``resize`` they also get the median size around the median y."""
    return _moved(good.join(alignment, [T, "column_id"], "left").join(medians, [T, "column_id"], "left"), good.columns, resize)


def _moved(j: DataFrame, columns: list[str], resize: bool) -> DataFrame:
    """Cells with their column's alignment, x, w and h, bad ones moved."""
    x = F.coalesce("x", F.lit(0.0))
    a = F.coalesce("alignment", F.lit("left"))
    width = F.coalesce("w", F.lit(0.0)) if resize else F.col("r") - F.col("l")
    left = G.aligned_left(a, x, width)
    if resize:
        middle, half = (F.col("t") + F.col("b")) / 2, F.coalesce("h", F.lit(0.0)) / 2
        top, bottom = middle - half, middle + half
    else:
        top, bottom = F.col("t"), F.col("b")
    pick = lambda bad, kept: F.when(F.col("is_good"), F.col(kept)).otherwise(bad).alias(kept)
    moved = {"l": pick(left, "l"), "t": pick(top, "t"), "r": pick(left + width, "r"), "b": pick(bottom, "b")}
    return j.select(*(moved.get(c, F.col(c)) for c in columns if c not in ("hits", "is_good")))


def moved_in_place(good: DataFrame, simple: bool = False) -> DataFrame:
    """``move_bad_cells`` by windows over a column's cells, with no join on alignments and medians."""
    column = Window.partitionBy(T, "column_id")
    middle = (F.col("l") + F.col("r")) / 2
    spread = lambda v: F.max(F.when(F.col("is_good"), v)).over(column) - F.min(F.when(F.col("is_good"), v)).over(column)
    g = good.withColumns({"dl": spread(F.col("l")), "dm": spread(middle), "dr": spread(F.col("r"))})
    kind = F.when((F.col("dl") <= F.col("dm")) & (F.col("dl") <= F.col("dr")), "left").when(F.col("dm") <= F.col("dr"), "middle")
    g = g.withColumn("alignment", F.when(F.col("dl").isNotNull(), kind.otherwise("right")))
    ok = F.col("is_good") if simple else F.col("is_good") & F.col("colspan_val").isNull() & F.col("rowspan_val").isNull()
    often = F.lit(1) if simple else F.greatest(F.col("hits"), F.lit(1))
    half = lambda v: F.percentile(F.when(ok, v), F.lit(0.5), often).over(column)
    x = F.when(F.col("alignment") == "left", F.col("l")).when(F.col("alignment") == "middle", middle).otherwise(F.col("r"))
    found = {"x": half(x)} | ({"w": half(F.col("r") - F.col("l")), "h": half(F.col("b") - F.col("t"))} if simple else {})
    return _moved(g.withColumns(found), good.columns, simple)


def column_scores(cells: DataFrame, initial: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Per column the sum of its matches' shares, before and after moving, and its sorted set of tokens."""
    at = cells.select(T, "cell_id", "column_id")
    whole = dimensions(cells).select(T, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_columns") - 1)).alias("column_id"))
    # each side by itself, as a union would forget that a table's rows are together
    for k, pairs in enumerate((initial, recomputed)):
        found = pairs.select(T, "cell_id", "pdf_cell_id", "iopdf").join(at, [T, "cell_id"]).groupBy(T, "column_id")
        whole = whole.join(found.agg(F.sum("iopdf").alias(f"score_{k}"), F.collect_set("pdf_cell_id").alias(f"tokens_{k}")), [T, "column_id"], "left")
    none = F.array().cast("array<bigint>")
    score = F.coalesce("score_0", F.lit(0.0)) + F.coalesce("score_1", F.lit(0.0))
    tokens = F.array_sort(F.array_union(F.coalesce("tokens_0", none), F.coalesce("tokens_1", none)))
    return whole.select(T, "column_id", score.alias("score"), tokens.alias("tokens"))


def duplicate_columns(scores: DataFrame, share: float = 0.6) -> DataFrame:
    """Columns that go: of neighbours where over ``share`` of the left one's tokens are shared, the one of lower score, on ties the right."""
    w = Window.partitionBy(T).orderBy("column_id")
    n = scores.select(T, "column_id", "score", "tokens", F.lead("tokens").over(w).alias("next_tokens"), F.lead("score").over(w).alias("next_score"))
    shared = F.size(F.array_intersect("tokens", "next_tokens")) / F.size("tokens")
    n = n.where(F.col("next_tokens").isNotNull() & (F.size("tokens") > 0)).where(shared > share)
    lower = F.col("next_score") - F.col("score") > EQUAL * F.greatest(F.lit(1.0), F.abs("next_score"))
    return n.select(T, F.when(lower, F.col("column_id")).otherwise(F.col("column_id") + 1).alias("column_id")).distinct()


def without_columns(cells: DataFrame, gone: DataFrame) -> DataFrame:
    """Cells less those of columns that go; the others keep their column's number."""
    return cells.join(gone, [T, "column_id"], "left_anti")


def delete_columns(cells: DataFrame, gone: DataFrame) -> DataFrame:
    """``without_columns`` with the columns to the right of deleted ones moved up."""
    at = gone.groupBy(T).agg(F.collect_set("column_id").alias("gone"))
    j = cells.join(at, T, "left").where(~F.coalesce(F.array_contains("gone", F.col("column_id")), F.lit(False)))
    left = F.coalesce(F.size(F.filter("gone", lambda g: g < F.col("column_id"))), F.lit(0))
    return j.select(*((F.col(c) - left).cast("long").alias(c) if c == "column_id" else F.col(c) for c in cells.columns))


def overlapping(cells: DataFrame) -> DataFrame:
    """Pairs of overlapping cells of a table: table_id, cell_id, other_id, the first of lesser id."""
    a, b = cells.alias("a"), cells.alias("b")
    return a.join(b, (F.col("a.table_id") == F.col("b.table_id")) & (F.col("a.cell_id") < F.col("b.cell_id")) & G.overlaps(G.box("a."), G.box("b."))).select(
        F.col("a.table_id").alias(T), F.col("a.cell_id").alias("cell_id"), F.col("b.cell_id").alias("other_id")
    )


def token_boxes(cells: DataFrame, best: DataFrame, tokens: DataFrame) -> DataFrame:
    """Cells shrunk to the hull of their best-matched tokens; cells without one go."""
    hull = best.join(tokens, [T, "pdf_cell_id"]).groupBy(T, "cell_id").agg(
        F.min("l").alias("l"), F.min("t").alias("t"), F.max("r").alias("r"), F.max("b").alias("b")
    )
    return cells.drop("l", "t", "r", "b").join(hull, [T, "cell_id"]).select(*cells.columns)


def first_token_boxes(cells: DataFrame, best: DataFrame, tokens: DataFrame) -> DataFrame:
    """Cells with the box of their first best-matched token; others keep theirs."""
    first = best.join(tokens, [T, "pdf_cell_id"]).groupBy(T, "cell_id").agg(F.min_by(F.struct(*"ltrb"), "pdf_cell_id").alias("x"))
    return cells.join(first, [T, "cell_id"], "left").select(
        *(F.coalesce(f"x.{c}", c).alias(c) if c in "ltrb" else F.col(c) for c in cells.columns)
    )


def align_to_tokens(cells: DataFrame, best: DataFrame, tokens: DataFrame) -> DataFrame:
    """``token_boxes`` for tables of up to MANY tokens; in others cells stay as they are."""
    many = tokens.groupBy(T).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MANY).select(T)
    return token_boxes(cells.join(many, T, "left_anti"), best, tokens).unionByName(cells.join(many, T, "left_semi"))


def bands(cells: DataFrame, line: str, low: str, high: str) -> DataFrame:
    """Extent of each row or column over cells of class over 1 without spans; -1 to -1 where there is none."""
    key = {"row_id": "n_rows", "column_id": "n_columns"}[line]
    found = cells.where("cell_class > 1 and colspan_val is null and rowspan_val is null").groupBy(T, line).agg(F.min(low).alias("lo"), F.max(high).alias("hi"))
    whole = dimensions(cells).select(T, F.explode(F.sequence(F.lit(0).cast("long"), F.col(key) - 1)).alias(line))
    return whole.join(found, [T, line], "left").select(T, line, F.coalesce("lo", F.lit(-1.0)).alias("lo"), F.coalesce("hi", F.lit(-1.0)).alias("hi"))


def nearest_band(lost: DataFrame, found: DataFrame, line: str, low: str, high: str) -> DataFrame:
    """For each orphan the touching band of nearest centre, rounded half to even; the lowest band on ties."""
    j = lost.alias("o").join(
        found.alias("x"), (F.col("o.table_id") == F.col("x.table_id")) & (F.col(f"o.{low}") <= F.col("x.hi")) & (F.col(f"o.{high}") >= F.col("x.lo"))
    )
    depth = G.band_depth((F.col("x.lo") + F.col("x.hi")) / 2, (F.col(f"o.{low}") + F.col(f"o.{high}")) / 2)
    order = Window.partitionBy(T, "pdf_cell_id").orderBy("depth", line)
    return (
        j.select("o.table_id", "o.pdf_cell_id", f"x.{line}", depth.alias("depth"))
        .withColumn("rn", F.row_number().over(order))
        .where("rn = 1")
        .select(T, "pdf_cell_id", line, "depth")
    )


def place_orphans(cells: DataFrame, lost: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells with those that orphans extend or open, and the orphans' matches (with ``post``, the column depth).

    An orphan needs a row and a column band. It goes to the first cell there, whose box grows to the
    hull, or to a new cell, numbered after the last one by the least token of its place.
    """
    r = nearest_band(lost, bands(cells, "row_id", "t", "b"), "row_id", "t", "b").drop("depth")
    c = nearest_band(lost, bands(cells, "column_id", "l", "r"), "column_id", "l", "r")
    placed = r.join(c, [T, "pdf_cell_id"]).join(lost.select(T, "pdf_cell_id", *"ltrb"), [T, "pdf_cell_id"])
    first = cells.groupBy(T, "row_id", "column_id").agg(F.min("cell_id").alias("cell_id"))
    spot = placed.groupBy(T, "row_id", "column_id").agg(
        F.min("pdf_cell_id").alias("least"), F.min("l").alias("l"), F.min("t").alias("t"), F.max("r").alias("r"), F.max("b").alias("b")
    )
    spot = spot.join(first, [T, "row_id", "column_id"], "left").join(dimensions(cells).select(T, "max_cell_id"), T)
    fresh = F.col("cell_id").isNull()
    rank = F.dense_rank().over(Window.partitionBy(T, fresh).orderBy("least"))
    spot = spot.withColumn("fresh", fresh).withColumn("cell_id", F.coalesce("cell_id", F.col("max_cell_id") + rank))
    grown = spot.where("not fresh").select(T, "cell_id", *(F.col(k).alias(f"o{k}") for k in "ltrb"))
    old = cells.join(grown, [T, "cell_id"], "left")
    box = {"l": F.least("l", "ol"), "t": F.least("t", "ot"), "r": F.greatest("r", "or"), "b": F.greatest("b", "ob")}
    old = old.select(*(box[k].alias(k) if k in box else F.col(k) for k in cells.columns))
    made = {
        "cell_class": F.lit(2).cast("long"), "label": F.lit("body"), "colspan_val": F.lit(None).cast("long"), "rowspan_val": F.lit(None).cast("long"),
    }
    new = spot.where("fresh").select(*(made[k].alias(k) if k in made else F.col(k) for k in cells.columns))
    links = placed.join(spot.select(T, "row_id", "column_id", "cell_id"), [T, "row_id", "column_id"]).select(
        T, "pdf_cell_id", "cell_id", F.lit(1.0).alias("iopdf"), F.col("depth").alias("post")
    )
    return old.unionByName(new), links


def push_apart(boxes: list[list[float]]) -> list[list[float]]:
    """Overlapping boxes of a table pushed apart along the thinner side of their overlap, in list order."""
    for i in range(len(boxes)):
        for j in range(i + 1, len(boxes)):
            a, b = boxes[i], boxes[j]
            if a == b or a[0] >= b[2] or a[2] <= b[0] or a[1] >= b[3] or a[3] <= b[1]:
                continue
            ox, oy = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
            low = 0 if ox < oy else 1
            over = min(ox, oy)
            near, far = (a, b) if a[low] < b[low] else (b, a)
            near[low + 2] -= math.ceil(over / 2) + 2
            far[low] += math.floor(over / 2)
            for x in (a, b):
                x[:] = [min(x[0], x[2]), min(x[1], x[3]), max(x[0], x[2]), max(x[1], x[3])]
    return boxes


def _any_overlap(boxes: np.ndarray, n: np.ndarray, place: np.ndarray) -> list[int]:
    """First rows of the tables in which two boxes overlap; a table's rows stand together, ``place`` counts them up to ``n``."""
    found, at, gap = set(), np.flatnonzero((place < n) & (n <= MANY)), 1
    while len(at):
        x, y = boxes[at], boxes[at + gap]
        apart = (x[:, 0] >= y[:, 2]) | (x[:, 2] <= y[:, 0]) | (x[:, 1] >= y[:, 3]) | (x[:, 3] <= y[:, 1])
        hit = at[~apart]
        found.update((hit - place[hit] + 1).tolist())
        gap += 1
        at = at[place[at] + gap <= n[at]]
    return sorted(found)


def correct_overlaps(cells: DataFrame) -> DataFrame:
    """``push_apart`` per table of up to MANY cells; larger tables stay.

    Tables come whole and in the order of their cells, many to a batch; only those with overlapping boxes are folded.
    """
    table, names = Window.partitionBy(T), cells.columns
    marked = cells.withColumn("n_cells", F.count(F.lit(1)).over(table)).withColumn("place", F.row_number().over(table.orderBy("cell_id")))

    def apart(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, place = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_cells", "place"))
        boxes = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in "ltrb"])
        moved = _any_overlap(boxes, n, place)
        for at in moved:
            boxes[at : at + n[at]] = push_apart(boxes[at : at + n[at]].tolist())
        done = {c: batch.column(c) for c in names}
        if moved:
            done |= {c: pa.array(boxes[:, k], mask=done[c].is_null().to_numpy(zero_copy_only=False)).cast(done[c].type) for k, c in enumerate("ltrb")}
        return pa.RecordBatch.from_arrays(list(done.values()), names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if rest is not None:
                batch, rest = pa.concat_batches([rest, batch]), None
            if not batch.num_rows:
                continue
            # a table that goes on in the next batch waits for it
            n, place = (batch.column(c)[-1].as_py() for c in ("n_cells", "place"))
            whole = batch.num_rows - (place if place < n <= MANY else 0)
            if whole < batch.num_rows:
                rest = batch.slice(whole)
            yield apart(batch.slice(0, whole))

    return marked.mapInArrow(run, cells.schema)


def refined(cells: DataFrame, tokens: DataFrame, simple: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cells after moving, without duplicate columns and set to their tokens; best matches; tokens left over.

    Steps that several later ones read are checkpointed, as each would otherwise be planned and worked out
    once per reader.
    """
    cells, tokens = by_table(cells), by_table(tokens)
    initial = dealt(intersection_over_token(cells, tokens))
    moved = dealt(moved_in_place(good_cells(cells, initial), simple))
    again = dealt(intersection_over_token(moved, tokens))
    gone = duplicate_columns(column_scores(moved, again if simple else initial, again))
    kept = dealt(without_columns(moved, gone))
    best = dealt(best_match(again.join(kept.select(T, "cell_id"), [T, "cell_id"], "left_semi")))
    boxed = dealt(first_token_boxes(kept, best, tokens) if simple else align_to_tokens(kept, best, tokens))
    return boxed, best, dealt(orphans(tokens, best))


def run(cells: DataFrame, tokens: DataFrame, dialect: str = "canonical") -> tuple[DataFrame, DataFrame]:
    """All steps: cleaned cells and the token matches they end with."""
    simple = dialect == "simplified"
    boxed, best, lost = refined(cells, drop_empty_tokens(tokens, blank_too=simple), simple)
    if not simple:
        done, links = place_orphans(boxed, lost)
        return done, best.unionByName(links.drop("post"))
    order = Window.partitionBy(T).orderBy("pdf_cell_id")
    numbered = lost.join(dimensions(boxed).select(T, "max_cell_id"), T).withColumn("cell_id", F.col("max_cell_id") + F.row_number().over(order))
    fixed = {
        "row_id": F.lit(0).cast("long"), "column_id": F.lit(0).cast("long"), "cell_class": F.lit(2).cast("long"), "label": F.lit("body"),
        "colspan_val": F.lit(None).cast("long"), "rowspan_val": F.lit(None).cast("long"),
    }
    extra = numbered.select(*(fixed[k].alias(k) if k in fixed else F.col(k) for k in cells.columns))
    return boxed.unionByName(extra), best.unionByName(numbered.select(T, "pdf_cell_id", "cell_id", F.lit(1.0).alias("iopdf")))


def page(cells: DataFrame, tokens: DataFrame, dialect: str = "canonical", do_cell_matching: bool = True, correct_overlapping_cells: bool = False) -> tuple[DataFrame, DataFrame]:
    """The entry point: cleaned cells and matches of tables with tokens; the cells of others, or of all without matching, as they are."""
    if not do_cell_matching:
        return cells, no_matches(tokens)
    told = tokens.select(T).distinct()
    done, links = run(cells.join(told, T, "left_semi"), tokens, dialect)
    if correct_overlapping_cells and dialect == "canonical":
        done = correct_overlaps(done)
    return done.unionByName(cells.join(told, T, "left_anti")), links
