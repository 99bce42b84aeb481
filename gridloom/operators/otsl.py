"""Structure tokens (OTSL): grids, spans, padding, HTML and back.

Input: table_id, pos, tag; rows end with ``nl``. ``lcel`` continues the cell to the left, ``ucel`` the one
above, ``xcel`` both.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .match import T

#: Tags that open a cell, without and with the two-dimensional continuation.
CELL5 = ("fcel", "ecel", "ched", "rhed", "srow")
CELL6 = (*CELL5, "xcel")
STOP = ("<pad>", "<unk>", "<start>", "<end>")


def without_stops(tokens: DataFrame) -> DataFrame:
    return tokens.where(~F.col("tag").isin(*STOP))


def grid(tokens: DataFrame) -> DataFrame:
    """Adds row_id, column_id and, for cell tags, cell_id; ``nl`` tokens go."""
    t = Window.partitionBy(T).orderBy("pos")
    row = F.coalesce(F.sum((F.col("tag") == "nl").cast("long")).over(t.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    is_cell = F.col("tag").isin(*CELL6)
    cell = F.sum(is_cell.cast("long")).over(t.rowsBetween(Window.unboundedPreceding, 0)) - 1
    g = tokens.withColumn("row_id", row).withColumn("cell_id", F.when(is_cell, cell)).where("tag <> 'nl'")
    order = Window.partitionBy(T, "row_id").orderBy("pos")
    return g.withColumn("column_id", (F.row_number().over(order) - 1).cast("long"))


def row_lengths(cells: DataFrame) -> DataFrame:
    return cells.groupBy(T, "row_id").agg(F.count(F.lit(1)).alias("n"))


def is_square(cells: DataFrame) -> DataFrame:
    """table_id, square: all rows have the same length."""
    return row_lengths(cells).groupBy(T).agg((F.min("n") == F.max("n")).alias("square"))


def padded(cells: DataFrame, tag: str = "lcel") -> DataFrame:
    """Rows filled up on the right to the longest with ``tag``: table_id, row_id, column_id, tag."""
    n = row_lengths(cells)
    longest = n.groupBy(T).agg(F.max("n").alias("most"))
    more = n.join(longest, T).where("n < most").select(T, "row_id", F.explode(F.sequence(F.col("n"), F.col("most") - 1)).alias("column_id"), F.lit(tag).alias("tag"))
    return cells.select(T, "row_id", "column_id", "tag").unionByName(more)


def dimensions(tokens: DataFrame) -> DataFrame:
    """Columns (place of the first nl) and rows (number of nl); a table without any nl is an error."""
    order = Window.partitionBy(T).orderBy("pos")
    at = tokens.withColumn("k", (F.row_number().over(order) - 1).cast("long"))
    n = at.groupBy(T).agg(F.min(F.when(F.col("tag") == "nl", F.col("k"))).alias("n_columns"), F.count_if(F.col("tag") == "nl").alias("n_rows"))
    told = F.concat(F.lit("no nl in table "), F.col(T).cast("string"))
    return n.withColumn("n_columns", F.coalesce("n_columns", F.raise_error(told).cast("long")))


def cell_counts(tokens: DataFrame) -> DataFrame:
    """Numbers of cell tags per table in either sense."""
    return tokens.groupBy(T).agg(F.count_if(F.col("tag").isin(*CELL5)).alias("n5"), F.count_if(F.col("tag").isin(*CELL6)).alias("n6"))


def rows_only(cells: DataFrame) -> DataFrame:
    """Cells with rows numbered anew, so that rows without a tag have no number."""
    row = F.dense_rank().over(Window.partitionBy(T).orderBy("row_id")) - 1
    return cells.withColumn("row_id", row.cast("long"))


def reaches(cells: DataFrame) -> DataFrame:
    """Adds the tags to the right and below, and how far a cell reaches: ``right`` over lcel and xcel, ``down`` over ucel and xcel."""
    across = Window.partitionBy(T, "row_id").orderBy("column_id")
    down = Window.partitionBy(T, "column_id").orderBy("row_id")
    after = lambda w: w.rowsBetween(1, Window.unboundedFollowing)
    size = lambda k, w: F.max(k).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) + 1
    stop_h = F.min(F.when(~F.col("tag").isin("lcel", "xcel"), F.col("column_id"))).over(after(across))
    stop_v = F.min(F.when(~F.col("tag").isin("ucel", "xcel"), F.col("row_id"))).over(after(down))
    return cells.withColumns(
        {
            "next_tag": F.lead("tag").over(across),
            "below_tag": F.lead("tag").over(down),
            "right": (F.coalesce(stop_h, size("column_id", across)) - F.col("column_id")).cast("long"),
            "down": (F.coalesce(stop_v, size("row_id", down)) - F.col("row_id")).cast("long"),
        }
    )


def registered(found: DataFrame) -> DataFrame:
    """(table_id, row_id, column_id) of the two-dimensional spans that stand: in row order, each that meets no earlier standing one."""
    meets = lambda a, b: (
        (a["row_id"] < b["row_id"] + b["down"]) & (b["row_id"] < a["row_id"] + a["down"])
        & (a["column_id"] < b["column_id"] + b["right"]) & (b["column_id"] < a["column_id"] + a["right"])
    )
    spans = found.where("next_tag = 'xcel'").groupBy(T).agg(F.array_sort(F.collect_list(F.struct("row_id", "column_id", "right", "down"))).alias("x"))
    stand = F.aggregate("x", F.slice("x", 1, 0), lambda acc, b: F.when(F.exists(acc, lambda a: meets(a, b)), acc).otherwise(F.array_append(acc, b)))
    return spans.select(T, F.explode(stand).alias("x")).select(T, "x.row_id", "x.column_id", F.lit(True).alias("stands"))


def spans(cells: DataFrame, tags: tuple[str, ...] = CELL5) -> DataFrame:
    """Per cell with one of ``tags``: wide and tall (one-dimensional spans), xwide and xtall (two-dimensional), stands, and colspan and rowspan.

    Only lcel to the right opens ``wide``, only ucel below opens ``tall``, only xcel to the right opens a
    two-dimensional span, which counts unless an earlier one already holds one of its places.
    """
    found = reaches(cells).where(F.col("tag").isin(*tags))
    found = found.join(registered(found), [T, "row_id", "column_id"], "left").withColumn("stands", F.coalesce("stands", F.lit(False)))
    two = F.col("next_tag") == "xcel"
    one = F.lit(1).cast("long")
    s = found.withColumns(
        {
            "wide": F.when(F.col("next_tag") == "lcel", F.col("right")).otherwise(one),
            "tall": F.when(F.col("below_tag") == "ucel", F.col("down")).otherwise(one),
            "xwide": F.when(two, F.col("right")).otherwise(one),
            "xtall": F.when(two, F.col("down")).otherwise(one),
            "cancelled": F.coalesce(two, F.lit(False)) & ~F.col("stands"),
        }
    )
    both = lambda plain, crossed: F.greatest(plain, F.when(F.col("stands"), F.col(crossed)).otherwise(one))
    return s.withColumns({"colspan": both("wide", "xwide"), "rowspan": both("tall", "xtall")}).drop("next_tag", "below_tag", "right", "down")


def span_map(tokens: DataFrame) -> DataFrame:
    """table_id, cell_id, colspan, rowspan of the cells (xcel among them) that span more than one place.

    Tables that begin with no cell have none. Rows are padded first; a cell's number counts cells in the padded rows.
    """
    good = opening(tokens).where(F.col("first_tag").isin(*CELL6)).select(T)
    full = padded(rows_only(grid(tokens.join(good, T, "left_semi"))))
    found = spans(full, CELL6).withColumn("cell_id", (F.row_number().over(Window.partitionBy(T).orderBy("row_id", "column_id")) - 1).cast("long"))
    return found.where("colspan > 1 or rowspan > 1").select(T, "cell_id", "colspan", "rowspan")


def opening(tokens: DataFrame) -> DataFrame:
    """table_id, first_tag."""
    return tokens.groupBy(T).agg(F.min_by("tag", "pos").alias("first_tag"))


def head_marks(cells: DataFrame) -> DataFrame:
    """Per row: opens or closes the table head. It opens at a first row with ched and closes before the next without."""
    rows = cells.groupBy(T, "row_id").agg(F.max((F.col("tag") == "ched").cast("int")).alias("has"))
    before = F.coalesce(F.lag("has").over(Window.partitionBy(T).orderBy("row_id")), F.lit(0))
    return rows.select(T, "row_id", ((F.col("has") == 1) & (before == 0)).alias("opens"), ((F.col("has") == 0) & (before == 1)).alias("closes"))


def cell_html() -> Column:
    """HTML tokens of a cell of ``spans``: one-dimensional spans as colspan and rowspan, two-dimensional ones the other way round."""
    attribute = lambda name, n, when: F.when(when, F.concat(F.lit(f' {name}="'), n.cast("string"), F.lit('"')))
    wide, tall, xwide, xtall = (F.col(c) for c in ("wide", "tall", "xwide", "xtall"))
    told = F.array_compact(
        F.array(
            attribute("colspan", wide, wide > 1), attribute("rowspan", tall, tall > 1),
            attribute("rowspan", xtall, xwide > 1), attribute("colspan", xwide, xwide > 1),
        )
    )
    open_, close = F.array(F.lit("<td")), F.array(F.lit(">"), F.lit("</td>"))
    return F.when((F.size(told) == 0) | F.col("cancelled"), F.array(F.lit("<td>"), F.lit("</td>"))).otherwise(F.concat(open_, told, close))


def html(tokens: DataFrame) -> DataFrame:
    """The HTML token list of each table, joined by ``|``; short rows are padded first, empty ones go.

    Tables that begin with no cell are not structure tokens, so they come back as they are.
    """
    first = opening(tokens).withColumn("is_cell", F.col("first_tag").isin(*CELL5)).drop("first_tag")
    known = tokens.join(first, T)
    full = padded(rows_only(grid(known.where("is_cell").drop("is_cell"))))
    lines = spans(full).select(T, "row_id", "column_id", cell_html().alias("x")).groupBy(T, "row_id").agg(F.array_sort(F.collect_list(F.struct("column_id", "x"))).alias("xs"))
    lines = head_marks(full).join(lines, [T, "row_id"], "left")
    none = F.array().cast("array<string>")
    body = F.coalesce(F.flatten(F.transform("xs", lambda v: v["x"])), none)
    line = F.concat(
        F.when(F.col("closes"), F.array(F.lit("</thead>"))).otherwise(none),
        F.when(F.col("opens"), F.array(F.lit("<thead>"))).otherwise(none),
        F.array(F.lit("<tr>")), body, F.array(F.lit("</tr>")),
    )
    text = lambda parts: F.array_join(parts, "|").alias("html")
    done = lines.select(T, "row_id", line.alias("x")).groupBy(T).agg(text(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("row_id", "x"))), lambda v: v["x"]))))
    asis = known.where("not is_cell").groupBy(T).agg(text(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tag"))), lambda v: v["tag"])))
    return done.unionByName(asis)


#: A span token of 2 to 20 places; others are passed over.
SPAN = re.compile(r'^ (col|row)span="([2-9]|1[0-9]|20)"$')
#: Marks that say nothing about whether a cell is empty.
MARKS = {"<i>", "</i>", "<I>", "</I>", "<b>", "</b>", "<B>", "</B>", " "}
CONVERTED = "ok boolean, tags string, spans map<int,array<int>>, n_columns int, n_rows int, html_len int, tags_len int, square boolean"


def span_places(token: Column) -> Column:
    """The number of places of a span token, of 2 to 20; null for others."""
    n = F.regexp_extract(token, r'^ (?:col|row)span="(\d+)"$', 1).try_cast("long")
    return F.when(n.between(2, 20), n)


class HtmlReader:
    """Folds HTML tokens into structure tags. Every place of the row above says how wide a span there goes on and
    for how many rows more; a row first continues what stands above the place that it has come to."""

    def __init__(self, contents: list[list[str]] | None) -> None:
        self.contents = contents
        self.rows: list[list[str]] = []
        self.above: list[tuple[int, int]] = []
        self.tags: list[str] = []
        self.marks: list[tuple[int, int]] = []
        self.place = self.cells = 0
        self.spans: dict[int, list[int]] = {}

    def put(self, tag: str, width: int, rows: int) -> None:
        self.tags.append(tag)
        self.marks.append((width, rows))

    def continue_above(self) -> bool:
        """Whether the row above reaches as far as this one."""
        if not self.rows:
            return True
        while self.place < len(self.above):
            width, rows = self.above[self.place]
            if rows <= 0:
                return True
            for k in range(max(width, 1)):
                self.put("xcel" if width else "ucel", width - k if width else 0, rows - 1)
            self.place += max(width, 1)
        return False

    def end_row(self) -> None:
        if self.rows:  # what the row above has beyond this one
            for width, rows in self.above[len(self.marks) : -1]:
                self.put("xcel" if width else "ucel", width, rows - 1)
        self.rows.append(self.tags)
        self.above = [*self.marks, (-1, -1)]
        self.tags, self.marks, self.place = [], [], 0

    def open_cell(self) -> None:
        full = self.contents is None or any(t not in MARKS for t in self.contents[self.cells])
        self.put("fcel" if full else "ecel", 0, 0)
        self.cells += 1
        self.place += 1

    def span(self, columns: int, rows: int) -> None:
        """Widens the cell put last; a span over rows and columns does not move the place on."""
        self.spans[self.cells - 1] = [columns, rows]
        self.marks[-1] = (columns if columns > 1 else 0, rows - 1)
        for k in range(1, columns):
            self.put("lcel" if rows == 1 else "xcel", columns - k, rows - 1)
        if rows == 1:
            self.place += columns - 1

    def read(self, tokens: list[str]) -> bool:
        kinds = [SPAN.match(t) for t in tokens]
        at = lambda i: kinds[i] if 0 <= i < len(kinds) else None
        for i, t in enumerate(tokens):
            if t in ("<td>", "<td", "</tr>") and not self.continue_above():
                return False
            if t == "</tr>":
                self.end_row()
            elif t in ("<td>", "<td"):
                self.open_cell()
            elif m := kinds[i]:
                others = [o for o in (at(i - 1), at(i + 1)) if o and o[1] != m[1]]
                if not others:
                    self.span(*((int(m[2]), 1) if m[1] == "col" else (1, int(m[2]))))
                elif m[1] == "row":
                    for o in others:
                        self.span(int(o[2]), int(m[2]))
        return True


def tags_of_html(tokens: list[str], contents: list[list[str]] | None = None) -> dict | None:
    """Structure tags of HTML tokens with spans, sizes and squareness; None where a row outruns the one above.

    ``contents`` are the tokens of each cell's text: a cell with nothing but marks is ecel. Rows that are not
    of one length are filled up with fcel.
    """
    reader = HtmlReader(contents)
    try:
        if not reader.read(tokens):
            return None
    except IndexError:  # more cells than contents, or a span before any cell
        return None
    most = max(map(len, reader.rows), default=0)
    square = len({len(r) for r in reader.rows if r}) <= 1
    tags = [t for r in reader.rows if r for t in (*r, *["fcel"] * (most - len(r)), "nl")] if not square else [t for r in reader.rows for t in (*r, "nl")]
    return {"tags": tags, "spans": reader.spans, "n_columns": most, "n_rows": len(reader.rows), "html_len": len(tokens), "tags_len": len(tags), "square": square}


def from_html(found: DataFrame) -> DataFrame:
    """``CONVERTED`` of each table's ``|``-joined HTML tokens and, in a column ``contents`` if there is one, its cells' tokens.

    Rows carry spans downwards, so a table is folded as a whole.
    """
    some = F.col("contents") if "contents" in found.columns else F.lit(None).cast("array<array<string>>")

    @F.pandas_udf(CONVERTED)
    def fold(html_tokens: pd.Series, contents: pd.Series) -> pd.DataFrame:
        out = []
        for x, c in zip(html_tokens, contents):
            done = tags_of_html(x.split("|"), None if c is None else [list(k) for k in c])
            none = dict.fromkeys(("tags", "spans", "n_columns", "n_rows", "html_len", "tags_len", "square"))
            out.append({"ok": done is not None, **(done or none)} | ({"tags": " ".join(done["tags"])} if done else {}))
        return pd.DataFrame(out, columns=[c.split()[0] for c in re.split(r", (?=\w+ )", CONVERTED)])

    return found.select(T, fold("html", some).alias("x")).select(T, "x.*")
