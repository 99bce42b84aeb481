"""Deterministic table-structure inputs derived from the star-schema tables.

Each is a DataFrame here and, for the SQL equivalents, a common table expression in ``CTE``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(spark: SparkSession, sf_dir: str, big: bool = False) -> DataFrame:
    """One row per table row: table_id, row_id, and the integers p, s, q that places derive from.

    A table is an order, of up to seven rows; with ``big`` a supplier's lines of one number, of up to some hundred rows.
    """
    key = F.col("l_suppkey") * 10 + F.col("l_linenumber") if big else F.col("l_orderkey")
    lines = read(spark, sf_dir, "lineitem").select(
        key.cast("long").alias("table_id"), F.col("l_partkey").cast("long").alias("p"), F.col("l_suppkey").cast("long").alias("s"), "l_orderkey", "l_linenumber", "l_quantity"
    )
    # dealt by the key's final name, so that later steps know that a table's rows are together
    order = Window.partitionBy("table_id").orderBy(*(["l_orderkey"] if big else []), "l_linenumber", "p", "s", "l_quantity")
    return lines.select("table_id", (F.row_number().over(order) - 1).cast("long").alias("row_id"), "p", "s", F.col("l_quantity").cast("long").alias("q"))


def grid(spark: SparkSession, sf_dir: str, big: bool = False) -> DataFrame:
    return rows(spark, sf_dir, big).withColumn("col", F.explode(F.array(*(F.lit(c).cast("long") for c in range(4)))))


def table_cells(spark: SparkSession, sf_dir: str, big: bool = False) -> DataFrame:
    """table_id, cell_id, row_id, column_id, l, t, r, b, cell_class, label, colspan_val, rowspan_val."""
    g = grid(spark, sf_dir, big)
    left, top = 100 * F.col("col") + (F.col("p") + F.col("col")) % 7, 20 * F.col("row_id") + F.col("s") % 5
    wide = ((F.col("p") + 3 * F.col("col")) % 10 == 0) & (F.col("col") < 3)
    return g.select(
        "table_id",
        (F.col("row_id") * 4 + F.col("col")).alias("cell_id"),
        "row_id",
        F.col("col").alias("column_id"),
        left.cast("double").alias("l"),
        top.cast("double").alias("t"),
        (left + 60 + F.col("q") % 20).cast("double").alias("r"),
        (top + 14).cast("double").alias("b"),
        F.when((F.col("p") + F.col("col")) % 9 == 0, 1).otherwise(2).cast("long").alias("cell_class"),
        F.when(F.col("row_id") == 0, "ched").when(F.col("col") == 0, "rhed").otherwise("fcel").alias("label"),
        F.when(wide, 2).cast("long").alias("colspan_val"),
        F.when(wide, 1).cast("long").alias("rowspan_val"),
    )


def pdf_cells(spark: SparkSession, sf_dir: str, big: bool = False) -> DataFrame:
    """Text tokens of a page: table_id, pdf_cell_id, l, t, r, b, text."""
    c, p, s, q = (F.col(x) for x in ("col", "p", "s", "q"))
    shifted = (s + c) % 17 == 0
    left = 100 * c + (s * 3 + c) % 25 - 10 + F.when(shifted, 85).otherwise(0)
    top = 20 * F.col("row_id") + p % 9 - 4
    return (
        grid(spark, sf_dir, big)
        .where((p + 2 * c) % 11 != 0)
        .select(
            "table_id",
            (F.col("row_id") * 4 + c).alias("pdf_cell_id"),
            left.cast("double").alias("l"),
            top.cast("double").alias("t"),
            (left + F.when(shifted, 12).otherwise(30 + q % 15)).cast("double").alias("r"),
            (top + 10).cast("double").alias("b"),
            F.when((p + c) % 23 == 0, "").otherwise(F.concat(F.lit("w"), p.cast("string"))).alias("text"),
        )
    )


def otsl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure tokens: table_id, pos, tag; every row ends with nl.

    Tables have three to six columns; some rows are short or empty, some tables begin with no cell, and spans over
    rows and columns touch and overlap.
    """
    r, c, p, s = F.col("row_id"), F.col("col"), F.col("p"), F.col("s")
    h = p + 3 * c + 5 * r
    tag = (
        F.when((r == 0) & (c == 0) & (p % 19 < 2), F.when(p % 19 == 0, "lcel").otherwise("xcel"))
        .when((c > 0) & (h % 6 == 0), "lcel")
        .when((c > 0) & (h % 6 == 1) & (s % 3 == 0), "xcel")
        .when((r > 0) & ((s + c) % 5 == 0), "ucel")
        .when((r > 0) & (c > 0) & ((s + c) % 5 == 1) & (p % 2 == 0), "xcel")
        .when((r == 0) | (r == 2) & (p % 4 == 0), "ched")
        .when(c == 0, "rhed")
        .when(p % 13 == 0, "srow")
        .when((p * c) % 8 == 0, "ecel")
        .otherwise("fcel")
    )
    lines = rows(spark, sf_dir)
    wide = lines.withColumn("col", F.explode(F.sequence(F.lit(0).cast("long"), 2 + F.col("table_id") % 4)))
    there = ((c == 0) | ((p + s + c) % 23 != 0)) & ((r == 0) | (s % 29 != 0))
    cells = wide.where(there).select("table_id", (r * 16 + c).alias("pos"), tag.alias("tag"))
    return cells.unionByName(lines.select("table_id", (r * 16 + 15).alias("pos"), F.lit("nl").alias("tag")))


def predicted_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 centre boxes a table: table_id, pos, cx, cy, w, h and three class logits."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("table_id"), "embedding")
    k = e.select("table_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("k"))
    at = lambda i: F.get("embedding", (F.col("k") * 4 + i) % 64).cast("double")
    return k.select(
        "table_id", F.col("k").cast("long").alias("pos"), (0.5 + at(0)).alias("cx"), (0.5 + at(1)).alias("cy"), F.abs(at(2)).alias("w"),
        F.abs(at(3)).alias("h"), at(4).alias("c0"), at(5).alias("c1"), at(6).alias("c2"),
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of two variants: variant, image, ord, label, score, l, t, r, b."""
    g = grid(spark, sf_dir).withColumn("v", F.explode(F.array(F.lit(0), F.lit(1))))
    c, p, s, v = F.col("col"), F.col("p"), F.col("s"), F.col("v")
    kept = ~((v == 1) & ((p + c) % 13 == 0))
    left, top = 100 * c + (p + c) % 7 + v * (s % 12), 20 * F.col("row_id") + s % 5 + v * (p % 3)
    return g.where(kept).select(
        F.when(v == 0, "baseline").otherwise("candidate").alias("variant"),
        F.col("table_id").alias("image"),
        (F.col("row_id") * 4 + c).alias("ord"),
        F.when((p + c) % 9 == 0, "empty").when(c == 0, "head").otherwise("text").alias("label"),
        (((p * 7 + c + v * (s % 2)) % 100) / 100).alias("score"),
        left.cast("double").alias("l"),
        top.cast("double").alias("t"),
        (left + 60 + F.col("q") % 20).cast("double").alias("r"),
        (top + 14).cast("double").alias("b"),
    )


def timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document, stage, run, ms (integers)."""
    order = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").cast("long").alias("document"),
        F.col("event_type").alias("stage"),
        (F.row_number().over(order) - 1).cast("long").alias("run"),
        (F.col("event_id") % 997).cast("long").alias("ms"),
    )


_GRID = "SELECT r.*, CAST(c.col AS BIGINT) AS col FROM fx_row r, (VALUES (0),(1),(2),(3)) c(col)"
CTE = {
    "fx_row": """SELECT CAST(l_orderkey AS BIGINT) AS table_id, CAST(row_number() OVER (PARTITION BY l_orderkey
        ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS BIGINT) AS row_id, CAST(l_partkey AS BIGINT) AS p,
        CAST(l_suppkey AS BIGINT) AS s, CAST(l_quantity AS BIGINT) AS q FROM lineitem""",
    "fx_grid": _GRID,
    "fx_table_cell": """SELECT table_id, row_id*4+col AS cell_id, row_id, col AS column_id,
        CAST(100*col+(p+col)%7 AS DOUBLE) AS l, CAST(20*row_id+s%5 AS DOUBLE) AS t,
        CAST(100*col+(p+col)%7+60+q%20 AS DOUBLE) AS r, CAST(20*row_id+s%5+14 AS DOUBLE) AS b,
        CAST(CASE WHEN (p+col)%9=0 THEN 1 ELSE 2 END AS BIGINT) AS cell_class,
        CASE WHEN row_id=0 THEN 'ched' WHEN col=0 THEN 'rhed' ELSE 'fcel' END AS label,
        CAST(CASE WHEN (p+3*col)%10=0 AND col<3 THEN 2 END AS BIGINT) AS colspan_val,
        CAST(CASE WHEN (p+3*col)%10=0 AND col<3 THEN 1 END AS BIGINT) AS rowspan_val FROM fx_grid""",
    "fx_pdf_cell": """SELECT table_id, row_id*4+col AS pdf_cell_id, CAST(x AS DOUBLE) AS l, CAST(y AS DOUBLE) AS t,
        CAST(x + CASE WHEN (s+col)%17=0 THEN 12 ELSE 30+q%15 END AS DOUBLE) AS r, CAST(y+10 AS DOUBLE) AS b,
        CASE WHEN (p+col)%23=0 THEN '' ELSE 'w' || p END AS text
        FROM (SELECT *, 100*col+(s*3+col)%25-10+CASE WHEN (s+col)%17=0 THEN 85 ELSE 0 END AS x, 20*row_id+p%9-4 AS y
              FROM fx_grid WHERE (p+2*col)%11<>0)""",
    "fx_otsl": """SELECT table_id, row_id*16+col AS pos, CASE WHEN row_id=0 AND col=0 AND p%19=0 THEN 'lcel' WHEN row_id=0 AND col=0 AND p%19=1 THEN 'xcel'
        WHEN col>0 AND (p+3*col+5*row_id)%6=0 THEN 'lcel' WHEN col>0 AND (p+3*col+5*row_id)%6=1 AND s%3=0 THEN 'xcel'
        WHEN row_id>0 AND (s+col)%5=0 THEN 'ucel' WHEN row_id>0 AND col>0 AND (s+col)%5=1 AND p%2=0 THEN 'xcel'
        WHEN row_id=0 OR (row_id=2 AND p%4=0) THEN 'ched' WHEN col=0 THEN 'rhed' WHEN p%13=0 THEN 'srow'
        WHEN (p*col)%8=0 THEN 'ecel' ELSE 'fcel' END AS tag
        FROM (SELECT *, unnest(range(CAST(3+table_id%4 AS BIGINT))) AS col FROM fx_row) WHERE (col=0 OR (p+s+col)%23<>0) AND (row_id=0 OR s%29<>0)
        UNION ALL SELECT table_id, row_id*16+15, 'nl' FROM fx_row""",
    "fx_pred_box": """SELECT table_id, k AS pos, 0.5+CAST(e[(k*4)%64+1] AS DOUBLE) AS cx, 0.5+CAST(e[(k*4+1)%64+1] AS DOUBLE) AS cy,
        abs(CAST(e[(k*4+2)%64+1] AS DOUBLE)) AS w, abs(CAST(e[(k*4+3)%64+1] AS DOUBLE)) AS h, CAST(e[(k*4+4)%64+1] AS DOUBLE) AS c0,
        CAST(e[(k*4+5)%64+1] AS DOUBLE) AS c1, CAST(e[(k*4+6)%64+1] AS DOUBLE) AS c2
        FROM (SELECT CAST(vec_id AS BIGINT) AS table_id, embedding AS e, unnest(range(16)) AS k FROM embeddings)""",
    "fx_detection": """SELECT CASE WHEN v=0 THEN 'baseline' ELSE 'candidate' END AS variant, table_id AS image, row_id*4+col AS ord,
        CASE WHEN (p+col)%9=0 THEN 'empty' WHEN col=0 THEN 'head' ELSE 'text' END AS label,
        ((p*7+col+v*(s%2))%100)/100.0::DOUBLE AS score, CAST(100*col+(p+col)%7+v*(s%12) AS DOUBLE) AS l,
        CAST(20*row_id+s%5+v*(p%3) AS DOUBLE) AS t, CAST(100*col+(p+col)%7+v*(s%12)+60+q%20 AS DOUBLE) AS r,
        CAST(20*row_id+s%5+v*(p%3)+14 AS DOUBLE) AS b
        FROM fx_grid, (VALUES (0),(1)) w(v) WHERE NOT (v=1 AND (p+col)%13=0)""",
    "fx_timing": """SELECT CAST(user_id AS BIGINT) AS document, event_type AS stage, CAST(row_number() OVER (PARTITION BY user_id, event_type
        ORDER BY ts, event_id) - 1 AS BIGINT) AS run, CAST(event_id % 997 AS BIGINT) AS ms FROM events""",
}

CTE["fx_big_row"] = CTE["fx_row"].replace("l_orderkey AS BIGINT", "l_suppkey*10+l_linenumber AS BIGINT").replace("PARTITION BY l_orderkey", "PARTITION BY l_suppkey*10+l_linenumber")
for _name in ("grid", "table_cell", "pdf_cell"):
    CTE[f"fx_big_{_name}"] = CTE[f"fx_{_name}"].replace("fx_row", "fx_big_row").replace("fx_grid", "fx_big_grid")


def with_ctes(sql: str) -> str:
    """``sql`` behind the common table expressions."""
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in CTE.items()) + (",\n" + sql[5:] if sql.startswith("WITH ") else "\n" + sql)
