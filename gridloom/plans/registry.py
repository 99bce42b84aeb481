"""Queries over the derived table-structure inputs, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import assemble, decode, evaluate, match, otsl, postprocess
from ..operators.lineage import cut, within_tables
from ..operators.match import T
from ..sources import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

INTER = "(least(c.r,p.r)-greatest(c.l,p.l))*(least(c.b,p.b)-greatest(c.t,p.t))"
OVER = "c.table_id=p.table_id AND c.l<p.r AND p.l<c.r AND c.t<p.b AND p.t<c.b"


def _match(cells: str, tokens: str) -> str:
    return f"SELECT DISTINCT c.table_id, p.pdf_cell_id, c.cell_id, {INTER}/((p.r-p.l)*(p.b-p.t)) AS iopdf FROM {cells} c JOIN {tokens} p ON {OVER}"


def _medians(y: str, where: str, source: str) -> str:
    return f"""SELECT g.table_id, g.column_id, median(CASE a.alignment WHEN 'left' THEN l WHEN 'middle' THEN (l+r)/2 ELSE r END) AS x,
      median({y}) AS y, median(r-l) AS w, median(b-t) AS h FROM {source} g JOIN align a USING (table_id, column_id) WHERE {where} GROUP BY ALL"""


def _moved(w: str, t: str, b: str, med: str) -> str:
    left = "CASE coalesce(a.alignment,'left') WHEN 'left' THEN coalesce(m.x,0) WHEN 'middle' THEN coalesce(m.x,0)-({w})/2 ELSE coalesce(m.x,0)-({w}) END".format(w=w)
    return f"""SELECT g.table_id, g.cell_id, g.row_id, g.column_id, CASE WHEN is_good THEN l ELSE {left} END AS l, CASE WHEN is_good THEN t ELSE {t} END AS t,
      CASE WHEN is_good THEN r ELSE {left}+({w}) END AS r, CASE WHEN is_good THEN b ELSE {b} END AS b, cell_class, label, colspan_val, rowspan_val
      FROM good g LEFT JOIN align a USING (table_id, column_id) LEFT JOIN {med} m USING (table_id, column_id)"""


def _scores(cells: str, first: str, again: str) -> str:
    return f"""SELECT d.table_id, d.column_id, coalesce(sum(iopdf),0) AS score,
      coalesce(list_sort(list_distinct(list(pdf_cell_id) FILTER (pdf_cell_id IS NOT NULL))), []) AS tokens
      FROM (SELECT table_id, unnest(range(max(column_id)+1)) AS column_id FROM {cells} GROUP BY table_id) d
      LEFT JOIN (SELECT c.table_id, c.column_id, u.pdf_cell_id, u.iopdf FROM (SELECT * FROM {first} UNION ALL SELECT * FROM {again}) u
                 JOIN {cells} c USING (table_id, cell_id)) x USING (table_id, column_id) GROUP BY ALL"""


_LINE = """SELECT d.table_id, d.{k}, coalesce(min({lo}),-1) AS lo, coalesce(max({hi}),-1) AS hi
  FROM (SELECT table_id, unnest(range(max({k})+1)) AS {k} FROM boxed GROUP BY table_id) d
  LEFT JOIN (SELECT * FROM boxed WHERE cell_class>1 AND colspan_val IS NULL AND rowspan_val IS NULL) c USING (table_id, {k}) GROUP BY ALL"""
_NEAR = """SELECT table_id, pdf_cell_id, {k}, depth FROM (SELECT o.table_id, o.pdf_cell_id, x.{k}, round_even(abs((x.lo+x.hi)/2-(o.{lo}+o.{hi})/2),0) AS depth,
  row_number() OVER (PARTITION BY o.table_id, o.pdf_cell_id ORDER BY round_even(abs((x.lo+x.hi)/2-(o.{lo}+o.{hi})/2),0), x.{k}) AS rn
  FROM lost o JOIN {band} x ON o.table_id=x.table_id AND o.{lo}<=x.hi AND o.{hi}>=x.lo) WHERE rn=1"""

CELL5, CELL6 = "('fcel','ecel','ched','rhed','srow')", "('fcel','ecel','ched','rhed','srow','xcel')"


def _registry(n: str, tags: str) -> dict[str, str]:
    """Two-dimensional spans in row order, each kept if it meets none kept before, and the spans of cells with ``tags``."""
    return {
        f"cand{n}": f"SELECT table_id, row_id, column_id, rt, dn, row_number() OVER (PARTITION BY table_id ORDER BY row_id, column_id) AS k FROM reach WHERE nt='xcel' AND tag IN {tags}",
        f"reg{n}": f"""SELECT DISTINCT table_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(y BIGINT, x BIGINT, d BIGINT, r BIGINT)[]) AS acc FROM cand{n}
          UNION ALL SELECT c.table_id, c.k, CASE WHEN len(list_filter(g.acc, lambda a: a.y<c.row_id+c.dn AND c.row_id<a.y+a.d AND a.x<c.column_id+c.rt AND c.column_id<a.x+a.r))>0 THEN g.acc
            ELSE list_append(g.acc, {{'y': c.row_id, 'x': c.column_id, 'd': c.dn, 'r': c.rt}}) END FROM reg{n} g JOIN cand{n} c ON c.table_id=g.table_id AND c.k=g.k+1""",
        f"stand{n}": f"SELECT table_id, a.y AS row_id, a.x AS column_id, true AS stands FROM (SELECT table_id, unnest(arg_max(acc, k)) AS a FROM reg{n} GROUP BY table_id)",
        f"span{n}": f"""SELECT r.table_id, r.row_id, r.column_id, r.tag, CASE WHEN nt='lcel' THEN rt ELSE 1 END AS wide, CASE WHEN bt='ucel' THEN dn ELSE 1 END AS tall,
          CASE WHEN nt='xcel' THEN rt ELSE 1 END AS xwide, CASE WHEN nt='xcel' THEN dn ELSE 1 END AS xtall, coalesce(nt='xcel',false) AND s.stands IS NULL AS cancelled, coalesce(s.stands,false) AS stands,
          greatest(CASE WHEN nt='lcel' THEN rt ELSE 1 END, CASE WHEN s.stands AND nt='xcel' THEN rt ELSE 1 END) AS colspan,
          greatest(CASE WHEN bt='ucel' THEN dn ELSE 1 END, CASE WHEN s.stands AND nt='xcel' THEN dn ELSE 1 END) AS rowspan
          FROM reach r LEFT JOIN stand{n} s USING (table_id, row_id, column_id) WHERE tag IN {tags}""",
    }


#: Steps of the SQL equivalents, in order; a query names the last that it needs.
STEPS = {
    "tok": "SELECT * FROM fx_pdf_cell WHERE text<>''",
    "m": _match("fx_table_cell", "tok"),
    "best0": "SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY table_id, pdf_cell_id ORDER BY iopdf DESC, cell_id) AS rn FROM m) WHERE rn=1",
    "good": """SELECT c.*, coalesce(h.hits,0) AS hits, cell_class>1 AND coalesce(h.hits,0)>0 AS is_good FROM fx_table_cell c
      LEFT JOIN (SELECT table_id, cell_id, count(*) AS hits FROM m GROUP BY ALL) h USING (table_id, cell_id)""",
    "align": """SELECT table_id, column_id, CASE WHEN dl<=dm AND dl<=dr THEN 'left' WHEN dm<=dr THEN 'middle' ELSE 'right' END AS alignment FROM (
      SELECT table_id, column_id, max(l)-min(l) AS dl, max((l+r)/2)-min((l+r)/2) AS dm, max(r)-min(r) AS dr FROM good WHERE is_good GROUP BY ALL)""",
    "med": _medians("t", "is_good AND colspan_val IS NULL AND rowspan_val IS NULL", "(SELECT *, unnest(range(hits)) AS k FROM good)"),
    "med_s": _medians("(t+b)/2", "is_good", "good"),
    "moved": _moved("r-l", "t", "b", "med"),
    "moved_s": _moved("coalesce(m.w,0)", "(t+b)/2-coalesce(m.h,0)/2", "(t+b)/2+coalesce(m.h,0)/2", "med_s"),
    "again": _match("moved", "tok"),
    "score": _scores("moved", "m", "again"),
    "gone": """SELECT DISTINCT table_id, CASE WHEN score<ns THEN column_id ELSE column_id+1 END AS column_id FROM (
      SELECT *, lead(tokens) OVER w AS nt, lead(score) OVER w AS ns FROM score WINDOW w AS (PARTITION BY table_id ORDER BY column_id))
      WHERE nt IS NOT NULL AND len(tokens)>0 AND len(list_intersect(tokens, nt))/len(tokens)>0.6""",
    "kept": "SELECT c.* FROM moved c ANTI JOIN gone g USING (table_id, column_id)",
    "best": """SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY table_id, pdf_cell_id ORDER BY iopdf DESC, cell_id) AS rn
      FROM again SEMI JOIN kept USING (table_id, cell_id)) WHERE rn=1""",
    "many": "SELECT table_id FROM tok GROUP BY table_id HAVING count(*)>300",
    "boxed": """SELECT c.table_id, c.cell_id, c.row_id, c.column_id, h.l, h.t, h.r, h.b, c.cell_class, c.label, c.colspan_val, c.rowspan_val
      FROM kept c JOIN (SELECT b.table_id, b.cell_id, min(l) AS l, min(t) AS t, max(r) AS r, max(p.b) AS b FROM best b JOIN tok p USING (table_id, pdf_cell_id) GROUP BY ALL) h
      USING (table_id, cell_id) WHERE c.table_id NOT IN (SELECT table_id FROM many)
      UNION ALL SELECT table_id, cell_id, row_id, column_id, l, t, r, b, cell_class, label, colspan_val, rowspan_val FROM kept WHERE table_id IN (SELECT table_id FROM many)""",
    "lost": "SELECT p.* FROM tok p ANTI JOIN best b USING (table_id, pdf_cell_id)",
    "band_r": _LINE.format(k="row_id", lo="t", hi="b"),
    "band_c": _LINE.format(k="column_id", lo="l", hi="r"),
    "near_r": _NEAR.format(k="row_id", lo="t", hi="b", band="band_r"),
    "near_c": _NEAR.format(k="column_id", lo="l", hi="r", band="band_c"),
    "spot": """SELECT s.*, f.cell_id AS old_id, d.top FROM (
        SELECT r.table_id, r.row_id, c.column_id, min(o.pdf_cell_id) AS least, min(l) AS l, min(t) AS t, max(o.r) AS r, max(b) AS b
        FROM near_r r JOIN near_c c USING (table_id, pdf_cell_id) JOIN lost o USING (table_id, pdf_cell_id) GROUP BY ALL) s
      LEFT JOIN (SELECT table_id, row_id, column_id, min(cell_id) AS cell_id FROM boxed GROUP BY ALL) f USING (table_id, row_id, column_id)
      JOIN (SELECT table_id, max(cell_id) AS top FROM boxed GROUP BY ALL) d USING (table_id)""",
    "spots": "SELECT *, coalesce(old_id, top + dense_rank() OVER (PARTITION BY table_id, old_id IS NULL ORDER BY least)) AS cell_id FROM spot",
    "final": """SELECT c.table_id, c.cell_id, c.row_id, c.column_id, least(c.l,s.l) AS l, least(c.t,s.t) AS t, greatest(c.r,s.r) AS r, greatest(c.b,s.b) AS b,
        c.cell_class, c.label, c.colspan_val, c.rowspan_val FROM boxed c LEFT JOIN (SELECT * FROM spots WHERE old_id IS NOT NULL) s USING (table_id, cell_id)
      UNION ALL SELECT table_id, cell_id, row_id, column_id, l, t, r, b, 2, 'body', NULL, NULL FROM spots WHERE old_id IS NULL""",
    "final_m": """SELECT table_id, pdf_cell_id, cell_id, iopdf FROM best UNION ALL
      SELECT r.table_id, r.pdf_cell_id, s.cell_id, 1.0 FROM near_r r JOIN near_c c USING (table_id, pdf_cell_id) JOIN spots s ON s.table_id=r.table_id AND s.row_id=r.row_id AND s.column_id=c.column_id""",
    "dummy": """SELECT table_id, cell_id, coalesce(rowspan_val,1) AS row_span, coalesce(colspan_val,1) AS col_span, row_id AS start_row, row_id+coalesce(rowspan_val,1) AS end_row,
      column_id AS start_col, column_id+coalesce(colspan_val,1) AS end_col, label='ched' AS column_header, label='rhed' AS row_header, label='srow' AS row_section, l, t, r, b FROM {cells}""",
    "again_s": _match("moved_s", "tok"),
    "g": """SELECT *, CAST(row_number() OVER (PARTITION BY table_id, row_id ORDER BY pos)-1 AS BIGINT) AS column_id FROM (
      SELECT table_id, pos, tag, CAST(coalesce(sum(CASE WHEN tag='nl' THEN 1 ELSE 0 END) OVER (PARTITION BY table_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS BIGINT) AS row_id,
        CASE WHEN tag IN ('fcel','ecel','ched','rhed','srow','xcel') THEN CAST(sum(CASE WHEN tag IN ('fcel','ecel','ched','rhed','srow','xcel') THEN 1 ELSE 0 END)
          OVER (PARTITION BY table_id ORDER BY pos ROWS UNBOUNDED PRECEDING)-1 AS BIGINT) END AS cell_id FROM fx_otsl) WHERE tag<>'nl'""",
    "opening": "SELECT table_id, arg_min(tag, pos) AS first_tag FROM fx_otsl GROUP BY table_id",
    "gd": "SELECT table_id, tag, column_id, CAST(dense_rank() OVER (PARTITION BY table_id ORDER BY row_id)-1 AS BIGINT) AS row_id FROM g",
    "gd_len": "SELECT table_id, row_id, count(*) AS n FROM gd GROUP BY ALL",
    "squared": """SELECT table_id, row_id, column_id, tag FROM gd UNION ALL SELECT table_id, row_id, unnest(range(n, most)) AS column_id, 'lcel' FROM (
      SELECT *, max(n) OVER (PARTITION BY table_id) AS most FROM gd_len) WHERE n<most""",
    "reach": """SELECT *, lead(tag) OVER h AS nt, lead(tag) OVER v AS bt,
        CAST(coalesce(min(CASE WHEN tag NOT IN ('lcel','xcel') THEN column_id END) OVER (h ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), max(column_id) OVER (PARTITION BY table_id,row_id)+1)-column_id AS BIGINT) AS rt,
        CAST(coalesce(min(CASE WHEN tag NOT IN ('ucel','xcel') THEN row_id END) OVER (v ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), max(row_id) OVER (PARTITION BY table_id,column_id)+1)-row_id AS BIGINT) AS dn
      FROM squared WINDOW h AS (PARTITION BY table_id,row_id ORDER BY column_id), v AS (PARTITION BY table_id,column_id ORDER BY row_id)""",
    **{k: v for n, tags in (("5", CELL5), ("6", CELL6)) for k, v in _registry(n, tags).items()},
    "head": """SELECT table_id, row_id, has AND NOT was AS opens, was AND NOT has AS closes FROM (SELECT *, coalesce(lag(has) OVER (PARTITION BY table_id ORDER BY row_id), false) AS was
      FROM (SELECT table_id, row_id, bool_or(tag='ched') AS has FROM squared GROUP BY ALL))""",
    "box": "SELECT table_id, pos, cx-w/2 AS l, cy-h/2 AS t, cx+w/2 AS r, cy+h/2 AS b FROM fx_pred_box",
    "pair": """SELECT a.image, a.k, (greatest(least(a.r,b.r)-greatest(a.l,b.l),0)*greatest(least(a.b,b.b)-greatest(a.t,b.t),0)) AS i, (a.r-a.l)*(a.b-a.t)+(b.r-b.l)*(b.b-b.t) AS u,
        a.label=b.label AS same, abs(a.score-b.score) AS d_score
      FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY ord) AS k FROM fx_detection WHERE variant='baseline') a
      JOIN (SELECT *, row_number() OVER (PARTITION BY image ORDER BY ord) AS k FROM fx_detection WHERE variant='candidate') b ON a.image=b.image AND a.k=b.k""",
    "pairs": "SELECT *, CASE WHEN u-i>0 THEN i/(u-i) ELSE 0 END AS iou FROM pair",
    "means": "SELECT document, stage, avg(ms) AS ms FROM fx_timing WHERE run>=1 AND run<6 GROUP BY ALL",
}


def steps(sql: str, **names: str) -> str:
    """``sql`` behind the inputs and steps that it names, directly or through others."""
    known = fx.CTE | {k: v.format(**names) if "{cells}" in v and names else v for k, v in STEPS.items()}
    import re

    need, queue = set(), [sql]
    while queue:
        for word in set(re.findall(r"\w+", queue.pop())):
            if word in known and word not in need:
                need.add(word)
                queue.append(known[word])
    parts = [f"{k} AS ({v})" for k, v in known.items() if k in need]
    if sql.startswith("WITH "):
        return "WITH RECURSIVE " + ",\n".join([*parts, sql[5:]])
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + sql if parts else sql


def query(name: str, sql: str | None = None, **names: str):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = steps(sql, **names)
        return f

    return keep


def _r(*columns: str, places: int = 6):
    return [F.round(c, places).alias(c) for c in columns]


def _r_scaled(column: str, places: int = 6):
    """Rounded as DuckDB does it, by the scaled double: 0.5203125 lies below its decimal digits and goes down."""
    return (F.round(F.col(column) * 10.0**places) / 10.0**places).alias(column)


class In:
    """The derived inputs of one folder, and results that several queries share."""

    def __init__(self, spark: SparkSession, sf: str) -> None:
        self.spark, self.cells, self.pdf = spark, fx.table_cells(spark, sf), fx.pdf_cells(spark, sf)
        self.tok = match.drop_empty_tokens(self.pdf)

    def good(self):
        m = cut(match.intersection_over_token(self.cells, self.tok))
        g = postprocess.good_cells(self.cells, m)
        return m, g, postprocess.column_alignment(g)

    def moved(self, simple: bool = False):
        """Matches and moved cells. Nothing is stored or dealt anew: the rows of an order are dealt once, and all steps work within it."""
        within_tables(self.spark)
        m = match.intersection_over_token(self.cells, self.tok)
        return m, postprocess.moved_in_place(postprocess.good_cells(self.cells, m), simple)

    def scores(self):
        """Moved cells and the scores of their columns; ids and columns are those of the cells before moving."""
        m, moved = self.moved()
        return moved, postprocess.column_scores(self.cells, m, match.intersection_over_token(moved, self.tok))


@query("flagship_best_match", "SELECT table_id, pdf_cell_id, cell_id, round(iopdf,6) AS iopdf FROM best0")
def flagship(spark, sf):
    i = In(spark, sf)
    return match.best_match(match.intersection_over_token(i.cells, i.tok)).select(T, "pdf_cell_id", "cell_id", *_r("iopdf"))


@query("pf1_drop_empty_tokens", "SELECT * FROM tok")
def _(spark, sf):
    return In(spark, sf).tok


@query("j1_overlap_match", "SELECT table_id, pdf_cell_id, cell_id, round(iopdf,6) AS iopdf FROM m")
def _(spark, sf):
    i = In(spark, sf)
    return match.intersection_over_token(i.cells, i.tok).select(T, "pdf_cell_id", "cell_id", *_r("iopdf"))


@query("j2_iou_match", f"""SELECT table_id, pdf_cell_id, cell_id, round(iou,6) AS iou, text FROM (
    SELECT c.table_id, p.pdf_cell_id, c.cell_id, p.text, {INTER}/((c.r-c.l)*(c.b-c.t)+(p.r-p.l)*(p.b-p.t)-{INTER}) AS iou FROM fx_table_cell c JOIN tok p ON {OVER}) WHERE iou>=0.05""")
def _(spark, sf):
    i = In(spark, sf)
    return match.iou_matches(i.cells, i.tok).select(T, "pdf_cell_id", "cell_id", *_r("iou"), "text")


@query("o3_ranked_matches", "SELECT table_id, pdf_cell_id, cell_id, round(iopdf,6) AS iopdf, CAST(row_number() OVER (PARTITION BY table_id, pdf_cell_id ORDER BY iopdf DESC, cell_id)-1 AS BIGINT) AS match_ord FROM m")
def _(spark, sf):
    i = In(spark, sf)
    return match.ranked_matches(match.intersection_over_token(i.cells, i.tok)).select(T, "pdf_cell_id", "cell_id", *_r("iopdf"), "match_ord")


@query("j9_orphans", "SELECT p.* FROM tok p ANTI JOIN m USING (table_id, pdf_cell_id)")
def _(spark, sf):
    i = In(spark, sf)
    return match.orphans(i.tok, match.intersection_over_token(i.cells, i.tok)).select(*i.tok.columns)


@query("a1_dimensions", "SELECT table_id, greatest(max(column_id)+1,1) AS n_columns, greatest(max(row_id)+1,1) AS n_rows, greatest(max(cell_id),0) AS max_cell_id FROM fx_table_cell GROUP BY ALL")
def _(spark, sf):
    return postprocess.dimensions(In(spark, sf).cells)


@query("pf10_good_cells", "SELECT table_id, cell_id, hits, is_good FROM good")
def _(spark, sf):
    return In(spark, sf).good()[1].select(T, "cell_id", "hits", "is_good")


@query("a2_column_alignment", "SELECT * FROM align")
def _(spark, sf):
    return In(spark, sf).good()[2]


@query("a3_column_medians", "SELECT table_id, column_id, round(x,6) AS x, round(y,6) AS y, round(w,6) AS w, round(h,6) AS h FROM med")
def _(spark, sf):
    _, g, a = In(spark, sf).good()
    return postprocess.column_medians(g, a).select(T, "column_id", *_r("x", "y", "w", "h"))


@query("a3_column_medians_simplified", "SELECT table_id, column_id, round(x,6) AS x, round(y,6) AS y, round(w,6) AS w, round(h,6) AS h FROM med_s")
def _(spark, sf):
    _, g, a = In(spark, sf).good()
    return postprocess.column_medians_simplified(g, a).select(T, "column_id", *_r("x", "y", "w", "h"))


_BOX = "round(l,6) AS l, round(t,6) AS t, round(r,6) AS r, round(b,6) AS b"


@query("g12_move_bad_cells", f"SELECT table_id, cell_id, {_BOX} FROM moved")
def _(spark, sf):
    return In(spark, sf).moved()[1].select(T, "cell_id", *_r(*"ltrb"))


@query("g12_move_bad_cells_simplified", f"SELECT table_id, cell_id, {_BOX} FROM moved_s")
def _(spark, sf):
    return In(spark, sf).moved(True)[1].select(T, "cell_id", *_r(*"ltrb"))


@query("a4_column_scores", "SELECT table_id, column_id, round(score,8) AS score, CAST(len(tokens) AS BIGINT) AS n_tokens, coalesce(array_to_string(tokens, ','),'') AS tokens FROM score")
def _(spark, sf):
    s = In(spark, sf).scores()[1]
    return s.select(T, "column_id", *_r("score", places=8), F.size("tokens").cast("long").alias("n_tokens"), F.array_join(F.col("tokens").cast("array<string>"), ",").alias("tokens"))


@query("w6_duplicate_columns", "SELECT * FROM gone")
def _(spark, sf):
    return postprocess.duplicate_columns(In(spark, sf).scores()[1])


@query("pf11_delete_columns", "SELECT table_id, cell_id, column_id FROM kept")
def _(spark, sf):
    moved, scores = In(spark, sf).scores()
    gone = postprocess.duplicate_columns(scores)
    return postprocess.without_columns(moved, gone).select(T, "cell_id", "column_id")


@query("a6_token_hulls", "SELECT b.table_id, b.cell_id, min(l) AS l, min(t) AS t, max(r) AS r, max(p.b) AS b FROM best0 b JOIN tok p USING (table_id, pdf_cell_id) GROUP BY ALL")
def _(spark, sf):
    i = In(spark, sf)
    best = match.best_match(match.intersection_over_token(i.cells, i.tok))
    return postprocess.token_boxes(i.cells, best, i.tok).select(T, "cell_id", *"ltrb")


@query("j8_first_token_boxes", """SELECT c.table_id, c.cell_id, coalesce(x.l,c.l) AS l, coalesce(x.t,c.t) AS t, coalesce(x.r,c.r) AS r, coalesce(x.b,c.b) AS b FROM fx_table_cell c
  LEFT JOIN (SELECT * FROM (SELECT b0.table_id, b0.cell_id, p.l, p.t, p.r, p.b, row_number() OVER (PARTITION BY b0.table_id, b0.cell_id ORDER BY pdf_cell_id) AS rn
    FROM best0 b0 JOIN tok p USING (table_id, pdf_cell_id)) WHERE rn=1) x USING (table_id, cell_id)""")
def _(spark, sf):
    i = In(spark, sf)
    best = match.best_match(match.intersection_over_token(i.cells, i.tok))
    return postprocess.first_token_boxes(i.cells, best, i.tok).select(T, "cell_id", *"ltrb")


for _line, _lo, _hi in (("row_id", "t", "b"), ("column_id", "l", "r")):

    @query(f"a7_bands_{_line[:-3]}", f"""SELECT d.table_id, d.{_line}, coalesce(min({_lo}),-1) AS lo, coalesce(max({_hi}),-1) AS hi
      FROM (SELECT table_id, unnest(range(max({_line})+1)) AS {_line} FROM fx_table_cell GROUP BY table_id) d
      LEFT JOIN (SELECT * FROM fx_table_cell WHERE cell_class>1 AND colspan_val IS NULL AND rowspan_val IS NULL) c USING (table_id, {_line}) GROUP BY ALL""")
    def _(spark, sf, line=_line, lo=_lo, hi=_hi):
        return postprocess.bands(In(spark, sf).cells, line, lo, hi)


@query("w9_j10_nearest_bands", "SELECT r.table_id, r.pdf_cell_id, r.row_id, c.column_id, c.depth FROM near_r r JOIN near_c c USING (table_id, pdf_cell_id)")
def _(spark, sf):
    boxed, lost = _boxed(spark, sf)
    r = postprocess.nearest_band(lost, postprocess.bands(boxed, "row_id", "t", "b"), "row_id", "t", "b").drop("depth")
    c = postprocess.nearest_band(lost, postprocess.bands(boxed, "column_id", "l", "r"), "column_id", "l", "r")
    return r.join(c, [T, "pdf_cell_id"])


def _boxed(spark, sf):
    i = In(spark, sf)
    boxed, _, lost = postprocess.refined(i.cells, i.tok)
    return boxed, lost


@query("w10_j11_place_orphans", "SELECT table_id, row_id, column_id, cell_id FROM spots WHERE old_id IS NULL")
def _(spark, sf):
    boxed, lost = _boxed(spark, sf)
    cells, _ = postprocess.place_orphans(boxed, lost)
    return cells.where("label = 'body'").select(T, "row_id", "column_id", "cell_id")


_CELLS = f"SELECT table_id, cell_id, row_id, column_id, {_BOX}, CAST(cell_class AS BIGINT) AS cell_class, label FROM "


@query("postprocess_canonical_cells", _CELLS + "final")
def _(spark, sf):
    i = In(spark, sf)
    return postprocess.run(i.cells, i.pdf)[0].select(T, "cell_id", "row_id", "column_id", *_r(*"ltrb"), "cell_class", "label")


@query("postprocess_canonical_matches", "SELECT table_id, pdf_cell_id, cell_id, round(iopdf,6) AS iopdf FROM final_m")
def _(spark, sf):
    i = In(spark, sf)
    return postprocess.run(i.cells, i.pdf)[1].select(T, "pdf_cell_id", "cell_id", *_r("iopdf"))


#: The simplified dialect, from ``moved_s`` on: matches counted once more for scores, first tokens' boxes, orphans as cells of their own.
_SIMPLE = f"""WITH ts AS (SELECT * FROM fx_pdf_cell WHERE trim(text)<>''), ags AS (SELECT DISTINCT c.table_id, p.pdf_cell_id, c.cell_id, {INTER}/((p.r-p.l)*(p.b-p.t)) AS iopdf FROM moved_s c JOIN ts p ON {OVER}),
  scs AS ({_scores("moved_s", "ags", "ags")}), gos AS (SELECT DISTINCT table_id, CASE WHEN score<ns THEN column_id ELSE column_id+1 END AS column_id FROM (
    SELECT *, lead(tokens) OVER w AS nt, lead(score) OVER w AS ns FROM scs WINDOW w AS (PARTITION BY table_id ORDER BY column_id)) WHERE nt IS NOT NULL AND len(tokens)>0 AND len(list_intersect(tokens, nt))/len(tokens)>0.6),
  kes AS (SELECT c.* FROM moved_s c ANTI JOIN gos USING (table_id, column_id)),
  bes AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY table_id, pdf_cell_id ORDER BY iopdf DESC, cell_id) AS rn FROM ags SEMI JOIN kes USING (table_id, cell_id)) WHERE rn=1),
  fis AS (SELECT * FROM (SELECT b.table_id, b.cell_id, p.l, p.t, p.r, p.b, row_number() OVER (PARTITION BY b.table_id, b.cell_id ORDER BY pdf_cell_id) AS rn FROM bes b JOIN ts p USING (table_id, pdf_cell_id)) WHERE rn=1),
  bos AS (SELECT c.table_id, c.cell_id, c.row_id, c.column_id, coalesce(x.l,c.l) AS l, coalesce(x.t,c.t) AS t, coalesce(x.r,c.r) AS r, coalesce(x.b,c.b) AS b, c.cell_class, c.label FROM kes c LEFT JOIN fis x USING (table_id, cell_id)),
  los AS (SELECT p.*, row_number() OVER (PARTITION BY table_id ORDER BY pdf_cell_id) AS rn FROM ts p ANTI JOIN bes USING (table_id, pdf_cell_id))"""


@query("postprocess_simplified_cells", _SIMPLE + f""" SELECT table_id, cell_id, row_id, column_id, {_BOX}, cell_class, label FROM bos
  UNION ALL SELECT o.table_id, d.m+o.rn, 0, 0, o.l, o.t, o.r, o.b, 2, 'body' FROM los o JOIN (SELECT table_id, greatest(max(cell_id),0) AS m FROM bos GROUP BY table_id) d USING (table_id)""")
def _(spark, sf):
    i = In(spark, sf)
    return postprocess.run(i.cells, i.pdf, "simplified")[0].select(T, "cell_id", "row_id", "column_id", *_r(*"ltrb"), "cell_class", "label")


@query("postprocess_simplified_matches", _SIMPLE + """ SELECT table_id, pdf_cell_id, cell_id, round(iopdf,6) AS iopdf FROM bes
  UNION ALL SELECT o.table_id, o.pdf_cell_id, d.m+o.rn, 1.0 FROM los o JOIN (SELECT table_id, greatest(max(cell_id),0) AS m FROM bos GROUP BY table_id) d USING (table_id)""")
def _(spark, sf):
    i = In(spark, sf)
    return postprocess.run(i.cells, i.pdf, "simplified")[1].select(T, "pdf_cell_id", "cell_id", _r_scaled("iopdf"))


@query("sq6_overlap_correction")
def _(spark, sf):
    return postprocess.correct_overlaps(In(spark, sf).cells).select(T, "cell_id", *"ltrb")


@query("pf17_dummy_responses", "SELECT * FROM dummy", cells="fx_table_cell")
def _(spark, sf):
    return assemble.dummy_responses(In(spark, sf).cells)


@query("pf18_fallback_boxes", "SELECT table_id, cell_id, CASE WHEN gap THEN 0 ELSE l END AS l, CASE WHEN gap THEN 0 ELSE t END AS t, CASE WHEN gap THEN 0 ELSE r END AS r, CASE WHEN gap THEN 0 ELSE b END AS b FROM (SELECT *, cell_class=1 AND label='ched' AS gap FROM fx_table_cell)")
def _(spark, sf):
    """Cells of class 1 have no box of their own; predictions are missing for heads."""
    c = In(spark, sf).cells
    holes = c.select(T, "cell_id", *(F.when(F.col("cell_class") > 1, F.col(k)).alias(k) for k in "ltrb"))
    return assemble.with_fallback_boxes(holes, c.where("label <> 'ched'"))


_RESP = """SELECT d.table_id, d.start_col, d.start_row, min(d.cell_id) AS cell_id, arg_min(col_span, d.cell_id) AS col_span, arg_min(row_span, d.cell_id) AS row_span,
  arg_min(column_header, d.cell_id) AS column_header, arg_min(row_header, d.cell_id) AS row_header, string_agg(text, ' ' ORDER BY d.cell_id, pdf_cell_id) AS text
  FROM dummy d JOIN final_m USING (table_id, cell_id) JOIN tok USING (table_id, pdf_cell_id) GROUP BY d.table_id, d.start_col, d.start_row"""


@query("a9_responses", _RESP, cells="final")
def _(spark, sf):
    return _responses(spark, sf)


def _responses(spark, sf):
    i = In(spark, sf)
    cells, links = postprocess.run(i.cells, i.pdf)
    return assemble.responses(cells, links, i.tok)


_INDEX = f"SELECT table_id, cell_id, col_span, row_span, CAST(dense_rank() OVER (PARTITION BY table_id ORDER BY start_col)-1 AS BIGINT) AS start_col, CAST(dense_rank() OVER (PARTITION BY table_id ORDER BY start_row)-1 AS BIGINT) AS start_row FROM ({_RESP})"


@query("w8_reindex", f"SELECT *, start_col+col_span AS end_col, start_row+row_span AS end_row FROM ({_INDEX})", cells="final")
def _(spark, sf):
    return assemble.reindexed(_responses(spark, sf)).select(T, "cell_id", "col_span", "row_span", "start_col", "start_row", "end_col", "end_row")


@query("a10_table_sizes", f"SELECT table_id, max(start_col+col_span) AS num_cols, max(start_row+row_span) AS num_rows FROM ({_INDEX}) GROUP BY ALL", cells="final")
def _(spark, sf):
    return assemble.sizes(assemble.reindexed(_responses(spark, sf)))


@query("w1_otsl_grid", "SELECT * FROM g")
def _(spark, sf):
    return otsl.grid(fx.otsl(spark, sf)).select(T, "pos", "tag", "row_id", "cell_id", "column_id")


def _full(spark, sf):
    return otsl.padded(otsl.rows_only(otsl.grid(fx.otsl(spark, sf))))


@query("w2_padded_rows", "SELECT * FROM squared")
def _(spark, sf):
    return _full(spark, sf)


@query("w3_w4_spans", "SELECT table_id, row_id, column_id, tag, wide, tall, xwide, xtall FROM span5")
def _(spark, sf):
    return otsl.spans(_full(spark, sf)).select(T, "row_id", "column_id", "tag", "wide", "tall", "xwide", "xtall")


@query("sq3_registered_spans", "SELECT table_id, row_id, column_id, xwide, xtall, cancelled FROM span5 WHERE xwide>1")
def _(spark, sf):
    return otsl.spans(_full(spark, sf)).where("xwide > 1").select(T, "row_id", "column_id", "xwide", "xtall", "cancelled")


@query("q4_span_map", f"""SELECT table_id, cell_id, colspan, rowspan FROM (SELECT *, CAST(row_number() OVER (PARTITION BY table_id ORDER BY row_id, column_id)-1 AS BIGINT) AS cell_id
  FROM span6 WHERE table_id IN (SELECT table_id FROM opening WHERE first_tag IN {CELL6})) WHERE colspan>1 OR rowspan>1""")
def _(spark, sf):
    return otsl.span_map(fx.otsl(spark, sf))


@query("w5_head_marks", "SELECT * FROM head")
def _(spark, sf):
    return otsl.head_marks(_full(spark, sf))


_ROW = """SELECT h.table_id, string_agg(CASE WHEN closes THEN '</thead>|' ELSE '' END || CASE WHEN opens THEN '<thead>|' ELSE '' END || '<tr>|' || coalesce(x || '|','') || '</tr>', '|' ORDER BY h.row_id) AS html
  FROM head h LEFT JOIN (SELECT table_id, row_id, string_agg(CASE WHEN cancelled OR (wide=1 AND tall=1 AND xwide=1) THEN '<td>|</td>' ELSE '<td'
      || CASE WHEN wide>1 THEN '| colspan="' || wide || '"' ELSE '' END || CASE WHEN tall>1 THEN '| rowspan="' || tall || '"' ELSE '' END
      || CASE WHEN xwide>1 THEN '| rowspan="' || xtall || '"| colspan="' || xwide || '"' ELSE '' END || '|>|</td>' END, '|' ORDER BY column_id) AS x
    FROM span5 GROUP BY ALL) s USING (table_id, row_id) GROUP BY h.table_id"""
_HTML = f"""SELECT * FROM ({_ROW}) WHERE table_id IN (SELECT table_id FROM opening WHERE first_tag IN {CELL5})
  UNION ALL SELECT table_id, string_agg(tag, '|' ORDER BY pos) AS html FROM fx_otsl WHERE table_id NOT IN (SELECT table_id FROM opening WHERE first_tag IN {CELL5}) GROUP BY table_id"""


@query("q2_html", _HTML)
def _(spark, sf):
    return otsl.html(fx.otsl(spark, sf))


@query("q3_cell_html", """SELECT table_id, row_id, column_id, CASE WHEN cancelled OR (wide=1 AND tall=1 AND xwide=1) THEN '<td></td>' ELSE concat('<td',
  CASE WHEN wide>1 THEN concat(' colspan="', wide, '"') END, CASE WHEN tall>1 THEN concat(' rowspan="', tall, '"') END,
  CASE WHEN xwide>1 THEN concat(' rowspan="', xtall, '" colspan="', xwide, '"') END, '></td>') END AS html FROM span5""")
def _(spark, sf):
    return otsl.spans(_full(spark, sf)).select(T, "row_id", "column_id", F.array_join(otsl.cell_html(), "").alias("html"))


@query("q5_html_to_otsl")
def _(spark, sf):
    """Spans as 2-D state go down from row to row, so there is no SQL; hand-worked cases are in the tests."""
    found = otsl.from_html(otsl.html(fx.otsl(spark, sf)))
    return found.withColumn("spans", F.to_json("spans"))


@query("a11_otsl_dimensions", "SELECT table_id, min(CASE WHEN tag='nl' THEN k END) AS n_columns, count(*) FILTER (tag='nl') AS n_rows FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY pos)-1 AS k FROM fx_otsl) GROUP BY table_id")
def _(spark, sf):
    return otsl.dimensions(fx.otsl(spark, sf))


@query("a14_cell_counts", "SELECT table_id, count(*) FILTER (tag IN ('fcel','ecel','ched','rhed','srow')) AS n5, count(*) FILTER (tag IN ('fcel','ecel','ched','rhed','srow','xcel')) AS n6 FROM fx_otsl GROUP BY table_id")
def _(spark, sf):
    return otsl.cell_counts(fx.otsl(spark, sf))


@query("a13_squareness", f"SELECT table_id, min(n)=max(n) AS square FROM gd_len GROUP BY ALL")
def _(spark, sf):
    return otsl.is_square(otsl.grid(fx.otsl(spark, sf)))


@query("q1_pad_to_square", """SELECT table_id, row_id, column_id, tag FROM g UNION ALL SELECT table_id, row_id, unnest(range(n, most)) AS column_id, 'lcel' FROM (
  SELECT *, max(n) OVER (PARTITION BY table_id) AS most FROM (SELECT table_id, row_id, count(*) AS n FROM g GROUP BY ALL)) WHERE n<most""")
def _(spark, sf):
    return otsl.padded(otsl.grid(fx.otsl(spark, sf)))


_FIXED = "SELECT table_id, pos, CASE WHEN t='lcel' AND coalesce(lag(t) OVER (PARTITION BY table_id ORDER BY pos)='ucel', false) THEN 'fcel' ELSE t END AS tag FROM (SELECT *, CASE WHEN tag='xcel'{} THEN 'lcel' ELSE tag END AS t FROM fx_otsl)"


@query("sq1_token_correction", _FIXED.format(""))
def _(spark, sf):
    return decode.corrected(fx.otsl(spark, sf))


@query("sq1_token_correction_simplified", _FIXED.format(" AND pos=first") .replace("FROM fx_otsl", "FROM (SELECT *, min(pos) OVER (PARTITION BY table_id) AS first FROM fx_otsl)"))
def _(spark, sf):
    return decode.corrected(fx.otsl(spark, sf), first_only=True)


_EMIT = """SELECT table_id, pos, tag, first_lcel, CAST(row_number() OVER (PARTITION BY table_id ORDER BY pos)-1 AS BIGINT) AS box_ord FROM (
  SELECT *, tag='lcel' AND b<>'lcel' AS first_lcel, (b NOT IN ('nl','ucel','xcel','<start>') AND tag IN ('fcel','ecel','ched','rhed','srow','nl','ucel')) OR (tag='lcel' AND b<>'lcel') AS emits FROM (
    SELECT *, coalesce(lag(tag) OVER (PARTITION BY table_id ORDER BY pos),'<start>') AS b FROM fx_otsl)) WHERE emits"""


@query("w11_box_emission", _EMIT)
def _(spark, sf):
    return decode.emitted(fx.otsl(spark, sf))


@query("w12_merge_pairs", f"SELECT table_id, box_ord, next_ord FROM (SELECT *, CAST(coalesce(lead(box_ord) OVER (PARTITION BY table_id ORDER BY box_ord),-1) AS BIGINT) AS next_ord FROM ({_EMIT})) WHERE first_lcel")
def _(spark, sf):
    return decode.merge_pairs(decode.emitted(fx.otsl(spark, sf)))


def _boxes(spark, sf):
    p = fx.predicted_boxes(spark, sf)
    half = lambda a, b, s: (F.col(a) + s * F.col(b) / 2)
    return p.select(T, "pos", half("cx", "w", -1).alias("l"), half("cy", "h", -1).alias("t"), half("cx", "w", 1).alias("r"), half("cy", "h", 1).alias("b"))


@query("g5_centre_to_corners", f"SELECT table_id, pos, {_BOX} FROM box")
def _(spark, sf):
    return _boxes(spark, sf).select(T, "pos", *_r(*"ltrb"))


@query("o8_argmax_class", "SELECT table_id, pos, CAST(CASE WHEN c0>=c1 AND c0>=c2 THEN 0 WHEN c1>=c2 THEN 1 ELSE 2 END AS BIGINT) AS cls FROM fx_pred_box")
def _(spark, sf):
    return fx.predicted_boxes(spark, sf).select(T, "pos", decode.argmax(F.array("c0", "c1", "c2")).alias("cls"))


@query("g7_to_page", "SELECT table_id, pos, round(10+200*l,6) AS l, round(20+100*t,6) AS t, round(10+200*r,6) AS r, round(20+100*b,6) AS b FROM box")
def _(spark, sf):
    page = G.to_page(G.box(), tuple(F.lit(x) for x in (10.0, 20.0, 210.0, 120.0)))
    return _boxes(spark, sf).select(T, "pos", *(F.round(v, 6).alias(k) for k, v in zip("ltrb", page)))


@query("g9_round_clamp", """SELECT table_id, pos, x0, y0, greatest(x0,x1) AS x1, greatest(y0,y1) AS y1 FROM (SELECT table_id, pos, greatest(0,least(CAST(round_even(l*100,0) AS BIGINT),90)) AS x0, greatest(0,least(CAST(round_even(t*100,0) AS BIGINT),80)) AS y0,
  greatest(0,least(CAST(round_even(r*100,0) AS BIGINT),90)) AS x1, greatest(0,least(CAST(round_even(b*100,0) AS BIGINT),80)) AS y1 FROM box)""")
def _(spark, sf):
    at = G.round_clamped(G.scaled(G.box(), F.lit(100.0)), F.lit(90), F.lit(80))
    return _boxes(spark, sf).select(T, "pos", *(v.cast("long").alias(k) for k, v in zip(("x0", "y0", "x1", "y1"), at)))


@query("g4_pairwise_iou", """SELECT table_id, pos, other, round(i/u,6) AS iou, round(i/u-(hull-u)/hull,6) AS giou FROM (SELECT a.table_id, a.pos, b.pos AS other,
  greatest(least(a.r,b.r)-greatest(a.l,b.l),0)*greatest(least(a.b,b.b)-greatest(a.t,b.t),0) AS i, (a.r-a.l)*(a.b-a.t)+(b.r-b.l)*(b.b-b.t)-greatest(least(a.r,b.r)-greatest(a.l,b.l),0)*greatest(least(a.b,b.b)-greatest(a.t,b.t),0) AS u,
  (greatest(a.r,b.r)-least(a.l,b.l))*(greatest(a.b,b.b)-least(a.t,b.t)) AS hull FROM box a JOIN box b ON a.table_id=b.table_id AND a.pos<b.pos)""")
def _(spark, sf):
    a, b = _boxes(spark, sf).alias("a"), _boxes(spark, sf).alias("b")
    j = a.join(b, (F.col("a.table_id") == F.col("b.table_id")) & (F.col("a.pos") < F.col("b.pos")))
    x, y = G.box("a."), G.box("b.")
    return j.select(F.col("a.table_id").alias(T), F.col("a.pos").alias("pos"), F.col("b.pos").alias("other"), F.round(G.iou(x, y), 6).alias("iou"), F.round(G.generalised_iou(x, y), 6).alias("giou"))


@query("g6_merge_span", """SELECT table_id, pos, round(x0+(x1-x0)/2,6) AS cx, round(y0+hh/2,6) AS cy, round(x1-x0,6) AS w, round(hh,6) AS h FROM (
  SELECT a.table_id, a.pos, a.cx-a.w/2 AS x0, b.cx+b.w/2 AS x1, least(a.cy-a.h/2,b.cy-b.h/2) AS y0, b.cy+b.h/2-(a.cy-a.h/2) AS hh FROM fx_pred_box a JOIN fx_pred_box b ON a.table_id=b.table_id AND b.pos=a.pos+1)""")
def _(spark, sf):
    a, b = fx.predicted_boxes(spark, sf).alias("a"), fx.predicted_boxes(spark, sf).withColumn("pos", F.col("pos") - 1).alias("b")
    pick = lambda p: tuple(F.col(f"{p}.{k}") for k in ("cx", "cy", "w", "h"))
    j = a.join(b, (F.col("a.table_id") == F.col("b.table_id")) & (F.col("a.pos") == F.col("b.pos")))
    return j.select(F.col("a.table_id").alias(T), F.col("a.pos").alias("pos"), *(F.round(v, 6).alias(k) for k, v in zip(("cx", "cy", "w", "h"), G.merge_span(pick("a"), pick("b")))))


@query("pf9_invalid_boxes", "SELECT table_id, count(*) FILTER (r*(1-pos%3)-l<0 AND b>t OR r*(1-pos%3)-l>0 AND b<t) AS n FROM box GROUP BY table_id")
def _(spark, sf):
    b = _boxes(spark, sf).withColumn("r", F.col("r") * (1 - F.col("pos") % 3))
    return b.groupBy(T).agg(F.count_if(G.signed_area(G.box()) < 0).alias("n"))


@query("j5_cells_with_boxes", """SELECT c.table_id, c.cell_id, round(coalesce(x.l,0),6) AS l, round(coalesce(x.t,0),6) AS t, round(coalesce(x.r,0),6) AS r, round(coalesce(x.b,0),6) AS b, CAST(CASE WHEN x.pos IS NULL THEN 2 WHEN c0>=c1 AND c0>=c2 THEN 0 WHEN c1>=c2 THEN 1 ELSE 2 END AS BIGINT) AS cell_class
  FROM fx_table_cell c LEFT JOIN box x ON x.table_id=c.table_id AND x.pos=c.cell_id LEFT JOIN fx_pred_box p ON p.table_id=c.table_id AND p.pos=c.cell_id""")
def _(spark, sf):
    cls = fx.predicted_boxes(spark, sf).select(T, "pos", decode.argmax(F.array("c0", "c1", "c2")).alias("cls"))
    return match.with_predictions(In(spark, sf).cells, _boxes(spark, sf).join(cls, [T, "pos"])).select(T, "cell_id", *_r(*"ltrb"), "cell_class")


@query("w13_ranked_detections", "SELECT variant, image, ord, CAST(row_number() OVER (PARTITION BY variant, image ORDER BY score DESC, ord)-1 AS BIGINT) AS id FROM fx_detection")
def _(spark, sf):
    return evaluate.ranked(fx.detections(spark, sf)).select("variant", "image", "ord", "id")


@query("j14_positional_pairs", "SELECT image, k, round(iou,6) AS iou, same, d_score FROM pairs")
def _(spark, sf):
    return evaluate.paired(fx.detections(spark, sf), "candidate").select("image", "k", *_r("iou"), "same", "d_score")


@query("a15_quality", "SELECT round(avg(iou),6) AS mean_iou, round(avg(CAST(iou>=0.5 AS DOUBLE)),6) AS iou_50, round(avg(CAST(iou>=0.75 AS DOUBLE)),6) AS iou_75, round(avg(CAST(same AS DOUBLE)),6) AS agreement, round(avg(d_score),6) AS d_score FROM pairs")
def _(spark, sf):
    return evaluate.quality(evaluate.paired(fx.detections(spark, sf), "candidate")).select(*_r("mean_iou", "iou_50", "iou_75", "agreement", "d_score"))


@query("a16_box_count_change", "SELECT round(avg(m-n),6) AS d_boxes, round(avg((m-n)/greatest(1,n)*100),6) AS d_percent FROM (SELECT image, count(*) FILTER (variant='baseline') AS n, count(*) FILTER (variant='candidate') AS m FROM fx_detection GROUP BY image)")
def _(spark, sf):
    return evaluate.box_count_change(fx.detections(spark, sf), "candidate").select(*_r("d_boxes", "d_percent"))


@query("j15_sq7_greedy_pairs")
def _(spark, sf):
    return evaluate.greedy_pairs(fx.detections(spark, sf), "candidate")


@query("a18_label_counts", "SELECT variant, label, count(*) AS n FROM fx_detection GROUP BY ALL")
def _(spark, sf):
    return evaluate.label_counts(fx.detections(spark, sf))


@query("a19_confidence", "SELECT variant, round(avg(score),6) AS mean, max(score) AS most, min(score) AS least FROM fx_detection GROUP BY ALL")
def _(spark, sf):
    return evaluate.confidence(fx.detections(spark, sf)).select("variant", *_r("mean"), "most", "least")


@query("a20_box_areas", "SELECT variant, count(*) AS n, round(avg((r-l)*(b-t)),6) AS mean, max((r-l)*(b-t)) AS most FROM fx_detection GROUP BY ALL")
def _(spark, sf):
    return evaluate.box_areas(fx.detections(spark, sf)).select("variant", "n", *_r("mean"), "most")


@query("sk9_iou_histogram", "SELECT CAST(least(floor(iou*10)+1,10) AS BIGINT) AS bin, count(*) AS n FROM (SELECT round(iou,6) AS iou FROM pairs) GROUP BY ALL")
def _(spark, sf):
    p = evaluate.paired(fx.detections(spark, sf), "candidate").select(F.floor(F.round("iou", 6) * 10).alias("x"))
    return evaluate.histogram(p, "x", 0.0, 10.0)


_RANKED = "(SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, ord) AS k FROM fx_detection WHERE variant='{}')"


@query("a32_parity", f"""SELECT image, coalesce(median(d_box),0) AS d_median, round(avg(CAST(CASE WHEN u-i>0 THEN i/(u-i) ELSE 0 END>=0.5 AS DOUBLE)),6) AS iou_50, bool_and(same) AS labels, bool_and(d_score<=0.01) AS scores,
    median(d_box)<2 AND avg(CAST(CASE WHEN u-i>0 THEN i/(u-i) ELSE 0 END>=0.5 AS DOUBLE))>0.98 AND bool_and(same) AND bool_and(d_score<=0.01) AS passes FROM (
  SELECT a.image, greatest(least(a.r,b.r)-greatest(a.l,b.l),0)*greatest(least(a.b,b.b)-greatest(a.t,b.t),0) AS i, (a.r-a.l)*(a.b-a.t)+(b.r-b.l)*(b.b-b.t) AS u, a.label=b.label AS same, abs(a.score-b.score) AS d_score,
    greatest(abs(a.l-b.l),abs(a.t-b.t),abs(a.r-b.r),abs(a.b-b.b)) AS d_box FROM {_RANKED.format("baseline")} a JOIN {_RANKED.format("candidate")} b ON a.image=b.image AND a.k=b.k) GROUP BY image""")
def _(spark, sf):
    """Per image, as some pass and others fail."""
    d = evaluate.ranked(fx.detections(spark, sf))
    return evaluate.parity(evaluate.paired(d, "candidate", by="id"), ("image",)).select("image", "d_median", *_r("iou_50"), "labels", "scores", "passes")


@query("a17_latency", "SELECT stage, round(avg(ms),6) AS mean_ms, round(median(ms),6) AS median_ms, round(quantile_cont(ms,0.95),6) AS p95_ms FROM fx_timing GROUP BY stage")
def _(spark, sf):
    return evaluate.latency(fx.timings(spark, sf), ["stage"]).select("stage", *_r("mean_ms", "median_ms", "p95_ms"))


@query("a24_stage_means", "SELECT document, stage, round(ms,6) AS ms FROM means")
def _(spark, sf):
    return evaluate.stage_means(fx.timings(spark, sf)).select("document", "stage", *_r("ms"))


@query("a28_stage_shares", "SELECT stage, round(sum(ms),4) AS ms, round(sum(ms)/greatest(1e-9,sum(sum(ms)) OVER ())*100,6) AS share FROM means GROUP BY stage")
def _(spark, sf):
    return evaluate.stage_summary(evaluate.stage_means(fx.timings(spark, sf))).select("stage", *_r("ms", places=4), *_r("share"))


@query("j17_baseline_delta", """SELECT document, round(coalesce(a,0),6) AS base, round(coalesce(b,0),6) AS now, round(coalesce(b,0)-coalesce(a,0),6) AS delta, round(CASE WHEN abs(coalesce(a,0))<1e-9 THEN 0 ELSE (coalesce(b,0)-coalesce(a,0))/coalesce(a,0)*100 END,4) AS percent
  FROM (SELECT document, avg(ms) AS a FROM fx_timing WHERE ms<700 GROUP BY ALL) FULL JOIN (SELECT document, avg(ms) AS b FROM fx_timing WHERE ms>=300 GROUP BY ALL) USING (document)""")
def _(spark, sf):
    """Documents' calls of under 700 ms against those of 300 and more; some documents have the one or the other alone."""
    t = fx.timings(spark, sf)
    mean = lambda c: t.where(c).groupBy("document").agg(F.avg("ms").alias("ms"))
    return evaluate.against_baseline(mean("ms < 700"), mean("ms >= 300"), "document").select("document", *_r("base", "now", "delta"), *_r("percent", places=4))


@query("a27_best_run", "SELECT document, run, round(a,6) AS avg_ms FROM (SELECT *, row_number() OVER (PARTITION BY document ORDER BY a, run) AS rn FROM (SELECT document, run, avg(ms) AS a FROM fx_timing GROUP BY ALL)) WHERE rn=1")
def _(spark, sf):
    return evaluate.best_run(fx.timings(spark, sf)).select("document", "run", *_r("avg_ms"))


@query("w7_last_runs", "SELECT document, stage, round(avg(ms),6) AS mean_ms, round(median(ms),6) AS median_ms, count(*) AS calls FROM (SELECT *, row_number() OVER (PARTITION BY document, stage ORDER BY run DESC) AS k FROM fx_timing) WHERE k<=20 GROUP BY ALL")
def _(spark, sf):
    return evaluate.last_runs(fx.timings(spark, sf)).select("document", "stage", *_r("mean_ms", "median_ms"), "calls")
