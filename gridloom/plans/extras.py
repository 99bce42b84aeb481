"""More registered queries: tokens and ids, pages without tokens, evaluation, reports and documents as JSON texts.

Inputs are the derived ones of ``registry``. Readers of files are run on the texts that the files would hold.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import images
from ..operators import assemble, decode, evaluate, match, otsl, postprocess, reports
from ..operators.match import T
from ..sources import files
from ..sources import fixtures as fx
from .registry import _BOX, _CELLS, _EMIT, _HTML, CELL5, INTER, OVER, QUERIES, SQL, In, _boxes, _r, _responses, query

# --- tokens and ids


def _raw_tokens(spark, sf):
    """Tokens as pages give them: boxes as corners or as sides, some ids blank or no numbers, some texts null."""
    p = fx.pdf_cells(spark, sf)
    even, place = F.col("t") % 2 == 0, F.col("pdf_cell_id")
    name = F.when(F.col("l") % 5 == 0, "  ").when(F.col("l") % 13 == 1, "x7").otherwise(place.cast("string"))
    return p.select(
        T, place.alias("pos"), name.alias("id"), F.nullif("text", F.lit("")).alias("text"),
        F.when(even, F.array(*"ltrb")).alias("corners"), F.when(~even, F.struct(*"ltrb")).alias("sides"),
    )


@query("pf2_pf3_normalised_tokens", "SELECT table_id, pdf_cell_id, l, t, r, b, text FROM fx_pdf_cell WHERE l%5=0 OR l%13<>1")
def _(spark, sf):
    """PF2, PF3, F2: boxes of either form, ids by place where blank; tokens whose id is no number go."""
    return match.normalised_tokens(_raw_tokens(spark, sf), strict=False)


@query("pf1_drop_blank_tokens", "SELECT * FROM fx_pdf_cell WHERE trim(text)<>''")
def _(spark, sf):
    return match.drop_empty_tokens(fx.pdf_cells(spark, sf), blank_too=True)


def _ids(spark, sf):
    """Per table the ids of its tags between a start and an end, and some zeros."""
    known = F.create_map(*(F.lit(x) for kv in decode.TAG_IDS.items() for x in kv))
    listed = fx.otsl(spark, sf).groupBy(T).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tag"))), lambda x: known[x["tag"]]).alias("x"))
    zeros = F.array_repeat(F.lit(0), (F.col(T) % 4).cast("int"))
    return listed.select(T, F.concat(F.array(F.lit(2)), "x", F.array(F.lit(3)), zeros).alias("ids"))


_TAGS = "SELECT table_id, string_agg(tag, ' ' ORDER BY pos) AS tags, count(*) AS n FROM fx_otsl GROUP BY table_id"


@query("pf5_sq2_tags", f"SELECT table_id, tags FROM ({_TAGS})")
def _(spark, sf):
    """SQ2, then PF5: ids up to the end, without first and last, as tags."""
    return _ids(spark, sf).select(T, F.array_join(decode.tags(decode.until_end(F.col("ids"))), " ").alias("tags"))


@query("pf6_padding", f"SELECT table_id, n+2 AS n_ids, CAST(table_id%4 AS BIGINT) AS n_padding FROM ({_TAGS})")
def _(spark, sf):
    ids = F.col("ids")
    return _ids(spark, sf).select(T, F.size(decode.without_padding(ids)).cast("long").alias("n_ids"), decode.padding(ids).cast("long").alias("n_padding"))


@query("pf4_without_stops", "SELECT table_id, pos, tag FROM fx_otsl")
def _(spark, sf):
    tokens = fx.otsl(spark, sf)
    ends = tokens.groupBy(T).agg(F.max("pos").alias("m"))
    stops = ends.select(T, F.explode(F.array(*(F.struct((F.col("m") + k + 1).alias("pos"), F.lit(t).alias("tag")) for k, t in enumerate(otsl.STOP)))).alias("x")).select(T, "x.*")
    return otsl.without_stops(tokens.unionByName(stops))


@query("j4_tag_names", "SELECT table_id, pos, tag FROM fx_otsl")
def _(spark, sf):
    names = spark.createDataFrame([(v, k) for k, v in decode.TAG_IDS.items()], "tag_id int, tag string")
    ids = _ids(spark, sf).select(T, F.posexplode(decode.until_end(F.col("ids"))).alias("k", "tag_id")).where("tag_id not in (2, 3)")
    places = fx.otsl(spark, sf).groupBy(T).agg(F.array_sort(F.collect_list("pos")).alias("p"))
    return decode.tag_names(ids, names).join(places, T).select(T, F.get("p", F.col("k") - 1).alias("pos"), "tag")


_SYNC = f"SELECT table_id, CAST(len(list_filter(string_split(html,'|'), lambda t: t IN ('<td>','>'))) AS BIGINT) AS n FROM ({_HTML}) WHERE table_id IN (SELECT table_id FROM opening WHERE first_tag IN {CELL5})"


def _html_lists(spark, sf):
    """HTML token lists of tables that begin with a cell, and as many boxes as structure cells, or one more in every third table."""
    good = otsl.opening(fx.otsl(spark, sf)).where(F.col("first_tag").isin(*otsl.CELL5)).select(T)
    h = otsl.html(fx.otsl(spark, sf)).join(good, T, "left_semi").select(T, F.split("html", r"\|").alias("html"))
    n = F.size(F.filter("html", lambda t: t.isin("<td>", ">"))) + F.when(F.col(T) % 3 == 0, 1).otherwise(0)
    return h.select(T, "html", F.sequence(F.lit(0), n - 1).alias("boxes"))


@query("a12_html_cells", _SYNC)
def _(spark, sf):
    return _html_lists(spark, sf).select(T, F.size(F.filter("html", lambda t: t.isin("<td>", ">"))).cast("long").alias("n"))


@query("q8_q9_synced_boxes", f"""SELECT table_id, coalesce(string_agg(b, ',' ORDER BY b) FILTER (n IS NULL OR NOT list_contains(gone, b)), '') AS boxes FROM (
  SELECT h.table_id, unnest(range(len(opens) + CASE WHEN h.table_id%3=0 THEN 1 ELSE 0 END)) AS b, CASE WHEN h.table_id%3=0 THEN 1 END AS n,
    list_transform(list_filter(list_zip(opens, range(1, len(opens)+1)), lambda z: z[1]='>'), lambda z: z[2]) AS gone
  FROM (SELECT table_id, list_filter(string_split(html,'|'), lambda t: t IN ('<td>','>')) AS opens FROM ({_HTML}) WHERE table_id IN (SELECT table_id FROM opening WHERE first_tag IN {CELL5})) h) GROUP BY table_id""")
def _(spark, sf):
    """Q9 and Q8: boxes as they are where their number is that of the cells, else less those behind a spanned cell."""
    return _html_lists(spark, sf).select(T, F.array_join(decode.synced(F.col("boxes"), F.col("html")).cast("array<string>"), ",").alias("boxes"))


@query("q6_q7_span_tokens", f"""SELECT table_id, CAST(coalesce(sum(CASE WHEN n BETWEEN 2 AND 20 THEN n END),0) AS BIGINT) AS total FROM (
  SELECT table_id, TRY_CAST(regexp_extract(t, 'span="(\\d+)"', 1) AS BIGINT) AS n FROM (SELECT table_id, unnest(string_split(html,'|')) AS t FROM ({_HTML}))) GROUP BY table_id""")
def _(spark, sf):
    """Q7 reads the number of a span token, Q6 takes those of 2 to 20."""
    return otsl.html(fx.otsl(spark, sf)).select(T, F.explode(F.split("html", r"\|")).alias("t")).groupBy(T).agg(F.coalesce(F.sum(otsl.span_places(F.col("t"))), F.lit(0)).alias("total"))


@query("o7_top_tokens", "SELECT table_id, CAST(list_position(x, list_max(x))-1 AS BIGINT) AS top FROM (SELECT vec_id AS table_id, embedding AS x FROM embeddings)")
def _(spark, sf):
    return fx.read(spark, sf, "embeddings").select(F.col("vec_id").alias(T), decode.argmax(F.col("embedding")).alias("top"))


# --- boxes

def _ordered_boxes(spark, sf):
    """Emitted boxes of the structure tokens with places that follow from their ordinal."""
    e = decode.emitted(fx.otsl(spark, sf))
    at = lambda k, m: ((F.col("box_ord") * k + F.col(T)) % m).cast("double")
    return e, e.select(T, "box_ord", at(7, 31).alias("cx"), at(5, 23).alias("cy"), (at(3, 11) + 1).alias("w"), (at(2, 7) + 1).alias("h"))


_ORD = f"SELECT table_id, box_ord, first_lcel, CAST((box_ord*7+table_id)%31 AS DOUBLE) AS cx, CAST((box_ord*5+table_id)%23 AS DOUBLE) AS cy, CAST((box_ord*3+table_id)%11+1 AS DOUBLE) AS w, CAST((box_ord*2+table_id)%7+1 AS DOUBLE) AS h, max(box_ord) OVER (PARTITION BY table_id) AS last FROM ({_EMIT})"
_MERGED = """SELECT a.table_id, a.box_ord, CASE WHEN b.box_ord IS NULL THEN a.cx ELSE round((a.cx-a.w/2)+(b.cx+b.w/2-(a.cx-a.w/2))/2,6) END AS cx,
  CASE WHEN b.box_ord IS NULL THEN a.cy ELSE round(least(a.cy-a.h/2,b.cy-b.h/2)+(b.cy+b.h/2-(a.cy-a.h/2))/2,6) END AS cy,
  CASE WHEN b.box_ord IS NULL THEN a.w ELSE round(b.cx+b.w/2-(a.cx-a.w/2),6) END AS w, CASE WHEN b.box_ord IS NULL THEN a.h ELSE round(b.cy+b.h/2-(a.cy-a.h/2),6) END AS h
  FROM {opens} a LEFT JOIN {boxes} b ON b.table_id=a.table_id AND a.follow=b.box_ord WHERE {stays}"""


@query("m5_merged_boxes", f"""WITH o AS ({_ORD}), s AS (SELECT *, CASE WHEN first_lcel THEN CASE WHEN box_ord<last THEN box_ord+1 ELSE last END END AS follow,
  coalesce(lag(first_lcel) OVER (PARTITION BY table_id ORDER BY box_ord), false) AS closes FROM o) """ + _MERGED.format(opens="s", boxes="o", stays="first_lcel OR NOT a.closes").replace("first_lcel", "a.first_lcel"))
def _(spark, sf):
    e, boxes = _ordered_boxes(spark, sf)
    return decode.merged(boxes, decode.merge_pairs(e)).select(T, "box_ord", *_r("cx", "cy", "w", "h"))


@query("m5_merged_boxes_simplified", f"""WITH o AS ({_ORD}), i AS (SELECT *, sum(CASE WHEN first_lcel AND box_ord<last THEN 0 ELSE 1 END) OVER (PARTITION BY table_id ORDER BY box_ord) AS run FROM o),
  k AS (SELECT *, row_number() OVER (PARTITION BY table_id, run, first_lcel AND box_ord<last ORDER BY box_ord) AS rn FROM i),
  s AS (SELECT *, CASE WHEN first_lcel AND box_ord<last AND rn%2=1 THEN box_ord+1 END AS follow FROM k),
  q AS (SELECT *, coalesce(lag(follow) OVER (PARTITION BY table_id ORDER BY box_ord)=box_ord, false) AS closes FROM s) """ + _MERGED.format(opens="q", boxes="o", stays="NOT a.closes"))
def _(spark, sf):
    e, boxes = _ordered_boxes(spark, sf)
    return decode.merged(boxes, decode.merge_pairs(e), canonical=False).select(T, "box_ord", *_r("cx", "cy", "w", "h"))


@query("g5_centre_boxes", f"SELECT table_id, pos, round((l+r)/2,6) AS cx, round((t+b)/2,6) AS cy, round(r-l,6) AS w, round(b-t,6) AS h, {_BOX} FROM box")
def _(spark, sf):
    """Centre boxes to corners and back."""
    corners = fx.predicted_boxes(spark, sf).select(T, "pos", *(v.alias(k) for k, v in zip("ltrb", G.from_centre(*map(F.col, ("cx", "cy", "w", "h"))))))
    return corners.select(T, "pos", *(F.round(v, 6).alias(k) for k, v in zip(("cx", "cy", "w", "h"), G.to_centre(G.box()))), *_r(*"ltrb"))


@query("g8_scaled_boxes", "SELECT table_id, pos, round(l*1024/768,6) AS l, round(t*1024/768,6) AS t, round(r*1024/768,6) AS r, round(b*1024/768,6) AS b, round(l,6) AS l0, round(b,6) AS b0 FROM box")
def _(spark, sf):
    """Page boxes to the scale of the resized page and back."""
    factor = G.page_scale(F.lit(768.0))
    up = G.scaled(G.box(), factor)
    back = G.unscaled(up, factor)
    return _boxes(spark, sf).select(T, "pos", *(F.round(v, 6).alias(k) for k, v in zip("ltrb", up)), F.round(back[0], 6).alias("l0"), F.round(back[3], 6).alias("b0"))


@query("g10_unpadded_boxes", "SELECT table_id, pos, round(least(greatest((l-0.5)*1.25+0.5,0),1),6) AS l, round(least(greatest((t-0.5)*1.6+0.5,0),1),6) AS t, round(least(greatest((r-0.5)*1.25+0.5,0),1),6) AS r, round(least(greatest((b-0.5)*1.6+0.5,0),1),6) AS b FROM box")
def _(spark, sf):
    return _boxes(spark, sf).select(T, "pos", *(F.round(v, 6).alias(k) for k, v in zip("ltrb", G.unpad(G.box(), F.lit(1.25), F.lit(1.6)))))


@query("g11_table_image_boxes", "SELECT table_id, pos, round(l-10,6) AS l, round(800-b-20,6) AS t, round(r-10,6) AS r, round(800-t-20,6) AS b FROM box")
def _(spark, sf):
    at = G.to_table_image(G.box(), tuple(F.lit(x) for x in (10.0, 20.0, 210.0, 120.0)), F.lit(800.0))
    return _boxes(spark, sf).select(T, "pos", *(F.round(v, 6).alias(k) for k, v in zip("ltrb", at)))


@query("g14_page_scale", "SELECT item_id, CAST(trunc((400+item_id)*(1024.0/(600+item_id))) AS BIGINT) AS width, round(1024.0/(600+item_id),9) AS factor FROM benchmark")
def _(spark, sf):
    n = F.col("item_id").cast("double")
    return fx.read(spark, sf, "benchmark").select("item_id", G.scaled_width(400 + n, 600 + n).alias("width"), F.round(G.page_scale(600 + n), 9).alias("factor"))


@query("g15_a8_regions", """SELECT table_id, pos, round(l,6) AS l, round(t,6) AS t, round(l+w,6) AS r, round(t+h,6) AS b, round(least(l,0.5),6) AS ul, round(greatest(l+w,0.75),6) AS ur
  FROM (SELECT x.table_id, x.pos, l, t, w, h FROM box x JOIN fx_pred_box p USING (table_id, pos))""")
def _(spark, sf):
    """Regions of place and size to corners, and their hull with a fixed box."""
    j = _boxes(spark, sf).join(fx.predicted_boxes(spark, sf).select(T, "pos", "w", "h"), [T, "pos"])
    c = G.from_xywh(F.col("l"), F.col("t"), F.col("w"), F.col("h"))
    hull = G.union(c, tuple(F.lit(x) for x in (0.5, 0.25, 0.75, 0.5)))
    return j.select(T, "pos", *(F.round(v, 6).alias(k) for k, v in zip("ltrb", c)), F.round(hull[0], 6).alias("ul"), F.round(hull[2], 6).alias("ur"))


@query("i6_resized_targets", "SELECT table_id, pos, round(cx*0.4,6) AS cx, round(cy*0.7,6) AS cy, round(w*0.4,6) AS w, round(h*0.7,6) AS h FROM fx_pred_box")
def _(spark, sf):
    b = G.resized(tuple(map(F.col, ("cx", "cy", "w", "h"))), F.lit(0.4), F.lit(0.7))
    return fx.predicted_boxes(spark, sf).select(T, "pos", *(F.round(v, 6).alias(k) for k, v in zip(("cx", "cy", "w", "h"), b)))


@query("a22_array_statistics", """SELECT vec_id, least, most, round(mean,6) AS mean, round(sqrt(greatest(sq-mean*mean,0)),5) AS std FROM (SELECT vec_id, list_min(x) AS least, list_max(x) AS most,
  list_sum(x)/len(x) AS mean, list_sum(list_transform(x, lambda v: v*v))/len(x) AS sq FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings))""")
def _(spark, sf):
    e = fx.read(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return e.select("vec_id", *images.array_statistics(F.col("x"))).select("vec_id", "least", "most", *_r("mean"), *_r("std", places=5))


@query("j13_overlapping_cells", f"SELECT c.table_id, c.cell_id, p.cell_id AS other_id FROM moved c JOIN moved p ON {OVER} AND c.cell_id<p.cell_id")
def _(spark, sf):
    return postprocess.overlapping(In(spark, sf).moved()[1])


# --- pages


@query("pf11_deleted_columns", """SELECT m.table_id, cell_id, m.column_id - (SELECT count(*) FROM gone g WHERE g.table_id=m.table_id AND g.column_id<m.column_id) AS column_id
  FROM moved m ANTI JOIN gone g USING (table_id, column_id)""")
def _(spark, sf):
    moved, scores = In(spark, sf).scores()
    gone = postprocess.duplicate_columns(scores)
    return postprocess.delete_columns(moved, gone).select(T, "cell_id", "column_id")


def _some_tokens(spark, sf):
    """Tokens of the tables whose first token begins to the right of 0; other tables are without tokens."""
    pdf = fx.pdf_cells(spark, sf)
    told = pdf.groupBy(T).agg(F.min("l").alias("m")).where("m > 0").select(T)
    return pdf.join(told, T, "left_semi")


@query("pf14_pages", _CELLS + """final WHERE table_id IN (SELECT table_id FROM fx_pdf_cell GROUP BY table_id HAVING min(l)>0)
  UNION ALL SELECT table_id, cell_id, row_id, column_id, l, t, r, b, cell_class, label FROM fx_table_cell WHERE table_id NOT IN (SELECT table_id FROM fx_pdf_cell GROUP BY table_id HAVING min(l)>0)""")
def _(spark, sf):
    """PF14: tables without tokens skip the post-processing."""
    cells = In(spark, sf).cells
    return postprocess.page(cells, _some_tokens(spark, sf))[0].select(T, "cell_id", "row_id", "column_id", *_r(*"ltrb"), "cell_class", "label")


@query("j3_page_matches", "SELECT table_id, pdf_cell_id, cell_id, round(iopdf,6) AS iopdf FROM final_m WHERE table_id IN (SELECT table_id FROM fx_pdf_cell GROUP BY table_id HAVING min(l)>0)")
def _(spark, sf):
    """J3: tables without tokens have no matches."""
    return postprocess.page(In(spark, sf).cells, _some_tokens(spark, sf))[1].select(T, "pdf_cell_id", "cell_id", *_r("iopdf"))


_BIG = """WITH tk AS (SELECT * FROM fx_big_pdf_cell WHERE text<>''), mm AS (SELECT DISTINCT c.table_id, p.pdf_cell_id, c.cell_id, {inter}/((p.r-p.l)*(p.b-p.t)) AS iopdf FROM fx_big_table_cell c JOIN tk p ON {over}),
  bb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY table_id, pdf_cell_id ORDER BY iopdf DESC, cell_id) AS rn FROM mm) WHERE rn=1), crowded AS (SELECT table_id FROM tk GROUP BY table_id HAVING count(*)>300)
  SELECT b.table_id, b.cell_id, min(l) AS l, min(t) AS t, max(r) AS r, max(p.b) AS b FROM bb b JOIN tk p USING (table_id, pdf_cell_id) WHERE b.table_id NOT IN (SELECT table_id FROM crowded) GROUP BY ALL
  UNION ALL SELECT table_id, cell_id, l, t, r, b FROM fx_big_table_cell WHERE table_id IN (SELECT table_id FROM crowded)""".format(inter=INTER, over=OVER)


@query("pf15_aligned_cells", _BIG)
def _(spark, sf):
    """PF15 on tables of up to some hundred rows: beyond 300 tokens cells keep their boxes."""
    cells, tokens = fx.table_cells(spark, sf, big=True), match.drop_empty_tokens(fx.pdf_cells(spark, sf, big=True))
    best = match.best_match(match.intersection_over_token(cells, tokens))
    return postprocess.align_to_tokens(cells, best, tokens).select(T, "cell_id", *"ltrb")


@query("a35_post_processed", "SELECT p.table_id, p.pdf_cell_id, m.cell_id, round(m.iopdf,6) AS iopdf FROM tok p LEFT JOIN final_m m USING (table_id, pdf_cell_id)")
def _(spark, sf):
    """One row per token of the post-processed table with its match, if it has one."""
    i = In(spark, sf)
    links = postprocess.run(i.cells, i.pdf)[1]
    return i.tok.select(T, "pdf_cell_id").join(links.select(T, "pdf_cell_id", "cell_id", "iopdf"), [T, "pdf_cell_id"], "left").select(T, "pdf_cell_id", "cell_id", *_r("iopdf"))


@query("a37_token_responses", """SELECT m.table_id, m.pdf_cell_id, arg_max(row_span, d.cell_id) AS row_span, arg_max(col_span, d.cell_id) AS col_span, arg_max(start_row, d.cell_id) AS start_row, arg_max(start_col, d.cell_id) AS start_col,
  bool_or(column_header) AS column_header, bool_or(row_header) AS row_header, bool_or(row_section) AS row_section,
  array_to_string(list_sort(list_distinct(list(f.row_id))), ',') AS row_ids, array_to_string(list_sort(list_distinct(list(f.column_id))), ',') AS column_ids, min(f.label) AS label
  FROM m JOIN dummy d USING (table_id, cell_id) JOIN fx_table_cell f USING (table_id, cell_id) GROUP BY m.table_id, m.pdf_cell_id""", cells="fx_table_cell")
def _(spark, sf):
    """Rows, columns and label of every cell that a token touches, before the best one is chosen."""
    i = In(spark, sf)
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    found = assemble.token_responses(i.cells, match.intersection_over_token(i.cells, i.tok))
    return found.select(T, "pdf_cell_id", "row_span", "col_span", "start_row", "start_col", "column_header", "row_header", "row_section", text("row_ids"), text("column_ids"), "label")


@query("f1_cell_keys", "SELECT table_id, cell_id, start_col || '_' || start_row AS cell_key FROM dummy", cells="fx_table_cell")
def _(spark, sf):
    return assemble.keyed(assemble.dummy_responses(In(spark, sf).cells)).select(T, "cell_id", "cell_key")


@query("o1_sorted_cells", "SELECT table_id, string_agg(cell_id, ',' ORDER BY cell_id) AS cells FROM final GROUP BY table_id")
def _(spark, sf):
    """O1: cells of a table in the order of their ids."""
    i = In(spark, sf)
    return assemble.in_order(postprocess.run(i.cells, i.pdf)[0], "cell_id")


@query("o5_sorted_samples", "SELECT table_id, CAST(row_number() OVER (ORDER BY table_id)-1 AS BIGINT) AS place FROM (SELECT DISTINCT table_id FROM fx_table_cell)")
def _(spark, sf):
    """O5: places of samples in the order of their keys."""
    return evaluate.placed(In(spark, sf).cells.select(T).distinct(), [T])


@query("o6_first_images", "SELECT label, image FROM (SELECT label, image, row_number() OVER (PARTITION BY label ORDER BY image) AS rn FROM (SELECT DISTINCT label, image FROM fx_detection)) WHERE rn<=3")
def _(spark, sf):
    """O6: the first three images of each label."""
    return evaluate.first_k(fx.detections(spark, sf).select("label", "image").distinct(), "label", "image", 3)


@query("u4_labels", "SELECT DISTINCT label FROM fx_detection")
def _(spark, sf):
    d = fx.detections(spark, sf)
    return evaluate.label_universe(d.where("variant = 'baseline'"), d.where("variant = 'candidate'"))


# --- evaluation


@query("a21_speed_up", "SELECT document, round(CASE WHEN b<>0 THEN a/b END,6) AS speed_up FROM (SELECT document, sum(CASE WHEN run=0 THEN ms ELSE 0 END) AS a, sum(CASE WHEN run=1 THEN ms ELSE 0 END) AS b FROM fx_timing GROUP BY document)")
def _(spark, sf):
    runs = fx.timings(spark, sf).groupBy("document").agg(*(F.sum(F.when(F.col("run") == k, F.col("ms")).otherwise(0)).alias(n) for k, n in ((0, "a"), (1, "b"))))
    return evaluate.speed_up(runs, "document", "a", "b").select("document", *_r("speed_up"))


@query("a25_run_totals", "SELECT document, stage, run, CAST(sum(ms) AS BIGINT) AS ms FROM (SELECT document, stage, run//3 AS run, ms FROM fx_timing) GROUP BY ALL")
def _(spark, sf):
    return evaluate.run_totals(fx.timings(spark, sf).withColumn("run", F.floor(F.col("run") / 3).cast("long")))


@query("a26_document_totals", "SELECT run, CAST(sum(ms) AS BIGINT) AS total_ms, round(sum(ms)/greatest(1,count(*)),6) AS average_ms FROM (SELECT run, document, sum(ms) AS ms FROM fx_timing GROUP BY ALL) GROUP BY run")
def _(spark, sf):
    return evaluate.document_totals(fx.timings(spark, sf)).select("run", "total_ms", *_r("average_ms"))


@query("a29_profile", """SELECT document AS session, stage AS section, round(avg(dt),6) AS mean_dt, round(median(dt),6) AS median_dt, round(avg(calls),6) AS mean_calls, median(calls) AS median_calls, max(kb) AS most_kb, count(*) AS cycles
  FROM (SELECT *, row_number() OVER (PARTITION BY document, stage ORDER BY cycle DESC) AS k FROM (SELECT document, stage, run//2 AS cycle, sum(ms) AS dt, count(*) AS calls, max(ms*4+run) AS kb FROM fx_timing GROUP BY ALL)) WHERE k<=20 GROUP BY ALL""")
def _(spark, sf):
    t = fx.timings(spark, sf).select(F.col("document").alias("session"), F.col("stage").alias("section"), F.floor(F.col("run") / 2).cast("long").alias("cycle"), F.col("ms").alias("dt"), (F.col("ms") * 4 + F.col("run")).alias("kb"))
    return evaluate.profile(t).select("session", "section", *_r("mean_dt", "median_dt", "mean_calls"), "median_calls", "most_kb", "cycles")


@query("a30_running_average", "SELECT stage, CAST(sum(ms*(run+1)) AS BIGINT) AS sum, CAST(sum(run+1) AS BIGINT) AS n, round(sum(ms*(run+1))/sum(run+1),6) AS average FROM fx_timing GROUP BY stage")
def _(spark, sf):
    return evaluate.running_average(fx.timings(spark, sf).withColumn("n", F.col("run") + 1), "stage", "ms", "n").select("stage", "sum", "n", *_r("average"))


@query("a31_top_k_accuracy", "SELECT round(avg(hit)*100,6) AS accuracy FROM (SELECT vec_id, max(CASE WHEN k-1=label THEN 1 ELSE 0 END) AS hit FROM (SELECT vec_id, label, k, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, k) AS rn FROM (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(1,len(embedding)+1)) AS k FROM embeddings)) WHERE rn<=5 GROUP BY vec_id)")
def _(spark, sf):
    e = fx.read(spark, sf, "embeddings").select(F.col("vec_id").alias("sample"), "label", F.posexplode("embedding").alias("k", "x"))
    return evaluate.top_k_accuracy(evaluate.guesses(e), 5).select(*_r("accuracy"))


@query("a33_acceptance", "SELECT iou_50>=0.995 AND mean_iou>=0.99 AND abs(p)<=1 AND (0.85<=0.9 OR 60<=50) AS passes FROM (SELECT avg(iou) AS mean_iou, avg(CAST(iou>=0.5 AS DOUBLE)) AS iou_50 FROM pairs), (SELECT avg((m-n)/greatest(1,n)*100) AS p FROM (SELECT image, count(*) FILTER (variant='baseline') AS n, count(*) FILTER (variant='candidate') AS m FROM fx_detection GROUP BY image))")
def _(spark, sf):
    d = fx.detections(spark, sf)
    return evaluate.acceptance(evaluate.quality(evaluate.paired(d, "candidate")), evaluate.box_count_change(d, "candidate"), 0.85, 60)


@query("a34_array_difference", "SELECT vec_id, round(d,6) AS d_max, round(d/greatest(list_max(list_transform(x, lambda v: abs(v))),1e-9),6) AS d_relative FROM (SELECT *, list_max(list_transform(list_zip(x, list_reverse(x)), lambda z: abs(z[1]-z[2]))) AS d FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings))")
def _(spark, sf):
    e = fx.read(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x")).withColumn("y", F.reverse("x"))
    return evaluate.array_difference(e, "vec_id", "x", "y").select("vec_id", *_r("d_max", "d_relative"))


_TIMES = "SELECT CASE WHEN run%2=0 THEN 'baseline' ELSE 'candidate' END AS variant, ms FROM fx_timing"


@query("a36_comparison", f"""SELECT variant, round(coalesce(mean_iou,1),6) AS mean_iou, round(mean_ms,6) AS mean_ms, round(p95_ms,6) AS p95_ms, CAST(CASE variant WHEN 'candidate' THEN 1.5 ELSE 0 END AS DOUBLE) AS size_mb
  FROM (SELECT DISTINCT variant FROM fx_detection) LEFT JOIN (SELECT 'candidate' AS variant, avg(iou) AS mean_iou FROM pairs) USING (variant) LEFT JOIN (SELECT variant, avg(ms) AS mean_ms, quantile_cont(ms,0.95) AS p95_ms FROM ({_TIMES}) GROUP BY variant) USING (variant)""")
def _(spark, sf):
    t = fx.timings(spark, sf).select(F.when(F.col("run") % 2 == 0, "baseline").otherwise("candidate").alias("variant"), "ms")
    sizes = spark.createDataFrame([("candidate", 1572864)], "variant string, bytes long")
    return evaluate.comparison(fx.detections(spark, sf), t, sizes).select("variant", *_r("mean_iou", "mean_ms", "p95_ms"), "size_mb")


@query("a38_mean_elapsed", "SELECT document, round(avg(ms),6) AS mean_ms FROM fx_timing WHERE run>=1 GROUP BY document")
def _(spark, sf):
    return evaluate.mean_elapsed(fx.timings(spark, sf)).select("document", *_r("mean_ms"))


# --- reports and documents

_STAGE = "SELECT document AS d, stage, avg(ms) AS ms FROM fx_timing WHERE run>=1 AND run<6 GROUP BY ALL"


def _report_texts(spark, sf):
    """A benchmark report per stage, as JSON: the legacy layout for stages whose name ends in a letter after m."""
    d = evaluate.stage_means(fx.timings(spark, sf)).withColumn("image", F.concat(F.lit("p"), F.col("document").cast("string")))
    pairs = lambda v: F.map_from_entries(F.array_sort(F.collect_list(F.struct("image", v))))
    g = d.groupBy("stage").agg(
        pairs(F.struct(F.round("ms", 3).alias("TimingMs")).alias("v")).alias("docs"), pairs(F.struct(F.lit(0).alias("num_tables")).alias("v")).alias("pred"), pairs(F.round("ms", 3).alias("v")).alias("times"),
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.round("ms", 3)), 3).alias("total"),
    )
    now = F.to_json(
        F.struct(
            F.struct(F.concat(F.lit("run-"), "stage").alias("Label"), F.lit(1).alias("Iteration")).alias("Metadata"), F.col("docs").alias("Documents"),
            F.struct(F.col("n").alias("NumDocuments"), F.col("total").alias("TotalMs"), F.round(F.col("total") / F.col("n"), 3).alias("AverageMs")).alias("Summary"),
        )
    )
    old = F.to_json(F.struct(F.col("pred").alias("predictions"), F.col("times").alias("timings_ms")))
    return g.select(F.concat(F.lit("/runs/"), "stage", F.lit(".json")).alias("name"), F.when(F.right("stage", F.lit(1)) > "m", old).otherwise(now).alias("value"))


@query("sc15_report_documents", f"SELECT '/runs/' || stage || '.json' AS name, 'p' || d AS document, round(ms,3) AS timing_ms FROM ({_STAGE})")
def _(spark, sf):
    return reports.report_documents(_report_texts(spark, sf))


@query("sc15_report_summaries", f"""SELECT '/runs/' || stage || '.json' AS name, CASE WHEN right(stage,1)>'m' THEN stage ELSE 'run-' || stage END AS label, count(*) AS n_documents,
  round(sum(round(ms,3)),3) AS total_ms, round(CASE WHEN right(stage,1)>'m' THEN sum(round(ms,3))/count(*) ELSE round(round(sum(round(ms,3)),3)/count(*),3) END,3) AS average_ms FROM ({_STAGE}) GROUP BY stage""")
def _(spark, sf):
    return reports.report_summaries(_report_texts(spark, sf)).select("name", "label", "n_documents", F.round("total_ms", 3).alias("total_ms"), F.round("average_ms", 3).alias("average_ms"))


def _detection_texts(spark, sf, base: str):
    """Detections of each image of a variant as the JSON text of a file."""
    d = fx.detections(spark, sf).where(F.col("variant") == base)
    one = F.struct("ord", F.col("ord").alias("id"), F.array(*"ltrb").alias("bbox"), "label", "score")
    return d.groupBy("image").agg(F.to_json(F.transform(F.array_sort(F.collect_list(one)), lambda x: x.dropFields("ord"))).alias("value")).select(F.concat(F.lit("/a.b/"), F.col("image").cast("string"), F.lit(".json")).alias("path"), "value")


@query("sc12_predictions", "SELECT * FROM (SELECT CAST(image AS VARCHAR) AS image, CAST(row_number() OVER (PARTITION BY image ORDER BY ord)-1 AS BIGINT) AS ord, label, score, l, t, r, b FROM fx_detection WHERE variant='baseline') WHERE score>0.25")
def _(spark, sf):
    """SK1 writes, SC12 and F4 read, PF12 keeps detections above a score."""
    return files.above(files.detections_of(_detection_texts(spark, sf, "baseline"))).drop("id")


@query("sc14_detection_pairs", "SELECT image, label, count(*) AS n, round(avg(score),6) AS confidence, round(avg((r-l)*(b-t)),6) AS area FROM fx_detection WHERE variant='candidate' GROUP BY ALL")
def _(spark, sf):
    d = fx.detections(spark, sf).where("variant = 'candidate'")
    one = F.struct("label", F.col("score").alias("confidence"), F.struct((F.col("r") - F.col("l")).alias("width"), (F.col("b") - F.col("t")).alias("height")).alias("bbox"))
    texts = d.groupBy("image").agg(F.to_json(F.struct(F.collect_list(one).alias("detections"))).alias("value")).select(F.col("image").cast("string").alias("name"), "value")
    found = reports.detection_pairs(texts, "bbox").groupBy(F.col("name").cast("long").alias("image"), "label")
    return found.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"), F.round(F.avg("area"), 6).alias("area"))


@query("sc17_annotations", "SELECT CAST(image AS VARCHAR) AS filename, ord, l, t, r, b FROM fx_detection WHERE variant='baseline'")
def _(spark, sf):
    """SC17 and G15: regions of place and size."""
    d = fx.detections(spark, sf).where("variant = 'baseline'")
    one = F.struct(F.col("ord"), F.col("l").alias("x"), F.col("t").alias("y"), (F.col("r") - F.col("l")).alias("width"), (F.col("b") - F.col("t")).alias("height"), F.col("ord").cast("int").alias("label"))
    texts = d.groupBy("image").agg(F.array_sort(F.collect_list(one)).alias("regions")).select(F.to_json(F.struct(F.col("image").cast("string").alias("filename"), "regions")).alias("value"))
    return files.annotations_of(texts).select("filename", F.col("label").cast("long").alias("ord"), *"ltrb")


@query("sc13_timings", "SELECT 'p' || document AS filename, CAST(ms AS DOUBLE) AS ms FROM fx_timing WHERE run>0")
def _(spark, sf):
    """SC13: lines of a CSV text with a header, short lines and wrong numbers."""
    t = fx.timings(spark, sf)
    line = F.when(F.col("run") == 0, F.when(F.col("ms") % 2 == 0, "filename,ms").otherwise("short")).otherwise(F.concat(F.lit("p"), F.col("document").cast("string"), F.lit(","), F.col("ms").cast("string")))
    return files.timings_of(t.select(line.alias("value")))


def _golden_texts(spark, sf, variant: str):
    """Recorded pages as JSON: a page per image, its detections as tables, some as objects and some as their text."""
    d = fx.detections(spark, sf).where(F.col("variant") == variant)
    table = F.to_json(F.struct("label", F.col("ord").alias("id")))
    told = F.when(F.col("ord") % 2 == 0, table).otherwise(F.to_json(F.struct(F.array(table).alias("x"))).substr(F.lit(7), F.length(F.to_json(F.struct(F.array(table).alias("x")))) - 8))
    g = d.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("ord", told.alias("t")))).alias("x"))
    page = F.concat(F.lit('{"p'), F.col("image").cast("string"), F.lit('":{"num_tables":'), F.size("x").cast("string"), F.lit(',"tables":['), F.array_join(F.transform("x", lambda t: t["t"]), ","), F.lit("]}}"))
    return g.select(F.lit(variant).alias("name"), page.alias("value"))


_GOLD = """SELECT 'p' || image AS image, count(*) OVER (PARTITION BY image) AS num_tables, CAST(row_number() OVER (PARTITION BY image ORDER BY ord)-1 AS BIGINT) AS table_index,
  CASE WHEN ord%2=0 THEN '{{"id":' || ord || ',"label":"' || label || '"}}' ELSE '{{"label":"' || label || '","id":' || ord || '}}' END AS canonical FROM fx_detection WHERE variant='{}'"""


@query("sc16_golden_tables", _GOLD.format("baseline"))
def _(spark, sf):
    """SC16, SK6 and F8: tables given as objects are made canonical."""
    return reports.golden_tables(_golden_texts(spark, sf, "baseline")).drop("name")


@query("j18_golden_failures", f"""WITH e AS ({_GOLD.format("baseline")}), a AS ({_GOLD.format("candidate")}),
  p AS (SELECT image, x.n AS en, y.n AS an FROM (SELECT image, max(num_tables) AS n FROM e GROUP BY image) x FULL JOIN (SELECT image, max(num_tables) AS n FROM a GROUP BY image) y USING (image))
  SELECT image, CAST(NULL AS BIGINT) AS table_index, CASE WHEN en IS NULL THEN 'unexpected page' WHEN an IS NULL THEN 'page not produced' ELSE 'table count' END AS failure FROM p WHERE en IS NULL OR an IS NULL OR en<>an
  UNION ALL SELECT a.image, a.table_index, CASE WHEN e.canonical IS NULL THEN 'missing reference' ELSE 'mismatch' END FROM a LEFT JOIN e USING (image, table_index) WHERE a.image IN (SELECT image FROM e) AND (e.canonical IS NULL OR e.canonical<>a.canonical)""")
def _(spark, sf):
    golden, actual = (reports.golden_tables(_golden_texts(spark, sf, v)).drop("name") for v in ("baseline", "candidate"))
    return reports.golden_failures(golden, actual)


def _digests(spark, sf):
    """Digests of documents' texts as if they were tensors: what is expected, and what a changed folder holds."""
    d = fx.read(spark, sf, "documents").select("source", "doc_id", "lang", "n_chars", F.sha2("text", 256).alias("sha256"))
    rows = d.select(F.col("source").alias("file"), F.col("doc_id").cast("string").alias("name"), F.when(F.col("lang") == "en", "F32").otherwise("I64").alias("dtype"), F.col("n_chars").cast("string").alias("shape"), "sha256", "n_chars")
    found = rows.select("file", "name", F.when(F.col("n_chars") % 7 == 0, "F64").otherwise(F.col("dtype")).alias("dtype"), F.when(F.col("n_chars") % 11 == 0, "1").otherwise(F.col("shape")).alias("shape"), F.when(F.col("n_chars") % 13 == 0, "0").otherwise(F.col("sha256")).alias("sha256"), "n_chars")
    return rows.where("n_chars % 17 <> 0").drop("n_chars"), found.where("n_chars % 19 <> 0").drop("n_chars")


@query("j19_digest_failures", """SELECT source AS file, CAST(doc_id AS VARCHAR) AS name, CASE WHEN n_chars%19=0 THEN 'missing' WHEN n_chars%17=0 THEN 'extra' WHEN n_chars%7=0 THEN 'dtype' WHEN n_chars%11=0 THEN 'shape' ELSE 'hash' END AS failure
  FROM documents WHERE NOT (n_chars%17=0 AND n_chars%19=0) AND (n_chars%7=0 OR n_chars%11=0 OR n_chars%13=0 OR n_chars%17=0 OR n_chars%19=0)""")
def _(spark, sf):
    return reports.digest_failures(*_digests(spark, sf))


@query("j16_joined_samples", "SELECT image, count(*) AS n, round(sum(iou),5) AS iou FROM pairs GROUP BY image")
def _(spark, sf):
    """Pairs beside their image's sample; a pair of an unknown image would be an error."""
    pairs = evaluate.paired(fx.detections(spark, sf), "candidate")
    samples = fx.detections(spark, sf).select("image").distinct()
    return reports.joined_samples(pairs, samples, ["image"]).groupBy("image").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("iou"), 5).alias("iou"))


_BREAK = """SELECT stage, '| ' || stage || ' | ' || printf('%.2f', b) || ' | ' || printf('%.2f', n) || ' | ' || {d} || ' | ' || {p} || ' | ' || printf('%.2f', b/greatest(1e-9,sum(b) OVER ())*100) || ' | ' || printf('%.2f', n/greatest(1e-9,sum(n) OVER ())*100) || ' |' AS line
  FROM (SELECT *, n-b AS d, CASE WHEN abs(b)<1e-9 THEN 0 ELSE (n-b)/b*100 END AS p FROM (SELECT stage, CAST(sum(CASE WHEN run<3 THEN ms ELSE 0 END) AS DOUBLE) AS b, CAST(sum(CASE WHEN run>=3 THEN ms ELSE 0 END) AS DOUBLE) AS n FROM fx_timing GROUP BY stage))""".format(
    **{k: f"CASE WHEN abs({k})<1e-6 THEN '0.00' WHEN {k}>=0 THEN '+' || printf('%.2f', {k}) ELSE printf('%.2f', {k}) END" for k in "dp"}
)


@query("sk4_stage_breakdown", _BREAK)
def _(spark, sf):
    """SK4, F5, A28: the lines of a report of stages."""
    t = fx.timings(spark, sf).withColumn("ms", F.col("ms").cast("double"))
    return reports.stage_breakdown(t.where("run < 3"), t.where("run >= 3"))


@query("sk4_variant_report", """SELECT 'candidate' AS variant, '# candidate' || chr(10) || chr(10) || '|metric|value|' || chr(10) || '|---|---:|' || chr(10) || '|mean IoU|' || printf('%.3f', avg(iou)) || '|' || chr(10) || '|IoU@0.5|' || printf('%.3f', avg(CAST(iou>=0.5 AS DOUBLE))) || '|' || chr(10)
  || '|IoU@0.75|' || printf('%.3f', avg(CAST(iou>=0.75 AS DOUBLE))) || '|' || chr(10) || '|label agreement|' || printf('%.3f', avg(CAST(same AS DOUBLE))) || '|' || chr(10) || '|Δ score|' || printf('%.3f', avg(d_score)) || '|' || chr(10) || '|model size (MB)|1.5|' AS text FROM pairs""")
def _(spark, sf):
    """SK4 and F6: a variant's report; it has no times here, so those lines are absent."""
    q = evaluate.quality(evaluate.paired(fx.detections(spark, sf), "candidate"))
    none = F.lit(None).cast("double")
    return reports.variant_report(q.select(F.lit("candidate").alias("variant"), "*", none.alias("d_boxes"), none.alias("mean_ms"), none.alias("p95_ms"), reports.mebibytes(F.lit(1572864)).alias("size_mb")))


@query("f7_precision", "SELECT doc_id, CASE WHEN doc_id%3=0 THEN 'fp16' WHEN doc_id%3=1 THEN 'int8' ELSE 'fp32' END AS precision FROM documents")
def _(spark, sf):
    d = fx.read(spark, sf, "documents").select("doc_id", F.concat(F.lit("net_"), F.element_at(F.array(F.lit("FP16"), F.lit("int8"), F.lit("x")), (F.col("doc_id") % 3 + 1).cast("int")), F.lit(".bin")).alias("name"))
    return d.select("doc_id", reports.precision(F.col("name")).alias("precision"))


@query("sk1_response_documents", """SELECT table_id, '[' || string_agg('{"cell_id":' || cell_id || ',"col_span":' || col_span || ',"row_span":' || row_span || ',"column_header":' || column_header || ',"row_header":' || row_header
  || ',"text":"' || text || '","start_col":' || start_col || ',"start_row":' || start_row || ',"end_col":' || (start_col+col_span) || ',"end_row":' || (start_row+row_span) || '}', ',' ORDER BY cell_id) || ']' AS document
  FROM (SELECT * EXCLUDE (start_col, start_row), dense_rank() OVER (PARTITION BY table_id ORDER BY start_col)-1 AS start_col, dense_rank() OVER (PARTITION BY table_id ORDER BY start_row)-1 AS start_row FROM (
    SELECT d.table_id, d.start_col, d.start_row, min(d.cell_id) AS cell_id, arg_min(col_span, d.cell_id) AS col_span, arg_min(row_span, d.cell_id) AS row_span,
      arg_min(column_header, d.cell_id) AS column_header, arg_min(row_header, d.cell_id) AS row_header, string_agg(text, ' ' ORDER BY d.cell_id, pdf_cell_id) AS text
    FROM dummy d JOIN final_m USING (table_id, cell_id) JOIN tok USING (table_id, pdf_cell_id) GROUP BY d.table_id, d.start_col, d.start_row)) GROUP BY table_id""", cells="final")
def _(spark, sf):
    """SK1, SK11 and O2: one JSON document per table, responses by cell."""
    return assemble.document(assemble.reindexed(_responses(spark, sf)))


@query("j7_response_boxes", """SELECT table_id, cell_id, string_agg(n || ':' || CAST(l AS BIGINT) || ':' || CAST(b AS BIGINT) || ':' || text, ' ' ORDER BY n) AS boxes FROM (
  SELECT d.table_id, min(d.cell_id) OVER w AS cell_id, row_number() OVER (w ORDER BY d.cell_id, pdf_cell_id) AS n, p.l, p.b, p.text
  FROM dummy d JOIN final_m USING (table_id, cell_id) JOIN tok p USING (table_id, pdf_cell_id) WINDOW w AS (PARTITION BY d.table_id, d.start_col, d.start_row)) GROUP BY table_id, cell_id""", cells="final")
def _(spark, sf):
    """J7: responses with the boxes of their tokens."""
    i = In(spark, sf)
    cells, links = postprocess.run(i.cells, i.pdf)
    found = assemble.responses(cells, links, i.tok, boxes=True)
    told = F.transform("text_cell_bboxes", lambda x, k: F.concat_ws(":", (k + 1).cast("string"), x["l"].cast("long").cast("string"), x["b"].cast("long").cast("string"), x["token"]))
    return found.select(T, "cell_id", F.array_join(told, " ").alias("boxes"))


# --- configuration, word maps, process samples


@query("sc7_word_map", "SELECT DISTINCT source AS name, 'w' || lang AS tag, CAST(list_position(['en','de','fr','es'], lang) AS BIGINT) AS tag_id FROM documents")
def _(spark, sf):
    """SC7: word maps as JSON, one per source."""
    ids = F.element_at(F.create_map(*(F.lit(x) for k, v in enumerate(("en", "de", "fr", "es"), 1) for x in (v, k))), F.col("lang"))
    d = fx.read(spark, sf, "documents").select("source", "lang", ids.alias("id")).distinct().groupBy("source")
    texts = d.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("w"), "lang"), "id")))).alias("value")).select(F.col("source").alias("name"), "value")
    return files.word_map(texts).select("name", "tag", F.col("tag_id").cast("long").alias("tag_id"))


@query("sc5_sc6_config", "SELECT item_id, 512+item_id%9 AS max_tag_len, 200+item_id AS seq_len, CAST(CASE WHEN item_id%2=0 THEN 0.5 ELSE 0.05 END AS DOUBLE) AS threshold FROM benchmark")
def _(spark, sf):
    """SC5, SC6, F10: required lengths of a configuration, checked, and a threshold with a default."""
    n = F.col("item_id")
    model = F.struct((512 + n % 9).alias("max_tag_len"), (200 + n).alias("seq_len"), F.when(n % 2 == 0, 0.5).alias("iou"))
    texts = fx.read(spark, sf, "benchmark").select(n, F.to_json(F.struct(model.alias("model"))).alias("value"))
    c = F.parse_json("value")
    most, length = (files.parameter(c, f"$.model.{k}", "long", required=True) for k in ("max_tag_len", "seq_len"))
    return texts.select("item_id", most.alias("max_tag_len"), files.checked_length(length, F.greatest(most, length)).alias("seq_len"), files.parameter(c, "$.model.iou", "double", 0.05).alias("threshold"))


@query("sc8_prepared_names", "SELECT item_id, 'WORDMAP_' || upper('v' || item_id) || '.json' AS name FROM benchmark")
def _(spark, sf):
    return fx.read(spark, sf, "benchmark").select("item_id", files.prepared_name(F.lit("WORDMAP_<POSTFIX>.json"), F.upper(F.concat(F.lit("v"), F.col("item_id").cast("string")))).alias("name"))


@query("sc21_process_memory", "SELECT event_id, (event_id%1000)*4 AS size_kb, (event_id%300)*4 AS resident_kb, (event_id%500)*3 AS peak_kb FROM events")
def _(spark, sf):
    """SC21: samples of the kernel's two files of a process."""
    n = F.col("event_id")
    s = lambda k: (n % k).cast("string")
    e = fx.read(spark, sf, "events").select("event_id", F.concat_ws(" ", s(1000), s(300), *(F.lit("1"),) * 5).alias("statm"), F.concat(F.lit("Name:\tx\nVmPeak:\t   "), ((n % 500) * 3).cast("string"), F.lit(" kB\nThreads:\t3\n")).alias("status"))
    m = files.statm(F.col("statm"))
    return e.select("event_id", m["size_kb"].alias("size_kb"), m["resident_kb"].alias("resident_kb"), files.status_field(F.col("status"), "VmPeak").alias("peak_kb"))


@query("f9_dtypes", "SELECT doc_id, CASE doc_id%4 WHEN 0 THEN 'float32' WHEN 1 THEN 'float64' WHEN 2 THEN 'int64' ELSE 'int32' END AS dtype FROM documents")
def _(spark, sf):
    code = F.element_at(F.array(*map(F.lit, ("F32", "F64", "I64", "I32"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return fx.read(spark, sf, "documents").select("doc_id", files.dtype_name(code).alias("dtype"))


@query("o9_byte_order", "SELECT lang, string_agg(source, ',' ORDER BY source) AS names FROM (SELECT DISTINCT lang, source FROM documents) GROUP BY lang")
def _(spark, sf):
    """O9: names in the order of their bytes."""
    return assemble.in_order(fx.read(spark, sf, "documents").select("lang", "source").distinct(), "source", by="lang", name="names")


@query("f3_sequence_digests", "SELECT table_id, sha256(string_agg(tag, ' ' ORDER BY pos)) AS sha256 FROM fx_otsl GROUP BY table_id")
def _(spark, sf):
    tokens = fx.otsl(spark, sf).groupBy(T).agg(F.array_sort(F.collect_list(F.struct("pos", "tag"))).alias("x"))
    return tokens.select(T, F.sha2(F.array_join(F.transform("x", lambda v: v["tag"]), " "), 256).alias("sha256"))


@query("sk6_canonical_json", "SELECT event_id, CASE WHEN props IS NOT NULL THEN '{\"a\":1.50,\"b\":[1,2],\"z\":\"\\u00e9' || event_id || '\"}' END AS json FROM events")
def _(spark, sf):
    """SK6 and F8: keys in order, no blanks, numbers as written, other characters escaped."""
    e = fx.read(spark, sf, "events").select("event_id", F.when(F.col("props").isNotNull(), F.concat(F.lit('{ "z": "é'), F.col("event_id").cast("string"), F.lit('", "b": [1, 2],\n "a": 1.50}'))).alias("x"))
    return e.select("event_id", files.canonical_json(F.col("x")).alias("json"))


@query("sq6_overlapping_left", None)
def _(spark, sf):
    """SQ6 with its gate on tables of up to some hundred rows; order matters, so there is no SQL."""
    return postprocess.correct_overlaps(fx.table_cells(spark, sf, big=True)).select(T, "cell_id", *"ltrb")


@query("sc20_regions", "SELECT page_id, CAST(CASE WHEN page_id%3=0 THEN 0 ELSE 1 END AS BIGINT) AS table_index, CAST(CASE WHEN page_id%3=0 THEN 0 ELSE 5 END AS DOUBLE) AS l, CAST(CASE WHEN page_id%3=0 THEN 600+page_id%7 ELSE 50 END AS DOUBLE) AS r FROM pages")
def _(spark, sf):
    """SC20: a page without regions is one region."""
    from ..operators.predict import default_regions

    p = fx.read(spark, sf, "pages").select("page_id", (600 + F.col("page_id") % 7).alias("width"), F.lit(800).alias("height"))
    some = p.where("page_id % 3 <> 0").select("page_id", F.lit(1).alias("table_index"), *(F.lit(v).alias(k) for k, v in zip("ltrb", (5.0, 6.0, 50.0, 60.0))))
    return default_regions(p, some).select("page_id", F.col("table_index").cast("long").alias("table_index"), "l", "r")


@query("m4_m6_stub_predictions", "SELECT page_id, CAST(2 AS BIGINT) AS n_rows, CAST(3 AS BIGINT) AS n_columns, CAST(6 AS BIGINT) AS n_boxes FROM pages")
def _(spark, sf):
    """M4 and M6: the predictor plug with its stub, decoded."""
    from ..operators.predict import StubPredictor

    found = StubPredictor(2, 3).predict(fx.read(spark, sf, "pages").select("page_id", F.lit(0).alias("table_index")))
    tokens = found.select(F.col("page_id").alias(T), F.posexplode(decode.tags(F.col("ids"))).alias("pos", "tag"))
    return otsl.dimensions(tokens).join(found.select(F.col("page_id").alias(T), F.size("boxes").cast("long").alias("n_boxes")), T).select(F.col(T).alias("page_id"), "n_rows", "n_columns", "n_boxes")


__all__ = ["QUERIES", "SQL"]
