"""Hand-worked cases of the table-structure operators."""

from pyspark.sql import functions as F

from gridloom.functions import geometry as G
from gridloom.operators import assemble, decode, evaluate, match, otsl, postprocess

CELL = "table_id long, cell_id long, row_id long, column_id long, l double, t double, r double, b double, cell_class long, label string, colspan_val long, rowspan_val long"
TOKEN = "table_id long, pdf_cell_id long, l double, t double, r double, b double, text string"


def tokens_of(spark, text):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(text.split())], "table_id long, pos long, tag string")


def test_geometry(spark):
    df = spark.createDataFrame([(0.0, 0.0, 2.0, 2.0, 1.0, 1.0, 3.0, 3.0)], "al double, at double, ar double, ab double, bl double, bt double, br double, bb double")
    a, b = (tuple(F.col(p + k) for k in "ltrb") for p in "ab")
    row = df.select(G.iou(a, b).alias("i"), G.overlaps(a, b).alias("o"), G.area(G.union(a, b)).alias("u"), G.over_second(a, b).alias("s")).first()
    assert abs(row["i"] - 1 / 7) < 1e-12 and row["o"] and row["u"] == 9 and row["s"] == 0.25
    even = spark.range(1).select(*G.round_clamped(tuple(F.lit(x) for x in (0.5, 1.5, 99.0, -3.0)), F.lit(10), F.lit(10))).first()
    assert tuple(even) == (0, 2, 10, 2)


def test_spans_and_html(spark):
    grid = otsl.grid(tokens_of(spark, "ched lcel ched nl fcel fcel ucel nl rhed fcel fcel nl"))
    spans = {(r["row_id"], r["column_id"]): (r["colspan"], r["rowspan"]) for r in otsl.spans(grid).collect()}
    assert spans[(0, 0)] == (2, 1) and spans[(0, 2)] == (1, 2) and spans[(2, 1)] == (1, 1)
    html = otsl.html(tokens_of(spark, "ched lcel ched nl fcel fcel ucel nl rhed fcel fcel nl")).first()["html"]
    assert html.startswith('<thead>|<tr>|<td| colspan="2"|>|</td>|<td| rowspan="2"|>|</td>|</tr>|</thead>|<tr>')
    assert otsl.tags_of_html(html.split("|"))["tags"] == "fcel lcel fcel nl fcel fcel ucel nl fcel fcel fcel nl".split()


#: Tags and the HTML of their cells, row by row.
SPANS = {
    "fcel lcel fcel nl ucel xcel fcel nl": '<tr>|<td| colspan="2"| rowspan="2"|>|</td>|<td>|</td>|</tr>|<tr>|<td>|</td>|</tr>',
    "fcel xcel nl fcel fcel nl": '<tr>|<td| rowspan="1"| colspan="2"|>|</td>|</tr>|<tr>|<td>|</td>|<td>|</td>|</tr>',
    "fcel xcel nl ucel xcel nl": '<tr>|<td| rowspan="2"| rowspan="2"| colspan="2"|>|</td>|</tr>|<tr>|</tr>',
    "fcel xcel nl xcel xcel nl": '<tr>|<td| rowspan="2"| colspan="2"|>|</td>|</tr>|<tr>|</tr>',
    "fcel fcel nl xcel fcel nl": "<tr>|<td>|</td>|<td>|</td>|</tr>|<tr>|<td>|</td>|</tr>",
    # the second span over rows and columns meets the first: it is cancelled, with its rowspan
    "fcel xcel fcel nl xcel fcel xcel nl fcel ucel fcel nl": '<tr>|<td| rowspan="2"| colspan="2"|>|</td>|<td>|</td>|</tr>|<tr>|<td>|</td>|</tr>|<tr>|<td>|</td>|<td>|</td>|</tr>',
    # short rows are filled with lcel, empty rows go
    "ched nl nl fcel fcel nl": '<thead>|<tr>|<td| colspan="2"|>|</td>|</tr>|</thead>|<tr>|<td>|</td>|<td>|</td>|</tr>',
    "xcel fcel nl": "xcel|fcel|nl",
    "<td> </td>": "<td>|</td>",
}


def test_two_dimensional_spans(spark):
    rows = [(k, i, t) for k, text in enumerate(SPANS) for i, t in enumerate(text.split(" "))]
    tokens = spark.createDataFrame(rows, "table_id long, pos long, tag string")
    got = {r["table_id"]: r["html"] for r in otsl.html(tokens).collect()}
    assert [got[k] for k in range(len(SPANS))] == list(SPANS.values())
    spans = {(r["table_id"], r["cell_id"]): (r["colspan"], r["rowspan"]) for r in otsl.span_map(tokens).collect()}
    assert spans == {(0, 0): (2, 2), (1, 0): (2, 1), (2, 0): (2, 2), (3, 0): (2, 2), (5, 0): (2, 2), (5, 4): (1, 2), (6, 0): (2, 1)}
    empty = tokens.limit(0)
    assert otsl.html(empty).count() == 0 and otsl.span_map(empty).count() == 0


def test_html_to_tags(spark):
    read = lambda html, contents=None: otsl.tags_of_html(html.split("|"), contents)
    two = '<tr>|<td| colspan="2"| rowspan="2"|>|</td>|<td>|</td>|</tr>|<tr>|<td>|</td>|</tr>'
    assert " ".join(read(two)["tags"]) == "fcel xcel fcel nl xcel xcel fcel nl"
    assert read(two)["spans"] == {0: [2, 2]} and read(two)["square"] and read(two)["n_columns"] == 3
    swapped = two.replace(' colspan="2"| rowspan="2"', ' rowspan="2"| colspan="2"')
    assert read(swapped) == read(two)
    # emptiness by what a cell holds beside marks; spans count too
    assert " ".join(read(two, [["<b>", " ", "</b>"], ["x"], []])["tags"]) == "ecel xcel fcel nl xcel xcel ecel nl"
    tall = '<tr>|<td>|</td>|<td| rowspan="3"|>|</td>|</tr>|<tr>|<td>|</td>|</tr>|<tr>|<td>|</td>|</tr>'
    assert " ".join(read(tall)["tags"]) == "fcel fcel nl fcel ucel nl fcel ucel nl"
    # spans beyond 20 are passed over, so the rows differ in length and are filled up
    far = read('<tr>|<td| colspan="21"|>|</td>|</tr>|<tr>|<td>|</td>|</tr>')
    assert " ".join(far["tags"]) == "fcel nl fcel nl" and far["spans"] == {}
    short = read("<tr>|<td>|</td>|<td>|</td>|</tr>|<tr>|<td>|</td>|</tr>")
    assert " ".join(short["tags"]) == "fcel fcel nl fcel ucel nl" and short["square"]
    # a row beyond the one above is a failure
    assert read("<tr>|<td>|</td>|</tr>|<tr>|<td>|</td>|<td>|</td>|<td>|</td>|</tr>") is None
    found = otsl.from_html(spark.createDataFrame([(1, two, [["x"], ["x"], [" "]]), (2, "<tr>|<td>|</td>|</tr>|<tr>|<td>|</td>|<td>|</td>|<td>|</td>|</tr>", None)], "table_id long, html string, contents array<array<string>>"))
    rows = {r["table_id"]: r for r in found.collect()}
    assert rows[1]["ok"] and rows[1]["tags"] == "fcel xcel fcel nl xcel xcel ecel nl" and not rows[2]["ok"] and rows[2]["tags"] is None


def test_golden_sequence(spark):
    """A recorded page: ids to tags to HTML."""
    ids = [2, 5, 10, 10, 9] + [11, 5, 5, 9] * 6 + [3]
    df = spark.createDataFrame([(ids,)], "ids array<int>")
    tags = df.select(decode.tags(F.col("ids")).alias("t")).first()["t"]
    assert " ".join(tags) == "fcel ched ched nl" + " rhed fcel fcel nl" * 6
    html = otsl.html(tokens_of(spark, " ".join(tags))).first()["html"]
    assert html == "<thead>|<tr>|<td>|</td>|<td>|</td>|<td>|</td>|</tr>|</thead>" + "|<tr>|<td>|</td>|<td>|</td>|<td>|</td>|</tr>" * 6


def test_decode_helpers(spark):
    df = spark.createDataFrame([([5, 5, 3, 0, 0], [0.1, 0.7, 0.7])], "ids array<int>, v array<double>")
    r = df.select(decode.until_end(F.col("ids")).alias("e"), decode.without_padding(F.col("ids")).alias("p"), decode.argmax(F.col("v")).alias("m")).first()
    assert r["e"] == [5, 5, 3] and r["p"] == [5, 5, 3] and r["m"] == 1
    fixed = decode.corrected(tokens_of(spark, "fcel xcel nl ucel lcel nl")).orderBy("pos").collect()
    assert [x["tag"] for x in fixed] == ["fcel", "lcel", "nl", "ucel", "fcel", "nl"]
    html = spark.createDataFrame([([1, 2, 3], ["<td", ' colspan="2"', ">", "</td>", "<td>", "</td>"])], "b array<int>, h array<string>")
    assert html.select(decode.synced(F.col("b"), F.col("h")).alias("x")).first()["x"] == [1, 3]


def test_best_match_and_orphans(spark):
    cells = spark.createDataFrame([(1, 0, 0, 0, 0.0, 0.0, 10.0, 10.0, 2, "fcel", None, None), (1, 1, 0, 1, 10.0, 0.0, 20.0, 10.0, 2, "fcel", None, None)], CELL)
    toks = spark.createDataFrame([(1, 0, 5.0, 0.0, 15.0, 10.0, "tie"), (1, 1, 30.0, 0.0, 40.0, 10.0, "far"), (1, 2, 8.0, 0.0, 18.0, 10.0, "right")], TOKEN)
    m = match.intersection_over_token(cells, toks)
    assert {(r["pdf_cell_id"], r["cell_id"]) for r in match.best_match(m).collect()} == {(0, 0), (2, 1)}
    assert [r["pdf_cell_id"] for r in match.orphans(toks, m).collect()] == [1]
    done, links = postprocess.run(cells, toks)
    assert done.count() >= 1 and links.where("pdf_cell_id = 0").count() == 1
    found = assemble.reindexed(assemble.responses(done, links, toks))
    assert assemble.sizes(found).first()["num_rows"] == 1 and '"text"' in assemble.document(found).first()["document"]


def test_push_apart():
    assert postprocess.push_apart([[0, 0, 10, 10], [20, 0, 30, 10]]) == [[0, 0, 10, 10], [20, 0, 30, 10]]
    assert postprocess.push_apart([[0, 0, 10, 10], [8, 0, 20, 10]]) == [[0, 0, 7, 10], [9, 0, 20, 10]]


def test_deleted_columns_and_pages(spark):
    cells = spark.createDataFrame([(t, c, 0, c, 10.0 * c, 0.0, 10.0 * c + 9, 9.0, 2, "fcel", None, None) for t in (1, 2) for c in range(4)], CELL)
    gone = spark.createDataFrame([(1, 0), (1, 2)], "table_id long, column_id long")
    assert sorted((r["table_id"], r["cell_id"], r["column_id"]) for r in postprocess.delete_columns(cells, gone).collect()) == [(1, 1, 0), (1, 3, 1), (2, 0, 0), (2, 1, 1), (2, 2, 2), (2, 3, 3)]
    tokens = spark.createDataFrame([(1, 0, 1.0, 1.0, 8.0, 8.0, "a")], TOKEN)
    done, links = postprocess.page(cells, tokens, correct_overlapping_cells=True)
    assert {r["cell_id"] for r in done.where("table_id = 2").collect()} == {0, 1, 2, 3}
    assert [tuple(r)[:3] for r in links.collect()] == [(1, 0, 0)]
    plain, none = postprocess.page(cells, tokens, do_cell_matching=False)
    assert plain.count() == 8 and none.count() == 0


def test_merged_boxes(spark):
    boxes = spark.createDataFrame([(1, i, 10.0 * i, 0.0, 2.0, 2.0) for i in range(5)], "table_id long, box_ord long, cx double, cy double, w double, h double")
    pairs = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 4, -1)], "table_id long, box_ord long, next_ord long")
    got = lambda c: {r["box_ord"]: r["w"] for r in decode.merged(boxes, pairs, c).collect()}
    assert got(True) == {0: 12.0, 1: 12.0, 3: 2.0, 4: 2.0}
    assert got(False) == {0: 12.0, 2: 2.0, 3: 2.0, 4: 2.0}


def test_greedy_pairs(spark):
    rows = [("baseline", 1, 0, "a", 5, 0.0, 0.0, 10.0, 10.0), ("baseline", 1, 1, "a", 5, 1.0, 0.0, 11.0, 10.0), ("candidate", 1, 0, "a", 5, 1.0, 0.0, 11.0, 10.0)]
    d = spark.createDataFrame(rows, "variant string, image long, ord long, label string, score long, l double, t double, r double, b double")
    assert [(r["x"], r["y"]) for r in evaluate.greedy_pairs(d, "candidate").collect()] == [(0, 0)]
    assert evaluate.quality(evaluate.paired(d.where("image = 2"), "candidate")).first()["mean_iou"] == 1.0
