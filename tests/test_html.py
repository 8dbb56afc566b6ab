"""Grids of HTML tables: spans, broken tags, records by label, detail fields."""

import pytest

from factweave.sources import html as H

CASES = {
    "plain": ("<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table>", [["A", "B"], ["1", "2"]]),
    "open cells and rows": ("<table><tr><td>1<td>2<tr><td>3<td>4", [["1", "2"], ["3", "4"]]),
    "row span": ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d</table>", [["a", "b"], ["a", "c"], ["d"]]),
    "row span in the middle": ("<table><tr><td>1<td rowspan=3>x<td>2<tr><td>3<td>4<tr><td>5</table>", [["1", "x", "2"], ["3", "x", "4"], ["5", "x"]]),
    "column span": ("<table><tr><td colspan=2>a<td>b<tr><td>c<td>d<td>e</table>", [["a", "a", "b"], ["c", "d", "e"]]),
    "both spans": ("<table><tr><td rowspan=2 colspan=2>a<td>b<tr><td>c</table>", [["a", "a", "b"], ["a", "a", "c"]]),
    "bad spans": ("<table><tr><td rowspan=0>a<td colspan=x>b<td rowspan=-2>c<tr><td>d</table>", [["a", "b", "c"], ["d"]]),
    "span past the end": ("<table><tr><td rowspan=99>a</table>", [["a"]]),
    "inner table": ("<table><tr><td>a<table><tr><td>in</table>z<td>b</table>", [["az", "b"]]),
    "stray ends, scripts, comments": ("</td></table><!-- <table> --><script>'<table>'</script><table></tr><tr>out<td>1 &lt; 2 <!-- x --><style><td></style>&amp; so<br>on</tr></table>", [["1 < 2 & so on"]]),
    "cell without a row": ("<TABLE><TD title='a > b'>x<TD>y</TABLE>", [["x", "y"]]),
    "signs that are no tags": ("<table><tr><td>1 < 2 and <3<td>b", [["1 < 2 and <3", "b"]]),
    "no table": ("<p>x", []),
    "empty table": ("<table></table>", []),
}


@pytest.fixture(scope="module")
def cells(spark):
    rows = [(name, page, 1) for name, (page, _) in CASES.items()] + [("null", None, 1), ("empty", "", 1)]
    return H.table_cells(spark.createDataFrame(rows, "page_id string, html string, row int")).cache()


def test_grids(cells):
    got = {name: {} for name in CASES}
    for r in cells.filter("table_no = 0").collect():
        assert (r.row, r.col) not in got[r.page_id]
        got[r.page_id][r.row, r.col] = r.text
    for name, (_, want) in CASES.items():
        assert got[name] == {(i, j): text for i, line in enumerate(want) for j, text in enumerate(line)}, name
    assert {(r.page_id, r.text) for r in cells.filter("table_no = 1").collect()} == {("inner table", "in")}


def test_wide_spans_are_bounded(spark):
    page = "<table><tr><td colspan=999999>a<td>b</table>"
    assert H.table_cells(spark.createDataFrame([(1, page)], "page_id long, html string")).count() == 1001


def test_long_broken_pages_take_linear_time(spark):
    pages = ["<table><tr><td>" + bad * 200_000 for bad in ("<a ", "<td \"", "x=", "<!--", "<td a='")]
    assert H.table_cells(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")).select("page_id").distinct().count() == 5


def test_records_need_every_label(spark):
    page = "<table><tr><th>Reg. No<th>Note<th>File</tr><tr><td>7<td><td><a href='/f?a=1&amp;b=2'>pdf</a><tr><td colspan=2>short</table><table><tr><td>Reg no<td>other<tr><td>1<td>2</table><table><tr><td>x</table>"
    cells = H.table_cells(spark.createDataFrame([("p", page)], "page_id string, html string"))
    labels = {"reg": ["registration", "reg no"], "file": ["file", "document"]}
    assert [tuple(r) for r in H.table_records(cells, labels).collect()] == [("p", 0, 1, "7", None, "pdf", "/f?a=1&b=2")]
    assert [tuple(r) for r in H.missing_labels(cells, labels).collect()] == [("p", 1, ["file"])]


def test_detail_fields(spark):
    page = "<table><tr><th>Area</th><td>4</td><td>Floor :</td><td><a href=/u>2</a></td></tr><tr><th colspan=3>Wide<td>v<tr><th>None<td><tr><th>A<th>B<td>c<tr><td>no<td>label</table>"
    cells = H.table_cells(spark.createDataFrame([(5, page)], "page_id int, html string"))
    assert sorted((r.page_id, r.row, r.label, r.value, r.link) for r in H.detail_fields(cells).collect()) == [(5, 0, "Area", "4", None), (5, 0, "Floor", "2", "/u"), (5, 1, "Wide", "v", None), (5, 3, "B", "c", None)]


def test_ids_stay_exact_beside_nulls(spark):
    page = "<table><tr><td>a</table>"
    cells = H.table_cells(spark.createDataFrame([((1 << 60) + 1, page), (None, page), (3, None)], "page_id long, html string"))
    assert {r.page_id for r in cells.collect()} == {(1 << 60) + 1, None}


def test_records_and_fields_of_grids_are_read_where_the_page_is(spark):
    """cells were written, then joined and grouped again; a grid is one row now, and nothing is dealt anew."""
    page = "<table id='t'><tr><th>A<th rowspan=2>B:<th>C<tr><td>1<td>2<tr><td>3<td>4<td>5<table><tr><td>x</table><tr><td colspan=3>note</table><table><tr><th>L<td>7</table>"
    pages = spark.createDataFrame([(1, page), (2, "<table><tr></tr><tr><td>a<td>b<td>c</table>"), (None, page)], "page_id long, html string")
    grids, cells, labels = H.table_grids(pages), H.table_cells(pages), {"a": ["a"], "c": ["c"]}
    for got, same in ((H.grid_records(grids, labels), H.table_records(cells, labels)), (H.grid_fields(grids), H.detail_fields(cells))):
        plan = got._jdf.queryExecution().toString()
        assert "Exchange" not in plan and "Join" not in plan
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, same.collect()), key=str)
    assert [tuple(r) for r in H.grid_records(grids, labels).orderBy("row").collect()] == [(1, 0, 1, "1", None, "2", None), (1, 0, 2, "3", None, "5", None), (1, 0, 3, "note", None, "note", None)]
    assert sorted((r.page_id, r.label, r.value) for r in H.grid_fields(grids).collect()) == [(1, "L", "7")]
