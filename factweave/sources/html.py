"""Tables of HTML pages as grids of cells, and records and label/value fields read from the grids.

A page is read once, tag by tag, in the task that holds it; a table's grid is one row of what follows. What broken pages give is defined:

* a cell ends at the next cell, row or table tag, a row at the next row or table tag, a table at its end tag or the end of the page;
* end tags that close nothing are ignored, cells outside a row start one, text outside a cell is left out;
* a table inside a cell is a table of its own, numbered by where it starts; its text isn't the outer cell's;
* a span of 0, of no number or below 0 counts as 1; a column span is at most 1,000, as browsers have it, and a row span ends with the table's rows;
* scripts, styles and comments hold no tags and no text; an unclosed one takes the rest of the page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.cut import cut

_TAG = re.compile(r"<(?:(?=[sS])(?i:(script|style)\b.*?(?:</\1\s*>|\Z))|(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^'\"<>]++|\"[^\"]*\"|'[^']*')*+)>|!--.*?(?:-->|\Z))", re.S)
_ATTRIBUTE = re.compile(r"(?<![a-z-])([a-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_MOST_COLUMNS = 1000
#: Rows of grids that a task holds before it gives them on, but for those of one page.
_MOST_ROWS = 10_000
#: Tags after which words don't run together.
_BREAKS = {"br", "p", "div", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6"}
#: A row of a grid: its number, and of each of its places, from the left, the column, the width of its cell, whether that is a header, its text, its link, and whether it reaches here by a span.
_ROW = "row int, cols array<int>, widths array<int>, headers array<boolean>, texts array<string>, links array<string>, spanned array<boolean>"


def _attributes(text: str) -> dict[str, str]:
    return {name.lower(): html.unescape(a or b or c).strip() for name, a, b, c in _ATTRIBUTE.findall(text)} if "=" in text else {}


def _span(value: str | None) -> int:
    return max(1, int(value)) if value and re.fullmatch(r"[0-9]{1,6}", value) else 1


class _Cell:
    __slots__ = ("header", "text", "link", "width")

    def __init__(self, header: bool) -> None:
        self.header, self.text, self.link, self.width = header, [], None, 1


class _Table:
    """The cells of one table while it is read."""

    __slots__ = ("number", "name", "row", "open", "in_row", "hanging", "due", "column", "slots")

    def __init__(self, number: int, name: str | None) -> None:
        self.number, self.name, self.row, self.open = number, name, -1, None
        self.in_row, self.hanging, self.slots = False, {}, []  # hanging: column -> (rows left, cell) of row spans

    def end_cell(self) -> None:
        if self.open:
            text = "".join(self.open.text)
            self.open.text = " ".join((html.unescape(text) if "&" in text else text).split())
            self.open = None

    def end_row(self) -> None:
        if self.open:
            self.end_cell()
        if self.in_row and self.hanging:
            self.fill(_MOST_COLUMNS * _MOST_COLUMNS)
            self.hanging = {c: (n - 1, cell) for c, (n, cell) in self.hanging.items() if n > 1}
        self.in_row = False

    def fill(self, until: int) -> None:
        """Puts the cells that hang down from rows above into this row, up to a column."""
        for column in sorted(c for c in self.due if c < until):
            self.slots.append((self.row, column, self.due.pop(column)[1], True))

    def start_row(self) -> None:
        if self.in_row:
            self.end_row()
        self.row, self.in_row, self.column, self.due = self.row + 1, True, 0, dict(self.hanging)

    def start_cell(self, header: bool, attributes: dict[str, str]) -> None:
        if self.open:
            self.end_cell()
        if not self.in_row:
            self.start_row()
        while self.column in self.due:
            self.fill(self.column + 1)
            self.column += 1
        cell = self.open = _Cell(header)
        self.slots.append((self.row, self.column, cell, False))
        if not attributes:
            self.column += 1
            return
        first, down = self.column, _span(attributes.get("rowspan"))
        for k in range(min(_span(attributes.get("colspan")), _MOST_COLUMNS)):
            if k:
                if self.column in self.due:  # a span from above keeps its place
                    break
                self.slots.append((self.row, self.column, cell, True))
            if down > 1:
                self.hanging[self.column] = (down, cell)
            self.column += 1
        cell.width = self.column - first


def _tables(page: str) -> list[_Table]:
    found: list[_Table] = []
    stack: list[_Table] = []
    top = None
    parts = _TAG.split(page)  # text, then four groups and a text for each tag
    at = iter(parts)
    if (text := next(at)) and top and top.open:
        top.open.text.append(text)
    for _, ends, tag, attributes, text in zip(at, at, at, at, at):
        if tag is None:  # a comment, script or style
            tag = ""
        elif not tag.islower():
            tag = tag.lower()
        if tag == "td" or tag == "th":
            if top:
                if ends:
                    top.end_cell()
                else:
                    top.start_cell(tag == "th", _attributes(attributes) if attributes else {})
        elif tag == "tr":
            if top:
                top.end_row() if ends else top.start_row()
        elif tag == "table":
            if not ends:
                top = _Table(len(found), _attributes(attributes).get("id"))
                stack.append(top)
                found.append(top)
            elif top:
                stack.pop().end_row()
                top = stack[-1] if stack else None
        elif top and tag in ("thead", "tbody", "tfoot"):
            top.end_row()
        elif top and top.open:
            if tag == "a" and not ends and top.open.link is None:
                top.open.link = _attributes(attributes).get("href") or None
            elif tag in _BREAKS:
                top.open.text.append(" ")
        if text and top and top.open:
            top.open.text.append(text)
    for table in reversed(stack):
        table.end_row()
    return found


class _Grids:
    """Arrow columns of grids while they are gathered."""

    def __init__(self) -> None:
        self.page, self.number, self.name, self.first_row = [], [], [], [0]
        self.row, self.first_cell = [], [0]
        self.cells = [[] for _ in range(6)]

    def add(self, page: int, table: _Table) -> None:
        cols, widths, headers, texts, links, spanned = self.cells
        last = -1
        for row, col, cell, again in table.slots:
            if row != last:
                if last >= 0:
                    self.first_cell.append(len(cols))
                self.row.append(row)
                last = row
            cols.append(col)
            widths.append(cell.width)
            headers.append(cell.header)
            texts.append(cell.text)
            links.append(cell.link)
            spanned.append(again)
        if last >= 0:
            self.first_cell.append(len(cols))
            self.page.append(page)
            self.number.append(table.number)
            self.name.append(table.name)
            self.first_row.append(len(self.row))

    def batch(self, key: str, keys: pa.Array) -> pa.RecordBatch:
        offsets = pa.array(self.first_cell, pa.int32())
        kinds = [pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.bool_()]
        places = [pa.ListArray.from_arrays(offsets, pa.array(values, kind)) for values, kind in zip(self.cells, kinds)]
        rows = pa.StructArray.from_arrays([pa.array(self.row, pa.int32()), *places], names=[f.split()[0] for f in _ROW.split(", ")])
        table = pa.ListArray.from_arrays(pa.array(self.first_row, pa.int32()), rows)
        return pa.RecordBatch.from_arrays([keys.take(pa.array(self.page, pa.int64())), pa.array(self.number, pa.int32()), pa.array(self.name, pa.string()), table], names=[key, "table_no", "table_id", "rows"])


def table_grids(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """A row for every table with cells, as (key, table_no, table_id, rows): ``rows`` are the grid's rows with cells, in order, as structs of ``_ROW``.

    All that reads a grid finds it in one row, so records and fields need no join of cells. Pages that are null or have no table give no rows.
    """
    of_id = pages.schema[key].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, grids = batch.column(0), _Grids()
            for at, page in enumerate(batch.column(1).to_pylist()):
                if page and "<table" in page.lower():
                    for table in _tables(page):
                        grids.add(at, table)
                    if len(grids.row) >= _MOST_ROWS:
                        yield grids.batch(key, keys)
                        grids = _Grids()
            if grids.row:
                yield grids.batch(key, keys)

    return pages.select(key, F.col(column).cast("string").alias("__page")).mapInArrow(read, f"`{key}` {of_id}, table_no int, table_id string, rows array<struct<{_ROW.replace(' ', ':').replace(',:', ',')}>>")


def table_cells(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """The grid of every table cell by cell: (key, table_no, table_id, row, col, width, header, text, link, spanned), all counted from 0.

    A cell that spans fills each of its places, with ``spanned`` at all but the first; ``width`` is the number of its columns.
    The cells are written to the shared folder, so that what reads them several times reads pages once.
    """
    rows = table_grids(pages, key, column).select(key, "table_no", "table_id", F.explode("rows").alias("r"))
    each = F.inline(F.arrays_zip(*[F.col(f"r.{c}").alias(c) for c in ("cols", "widths", "headers", "texts", "links", "spanned")]))
    cells = rows.select(key, "table_no", "table_id", F.col("r.row").alias("row"), each)
    return cut(cells.toDF(key, "table_no", "table_id", "row", "col", "width", "header", "text", "link", "spanned"), "table-cells")


def _grids(cells: DataFrame, key: str) -> DataFrame:
    """Cells as ``table_grids`` has them."""
    places = F.sort_array(F.collect_list(F.struct("col", "width", "header", "text", "link", "spanned")))  # a row of one table
    rows = cells.groupBy(key, "table_no", "table_id", "row").agg(places.alias("p"))
    row = F.struct("row", *[F.col(f"p.{c}").alias(name) for c, name in (("col", "cols"), ("width", "widths"), ("header", "headers"), ("text", "texts"), ("link", "links"), ("spanned", "spanned"))])
    return rows.select(key, "table_no", "table_id", row.alias("r")).groupBy(key, "table_no", "table_id").agg(F.sort_array(F.collect_list("r")).alias("rows"))


def _label(c: Column) -> Column:
    """Letters and digits only, in lower case: how column labels are compared."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def _known(labels: dict[str, list[str]]) -> Column:
    """Names by the labels that mean them."""
    return F.create_map(*[F.lit(x) for name, texts in labels.items() for text in texts for x in (re.sub(r"[\W_]+", "", text.lower()), name)])


def _labelled(cells: DataFrame, labels: dict[str, list[str]], key: str) -> DataFrame:
    """(key, table_no, col, name) of the first-row cells that carry a configured label; of several columns of one name the first counts."""
    head = cells.filter("row = 0").select(key, "table_no", "col", F.try_element_at(_known(labels), _label(F.col("text"))).alias("name")).filter("name IS NOT NULL")
    return head.groupBy(key, "table_no", "name").agg(F.min("col").alias("col"))


def grid_records(grids: DataFrame, labels: dict[str, list[str]], key: str = "page_id") -> DataFrame:
    """The rows under a table's first one as (key, table_no, row, one column for each name of ``labels``, and its link as name_link).

    ``labels`` maps a name to the column labels that mean it. Only tables with a column for each name count (``missing_labels`` lists the others);
    a row without a cell in one of them, such as a note across a short row, is no record, and pages without an id have none.
    """
    first = F.element_at("rows", 1)
    names = F.when(first["row"] == 0, F.transform(first["texts"], lambda x: F.try_element_at(_known(labels), _label(x))))
    at = {name: F.get(first["cols"], (F.array_position("__names", name) - 1).cast("int")).alias(f"__{i}") for i, name in enumerate(labels)}
    whole = grids.filter(F.col(key).isNotNull()).withColumn("__names", names).select(key, "table_no", "rows", *at.values())
    rows = whole.dropna(subset=[f"__{i}" for i in range(len(labels))]).select("*", F.explode("rows").alias("__r")).drop("rows").filter("__r.row > 0")
    rows = rows.withColumns({f"__{i}": F.array_position("__r.cols", F.col(f"__{i}")).cast("int") - 1 for i in range(len(labels))})
    columns = [x for i, name in enumerate(labels) for x in (F.get("__r.texts", F.col(f"__{i}")).alias(name), F.get("__r.links", F.col(f"__{i}")).alias(f"{name}_link"))]
    return rows.filter(" AND ".join(f"__{i} >= 0" for i in range(len(labels)))).select(key, "table_no", F.col("__r.row").alias("row"), *columns)


def table_records(cells: DataFrame, labels: dict[str, list[str]], key: str = "page_id") -> DataFrame:
    """``grid_records`` of cells, which are gathered to grids first."""
    return grid_records(_grids(cells, key), labels, key)


def missing_labels(cells: DataFrame, labels: dict[str, list[str]], key: str = "page_id") -> DataFrame:
    """(key, table_no, missing): the names for which a table has no column, for tables that lack some but not all."""
    found = _labelled(cells, labels, key).groupBy(key, "table_no").agg(F.collect_set("name").alias("has"))  # a few names
    missing = F.array_sort(F.array_except(F.array(*[F.lit(n) for n in labels]), "has"))
    return found.select(key, "table_no", missing.alias("missing")).filter("size(missing) > 0")


def grid_fields(grids: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, table_no, row, label, value, link): a header cell, or one whose text ends in a colon, with the cell right of it.

    Rows of several such pairs give each. A label without a value, or followed by another label, gives none; pages without an id have none.
    """
    rows = grids.filter(F.col(key).isNotNull()).select(key, "table_no", F.explode("rows").alias("r")).select(key, "table_no", "r.*")
    rows = rows.filter(F.array_contains("headers", True) | F.exists("texts", lambda x: x.endswith(":")))
    of = lambda c, i: F.get(c, F.col(i))
    own_label = lambda i: of("headers", i) | of("texts", i).endswith(":")
    labels = rows.withColumn("__i", F.explode(F.sequence(F.lit(0), F.size("cols") - 1))).filter(~of("spanned", "__i") & own_label("__i"))
    pairs = labels.withColumn("__j", F.array_position("cols", of("cols", "__i") + of("widths", "__i")).cast("int") - 1).filter(F.col("__j") >= 0)
    pairs = pairs.filter(~of("spanned", "__j") & ~own_label("__j"))
    found = pairs.select(key, "table_no", "row", F.trim(F.regexp_replace(of("texts", "__i"), r"\s*:$", "")).alias("label"), of("texts", "__j").alias("value"), of("links", "__j").alias("link"))
    return found.filter("label <> '' AND value <> ''")


def detail_fields(cells: DataFrame, key: str = "page_id") -> DataFrame:
    """``grid_fields`` of cells, which are gathered to grids first."""
    return grid_fields(_grids(cells, key), key)
