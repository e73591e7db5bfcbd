"""Tables on pages: found by the alignment of words, structured to headers, labels and cells.

*Finding.* Words of a line with narrow spaces between them are one piece. Lines with several pieces that follow each other are a table.
Its columns come from a sweep over the x-intervals of its pieces: an interval that begins right of all before it begins a column.
Documents whose pages hold ruled tables keep those; where ruling finds next to nothing, alignment is tried instead.

*Structure.* Header rows (one, or two where a row of groups stands on a row of names), the header of every column, the label of every row,
and which cells can't be told apart. Rows may have any number of cells, and what a table doesn't show is null.

Everything is grouped by page or table, which are bounded.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import periods
from ..functions import text as texts
from . import page_arrays
from .layout import text_lines
from .verify import amounts_in

#: Spaces from which on two words are in different cells, and lines of a table at least.
CELL_GAP, TABLE_LINES = 10.0, 3
#: Steps between the lines of a table in line heights, at most.
LINE_STEP = 2.5
# Tables a page below which ruling has failed; characters of a header of two levels; points above a table in which its caption stands.
LOW_DENSITY, HEADER_CHARS, CAPTION_POINTS = 0.2, 15, 45.0
# How a caption or header states the scale of its numbers.
_SCALE = r"(?:lakhs?|lacs?|crores?|cr\.?|millions?|mn|mm|billions?|bn|thousands?|k)"
_CURRENCY = r"(?:rs\.?|inr|₹|us\$|usd|\$|eur|€|gbp|£)"
SCALE_PHRASE = rf"(?i)\b(?:{_CURRENCY}\.?\s*)?(?:in|figures?\s+in|amount\s+in|values?\s+in)\s+(?:{_CURRENCY}\s+)?({_SCALE})\b"


def aligned_cells(words: DataFrame, gap: float = CELL_GAP) -> DataFrame:
    """(page_id, table_id, row, col, x0, top, x1, bottom, value) of the tables that aligned words make.

    A piece that reaches over several columns stands in the first; columns without a piece have no cell in that row.
    """
    cells = page_arrays.over_pages(words.where("page_id is not null"), partial(_cells, gap=gap), "nth int, row int, col int, x0 double, top double, x1 double, bottom double, value string")
    return cells.select("page_id", F.concat_ws("#", F.col("page_id").cast("string"), "nth").alias("table_id"), "row", "col", *page_arrays.BOX, "value")


def _cells(w: page_arrays.Words, gap: float) -> pa.RecordBatch | None:
    """The cells of the tables on some pages."""
    begins = w.first | (w.x0 - page_arrays.reach_before(w.x1, w.first) > gap)
    start = np.flatnonzero(begins)
    x0, top, x1, bottom = page_arrays.boxes(w.x0, w.top, w.x1, w.bottom, start)
    of_line = np.cumsum(w.first[start]) - 1  # of the pieces
    line = np.flatnonzero(w.first[start])  # first piece of each line
    n = np.diff(np.append(line, len(start)))

    # runs of lines with several pieces, close to each other
    line_top, line_bottom, page = np.fmin.reduceat(top, line), np.fmax.reduceat(bottom, line), w.page[start][line]
    near = line_top[1:] - line_bottom[:-1] <= LINE_STEP * np.fmax(line_bottom[1:] - line_top[1:], 1.0)
    same = np.append(False, near & (n[1:] > 1) & (n[:-1] > 1) & (page[1:] == page[:-1]))
    run = np.cumsum(~same) - 1
    lines_of = np.bincount(run)
    is_table = (lines_of >= TABLE_LINES) & (n[~same] > 1)
    if not is_table.any():
        return None
    begin = np.flatnonzero(~same)
    row = np.arange(len(line)) - begin[run]
    table = np.cumsum(is_table) - 1  # of the runs
    page_of = page[begin][is_table]
    nth = np.arange(len(page_of)) - np.maximum.accumulate(np.where(page_arrays.first_of(page_of), np.arange(len(page_of)), 0)) + 1

    piece = np.flatnonzero(is_table[run[of_line]])
    of, row, width, x = table[run[of_line[piece]]], row[of_line[piece]], n[of_line[piece]], x0[piece]
    # columns: gaps in what the table's pieces cover; wide pieces over several columns don't count
    most = np.maximum.reduceat(width, np.flatnonzero(page_arrays.first_of(of)))
    full = np.flatnonzero(width == most[of])
    full = full[np.lexsort((row[full], x1[piece][full], x[full], of[full]))]
    first = page_arrays.first_of(of[full])
    edge = np.flatnonzero(first | (x[full] > page_arrays.reach_before(x1[piece][full], first)))
    reach, reach_of = np.fmax.reduceat(x1[piece][full], edge), of[full][edge]
    least = np.searchsorted(reach_of, np.arange(len(most)))
    edges = np.diff(np.append(least, len(reach)))
    # a piece stands in the first column that doesn't end on its left
    col, left = np.zeros(len(of), np.int64), np.arange(len(of))
    for k in range(int(edges.max())):
        left = left[edges[of[left]] > k]
        col[left] += reach[least[of[left]] + k] < x[left]
    col = np.minimum(col, edges[of] - 1)

    opens = page_arrays.first_of(of, row, col)
    at = np.flatnonzero(opens)
    value = page_arrays.joined(page_arrays.joined(w.text, begins).take(pa.array(piece)), opens)
    cell = page_arrays.boxes(x, top[piece], x1[piece], bottom[piece], at)
    columns = [w.taken("page_id", start[piece[at]]), *(pa.array(c, pa.int32()) for c in (nth[of[at]], row[at], col[at])), *page_arrays.doubles(*cell), value]
    return pa.RecordBatch.from_arrays(columns, names=["page_id", "nth", "row", "col", *page_arrays.BOX, "value"])


def with_fallback(pages: DataFrame, ruled: DataFrame, aligned: DataFrame) -> DataFrame:
    """Cells of each document's tables, with strategy: `ruled`, unless there are under LOW_DENSITY tables a page and alignment finds more.

    `pages` has (doc_id, page_id) for every page; the cells have page_id and table_id.
    """
    count = lambda cells, name: cells.join(pages, "page_id").groupBy("doc_id").agg(F.count_distinct("table_id").alias(name))
    totals = pages.groupBy("doc_id").agg(F.count("*").alias("pages")).join(count(ruled, "ruled"), "doc_id", "left").join(count(aligned, "aligned"), "doc_id", "left").fillna(0)
    strategy = F.when((F.col("ruled") / F.col("pages") < LOW_DENSITY) & (F.col("aligned") > F.col("ruled")), "aligned").otherwise("ruled")
    chosen = pages.join(totals.select("doc_id", strategy.alias("strategy")), "doc_id")
    both = ruled.withColumn("strategy", F.lit("ruled")).unionByName(aligned.withColumn("strategy", F.lit("aligned")))
    return both.join(chosen, ["page_id", "strategy"])


def scale_phrase(text) -> F.Column:
    """The first phrase that states a scale, as written, or an empty text."""
    return F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), SCALE_PHRASE, 0))


def captions(cells: DataFrame, words: DataFrame) -> DataFrame:
    """(table_id, caption, scale) of every table: the lines within CAPTION_POINTS above it, and the first scale in them or the first two rows."""
    head = F.sort_array(F.collect_list(F.when(F.col("row") < 2, F.struct("row", "col", F.coalesce("value", F.lit("")).alias("v")))))
    found = cells.groupBy("page_id", "table_id").agg(F.min("top").alias("table_top"), F.array_join(F.transform(head, lambda c: c["v"]), " ").alias("head"))
    # the tables of a page meet its lines, and each keeps those above it
    lines = text_lines(words).select("page_id", "line", "top", "text")
    near = F.when((F.col("top") < F.col("table_top")) & (F.col("top") >= F.col("table_top") - CAPTION_POINTS), F.struct("line", "text"))
    above = found.join(lines, "page_id", "left").groupBy("page_id", "table_id").agg(F.first("head").alias("head"), F.sort_array(F.collect_list(near)).alias("near"))
    caption = F.array_join(F.transform("near", lambda x: x["text"]), "\n")
    return above.select("table_id", caption.alias("caption"), "head").select("table_id", "caption", scale_phrase(F.concat_ws(" ", "caption", "head")).alias("scale"))


def header_rows(cells: DataFrame) -> DataFrame:
    """(table_id, rows, header_rows) of every table: 0 without rows, 2 for groups over names, else 1.

    Two levels need three rows, a first row with at least two different short groups, and a second one of as many cells, all but the first filled with short texts that are no numbers.
    """
    value = F.coalesce(F.trim("value"), F.lit(""))
    top = F.collect_set(F.when((F.col("row") == 0) & (value != ""), value))  # of one row
    below = (F.col("row") == 1) & (F.col("col") > 0)
    fits = (value != "") & (F.length(value) <= HEADER_CHARS) & ~texts.is_number_cell(value)
    found = cells.groupBy("table_id").agg(
        (F.max("row") + 1).alias("rows"), F.count_if(F.col("row") == 0).alias("width"), F.count_if(F.col("row") == 1).alias("below"), top.alias("groups"), F.bool_and(F.when(below, fits)).alias("names")
    )
    two = (F.col("rows") >= 3) & (F.col("width") == F.col("below")) & (F.col("width") >= 2) & (F.size("groups") >= 2) & F.forall("groups", lambda g: F.length(g) <= HEADER_CHARS) & F.coalesce("names", F.lit(True))
    return found.select("table_id", "rows", F.when(two, 2).otherwise(1).alias("header_rows"))


def structured(cells: DataFrame, scales: DataFrame | None = None) -> DataFrame:
    """(table_id, row, col, value, row_label, header, unit, period_label, confident, ambiguous) of every data cell.

    `cells` has (table_id, row, col, value) with rows and columns from 0, a row for each cell there is; `scales` (table_id, scale) states tables' scales. Rows count without
    the header. A table whose first column holds numbers for the most part has no labels, and all its cells are ambiguous; so is a cell with several numbers.
    """
    value = F.coalesce(F.trim("value"), F.lit(""))
    rows = cells.join(header_rows(cells), "table_id").withColumn("value", value)
    head = rows.where("row < header_rows")
    along = Window.partitionBy("table_id", "row").orderBy("col").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = F.coalesce(F.last(F.nullif("value", F.lit("")), ignorenulls=True).over(along), F.lit(""))
    head = head.withColumn("value", F.when((F.col("header_rows") == 2) & (F.col("row") == 0), filled).otherwise(F.col("value")))
    headers = head.groupBy("table_id", "col").agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "value"))), lambda h: h["value"]), " ")).alias("header"))

    data = rows.where("row >= header_rows").withColumn("row", F.col("row") - F.col("header_rows"))
    first = data.where("col = 0 and value <> ''").groupBy("table_id").agg((F.count_if(texts.is_number_cell(F.col("value"))) <= F.count("*") / 2).alias("confident"))
    of_row = Window.partitionBy("table_id", "row")
    data = data.join(first, "table_id", "left").withColumn("confident", F.coalesce("confident", F.lit(True)))
    label = F.when(F.col("confident"), F.nullif(F.max(F.when(F.col("col") == 0, F.col("value"))).over(of_row), F.lit("")))
    data = data.withColumn("row_label", label).join(headers, ["table_id", "col"], "left").withColumn("header", F.nullif("header", F.lit("")))
    data = data.withColumn("unit", F.lit("")) if scales is None else data.join(scales.select("table_id", F.col("scale").alias("unit")), "table_id", "left").fillna("", ["unit"])
    period = periods.parse_period(F.col("header"))["label"]
    many = F.size(amounts_in(F.col("value"), F.col("unit"))) > 1
    return data.select("table_id", "row", "col", "value", "row_label", "header", "unit", period.alias("period_label"), "confident", (~F.col("confident") | F.coalesce(many, F.lit(False))).alias("ambiguous"))


def cell_at(cells: DataFrame, asked: DataFrame) -> DataFrame:
    """`asked` (table_id, row, col) with the cell there; out of range all is null."""
    return asked.join(cells, ["table_id", "row", "col"], "left")


def column_units(cells: DataFrame) -> DataFrame:
    """(table_id, col, unit_text): header cells that state a percentage or a scale, joined for each column."""
    heads = cells.join(header_rows(cells), "table_id").where("row < header_rows")
    states = F.lower("value").rlike(rf"%|per\s*cent|percent|\b{_SCALE}\b")
    kept = heads.where(states).groupBy("table_id", "col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", F.trim("value").alias("v")))), lambda h: h["v"]), " ").alias("unit_text"))
    return kept
