"""What a page looks like: lines, blocks and their kinds, column gutters, and the order in which to read it.

Words come as rows (page_id, x0, top, x1, bottom, text) and tables as boxes (page_id, x0, top, x1, bottom). A page's words are a
bounded group, and everything is a window or an aggregate over pages; lines are made of many pages at a time (`page_arrays`). Pages without words have no row anywhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import page_arrays
from .documents import block_numbers, line_numbers

# Words of a line that can tell of columns, gaps that can be gutters, how far gutters of one page may lie apart.
GUTTER_WORDS, GUTTER_LINES, GUTTER_WIDTH, GUTTER_SPREAD = 4, 8, 40.0, 15.0
#: Share of the lines that have a gutter, share of the gutters that lie together, share of the lines whose gutters do.
WITH_GUTTER, TOGETHER, LINES_TOGETHER = 0.5, 0.7, 0.5
# Words of a heading at most; how list items begin; dots that lead to a page number.
HEADING_WORDS = 10
LIST_ITEM = r"^[-•*]\s|^\d+[.)]\s"
DOT_LEADER = r"\.{3,}"


def _lines(w: page_arrays.Words) -> pa.RecordBatch:
    start, of = np.flatnonzero(w.first), np.cumsum(w.first) - 1
    x0, top, x1, bottom = page_arrays.boxes(w.x0, w.top, w.x1, w.bottom, start)
    left = np.where(w.first, np.nan, np.append(np.nan, w.x1[:-1]))
    gap = np.where(w.x0 > left, w.x0 - left, -np.inf)
    widest = np.maximum.reduceat(gap, start)
    place = np.flatnonzero((gap == widest[of]) & (gap > 0))
    place = place[page_arrays.first_of(of[place])]  # the first of several
    gaps = np.full((2, len(start)), np.nan)
    gaps[:, of[place]] = gap[place], (w.x0[place] + left[place]) / 2
    # where there is no height, it counts as 1
    columns = [w.taken("page_id", start), w.taken("line", start), *page_arrays.doubles(x0, top, x1, bottom, np.fmax(bottom - top, 1.0))]
    columns += [pa.array(np.diff(np.append(start, len(of)))), page_arrays.joined(w.text, w.first), *page_arrays.doubles(*gaps)]
    return pa.RecordBatch.from_arrays(columns, names=["page_id", "line", "x0", "top", "x1", "bottom", "height", "words", "text", "gap", "gap_x"])


def text_lines(words: DataFrame) -> DataFrame:
    """(page_id, line, x0, top, x1, bottom, height, words, text, gap, gap_x) of every line; gap is its widest space between words, gap_x the middle."""
    return page_arrays.over_pages(words, _lines, "line int, x0 double, top double, x1 double, bottom double, height double, words long, text string, gap double, gap_x double")


def touches(rows: DataFrame, tables: DataFrame | None, name: str = "in_table") -> DataFrame:
    """Adds whether a row's box meets a table of its page, borders included. A page has few tables."""
    if tables is None:
        return rows.withColumn(name, F.lit(False))
    boxes = tables.groupBy("page_id").agg(F.collect_list(F.struct("x0", "top", "x1", "bottom")).alias("__boxes"))
    meets = lambda t: (F.col("bottom") >= t["top"]) & (F.col("top") <= t["bottom"]) & (F.col("x1") >= t["x0"]) & (F.col("x0") <= t["x1"])
    return rows.join(boxes, "page_id", "left").withColumn(name, F.coalesce(F.exists("__boxes", meets), F.lit(False))).drop("__boxes")


def column_gutters(lines: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """(page_id, lines, multi_column, boundary) for every page.

    A page has two columns if enough lines have a wide space, and these lie at nearly one place. A single wide space tells nothing, nor do
    lines in tables, short ones and those with dots that lead to a number.
    """
    page = Window.partitionBy("page_id")
    asked = (F.col("words") >= GUTTER_WORDS) & ~F.col("in_table") & ~F.col("text").rlike(DOT_LEADER)
    rows = touches(lines, tables).withColumn("asked", asked).withColumn("x", F.when(asked & (F.col("gap") > GUTTER_WIDTH), F.col("gap_x")))
    rows = rows.withColumn("middle", F.percentile("x", 0.5).over(page))
    near = F.count_if(F.abs(F.col("x") - F.col("middle")) < GUTTER_SPREAD)
    found = rows.groupBy("page_id").agg(F.count("*").alias("lines"), F.count_if("asked").alias("n"), F.count("x").alias("wide"), F.coalesce(near, F.lit(0)).alias("near"), F.first("middle").alias("middle"))
    two = (F.col("n") >= GUTTER_LINES) & (F.col("wide") >= WITH_GUTTER * F.col("n")) & (F.col("near") >= TOGETHER * F.col("wide")) & (F.col("near") >= LINES_TOGETHER * F.col("n"))
    return found.select("page_id", "lines", two.alias("multi_column"), F.when(two, F.col("middle")).alias("boundary"))


def reading_order(words: DataFrame, gutters: DataFrame, least: float = GUTTER_WIDTH / 2) -> DataFrame:
    """`words` with line, part (0 across the page, 1 left, 2 right) and position (from 1).

    Lines that cross the gutter, with a word or with a space under `least`, are read where they stand and cut the page to bands; in
    each band the left column comes first.
    """
    rows = line_numbers(words).join(gutters.select("page_id", "boundary"), "page_id", "left")
    line, page = Window.partitionBy("page_id", "line"), Window.partitionBy("page_id")
    left, right = F.max(F.when(F.col("x0") < F.col("boundary"), F.col("x1"))).over(line), F.min(F.when(F.col("x0") >= F.col("boundary"), F.col("x0"))).over(line)
    across = F.col("boundary").isNull() | (left > F.col("boundary")) | (right - left < least)
    rows = rows.withColumn("across", F.coalesce(across, F.lit(False)))
    part = F.when(F.col("across"), 0).when(F.col("x0") < F.col("boundary"), 1).otherwise(2)
    order = page.orderBy("line", "x0", "x1", "text")
    turn = F.when(F.col("across") != F.lag("across").over(order), 1).otherwise(0)
    rows = rows.withColumns({"part": part, "turn": turn}).withColumn("band", F.sum("turn").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.withColumn("position", F.row_number().over(page.orderBy("band", "part", "line", "x0", "x1", "text"))).drop("boundary", "across", "turn", "band")


def block_kinds(lines: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """(page_id, block, lines, x0, top, x1, bottom, kind) of every block; kind is table_adjacent, heading, list, paragraph or unknown."""
    item = F.col("text").rlike(LIST_ITEM)
    blocks = block_numbers(lines).groupBy("page_id", "block").agg(
        F.count("*").alias("lines"), F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"), F.max("words").alias("words"), F.bool_or(item).alias("item")
    )
    kind = (
        F.when(F.col("in_table"), "table_adjacent")
        .when((F.col("lines") == 1) & (F.col("words") <= HEADING_WORDS) & ~F.col("item"), "heading")
        .when(F.col("lines") == 1, "unknown")
        .when(F.col("item"), "list")
        .otherwise("paragraph")
    )
    return touches(blocks, tables).withColumn("kind", kind).drop("words", "item", "in_table")


def page_layouts(words: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """(page_id, lines, blocks, multi_column, boundary, kinds) of every page; kinds counts its blocks."""
    lines = text_lines(words)
    blocks = block_kinds(lines, tables).groupBy("page_id", "kind").agg(F.count("*").alias("n"))
    kinds = blocks.groupBy("page_id").agg(F.sum("n").alias("blocks"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("kinds"))
    return column_gutters(lines, tables).join(kinds, "page_id")


def is_in(inner: str, outer: str, slack: float) -> Column:
    """Whether one box lies in another, borders out by `slack` at most; names are aliases of rows."""
    at = lambda a, c: F.col(f"{a}.{c}")
    return (at(inner, "x0") >= at(outer, "x0") - slack) & (at(inner, "top") >= at(outer, "top") - slack) & (at(inner, "x1") <= at(outer, "x1") + slack) & (at(inner, "bottom") <= at(outer, "bottom") + slack)
